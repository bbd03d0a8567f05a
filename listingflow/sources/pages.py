"""Captured web pages -> cards, sections, facts, paragraphs, images.

Pages are a table (page_id, url, html).  Cards, descriptions, images and marked facts
are selected from the element table of a page (``elements.page_elements``), so nesting
is real; sections and microdata are cut from a regular form of the mark-up
(``markup.walked``), JSON-LD is read from the mark-up itself.  Each page is walked once
per extraction, in Arrow batches, and all selection is array expressions next to the
scan; nothing shuffles until cards are made unique.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.flags import is_boilerplate, is_generic_title
from ..functions.parse import (
    domain_of, extract_date, extract_hour, extract_price, prefer_ticket_link, resolve_url, valid_image,
)
from ..functions.text import any_contains, blank_to_null, clean_text, let, name_from_slug, strip
from ..operators.facts import usable_venue
from ..operators.survivors import first_seen
from .elements import El, attribute, first, image_source, inside, page_elements, select, text_of
from .markup import plain, walked, whole



def _cls(*parts: str, tag: str | tuple[str, ...] | None = None) -> El:
    """An element whose class attribute contains one of the parts."""
    return El(tag, has=(("class", parts),))


def _link(*parts: str) -> El:
    return El("a", has=(("href", parts),))


# Description containers in order of preference.
DESCRIPTION_CONTAINERS: list[tuple[El, ...]] = [
    (El("div", attr=(("itemprop", "description"),)),), (El("div", cls="description"),), (El(cls="event-description"),),
    (El(id="event-description"),), (El(cls="entry-content"),), (El("article"), El(cls="content")), (El("article"),),
    (El(has=(("class", ("description",)),), lacks=(("class", "condition"),)),), (El(cls="detail-text"),), (El(cls="info-event"),),
    (El(cls="content-detail"),), (El(cls="field-body"),), (El(cls="texto"),), (El(cls="cuerpo"),),
]
# Where the image of an event is, in order of preference; first those of some hosts only.
HOST_IMAGES: dict[str, list[tuple[El, ...]]] = {
    "entrees": [(El("img", has=(("src", ("media.entrees.es",)),)),), (El("img", has=(("data-image", ("media.entrees.es",)),)),)],
}
EVENT_IMAGES: list[tuple[El, ...]] = [
    (El(cls="event-image"), El("img")), (El(cls="detail-image"), El("img")), (_cls("poster"), El("img")), (_cls("cartel"), El("img")),
    (El(cls="main-image"), El("img")), (El(cls="entry-content"), El("img")), (El("article"), El("img")), (_cls("event", "poster", "cartel", tag="img"),),
    (El(cls="contenido"), El("img")), (El(cls="imagen"), El("img")), (El("img", has=(("src", ("tomaticket.com/eventos", "tomaticket.com/images/eventos")),)),),
]
# Marked facts by host, in order of preference; "" is for all hosts not named.
PRICE_MARKS: dict[str, list[tuple[El, ...]]] = {
    "tomaticket": [(El(id="BotonExterno"),), (El("a", cls="btn-compra"),), (El(cls="boton-compra"),), (_link("entradas"), El("span")),
                   (El(cls="event-price"),), (_cls("price"),), (_cls("precio"),)],
    "tickety": [(El(cls="event-price"),), (_cls("price"),), (_cls("precio"),), (El("button", shows="€"),), (El("span", shows="€"),)],
    "ticketmaster": [(El(cls="event-price"),), (_cls("price"),), (El(has=(("data-testid", ("price",)),)),)],
    "guiniguada": [(El(cls="precio"),), (_cls("price"),), (_cls("tarifa"),)],
    "cicca": [(El(cls="precio"),), (_cls("price"),), (_cls("tarifa"),)],
    "auditorio": [], "teatro_galdos": [],
    "": [(El(cls="price"),), (El(cls="precio"),), (_cls("price"),), (_cls("precio"),)],
}
DATE_MARKS: dict[str, list[tuple[El, ...]]] = {
    "tomaticket": [(El("p", cls="fecha-info"),), (El(cls="event-date"),), (El(cls="date"),), (El(cls="fecha"),), (_cls("date"),), (_cls("fecha"),), (El(cls="info-date"),)],
    "tickety": [(El(cls="date"),), (El(cls="fecha"),), (_cls("date"),)],
    "ticketmaster": [(_cls("date"),), (El("time"),), (El(given="datetime"),)],
    "guiniguada": [(El(cls="fecha"),), (_cls("date"),), (El(cls="event-date"),)],
    "cicca": [(El(cls="fecha"),), (_cls("date"),), (El(cls="event-date"),)],
    "auditorio": [(El(cls="event__container__header-info"), El("p")), (El(cls="info"), El("p")), (El(cls="event-info"),)],
    "teatro_galdos": [(El(cls="event__container__header-info"), El("p")), (El(cls="info"), El("p")), (El(cls="event-info"),)],
    "": [(El(cls="event-date"),), (El(cls="date"),), (El(cls="fecha"),), (_cls("date"),), (_cls("fecha"),)],
}
PLACE_MARKS: dict[str, list[tuple[El, ...]]] = {
    "tomaticket": [(El(cls="info-evento"), El(cls="lugar")), (El(cls="venue"),), (El(cls="venue-name"),), (_cls("venue"),), (_cls("lugar"),),
                   (El("p", cls="lugar"),), (El(cls="event-info"), El(cls="location")), (El(cls="info-ficha"), El(cls="lugar"))],
    "tickety": [(El(cls="event-venue"),), (El(cls="venue"),), (El(cls="location"),), (_cls("venue"),), (_cls("location"),), (El(cls="event-detail"), El(cls="venue-name"))],
    "entradascanarias": [(El(cls="venue-name"),), (El(cls="venue"),), (_cls("venue"),), (El(cls="event-location"),), (El(cls="location-name"),)],
    "entradas_com": [(El(cls="venue"),), (El(cls="event-location"),), (_cls("venue"),), (_cls("location"),), (El(cls="lugar"),)],
    "": [(El(cls="venue"),), (El(cls="venue-name"),), (El(cls="location"),), (_cls("venue"),), (_cls("location"),),
         (El(attr=(("itemprop", "location"),)),), (_cls("lugar"),)],
}
# Marks of list items in section pages.
SECTION_MARKS = {"lugar": ["📍"], "fecha": ["🗓", "📆"], "hora": ["⏰", "⏱"], "precio": ["💶"]}
SECTION_SKIP = ["suscríbete", "conclusión"]
# One rule per kind of listing page.  ``card`` selects the cards of a page, the others pick
# the first element of a field inside a card.
_HEADINGS = ("h1", "h2", "h3", "h4")
CARD_RULES: dict[str, dict[str, tuple[El, ...]]] = {
    "tomaticket": {"card": (_cls("eventtt", tag="a"),), "title": (El("h2"),), "date": (_cls("fecha"),)},
    "tickety": {"card": (_link("/event/"),), "title": (El(_HEADINGS),)},
    "entradas_com": {"card": (El(("tr", "li", "article")),), "title": (El(("h2", "h3")), El("a")), "price": (_cls("price", "precio"),)},
    "entrees": {"card": (_link("/evento/", "/entradas/"),), "title": (El(("h2", "h3")),), "place": (_cls("location", "lugar", "venue"),),
                "price": (_cls("price", "precio"),)},
    "cicca": {"card": (_cls("et_pb_post", tag="article"),), "title": (El("h4"),)},
    "guiniguada": {"card": (_link("/eventos/"),)},
    "teldecultura": {"card": (_cls("event-card", "em-event-item", "bloque-evento", tag=("article", "div")),), "title": (El(_HEADINGS),)},
    "salanproducciones": {"card": (_cls("elementor-post", tag="article"),), "title": (El("h3"),)},
    "ticketmaster": {"card": (_link("/event/", "/activity/"),), "title": (El(("h2", "h3")),), "date": (_cls("date", "fecha"),),
                     "place": (_cls("venue", "location"),)},
    "entradium": {"card": (_link("/es/events/"),)},
    "generico": {"card": (El("a", given="href"),)},
}
DOTALL = "(?is)"


def tag_text(html: Column) -> Column:
    """Visible text of a piece of mark-up: scripts and tags out, basic entities read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return clean_text(out)


def _pick(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(html, DOTALL + pattern, group)


def _image_of(html: Column) -> Column:
    src = blank_to_null(_pick(html, r"<img\b[^>]*\ssrc=\"([^\"]*)\""))
    lazy = blank_to_null(_pick(html, r"<img\b[^>]*\sdata-(?:src|image)=\"([^\"]*)\""))
    return F.coalesce(src, lazy)


def shown(text: Column, e: Column) -> Column:
    """Cleaned text of an element; null without one."""
    return let(e, lambda x: F.when(x.isNotNull(), clean_text(text_of(text, x))))


def extract_cards(
    pages: DataFrame, rule: Mapping[str, tuple[El, ...]] | str, *, base: Column | None = None,
    max_text: int | None = None, slash: str = "keep",
) -> DataFrame:
    """Cards of listing pages (page_id, pos, title, url, image, date, price, place, text).

    Cards inside cards are cards of their own.  Relative links are resolved against the
    page's own site.  Cards are unique by URL in (page, position) order.
    """
    rule = CARD_RULES[rule] if isinstance(rule, str) else rule
    site = base if base is not None else F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0)
    elements, text = F.col("elements"), F.col("text")
    walked_pages = page_elements(pages.select("page_id", site.alias("site"), "html")).drop("html")

    def picked(e: Column) -> Column:
        own = inside(elements, e)
        linked = F.coalesce(attribute(e, "href"), attribute(first(select(elements, text, El(given="href"), among=own)), "href"))
        image = image_source(first(select(elements, text, El("img"), among=own)))
        fields = [shown(text, first(select(elements, text, *rule[f], among=own))).alias(f"{f}_text") if f in rule
                  else F.lit(None).cast("string").alias(f"{f}_text") for f in ("title", "date", "price", "place")]
        return F.struct(linked.alias("href"), image.alias("image"), *fields, shown(text, e).alias("text"))

    cards = walked_pages.select("page_id", "site", F.posexplode(F.transform(select(elements, text, *rule["card"]), picked)).alias("pos", "card"))
    cards = cards.select("page_id", "site", "pos", "card.*")
    href = blank_to_null(F.col("href"))
    absolute = F.when(href.rlike("^https?://"), href).when(
        F.startswith(href, F.lit("/")), F.concat("site", href)
    ).otherwise(F.concat("site", F.lit("/"), href))
    url = F.regexp_extract(absolute, r"^[^?]*", 0)
    if slash == "drop":
        url = F.regexp_replace(url, "/+$", "")
    cards = cards.withColumn("url", url).filter(F.col("url").isNotNull() & (F.col("url") != ""))
    cards = first_seen(cards, ["url"], ["page_id", "pos"])
    title = F.coalesce(blank_to_null(F.col("title_text")), blank_to_null(F.col("text")), name_from_slug(F.col("url")))
    return cards.select(
        "page_id", "pos", title.alias("title"), "url", valid_image(F.col("image")).alias("image"),
        *(blank_to_null(F.col(f"{f}_text")).alias(f"{f}_text") for f in ("date", "price", "place")),
        (F.substring("text", 1, max_text) if max_text else F.col("text")).alias("text"),
    )


def extract_microdata(pages: DataFrame) -> DataFrame:
    """schema.org microdata blocks: title, start, place, background image, tags."""
    block = whole(r"<article\b[^>]*itemtype=\"[^\"]*Event[^\"]*\"[^>]*")
    rows = pages.select("page_id", "url", walked(F.col("html")).alias("html")).select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(DOTALL + block), 0)).alias("pos", "block"),
    ).withColumn("block", plain(F.col("block")))
    b = F.col("block")
    tags = F.regexp_extract_all(b, F.lit(DOTALL + r"<span\b[^>]*badge[^>]*>(.*?)</span>"), 1)
    image = blank_to_null(_pick(b, r"url\(['\"]?([^'\")]+)['\"]?\)"))
    return rows.select(
        "page_id", "url", "pos",
        tag_text(_pick(b, r"<h5\b[^>]*>(.*?)</h5>")).alias("title"),
        blank_to_null(_pick(b, r"<meta\b[^>]*itemprop=\"startDate\"[^>]*content=\"([^\"]*)\"")).alias("start"),
        blank_to_null(tag_text(_pick(b, r"class=\"[^\"]*text-truncate[^\"]*\"[^>]*>(.*?)</"))).alias("place"),
        image.alias("image"),
        F.filter(F.transform(tags, lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", ""))), lambda t: t != "").alias("tags"),
    ).filter(F.col("title") != "")


def segment_sections(pages: DataFrame, as_of: Column, heading: str = "h3") -> DataFrame:
    """One row per heading section; marked list items give place, date, hour and price."""
    part = rf"<{heading}\b[^>]*>"
    split = pages.select("page_id", "url", plain(walked(F.col("html"))).alias("html")).select(
        "page_id", "url", F.posexplode(F.split("html", DOTALL + part)).alias("pos", "part")
    ).filter(F.col("pos") > 0)
    body = F.col("part")
    title = F.regexp_replace(tag_text(_pick(body, rf"^(.*?)</{heading}>")), r"^\d+\.\s*", "")
    rows = split.withColumn("title", strip(title)).filter(
        (F.length("title") >= 4) & ~any_contains(F.lower("title"), SECTION_SKIP)
    )
    items = F.regexp_extract_all(body, F.lit(DOTALL + r"<li\b[^>]*>(.*?)</li>"), 1)

    def marked(marks: Sequence[str], words: Sequence[str] = ()) -> Column:
        def hit(item: Column) -> Column:
            out = any_contains(item, marks)
            return out | any_contains(F.lower(item), words) if words else out
        # The last matching item wins, as later items overwrite earlier ones.
        found = F.try_element_at(F.filter(items, hit), F.lit(-1))
        text = F.regexp_replace(tag_text(found), "[📍🗓📆⏰⏱💶️]", "")
        return F.regexp_replace(text, r"^[:\s]+|[:\s]+$", "")

    links = F.filter(
        F.regexp_extract_all(body, F.lit(DOTALL + r"<a\b[^>]*href=\"([^\"]*)\""), 1),
        lambda u: F.contains(u, F.lit("http")),
    )
    date_text = marked(SECTION_MARKS["fecha"])
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return rows.select(
        "page_id", "pos", "title", marked(SECTION_MARKS["lugar"]).alias("place"),
        date_text.alias("date_text"), extract_date(date_text, as_of).alias("day"),
        extract_hour(marked(SECTION_MARKS["hora"])).alias("hour"),
        extract_price(marked(SECTION_MARKS["precio"], ["precio", "gratuita", "gratis", "entrada libre", "€"])).alias("price"),
        valid_image(_image_of(body)).alias("image"),
        prefer_ticket_link(links, F.col("url"), host).alias("link"),
    )


# ---------------------------------------------------------------- JSON-LD
def jsonld_items(html: Column) -> Column:
    """Array of all JSON-LD objects of a page; lists are opened, bad scripts skipped."""
    pattern = r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
    scripts = F.regexp_extract_all(html, F.lit(DOTALL + pattern), 1)

    def opened(data: Column) -> Column:
        return F.coalesce(F.try_variant_get(data, "$", "array<variant>"), F.array(data))

    data = F.filter(F.transform(scripts, F.try_parse_json), lambda d: d.isNotNull())
    return F.flatten(F.transform(data, opened))


def _text_at(item: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(item, path, "string"), F.lit(""))


def _raw_text(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "string")


def _first_text(item: Column, name: str, inner: Sequence[str]) -> Column:
    """Text of a member that may be a list, an object or plain text."""
    objects = [F.try_variant_get(item, f"$.{name}{at}", "map<string,variant>") for at in ("[0]", "")]
    plain = F.coalesce(_text_at(item, f"$.{name}[0]"), _text_at(item, f"$.{name}"))
    members = [_text_at(item, f"$.{name}{at}.{i}") for at in ("[0]", "") for i in inner]
    return F.coalesce(*members, F.when(F.coalesce(*objects).isNull(), plain))


def extract_jsonld(pages: DataFrame, as_of: Column, types: Sequence[str] = v.EVENT_TYPES) -> DataFrame:
    """First event object of each page with price, date, hour, venue, image and offer link.

    Every step works inside the page's row, so nothing shuffles.
    """
    typed = F.filter(jsonld_items(F.col("html")), lambda i: _raw_text(i, "$['@type']").isin(*types))
    item = F.col("item")
    # A generator instead of "first and not null": a filter would be pushed below
    # and parse the scripts a second time.
    flat = pages.select("page_id", F.explode(F.slice(typed, 1, 1)).alias("item")).select(
        "page_id", _text_at(item, "$.name").alias("name"), _text_at(item, "$.startDate").alias("start"),
        _first_text(item, "offers", ["price", "lowPrice"]).alias("price"),
        strip(_first_text(item, "location", ["name"])).alias("venue"),
        _first_text(item, "image", ["url"]).alias("image"),
        _first_text(item, "offers", ["url"]).alias("offer_url"),
    )
    start = F.col("start")
    return flat.select(
        "page_id", "name", "start", extract_date(start, as_of).alias("day"),
        extract_hour(start).alias("hour"), F.col("price").try_cast("double").alias("price"),
        F.when(F.length("venue") > 2, F.col("venue")).alias("venue"),
        valid_image(F.col("image")).alias("image"),
        F.when(F.startswith("offer_url", F.lit("http")), F.col("offer_url")).alias("offer_url"),
    )


def extract_article_date(pages: DataFrame, as_of: Column) -> DataFrame:
    """Publication date of the first article object, in a graph or at top level."""
    def dated(kinds: Sequence[str]):
        return lambda i: _raw_text(i, "$['@type']").isin(*kinds) & _raw_text(i, "$.datePublished").isNotNull()

    def articles(item: Column) -> Column:
        graph = F.try_variant_get(item, "$['@graph']", "array<variant>")
        return F.coalesce(
            F.filter(graph, dated(v.GRAPH_ARTICLE_TYPES)), F.filter(F.array(item), dated(v.ARTICLE_TYPES))
        )

    found = F.flatten(F.transform(jsonld_items(F.col("html")), articles))
    published = F.col("published")
    return (
        pages.select("page_id", F.explode(F.slice(found, 1, 1)).alias("item"))
        .select("page_id", _text_at(F.col("item"), "$.datePublished").alias("published"))
        .select("page_id", "published", extract_date(published, as_of).alias("day"),
                extract_hour(published).alias("hour"))
    )


# ---------------------------------------------------------------- text and image
def _lines(text: Column, parts: Column, min_size: int) -> Column:
    """Cleaned texts of elements above a size and not boilerplate, joined by new lines."""
    texts = F.transform(parts, lambda e: clean_text(text_of(text, e)))
    return F.array_join(F.filter(texts, lambda t: (F.length(t) > min_size) & ~is_boilerplate(t)), "\n")


def _container_text(elements: Column, text: Column, path: tuple[El, ...]) -> Column:
    """What the first container says: its p, li and span elements, or all of it where it has none; null without one."""
    def said(e: Column) -> Column:
        parts = select(elements, text, El(("p", "li", "span")), among=inside(elements, e))
        own = clean_text(text_of(text, e))
        whole_text = F.when(~is_boilerplate(own), own).otherwise("")
        return F.when(e.isNotNull(), let(parts, lambda p: F.when(F.size(p) > 0, _lines(text, p, 5)).otherwise(whole_text)))

    return let(first(select(elements, text, *path)), said)


def _descriptions(containers: Sequence[tuple[El, ...]], min_text: int) -> list[Column]:
    """Usable texts of the containers, in order of preference, then the loose paragraphs; null where there is none."""
    elements, text = F.col("elements"), F.col("text")
    found = [_container_text(elements, text, path) for path in containers]
    usable = [let(f, lambda t: F.when((F.length(t) > min_text) & ~is_boilerplate(t), t)) for f in found]
    frame = select(elements, text, El(("nav", "footer")))
    loose = let(frame, lambda outer: _lines(text, F.filter(
        elements, lambda e: e["tag"].isin("p", "li") & ~F.exists(outer, lambda o: (e["n"] > o["n"]) & (e["n"] <= o["last"]))), 20))
    return [*usable, F.nullif(loose, F.lit(""))]


def description_candidates(
    pages: DataFrame, containers: Sequence[tuple[El, ...]] = DESCRIPTION_CONTAINERS, min_text: int = 30,
) -> DataFrame:
    """(page_id, url, ord, descripcion): texts of the containers in order of preference, then the loose paragraphs.

    Loose paragraphs are all of the page but those in navigation and footers.
    """
    body = page_elements(pages.select("page_id", "url", "html")).drop("html")
    texts = F.array(*_descriptions(containers, min_text))
    return body.select("page_id", "url", F.posexplode(texts).alias("ord", "descripcion")).filter("descripcion IS NOT NULL")


def _ranked(rank: Column, value: Column) -> Column:
    """(rank, value), null without a value."""
    return let(value, lambda x: F.when(x.isNotNull(), F.struct(rank.cast("long").alias("rank"), x.alias("value"))))


def _first_given(ranked: Sequence[tuple[Column, Column]]) -> Column:
    """(rank, value) of the first value that is not null; none after it is computed."""
    return F.coalesce(*[_ranked(rank, value) for rank, value in ranked])


def extract_paragraphs(pages: DataFrame, containers: Sequence[tuple[El, ...]] = DESCRIPTION_CONTAINERS,
                       min_text: int = 30) -> DataFrame:
    """Description of each page: first container with enough text, else loose paragraphs."""
    texts = _descriptions(containers, min_text)
    body = page_elements(pages.select("page_id", "html")).drop("html")
    found = body.select("page_id", F.explode(F.array(_first_given([(F.lit(i), t) for i, t in enumerate(texts)]))).alias("d"))
    best = found.groupBy("page_id").agg(F.min_by("d.value", "d.rank").alias("descripcion"))
    return pages.select("page_id", "url").join(best, "page_id", "left")


def _event_images() -> list[tuple[int, int, Column]]:
    """(layer, pos, image): og:image, then images of the event in order of preference."""
    elements, text = F.col("elements"), F.col("text")
    og = attribute(first(select(elements, text, El("meta", attr=(("property", "og:image"),)))), "content")
    hosts = [(host, path) for host, paths in HOST_IMAGES.items() for path in paths] + [("", path) for path in EVENT_IMAGES]
    found = [(1, 0, valid_image(og))]
    for pos, (host, path) in enumerate(hosts):
        source = let(first(select(elements, text, *path)), image_source)
        if host:
            source = F.when(domain_of(F.col("url")) == host, source)
        found.append((2, pos, valid_image(let(source, lambda u: F.when(~F.contains(F.lower(u), F.lit("logo")), u)))))
    return found


def _wide_images(wide_images: int | None) -> Column:
    """Array of (layer, pos, image) of wide images."""
    images = select(F.col("elements"), F.col("text"), El("img"))
    return F.transform(F.slice(images, 1, wide_images) if wide_images is not None else images, lambda e, i: F.struct(
        F.lit(3).alias("layer"), i.alias("pos"), valid_image(F.when(
            (attribute(e, "width").try_cast("int") > 200) & ~any_contains(F.lower(image_source(e)), ["logo", "icon"]), image_source(e))).alias("image")))


def image_candidates(pages: DataFrame, *, wide_images: int | None = None) -> DataFrame:
    """(page_id, layer, pos, image): og:image, then images of the event in order of preference, then wide images.

    ``wide_images`` looks for wide ones among the first images only; the default takes all.
    """
    walked_pages = page_elements(pages.select("page_id", "url", "html")).drop("html")
    events = [F.struct(F.lit(layer).alias("layer"), F.lit(pos).alias("pos"), image.alias("image")) for layer, pos, image in _event_images()]
    found = F.concat(F.array(*events), _wide_images(wide_images))
    return walked_pages.select("page_id", F.explode(found).alias("c")).select("page_id", "c.*").filter("image IS NOT NULL")


def extract_image(pages: DataFrame) -> DataFrame:
    """The first image of each page; pages without one are left out.  No layer after the first that has one is looked at."""
    walked_pages = page_elements(pages.select("page_id", "url", "html")).drop("html")
    wide = F.get(F.filter(_wide_images(None), lambda c: c["image"].isNotNull()), F.lit(0))
    ranked = [(F.lit((layer << 32) + pos), image) for layer, pos, image in _event_images()]
    best = F.coalesce(_first_given(ranked), let(wide, lambda w: _ranked(F.lit(3 << 32) + w["pos"], w["image"])))
    found = walked_pages.select("page_id", F.explode(F.array(best)).alias("c"))
    return found.filter("c IS NOT NULL").groupBy("page_id").agg(F.min_by("c.value", "c.rank").alias("imagen_url"))


def extract_heading(pages: DataFrame) -> DataFrame:
    """First ``h1`` over five characters, unless it is a portal phrase."""
    text = tag_text(_pick(F.col("html"), r"<h1\b[^>]*>(.*?)</h1>"))
    return pages.select(
        "page_id", F.when((F.length(text) > 5) & ~is_generic_title(text), text).alias("nombre_deep")
    )


# ---------------------------------------------------------------- fact layers
def _marked(marks: Mapping[str, list[tuple[El, ...]]]) -> Column:
    """Texts of the first match of each selector of the page's host."""
    elements, text = F.col("elements"), F.col("text")

    def texts(paths: list[tuple[El, ...]]) -> Column:
        found = [shown(text, first(select(elements, text, *path))) for path in paths]
        return F.array(*found) if found else F.array().cast("array<string>")

    out = texts(marks[""])
    for name, paths in marks.items():
        if name:
            out = F.when(F.col("host") == name, texts(paths)).otherwise(out)
    return out


def _fact_parts(pages: DataFrame, as_of: Column, text_size: int | None, time_tags: int | None, *, missing: bool) -> DataFrame:
    """What the layers read: facts of the event object, texts of marks, time tags and visible text, and the page's host.

    With ``missing`` marks are looked for only where the event object lacks a fact they may give.
    """
    host = domain_of(F.col("url")) if "url" in pages.columns else F.lit("")
    typed = F.filter(jsonld_items(F.col("html")), lambda i: _raw_text(i, "$['@type']").isin(*v.EVENT_TYPES))
    item, start, venue = F.col("item"), F.col("start"), F.col("venue")
    walked_pages = page_elements(pages).select("page_id", host.alias("host"), F.get(typed, F.lit(0)).alias("item"), "elements", "text")
    told = walked_pages.select(
        "page_id", "host", "elements", "text", _text_at(item, "$.startDate").alias("start"),
        _first_text(item, "offers", ["price", "lowPrice"]).try_cast("double").alias("ld_price"),
        strip(_first_text(item, "location", ["name"])).alias("venue"),
    ).select(
        "page_id", "host", "elements", "text", "ld_price", extract_date(start, as_of).alias("ld_day"), extract_hour(start).alias("ld_hour"),
        F.when(F.length(venue) > 2, venue).alias("ld_venue"),
    )
    elements, shown_text = F.col("elements"), F.col("text")
    times = F.transform(select(elements, shown_text, El("time", given="datetime")), lambda e: attribute(e, "datetime"))
    body = first(select(elements, shown_text, El("body")))
    text = clean_text(let(body, lambda b: F.when(b.isNotNull(), text_of(shown_text, b)).otherwise(shown_text)))

    def marked(marks: Mapping[str, list[tuple[El, ...]]], *facts: str) -> Column:
        lacking = reduce(or_, (F.col(fact).isNull() for fact in facts))
        return F.when(lacking, _marked(marks)) if missing else _marked(marks)

    return told.select(
        "page_id", "host", "ld_price", "ld_day", "ld_hour", "ld_venue",
        marked(PRICE_MARKS, "ld_price").alias("prices"), marked(DATE_MARKS, "ld_day", "ld_hour").alias("dates"),
        marked(PLACE_MARKS, "ld_venue").alias("venues"), (F.slice(times, 1, time_tags) if time_tags else times).alias("times"),
        (F.substring(text, 1, text_size) if text_size else text).alias("body"),
    )


def _fact_layers(as_of: Column) -> dict[str, list[tuple[int, Column]]]:
    """(layer, values by position) of each field, in the order of the layers; a null array is a layer the page does not have."""
    def price(c: Column) -> Column:
        return extract_price(c).cast("string")

    def day(c: Column) -> Column:
        return extract_date(c, as_of).cast("string")

    def hour(c: Column) -> Column:
        return extract_hour(c)

    def dated(told: str, value: Callable[[Column], Column]) -> list[tuple[int, Column]]:
        # Dates of marked elements come before the time tags on one host and after them on the others.
        early, marks = F.col("host") == "tomaticket", F.transform("dates", lambda t: value(t))
        return [(1, F.array(F.col(told).cast("string"))), (2, F.when(early, marks)), (3, F.transform("times", lambda t: value(t))),
                (4, F.when(~early, marks)), (5, F.array(value(F.col("body"))))]

    return {
        "precio_num": [(1, F.array(F.col("ld_price").cast("string"))), (2, F.transform("prices", price)), (5, F.array(price(F.col("body"))))],
        "fecha_iso": dated("ld_day", day), "hora": dated("ld_hour", hour),
        "lugar": [(1, F.array("ld_venue")), (2, F.transform("venues", lambda t: F.nullif(t, F.lit(""))))],
    }


def _facts(field: str, layer: int, values: Column) -> Column:
    """Array of (field, layer, ord, value) of the values there are."""
    found = F.transform(values, lambda x, i: F.struct(F.lit(field).alias("field"), F.lit(layer).alias("layer"), i.alias("ord"), x.alias("value")))
    return F.filter(found, lambda f: f["value"].isNotNull())


def fact_candidates(
    pages: DataFrame, as_of: Column, *, text_size: int | None = None, time_tags: int | None = None,
) -> DataFrame:
    """(page_id, field, layer, ord, value) from JSON-LD, marked elements, ``time`` tags and text.

    One pass over the pages.  ``text_size`` limits the text layer and ``time_tags`` the
    number of ``time`` tags; the default reads the whole visible text and all tags.  Marked
    elements are looked for by the selectors of the page's host.
    """
    parts = _fact_parts(pages, as_of, text_size, time_tags, missing=False)
    facts = [F.coalesce(_facts(field, layer, values), F.array()) for field, found in _fact_layers(as_of).items() for layer, values in found]
    return parts.select("page_id", F.inline(F.concat(*facts)))


def first_facts(
    pages: DataFrame, as_of: Column, *, text_size: int | None = None, time_tags: int | None = None,
) -> DataFrame:
    """The first of the :func:`fact_candidates` of each page and field that ``layered_facts`` takes; no layer after it is looked at."""
    def first_of(field: str, layer: int, values: Column) -> Column:
        found = _facts(field, layer, values)
        if field == "lugar" and layer > 1:
            found = F.filter(found, lambda f: usable_venue(f["value"]))
        return first(found)

    best = [F.coalesce(*(first_of(field, layer, values) for layer, values in found)) for field, found in _fact_layers(as_of).items()]
    parts = _fact_parts(pages, as_of, text_size, time_tags, missing=True)
    return parts.select("page_id", F.inline(F.array_compact(F.array(*best))))
