"""Queries over the element table of pages: counts, nested cards, descriptions, images and facts by host."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.facts import layered_facts
from ..operators.resolve import first_new_text
from ..sources import elements, pages
from . import sqltext as s
from .registry import query
from .tables import AS_OF, dealt, listing, table

LIT = F.lit
_BARE = r"regexp_replace(regexp_replace(html, '(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query("page_elements", f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def _(spark, sf):
    walked = elements.page_elements(table(spark, sf, "pages").select("page_id", "html"))
    return elements.element_rows(walked).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("elements_inside", f"""
WITH a AS (SELECT page_id, regexp_extract({_BARE}, '(?s)<nav>.*?</nav>') AS nav FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(nav, '<([a-z][a-z0-9]*)', 1)) AS tag FROM a)
SELECT page_id, tag, count(*) AS n FROM t WHERE tag <> 'nav' GROUP BY ALL""")
def _(spark, sf):
    rows = elements.element_rows(elements.page_elements(table(spark, sf, "pages").select("page_id", "html")))
    found = elements.rows_inside(rows, [F.col("tag") == "nav"], [LIT(True)])
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _of_id(html: str):
    """Mark-up with ``{k}`` as the id."""
    k = F.col("page_id").cast("string")
    return F.concat(*[x for p in html.split("{k}") for x in (LIT(p), k)][:-1])


def _by_kind(spark, sf, url, kinds):
    """Pages of one piece of mark-up per listing, the kinds in turn."""
    rows = dealt(listing(spark, sf).select("id")).select(F.col("id").alias("page_id"))
    html = F.element_at(F.array(*map(_of_id, kinds)), (F.col("page_id") % len(kinds) + 1).cast("int"))
    own = F.concat(LIT("https://site.example/"), F.col("page_id").cast("string"))
    return rows.select("page_id", (own if url is None else url).alias("url"), html.alias("html"))


_NESTED = """<div><ul><li class=outer><h2>Gira <a href='/a/{k}?ref=1'>Acto {k}</a></h2><span class="big price">{k} €</span>
<ul><li><h3><a href="https://other.example/b/{k}">Pase <b>{k}</b></a></h3><i class='precio'>desde 3 €</i></li></ul></li>
<tr><td><h3><a href=c/{k}>Fila {k}</a></h3></td></tr></ul></div>"""


@query("nested_cards", """
SELECT o_orderkey AS page_id, CAST(0 AS BIGINT) AS pos, 'Acto ' || o_orderkey AS title, 'https://site.example/a/' || o_orderkey AS url, o_orderkey || ' €' AS price_text FROM orders
UNION ALL SELECT o_orderkey, 1, 'Pase ' || o_orderkey, 'https://other.example/b/' || o_orderkey, 'desde 3 €' FROM orders
UNION ALL SELECT o_orderkey, 2, 'Fila ' || o_orderkey, 'https://site.example/c/' || o_orderkey, NULL FROM orders""")
def _(spark, sf):
    cards = pages.extract_cards(_by_kind(spark, sf, None, [_NESTED]), "entradas_com")
    return cards.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url", "price_text")


_TEXTS = [
    "<div class='x event-description y'><ul><li><div>Primera parte</div> del acto {k} en la sala</li></ul><span>Fin de la cita {k}</span></div>",
    "<nav><p>Un menú de la página con bastantes palabras</p></nav><section id='event-description'>Texto propio del acto {k}<br>sin párrafo ninguno</section>",
    "<p class='description-condition'>Condiciones de la compra de la entrada {k}</p><div class='long-description'><p>La descripción buena del acto {k} está aquí</p></div>",
    "<article><header>Fuera</header><div class='inner content'><p>Dentro del contenido del acto {k} hay texto<p>y un segundo párrafo {k}</div><p>Resto del artículo</p></article>",
]
_SAID = """CASE o_orderkey % 4 WHEN 0 THEN 'Primera parte del acto ' || o_orderkey || ' en la sala' || chr(10) || 'Fin de la cita ' || o_orderkey
  WHEN 1 THEN 'Texto propio del acto ' || o_orderkey || ' sin párrafo ninguno'
  WHEN 2 THEN 'La descripción buena del acto ' || o_orderkey || ' está aquí'
  ELSE 'Dentro del contenido del acto ' || o_orderkey || ' hay texto' || chr(10) || 'y un segundo párrafo ' || o_orderkey END"""


@query("container_texts", f"SELECT o_orderkey AS page_id, {_SAID} AS descripcion FROM orders")
def _(spark, sf):
    return pages.extract_paragraphs(_by_kind(spark, sf, None, _TEXTS)).select("page_id", "descripcion")


_IMAGES = [
    "<img src='https://i.example/icon.png' width=900><div class='event-image'><p><img data-src='https://i.example/event-{k}.jpg'></p></div>",
    "<div class='logo-poster'><img src='https://i.example/logo-{k}.png'></div><figure class='gran cartel'><span><img src='' data-image='https://i.example/cartel-{k}.jpg'></span></figure>",
    "<img src='https://media.entrees.es/{k}/photo.jpg' width=10><img src='https://i.example/wide-{k}.jpg' width='640'>",
]


@query("event_images", """
SELECT o_orderkey AS page_id, CASE o_orderkey % 3 WHEN 0 THEN 'https://i.example/event-' || o_orderkey || '.jpg'
  WHEN 1 THEN 'https://i.example/cartel-' || o_orderkey || '.jpg' ELSE CASE WHEN o_orderkey % 2 = 0
  THEN 'https://media.entrees.es/' || o_orderkey || '/photo.jpg' ELSE 'https://i.example/wide-' || o_orderkey || '.jpg' END END AS imagen_url FROM orders""")
def _(spark, sf):
    url = F.when(F.col("page_id") % 2 == 0, "https://www.entrees.es/evento/1").otherwise("https://site.example/1")
    return pages.extract_image(_by_kind(spark, sf, url, _IMAGES))


_FACTS = [
    "<body><b class=price>999 €</b><a id='BotonExterno'>COMPRAR ENTRADAS - DESDE: 30 €</a><p class='fecha-info'>10/03/2027 a las 19:30</p><div class=info-ficha><p class=lugar>Teatro Cuyás {k}</p></div></body>",
    "<body><button>Ver</button><button>Sí, por 12,50 €</button><span class='event-venue'>Sala Insular {k}</span><em class=date>12/04/2027</em><time datetime='2027-04-11T21:00'>x</time></body>",
    "<body><i class=precio>999 €</i><div data-testid='min-price-x'>45 €</div><time>15/05/2027</time><p itemprop=location>Pabellón {k}</p></body>",
    "<body><i class=tarifa-unica>8 €</i><span class='fecha'>20/06/2027</span><i class=venue>12,5 € en taquilla</i><i class=venue-name>Teatro Guiniguada {k}</i></body>",
]
_HOSTS = ["www.tomaticket.es", "tickety.es", "www.ticketmaster.es", "teatroguiniguada.es"]


@query("host_facts", """
SELECT o_orderkey AS page_id, ['30.0', '12.5', '45.0', '8.0'][o_orderkey % 4 + 1] AS precio_num,
  ['2027-03-10', '2027-04-11', '2027-05-15', '2027-06-20'][o_orderkey % 4 + 1] AS fecha_iso,
  ['19:30', '21:00', NULL, NULL][o_orderkey % 4 + 1] AS hora,
  ['Teatro Cuyás ', 'Sala Insular ', 'Pabellón ', 'Teatro Guiniguada '][o_orderkey % 4 + 1] || o_orderkey AS lugar FROM orders""")
def _(spark, sf):
    url = F.concat(LIT("https://"), F.element_at(F.array(*[LIT(h) for h in _HOSTS]), (F.col("page_id") % 4 + 1).cast("int")), LIT("/e/1"))
    return layered_facts(pages.fact_candidates(_by_kind(spark, sf, url, _FACTS), LIT(AS_OF)))


@query("first_new_text", rf"""
WITH RECURSIVE line AS (
  SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
page AS (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k,
    list(ord ORDER BY ord) AS ords, list(left({s.strip('left(t, 200)')}, 200) ORDER BY ord) AS marks FROM line WHERE length(t) > 30 GROUP BY lang, doc_id),
walk AS (
  SELECT lang, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS ord FROM (SELECT DISTINCT lang FROM page)
  UNION ALL
  SELECT lang, k, CASE WHEN pick IS NULL THEN seen ELSE list_append(seen, marks[pick]) END, doc_id, ords[pick] FROM (
    SELECT page.lang, page.k, walk.seen, page.doc_id, page.ords, page.marks,
      list_filter(range(1, len(page.marks) + 1), lambda i: NOT list_contains(walk.seen, page.marks[i]))[1] AS pick
    FROM walk JOIN page ON page.lang = walk.lang AND page.k = walk.k + 1))
SELECT doc_id, ord FROM walk WHERE ord IS NOT NULL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "t"))
    taken = first_new_text(docs.filter(F.length("t") > 30), run="lang", order=["doc_id"], place="ord", text="t")
    return taken.select("doc_id", F.col("ord").cast("long").alias("ord"))
