"""Page extraction on nested, single-quoted and reordered mark-up; values written by hand."""

import pytest
from pyspark.sql import functions as F

from listingflow.sources import pages
from listingflow.sources.markup import regular

URL = "https://site.example/agenda"


def table(spark, *html):
    return spark.createDataFrame([(i, URL, h) for i, h in enumerate(html, 1)], "page_id long, url string, html string")


def test_regular_form():
    assert regular("<P>a<p CLASS='x \"y\"'>b<br>c&amp;<!-- no --></div>") == (
        '<p data-el="1">a</p data-el="1"><p class="x &quot;y&quot;" data-el="2">b<br data-el="3">c&amp;</p data-el="2">')
    assert regular("<ul><li>1<li>2<ul><li>3</ul></ul>") == (
        '<ul data-el="1"><li data-el="2">1</li data-el="2"><li data-el="3">2<ul data-el="4"><li data-el="5">3</li data-el="5">'
        '</ul data-el="4"></li data-el="3"></ul data-el="1">')
    assert regular("<meta content='u' property=og:image>") == '<meta property="og:image" content="u" data-el="1">'
    assert regular("") == "" and regular("< 3 & <x") is not None


def test_paragraphs_of_nested_containers(spark):
    a, b, c = ("First paragraph with enough words in it.", "Second paragraph with enough words too.", "Third one is long enough to be taken.")
    got = {r.page_id: r.descripcion for r in pages.extract_paragraphs(table(
        spark, f"<section class='entry-content'><p>{a}</p><p>{b}</p></section>",
        f'<div class="description"><div><p>{a}</p></div><div><p>{b}</p></div><p>{c}</p></div><p>outside of the description</p>',
        f"<div itemprop=description><p>{a}<p>{b}</div>", f"<nav><div><p>{a}</p></div><p>{b}</p></nav><p>{c}</p>", None, "",
    )).collect()}
    assert got == {1: f"{a}\n{b}", 2: f"{a}\n{b}\n{c}", 3: f"{a}\n{b}", 4: c, 5: None, 6: None}


CARDS = {
    "tomaticket": "<a href='/e/1' class='x eventtt'><h2>Title one</h2><p class='fecha big'>1 mayo 2027</p></a>",
    "tickety": "<a class=c href='https://site.example/event/1'><div><h3>Title one</h3></div></a>",
    "entradas_com": "<li><div><h2><a href='/e/1'>Title one</a></h2><ul><li class=price>5</li></ul></div></li>",
    "entrees": "<a href='/evento/1'><h3>Title one</h3><span class='lugar'>Hall</span></a>",
    "cicca": "<article class='et_pb_post a'><h4><a href='/e/1'>Title one</a></h4></article>",
    "guiniguada": "<a href='/eventos/title-one'>Title one</a>",
    "teldecultura": "<div class='em-event-item'><div><div>x</div></div><h3>Title one</h3><a href='/e/1'>more</a></div>",
    "salanproducciones": "<article class='elementor-post'><div><h3>Title one</h3></div><a href='/e/1'>more</a></article>",
    "ticketmaster": "<a href='/event/1'><h3>Title one</h3><div class='date'>1 mayo</div><div class='venue'>Hall</div></a>",
    "entradium": "<a href='/es/events/1'>Title one</a>",
    "generico": "<a href='/x/1'>Title one</a>",
}


@pytest.mark.parametrize("rule", sorted(pages.CARD_RULES))
def test_every_card_rule(spark, rule):
    rows = pages.extract_cards(table(spark, f"<div><div>{CARDS[rule]}</div></div>", None, ""), rule).collect()
    assert [r.title for r in rows] == ["Title one"] and rows[0].url.startswith("https://site.example/")


def test_images_and_microdata(spark):
    rows = {r.page_id: r.imagen_url for r in pages.extract_image(table(
        spark, "<meta content='https://i.example/a.jpg' property='og:image'>", "<img width='300' src='https://i.example/w.jpg'>",
        "".join("<img src='https://i.example/s.jpg' width=1>" for _ in range(40)) + "<img class='poster' src='https://i.example/p.jpg'>",
    )).collect()}
    assert rows == {1: "https://i.example/a.jpg", 2: "https://i.example/w.jpg", 3: "https://i.example/p.jpg"}
    block = "<article itemtype='https://schema.org/Event'><article>inner</article><meta content='2027-05-01' itemprop='startDate'><h5>Night</h5></article>"
    got = pages.extract_microdata(table(spark, block)).collect()
    assert [(r.title, r.start) for r in got] == [("Night", "2027-05-01")]


def test_facts_of_single_quoted_marks(spark):
    page = "<span class='price'>12 €</span><time datetime='2027-05-01T20:30:00'>x</time>"
    facts = {(r.field, r.layer): r.value for r in pages.fact_candidates(table(spark, page), F.lit("2027-01-01").cast("date")).collect()}
    assert facts["precio_num", 2] == "12.0" and facts["fecha_iso", 3] == "2027-05-01" and facts["hora", 3] == "20:30"
