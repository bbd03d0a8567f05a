"""Plain mark-up cut by a pattern gives what the parser gives; pages are dealt to all tasks before they are walked."""

import random

import pytest
from pyspark.sql import functions as F

from listingflow.catalog import page_queries, source_queries
from listingflow.operators import lookups
from listingflow.sources import elements, markup, pieces

SF = "/root/testdata/sf0.001"
BITS = [
    "<!DOCTYPE html>", "<!-- x-y > <b> -->", "<!-->", "<!--a--b-->", "<p>", "</p>", "<li class='a b'>", "</li>", "<a href=c/1>", "<a href=/x/>", "<br/>",
    "<br x=a/>", "<img src='' data-image=\"u\">", "<script>", "</script>", "<script>var t=\"</p>\" & 1;</script>", "<STYLE a=b>p{}</style >", "a < b",
    "&amp;", "&nbsp", "&copy=1", " text\n", "<title>", "</title>", "<TD>", "<tr>", "<table>", "</table>", "<div ID=X>", "</div >", "<input disabled>",
    "<input value=\"a>b\">", "<a href=\"?a=1&amp;b=2\">", "<script/>", "<svg>", "<p\tclass = 'x'>", "<", "</", "<a b c=d e>", "é<b>ñ</b>", "<div a='1'b='2'>",
]


def parsed_tree(page):
    tree = elements.Tree()
    tree.feed(page)
    tree.close()
    while tree.open:
        tree.end_one()
    return "".join(tree.parts), tree.elements


def parsed_regular(page):
    walker = markup.Walker()
    walker.feed(page)
    walker.close()
    while walker.open:
        walker.end_one()
    return "".join(walker.out)


def test_pieces_say_what_the_parser_says():
    draw, plain = random.Random(1), 0
    for _ in range(4000):
        page = "".join(draw.choice(BITS) for _ in range(draw.randint(1, 8)))
        plain += pieces.plain_pieces(page) is not None
        assert elements.tree_of(page) == parsed_tree(page), page
        assert markup.regular(page) == parsed_regular(page), page
    assert plain > 500


@pytest.mark.parametrize("made", [source_queries.event_pages, lambda s, sf: page_queries._by_kind(s, sf, None, ["<p>{k}</p>", "<b>{k}</b>"])])
def test_derived_pages_are_dealt_to_all_tasks(spark, made):
    df = made(spark, SF)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == df.select("page_id").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_repeated_keywords_go_to_the_tasks_once(spark, monkeypatch):
    sent, real = [], lookups._keyword_points
    monkeypatch.setattr(lookups, "_keyword_points", lambda shared: sent.append(shared.value) or real(shared))
    words = spark.createDataFrame([(1, "Rock", "gear")] * 40 + [(2, "Jazz", "gear")] * 41, "ord int, category string, keyword string")
    df = spark.createDataFrame([(1, "New gear", "gear", None)], "id long, nombre string, descripcion string, estilo string")
    out = lookups.classify_by_table(df, words)
    assert [r.estilo for r in out.withColumn("n", F.lit(1)).collect()] == ["Jazz"]
    assert len(sent[0]) == 2
