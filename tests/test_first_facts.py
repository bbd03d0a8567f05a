"""The first facts of a page are those the aggregate over all candidates takes, and each selection stands once in the plan."""

import datetime as dt

from pyspark.sql import functions as F

from listingflow.operators.facts import layered_facts
from listingflow.sources import pages

LD = '<script type="application/ld+json">{"@type":"Event"%s}</script>'
MARKED = "<p class=precio>9 €</p><p class=fecha>12/04/2027 a las 20:30</p><p class=fecha-info>13/04/2027</p><p class=venue>12,5 €</p><p class=location>Teatro Cuyás</p>"
TIMES = "<time datetime='x'></time><time datetime='2027-05-01T19:00'></time><time datetime='2027-06-01'></time>"
TEXT = "<p>Gratis el 3 de mayo de 2027 a las 18:00</p>"
PAGES = [
    (host, LD % told + marks + times + text)
    for host in ("https://www.tomaticket.es/e", "https://www.ticketmaster.es/e", "https://auditorioteatrolaspalmasgc.es/e", "https://site.example/e")
    for told in ("", ',"startDate":"2027-02-01"', ',"startDate":"2027-02-01T21:00","offers":{"price":"7"},"location":{"name":"Gran Canaria"}')
    for marks in ("", MARKED) for times in ("", TIMES) for text in ("", TEXT)
] + [("https://www.tomaticket.es/e", None), (None, MARKED), ("x", "")]


def table(spark):
    return spark.createDataFrame([(i // 2, url, html) for i, (url, html) in enumerate(PAGES)], "page_id long, url string, html string")


def test_first_facts_are_those_of_all_candidates(spark):
    as_of, df = F.lit(dt.date(2027, 1, 1)), table(spark)
    first, every = pages.first_facts(df, as_of), pages.fact_candidates(df, as_of)
    assert sorted(map(str, layered_facts(first).collect())) == sorted(map(str, layered_facts(every).collect()))
    rows = first.collect()
    assert len(rows) < every.count() and {r.field for r in rows} == {"precio_num", "fecha_iso", "hora", "lugar"}
    # One value of each field and row of pages; each number is that of two pages.
    assert max(sum(r.page_id == k and r.field == f for r in rows) for k in range(len(PAGES)) for f in ("fecha_iso", "hora")) <= 2


def test_a_selection_stands_once_in_the_plan(spark):
    facts = pages.fact_candidates(table(spark), F.lit(dt.date(2027, 1, 1)))._jdf.queryExecution().analyzed().toString()
    assert facts.count("BotonExterno") == 1
