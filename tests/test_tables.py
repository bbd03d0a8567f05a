"""Upsert, streaming, sinks and sources on small written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listingflow.functions.text import fold
from listingflow.operators import lookups, quality, serving, sets, upsert
from listingflow.plans.refine import refine, require_gates
from listingflow.schema import LISTING_SCHEMA, conform
from listingflow.sources import listings, pages, sinks
from listingflow.streaming.upsert_stream import read_target, upsert_batch, upsert_stream



def now():
    return F.lit("2027-01-01 10:00:00").cast("timestamp")


COLS = "id long, nombre string, lugar string, fecha_iso date, hora string, organiza string, url_venta string, precio_num double, event_group_id string, last_seen_at timestamp"


def rows(spark, data):
    full = [(i, n, "Sala", dt.date(2027, 1, d), h, "CICCA", f"u{i}", p, g, dt.datetime(2027, 1, 1, 0, 0, i)) for i, n, d, h, p, g in data]
    df = conform(spark.createDataFrame(full, COLS))
    return df.withColumn("hash_id", upsert.hash_key("ingest"))


def as_map(df):
    return {r.hash_id: (r.nombre, r.precio_num, r.event_group_id, r.organiza) for r in df.collect()}


def test_upsert_last_row_wins_and_is_idempotent(spark):
    target = rows(spark, [(1, "Rock", 2, "20:00", 5.0, "g1"), (2, "Jazz", 3, None, 6.0, None)])
    batch = rows(spark, [(3, "ROCK", 2, "20:00", 7.0, ""), (4, "rock", 2, "20:00", None, None), (5, "Fado", 4, "", 9.0, "g5"), (6, "FADO", 4, "", 8.0, "")])
    once = upsert.upsert(target, batch, now=now(), order="id")
    got = sorted(as_map(once).values(), key=lambda r: r[0].lower())
    assert got == [("FADO", 8.0, "g5", "CICCA"), ("Jazz", 6.0, None, "CICCA"), ("rock", None, "g1", "CICCA")]
    again = upsert.upsert(once, batch, now=now(), order="id")
    assert as_map(again) == as_map(once)
    assert upsert.upsert_counters(target, batch).first().asDict() == {"insertados": 1, "actualizados": 1}


def test_upsert_ties_do_not_depend_on_row_order(spark):
    target = rows(spark, [(1, "Rock", 2, "20:00", 5.0, "g1")])
    same = [(7, "ROCK", 2, "20:00", 7.0, "x"), (7, "rock", 2, "20:00", 8.0, "y"), (7, "Rock", 2, "20:00", 9.0, "z")]
    got = {tuple(as_map(upsert.upsert(target, rows(spark, order).coalesce(1), now=now(), order="last_seen_at")).items())
           for order in (same, same[::-1], same[1:] + same[:1])}
    assert len(got) == 1


def test_repeated_labels_and_enrichments_keep_one_row(spark):
    df = rows(spark, [(1, "Rock", 2, "20:00", 5.0, "g1"), (2, "Jazz", 3, None, 6.0, None)]).withColumn("lugar", F.lit("Gran Canaria"))
    labels = spark.createDataFrame([(1, "Teatro"), (1, "Cine"), (1, "Otros"), (1, "nothing"), (2, None)], "id long, categoria string")
    first = next(c for c in lookups.v.CATEGORIES if c in ("Teatro", "Cine"))
    assert {r.id: r.estilo for r in lookups.apply_labels(df, labels).collect()} == {1: first, 2: None}
    more = spark.createDataFrame([(1, "x" * 30, 1.0, "20:00", "Sala A"), (1, "y" * 30, 2.0, "21:00", "Sala B")],
                                 "id long, descripcion_limpia string, precio_num double, hora string, lugar_corregido string")
    got = [(r.id, r.lugar, r.descripcion) for r in lookups.apply_enrichment(df, more).orderBy("id").collect()]
    assert got == [(1, "Sala B", "y" * 30), (2, "Gran Canaria", None)]


def test_upsert_stream_equals_batches(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    first = rows(spark, [(1, "Rock", 2, "20:00", 5.0, "g1"), (2, "Jazz", 3, None, 6.0, None)])
    first.coalesce(1).write.parquet(source)
    upsert_stream(spark.readStream.schema(LISTING_SCHEMA).parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    assert len(as_map(read_target(spark, table))) == 2
    rows(spark, [(9, "ROCK", 2, "20:00", 8.0, None)]).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(spark.readStream.schema(LISTING_SCHEMA).parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    got = as_map(read_target(spark, table))
    assert len(got) == 2 and ("ROCK", 8.0, "g1", "CICCA") in got.values()
    before = got
    upsert_batch(rows(spark, [(9, "ROCK", 2, "20:00", 8.0, None)]), table, order="last_seen_at")
    assert as_map(read_target(spark, table)) == before


def test_export_round_trip(spark, tmp_path):
    df = rows(spark, [(1, "Rock", 2, "20:00", 5.0, None), (2, "Jazz", 3, None, None, None)]).withColumn("merged_from_sources", F.lit("CICCA"))
    df = df.unionByName(df.limit(1).withColumn("fecha_iso", F.lit(None).cast("date")))
    path = str(tmp_path / "out")
    sinks.write_split(df, path)
    back = listings.read_export(spark, path + "/confirmed")
    assert sorted((r.nombre, r.precio_num, r.hora) for r in back.collect()) == [("Jazz", "Consultar", "Hora por confirmar"), ("Rock", "5.0", "20:00")]
    assert listings.read_export(spark, path + "/drafts").count() == 1
    back.drop("lugar").write.parquet(path + "/broken")
    with pytest.raises(ValueError, match="required columns"):
        listings.read_export(spark, path + "/broken")
    sinks.write_json_records(back, path + "/json")
    assert spark.read.json(path + "/json").filter("precio_num IS NULL").count() == 1


def test_table_write_read_and_metrics(spark, tmp_path):
    df = rows(spark, [(i, f"t{i}", 1 + i % 20, "20:00", 5.0, None) for i in range(40)])
    sinks.write_table(df, str(tmp_path / "t"))
    back = listings.read_listings(spark, str(tmp_path / "t"))
    assert back.schema == LISTING_SCHEMA and back.count() == 40
    plan = serving.day(back, dt.date(2027, 1, 3)).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(fecha_iso), EqualTo(fecha_iso" in plan
    march = listings.read_listings(spark, str(tmp_path / "t"), dt.date(2027, 3, 1), dt.date(2027, 3, 9))
    assert march.count() == 0 and "PartitionFilters: [isnotnull(month" in march._jdf.queryExecution().toString()
    kpi = quality.run_metrics(*sets.split(df, F.col("fecha_iso").isNotNull()), timestamp=now(), elapsed=1.0)
    for _ in range(2):
        sinks.append_run_metrics(kpi, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_keyword_table_is_a_parameter(spark, tmp_path):
    path = str(tmp_path / "kw")
    spark.createDataFrame([(2, "B", "jazz"), (1, "A", "rock"), (3, "B", "swing")], "ord int, category string, keyword string").write.option("header", True).csv(path)
    words = listings.read_keywords(spark, path)
    text = "Velada de rock, luego jazz"
    df = spark.createDataFrame(
        [(1, text, "swing"), (2, "Noche", "swing y rock"), (3, None, "rock"), (4, "Noche", None), (5, None, None), (6, "ROCK y jazz", ""), (7, "jazz", text * 9000)],
        "id int, nombre string, descripcion string").withColumn("estilo", F.lit("Otros"))
    # 1: B has 3 + 1 points, A 3; 2 and 6: equal points, A comes first.
    expected = {1: "B", 2: "A", 3: "A", 4: "Otros", 5: "Otros", 6: "A", 7: "B"}
    for size in (1000, 8, 1):  # one block, some, and more blocks than keywords
        out = lookups.classify_by_table(df, words, block_chars=size)
        assert out.columns == df.columns and {r.id: r.estilo for r in out.collect()} == expected
    listed = lookups.classify_keywords(df, [("A", ["rock"]), ("B", ["jazz", "swing"])])
    assert {r.id: r.estilo for r in listed.collect()} == expected
    assert lookups.classify_by_table(df, words.limit(0)).filter("estilo <> 'Otros'").isEmpty()


def test_refine_stops_on_generic_titles(spark):
    bad = conform(spark.createDataFrame([(i, "Entradas", dt.date(2027, 5, i + 1)) for i in range(9)], "id long, nombre string, fecha_iso date"))
    with pytest.raises(RuntimeError, match="generic_titles"):
        refine(bad, dt.date(2027, 1, 1))
    staged = {r.gate: r.level for r in quality.staged_gates(bad).collect()}
    assert staged == {"blank_hour": "alert", "generic_titles": "abort"}
    assert refine(bad, dt.date(2027, 1, 1), gates=False).filter("fecha_iso IS NOT NULL").isEmpty()


def test_folding_of_every_script(spark):
    df = spark.createDataFrame([("Й",), ("ά",), ("ﬁn",), ("Ñandú",), (None,)], "x string")
    both = [tuple(r) for r in df.select(fold(F.col("x"), every_script=True), fold(F.col("x"))).collect()]
    assert [a for a, _ in both] == ["и", "α", "fin", "nandu", ""] and both[3][1] == "nandu"


def test_gates_stop_a_run(spark):
    bad = rows(spark, [(i, "Entradas", 2, "20:00", 5.0, None) for i in range(20)])
    with pytest.raises(RuntimeError, match="generic_titles"):
        require_gates(quality.table_gates(bad))


def test_named_windows():
    sat, sun, mon = dt.date(2026, 2, 28), dt.date(2026, 3, 1), dt.date(2026, 3, 2)
    assert serving.date_window("weekend", sat) == (dt.date(2026, 3, 7), dt.date(2026, 3, 8))
    assert serving.date_window("weekend", sun) == (dt.date(2026, 3, 7), dt.date(2026, 3, 8))
    assert serving.date_window("weekend", mon) == (dt.date(2026, 3, 7), dt.date(2026, 3, 8))
    assert serving.date_window("month", sat) == (sat, sat)


PAGE = """<html><head><meta property="og:image" content="https://i.example/a.jpg"/>
<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "WebPage", "datePublished": "2026-05-03T21:00:00"}]}</script></head>
<body><nav><p>menu largo que no cuenta</p></nav><h1>Gran <b>noche</b></h1><article><p>Una velada inolvidable de música.</p>
<p>Aviso legal y cookies de la web</p><img src="https://i.example/logo.png" width="900"></article>
<a class="x eventtt" href="es-es/rock-uno?x=1"><h2>Rock uno</h2><p class="fecha">3 de mayo</p><img src="https://i.example/card-1.jpg"></a>
<a class="eventtt" href="/es-es/rock-uno"><h2>Otra vez</h2></a></body></html>"""


def test_page_extractors(spark):
    df = spark.createDataFrame([(1, "https://www.tomaticket.es/lista", PAGE), (2, "https://x.example/", "<html></html>")], "page_id long, url string, html string")
    cards = pages.extract_cards(df, "tomaticket").collect()
    assert [(c.title, c.url, c.image, c.date_text) for c in cards] == [
        ("Rock uno", "https://www.tomaticket.es/es-es/rock-uno", "https://i.example/card-1.jpg", "3 de mayo")]
    assert {r.page_id: r.nombre_deep for r in pages.extract_heading(df).collect()} == {1: "Gran noche", 2: None}
    texts = {r.page_id: r.descripcion for r in pages.extract_paragraphs(df).collect()}
    assert texts == {1: "Una velada inolvidable de música.", 2: None}
    assert {r.page_id: r.imagen_url for r in pages.extract_image(df).collect()} == {1: "https://i.example/a.jpg"}
    art = pages.extract_article_date(df, F.lit(dt.date(2026, 3, 1))).collect()
    assert [(r.page_id, str(r.day), r.hour) for r in art] == [(1, "2026-05-03", "21:00")]
    empty = df.filter("page_id = 2")
    for rule in pages.CARD_RULES:
        assert pages.extract_cards(empty, rule).count() == 0
