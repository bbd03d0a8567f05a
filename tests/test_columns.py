"""Column functions on (input, expected) pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listingflow.functions import flags, parse, text

DAY = dt.date(2026, 3, 1)


def check(spark, fn, pairs, expected_type=None):
    rows = [(i, a) for i, (a, _) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, x string").select("i", fn(F.col("x")).alias("y"))
    got = {r.i: r.y for r in df.collect()}
    wrong = [(a, got[i], want) for i, (a, want) in enumerate(pairs) if got[i] != want]
    assert not wrong


def test_price(spark):
    check(spark, parse.extract_price, [
        ("20€", 20.0), ("15.50 EUR", 15.5), ("Gratis", 0.0), ("Entrada Libre", 0.0), ("Precio: 🍒", None),
        (None, None), ("", None), ("COMPRAR ENTRADAS - DESDE: 30 €", 30.0), ("A partir de 15,50", 15.5),
        ("10 - 20€", 10.0), ("15,50€ - 30.00€", 15.5), ("1500€", None), ("501", None), ("12,50 euros", 12.5),
        ("eur 10", 10.0), ("desde:30€", 30.0), ("50 - 60 eur", 50.0), ("Entrada libre y gratuita", 0.0),
        ("precio: 10,00€", 10.0), ("eur 499.99", 499.99), ("30 € / 45 €", 30.0), ("10,80 € – 19,07 €", 10.8),
        ("Descuento 50% (Precio final 20€)", 20.0), ("Próximamente", None), ("15-30€", 15.0),
        ("Gratis o 900€", 0.0),
    ])


def test_date(spark):
    check(spark, lambda c: parse.extract_date(c, F.lit(DAY)).cast("string"), [
        ("2026-02-14T20:00:00", "2026-02-14"), ("Apertura de puertas 19:00 03/04/2026", "2026-04-03"),
        ("14 de febrero 2026", "2026-02-14"), ("14 de febrero", "2026-02-14"), ("Texto random sin fecha", None),
        ("Varias Fechas (06/02/2026 - 30/04/2026)", "2026-02-06"), ("", None), (None, None),
        ("1/2/2026", "2026-02-01"), ("01-02-26", "2026-02-01"), ("15 del mes de febrero", None),
        ("15 de enero del 2026", "2027-01-15"), ("31 DE DICIEMBRE", "2026-12-31"),
        ("Del 1 al 10 de Mayo 2026", "2026-05-01"), ("31/02/2026 o 3 de marzo", "2026-03-03"),
        ("2019-01-01", None), ("Tel. 928/36/1999", None), ("31 de febrero de 2026", None), ("2 de enero", "2027-01-02"),
    ])


def test_year_inference_variants(spark):
    check(spark, lambda c: parse.normalize_date(c, F.lit(DAY)).cast("string"), [
        ("15 de Marzo", "2026-03-15"), ("1 de Ene", "2027-01-01"), ("No hay fecha", None), ("31 de feb", None)])
    check(spark, lambda c: parse.badge_date(c, F.lit("MARZO"), F.lit(DAY)).cast("string"), [
        (" 5", "2026-03-05"), ("32", None), ("x", None)])


def test_date_range(spark):
    check(spark, lambda c: F.to_json(parse.extract_date_range(c)), [
        ("01.10.2024-30.06.2026 x", '{"start":"2024-10-01","end":"2026-06-30","is_course":true}'),
        ("15.03.2026", '{"start":"2026-03-15","end":"2026-03-15","is_course":false}'),
        ("Todo el día", '{"is_course":false}')])
    check(spark, lambda c: parse.last_day_of_range(c, F.lit(DAY)).cast("string"), [("Del 20 al 23 de marzo", "2026-03-23")])


def test_hour(spark):
    check(spark, parse.extract_hour, [
        ("20:30", "20:30"), ("Apertura de puertas 19:00 03/04/2026", "19:00"), ("a las 19:30", "19:30"),
        ("2026-02-14T20:00:00", "20:00"), ("19:30h", "19:30"), ("20.00", "20:00"), ("10.31€", None),
        ("10.30 €", None), ("A las 8:30", "08:30"), ("a las 23.59", "23:59"), ("19hrs", "19:00"), ("20 h", "20:00"),
        ("25:00", None), ("19:60", None), ("9 h.", "09:00"), ("20:45 aprox.", "20:45"), ("06:00", None), ("", None),
        (None, None), ("10/03/2026 a las 19:30", "19:30"), ("22:33", "22:33"), ("50% 7:00", None)])
    check(spark, parse.plain_hour, [("Todo el día 10:00", None), ("9:05", "09:05"), ("nada", None)])
    check(spark, parse.hour_to_minutes, [("20:30", 1230), ("", -999), (None, -999), ("x:y", -999), ("7:05:00", 425)])


def test_local_time(spark):
    check(spark, lambda c: F.to_json(parse.to_local(c)), [
        ("2026-07-27T22:00:00", '{"day":"2026-07-27","hour":"23:00"}'),
        ("2026-07-27T23:30:00+00:00", '{"day":"2026-07-28","hour":"00:30"}'),
        ("2026-01-27T22:00:00Z", '{"day":"2026-01-27","hour":"22:00"}'), ("mañana", "{}"), ("2026-13-45", "{}")])


def test_local_time_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        check(spark, lambda c: F.to_json(parse.to_local(c)), [("2026-07-27T22:00:00", '{"day":"2026-07-27","hour":"23:00"}')])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_image(spark):
    check(spark, parse.valid_image, [
        ("https://example.com/img.jpg", "https://example.com/img.jpg"), ("placeholder.png", None), ("noimage", None),
        ("/relative/path.jpg", None), ("data:image/png;base64,...", None), ("http://sh.ort", None), ("", None), (None, None)])


def test_titles_and_places(spark):
    check(spark, text.strip_place_suffix, [
        ("Concierto en Gran Canaria", "Concierto"), ("Concierto | Las Palmas de Gran Canaria", "Concierto"),
        ("Concierto - Telde", "Concierto"), ("Concierto Islas Canarias", "Concierto"), (None, ""), ("Teldeana", "Teldeana")])
    check(spark, text.canonical_venue, [
        ("Teatro Pérez Galdos", "Teatro Pérez Galdós"), ("Auditorio A. Kraus", "Auditorio Alfredo Kraus"),
        ("GC Arena", "Gran Canaria Arena"), ("vive la experiencia en el parque", None), (None, None), ("", None),
        ("x" * 151, None), ("  Estadio de Gran Canaria  ", "Estadio de Gran Canaria"), ("Infecar, pabellon 7", "INFECAR"),
        ("Fundacion Cicca", "Fundación CICCA"), ("Bar Ñoño", "Bar Ñoño")])
    check(spark, text.strip_suffixes, [
        ("Rock en Canarias en Vivo - Concierto en Las Palmas", "Rock"), ("Jazz - Festival en Las Palmas", "Jazz"), ("Solo –", "Solo")])
    check(spark, text.canonical_title, [("Fito & Fitipaldis en Gran Canaria 2026!", "fito y fitipaldis"), ("ÁÉÍ ñu", "aei nu"), (None, "")])


def test_occurrence_key(spark):
    rows = [("Concierto de Melendi", "2026-05-20", "Gran Canaria Arena"), ("MELENDI EN CONCIERTO", "2026-05-20", "GC Arena"),
            ("Teatro", "2026-05-21", "Teatro Cuyas")]
    df = spark.createDataFrame(rows, "t string, d string, p string").select(
        text.occurrence_key(F.col("t"), F.col("d"), F.col("p")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys[0] == keys[1] == "melendi|2026-05-20|grancanariaarena" and keys[2] != keys[0]


def test_misc_text(spark):
    check(spark, text.clean_text, [("  hola   mundo  ", "hola mundo"), ("hola​mundo", "holamundo"), (None, ""), ("a \n b", "a b")])
    check(spark, text.fold, [(" Pérez ÑANDÚ, 3 ", "perez nandu, 3"), ("é", "e"), (None, ""), ("ß", "ß")])
    check(spark, text.name_from_slug, [
        ("https://entradas.com/evento/lago-cisnes", "Lago Cisnes"), ("/evento/123456-concierto-fantastico/", "Concierto Fantastico"),
        (None, "Evento Cultural"), ("", "Evento Cultural"), ("/x/caf%C3%A9-teatro/9", "Café Teatro")])
    check(spark, text.ics_escape, [("a,b;c\\d\ne", "a\\,b\\;c\\\\d\\ne")])


def test_flags(spark):
    check(spark, flags.is_generic_title, [
        ("Entradas para el concierto", True), ("Melendi en concierto", False), ("Tickety", True), ("", True), ("2", True),
        ("ABC", False), ("  Comprar  entradas... ", True), ("Música", True), (None, True)])
    check(spark, flags.is_boilerplate, [("Política de privacidad y aviso legal", True), ("Este es un gran concierto", False), (None, False)])
    check(spark, flags.is_junk_title, [("ext", True), ("A", True), ("x" * 110, True), ("llama 928 123", True), ("sigue...", True), ("UB40", False)])
    check(spark, flags.is_generic_place, [("Gran Canaria", True), ("España", True), (None, True), ("Sala Scala", False)])
    check(spark, flags.slug_verdict, [("rock-en-madrid", False), ("jazz-telde", True), ("jazz", None)])


@pytest.mark.parametrize("url,code", [
    ("https://www.tomaticket.es/es-es/event", "tomaticket"), ("https://auditorioalfredokraus.es/evento/test", "auditorio"),
    ("https://www3.gobiernodecanarias.org/cultura/", "guiniguada"), ("https://ofgc.janto.es/janto/main.php", "janto"),
    ("https://www.example.com/tickety", "generico"), ("mal", "generico")])
def test_domain(spark, url, code):
    check(spark, parse.domain_of, [(url, code)])
