"""The given tables, and a listing view derived from them.

``listing`` is orders joined with their customer, nation and part: every order is
one listing.  The DataFrame form and the SQL form are written separately, so a
query and its check share no code.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import python_partitions

AS_OF = dt.date(2027, 1, 1)
AS_OF_SQL = "DATE '2027-01-01'"

PLACES = [
    "Teatro Pérez Galdós", "Auditorio A. Kraus", "Sala Scala", "Telde", "Casa de Colón",
    "GC Arena", "Infecar, pabellón 7", "Parque San Telmo", "Fundación Cicca", "Agüimes",
    "Teatro Cuyas Las Palmas", "Las Palmas", "Auditorio Adán Martín, Tenerife", "Pub El Rincón",
    "Estadio de Gran Canaria", "Teatro Guiniguada", "Vive la experiencia en el parque",
    "Santa Brígida", "Sin especificar", "Maspalomas", "Museo Elder", "Adeje", "Club Náutico",
    "La Laguna", "Arucas",
]
MONTH_NAMES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
    "octubre", "noviembre", "diciembre",
]
SOURCES = {
    "AUTOMOBILE": "Ticketmaster", "BUILDING": "EntradasCanarias", "FURNITURE": "Tickety",
    "HOUSEHOLD": "CICCA", "MACHINERY": "LocalGuideGC",
}
STYLES = {"1-URGENT": "Música", "2-HIGH": "Teatro", "3-MEDIUM": "Cine", "5-LOW": "Humor"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(key: Column, mapping: dict) -> Column:
    out = F
    for k, value in mapping.items():
        out = out.when(key == k, value)
    return out


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the date moved into the years the extractors accept."""
    return shifted(table(spark, sf_dir, "orders"))


def shifted(df: DataFrame) -> DataFrame:
    day = (F.col("o_orderdate").cast("date") + F.expr("INTERVAL 29 YEARS")).cast("date")
    return df.withColumn("day", day)


def order_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a stream of the files that come into ``folder``."""
    schema = spark.read.parquet(folder).schema
    return shifted(spark.readStream.schema(schema).parquet(folder))


def listing(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """One listing per order; ``source`` may be the stream of orders."""
    o = orders(spark, sf_dir) if source is None else source
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    p = table(spark, sf_dir, "part")
    rows = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(p, F.col("p_partkey") == F.col("o_custkey"))
    )
    k = "o_orderkey"
    places = "array(" + ", ".join(f"'{x}'" for x in PLACES) + ")"
    return rows.selectExpr(
        f"{k} AS id",
        f"""CASE WHEN {k} % 97 = 0 THEN concat('Entradas para ', p_name) WHEN {k} % 89 = 0 THEN concat('Youtube ', p_name)
            WHEN {k} % 83 = 0 THEN concat(p_name, '...') WHEN {k} % 79 = 0 THEN '12-3'
            WHEN {k} % 5 = 0 THEN concat(p_name, ' en concierto') WHEN {k} % 5 = 1 THEN concat('Concierto de ', p_name)
            WHEN {k} % 5 = 2 THEN concat(upper(p_name), ' | Las Palmas de Gran Canaria') ELSE p_name END AS nombre""",
        f"""CASE WHEN {k} % 6 = 0 THEN 'Gran Canaria' WHEN {k} % 71 = 0 THEN NULL
            ELSE element_at({places}, n_nationkey + 1) END AS lugar""",
        "concat(day(day), '/', month(day), '/', year(day)) AS fecha_raw",
        f"CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 3 = 0 THEN trunc(day, 'month') ELSE day END AS fecha_iso",
        f"{_case_sql('c_mktsegment', SOURCES)} AS organiza",
        f"""concat(element_at(array('https://www.tomaticket.es/es-es/evento/', 'https://tickety.es/event/',
            'https://teatrocuyas.com/evento/', 'https://shop.example.com/entradas/'), CAST(o_custkey % 4 + 1 AS INT)),
            replace(p_name, ' ', '-'), '/', {k} % 3, CASE WHEN {k} % 3 = 0 THEN '?ref=x' ELSE '' END) AS url_venta""",
        f"""CASE WHEN {k} % 12 = 0 THEN NULL WHEN {k} % 13 = 0 THEN 'data:image/png;base64,AAAA'
            ELSE concat('https://img.example.com/', {k}, '.jpg') END AS imagen_url""",
        f"""CASE WHEN {k} % 8 <> 0 THEN concat(
            repeat(concat('Cita ', lower(p_type), ' con ', p_name, ' en Plaza ', n_name, ', ', c_name, '. '), CAST(p_size % 7 + 1 AS INT)),
            CASE WHEN {k} % 31 = 0 THEN 'Nos vemos en el Teatro Cuyás' WHEN {k} % 37 = 0
                 THEN 'Entrada libre, aviso legal y cookies' ELSE '' END) END AS descripcion""",
        f"{_case_sql('o_orderpriority', STYLES)} AS estilo",
        f"CASE WHEN {k} % 3 <> 0 THEN 27.7D + n_nationkey * 0.02D END AS latitud",
        f"CASE WHEN {k} % 3 <> 0 THEN -15.8D + n_nationkey * 0.02D END AS longitud",
        f"CASE WHEN {k} % 9 = 0 THEN NULL WHEN {k} % 10 = 3 THEN 0D ELSE floor(o_totalprice / 10) / 100D END AS precio_num",
        f"""CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 11 = 0 THEN ''
            ELSE concat(lpad(CAST({k} % 24 AS STRING), 2, '0'), CASE WHEN {k} % 2 = 0 THEN ':00' ELSE ':30' END) END AS hora""",
        "'upcoming' AS estado", f"{k} % 2 = 1 AS enriquecido",
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Slim rows dealt to all tasks by id, before work that costs far more than their bytes tell.

    The tables are small files; a scan alone would put a million pages of mark-up into one task.
    """
    return rows.repartition(python_partitions(rows.sparkSession), "id")


def _case_sql(key: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())
    return f"CASE {key} {arms} END"


PLACES_SQL = "[" + ", ".join(f"'{x}'" for x in PLACES) + "]"
MONTHS_SQL = "[" + ", ".join(f"'{x}'" for x in MONTH_NAMES) + "]"
ORDERS_SQL = "ord AS (SELECT *, CAST(o_orderdate + INTERVAL 29 YEAR AS DATE) AS day FROM orders)"
LISTING_SQL = ORDERS_SQL + f""", listing AS (
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'Entradas para ' || p_name
       WHEN o_orderkey % 89 = 0 THEN 'Youtube ' || p_name
       WHEN o_orderkey % 83 = 0 THEN p_name || '...'
       WHEN o_orderkey % 79 = 0 THEN '12-3'
       WHEN o_orderkey % 5 = 0 THEN p_name || ' en concierto'
       WHEN o_orderkey % 5 = 1 THEN 'Concierto de ' || p_name
       WHEN o_orderkey % 5 = 2 THEN upper(p_name) || ' | Las Palmas de Gran Canaria'
       ELSE p_name END AS nombre,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Gran Canaria' WHEN o_orderkey % 71 = 0 THEN NULL
       ELSE ({PLACES_SQL})[n_nationkey + 1] END AS lugar,
  day(day) || '/' || month(day) || '/' || year(day) AS fecha_raw,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(date_trunc('month', day) AS DATE) ELSE day END AS fecha_iso,
  {_case_sql('c_mktsegment', SOURCES)} AS organiza,
  (['https://www.tomaticket.es/es-es/evento/', 'https://tickety.es/event/',
    'https://teatrocuyas.com/evento/', 'https://shop.example.com/entradas/'])[o_custkey % 4 + 1]
    || replace(p_name, ' ', '-') || '/' || (o_orderkey % 3)
    || CASE WHEN o_orderkey % 3 = 0 THEN '?ref=x' ELSE '' END AS url_venta,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'data:image/png;base64,AAAA'
       ELSE 'https://img.example.com/' || o_orderkey || '.jpg' END AS imagen_url,
  CASE WHEN o_orderkey % 8 <> 0 THEN
    repeat('Cita ' || lower(p_type) || ' con ' || p_name || ' en Plaza ' || n_name || ', ' || c_name || '. ',
           p_size % 7 + 1)
    || CASE WHEN o_orderkey % 31 = 0 THEN 'Nos vemos en el Teatro Cuyás'
            WHEN o_orderkey % 37 = 0 THEN 'Entrada libre, aviso legal y cookies' ELSE '' END END AS descripcion,
  {_case_sql('o_orderpriority', STYLES)} AS estilo,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(27.7 AS DOUBLE) + n_nationkey * CAST(0.02 AS DOUBLE) END AS latitud,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(-15.8 AS DOUBLE) + n_nationkey * CAST(0.02 AS DOUBLE) END AS longitud,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 3 THEN CAST(0 AS DOUBLE)
       ELSE floor(o_totalprice / 10) / CAST(100 AS DOUBLE) END AS precio_num,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
       ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0')
            || CASE WHEN o_orderkey % 2 = 0 THEN ':00' ELSE ':30' END END AS hora,
  'upcoming' AS estado, o_orderkey % 2 = 1 AS enriquecido
FROM ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON p_partkey = o_custkey)"""
