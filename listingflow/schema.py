"""The listing schema and how frames are brought to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, MapType,
    StringType, StructField, StructType, TimestampType,
)

LISTING_SCHEMA = StructType([
    StructField("id", LongType()),
    StructField("nombre", StringType()),
    StructField("lugar", StringType()),
    StructField("fecha_raw", StringType()),
    StructField("fecha_iso", DateType()),
    StructField("organiza", StringType()),
    StructField("url_venta", StringType()),
    StructField("hash_id", StringType()),
    StructField("imagen_url", StringType()),
    StructField("descripcion", StringType()),
    StructField("estilo", StringType()),
    StructField("latitud", DoubleType()),
    StructField("longitud", DoubleType()),
    StructField("source_id", StringType()),
    StructField("precio_num", DoubleType()),
    StructField("hora", StringType()),
    StructField("estado", StringType()),
    StructField("enriquecido", BooleanType()),
    StructField("event_group_id", StringType()),
    StructField("field_confidence", MapType(StringType(), DoubleType())),
    StructField("source_priority", IntegerType()),
    StructField("quality_flags", ArrayType(StringType())),
    StructField("last_seen_at", TimestampType()),
])

# Defaults of columns that a source does not deliver.
LISTING_DEFAULTS = {
    "lugar": "Sin especificar", "fecha_raw": "Sin fecha", "organiza": "Desconocido",
    "estilo": "Otros", "estado": "upcoming", "enriquecido": False, "source_priority": 50,
}


def conform(
    df: DataFrame, schema: StructType = LISTING_SCHEMA,
    defaults: Mapping[str, object] = LISTING_DEFAULTS, extra: Sequence[str] = (),
) -> DataFrame:
    """Add missing columns with their default, drop others, cast and order as ``schema``."""
    columns = []
    for field in schema:
        if field.name in df.columns:
            value = F.col(field.name).try_cast(field.dataType)
        else:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns, *extra)


def backfill(df: DataFrame, **values) -> DataFrame:
    """Fill the named columns only where they are null."""
    return df.withColumns({name: F.coalesce(F.col(name), value) for name, value in values.items()})
