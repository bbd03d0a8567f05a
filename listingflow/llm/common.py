"""Helpers shared by the corpus operators: words, shared files, code that travels with tasks."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(name: str) -> None:
    """Pickle the functions of module ``name`` by value, so executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but the used ones under names that no operator uses; ``toDF`` gives them back."""
    return docs.toDF(*(c if c in used else f"own {i} {c}" for i, c in enumerate(docs.columns)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    folder = checkpoint_dir(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def store(uri: str):
    """(file system, path) of a shared folder, from inside a task; any URI Arrow can open."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def by_batch(rows: Iterable[dict], schema: pa.Schema, size: int = 4096):
    """Record batches of at most ``size`` rows from an iterator of tuples in schema order."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
