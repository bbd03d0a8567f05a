"""Line de-duplication with DataFrame functions only: which lines of which documents stay.

Lines become 128-bit hashes, range-partitioned and sorted by document and position inside
each hash, so first occurrences come in stream order.  The range key carries a salt of the
document, so a line that a third of all documents hold is spread over many partitions; its
parts are summed by a partial aggregate.  The result is a compressed keep bitmap for each
document that loses a line; texts never travel with the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .common import SPACE, aside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, SALTS, SALT_LINES = 40, 5, 64, 2_000_000


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty give one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def keep_bitmaps(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int | None = None,
) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep): one row for each document that loses lines.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents keeps its
    lines only in the largest doc_id.  ``keep`` maps a word number (position div 64) to 64 keep
    bits; a word that is not there keeps all its lines.  Rows with one doc_id count as one
    document and are told apart by the hash of their text; null doc_ids are one document, the
    smallest.  Other columns are ignored; an empty table gives an empty result.  ``salts`` is how
    many parts a line may be dealt to; by default it grows with the number of lines.
    """
    lines = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    ).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    lines = settle(lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"),
        "doc_id", "text_hash", "pos",
    ))
    if salts is None:
        salts = max(SALTS, lines.count() // SALT_LINES)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    ordered = salted.select("h1", "h2", "salt", "doc_id", "pos").repartitionByRange("h1", "h2", "salt")
    by_document = W.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc_id"), "pos")
    # The first line of a document inside its hash: one per document, repeats do not count.
    opens = (F.row_number().over(by_document) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(by_document))
    # Written first: the join then has a plain exchange on both sides, which AQE can split where a line is hot.
    frequent = settle(
        ordered.withColumn("opens", opens).filter("opens")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    dropped = lines.join(frequent.drop("n_docs"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep"))))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined by a line feed; a null bitmap keeps the text."""
    def stays(_: Column, pos: Column) -> Column:
        word = F.coalesce(F.element_at(keep, (pos / 64).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, (pos % 64).cast("int")) == 1

    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.filter(split_lines(text), stays), "\n")
    )


def with_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``line_keep`` and ``line_dropped``; repeated rows stay repeated.

    Columns of these names must not be there; ``drop_repeated_lines`` takes any.
    """
    maps = keep_bitmaps(docs, **options).select(
        F.col("doc_id").alias("map_doc"), F.col("text_hash").alias("map_text"), F.col("n_dropped").alias("line_dropped"),
        F.col("keep").alias("line_keep"),
    )
    same = docs["doc_id"].eqNullSafe(maps["map_doc"]) & (F.xxhash64(docs["text"]) == maps["map_text"])
    return docs.join(maps, same, "left").drop("map_doc", "map_text")


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the same columns and the kept lines as ``text``; ``n_chars`` follows, where there is one.

    A document that loses no line keeps its text as it is, null included.
    """
    text = F.when(F.col("line_keep").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("line_keep")))
    mine = aside(docs, "doc_id", "text", "n_chars")
    out = with_bitmaps(mine, **options).withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col("line_keep").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*mine.columns).toDF(*docs.columns)
