"""The registered corpus queries: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    classifier, decontaminate, interpolation, licenses, linededup, negatives, packing, perplexity, simhash, spelling, tokens,
    urlfilter, warc,
)
from .common import read, shared_folder
from .oracles import OP1_SQL, OP4_SQL, OP5_SQL, OP10_SQL, OP11_SQL, OP13_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL, "op4_licenses": OP4_SQL, "op5_url_filter": OP5_SQL, "op10_line_dedup": OP10_SQL,
    "op11_spelling": OP11_SQL, "op13_hard_negatives": OP13_SQL,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back."""
    folder = shared_folder(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"
    )


@query
def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = perplexity.judge_documents(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.hamming_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state."""
    return licenses.find_licenses(read(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    judged = urlfilter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op6_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = classifier.train(docs, read(spark, sf_dir, "labels"))
    scored = classifier.score_documents(docs, chain)
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op8_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items it holds, edits included."""
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix rows of all documents, written, read back and summed up."""
    rows = tokens.write_rows(tokens.pack_rows(read(spark, sf_dir, "documents")), shared_folder(spark, "packed-ids"))
    crc = F.crc32(F.substring("input_ids", F.lit(1), (F.col("n_tokens") * F.col("id_bytes")).cast("int")))
    return rows.select(
        "sequence_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets",
        F.octet_length("input_ids").alias("matrix_bytes"), crc.alias("ids_crc32"),
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before, and what stays."""
    docs = linededup.with_bitmaps(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size(linededup.split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("line_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(linededup.kept_text(F.col("text"), F.col("line_keep")), 256).alias("kept_sha256"),
    )


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words and forms."""
    found = spelling.group_variants(read(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return interpolation.score_documents(read(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector; every seventh has a label not its own."""
    label, vec_id = F.col("label"), F.col("vec_id")
    return negatives.mine_negatives(
        read(spark, sf_dir, "embeddings"), anchor=vec_id % 50 == 0,
        relabel=F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label),
    )
