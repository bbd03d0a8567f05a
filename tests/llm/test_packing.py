"""Both packers: whole documents come back, limits hold, ids equal the tokenizer's."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from listingflow.llm import packing, tokens
from listingflow.llm.common import shared_folder
from listingflow.llm.queries import QUERIES
from listingflow.llm.tokenizing import Tokenize, default_tokenizer
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(exact, text):
    return np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_fast_ids_equal_the_tokenizers(exact):
    rng = random.Random(1)
    encode = Tokenize(default_tokenizer())
    assert encode.fast is not None
    texts = ["", " ", "\n\n  x", "<|endoftext|> a", "don't we'll I'M", "a" * 5000, " " * 3000 + "x", "é\u0301 漢字 🙂 \u200b x\u00a0y", "١٢٣ ½ x²"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x4E00, 0x9FFF), 10, 32])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encode.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_the_registered_query(spark, exact):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_vector_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, mine in pieces.items():
        ids, at = ids_of(exact, texts[doc]), 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(mine) <= packing.MAX_SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.001 * sum(r["length"] for r in rows)


def test_examples_keep_all_three_limits(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 600), rng.randint(0, 200)) for i in range(500)] + [(900, 5000, 1), (901, None, None), (902, 10, 3000)]
    frame = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").repartition(3)
    got = packing.pack_examples(frame, max_tokens=1000, max_segments=4, max_loss=250).collect()
    assert sorted(r["example_id"] for r in got) == sorted(r[0] for r in rows)
    assert {r["example_id"] for r in got if not r["fits"]} == {900, 902}
    bins = {}
    for r in got:
        if r["fits"]:
            bins.setdefault(r["sequence_id"], []).append(r)
    for mine in bins.values():
        assert len(mine) <= 4 and sum(r["tokens"] for r in mine) <= 1000 and sum(r["loss_tokens"] for r in mine) <= 250
        assert sorted(r["segment"] for r in mine) == list(range(len(mine)))
    least = max(sum(r[1] or 0 for r in rows[:500]) / 1000, 500 / 4, sum(r[2] for r in rows[:500]) / 250)
    assert len(bins) <= 1.25 * least + 3


def test_segment_tree_is_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        top = rng.randint(1, 40)
        tree, held = tokens.Capacities(top), []
        for _ in range(80):
            if rng.random() < 0.5:
                c = rng.randint(0, top)
                tree.add(c, len(held))
                held.append(c)
            else:
                size = rng.randint(1, top)
                fits = [c for c in held if c is not None and c >= size]
                got = tree.fit(size)
                assert (got is None) == (not fits)
                if got:
                    assert got[0] == min(fits) and held[got[1]] == got[0]
                    held[got[1]] = None


def test_matrix_rows(spark, exact):
    rows = [(1, "word " * 3000, 0), (2, None, 0), (2, "", 0), (3, "short text", 0), (None, "no id", 0), (4, "x" * 100, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    written = tokens.write_rows(tokens.pack_rows(docs, row_tokens=512, window_tokens=2000, pad_id=7), shared_folder(spark, "rows-test"))
    back = {}
    for r in written.collect():
        ids = tokens.matrix([r], 512)[0]
        bounds = r["cu_seqlens"]
        assert len(ids) == 512 and bounds[0] == 0 and bounds[-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 7).all()
        assert r["position_resets"] == (bounds if bounds[-1] < 512 else bounds[:-1])
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], bounds, bounds[1:]):
            back.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for doc in {r[0] for r in rows}:
        want = sorted(ids_of(exact, t).tolist() for d, t, _ in rows if d == doc)
        if len(want) == 1:
            assert sum((ids for _, ids in sorted(back[doc])), []) == want[0]
        else:
            assert sorted(ids for _, ids in back[doc]) == want
    assert tokens.pack_rows(docs.filter("false")).collect() == []


def test_odd_documents(spark, exact):
    rows = [(1, None, 9), (1, None, 9), (None, "text", 9), (5, "long " * 40_000, 9), (6, "<|endoftext|>", 9)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of(exact, r[1])) for r in rows)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
