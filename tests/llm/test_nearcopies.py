"""Groups of near copies against brute force over all pairs of shingle sets."""

import random

import pytest

from listingflow.llm import nearcopies
from listingflow.llm.simhash import shingle_hashes


def brute(rows, similarity=0.8):
    sets = [frozenset(shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a == sets[j] or shared and shared >= similarity * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, edits):
    """Words replaced far from each other: each costs five shingles."""
    out = list(words)
    for k in rng.sample(range(len(words) // 10), edits):
        out[10 * k + 4] = f"new{rng.randrange(10 ** 9)}"
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(map(tuple, nearcopies.similar_groups(docs, **options).collect()), key=str)
    assert got == brute(rows)
    return got


def test_just_over_and_just_under(spark):
    """1,104 words are 1,100 shingles; n edits of five shingles give (1100 - 5n) / (1100 + 5n): 0.802 for 24, 0.794 for 25."""
    rng, rows = random.Random(1), []
    for n in range(40):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(1104)]
        near = 24 if n % 2 else 25
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(edited(rng, base, near)))]
    got = dict(check(spark, rows))
    assert all((got[2 * n + 1] == 2 * n) == (n % 2 == 1) for n in range(40))


@pytest.mark.parametrize("block", [20_000, 30])
def test_families(spark, block):
    """Groups where most pairs lie about the threshold, chains, copies of copies, and unlike texts with common passages."""
    rng, rows = random.Random(2), []
    passage = [f"p{i}" for i in range(150)]
    for size, edits in ((40, 4), (30, 7), (20, 9), (25, 6)):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
        rows += [" ".join(edited(rng, base, edits)) for _ in range(size)]
    chain = [f"c{i}" for i in range(400)]
    for _ in range(15):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 3)
    rows += [" ".join(passage + [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]) for _ in range(40)]
    rows += rows[:3] * 3
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)), block=block)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b C"), (5, "a  B c"), (6, "one"), (6, "one"), (None, "one"), (7, "é " * 40_000),
            (None, "only here"), (8, "one two three four five six"), (8, "one two three four five seven"), (9, "a b c d e f")]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert nearcopies.similar_groups(docs.filter("false")).collect() == []


def test_first_of_each_group_stays(spark):
    rows = [(5, "a b c d e", 1, "m"), (3, "A b c D e", 2, "n"), (3, "A b c D e", 2, "n"), (None, "a b c d e", 3, "o"), (9, "else", 4, "p"), (None, "own", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, component_id string")
    kept = nearcopies.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)


def test_tree_settles_what_it_finds(spark, monkeypatch):
    """Near copies within two bits become classes in the routing tree; the anchors' shards look at other classes only."""
    rng, rows = random.Random(3), []
    for _ in range(4):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(1500)]
        rows += [" ".join(base[:-1] + [f"end{k}"]) for k in range(8)]
    rows += [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300)) for _ in range(10)]
    routed, marked = [], []
    monkeypatch.setattr(nearcopies, "hamming_edges", lambda unique, keep=nearcopies.hamming_edges, **o: routed.append(unique.count()) or keep(unique, **o))
    monkeypatch.setattr(nearcopies, "touched", lambda dealt, *a, keep=nearcopies.touched: marked.append(keep(dealt, *a)) or marked[-1])
    check(spark, list(enumerate(rows)))
    assert routed == [len({nearcopies.fingerprint(nearcopies.np.unique(shingle_hashes(t.encode(), 5))) for t in rows})]
    assert marked[0].count() == 0


def test_links_from_class_to_class(spark):
    """A class of close copies whose members alone link to another class, through shards in slices as well."""
    rng, rows = random.Random(4), []
    for edits in (6, 8, 9, 12):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(404)]
        other = edited(rng, base, edits)
        rows += [" ".join(base)] + [" ".join(other[:-1] + [f"end{k}"]) for k in range(6)] + [" ".join(edited(rng, other, edits))]
    check(spark, list(enumerate(rows)))
    check(spark, list(enumerate(rows)), block=3)


def test_sets_of_a_batch_are_counted_together(spark, monkeypatch):
    made, real = [], nearcopies.fingerprints_of
    monkeypatch.setattr(nearcopies, "fingerprints_of", lambda sets, *more: made.append(len(sets)) or real(sets, *more))
    schema = nearcopies.pa.schema([("doc_id", nearcopies.pa.int64()), ("mark", nearcopies.pa.int64()), ("text", nearcopies.pa.string())])
    batch = nearcopies.to_batch([(i, i, f"a b c d e f{i}") for i in range(100)], schema)
    run = []

    class Docs:  # hands the batch to the function of the tasks
        def select(self, *_):
            return self

        def mapInArrow(self, compute, ddl):
            run.extend(compute(iter([batch])))

    nearcopies.nodes_of(Docs(), 5, 8)
    assert made == [100] and sum(b.num_rows for b in run) == 100
