"""URL verdicts from glob rules, all run at once as one bit-parallel automaton.

Every pattern is a row of bits in a shared multiword state: a start bit and one bit per
symbol.  One Shift-And step reads one byte of every URL of a block and moves all patterns:
``state = ((state << 1) & enter[byte]) | (state & stay[byte])``; ``stay`` holds the bits
before a wildcard.  ``?`` is any byte, ``*`` any run without ``/ ? #`` and ``**`` any run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import aside, ship

ship(__name__)

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's.
HOST_RULES = [
    ("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK),
]
#: Globs that block what no host rule decides.
BLOCK_GLOBS = ["*spam*/**", "*spam*", "*casino*/**", "*casino*", "**utm_source=ads**", "**.exe", "**/login**"]
BLOCK_ROWS = 2048


class Automaton:
    """Glob patterns packed into 64-bit words; ``run`` gives the patterns that match whole texts."""

    def __init__(self, globs: Sequence[str]):
        symbols, accept, starts = [], [], []
        for glob in globs:
            starts.append(len(symbols))
            symbols.append([None, ""])  # start bit: nothing enters it
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i] == 42:
                    run = 2 if data[i : i + 2] == b"**" else 1
                    symbols[-1][1] = "**" if run == 2 or symbols[-1][1] == "**" else "*"
                    i += run
                else:
                    symbols.append([data[i], ""])
                    i += 1
            accept.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        any_byte = np.arange(256)
        inside = np.array([b for b in range(256) if b not in b"/?#"])
        for bit, (symbol, loop) in enumerate(symbols):
            word, mask = bit // 64, np.uint64(1 << bit % 64)
            if symbol is not None:
                self.enter[any_byte if symbol == 63 else symbol, word] |= mask
            if loop:
                self.stay[any_byte if loop == "**" else inside, word] |= mask
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
        self.accept = np.array(accept, np.int64)

    def run(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix, one row per text and one column per pattern."""
        data = [t.encode() for t in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.start, (len(data), 1))
        flat = np.frombuffer(b"".join(data[i] for i in order) or b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
        falling = -sizes[order]
        for pos in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(falling, -pos, side="left"))  # rows longer than pos come first
            byte = flat[begin[:live] + pos]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.enter[byte]) | (now & self.stay[byte])
        bits = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(bits.shape, bool)
        out[order] = bits.astype(bool)
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def judge_urls(
    df: DataFrame, url: str = "url", *, rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    The longest fitting host rule decides; without one, a block glob over the canonical URL
    (host, path and query, no scheme and no fragment) blocks, all else is allowed.  Null urls
    and urls without ``://`` have an empty host and path and are judged as the empty text.
    An empty table stays empty; a very long url is judged whole.  A map over rows: no shuffle, and memory bounded by ``block_rows`` URLs.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    globs = [g for host, path, _ in ranked for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block_globs)
    names = [host + path for host, path, _ in ranked]
    verdicts = [v for _, _, v in ranked]

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        n = len(names)
        for urls in batches:
            rule, verdict = [], []
            for at in range(0, len(urls), block_rows):
                hits = automaton.run(list(urls.iloc[at : at + block_rows]))
                fits = hits[:, 0 : 2 * n : 2] | hits[:, 1 : 2 * n : 2]
                first = fits.argmax(axis=1) if n else np.zeros(len(hits), int)
                found = fits.any(axis=1) if n else np.zeros(len(hits), bool)
                blocked = hits[:, 2 * n :].any(axis=1)
                for f, ok, bad in zip(first, found, blocked):
                    rule.append(names[f] if ok else None)
                    verdict.append(verdicts[f] if ok else BLOCK if bad else ALLOW)
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    replaced = ("host", "path", "rule", "verdict")
    mine = aside(df, url, *replaced)
    out = mine.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    judged = out.withColumn("url_judged", decide(F.concat("host", "path", query_of(F.col(url)))))
    judged = judged.withColumn("rule", F.col("url_judged.rule")).withColumn("verdict", F.col("url_judged.verdict")).drop("url_judged")
    return judged.toDF(*df.columns, *(c for c in judged.columns if c not in mine.columns))
