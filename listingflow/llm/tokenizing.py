"""Token ids of texts with a public tokenizer whose file is a parameter.

``<name>.json`` is read by ``tokenizers``.  Where ``<name>.tiktoken`` with the same vocabulary
lies beside it, ordinary texts go through ``tiktoken``, which gives the same ids several times
faster; texts that hold a special token's string, and any text it cannot take, go through
``tokenizers``.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from .common import ship

ship(__name__)

# What the vocabulary's byte-level model splits words by (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenize:
    """``ids(text)``: uint32 ids without added special tokens; one instance per task."""

    def __init__(self, path: str, use_ranks: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_padding()
        self.exact.no_truncation()
        special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if use_ranks and path.endswith(".json") and os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not (self.special and self.special.search(text)):
            try:
                return np.asarray(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # noqa: BLE001 - a panic of the native code is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
