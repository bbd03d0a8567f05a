"""Searches over stored indexes: forms of words, the best of them, substrings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import postings
from ..session import checkpoint_dir
from .registry import on_listing
from .serving_queries import _LIST, _STOP, _tokens
from .tables import dealt

_WORDS = f"""hit AS (SELECT id, CASE WHEN token IN ('concierto', 'conciertos') THEN 1 ELSE 2 END AS word, w FROM ({_tokens('listing', 'id', _LIST)})
  WHERE token IN ('concierto', 'conciertos', 'plaza', 'plazas') AND token NOT IN {_STOP}),
ranked AS (SELECT id, round(sum(w), 6) AS rank FROM hit GROUP BY id HAVING count(DISTINCT word) = 2)"""


def _folder(df, name):
    return f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _searched(df, n=None):
    folder = _folder(df, "words")
    postings.write_word_index(dealt(df.select("id", *_LIST)), folder, key="id", fields=_LIST)
    return postings.search_words(df.sparkSession, folder, "Plazas de los CONCIERTOS", n).select(F.col("key").alias("id"), "rank")


on_listing("search_forms", "SELECT * FROM ranked", _WORDS)(_searched)
on_listing("search_top", "SELECT * FROM ranked ORDER BY rank DESC, id LIMIT 25", _WORDS)(lambda df: _searched(df, 25))


def _part(df, needle):
    folder = _folder(df, "trigrams")
    rows = dealt(df.select("id", "nombre", "lugar", "descripcion"))
    postings.write_substring_index(rows, folder, key="id", columns=["nombre", "lugar"])
    return postings.search_substring(df.sparkSession, folder, needle, key="id", columns=["nombre", "lugar"]).select("id", "nombre", "lugar")


for _name, _needle in {"search_substring": "CIERTO de l", "search_two_letters": "ón"}.items():
    on_listing(_name, f"SELECT id, nombre, lugar FROM listing WHERE contains(lower(nombre), lower('{_needle}')) OR contains(lower(lugar), lower('{_needle}'))")(
        lambda df, n=_needle: _part(df, n))
