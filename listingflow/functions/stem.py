"""Spanish stems as a column expression: suffixes are stripped inside the regions of a word.

The rules are those of the published Snowball stemmer for Spanish.  R1 begins after the first
consonant that follows a vowel, R2 is the same inside R1, and RV leaves the root of a verb alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import let

# Fixed values of the published rules.
VOWELS = "aeiouáéíóúü"
PRONOUNS = ["me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"]
PLAIN = [
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos",
    "osas", "amiento", "amientos", "imiento", "imientos",
]
AFTER_IC = ["adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"]
Y_VERBS = ["ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos"]
FUTURES = ["ían", "ías", "án", "ás", "íais", "ía", "éis", "íamos", "emos", "á", "é"]
VERBS = [
    "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran", "asen",
    "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases",
    "ieses", "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos",
    "imos", "áramos", "iéramos", "iésemos", "ásemos",
]
ENDINGS = [*VERBS, *(r + f for r in ("ar", "er", "ir") for f in FUTURES)]
SOFT = ["en", "es", "éis", "emos"]


def _one_of(suffixes: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")"


def _after_consonant(text: Column) -> Column:
    """Length up to and with the first consonant that follows a vowel; all of it where there is none."""
    head = F.regexp_extract(text, f"^.*?[{VOWELS}][^{VOWELS}]", 0)
    return F.when(head == "", F.length(text)).otherwise(F.length(head))


def _root(word: Column) -> Column:
    """Where RV begins."""
    consonant = F.regexp_extract(word, f"^.[^{VOWELS}].*?[{VOWELS}]", 0)
    vowels = F.regexp_extract(word, f"^[{VOWELS}]{{2}}.*?[^{VOWELS}]", 0)
    head = F.when(word.rlike(f"^.[^{VOWELS}]"), consonant).when(word.rlike(f"^[{VOWELS}]{{2}}"), vowels).otherwise(F.substring(word, 1, 3))
    return F.when((head == "") | (F.length(word) < 3), F.length(word)).otherwise(F.length(head))


def _ends(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(suffix))


def _without(word: Column, pattern: str, begin: Column) -> Column:
    """The word without a suffix that lies after ``begin``; unchanged without one."""
    found = F.regexp_extract(word, f"{pattern}$", 0)
    return let(found, lambda s: F.when((s != "") & (F.length(word) - F.length(s) >= begin), _ends(word, s)).otherwise(word))


def _pronouns(word: Column, rv: Column) -> Column:
    """Pronouns after a gerund or an infinitive go, and its accent with them."""
    tail = F.regexp_extract(word, f"{_one_of(PRONOUNS)}$", 0)

    def cut(t: Column) -> Column:
        verb = _ends(word, t)
        marked = F.regexp_extract(verb, "(?:iéndo|ándo|ár|ér|ír)$", 0)
        plain = F.regexp_extract(verb, "(?:iendo|ando|ar|er|ir)$", 0)
        after_u = verb.rlike("uyendo$") & (F.length(verb) - 5 >= rv)
        inside = lambda s: (s != "") & (F.length(verb) - F.length(s) >= rv)
        bare = F.concat(_ends(verb, marked), F.translate(marked, "áéí", "aei"))
        return F.when(t == "", word).when(inside(marked), bare).when(inside(plain) | after_u, verb).otherwise(word)

    return let(tail, cut)


def _standard(word: Column, r1: Column, r2: Column) -> Column:
    """Suffixes of nouns, adjectives and adverbs; the longest one decides, and it may be left alone."""
    groups = [
        (PLAIN, lambda w: w),
        (AFTER_IC, lambda w: _without(w, "ic", r2)),
        (["logía", "logías"], lambda w: F.concat(w, F.lit("log"))),
        (["ución", "uciones"], lambda w: F.concat(w, F.lit("u"))),
        (["encia", "encias"], lambda w: F.concat(w, F.lit("ente"))),
        (["mente"], lambda w: _without(w, "(?:ante|able|ible)", r2)),
        (["idad", "idades"], lambda w: _without(w, "(?:abil|ic|iv)", r2)),
        (["iva", "ivo", "ivas", "ivos"], lambda w: _without(w, "at", r2)),
    ]
    every = [x for suffixes, _ in groups for x in suffixes] + ["amente"]

    def adverb(stem: Column) -> Column:
        no_iv = _without(stem, "iv", r2)
        return let(no_iv, lambda w: F.when(w != stem, _without(w, "at", r2)).otherwise(_without(stem, "(?:os|ic|ad)", r2)))

    def cut(s: Column) -> Column:
        stem = _ends(word, s)
        out = F.when((s == "amente") & (F.length(stem) >= r1), let(stem, adverb))
        for suffixes, rest in groups:
            out = out.when(s.isin(*suffixes) & (F.length(stem) >= r2), let(stem, rest))
        return out.otherwise(word)

    return let(F.regexp_extract(word, f"{_one_of(every)}$", 0), cut)


def _verb(word: Column, rv: Column) -> Column:
    """Endings of verbs; those with ``y`` only after ``u``."""
    with_y = F.regexp_extract(word, f"u({_one_of(Y_VERBS)})$", 1)
    inside = lambda s: (s != "") & (F.length(word) - F.length(s) >= rv)

    def cut(y: Column) -> Column:
        # The longest ending inside RV decides.
        rest = F.substring(word, rv + 1, F.length(word))
        found = F.regexp_extract(rest, f"{_one_of([*ENDINGS, *SOFT])}$", 0)
        return F.when(inside(y), _ends(word, y)).otherwise(let(found, lambda s: F.when(s == "", word).when(
            s.isin(*SOFT), F.regexp_replace(_ends(word, s), "gu$", "g")).otherwise(_ends(word, s))))

    return let(with_y, cut)


def _residue(word: Column, rv: Column) -> Column:
    last = F.regexp_extract(F.substring(word, rv + 1, F.length(word)), "(?:os|[aoáíóeé])$", 0)

    def cut(s: Column) -> Column:
        stem = _ends(word, s)
        gu = stem.rlike("gu$") & (F.length(stem) - 1 >= rv)
        soft = F.when(gu, F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
        return F.when(s == "", word).when(s.isin("e", "é"), soft).otherwise(stem)

    return let(last, cut)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; accents go, null stays null."""
    def with_regions(w: Column) -> Column:
        r1 = _after_consonant(w)
        regions = let(r1, lambda a: F.struct(
            a.alias("r1"), (a + _after_consonant(F.substring(w, a + 1, F.length(w)))).alias("r2"), _root(w).alias("rv"), w.alias("w")))

        def steps(r: Column) -> Column:
            def after(base: Column) -> Column:
                standard = _standard(base, r["r1"], r["r2"])
                return let(standard, lambda s: F.when(s != base, s).otherwise(_verb(base, r["rv"])))

            return let(let(_pronouns(r["w"], r["rv"]), after), lambda s: _residue(s, r["rv"]))

        return let(regions, steps)

    return F.translate(let(word, with_regions), "áéíóú", "aeiou")
