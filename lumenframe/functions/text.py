"""Tokens, stems, term weights and lexical match scores as JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words, irregular stems and term classes that results depend on.
STOPWORDS = (
    "a an and are as at be been being by did do does for from has have having he her his in is it its of she that the their there they this to was were with "
    "then next "
    "bị các cho có của đã đang đó được kia là mà một này những rồi sẽ thì tiếp và với ở"
).split()
STEMS = {"children": "child", "gone": "go", "lay": "lie", "left": "leave", "lying": "lie", "men": "man", "people": "person", "ran": "run", "sat": "sit", "stood": "stand", "went": "go", "women": "woman"}
GENERIC_SUBJECTS = "anh bà child chị cô đàn human man người ông person somebody someone woman".split()
PARTICLES = "away down off on out ra up vào xuống lên".split()
SUBJECT_WEIGHT, PARTICLE_WEIGHT = 0.35, 0.55
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(_lowered(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _lowered(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def stem_sql(x: str, matches: str = "regexp_like") -> str:
    """A conservative English stem of a token as SQL that Spark and DuckDB both read."""

    def undoubled(v: str) -> str:
        return f"(CASE WHEN length({v}) > 3 AND right({v}, 1) = left(right({v}, 2), 1) AND right({v}, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({v}, length({v}) - 1) ELSE {v} END)"

    cut = lambda n: f"left({x}, length({x}) - {n})"
    irregular = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in STEMS.items())
    base = (
        f"CASE WHEN length({x}) > 5 AND right({x}, 3) = 'ies' THEN concat({cut(3)}, 'y') "
        f"WHEN length({x}) > 5 AND right({x}, 3) = 'ing' THEN {undoubled(cut(3))} "
        f"WHEN length({x}) > 4 AND right({x}, 3) = 'ied' THEN concat({cut(3)}, 'y') "
        f"WHEN length({x}) > 4 AND right({x}, 2) = 'ed' THEN {undoubled(cut(2))} "
        f"WHEN length({x}) > 4 AND (right({x}, 4) IN ('sses', 'shes', 'ches') OR right({x}, 3) IN ('xes', 'zes', 'oes')) THEN {cut(2)} "
        f"WHEN length({x}) > 3 AND right({x}, 1) = 's' AND right({x}, 2) <> 'ss' THEN {cut(1)} ELSE {x} END"
    )
    # the final e goes last
    return f"(CASE {irregular} WHEN NOT {matches}({x}, '^[a-z]+$') THEN {x} WHEN length({base}) > 4 AND right({base}, 1) = 'e' THEN left({base}, length({base}) - 1) ELSE {base} END)"


def stem(token: str) -> Column:
    """Stem of a token column, by name."""
    return F.expr(stem_sql(token))


def weight_sql(x: str) -> str:
    return f"(CASE WHEN {x} IN ({_listed(GENERIC_SUBJECTS)}) THEN 35e-2 WHEN {x} IN ({_listed(PARTICLES)}) THEN 55e-2 ELSE 1e0 END)"


def stems_of(text: Column, content: bool = False) -> Column:
    """Stems of a text in order, with or without function words (tested before stemming)."""
    words = tokens(text)
    if content:
        words = F.filter(words, lambda t: ~t.isin(STOPWORDS))
    return F.transform(words, _stem_column)


def stems_among(text: Column, terms: list[str]) -> Column:
    """Those of a text's stems that are in ``terms`` (stems), repeats included.

    A stem is how its token begins, but for a final y (cut endings) and irregular forms; so only tokens that begin so are
    taken out of the text and stemmed.
    """
    starts = {*terms, *(t[:-1] for t in terms if t.endswith("y")), *(k for k, v in STEMS.items() if v in terms)}
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, sorted(starts)))})[\p{{L}}\p{{N}}]*"
    return F.filter(F.transform(F.regexp_extract_all(_lowered(text), F.lit(pattern), 0), _stem_column), lambda s: s.isin(terms))


def _stem_column(x: Column) -> Column:
    ends = lambda s: F.endswith(v, F.lit(s))
    v = x
    cut = lambda n: F.left(v, F.length(v) - n)

    def undoubled(u: Column) -> Column:
        last = F.right(u, F.lit(1))
        return F.when((F.length(u) > 3) & (last == F.left(F.right(u, F.lit(2)), F.lit(1))) & ~last.isin(list("aeiou")), F.left(u, F.length(u) - 1)).otherwise(u)

    base = (
        F.when((F.length(v) > 5) & ends("ies"), F.concat(cut(3), F.lit("y")))
        .when((F.length(v) > 5) & ends("ing"), undoubled(cut(3)))
        .when((F.length(v) > 4) & ends("ied"), F.concat(cut(3), F.lit("y")))
        .when((F.length(v) > 4) & ends("ed"), undoubled(cut(2)))
        .when((F.length(v) > 4) & (ends("sses") | ends("shes") | ends("ches") | ends("xes") | ends("zes") | ends("oes")), cut(2))
        .when((F.length(v) > 3) & ends("s") & ~ends("ss"), cut(1))
        .otherwise(v)
    )
    full = F.when((F.length(base) > 4) & F.endswith(base, F.lit("e")), F.left(base, F.length(base) - 1)).otherwise(base)
    out = F.when(~x.rlike("^[a-z]+$"), x).otherwise(full)
    for k, s in STEMS.items():
        out = F.when(x == k, F.lit(s)).otherwise(out)
    return out


def stem_of(token: str) -> str:
    """The same stem of a token, for tasks that meet each token once."""
    if token in STEMS:
        return STEMS[token]
    if token[-1:] not in ("s", "g", "d", "e") or not (token.isascii() and token.isalpha() and token.islower()):
        return token
    v, n = token, len(token)
    undoubled = lambda u: u[:-1] if len(u) > 3 and u[-1] == u[-2] and u[-1] not in "aeiou" else u
    if n > 5 and v.endswith("ies"):
        v = v[:-3] + "y"
    elif n > 5 and v.endswith("ing"):
        v = undoubled(v[:-3])
    elif n > 4 and v.endswith("ied"):
        v = v[:-3] + "y"
    elif n > 4 and v.endswith("ed"):
        v = undoubled(v[:-2])
    elif n > 4 and v.endswith(("sses", "shes", "ches", "xes", "zes", "oes")):
        v = v[:-2]
    elif n > 3 and v.endswith("s") and not v.endswith("ss"):
        v = v[:-1]
    return v[:-1] if len(v) > 4 and v.endswith("e") else v


def weight(term: str) -> Column:
    return F.expr(weight_sql(term))


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * F.greatest(length, F.lit(1)) / F.greatest(mean, F.lit(1.0))))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine_to_unit(x: Column) -> Column:
    return unit((x + 1.0) / 2.0)
