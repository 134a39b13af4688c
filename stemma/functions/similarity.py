"""String likeness Spark lacks, as Arrow functions: LCS ratio, a weighted ratio, Metaphone."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: one machine word a character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@lru_cache(maxsize=100_000)
def lcs_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (length of both); 100 for two empty strings."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one: windows of its length, and shorter ones at either end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    k = len(short)
    parts = {long[max(0, i) : i + k] for i in range(1 - k, len(long))}
    # a pair of strings of equal length is the same window either way; both ends are covered by the range
    return max(lcs_ratio(short, part) for part in parts)


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of the sorted words and the ratio by sets of words: what both have, and that with what
    only one has; 100 if all words of one are in the other."""
    one, two = set(a.split()), set(b.split())
    both, mine, yours = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if both and not (mine and yours):
        return 100.0
    best = lcs_ratio(_sorted_words(a), _sorted_words(b))
    joined = lambda rest: f"{both} {rest}" if both else rest
    total = len(joined(mine)) + len(joined(yours))
    if total:
        # what both begin with matches in full, so only the rests differ
        best = max(best, 100.0 - 100.0 * (len(mine) + len(yours) - 2 * _lcs(mine, yours)) / total)
    if both:
        # what both have, against that with each one's rest
        best = max(best, *(200.0 * len(both) / (len(both) + len(joined(rest))) for rest in (mine, yours)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if the strings have a word in common, else the best part of the sorted words."""
    one, two = set(a.split()), set(b.split())
    return 100.0 if one & two else partial(_sorted_words(a), _sorted_words(b))


@lru_cache(maxsize=100_000)
def weighted_ratio(a: str, b: str) -> float:
    """The usual weighted ratio by its published rules. If the longer string is less than half as long again: the best of
    the ratio and 0.95 of the token ratio; else of the ratio, 0.9 of the partial ratio and 0.9 * 0.95 of the partial
    token ratio, with 0.6 for 0.9 where the one is more than eight times as long as the other."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(lcs_ratio(a, b), 0.95 * token_ratio(a, b))
    weight = 0.9 if times <= 8 else 0.6
    return max(lcs_ratio(a, b), weight * partial(a, b), weight * 0.95 * partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def weighted_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_at_least(a: Column, b: Column, least: float) -> Column:
    """Whether the LCS ratio reaches the bound. The edit distance, computed in the JVM, is a necessary condition
    and keeps most pairs from Python."""
    bound = F.floor(F.lit(1 - least / 100) * (F.length(a) + F.length(b)) + F.lit(1e-9)).cast("int")
    possible = F.levenshtein(a, b) <= bound
    return F.when(possible, ratio_udf(a, b) >= least).otherwise(False)


#: Pairs of at most this many characters together meet by segments at their places, longer ones by segments anywhere.
LONG = 48


def near_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, r): pairs of different strings of a(a) and b(b), each distinct, whose LCS ratio r is 85 or more; none is lost.

    Such strings differ by at most D = 15 % of the sum s of their lengths in single insertions and deletions, D of the
    parity of s. Cut into D + 1 segments, b keeps one of them whole, and a has it at most the insertions to the right and
    the deletions to the left. Where s is over LONG, b is cut once, for the longest partner, into segments of 2 or 3.
    """
    most = lambda s: f"({s} * 3 div 20 - ({s} + {s} * 3 div 20) % 2)"
    sides = []
    for df, me in ((a, "a"), (b, "b")):
        d = df.select(me, F.length(me).alias(f"n{me}")).where(f"n{me} > 2")
        other = "b" if me == "a" else "a"
        d = d.withColumn(f"n{other}", F.explode(F.expr(f"sequence(cast(ceil(n{me} * 17 / 23) as int), cast(floor(n{me} * 23 / 17) as int))")))
        sides.append(d.withColumn("d", F.expr(most("(na + nb)"))).where("d >= 1 and abs(na - nb) <= d"))
    cut = lambda df: df.where(f"na + nb <= {LONG}").withColumn("i", F.explode(F.expr("sequence(0, cast(d as int))"))).withColumn("at", F.expr("i * nb div (d + 1)")).withColumn("size", F.expr("(i + 1) * nb div (d + 1) - at"))
    key = F.expr("xxhash64(na, nb, i, part)").alias("key")
    of_b = cut(sides[1]).withColumn("part", F.expr("substring(b, cast(at + 1 as int), cast(size as int))")).select("b", key, F.lit(-1).alias("pb"))
    moved = cut(sides[0]).where("greatest(0, at - (d + nb - na) div 2) <= least(na - size, at + (d - nb + na) div 2)").withColumn("at", F.explode(F.expr("sequence(greatest(0, at - (d + nb - na) div 2), least(na - size, at + (d - nb + na) div 2))")))
    of_a = moved.withColumn("part", F.expr("substring(a, cast(at + 1 as int), cast(size as int))")).select("a", key, F.lit(-1).alias("pa"))
    long_b = sides[1].groupBy("b", "nb").agg(F.max("na").alias("na")).where(f"na + nb > {LONG}").withColumn("k", F.expr("(na + nb) * 3 div 20 + 1"))
    long_b = long_b.withColumn("i", F.explode(F.expr("sequence(0, cast(k - 1 as int))"))).withColumn("pb", F.expr("cast(i * nb div k as int)"))
    long_b = long_b.select("b", F.expr("xxhash64(substring(b, pb + 1, cast((i + 1) * nb div k - pb as int)))").alias("key"), "pb")
    long_a = sides[0].groupBy("a", "na").agg(F.max("nb").alias("nb")).where(f"na + nb > {LONG}").withColumn("size", F.explode(F.array(F.lit(2), F.lit(3))))
    long_a = long_a.withColumn("pa", F.explode(F.expr("sequence(0, na - size)"))).select("a", F.expr("xxhash64(substring(a, pa + 1, size))").alias("key"), "pa")
    met = of_a.unionByName(long_a).join(of_b.unionByName(long_b), "key").where("abs(pa - pb) * 20 <= 3 * (length(a) + length(b))")
    met = met.where("a <> b and levenshtein(a, b) * 20 <= 3 * (length(a) + length(b))").select("a", "b").distinct()
    return met.withColumn("r", ratio_udf(F.col("a"), F.col("b"))).where("r >= 85")


_VOWELS = "AEIOU"


@lru_cache(maxsize=100_000)
def metaphone(word: str) -> str:
    """Phonetic code of an English word by the published Metaphone rules."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n = [], len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    for i, c in enumerate(w):
        if c == at(i - 1) and c != "C":
            continue
        nxt, prev = at(i + 1), at(i - 1)
        front = nxt in ("E", "I", "Y") and nxt != ""
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (prev == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if front:
                if w[i + 1 : i + 3] == "IA":
                    out.append("X")
                elif prev != "S":
                    out.append("S")
            elif nxt == "H":
                out.append("K" if prev == "S" else "X")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if w[i + 1 : i + 3] in ("GE", "GY", "GI") else "T")
        elif c == "G":
            if nxt == "H" and not (i + 2 < n and at(i + 2) in _VOWELS):
                continue
            if nxt == "N" and (i + 2 >= n or w[i + 1 :] == "NED"):
                continue
            if prev == "D" and front:
                continue
            out.append("J" if front and prev != "G" else "K")
        elif c == "H":
            if nxt in _VOWELS and nxt and prev not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if nxt == "H" or w[i + 1 : i + 3] in ("IO", "IA") else "S")
        elif c == "T":
            if nxt == "H":
                out.append("0")
            elif w[i + 1 : i + 3] in ("IO", "IA"):
                out.append("X")
            elif w[i + 1 : i + 3] != "CH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt in _VOWELS and nxt:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone_udf(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else metaphone(w))
