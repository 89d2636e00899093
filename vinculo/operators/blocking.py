"""Complete blocking keys for approximate string equality on dictionaries of distinct words.

Every rule below emits, for a word, keys such that two words the similarity
rule accepts always share a key. Joining on the keys therefore loses nothing,
and the exact rule is checked afterwards on the few candidates. First names
share no short key but their initial; they are compared where surnames meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MATCH, MatchConfig
from ..functions.fold import one_of
from ..functions.similarity import (
    first_names_pass, jaro_winkler, last_names_agree, surnames_agree,
)
from .scale import cell_join, store

SORT_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _one_letter_less(c: Column) -> Column:
    spots = F.when(F.length(c) >= 1, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def edit1_keys(c: Column) -> Column:
    """Words within one edit share the word itself or a copy with one letter less."""
    return F.array_distinct(F.concat(F.array(c), _one_letter_less(c)))


def common_start(a: Column, b: Column) -> Column:
    """How many letters, up to four, two words have in common from the start."""

    def longer(n: int) -> Column:
        reached = (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
        return F.when(reached, F.lit(n))

    return F.coalesce(longer(4), longer(3), longer(2), longer(1), F.lit(0))


def letter_bits(c: Column) -> Column:
    """One bit for every letter of a word, and another for every letter that it has twice."""
    letters = F.array(*[F.lit(x) for x in SORT_LETTERS])
    times = F.transform(letters, lambda x: F.length(c) - F.length(F.replace(c, x)))
    bits = F.transform(times, lambda n, k: F.when(n > 1, F.lit((1 << 26) + 1)).when(n == 1, F.lit(1)).otherwise(F.lit(0)).cast("long") * F.pow(F.lit(2), k).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda some, bit: some + bit)


def first_names_may_pass(a: Column, b: Column, a_bits: Column, b_bits: Column, cfg: MatchConfig = MATCH) -> Column:
    """False only for different first names of one initial that S-12 rejects.

    A letter that only one side has takes an edit and matches nothing, so the
    letters' bits bound the edits from below and the similarity from above.
    """
    n, m = F.length(a), F.length(b)
    only_a, only_b = F.bit_count(a_bits.bitwiseAND(F.bitwise_not(b_bits))), F.bit_count(b_bits.bitwiseAND(F.bitwise_not(a_bits)))
    edits = (F.abs(n - m) <= cfg.first_name_edits) & (F.greatest(only_a, only_b) <= cfg.first_name_edits)
    jaro = (F.least(n - only_a, m - only_b) * (1 / n + 1 / m) + 1) / 3
    similar = jaro + common_start(a, b) * F.lit(0.1) * (1 - jaro) >= cfg.first_name_similarity - 1e-9
    return (F.least(n, m) > 3) & (edits | similar)


def _passing(met: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Rows of ``met(f1, f2, f1_bits, f2_bits, ...)`` whose first names have one initial and pass S-12, with their similarity ``fj``."""
    a, b = F.col("f1"), F.col("f2")
    met = met.filter((a == b) | first_names_may_pass(a, b, F.col("f1_bits"), F.col("f2_bits"), cfg)).drop("f1_bits", "f2_bits")
    similarity = F.coalesce("_fj", F.lit(1.0))
    met = met.withColumn("_fj", jaro_winkler(F.when(a != b, a), F.when(a != b, b)))
    # A filter would be pushed below the similarity, which is then found twice.
    passed = F.explode(F.array_compact(F.array(F.when(first_names_pass(a, b, similarity, cfg), similarity))))
    return met.select(*[c for c in met.columns if c != "_fj"], passed.alias("fj"))


def _with_bits(names: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return names.filter(c != "").withColumns({"initial": F.left(c, F.lit(1)), f"{name}_bits": letter_bits(c)})


def first_name_pairs(left: DataFrame, right: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """(f1, f2, fj) of two dictionaries of distinct first names that pass S-12, with their similarity.

    First names of one initial meet, which is a product: where surnames must be
    related too, ``related_classes`` makes far fewer pairs.
    """
    left, right = store(_with_bits(left, "f1"), "left-names"), store(_with_bits(right, "f2"), "right-names")
    met = cell_join(left, right, ["initial"], cfg.pairs_per_cell, dealt=True)
    return _passing(met.drop("initial"), cfg).select("f1", "f2", "fj")


def related_classes(left: DataFrame, right: DataFrame, surnames: DataFrame, where: str, cfg: MatchConfig = MATCH) -> DataFrame:
    """Rows of ``left(f1, x, ...)`` and ``right(f2, y, ...)`` with related surnames for which ``where`` holds and first names that pass S-12.

    Adds ``agree``, ``last_ok`` and ``rare`` of the surnames and ``fj`` of the first
    names. A first name is related to very many others and a surname to few, so
    surnames meet before first names are compared, under the first names'
    initial. Nothing is made for related first names without related surnames.
    """
    left, right = _with_bits(left, "f1"), store(_with_bits(right, "f2"), "class-names")
    held = surnames.join(right.select("y", "initial").distinct(), "y")
    sides = store(left.join(held, ["x", "initial"]).filter(where), "class-sides")
    met = cell_join(sides, right, ["y", "initial"], cfg.pairs_per_cell, dealt=True)
    return _passing(met.drop("initial"), cfg)


def surname_pairs(left: DataFrame, right: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """(x, y, agree, last_ok, rare) of two dictionaries of distinct surnames related by S-13 or the last-name rule."""
    x, y = F.col("x"), F.col("y")
    edits = (
        left.select("x", F.explode(edit1_keys(x)).alias("k"))
        .join(right.select("y", F.explode(edit1_keys(y)).alias("k")), "k")
        .select("x", "y")
    )

    def starts(c: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(4), F.length(c)), lambda n: F.left(c, n)))

    cut_right = left.filter(F.length(x) >= 4).select("x", starts(x).alias("y")).join(right, "y")
    cut_left = right.filter(F.length(y) >= 4).select("y", starts(y).alias("x")).join(left, "x")
    pairs = edits.unionByName(cut_right).unionByName(cut_left).distinct()
    longer = F.when(F.length(x) > F.length(y), x).otherwise(y)
    # Whatever agrees by S-13 also agrees by the looser last-name rule, so that rule alone is the filter.
    kept = pairs.withColumn("last_ok", last_names_agree(x, y, cfg)).filter("last_ok")
    kept = kept.withColumn("agree", surnames_agree(x, y, cfg))
    rare = F.col("agree") & (~one_of(x, cfg.common_surnames) | ~one_of(longer, cfg.common_surnames))
    return kept.select("x", "y", "agree", "last_ok", rare.alias("rare"))


def words_inside_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, token, df): every dictionary token that contains the word.

    ``words(word)`` have three letters or more, ``tokens(token, df)`` are the
    distinct page tokens with their page counts. A token that contains a word
    contains all its three-letter pieces, so joining on the word's rarest piece
    finds every one of them.
    """

    def pieces(c: Column) -> Column:
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
        )

    by_piece = tokens.filter(F.length("token") >= 3).select(
        "token", "df", F.explode(pieces(F.col("token"))).alias("piece")
    )
    spread = by_piece.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        words.select("word", F.explode(pieces(F.col("word"))).alias("piece"))
        .join(spread, "piece", "left")
        .groupBy("word")
        # A piece no token holds means that no token holds the word: n is NULL, counts as 0 and wins.
        .agg(F.min_by("piece", F.struct(F.coalesce(F.col("n"), F.lit(0)), F.col("piece"))).alias("piece"))
    )
    return rarest.join(by_piece, "piece").filter(F.col("token").contains(F.col("word"))).select("word", "token", "df")
