"""Name similarity.

Everything is a native column except Jaro-Winkler, which has no Spark
built-in: it is one Arrow-batched pandas UDF that works on whole batches with
numpy, a loop over character positions and not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MATCH, MatchConfig
from .fold import first_name, one_of, surnames, without_particles, words
from .jaro_winkler import jaro_winkler_series


def jaro_winkler(a: Column, b: Column) -> Column:
    """S-11."""
    return F.pandas_udf(jaro_winkler_series, "double")(a, b)


def within_edits(a: Column, b: Column, most: int) -> Column:
    """S-10 bound test; the bounded built-in returns -1 above the limit."""
    return F.levenshtein(a, b, most) >= 0


def first_names_pass(a: Column, b: Column, jw: Column, cfg: MatchConfig = MATCH) -> Column:
    """S-12, given the Jaro-Winkler score of the two first names."""
    comparable = (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.least(F.length(a), F.length(b)) > 3)
    near = within_edits(a, b, cfg.first_name_edits) | (jw >= cfg.first_name_similarity)
    return (a == b) | ((a != "") & (b != "") & comparable & near)


def _same_surname(x: Column, y: Column, cfg: MatchConfig) -> Column:
    return (x == y) | within_edits(x, y, cfg.surname_edits)


def _cut_surname(x: Column, y: Column) -> Column:
    """One is the start of the other: left >= 5 letters, right >= 4, and the short one long enough."""
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    starts = F.startswith(x, y) | F.startswith(y, x)
    return (F.length(x) >= 5) & (F.length(y) >= 4) & starts & (short >= F.least(F.lit(5.0), long * F.lit(0.6)))


def surnames_agree(x: Column, y: Column, cfg: MatchConfig = MATCH) -> Column:
    """The pair rule of S-13."""
    return _same_surname(x, y, cfg) | _cut_surname(x, y)


def surname_overlap(left: Column, right: Column, cfg: MatchConfig = MATCH) -> Column:
    """S-13 as struct(count, distinctive). Every left surname takes its first agreeing right surname."""

    def one(x: Column) -> Column:
        y = F.get(F.filter(right, lambda r: surnames_agree(x, r, cfg)), F.lit(0))
        longer = F.when(F.length(x) > F.length(y), x).otherwise(y)
        rare = F.when(_same_surname(x, y, cfg), ~one_of(x, cfg.common_surnames)).otherwise(
            ~one_of(longer, cfg.common_surnames)
        )
        return F.struct(y.isNotNull().alias("hit"), (y.isNotNull() & rare).alias("rare"))

    hits = F.transform(left, one)
    return F.struct(
        F.size(F.filter(hits, lambda h: h["hit"])).alias("count"),
        F.exists(hits, lambda h: h["rare"]).alias("distinctive"),
    )


def last_names_agree(x: Column, y: Column, cfg: MatchConfig = MATCH) -> Column:
    """The looser rule used for the last surnames only."""
    starts = (F.length(x) >= 4) & (F.length(y) >= 4) & (F.startswith(x, y) | F.startswith(y, x))
    return within_edits(x, y, cfg.surname_edits) | starts


def last_surnames_agree(left: Column, right: Column, cfg: MatchConfig = MATCH) -> Column:
    x = F.try_element_at(left, F.lit(-1))
    y = F.try_element_at(right, F.lit(-1))
    return F.coalesce(last_names_agree(x, y, cfg), F.lit(False))


def score_text(score: Column, cfg: MatchConfig = MATCH) -> Column:
    """S-32."""
    shown = F.format_string("%.2f", score)
    return (
        F.when(score >= cfg.accept, F.concat(F.lit("SCORE ALTO ("), shown, F.lit(")")))
        .when(score >= cfg.partial, F.concat(F.lit("CANDIDATO PARCIAL ("), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("SCORE BAIXO ("), shown, F.lit(")")))
    )


def with_match_score(
    df: DataFrame,
    target: str,
    candidate: str,
    cfg: MatchConfig = MATCH,
    score: str = "score",
    reason: str = "reason",
) -> DataFrame:
    """S-14. Adds ``score`` and ``reason`` for two folded names; the target is always the left side."""
    t, c = F.col(target), F.col(candidate)
    keep = df.columns
    df = df.withColumns(
        {
            "_f1": first_name(t, cfg.particles), "_s1": surnames(t, cfg.particles),
            "_f2": first_name(c, cfg.particles), "_s2": surnames(c, cfg.particles),
            "_c1": without_particles(t, cfg.particles), "_c2": without_particles(c, cfg.particles),
        }
    )
    same_initial = F.left(F.col("_f1"), F.lit(1)) == F.left(F.col("_f2"), F.lit(1))
    # Pairs that cannot pass blocking send NULLs, so Python is not asked about them.
    df = df.withColumns(
        {
            "_fj": jaro_winkler(F.when(same_initial, F.col("_f1")), F.when(same_initial, F.col("_f2"))),
            "_nj": jaro_winkler(F.when(same_initial, F.col("_c1")), F.when(same_initial, F.col("_c2"))),
        }
    )
    f1, f2, s1, s2, fj = (F.col(x) for x in ("_f1", "_f2", "_s1", "_s2", "_fj"))
    df = df.withColumns(
        {
            "_pass": first_names_pass(f1, f2, F.coalesce(fj, F.lit(0.0)), cfg),
            "_ov": surname_overlap(s1, s2, cfg),
            "_last": last_surnames_agree(s1, s2, cfg),
        }
    )
    n, rare, last = F.col("_ov.count"), F.col("_ov.distinctive"), F.col("_last")
    base = F.when(rare, F.least(F.lit(1.0), F.col("_nj") + cfg.distinctive_bonus)).otherwise(F.col("_nj"))
    capped = F.when((n > 0) & ~rare & (F.size(s1) > 1) & ~last, F.least(base, F.lit(cfg.common_only_cap))).otherwise(base)
    floored = F.when(
        (fj >= cfg.first_name_similarity) & last, F.greatest(capped, F.lit(cfg.ends_match_floor))
    ).otherwise(capped)
    final = F.when(f1 != f2, floored * fj).otherwise(floored)
    empty = (f1 == "") | (f2 == "")
    apart = (n == 0) & (F.size(s1) > 0) & (F.size(s2) > 0)
    df = df.withColumn(
        score,
        F.when(t == c, F.lit(1.0))
        .when(empty | ~F.col("_pass"), F.lit(0.0))
        .when(apart, F.lit(cfg.no_shared_surname))
        .otherwise(final),
    )
    df = df.withColumn(
        reason,
        F.when(t == c, F.lit("EXATO"))
        .when(empty, F.lit("NOME VAZIO"))
        .when(~F.col("_pass"), F.concat(F.lit("PRIMEIRO NOME DIFERENTE: "), f1, F.lit(" ≠ "), f2))
        .when(apart, F.lit("SEM SOBRENOME EM COMUM"))
        .otherwise(score_text(F.col(score), cfg)),
    )
    return df.select(*keep, score, reason)


def loosely_equal(a: Column, b: Column) -> Column:
    """S-16 on two names folded with S-2."""
    wa, wb = words(a, 3), words(b, 3)
    shared = F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))
    ends = (F.get(wa, F.lit(0)) == F.get(wb, F.lit(0))) & (
        F.try_element_at(wa, F.lit(-1)) == F.try_element_at(wb, F.lit(-1))
    )
    enough = (shared >= 2) & (shared >= F.ceil(F.least(F.size(wa), F.size(wb)) * F.lit(0.6)))
    some = (a != "") & (b != "")
    return some & ((a == b) | ((F.size(wa) > 0) & (F.size(wb) > 0) & (ends | enough)))
