"""The payee most like a name, found by upper bounds instead of all pairs.

Payees lie in classes (first name, surname key), classes are split into leaves
(last surname, start, length). Classes and leaves know the largest count of every
letter of their names, so the Jaro-Winkler part of the score has an upper bound
without looking at a single payee: no more letters can match than both sides
have. What else the score depends on (a rare surname, agreeing last surnames, the
first names' similarity) is known exactly for each key.

The search is best first: for every name one payee of its best class is scored,
which is a lower bound; classes that can't reach it are dropped; one payee of
the best remaining leaf is scored; leaves, and then single payees by their own
letters, must reach that. Only what is left is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MATCH, MatchConfig
from ..functions.fold import first_name, let, surnames, without_particles
from ..functions.similarity import with_match_score
from .blocking import SORT_LETTERS, common_start, related_classes
from .linkage import first_names, related_surnames
from .scale import cell_join, store

#: Surname keys of payees for names without a surname, and of payees without one.
ANY, NONE = "*", ""
_COUNTED = (*SORT_LETTERS, " ")
_KEY = ["f2", "y", "tail"]
_LEAF = [*_KEY, "l2", "start", "middle", "n"]
#: Bounds and scores are sums of the same few terms in another order.
_SLACK = 1e-9


def _letters(c: Column) -> Column:
    """How often each counted character occurs, and how many others there are."""
    counts = F.transform(F.array(*[F.lit(x) for x in _COUNTED]), lambda x: F.length(c) - F.length(F.replace(c, x)))
    return let(counts, lambda k: F.concat(k, F.array(F.length(c) - F.aggregate(k, F.lit(0), lambda a, n: a + n))))


def _shape(norm: Column, first: Column, cfg: MatchConfig) -> dict[str, Column]:
    c = without_particles(norm, cfg.particles)
    return {
        "start": F.left(c, F.lit(4)), "middle": F.substring(c, F.length(first) + 2, F.lit(2)), "n": F.length(c), "letters": _letters(c),
    }


def _most(letters: str) -> Column:
    return F.array(*[F.max(F.get(letters, F.lit(k))) for k in range(len(_COUNTED) + 1)])


def similarity_bound(letters: Column, n: Column, other_letters: Column, other_n: Column, start: Column, exact_length: bool) -> Column:
    """No Jaro-Winkler similarity of the two sides is higher; ``other_n`` is the shortest other name unless all have that length."""
    common = F.aggregate(F.zip_with(letters, other_letters, lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    # Every term holds its bound once, so that expressions don't multiply.
    if exact_length:
        parts = F.least(common, n, other_n) * (1 / n + 1 / other_n)
    else:
        parts = let(common, lambda m: F.least(m, n) / n + F.least(m, other_n) / other_n)
    return (parts + 1) / 3 * (1 - start * F.lit(0.1)) + start * F.lit(0.1)


def score_bound(similarity: Column, cfg: MatchConfig) -> Column:
    """S-14 with a bound for its similarity. A pair's own key with the best bound is at least its score.

    Distinctive pairs have a key that is ``rare``; pairs whose last surnames agree have a key that says so (``last``).
    """
    base = F.least(F.lit(1.0), similarity + F.when(F.col("rare"), F.lit(cfg.distinctive_bonus)).otherwise(F.lit(0.0)))
    common = ~F.col("rare") & F.col("several") & ~F.col("last") & ~F.col("y").isin(ANY, NONE)
    capped = F.least(base, F.when(common, F.lit(cfg.common_only_cap)).otherwise(F.lit(1.0)))
    ends = F.col("last") & (F.col("fj") >= cfg.first_name_similarity)
    return F.greatest(capped, F.when(ends, F.lit(cfg.ends_match_floor)).otherwise(F.lit(0.0))) * F.least(F.col("fj"), F.lit(1.0)) + _SLACK


def _can_win(bound: Column, seen: Column) -> Column:
    """Better than the lower bound, or as good and seen earlier."""
    as_good = F.col("least").isNull() | (seen <= F.col("least_seen"))
    return bound >= F.coalesce("least", F.lit(0.0)) + F.when(as_good, F.lit(0.0)).otherwise(F.lit(2 * _SLACK))


def _lower(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("cost"), "seen")).alias("b"))
    return best.select("norm", (-F.col("b.cost")).alias("least"), F.col("b.seen").alias("least_seen"))


def _keys_of_targets(targets: DataFrame, classes: DataFrame, sur: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(norm, f2, y, tail, rare, last, fj): the classes that can hold a payee of a name."""
    held = classes.select(*_KEY)
    tx = targets.filter("size(s1) > 0").select("norm", "f1", F.posexplode("s1").alias("i", "x"), F.size("s1").alias("k"))
    tx = tx.select("norm", "f1", "x", (F.col("i") == F.col("k") - 1).alias("x_last"))
    related = related_classes(tx.select("f1", "x", "x_last").distinct(), held, sur, "agree or (x_last and last_ok)", cfg)
    # Last surnames may agree by the looser rule alone; then the payee's key is its last surname.
    both_last = F.col("x_last") & F.col("tail") & F.col("last_ok")
    related = related.filter(F.col("agree") | both_last).select(
        "f1", "x", "x_last", *_KEY, "fj", (F.col("agree") & F.col("rare")).alias("rare"), both_last.alias("last")
    )
    related = store(related, "near-classes")
    keyed = cell_join(tx, related, ["f1", "x", "x_last"], cfg.pairs_per_cell, dealt=True)
    keyed = keyed.groupBy("norm", *_KEY).agg(F.max("rare").alias("rare"), F.max("last").alias("last"), F.max("fj").alias("fj"))
    # Names without a surname meet all payees of a first name, and payees without one meet all such names.
    for some, y in ((targets.filter("size(s1) > 0"), NONE), (targets.filter("size(s1) = 0"), ANY)):
        alike = held.filter(F.col("y") == y)
        bare = some.select("norm", "f1").join(first_names(some, alike, cfg), "f1").join(alike, "f2")
        keyed = keyed.unionByName(bare.select("norm", *_KEY, F.lit(False).alias("rare"), F.lit(False).alias("last"), "fj"))
    return keyed


def nearest_pairs(targets: DataFrame, payees: DataFrame, dictionaries: tuple[DataFrame | None, DataFrame], cfg: MatchConfig) -> DataFrame:
    """(norm, payee, seen, score, reason), stored: scored pairs, among them every name's best pair of those that share a surname or lack one.

    Of ``dictionaries`` only the surnames are used: first names are related where surnames meet.
    """
    sur = dictionaries[1]
    shaped = store(
        payees.select("payee", "f2", "s2", "seen", F.coalesce(F.try_element_at("s2", F.lit(-1)), F.lit("")).alias("l2"), *[v.alias(k) for k, v in _shape(F.col("payee"), F.col("f2"), cfg).items()]),
        "near-payees",
    )
    some_bare = not targets.filter("size(s1) = 0").isEmpty()
    at_end = F.struct(F.col("l2").alias("y"), F.lit(True).alias("tail"))
    inner = F.transform(F.slice("s2", F.lit(1), F.greatest(F.size("s2") - 1, F.lit(0))), lambda y: F.struct(y.alias("y"), F.lit(False).alias("tail")))
    keys = F.when(F.size("s2") > 0, F.concat(F.array(at_end), inner)).otherwise(F.array(F.struct(F.lit(NONE).alias("y"), F.lit(False).alias("tail"))))
    if some_bare:
        keys = F.concat(keys, F.array(F.struct(F.lit(ANY).alias("y"), F.lit(False).alias("tail"))))
    keyed_payees = shaped.withColumn("key", F.explode(F.array_distinct(keys))).select("payee", "f2", "key.y", "key.tail", "l2", "start", "middle", "n", "letters", "seen")
    leaves = store(
        keyed_payees.groupBy(*_LEAF).agg(_most("letters").alias("letters"), F.min("seen").alias("seen"), F.min_by("payee", "seen").alias("one")), "near-leaves"
    )
    classes = leaves.groupBy(*_KEY).agg(
        _most("letters").alias("letters"), F.min("n").alias("n"), F.min("seen").alias("seen"), F.min_by("one", "seen").alias("one")
    )
    classes = store(classes, "near-class-bounds")
    own = store(
        targets.filter("f1 <> ''").select(
            "norm", "f1", "s1", (F.size("s1") > 1).alias("several"), *[v.alias(f"own_{k}") for k, v in _shape(F.col("norm"), F.col("f1"), cfg).items()]
        ),
        "near-targets",
    )
    about = own.select("norm", "several", "own_n", "own_letters", "own_start")
    keyed = _keys_of_targets(own, classes, sur, cfg).join(about, "norm")

    # Every name's classes with their bounds; one payee of the best one is scored.
    bound = score_bound(similarity_bound(F.col("own_letters"), F.col("own_n"), F.col("letters"), F.col("n"), F.lit(4), False), cfg)
    bounded = store(keyed.join(classes, _KEY).select("norm", *_KEY, "rare", "last", "fj", "seen", "one", bound.alias("bound")), "near-bounds")
    where = shaped.select("payee", "seen")
    pick = bounded.groupBy("norm").agg(F.max_by("one", "bound").alias("payee"))
    same = targets.select("norm").join(where.select(F.col("payee").alias("norm")), "norm").select("norm", F.col("norm").alias("payee"))
    scored_1 = store(with_match_score(pick.unionByName(same).distinct().join(where, "payee"), "norm", "payee", cfg), "near-scores")

    kept = bounded.join(_lower(scored_1), "norm", "left").filter(_can_win(F.col("bound"), F.col("seen"))).drop("seen", "one", "bound")
    kept = kept.join(about, "norm")
    at_leaf = similarity_bound(F.col("own_letters"), F.col("own_n"), F.col("letters"), F.col("n"), common_start(F.col("own_start"), F.col("start")), True)
    in_leaves = cell_join(kept, leaves, _KEY, cfg.pairs_per_cell, dealt=True).withColumn("bound", score_bound(at_leaf, cfg))
    in_leaves = in_leaves.filter(_can_win(F.col("bound"), F.col("seen"))).drop("letters", "own_letters")
    in_leaves = store(in_leaves, "near-open-leaves")
    pick = in_leaves.groupBy("norm").agg(F.max_by("one", "bound").alias("payee")).join(scored_1.select("norm", "payee"), ["norm", "payee"], "left_anti")
    scored_2 = store(with_match_score(pick.join(where, "payee"), "norm", "payee", cfg), "near-scores")
    seen_so_far = scored_1.unionByName(scored_2)

    open_ = in_leaves.drop("least", "least_seen").join(_lower(seen_so_far), "norm", "left").filter(_can_win(F.col("bound"), F.col("seen")))
    open_ = open_.drop("seen", "one", "bound").join(about.select("norm", "own_letters"), "norm")
    of_payee = similarity_bound(F.col("own_letters"), F.col("own_n"), F.col("letters"), F.col("n"), common_start(F.col("own_start"), F.col("start")), True)
    pairs = cell_join(open_, keyed_payees, _LEAF, cfg.pairs_per_cell, dealt=True).filter(_can_win(score_bound(of_payee, cfg), F.col("seen")))
    pairs = pairs.select("norm", "payee", "seen").distinct().join(seen_so_far.select("norm", "payee"), ["norm", "payee"], "left_anti")
    rest = with_match_score(store(pairs, "near-pairs"), "norm", "payee", cfg)
    return store(seen_so_far.unionByName(rest.select(*seen_so_far.columns)), "miss-pairs")


def nearest_payee(
    targets: DataFrame, occurrences: DataFrame, cfg: MatchConfig = MATCH, related: DataFrame | None = None
) -> DataFrame:
    """J-18: (norm, candidate, score, reason): the payee with the highest score above 0, the first seen on ties.

    All pairs of allowed first names and no agreeing surname score the same low
    value, so their first-seen payee per first name is all that is needed, for
    names that have nothing better. ``related`` surnames of a run that holds
    these names and payees are used again.
    """
    norm = F.col("payee")
    seen = occurrences.groupBy("payee").agg(F.min(F.struct("page_ord", "pos")).alias("seen"))
    payees = store(seen.withColumns({"f2": first_name(norm, cfg.particles), "s2": surnames(norm, cfg.particles)}), "miss-payees")
    sur = related_surnames(targets, payees, cfg) if related is None else related
    scored = nearest_pairs(targets, payees, (None, sur), cfg)
    better = scored.filter(F.col("score") > cfg.no_shared_surname).select("norm").distinct()
    poor = store(targets.filter("size(s1) > 0").select("norm", "f1").join(better, "norm", "left_anti"), "near-nothing")
    surnamed = store(payees.filter("size(s2) > 0").groupBy("f2").agg(F.min(F.struct("seen", "payee")).alias("p")), "near-first-seen")
    low = (
        poor.join(first_names(poor, surnamed, cfg), "f1").join(surnamed, "f2")
        .groupBy("norm").agg(F.min("p").alias("p"))
        .select(
            "norm", F.col("p.payee").alias("payee"), F.col("p.seen").alias("seen"),
            F.lit(cfg.no_shared_surname).alias("score"), F.lit("SEM SOBRENOME EM COMUM").alias("reason"),
        )
    )
    # A first-seen payee that does share a surname has a score of its own, which is higher than the low one or rules it out as the best.
    columns = ["norm", "payee", "seen", "score", "reason"]
    every = scored.select(*columns).unionByName(low.select(*columns)).filter("score > 0")
    best = every.groupBy("norm").agg(
        F.min(F.struct((-F.col("score")).alias("cost"), F.col("seen"), F.col("payee"), F.col("reason"))).alias("b")
    )
    return best.select("norm", F.col("b.payee").alias("candidate"), (-F.col("b.cost")).alias("score"), F.col("b.reason").alias("reason"))
