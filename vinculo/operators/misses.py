"""Why an employee stayed without a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import MATCH, MatchConfig
from ..functions.fold import words
from .linkage import Prepared, payee_occurrences
from .nearest import nearest_payee
from .postings import at_distance, first_place, word_offsets, word_postings
from .scale import cell_join, number_rows, store


def unlinked(employees: DataFrame, links: DataFrame) -> DataFrame:
    """U-5: employees without an accepted link."""
    return employees.join(links.filter("accepted").select("emp_ord"), "emp_ord", "left_anti")


def found_in_text(targets: DataFrame, pages: DataFrame, index: DataFrame, vocabulary: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """S-30: norms whose whole name is in some page, or whose first and last word start within the distance.

    Unlike the link methods there is no lower limit on the name length, no word
    bound and no lower limit on the distance. Distances come from the postings
    of each distinct (first, last), the one on fewer pages leading. Pages are
    read only for names that no distance has found, where both ends stand as
    far apart as in the name.
    """
    named = targets.select("norm", "words", "first", "last")
    two, one = named.filter(F.size("words") >= 2), named.filter(F.size("words") == 1)
    ends = two.select(F.explode(F.array("first", "last")).alias("word")).unionByName(one.select(F.col("first").alias("word"))).distinct()
    postings = word_postings(ends, index, vocabulary)
    load = lambda end, name: postings.load.select(F.col("word").alias(end), F.col("load").alias(name))
    pairs = two.select("first", "last").distinct().join(load("first", "fl"), "first").join(load("last", "ll"), "last")
    rare = F.col("fl") <= F.col("ll")
    keys = pairs.select("first", "last", rare.alias("by_first"), F.when(rare, F.col("first")).otherwise(F.col("last")).alias("word"))
    near = cell_join(keys, postings.rows, ["word"], cfg.pairs_per_cell).select(
        "first", "last", "by_first", "page_ord", F.col("at").alias("own"), F.when(F.col("by_first"), F.col("last")).otherwise(F.col("first")).alias("word")
    )
    near = near.join(postings.rows.select("word", "page_ord", F.col("at").alias("other")), ["word", "page_ord"]).select(
        "first", "last", "page_ord", F.when(F.col("by_first"), F.col("own")).otherwise(F.col("other")).alias("first_at"),
        F.when(F.col("by_first"), F.col("other")).otherwise(F.col("own")).alias("last_at"),
    )
    close = F.abs(first_place(F.col("first_at")) - first_place(F.col("last_at"))) < cfg.proximity_chars
    offsets = word_offsets(F.col("norm"))
    names = two.select("norm", "first", "last", (F.element_at(offsets, -1) - F.get(offsets, F.lit(0))).alias("distance"))
    # One row says that a name is found by distance; the other rows are pages to read if it isn't.
    places = near.withColumn("close", close).join(names, ["first", "last"])
    places = places.filter(F.col("close") | at_distance(F.col("first_at"), F.col("last_at"), F.col("distance")))
    places = store(places.select("norm", F.when(~F.col("close"), F.col("page_ord")).alias("page_ord")).distinct(), "miss-places")
    found = places.filter("page_ord is null").select("norm")
    read = places.filter("page_ord is not null").join(found, "norm", "left_anti")
    # A name that is one word is found by its word; with short words beside it, pages with the word are read.
    alone = one.filter("norm = first").join(postings.load.select(F.col("word").alias("first")), "first").select("norm")
    beside = cell_join(one.filter("norm <> first").select("norm", F.col("first").alias("word")), postings.rows.select("word", "page_ord"), ["word"], cfg.pairs_per_cell)
    read = read.unionByName(beside.select("norm", "page_ord")).join(pages.select("page_ord", F.col("norm").alias("page")), "page_ord")
    found = found.unionByName(alone).unionByName(read.filter(F.contains("page", "norm")).select("norm"))
    short = targets.filter((F.size("words") == 0) & (F.col("norm") != "")).select("norm", F.split("norm", " ").alias("t"))
    if not short.isEmpty():
        found = found.unionByName(_short_names_in_text(short, index.select("page_ord", "token"), pages))
    # An empty name is part of every text.
    blank = targets.filter("norm = ''").select("norm").join(pages.select("page_ord").limit(1), how="cross").select("norm")
    return found.unionByName(blank).distinct()


def _short_names_in_text(short: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """Norms made of words under three letters that occur in some page, looked up by pieces of its tokens."""
    # Three words or more: the inner ones are whole tokens of the page.
    inner = short.filter(F.size("t") >= 3).select("norm", F.element_at("t", 2).alias("token")).join(index, "token")
    # Two words: the first one ends a token.
    edge = short.filter(F.size("t") == 2).select(
        "norm", F.length(F.get("t", F.lit(0))).alias("len"), F.get("t", F.lit(0)).alias("tail")
    )
    tails = index.select("page_ord", "token", F.explode(F.array(F.lit(1), F.lit(2))).alias("len")).select(
        "page_ord", "len", F.right("token", F.col("len")).alias("tail")
    )
    # One word: it is a piece of a token.
    single = short.filter(F.size("t") == 1).select("norm", F.get("t", F.lit(0)).alias("piece"))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("token")),
            lambda k: F.array(F.substring("token", k, F.lit(1)), F.substring("token", k, F.lit(2))),
        )
    )
    bits = index.select("page_ord", F.explode(F.array_distinct(pieces)).alias("piece"))
    pairs = (
        inner.select("norm", "page_ord")
        .unionByName(edge.join(tails, ["len", "tail"]).select("norm", "page_ord"))
        .unionByName(single.join(bits, "piece").select("norm", "page_ord"))
        .distinct()
    )
    return (
        pairs.join(pages.select("page_ord", F.col("norm").alias("page")), "page_ord")
        .filter(F.contains("page", "norm")).select("norm")
    )


def miss_reason(as_payee: Column, in_text: Column, candidate: Column, score_reason: Column) -> Column:
    """S-29 text; the first rule that holds wins."""
    return (
        F.when(as_payee, C.REASON_AS_PAYEE)
        .when(in_text, C.REASON_IN_TEXT)
        .when(candidate.isNotNull(), F.concat(score_reason, F.lit(" (candidato: "), candidate, F.lit(")")))
        .otherwise(C.REASON_NONE)
    )


def _by_rule(texts: tuple[str, str, str, str]):
    def choose(as_payee: Column, in_text: Column, candidate: Column) -> Column:
        return (
            F.when(as_payee, texts[0]).when(in_text, texts[1])
            .when(candidate != C.NO_CANDIDATE, texts[2]).otherwise(texts[3])
        )

    return choose


miss_category = _by_rule((C.CATEGORY_AS_PAYEE, C.CATEGORY_IN_TEXT, C.CATEGORY_CANDIDATE, C.CATEGORY_NONE))
miss_badge = _by_rule((C.BADGE_AS_PAYEE, C.BADGE_IN_TEXT, C.BADGE_CANDIDATE, C.BADGE_NONE))


def shared_words(a: Column, b: Column) -> Column:
    """U-4: words of three letters or more of ``a`` that ``b`` has too, repeats in ``a`` counted."""
    other = words(b, 3)
    return F.size(F.filter(words(a, 3), lambda w: F.array_contains(other, w)))


def explain_misses(run: Prepared, links: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """The miss report: one row per employee without an accepted link, numbered in employee order (W-8)."""
    targets = store(unlinked(run.targets, links), "misses")
    occurrences = payee_occurrences(run.pages)
    in_text = found_in_text(targets, run.pages, run.index, run.vocabulary, cfg).withColumn("found_in_full_text", F.lit(True))
    as_payee = occurrences.select(F.col("payee").alias("norm")).distinct().withColumn("found_as_payee", F.lit(True))
    near = nearest_payee(targets, occurrences, cfg, run.surnames)
    report = (
        targets.join(in_text, "norm", "left")
        .join(as_payee, "norm", "left")
        .join(near, "norm", "left")
        .withColumns(
            {
                "found_in_full_text": F.coalesce("found_in_full_text", F.lit(False)),
                "found_as_payee": F.coalesce("found_as_payee", F.lit(False)),
            }
        )
        .withColumns(
            {
                "reason": miss_reason(
                    F.col("found_as_payee"), F.col("found_in_full_text"), F.col("candidate"), F.col("reason")
                ),
                "shared_words": F.coalesce(shared_words(F.col("norm"), F.col("candidate")), F.lit(0)),
                "closest_candidate": F.coalesce("candidate", F.lit(C.NO_CANDIDATE)),
            }
        )
    )
    report = report.select(
        "emp_ord", "name", F.col("norm").alias("normalized"), F.col("first").alias("first_name"),
        F.col("last").alias("last_name"), F.col("slip_file").alias("source_file"),
        F.col("slip_page").alias("source_page"), "found_in_full_text", "found_as_payee", "closest_candidate",
        "shared_words", "reason",
    )
    return number_rows(report, F.col("emp_ord"), name="index")


def reason_counts(report: DataFrame) -> DataFrame:
    """A-9: misses per category."""
    category = miss_category(F.col("found_as_payee"), F.col("found_in_full_text"), F.col("closest_candidate"))
    return report.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("misses")).orderBy(F.desc("misses"))


def search_misses(report: DataFrame, text: str) -> DataFrame:
    """P-17: case-blind search in name or reason."""
    needle = text.lower()
    return report.filter(F.lower("name").contains(needle) | F.lower("reason").contains(needle))


def page_statistics(prepared_pages: DataFrame, min_chars: int = C.TEXT.text_page_chars) -> DataFrame:
    """A-7: one row of page and payee counts."""
    pages = prepared_pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.length("norm") > min_chars).alias("pages_with_text"),
        F.count_if(F.size("payees") == 0).alias("pages_without_payee"),
        F.coalesce(F.sum(F.size("payees")), F.lit(0)).alias("payees_total"),
    )
    distinct = prepared_pages.select(F.explode("payees").alias("p")).agg(F.countDistinct("p").alias("payees_distinct"))
    return pages.join(F.broadcast(distinct))  # one row each


def numbered_payees(prepared_pages: DataFrame) -> DataFrame:
    """L-6: all distinct payees in order, numbered."""
    return number_rows(
        prepared_pages.select(F.explode("payees").alias("payee")).distinct(), F.col("payee"), name="position"
    )
