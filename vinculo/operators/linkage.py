"""Employee to receipt-page linkage: candidate generation, methods, best page, one winner per page.

Inputs are page tables ``(file_id, file_name, file_ord, page_no, text)``. Every
ordered list of the problem carries explicit integers: ``page_ord`` orders
receipt pages over all files, ``emp_ord`` orders employees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MATCH, MatchConfig
from ..functions.extract import employee_names, payee_names
from ..functions.fold import first_name, fold_name_ocr, let, prepared_target, surnames
from ..functions.similarity import with_match_score
from .blocking import first_name_pairs, related_classes, surname_pairs
from .postings import (
    at_distance, first_place, in_order, phrase_start, place, positional_index, stands_whole, vocabulary_of, word_offsets, word_postings,
)
from .scale import cell_join, store

METHODS = ("favorecido", "substring", "word-overlap", "proximity")


def page_ord(file_ord: Column, page_no: Column) -> Column:
    return F.shiftleft(file_ord.cast("long"), 32) + page_no.cast("long")


def employees_from_slips(slips: DataFrame, phase: Column | None = None) -> DataFrame:
    """X-1 and W-1: one row per distinct folded name, the first one seen.

    ``phase`` orders pages of one file that were read at different times (native
    text 0 before OCR text 1). Grouping with ``min`` combines before the shuffle,
    so a name on very many slips costs one row per task.
    """
    phase = F.lit(0) if phase is None else phase
    order = F.shiftleft(F.col("file_ord").cast("long"), 33) + F.shiftleft(phase.cast("long"), 32) + F.col("page_no")
    named = slips.select("file_id", "file_name", "page_no", order.alias("emp_ord"), employee_names(F.col("text")).alias("name"))
    named = named.withColumn("norm", fold_name_ocr(F.col("name")))
    return first_seen(named, "norm", "emp_ord").select(
        "emp_ord", "name", "norm", F.col("file_name").alias("slip_file"), F.col("page_no").alias("slip_page")
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` per ``key``."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_best"))
    return best.select(key, "_best.*")


def prepare_targets(employees: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """S-17 for names, plus the score tokens of S-9."""
    norm = F.col("norm")
    return employees.withColumns(
        {
            **prepared_target(norm, cfg),
            "f1": first_name(norm, cfg.particles),
            "s1": surnames(norm, cfg.particles),
        }
    )


def prepare_pages(pages: DataFrame) -> DataFrame:
    """S-17 for pages: folded text and payee list."""
    return pages.select(
        "file_id", "file_name", "file_ord", "page_no",
        page_ord(F.col("file_ord"), F.col("page_no")).alias("page_ord"),
        fold_name_ocr(F.col("text")).alias("norm"),
        payee_names(F.col("text")).alias("payees"),
    )


def first_copies(pages: DataFrame) -> DataFrame:
    """Drop pages that repeat an earlier page.

    What a page matches depends on its folded text and payees only, and of two
    equal pages the earlier one always wins (earlier file first, earlier page on
    equal scores), so later copies can never be chosen. Only hashes and ordinals
    are grouped; texts move once, in the semi join.
    """
    key = F.sha2(F.concat_ws("|", F.col("norm"), F.array_join("payees", "|")), 256)
    kept = pages.groupBy(key.alias("_key")).agg(F.min("page_ord").alias("page_ord")).select("page_ord")
    return pages.join(kept, "page_ord", "left_semi")


# ---------------------------------------------------------------------------
# Payee method
# ---------------------------------------------------------------------------

def payee_occurrences(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_ord", F.shiftright("page_ord", 32).cast("int").alias("file_ord"), F.posexplode("payees").alias("pos", "payee")
    )


def _era(file_ord: Column) -> Column:
    """Exponential age class of a file: 0, 1-2, 3-6, 7-14, ..."""
    return F.floor(F.log2(file_ord.cast("double") + 1)).cast("int")


def _until(bound_file: Column, last_era: Column) -> Column:
    """All age classes up to the one of ``bound_file``; all classes when there is no bound."""
    return F.sequence(F.lit(0), F.coalesce(_era(bound_file), last_era))


def first_names(targets: DataFrame, payees: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Stored (f1, f2, fj): related first names. A product of two dictionaries, so only for rows that meet by first names alone."""
    pairs = first_name_pairs(targets.select("f1").filter("f1 <> ''").distinct(), payees.select("f2").filter("f2 <> ''").distinct(), cfg)
    return store(pairs, "first-names")


def related_surnames(targets: DataFrame, payees: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Stored (x, y, agree, last_ok, rare): related surnames."""
    pairs = surname_pairs(
        targets.select(F.explode("s1").alias("x")).distinct(), payees.select(F.explode("s2").alias("y")).distinct(), cfg
    )
    return store(pairs, "surnames")


def name_dictionaries(targets: DataFrame, payees: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """All related first names and surnames. The link run relates first names only where surnames meet."""
    return first_names(targets, payees, cfg), related_surnames(targets, payees, cfg)


def payee_pairs(
    targets: DataFrame,
    payees: DataFrame,
    sur: DataFrame,
    cfg: MatchConfig,
    nearest: bool = False,
    last_era: int = 0,
) -> DataFrame:
    """Candidate (target, payee) norm pairs, complete for scores of ``cfg.relaxed`` and more.

    A pair can only score that high when the first names pass blocking and
    (a) one side has no surname, or (b) a surname agrees that is not among the
    common ones, or the last surnames agree, or the target has one surname
    only. With ``nearest`` any agreeing surname counts. ``targets`` may carry a
    ``bound`` (page_ord): payees first seen in later files are of no use to it.
    """
    base = targets.select("norm", "f1", "s1", "bound", F.size("s1").alias("n1"))

    # (a) names without surnames: few distinct ones per first name.
    no_surname = base.filter("n1 = 0").select("norm", "bound", "f1")
    bare_t = cell_join(
        no_surname.join(first_names(no_surname, payees, cfg), "f1"), payees.select("f2", "payee", "first_ord"), ["f2"], cfg.pairs_per_cell
    )
    no_surname, others = payees.filter("size(s2) = 0").select("f2", "payee", "first_ord"), base.filter("n1 > 0").select("norm", "bound", "f1")
    bare_p = cell_join(no_surname.join(first_names(others, no_surname, cfg), "f2"), others, ["f1"], cfg.pairs_per_cell)
    out = [d.select("norm", "bound", "payee", "first_ord") for d in (bare_t, bare_p)]

    # (b) surname keys. Which (first name, surname) classes can meet is settled on distinct classes.
    tx = base.filter("n1 > 0").select(
        "norm", "bound", "f1", (F.col("n1") == 1).alias("single"), "n1", F.posexplode("s1").alias("i", "x")
    ).withColumn("x_last", F.col("i") == F.col("n1") - 1).drop("i", "n1")
    py = payees.filter("size(s2) > 0").select(
        "payee", "first_ord", "f2", F.size("s2").alias("n2"), F.posexplode("s2").alias("j", "y")
    ).withColumn("y_last", F.col("j") == F.col("n2") - 1).drop("n2", "j")
    held = py.select("f2", "y", "y_last").groupBy("f2", "y").agg(F.max("y_last").alias("some_last"))
    wanted = "agree" if nearest else "rare or (single and agree) or (x_last and last_ok)"
    related = related_classes(tx.select("f1", "x", "x_last", "single").distinct(), held, sur, wanted, cfg)
    if nearest:
        related = related.withColumn("need_last", F.lit(False))
    else:
        open_key = F.col("rare") | (F.col("single") & F.col("agree"))
        # Equal first names whose last surnames agree are settled per class and need no pairs.
        by_last = F.expr("x_last and last_ok and some_last and not (f1 = f2 and agree)")
        roles = F.array(F.when(open_key, False), F.when(by_last & ~open_key, True))
        related = related.withColumn("need_last", F.explode(F.filter(roles, lambda r: r.isNotNull())))
    classes = related.select("f1", "x", "x_last", "single", "f2", "y", "need_last")
    classes = store(classes, "name-classes")
    keyed = tx.join(classes, ["f1", "x", "x_last", "single"]).select("norm", "bound", "f2", "y", "need_last")
    if nearest:
        keys = ["f2", "y"]
    else:
        # Payees first seen in later files than the bound are of no use: a payee joins from its age class of files on.
        # Names are many for each payee and not copied.
        keys = ["f2", "y", "era"]
        latest = F.lit(last_era)
        keyed = keyed.withColumn("era", F.coalesce(F.least(_era(F.shiftright("bound", 32)), latest), latest))
        py = py.withColumn("era", F.explode(F.sequence(_era(F.shiftright("first_ord", 32)), latest)))
    pairs = cell_join(store(keyed, "payee-keys"), py, keys, cfg.pairs_per_cell, dealt=True).filter("not need_last or y_last")
    if not nearest:
        pairs = pairs.filter("bound is null or first_ord <= bound")
    out.append(pairs.select("norm", "bound", "payee", "first_ord"))
    found = out[0].unionByName(out[1]).unionByName(out[2])
    if not nearest:
        found = found.filter("bound is null or first_ord <= bound")
    return found.select("norm", "payee", "first_ord").distinct()


def class_bounds(targets: DataFrame, payees: DataFrame, surnames_related: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(norm, bound): earliest page that surely scores 1.0 for a target, found without pairs.

    Equal names score 1.0. Equal first names with agreeing last surnames score
    at least ``cfg.ends_match_floor`` whatever lies between, so one first
    occurrence per (first, last) class stands for all payees of the class.
    """
    exact = targets.select("norm").join(
        payees.select(F.col("payee").alias("norm"), F.col("first_ord").alias("bound")), "norm"
    )
    if cfg.ends_match_floor < cfg.accept:
        return exact
    t = targets.filter("size(s1) > 0").select("norm", "f1", F.element_at("s1", -1).alias("x"))
    p = (
        payees.filter("size(s2) > 0")
        .groupBy(F.col("f2").alias("f1"), F.element_at("s2", -1).alias("y"))
        .agg(F.min("first_ord").alias("bound"))
    )
    sur = surnames_related.filter("agree and last_ok").select("x", "y")
    classes = (
        t.select("f1", "x").distinct().join(sur, "x").join(p, ["f1", "y"]).groupBy("f1", "x").agg(F.min("bound").alias("bound"))
    )
    by_class = t.join(classes, ["f1", "x"]).select("norm", "bound")
    return exact.unionByName(by_class).groupBy("norm").agg(F.min("bound").alias("bound"))


def payee_dictionary(occurrences: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Distinct payee names with their first page and score tokens."""
    norm = F.col("payee")
    return (
        occurrences.groupBy("payee").agg(F.min("page_ord").alias("first_ord"))
        .withColumns({"f2": first_name(norm, cfg.particles), "s2": surnames(norm, cfg.particles)})
    )


def accepted_pairs(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``pairs(norm, payee, ...)`` that score ``cfg.relaxed`` or more. A filter would be pushed below the score, which is then found twice."""
    scored, score = with_match_score(pairs, "norm", "payee", cfg), F.col("score")
    return scored.withColumn("score", F.explode(F.array_compact(F.array(F.when(score >= cfg.relaxed, score)))))


def payee_hits(targets: DataFrame, payees: DataFrame, sur: DataFrame, occurrences: DataFrame, cfg: MatchConfig, last_era: int) -> DataFrame:
    """J-2 as (norm, page_ord, score, sure): the only pages a payee hit can make the best page of a target.

    A sure hit scores 1.0 on every page of its payee, so its first page stands
    for all. Weaker hits keep all pages of the first file that has any.
    """
    bounds = store(class_bounds(targets, payees, sur, cfg), "bounds")
    bounded = targets.join(bounds, "norm", "left")
    pairs = store(payee_pairs(bounded, payees, sur, cfg, last_era=last_era), "payee-pairs")
    scored = store(accepted_pairs(pairs, cfg).select("norm", "payee", "first_ord", "score"), "payee-scores")
    sure = (
        bounds.select("norm", "bound")
        .unionByName(scored.filter(F.col("score") >= cfg.accept).select("norm", F.col("first_ord").alias("bound")))
        .groupBy("norm").agg(F.min("bound").alias("bound"))
    )
    weak = scored.filter(F.col("score") < cfg.accept)
    weak_file = weak.groupBy("norm").agg(F.min(F.shiftright("first_ord", 32)).alias("weak_file"))
    state = sure.join(weak_file, "norm", "full")
    sure_file = F.shiftright("bound", 32)
    is_sure = F.coalesce(sure_file <= F.coalesce(F.col("weak_file"), sure_file), F.lit(False))
    state = state.withColumn("sure", is_sure)
    sure_hits = state.filter("sure").select(
        "norm", F.col("bound").alias("page_ord"), F.lit(1.0).alias("score"), F.lit(True).alias("sure")
    )
    weak_hits = (
        state.filter("not sure").select("norm", F.col("weak_file").cast("int").alias("file_ord"))
        .join(weak.select("norm", "payee", "score"), "norm")
        .join(occurrences, ["payee", "file_ord"])
        .groupBy("norm", "page_ord").agg(F.min_by("score", "pos").alias("score"))
        .withColumn("sure", F.lit(False))
    )
    return sure_hits.unionByName(weak_hits)


# ---------------------------------------------------------------------------
# Text methods
# ---------------------------------------------------------------------------

def rarest_tokens(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(norm, token): the token of each name that is on the fewest pages, of which a page with the whole name must hold one.

    A token no page has wins, and then nothing is found.
    """
    each = names.select("norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("token")).join(vocabulary, "token", "left")
    return each.groupBy("norm").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token"))


def whole_name(page: Column, norm: Column, cfg: MatchConfig = MATCH) -> Column:
    """J-3. Only the first occurrence of the whole name is tested for word bounds."""
    at = F.instr(page, norm)
    before = F.substring(page, at - 1, F.lit(1))
    after = F.substring(page, at + F.length(norm), F.lit(1))
    return (F.length(norm) >= cfg.substring_min_chars) & (at > 0) & ((at == 1) | (before == " ")) & ((after == "") | (after == " "))


def _reach(last_era: int) -> Column:
    """Age classes of files up to ``last_ord``. A bound that ends in front of a file may be -1: then no page is left and the list is empty."""
    some = F.coalesce(F.col("last_ord"), F.lit(0)) >= 0
    return F.when(some, _until(F.shiftright("last_ord", 32), F.lit(last_era))).otherwise(F.array().cast("array<int>"))


def text_hits(targets: DataFrame, pages: DataFrame, index: DataFrame, vocabulary: DataFrame, cfg: MatchConfig, last_era: int) -> DataFrame:
    """(norm, page_ord, rank). ``targets`` carry ``last_ord``: pages after it cannot win for the target."""
    hits = _hits_of_two_words(targets.filter("last <> ''"), pages, index, vocabulary, cfg, last_era)
    one = targets.filter((F.col("last") == "") & (F.length("norm") >= cfg.substring_min_chars))
    if not one.isEmpty():
        hits = hits.unionByName(_hits_of_one_word(one, pages, index, vocabulary, cfg, last_era))
    return hits


def _hits_of_two_words(two: DataFrame, pages: DataFrame, index: DataFrame, vocabulary: DataFrame, cfg: MatchConfig, last_era: int) -> DataFrame:
    """Names with a first and a last word, decided on the places of their words.

    Both ends must be on a page. Pages come from the postings of the end that is
    on fewer pages; the other end's places are joined to them, and the places of
    the words between to what can still be a hit in order. Page texts are only
    read where a name with words under three letters stands at the right
    distances.
    """
    postings = word_postings(two.select(F.explode("words").alias("word")).distinct(), index, vocabulary)
    rows = postings.rows
    ends = two.join(postings.load.select(F.col("word").alias("first"), F.col("load").alias("fl")), "first").join(
        postings.load.select(F.col("word").alias("last"), F.col("load").alias("ll")), "last"
    )
    rare = F.col("fl") <= F.col("ll")
    keys = ends.select(
        "norm", "last_ord", "first", "last", rare.alias("by_first"), F.when(rare, F.col("first")).otherwise(F.col("last")).alias("word"),
        F.explode(_reach(last_era)).alias("era"),
    )
    keys = store(keys, "text-keys")
    # The repeated word of a name like ANA ... ANA is one set of places on both ends.
    wanted = rows.join(keys.select("word").distinct(), "word", "left_semi").withColumn("era", _era(F.shiftright("page_ord", 32)))
    near = cell_join(keys, wanted, ["word", "era"], cfg.pairs_per_cell).filter("last_ord is null or page_ord <= last_ord")
    near = near.select("norm", "page_ord", "by_first", F.col("at").alias("own"), F.when(F.col("by_first"), F.col("last")).otherwise(F.col("first")).alias("word"))
    both = near.join(rows.select("word", "page_ord", F.col("at").alias("other")), ["word", "page_ord"]).select(
        "norm", "page_ord", F.when(F.col("by_first"), F.col("own")).otherwise(F.col("other")).alias("first_at"),
        F.when(F.col("by_first"), F.col("other")).otherwise(F.col("own")).alias("last_at"),
    )
    names = two.select("norm", "words", "required", word_offsets(F.col("norm")).alias("offsets"), (F.size(F.split("norm", " ")) == F.size("words")).alias("plain"))
    both = both.join(names, "norm")
    gap = F.abs(first_place(F.col("first_at")) - first_place(F.col("last_at")))
    distance = F.element_at("offsets", -1) - F.get("offsets", F.lit(0))
    phrase = (F.length("norm") >= cfg.substring_min_chars) & at_distance(F.col("first_at"), F.col("last_at"), distance)
    ordered = stands_whole(F.col("first_at")) & stands_whole(F.col("last_at"))
    both = both.withColumns({"close": (gap > 0) & (gap < cfg.proximity_chars), "open": phrase | ordered, "phrase": phrase})
    both = store(both.filter("close or open"), "text-places")

    # The words between the ends, for pages where they matter.
    middle = F.when(F.size("words") > 2, F.slice(F.transform("words", lambda w, i: F.struct(i.alias("k"), w.alias("word"))), F.lit(2), F.size("words") - 2))
    between = both.filter(F.col("open") & (F.size("words") > 2)).select("norm", "page_ord", F.explode(middle).alias("m")).select("norm", "page_ord", "m.k", "m.word")
    between = between.join(rows, ["word", "page_ord"]).groupBy("norm", "page_ord").agg(F.map_from_entries(F.collect_list(F.struct("k", "at"))).alias("found"))
    open_ = both.filter("open").join(between, ["norm", "page_ord"], "left")
    nothing = F.array().cast("array<int>")
    inner = lambda k: F.coalesce(F.try_element_at("found", k), nothing)
    last = F.size("words") - 1
    ats = F.transform("words", lambda _, k: F.when(k == 0, F.col("first_at")).when(k == last, F.col("last_at")).otherwise(inner(k)))

    def bounded(start: Column) -> Column:
        # Only the first occurrence of the whole name is tested for word bounds.
        end = F.exists("last_at", lambda q: (place(q) == place(start) + distance) & (q.bitwiseAND(F.lit(1)) == 1))
        return start.isNotNull() & (start.bitwiseAND(F.lit(2)) == 2) & end

    def decide(ats: Column) -> Column:
        overlap = (
            stands_whole(F.col("first_at")) & stands_whole(F.col("last_at"))
            & (F.size(F.filter(ats, stands_whole)) >= F.col("required")) & in_order(ats, F.col("words"))
        )
        whole = F.col("phrase") & F.col("plain") & let(phrase_start(ats, F.col("offsets")), bounded)
        rank = F.when(whole, 2).when(overlap, 3).when(F.col("close"), 4)
        # With short words in the name the places say only where to look.
        unsure = F.col("phrase") & ~F.col("plain") & F.forall(ats, lambda at: F.size(at) > 0)
        return F.struct(rank.alias("rank"), F.coalesce(unsure, F.lit(False)).alias("unsure"))

    # A filter in front of the write would decide every row anew.
    open_ = open_.select("norm", "page_ord", let(ats, decide).alias("d")).select("norm", "page_ord", "d.rank", "d.unsure")
    open_ = store(open_, "text-ranks").filter("rank is not null or unsure")
    read = open_.filter("unsure").join(pages.select("page_ord", F.col("norm").alias("page")), "page_ord")
    read = read.withColumn("rank", F.when(whole_name(F.col("page"), F.col("norm"), cfg), 2).otherwise(F.col("rank")))
    out = [open_.filter("not unsure"), read.filter("rank is not null"), both.filter("not open").withColumn("rank", F.lit(4))]
    return out[0].select("norm", "page_ord", "rank").unionByName(out[1].select("norm", "page_ord", "rank")).unionByName(out[2].select("norm", "page_ord", "rank"))


def _hits_of_one_word(one: DataFrame, pages: DataFrame, index: DataFrame, vocabulary: DataFrame, cfg: MatchConfig, last_era: int) -> DataFrame:
    """Names of one word: only the whole name counts, and pages that hold its rarest token are read."""
    anchors = rarest_tokens(one, vocabulary).join(one.select("norm", "last_ord"), "norm")
    keys = store(anchors.select("norm", "last_ord", "token", F.explode(_reach(last_era)).alias("era")), "text-keys")
    wanted = index.select("token", "page_ord").join(keys.select("token").distinct(), "token", "left_semi").withColumn(
        "era", _era(F.shiftright("page_ord", 32))
    )
    pairs = (
        cell_join(keys, wanted, ["token", "era"], cfg.pairs_per_cell)
        .filter("last_ord is null or page_ord <= last_ord").select("norm", "page_ord").distinct()
    )
    read = pairs.join(pages.select("page_ord", F.col("norm").alias("page")), "page_ord")
    return read.filter(whole_name(F.col("page"), F.col("norm"), cfg)).select("norm", "page_ord", F.lit(2).alias("rank"))


# ---------------------------------------------------------------------------
# Links
# ---------------------------------------------------------------------------

def method_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in METHODS]), rank)


@dataclass
class Prepared:
    """What a run and the explanation of its misses have in common, all of it stored."""

    targets: DataFrame
    #: First copies of pages, their tokens with places, and the tokens' page counts.
    pages: DataFrame
    index: DataFrame
    vocabulary: DataFrame
    #: Distinct payees, and related surnames of targets and payees.
    payees: DataFrame
    surnames: DataFrame


def prepare_run(employees: DataFrame, prepared_pages: DataFrame, cfg: MatchConfig = MATCH) -> Prepared:
    """``prepared_pages`` is a stored table from ``prepare_pages``."""
    targets = store(prepare_targets(employees, cfg), "targets")
    pages = store(first_copies(prepared_pages), "pages")
    index = positional_index(pages)
    payees = store(payee_dictionary(payee_occurrences(pages), cfg), "payees")
    return Prepared(targets, pages, index, vocabulary_of(index), payees, related_surnames(targets, payees, cfg))


def link_candidates(run: Prepared, cfg: MatchConfig = MATCH) -> DataFrame:
    """(norm, page_ord, rank, score): per target every page that can still be its best page (J-1)."""
    targets, pages = run.targets, run.pages
    last_file = pages.agg(F.max("file_ord")).first()[0] or 0
    last_era = int(last_file + 1).bit_length() - 1
    hits = store(payee_hits(targets, run.payees, run.surnames, payee_occurrences(pages), cfg, last_era), "payee-hits")
    # A sure hit ends the search in front of its file's page; a weak one at the end of its file.
    file_start = F.shiftleft(F.shiftright("page_ord", 32), 32)
    limit = hits.groupBy("norm").agg(
        F.min(F.when(F.col("sure"), file_start - 1).otherwise(file_start + F.lit((1 << 32) - 1))).alias("last_ord")
    )
    text = text_hits(targets.join(limit, "norm", "left"), pages, run.index, run.vocabulary, cfg, last_era)
    scores = F.element_at(
        F.array(F.lit(1.0), F.lit(cfg.substring_score), F.lit(cfg.overlap_score), F.lit(cfg.proximity_score)), F.col("rank")
    )
    return hits.select("norm", "page_ord", F.lit(1).alias("rank"), "score").unionByName(
        text.select("norm", "page_ord", "rank", scores.alias("score"))
    )


def best_page(candidates: DataFrame) -> DataFrame:
    """W-2 then W-3: best method per page, then first file, highest score, earliest page."""
    per_page = candidates.groupBy("norm", "page_ord").agg(F.min(F.struct("rank", "score")).alias("m"))
    order = F.struct(
        F.shiftright("page_ord", 32).alias("file_ord"), (-F.col("m.score")).alias("cost"), F.col("page_ord"), F.col("m.rank")
    )
    best = per_page.groupBy("norm").agg(F.min(order).alias("b"))
    return best.select("norm", F.col("b.page_ord").alias("page_ord"), (-F.col("b.cost")).alias("score"), F.col("b.rank").alias("rank"))


def resolve_conflicts(links: DataFrame) -> DataFrame:
    """W-4: mark the best link of every page as accepted; losers stay in the table.

    The winner is found by an aggregate per page and flagged by employee, so a
    page claimed by very many employees never becomes one group.
    """
    winners = links.groupBy("page_ord").agg(
        F.min(F.struct((-F.col("score")).alias("cost"), F.col("emp_ord"))).alias("w")
    )
    won = winners.select(F.col("w.emp_ord").alias("emp_ord"), F.lit(True).alias("_won"))
    return links.join(won, "emp_ord", "left").withColumn("accepted", F.coalesce("_won", F.lit(False))).drop("_won")


def link(employees: DataFrame, prepared_pages: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """J-1 with W-2, W-3, W-4: every chosen link, losers of page conflicts included with ``accepted = false``."""
    return link_prepared(prepare_run(employees, prepared_pages, cfg), cfg)


def link_prepared(run: Prepared, cfg: MatchConfig = MATCH) -> DataFrame:
    best = best_page(link_candidates(run, cfg))
    targets = run.targets
    receipts = run.pages.select(
        "page_ord", F.col("file_name").alias("receipt_file"), "file_ord", F.col("page_no").alias("receipt_page")
    )
    links = (
        best.join(targets.select("norm", "emp_ord", "name", "slip_file", "slip_page"), "norm")
        .join(receipts, "page_ord")
        .withColumn("method", method_name(F.col("rank")))
    )
    return resolve_conflicts(links).select(
        "emp_ord", "name", "norm", "slip_file", "slip_page", "receipt_file", "file_ord", "receipt_page",
        "page_ord", "method", "score", "accepted",
    )


def first_page_with_name(pages: DataFrame, names: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """J-6: per given name (column ``name``) and file the first page where any method hits; files without a hit are left out."""
    norms = names.select("name", fold_name_ocr(F.col("name")).alias("norm"))
    targets = prepare_targets(norms.select("norm").distinct(), cfg)
    prepared = store(prepare_pages(pages), "search-pages")
    occurrences = payee_occurrences(prepared)
    payees = payee_dictionary(occurrences, cfg)
    bounded = store(targets.withColumn("bound", F.lit(None).cast("long")), "search-targets")
    last_era = int((prepared.agg(F.max("file_ord")).first()[0] or 0) + 1).bit_length() - 1
    same = bounded.join(payees.withColumnRenamed("payee", "norm"), "norm").select("norm", F.col("norm").alias("payee"))
    payees = store(payees, "search-payees")
    related = related_surnames(bounded, payees, cfg)
    # Of a payee only its first page in each file counts.
    pages_of = store(occurrences.groupBy("payee", "file_ord").agg(F.min("page_ord").alias("page_ord")), "payee-files")
    # Equal first names with agreeing last surnames are a hit whatever lies between: one page per class and file is enough.
    sure = cfg.ends_match_floor >= cfg.relaxed
    pairs = payee_pairs(bounded, payees, related, cfg, nearest=not sure, last_era=last_era).select("norm", "payee")
    by_payee = accepted_pairs(pairs.unionByName(same).distinct(), cfg).join(pages_of, "payee").select("norm", "page_ord")
    if sure:
        ends = payees.filter("size(s2) > 0").select("payee", F.col("f2").alias("f1"), F.element_at("s2", -1).alias("y"))
        classes = pages_of.join(ends, "payee").groupBy("f1", "y", "file_ord").agg(F.min("page_ord").alias("page_ord"))
        last = bounded.filter("size(s1) > 0").select("norm", "f1", F.element_at("s1", -1).alias("x"))
        agreeing = related.filter("agree and last_ok").select("x", "y")
        by_payee = by_payee.unionByName(last.join(agreeing, "x").join(classes, ["f1", "y"]).select("norm", "page_ord"))
    index = positional_index(prepared)
    by_text = text_hits(bounded.withColumn("last_ord", F.lit(None).cast("long")), prepared, index, vocabulary_of(index), cfg, last_era)
    hits = by_payee.unionByName(by_text.select("norm", "page_ord"))
    files = prepared.select("file_ord", "file_name").distinct()
    first = hits.groupBy("norm", F.shiftright("page_ord", 32).cast("int").alias("file_ord")).agg(F.min("page_ord").alias("page_ord"))
    return norms.join(first, "norm").join(files, "file_ord").select(
        "name", "file_name", "file_ord", F.col("page_ord").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("page_no")
    )


def methods_count(links: DataFrame) -> DataFrame:
    """A-3: accepted links per method."""
    return links.filter("accepted").groupBy("method").agg(F.count(F.lit(1)).alias("links"))


def confidence_tiers(links: DataFrame) -> DataFrame:
    """A-17: payee label high, whole name medium, the other methods low."""
    tier = F.when(F.col("method") == METHODS[0], "high").when(F.col("method") == METHODS[1], "medium").otherwise("low")
    return links.filter("accepted").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("links"))


def contested_pages(links: DataFrame) -> DataFrame:
    """A-10: pages chosen by several names, before conflicts are settled; one row per page and name."""
    n = links.groupBy("page_ord").agg(F.count(F.lit(1)).alias("n_names")).filter("n_names > 1")
    return links.join(n, "page_ord").select("receipt_file", "receipt_page", "n_names", "name", "score", "accepted")


def links_to_review(links: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """P-20: links with a low score, before conflicts are settled."""
    return links.filter(F.col("score") < cfg.review_below)


def page_invariant(links: DataFrame) -> DataFrame:
    """A-15: accepted links against the distinct pages they use."""
    per_page = links.filter("accepted").groupBy("page_ord").agg(F.count(F.lit(1)).alias("n"))
    return per_page.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count(F.lit(1)).alias("pages"),
        (F.coalesce(F.sum("n"), F.lit(0)) == F.count(F.lit(1))).alias("consistent"),
    )


def success_rate(links: DataFrame, employees: DataFrame) -> DataFrame:
    """A-8: accepted links per hundred employees, one decimal."""
    n = links.filter("accepted").agg(F.count(F.lit(1)).alias("links"))
    total = employees.agg(F.count(F.lit(1)).alias("employees"))
    rate = F.when(F.col("employees") > 0, F.round(100.0 * F.col("links") / F.col("employees"), 1)).otherwise(F.lit(0.0))
    return n.join(F.broadcast(total)).select("links", "employees", rate.alias("rate"))  # one row each
