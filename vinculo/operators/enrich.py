"""Company, city and contract of links, from the roster first and the registry second; output manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_name, fold_name_ocr, words
from ..functions.present import month_name, output_name, run_name

ROSTER_FIELDS = ("empresa", "cidade", "contrato")


def roster_lookup(names: DataFrame, records: DataFrame, fields: tuple[str, ...] = ROSTER_FIELDS) -> DataFrame:
    """J-7. ``names(name)`` with the roster fields of their record, NULL when there is none.

    The first record of the same fold wins; without one, the only record with the
    same first and last word. Both rosters are reduced to one row per key before
    they are joined, and keys are joined once per distinct fold.
    """
    rec = F.struct(*fields)
    roster = records.select("row_ord", rec.alias("rec"), fold_name(F.col("colaborador")).alias("norm"))
    exact = roster.groupBy("norm").agg(F.min_by("rec", "row_ord").alias("by_name"))
    w = words(F.col("norm"), 2)
    ends = (
        roster.filter(F.size(w) >= 2)
        .groupBy(F.get(w, F.lit(0)).alias("a"), F.element_at(w, -1).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("rec", "row_ord").alias("by_ends"))
        .filter("n = 1").drop("n")
    )
    norms = names.select("name").distinct().withColumn("norm", fold_name(F.col("name")))
    keyed = norms.select("norm").distinct().select(
        "norm", F.try_element_at(w, F.lit(1)).alias("a"), F.try_element_at(w, F.lit(-1)).alias("b")
    )
    found = keyed.join(exact, "norm", "left").join(ends, ["a", "b"], "left").select(
        "norm", F.when(F.col("a").isNotNull(), F.coalesce("by_name", "by_ends")).alias("rec")
    )
    # Back to names as given: distinct names may share a fold, never many of them.
    return norms.join(found, "norm").select("name", *[F.col(f"rec.{f}").alias(f) for f in fields])


def roster_company_and_city(names: DataFrame, records: DataFrame) -> DataFrame:
    """J-8."""
    return roster_lookup(names, records, ("empresa", "cidade"))


def registry_candidates(active: DataFrame) -> DataFrame:
    """A-16 counted: (norm, n, fields of one candidate) of active employees with company and city names."""
    return active.groupBy(F.col("nome_normalizado").alias("norm")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in ROSTER_FIELDS])).alias("c")
    )


def registry_fallback(links: DataFrame, active: DataFrame) -> DataFrame:
    """J-9. Fill blank fields from the registry where the name has exactly one active candidate."""
    one = registry_candidates(active).filter("n = 1").select("norm", "c")
    keyed = links.withColumn("norm", fold_name_ocr(F.col("name")))
    filled = keyed.join(one, "norm", "left")
    return filled.withColumns(
        {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"c.{f}"), F.lit(""))) for f in ROSTER_FIELDS}
    ).drop("c", "norm")


def enrich_links(links: DataFrame, records: DataFrame | None, active: DataFrame) -> DataFrame:
    """Links with company, city and contract."""
    if records is None:
        out = links.withColumns({f: F.lit(None).cast("string") for f in ROSTER_FIELDS})
    else:
        out = links.join(roster_lookup(links.select("name"), records), "name", "left")
    return registry_fallback(out, active)


def manifest(enriched: DataFrame, run_at: Column) -> DataFrame:
    """IO-14 rows, W-10: one output file per name, the last link of a name wins, ``collisions`` counts the others.

    ``link_ord`` orders links; all links still count as produced documents.
    """
    named = enriched.withColumn(
        "out_file", output_name(F.col("empresa"), F.col("cidade"), F.col("contrato"), F.col("name"))
    )
    keep = ["name", *ROSTER_FIELDS, "link_ord"]
    out = named.groupBy("out_file").agg(
        F.max_by(F.struct(*keep), "link_ord").alias("k"), (F.count(F.lit(1)) - 1).alias("collisions")
    )
    return out.select(
        "out_file", *[F.col(f"k.{c}").alias(c) for c in keep], "collisions",
        F.year(run_at).alias("year"), F.month(run_at).alias("month"), month_name(F.month(run_at)).alias("month_name"),
    )


def modal_company(links: DataFrame, company: str = "empresa", order: str = "link_ord") -> DataFrame:
    """A-11. The company of most links; on ties the one seen first."""
    counts = links.filter(F.col(company) != "").groupBy(company).agg(
        F.count(F.lit(1)).alias("links"), F.min(order).alias("first_ord")
    )
    return counts.orderBy(F.desc("links"), "first_ord").limit(1)


def archive_name(links: DataFrame, run_at: Column) -> DataFrame:
    """The run name, from the modal company where there is one."""
    top = links.sparkSession.range(1).join(modal_company(links), how="left", on=F.lit(True))
    return top.select(run_name(F.col("empresa"), month_name(F.month(run_at)), F.year(run_at)).alias("run_name"))
