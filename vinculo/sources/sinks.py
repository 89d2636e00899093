"""History rows, exports and output manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MISSES_CSV_HEADER, MONTH_NAMES


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def upload_history_row(stats: DataFrame, file_name: Column, uploaded_at: Column) -> DataFrame:
    """IO-11. The history row of one import from its one-row statistics."""
    return stats.select(
        F.sha2(F.concat_ws("|", file_name, uploaded_at.cast("string")), 256).alias("id"),
        file_name.alias("file_name"), uploaded_at.alias("uploaded_at"),
        F.col("empresas").cast("int").alias("total_empresas"),
        F.col("municipios").cast("int").alias("total_municipios"),
        F.col("total").cast("int").alias("total_funcionarios"),
        F.col("novos").cast("int").alias("funcionarios_novos"),
        F.col("atualizados").cast("int").alias("funcionarios_atualizados"),
        F.col("removidos").cast("int").alias("funcionarios_removidos"),
    )


def run_id(user_id: Column, finished_at: Column) -> Column:
    return F.sha2(F.concat_ws("|", user_id, finished_at.cast("string")), 256)


def run_history_row(misses: DataFrame, pdf_count: int, duration_ms: int, finished_at: Column, user_id: Column) -> DataFrame:
    """IO-12. The one history row of a run, whatever the number of its misses."""
    month = F.month(finished_at)
    return misses.agg(F.count(F.lit(1)).cast("int").alias("misses")).select(
        run_id(user_id, finished_at).alias("id"), user_id.alias("user_id"), finished_at.alias("created_at"),
        F.lit(pdf_count).alias("pdf_count"), F.round(F.lit(duration_ms) / 1000).cast("int").alias("duration_seconds"),
        month.alias("month"), F.year(finished_at).alias("year"),
        F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month).alias("month_name"),
        "misses", F.lit(None).cast("string").alias("unprocessed_data"),
    )


def run_miss_rows(misses: DataFrame, finished_at: Column, user_id: Column) -> DataFrame:
    """IO-12. The misses of a run as rows of the miss table, in report order by ``index``."""
    return misses.select(
        run_id(user_id, finished_at).alias("run_id"), "index", "name", "reason", F.col("closest_candidate").alias("closestCandidate"),
        F.col("found_in_full_text").alias("foundInFullText"), F.col("found_as_payee").alias("foundAsFavorecido"),
    )


def misses_json(rows: DataFrame) -> DataFrame:
    """(run_id, index, json): one JSON object per miss row, for export as JSON lines."""
    fields = [c for c in rows.columns if c not in ("run_id", "index")]
    return rows.select("run_id", "index", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def misses_for_export(misses: DataFrame) -> DataFrame:
    """IO-13 columns: fixed header, booleans as SIM / NÃO."""
    yes = lambda c: F.when(F.col(c), "SIM").otherwise("NÃO")
    values = (
        F.col("name"), F.col("normalized"), F.col("source_file"), F.col("source_page"),
        yes("found_in_full_text"), yes("found_as_payee"), F.col("closest_candidate"), F.col("reason"),
    )
    return misses.select(*[v.alias(h) for v, h in zip(values, MISSES_CSV_HEADER)])


def export_misses(misses: DataFrame, path: str) -> None:
    """IO-13. CSV with inner quotes doubled."""
    misses_for_export(misses).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """IO-14. The output set of a run, by year and month."""
    append(manifest, path, "year", "month")
