"""From a finished link run to its stored outputs: enrichment, manifest, history and misses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import enrich
from ..operators.scale import materialize
from ..sources import sinks
from .link_run import LinkRun


def outputs(links: DataFrame, records: DataFrame | None, active: DataFrame, run_at: Column) -> tuple[DataFrame, DataFrame]:
    """(manifest, run name) of the accepted links."""
    accepted = links.filter("accepted").withColumn("link_ord", F.struct("file_ord", "emp_ord"))
    enriched = materialize(enrich.enrich_links(accepted, records, active), "enriched")
    return enrich.manifest(enriched, run_at), enrich.archive_name(enriched, run_at)


@dataclass(frozen=True)
class Published:
    """Folders of what a run has written."""

    manifest: str
    history: str
    misses: str
    run_name: str | None


def publish(
    run: LinkRun, records: DataFrame | None, active: DataFrame, run_at: Column, user_id: Column, duration_ms: int, folder: str
) -> Published:
    """J-7, J-9, W-10, A-11, IO-12, IO-14: write the manifest, the history row and the misses of a run below ``folder``."""
    out = Published(f"{folder}/manifest", f"{folder}/processing_history", f"{folder}/run_misses", None)
    manifest, name = outputs(run.links, records, active, run_at)
    sinks.write_manifest(manifest, out.manifest)
    written = run.links.sparkSession.read.schema(manifest.schema).parquet(out.manifest)
    report = materialize(run.misses(), "miss-report")
    sinks.append(sinks.run_history_row(report, written.count(), duration_ms, run_at, user_id), out.history)
    sinks.append(sinks.run_miss_rows(report, run_at, user_id), out.misses)
    return Published(out.manifest, out.history, out.misses, name.first()["run_name"])
