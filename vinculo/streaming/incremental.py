"""Long-running jobs as Structured Streaming queries.

Each batch writes under its own id and becomes valid by its manifest, so a batch
that is repeated after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.extract import employee_names
from ..functions.fold import fold_name_ocr
from ..operators import merge
from ..operators.linkage import first_seen
from ..operators.scale import materialize
from ..sources.pages import best_versions
from ..sources.schemas import REGISTRY, struct
from .buckets import BUCKETS, BucketTable, bucket_of

REGISTERED = ("empresas", "municipios", "funcionarios", "funcionarios_salario")


def _schema(table: str) -> StructType:
    return struct(REGISTRY[table])


def current_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A bucketed table as the last batch left it."""
    return BucketTable(spark, path, schema).read().select(*schema.fieldNames())


def _buckets_in(rows: DataFrame) -> list[int]:
    """Buckets that occur, of a fixed number."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def extract_slips(pages: DataFrame) -> DataFrame:
    """Slip entries of a (streaming) page table."""
    named = pages.select("file_id", "file_ord", "page_no", "started_at", employee_names(F.col("text")).alias("name"))
    return named.withColumn("norm", fold_name_ocr(F.col("name")))


def resume_extraction(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """T-1. Extract all pages not yet seen; started again with the same checkpoint it goes on where it stopped.

    The pages of a batch are dealt to all cores: a batch may have one split, and a page costs much more to search than to move.
    """
    tasks = 2 * pages.sparkSession.sparkContext.defaultParallelism
    return append_stream(extract_slips(pages.repartition(tasks)), out, checkpoint)


def first_seen_stream(entries: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """T-2. Keep the first entry of every name over the whole run, in whatever order files arrive.

    ``entries(norm, entry_ord, …)``. Names are kept in buckets by hash; a batch
    reads and rewrites the buckets of its names only. ``current_rows`` reads the result.
    """
    schema = entries.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = first_seen(batch, "norm", "entry_ord").select(*schema.fieldNames()).withColumn("bucket", bucket_of("norm", buckets))
        fresh = materialize(fresh, "first-seen")
        if touched := _buckets_in(fresh):
            held = BucketTable(batch.sparkSession, out, schema)
            both = fresh.unionByName(held.read(touched, batch_id))
            held.write(first_seen(both, "norm", "entry_ord").withColumn("bucket", bucket_of("norm", buckets)), batch_id)

    return (
        entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def close_idle_runs(states: DataFrame, run: str = "run_id", at: str = "started_at", hours: int = 24, late: str = "1 hour") -> DataFrame:
    """T-3 as a stream: (run, first_at, last_at, saves, closed_at) of every run with no saved state for ``hours``.

    A run's states form a session that each further state extends; it is closed
    and forgotten once the watermark, ``late`` behind the newest state, has
    passed its end. States of closed sessions that come later than that are
    dropped, so what is held is what is still open.
    """
    session = F.session_window(at, f"{hours} hours")
    held = states.withWatermark(at, late).groupBy(run, session.alias("session"))
    out = held.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("saves"))
    return out.select(run, "first_at", "last_at", "saves", F.col("session.end").alias("closed_at"))


def arriving_versions(versions: DataFrame, at: str = "at", wait: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """IO-6 as a stream: one text per page from its native, OCR and retry versions, in whatever order they come.

    A page is settled when no version of it has come for ``wait``; a version
    that never comes is left out, and one that comes after that is dropped or,
    within ``late``, settles its page once more.
    """
    return best_versions(versions.withWatermark(at, late), by=[F.session_window(at, wait).alias("session")])


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there, and append what it settles to ``out``."""
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
        .outputMode("append").trigger(availableNow=True).start()
    )


def drop_stale(states: DataFrame, now, hours: int = 24) -> DataFrame:
    """T-3. Saved run states not older than the limit."""
    return states.filter(F.unix_micros("started_at") >= F.unix_micros(now) - F.lit(hours * 3600 * 1_000_000))


def merge_uploads(uploads: DataFrame, folder: str, checkpoint: str, now: Column, buckets: int = BUCKETS) -> StreamingQuery:
    """T-4. Merge arriving rosters (employee records) into the registry in ``folder``, one batch after the other.

    A batch is one upload (limit the source with ``maxFilesPerTrigger``) and runs
    J-14 to J-16. Employees and salaries are bucketed by city, companies and
    cities by id, and only buckets with rows of the upload are written. A batch
    that is repeated after a failure reads what was there before it and replaces
    its own output.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        records = materialize(batch, "upload")
        if records.isEmpty():
            return
        held = {name: BucketTable(batch.sparkSession, f"{folder}/{name}", _schema(name)) for name in REGISTERED}
        dimensions = {}
        for name, column in (("empresas", "empresa"), ("municipios", "cidade")):
            known = materialize(held[name].read(before=batch_id), name)
            table, ids = merge.upsert_dimension(known.drop("bucket"), records.select(F.col(column).alias("nome"), "row_ord"), now)
            dimensions[name] = materialize(ids, f"{name}-ids")
            added = table.join(known.select("id"), "id", "left_anti")
            columns = [F.col(f.name) if f.name in added.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _schema(name).fields]
            added = materialize(added.select(*columns, bucket_of("id", buckets).alias("bucket")), f"{name}-added")
            if touched := _buckets_in(added):
                held[name].write(added.unionByName(known.filter(F.col("bucket").isin(touched))), batch_id)
        keyed = materialize(merge.keyed_records(records, dimensions["empresas"], dimensions["municipios"]), "keyed-records")
        touched = _buckets_in(dimensions["municipios"].select(bucket_of("id", buckets).alias("bucket")))
        employees, salaries = (held[name].read(touched, batch_id).drop("bucket") for name in REGISTERED[2:])
        merged = materialize(merge.merge_employees(employees, keyed, dimensions["municipios"], now), "merged")
        merged = merged.withColumn("bucket", bucket_of("municipio_id", buckets))
        paid = merge.upsert_salaries(salaries, keyed, merged.drop("bucket")).join(merged.select(F.col("id").alias("funcionario_id"), "bucket"), "funcionario_id")
        held["funcionarios"].write(merged, batch_id)
        held["funcionarios_salario"].write(paid, batch_id)

    return (
        uploads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def registry_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The registry as the last batch of ``merge_uploads`` left it."""
    return {name: current_rows(spark, f"{folder}/{name}", _schema(name)) for name in REGISTERED}
