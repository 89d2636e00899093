"""Bucketed tables of streams, and streams that settle by event time."""

import glob
import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from vinculo.operators.linkage import employees_from_slips
from vinculo.operators.scale import shared_folder
from vinculo.plans.registered import QUERIES
from vinculo.streaming import incremental
from vinculo.streaming.buckets import BucketTable, bucket_of

SCHEMA = StructType().add("k", "long").add("v", "long")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA).withColumn("bucket", bucket_of("k", 4))


def held(table, before=None):
    return sorted((r.k, r.v) for r in table.read(before=before).collect())


def test_bucket_table_survives_dead_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, SCHEMA)
    assert held(table) == []
    table.write(rows(spark, [(k, 0) for k in range(20)]), 0)
    one = [k for k in range(20) if k in {r.k for r in rows(spark, [(k, 0) for k in range(20)]).filter("bucket = 1").collect()}]
    table.write(rows(spark, [(k, 1) for k in one]), 1)
    want = sorted((k, 1 if k in one else 0) for k in range(20))
    assert held(table) == want and held(table, before=1) == [(k, 0) for k in range(20)]
    # A batch that died after its data has no manifest; a draft of one is not read.
    rows(spark, [(k, 9) for k in one]).write.partitionBy("bucket").parquet(f"{path}/data/batch=2")
    with open(f"{path}/manifests/_draft-2-x", "w") as f:
        f.write('{"1": 2')
    assert held(table) == want
    # The repeated batch reads what was there before it and replaces its own files.
    for value in (2, 3):
        assert held(table, before=2) == want
        table.write(rows(spark, [(k, value) for k in one]), 2)
        assert held(table) == sorted((k, value if k in one else 0) for k in range(20))


def test_old_versions_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, SCHEMA, keep=1)
    table.write(rows(spark, [(k, -1) for k in range(12)]), 0)
    moved = [r.k for r in rows(spark, [(k, 0) for k in range(12)]).filter("bucket = 0").collect()]
    for batch in range(1, 12):
        table.write(rows(spark, [(k, batch) for k in moved]), batch)
    assert held(table) == sorted((k, 11 if k in moved else -1) for k in range(12))
    assert sorted(x for x in os.listdir(f"{path}/manifests") if not x.startswith(".")) == ["batch=10.json", "batch=11.json"]
    # Batch 0 keeps the buckets that nothing replaced; of the others the last two versions stay.
    assert sorted(x for x in os.listdir(f"{path}/data") if not x.startswith(".")) == ["batch=0", "batch=10", "batch=11"]
    assert "bucket=0" not in os.listdir(f"{path}/data/batch=0")


def run(spark, tmp_path, drops, schema, settle):
    """What a stream settles after each drop of rows."""
    out, seen = str(tmp_path / "out"), []
    for k, drop in enumerate(drops):
        spark.createDataFrame(drop, schema).select(*[F.col(c) for c in schema.replace(",", "").split()[::2]]).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={k}"))
        stream = settle(spark.readStream.schema(spark.createDataFrame(drop, schema).schema).parquet(str(tmp_path / "in" / "*")))
        query = incremental.append_stream(stream, out, str(tmp_path / "cp"))
        query.awaitTermination()
        now = spark.read.schema(stream.schema).parquet(out).collect() if os.path.exists(out) else []
        seen.append(now)
    return seen


def at(hour):
    import datetime

    return datetime.datetime(2026, 3, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hour)


def test_idle_runs_close_once(spark, tmp_path):
    drops = [
        [("a", at(0)), ("b", at(1)), ("a", at(20))],
        [("c", at(50)), ("b", at(30))],   # b comes back after its session's end, but the first one is still held
        [("a", at(2)), ("d", at(120))],   # a's state is too late
        [("e", at(200))],
    ]
    seen = run(spark, tmp_path, drops, "run_id string, started_at timestamp", lambda s: incremental.close_idle_runs(s, hours=24))
    told = [sorted((r.run_id, r.saves) for r in rows_) for rows_ in seen]
    assert told[0] == []
    assert told[1] == [("a", 2), ("b", 1)]
    assert told[2] == [("a", 2), ("b", 1), ("b", 1), ("c", 1)]
    assert told[3] == [("a", 2), ("b", 1), ("b", 1), ("c", 1), ("d", 1)]
    assert {r.run_id: r.closed_at.replace(tzinfo=None) for r in seen[1]}["a"] == at(44).replace(tzinfo=None)


def test_versions_that_are_late_missing_or_retried(spark, tmp_path):
    long, minute = "x" * 120, 1 / 60
    drops = [
        [("f", 1, "native", long, False, at(0)), ("f", 2, "native", "", False, at(0)), ("f", 3, "native", "", False, at(0)), ("f", 4, "native", "", False, at(0))],
        [("f", 2, "ocr", "short", False, at(10 * minute)), ("f", 3, "ocr", "o" * 50, False, at(5 * minute))],
        [("f", 2, "retry", "a longer text of the retry", False, at(20 * minute)), ("f", 1, "ocr", "late but harmless", False, at(20 * minute))],
        [("g", 1, "native", long, False, at(3))],
        [("f", 4, "ocr", "far too late", False, at(25 * minute)), ("g", 2, "native", long, False, at(9))],
    ]
    seen = run(spark, tmp_path, drops, "file_id string, page_no int, stage string, text string, timed_out boolean, at timestamp", incremental.arriving_versions)
    assert [len(x) for x in seen[:3]] == [0, 0, 0]
    assert sorted((r.file_id, r.page_no, r.text) for r in seen[3]) == [("f", 1, long), ("f", 2, "a longer text of the retry"), ("f", 3, "o" * 50), ("f", 4, "[Empty page 4]")]
    assert sorted((r.file_id, r.page_no) for r in seen[4]) == [("f", 1), ("f", 2), ("f", 3), ("f", 4), ("g", 1)]


def slips(spark, numbers):
    """One page per number, with a name of its own, or none for every fourth."""
    word = "".join(f"substr('ABCDEFGHIJ', n DIV {k} % 10 + 1, 1), " for k in (100, 10, 1))
    pages = spark.createDataFrame([(n,) for n in numbers], "n int").withColumn("name", F.expr(f"concat('Maria ', {word}'KER')"))
    text = F.when(F.col("n") % 4 == 0, F.lit("12/05, 10.")).otherwise(F.concat(F.lit("Nome do Funcionário: "), "name", F.lit(" CPF: 1")))
    return pages.select(F.lit("f").alias("file_id"), F.lit(1).alias("file_ord"), F.col("n").alias("page_no"), F.lit(at(0)).alias("started_at"), text.alias("text"))


def test_pages_are_searched_once(spark):
    table = spark.createDataFrame([("f", 1, 1, at(0), "x")], slips(spark, [1]).schema)
    plan = incremental.extract_slips(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FAVORECIDO *:?") == 1
    plan = employees_from_slips(table.withColumn("file_name", F.lit("f")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FAVORECIDO *:?") == 1


def test_extraction_deals_a_file_to_all_cores_and_goes_on(spark, tmp_path):
    out = str(tmp_path / "out")

    def run(k, numbers):
        slips(spark, numbers).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={k}"))
        stream = spark.readStream.schema(slips(spark, [1]).schema).parquet(str(tmp_path / "in" / "*"))
        incremental.resume_extraction(stream, out, str(tmp_path / "cp")).awaitTermination()
        found = spark.read.schema(incremental.extract_slips(stream).schema).parquet(out)
        return sorted((r.page_no, r.norm) for r in found.collect()), found.select(F.input_file_name()).distinct().count()

    def want(numbers):
        return [(n, "MARIA " + "".join("ABCDEFGHIJ"[int(x)] for x in f"{n:03}") + "KER") for n in numbers if n % 4]

    rows_, files = run(0, range(400))
    assert rows_ == want(range(400)) and files >= spark.sparkContext.defaultParallelism
    assert run(1, range(400, 410))[0] == want(range(410))


def test_extraction_takes_a_file_for_every_core_in_a_batch(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    docs = slips(spark, range(60)).select(F.col("page_no").cast("long").alias("doc_id"), "text", F.lit("pt").alias("lang"), F.lit("src7").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.repartition(cores + 1).write.parquet(str(tmp_path / "documents.parquet"))
    told = set(glob.glob(f"{shared_folder(spark)}/vinculo/stream-*"))
    assert QUERIES["stream_extraction"](spark, str(tmp_path)).select("page_no").distinct().count() == 45
    (folder,) = set(glob.glob(f"{shared_folder(spark)}/vinculo/stream-*")) - told
    assert len(glob.glob(f"{folder}/checkpoint/commits/[0-9]*")) == 2
