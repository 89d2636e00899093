"""Building blocks that keep hot keys and long ordered groups distributed."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vinculo-"))
    return spark.sparkContext.getCheckpointDir()


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan with few splits to all cores, for costly work per row.

    A large table has more splits than cores and stays as it is. Only for plain
    scans: asking a plan with shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches need the same costly columns. Unlike a cache
    the table outlives lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vinculo/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for tables that grow with the input and are joined: they never go through the driver.

    The engine judges a stored table by its bytes on disk. Names and pairs of
    names take a tenth of their room in memory there, so a table of some
    megabytes would be collected and sent to every executor as hundreds.
    """
    return materialize(df, name).hint("merge")


def number_rows(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """Consecutive numbers from 1 in a total order, without a one-partition window.

    Rows are range-partitioned and sorted, each row stores its partition and
    its place in it, and the partition sizes (one row per partition, so at
    most as many as there are shuffle partitions) give the offsets.
    """
    place = F.monotonically_increasing_id()
    # Range partitioning samples its input first; a stored input is not computed twice for that.
    placed = (
        materialize(df, "unnumbered").repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    )
    placed = materialize(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_at") + 1)
        .drop("_part", "_at", "_base")
    )


def _row_blocks(df: DataFrame, part: list[str], order: str, blocks: int | None) -> DataFrame:
    """Cut the rows of all groups into ranges of about equal row counts; ``_block`` rises along a group's order.

    The ranges are cut from a sample of (part, order), so a group with sparse
    order values gets as many blocks as it has rows for, and rows of one order
    value share a block. Without a number of blocks there are as many as shuffle
    partitions, fewer for little data.
    """
    by = [*([] if blocks is None else [blocks]), *[F.col(c) for c in (*part, order)]]
    return df.repartitionByRange(*by).withColumn("_block", F.spark_partition_id())


def carry_forward(df: DataFrame, part: list[str], order: str, values: list[str], blocks: int | None = None) -> DataFrame:
    """Last non-NULL value so far, per ``part`` in ``order``, for every column of ``values``.

    One group may hold most of the data, so its rows are cut into blocks: the
    window runs inside a block, and the value a block starts with comes from a
    second window over one row per block. Blocks are cut by rows, and stored
    with what is known inside them, since another run may cut elsewhere.
    """
    inside = Window.partitionBy(*part, "_block").orderBy(order)
    within = materialize(_row_blocks(df, part, order, blocks).withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values}), "carried")
    ends = within.groupBy(*part, "_block").agg(*[F.max_by(v, order).alias(f"_end_{v}") for v in values])
    earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        *part, "_block", *[F.last(f"_end_{v}", ignorenulls=True).over(earlier).alias(f"_start_{v}") for v in values]
    )
    joined = _null_safe_join(within, starts, [*part, "_block"])
    return joined.withColumns({v: F.coalesce(F.col(v), F.col(f"_start_{v}")) for v in values}).drop(
        "_block", *[f"_start_{v}" for v in values]
    )


def running_offset(df: DataFrame, part: list[str], order: str, size: str, name: str, blocks: int | None = None) -> DataFrame:
    """Sum of ``size`` over all earlier rows of ``part``; in blocks like ``carry_forward``."""
    inside = Window.partitionBy(*part, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = materialize(_row_blocks(df, part, order, blocks).withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0))), "offsets")
    totals = within.groupBy(*part, "_block").agg(F.sum(size).alias("_total"))
    earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*part, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    joined = _null_safe_join(within, bases, [*part, "_block"])
    return joined.withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


def rank_slice(df: DataFrame, order: list[str], first: int, size: int, rows: int = 1 << 16, ranges: int = 64) -> DataFrame:
    """Rows ``first`` to ``first + size - 1`` (from 0) in the ascending order of columns, without sorting the others.

    Keys of a sample bound ranges whose rows are counted exactly; only the
    ranges that hold the wanted ranks go on, until few rows are left to sort.
    Each round reads the table twice and keeps nothing. Rows that all have one
    key can't be told apart by ranges; they are numbered instead.
    """
    key = F.struct(*order)
    open_ = df
    while (n := open_.count()) > rows:
        spaced = open_.select(key.alias("k")).sample(min(1.0, 32 * ranges / n), seed=n).orderBy("k").collect()
        bounds = list(dict.fromkeys(r.k for r in spaced[:: max(1, len(spaced) // ranges)]))
        at = F.lit(0)
        for bound in bounds:
            literal = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, bound, strict=True)])
            at = at + (key > literal).cast("int")
        counts = dict(open_.groupBy(at.alias("at")).count().collect())
        begin, chosen, skipped = 0, [], 0
        for k in sorted(counts):
            if begin + counts[k] > first and begin < first + size:
                chosen.append(k)
            elif begin + counts[k] <= first:
                skipped += counts[k]
            begin += counts[k]
        if not chosen or sum(counts[k] for k in chosen) == n:
            numbered = number_rows(open_, *[F.col(c) for c in order], name="_place")
            return numbered.filter(F.col("_place").between(first + 1, first + size)).drop("_place")
        open_ = open_.filter(at.between(chosen[0], chosen[-1]))
        first -= skipped
    return open_.orderBy(*order).offset(max(first, 0)).limit(size)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(right[f"_k_{k}"])
        cond = term if cond is None else cond & term
    return left.join(right, cond, "left").drop(*[f"_k_{k}" for k in keys])


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], pairs_per_cell: int, dealt: bool = False) -> DataFrame:
    """Inner equi join whose hot keys are cut into cells of at most about ``pairs_per_cell`` pairs.

    The engine splits skewed partitions by bytes; a key with short rows on both
    sides can still make far too many pairs for one task. Both sides of such a
    key are dealt into chunks, each left chunk meets each right chunk under its
    own cell key, and every pair still occurs exactly once. With ``dealt`` both
    sides are shuffled once, as the hot keys (one for ``pairs_per_cell`` pairs at
    most) are sent to them, and the cells stay on all tasks of a shuffle: the
    engine puts few bytes into one task, however many pairs they make.
    """
    side = max(int(math.sqrt(pairs_per_cell)), 1)
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    hot = (
        n_left.join(n_right, keys)
        .filter(F.col("_nl").cast("double") * F.col("_nr") > pairs_per_cell)
        .select(
            *keys,
            F.ceil(F.col("_nl") / side).cast("int").alias("_cl"),
            F.ceil(F.col("_nr") / side).cast("int").alias("_cr"),
        )
    )

    hot = F.broadcast(hot) if dealt else hot

    def chunked(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(F.col(own_n), F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1)
        return (
            df.join(hot, keys, "left")
            .withColumn(own, spread.cast("int"))
            .withColumn(other, F.explode(copies))
            .drop("_cl", "_cr")
        )

    cells = chunked(left, "_a", "_cl", "_b", "_cr"), chunked(right, "_b", "_cr", "_a", "_cl")
    if dealt:
        spark = left.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        cells = [side.repartition(tasks, *keys, "_a", "_b").hint("merge") for side in cells]
    return cells[0].join(cells[1], [*keys, "_a", "_b"]).drop("_a", "_b")
