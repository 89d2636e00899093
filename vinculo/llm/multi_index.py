"""Hard negatives for anchors by an inverted multi-index over integer vectors.

Each half of a vector is given to the nearest word of that half's codebook, and
the two words form its cell. Codebooks are fitted on a bounded, deterministic
sample; all rows are in the index. A directory keeps, for every occupied cell, its
rows and, for each half, the largest distance to the word: at most
``words`` x ``words`` entries.

With q = (q1, q2) and a cell (i, j), every row's score is at most
(q1.c1[i] + |q1| r1) + (q2.c2[j] + |q2| r2). A heap walks the two lists of half
bounds (with the largest radius of each word) in falling order of their sums, so
cells come best bound first, and the walk stops for good at the first sum below
what is still of use. The cell's own radii then rule out single cells. The radii
make the result exact: codebooks only decide how early the walk can stop.

Searches run in two steps, each a join of (shard, block of anchors) with the cells
stored there. The first takes the best cells up to a number of rows and so gives
lower bounds; the second takes all others that can still hold a result, which
certifies it: first the positives, then for each positive the window of scores
its negatives lie in.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculo.llm.common import column, map_batches, materialize


@dataclass(frozen=True)
class MineRules:
    scale: int = 256
    anchor_every: int = 100
    positives: int = 5
    negatives: int = 5
    #: A negative's score is from low % of its positive's to all of it.
    low_percent: int = 80
    #: Most rows of the sample behind the codebooks, most words of a codebook, rows a cell should have.
    sample: int = 4096
    words: int = 256
    cell_rows: int = 64
    #: Rows of a shard, anchors of a block, rows that the first step looks at for each anchor.
    shard: int = 4096
    block: int = 2048
    first_rows: int = 512


def labelled(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, x) of the rows that take part, stored: x = floor(scale * component), ``row`` is unique."""
    wide = F.transform(F.col(embedding), lambda v: v.cast("double"))
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), wide.alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0)).filter(F.coalesce(sound, F.lit(False)))
    x = F.transform("e", lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", x.alias("x")), "labelled")


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _away(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * (x @ words.T)
    return np.sqrt(np.maximum(square, 0))


def codebook(x: np.ndarray, words: int, turns: int = 8) -> np.ndarray:
    """Words of one half: means of the nearest rows, started from rows spread over the sample."""
    found = np.unique(x, axis=0)
    found = found[np.linspace(0, len(found) - 1, min(words, len(found))).astype(int)].astype(float)
    for _ in range(turns):
        nearest = _away(x, found).argmin(1)
        total = np.zeros_like(found)
        np.add.at(total, nearest, x)
        count = np.bincount(nearest, minlength=len(found))
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


@dataclass(frozen=True)
class Directory:
    """Codebooks and, in the order of cells, which cells there are and where: all of bounded size."""

    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray
    rows: np.ndarray
    radii: np.ndarray
    first_shard: np.ndarray
    parts: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return x[..., :cut], x[..., cut:]

    def cells_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distances to its two words for each row."""
        away = [_away(h, b) for h, b in zip(self.halves(x), self.books, strict=True)]
        near = [d.argmin(1) for d in away]
        each = np.arange(len(x))
        return near[0] * len(self.books[1]) + near[1], np.stack([d[each, k] for d, k in zip(away, near, strict=True)], axis=1)

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """(bound of all cells still to come, place in the directory, the cell's own upper and lower bound), best first."""
        n2 = len(self.books[1])
        places = np.full(len(self.books[0]) * n2, -1)
        places[self.cells] = np.arange(len(self.cells))
        norms, dots, lists = [], [], []
        for half, (h, book) in enumerate(zip(self.halves(q), self.books, strict=True)):
            word = self.cells // n2 if half == 0 else self.cells % n2
            widest = np.full(len(book), -1.0)
            np.maximum.at(widest, word, self.radii[:, half])
            dot, norm = book @ h, math.sqrt(float(h @ h))
            used = np.flatnonzero(widest >= 0)
            bounds = dot[used] + norm * widest[used]
            order = np.argsort(-bounds, kind="stable")
            lists.append((bounds[order], used[order]))
            norms.append(norm)
            dots.append(dot)
        (b1, w1), (b2, w2) = lists
        slack = 1e-6 * (1 + abs(float(b1[0])) + abs(float(b2[0])) + norms[0] + norms[1])
        # Multi-sequence: (a, b) is pushed when (a - 1, b) and (a, b - 1) have been taken.
        heap, taken = [(-(b1[0] + b2[0]), 0, 0)], np.zeros(len(b1), int)
        while heap:
            total, a, b = heapq.heappop(heap)
            taken[a] = b + 1
            if a + 1 < len(b1) and (b == 0 or taken[a + 1] == b):
                heapq.heappush(heap, (-(b1[a + 1] + b2[b]), a + 1, b))
            if b + 1 < len(b2) and (a == 0 or taken[a - 1] >= b + 2):
                heapq.heappush(heap, (-(b1[a] + b2[b + 1]), a, b + 1))
            place = places[w1[a] * n2 + w2[b]]
            if place >= 0:
                middle = dots[0][w1[a]] + dots[1][w2[b]]
                wide = norms[0] * self.radii[place, 0] + norms[1] * self.radii[place, 1]
                yield -total + slack, int(place), middle + wide + slack, middle - wide - slack


@dataclass
class MultiIndex:
    directory: Directory
    cells: DataFrame
    dim: int
    rules: MineRules


_CELLS = "shard long, place int, rows binary, ids binary, labels binary, vectors binary"


def build_index(rows: DataFrame, dim: int, rules: MineRules = MineRules()) -> MultiIndex:
    """The index over stored rows (row, vec_id, label, x), all of dimension ``dim``."""
    some = rows.select("x", "row").orderBy(F.xxhash64("row"), "row").limit(rules.sample).select("x").toArrow()
    sample = _matrix(some.column("x"), dim)
    words = max(1, min(rules.words, math.isqrt(rows.count() // rules.cell_rows)))
    cut = (dim + 1) // 2
    none = np.zeros(0, int)
    books = Directory((codebook(sample[:, :cut], words), codebook(sample[:, cut:], words)), none, none, np.zeros((0, 2)), none, none)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, away = books.cells_of(_matrix(column(batch, "x"), dim))
                for name, values in (("cell", cell), ("away_1", away[:, 0]), ("away_2", away[:, 1])):
                    batch = batch.append_column(name, pa.array(values))
                yield batch

    given = materialize(map_batches(rows.select("row", "vec_id", "label", "x"), assign, "row long, vec_id long, label long, x array<long>, cell long, away_1 double, away_2 double"), "cell-rows")
    found = given.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away_1").alias("r1"), F.max("away_2").alias("r2")).orderBy("cell").toPandas()
    n = found["n"].to_numpy()
    # Whole cells share a shard up to its size; a cell of more rows is dealt over shards of its own.
    parts, shard, filled, first = np.maximum(1, -(-n // rules.shard)), 0, 0, []
    for size, part in zip(n.tolist(), parts.tolist(), strict=True):
        if filled and filled + size > rules.shard:
            shard, filled = shard + 1, 0
        first.append(shard)
        filled += size
        if part > 1:
            shard, filled = shard + part, 0
    radii = np.nextafter(found[["r1", "r2"]].to_numpy() * (1 + 1e-9) + 1e-6, np.inf)
    directory = Directory(books.books, found["cell"].to_numpy(), n, radii, np.array(first), parts)
    spark = rows.sparkSession
    where = spark.createDataFrame([(int(c), k, int(s), int(p)) for k, (c, s, p) in enumerate(zip(directory.cells, first, parts, strict=True))], "cell long, place int, first long, parts long")
    placed = given.join(F.broadcast(where), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))

    def pack(part: pa.Table) -> pa.Table:
        packed = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id", "label")]
        flat = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
        names = [c.split()[0] for c in _CELLS.split(", ")]
        values = [part.column("shard")[0].as_py(), part.column("place")[0].as_py(), *packed, flat]
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
        return pa.table({c: pa.array([v], k) for c, v, k in zip(names, values, kinds, strict=True)})

    stored = placed.select("shard", "place", "row", "vec_id", "label", "x").groupBy("shard", "place").applyInArrow(pack, _CELLS)
    return MultiIndex(directory, materialize(stored, "multi-index"), dim, rules)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles hold them while components stay below 2^20."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 20:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _probe(index: MultiIndex, anchors: DataFrame, choose, search, schema: str) -> DataFrame:
    """Send each anchor to the shards of the cells that ``choose`` returns for it, and ``search`` them there.

    ``anchors`` has (row, anchor_id, label, x, low array<long>, high array<long>):
    the windows of scores that are of use. ``choose(directory, x, low, high)``
    returns places; ``search(anchor columns, cell columns)`` returns a table.
    """
    directory, dim, block = index.directory, index.dim, index.rules.block

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(column(batch, "x"), dim)
            low, high = (column(batch, c).to_pylist() for c in ("low", "high"))
            take, shards, places = [], [], []
            for k in range(len(x)):
                at = np.array(choose(directory, x[k], low[k], high[k]), np.int64)
                parts = directory.parts[at]
                cell = np.repeat(at, parts)
                shard = directory.first_shard[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.argsort(shard, kind="stable")
                own, begin = np.unique(shard[order], return_index=True)
                take += [k] * len(own)
                shards += own.tolist()
                places += [c.astype(np.int32).tolist() for c in np.split(cell[order], begin[1:])] if len(own) else []
            out = batch.take(pa.array(take, pa.int64()))
            yield out.append_column("shard", pa.array(shards, pa.int64())).append_column("places", pa.array(places, pa.list_(pa.int32())))

    plain = "row long, anchor_id long, label long, x array<long>, low array<long>, high array<long>"
    sent = materialize(map_batches(anchors.select("row", "anchor_id", "label", "x", "low", "high"), send, f"{plain}, shard long, places array<int>"), "probes")
    # Anchors of a shard are cut into blocks of bounded size; a shard's cells are copied once for each of its blocks.
    blocks = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    left = sent.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    right = index.cells.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns])

    def task(queries: pa.Table, cells: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows:
            x = _matrix(queries.column("x"), dim)
            asked: dict[int, list[int]] = {}
            for k, wanted in enumerate(queries.column("places").to_pylist()):
                for place in wanted:
                    asked.setdefault(place, []).append(k)
            rows, labels = queries.column("row").to_numpy(), queries.column("label").to_numpy()
            low, high = queries.column("low").to_pylist(), queries.column("high").to_pylist()
            for cell in cells.to_pylist():
                who = asked.get(cell["c_place"])
                if who:
                    own, ids, own_labels = (np.frombuffer(cell[c], np.int64) for c in ("c_rows", "c_ids", "c_labels"))
                    score = _scores(x[who], np.frombuffer(cell["c_vectors"], np.int64).reshape(-1, dim).astype(float))
                    for k, mine in zip(who, score, strict=True):
                        out += [(int(rows[k]), *hit) for hit in search((rows[k], labels[k], low[k], high[k]), (own, ids, own_labels, mine))]
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True)})

    return left.groupBy("shard", "block").cogroup(right.groupBy("c_shard", "c_block")).applyInArrow(task, schema)


def _top(ids: np.ndarray, score: np.ndarray, chosen: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of the chosen entries."""
    at = np.flatnonzero(chosen)
    if len(at) > k:
        least = np.partition(score[at], -k)[-k]
        at = at[score[at] >= least]
    at = at[np.lexsort((ids[at], -score[at]))][:k]
    return list(zip(ids[at].tolist(), score[at].tolist(), strict=True))


def _first_cells(directory: Directory, x: np.ndarray, rows: int, high: float) -> list[int]:
    """The cells in the walk's order until they hold ``rows`` rows, without those that lie above ``high`` as a whole."""
    out, held = [], 0
    for _, place, _, lower in directory.walk(x):
        if lower > high:
            continue
        out.append(place)
        held += int(directory.rows[place])
        if held >= rows:
            break
    return out


def _other_cells(directory: Directory, x: np.ndarray, rows: int, low: float, high: float) -> list[int]:
    """All cells after ``_first_cells`` that can hold a score from ``low`` to ``high``."""
    out, held = [], 0
    for rest, place, upper, lower in directory.walk(x):
        if rest < low:
            break
        if lower > high:
            continue
        if held < rows:
            held += int(directory.rows[place])
        elif upper >= low:
            out.append(place)
    return out


_NO_LIMIT = 1 << 62


def _ranked(found: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), item))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _positives(index: MultiIndex, anchors: DataFrame) -> DataFrame:
    """(row, positive_id, score, rank): the best other rows of each anchor's label."""
    rules = index.rules
    k, first = rules.positives, rules.first_rows

    def search(anchor, cell):
        row, label, _, _ = anchor
        own, ids, labels, score = cell
        return _top(ids, score, (labels == label) & (own != row), k)

    schema = "row long, positive_id long, score long"
    windows = anchors.withColumns({"low": F.array(F.lit(-_NO_LIMIT)), "high": F.array(F.lit(_NO_LIMIT))})
    seen = materialize(_ranked(_probe(index, windows, lambda d, x, low, high: _first_cells(d, x, first, high[0]), search, schema), ["row"], "positive_id", k), "first-positives")
    least = seen.filter(F.col("rank") == k).select("row", F.array("score").alias("found"))
    rest = windows.join(least, "row", "left").withColumn("low", F.coalesce("found", "low")).drop("found")
    more = _probe(index, rest, lambda d, x, low, high: _other_cells(d, x, first, low[0], high[0]), search, schema)
    return _ranked(seen.drop("rank").unionByName(more), ["row"], "positive_id", k)


def _negatives(index: MultiIndex, anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """(row, at, negative_id, score, rank) for the positive of rank ``at`` of each anchor."""
    rules = index.rules
    k, first, percent = rules.negatives, rules.first_rows, rules.low_percent

    def search(anchor, cell):
        _, label, low, high = anchor
        own, ids, labels, score = cell
        other = labels != label
        return [(at, *hit) for at, (a, b) in enumerate(zip(low, high, strict=True), 1) for hit in _top(ids, score, other & (score >= a) & (score <= b), k)]

    # ceil(percent * score / 100) without fractions; a positive below zero has an empty window.
    bottom = F.call_function("div", F.col("score") * percent + 99, F.lit(100))
    windows = positives.filter("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", bottom.alias("low"), F.col("score").alias("high")))).alias("w"))
    # Windows fall from the first positive to the last, so ranks without a window are at the end.
    windows = windows.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asked = materialize(anchors.join(windows, "row"), "windows")
    schema = "row long, at long, negative_id long, score long"
    seen = materialize(_ranked(_probe(index, asked, lambda d, x, low, high: _first_cells(d, x, first, high[0]), search, schema), ["row", "at"], "negative_id", k), "first-negatives")
    full = seen.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("least"))
    # A full window needs nothing below its last negative; the lists are only used as bounds from here on.
    need = F.transform("low", lambda v, i: F.coalesce(F.try_element_at("least", (i + 1).cast("long")), v))
    rest = asked.join(full, "row", "left").withColumn("low", need).drop("least")
    more = _probe(index, rest, lambda d, x, low, high: _other_cells(d, x, first, min(low), high[0]), search, schema)
    return _ranked(seen.drop("rank").unionByName(more), ["row", "at"], "negative_id", k)


def mine_negatives(vectors: DataFrame, rules: MineRules = MineRules(), label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``anchor_every``; their positives
    the best other rows of the same label, and for each positive the best rows
    of other labels whose score is from ``low_percent`` % to 100 % of the
    positive's. Ties go to the smaller id. Rows without an id, a label or a
    vector, with an empty vector or with null or non-finite components take no
    part. Repeated rows are rows of their own. Vectors meet those of their own
    dimension only: each dimension has its own index. An empty table gives no
    rows; other columns are not read.
    """
    rows = labelled(vectors, rules.scale, label=label)
    out = None
    # One index per dimension, few in any table of embeddings.
    for (dim,) in sorted(rows.select(F.size("x")).distinct().collect()):
        own = rows.filter(F.size("x") == dim)
        anchors = own.filter(F.col("vec_id") % rules.anchor_every == 0).select("row", F.col("vec_id").alias("anchor_id"), "label", "x")
        index = build_index(own, dim, rules)
        positives = materialize(_positives(index, anchors), "positives")
        negatives = _negatives(index, anchors, positives)
        named = positives.select("row", F.col("rank").cast("long").alias("at"), "positive_id", F.col("score").alias("positive_score"))
        mined = negatives.withColumnRenamed("score", "negative_score").join(named, ["row", "at"]).join(anchors.select("row", "anchor_id"), "row")
        mined = mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = mined if out is None else out.unionByName(mined)
    if out is None:
        names = ("anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long")
        return rows.sparkSession.createDataFrame([], ", ".join(names))
    return out
