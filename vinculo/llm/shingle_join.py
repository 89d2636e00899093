"""Near-duplicate join: word shingles, Jaccard similarity, token-combination prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity of
at least 80 %. Such a pair leaves each set at most ``tau = n - ceil(0.8 n)``
shingles that the other lacks, which all steps below build on:

1. **Settling.** A document with more than ``tau`` shingles that no other
   document has can't link. Counting is exact and needs only a fixed part of the
   shingle space (``JoinRules.share``), so most documents leave after one
   compact shuffle of packed arrays. Shingles seen more than once in a slice of
   the input are sent once, so a hot shingle stays small.
2. **Classes.** Documents with one and the same set become one class, named by
   its smallest id.
3. **Signatures.** Shingles of the remaining classes are ordered by their exact
   document frequency. A document's prefix is extended until more than ``tau``
   removals are needed to destroy all its signatures: rare shingles are
   signatures by themselves, more frequent classes give combinations of two or
   three shingles from one block of the shingle space (a block with c shingles
   survives c - k + 1 removals). Of any linked pair, the prefix that ends first
   in the common order keeps a signature that the other prefix has as well.
4. **Verification.** In every list of documents with one signature, one hub is
   compared with the members outside its component and then leaves the list;
   lists within one component are finished. What is left after a few rounds is
   compared member by member, in cells of bounded size, if the pair has as many
   signatures in common as a link implies: partners with the most of them first,
   until no pair across components is left. Comparisons are exact, on the sets.

No list, group or component is collected; the only driver values are counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculo.llm import bytewords
from vinculo.llm.common import MOST_SENT_IDS, column, int64s, map_batches, map_slices, materialize

_SALTS = 64
_SEED_1, _SEED_2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class JoinRules:
    words: int = 5
    #: Least similarity in per cent.
    percent: int = 80
    #: Part of the shingle space that is counted in the first step.
    share: float = 0.4
    #: Document frequencies up to which shingles are used singly, and in twos; above in threes.
    singles: int = 8
    pairs: int = 64
    #: Rounds with one hub per list before the rest is compared member by member.
    hub_rounds: int = 2
    #: Bytes of text behind one group of packed shingles.
    group_bytes: int = 4 << 20
    #: Most documents, signatures and shingles on a side of a cell of the lists that need all their pairs.
    cell_ids: int = 1500
    cell_postings: int = 100_000
    cell_values: int = 1 << 21


def tau(n: int, percent: int = 80) -> int:
    """Shingles that a set of n may have outside a partner's set."""
    return n - (percent * n + 99) // 100


def overlaps(a: int, b: int, shared: int, percent: int = 80) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _tau(n: str, percent: int) -> Column:
    return F.col(n) - F.floor((F.lit(percent) * F.col(n) + 99) / 100).cast("long")


# --- 1. settling -----------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, which the shuffle's compression shortens."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(chunks: list[bytes], kind: type) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel() for x in chunks if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _slice_sets(part: pa.RecordBatch, text: str, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a slice's texts one after another, their bounds, and two halves of a fingerprint of each set."""
    raw, offsets = bytewords.text_bytes(column(part, text))
    sets = list(bytewords.shingle_sets(bytewords.split_words(raw, offsets, fold=True), words))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=bounds[1:])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    halves = []
    for seed in (_SEED_1, _SEED_2):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(bytewords.mix(flat ^ seed), out=total[1:])
        halves.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return flat, bounds, halves[0], halves[1]


_PACKED = "bucket int, tokens binary, owners binary, shared binary, ids binary, sizes binary, counted binary, known binary, high binary, low binary"
_COUNTED = "doc_id long, n long, counted long, shared long, high long, low long, deck int, docs binary, counts binary"
#: Documents whose counts from all groups are added up together.
_DECK_DOCS = 1 << 16


def _packed(docs: DataFrame, rules: JoinRules, buckets: int) -> DataFrame:
    limit = np.uint64(int(rules.share * 2**64)) if rules.share < 1 else np.uint64(2**64 - 1)
    edges = np.array([int(limit) * k // buckets for k in range(1, buckets)], np.uint64)
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = int64s(column(part, "doc_id"))
            flat, bounds, high, low = _slice_sets(part, "text", rules.words)
            sizes = np.diff(bounds)
            of = np.repeat(np.arange(len(ids)), sizes)
            counted = flat <= limit
            flat, of = flat[counted], of[counted]
            order = np.argsort(flat)
            flat, of = flat[order], of[order]
            change = np.ones(len(flat) + 1, bool)
            change[1:-1] = flat[1:] != flat[:-1]
            first, single = change[:-1], change[:-1] & change[1:]
            tokens, owners, shared = flat[single], ids[of[single]], flat[first & ~single]
            at, at_shared = [0, *np.searchsorted(tokens, edges), len(tokens)], [0, *np.searchsorted(shared, edges), len(shared)]
            rows = {k: [] for k in names}
            for b in range(buckets):
                (i, j), (k, m) = at[b : b + 2], at_shared[b : b + 2]
                if j > i or m > k:
                    values = (b, _pack(tokens[i:j]), _pack(owners[i:j]), _pack(shared[k:m]), *[None] * 6)
                    for name, value in zip(names, values, strict=True):
                        rows[name].append(value)
            facts = (ids, sizes, np.bincount(of, minlength=len(ids)), np.bincount(of[~single], minlength=len(ids)), high, low)
            for name, value in zip(names, (int(ids[0]) % buckets, None, None, None, *[_pack(x.astype(np.int64)) for x in facts]), strict=True):
                rows[name].append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[k], pa.binary()) for k in names[1:]]], names=names
            )

        return one

    return map_slices(docs, make, _PACKED, most=1 << 21)


def _count_group(group: pa.Table, decks: int) -> pa.Table:
    """Documents' own facts as rows, and packed by decks of documents the number of their shingles here that another document has."""
    get = lambda name, kind=np.int64: _unpack(group.column(name).to_pylist(), kind)
    tokens, owners, shared = get("tokens", np.uint64), get("owners"), np.sort(get("shared", np.uint64))
    order = np.argsort(tokens)
    tokens, owners = tokens[order], owners[order]
    again = np.zeros(len(tokens) + 1, bool)
    again[1:-1] = tokens[1:] == tokens[:-1]
    again = again[:-1] | again[1:]
    if len(shared):
        again |= shared[np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)] == tokens
    docs, counts = np.unique(owners[again], return_counts=True)
    deck = (bytewords.mix(docs.view(np.uint64)) % np.uint64(decks)).astype(np.int32)
    order = np.argsort(deck, kind="stable")
    docs, counts, deck = docs[order], counts[order].astype(np.int64), deck[order]
    own, begin = np.unique(deck, return_index=True)
    bounds = [*begin.tolist(), len(docs)]
    ids = get("ids")
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    none = [pa.nulls(len(ids), k) for k in (pa.int32(), pa.binary(), pa.binary())]
    whole = pa.table([ids, get("sizes"), get("counted"), get("known"), get("high"), get("low"), *none], names=names)
    packed = [pa.array([_pack(x[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in (docs, counts)]
    part = pa.table([*[pa.nulls(len(own), pa.int64())] * 6, pa.array(own, pa.int32()), *packed], names=names)
    return pa.concat_tables([whole, part])


def _sum_deck(group: pa.Table) -> pa.Table:
    """Counts of a deck's documents over all groups."""
    docs, counts = (_unpack(group.column(c).to_pylist(), np.int64) for c in ("docs", "counts"))
    ids, at = np.unique(docs, return_inverse=True)
    return pa.table({"doc_id": pa.array(ids), "more": pa.array(np.bincount(at, counts, len(ids)).astype(np.int64))})


def _facts(docs: DataFrame, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """Size and fingerprint of every document's set, and which documents may still link."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    buckets, decks = max(8, math.ceil((size or 0) / rules.group_bytes)), max(8, math.ceil(rows / _DECK_DOCS))
    counted = materialize(_packed(docs, rules, buckets).groupBy("bucket").applyInArrow(lambda t: _count_group(t, decks), _COUNTED), "shingle-counts")
    whole = counted.filter(F.col("n").isNotNull())
    more = counted.filter(F.col("deck").isNotNull()).groupBy("deck").applyInArrow(_sum_deck, "doc_id long, more long")
    alone = F.col("counted") - F.col("shared") - F.coalesce(F.col("more"), F.lit(0))
    still = whole.filter("n > 0").join(more, "doc_id", "left").filter(alone <= _tau("n", rules.percent))
    return whole.select("doc_id", "n", "high", "low"), still.select("doc_id", "n", "high", "low")


# --- 2. classes ------------------------------------------------------------------------------------------------------


def _class_sets(docs: DataFrame, classes: DataFrame, rules: JoinRules) -> DataFrame:
    """The shingle set of one document of each class."""
    named = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("high", "low")).alias("print"))
    named = named.select("doc_id", "print.high", "print.low")
    if classes.count() <= MOST_SENT_IDS:
        named = F.broadcast(named)

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds, high, low = _slice_sets(part, "text", rules.words)
            same = (high == int64s(column(part, "high"))) & (low == int64s(column(part, "low")))
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
            columns = [column(part, "doc_id"), pa.array(np.diff(bounds)), sets]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "tokens"]).filter(pa.array(same))

        return one

    return materialize(map_slices(docs.join(named, "doc_id"), make, "id long, n long, tokens array<long>", most=1 << 21), "shingle-sets")


# --- 3. signatures ---------------------------------------------------------------------------------------------------


def signatures(n: int, shared: list[tuple[int, int]], rules: JoinRules) -> set[int]:
    """Signatures of a set of n shingles, of which ``shared`` (frequency, shingle) occur in other sets as well.

    Block widths depend on the size level of the smaller set of a pair, so a set
    gives signatures for its own level and for that of its smallest partner.
    """
    spare = tau(n, rules.percent)
    need = spare + 1 - (n - len(shared))
    if need <= 0:
        return set()
    shared = sorted(shared)
    out: set[int] = set()
    for level in {n.bit_length(), (n - spare).bit_length()}:
        blocks = 1 << max(0, level - 5)
        seen: dict[tuple[int, int], list[int]] = {}
        got = 0
        for frequency, token in shared:
            k = 1 if frequency <= rules.singles or level < 4 else 2 if frequency <= rules.pairs else 3
            if k == 1:
                out.add(hash((1, token)))
                got += 1
            else:
                held = seen.setdefault((k, token % blocks), [])
                if k == 2:
                    out.update(hash((2, level, x, token)) for x in held)
                else:
                    out.update(hash((3, level, x, y, token)) for i, y in enumerate(held) for x in held[:i])
                held.append(token)
                got += len(held) >= k
            if got >= need:
                break
    return out


def _signed(sets: DataFrame, rules: JoinRules) -> DataFrame:
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(often, "token").groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few rows at a time: their lists become Python numbers.
        for batch in (whole.slice(k, 200) for whole in batches for k in range(0, whole.num_rows, 200)):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            lists = column(batch, "shared")
            frequency, token = (lists.flatten().field(k).to_pylist() for k in (0, 1))
            at = 0
            for doc, n, m in zip(column(batch, "id").to_pylist(), column(batch, "n").to_pylist(), pa.compute.list_value_length(lists).to_pylist(), strict=True):
                known = set(zip(frequency[at : at + m], token[at : at + m], strict=True))
                own = signatures(n, list(known), rules)
                at += m
                for values, value in zip(rows, (own, [doc] * len(own), [n] * len(own), [len(known)] * len(own)), strict=True):
                    values.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["sig", "id", "n", "m"])

    return materialize(map_batches(shared, run, "sig long, id long, n long, m long"), "shingle-signatures")


# --- 4. verification -------------------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs (a, b, na, nb) that link. A group holds the sets its pairs need, each once."""
    pairs = materialize(pairs, "shingle-pairs")
    values = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0]
    if not values:
        return pairs.select("a", "b")
    groups = max(16, math.ceil(values / (1 << 20)))
    # A set of very many pairs takes them to as many groups as its partners' sets fill.
    large = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / (1 << 20)).alias("parts")).filter("parts > 1")
    pairs = pairs.join(large, "a", "left")
    pairs = pairs.withColumn("group", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))), F.lit(groups)).cast("int")).drop("parts")
    wanted = pairs.select(F.col("group").alias("cell"), F.explode(F.array("a", "b")).alias("id")).distinct()
    held = wanted.join(sets.select("id", "tokens"), "id")
    percent = rules.percent

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("tokens").combine_chunks()
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists))])
        of = {doc: flat[i:j] for doc, i, j in zip(right.column("id").to_pylist(), at[:-1], at[1:], strict=True)}
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            small, large = sorted((of[a], of[b]), key=len)
            spot = np.searchsorted(large, small)
            spot[spot == len(large)] = 0
            keep.append(overlaps(len(small), len(large), int((large[spot] == small).sum()), percent))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    linked = pairs.groupBy("group").cogroup(held.groupBy("cell")).applyInArrow(compare, "a long, b long")
    return materialize(linked, "shingle-links")


def _local_sets(held: pa.Table) -> tuple[dict[int, np.ndarray], int]:
    """Sets as numbers of a group's own shingles, and how many of those there are."""
    lists = held.column("tokens_").combine_chunks()
    found, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists))])
    return {doc: flat[i:j] for doc, i, j in zip(held.column("id_").to_pylist(), at[:-1], at[1:], strict=True)}, len(found)


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded set of links, by union-find with the smaller id on top."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
            low, high = sorted((_top(parent, a), _top(parent, b)))
            if low != high:
                parent[high] = low
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_top(parent, x) for x in ids], pa.int64())], names=["id", "comp"])


def components(links: DataFrame, together: int = 1 << 20) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b) but the smallest of each component, which is ``comp``.

    Up to ``together`` links (16 MB, counted first) are joined in one task. More
    are joined by steps that hang neighbours under the smallest one seen, until
    nothing changes; every step is an aggregate and a join on edges.
    """
    if links.count() <= together:
        return materialize(map_batches(links.select("a", "b").coalesce(1), _joined, "id long, comp long"), "shingle-stars")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = materialize(
            small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
            "shingle-stars",
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        before = now


def _possible(percent: int) -> Column:
    """Whether two sets of n and other_n shingles can overlap enough, given that m and other_m of them occur elsewhere at all."""
    return F.lit(100 + percent) * F.least("m", "other_m") >= F.lit(percent) * (F.col("n") + F.col("other_n"))


def _ordered(frame: DataFrame) -> DataFrame:
    """Pairs (id, n, other, other_n) as distinct (a, b, na, nb) with a < b."""
    first = F.col("id") < F.col("other")
    return frame.select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("other_n")).alias("na"), F.when(first, F.col("other_n")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def least_common(n: int, other_n: int, percent: int = 80) -> int:
    """Signatures that a linked pair has in common at least.

    With an overlap of o, the prefix that ends first lacks at most n - o of its
    shingles in the other set, and tau + 1 removals are needed to destroy it.
    """
    overlap = -(-percent * (n + other_n) // (100 + percent))
    return max(1, overlap + 1 - max(n - tau(n, percent), other_n - tau(other_n, percent)))


def _rest_links(rest: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """Links (a, b) across components of what the hubs left, enough of them to join what belongs together.

    Lists are bundled by their largest component. Its outsiders meet all members
    in cells of bounded size, which hold the sets of their members once. A pair
    is compared there if its common signatures, with those that both may share
    in other bundles, can be as many as a linked pair has, and if no hub of a
    common list settled it. Partners with the most common signatures come first,
    and pairs that links of the cell have joined meanwhile are left out.
    """
    outside = F.col("comp") != F.col("major")
    out = lambda c: F.sum(F.when(outside, F.col(c)).otherwise(0))
    parts = lambda ids, sigs, values: F.greatest(F.ceil(ids / rules.cell_ids), F.ceil(sigs / rules.cell_postings), F.ceil(values / rules.cell_values)).cast("int")
    sizes = rest.groupBy("major").agg(
        parts(F.count_if(outside), out("sigs"), out("n")).alias("rows"), parts(F.count(F.lit(1)), F.sum("sigs"), F.sum("n")).alias("cols")
    )
    postings, values = rest.agg(F.sum("sigs"), F.sum("n")).first()
    bundles = max(1, math.ceil((postings or 0) / rules.cell_postings), math.ceil((values or 0) / rules.cell_values))
    split = (F.col("rows") > 1) | (F.col("cols") > 1)
    sizes = sizes.withColumns({"split": split, "bundle": F.when(split, F.col("major")).otherwise(F.pmod(F.xxhash64("major"), F.lit(bundles)))})
    # A component may hold most rows: its one row of sizes is copied to several keys.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    # Waiting signatures of the ids that have them in several bundles.
    spread = rest.groupBy("id").agg(F.sum("waits").alias("waiting"), F.count_if(F.col("waits") > 0).alias("majors"))
    rest = rest.join(spread.filter("majors > 1").select("id", "waiting"), "id", "left")
    keyed = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(salted, ["major", "salt"]).drop("salt")
    chunk = lambda of: F.pmod(F.xxhash64("id"), F.greatest(of, F.lit(1))).cast("int")
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.greatest(of, F.lit(1)) - 1))
    names = ["split", "bundle", "row", "col"]
    left = keyed.filter(outside).withColumns({"row": chunk(F.col("rows")), "col": copies(F.col("cols"))}).drop("rows", "cols")
    right = keyed.withColumns({"col": chunk(F.col("cols")), "row": copies(F.col("rows"))}).drop("rows", "cols")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    # The sets of a cell's members, each once, as further rows of its second side.
    inside = left.select(*names, "id").unionByName(right.select(*[F.col(f"{c}_").alias(c) for c in (*names, "id")])).distinct()
    held = inside.join(sets.select("id", "tokens"), "id").select(*[F.col(c).alias(f"{c}_") for c in (*names, "id", "tokens")])
    right = right.unionByName(held, allowMissingColumns=True)
    percent = rules.percent

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        is_set = b.column("tokens_").is_valid()
        of, terms = _local_sets(b.filter(is_set))
        b = b.filter(pa.compute.invert(is_set))
        mark = np.zeros(terms, bool)
        lists: dict[int, dict[int, tuple[list, list, list, list]]] = {}
        facts: dict[int, tuple[int, int, int, int]] = {}
        for side, table, tail in ((0, a, ""), (1, b, "_")):
            rows = zip(*(table.column(c + tail).to_pylist() for c in ("major", "id", "n", "m", "comp", "waiting", "marks", "dones")), strict=True)
            for major, doc, n, m, comp, waiting, marks, dones in rows:
                own = lists.setdefault(major, {})
                for sig, done in zip(marks, dones, strict=True):
                    own.setdefault(sig, ([], [], [], []))[side + 2 * done].append(doc)
                facts[doc] = (n, m, comp, waiting or 0)
        for major, own in lists.items():
            rows_of, cols_of = ({doc: k for k, doc in enumerate(sorted({d for four in own.values() for d in four[side] + four[side + 2]}))} for side in (0, 1))
            if not rows_of or not cols_of:
                continue
            counts, settled = np.zeros((len(rows_of), len(cols_of)), np.int32), np.zeros((len(rows_of), len(cols_of)), bool)
            here_x, here_y = np.zeros(len(rows_of), np.int64), np.zeros(len(cols_of), np.int64)
            for x, y, hub_x, hub_y in own.values():
                x, y, hub_x, hub_y = [rows_of[d] for d in x], [cols_of[d] for d in y], [rows_of[d] for d in hub_x], [cols_of[d] for d in hub_y]
                here_x[x] += 1
                here_y[y] += 1
                if x and y:
                    counts[np.ix_(x, y)] += 1
                if hub_x:
                    settled[np.ix_(hub_x, y + hub_y)] = True
                if hub_y:
                    settled[np.ix_(x + hub_x, hub_y)] = True
            rows, cols = list(rows_of), list(cols_of)
            (n, m, comp, waiting), (other_n, other_m, other_comp, other_waiting) = (np.array([facts[d] for d in ids], np.int64).T for ids in (rows, cols))
            both = n[:, None] + other_n[None, :]
            overlap = -(-percent * both // (100 + percent))
            least = np.maximum(1, overlap + 1 - np.maximum.outer((percent * n + 99) // 100, (percent * other_n + 99) // 100))
            elsewhere = np.minimum.outer(np.maximum(waiting - here_x, 0), np.maximum(other_waiting - here_y, 0))
            keep = ~settled & (counts > 0) & (counts + elsewhere >= least) & (np.minimum.outer(m, other_m) >= overlap) & (comp[:, None] != other_comp[None, :])
            # Two outsiders meet twice, once in each order.
            keep &= (other_comp == major)[None, :] | np.less.outer(np.array(rows), np.array(cols))
            above: dict[int, int] = {}
            for i in np.flatnonzero(keep.any(axis=1)).tolist():
                near = np.flatnonzero(keep[i])
                near = near[np.argsort(-counts[i, near], kind="stable")]
                mine = of[rows[i]]
                mark[mine] = True
                done, width = 0, 8
                while done < len(near):
                    some = [j for j in near[done : done + width].tolist() if _top(above, int(other_comp[j])) != _top(above, int(comp[i]))]
                    done, width = done + width, width * 8
                    if some:
                        theirs = [of[cols[j]] for j in some]
                        sizes = np.array([len(x) for x in theirs])
                        shared = np.add.reduceat(mark[np.concatenate(theirs)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                        for k in np.flatnonzero(100 * shared >= percent * (len(mine) + sizes - shared)).tolist():
                            low, high = sorted((_top(above, int(comp[i])), _top(above, int(other_comp[some[k]]))))
                            if low != high:
                                above[high] = low
                                found.append((rows[i], cols[some[k]]))
                mark[mine] = False
        ends = list(zip(*found, strict=True)) if found else [(), ()]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("a", "b"), ends, strict=True)})

    cells = left.groupBy(*names).cogroup(right.groupBy(*[f"{c}_" for c in names]))
    return materialize(cells.applyInArrow(meet, "a long, b long"), "shingle-links")


def _linked_classes(sets: DataFrame, rules: JoinRules) -> DataFrame:
    """(id, comp) of the classes that are not the smallest of their component."""
    lists = _signed(sets, rules)
    comps = links = None
    for step in range(rules.hub_rounds + 1):
        if comps is None:
            members = lists.withColumns({"comp": F.col("id"), "weight": F.lit(1), "done": F.lit(False)})
        else:
            # A component may hold most classes: its one weight is copied to several keys.
            weights = comps.groupBy("comp").agg((F.count(F.lit(1)) + 1).alias("weight")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
            labels = comps.unionByName(comps.select(F.col("comp").alias("id"), "comp").distinct()).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
            labels = labels.join(weights, ["comp", "salt"]).drop("salt")
            members = lists.join(labels, "id", "left").withColumns({"comp": F.coalesce("comp", "id"), "weight": F.coalesce("weight", F.lit(1))})
        # The hub comes from the smallest component, so that single outsiders of a large group leave first.
        as_other = [F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("m").alias("other_m"), F.col("comp").alias("hub_comp")]
        # The rank is that of the document alone: documents that share many lists have one hub in all of them.
        hub = F.struct("weight", F.xxhash64("id").alias("rank"), *as_other)
        waiting = lambda c: F.when(~F.col("done"), c)
        state = members.groupBy("sig").agg(
            (F.min(waiting(F.col("comp"))) < F.max(waiting(F.col("comp")))).alias("mixed"), F.max("done").alias("told"),
            F.max(F.struct("weight", "comp")).alias("major"), F.min(waiting(hub)).alias("hub"),
        ).withColumn("mixed", F.coalesce("mixed", F.lit(False))).filter("mixed or told")
        columns = ["sig", "id", "n", "m", "comp", "done", "mixed"]
        if step < rules.hub_rounds:
            lists = members.join(state.drop("major", "told"), "sig").select(*columns, "hub.other", "hub.other_n", "hub.other_m", "hub.hub_comp")
            lists = materialize(lists, "shingle-lists")
            meeting = lists.filter(F.col("mixed") & ~F.col("done") & (F.col("comp") != F.col("hub_comp")) & _possible(rules.percent))
            finished = lists.filter("mixed").isEmpty()
            # A hub that was compared stays in its list to tell which pairs are settled.
            lists = lists.select("sig", "id", "n", "m", (F.col("done") | F.col("mixed") & (F.col("id") == F.col("other"))).alias("done"))
        else:
            # Across components, pairs that no hub settled share mixed lists only.
            rest = members.join(state.filter("mixed").drop("hub", "told"), "sig").withColumn("major", F.col("major.comp"))
            # One row per document and largest component, with its signatures there.
            rest = rest.groupBy("major", "id", "comp", "n", "m").agg(F.collect_list(F.struct("sig", "done")).alias("own"))
            waits = F.size(F.filter("own", lambda x: ~x["done"]))
            rest = rest.select("major", "id", "comp", "n", "m", F.col("own.sig").alias("marks"), F.col("own.done").alias("dones"), F.size("own").alias("sigs"), waits.alias("waits"))
            meeting, finished = None, True
        found = _rest_links(materialize(rest, "shingle-rest"), sets, rules) if meeting is None else _verified(_ordered(meeting), sets, rules)
        if comps is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = components(links)
        if finished:
            break
    return comps


def near_duplicates(docs: DataFrame, rules: JoinRules = JoinRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable over links.

    A null or empty text, or one of white space only, has no shingles and links
    with nothing; fewer words than a shingle form one shingle together. Repeated
    rows have one component and are all returned. An id that is repeated with
    another text links by each of its texts, where a text that shares both its
    smallest id and none of its shingles with another class is left on its own.
    A null id can't name a component: it gets a null ``component_id`` and links
    with nothing. Other columns are not read. An empty table gives no rows.
    """
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = every.filter(F.col("doc_id").isNotNull())
    whole, still = _facts(docs, rules)
    classes = materialize(still.groupBy("high", "low", "n").agg(F.min("doc_id").alias("rep")), "shingle-classes")
    comps = _linked_classes(_class_sets(docs, classes, rules), rules)
    result = (
        whole.join(classes, ["high", "low", "n"], "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))
    )

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            _, bounds, _, _ = _slice_sets(part, "text", rules.words)
            none = pa.nulls(part.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(np.diff(bounds)), none], names=["doc_id", "n_shingles", "component_id"])

        return one

    unnamed = map_slices(every.filter(F.col("doc_id").isNull()), make, "doc_id long, n_shingles long, component_id long")
    return result.unionByName(unnamed)
