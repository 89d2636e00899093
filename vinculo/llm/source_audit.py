"""How far the sources of a language diverge in their words, with exact integers.

A task lower-cases the letters of a text and blanks all separators with one
``bytes.translate``, cuts it with ``bytes.split`` and counts it with a Counter;
Counters of one (language, source) are added up in the task as far as memory
allows, so a hot source sends its terms a few times and not once per document.
Spark adds them up by (language, source, term).

Two groups differ on few of a language's terms by more than what both of them
give to an unseen term. The divergence of a pair is that of two groups without
any term, times the number of kept terms, plus corrections from the terms that
one of them has. Corrections are computed in cells: the terms of a bucket for
two blocks of sources, so no cell grows with the corpus, no pair of rows of a
term is ever emitted, and a cell returns one number per pair of sources.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculo.llm.common import column, map_batches, materialize
from vinculo.operators.scale import cell_join

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of any script: letters and everything beyond ASCII; what is parted by all other ASCII characters.
_COUNTS = "lang string, source string, term string, n long, docs long"


@dataclass(frozen=True)
class AuditRules:
    #: Documents of a language that a kept term occurs in.
    least_docs: int = 3
    #: Each group's shares add up to about this.
    scale: int = 1_000_000_000
    #: Ranks of single terms.
    terms: int = 200
    #: Entries of the counts that a task holds before it hands them on, and bytes of the terms it added to them.
    held: int = 1 << 19
    held_bytes: int = 1 << 28
    #: Rows of a bucket of terms, and sources of a block.
    bucket_rows: int = 1 << 15
    block: int = 64


def split_terms(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def count_terms(docs: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents it occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = {}
        documents: dict[tuple[str, str], Counter] = {}
        held = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, counts in occurrences.items():
                terms, n = list(counts), len(counts)
                lang, source = (pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [x]).cast(pa.string()) for x in group)
                in_docs = documents[group]
                yield pa.RecordBatch.from_arrays(
                    [lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for text, lang, source in zip(*(column(batch, c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                counts = Counter(split_terms(text))
                if not counts:
                    continue
                if (lang, source) not in occurrences:
                    occurrences[lang, source], documents[lang, source] = Counter(), Counter()
                total = occurrences[lang, source]
                before = len(total)
                total.update(counts)
                documents[lang, source].update(counts.keys())
                if len(total) > before:
                    held += len(total) - before
                    size += sum(map(len, counts))
                if held > rules.held or size > rules.held_bytes:
                    yield from flush()
                    occurrences.clear()
                    documents.clear()
                    held = size = 0
        yield from flush()

    parts = map_batches(docs.select("text", "lang", "source").filter("text <> ''"), run, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def share(n: Column, total: Column, kept: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + kept)), exact for every count."""
    numerator = _exact(F.lit(scale)) * _exact(n + 1)
    return F.lit(1) + F.call_function("div", numerator, _exact(total + kept)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(cell: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the cell's terms of the gap of two sources less the gap of two sources without the term."""
    names = groups.column("source").to_pylist()
    blocks, none = groups.column("block").to_numpy(), groups.column("none").to_numpy()
    number = {s: k for k, s in enumerate(names)}
    terms = cell.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    owner = np.array([number[s] for s in cell.column("source").to_pylist()], np.int64)
    p = cell.column("p").to_numpy()
    order = np.lexsort((terms, owner))
    terms, owner, p = terms[order], owner[order], p[order]
    bounds = np.searchsorted(owner, np.arange(len(names) + 1))
    # shares[b] holds the share of every term of the cell in source b, whether it occurs there or not.
    shares = np.repeat(none[:, None], int(terms.max(initial=-1)) + 1, axis=1)
    shares[owner, terms] = p
    one_block = bool((blocks == blocks[0]).all())
    a_names, b_names, sums = [], [], []
    for a, name in enumerate(names):
        mine, p_mine = terms[bounds[a] : bounds[a + 1]], p[bounds[a] : bounds[a + 1]]
        unseen = np.ones(shares.shape[1], bool)
        unseen[mine] = False
        for b, other in enumerate(names):
            if a == b or not one_block and blocks[a] == blocks[b]:
                continue
            theirs = slice(bounds[b], bounds[b + 1])
            only = p[theirs][unseen[terms[theirs]]]
            q = shares[b][mine]
            both = int(((p_mine - q) ** 2 // q).sum()) + int(((none[a] - only) ** 2 // only).sum())
            if more := both - int((none[a] - none[b]) ** 2 // none[b]) * (len(mine) + len(only)):
                a_names.append(name)
                b_names.append(other)
                sums.append(more)
    lang = cell.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "source": pa.array(a_names, pa.string()), "item": pa.array(b_names, pa.string()), "more": pa.array(sums, pa.int64())})


def source_divergence(docs: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """One row per (lang, source, part, item): value and rank.

    Part ``pair``: the divergence of a source from each other source of its
    language, over all kept terms. Part ``term``: the terms that a source has
    more often than its language, up to rank ``terms``. Null text, lang and
    source are read as ''. A group without terms takes part with counts of 0; a
    language without kept terms has pairs of value 0. Ties go to the smaller
    item in the order of its bytes. Repeated rows count each, texts of any
    length are counted whole, other columns are not read, an empty table gives
    no rows. Counts are exact up to 10^18.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(count_terms(read, rules), "term-counts")
    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= rules.least_docs)
    kept = materialize(per_lang.drop("docs"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "own-terms")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    all_groups = all_groups.fillna(0, ["total", "kept", "lang_total"])
    # The share of a term that a group doesn't have; without kept terms nothing is ever computed from it.
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"), rules.scale)).otherwise(F.lit(1).cast("long"))
    block = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / rules.block).cast("int")
    groups = materialize(all_groups.withColumns({"none": none, "block": block}), "source-groups")

    shared = own.join(groups.select("lang", "source", "total", "kept", "lang_total", "block"), ["lang", "source"])
    shared = shared.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept"), rules.scale), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), rules.scale)})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.terms)

    buckets = max(1, math.ceil(own.count() / rules.bucket_rows))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # A block of sources meets each block of its language once: nothing is copied while there is one block.
    meets = lambda: F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least("block", y).alias("low"), F.greatest("block", y).alias("high"))))
    left = shared.join(F.broadcast(blocks) if blocks.count() <= 1 << 16 else blocks, "lang").select("lang", bucket.alias("bucket"), meets().alias("cell"), "source", "term", "p")
    left = left.select("lang", "bucket", "cell.low", "cell.high", "source", "term", "p")
    right = groups.join(blocks, "lang").select("lang", meets().alias("cell"), "source", "block", "none")
    right = right.select(F.col("lang").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"), F.col("cell.low").alias("lo"), F.col("cell.high").alias("hi"), "source", "block", "none")
    cells = left.groupBy("lang", "bucket", "low", "high").cogroup(right.groupBy("l", "b", "lo", "hi"))

    def correct(cell: pa.Table, own_groups: pa.Table) -> pa.Table:
        if not cell.num_rows or not own_groups.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "more": pa.array([], pa.int64())})
        return _corrections(cell, own_groups)

    more = cells.applyInArrow(correct, "lang string, source string, item string, more long").groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    # The pairs of sources of a language are the result itself; those of a language with very many sources are dealt into cells.
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_q"))
    pairs = cell_join(groups.select("lang", "source", "kept", "none"), other, ["lang"], 1 << 20).filter(F.col("source") != F.col("item"))
    pairs = pairs.join(more, ["lang", "source", "item"], "left")
    value = F.col("kept") * gap(F.col("none"), F.col("none_q")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
