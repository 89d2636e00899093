"""Packing documents in their order: windows of a stream of tokens, cut by dynamic programming.

Each task reads its documents one after the other as one stream of ids. A window
is a run of that stream of at most ``capacity`` tokens, and the cuts between
windows lie at places of three kinds: the end of a document (free), the end of a
sentence (a document is truncated there: ``sentence_cut``), and, only inside runs
of more than ``stretch`` tokens without either, a grid of places (``hard_cut``).

With P the places, f(j) is the least cost of windows up to place j:

    f(j) = cut(j) + window + min(min over i with P[j] - P[i] <= capacity of f(i) + capacity - (P[j] - P[i]),
                                 min over k with P[i] = P[j] - 2^k of f(i))

A window is padded to the capacity unless its length is a power of two; each
window also costs ``window``, so that many short ones don't come for nothing.
The first minimum runs over f(i) + P[i] in a sliding range, so a monotone queue
gives it in constant time; the second looks up at most 13 places.

Only stretches of the stream are held: windows are final but for the last ones
of a stretch, whose tokens go on into the next. Nothing is shuffled. A lost task
cuts the same rows again and returns the same windows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.bytewords import slices
from vinculo.llm.common import column, held_in_worker, map_batches
from vinculo.llm.packing import WordIds

#: Words remembered per worker (some 400 MB at most); only speed depends on it.
_REMEMBERED = 1 << 21
_SENTENCE_ENDS = ".!?…。！？"
_CLOSERS = "\"')]}»”’"


@dataclass(frozen=True)
class CutRules:
    capacity: int = 4096
    #: Id put after every document.
    end: int = 2
    #: Costs in tokens of padding: truncating a document at a sentence's end or anywhere else, and a window.
    sentence_cut: int = 8
    hard_cut: int = 24
    window: int = 4
    #: Of sentences that end within this many tokens one gives a place.
    apart: int = 32
    #: A longer run without a boundary gets a place at every ``grid`` tokens.
    stretch: int = 256
    grid: int = 32
    #: Windows at the end of a stretch of the stream that are cut anew together with what follows.
    open_windows: int = 4


def best_cuts(places: np.ndarray, costs: list[int], capacity: int, window: int) -> list[int]:
    """Numbers of the places at which the cheapest windows end; ``places`` starts with 0 and has no gap over the capacity."""
    n = len(places)
    known = np.zeros(int(places[-1]) + 1, bool)
    known[places] = True
    # Pairs of places whose distance is a power of two.
    found: list[list[int] | None] = [None] * n
    step = 1
    while step < capacity:
        first = int(np.searchsorted(places, step))
        same = np.flatnonzero(known[places[first:] - step]) + first
        for j, i in zip(same.tolist(), np.searchsorted(places, places[same] - step).tolist(), strict=True):
            if found[j] is None:
                found[j] = [i]
            else:
                found[j].append(i)
        step *= 2
    places = places.tolist()
    # f(i) + P[i] of the queue's places rises from its head to its tail.
    best, before, queue, keyed = [0] * n, [0] * n, deque([0]), deque([0])
    for j in range(1, n):
        p = places[j]
        low = p - capacity
        while places[queue[0]] < low:
            queue.popleft()
            keyed.popleft()
        i = queue[0]
        cost = keyed[0] - low
        if found[j] is not None:
            for k in found[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        cost += costs[j] + window
        best[j], before[j] = cost, i
        cost += p
        while keyed and keyed[-1] >= cost:
            keyed.pop()
            queue.pop()
        queue.append(j)
        keyed.append(cost)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


class SentenceEnds:
    """Which tokens end a sentence, told by the vocabulary's strings."""

    def __init__(self, words: WordIds) -> None:
        vocabulary = words.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.stops, self.follows = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in vocabulary.items():
            # What a byte-level token stands for needs no decoding here: signs of ASCII are themselves.
            core = token.removesuffix("</w>")
            signs = core != "" and all(c in _SENTENCE_ENDS or c in _CLOSERS for c in core)
            self.stops[number] = signs and core != token and any(c in _SENTENCE_ENDS for c in core)
            # Further signs belong to the sentence, and a point before a digit belongs to a number.
            self.follows[number] = signs or core[:1].isdigit()

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Places behind the last token of each sentence."""
        ends = self.stops[ids]
        ends[:-1] &= ~self.follows[ids[1:]]
        return np.flatnonzero(ends) + 1


def _reader(tokenizer: str) -> tuple[WordIds, SentenceEnds]:
    words = WordIds(tokenizer, _REMEMBERED)
    return words, SentenceEnds(words)


def _places(ends: np.ndarray, sentences: np.ndarray, rules: CutRules) -> tuple[np.ndarray, list[int]]:
    """Places of a stretch and their costs: 0, document ends, sentence ends, and grid places in long runs."""
    # Of sentences that end close together the first is enough of a choice.
    cell = sentences // rules.apart
    sentences = sentences[np.flatnonzero(np.diff(cell, prepend=-1))]
    kind = np.zeros(int(ends[-1]) + 1, np.int8)
    kind[sentences] = 2
    kind[ends] = 3
    kind[0] = 3
    known = np.flatnonzero(kind)
    for k in np.flatnonzero(np.diff(known) > rules.stretch).tolist():
        kind[known[k] + rules.grid : known[k + 1] : rules.grid] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0, rules.hard_cut, rules.sentence_cut, 0])[kind[at]].tolist()


class Stream:
    """Documents in their order, held as far as their windows are open."""

    def __init__(self, rules: CutRules, sentence_ends: SentenceEnds) -> None:
        self.rules, self.sentence_ends = rules, sentence_ends
        self.windows = 0
        # Open documents: id, all its tokens, how many of them are cut already; then their open ids.
        self.docs: list[tuple[int | None, int, int]] = []
        self.raw: list[bytes] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.docs.append((doc_id, len(raw) // 4, 0))
        self.raw.append(raw)

    def cut(self, last: bool) -> list[list]:
        """Columns doc_id, start, length, ids_crc32, doc_tokens, window, offset of all pieces whose windows are final."""
        out: list[list] = [[] for _ in range(7)]
        if not self.raw:
            return out
        raw = b"".join(self.raw)
        ids = np.frombuffer(raw, np.uint32)
        ends = np.cumsum([len(x) // 4 for x in self.raw])
        places, costs = _places(ends, self.sentence_ends.after(ids), self.rules)
        cuts = places[best_cuts(places, costs, self.rules.capacity, self.rules.window)].tolist()
        if not last:
            cuts = cuts[: -self.rules.open_windows]
        view, doc, at = memoryview(raw), 0, 0
        ends = ends.tolist()
        for cut in cuts:
            first = at
            while at < cut:
                stop = min(cut, ends[doc])
                doc_id, total, gone = self.docs[doc]
                begin = ends[doc - 1] if doc else 0
                row = (doc_id, gone + at - begin, stop - at, zlib.crc32(view[4 * at : 4 * stop]), total, self.windows, at - first)
                for values, value in zip(out, row, strict=True):
                    values.append(value)
                at = stop
                doc += stop == ends[doc]
            self.windows += 1
        if doc < len(self.docs):
            doc_id, total, gone = self.docs[doc]
            begin = ends[doc - 1] if doc else 0
            self.docs = [(doc_id, total, gone + at - begin), *self.docs[doc + 1 :]]
            self.raw = [self.raw[doc][4 * (at - begin) :], *self.raw[doc + 1 :]]
        else:
            self.docs, self.raw = [], []
        return out


def window_pieces(
    docs: DataFrame, tokenizer: str, rules: CutRules = CutRules(), order: list[str] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The stream follows the rows as they lie in each partition; ``order`` sorts
    them first. Sequence numbers rise along the stream. A null or empty text is
    its end id alone. A text of any length is a run of the stream, cut where its
    windows end. Repeated rows are packed each, null ids stay, equal costs go to
    the later cut; other columns are not read; an empty table gives no rows.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"by_{k}") for k, c in enumerate(order or [])])
    if order:
        by = [f"by_{k}" for k in range(len(order))]
        chosen = chosen.repartitionByRange(*by).sortWithinPartitions(*by)
    kind = pa.int64() if docs.schema[doc_id].dataType.simpleString() == "bigint" else None
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([rules.end], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sentence_ends = held_in_worker(("windows", tokenizer), lambda: _reader(tokenizer))
        stream = Stream(rules, sentence_ends)
        base, id_kind = TaskContext.get().partitionId() << 32, kind

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            doc, start, length, crc, total, window, offset = stream.cut(last)
            if doc:
                numbers = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, id_kind), *numbers, pa.array(np.array(window, np.int64) + base), pa.array(offset, pa.int64())], names=names)

        for batch in batches:
            id_kind = id_kind or batch.schema.field("doc_id").type
            for part in slices(batch, "text", 1 << 22):
                for one, raw in zip(column(part, "doc_id").to_pylist(), words.encode_all(column(part, "text").to_pylist()), strict=True):
                    stream.add(one, raw + end)
                yield from rows(False)
        yield from rows(True)
        pa.default_memory_pool().release_unused()

    spark_kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(chosen.select("doc_id", "text"), run, f"doc_id {spark_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
