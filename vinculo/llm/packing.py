"""Packing documents into sequences of a fixed number of tokens.

Documents become ids (with an end id), and only documents longer than a
sequence are cut. Full pieces are sequences of their own. The others are dealt
into groups of a bounded number of rows, whatever their ids, and each group is
packed best fit first, longest first. If fewer sequences might do, a local
search goes on between underfull sequences: it moves a document, exchanges one
for a shorter one, or two for a shorter one, always so that the sum of squared
fills rises and sequences run empty. What stays open in all groups is packed
again together, in rounds, so that the loss doesn't grow with the groups.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.common import column, held_in_worker, map_batches, map_slices, materialize

#: Words remembered per task; only speed depends on it.
_REMEMBERED = 300_000
#: Signs that may follow a word; their run is a word of its own for the vocabulary.
_SIGNS = ".,!?;:#$%&*"


@dataclass(frozen=True)
class PackRules:
    capacity: int = 4096
    #: Id put after every document.
    end: int = 1
    #: Rows packed together in one task.
    group_rows: int = 32_768
    #: Sequences filled less than this are opened again in the next round.
    closed: float = 0.99


def _letters(word: str) -> bool:
    composed = unicodedata.normalize("NFC", word)
    return composed.isalpha() and composed.lower().isalpha()


class WordIds:
    """Ids of whole texts from the tokenizers library, which sees every distinct stretch between blanks once.

    The vocabulary's normaliser and word pattern never join characters over a
    blank or a line feed, so stretches can be encoded on their own. Words of
    letters, also in the vocabulary's composed form, are handed over without the
    signs behind them, many at a time with blanks between, and end where a token
    ends a word; other stretches are parted by a special token.
    """

    def __init__(self, path: str, remembered: int = _REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        special = [(x.content, i) for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special]
        self.mark, self.mark_id = special[0]
        self.specials = [x for x, _ in special]
        self.held: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.signs: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, fresh: set[str]) -> None:
        # Lists side by side: a tuple for each of some hundred thousand words would cost more than what is in it.
        words: list[str] = []
        cores: list[str] = []
        behind: list[bytes] = []
        others: list[str] = []
        for word in fresh:
            core = word.rstrip(_SIGNS)
            signs = word[len(core) :]
            if core.isascii():
                core = core.lower()
                whole = core.isalpha()
            else:
                # A letter whose composed form or small letter is more than letters would give more than one word.
                whole = core.isalpha() and _letters(core)
            if whole:
                if signs not in self.signs:
                    self.signs[signs] = self._ids(signs).tobytes()
                words.append(word)
                cores.append(core)
                behind.append(self.signs[signs])
            else:
                others.append(word)
        distinct = set(cores)
        ids_of = {core: self.held[core] for core in distinct & self.held.keys()}
        todo = list(distinct - ids_of.keys())
        unsure: set[str] = set()
        for k in range(0, len(todo), 5_000):
            some = todo[k : k + 5_000]
            ids = self._ids(" ".join(some))
            if np.count_nonzero(self.ends[ids]) != len(some):
                # The library's Unicode tables may differ from Python's: every word ends at least once, some more often.
                unsure.update(some)
                continue
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            ids_of.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        if unsure:
            others += [word for word, core in zip(words, cores, strict=True) if core in unsure]
            known = [core not in unsure for core in cores]
            words, cores, behind = (list(compress(x, known)) for x in (words, cores, behind))
        self.held.update(zip(words, map(bytes.__add__, map(ids_of.__getitem__, cores), behind), strict=True))
        for k in range(0, len(others), 5_000):
            some = others[k : k + 5_000]
            ids = self._ids(self.mark.join(some))
            marks = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            starts, ends = [0, *((marks + 1) * 4).tolist()], [*(marks * 4).tolist(), len(raw)]
            self.held.update(zip(some, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null is empty."""
        # A text with a special token's string goes to the library as it is.
        plain = [x is not None and not ("<" in x and any(s in x for s in self.specials)) for x in texts]
        words = [x.replace("\n", " ").split(" ") if ok else None for x, ok in zip(texts, plain, strict=True)]
        fresh = set().union(*(ws for ws in words if ws))
        if len(self.held) > self.remembered:
            # What came first is what is most frequent.
            self.held, self.signs = ({k: d[k] for k in islice(d, self.remembered // 2)} for d in (self.held, self.signs))
        self._learn(fresh - self.held.keys())
        get = self.held.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else self._ids(x).tobytes() if x else b"" for x, ws in zip(texts, words, strict=True)]


def words_of(path: str) -> WordIds:
    """One encoder per Python worker, so that its words serve the worker's later tasks as well."""
    return held_in_worker(("packing", path), lambda: WordIds(path))


def cut_pieces(docs: DataFrame, tokenizer: str, rules: PackRules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    width, end = rules.capacity * 4, np.array([rules.end], np.uint32).tobytes()

    def make():
        words = words_of(tokenizer)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(5)]
            for doc, raw in zip(column(part, doc_id).to_pylist(), words.encode_all(column(part, text).to_pylist()), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), width)):
                    own = raw[at : at + width]
                    for values, value in zip(rows, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        values.append(value)
            kinds = (part.schema.field(doc_id).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=names)

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", text)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[item]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        left = room - need
        by_room.setdefault(left, []).append(b)
        rooms |= 1 << left
    return bins


def swap_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    A step takes one item out of an underfull bin into another one's room, or
    exchanges one or two items for one shorter item of the other bin. Bins are
    tried emptiest first, as long as a step helps them. The search ends when no
    step helps any bin, or when no fewer bins could hold the items.
    """
    least = -(-sum(lengths) // capacity)
    bins = [list(b) for b in bins]
    fills = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    open_ = np.flatnonzero(fills < capacity)
    items = [i for b in open_ for i in bins[b]]
    # What a bin can give back: one of its items, or nothing (the rows of length 0).
    size = np.array([*(lengths[i] for i in items), *[0] * len(open_)], np.int64)
    owner = np.array([*(b for b in open_ for _ in bins[b]), *open_], np.int64)
    item = np.array([*items, *[-1] * len(open_)], np.int64)
    row_of = {i: k for k, i in enumerate(items)}

    def best_step(source: int) -> tuple[tuple[int, ...], int] | None:
        best, step = 0, None
        own = bins[source]
        room = np.where(owner == source, 0, capacity - fills[owner])
        rise = fills[owner] - fills[source]
        for out in [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[k + 1 :]]:
            net = sum(lengths[i] for i in out) - size
            gain = np.where((net > 0) & (net <= room) & ((item >= 0) | (len(out) == 1)), net * (rise + net), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, step = int(gain[k]), (out, k)
        return step

    helped = True
    while helped:
        helped = False
        for source in open_[np.argsort(fills[open_], kind="stable")].tolist():
            while bins[source] and np.count_nonzero(fills) > least and (step := best_step(source)):
                out, k = step
                target, back = int(owner[k]), int(item[k])
                bins[source] = [i for i in bins[source] if i not in out] + ([back] if back >= 0 else [])
                bins[target] = [i for i in bins[target] if i != back] + list(out)
                net = sum(lengths[i] for i in out) - int(size[k])
                fills[source] -= net
                fills[target] += net
                owner[[row_of[i] for i in out]] = target
                if back >= 0:
                    owner[k] = source
                helped = True
    return [b for b in bins if b]


def _pack_rows(pieces: DataFrame, groups: int, step: int, rules: PackRules) -> DataFrame:
    """Deal rows evenly, whatever they hold, and pack each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        lengths = rows.column("length").to_pylist()
        bins = swap_search(lengths, best_fit(lengths, rules.capacity), rules.capacity)
        base = (step << 56) + (TaskContext.get().partitionId() << 32)
        number, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                number[i], offset[i] = base + b, at
                at += lengths[i]
            fill[items] = at
        for name, values in (("sequence_id", number), ("offset", offset), ("fill", fill)):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches()

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_batches(pieces.repartition(groups), run, f"{plain}, sequence_id long, offset long, fill long")


def pack_pieces(pieces: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with ``length`` from 1 to the capacity."""
    full = pieces.filter(F.col("length") >= rules.capacity)
    done = [full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    rest, rows, step = pieces.filter(F.col("length") < rules.capacity), None, 1
    while True:
        before, rows = rows, rest.count()
        groups = max(1, math.ceil(rows / rules.group_rows))
        packed = materialize(_pack_rows(rest, groups, step, rules), "packed")
        # Packing again pays while the open sequences of several groups can meet in fewer.
        if groups == 1 or before is not None and rows > 0.8 * before:
            done.append(packed.drop("fill"))
            break
        limit = int(rules.closed * rules.capacity)
        done.append(packed.filter(F.col("fill") >= limit).drop("fill"))
        rest, step = packed.filter(F.col("fill") < limit).select(*pieces.columns), step + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, rules: PackRules = PackRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Repeated rows are
    packed each; null ids stay; other columns are not read; an empty table
    gives no rows. Which of several equal packings comes out may differ between
    runs, the number of tokens in a sequence never exceeds the capacity.
    """
    return pack_pieces(materialize(cut_pieces(docs, tokenizer, rules, doc_id, text), "pieces"), rules)
