"""Token counts from a finite-state transducer compiled from a piece vocabulary.

The transducer reads characters and emits, on each transition, by how much the
token count of what was read so far changes. A state holds what later decisions
can depend on: for each start within the text read that may still become a
piece, its distance, the last token before it and the token count there,
relative to now. States are numbered as they are met and transitions compiled
on first use, so the machine is deterministic and as large as the data need.

Texts are cut into chunks, and a chunk becomes a map of states: entry state ->
(exit state, tokens). Before a space that follows another character all states
become the first one, so behind its first such border a chunk is read once for
all entry states; a chunk without one is read from each. The map of a chunk is
made for the states that the text before it leads to from some of its places,
which is nearly always all that is met: the machine forgets what lies further
back than its pieces reach. Maps compose associatively, a prefix scan composes
those of a text, and a state that a map doesn't hold yet is read when it is met.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from vinculo.llm.common import column, held_in_worker, map_slices

SPACE = "▁"
#: Sizes at which remembered words, pairs and states are dropped and met anew; only speed depends on them.
_WORDS, _PAIRS, _STATES = 400_000, 500_000, 300_000
CHUNK = 1 << 16


#: The text since the furthest start that is open, and (distance, last token, relative count) of each such start.
State = tuple[str, tuple[tuple[int, str, int], ...]]
FIRST: State = ("", ((0, "", 0),))
#: How far before a chunk the reading starts that finds its entry states.
_BEFORE = (64, 48, 32, 24)


class PieceTransducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece goes on over a space; its words can't be counted one by one")
        self.score = {p: -model.get_score(i) for p, i in self.rank.items()}
        self.stems = {p[:k] for p in self.rank for k in range(1, len(p))}
        # A piece that its own characters don't merge to never occurs.
        self.whole = {p for p in self.rank if len(p) == 1 or self._merge(p) == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[State] = [FIRST]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text: again and again the best pair that is a piece, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.score[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _may_meet(self, a: str, b: str) -> bool:
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return known

    def _move(self, state: int, c: str) -> tuple[int, int]:
        """Compile the transition of a state on a character."""
        if c not in self.rank:
            made: tuple[int, int] = (0, len(c.encode("utf-8", "surrogatepass")))
            self.moves[state][c] = made
            return made
        read, open_ = self.states[state]
        token, delta, still = c, 1, []
        for distance, prior, count in open_:
            piece = read[len(read) - distance :] + c
            if piece in self.whole and self._may_meet(prior, piece):
                token, delta = piece, count + 1
                break
        for distance, prior, count in open_:
            if read[len(read) - distance :] + c in self.stems:
                still.append((distance + 1, prior, count - delta))
        still.append((0, token, 0))
        target = (((read + c)[-still[0][0] :] if still[0][0] else ""), tuple(still))
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
            self.moves.append({})
        self.moves[state][c] = made = (number, delta)
        return made

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text``, with spaces written as ``SPACE``, and the tokens that its transitions emit."""
        if len(self.states) > _STATES:
            self._reset()
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        total, moves = 0, self.moves
        for c in text:
            number, delta = moves[number].get(c) or self._move(number, c)
            total += delta
        return self.states[number], total

    def count(self, word: str) -> int:
        """Tokens of a stretch of characters that starts in the first state."""
        return self.run(FIRST, word)[1]


class ChunkMap:
    """What a chunk does to states: ``held`` maps an entry state to its exit state and the tokens between."""

    def __init__(self, counter: TokenCounter, chunk: str) -> None:
        self.counter = counter
        self.held: dict[State, tuple[State, int]] = {}
        self.head, self.middle, tail = counter.at_borders(chunk)
        #: State and tokens behind the first border, the same for all entry states; None without a border.
        self.behind = None if tail is None else counter.machine.run(FIRST, tail)

    def __call__(self, entry: State) -> tuple[State, int]:
        made = self.held.get(entry)
        if made is None:
            state, n = self.counter.machine.run(entry, self.head)
            if self.behind is not None:
                state, n = self.behind[0], n + self.middle + self.behind[1]
            made = self.held[entry] = state, n
        return made


class ComposedMap:
    """One map after another, for the entry states that the first one holds."""

    def __init__(self, first: ChunkMap | ComposedMap, second: ChunkMap | ComposedMap) -> None:
        self.first, self.second = first, second
        self.held: dict[State, tuple[State, int]] = {}
        for entry in list(first.held):
            self(entry)

    def __call__(self, entry: State) -> tuple[State, int]:
        made = self.held.get(entry)
        if made is None:
            between, a = self.first(entry)
            after, b = self.second(between)
            made = self.held[entry] = after, a + b
        return made


_UNIT = re.compile(r" *[^ ]+| +")
#: What follows the last border of a text.
_TAIL = re.compile(r"(?<=[^ ]) +[^ ]*\Z")


class TokenCounter(dict):
    """Tokens of words after one space; new words run through the transducer."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.machine = PieceTransducer(path)

    def __missing__(self, word: str) -> int:
        if len(self) > _WORDS:
            self.clear()
        made = self[word] = self.machine.count(SPACE + word.replace(" ", SPACE))
        return made

    def at_borders(self, chunk: str) -> tuple[str, int, str | None]:
        """What is read in the entry state, tokens between the first and the last border, and what follows that."""
        words = chunk.split(" ")
        if "" not in words:
            if len(words) == 1:
                return chunk, 0, None
            return words[0], sum(map(self.__getitem__, words[1:-1])), SPACE + words[-1]
        # A unit is spaces and what follows them.
        units = _UNIT.findall(chunk)
        head = units[0].replace(" ", SPACE)
        if len(units) == 1:
            return head, 0, None
        return head, sum(self[u[1:]] for u in units[1:-1]), units[-1].replace(" ", SPACE)

    def entry_states(self, before: str) -> set[State]:
        """States in which a text may end that ends with ``before``."""
        tail = _TAIL.search(before)
        starts = {tail.start()} if tail else {max(len(before) - k, 0) for k in _BEFORE}
        return {self.machine.run(FIRST, before[k:].replace(" ", SPACE))[0] for k in starts}

    def chunk_maps(self, text: str, chunk: int) -> list[ChunkMap]:
        made = []
        for k in range(0, len(text), chunk):
            one = ChunkMap(self, text[k : k + chunk])
            for entry in self.entry_states(text[max(0, k - max(_BEFORE)) : k]) if k else [FIRST]:
                one(entry)
            made.append(one)
        return made

    def scan(self, maps: list[ChunkMap | ComposedMap]) -> ChunkMap | ComposedMap:
        """Compose neighbours in rounds, as a parallel scan does."""
        while len(maps) > 1:
            maps = [ComposedMap(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count_text(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        # The library reads its own sign for a space as a space, and puts one space before a text.
        return self.scan(self.chunk_maps(" " + text.replace(SPACE, " "), chunk))(FIRST)[1]


def counter_of(path: str) -> TokenCounter:
    """One counter per Python worker, so that its words and states serve the worker's later tasks as well."""
    return held_in_worker(("transducer", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every text.

    A null or empty text has 0 bytes and tokens. Repeated rows are counted
    each; null ids stay; other columns are not read; an empty table gives no
    rows. ``tokenizer`` is a sentencepiece model file that every executor can read.
    """

    def make():
        counter = counter_of(tokenizer)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = column(part, text)
            n = pa.array([counter.count_text(x, chunk) for x in texts.to_pylist()], pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            over = pa.compute.greater(n, limit)
            return pa.RecordBatch.from_arrays([column(part, doc_id), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", text)
