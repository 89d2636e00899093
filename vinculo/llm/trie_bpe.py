"""Byte-pair encoding and decoding that encodes shared word prefixes once.

The last token of the encoding of every prefix of a word determines the whole
encoding: token ``t`` ends a prefix exactly if the encoding of what comes before
it ends with a token that may stand before ``t``. So the distinct words of a
slice are visited in the depth-first order of their trie (their sorted order),
the last token of each trie node is found from the nodes above, and a word's ids
are read off its path. Words with a common prefix share its nodes.

Two tokens may be neighbours if no merge across their border comes before the
merges that built them; see ``MergeTable.may_meet``.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vinculo.llm.common import column, held_in_worker, map_slices

_NEVER = 1 << 60
#: Words and pairs remembered per task; only speed depends on them.
_REMEMBERED = 400_000
_SHORT = 16


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """Tokens as bytes, merge ranks, and which tokens may stand next to each other."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()
        self.added = {x["content"]: x["id"] for x in data["added_tokens"] or []}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        ids = {t: i for t, i in model["vocab"].items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.single = [0] * 256
        for letter, b in letters.items():
            self.single[b] = ids[letter]
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.id_of: dict[bytes, int] = {}
        for i, raw in self.bytes_of.items():
            self._derive(i, raw)
        self.tails = {raw[-_SHORT:] for raw in self.id_of if len(raw) > _SHORT}
        self.longest = max(map(len, self.id_of))
        self.met: dict[int, bool] = {}

    def _derive(self, token: int, raw: bytes) -> None:
        """Merge the bytes of one token; if they give that token, note what stood at both its ends and until which rank."""
        parts = [self.single[b] for b in raw]
        left, right = [(parts[0], _NEVER)], [(parts[-1], _NEVER)]
        while len(parts) > 1:
            found = min(((*self.ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks), key=lambda x: (x[0], x[2]), default=None)
            if found is None:
                return
            rank, made, k = found
            if k == 0:
                left[-1] = (left[-1][0], rank)
                left.append((made, _NEVER))
            if k == len(parts) - 2:
                right[-1] = (right[-1][0], rank)
                right.append((made, _NEVER))
            parts[k : k + 2] = [made]
        if parts[0] == token:
            self.id_of[raw], self.left[token], self.right[token] = token, left, right

    def may_meet(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives the two tokens again.

        Walks up the pieces at the border, on both sides in order of the merges
        that take them in, and looks for an earlier merge across the border. Of
        equal ranks the left one comes first.
        """
        key = a << 20 | b
        known = self.met.get(key)
        if known is None:
            if len(self.met) > 4 * _REMEMBERED:
                self.met.clear()
            known = self.met[key] = self._walk(self.right[a], self.left[b])
        return known

    def _walk(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.ranks.get((x, y))
            if across and across[0] < x_until and across[0] <= y_until:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, each prefix of the sorted words visited once."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]
        before = b""
        id_of, met, may_meet, tails, longest = self.id_of, self.met, self.may_meet, self.tails, self.longest
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                start = max(0, end - (longest if end > _SHORT and word[end - _SHORT : end] in tails else _SHORT))
                while True:
                    token = id_of.get(word[start:end])
                    if token is not None:
                        prior = last[start]
                        if prior < 0:
                            break
                        fits = met.get(prior << 20 | token)
                        if fits is None:
                            fits = may_meet(prior, token)
                        if fits:
                            break
                    start += 1
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(self.bytes_of[last[end]])
            ids.reverse()
            out[word] = ids
            before = word
        return out


#: Fixed pattern of the byte-level pre-tokenizer.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TrieCodec:
    """Whole texts to ids and back, with the words and stretches seen so far."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.words: dict[bytes, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        added = "|".join(regex.escape(x) for x in sorted(self.table.added, key=len, reverse=True))
        self.added = regex.compile(f"({added})") if added else None

    @staticmethod
    def _stretches(text: str) -> list[str]:
        """Parts of a text that are split into words independently: cut before single spaces between other characters."""
        parts = text.split(" ")
        if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts if not p.isalnum()):
            return [text]
        return [parts[0], *[" " + p for p in parts[1:]]]

    def _learn(self, stretches: set[str]) -> None:
        cut = {s: [w.encode() for w in _WORDS.findall(s)] for s in stretches}
        fresh = {w for ws in cut.values() for w in ws} - self.words.keys()
        if len(self.words) + len(fresh) > _REMEMBERED:
            self.words.clear()
            fresh = {w for ws in cut.values() for w in ws}
        self.words |= {w: array("I", ids).tobytes() for w, ids in self.table.encode_words(fresh).items()}
        if len(self.stretches) + len(cut) > _REMEMBERED:
            self.stretches.clear()
        self.stretches |= {s: b"".join(map(self.words.__getitem__, ws)) for s, ws in cut.items()}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null is empty."""
        plans: list[list[str | bytes]] = []
        for text in texts:
            pieces = self.added.split(text) if text and self.added and "<|" in text else [text or ""]
            plan: list[str | bytes] = []
            for k, piece in enumerate(pieces):
                if k % 2:
                    plan.append(array("I", [self.table.added[piece]]).tobytes())
                elif piece:
                    plan.extend(self._stretches(piece))
            plans.append(plan)
        fresh = {s for plan in plans for s in plan if s.__class__ is str and s not in self.stretches}
        if len(self.stretches) + len(fresh) > _REMEMBERED:
            self.stretches.clear()
            fresh = {s for plan in plans for s in plan if s.__class__ is str}
        if fresh:
            self._learn(fresh)
        held = self.stretches
        return [b"".join([held[s] if s.__class__ is str else s for s in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 give replacement characters, unknown ids nothing."""
        of = self.table.bytes_of
        return b"".join([of.get(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def codec_of(path: str) -> TrieCodec:
    """One codec per Python worker, so that its words serve the worker's later tasks as well."""
    return held_in_worker(("trie", path), lambda: TrieCodec(path))


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", digest_only: bool = False) -> DataFrame:
    """Ids of every text (``ids`` array<int>), and the text decoded from them.

    With ``digest_only`` the two are given as SHA-256 digests. A null or empty
    text has no ids and decodes to the empty text. Repeated rows are encoded
    each; null ids stay; other columns are not read; an empty table gives no
    rows. ``tokenizer`` is a vocabulary file that every executor can read.
    """

    def make():
        codec = codec_of(tokenizer)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            encoded = codec.encode_all(column(part, text).to_pylist())
            decoded = [codec.decode(x) for x in encoded]
            columns = [column(part, doc_id), pa.array([len(x) // 4 for x in encoded], pa.int64())]
            if digest_only:
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in encoded]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            columns += [pa.array([list(memoryview(x).cast("I")) for x in encoded], pa.list_(pa.int32())), pa.array(decoded)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digest_only else "ids array<int>, decoded string"
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, n_tokens long, {rest}", text)
