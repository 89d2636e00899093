"""Language identification: known words first, then ever shorter character n-grams.

A word of the model scores by its log frequency in each language. A word that
the model doesn't hold scores by its longest known character n-grams: all of
the greatest length, if none is known those one shorter, and so on. The model holds
the words and n-grams that make up at least a fixed share of their language's
total, which bounds it for each language however large the corpus is; the counts
behind it are exact and over all training rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.bytewords import slices
from vinculo.llm.common import column, held_in_worker, map_batches, map_slices, materialize

#: Letters, and signs that count as numbers without being digits, such as fractions and circled numbers.
_WORD = re.compile(r"[^\W\d_]+")
#: Distinct words held per task before their counts are passed on, and word scores remembered per task.
_FLUSH, _REMEMBERED = 150_000, 150_000


@dataclass(frozen=True)
class LanguageRules:
    #: Longest n-gram; words are framed by blanks before they are cut.
    longest: int = 4
    #: A word is kept if it is at least this share of its language's words: at most 2^15 words a language.
    word_share: float = 2.0**-15
    #: The same for n-grams of one length.
    gram_share: float = 2.0**-14
    #: Words whose evidence counts in full towards the score's certainty.
    certain_words: int = 20


@dataclass
class LanguageModel:
    """Keys of each n-gram length (0 for words) and their log frequencies, one row a key and one column a language."""

    languages: list[str]
    keys: list[list[str]]
    logs: list[np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = _WORD.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = [x for word in words for x in "".join(c if c.isalpha() else " " for c in word).split()]
    return words


def grams_of(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[k : k + n] for k in range(len(framed) - n + 1)]


def _as_rows(held: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
    for (language, n), own in held.items():
        columns = [pa.array([language] * len(own)), pa.array([n] * len(own), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "key", "count"])
    held.clear()


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n = 0, key, count) of the words of all rows with a text and a language.

    Tasks count before they shuffle, and pass on what they hold when it grows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for part in slices(batch, text):
                for language, content in zip(column(part, lang).to_pylist(), column(part, text).to_pylist(), strict=True):
                    held.setdefault((language, 0), Counter()).update(words_of(content))
                if sum(map(len, held.values())) > _FLUSH:
                    yield from _as_rows(held)
        yield from _as_rows(held)

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias(lang), text)
    counted = map_batches(rows, run, "lang string, n int, key string, count long")
    return counted.groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    """The same for the n-grams of counted words, up to ``longest`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for language, word, c in zip(*(column(batch, name).to_pylist() for name in ("lang", "key", "count")), strict=True):
                for n in range(1, longest + 1):
                    own = held.setdefault((language, n), Counter())
                    for gram in grams_of(word, n):
                        own[gram] += c
            if sum(map(len, held.values())) > _FLUSH:
                yield from _as_rows(held)
        yield from _as_rows(held)

    counted = map_batches(words, run, "lang string, n int, key string, count long")
    return counted.groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))


def fit_language_model(docs: DataFrame, rules: LanguageRules = LanguageRules(), text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of the given rows; rows without text or language teach nothing."""
    words = materialize(count_words(docs, text, lang), "language-words")
    grams = materialize(count_grams(words, rules.longest), "language-grams")
    counts = words.unionByName(grams)
    # One total for each language and length.
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    share = F.when(F.col("n") == 0, F.lit(rules.word_share)).otherwise(F.lit(rules.gram_share))
    keys = counts.join(F.broadcast(totals), ["lang", "n"]).filter(F.col("count") >= share * F.col("total"))
    rows = keys.select("lang", "n", "key", (F.col("count") / F.col("total")).alias("part")).toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    place = {a: k for k, a in enumerate(languages)}
    seen: list[dict[str, np.ndarray]] = [{} for _ in range(rules.longest + 1)]
    for a, n, key, part in zip(rows["lang"], rows["n"], rows["key"], rows["part"], strict=True):
        seen[n].setdefault(key, np.zeros(len(languages)))[place[a]] = part
    # A key below a language's share there counts as a part of the share, the same in all languages.
    least = [0.2 * rules.word_share] + [0.2 * rules.gram_share] * rules.longest
    logs = [np.log(np.maximum(np.array(list(held.values())).reshape(-1, len(languages) or 1), low)).astype(np.float32) for held, low in zip(seen, least, strict=True)]
    return LanguageModel(languages, [list(held) for held in seen], logs)


class _Scores(dict):
    """Row of each word seen in a matrix of scores; an unseen word backs off to n-grams."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model = model
        width = max(1, len(model.languages))
        starts = np.cumsum([0, *map(len, model.keys)])
        #: Place of each key in one matrix, whose last row is for words without any known n-gram.
        self.at = [{key: k for k, key in enumerate(keys, start)} for keys, start in zip(model.keys, starts.tolist(), strict=False)]
        self.logs = np.concatenate([*(x.reshape(-1, width) for x in model.logs), np.zeros((1, width), np.float32)])
        self.rows = np.zeros((0, width), np.float32)

    def learn(self, fresh: set[str]) -> None:
        words, grams = self.at[0], list(enumerate(self.at))[:0:-1]
        flat: list[int] = []
        counts: list[int] = []
        for word in fresh:
            known = words.get(word)
            if known is not None:
                found = [known]
            else:
                framed = f" {word} "
                for n, held in grams:
                    found = [held[g] for k in range(len(framed) - n + 1) if (g := framed[k : k + n]) in held]
                    if found:
                        break
                else:
                    found = [len(self.logs) - 1]
            flat += found
            counts.append(len(found))
        sizes = np.array(counts, np.int64)
        made = np.add.reduceat(self.logs[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
        self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, made.astype(np.float32)])

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        every = set().union(*texts)
        if len(self) > _REMEMBERED:
            self._drop()
        if fresh := every - self.keys():
            self.learn(fresh)
        counts = np.array([len(x) for x in texts], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        total = np.zeros((len(at) + 1, self.rows.shape[1]))
        np.cumsum(self.rows[at], axis=0, out=total[1:])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def _drop(self) -> None:
        """Forget the later half of the words: what came first is what is most frequent."""
        for word in list(self)[_REMEMBERED // 2 :]:
            del self[word]
        self.rows = self.rows[: len(self)]


def scores_of(model: LanguageModel) -> _Scores:
    """The scores of a model in this Python worker, which later tasks go on with."""
    return held_in_worker(("language", model.name), lambda: _Scores(model))


def predict_texts(texts: list[str | None], scores: _Scores, rules: LanguageRules) -> tuple[list[str], np.ndarray]:
    words = [words_of(x) if x else [] for x in texts]
    counts = np.array([len(x) for x in words])
    languages = scores.model.languages
    if not languages or not len(words):
        return ["und"] * len(words), np.zeros(len(words))
    logs = scores.sums(words) / np.maximum(counts, 1)[:, None] * np.minimum(counts, rules.certain_words)[:, None]
    logs = np.exp(logs - logs.max(axis=1, keepdims=True))
    share = logs / logs.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    # A letter outside every word can't be: words are runs of letters.
    found = counts > 0
    return [languages[k] if ok else "und" for k, ok in zip(best, found, strict=True)], np.where(found, share.max(axis=1), 0.0)


def predict_languages(docs: DataFrame, model: LanguageModel, rules: LanguageRules = LanguageRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` of every text.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if the model has learnt no language. Equal scores go to the first
    language in alphabetical order. Repeated rows get a row each; null ids
    stay; other columns are not read; an empty table gives no rows.
    """

    def make():
        scores = scores_of(model)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            best, share = predict_texts(column(part, text).to_pylist(), scores, rules)
            return pa.RecordBatch.from_arrays([column(part, doc_id), pa.array(best), pa.array(share)], names=["doc_id", "lang_pred", "score"])

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, lang_pred string, score double", text, 1 << 21)


def keep_languages(docs: DataFrame, model: LanguageModel, least: float = 0.5, rules: LanguageRules = LanguageRules(), text: str = "text") -> DataFrame:
    """Documents whose language is told with a score of at least ``least``; all columns stay as they are."""

    def make():
        scores = scores_of(model)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            best, share = predict_texts(column(part, text).to_pylist(), scores, rules)
            return part.filter(pa.array([b != "und" and s >= least for b, s in zip(best, share.tolist(), strict=True)], pa.bool_()))

        return one

    return map_slices(docs, make, docs.schema, text, 1 << 21)
