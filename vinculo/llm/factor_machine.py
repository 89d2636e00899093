"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum is taken in linear time as half of |sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2.
Features of a text are its distinct hashed words by their share (one unit vector
a text), and bins of structure statistics (capitals, symbols, separators,
repetition, line shapes) and of metadata (size in bytes, words and lines), each
with the same small weight. All are made by NumPy over the bytes of many texts.
The model is fitted on a bounded sample of labelled rows, which the caller
keeps out of its held-out fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm import bytewords
from vinculo.llm.common import column, map_slices


@dataclass(frozen=True)
class FactorRules:
    #: Words are hashed to 2^bits features.
    bits: int = 15
    factors: int = 8
    #: Most labelled rows that are learnt from; those with the smallest hash of their id are taken.
    train_rows: int = 12_000
    epochs: int = 12
    batch: int = 200
    rate: float = 0.08
    decay: float = 1e-5
    #: Weight of each bin of structure and metadata.
    structure: float = 0.5
    seed: int = 7
    threshold: float = 0.7


#: Borders of the bins of each statistic; shares are of words or lines.
_BINS: dict[str, tuple[float, ...]] = {
    "capitals": (0.02, 0.1, 0.25, 0.4, 0.6, 0.8),
    "capital_letters": (0.03, 0.06, 0.12, 0.25, 0.5, 0.8),
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "separators": (0.01, 0.05, 0.12, 0.2, 0.3, 0.45),
    "marks": (0.02, 0.08, 0.2, 0.4, 0.7),
    "same_as_before": (0.005, 0.03, 0.1, 0.2, 0.4, 0.7),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "sentence_ends": (0.01, 0.03, 0.06, 0.1, 0.15, 0.3),
    "digits": (0.005, 0.02, 0.05, 0.15),
    "word_length": (2, 3, 4, 5, 6, 8, 11),
    "line_words": (3, 8, 16, 32, 64, 128),
    "n_words": (1, 5, 12, 25, 60, 150, 400, 1200, 4000),
    "n_lines": (2, 4, 8, 16, 40),
    "n_bytes": (30, 100, 400, 1500, 6000, 30000),
}
_START = dict(zip(_BINS, np.cumsum([0, *[len(x) + 1 for x in _BINS.values()]])[:-1].tolist(), strict=True))
STRUCTURE = sum(len(x) + 1 for x in _BINS.values())


def _kind(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _LOWER, _DIGIT = _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123))), _kind(b"0123456789")
_SYMBOL, _PIPE, _MARK, _END = _kind(b"#*$%&<>=~^@{}[]_"), _kind(b"|"), _kind(b"!?"), _kind(b".!?")


class Features:
    """Features of a slice of texts: rows of (text, feature, value) sorted by text."""

    def __init__(self, texts: pa.Array, rules: FactorRules) -> None:
        raw, offsets = bytewords.text_bytes(texts)
        words = bytewords.split_words(raw, offsets)
        n = len(offsets) - 1
        counts = np.diff(words.bounds)
        of = np.repeat(np.arange(n), counts)
        per_word, per_text = np.maximum(counts, 1), np.maximum(np.diff(offsets), 1)

        def in_words(kind: np.ndarray) -> np.ndarray:
            total = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(kind[raw], out=total[1:])
            self.total = total
            return total[words.ends] - total[words.starts]

        def by_text(values: np.ndarray) -> np.ndarray:
            total = np.zeros(len(values) + 1)
            np.cumsum(values, out=total[1:])
            return total[words.bounds[1:]] - total[words.bounds[:-1]]

        def of_bytes() -> np.ndarray:
            return (self.total[offsets[1:]] - self.total[offsets[:-1]]).astype(float)

        lower = in_words(_LOWER)
        lowers = of_bytes()
        upper = in_words(_UPPER)
        uppers = of_bytes()
        stats = {"capitals": by_text((upper > 0) & (lower == 0)) / per_word, "capital_letters": uppers / np.maximum(uppers + lowers, 1)}
        for name, kind in (("symbols", _SYMBOL), ("marks", _MARK), ("digits", _DIGIT)):
            in_words(kind)
            stats[name] = of_bytes() / (per_text if name != "marks" else per_word)
        stats["separators"] = by_text(in_words(_PIPE) > 0) / per_word
        in_words(_END)
        stats["sentence_ends"] = by_text(_END[raw[words.ends - 1]] if len(words.ends) else np.zeros(0)) / per_word
        again = np.zeros(len(words.keys), bool)
        again[1:] = (words.keys[1:] == words.keys[:-1]) & (of[1:] == of[:-1])
        stats["same_as_before"] = by_text(again) / per_word
        in_words(_kind(b"\n"))
        lines = of_bytes() + 1
        stats |= {"word_length": by_text(words.ends - words.starts) / per_word, "line_words": counts / lines, "n_words": counts, "n_lines": lines, "n_bytes": np.diff(offsets)}
        # Distinct hashed words of each text with their counts.
        keys = np.sort((of.astype(np.uint64) << np.uint64(rules.bits)) | (words.keys >> np.uint64(64 - rules.bits)))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        tf = np.diff(np.append(at, len(keys))).astype(np.float32)
        owner = (keys[at] >> np.uint64(rules.bits)).astype(np.int64)
        word = (keys[at] & np.uint64((1 << rules.bits) - 1)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n)
        stats["distinct"] = distinct / per_word
        norm = np.sqrt(np.bincount(owner, weights=tf * tf, minlength=n))
        bins = np.stack([_START[name] + np.searchsorted(edges, stats[name], "right") for name, edges in _BINS.items()], axis=1) + (1 << rules.bits)
        k = len(_BINS)
        owners = np.concatenate([owner, np.repeat(np.arange(n), k)])
        order = np.argsort(owners, kind="stable")
        self.owner = owners[order]
        self.index = np.concatenate([word, bins.ravel()])[order]
        self.value = np.concatenate([tf / norm[owner], np.full(n * k, rules.structure)])[order].astype(np.float32)
        self.bounds = np.searchsorted(self.owner, np.arange(n + 1))


@dataclass
class FactorMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    rules: FactorRules

    def logits(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every text has structure features, so no run between bounds is empty."""
        if len(bounds) < 2:
            return np.zeros(0)
        starts = bounds[:-1]
        linear = np.add.reduceat(self.weights[index] * value, starts)
        scaled = self.factors[index] * value[:, None]
        pairs = np.add.reduceat(scaled, starts) ** 2 - np.add.reduceat(scaled * scaled, starts)
        return self.bias + linear + 0.5 * pairs.sum(axis=1)


def train(index: np.ndarray, value: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rules: FactorRules) -> FactorMachine:
    """Adaptive gradient steps over shuffled batches; one class alone gives a constant score."""
    size = (1 << rules.bits) + STRUCTURE
    rng = np.random.default_rng(rules.seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = FactorMachine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rules.factors)).astype(np.float32), rules)
    squares_w, squares_v, square_b = np.full(size, 1e-6, np.float32), np.full((size, rules.factors), 1e-6, np.float32), 1e-6
    lengths = np.diff(bounds)
    for _ in range(rules.epochs if len(labels) else 0):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // rules.batch)):
            sizes = lengths[rows]
            own = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(bounds[rows] - own[:-1], sizes) + np.arange(own[-1])
            i, x = index[at], value[at]
            scaled = model.factors[i] * x[:, None]
            sums = np.add.reduceat(scaled, own[:-1])
            error = 1 / (1 + np.exp(-model.logits(i, x, own))) - labels[rows]
            each = np.repeat(error, sizes) / len(rows)
            order = np.argsort(i, kind="stable")
            i = i[order]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            used = i[starts]
            grad_w = np.add.reduceat((each * x)[order], starts) + rules.decay * model.weights[used]
            grad_v = np.add.reduceat(((each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - scaled))[order], starts) + rules.decay * model.factors[used]
            squares_w[used] += grad_w**2
            squares_v[used] += grad_v**2
            square_b += error.mean() ** 2
            model.weights[used] -= (rules.rate * grad_w / np.sqrt(squares_w[used])).astype(np.float32)
            model.factors[used] -= (rules.rate * 0.3 * grad_v / np.sqrt(squares_v[used])).astype(np.float32)
            model.bias -= rules.rate * error.mean() / square_b**0.5
    return model


def fit_factor_machine(docs: DataFrame, labels: DataFrame, rules: FactorRules = FactorRules(), doc_id: str = "doc_id", text: str = "text") -> FactorMachine:
    """A model from ``labels`` (doc_id, quality 0/1), at most ``train_rows`` of them.

    Rows with a null id or label teach nothing; a document labelled both ways
    counts as bad; texts that are null teach as empty texts. Of the rows of one id the
    smallest text teaches.
    """
    one = labels.filter(F.col(doc_id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_rows)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # However often an id repeats, it teaches once, so the sample keeps its bound.
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def make():
        def features(part: pa.RecordBatch) -> pa.RecordBatch:
            made = Features(column(part, "text"), rules)
            bounds = pa.array(made.bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (made.index.astype(np.int32), made.value)]
            return pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "quality"), *lists], names=["doc_id", "quality", "index", "value"])

        return features

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = map_slices(sample, make, f"doc_id {kind}, quality int, index array<int>, value array<float>").toArrow().combine_chunks().sort_by("doc_id")
    index, value = (rows.column(x).combine_chunks() for x in ("index", "value"))
    sizes = index.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (index, value)]
    return train(flat[0].astype(np.int64), flat[1], bounds, rows.column("quality").to_numpy().astype(float), rules)


def score_documents(docs: DataFrame, model: FactorMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` (higher: better) and ``predicted`` of every text.

    A null or empty text is scored by its structure features alone. Repeated
    rows are scored each; null ids stay; other columns are not read; an empty
    table gives no rows.
    """
    rules = model.rules

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            made = Features(column(part, text), rules)
            score = 1 / (1 + np.exp(-np.clip(model.logits(made.index, made.value, made.bounds), -50, 50)))
            predicted = (score >= rules.threshold).astype(np.int32)
            return pa.RecordBatch.from_arrays([column(part, doc_id), pa.array(score.astype(float)), pa.array(predicted)], names=["doc_id", "score", "predicted"])

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, score double, predicted int", text, 1 << 21)
