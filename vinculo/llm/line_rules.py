"""Quality rules: lines are judged first, then the document by what its failing lines took away.

Every line is tested for shouting, symbols, navigation, boilerplate, repetition
and missing sentence ends. Failing lines are removed, and a document that loses
more than ``LineRules.most_lost`` of its words is rejected, as is one that
fails the base rules (fewer than ten words, or more than a fifth of its words
in repeated runs of five words).

Every rule looks at one document only, so the work is a single pass without a
shuffle, and memory is bounded by a slice of the input.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vinculo.llm import bytewords
from vinculo.llm.common import column, map_slices

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_RUN = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are of the words of a line."""

    #: Share of words with a run of symbols or a single bracket-like symbol at an end.
    most_symbol_words: float = 0.3
    #: Share of words that are all capitals, in lines of at least ``few_words`` words.
    most_shouted: float = 0.7
    #: Separators such as ``|`` in a menu: this many, and this share of the words.
    most_separators: int = 2
    separator_share: float = 0.15
    #: Share of the most frequent word in lines of at least ``long_words`` words.
    most_one_word: float = 0.4
    few_words: int = 4
    long_words: int = 12
    #: Share of words equal to the word before, in lines of at least ``stutter_words`` words.
    most_stutter: float = 0.35
    stutter_words: int = 6
    #: Lines of at least this many words must have a sentence end somewhere.
    open_words: int = 40
    #: A document losing more than this share of its words is rejected.
    most_lost: float = 0.5


_SEPARATORS = frozenset({"|", "||", "»", "›", ">", ">>", "•", "·", "/", "::"})
_SYMBOLS = re.compile(r"[#*$%&<>|=~^!?]{2}")
_SYMBOL_WORD = re.compile(r"[#*$%&<>|=~^]{2,}|[!?]{2,}$")
_SENTENCE_END = re.compile(r"[.!?…:;。！？]")
#: Phrases of page furniture in the languages of the corpus, lower case.
_BOILERPLATE = re.compile(
    r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados"
    r"|(?:accept|use of|uses|our) cookies|cookie(?:s)? (?:policy|settings)|wir verwenden cookies|utilise(?:r)? des cookies|usamos cookies"
    r"|(?:enable|requires?|turn on) javascript|privacy policy|terms (?:of (?:use|service)|and conditions)|datenschutzerklärung|mentions légales|aviso legal"
    r"|(?:log|sign) ?(?:in|up) (?:to|for|now|here)|subscribe (?:to|now|here)|click here|read more\b|share (?:this|on)|skip to (?:main )?content"
    r"|lorem ipsum|404 not found|page not found"
)


def line_fails(line: str, rules: LineRules) -> str | None:
    """Name of the first rule that a line breaks; None for a good or blank line."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if _SYMBOLS.search(line) and sum(_SYMBOL_WORD.search(w) is not None for w in words) > rules.most_symbol_words * n:
        return "symbols"
    if n >= 3:
        menu = sum(w in _SEPARATORS for w in words)
        if menu >= rules.most_separators and menu >= rules.separator_share * n:
            return "navigation"
    if n == 2 and words[-1] in _SEPARATORS or n == 3 and words[1] in _SEPARATORS:
        return "navigation"
    if n >= rules.few_words and not line.islower():
        shouted = sum(w.isupper() for w in words)
        if shouted > rules.most_shouted * n:
            return "shouting"
    if n >= rules.long_words:
        if Counter(words).most_common(1)[0][1] > rules.most_one_word * n:
            return "repetition"
        if n >= rules.open_words and not _SENTENCE_END.search(line):
            return "punctuation"
    if n >= rules.stutter_words and sum(map(str.__eq__, words, words[1:])) > rules.most_stutter * n:
        return "repetition"
    if n <= rules.open_words and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def clean_text(text: str | None, rules: LineRules) -> tuple[str, int, int]:
    """A text without its failing lines, how many they are, and how many words they have."""
    if not text:
        return "", 0, 0
    lines = text.split("\n")
    failed = [line_fails(x, rules) is not None for x in lines]
    if not any(failed):
        return text, 0, 0
    lost = sum(len(x.encode().split()) for x, bad in zip(lines, failed, strict=True) if bad)
    return "\n".join(x for x, bad in zip(lines, failed, strict=True) if not bad), sum(failed), lost


def _duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    counts = Counter(lines)
    return sum(n - 1 for x, n in counts.items() if n > 1 and x.strip(_BLANKS))


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, code points in words, symbols, and words in repeated runs of five words, for each text."""
    raw, offsets = bytewords.text_bytes(texts)
    found = bytewords.split_words(raw, offsets)
    counts = np.diff(found.bounds)
    keys = bytewords.shingle_keys(found.keys, _RUN)
    repeated = np.zeros(len(found.keys), bool)
    if len(keys):
        of = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        whole = np.flatnonzero(of[: len(keys)] == of[_RUN - 1 :])
        own = bytewords.mix(keys[whole] + of[whole] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        ranked = own[order]
        same = np.zeros(len(ranked) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        twice = whole[order[same[:-1] | same[1:]]]
        for k in range(_RUN):
            repeated[twice + k] = True
    first_bytes = (raw & 0xC0) != 0x80
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": _sums(first_bytes & bytewords._IN_WORD[raw], offsets),
        "n_symbols": _sums(_IS_SYMBOL[raw], offsets),
        "n_repeat_words": _sums(repeated, found.bounds),
    }


_VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "lines_removed long, words_removed long"
)


def judge(part: pa.RecordBatch, text: str, rules: LineRules) -> tuple[dict[str, np.ndarray | list], list[str]]:
    """The verdict's columns and the cleaned texts of a slice."""
    counts = base_counts(column(part, text))
    texts = column(part, text).to_pylist()
    cleaned = [clean_text(x, rules) for x in texts]
    n, lost = counts["n_words"], np.array([x[2] for x in cleaned], np.int64)
    failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
    out = {k: counts[k] for k in ("n_words", "word_chars", "n_symbols")}
    out["n_dup_lines"] = np.array([_duplicate_lines(x) if x else 0 for x in texts], np.int64)
    out["n_repeat_words"] = counts["n_repeat_words"]
    out["base_failed"] = failed
    out["kept"] = ~failed & (lost <= rules.most_lost * n)
    out["lines_removed"] = np.array([x[1] for x in cleaned], np.int64)
    out["words_removed"] = lost
    return out, [x[0] for x in cleaned]


def line_verdicts(docs: DataFrame, rules: LineRules = LineRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts and the verdict of every document, in input order of no meaning.

    A null or empty text has no words: all counts are 0, ``base_failed`` is true
    and ``kept`` false. Repeated rows are judged each; a null id stays null.
    Columns besides the two named are not read, so their names can't clash. An
    empty table gives an empty result.
    """

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            verdict, _ = judge(part, text, rules)
            return pa.RecordBatch.from_pydict({"doc_id": column(part, doc_id), **{k: pa.array(v) for k, v in verdict.items()}})

        return one

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs.select(doc_id, text), make, f"doc_id {kind}, {_VERDICT}", text)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Documents that the rules keep, without their failing lines; all columns stay.

    ``n_chars``, where there is such a column, counts the code points of the
    new text. Nulls, empty texts and repeated rows are treated as in
    ``line_verdicts``: rows without text go.
    """
    schema = docs.schema

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            verdict, cleaned = judge(part, text, rules)
            at = part.schema.get_field_index(text)
            part = part.set_column(at, part.schema.field(at), pa.array(cleaned, part.schema.field(at).type))
            if n_chars and (at := part.schema.get_field_index(n_chars)) >= 0:
                part = part.set_column(at, part.schema.field(at), pa.array([len(x) for x in cleaned], part.schema.field(at).type))
            return part.filter(pa.array(verdict["kept"]))

        return one

    return map_slices(docs, make, schema, text)
