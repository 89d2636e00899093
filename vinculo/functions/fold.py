"""Text folds and name tokens, as column expressions.

Spark has no Unicode decomposition function, so accents are removed with one
``translate`` whose two strings are derived here from ``unicodedata``. The same
call drops invisible characters and turns every kind of white space, hyphen
and quote into a blank, so a fold costs one pass plus one or two regex passes
and stays inside code generation.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MATCH, PARTICLES

# Character groups of the folds.
INVISIBLE = "\uFEFF\u200B\u200C\u200D\u2060\u00AD\uFFFE\u2028\u2029"
SPACES = (
    "\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u202F\u205F\u3000"
)
LINE_SPACES = SPACES + "\u2028\u2029\uFEFF"
NAME_SEPARATORS = "-\u2010\u2011\u2013\u2014'`\u00B4"
PAGE_SEPARATORS = "-\u2010\u2011\u2013\u2014'"
MARKS = "".join(chr(c) for c in range(0x300, 0x370))
# The same white space as a regex class, for patterns that must see all of it.
SPACE_CLASS = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def js_trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def spaced(pattern: str) -> str:
    r"""A pattern whose ``\s`` is every kind of white space; the engine's own is ASCII only."""
    return pattern.replace(r"\s", SPACE_CLASS)


def number_text(c: Column) -> Column:
    """A double as spreadsheets' scripts write it: shortest digits, plain from 1e-6 to below 1e21, no ``.0``."""
    text = F.abs(c).cast("string")
    whole, rest = F.regexp_extract(text, r"^(\d+)\.(\d+)", 1), F.regexp_extract(text, r"^(\d+)\.(\d+)", 2)
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))

    def write(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        size = F.length(digits)
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, size)))
        )
        decimals = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit(""))
        scientific = F.concat(F.left(digits, F.lit(1)), decimals, F.when(point > 1, F.lit("e+")).otherwise(F.lit("e")), (point - 1).cast("string"))
        return F.when((F.abs(c) >= 1e-6) & (F.abs(c) < 1e21), plain).otherwise(scientific)

    raw = F.concat(whole, F.when(rest == "0", F.lit("")).otherwise(rest))
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
    parts = F.struct(F.ltrim(raw, F.lit("0")).alias("digits"), (F.length(whole) + power - lead).alias("point"))
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(c), F.lit("NaN")).when(text == "Infinity", F.concat(sign, text)).when(c == 0, F.lit("0")).otherwise(F.concat(sign, let(parts, write)))


@lru_cache(maxsize=None)
def accent_pairs() -> tuple[str, str]:
    """Characters whose decomposition without marks is one other character, and that character."""
    src, dst = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF or 0x300 <= code < 0x370:
            continue
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) < 0x370)
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


@lru_cache(maxsize=None)
def _table(drop: str, blank: str) -> tuple[str, str]:
    """translate() arguments: ``blank`` characters become ' ', accents their base, ``drop`` nothing."""
    src, dst = accent_pairs()
    taken = set(drop) | set(blank)
    # A decomposition may itself land on a separator (the Greek grave), so map the result as well.
    pairs = [(s, " " if d in blank else d) for s, d in zip(src, dst) if s not in taken]
    matching = blank + "".join(s for s, _ in pairs) + drop
    replace = " " * len(blank) + "".join(d for _, d in pairs)
    return matching, replace


def _translate(c: Column, drop: str, blank: str) -> Column:
    """Texts without any accent (as many bytes as letters) only need their separators blanked."""
    plain = "".join(ch for ch in blank if ord(ch) < 0x80 and ch != " ")
    quick = F.regexp_replace(c, "[" + re.escape(plain) + "]", " ") if plain else c
    full = F.translate(c, *_table(drop, blank))
    return F.when(F.octet_length(c) == F.length(c), quick).otherwise(full)


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def _repair_digits(c: Column) -> Column:
    """Digits an OCR engine reads in place of a letter, when between two letters. Texts without such digits aren't searched."""

    def repaired(text: Column) -> Column:
        for digit, letter in (("0", "O"), ("1", "I"), ("5", "S")):
            text = F.regexp_replace(text, f"([A-Z]){digit}([A-Z])", f"$1{letter}$2")
        return text

    return let(c, lambda text: F.when(text.contains("0") | text.contains("1") | text.contains("5"), repaired(text)).otherwise(text))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """Membership in a word list (words without commas), one small expression whatever the length of the list."""
    return F.find_in_set(c, F.lit(",".join(values))) > 0


def fold_name(c: Column) -> Column:
    """S-1. Letters A-Z and single blanks only; NULL reads as ''."""
    c = F.upper(_translate(F.coalesce(c, F.lit("")), INVISIBLE + MARKS, SPACES + NAME_SEPARATORS))
    return F.trim(_squeeze(F.regexp_replace(c, "[^A-Z ]+", "")))


def fold_constant(text: str) -> str:
    """``fold_name`` of a parameter value."""
    drop = dict.fromkeys(map(ord, INVISIBLE + MARKS))
    blank = dict.fromkeys(map(ord, SPACES + NAME_SEPARATORS), " ")
    plain = unicodedata.normalize("NFD", text).translate({**drop, **blank}).upper()
    return " ".join("".join(ch for ch in plain if ch == " " or "A" <= ch <= "Z").split())


def fold_name_ocr(c: Column) -> Column:
    """S-2. As ``fold_name`` after repairing digits between letters."""
    c = F.upper(_translate(F.coalesce(c, F.lit("")), INVISIBLE + MARKS, SPACES + NAME_SEPARATORS))
    return F.trim(_squeeze(F.regexp_replace(_repair_digits(c), "[^A-Z ]+", "")))


def fold_page(c: Column) -> Column:
    """Page fold for pattern search: upper case, no accents, digits repaired, single blanks, not trimmed."""
    c = F.upper(_translate(F.coalesce(c, F.lit("")), MARKS, LINE_SPACES + PAGE_SEPARATORS))
    return _squeeze(_repair_digits(c))


def fold_light(c: Column) -> Column:
    """S-3. The page fold, trimmed; keeps digits, colons, slashes and other marks."""
    return F.trim(fold_page(c))


def fold_upper(c: Column) -> Column:
    """Upper case without accents, white space untouched."""
    return F.upper(_translate(F.coalesce(c, F.lit("")), MARKS, ""))


def fold_weak(c: Column) -> Column:
    """S-4. Upper case, no accents, trimmed."""
    return F.regexp_replace(fold_upper(c), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def fold_storage(c: Column) -> Column:
    """S-5. Path-safe text."""
    c = _translate(F.coalesce(c, F.lit("")), MARKS, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9_\-./]", "_"), "_+", "_")
    return F.regexp_replace(c, "^_|_$", "")


def file_part(c: Column) -> Column:
    """A path-safe part of an output name: white-space runs become '_' first."""
    return fold_storage(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+", "_"))


def code_points(c: Column) -> Column:
    """S-6. One item per character: ``J(4A)``, ``·(20)`` for a blank, else ``\\u00A0``."""

    def item(ch: Column) -> Column:
        hexed = F.regexp_replace(F.hex(F.encode(ch, "UTF-32")), "^0+(?=..)", "")
        visible = (ch >= F.lit("!")) & (ch <= F.lit("~"))
        return (
            F.when(ch == " ", F.lit("·(20)"))
            .when(visible, F.concat(ch, F.lit("("), hexed, F.lit(")")))
            .otherwise(F.concat(F.lit("\\u"), F.when(F.length(hexed) < 4, F.lpad(hexed, 4, "0")).otherwise(hexed)))
        )

    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.array_join(F.transform(chars, item), " ")


def fold_changes(c: Column) -> Column:
    """S-7. True when the name fold differs from trimmed upper case."""
    c = F.coalesce(c, F.lit(""))
    trimmed = F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.upper(trimmed) != fold_name(c)


def words(c: Column, min_letters: int = 1) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) >= min_letters)


def without_particles(c: Column, particles: tuple[str, ...] = PARTICLES) -> Column:
    """S-8."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~one_of(w, particles)), " ")


def score_words(norm: Column, particles: tuple[str, ...] = PARTICLES) -> Column:
    """S-9 words: at least two letters, no particles."""
    return F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 2) & ~one_of(w, particles))


def first_name(norm: Column, particles: tuple[str, ...] = PARTICLES) -> Column:
    """S-9. First word, '' when there is none."""
    return F.coalesce(F.get(score_words(norm, particles), F.lit(0)), F.lit(""))


def surnames(norm: Column, particles: tuple[str, ...] = PARTICLES) -> Column:
    """S-9. All words after the first."""
    w = score_words(norm, particles)
    return F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))


def prepared_target(norm: Column, cfg=MATCH) -> dict[str, Column]:
    """S-17 columns of an already folded target name."""
    w = words(norm, 3)
    n = F.size(w)
    return {
        "words": w,
        "first": F.coalesce(F.get(w, F.lit(0)), F.lit("")),
        "last": F.when(n >= 2, F.element_at(w, -1)).otherwise(F.lit("")),
        "required": F.greatest(F.lit(2), F.floor(n * F.lit(cfg.overlap_ratio)).cast("int")),
        "char_count": F.length(F.replace(norm, F.lit(" "), F.lit(""))),
    }
