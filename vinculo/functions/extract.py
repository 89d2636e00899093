"""Names and numbers read from page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .fold import fold_light, fold_name_ocr, fold_page, fold_upper, let, one_of


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = text.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | text.contains(needle)
    return hit


def valid_person_name(name: Column, bad_words=C.NON_NAME_WORDS, bad_starts=C.LEADING_PREPOSITIONS) -> Column:
    """The four checks on a captured name with single blanks."""
    return let(
        F.filter(F.split(name, " "), lambda x: F.length(x) > 1),
        lambda w: (F.size(w) >= 2)
        & F.length(name).between(5, 60)
        & ~one_of(F.get(w, F.lit(0)), bad_starts)
        # A list of literals becomes a hash set in the plan; most captures of prose end here.
        & ~F.exists(w, lambda x: (F.length(x) > 15) | x.isin(*bad_words)),
    )


def employee_name(text: Column, patterns=C.SLIP_NAME_PATTERNS) -> Column:
    """X-1. First valid capture of the highest-ranked pattern that has one, else NULL.

    ``coalesce`` stops at the first pattern with a valid name. A pattern that
    needs certain words or digits is only run on texts that hold them.
    """
    bad_words = [F.lit(w) for w in C.NON_NAME_WORDS]

    def first_valid(page: Column, pattern: str, needs: tuple[str, ...] | str) -> Column:
        found = F.regexp_extract_all(page, F.lit(pattern), F.lit(1))
        # Captures after the first valid one aren't looked at.
        name = F.aggregate(
            found, F.lit(None).cast("string"),
            lambda first, x: F.coalesce(first, let(F.trim(x), lambda y: F.when(valid_person_name(y, bad_words), y))),
        )
        if not needs:
            return name
        return F.when(page.rlike(needs) if isinstance(needs, str) else _contains_any(page, needs), name)

    return let(fold_page(text), lambda page: F.coalesce(*[first_valid(page, p, needs) for p, needs in patterns]))


def employee_names(text: Column) -> Column:
    """X-1 as rows: the name of a page that has one, nothing for other pages.

    A filter on ``employee_name`` is pushed below the column that holds it, and every page is then searched twice.
    """
    return F.explode(F.array_compact(F.array(employee_name(text))))


def is_slip_page(text: Column, name: Column) -> Column:
    """P-19, given the extracted name."""
    return name.isNotNull() | fold_upper(text).rlike(C.SLIP_PAGE_PATTERN)


def has_payee_label(text: Column) -> Column:
    """P-18."""
    return fold_upper(text).rlike(r"FAVORECIDO\s*:?")


def _payee_pattern(labels, anchors) -> str:
    return (
        "(?:" + "|".join(labels) + ")[ :]*([A-Z][A-Z ]{4,80})(?= *(?:" + "|".join(anchors) + "))"
    )


def _payee_after_label(page: Column, label: str, stop_words) -> Column:
    """Leading run of plain words right after the first hit of ``label``; NULL below two words."""
    at = F.instr(page, label)
    rest = F.regexp_replace(F.substring(page, at + len(label), F.length(page)), "^ *:? *", "")

    def leading_run(tokens: Column) -> Column:
        plain = F.transform(tokens, lambda w: w.rlike("^[A-Z]{2,}$") & ~one_of(w, stop_words))
        stop = F.array_position(plain, F.lit(False))
        return F.when(stop > 0, F.slice(tokens, 1, (stop - 1).cast("int"))).otherwise(tokens)

    run = let(F.split(rest, " "), leading_run)
    return F.when(at > 0, let(run, lambda r: F.when(F.size(r) >= 2, F.array_join(r, " "))))


def payee_names(
    text: Column,
    labels=C.PAYEE_LABELS,
    anchors=C.PAYEE_ANCHORS,
    fallback_labels=C.PAYEE_FALLBACK_LABELS,
    stop_words=C.PAYEE_STOP_WORDS,
) -> Column:
    """X-2. Distinct folded payee names in text order.

    The label pattern is greedy and ends at the last possible anchor, so a
    name can keep a trailing anchor word. Pages where it finds nothing are read
    word by word after the first label that yields two words.
    """
    none = F.array().cast("array<string>")

    def by_label(page: Column) -> Column:
        found = F.regexp_extract_all(page, F.lit(_payee_pattern(labels, anchors)), F.lit(1))
        names = F.filter(
            F.transform(found, lambda x: F.trim(x)),
            lambda x: (F.length(x) >= 5) & (F.size(F.filter(F.split(x, " "), lambda w: F.length(w) > 1)) >= 2),
        )
        return F.array_distinct(F.transform(names, lambda x: fold_name_ocr(x)))

    def by_words(page: Column) -> Column:
        spare = F.coalesce(*[_payee_after_label(page, label, stop_words) for label in fallback_labels])
        return let(spare, lambda x: F.when(x.isNotNull(), F.array(fold_name_ocr(x))).otherwise(none))

    def read(page: Column) -> Column:
        found = let(by_label(page), lambda x: F.when(F.size(x) > 0, x).otherwise(by_words(page)))
        return F.when(_contains_any(page, labels), found).otherwise(none)

    return let(fold_light(text), read)


def tax_id(text: Column) -> Column:
    """X-3. First CPF as 11 digits, else NULL."""
    hit = F.regexp_extract(
        text, r"(?<![A-Za-z0-9_])(\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2})(?![A-Za-z0-9_])", 1
    )
    return F.nullif(F.regexp_replace(hit, r"\D", ""), F.lit(""))


def positions_of(text: Column, needle: Column) -> Column:
    """X-4. All zero-based positions of a substring, overlaps included.

    The text is cut in front of every hit, so positions are running sums of
    piece lengths and the work stays linear in the text.
    """
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")), -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    cuts = F.aggregate(
        lengths,
        state,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["hits"], acc["at"] + n).alias("hits")),
    )["hits"]
    return F.when(F.startswith(text, needle), F.concat(F.array(F.lit(0)), cuts)).otherwise(cuts)
