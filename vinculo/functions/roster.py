"""Roster cells: money, cities, companies, employee names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .fold import SPACE_CLASS, fold_name, js_trim, let, spaced

MONEY = "decimal(18,2)"


def _any_of(c: Column, values: tuple[str, ...], test) -> Column:
    hit = test(c, values[0])
    for v in values[1:]:
        hit = hit | test(c, v)
    return hit


def _contains(c: Column, v: str) -> Column:
    return c.contains(v)


def _starts(c: Column, v: str) -> Column:
    return c.startswith(v)


def locale_number(value: Column, num: Column | None = None) -> Column:
    """S-21. ``R$ 1.234,56`` as a number; a cell that already is a number passes through.

    NULL for blank cells and a lone hyphen; a text without digits is 0.
    """
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?iu)R\$", "")
    text = F.regexp_replace(text, f"{SPACE_CLASS}+", "")

    def read(t: Column) -> Column:
        plain = F.when(
            t.contains(","), F.regexp_replace(F.when(t.contains("."), F.replace(t, F.lit("."), F.lit(""))).otherwise(t), "^([^,]*),", "$1.")
        ).otherwise(t)
        digits = F.regexp_replace(plain, r"[^0-9.\-]", "")
        number = F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))
        return F.when((t != "") & (t != "-"), number)

    parsed = let(text, read)
    return parsed if num is None else F.coalesce(num, parsed)


def positive_number(value: Column, num: Column | None = None) -> Column:
    """S-22. A plain number above 0, else NULL."""
    text = js_trim(F.coalesce(value, F.lit("")))
    parsed = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    n = parsed if num is None else F.coalesce(num, parsed)
    return F.when(n > 0, n)


def looks_like_city(c: Column) -> Column:
    """P-12."""
    return c.rlike(spaced(r"(?iu)\s*-\s*(?:" + "|".join(C.CITY_LINE_SUFFIXES) + ")"))


def looks_like_company(c: Column) -> Column:
    """P-13."""
    up = F.upper(js_trim(c))
    return _any_of(up, C.COMPANY_PREFIXES, _starts) | _any_of(up, C.COMPANY_KEYWORDS, _contains)


def without_code(c: Column) -> Column:
    """S-23. Drop a leading ``12 - ``."""
    return js_trim(F.regexp_replace(c, spaced(r"^\d+\s*-\s*"), ""))


def denotes_municipality(c: Column) -> Column:
    """P-14."""

    def rule(norm: Column) -> Column:
        bare = without_code(c)
        plain = (
            ~looks_like_company(c) & (F.length(bare) >= 3)
            & ~bare.rlike(r"(?iu)(?<![A-Za-z0-9_])(?:SERVICO|SERVICE|CLEAN|ASSESSOR|CONSULT)(?![A-Za-z0-9_])")
        )
        return (F.replace(norm, F.lit(" "), F.lit("")) != "SERVICO") & (
            norm.rlike("|".join(C.MUNICIPAL_WORDS)) | plain
        )

    return let(fold_name(c), rule)


def city_of_line(c: Column) -> Column:
    """S-19. ``A - B``: B after an institution, else A."""
    parts = F.split(c, spaced(r"\s*-\s*"))
    first = js_trim(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    second = js_trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    institution = let(fold_name(first), lambda n: _any_of(n, C.INSTITUTION_PREFIXES, _starts))
    return F.when((F.size(parts) >= 2) & institution, second).otherwise(first)


def city_of_service(c: Column) -> Column:
    """S-20. '' unless the service line denotes a municipality."""
    bare = without_code(c)
    forms = [
        js_trim(F.regexp_extract(bare, p, 1))
        for p in (
            spaced(r"(?iu)^MUNIC[IÍ]PIO\s+DE\s+(.+)"), spaced(r"(?iu)^PREFEITURA\s+MUNICIPAL\s+DE\s+(.+)"),
            spaced(r"(?iu)^C[AÂ]MARA\s+MUNICIPAL\s+DE\s+(.+)"),
        )
    ]
    city = F.coalesce(*[F.nullif(f, F.lit("")) for f in forms], bare)
    label_only = js_trim(c).rlike(spaced(r"(?iu)^Servi[çc]o\s*:?\s*$"))
    return F.when((F.coalesce(c, F.lit("")) != "") & ~label_only & denotes_municipality(c), city).otherwise("")


def clean_employee(c: Column) -> Column:
    """S-18. Employee cell without a PIX note or phone number."""
    text = js_trim(c)
    text = js_trim(F.regexp_replace(text, spaced(r"(?iu)\s*-\s*PIX.*$"), ""))
    text = js_trim(F.regexp_replace(text, spaced(r"(?iu)\s*PIX.*$"), ""))
    text = js_trim(F.regexp_replace(text, spaced(r"\s*\(\d{2}\)\s*\d{4,5}-?\d{4}.*$"), ""))
    return js_trim(F.regexp_replace(text, spaced(r"\s+"), " "))


def bank_of_contract(c: Column) -> Column:
    """S-23. Last part of ``… - bank``, NULL when there is only one part."""
    parts = F.split(F.coalesce(c, F.lit("")), spaced(r"\s*-\s*"))
    return F.when(F.size(parts) > 1, F.nullif(js_trim(F.element_at(parts, -1)), F.lit("")))


def compare_fold(c: Column) -> Column:
    """S-24. Blank as NULL, trimmed, upper case."""
    return F.upper(F.nullif(js_trim(c), F.lit("")))
