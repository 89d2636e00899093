"""Display texts: dates, durations, money, output names, JSON counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MONTH_NAMES
from ..sources.schemas import MISSES_JSON
from .fold import file_part


def month_name(month: Column) -> Column:
    """S-26."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


def duration_hms(ms: Column) -> Column:
    """S-27, milliseconds with hours."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def duration_ms(seconds: Column) -> Column:
    """S-27, whole seconds without hours."""
    total = seconds.cast("long")
    return F.when(total < 60, F.format_string("%ds", total)).otherwise(
        F.format_string("%dm %ds", F.floor(total / 60), total % 60)
    )


def brl(amount: Column) -> Column:
    """S-28. ``R$ 1.234,56`` with a no-break space, '—' for NULL."""
    digits = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    sign = F.when(F.round(amount, 2) < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, F.lit("R$\u00A0"), digits), F.lit("—"))


def output_name(company: Column, city: Column, contract: Column, name: Column) -> Column:
    """S-25. ``company_city_contract_name.pdf`` with placeholders for blank parts."""

    def part(c: Column, placeholder: str) -> Column:
        return file_part(F.coalesce(F.nullif(c, F.lit("")), F.lit(placeholder)))

    return F.concat(
        F.concat_ws("_", part(company, "EMPRESA"), part(city, "CIDADE"), part(contract, "CONTRATO"), file_part(name)),
        F.lit(".pdf"),
    )


def run_name(company: Column, month: Column, year: Column) -> Column:
    """S-25. ``company_month_year_PDFs.zip``; the year stands in for a missing company."""
    prefix = F.coalesce(F.nullif(file_part(company), F.lit("")), year.cast("string"))
    return F.concat(F.concat_ws("_", prefix, file_part(month), year.cast("string")), F.lit("_PDFs.zip"))


def parse_misses(data: Column) -> Column:
    """S-31. Array of misses; NULL when the text is no JSON array."""
    return F.when(F.ltrim(data).startswith("["), F.from_json(data, MISSES_JSON))


def miss_count(data: Column) -> Column:
    """S-31."""
    return F.coalesce(F.when(F.ltrim(data).startswith("["), F.json_array_length(data)), F.lit(0))
