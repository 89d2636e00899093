"""Roster layouts: which of three a workbook has, where its columns are, and its records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.fold import fold_constant, fold_name, js_trim, let, spaced
from ..functions.roster import (
    MONEY, city_of_line, city_of_service, clean_employee, locale_number, looks_like_city, looks_like_company,
    positive_number, without_code,
)
from ..sources.grids import SHEET, cell_at, fill_merges, grid_rows, number_at
from ..sources.schemas import EMPLOYEE_RECORDS, struct
from .scale import carry_forward, materialize

SERVICE = spaced(r"(?iu)Servi[çc]o\s*:\s*")
LAYOUTS = ("payroll", "todos", "city_sheets")


def find_column(folded: Column, aliases: tuple[str, ...]) -> Column:
    """P-2. Zero-based column whose folded header fits an alias, or -1.

    An exact hit beats a prefix hit, which beats a hit inside; within a pass the
    alias order decides, then the left-most column.
    """
    names = F.split(F.lit("|".join(dict.fromkeys(fold_constant(a) for a in aliases))), r"\|")

    def first_of(position) -> Column:
        return F.get(F.filter(F.transform(names, position), lambda p: p > 0), F.lit(0))

    exact = first_of(lambda n: F.array_position(folded, n))
    prefix = first_of(lambda n: F.array_position(F.transform(folded, lambda h: F.startswith(h, n)), F.lit(True)))
    inside = first_of(lambda n: F.array_position(F.transform(folded, lambda h: F.contains(h, n)), F.lit(True)))
    return F.coalesce(exact, prefix, inside, F.lit(0)).cast("int") - 1


def folded_headers(cells: Column) -> Column:
    return F.transform(cells, lambda c: fold_name(c))


def _column_struct(folded: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    return F.struct(*[find_column(folded, a).alias(f) for f, a in aliases.items()])


def _first_row_with(rows: DataFrame, hit: Column, value: Column, name: str) -> DataFrame:
    """Per sheet the smallest row number for which ``hit`` holds, with its ``value``."""
    return (
        rows.filter(hit).groupBy(*SHEET)
        .agg(F.min(F.struct("r", value.alias("v"))).alias("m"))
        .select(*SHEET, F.col("m.r").alias("header_r"), F.col("m.v").alias(name))
    )


# ---------------------------------------------------------------------------
# Payroll layout
# ---------------------------------------------------------------------------

def payroll_headers(rows: DataFrame) -> DataFrame:
    """P-4. Per sheet its payroll header row and column positions.

    Code and name, or name and a salary or net column. Only sheets of three
    rows or more count. Each row is folded once and searched for a name header;
    only rows that may have one are tested for the deciding fields, and the full
    column map is only made for the header row found.
    """
    need = {f: C.PAYROLL_ALIASES[f] for f in ("codigo", "nome", "salario", "liquido")}
    whole = fold_name(F.array_join("cells", " "))
    named = let(whole, lambda t: reduce(Column.__or__, [t.contains(fold_constant(a)) for a in C.PAYROLL_ALIASES["nome"]]))
    keyed = rows.filter(named).withColumn("folded", folded_headers(F.col("cells"))).withColumn("k", _column_struct(F.col("folded"), need))
    hit = (F.col("k.nome") >= 0) & ((F.col("k.codigo") >= 0) | (F.col("k.salario") >= 0) | (F.col("k.liquido") >= 0))
    long_enough = rows.groupBy(*SHEET).agg(F.max("r").alias("last_r")).filter("last_r >= 2").select(*SHEET)
    first = _first_row_with(keyed, hit, F.col("folded"), "folded")
    return first.join(long_enough, SHEET, "left_semi").select(
        *SHEET, "header_r", _column_struct(F.col("folded"), C.PAYROLL_ALIASES).alias("at")
    )


def choose_sheet(headers: DataFrame) -> DataFrame:
    """P-5. The first sheet of a file among those detected."""
    best = headers.groupBy("file").agg(F.min("sheet_ord").alias("sheet_ord"))
    return headers.join(best, SHEET, "left_semi")


def payroll_company(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """P-6. Company of a payroll sheet from the rows above its header."""
    above = rows.join(headers.select(*SHEET, "header_r"), SHEET).filter("r < least(header_r, 10)")
    cells = above.select(*SHEET, "r", F.posexplode("cells").alias("c", "raw")).withColumn("v", js_trim(F.col("raw")))
    coded = F.col("v").rlike(spaced(r"^\d+\s*-\s*.+"))
    named = (F.length("v") > 5) & ~F.col("v").rlike(r"(?iu)^(RELAC|Servi|Codigo|Nome|Salari|INSS|IRRF|FGTS|Liquid)")
    at = F.struct("r", "c", "v")
    found = cells.groupBy(*SHEET).agg(F.min(F.when(coded, at)).alias("a"), F.min(F.when(named, at)).alias("b"))
    return found.select(
        *SHEET, F.coalesce(F.nullif(without_code(F.col("a.v")), F.lit("")), F.col("b.v"), F.lit("")).alias("empresa")
    )


def _service_of_row(cells: Column) -> Column:
    """W-6. Service text of a row; NULL when the row has no service label, '' when the label has no value."""
    label = spaced(r"(?iu)Servi[çc]o\s*:\s*(.*)")

    def value(at: Column) -> Column:
        own = js_trim(F.regexp_extract(F.element_at(cells, at), label, 1))
        right = F.filter(
            F.transform(F.slice(cells, at + 1, F.size(cells)), lambda c: js_trim(c)),
            lambda c: (c != "") & ~c.rlike(spaced(r"(?iu)^Servi[çc]o\s*:?\s*$")),
        )
        return F.when(own != "", own).otherwise(F.coalesce(F.get(right, F.lit(0)), F.lit("")))

    def in_row(joined: Column) -> Column:
        rest = F.regexp_extract(joined, spaced(r"(?iu)Servi[çc]o\s*:\s*(.+)"), 1)
        return F.when(rest != "", js_trim(F.regexp_replace(rest, spaced(r"(?iu)Servi[çc]o\s*:?\s*"), "")))

    position = F.array_position(F.transform(cells, lambda c: js_trim(c).rlike(SERVICE)), F.lit(True)).cast("int")
    return let(
        position,
        lambda p: F.when(p > 0, value(F.when(p > 0, p).otherwise(1))).otherwise(let(F.array_join(cells, " "), in_row)),
    )


def _unlabelled_service(cells: Column) -> Column:
    hits = F.filter(
        F.transform(cells, lambda c: js_trim(c)),
        lambda c: c.rlike(spaced(r"^\d+\s*-\s*.{5,}")) & c.rlike(r"(?iu)MUNIC|PREFEIT|CAMARA"),
    )
    return F.get(hits, F.lit(0))


def _section_type(first: Column, name: Column) -> Column:
    """W-7."""
    out = F.lit(None).cast("string")
    for pattern, tipo in reversed(C.SECTION_TYPES):
        out = F.when(first.rlike(spaced(pattern)) | name.rlike(spaced(pattern)), F.lit(tipo)).otherwise(out)
    return out


def payroll_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """P-10, P-11, W-5 to W-7: every row below the header with its section state and ``skip_reason``.

    A labelled service line always sets the contract and sets the city when it
    names one; a line like ``6-MUNICIPIO …`` sets both, the city even to ''.
    """
    body = rows.join(headers, SHEET).filter("r > header_r")
    body = body.withColumns(
        {
            "service": _service_of_row(F.col("cells")),
            "nome": cell_at(F.col("cells"), F.col("at.nome")),
            "first": cell_at(F.col("cells"), F.lit(0)),
        }
    )
    body = body.withColumn("section", F.when(F.col("service").isNull(), _section_type(F.col("first"), F.col("nome"))))
    body = body.withColumn(
        "bare_service",
        F.when(F.col("service").isNull() & F.col("section").isNull(), _unlabelled_service(F.col("cells"))),
    )
    raw_code = F.regexp_replace(F.regexp_replace(cell_at(F.col("cells"), F.col("at.codigo")), r"\.0$", ""), spaced(r"\s"), "")
    said = F.nullif(F.col("service"), F.lit(""))
    body = body.withColumns(
        {
            "contrato": F.coalesce(said, F.col("bare_service")),
            "cidade": F.coalesce(
                F.nullif(city_of_service(said), F.lit("")),
                F.when(F.col("bare_service").isNotNull(), city_of_service(F.col("bare_service"))),
            ),
            "tipo": F.col("section"),
            "codigo": F.when(F.col("at.codigo") >= 0, raw_code).otherwise(""),
        }
    )
    body = carry_forward(body, SHEET, "r", ["contrato", "cidade", "tipo"])
    n_words = F.size(F.filter(F.split("nome", spaced(r"\s+")), lambda w: F.length(w) >= 2))
    # Without a code column only blanks part words.
    n_blank_words = F.size(F.filter(F.split("nome", " "), lambda w: F.length(w) >= 2))
    skip = (
        F.when(F.col("service").isNotNull(), "service")
        .when(F.col("section").isNotNull(), "section")
        .when(F.col("bare_service").isNotNull(), "service")
        .when(F.length("nome") < 3, "empty_name")
        .when(fold_name(F.col("nome")).rlike(C.PAYROLL_SKIP_PATTERN), "skip_pattern")
        .when((F.col("codigo") != "") & ~F.col("codigo").rlike(r"^\d+$"), "non_numeric_code")
        .when((n_words < 2) | ((F.col("at.codigo") < 0) & (n_blank_words < 2)), "few_words")
    )
    return body.withColumn("skip_reason", skip)


def payroll_records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """P-10. Records of the chosen payroll sheet of each file."""
    chosen = choose_sheet(headers)
    kept = payroll_rows(rows, chosen).filter("skip_reason is null")
    named = kept.join(payroll_company(rows, chosen), SHEET, "left")
    money = {
        f: locale_number(cell_at(F.col("cells"), F.col(f"at.{f}")), number_at(F.col("nums"), F.col(f"at.{f}"))).cast(MONEY)
        for f in C.PAYROLL_MONEY_FIELDS
    }
    out = named.select(
        "file", F.col("r").cast("long").alias("row_ord"), F.coalesce("empresa", F.lit("")).alias("empresa"),
        F.coalesce("cidade", F.lit("")).alias("cidade"), F.coalesce("contrato", F.lit("")).alias("contrato"),
        F.col("nome").alias("colaborador"), "tipo", F.nullif(F.col("codigo"), F.lit("")).alias("codigo"),
        *[c.alias(f) for f, c in money.items()],
    )
    return _as_records(out)


def _as_records(df: DataFrame) -> DataFrame:
    fields = struct(EMPLOYEE_RECORDS).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


# ---------------------------------------------------------------------------
# TODOS layout
# ---------------------------------------------------------------------------

def validate_todos(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """P-1, U-3. Per file whether its TODOS sheet has the required headers, and which are missing.

    Of its first ten rows the first with all headers makes it valid, the first
    with at least three makes it invalid with those missing.
    """
    required = F.array(*[F.lit(h) for h in C.REQUIRED_HEADERS])
    todos = _todos_sheets(sheets)
    heads = (
        rows.join(todos, SHEET, "left_semi").filter("r < 10")
        .withColumn("missing", F.array_except(required, folded_headers(F.col("cells"))))
        .filter(F.size("missing") <= len(C.REQUIRED_HEADERS) - 3)
        .groupBy("file").agg(F.min(F.struct("r", "missing")).alias("m"))
    )
    return (
        sheets.select("file").distinct().join(heads, "file", "left")
        .select("file", F.coalesce(F.col("m.missing"), required).alias("missing_columns"))
        .withColumn("valid", F.size("missing_columns") == 0)
    )


def _todos_sheets(sheets: DataFrame) -> DataFrame:
    return (
        sheets.filter(fold_name(F.col("sheet")) == "TODOS").groupBy("file").agg(F.min("sheet_ord").alias("sheet_ord"))
    )


def todos_records(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """P-8."""
    todos = rows.join(_todos_sheets(sheets), SHEET, "left_semi")
    need = {f: C.ROSTER_ALIASES[f] for f in ("empresa", "cidade", "colaborador")}
    keyed = (
        todos.filter("r < 10").withColumn("folded", folded_headers(F.col("cells")))
        .withColumn("k", _column_struct(F.col("folded"), need))
    )
    hit = (F.col("k.empresa") >= 0) & (F.col("k.cidade") >= 0) & (F.col("k.colaborador") >= 0)
    headers = _first_row_with(keyed, hit, F.col("folded"), "folded").select(
        *SHEET, "header_r", _column_struct(F.col("folded"), C.ROSTER_ALIASES).alias("at")
    )
    body = todos.join(headers, SHEET).filter("r > header_r")

    def text(f: str) -> Column:
        return cell_at(F.col("cells"), F.col(f"at.{f}"))

    def number(f: str) -> Column:
        return number_at(F.col("nums"), F.col(f"at.{f}"))

    out = body.select(
        "file", F.col("r").cast("long").alias("row_ord"),
        *[text(f).alias(f) for f in ("empresa", "cidade", "contrato", "colaborador", "banco", "tipo")],
        nonzero(text("total_funcionarios"), number("total_funcionarios")).cast("int").alias("total_funcionarios"),
        F.nullif(text("observacoes"), F.lit("")).alias("observacoes"),
        positive_number(text("salario"), number("salario")).cast(MONEY).alias("salario"),
    ).filter("colaborador <> ''")
    return _as_records(out)


def nonzero(c: Column, num: Column) -> Column:
    """A number other than 0, else NULL."""
    return F.nullif(F.coalesce(num, c.try_cast("double")), F.lit(0.0))


# ---------------------------------------------------------------------------
# City sheets
# ---------------------------------------------------------------------------

def city_sheet_heads(rows: DataFrame) -> DataFrame:
    """Company, city, first data row and salary column of every city sheet."""
    top = rows.filter("r < 4").groupBy(*SHEET).agg(
        F.max("sheet").alias("sheet"),
        *[F.max(F.when(F.col("r") == i, cell_at(F.col("cells"), F.lit(0)))).alias(f"a{i}") for i in range(4)],
        *[F.max(F.when(F.col("r") == i, F.struct(F.col("cells")))).alias(f"row{i}") for i in (2, 3)],
    )
    length = rows.groupBy(*SHEET).agg(F.max("r").alias("last_r"))
    top = top.join(length, SHEET).filter("last_r >= 2").filter(fold_name(F.col("sheet")) != "TODOS")
    blank = F.lit("")
    # Digits do not survive the fold, so COLUNA1 reads COLUNA.
    titled = fold_name(F.coalesce("a0", blank)).rlike("^COLUNAS?$")
    top = top.withColumns(
        {
            "titled": titled,
            "empresa": F.coalesce(F.when(titled, F.col("a1")).otherwise(F.col("a0")), blank),
            "line": F.coalesce(F.when(titled, F.col("a2")).otherwise(F.col("a1")), blank),
        }
    )
    def or_line(c: Column, line: Column) -> Column:
        return F.coalesce(F.nullif(c, blank), line)

    top = top.withColumn("line", or_line(city_of_line(F.col("line")), F.col("line")))
    top = top.withColumn("cidade", or_line(city_of_line(F.col("line")), F.col("line")))
    top = top.filter((F.col("empresa") != "") & (F.col("line") != "") & (F.length("cidade") >= 2))
    start = F.when(F.col("titled"), 4).otherwise(3)
    a3 = F.coalesce("a3", blank)
    skips = let(
        fold_name(a3),
        lambda n: (a3 == "") | n.isin(*C.CITY_SHEET_SKIP_VALUES) | n.startswith("COLUNA"),
    )
    head = F.when(F.col("titled"), F.col("row3.cells")).otherwise(F.col("row2.cells"))
    empty = F.array().cast("array<string>")
    return top.select(
        *SHEET, "sheet", "empresa", "cidade",
        F.when(skips, F.greatest(start, F.lit(4))).otherwise(start).alias("start_r"),
        find_column(F.coalesce(folded_headers(head), empty), C.ROSTER_ALIASES["salario"]).alias("salary_at"),
    )


def city_sheet_rows(rows: DataFrame) -> DataFrame:
    """P-9, P-11 with ``skip_reason``."""
    body = rows.drop("sheet").join(city_sheet_heads(rows), SHEET).filter("r >= start_r")
    body = body.withColumn("raw", cell_at(F.col("cells"), F.lit(0)))
    body = body.withColumns({"norm": fold_name(F.col("raw")), "colaborador": clean_employee(F.col("raw"))})
    n_words = F.size(F.filter(F.split("colaborador", " "), lambda w: F.length(w) >= 2))
    skip = (
        F.when(F.col("raw") == "", "empty_name")
        .when(F.col("norm").isin(*C.CITY_SHEET_SKIP_VALUES), "skip_value")
        .when(F.col("norm").rlike("^(TOTAL|SUBTOTAL|SOMA|COLUNA)"), "skip_pattern")
        .when(F.col("raw").rlike(spaced(r"(?iu)^R\$\s*[\d.,]")), "money")
        .when(looks_like_city(F.col("raw")), "city")
        .when(looks_like_company(F.col("raw")), "company")
        .when(F.length("colaborador") < 3, "short_name")
        .when(n_words < 2, "few_words")
    )
    return body.withColumn("skip_reason", skip)


def city_sheet_records(rows: DataFrame) -> DataFrame:
    """P-9."""
    kept = city_sheet_rows(rows).filter("skip_reason is null")
    out = kept.select(
        "file", (F.shiftleft(F.col("sheet_ord").cast("long"), 32) + F.col("r")).alias("row_ord"), "empresa", "cidade",
        F.col("sheet").alias("contrato"), "colaborador",
        positive_number(cell_at(F.col("cells"), F.col("salary_at")), number_at(F.col("nums"), F.col("salary_at")))
        .cast(MONEY).alias("salario"),
    )
    return _as_records(out)


# ---------------------------------------------------------------------------
# Router
# ---------------------------------------------------------------------------

def route_layouts(headers: DataFrame, validation: DataFrame) -> DataFrame:
    """P-7. (file, layout): payroll first, then a valid TODOS sheet, else city sheets.

    A TODOS sheet with a salary column also fits the payroll rule and is read as
    payroll; pass ``layout`` to ``parse_workbooks`` to choose otherwise.
    """
    payroll = headers.select("file").distinct().withColumn("_p", F.lit(True))
    return validation.join(payroll, "file", "left").select(
        "file",
        F.when(F.col("_p"), LAYOUTS[0]).when(F.col("valid"), LAYOUTS[1]).otherwise(LAYOUTS[2]).alias("layout"),
    )


def parse_workbooks(
    cells: DataFrame, merges: DataFrame | None = None, layout: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P-7: (records, layouts, rejects) of all workbooks of a cell table."""
    if merges is not None:
        cells = fill_merges(cells, merges)
    rows = materialize(grid_rows(cells.filter("value is not null or num is not null")), "grid-rows")
    sheets = rows.groupBy(*SHEET).agg(F.max("sheet").alias("sheet"))
    headers = materialize(payroll_headers(rows), "payroll-headers")
    if layout is None:
        layouts = materialize(route_layouts(headers, validate_todos(rows, sheets)), "layouts")
    else:
        layouts = rows.select("file").distinct().withColumn("layout", F.lit(layout))

    def of(name: str) -> DataFrame:
        return rows.join(layouts.filter(F.col("layout") == name), "file", "left_semi")

    parts = [payroll_records(of(LAYOUTS[0]), headers), todos_records(of(LAYOUTS[1]), sheets), city_sheet_records(of(LAYOUTS[2]))]
    records = materialize(reduce(DataFrame.unionByName, parts), "records")
    empty = layouts.join(records.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit("no employee found").alias("reason")
    )
    blank = cells.select("file").distinct().join(layouts, "file", "left_anti").select(
        "file", F.lit("empty workbook").alias("reason")
    )
    return records, layouts, empty.unionByName(blank)


def skip_reasons(rows: DataFrame) -> DataFrame:
    """A-14."""
    return rows.filter("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("rows"))


def employees_per_city(records: DataFrame, count_blank: bool = True) -> DataFrame:
    """A-1. The payroll layout leaves out the blank city."""
    kept = records if count_blank else records.filter("cidade <> ''")
    return kept.groupBy("cidade").agg(F.count(F.lit(1)).alias("employees"))


def distinct_sorted(records: DataFrame, column: str) -> DataFrame:
    """A-2."""
    return records.select(column).filter(F.col(column) != "").distinct().orderBy(column)
