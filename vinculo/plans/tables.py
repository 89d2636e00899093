"""Inputs of the registered queries, derived row by row from the driver tables.

The driver tables hold no pay slips, so names, slips, receipts and workbooks
are built from their columns. Every function reads a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold_name, let, words
from ..operators.scale import spread


TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def text_name(text: Column) -> Column:
    """A three-word name of a text: its first, middle and last word of three letters or more."""
    return let(
        words(fold_name(text), 3),
        lambda w: F.when(
            F.size(w) > 0,
            F.concat_ws(
                " ", F.get(w, F.lit(0)), F.get(w, F.floor(F.size(w) / 2).cast("int")), F.get(w, F.size(w) - 1)
            ),
        ).otherwise(F.lit("")),
    )


def named_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, file_ord, n_chars, name."""
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id", "source", F.substring("source", 4, 9).cast("int").alias("file_ord"), "n_chars",
        text_name(F.col("text")).alias("name"),
    )


def altered(name: Column, n: Column) -> Column:
    """A name as another paper may show it: same, cut, without the middle word, one letter off, turned round."""
    w = F.split(name, " ")
    first, last = F.get(w, F.lit(0)), F.get(w, F.lit(2))
    k = n % 5
    return (
        F.when(k == 0, name)
        .when(k == 1, F.trim(F.left(name, F.greatest(F.length(name) - 2, F.lit(1)))))
        .when(k == 2, F.concat_ws(" ", first, last))
        .when(k == 3, F.concat_ws(" ", F.concat(F.left(first, F.length(first) - 1), F.lit("E")), F.get(w, F.lit(1)), last))
        .otherwise(F.concat_ws(" ", last, F.get(w, F.lit(1)), first))
    )


def name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, target, candidate."""
    d = named_documents(spark, folder)
    return d.select("doc_id", F.col("name").alias("target"), altered(F.col("name"), F.col("n_chars")).alias("candidate"))


def slip_pages(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """One labelled slip per document, one file per source. ``names`` is what ``named_documents`` gives, if it is at hand."""
    d = named_documents(spark, folder) if names is None else names
    return d.select(
        F.concat(F.lit("slip-"), "source").alias("file_id"), F.concat("source", F.lit(".pdf")).alias("file_name"),
        "file_ord", F.col("doc_id").cast("int").alias("page_no"),
        F.concat(
            F.lit("Folha Mensal Nome do Funcionário: "), F.initcap("name"), F.lit(" CPF: 123.456.789-00 Matrícula "),
            F.col("doc_id").cast("string"),
        ).alias("text"),
    )


def receipt_pages(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """One receipt per document: three in four with a payee label, the others with the bare name."""
    d = named_documents(spark, folder) if names is None else names
    payee = altered(F.col("name"), F.col("n_chars"))
    labelled = F.concat(F.lit("Comprovante de transferência Favorecido: "), F.initcap(payee), F.lit(" 12/05 R$ 10,00"))
    bare = F.concat(F.lit("Pago a "), F.initcap("name"), F.lit(" em 12/05"))
    return d.select(
        F.concat(F.lit("receipt-"), "source").alias("file_id"), F.concat("source", F.lit(".pdf")).alias("file_name"),
        "file_ord", F.col("doc_id").cast("int").alias("page_no"),
        F.when(F.col("n_chars") % 4 < 3, labelled).otherwise(bare).alias("text"),
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as receipt pages, whole texts, one file per source."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("source").alias("file_id"), F.col("source").alias("file_name"),
        F.substring("source", 4, 9).cast("int").alias("file_ord"), F.col("doc_id").cast("int").alias("page_no"), "text",
    )


def benchmark_employees(spark: SparkSession, folder: str) -> DataFrame:
    """Employees named by the benchmark texts."""
    b = table(spark, folder, "benchmark")
    return b.select(
        F.col("item_id").alias("emp_ord"), text_name(F.col("text")).alias("name"), text_name(F.col("text")).alias("norm"),
        F.lit("benchmark").alias("slip_file"), F.col("item_id").cast("int").alias("slip_page"),
    )


# ---------------------------------------------------------------------------
# Workbooks: one file per nation; the nation key decides the layout
# ---------------------------------------------------------------------------

def workbook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a nation as one workbook: payroll, TODOS or city sheets by nation key modulo 3.

    Every third person's name holds a no-break space, codes, contracts and money
    are numeric cells for some rows (eight digits and more, and zero) and text
    for the others. City sheets of even nations have no salary column.
    """
    n = table(spark, folder, "nation").select(
        F.concat(F.lit("wb-"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_nationkey"), "n_name"
    )
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    money = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    key = F.col("c_custkey")
    gap = F.when(key % 3 == 0, F.lit("\u00a0")).otherwise(F.lit(" "))
    person = F.concat(F.initcap("c_mktsegment"), gap, F.initcap("n_name"), F.lit(" da Silva"))
    r = key.cast("int") + 10

    def text(v: Column) -> Column:
        return F.struct(v.cast("string").alias("value"), F.lit(None).cast("double").alias("num"))

    def number_if(test: Column, num: Column, other: Column) -> Column:
        return F.struct(F.when(~test, other.cast("string")).alias("value"), F.when(test, num.cast("double")).alias("num"))

    def cells(df: DataFrame, sheet: Column, row: Column, values: list[Column]) -> DataFrame:
        at = F.posexplode(F.array(*values)).alias("c", "v")
        return df.select("file", F.lit(0).alias("sheet_ord"), sheet.alias("sheet"), row.cast("int").alias("r"), at).select(
            "file", "sheet_ord", "sheet", "r", "c", "v.value", "v.num"
        )

    def line(*values: str) -> list[Column]:
        return [text(F.lit(v)) for v in values]

    kind = F.col("n_nationkey") % 3
    lit = F.lit
    payroll, todos, city = n.filter(kind == 0), n.filter(kind == 1), n.filter(kind == 2)
    p, t, s = c.filter(kind == 0), c.filter(kind == 1), c.filter(kind == 2)
    sheet_p, sheet_t, sheet_s = lit("Folha"), lit("Todos"), F.initcap("n_name")
    # In payroll files a customer whose key is a multiple of seven stands for a service line.
    service = key % 7 == 0
    pay = number_if(key % 4 == 1, F.round(F.col("c_acctbal") * 2000), money)
    parts = [
        cells(payroll, sheet_p, lit(0), [text(F.concat(F.col("n_nationkey").cast("string"), lit(" - Empresa "), F.initcap("n_name")))]),
        cells(payroll, sheet_p, lit(3), line("Código", "Nome do Empregado", "Salário", "Líquido", "FGTS")),
        cells(p.filter(service), sheet_p, r, [*line("Serviço:", ""), text(F.concat(lit("6 - Município de "), F.initcap("c_mktsegment")))]),
        cells(
            p.filter(~service), sheet_p, r,
            [number_if(key % 2 == 0, key + 12_000_000, key), text(person), pay, text(F.concat(lit("R$ "), money)),
             number_if(key % 5 == 0, lit(0), lit("-"))],
        ),
        cells(todos, sheet_t, lit(2), line("Empresa", "Cidade", "Contrato", "Colaborador", "Banco", "Tipo", "Total Funcionarios", "Obs")),
        cells(
            t, sheet_t, r,
            [text(F.initcap("c_mktsegment")), text(F.initcap("n_name")), number_if(key % 2 == 0, key % 3, lit("Limpeza - Itaú")), text(person),
             text(lit("")), text(lit("Mensal")), number_if(key % 2 == 1, key % 4, lit("12")), text(lit(""))],
        ),
        cells(city, sheet_s, lit(0), [text(F.concat(lit("Empresa "), F.initcap("n_name")))]),
        cells(city, sheet_s, lit(1), [text(F.concat(F.initcap("n_name"), lit(" - Sicredi")))]),
        cells(city.filter("n_nationkey % 2 = 1"), sheet_s, lit(2), line("Funcionário", "Salário")),
        cells(city.filter("n_nationkey % 2 = 0"), sheet_s, lit(2), line("Funcionário")),
        cells(s, sheet_s, r, [text(F.concat(person, lit(" - PIX 123"))), number_if(key % 4 == 1, F.round(F.col("c_acctbal") * 2000), F.col("c_acctbal"))]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("value <> '' or num is not null")


def _sheet_cells(df: DataFrame, sheet_ord: int, sheet: str, row: Column, values: Column) -> DataFrame:
    """Cells of one row per row of ``df(file)`` from an array of texts; blank ones are left out."""
    at = df.select("file", row.cast("int").alias("r"), F.posexplode(values).alias("c", "value")).filter("value <> ''")
    return at.select("file", F.lit(sheet_ord).alias("sheet_ord"), F.lit(sheet).alias("sheet"), "r", "c", "value", F.lit(None).cast("double").alias("num"))


def section_workbook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of a nation as a payroll workbook with a cover sheet, and with every kind of row by key modulo 8.

    Section headings, service lines, names that are too short, totals, codes
    that aren't numbers, names of one word, and persons.
    """
    n = table(spark, folder, "nation").select(F.concat(F.lit("ws-"), F.col("n_nationkey").cast("string")).alias("file"), "n_nationkey", F.initcap("n_name").alias("nat"))
    s = table(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 8
    row = lambda *values: F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])
    code = key.cast("string")
    heading = F.element_at(row("EMPREGADOS", "Estagiarios", "CONTRIBUINTE"), (F.floor(key / 8) % 3 + 1).cast("int"))
    values = (
        F.when(kind == 0, row(heading))
        .when(kind == 1, row("Serviço:", "", F.concat(F.lit("6 - Município de "), F.col("nat"))))
        .when(kind == 2, row(code, "Li"))
        .when(kind == 3, row("", "Total geral do mes"))
        .when(kind == 4, row("X9", "Joao Souza"))
        .when(kind == 5, row(code, "Umapalavra"))
        .otherwise(row(code, F.concat(F.lit("Pessoa "), F.col("nat"), F.lit(" da Silva")), "1.234,50"))
    )
    cover = [_sheet_cells(n, 0, "Capa", F.lit(k), row(v)) for k, v in enumerate(("Relatorio", "Folha do mes", "x"))]
    parts = [
        *cover, _sheet_cells(n, 1, "Folha", F.lit(0), row(F.concat(F.lit("7 - Empresa "), F.col("nat")))),
        _sheet_cells(n, 1, "Folha", F.lit(2), row("Código", "Nome", "Salário")), _sheet_cells(s, 1, "Folha", key + 10, values),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def todos_heading_cells(spark: SparkSession, folder: str, headers: tuple[str, ...]) -> DataFrame:
    """One TODOS sheet per nation whose first heading row lacks one to three headers by the nation's key; every seventh has a full row further down."""
    n = table(spark, folder, "nation").select(F.concat(F.lit("wt-"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_nationkey").alias("k"))
    k = F.col("k")
    dropped = F.array(k % 5, F.when(k % 2 == 1, F.floor(k / 5) % 5), F.when(k % 3 == 0, (k + 2) % 5))
    some = F.array(*[F.when(F.coalesce(F.array_contains(F.array_compact(dropped), F.lit(i).cast("long")), F.lit(False)), "Obs").otherwise(F.initcap(F.lit(h))) for i, h in enumerate(headers)])
    full = F.array(*[F.lit(h) for h in headers])
    return _sheet_cells(n, 0, "Todos", F.lit(1), some).unionByName(_sheet_cells(n.filter(k % 7 == 0), 0, "Todos", F.lit(4), full)).unionByName(
        _sheet_cells(n, 0, "Todos", F.lit(6), F.array(F.lit("Acme")))
    )
