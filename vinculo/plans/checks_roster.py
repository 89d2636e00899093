"""Registered queries: grids, layouts, registry merge."""

from pyspark.sql import functions as F

from .. import config as C
from ..operators import layouts, merge
from ..operators.scale import carry_forward, materialize
from ..sources import grids
from . import sqltext as S
from .register import big, query
from .roster_import import import_workbooks
from .tables import section_workbook_cells, table, todos_heading_cells, workbook_cells

# ---------------------------------------------------------------------------
# Workbooks built from customers and nations
# ---------------------------------------------------------------------------

_GAP = "CASE WHEN c_custkey % 3 = 0 THEN chr(160) ELSE ' ' END"
_CUST = f"""cust AS (SELECT *, n_nationkey % 3 AS kind, 'wb-' || n_nationkey AS file, {S.initcap('n_name')} AS nat,
        {S.initcap('c_mktsegment')} AS seg, {S.initcap('c_mktsegment')} || {_GAP} || {S.initcap('n_name')} || ' da Silva' AS person,
        c_custkey % 4 = 1 AS numeric_pay, replace(replace(replace(format('{{:,.2f}}', c_acctbal), ',', '_'), '.', ','), '_', '.') AS money
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
#: Text of a whole number that came as a numeric cell; zero is blank.
_WHOLE = "coalesce(nullif(CAST(CAST({0} AS BIGINT) AS VARCHAR), '0'), '')"
_PAY = "CASE WHEN numeric_pay THEN " + _WHOLE.format("round(c_acctbal * 2000)") + " ELSE {0} END"


def _rows(spark, sf):
    return materialize(grids.grid_rows(workbook_cells(spark, sf)), "grid-rows")


def _of_layout(rows, kind):
    return rows.filter(F.substring("file", 4, 9).cast("int") % 3 == kind)


@query(
    f"""WITH {_CUST}, heads AS (SELECT 'wb-' || n_nationkey AS file, n_nationkey AS k, n_nationkey % 3 AS kind, {S.initcap('n_name')} AS nat FROM nation),
    cells AS (SELECT file, c_custkey + 10 AS r, CASE
        WHEN kind = 0 AND c_custkey % 7 = 0 THEN ['Serviço:', '', '6 - Município de ' || seg]
        WHEN kind = 0 THEN [CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 12000000 ELSE c_custkey END AS VARCHAR), person,
            {_PAY.format('money')}, 'R$ ' || money, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '-' END]
        WHEN kind = 1 THEN [seg, nat, CASE WHEN c_custkey % 2 = 0 THEN {_WHOLE.format('c_custkey % 3')} ELSE 'Limpeza - Itaú' END, person, '',
            'Mensal', CASE WHEN c_custkey % 2 = 1 THEN {_WHOLE.format('c_custkey % 4')} ELSE '12' END]
        ELSE [person || ' - PIX 123', {_PAY.format('CAST(c_acctbal AS VARCHAR)')}] END AS cells FROM cust
    UNION ALL SELECT file, 0, [CASE kind WHEN 0 THEN k || ' - Empresa ' || nat ELSE 'Empresa ' || nat END] FROM heads WHERE kind <> 1
    UNION ALL SELECT file, 3, ['Código', 'Nome do Empregado', 'Salário', 'Líquido', 'FGTS'] FROM heads WHERE kind = 0
    UNION ALL SELECT file, 2, ['Empresa', 'Cidade', 'Contrato', 'Colaborador', 'Banco', 'Tipo', 'Total Funcionarios', 'Obs'] FROM heads WHERE kind = 1
    UNION ALL SELECT file, 1, [nat || ' - Sicredi'] FROM heads WHERE kind = 2
    UNION ALL SELECT file, 2, CASE WHEN k % 2 = 1 THEN ['Funcionário', 'Salário'] ELSE ['Funcionário'] END FROM heads WHERE kind = 2)
    SELECT file, CAST(r AS BIGINT) AS r, CAST(len(cells) AS INTEGER) AS filled_to, array_to_string(cells, '|') AS cells FROM cells"""
)
def grid_rows(spark, sf):
    """IO-7: every row with all its cells, headers included."""
    return _rows(spark, sf).select("file", big("r").alias("r"), F.size("cells").alias("filled_to"), F.array_join("cells", "|").alias("cells"))


@query(
    """WITH base AS (SELECT 'wb-' || n_nationkey AS file, n_nationkey AS r0, n_name AS v, n_regionkey AS span FROM nation)
    SELECT file, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CASE WHEN r = r0 AND c = 2 THEN 'own' ELSE v END AS value
    FROM base, range(0, 30) AS rr(r), range(0, 8) AS cc(c) WHERE r BETWEEN r0 AND r0 + span AND c BETWEEN 0 AND span + 1
    UNION ALL SELECT file, r0, 2, 'own' FROM base WHERE span + 1 < 2"""
)
def merged_cells(spark, sf):
    """IO-8: every nation cell merged over a square, one cell of it filled already."""
    n = table(spark, sf, "nation")
    base = n.select(
        F.concat(F.lit("wb-"), F.col("n_nationkey").cast("string")).alias("file"), F.lit(0).alias("sheet_ord"), F.lit("s").alias("sheet"),
        F.col("n_nationkey").alias("r"), F.lit(0).alias("c"), F.col("n_name").alias("value"), F.lit(None).cast("double").alias("num"),
    )
    own = base.withColumns({"c": F.lit(2), "value": F.lit("own")})
    merges = n.select(
        F.concat(F.lit("wb-"), F.col("n_nationkey").cast("string")).alias("file"), F.lit(0).alias("sheet_ord"),
        F.col("n_nationkey").alias("r0"), F.lit(0).alias("c0"), (F.col("n_nationkey") + F.col("n_regionkey")).alias("r1"),
        (F.col("n_regionkey") + 1).alias("c1"),
    )
    out = grids.fill_merges(base.unionByName(own), merges)
    return out.select("file", big("r").alias("r"), big("c").alias("c"), "value")


@query(
    """SELECT 'wb-' || n_nationkey AS file, 'empty workbook' AS reason FROM nation
    WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"""
)
def populated_files(spark, sf):
    """IO-9: nations without a customer of high balance count as empty workbooks."""
    files = table(spark, sf, "nation").select(F.concat(F.lit("wb-"), F.col("n_nationkey").cast("string")).alias("file"))
    cells = table(spark, sf, "customer").select(
        F.concat(F.lit("wb-"), F.col("c_nationkey").cast("string")).alias("file"),
        F.when(F.col("c_acctbal") > 9900, F.col("c_name")).alias("value"), F.lit(None).cast("double").alias("num"),
    )
    return grids.split_populated(cells, files)[1]


@query(
    """SELECT 'wb-' || n_nationkey AS file, CASE n_nationkey % 6 WHEN 1 THEN 'todos' WHEN 4 THEN 'todos' WHEN 2 THEN 'city_sheets'
        ELSE 'payroll' END AS layout FROM nation"""
)
def route_layouts(spark, sf):
    """P-1, P-4, P-7. City sheets with a name and a salary header fit the payroll rule, which comes first."""
    rows = _rows(spark, sf)
    sheets = rows.groupBy("file", "sheet_ord").agg(F.max("sheet").alias("sheet"))
    return layouts.route_layouts(layouts.payroll_headers(rows), layouts.validate_todos(rows, sheets))


_PAYROLL = f"""{_CUST}, pay AS (SELECT *, c_custkey % 7 = 0 AS service FROM cust WHERE kind = 0),
    st AS (SELECT *, last_value(CASE WHEN service THEN seg END IGNORE NULLS) OVER w AS cidade,
        last_value(CASE WHEN service THEN '6 - Município de ' || seg END IGNORE NULLS) OVER w AS contrato
        FROM pay WINDOW w AS (PARTITION BY file ORDER BY c_custkey ROWS UNBOUNDED PRECEDING))"""
_MONEY = [f for f in C.PAYROLL_MONEY_FIELDS if f not in ("salario", "liquido", "fgts")]
_NO_MONEY = ", ".join(f"CAST(NULL AS DOUBLE) AS {f}" for f in _MONEY)
_PAID = "CASE WHEN numeric_pay THEN round(c_acctbal * 2000) ELSE round(c_acctbal, 2) END"


@query(
    f"""WITH {_PAYROLL} SELECT file, CAST(c_custkey + 10 AS BIGINT) AS row_ord, 'Empresa ' || nat AS empresa,
        coalesce(cidade, '') AS cidade, coalesce(contrato, '') AS contrato, person AS colaborador, CAST(NULL AS VARCHAR) AS tipo,
        CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 12000000 ELSE c_custkey END AS VARCHAR) AS codigo,
        {_PAID} AS salario, round(c_acctbal, 2) AS liquido, CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) END AS fgts, {_NO_MONEY}
    FROM st WHERE NOT service"""
)
def payroll_records(spark, sf):
    """P-4 to P-6, P-10, P-11, W-5, W-6, S-20, S-21: all fields of the payroll workbooks."""
    rows = _of_layout(_rows(spark, sf), 0)
    r = layouts.payroll_records(rows, layouts.payroll_headers(rows))
    return r.select(
        "file", "row_ord", "empresa", "cidade", "contrato", "colaborador", "tipo", "codigo",
        *[F.col(f).cast("double").alias(f) for f in C.PAYROLL_MONEY_FIELDS],
    )


@query(f"WITH {_PAYROLL} SELECT 'service' AS skip_reason, count(*) AS rows FROM st WHERE service HAVING count(*) > 0")
def payroll_skip_reasons(spark, sf):
    """A-14."""
    rows = _of_layout(_rows(spark, sf), 0)
    headers = layouts.choose_sheet(layouts.payroll_headers(rows))
    return layouts.skip_reasons(layouts.payroll_rows(rows, headers))


_SECTIONS = f"""sup AS (SELECT s_suppkey AS k, s_suppkey % 8 AS kind, 'ws-' || n_nationkey AS file, {S.initcap('n_name')} AS nat
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    held AS (SELECT *, last_value(CASE WHEN kind = 0 THEN ['Empregados', 'Estagiários', 'Contribuintes'][k // 8 % 3 + 1] END IGNORE NULLS) OVER w AS tipo,
        last_value(CASE WHEN kind = 1 THEN nat END IGNORE NULLS) OVER w AS cidade FROM sup WINDOW w AS (PARTITION BY file ORDER BY k ROWS UNBOUNDED PRECEDING))"""


def _section_rows(spark, sf):
    rows = materialize(grids.grid_rows(section_workbook_cells(spark, sf)), "grid-rows")
    return rows, layouts.payroll_headers(rows)


@query(
    f"""WITH {_SECTIONS} SELECT file, CAST(k + 10 AS BIGINT) AS row_ord, 'Empresa ' || nat AS empresa, coalesce(cidade, '') AS cidade,
        coalesce('6 - Município de ' || cidade, '') AS contrato, 'Pessoa ' || nat || ' da Silva' AS colaborador, tipo, CAST(k AS VARCHAR) AS codigo,
        CAST(1234.5 AS DOUBLE) AS salario FROM held WHERE kind >= 6"""
)
def payroll_sections(spark, sf):
    """W-7, P-5: section headings carried to the persons below them, on the second sheet of a workbook."""
    records = layouts.payroll_records(*_section_rows(spark, sf))
    return records.select("file", "row_ord", "empresa", "cidade", "contrato", "colaborador", "tipo", "codigo", F.col("salario").cast("double").alias("salario"))


@query(
    f"""WITH {_SECTIONS} SELECT ['section', 'service', 'empty_name', 'skip_pattern', 'non_numeric_code', 'few_words'][kind + 1] AS skip_reason,
        count(*) AS rows FROM sup WHERE kind < 6 GROUP BY kind"""
)
def payroll_every_skip_reason(spark, sf):
    """A-14 with every reason."""
    rows, headers = _section_rows(spark, sf)
    return layouts.skip_reasons(layouts.payroll_rows(rows, layouts.choose_sheet(headers)))


@query(
    """WITH n AS (SELECT n_nationkey AS k, ['EMPRESA', 'CIDADE', 'CONTRATO', 'COLABORADOR', 'BANCO'] AS req FROM nation),
    d AS (SELECT *, list_filter(range(0, 5), lambda i: i = k % 5 OR (k % 2 = 1 AND i = k // 5 % 5) OR (k % 3 = 0 AND i = (k + 2) % 5)) AS gone FROM n),
    m AS (SELECT k, CASE WHEN len(gone) <= 2 THEN list_transform(gone, lambda i: req[i + 1]) WHEN k % 7 = 0 THEN [] ELSE req END AS missing FROM d)
    SELECT 'wt-' || k AS file, len(missing) = 0 AS valid, array_to_string(missing, '|') AS missing FROM m"""
)
def todos_missing_headers(spark, sf):
    """U-3, P-1: which required headers a TODOS sheet lacks."""
    rows = materialize(grids.grid_rows(todos_heading_cells(spark, sf, C.REQUIRED_HEADERS)), "grid-rows")
    found = layouts.validate_todos(rows, rows.groupBy("file", "sheet_ord").agg(F.max("sheet").alias("sheet")))
    return found.select("file", "valid", F.array_join("missing_columns", "|").alias("missing"))


@query(
    f"""WITH {_CUST} SELECT file, CAST(c_custkey + 10 AS BIGINT) AS row_ord, seg AS empresa, nat AS cidade,
        CASE WHEN c_custkey % 2 = 0 THEN {_WHOLE.format('c_custkey % 3')} ELSE 'Limpeza - Itaú' END AS contrato, person AS colaborador,
        '' AS banco, 'Mensal' AS tipo, CAST(CASE WHEN c_custkey % 2 = 1 THEN nullif(c_custkey % 4, 0) ELSE 12 END AS INTEGER) AS total_funcionarios,
        CAST(NULL AS VARCHAR) AS observacoes, CAST(NULL AS DOUBLE) AS salario FROM cust WHERE kind = 1"""
)
def todos_records(spark, sf):
    """P-2, P-8, S-22: all fields of the TODOS workbooks."""
    rows = _of_layout(_rows(spark, sf), 1)
    sheets = rows.groupBy("file", "sheet_ord").agg(F.max("sheet").alias("sheet"))
    return layouts.todos_records(rows, sheets).select(
        "file", "row_ord", "empresa", "cidade", "contrato", "colaborador", "banco", "tipo", "total_funcionarios", "observacoes",
        F.col("salario").cast("double").alias("salario"),
    )


_CITY_SHEETS = f"""SELECT file, CAST(c_custkey + 10 AS BIGINT) AS row_ord, 'Empresa ' || nat AS empresa, nat AS cidade,
        nat AS contrato, replace(person, chr(160), ' ') AS colaborador,
        CASE WHEN n_nationkey % 2 = 1 AND c_acctbal > 0 THEN {_PAID} END AS salario FROM cust WHERE kind = 2"""


@query(f"WITH {_CUST} {_CITY_SHEETS}")
def city_sheet_records(spark, sf):
    """P-9, P-11, S-18, S-19, S-22."""
    r = layouts.city_sheet_records(_of_layout(_rows(spark, sf), 2))
    return r.select("file", "row_ord", "empresa", "cidade", "contrato", "colaborador", F.col("salario").cast("double").alias("salario"))


_RECORDS = f"""{_PAYROLL}, rec AS (
        SELECT c_custkey AS ord, 'Empresa ' || nat AS empresa, cidade, contrato, person AS nome,
            CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 12000000 ELSE c_custkey END AS VARCHAR) AS codigo, {_PAID} AS salario
        FROM st WHERE NOT service AND cidade IS NOT NULL
        UNION ALL SELECT c_custkey, seg, nat, CASE WHEN c_custkey % 2 = 0 THEN {_WHOLE.format('c_custkey % 3')} ELSE 'Limpeza - Itaú' END,
            person, NULL, NULL FROM cust WHERE kind = 1
        UNION ALL SELECT c_custkey, 'Empresa ' || nat, nat, nat, replace(person, chr(160), ' '), NULL, NULL FROM cust
        WHERE kind = 2 AND n_nationkey % 2 = 0)"""


@query(
    f"""WITH {_RECORDS}, k AS (SELECT {S.fold('empresa')} AS empresa, {S.fold('cidade')} AS cidade, {S.fold('nome')} AS nome_normalizado,
        min_by(nome, ord) AS nome, min_by(contrato, ord) AS contrato, min_by(coalesce(codigo, ''), ord) AS codigo, count(*) AS copies,
        max_by(salario, ord) FILTER (WHERE salario IS NOT NULL) AS salario FROM rec GROUP BY ALL)
    SELECT empresa, cidade, nome_normalizado, nome, contrato, nullif(codigo, '') AS codigo, copies, true AS ativo, 'insert' AS action, salario,
        CASE WHEN contains(contrato, ' - ') THEN string_split(contrato, ' - ')[-1] END AS banco FROM k"""
)
def workbook_import(spark, sf):
    """P-7 with all layouts, then J-14 to J-16 into an empty registry: its employees with company, city and salary.

    City workbooks with a salary header are read as payroll; they name no city, so their records stay out.
    """
    from ..sources.schemas import REGISTRY

    empty = lambda t: spark.createDataFrame([], REGISTRY[t])
    out, _ = import_workbooks(
        workbook_cells(spark, sf), None, empty("empresas"), empty("municipios"), empty("funcionarios"), empty("funcionarios_salario"),
        F.lit("2026-01-01").cast("timestamp"),
    )
    company = out.companies.select(F.col("id").alias("empresa_id"), F.col("nome_normalizado").alias("empresa"))
    city = out.cities.select(F.col("id").alias("municipio_id"), F.col("nome_normalizado").alias("cidade"))
    paid = out.salaries.select(F.col("funcionario_id").alias("id"), F.col("salario").cast("double").alias("salario"))
    return out.employees.join(company, "empresa_id").join(city, "municipio_id").join(paid, "id", "left").select(
        "empresa", "cidade", "nome_normalizado", "nome", "contrato", "codigo", "copies", "ativo", "action", "salario", "banco"
    )


@query(
    """WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS h FROM documents),
    f AS (SELECT doc_id, list_transform(h, lambda x: """ + S.fold("x") + """) AS h FROM w)
    SELECT doc_id, (CASE
        WHEN list_position(h, 'EN') > 0 THEN list_position(h, 'EN') - 1
        WHEN list_position(h, 'LES') > 0 THEN list_position(h, 'LES') - 1
        WHEN list_position(list_transform(h, lambda x: starts_with(x, 'EN')), true) > 0
            THEN list_position(list_transform(h, lambda x: starts_with(x, 'EN')), true) - 1
        WHEN list_position(list_transform(h, lambda x: starts_with(x, 'LES')), true) > 0
            THEN list_position(list_transform(h, lambda x: starts_with(x, 'LES')), true) - 1
        WHEN list_position(list_transform(h, lambda x: contains(x, 'EN')), true) > 0
            THEN list_position(list_transform(h, lambda x: contains(x, 'EN')), true) - 1
        WHEN list_position(list_transform(h, lambda x: contains(x, 'LES')), true) > 0
            THEN list_position(list_transform(h, lambda x: contains(x, 'LES')), true) - 1
        ELSE -1 END)::BIGINT AS position FROM f"""
)
def find_column(spark, sf):
    """P-2: the words of a document as headers, two aliases."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.split(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), " ").alias("h")
    )
    return d.select("doc_id", F.col("h")).select(
        "doc_id", layouts.folded_headers(F.col("h")).alias("h")
    ).select("doc_id", big(layouts.find_column(F.col("h"), ("En", "Les"))).alias("position"))


@query(
    """SELECT conv_id, CAST(turn AS BIGINT) AS turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations"""
)
def section_carry_forward(spark, sf):
    """W-5 on conversations: a user turn starts a section."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", big(F.length("text"))).alias("section")
    )
    return carry_forward(c, ["conv_id"], "turn", ["section"], blocks=5).select("conv_id", big("turn").alias("turn"), "section")


@query(
    """SELECT o_orderkey, last_value(CASE WHEN o_totalprice > 150000 THEN o_custkey END IGNORE NULLS)
        OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section FROM orders"""
)
def section_carry_forward_large(spark, sf):
    """W-5 with three very large groups, in blocks."""
    o = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderkey", F.when(F.col("o_totalprice") > 150000, F.col("o_custkey")).alias("section")
    )
    return carry_forward(o, ["o_orderstatus"], "o_orderkey", ["section"], blocks=16).select("o_orderkey", "section")


@query(
    f"""WITH {_CUST} SELECT nat AS cidade, count(*) AS employees FROM cust GROUP BY nat"""
)
def employees_per_city(spark, sf):
    """A-1."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return layouts.employees_per_city(c.select(F.initcap("n_name").alias("cidade")))


@query("SELECT DISTINCT p_name AS empresa FROM part WHERE p_name <> ''")
def distinct_sorted(spark, sf):
    """A-2."""
    return layouts.distinct_sorted(table(spark, sf, "part").select(F.col("p_name").alias("empresa")), "empresa")


# ---------------------------------------------------------------------------
# Registry merge
# ---------------------------------------------------------------------------

@query(
    """WITH old AS (SELECT upper(c_mktsegment) AS norm, min(c_custkey) AS id FROM customer GROUP BY 1),
    nw AS (SELECT upper(regexp_replace(regexp_replace(n, '[-]', ' ', 'g'), '[^A-Za-z ]', '', 'g')) AS norm, n, o FROM (
        SELECT lower(c_mktsegment) AS n, c_custkey AS o FROM customer
        UNION ALL SELECT o_orderpriority, o_orderkey + 10000000 FROM orders)),
    f AS (SELECT trim(norm) AS norm, min_by(n, o) AS nome FROM nw GROUP BY 1)
    SELECT f.norm AS nome_normalizado, CASE WHEN old.norm IS NULL THEN sha256(f.norm) ELSE CAST(old.id AS VARCHAR) END AS id,
        CASE WHEN old.norm IS NULL THEN f.nome END AS added FROM f LEFT JOIN old ON f.norm = old.norm"""
)
def dimension_upsert(spark, sf):
    """J-14: market segments are known, order priorities are new."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    now = F.lit("2026-01-01").cast("timestamp")
    existing = c.groupBy(F.upper("c_mktsegment").alias("nome_normalizado")).agg(F.min("c_custkey").cast("string").alias("id"))
    existing = existing.select("id", F.col("nome_normalizado").alias("nome"), "nome_normalizado", F.lit(None).cast("timestamp").alias("created_at"))
    names = c.select(F.lower("c_mktsegment").alias("nome"), F.col("c_custkey").alias("row_ord")).unionByName(
        o.select(F.col("o_orderpriority").alias("nome"), (F.col("o_orderkey") + 10000000).alias("row_ord"))
    )
    new_table, ids = merge.upsert_dimension(existing, names, now)
    added = new_table.filter("created_at is not null").select("nome_normalizado", F.col("nome").alias("added"))
    return ids.join(added, "nome_normalizado", "left")


_MERGE = """
    reg AS (SELECT o_orderpriority AS e, o_orderstatus AS m, 'C' || o_custkey AS nome, CAST(min(o_orderkey) AS VARCHAR) AS id,
        CASE WHEN min(o_orderkey) % 3 = 0 THEN 'ITAU' ELSE '' END AS banco, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'Limpeza - Itau' ELSE 'X' END AS contrato,
        CAST(NULL AS VARCHAR) AS obs, CASE WHEN count(*) > 1 THEN 'K' END AS codigo, min(o_orderkey) % 4 <> 0 AS ativo FROM orders GROUP BY 1, 2, 3),
    rec AS (SELECT o_orderpriority AS e, o_orderstatus AS m, 'C' || (o_custkey + 1) AS nome, o_orderkey AS ord,
        CASE WHEN o_orderkey % 3 = 0 THEN 'itau ' ELSE 'Itau' END AS banco, CASE WHEN o_orderkey % 2 = 0 THEN 'Limpeza - Itau' ELSE 'x' END AS contrato,
        '' AS obs, CASE WHEN o_totalprice > 150000 THEN 'k' ELSE '' END AS codigo FROM orders WHERE o_orderstatus <> 'P'),
    inc AS (SELECT e, m, nome, count(*) AS copies, min_by(banco, ord) AS fb, min_by(contrato, ord) AS fc, min_by(codigo, ord) AS fk,
        max_by(banco, ord) AS lb, max_by(contrato, ord) AS lc, max_by(codigo, ord) AS lk FROM rec GROUP BY 1, 2, 3),
    j AS (SELECT coalesce(reg.e, inc.e) AS empresa_id, coalesce(reg.m, inc.m) AS municipio_id, coalesce(reg.nome, inc.nome) AS nome_normalizado,
        id, banco, contrato, codigo, ativo, inc.* EXCLUDE (e, m, nome),
        nullif(upper(trim(lb)), '') IS NOT DISTINCT FROM nullif(upper(trim(banco)), '')
        AND nullif(upper(trim(lc)), '') IS NOT DISTINCT FROM nullif(upper(trim(contrato)), '')
        AND nullif(upper(trim(lk)), '') IS NOT DISTINCT FROM nullif(upper(trim(codigo)), '') AS same
        FROM reg FULL JOIN inc ON reg.e = inc.e AND reg.m = inc.m AND reg.nome = inc.nome),
    a AS (SELECT *, CASE WHEN id IS NULL THEN 'insert' WHEN copies IS NOT NULL AND NOT ativo THEN 'reactivate'
        WHEN copies IS NOT NULL AND NOT same THEN 'update' WHEN copies IS NOT NULL THEN 'unchanged'
        WHEN ativo AND municipio_id IN (SELECT m FROM rec) THEN 'deactivate' ELSE 'untouched' END AS action FROM j)"""


def _merged(spark, sf, scope="city"):
    o = table(spark, sf, "orders")
    text = lambda v: F.lit(v).cast("string")
    registry = o.groupBy(
        F.col("o_orderpriority").alias("empresa_id"), F.col("o_orderstatus").alias("municipio_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nome_normalizado"),
    ).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("n"))
    at = F.lit("2025-01-01").cast("timestamp")
    registry = registry.select(
        F.col("lo").cast("string").alias("id"), *merge.KEY, F.col("nome_normalizado").alias("nome"), text(None).alias("cargo"),
        F.when(F.col("lo") % 3 == 0, "ITAU").otherwise("").alias("banco"),
        F.when(F.col("hi") % 2 == 0, "Limpeza - Itau").otherwise("X").alias("contrato"), text(None).alias("observacoes"),
        F.when(F.col("n") > 1, "K").alias("codigo"), (F.col("lo") % 4 != 0).alias("ativo"), at.alias("created_at"), at.alias("updated_at"),
    )
    k = F.col("o_orderkey")
    keyed = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderpriority").alias("empresa_id"), F.col("o_orderstatus").alias("municipio_id"),
        F.concat(F.lit("C"), (F.col("o_custkey") + 1).cast("string")).alias("nome_normalizado"),
        F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string")).alias("colaborador"), k.alias("row_ord"),
        F.when(k % 3 == 0, "itau ").otherwise("Itau").alias("banco"),
        F.when(k % 2 == 0, "Limpeza - Itau").otherwise("x").alias("contrato"), F.lit("").alias("observacoes"),
        F.when(F.col("o_totalprice") > 150000, "k").otherwise("").alias("codigo"),
    )
    cities = keyed.select(F.col("municipio_id").alias("id")).distinct()
    return merge.merge_employees(registry, keyed, cities, F.lit("2026-01-01").cast("timestamp"), scope), keyed, cities


@query(
    f"""WITH {_MERGE} SELECT empresa_id, municipio_id, nome_normalizado, action, coalesce(copies, 0) AS copies,
        coalesce(id, sha256(concat_ws('|', empresa_id, municipio_id, nome_normalizado))) AS id,
        CASE action WHEN 'insert' THEN fb WHEN 'update' THEN lb WHEN 'reactivate' THEN lb ELSE banco END AS banco,
        CASE action WHEN 'insert' THEN fc WHEN 'update' THEN lc WHEN 'reactivate' THEN lc ELSE contrato END AS contrato,
        CASE action WHEN 'insert' THEN nullif(fk, '') WHEN 'update' THEN nullif(lk, '') WHEN 'reactivate' THEN nullif(lk, '')
            ELSE codigo END AS codigo,
        CASE WHEN action IN ('insert', 'update', 'reactivate') THEN true WHEN action = 'deactivate' THEN false ELSE ativo END AS ativo
    FROM a"""
)
def registry_merge(spark, sf):
    """J-15, U-2."""
    return _merged(spark, sf)[0].select(
        *merge.KEY, "action", "copies", "id", "banco", "contrato", "codigo", "ativo"
    )


@query(
    f"""WITH {_MERGE} SELECT count(DISTINCT empresa_id) FILTER (WHERE copies IS NOT NULL) AS empresas,
        count(DISTINCT municipio_id) FILTER (WHERE copies IS NOT NULL) AS municipios, count(*) FILTER (WHERE action = 'insert') AS novos,
        count(*) FILTER (WHERE action IN ('update', 'reactivate')) AS atualizados, count(*) FILTER (WHERE action = 'deactivate') AS removidos,
        CAST(sum(copies) AS BIGINT) AS total, CAST(sum(copies - 1) AS BIGINT) AS duplicados FROM a"""
)
def merge_stats(spark, sf):
    """A-4."""
    merged, keyed, cities = _merged(spark, sf)
    companies = keyed.select("empresa_id").distinct()
    return merge.sync_stats(merged, companies, cities, keyed)


@query(
    f"""WITH {_MERGE} SELECT CASE WHEN action = 'deactivate' AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.e = empresa_id AND rec.m = municipio_id)
        THEN 'untouched' ELSE action END AS action, count(*) AS rows FROM a GROUP BY 1"""
)
def merge_company_scope(spark, sf):
    """J-15 with deactivation by company and city."""
    return _merged(spark, sf, "company_city")[0].groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH nw AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS salario FROM orders GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS funcionario_id, round(coalesce(nw.salario, c_acctbal), 2) AS salario
    FROM customer LEFT JOIN nw ON c_custkey = o_custkey"""
)
def salary_upsert(spark, sf):
    """J-16: balances are the stored salaries, the last order of a customer brings a new one."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = lambda k: [F.lit("e").alias("empresa_id"), F.lit("m").alias("municipio_id"), k.cast("string").alias("nome_normalizado")]
    money = lambda v, n: v.cast("decimal(18,2)").alias(n)
    rest = [F.lit(None).cast("decimal(18,2)").alias(f) for f in C.PAYROLL_MONEY_FIELDS[1:]]
    stored = c.select(F.col("c_custkey").cast("string").alias("funcionario_id"), money(F.col("c_acctbal"), "salario"), *rest)
    keyed = o.select(*key(F.col("o_custkey")), F.col("o_orderkey").alias("row_ord"), money(F.col("o_totalprice"), "salario"), *rest)
    ids = c.select(F.col("c_custkey").cast("string").alias("id"), *key(F.col("c_custkey")))
    return merge.upsert_salaries(stored, keyed, ids).select("funcionario_id", F.col("salario").cast("double").alias("salario"))


@query(
    """SELECT c_custkey AS id, c_custkey % 2 = 0 AS has_salary FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
)
def cascade_delete(spark, sf):
    """J-17."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    salaries = c.filter("id % 2 = 0").select(F.col("id").alias("funcionario_id"))
    ids = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    left, paid = merge.delete_employees(c, salaries, ids)
    paid = paid.select(F.col("funcionario_id").alias("id"), F.lit(True).alias("has_salary"))
    return left.join(paid, "id", "left").withColumn("has_salary", F.coalesce("has_salary", F.lit(False)))
