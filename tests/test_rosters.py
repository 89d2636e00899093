"""Workbook layouts, merges, lookups and policies on small hand-made inputs."""

from pyspark.sql import functions as F

from vinculo.operators import enrich, layouts, merge, policy
from vinculo.operators.scale import carry_forward, cell_join, number_rows, rank_slice, running_offset
from vinculo.plans.roster_import import sync_records
from vinculo.sources import pages as P
from vinculo.sources.schemas import CELLS, MERGES, REGISTRY


def sheet(file, ord_, name, rows):
    return [
        (file, ord_, name, r, c, str(v), None)
        for r, row in rows.items() for c, v in enumerate(row) if v not in ("", None)
    ]


TODOS = {1: ["Empresa", "Cidade", "Contrato", "Colaborador", "Banco"], 2: ["ACME", "Canoas", "Limpeza - Itaú", "Ana Lima", ""],
         3: ["ACME", "Ivoti", "01", "", "BB"]}
PAYROLL = {
    0: ["2 - B SERVICE LTDA"], 2: ["Código", "Nome", "Salário", "Líquido"], 3: ["Serviço:", "", "6 - Município de Canoas"],
    4: ["EMPREGADOS"], 5: ["001.0", "Maria da Silva", "R$ 1.234,56", "-"], 6: ["", "TOTAL GERAL", "9"], 7: ["X9", "Joao Souza"],
    8: ["7-CAMARA LTDA"], 9: ["12", "Rita Souza", "0"], 10: ["13", "Li", "1"], 11: ["14", "Umapalavra", "1"],
}
CITY_A = {0: ["COLUNA1"], 1: ["ACME"], 2: ["CANOAS - ITAU"], 3: ["Lista"], 4: ["Jose Souza - PIX 51"], 5: ["TOTAL 3"], 6: ["ACME LTDA"]}
CITY_B = {0: ["ACME"], 1: ["IFRS - IVOTI"], 2: ["Pessoal"], 3: ["Rita Lima (51) 99999-1234"], 4: ["R$ 12,00"]}


def test_layouts(spark):
    cells = (
        sheet("todos", 0, "Todos", TODOS) + sheet("pay", 0, "Capa", {0: ["x"], 1: ["y"], 2: ["z"]}) + sheet("pay", 1, "Folha", PAYROLL)
        + sheet("city", 0, "Canoas", CITY_A) + sheet("city", 1, "Ivoti", CITY_B) + [("empty", 0, "Plan1", 0, 0, None, None)]
        + sheet("none", 0, "Plan1", {0: ["a"], 1: ["b"], 2: ["c"], 3: ["d"]})
    )
    records, chosen, rejects = layouts.parse_workbooks(spark.createDataFrame(cells, CELLS))
    assert {r.file: r.layout for r in chosen.collect()} == {"todos": "todos", "pay": "payroll", "city": "city_sheets", "none": "city_sheets"}
    assert {r.file: r.reason for r in rejects.collect()} == {"empty": "empty workbook", "none": "no employee found"}
    got = sorted((r.file, r.empresa, r.cidade, r.contrato, r.colaborador, r.codigo, r.tipo, r.salario and float(r.salario)) for r in records.collect())
    assert got == [
        ("city", "ACME", "CANOAS", "Canoas", "Jose Souza", None, None, None),
        ("city", "ACME", "IVOTI", "Ivoti", "Rita Lima", None, None, None),
        ("pay", "B SERVICE LTDA", "", "7-CAMARA LTDA", "Rita Souza", "12", "Empregados", 0),
        ("pay", "B SERVICE LTDA", "Canoas", "6 - Município de Canoas", "Maria da Silva", "001", "Empregados", 1234.56),
        ("todos", "ACME", "Canoas", "Limpeza - Itaú", "Ana Lima", None, "", None),
    ]


def test_merged_cells_and_validation(spark):
    cells = spark.createDataFrame(sheet("f", 0, "Todos", {0: ["Empresa", "", "Cidade", "Banco"], 1: ["A"]}), CELLS)
    merges = spark.createDataFrame([("f", 0, 0, 0, 0, 1), ("f", 0, 1, 0, 2, 0)], MERGES)
    from vinculo.sources.grids import fill_merges, grid_rows

    rows = grid_rows(fill_merges(cells, merges))
    assert sorted((r.r, list(r.cells)) for r in rows.collect()) == [(0, ["Empresa", "Empresa", "Cidade", "Banco"]), (1, ["A"]), (2, ["A"])]
    sheets = rows.groupBy("file", "sheet_ord").agg(F.max("sheet").alias("sheet"))
    v = layouts.validate_todos(rows, sheets).first()
    assert not v.valid and sorted(v.missing_columns) == ["COLABORADOR", "CONTRATO"]


def records(spark, rows):
    return spark.createDataFrame(rows, "row_ord long, empresa string, cidade string, contrato string, colaborador string, banco string, "
                                       "observacoes string, codigo string, salario int").withColumn("salario", F.col("salario").cast("decimal(18,2)")).select(
        "*", *[F.lit(None).cast("decimal(18,2)").alias(c) for c in ("outros_proventos", "salario_familia", "inss", "irrf", "outros_descontos", "liquido", "fgts")])


def test_sync_twice(spark):
    empty = {t: spark.createDataFrame([], REGISTRY[t]) for t in REGISTRY}
    now = F.lit("2026-01-01").cast("timestamp")
    first = records(spark, [
        (0, "Acme", "Canoas", "Limpeza - Itaú", "Ana Lima", None, None, "1", 10), (1, "ACME", "Canoas", "x", "José Souza", "BB", None, None, None),
        (2, "Outra", "Canoas", "x", "Rita Alves", None, None, None, 5), (3, "", "Canoas", "x", "Sem Empresa", None, None, None, None),
    ])
    a = sync_records(first, empty["empresas"], empty["municipios"], empty["funcionarios"], empty["funcionarios_salario"], now)
    assert a.stats.first().asDict() == {"empresas": 2, "municipios": 1, "novos": 3, "atualizados": 0, "removidos": 0, "total": 4, "duplicados": 0}
    assert {r.nome: r.banco for r in a.employees.collect()} == {"Ana Lima": "Itaú", "José Souza": "BB", "Rita Alves": None}
    registry = a.employees.drop("action", "copies")
    second = records(spark, [(0, "ACME", "canoas", " limpeza - itaú ", "ANA LIMA", None, None, "1", None), (1, "Acme", "Canoas", "y", "Jose Souza", "BB", None, None, 7)])
    b = sync_records(second, a.companies, a.cities, registry, a.salaries, now)
    got = {r.nome: (r.action, r.ativo) for r in b.employees.collect()}
    assert got == {"Ana Lima": ("unchanged", True), "José Souza": ("update", True), "Rita Alves": ("deactivate", False)}
    assert sorted(float(r.salario) for r in b.salaries.collect()) == [5, 7, 10]
    c = sync_records(second, a.companies, a.cities, registry, a.salaries, now, scope="company_city")
    assert {r.nome: r.action for r in c.employees.collect()}["Rita Alves"] == "untouched"
    d = sync_records(first, b.companies, b.cities, b.employees.drop("action", "copies"), b.salaries, now)
    assert {r.nome: r.action for r in d.employees.collect()}["Rita Alves"] == "reactivate"


def test_roster_lookup(spark):
    roster = spark.createDataFrame(
        [(0, "EMPRESA A", "CIDADE A", "001", "DIOVANA DA SILVA"), (1, "EMPRESA B", "CIDADE B", "002", "GIOVANA SIDES DA SILVA"),
         (2, "EMPRESA C", "CIDADE C", "003", "MARIA SOUZA"), (3, "EMPRESA D", "CIDADE D", "004", "MARIA SOUZA")],
        "row_ord int, empresa string, cidade string, contrato string, colaborador string",
    )
    names = spark.createDataFrame([("Diovana da Silva",), ("MARIA SOUZA",), ("CARLOS ROBERTO",), ("GIOVANA X SILVA",)], "name string")
    got = {r.name: r.empresa for r in enrich.roster_lookup(names, roster).collect()}
    assert got == {"Diovana da Silva": "EMPRESA A", "MARIA SOUZA": "EMPRESA C", "CARLOS ROBERTO": None, "GIOVANA X SILVA": "EMPRESA B"}


def test_ip_and_allow_list(spark):
    ips = ["1.2.3.4", "1.2.3.256", "::1", "1.2.3", "fe80::1:2", "x"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert [r.ok for r in df.select(policy.well_formed_ip(F.col("ip")).alias("ok")).collect()] == [True, False, True, False, True, False]


def test_blocked_windows_equal_plain_windows(spark):
    rows = [(g, o, o % 7 == 0 and o or None, o % 5) for g in ("a", "b", None) for o in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "g string, o int, v int, n int")
    got = sorted((str(r.g), r.o, r.v) for r in carry_forward(df, ["g"], "o", ["v"], blocks=7).collect())
    want, last = [], {}
    for g, o, v, _ in rows:
        last[g] = v if v is not None else last.get(g)
        want.append((str(g), o, last[g]))
    assert got == sorted(want)
    got = sorted((str(r.g), r.o, r.s) for r in running_offset(df, ["g"], "o", "n", "s", blocks=7).collect())
    want, total = [], {}
    for g, o, _, n in rows:
        want.append((str(g), o, total.get(g, 0)))
        total[g] = total.get(g, 0) + n
    assert got == sorted(want)


def test_blocks_are_cut_by_rows(spark):
    # Order values lie 2^20 apart: blocks of values would hold one row each.
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * (1 << 20)).alias("o"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))
    done = carry_forward(df, ["g"], "o", ["v"], blocks=8)
    sizes = [r["count"] for r in done.withColumn("k", F.floor(F.col("o") / (1 << 20) / 2500)).groupBy("k").count().collect()]
    assert sum(sizes) == 20_000
    want = F.when(F.col("o") >= 7 << 20, F.floor((F.col("o") / (1 << 20) - 7) / 1000) * 1000 + 7)
    assert done.filter(~F.col("v").eqNullSafe(want.cast("long"))).isEmpty()
    plan = done._jdf.queryExecution().executedPlan().toString()
    # What is read back is one row per block for the window over the group.
    assert "carried" in plan and plan.count("Window ") <= 2


def test_pages_by_rank(spark):
    df = spark.createDataFrame([((k * 7919) % 3001 if k % 50 else None, k % 3, str(k)) for k in range(3001)], "a int, b int, c string").repartition(5)
    rows = sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b, r.c))
    for first, size in ((0, 10), (55, 20), (1490, 33), (2995, 50), (4000, 5)):
        got = rank_slice(df, ["a", "b", "c"], first, size, rows=100, ranges=8).collect()
        assert got == rows[first : first + size]
    same = spark.range(500).select(F.lit(1).alias("a"), "id")
    assert rank_slice(same, ["a"], 120, 30, rows=50, ranges=4).count() == 30
    assert rank_slice(df.limit(0), ["a"], 0, 5).count() == 0


def test_cell_join_and_numbering(spark):
    a = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    b = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    got = cell_join(a, b, ["k"], 100).select("k", "a", "b")
    want = a.join(b, "k")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    numbered = number_rows(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(6), F.col("x"))
    assert numbered.filter("index <> x + 1").isEmpty() and numbered.count() == 5000


def test_reading_order(spark):
    items = [("f", 1, 0, 50.0, 700.0, 10.0, "Silva"), ("f", 1, 1, 10.0, 702.0, 10.0, "Ana"), ("f", 1, 2, 10.0, 680.0, 10.0, "CPF"), ("f", 1, 3, 0.0, 690.0, 10.0, " ")]
    df = spark.createDataFrame(items, "file_id string, page_no int, seq int, x double, y double, h double, str string")
    assert P.reading_order(df).first().text == "Ana Silva CPF"
