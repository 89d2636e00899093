"""Golden cases of folds, scores, extraction and cells."""

import pytest
from pyspark.sql import functions as F

from vinculo.functions import extract, fold, present, roster, similarity

PAIRS = [
    ("SIMONE CARVALHO PADILHA", "JULIANA MARIELI DE CARVALHO", False),
    ("DIOVANA DA SILVA", "GIOVANA SIDES DA SILVA", False),
    ("CARMEM OLIVEIRA DA SILVA", "TATIANE OLIVEIRA DA SILVA", False),
    ("MARIA SILVA", "MARTA SILVA", False),
    ("BEATRIZ GALL DA SILVA", "JESSICA DAIANA ELIAS DA SILVA", False),
    ("NIURA LUIZA SOARES", "IVONEI SOARES", False),
    ("JOAO DA SILVA", "JOAO DA SILVA", True),
    ("JOAO CARLOS SILVA", "JOAO PEREIRA SILVA", True),
    ("JOICE BEATRIZ MEES", "JOICI BEATRIZ MEES", True),
    ("GISELE APARECIDA SILVA SOARES", "GISELA APARECIDA SILVA SOARES", True),
    ("KELLI CRISTINA MONTEIRO", "KELLY CRISTINA MONTEIRO", True),
    ("ANA CRISTINA PEREIRA DOS SANTOS", "ANA CRISTINA PEREIRA DOS SANTO", True),
    ("CARLA SIMONE DA SILVEIRA FERNANDES", "CARLA SIMONE DA SILVEIRA FERNA", True),
    ("PAMELA MAURILIA DA ROSA CONCEICAO", "PAMELA MAURILIA DA ROSA CONCEI", True),
    ("GERTRUDES BERNARDINO DE OLIVEIRA", "GERTRUDES BERNARDINO DE OLIVEI", True),
    ("JOAO DA SILVA", "JOAO DA COSTA", False),
]


def test_match_decisions(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, want boolean")
    got = similarity.with_match_score(df, "a", "b").withColumn("got", F.col("score") >= 0.85).collect()
    assert [(r.a, r.b) for r in got if r.got != r.want] == []


def test_score_reasons(spark):
    df = spark.createDataFrame([("SIMONE PADILHA", "JULIANA PADILHA"), ("MARIA SILVA", "MARTA SILVA")], "a string, b string")
    one, two = similarity.with_match_score(df, "a", "b").collect()
    assert one.score == 0 and one.reason.startswith("PRIMEIRO NOME DIFERENTE")
    assert round(two.score, 4) == 0.8259 and two.reason == "CANDIDATO PARCIAL (0.83)"


@pytest.mark.parametrize(
    "a, b, ok",
    [
        ("JOAO", "JOAO", True), ("JOICE", "JOICI", True), ("GISELE", "GISELA", True), ("KELLI", "KELLY", True),
        ("DATANE", "DAIANE", True), ("SIMONE", "JULIANA", False), ("CARMEM", "TATIANE", False),
        ("MARIA", "ROSELAINE", False), ("DIOVANA", "GIOVANA", False),
    ],
)
def test_first_names(spark, a, b, ok):
    df = spark.createDataFrame([(a, b)], "a string, b string").withColumn("jw", similarity.jaro_winkler(F.col("a"), F.col("b")))
    assert df.select(similarity.first_names_pass(F.col("a"), F.col("b"), F.col("jw")).alias("ok")).first().ok is ok


FOLDS = [
    ("DENIZE BERNARDES", "DENIZE BERNARDES"), ("DENIZE\tBERNARDES", "DENIZE BERNARDES"),
    ("DENIZE\r\nBERNARDES", "DENIZE BERNARDES"), ("DENIZE​BERNARDES", "DENIZEBERNARDES"),
    ("DENIZE‍BERNARDES", "DENIZEBERNARDES"), ("﻿DENIZE", "DENIZE"), ("BERNAR­DES", "BERNARDES"),
    ("João da Silva", "JOAO DA SILVA"), ("João", "JOAO"), ("DENIZE   BERNARDES   BARCELLA", "DENIZE BERNARDES BARCELLA"),
    ("JOAO.SILVA123", "JOAOSILVA"), ("D'Ávila-Straße", "D AVILA STRASSE"),
]


def test_folds(spark):
    df = spark.createDataFrame(FOLDS, "raw string, want string").withColumn("got", fold.fold_name(F.col("raw")))
    assert [tuple(r) for r in df.filter("got <> want").collect()] == []
    for raw, want in FOLDS:
        assert fold.fold_constant(raw) == want
    ocr = [("J0AO", "JOAO"), ("S1LVA", "SILVA"), ("5OARES", "OARES"), ("RO5A", "ROSA"), ("A0A0A", "AOAA")]
    df = spark.createDataFrame(ocr, "raw string, want string").withColumn("got", fold.fold_name_ocr(F.col("raw")))
    assert [tuple(r) for r in df.filter("got <> want").collect()] == []


def test_code_points(spark):
    df = spark.createDataFrame([("A B ",)], "t string").select(fold.code_points(F.col("t")).alias("p"))
    assert df.first().p == "A(41) \\u00A0 B(42) ·(20)"


PAGES = [
    ("Nome do Funcionário: Maria Souza Lima CPF 123", "MARIA SOUZA LIMA", []),
    ("AGOSTO DE 2025 83 CLEUSA CORREA DA SILVA 514215 x", "CLEUSA CORREA DA SILVA", []),
    ("FAVORECIDO: JOAO DA SILVA CPF 123.456.789", "JOAO DA SILVA", ["JOAO DA SILVA CPF"]),
    ("TITULAR DA CONTA ANA LIMA CPF:", "TITULAR DA CONTA ANA LIMA", ["DA CONTA ANA LIMA"]),
    ("FAVORECIDO: JOSE SOUZA VALOR 9 BENEFICIARIO ANA LIMA BANCO", "ANA LIMA BANCO", ["JOSE SOUZA", "ANA LIMA BANCO"]),
    ("FAVORECIDO JOSE LIMA x9", None, ["JOSE LIMA"]),
    ("12/05 9", None, []),
]


def test_extraction(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in PAGES], "t string").coalesce(1)
    rows = df.select("t", extract.employee_name(F.col("t")).alias("n"), extract.payee_names(F.col("t")).alias("p")).collect()
    got = {r.t: (r.n, r.p) for r in rows}
    for text, name, payees in PAGES:
        if name is not None:
            assert got[text][0] == name
        assert got[text][1] == payees


def test_positions_and_tax_id(spark):
    df = spark.createDataFrame([("ANANANA", "ANA"), ("AAA", "AA"), ("b", "A")], "t string, n string").coalesce(1)
    assert [r.p for r in df.select(extract.positions_of(F.col("t"), F.col("n")).alias("p")).collect()] == [[0, 2, 4], [0, 1], []]
    df = spark.createDataFrame([("cpf 123.456.789-01 x",), ("none",)], "t string").coalesce(1)
    assert [r.c for r in df.select(extract.tax_id(F.col("t")).alias("c")).collect()] == ["12345678901", None]


MONEY = [
    ("R$ 1.234,56", 1234.56), ("1234,5", 1234.5), ("1.234", 1.234), ("abc", 0.0), ("-", None), ("", None), (None, None), ("-12,5", -12.5),
    ("1,2,3", 1.23),
]


def test_locale_number(spark):
    df = spark.createDataFrame(MONEY, "t string, want double").withColumn("got", roster.locale_number(F.col("t")))
    assert df.filter("not (got <=> want)").collect() == []


def test_places(spark):
    rows = [
        ("CANOAS - ITAU", "CANOAS", ""), ("IFRS - CANOAS", "CANOAS", ""), ("CANOAS", "CANOAS", ""),
        ("6 - MUNICÍPIO DE Canoas", None, "Canoas"), ("3 - Prefeitura Municipal de Ivoti", None, "Ivoti"),
        ("B SERVICE LTDA", None, ""), ("Serviço:", None, ""),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "t string").coalesce(1)
    got = df.select(roster.city_of_line(F.col("t")).alias("a"), roster.city_of_service(F.col("t")).alias("b")).collect()
    for (text, line, service), g in zip(rows, got):
        if line is not None:
            assert g.a == line, text
        elif service is not None:
            assert g.b == service, text


def test_display(spark):
    one = spark.range(1).select(
        present.duration_hms(F.lit(3_723_000)).alias("h"), present.duration_ms(F.lit(75)).alias("m"), present.brl(F.lit(1234.5)).alias("r"),
        present.output_name(F.lit("A B"), F.lit(""), F.lit("01/2"), F.lit("João Á")).alias("o"),
        present.run_name(F.lit(None).cast("string"), F.lit("Março"), F.lit(2026)).alias("z"),
        present.miss_count(F.lit('{"a":1}')).alias("c"),
    ).first()
    assert tuple(one) == ("1h 2m 3s", "1m 15s", "R$ 1.234,50", "A_B_CIDADE_01/2_Joao_A.pdf", "2026_Marco_2026_PDFs.zip", 0)
