"""The blocked link plan against a nested loop over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from vinculo.config import MatchConfig
from vinculo.operators import linkage, misses, nearest
from vinculo.operators.scale import materialize

FIRST = ["MARIA", "MARTA", "MARINA", "MARIANA", "JOAO", "JOANA", "JOSE", "ANA", "DIANA", "KELLY", "KELLI", "SIMONE", "GISELE", "GISELA", "LU"]
LAST = ["SILVA", "SILVEIRA", "SILV", "SANTOS", "SANTO", "SOUZA", "SOUSA", "FERNANDES", "FERNA", "MEES", "PADILHA", "PADIL", "ROSA", "ROSANGELA", "COSTA", "COSTABILE", "LI"]
MIDDLE = ["DA", "DE", "DOS", "CARLOS", "BEATRIZ", "PEREIRA", "APARECIDA", "SILVA", "COSTABILE", "MEES", "E"]
NOISE = ["VALOR", "PAGO", "EM", "CONTA", "AGENCIA", "BANCO", "XANAX", "MARIAROSA", "DIANA", "TOTAL", "REF"]


def name(rng):
    middle = rng.sample(MIDDLE, rng.choice([0, 0, 1, 1, 2]))
    tail = [rng.choice(LAST)] if rng.random() < 0.93 else []
    return " ".join([rng.choice(FIRST), *middle, *tail])


def fuzz(rng, n):
    kind = rng.random()
    if kind < 0.4:
        return n
    if kind < 0.6:
        return n[: max(4, len(n) - rng.randint(1, 3))].strip()
    i = rng.randrange(len(n))
    return (n[:i] + rng.choice("AEIOST") + n[i + 1 :]).strip()


def make_case(seed, n_targets=60, n_files=6, n_pages=8):
    rng = random.Random(seed)
    targets = sorted({name(rng) for _ in range(n_targets)})
    rng.shuffle(targets)
    pages = []
    for f in range(n_files):
        for p in range(1, n_pages + 1):
            payees = []
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                payees.append(fuzz(rng, rng.choice(targets) if rng.random() < 0.3 else name(rng)))
            payees = [x for x in dict.fromkeys(payees) if len(x) >= 5]
            text = []
            for _ in range(rng.randint(1, 3)):
                text += rng.sample(NOISE, rng.randint(1, 4))
                if rng.random() < 0.5:
                    text += rng.choice(targets).split(" ")
            if rng.random() < 0.2:
                text += ["FILLER"] * 25 + [rng.choice(LAST)]
            pages.append((f, p, " ".join(text), payees))
            if rng.random() < 0.2 and p < n_pages:
                pages[-1] = (f, p, *pages[rng.randrange(len(pages))][2:])
    return list(enumerate(targets)), pages


def frames(spark, targets, pages):
    emp = spark.createDataFrame([(e, n, n, "s.pdf", e + 1) for e, n in targets], "emp_ord long, name string, norm string, slip_file string, slip_page int")
    pg = spark.createDataFrame(
        [(f"f{f}", f"f{f}", f, p, (f << 32) + p, t, y) for f, p, t, y in pages],
        "file_id string, file_name string, file_ord int, page_no int, page_ord long, norm string, payees array<string>",
    )
    return emp.repartition(3), materialize(pg.repartition(5), "test-pages")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_misses_equal_nested_loop(spark, seed):
    targets, pages = make_case(seed)
    emp, pg = frames(spark, targets, pages)
    cfg = MatchConfig(pairs_per_cell=9)  # so small that many keys are split
    run = linkage.prepare_run(emp, pg, cfg)
    links = materialize(linkage.link_prepared(run, cfg), "test-links")
    got = sorted(
        (r.emp_ord, r.file_ord, r.receipt_page, linkage.METHODS.index(r.method) + 1, round(r.score, 9), r.accepted)
        for r in links.collect()
    )
    want = sorted((e, f, p, k, round(s, 9), ok) for e, f, p, k, s, ok in brute.link(targets, pages))
    assert got == want
    assert {g[3] for g in got} >= {1, 2}

    report = misses.explain_misses(run, links, cfg).collect()
    linked = {w[0] for w in want if w[5]}
    missing = [(e, n) for e, n in targets if e not in linked]
    assert [r["index"] for r in sorted(report, key=lambda r: r.emp_ord)] == list(range(1, len(missing) + 1))
    got = {r.normalized: (r.found_in_full_text, r.found_as_payee, r.closest_candidate) for r in report}
    want = {}
    for _, n in missing:
        in_text, as_payee, cand, _ = brute.miss(n, pages)
        want[n] = (in_text, as_payee, cand or "(nenhum)")
    assert got == want


def test_order_of_input_partitions_does_not_matter(spark):
    targets, pages = make_case(7)
    emp, pg = frames(spark, targets, pages)
    one = linkage.link(emp.coalesce(1), pg.coalesce(1)).collect()
    two = linkage.link(emp.repartition(7, F.rand(3)), pg.repartition(9, F.rand(5))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_nearest_candidate_scores_few_pairs_of_a_large_class(spark):
    rng = random.Random(8)
    # Most payees share first and last name; letters in between tell them apart.
    inner = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(4, 9)))
    payees = [f"MARIA {inner()} {inner()} SILVA" for _ in range(400)] + [f"MARIA {inner()}" for _ in range(20)] + ["MARIA", "MARIANA SILVA COSTA", "JOSE SILVA"]
    targets = [p[:-3] + "VO" if k % 2 else p.replace("SILVA", "SILVEIRA") for k, p in enumerate(rng.sample(payees[:400], 40))]
    targets += [f"MARIA {inner()} SILVA" for _ in range(20)] + ["MARIA", "MARIO SILVA", "ZOE", "MARIA DE SILVA", payees[7]]
    occurrences = spark.createDataFrame([(k, 0, 0, p) for k, p in enumerate(payees)], "page_ord long, file_ord int, pos int, payee string")
    emp = spark.createDataFrame([(k, t, t, "s", 1) for k, t in enumerate(dict.fromkeys(targets))], "emp_ord long, name string, norm string, slip_file string, slip_page int")
    cfg = MatchConfig(pairs_per_cell=50)
    prepared = materialize(linkage.prepare_targets(emp, cfg), "test-targets")
    got = {r.norm: (r.candidate, round(r.score, 9)) for r in nearest.nearest_payee(prepared, occurrences, cfg).collect()}
    for t in dict.fromkeys(targets):
        best = max((brute.score(t, p), -k) for k, p in enumerate(payees))
        assert got.get(t) == ((payees[-best[1]], round(best[0], 9)) if best[0] > 0 else None), t
    known = linkage.payee_dictionary(occurrences, cfg).join(occurrences.groupBy("payee").agg(F.min(F.struct("page_ord", "pos")).alias("seen")), "payee")
    known = materialize(known, "test-payees")
    pairs = nearest.nearest_pairs(prepared, known, linkage.name_dictionaries(prepared, known, cfg), cfg).count()
    assert pairs < 0.15 * len(got) * len(payees)


def test_text_methods_on_awkward_texts(spark):
    names = ["ANA DE LIMA", "ANA MARIA ANA", "LIMA E SA", "MARIA ROSA", "ROSA ROSA", "FERNANDES", "DE FERNANDES", "JO DA SA", "ANA CLARA DOS SANTOS LIMA"]
    texts = ["PAGO A ANA DE LIMA EM", "XANA DE LIMA E ANA DE LIMA", "ANA LIMA DE", "DIANA DE LIMAO", "ANA MARIA ANA", "ANAMARIA ANA MARIA", "ROSA", "ROSA MARIA ROSA", "MARIAROSA",
             "MARIA XROSA MARIA ROSA", "A FERNANDES B", "OFERNANDES FERNANDES", "JO DA SA", "XJO DA SAX", "ANA CLARA DOS SANTOS LIMA", "ANA SANTOS CLARA LIMA", "LIMA SANTOS CLARA DOS ANA",
             "ANA " + "Z " * 60 + "LIMA", "LIMA E SA", "SA LIMA E", "ROSA ROSA", "CLARA ANA SANTOS LIMA", ""]
    targets, pages = list(enumerate(names)), [(k, 1, t, []) for k, t in enumerate(texts)]
    emp, pg = frames(spark, targets, pages)
    run = linkage.prepare_run(emp, pg)
    prepared = run.targets.withColumn("last_ord", F.lit(None).cast("long"))
    hits = linkage.text_hits(prepared, run.pages, run.index, run.vocabulary, MatchConfig(pairs_per_cell=4), 5)
    got = {(r.norm, r.page_ord >> 32): r["rank"] for r in hits.collect()}
    want = {}
    for n in names:
        for k, t in enumerate(texts):
            if hit := brute.page_hit(n, t, []):
                want[n, k] = hit[0]
    assert got == want


def test_first_page_per_file_equals_nested_loop(spark):
    rng = random.Random(21)
    pages = []
    for f in range(4):
        for p in range(1, 10):
            payee = fuzz(rng, name(rng))
            text = f"COMPROVANTE FAVORECIDO: {payee} CPF 123.456.789-00" if rng.random() < 0.7 else f"PAGO A {name(rng)} EM CONTA"
            pages.append((f"f{f}", f"f{f}", f, p, text))
    raw = spark.createDataFrame(pages, "file_id string, file_name string, file_ord int, page_no int, text string")
    names = sorted({name(rng) for _ in range(50)})
    got = {(r.name, r.file_ord): r.page_no for r in linkage.first_page_with_name(raw, spark.createDataFrame([(n,) for n in names], "name string"), MatchConfig(pairs_per_cell=9)).collect()}
    want = {}
    for r in sorted(linkage.prepare_pages(raw).collect(), key=lambda r: r.page_ord):
        for n in names:
            if (n, r.file_ord) not in want and brute.page_hit(n, r.norm, r.payees):
                want[n, r.file_ord] = r.page_no
    assert got == want and len(want) > 20


def test_frequent_words_of_a_name_cost_their_number(spark):
    """The words of a name stand on one page very often, but never as the name."""
    import time

    from vinculo.functions.fold import let
    from vinculo.operators.postings import at_distance, phrase_start, place

    n = 20_000
    far = spark.range(1).select(*[F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i, k=k: ((i * 40 + k * 11 + 1) * 4 + 3).cast("int")).alias(c) for k, c in enumerate("abc")])
    offsets = F.array(F.lit(0), F.lit(4), F.lit(9))
    begun = time.time()
    got = far.select(at_distance(F.col("a"), F.col("c"), F.lit(9)).alias("d"), let(phrase_start(F.array("a", "b", "c"), offsets), lambda s: place(s)).alias("s")).first()
    assert (got.d, got.s) == (False, None)
    assert time.time() - begun < 60


def test_phrase_start_is_the_first_of_all(spark):
    from vinculo.operators.postings import at_distance, phrase_start

    rng = random.Random(5)
    offsets, rows = (0, 4, 9), []
    for _ in range(300):
        rows.append(tuple([sorted(p * 4 + rng.choice([3, 3, 3, 0, 1, 2]) for p in rng.sample(range(1, 30), rng.randint(0, 12))) for _ in offsets]))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>")
    ats = F.array("a", "b", "c")
    got = df.select("a", "b", "c", phrase_start(ats, F.array(*map(F.lit, offsets))).alias("s"), at_distance(F.col("a"), F.col("c"), F.lit(9)).alias("d")).collect()
    assert len(got) == 300 and any(r.s is not None for r in got)
    for r in got:
        def follows(p):
            spots = [any(q >> 2 == (p >> 2) + o and q & f == f for q in at) for at, o, f in zip((r.a, r.b, r.c), offsets, (1, 3, 2))]
            return all(spots)
        assert r.s == next((p for p in r.a if follows(p)), None)
        assert r.d == any((q >> 2) - (p >> 2) == 9 for p in r.a for q in r.c)


def test_stored_tables_of_a_run_are_never_sent_to_the_driver(spark):
    """Names and pairs of names are small on disk and large in memory, so their joins are shuffles at any size."""
    from vinculo.operators.linkage import name_dictionaries, prepare_targets

    norms = spark.createDataFrame([("MARIA DA SILVA",), ("JOAO SOUZA",)], "norm string")
    targets = prepare_targets(norms)
    payees = targets.select(F.col("norm").alias("payee"), F.col("f1").alias("f2"), F.col("s1").alias("s2"))
    first, sur = name_dictionaries(targets, payees, MatchConfig())
    joined = targets.join(first, "f1").join(sur, F.array_contains("s1", F.col("x")) & (F.col("f2") == F.col("y")), "left")
    plan = targets.join(first, "f1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 2


def test_first_names_are_only_related_where_surnames_meet(spark, monkeypatch):
    """Very many alike first names with surnames of their own make no pairs."""
    from vinculo.operators import blocking

    letters = "ABCDEFGHIJKLMNOPQRST"
    alike = [f"MARIA{a}{b}" for a in letters for b in letters]
    names = [f"{f} {a * 3}{b * 3}{a * 2}" for f, (a, b) in zip(alike, ((a, b) for a in letters for b in letters))]
    payees = [f"{f} Z{b * 4}{a * 3}XZ" for f, (a, b) in zip(alike, ((a, b) for a in letters for b in letters))] + [names[7]]
    emp, pg = frames(spark, list(enumerate(names)), [(k % 3, k, p, [p]) for k, p in enumerate(payees)])
    rows = {}

    def counted(df, name, store=linkage.store):
        out = store(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    for module in (blocking, linkage, nearest):
        monkeypatch.setattr(module, "store", counted, raising=False)
    run = linkage.prepare_run(emp, pg, MatchConfig())
    links = linkage.link_prepared(run, MatchConfig()).filter("method = 'favorecido'").collect()
    assert [r.norm for r in links] == [names[7]]
    assert max(rows.values()) < 10 * len(names), rows


def test_first_name_pairs_equal_all_pairs(spark):
    from vinculo.functions.similarity import first_names_pass, jaro_winkler
    from vinculo.operators.blocking import first_name_pairs

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ABE") for _ in range(rng.randint(1, 9))) for _ in range(160)} | {"", "MARIA", "MARIANA"})
    left = spark.createDataFrame([(w,) for w in words], "f1 string")
    right = left.select(F.col("f1").alias("f2"))
    got = {(r.f1, r.f2): r.fj for r in first_name_pairs(left, right, MatchConfig(pairs_per_cell=500)).collect()}
    every = left.filter("f1 <> ''").crossJoin(right.filter("f2 <> ''")).withColumn("fj", jaro_winkler(F.col("f1"), F.col("f2")))
    want = {(r.f1, r.f2): r.fj for r in every.collect() if r.f1 == r.f2 or r.fj >= 0}
    passed = every.filter(first_names_pass(F.col("f1"), F.col("f2"), F.col("fj"))).collect()
    assert got == {(r.f1, r.f2): want[r.f1, r.f2] for r in passed}
