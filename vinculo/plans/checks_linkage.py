"""Registered queries: linkage, misses, page scans and statistics."""

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import extract
from ..operators import linkage, misses
from ..operators.scale import materialize, shared_folder, spread
from ..sources import pages as P
from ..sources import sinks
from . import report
from . import sqltext as S
from .checks_functions import _PART, _RECEIPTS, _SCORE_CTES, _SCORE_REASON, _SLIPS, _employee_sql
from .link_run import LinkRun, run_links
from .register import big, query
from .tables import (
    benchmark_employees, document_pages, named_documents, receipt_pages, slip_pages, table,
)


def _first(c: str) -> str:
    """First word of two letters or more that is no particle."""
    return f"list_filter(string_split({c}, ' '), lambda w: length(w) >= 2 AND w NOT IN {_PART})[1]"


def _names(spark, sf):
    """Whole texts are folded once for slips and receipts."""
    return materialize(named_documents(spark, sf), "names")


def _run(spark, sf, names=None) -> LinkRun:
    names = _names(spark, sf) if names is None else names
    return run_links(spread(slip_pages(spark, sf, names)), spread(receipt_pages(spark, sf, names)))


# ---------------------------------------------------------------------------
# The link run on one slip and one receipt per document. The check SQL scores
# every name against every payee and looks into every page.
# ---------------------------------------------------------------------------

_RUN_SQL = f"""nm AS ({_employee_sql(f'({_SLIPS})', 'doc_id')}),
    src AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS file_ord, source || '.pdf' AS slip_file FROM documents),
    ent AS (SELECT CAST(file_ord AS BIGINT) * 8589934592 + doc_id AS emp_ord, name, {S.fold('name', repair=True)} AS norm, slip_file, doc_id
        FROM nm JOIN src USING (doc_id) WHERE name IS NOT NULL),
    emp AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY norm ORDER BY emp_ord) = 1),
    t AS (SELECT *, {S.words('norm', 3)} AS w FROM emp),
    rec AS (SELECT doc_id AS page_no, text FROM ({_RECEIPTS})),
    {S.NAMED},
    pay AS (SELECT doc_id AS page_no, {S.altered('name', 'n_chars')} AS payee FROM named WHERE n_chars % 4 < 3),
    pg AS (SELECT rec.page_no, src.file_ord, slip_file AS receipt_file, CAST(src.file_ord AS BIGINT) * 4294967296 + rec.page_no AS page_ord,
        {S.fold('rec.text', repair=True)} AS page,
        CASE WHEN length(payee) >= 5 AND len({S.words('payee', 2)}) >= 2 THEN payee END AS payee
        FROM rec JOIN src ON rec.page_no = src.doc_id LEFT JOIN pay USING (page_no)),
    names AS (SELECT DISTINCT norm AS target FROM emp), payees AS (SELECT DISTINCT payee AS candidate FROM pg WHERE payee IS NOT NULL),
    pairs AS (SELECT row_number() OVER () AS doc_id, target, candidate FROM names, payees
        WHERE target = candidate OR left({_first('target')}, 1) = left({_first('candidate')}, 1)),
    {_SCORE_CTES},
    sc AS (SELECT target AS norm, candidate AS payee, score, {_SCORE_REASON} AS why FROM v4),
    ph AS (SELECT norm, page_ord, 1 AS rank, CASE WHEN score >= 0.85 THEN 1.0 ELSE score END AS score FROM sc JOIN pg USING (payee) WHERE score >= 0.78),
    tp AS (SELECT norm, page_ord, w, page, ' ' || page || ' ' AS padded, instr(page, norm) AS hit_at, instr(page, w[1]) AS i,
        CASE WHEN len(w) >= 2 THEN instr(page, w[len(w)]) ELSE 0 END AS j FROM t, pg),
    th AS (SELECT norm, page_ord, CASE
        WHEN length(norm) >= 8 AND hit_at > 0 AND (hit_at = 1 OR substr(page, hit_at - 1, 1) = ' ')
            AND substr(page, hit_at + length(norm), 1) IN ('', ' ') THEN 2
        WHEN len(w) >= 2 AND contains(padded, ' ' || w[1] || ' ') AND contains(padded, ' ' || w[len(w)] || ' ')
            AND len(list_filter(w, lambda x: contains(padded, ' ' || x || ' '))) >= greatest(2, floor(len(w) * CAST(0.7 AS DOUBLE)))
            AND regexp_matches(page, array_to_string(w, '.*?')) THEN 3
        WHEN i > 0 AND j > 0 AND i <> j AND abs(i - j) < 100 THEN 4 END AS rank FROM tp WHERE hit_at > 0 OR (i > 0 AND j > 0)),
    hits AS (SELECT * FROM ph UNION ALL SELECT norm, page_ord, rank, CASE rank WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.5 END FROM th WHERE rank IS NOT NULL),
    per_page AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY norm, page_ord ORDER BY rank) = 1),
    best AS (SELECT * FROM per_page QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_ord // 4294967296, score DESC, page_ord) = 1),
    links AS (SELECT emp_ord, name, norm, slip_file, doc_id AS slip_page, receipt_file, file_ord, page_no AS receipt_page, page_ord,
        ['favorecido', 'substring', 'word-overlap', 'proximity'][rank] AS method, CAST(score AS DOUBLE) AS score,
        row_number() OVER (PARTITION BY page_ord ORDER BY score DESC, emp_ord) = 1 AS accepted
        FROM best JOIN emp USING (norm) JOIN (SELECT page_ord, receipt_file, file_ord, page_no FROM pg) USING (page_ord))"""
_MISS_SQL = f"""{_RUN_SQL},
    miss AS (SELECT t.* FROM t WHERE emp_ord NOT IN (SELECT emp_ord FROM links WHERE accepted)),
    mt AS (SELECT norm, bool_or(hit_at > 0 OR (i > 0 AND j > 0 AND abs(i - j) < 100)) AS in_text FROM tp GROUP BY norm),
    fo AS (SELECT payee, min(page_ord) AS seen FROM pg WHERE payee IS NOT NULL GROUP BY payee),
    nr AS (SELECT norm, payee AS candidate, why FROM sc JOIN fo USING (payee) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, seen) = 1),
    rep AS (SELECT emp_ord, row_number() OVER (ORDER BY emp_ord) AS "index", name, miss.norm AS normalized, w[1] AS first_name,
        CASE WHEN len(w) >= 2 THEN w[len(w)] ELSE '' END AS last_name, slip_file AS source_file, doc_id AS source_page, in_text AS found_in_full_text,
        miss.norm IN (SELECT payee FROM fo) AS found_as_payee, coalesce(candidate, '(nenhum)') AS closest_candidate,
        CAST(coalesce(len(list_filter(w, lambda x: list_contains({S.words('candidate', 3)}, x))), 0) AS INTEGER) AS shared_words,
        CASE WHEN miss.norm IN (SELECT payee FROM fo) THEN '{C.REASON_AS_PAYEE}' WHEN in_text THEN '{C.REASON_IN_TEXT}'
            WHEN candidate IS NOT NULL THEN why || ' (candidato: ' || candidate || ')' ELSE '{C.REASON_NONE}' END AS reason
        FROM miss LEFT JOIN mt USING (norm) LEFT JOIN nr USING (norm))"""


@query(f"WITH {_RUN_SQL} SELECT method, count(*) AS links FROM links WHERE accepted GROUP BY method")
def link_methods(spark, sf):
    """A-3 of the whole run: extract, link, settle conflicts, count per method."""
    return linkage.methods_count(_run(spark, sf).links)


@query(
    f"""WITH {_RUN_SQL} SELECT emp_ord, name, norm, slip_file, CAST(slip_page AS INTEGER) AS slip_page, receipt_file, file_ord,
        CAST(receipt_page AS INTEGER) AS receipt_page, method, round(score, 9) AS score, accepted FROM links"""
)
def link_run(spark, sf):
    """Every chosen link with method, score and whether it won its page."""
    return _run(spark, sf).links.drop("page_ord").withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_RUN_SQL} SELECT 'tier ' || CASE method WHEN 'favorecido' THEN 'high' WHEN 'substring' THEN 'medium' ELSE 'low' END AS fact,
        CAST(count(*) AS DOUBLE) AS value FROM links WHERE accepted GROUP BY 1
    UNION ALL SELECT 'success rate', round(100.0 * count(*) / (SELECT count(*) FROM emp), 1) FROM links WHERE accepted
    UNION ALL SELECT 'one link per page', CAST(CAST(count(*) = count(DISTINCT page_ord) AS INTEGER) AS DOUBLE) FROM links WHERE accepted
    UNION ALL SELECT 'to review', CAST(count(*) AS DOUBLE) FROM links WHERE score < 0.8"""
)
def link_report(spark, sf):
    """A-15, A-17, A-8 and P-20 of one run in one table."""
    run = _run(spark, sf)
    tiers = linkage.confidence_tiers(run.links).select(F.concat(F.lit("tier "), "tier").alias("fact"), F.col("links").cast("double").alias("value"))
    rate = linkage.success_rate(run.links, run.employees).select(F.lit("success rate").alias("fact"), F.col("rate").alias("value"))
    check = linkage.page_invariant(run.links).select(
        F.lit("one link per page").alias("fact"), F.col("consistent").cast("int").cast("double").alias("value")
    )
    review = linkage.links_to_review(run.links).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("to review").alias("fact"), "value"
    )
    return tiers.unionByName(rate).unionByName(check).unionByName(review)


@query(
    f"""WITH {_RUN_SQL} SELECT receipt_file, CAST(receipt_page AS INTEGER) AS receipt_page, n_names, name, round(score, 9) AS score, accepted
    FROM links JOIN (SELECT page_ord, count(*) AS n_names FROM links GROUP BY page_ord HAVING count(*) > 1) USING (page_ord)"""
)
def contested_pages(spark, sf):
    """A-10."""
    return linkage.contested_pages(_run(spark, sf).links).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_MISS_SQL} SELECT "index", name, normalized, first_name, last_name, source_file, CAST(source_page AS INTEGER) AS source_page,
        found_in_full_text, found_as_payee, closest_candidate, shared_words, reason FROM rep"""
)
def misses_report(spark, sf):
    """U-5, W-8, J-18, S-30: the employees without an accepted link."""
    return _run(spark, sf).misses().select(
        "index", "name", "normalized", "first_name", "last_name", "source_file", "source_page", "found_in_full_text",
        "found_as_payee", "closest_candidate", "shared_words", "reason",
    )


@query(
    f"""WITH {_MISS_SQL} SELECT CASE WHEN found_as_payee THEN '{C.CATEGORY_AS_PAYEE}' WHEN found_in_full_text THEN '{C.CATEGORY_IN_TEXT}'
        WHEN closest_candidate <> '(nenhum)' THEN '{C.CATEGORY_CANDIDATE}' ELSE '{C.CATEGORY_NONE}' END AS category, count(*) AS misses
    FROM rep GROUP BY 1"""
)
def miss_reasons(spark, sf):
    """A-9."""
    return misses.reason_counts(_run(spark, sf).misses())


# The roster knows every third document's person, the registry every second one's.
_PEOPLE = "SELECT doc_id, name, 'Empresa ' || coalesce(lang, 'x') AS empresa, named.source AS cidade, 'K ' || CAST(doc_id % 7 AS VARCHAR) AS contrato FROM named JOIN documents USING (doc_id) WHERE name <> ''"
_OUTPUT_SQL = f"""{_RUN_SQL}, people AS ({_PEOPLE}),
    rost AS (SELECT *, {S.words('name', 2)} AS rw FROM people WHERE doc_id % 3 = 0),
    ex AS (SELECT name AS norm_, min_by(struct_pack(empresa, cidade, contrato), doc_id) AS x FROM rost GROUP BY name),
    en AS (SELECT rw[1] AS a, rw[-1] AS b, min_by(struct_pack(empresa, cidade, contrato), doc_id) AS y FROM rost WHERE len(rw) >= 2 GROUP BY 1, 2 HAVING count(*) = 1),
    reg AS (SELECT name AS reg_name, min(empresa) AS e, min(cidade) AS m, min(contrato) AS c FROM people WHERE doc_id % 2 = 1 GROUP BY name HAVING count(*) = 1),
    won AS (SELECT *, {S.fold('name')} AS fold, {S.words(S.fold('name'), 2)} AS fw FROM links WHERE accepted),
    found AS (SELECT won.*, CASE WHEN fw[1] IS NOT NULL THEN coalesce(x, y) END AS r FROM won LEFT JOIN ex ON fold = norm_ LEFT JOIN en ON fw[1] = a AND fw[-1] = b),
    fl AS (SELECT found.file_ord, emp_ord, name, coalesce(nullif(r.empresa, ''), e) AS empresa, coalesce(nullif(r.cidade, ''), m) AS cidade,
        coalesce(nullif(r.contrato, ''), c) AS contrato FROM found LEFT JOIN reg ON norm = reg_name),
    files AS (SELECT *, {S.file_part("coalesce(empresa, 'EMPRESA')")} || '_' || {S.file_part("coalesce(cidade, 'CIDADE')")} || '_' ||
        {S.file_part("coalesce(contrato, 'CONTRATO')")} || '_' || {S.file_part('name')} || '.pdf' AS out_file FROM fl),
    company AS (SELECT empresa FROM fl WHERE empresa <> '' GROUP BY empresa ORDER BY count(*) DESC, min(struct_pack(file_ord, emp_ord)) LIMIT 1)"""


@query(
    f"""WITH {_OUTPUT_SQL} SELECT out_file, max_by(emp_ord, struct_pack(file_ord, emp_ord)) AS emp_ord, count(*) - 1 AS collisions, 'Março' AS month_name,
        (SELECT {S.file_part('empresa')} || '_Marco_2026_PDFs.zip' FROM company) AS run_name, (SELECT count(DISTINCT out_file) FROM files) AS pdf_count,
        (SELECT count(*) FROM emp) - (SELECT count(*) FROM won) AS misses
    FROM files GROUP BY out_file"""
)
def link_outputs(spark, sf):
    """J-7, J-9, W-10, A-11, IO-12, IO-14: links enriched from roster and registry, and what the run writes, read back."""
    names = _names(spark, sf)
    people = names.filter("name <> ''").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(
        "doc_id", "name", F.concat(F.lit("Empresa "), F.coalesce("lang", F.lit("x"))).alias("empresa"), F.col("source").alias("cidade"),
        F.concat(F.lit("K "), (F.col("doc_id") % 7).cast("string")).alias("contrato"),
    )
    people = materialize(people, "people")
    records = people.filter("doc_id % 3 = 0").withColumns({"row_ord": F.col("doc_id"), "colaborador": F.initcap("name")})
    active = people.filter("doc_id % 2 = 1").withColumnRenamed("name", "nome_normalizado")
    at = F.lit("2026-03-01").cast("timestamp")
    folder = f"{shared_folder(spark)}/vinculo/outputs-{uuid.uuid4().hex}"
    done = report.publish(_run(spark, sf, names), records, active, at, F.lit("u"), 12345, folder)
    history = spark.read.parquet(done.history).select(big("pdf_count").alias("pdf_count"), big("misses").alias("misses"))
    written = spark.read.parquet(done.manifest).select("out_file", F.col("link_ord.emp_ord").alias("emp_ord"), "collisions", "month_name")
    return written.withColumn("run_name", F.lit(done.run_name)).join(F.broadcast(history))  # one row


# ---------------------------------------------------------------------------
# Text methods: benchmark names in whole documents
# ---------------------------------------------------------------------------

# The check looks at all pairs. Receipts are the documents, first copies included; documents name no payees that fit.
_TEXT_PAIRS = f"""
    tg AS (SELECT min(item_id) AS emp_ord, norm FROM (SELECT item_id, {S.text_name('text')} AS norm FROM benchmark) GROUP BY norm),
    t AS (SELECT *, {S.words('norm', 3)} AS w FROM tg),
    pg AS (SELECT doc_id AS page_no, CAST(substr(source, 4) AS INTEGER) AS file_ord, {S.fold('text', repair=True)} AS page
        FROM documents),
    pp AS (SELECT *, ' ' || page || ' ' AS padded FROM pg),
    pairs AS (SELECT emp_ord, norm, w, file_ord, page_no, page, padded, instr(page, norm) AS hit_at,
        instr(page, w[1]) AS i, instr(page, w[len(w)]) AS j FROM t, pp WHERE norm <> ''),
    hits AS (SELECT emp_ord, norm, file_ord, page_no, CASE
        WHEN length(norm) >= 8 AND hit_at > 0 AND (hit_at = 1 OR substr(page, hit_at - 1, 1) = ' ')
            AND substr(page, hit_at + length(norm), 1) IN ('', ' ') THEN 2
        WHEN contains(padded, ' ' || w[1] || ' ') AND contains(padded, ' ' || w[len(w)] || ' ')
            AND len(list_filter(w, lambda x: contains(padded, ' ' || x || ' '))) >= greatest(2, floor(len(w) * CAST(0.7 AS DOUBLE)))
            AND regexp_matches(page, array_to_string(w, '.*?')) THEN 3
        WHEN i > 0 AND j > 0 AND i <> j AND abs(i - j) < 100 THEN 4 END AS rank FROM pairs),
    scored AS (SELECT *, [1.0, 0.8, 0.6, 0.5][rank] AS score FROM hits WHERE rank IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY file_ord, score DESC, page_no) AS rn FROM scored),
    best AS (SELECT *, row_number() OVER (PARTITION BY file_ord, page_no ORDER BY score DESC, emp_ord) = 1 AS accepted
        FROM ranked WHERE rn = 1)"""
_TEXT_METHOD = "['favorecido', 'substring', 'word-overlap', 'proximity'][rank]"


def _text_links(spark, sf):
    employees = linkage.first_seen(benchmark_employees(spark, sf).filter("norm <> ''"), "norm", "emp_ord")
    pages = materialize(linkage.prepare_pages(document_pages(spark, sf)), "prepared-pages")
    return employees, pages, linkage.link(employees, pages)


@query(
    f"""WITH {_TEXT_PAIRS} SELECT norm AS name, CAST(file_ord AS BIGINT) AS file_ord, CAST(page_no AS BIGINT) AS page_no,
        {_TEXT_METHOD} AS method, CAST(score AS DOUBLE) AS score FROM ranked WHERE rn = 1"""
)
def link_by_text(spark, sf):
    """J-3, J-4, J-5 with W-2 and W-3."""
    _, _, links = _text_links(spark, sf)
    return links.select("name", big("file_ord").alias("file_ord"), big("receipt_page").alias("page_no"), "method", "score")


@query(f"WITH {_TEXT_PAIRS} SELECT {_TEXT_METHOD} AS method, accepted, count(*) AS links FROM best GROUP BY 1, 2")
def link_by_text_conflicts(spark, sf):
    """W-4 on the same links."""
    _, _, links = _text_links(spark, sf)
    return links.groupBy("method", "accepted").agg(F.count(F.lit(1)).alias("links"))


@query(
    f"""WITH {_TEXT_PAIRS}, per AS (SELECT norm, file_ord, min(page_no) AS page_no FROM scored GROUP BY norm, file_ord)
    SELECT norm AS name, CAST(file_ord AS BIGINT) AS file_ord, CAST(page_no AS BIGINT) AS page_no FROM per"""
)
def first_page_with_name(spark, sf):
    """J-6: first page per file for every benchmark name."""
    names = benchmark_employees(spark, sf).filter("norm <> ''").select("name").distinct()
    found = linkage.first_page_with_name(document_pages(spark, sf), names)
    return found.select("name", big("file_ord").alias("file_ord"), big("page_no").alias("page_no"))


# ---------------------------------------------------------------------------
# Exact payees: links, conflicts, dedup
# ---------------------------------------------------------------------------

@query(
    f"""WITH {S.NAMED} SELECT {S.fold('name')} AS norm, min_by(doc_id, file_ord * 4294967296 + doc_id) AS page_no,
        CAST(min(file_ord * 4294967296 + doc_id) // 4294967296 AS BIGINT) AS file_ord
    FROM named WHERE name <> '' GROUP BY 1"""
)
def dedup_first_seen(spark, sf):
    """W-1 on document names."""
    d = named_documents(spark, sf).filter("name <> ''").select(
        F.col("name").alias("norm"), linkage.page_ord(F.col("file_ord"), F.col("doc_id")).alias("ord"), "doc_id"
    )
    return linkage.first_seen(d, "norm", "ord").select(
        "norm", F.col("doc_id").alias("page_no"), F.shiftright("ord", 32).alias("file_ord")
    )


@query(
    f"""WITH {S.NAMED}, a AS (SELECT name AS norm, min(file_ord * 4294967296 + doc_id) AS emp_ord FROM named
        WHERE name <> '' GROUP BY name),
    r AS (SELECT file_ord * 4294967296 + doc_id AS page_ord, {S.altered('name', 'n_chars')} AS payee FROM named WHERE name <> ''),
    hit AS (SELECT emp_ord, norm, min(page_ord) AS page_ord FROM a JOIN r ON norm = payee GROUP BY emp_ord, norm),
    won AS (SELECT page_ord, min(emp_ord) AS emp_ord FROM hit GROUP BY page_ord)
    SELECT hit.norm, hit.page_ord, won.emp_ord IS NOT NULL AS accepted
    FROM hit LEFT JOIN won ON hit.page_ord = won.page_ord AND hit.emp_ord = won.emp_ord"""
)
def link_exact(spark, sf):
    """J-2 restricted to equal names, with W-3 and W-4."""
    d = named_documents(spark, sf).filter("name <> ''")
    ord_ = linkage.page_ord(F.col("file_ord"), F.col("doc_id"))
    employees = linkage.first_seen(d.select(F.col("name").alias("norm"), ord_.alias("emp_ord")), "norm", "emp_ord")
    from .tables import altered

    payees = d.select(altered(F.col("name"), F.col("n_chars")).alias("norm"), ord_.alias("page_ord"))
    first = payees.groupBy("norm").agg(F.min("page_ord").alias("page_ord"))
    links = employees.join(first, "norm").withColumn("score", F.lit(1.0))
    return linkage.resolve_conflicts(links).select("norm", "page_ord", "accepted")


# ---------------------------------------------------------------------------
# Page statistics and estimates
# ---------------------------------------------------------------------------

_PAGE_TEXT = (
    "CASE WHEN role = 'user' THEN 'Favorecido: ' || text WHEN length(text) % 3 = 0 THEN 'Recibo de Pagamento ' || text ELSE text END"
)


def _conversation_pages(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_no"),
        F.expr(_PAGE_TEXT).alias("text"),
    )


@query(
    f"""SELECT CAST(conv_id AS VARCHAR) AS file_id, count(*) FILTER (WHERE regexp_matches(upper(strip_accents({_PAGE_TEXT})),
        'FAVORECIDO\\s*:?')) AS receipts FROM conversations GROUP BY conv_id"""
)
def receipt_estimate(spark, sf):
    """A-12, P-18."""
    return P.receipt_estimate(_conversation_pages(spark, sf), extract.has_payee_label(F.col("text")))


def _slip_estimate_sql() -> str:
    source = f"(SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn + 1 AS VARCHAR) AS k, {_PAGE_TEXT} AS text FROM conversations)"
    pattern = C.SLIP_PAGE_PATTERN.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
    return f"""WITH names AS ({_employee_sql(source, 'k')}),
    pg AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, turn + 1 AS page_no, CAST(conv_id AS VARCHAR) || '/' || CAST(turn + 1 AS VARCHAR) AS k,
        regexp_matches(upper(strip_accents({_PAGE_TEXT})), '{pattern}') AS pat FROM conversations),
    f AS (SELECT pg.*, pat OR name IS NOT NULL AS hit, max(page_no) OVER (PARTITION BY file_id) AS n FROM pg JOIN names USING (k))
    SELECT file_id, CASE WHEN bool_or(hit AND page_no IN (1, greatest(1, n // 2), greatest(1, n - 1)))
        THEN count(*) FILTER (WHERE hit) ELSE greatest(1, max(n) - 1) END AS slips FROM f GROUP BY file_id"""


@query(_slip_estimate_sql())
def slip_estimate(spark, sf):
    """A-13, P-19."""
    pages = _conversation_pages(spark, sf).withColumn("name", extract.employee_name(F.col("text")))
    return P.slip_estimate(pages, extract.is_slip_page(F.col("text"), F.col("name")))


@query(
    f"""WITH {S.NAMED}, q AS (SELECT CASE WHEN n_chars % 4 < 3 THEN 'COMPROVANTE DE TRANSFERENCIA FAVORECIDO '
            || {S.altered('name', 'n_chars')} || ' R' ELSE 'PAGO A ' || name || ' EM' END AS page,
        CASE WHEN n_chars % 4 < 3 THEN {S.altered('name', 'n_chars')} END AS named_payee FROM named),
    r AS (SELECT page, CASE WHEN length(named_payee) >= 5 AND len({S.words('named_payee', 2)}) >= 2 THEN named_payee END AS payee FROM q)
    SELECT count(*) AS pages, count(*) FILTER (WHERE length(trim(page)) > 50) AS pages_with_text,
        count(*) FILTER (WHERE payee IS NULL) AS pages_without_payee, count(payee) AS payees_total,
        count(DISTINCT payee) AS payees_distinct FROM r"""
)
def page_statistics(spark, sf):
    """A-7."""
    pages = materialize(linkage.prepare_pages(receipt_pages(spark, sf)), "prepared-pages")
    return misses.page_statistics(pages).select(*[big(c).alias(c) for c in (
        "pages", "pages_with_text", "pages_without_payee", "payees_total", "payees_distinct")])


@query(
    f"""WITH {S.NAMED}, r AS (SELECT DISTINCT {S.altered('name', 'n_chars')} AS payee FROM named WHERE n_chars % 4 < 3)
    SELECT payee, row_number() OVER (ORDER BY payee) AS position FROM r
    WHERE length(payee) >= 5 AND len({S.words('payee', 2)}) >= 2"""
)
def numbered_payees(spark, sf):
    """L-6."""
    return misses.numbered_payees(materialize(linkage.prepare_pages(receipt_pages(spark, sf)), "prepared-pages"))


# ---------------------------------------------------------------------------
# Page scans
# ---------------------------------------------------------------------------

@query(f"SELECT 'slip-' || source AS file_id, doc_id AS page_no, s.text FROM ({_SLIPS}) s JOIN documents USING (doc_id)")
def stored_pages(spark, sf):
    """IO-1: pages written to the shared folder and scanned again."""
    folder = f"{shared_folder(spark)}/vinculo/pages-{uuid.uuid4().hex}"
    sinks.append(slip_pages(spark, sf), folder)
    return P.read_pages(spark, folder).select("file_id", big("page_no").alias("page_no"), "text")


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS page_no, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""
)
def page_texts(spark, sf):
    """IO-1: lines of a document as its pages."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("texts"))
    return P.explode_pages(d).select("doc_id", big("page_no").alias("page_no"), "text")


@query(
    """SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations"""
)
def document_layout(spark, sf):
    """IO-2."""
    c = table(spark, sf, "conversations").withColumn("page_no", F.col("turn"))
    return P.document_layout(c, "conv_id").select("conv_id", big("turn").alias("turn"), big("start").alias("start"))


@query(
    """SELECT source, doc_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents"""
)
def source_layout(spark, sf):
    """IO-2 with few large documents: the sums run in blocks."""
    d = table(spark, sf, "documents").withColumn("page_no", F.col("doc_id"))
    return P.document_layout(d, "source").select("source", "doc_id", big("start").alias("start"))


@query("SELECT conv_id, role, text FROM conversations WHERE turn = 1")
def single_page(spark, sf):
    """IO-3: the page filter reaches the scan."""
    c = table(spark, sf, "conversations").withColumn("page_no", F.col("turn"))
    return P.one_page(c, 1).select("conv_id", "role", "text")


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS str,
        unnest(range(len(string_split(text, ' ')))) AS i FROM conversations),
    it AS (SELECT conv_id, turn, str, i, (i * 7) % 90 AS x, 1000000.0 - (i // 9) * 12 + (i % 4) AS y FROM w
        WHERE regexp_replace(str, '\\s', '', 'g') <> ''),
    l AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY conv_id, turn ORDER BY y DESC, x, i) - y > 5 THEN 1 ELSE 0 END AS nl FROM it),
    n AS (SELECT *, sum(nl) OVER (PARTITION BY conv_id, turn ORDER BY y DESC, x, i ROWS UNBOUNDED PRECEDING) AS line FROM l)
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, string_agg(str, ' ' ORDER BY line, x, i) AS text FROM n GROUP BY conv_id, turn"""
)
def reading_order(spark, sf):
    """IO-4 on the words of a text laid out in lines of nine with uneven heights."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("seq", "str"))
    i = F.col("seq")
    items = c.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("page_no"), "seq", ((i * 7) % 90).cast("double").alias("x"),
        (F.lit(1000000.0) - F.floor(i / 9) * 12 + (i % 4)).alias("y"), F.lit(10.0).alias("h"), "str",
    )
    return P.reading_order(items).select(F.col("file_id").alias("conv_id"), big("page_no").alias("turn"), "text")


@query(
    """SELECT conv_id, CAST(turn AS BIGINT) AS turn, text || ' ' || role || CASE WHEN turn % 2 = 0 THEN ' note ' || turn ELSE '' END
        || ' seen' AS text FROM conversations"""
)
def annotated_pages(spark, sf):
    """IO-5."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page_no"), "role", "text")
    one = c.select(
        "file_id", "page_no", F.lit(1).alias("seq"), F.concat(F.lit(" "), "role").alias("contents"), F.lit("  ").alias("field_value"),
        F.when(F.col("page_no") % 2 == 0, F.concat(F.lit("note "), F.col("page_no").cast("string"))).alias("alternative_text"),
    )
    two = c.select(
        "file_id", "page_no", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("contents"), F.lit("seen ").alias("field_value"),
        F.lit("").alias("alternative_text"),
    )
    out = P.with_annotations(c.drop("role"), one.unionByName(two))
    return out.select(F.col("file_id").alias("conv_id"), big("page_no").alias("turn"), "text")


def text_versions(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length("text")
    key = [F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("page_no")]
    out = c.select(*key, F.lit("native").alias("stage"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"),
                   F.lit(False).alias("timed_out"))
    ocr = c.filter("turn % 5 <> 4").select(
        *key, F.lit("ocr").alias("stage"), F.when(n % 2 == 0, F.col("text")).otherwise(F.col("role")).alias("text"),
        (n % 5 == 0).alias("timed_out"),
    )
    retry = c.filter("turn % 3 = 0").select(
        *key, F.lit("retry").alias("stage"), F.concat_ws(" ", "role", "text").alias("text"), (n % 7 == 0).alias("timed_out")
    )
    return out.unionByName(ocr).unionByName(retry)


_VERSIONS = f"""v AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS BIGINT) AS page_no,
        length({S.js_trim("CASE WHEN role = 'user' THEN text ELSE '' END")}) AS nl,
        CASE WHEN role = 'user' THEN text ELSE '' END AS native,
        CASE WHEN turn % 5 <> 4 THEN CASE WHEN length(text) % 2 = 0 THEN text ELSE role END END AS ocr,
        CASE WHEN turn % 3 = 0 THEN role || ' ' || text END AS retry,
        turn % 5 <> 4 AND length(text) % 5 = 0 AS ot, turn % 3 = 0 AND length(text) % 7 = 0 AS rt FROM conversations),
    x AS (SELECT *, coalesce(length({S.js_trim('ocr')}), 0) AS ol, coalesce(length({S.js_trim('retry')}), 0) AS rl FROM v),
    y AS (SELECT *, ol < 40 AND NOT ot AND retry IS NOT NULL AS retried FROM x)"""


@query(
    f"""WITH {_VERSIONS} SELECT file_id, page_no, CASE WHEN nl >= 100 THEN native WHEN retried AND rl > ol THEN retry
        ELSE coalesce(ocr, '[Empty page ' || page_no || ']') END AS text FROM y"""
)
def best_text_version(spark, sf):
    """IO-6 for receipts."""
    return P.best_versions(text_versions(spark, sf)).select("file_id", big("page_no").alias("page_no"), "text")


@query(
    f"""WITH {_VERSIONS}, n AS ({_employee_sql("(SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS k, CASE WHEN role = 'user' THEN text ELSE '' END AS text FROM conversations)", 'k')}),
    o AS ({_employee_sql("(SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS k, CASE WHEN length(text) % 2 = 0 THEN text ELSE role END AS text FROM conversations)", 'k')})
    SELECT file_id, page_no, CASE WHEN n.name IS NOT NULL THEN native
        WHEN (ocr IS NULL OR o.name IS NULL) AND ol < 60 AND rl > ol THEN retry ELSE ocr END AS text,
        CAST(CASE WHEN n.name IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS phase
    FROM y JOIN n ON n.k = file_id || '/' || page_no JOIN o ON o.k = n.k"""
)
def best_slip_version(spark, sf):
    """IO-6 for slips."""
    out = P.best_slip_versions(text_versions(spark, sf), extract.employee_name)
    return out.select("file_id", big("page_no").alias("page_no"), "text", big("phase").alias("phase"))


@query(
    f"""WITH {_VERSIONS} SELECT file_id, count(*) AS pages_total, count(*) FILTER (WHERE nl < 100) AS pages_needing_ocr,
        count(*) FILTER (WHERE nl < 100 AND greatest(ol, CASE WHEN retried THEN rl ELSE 0 END) < 40) AS pages_empty_or_short,
        count(*) FILTER (WHERE nl < 100 AND ot) + count(*) FILTER (WHERE nl < 100 AND retried AND rt) AS timeouts,
        count(*) FILTER (WHERE nl < 100 AND retried) AS retries FROM y GROUP BY ROLLUP (file_id)"""
)
def text_metrics(spark, sf):
    """A-5."""
    return P.text_metrics(text_versions(spark, sf))


# ---------------------------------------------------------------------------
# Miss texts
# ---------------------------------------------------------------------------

_REPORT = """rep AS (SELECT event_id + 1 AS idx, user_id, event_type, value > 50 AS as_payee, value > 20 AS in_text,
        CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS candidate FROM events)"""


def _report(spark, sf):
    e = table(spark, sf, "events")
    candidate = F.when(F.col("event_id") % 2 != 0, F.col("event_type"))
    r = e.select(
        (F.col("event_id") + 1).alias("index"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
        F.upper("event_type").alias("normalized"), F.lit("a.pdf").alias("source_file"), F.lit(1).alias("source_page"),
        (F.col("value") > 20).alias("found_in_full_text"), (F.col("value") > 50).alias("found_as_payee"), candidate.alias("candidate"),
    )
    return r.withColumns({
        "reason": misses.miss_reason(F.col("found_as_payee"), F.col("found_in_full_text"), F.col("candidate"), F.lit("SCORE BAIXO (0.10)")),
        "closest_candidate": F.coalesce("candidate", F.lit(C.NO_CANDIDATE)),
    })


@query(
    f"""WITH {_REPORT} SELECT CASE WHEN as_payee THEN '{C.CATEGORY_AS_PAYEE}' WHEN in_text THEN '{C.CATEGORY_IN_TEXT}'
        WHEN candidate IS NOT NULL THEN '{C.CATEGORY_CANDIDATE}' ELSE '{C.CATEGORY_NONE}' END AS category, count(*) AS misses
    FROM rep GROUP BY 1"""
)
def miss_categories(spark, sf):
    """S-29, A-9."""
    return misses.reason_counts(_report(spark, sf))


@query(
    f"""WITH {_REPORT}, t AS (SELECT 'User ' || user_id AS "Nome", upper(event_type) AS "Normalizado", 'a.pdf' AS "Arquivo",
        1 AS "Página", CASE WHEN in_text THEN 'SIM' ELSE 'NÃO' END AS "No Texto",
        CASE WHEN as_payee THEN 'SIM' ELSE 'NÃO' END AS "FAVORECIDO", coalesce(candidate, '(nenhum)') AS "Candidato Próximo",
        CASE WHEN as_payee THEN '{C.REASON_AS_PAYEE}' WHEN in_text THEN '{C.REASON_IN_TEXT}' WHEN candidate IS NOT NULL
            THEN 'SCORE BAIXO (0.10) (candidato: ' || candidate || ')' ELSE '{C.REASON_NONE}' END AS "Motivo" FROM rep)
    SELECT * FROM t WHERE contains(lower("Nome"), 'user 1') OR contains(lower("Motivo"), 'user 1')"""
)
def miss_export_search(spark, sf):
    """IO-13: the misses a search finds (P-17), as CSV written and read back."""
    folder = f"{shared_folder(spark)}/vinculo/misses-{uuid.uuid4().hex}"
    sinks.export_misses(misses.search_misses(_report(spark, sf), "User 1"), folder)
    back = spark.read.option("header", True).option("escape", '"').csv(folder)
    return back.withColumn("Página", F.col("Página").cast("int"))


@query(
    f"""WITH {_REPORT} SELECT sha256('u|2026-03-01 00:00:00') AS run_id, idx AS index, '{{"name":"User ' || user_id || '","reason":"' ||
        CASE WHEN as_payee THEN '{C.REASON_AS_PAYEE}' WHEN in_text THEN '{C.REASON_IN_TEXT}' WHEN candidate IS NOT NULL
            THEN 'SCORE BAIXO (0.10) (candidato: ' || candidate || ')' ELSE '{C.REASON_NONE}' END ||
        '","closestCandidate":"' || coalesce(candidate, '{C.NO_CANDIDATE}') || '","foundInFullText":' || in_text || ',"foundAsFavorecido":' ||
        as_payee || '}}' AS json FROM rep"""
)
def run_miss_rows(spark, sf):
    """IO-12: the miss table of a run, each miss as it is exported."""
    at = F.lit("2026-03-01").cast("timestamp")
    return sinks.misses_json(sinks.run_miss_rows(_report(spark, sf), at, F.lit("u")))


@query(
    f"""WITH {S.NAMED}, w AS (SELECT doc_id, {S.words('name', 3)} AS a, {S.words(S.altered('name', 'n_chars'), 3)} AS b FROM named)
    SELECT doc_id, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS BIGINT) AS shared FROM w"""
)
def shared_words(spark, sf):
    """U-4."""
    from .tables import name_pairs

    d = name_pairs(spark, sf)
    return d.select("doc_id", big(misses.shared_words(F.col("target"), F.col("candidate"))).alias("shared"))
