"""Registered queries: folds, names, similarity, extraction, cell and display functions."""

from pyspark.sql import functions as F

from .. import config as C
from ..functions import extract, fold, present, roster, similarity
from ..operators.linkage import employees_from_slips
from . import sqltext as S
from .register import big, query
from .tables import name_pairs, named_documents, receipt_pages, slip_pages, table

DIGITS = "translate(text, 'oOiIsS', '001155')"


@query(f"SELECT doc_id, {S.fold('text')} AS name_norm FROM documents")
def name_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold.fold_name(F.col("text")).alias("name_norm"))


@query(f"SELECT doc_id, {S.fold(DIGITS, repair=True)} AS name_norm FROM documents")
def name_fold_ocr(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", fold.fold_name_ocr(F.translate("text", "oOiIsS", "001155")).alias("name_norm")
    )


@query(f"SELECT doc_id, trim({S.page_fold('text')}) AS light FROM documents")
def light_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold.fold_light(F.col("text")).alias("light"))


@query(f"SELECT doc_id, {S.js_trim('''upper(strip_accents(replace(text, 'ß', 'ss')))''')} AS weak FROM documents")
def weak_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold.fold_weak(F.col("text")).alias("weak"))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^a-zA-Z0-9_\\-./]', '_', 'g'), "
    "'_+', '_', 'g'), '^_|_$', '', 'g') AS path FROM documents"
)
def storage_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold.fold_storage(F.col("text")).alias("path"))


@query(
    """SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c:
        CASE WHEN c = ' ' THEN '·(20)'
             WHEN unicode(c) BETWEEN 33 AND 126 THEN c || '(' || format('{:02X}', unicode(c)) || ')'
             ELSE '\\u' || format('{:04X}', unicode(c)) END), ' ') AS points
    FROM benchmark"""
)
def code_points(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fold.code_points(F.col("text")).alias("points"))


@query(
    f"""SELECT doc_id, changed FROM (SELECT doc_id,
        upper(replace({S.js_trim('text')}, 'ß', 'SS')) <> {S.fold('text')} AS changed FROM documents) WHERE changed"""
)
def sanitization_diff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fold.fold_changes(F.col("text")).alias("changed"))
    return d.filter("changed")


_PART = "('DE', 'DA', 'DO', 'DOS', 'DAS', 'DEL')"


@query(
    f"""WITH n AS (SELECT doc_id, {S.fold('text', repair=True)} AS norm FROM documents),
    t AS (SELECT doc_id, norm, list_filter(string_split(norm, ' '), lambda w: w NOT IN {_PART}) AS p,
        {S.words('norm', 3)} AS w FROM n),
    s AS (SELECT *, list_filter(p, lambda w: length(w) >= 2) AS q FROM t)
    SELECT doc_id, array_to_string(p, ' ') AS without_particles, coalesce(q[1], '') AS first_name,
        CAST(greatest(len(q) - 1, 0) AS BIGINT) AS surnames, coalesce(w[1], '') AS first_word,
        CASE WHEN len(w) >= 2 THEN w[len(w)] ELSE '' END AS last_word,
        CAST(greatest(2, floor(len(w) * CAST(0.7 AS DOUBLE))) AS BIGINT) AS required,
        CAST(length(replace(norm, ' ', '')) AS BIGINT) AS char_count
    FROM s"""
)
def name_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fold.fold_name_ocr(F.col("text")).alias("norm"))
    t = fold.prepared_target(F.col("norm"))
    return d.select(
        "doc_id", fold.without_particles(F.col("norm")).alias("without_particles"),
        fold.first_name(F.col("norm")).alias("first_name"), big(F.size(fold.surnames(F.col("norm")))).alias("surnames"),
        t["first"].alias("first_word"), t["last"].alias("last_word"), big(t["required"]).alias("required"),
        big(t["char_count"]).alias("char_count"),
    )


@query(
    """SELECT p_partkey, CAST(levenshtein(upper(p_name), upper(p_type || ' ' || p_brand)) AS BIGINT) AS edits,
        levenshtein(upper(p_name), upper(p_name || substr(p_brand, 7))) <= 1 AS near FROM part"""
)
def edit_distance(spark, sf):
    p = table(spark, sf, "part")
    name = F.upper("p_name")
    return p.select(
        "p_partkey", big(F.levenshtein(name, F.upper(F.concat_ws(" ", "p_type", "p_brand")))).alias("edits"),
        similarity.within_edits(name, F.upper(F.concat("p_name", F.substring("p_brand", 7, 9))), 1).alias("near"),
    )


# --- similarity: the check SQL walks over the letters with list_reduce ---

def _jw_ctes(source: str, a: str, b: str, tag: str) -> str:
    """CTE ``jw_<tag>(doc_id, jw)`` for columns a, b of ``source``: greedy matches, halves, bonus at every similarity."""
    return f"""
    in_{tag} AS (SELECT doc_id, {a} AS a, {b} AS b, string_split({a}, '') AS la,
        CAST(floor(greatest(length({a}), length({b})) / 2.0) AS BIGINT) - 1 AS reach FROM {source}),
    walk_{tag} AS (SELECT *, CASE WHEN a = b OR a = '' OR b = '' OR reach < 0 THEN NULL ELSE list_reduce(
        la, lambda s, c: list_value(
            CASE WHEN instr(substr(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0) + 1,
                    CAST(s[3] AS BIGINT) + reach + 1 - greatest(CAST(s[3] AS BIGINT) - reach, 0)), c) > 0
                THEN left(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0)
                        + instr(substr(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0) + 1,
                    CAST(s[3] AS BIGINT) + reach + 1 - greatest(CAST(s[3] AS BIGINT) - reach, 0)), c) - 1) || '#'
                    || substr(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0)
                        + instr(substr(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0) + 1,
                    CAST(s[3] AS BIGINT) + reach + 1 - greatest(CAST(s[3] AS BIGINT) - reach, 0)), c) + 1)
                ELSE s[1] END,
            CASE WHEN instr(substr(s[1], greatest(CAST(s[3] AS BIGINT) - reach, 0) + 1,
                    CAST(s[3] AS BIGINT) + reach + 1 - greatest(CAST(s[3] AS BIGINT) - reach, 0)), c) > 0
                THEN s[2] || c ELSE s[2] END,
            CAST(CAST(s[3] AS BIGINT) + 1 AS VARCHAR)), list_value(b, '', '0')) END AS s FROM in_{tag}),
    seen_{tag} AS (SELECT *, s[2] AS ma, array_to_string(list_transform(range(1, length(b) + 1),
        lambda i: CASE WHEN substr(s[1], i, 1) = '#' THEN substr(b, i, 1) ELSE '' END), '') AS mb FROM walk_{tag}),
    base_{tag} AS (SELECT doc_id, a, b, CASE WHEN a = b THEN 1.0 WHEN s IS NULL OR ma = '' THEN 0.0 ELSE
        (CAST(length(ma) AS DOUBLE) / length(a) + CAST(length(ma) AS DOUBLE) / length(b)
        + (length(ma) - len(list_filter(range(1, length(ma) + 1),
            lambda i: substr(ma, i, 1) <> substr(mb, i, 1))) / 2.0) / length(ma)) / 3 END AS j,
        CASE WHEN left(a, 4) = left(b, 4) AND length(a) >= 4 AND length(b) >= 4 THEN 4
             WHEN left(a, 3) = left(b, 3) AND length(a) >= 3 AND length(b) >= 3 THEN 3
             WHEN left(a, 2) = left(b, 2) AND length(a) >= 2 AND length(b) >= 2 THEN 2
             WHEN left(a, 1) = left(b, 1) AND a <> '' AND b <> '' THEN 1 ELSE 0 END AS pre FROM seen_{tag}),
    jw_{tag} AS (SELECT doc_id, CASE WHEN a = b THEN 1.0 WHEN j = 0 THEN 0.0 ELSE j + pre * 0.1 * (1 - j) END AS jw
        FROM base_{tag})"""


_TOKENS = f"""tok AS (SELECT *, list_filter(string_split(target, ' '), lambda w: w NOT IN {_PART}) AS pt,
        list_filter(string_split(candidate, ' '), lambda w: w NOT IN {_PART}) AS pc FROM pairs),
    parts AS (SELECT doc_id, target, candidate, array_to_string(pt, ' ') AS c1, array_to_string(pc, ' ') AS c2,
        list_filter(pt, lambda w: length(w) >= 2) AS w1, list_filter(pc, lambda w: length(w) >= 2) AS w2 FROM tok),
    p AS (SELECT doc_id, target, candidate, c1, c2, coalesce(w1[1], '') AS f1, coalesce(w2[1], '') AS f2,
        w1[2:] AS s1, w2[2:] AS s2 FROM parts)"""
_COMMON = "(" + ", ".join(f"'{w}'" for w in C.COMMON_SURNAMES) + ")"


def _agree(x: str, y: str) -> str:
    return (
        f"({x} = {y} OR levenshtein({x}, {y}) <= 1 OR (length({x}) >= 5 AND length({y}) >= 4 "
        f"AND (starts_with({x}, {y}) OR starts_with({y}, {x})) "
        f"AND least(length({x}), length({y})) >= least(5.0, greatest(length({x}), length({y})) * CAST(0.6 AS DOUBLE))))"
    )


_OVERLAP = f"""
    xs AS (SELECT doc_id, unnest(s1) AS x, unnest(range(len(s1))) AS i FROM p),
    ys AS (SELECT doc_id, unnest(s2) AS y, unnest(range(len(s2))) AS j FROM p),
    hit AS (SELECT xs.doc_id, x, i, arg_min(y, j) AS y FROM xs JOIN ys ON xs.doc_id = ys.doc_id AND {_agree('x', 'y')}
        GROUP BY xs.doc_id, x, i),
    ov AS (SELECT doc_id, count(*) AS shared, bool_or(CASE WHEN x = y OR levenshtein(x, y) <= 1 OR length(x) > length(y)
        THEN x NOT IN {_COMMON} ELSE y NOT IN {_COMMON} END) AS rare FROM hit GROUP BY doc_id)"""
_FIRST_OK = """(f1 = f2 OR (f1 <> '' AND f2 <> '' AND left(f1, 1) = left(f2, 1) AND least(length(f1), length(f2)) > 3
        AND (levenshtein(f1, f2) <= 2 OR fj >= 0.85)))"""
_LAST_OK = """(len(s1) > 0 AND len(s2) > 0 AND (levenshtein(s1[len(s1)], s2[len(s2)]) <= 1
        OR (length(s1[len(s1)]) >= 4 AND length(s2[len(s2)]) >= 4 AND (starts_with(s1[len(s1)], s2[len(s2)])
        OR starts_with(s2[len(s2)], s1[len(s1)])))))"""


@query(f"WITH {S.PAIRS}, {_jw_ctes('pairs', 'target', 'candidate', 'n')} SELECT doc_id, round(jw, 9) AS jw FROM jw_n")
def jaro_winkler(spark, sf):
    return name_pairs(spark, sf).select(
        "doc_id", F.round(similarity.jaro_winkler(F.col("target"), F.col("candidate")), 9).alias("jw")
    )


@query(
    f"""WITH {S.PAIRS}, {_TOKENS}, {_jw_ctes('p', 'f1', 'f2', 'f')}
    SELECT p.doc_id, f1, f2, {_FIRST_OK.replace('fj', 'jw')} AS pass FROM p JOIN jw_f ON p.doc_id = jw_f.doc_id"""
)
def first_name_blocking(spark, sf):
    d = name_pairs(spark, sf).select(
        "doc_id", fold.first_name(F.col("target")).alias("f1"), fold.first_name(F.col("candidate")).alias("f2")
    )
    d = d.withColumn("jw", similarity.jaro_winkler(F.col("f1"), F.col("f2")))
    return d.select("doc_id", "f1", "f2", similarity.first_names_pass(F.col("f1"), F.col("f2"), F.col("jw")).alias("pass"))


@query(
    f"""WITH {S.PAIRS}, {_TOKENS}, {_OVERLAP} SELECT p.doc_id, coalesce(shared, 0) AS shared, coalesce(rare, false) AS rare
    FROM p LEFT JOIN ov ON p.doc_id = ov.doc_id"""
)
def surname_overlap(spark, sf):
    d = name_pairs(spark, sf).select(
        "doc_id",
        similarity.surname_overlap(fold.surnames(F.col("target")), fold.surnames(F.col("candidate"))).alias("o"),
    )
    return d.select("doc_id", big("o.count").alias("shared"), F.col("o.distinctive").alias("rare"))


_SCORE_CTES = f"""{_TOKENS}, {_OVERLAP}, {_jw_ctes('p', 'f1', 'f2', 'f')}, {_jw_ctes('p', 'c1', 'c2', 'c')},
    facts AS (SELECT p.*, coalesce(shared, 0) AS n, coalesce(rare, false) AS rare, jw_f.jw AS fj, jw_c.jw AS nj,
        coalesce({_LAST_OK}, false) AS lst FROM p LEFT JOIN ov ON p.doc_id = ov.doc_id
        JOIN jw_f ON p.doc_id = jw_f.doc_id JOIN jw_c ON p.doc_id = jw_c.doc_id),
    v1 AS (SELECT *, CASE WHEN rare THEN least(1.0, nj + 0.05) ELSE nj END AS a1 FROM facts),
    v2 AS (SELECT *, CASE WHEN n > 0 AND NOT rare AND len(s1) > 1 AND NOT lst THEN least(a1, 0.75) ELSE a1 END AS a2 FROM v1),
    v3 AS (SELECT *, CASE WHEN fj >= 0.85 AND lst THEN greatest(a2, 0.87) ELSE a2 END AS a3 FROM v2),
    v4 AS (SELECT *, CASE WHEN target = candidate THEN 1.0 WHEN f1 = '' OR f2 = '' OR NOT {_FIRST_OK} THEN 0.0
        WHEN n = 0 AND len(s1) > 0 AND len(s2) > 0 THEN 0.1
        WHEN f1 <> f2 THEN a3 * fj ELSE a3 END AS score FROM v3)"""
_SCORED = f"{S.PAIRS}, {_SCORE_CTES}"


_SCORE_REASON = f"""CASE WHEN target = candidate THEN 'EXATO' WHEN f1 = '' OR f2 = '' THEN 'NOME VAZIO'
        WHEN NOT {_FIRST_OK} THEN 'PRIMEIRO NOME DIFERENTE: ' || f1 || ' ≠ ' || f2
        WHEN n = 0 AND len(s1) > 0 AND len(s2) > 0 THEN 'SEM SOBRENOME EM COMUM'
        WHEN score >= 0.85 THEN 'SCORE ALTO (' || printf('%.2f', score) || ')'
        WHEN score >= 0.70 THEN 'CANDIDATO PARCIAL (' || printf('%.2f', score) || ')' ELSE 'SCORE BAIXO (' || printf('%.2f', score) || ')' END"""


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 9) AS score, score >= 0.85 AS accepted, {_SCORE_REASON} AS reason FROM v4")
def match_score(spark, sf):
    d = similarity.with_match_score(name_pairs(spark, sf), "target", "candidate")
    return d.select(
        "doc_id", F.round("score", 9).alias("score"), (F.col("score") >= C.MATCH.accept).alias("accepted"), "reason"
    )


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT *, {S.words('target', 3)} AS a, {S.words('candidate', 3)} AS b FROM pairs)
    SELECT doc_id, coalesce(target <> '' AND candidate <> '' AND (target = candidate OR (len(a) > 0 AND len(b) > 0 AND (
        (a[1] = b[1] AND a[len(a)] = b[len(b)])
        OR (len(list_filter(a, lambda x: list_contains(b, x))) >= 2
            AND len(list_filter(a, lambda x: list_contains(b, x))) >= ceil(least(len(a), len(b)) * CAST(0.6 AS DOUBLE)))))), false) AS same
    FROM w"""
)
def loose_equivalence(spark, sf):
    d = name_pairs(spark, sf)
    return d.select("doc_id", F.coalesce(similarity.loosely_equal(F.col("target"), F.col("candidate")), F.lit(False)).alias("same"))


# --- extraction ---

def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _re2(pattern: str) -> str:
    """A name pattern without look-around: the text behind the name is consumed, which changes no capture here."""
    code = "(?:[0-9][A-Z0-9]{0,4}|[A-Z0-9][0-9][A-Z0-9]{0,3}|[A-Z0-9]{2}[0-9][A-Z0-9]{0,2}|[A-Z0-9]{3}[0-9][A-Z0-9]?|[A-Z0-9]{4}[0-9])"
    return (
        pattern.replace(r"(?<![A-Za-z0-9_])(?=[A-Z0-9]*\d)[A-Z0-9]{1,5}", r"\b" + code)
        .replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?=", "(?:")
    )


_VALID = (
    "list_filter(list_transform(regexp_extract_all(page, '{p}', 1), lambda x: trim(x)), lambda x: "
    "len(list_filter(string_split(x, ' '), lambda w: length(w) > 1)) >= 2 AND length(x) BETWEEN 5 AND 60 "
    "AND len(list_filter(string_split(x, ' '), lambda w: length(w) > 1 AND (length(w) > 15 OR w IN {bad}))) = 0 "
    "AND list_filter(string_split(x, ' '), lambda w: length(w) > 1)[1] NOT IN {starts})[1]"
)


def _employee_sql(source: str, key: str) -> str:
    firsts = ", ".join(
        _VALID.replace("{p}", _re2(p)).replace("{bad}", _sql_list(C.NON_NAME_WORDS)).replace(
            "{starts}", _sql_list(C.LEADING_PREPOSITIONS))
        for p, _ in C.SLIP_NAME_PATTERNS
    )
    return f"WITH pg AS (SELECT {key}, {S.page_fold('text')} AS page FROM {source}) SELECT {key}, coalesce({firsts}) AS name FROM pg"


@query(_employee_sql("documents", "doc_id"))
def employee_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.employee_name(F.col("text")).alias("name"))


_SLIPS = f"""WITH {S.NAMED} SELECT doc_id, 'Folha Mensal Nome do Funcionário: ' || {S.initcap('name')} ||
    ' CPF: 123.456.789-00 Matrícula ' || doc_id AS text FROM named"""
_RECEIPTS = f"""WITH {S.NAMED} SELECT doc_id, CASE WHEN n_chars % 4 < 3 THEN 'Comprovante de transferência Favorecido: ' ||
    {S.initcap(S.altered('name', 'n_chars'))} || ' 12/05 R$ 10,00' ELSE 'Pago a ' || {S.initcap('name')} || ' em 12/05' END AS text
    FROM named"""


@query(_employee_sql(f"({_SLIPS})", "doc_id"))
def employee_extract_slips(spark, sf):
    s = slip_pages(spark, sf)
    return s.select(F.col("page_no").cast("bigint").alias("doc_id"), extract.employee_name(F.col("text")).alias("name"))


@query(
    f"""WITH n AS ({_employee_sql(f"({_SLIPS})", "doc_id")}), o AS (SELECT {S.fold('n.name', repair=True)} AS norm, n.name,
        CAST(substr(source, 4) AS BIGINT) * 8589934592 + doc_id % 2 * 4294967296 + doc_id AS emp_ord FROM n JOIN documents USING (doc_id)
        WHERE n.name IS NOT NULL)
    SELECT norm, min(emp_ord) AS emp_ord, min_by(name, emp_ord) AS name, min(emp_ord) % 4294967296 AS slip_page FROM o GROUP BY norm"""
)
def phased_slips(spark, sf):
    """U-1, W-1: pages with native text (even numbers) come before those read by OCR in the first-seen order."""
    found = employees_from_slips(slip_pages(spark, sf), F.col("page_no") % 2)
    return found.select("norm", "emp_ord", "name", big("slip_page").alias("slip_page"))


@query("SELECT c_custkey, upper(c_mktsegment) || ' DA SILVA' AS names FROM customer")
def payee_fallback(spark, sf):
    """X-2, word by word: no anchor follows the label's name, which ends at a stop word, a sign or a digit."""
    end = F.element_at(F.array(F.lit(" Sicredi 12 a"), F.lit(" ** lote 7"), F.lit(" x9 lote 7")), (F.col("c_custkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("Comprovante\u00a0Favorecido: "), F.initcap("c_mktsegment"), F.lit(" da Silva"), end)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(extract.payee_names(text), "|").alias("names"))


def _payee_sql(source: str, key: str) -> str:
    """Label pattern only: no page of the checked sources reaches the word-by-word fallback with two words."""
    pattern = extract._payee_pattern(C.PAYEE_LABELS, C.PAYEE_ANCHORS)
    return f"""WITH pg AS (SELECT {key}, trim({S.page_fold('text')}) AS page FROM {source}),
    n AS (SELECT {key}, list_filter(list_transform(regexp_extract_all(page, '{pattern.replace("(?=", "(?:")}', 1),
        lambda x: trim(x)), lambda x: length(x) >= 5
        AND len(list_filter(string_split(x, ' '), lambda w: length(w) > 1)) >= 2) AS names FROM pg)
    SELECT {key}, list_reduce(list_prepend('', names), lambda a, x: CASE WHEN contains('|' || a || '|', '|' || x || '|')
        THEN a ELSE a || CASE WHEN a = '' THEN '' ELSE '|' END || x END) AS payees FROM n"""


@query(_payee_sql(f"({_RECEIPTS})", "doc_id"))
def payee_extract(spark, sf):
    r = receipt_pages(spark, sf)
    return r.select(
        F.col("page_no").cast("bigint").alias("doc_id"), F.array_join(extract.payee_names(F.col("text")), "|").alias("payees")
    )


@query()
def payee_extract_documents(spark, sf):
    """Whole documents; labels are rare in them."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(extract.payee_names(F.col("text")), "|").alias("payees"))


@query(
    r"""SELECT doc_id, nullif(regexp_replace(regexp_extract(text,
        '\b(\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2})\b', 1), '\D', '', 'g'), '') AS tax_id FROM documents"""
)
def tax_id_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.tax_id(F.col("text")).alias("tax_id"))


@query(
    """SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS hits, CAST(coalesce(list_sum(p), 0) AS BIGINT) AS position_sum FROM (
        SELECT conv_id, turn, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = 'en') AS p
        FROM conversations)"""
)
def substring_positions(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", extract.positions_of(F.col("text"), F.lit("en")).alias("p"))
    return c.select(
        big("conv_id").alias("conv_id"), big("turn").alias("turn"), big(F.size("p")).alias("hits"),
        big(F.aggregate("p", F.lit(0), lambda a, x: a + x)).alias("position_sum"),
    )


# --- roster cells ---

@query(
    """SELECT o_orderkey, round(o_totalprice, 2) AS parsed, CAST(NULL AS DOUBLE) AS dash, CAST(0 AS DOUBLE) AS letters,
        round(o_totalprice, 2) AS comma_only, o_totalprice * 100 AS number, round(o_totalprice, 2) AS odd_spaces FROM orders"""
)
def locale_number(spark, sf):
    o = table(spark, sf, "orders")
    brl = F.concat(F.lit("R$ "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    comma = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    return o.select(
        "o_orderkey", roster.locale_number(brl).alias("parsed"),
        roster.locale_number(F.lit("-")).alias("dash"), roster.locale_number(F.col("o_orderstatus")).alias("letters"),
        roster.locale_number(comma).alias("comma_only"), roster.locale_number(F.lit("7"), F.col("o_totalprice") * 100).alias("number"),
        roster.locale_number(F.concat(F.lit("\u00a0R$\u00a0"), comma, F.lit("\u2003"))).alias("odd_spaces"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, CAST(NULL AS DOUBLE) AS from_text
    FROM customer"""
)
def positive_number(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", roster.positive_number(F.col("c_acctbal").cast("string")).alias("positive"),
        roster.positive_number(F.col("c_mktsegment")).alias("from_text"),
    )


_LINE = """(CASE c_custkey % 6 WHEN 0 THEN n_name || ' - ITAU' WHEN 1 THEN 'IFRS - ' || n_name
    WHEN 2 THEN '7 - MUNICIPIO DE ' || n_name WHEN 3 THEN n_name || ' ASSESSORIA LTDA'
    WHEN 4 THEN '12 - ' || c_mktsegment || ' SERVICE' ELSE n_name END)"""


@query(
    f"""SELECT c_custkey,
        CASE k WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN '7' WHEN 3 THEN line WHEN 4 THEN '12' ELSE n_name END AS city,
        CASE k WHEN 0 THEN line WHEN 1 THEN line WHEN 2 THEN n_name WHEN 5 THEN n_name ELSE '' END AS service_city,
        k = 0 AS is_city, k = 3 AS is_company, k NOT IN (3, 4) AS is_municipality,
        CASE k WHEN 2 THEN 'MUNICIPIO DE ' || n_name WHEN 4 THEN c_mktsegment || ' SERVICE' ELSE line END AS bare
    FROM (SELECT c_custkey, c_custkey % 6 AS k, n_name, c_mktsegment, {_LINE} AS line
        FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
)
def place_rules(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.expr(_LINE)
    return c.select(
        "c_custkey", roster.city_of_line(line).alias("city"), roster.city_of_service(line).alias("service_city"),
        roster.looks_like_city(line).alias("is_city"), roster.looks_like_company(line).alias("is_company"),
        roster.denotes_municipality(line).alias("is_municipality"), roster.without_code(line).alias("bare"),
    )


@query(
    """SELECT c_custkey, n_name || ' DA SILVA' AS employee, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS bank,
        CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE upper(c_mktsegment) END AS folded
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def cell_cleanup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    person = F.concat(
        F.lit("  "), F.col("n_name"), F.lit("   DA SILVA "),
        F.when(k % 2 == 0, F.lit("- PIX 51 999")).otherwise(F.lit("(51) 99999-1234 casa")),
    )
    contract = F.when(k % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("LIMPEZA - "), F.col("n_name"), F.lit(" ")))
    return c.select(
        "c_custkey", roster.clean_employee(person).alias("employee"), roster.bank_of_contract(contract).alias("bank"),
        roster.compare_fold(F.when(k % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))).alias("folded"),
    )


# --- display ---

@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line,
        CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || (s % 3600) // 60 || 'm ' || s % 60 || 's'
             WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS long_text,
        CASE WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || s % 60 || 's' END AS short_text
    FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) // 10 AS s FROM lineitem)"""
)
def duration_texts(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.floor(F.floor("l_extendedprice") / 10)
    return li.select(
        "l_orderkey", big("l_linenumber").alias("line"), present.duration_hms(s * 1000 + 7).alias("long_text"),
        present.duration_ms(s).alias("short_text"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '—' ELSE (CASE WHEN round(c_acctbal, 2) < 0 THEN '-' ELSE '' END) ||
        'R$ ' || translate(format('{:,.2f}', abs(c_acctbal)), ',.', '.,') END AS shown FROM customer"""
)
def money_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        F.translate(present.brl(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))), "\u00A0", " ").alias("shown"),
    )


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
        ['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', 'Setembro', 'Outubro', 'Novembro',
         'Dezembro'][month(o_orderdate)] AS month_name FROM orders"""
)
def run_date_parts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", big(F.year("o_orderdate")).alias("y"), big(F.month("o_orderdate")).alias("m"),
        present.month_name(F.month("o_orderdate")).alias("month_name"),
    )
