"""Registered queries: enrichment, manifest, dashboard, lists, policies, streams."""

import uuid

from pyspark.sql import functions as F

from ..operators import enrich, kpi, policy
from ..operators.scale import shared_folder
from ..sources import registry, sinks
from ..sources.schemas import EMPLOYEE_RECORDS, struct
from ..streaming import incremental
from . import sqltext as S
from .checks_functions import _employee_sql
from .checks_linkage import _VERSIONS, text_versions
from .checks_roster import _CUST
from .register import big, query
from .tables import table

# ---------------------------------------------------------------------------
# Roster and registry lookups
# ---------------------------------------------------------------------------

_ROSTER = """roster AS (SELECT p_partkey AS row_ord, upper(p_name || ' ' || p_type) AS norm, p_brand AS empresa, p_type AS cidade,
        CAST(p_size AS VARCHAR) AS contrato, upper(split_part(p_name, ' ', 1)) AS a, upper(p_type) AS b,
        list_filter(string_split(upper(p_name || ' ' || p_type), ' '), lambda w: length(w) >= 2) AS w FROM part)"""


def _roster(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("row_ord"), F.concat_ws(" ", "p_name", "p_type").alias("colaborador"),
        F.col("p_brand").alias("empresa"), F.col("p_type").alias("cidade"), F.col("p_size").cast("string").alias("contrato"),
    )


def _lookup_names(spark, sf):
    """Names of the roster itself, and names that share only first and last word with it."""
    p = table(spark, sf, "part")
    exact = p.select(F.initcap(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    ends = p.select(
        F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.lit("de"), F.translate("p_brand", "#0123456789", "XABCDEFGHIJ"), "p_type").alias("name")
    )
    return exact.unionByName(ends).distinct()


@query(
    f"""WITH {_ROSTER}, names AS (SELECT DISTINCT {S.initcap("p_name || ' ' || p_type")} AS name FROM part
        UNION SELECT split_part(p_name, ' ', 1) || ' de ' || translate(p_brand, '#0123456789', 'XABCDEFGHIJ') || ' ' || p_type FROM part),
    n AS (SELECT name, upper(regexp_replace(name, '[^A-Za-z ]', '', 'g')) AS norm, upper(split_part(name, ' ', 1)) AS a,
        upper(string_split(name, ' ')[-1]) AS b FROM names),
    ex AS (SELECT norm, min_by(struct_pack(empresa, cidade, contrato), row_ord) AS x FROM roster GROUP BY norm),
    en AS (SELECT a, b, min_by(struct_pack(empresa, cidade, contrato), row_ord) AS y FROM roster WHERE len(w) >= 2 GROUP BY a, b HAVING count(*) = 1)
    SELECT name, coalesce(x, y).empresa AS empresa, coalesce(x, y).cidade AS cidade, coalesce(x, y).contrato AS contrato
    FROM n LEFT JOIN ex USING (norm) LEFT JOIN en ON n.a = en.a AND n.b = en.b"""
)
def roster_lookup(spark, sf):
    """J-7."""
    return enrich.roster_lookup(_lookup_names(spark, sf), _roster(spark, sf))


@query(
    f"""WITH {_ROSTER}, names AS (SELECT DISTINCT p_name AS name FROM part),
    n AS (SELECT name, upper(name) AS norm, upper(split_part(name, ' ', 1)) AS a, upper(split_part(name, ' ', 2)) AS b FROM names),
    en AS (SELECT a, b, min_by(struct_pack(empresa, cidade), row_ord) AS y FROM roster GROUP BY a, b HAVING count(*) = 1)
    SELECT name, y.empresa AS empresa, y.cidade AS cidade FROM n LEFT JOIN en ON n.a = en.a AND n.b = en.b"""
)
def roster_company_and_city(spark, sf):
    """J-8."""
    return enrich.roster_company_and_city(table(spark, sf, "part").select(F.col("p_name").alias("name")), _roster(spark, sf))


_ACTIVE = "act AS (SELECT upper(p_name || ' ' || p_type) AS norm, p_brand AS empresa, p_type AS cidade, CAST(p_size AS VARCHAR) AS contrato FROM part)"


def _active(spark, sf):
    return _roster(spark, sf).select(F.upper("colaborador").alias("nome_normalizado"), "empresa", "cidade", "contrato")


def _links(spark, sf):
    """One link per part; company known for some only."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("link_ord"), F.initcap(F.concat_ws(" ", "p_name", "p_type")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("empresa"), F.lit(None).cast("string").alias("cidade"),
        F.when(F.col("p_size") % 3 == 0, F.lit("São José / 01")).alias("contrato"),
    )


_FILLED = f"""{_ACTIVE}, one AS (SELECT norm, min(empresa) AS e, min(cidade) AS m, min(contrato) AS c FROM act GROUP BY norm HAVING count(*) = 1),
    fl AS (SELECT p_partkey AS link_ord, {S.initcap("p_name || ' ' || p_type")} AS name,
        coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, ''), e) AS empresa, m AS cidade,
        coalesce(CASE WHEN p_size % 3 = 0 THEN 'São José / 01' END, c) AS contrato
    FROM part LEFT JOIN one ON upper(p_name || ' ' || p_type) = norm)"""


@query(f"WITH {_FILLED} SELECT * FROM fl")
def registry_fallback(spark, sf):
    """J-9, A-16."""
    return enrich.registry_fallback(_links(spark, sf), _active(spark, sf)).select("link_ord", "name", "empresa", "cidade", "contrato")


_OUT = (
    f"{S.file_part('''coalesce(empresa, 'EMPRESA')''')} || '_' || {S.file_part('''coalesce(cidade, 'CIDADE')''')} || '_' || "
    f"{S.file_part('''coalesce(contrato, 'CONTRATO')''')} || '_' || {S.file_part('name')} || '.pdf'"
)


@query(
    f"""WITH {_FILLED} SELECT {_OUT} AS out_file, max(link_ord) AS link_ord, count(*) - 1 AS collisions, 2026 AS year, 3 AS month,
        'Março' AS month_name FROM fl GROUP BY 1"""
)
def output_manifest(spark, sf):
    """IO-14, S-5, S-25, W-10: the manifest as written and read back."""
    filled = enrich.registry_fallback(_links(spark, sf), _active(spark, sf))
    folder = f"{_folder(spark)}/manifest"
    sinks.write_manifest(enrich.manifest(filled, F.lit("2026-03-01").cast("timestamp")), folder)
    return spark.read.parquet(folder).select("out_file", "link_ord", "collisions", "year", "month", "month_name")


@query(
    f"""WITH {_FILLED}, t AS (SELECT empresa FROM fl WHERE empresa <> '' GROUP BY empresa ORDER BY count(*) DESC, min(link_ord) LIMIT 1)
    SELECT {S.file_part('empresa')} || '_Marco_2026_PDFs.zip' AS run_name FROM t"""
)
def run_archive_name(spark, sf):
    """A-11, S-25."""
    filled = enrich.registry_fallback(_links(spark, sf), _active(spark, sf))
    return enrich.archive_name(filled, F.lit("2026-03-01").cast("timestamp"))


@query(
    """SELECT CAST(l_suppkey AS VARCHAR) AS empresa, count(*) AS links, min(l_orderkey * 8 + l_linenumber) AS first_ord FROM lineitem
    GROUP BY l_suppkey ORDER BY links DESC, first_ord LIMIT 1"""
)
def modal_company(spark, sf):
    """A-11."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("empresa"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("link_ord")
    )
    return enrich.modal_company(li)


@query(
    """SELECT c_custkey AS id, c_name AS nome, coalesce(n_name, '—') AS empresa, coalesce(r_name, '—') AS cidade, s AS salario
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0
    LEFT JOIN region ON c_nationkey % 7 = r_regionkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def registry_display(spark, sf):
    """J-10."""
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    emp = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.col("c_nationkey").alias("empresa_id"),
                   (F.col("c_nationkey") % 7).alias("municipio_id"))
    companies = n.filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nome"))
    cities = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("nome"))
    salaries = o.groupBy(F.col("o_custkey").alias("funcionario_id")).agg(F.max("o_totalprice").alias("salario"))
    return registry.display_join(emp, companies, cities, salaries).select("id", "nome", "empresa", "cidade", "salario")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(upper(c_name), 'R#00000001') AND c_acctbal > 0")
def registry_search(spark, sf):
    """P-15, P-16."""
    c = table(spark, sf, "customer").withColumns({"ativo": F.col("c_acctbal") > 0, "nome_normalizado": F.upper("c_name")})
    return registry.search_by_name(registry.active_only(c), "r#00000001 ").select("c_custkey", "c_name")


# ---------------------------------------------------------------------------
# Dashboard and lists
# ---------------------------------------------------------------------------

_RUNS = """runs AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at, user_id AS pdf_count,
        CASE WHEN event_type = 'click' THEN '[' || props || ',' || props || ']' WHEN event_type = 'view' THEN props END AS unprocessed_data FROM events)"""


def _runs(spark, sf):
    e = table(spark, sf, "events")
    data = F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).when(
        F.col("event_type") == "view", F.col("props")
    )
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("pdf_count"),
        F.lit(None).cast("int").alias("misses"), data.alias("unprocessed_data"),
    )


@query(
    f"""WITH {_RUNS}, top AS (SELECT * FROM runs ORDER BY created_at DESC, id LIMIT 100),
    s AS (SELECT CAST(sum(pdf_count) AS BIGINT) AS documents, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_run,
        CAST(sum(CASE WHEN left(unprocessed_data, 1) = '[' THEN 2 ELSE 0 END) AS BIGINT) AS misses FROM top)
    SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS employees, (SELECT count(*) FROM nation) AS companies,
        (SELECT count(*) FROM region) AS cities, documents, last_run,
        CAST(floor(100.0 * documents / (documents + misses) + 0.5) AS BIGINT) AS success_percent FROM s"""
)
def dashboard_kpis(spark, sf):
    """A-6, S-31."""
    emp = table(spark, sf, "customer").select((F.col("c_acctbal") > 0).alias("ativo"))
    d = kpi.dashboard(emp, table(spark, sf, "nation"), table(spark, sf, "region"), _runs(spark, sf))
    return d.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id LIMIT 100")
def top_runs(spark, sf):
    """L-3, L-2."""
    e = table(spark, sf, "events").withColumns({"created_at": F.col("ts"), "id": F.col("event_id")})
    return registry.top_runs(e).select("event_id", "value")


@query(
    f"""WITH {_RUNS} SELECT id, CASE WHEN left(unprocessed_data, 1) = '[' THEN 2 ELSE 1 END AS copies FROM runs"""
)
def run_misses(spark, sf):
    """S-31: one row per miss, one for runs without."""
    return kpi.runs_with_misses(_runs(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders")
def pending_links(spark, sf):
    """P-21."""
    return kpi.pending(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), "O")


@query(
    """SELECT c_custkey, c_name, CAST(ceil(t.n / 50.0) AS INTEGER) AS page, CAST(ceil(t.n / 50.0) AS INTEGER) AS pages, t.n AS total
    FROM customer, (SELECT count(*) AS n FROM customer) t ORDER BY c_name, c_custkey
    OFFSET (SELECT (CAST(ceil(count(*) / 50.0) AS INTEGER) - 1) * 50 FROM customer)"""
)
def page_slice(spark, sf):
    """L-4, L-1: a page number behind the end shows the last page."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = registry.page_slice(c, ["c_name", "c_custkey"], 1_000_000_000, 50, rows=400)
    return out.withColumn("total", big("total"))


@query("SELECT p_partkey AS row_ord, p_name, true AS has_more FROM part ORDER BY p_partkey LIMIT 20")
def record_preview(spark, sf):
    """L-5."""
    head, more = registry.preview(table(spark, sf, "part").select(F.col("p_partkey").alias("row_ord"), "p_name"))
    return head.withColumn("has_more", more)


@query("SELECT user_id, min(event_type) AS role FROM events WHERE user_id = 7 GROUP BY user_id")
def role_of_user(spark, sf):
    """L-7."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("role"))
    return registry.role_of(e, "7").select(F.col("user_id").cast("bigint").alias("user_id"), "role")


# ---------------------------------------------------------------------------
# Policies
# ---------------------------------------------------------------------------

_ROLES = """roles AS (SELECT DISTINCT user_id, CASE event_type WHEN 'purchase' THEN 'admin' WHEN 'error' THEN 'financeiro' ELSE 'employee' END AS role
        FROM events WHERE value > 30)"""


def _roles(spark, sf):
    role = F.when(F.col("event_type") == "purchase", "admin").when(F.col("event_type") == "error", "financeiro").otherwise("employee")
    return table(spark, sf, "events").filter("value > 30").select("user_id", role.alias("role")).distinct()


@query(
    f"""WITH {_ROLES}, u AS (SELECT min(user_id) AS x FROM events)
    SELECT policy, count(*) AS rows FROM (
        SELECT 'own_rows' AS policy FROM events, u WHERE user_id = x
        UNION ALL SELECT 'own_or_admin' FROM events, u WHERE user_id = x OR EXISTS (SELECT 1 FROM roles WHERE user_id = x AND role = 'admin')
        UNION ALL SELECT 'admin_only' FROM events, u WHERE EXISTS (SELECT 1 FROM roles WHERE user_id = x AND role = 'admin')
        UNION ALL SELECT 'salary' FROM events, u WHERE EXISTS (SELECT 1 FROM roles WHERE user_id = x AND role IN ('admin', 'financeiro')))
    GROUP BY policy"""
)
def row_policy(spark, sf):
    """P-22, J-11: the rows the lowest user id may see under each policy."""
    e, roles = table(spark, sf, "events"), _roles(spark, sf)
    user = e.agg(F.min("user_id")).first()[0]
    out = None
    for p in (policy.OWN_ROWS, policy.OWN_OR_ADMIN, policy.ADMIN_ONLY, policy.SALARY):
        n = policy.restrict(e, roles, user, p).groupBy(F.lit(p).alias("policy")).agg(F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    f"""WITH {_ROLES} SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM roles WHERE role IN ('admin', 'financeiro'))"""
)
def users_with_any_role(spark, sf):
    """J-11."""
    return policy.with_role(table(spark, sf, "events").select("user_id").distinct(), _roles(spark, sf), "admin", "financeiro")


@query(
    f"""WITH {_ROLES} SELECT user_id, coalesce(max(role), 'employee') AS role FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN roles USING (user_id)
    GROUP BY user_id"""
)
def users_and_roles(spark, sf):
    """J-12, after new users got the default role."""
    users = table(spark, sf, "events").select("user_id").distinct()
    return policy.users_with_role(users, policy.add_default_roles(users, _roles(spark, sf)))


_IP = "'10.' || user_id % 300 || '.' || event_id % 260 || '.1'"


@query(
    f"""SELECT event_id, {_IP} IN (SELECT DISTINCT {_IP} FROM events WHERE event_type = 'purchase' AND value > 30) AS listed,
        true AS open, user_id % 300 <= 255 AND event_id % 260 <= 255 AS well_formed FROM events"""
)
def allow_list(spark, sf):
    """J-13, P-23: with active entries, and with none."""
    e = table(spark, sf, "events").withColumn("ip", F.expr("concat('10.', user_id % 300, '.', event_id % 260, '.1')"))
    entries = e.filter("event_type = 'purchase'").select("ip", (F.col("value") > 30).alias("active")).distinct()
    listed = policy.allow(e.select("event_id", "ip"), entries).withColumnRenamed("allowed", "listed")
    none = policy.allow(listed, entries.filter("false")).withColumnRenamed("allowed", "open")
    return none.select("event_id", "listed", "open", policy.well_formed_ip(F.col("ip")).alias("well_formed"))


# ---------------------------------------------------------------------------
# Streams
# ---------------------------------------------------------------------------

def _stream(spark, sf, name, files=1):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf}/{name}.parquet*")


def _splits(spark, sf, name):
    """Splits of a table's plain scan."""
    return max(1, spark.read.parquet(f"{sf}/{name}.parquet").rdd.getNumPartitions())


def _folder(spark):
    return f"{shared_folder(spark)}/vinculo/stream-{uuid.uuid4().hex}"


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query(
    f"""WITH n AS ({_employee_sql('documents', 'doc_id')})
    SELECT source AS file_id, CAST(substr(source, 4) AS INTEGER) AS file_ord, CAST(doc_id AS INTEGER) AS page_no, name,
        {S.fold('name', repair=True)} AS norm FROM documents JOIN n USING (doc_id) WHERE name IS NOT NULL"""
)
def stream_extraction(spark, sf):
    """T-1: documents arrive as files, a batch has one for every core; names are extracted, the stored result is read back."""
    pages = _stream(spark, sf, "documents", spark.sparkContext.defaultParallelism).select(
        F.col("source").alias("file_id"), F.substring("source", 4, 9).cast("int").alias("file_ord"),
        F.col("doc_id").cast("int").alias("page_no"), F.lit("2026-01-01").cast("timestamp").alias("started_at"), "text",
    )
    folder = _folder(spark)
    _finish(incremental.resume_extraction(pages, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema(incremental.extract_slips(pages).schema).parquet(f"{folder}/out").drop("started_at")


def _dropped_files(parts, folder, files):
    """A stream of tables that arrive one after the other, each in a number of files that make one batch."""
    for k, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{folder}/in/drop={k}")
    return parts[0].sparkSession.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")


@query("SELECT upper(p_name) AS norm, min(p_partkey) AS entry_ord FROM part GROUP BY 1")
def stream_first_seen(spark, sf):
    """T-2: entries arrive in four drops, those with smaller numbers last."""
    entries = table(spark, sf, "part").select(F.upper("p_name").alias("norm"), F.col("p_partkey").alias("entry_ord"))
    most = entries.agg(F.max("entry_ord")).first()[0] or 0
    quarter = F.floor(F.col("entry_ord") * 4 / (most + 1))
    folder = _folder(spark)
    stream = _dropped_files([entries.filter(quarter == k) for k in (3, 2, 1, 0)], folder, _splits(spark, sf, "part"))
    _finish(incremental.first_seen_stream(stream, f"{folder}/out", f"{folder}/checkpoint", buckets=8))
    return incremental.current_rows(spark, f"{folder}/out", stream.schema)


@query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id AS run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at,
        count(*) AS saves, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS closed_at
    FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_closed_runs(spark, sf):
    """T-3 as a stream: runs of a user are closed six hours after their last saved state; those still open at the end aren't told."""
    states = _stream(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"))
    closed = incremental.close_idle_runs(states, hours=6)
    folder = _folder(spark)
    _finish(incremental.append_stream(closed, f"{folder}/out", f"{folder}/checkpoint"))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at", "closed_at")}
    return spark.read.schema(closed.schema).parquet(f"{folder}/out").withColumns(shown)


_ARRIVALS = "TIMESTAMP '2026-03-01 00:00:00' + INTERVAL 1 MINUTE * conv_id"


@query(
    f"""WITH {_VERSIONS}, t AS (SELECT *, CAST(file_id AS BIGINT) AS conv_id FROM y),
    w AS (SELECT *, {_ARRIVALS} + INTERVAL 1 MINUTE * CASE WHEN retry IS NOT NULL THEN 12 WHEN ocr IS NOT NULL THEN 5 ELSE 0 END AS last_at FROM t)
    SELECT file_id, page_no, CASE WHEN nl >= 100 THEN native WHEN retried AND rl > ol THEN retry
        ELSE coalesce(ocr, '[Empty page ' || page_no || ']') END AS text
    FROM w WHERE last_at + INTERVAL 30 MINUTE <= (SELECT max(last_at) FROM w) - INTERVAL 10 MINUTE"""
)
def stream_text_versions(spark, sf):
    """IO-6 and U-1 as a stream: native text, OCR and retries arrive by and by, some never; pages still waiting at the end aren't told."""
    delay = F.when(F.col("stage") == "retry", 12).when(F.col("stage") == "ocr", 5).otherwise(0)
    minutes = F.col("file_id").cast("long") + delay
    seconds = F.unix_timestamp(F.lit("2026-03-01").cast("timestamp")) + 60 * minutes
    # Every second page arrives eight minutes after its time, which the watermark's ten allow for.
    versions = text_versions(spark, sf).withColumns({"at": F.timestamp_seconds(seconds), "arrival": minutes + 8 * (F.col("page_no") % 2)})
    most = versions.agg(F.max("arrival")).first()[0] or 0
    quarter = F.floor(F.col("arrival") * 4 / (most + 1))
    folder = _folder(spark)
    stream = _dropped_files([versions.filter(quarter == k).drop("arrival") for k in range(4)], folder, _splits(spark, sf, "conversations"))
    settled = incremental.arriving_versions(stream)
    _finish(incremental.append_stream(settled, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema(settled.schema).parquet(f"{folder}/out").select("file_id", big("page_no").alias("page_no"), "text")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def stale_states(spark, sf):
    """T-3."""
    e = table(spark, sf, "events").withColumn("started_at", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("started_at")).first()[0]
    return incremental.drop_stale(e, F.lit(now)).select("event_id")


_UPLOADS = f"""{_CUST}, up AS (SELECT *, c_custkey % 3 AS k, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS upload FROM cust WHERE n_nationkey % 5 <> 0),
    g AS (SELECT upload, {S.fold('seg')} AS empresa, {S.fold('nat')} AS cidade, {S.fold('person')} || CASE k WHEN 2 THEN ' NETO' ELSE '' END AS nome,
        min_by(c_custkey, c_custkey) AS first_key, max_by(c_custkey, c_custkey) AS last_key, max(c_custkey) FILTER (WHERE c_custkey % 4 <> 0) AS paid_key
        FROM up WHERE upload = 0 OR n_nationkey % 2 = 0 GROUP BY ALL),
    j AS (SELECT coalesce(a.empresa, b.empresa) AS empresa, coalesce(a.cidade, b.cidade) AS cidade, coalesce(a.nome, b.nome) AS nome,
        a.first_key AS a_key, b.first_key AS b_first, b.last_key AS b_last, coalesce(b.paid_key, a.paid_key) AS paid_key
        FROM (SELECT * FROM g WHERE upload = 0) a FULL JOIN (SELECT * FROM g WHERE upload = 1) b USING (empresa, cidade, nome))"""


@query(
    f"""WITH {_UPLOADS} SELECT empresa, cidade, nome AS nome_normalizado,
        'K' || CASE WHEN b_last IS NULL THEN a_key % 2 WHEN a_key IS NULL THEN b_first % 2 ELSE b_last % 2 END AS contrato,
        b_last IS NOT NULL OR cidade NOT IN (SELECT cidade FROM g WHERE upload = 1) AS ativo, CAST(paid_key AS DOUBLE) AS salario FROM j"""
)
def stream_merge(spark, sf):
    """T-4: two uploads in two files, each merged by J-14 to J-16; the second one covers cities of even nations only."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("n_nationkey % 5 <> 0")
    key = F.col("c_custkey")
    given = {
        "file": F.lit("u"), "row_ord": key, "empresa": F.initcap("c_mktsegment"), "cidade": F.initcap("n_name"),
        "colaborador": F.concat_ws(" ", F.initcap("c_mktsegment"), F.initcap("n_name"), F.lit("da Silva"), F.when(key % 3 == 2, "Neto")),
        "contrato": F.concat(F.lit("K"), (key % 2).cast("string")), "salario": F.when(key % 4 != 0, key),
    }
    # The folder with the higher number arrives first.
    part = F.when(key % 3 == 0, F.lit(0)).otherwise(F.lit(1))
    records = c.filter((key % 3 != 0) | (F.col("n_nationkey") % 2 == 0)).select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(EMPLOYEE_RECORDS)], part.alias("upload")
    )
    folder = _folder(spark)
    stream = _dropped_files([records.filter(F.col("upload") == k).drop("upload") for k in (1, 0)], folder, _splits(spark, sf, "customer"))
    _finish(incremental.merge_uploads(stream, f"{folder}/registry", f"{folder}/checkpoint", F.lit("2026-01-01").cast("timestamp"), buckets=8))
    t = incremental.registry_tables(spark, f"{folder}/registry")
    company = t["empresas"].select(F.col("id").alias("empresa_id"), F.col("nome_normalizado").alias("empresa"))
    city = t["municipios"].select(F.col("id").alias("municipio_id"), F.col("nome_normalizado").alias("cidade"))
    paid = t["funcionarios_salario"].select(F.col("funcionario_id").alias("id"), F.col("salario").cast("double").alias("salario"))
    return t["funcionarios"].join(company, "empresa_id").join(city, "municipio_id").join(paid, "id", "left").select(
        "empresa", "cidade", "nome_normalizado", "contrato", "ativo", "salario"
    )


@query(
    """SELECT sha256('u|' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')) AS id, CAST(count(*) AS BIGINT) AS total, 'u' AS file_name,
        0 AS total_empresas, 0 AS total_municipios, 0 AS funcionarios_novos, 0 AS funcionarios_atualizados, 0 AS funcionarios_removidos FROM orders"""
)
def upload_history(spark, sf):
    """IO-11."""
    stats = table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.max("o_orderdate").cast("timestamp").alias("at"),
        *[F.lit(0).alias(c) for c in ("empresas", "municipios", "novos", "atualizados", "removidos")],
    )
    row = sinks.upload_history_row(stats, F.lit("u"), F.col("at"))
    return row.select("id", big("total_funcionarios").alias("total"), "file_name", *[
        c for c in row.columns if c.startswith(("total_e", "total_m", "funcionarios_"))
    ])


@query(
    """SELECT sha256('u|2026-03-01 00:00:00') AS id, 'u' AS user_id, 10 AS pdf_count, 12 AS duration_seconds, 3 AS month, 2026 AS year,
        'Março' AS month_name, CAST(count(*) AS INTEGER) AS misses FROM events"""
)
def run_history(spark, sf):
    """IO-12: the history row of a run whose misses are the events, written and read back."""
    from .checks_linkage import _report

    folder = f"{_folder(spark)}/processing_history"
    sinks.append(sinks.run_history_row(_report(spark, sf), 10, 12345, F.lit("2026-03-01").cast("timestamp"), F.lit("u")), folder)
    back = registry.read_registry(spark, folder.rpartition("/")[0], "processing_history")
    return back.select("id", "user_id", "pdf_count", "duration_seconds", "month", "year", "month_name", "misses")
