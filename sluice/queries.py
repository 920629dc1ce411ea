"""The feed engine's queries over the test tables, and the same in DuckDB's SQL.

The tables hold no feeds, so feeds are made of them: `orders` is rendered as raw text
the way clients send it (padded, thousands separators, day-first dates, a debit mark),
and put through the readers, the projection and the checks like any file.
"""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FeedError
from .functions.text import LINE_END, decimal_of, money, run_id, truncated, truncated_tail
from .ledger import Ledger
from .operators import checks, custom, guard, manifest, metrics, reports, tables, versions
from .operators.counts import KeptCounts
from .operators.profile import as_pins, long_form, profile
from .operators.transform import load, project, project_plans, quarantine
from .plans.contract import ColumnSpec, FeedContract
from .plans.plan import IngestionPlan, compile_plan, dag, inject, mapping_document
from .schemas import CANONICAL
from .service import route
from .sources import bulk, encoded, files, quoted
from .streaming.arrivals import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS = FeedContract(
    client="orders", feed_name="daily", format="csv",
    columns=(
        ColumnSpec("ref", "trade_id"), ColumnSpec("acct", "account_id"),
        ColumnSpec("day", "value_date", "date", "%d/%m/%Y"),
        ColumnSpec("amt", "amount", "decimal", sign_column="mark", negative_marker="F"),
        ColumnSpec("mark"), ColumnSpec("ccy", "currency", default="usd"),
        ColumnSpec("cpty", "counterparty"), ColumnSpec("memo", "description"),
    ),
)


def price(c: str = "o_totalprice") -> Column:
    return F.col(c).cast("decimal(18,2)")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a client's text fields."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("idx"), F.lit("orders").alias("sample"),
        F.concat(F.lit("  ORD-"), F.lpad(key.cast("string"), 10, "0"), F.lit("\t")).alias("ref"),
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("acct"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.format_number(price(), 2).alias("amt"),
        F.col("o_orderstatus").alias("mark"), F.when(key % 3 == 1, "eur").when(key % 3 == 2, "Gbp").otherwise("").alias("ccy"),
        F.when(key % 10 == 0, " ").otherwise(F.concat(F.lit("CP-"), (F.col("o_custkey") % 97).cast("string"))).alias("cpty"),
        F.col("o_orderpriority").alias("memo"),
    )


def canonical(spark: SparkSession, sf_dir: str, plan: IngestionPlan | None = None, keep=("o_orderkey",)) -> DataFrame:
    raw = raw_orders(spark, sf_dir)
    fields = {c.source: F.col(c.source) for c in ORDERS.columns}
    return project(raw, fields, plan or compile_plan(ORDERS), keep=tuple(keep))


CANON = """canon AS (SELECT o_orderkey, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS trade_id,
  'CUST-' || CAST(o_custkey AS VARCHAR) AS account_id, strftime(o_orderdate, '%Y-%m-%d') AS value_date,
  CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  CASE o_orderkey % 3 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'CP-' || CAST(o_custkey % 97 AS VARCHAR) END AS counterparty,
  o_orderpriority AS description FROM orders)"""

SQL: dict[str, str] = {}


def canonical_projection(spark, sf_dir):
    return canonical(spark, sf_dir).select("o_orderkey", *CANONICAL)


SQL["canonical_projection"] = f"WITH {CANON} SELECT * FROM canon"


def _typed(rows: DataFrame, raw: dict[str, Column]) -> DataFrame:
    return rows.select(
        raw["key"].cast("long").alias("o_orderkey"), money(decimal_of(F.replace(raw["amount"], F.lit(","), F.lit("")))).alias("amount"),
        F.rtrim(raw["memo"]).alias("memo"), F.col("_fault").isNull().alias("sound"),
    )


_TYPED = """SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  {memo} AS memo, TRUE AS sound FROM orders"""


def csv_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(
            F.col("o_orderkey").cast("string"), F.lit(',"'), F.format_number(price(), 2), F.lit('","say ""'), F.col("o_orderpriority"), F.lit('"" twice"')
        ).alias("line")
    )
    return _typed(*files.with_csv(rows, ["key", "amount", "memo"], ",", strict=True))


SQL["csv_roundtrip"] = _TYPED.format(memo="'say \"' || o_orderpriority || '\" twice'")


def csv_field_faults(spark, sf_dir):
    cut = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, ",x,y").otherwise(",x")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a"), cut).alias("line"))
    rows, _ = files.with_csv(rows, ["k", "v"], ",", strict=True)
    return rows.groupBy((F.col("o_orderkey") % 4).alias("kind")).agg(F.count_if(F.col("_fault").isNotNull()).alias("faults"), F.count("*").alias("n"))


SQL["csv_field_faults"] = """SELECT o_orderkey % 4 AS kind, CAST(SUM(CASE WHEN o_orderkey % 4 <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS faults,
  COUNT(*) AS n FROM orders GROUP BY 1"""


def csv_lenient(spark, sf_dir):
    cut = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, ",x,y").otherwise(",x")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a"), cut).alias("line"))
    rows, raw = files.with_csv(rows, ["k", "v"], ",", strict=False)
    return rows.select("o_orderkey", raw["k"].alias("k"), raw["v"].alias("v"))


SQL["csv_lenient"] = "SELECT o_orderkey, 'a' AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS v FROM orders"


def fixed_width_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.lpad(price().cast("string"), 16, " "), F.rpad("o_orderpriority", 20, " ")).alias("line")
    )
    rows, raw = files.with_fixed(rows, ["0:12", "12:28", "28:48"], strict=True)
    return _typed(rows, {"key": F.trim(raw["0:12"]), "amount": F.trim(raw["12:28"]), "memo": raw["28:48"]})


SQL["fixed_width_roundtrip"] = _TYPED.format(memo="o_orderpriority")


def jsonl_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(F.col("o_orderkey").alias("key"), price().alias("amount"), F.col("o_orderpriority").alias("memo"))).alias("line")
    )
    return _typed(*files.with_json(rows, ["key", "amount", "memo"], strict=True))


SQL["jsonl_roundtrip"] = _TYPED.format(memo="o_orderpriority")


def json_props(spark, sf_dir):
    rows, raw = files.with_json(table(spark, sf_dir, "events").withColumnRenamed("props", "line"), ["k", "none"], strict=True)
    return rows.select("event_id", raw["k"].alias("k"), F.coalesce(raw["none"], F.lit("")).alias("absent"), F.col("_fault").isNull().alias("sound"))


SQL["json_props"] = "SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS absent, TRUE AS sound FROM events"


def _document_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.coalesce("text", F.lit("")).alias("text"))


def framed_lines(spark, sf_dir):
    framed = files.frame(_document_texts(spark, sf_dir), 0, 0)
    return framed.select(F.col("sample").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"))


_LINES = "[x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\s]')]"
SQL["framed_lines"] = f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_lines FROM documents"


def header_trailer_strip(spark, sf_dir):
    framed = files.frame(_document_texts(spark, sf_dir), 1, 1)
    return framed.select(
        F.col("sample").alias("doc_id"), F.size("body").cast("long").alias("n_body"),
        F.sha2(F.array_join("body", "\n").cast("binary"), 256).alias("body_sha256"),
    )


SQL["header_trailer_strip"] = f"""WITH l AS (SELECT doc_id, {_LINES} AS x FROM documents), b AS (
  SELECT doc_id, CASE WHEN len(x) > 2 THEN x[2:len(x) - 1] ELSE [] END AS body FROM l)
  SELECT doc_id, CAST(len(body) AS BIGINT) AS n_body, sha256(coalesce(array_to_string(body, chr(10)), '')) AS body_sha256 FROM b"""


def peek_lines(spark, sf_dir):
    return files.peek(_document_texts(spark, sf_dir), 3).select(F.col("sample").alias("doc_id"), F.col("idx").cast("long").alias("idx"), "line")


SQL["peek_lines"] = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
  t AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM l)
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, a[i] AS line FROM t, unnest(range(1, 4)) AS r(i) WHERE i <= len(a)"""


def catalog_digest(spark, sf_dir):
    return files.with_digests(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content")))


SQL["catalog_digest"] = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"


def _profile_columns() -> list[Column]:
    return [
        "rows", F.col("amount_sum").cast("decimal(38,2)").cast("string").alias("amount_sum"), "unparseable",
        *(f"null_{c}" for c in CANONICAL), *(f"distinct_{c}" for c in CANONICAL),
    ]


def profile_canonical(spark, sf_dir):
    """Count, exact sum, null rates and distinct counts of the whole feed."""
    return profile(canonical(spark, sf_dir), ()).select(*_profile_columns())


_PROFILE = "COUNT(*) AS rows, CAST(SUM(CAST(amount AS DECIMAL(38,2))) AS VARCHAR) AS amount_sum, CAST(0 AS BIGINT) AS unparseable, " + ", ".join(
    [f"AVG(CASE WHEN {c} = '' THEN 1.0 ELSE 0.0 END) AS null_{c}" for c in CANONICAL] + [f"COUNT(DISTINCT {c}) AS distinct_{c}" for c in CANONICAL]
)
SQL["profile_canonical"] = f"WITH {CANON} SELECT {_PROFILE} FROM canon"


def profile_by_currency(spark, sf_dir):
    return profile(canonical(spark, sf_dir), ("currency",)).select("currency", *_profile_columns())


SQL["profile_by_currency"] = f"WITH {CANON} SELECT currency, {_PROFILE} FROM canon GROUP BY currency"


def tolerant_sum(spark, sf_dir):
    key = F.col("o_orderkey")
    spoiled = F.when(key % 7 == 0, "n/a").when(key % 11 == 0, "NaN").otherwise(price().cast("string"))
    total, bad = checks.tolerant_sum(spoiled)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(total.cast("decimal(38,2)").cast("string").alias("total"), bad.alias("bad"))


SQL["tolerant_sum"] = """SELECT o_orderstatus,
  CAST(SUM(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) END) AS VARCHAR) AS total,
  CAST(SUM(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM orders GROUP BY 1"""


def spoiled(spark, sf_dir) -> DataFrame:
    """Canonical rows with wrong amounts, dates and currencies among them."""
    key = F.col("o_orderkey")
    return canonical(spark, sf_dir).withColumns(
        {
            "amount": F.when(key % 13 == 0, F.concat("amount", F.lit("0"))).otherwise(F.col("amount")),
            "value_date": F.when(key % 17 == 0, "2024-02-30").otherwise(F.col("value_date")),
            "currency": F.when(key % 19 == 0, F.lower("currency")).otherwise(F.col("currency")),
        }
    )


_SPOILED = f"""WITH {CANON}, bad AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'amount ' || amount || '0 is not a decimal with two places'
    WHEN o_orderkey % 17 = 0 THEN 'value_date 2024-02-30 is not a date'
    WHEN o_orderkey % 19 = 0 THEN 'currency ' || lower(currency) || ' is not three capitals' END AS reason FROM canon)"""


def schema_violations(spark, sf_dir):
    return spoiled(spark, sf_dir).select("o_orderkey", checks.row_violation().alias("reason")).filter(F.col("reason").isNotNull())


SQL["schema_violations"] = f"{_SPOILED} SELECT o_orderkey, reason FROM bad WHERE reason IS NOT NULL"


def schema_findings(spark, sf_dir):
    rows = spoiled(spark, sf_dir).withColumns({"client": F.lit("orders"), "sample": F.concat(F.lit("part-"), (F.col("o_orderkey") % 5).cast("string")), "iteration": F.lit(1), "idx": F.col("o_orderkey")})
    return checks.check_schema(rows).select("sample", "check", "severity", "message", F.col("evidence")["violations"].cast("long").alias("violations"))


SQL["schema_findings"] = f"""{_SPOILED}, n AS (SELECT 'part-' || CAST(o_orderkey % 5 AS VARCHAR) AS sample, COUNT(*) AS violations FROM bad WHERE reason IS NOT NULL GROUP BY 1)
  SELECT sample, 'H2_schema' AS "check", 'error' AS severity, sample || ': ' || CAST(violations AS VARCHAR) || ' row(s) violate the canonical schema' AS message, violations FROM n"""


def offending_top3(spark, sf_dir):
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return checks.top_offenders(lines, ["l_returnflag"], order).withColumn("rank", F.col("rank").cast("long"))


SQL["offending_top3"] = """SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3"""


def _months(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("sample"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("sample").agg(F.count("*").alias("rows"))
    pins = orders.groupBy("sample").agg((4 * F.count("*")).alias("expected_rows")).filter(F.col("sample") < "2001-06")
    return rows.withColumns({"client": F.lit("lineitem"), "iteration": F.lit(1)}), pins


def completeness(spark, sf_dir):
    return checks.check_completeness(*_months(spark, sf_dir)).select("sample", "check", "message")


SQL["completeness"] = """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS sample FROM orders),
  r AS (SELECT sample, COUNT(*) AS rows FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1),
  p AS (SELECT sample, 4 * COUNT(*) AS expected FROM o WHERE sample < '2001-06' GROUP BY 1)
  SELECT r.sample, 'H3_completeness' AS "check", CASE WHEN expected IS NULL THEN r.sample || ': no profile in the manifest'
    ELSE r.sample || ': expected ' || CAST(expected AS VARCHAR) || ' rows, got ' || CAST(rows AS VARCHAR) END AS message
  FROM r LEFT JOIN p ON r.sample = p.sample WHERE expected IS NULL OR rows <> expected"""


def _measures(spark, sf_dir, plan=None) -> DataFrame:
    return long_form(profile(canonical(spark, sf_dir, plan).withColumn("lot", F.col("o_orderkey") % 4), ("lot",)), ("lot",))


def drift_findings(spark, sf_dir):
    """Profiles of a plan that lost its debit mark, against those of the sound plan."""
    bad = inject(compile_plan(ORDERS), "amount_sign_dropped")
    base = _measures(spark, sf_dir).withColumnRenamed("observed", "expected")
    off = checks.drift(_measures(spark, sf_dir, bad), base, ["lot"])
    text = lambda c: F.col(c).cast("decimal(38,2)").cast("string").alias(c)
    return off.select("lot", "metric", "column", text("expected"), text("observed"))


SQL["drift_findings"] = f"""WITH {CANON}, m AS (SELECT o_orderkey % 4 AS lot, CAST(amount AS DECIMAL(18,2)) AS a, amount FROM canon),
  s AS (SELECT lot, SUM(a) AS e, SUM(ABS(a)) AS o, COUNT(DISTINCT a) AS de, COUNT(DISTINCT ABS(a)) AS od FROM m GROUP BY lot)
  SELECT lot, 'amount_sum' AS metric, 'amount' AS "column", CAST(CAST(e AS DECIMAL(38,2)) AS VARCHAR) AS expected, CAST(CAST(o AS DECIMAL(38,2)) AS VARCHAR) AS observed FROM s WHERE ABS(e - o) > 0.005
  UNION ALL SELECT lot, 'distinct', 'amount', CAST(de AS VARCHAR) || '.00', CAST(od AS VARCHAR) || '.00' FROM s WHERE de <> od"""


def latency_flags(spark, sf_dir):
    ms = (F.col("value") * 30).cast("long")
    return table(spark, sf_dir, "events").select("event_id", ms.alias("wall_ms"), checks.latency_level(ms).alias("level")).filter("level IS NOT NULL")


SQL["latency_flags"] = """SELECT * FROM (SELECT event_id, CAST(trunc(value * 30) AS BIGINT) AS wall_ms,
  CASE WHEN trunc(value * 30) > 5000 THEN 'error' WHEN trunc(value * 30) > 2500 THEN 'warning' END AS level FROM events) WHERE level IS NOT NULL"""


def dag_contract(spark, sf_dir):
    u = F.col("user_id") % 4
    e = lambda *x: F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in x))
    sound = (("extract", "transform"), ("transform", "load"))
    edges = F.when(u == 1, e(sound[0])).when(u == 2, e(*sound[::-1], sound[0])).when(u == 3, e(*sound, ("extract", "load"))).otherwise(e(*sound))
    tasks = F.when(u == 3, F.array(F.lit("load"), F.lit("extract"))).otherwise(F.array(*map(F.lit, ("load", "transform", "extract"))))
    dags = table(spark, sf_dir, "events").select("user_id").distinct().select(
        "user_id", F.concat(F.lit("u__"), F.col("user_id").cast("string")).alias("dag_id"), F.lit("0 6 * * *").alias("schedule"), tasks.alias("tasks"), edges.alias("edges"),
        F.concat(F.lit("u__"), F.col("user_id").cast("string")).alias("expected_id"), F.when(u == 0, "0 7 * * *").otherwise("0 6 * * *").alias("expected_schedule"),
    )
    return checks.dag_mismatch(dags)


SQL["dag_contract"] = """WITH u AS (SELECT DISTINCT user_id FROM events)
  SELECT user_id, 'schedule' AS field, '0 7 * * *' AS expected, '0 6 * * *' AS actual FROM u WHERE user_id % 4 = 0
  UNION ALL SELECT user_id, 'edges', 'extract>transform,transform>load', 'extract>transform' FROM u WHERE user_id % 4 = 1
  UNION ALL SELECT user_id, 'edges', 'extract>transform,transform>load', 'extract>load,extract>transform,transform>load' FROM u WHERE user_id % 4 = 3
  UNION ALL SELECT user_id, 'tasks', 'extract,load,transform', 'extract,load' FROM u WHERE user_id % 4 = 3"""


def report_verdict(spark, sf_dir):
    """Findings of schema, completeness and latency together, judged per check."""
    h2 = schema_findings(spark, sf_dir).select("check", "severity")
    h3 = completeness(spark, sf_dir).select("check", F.lit("error").alias("severity"))
    h5 = latency_flags(spark, sf_dir).select(F.lit(checks.H5).alias("check"), F.col("level").alias("severity"))
    return checks.verdict(h2.unionByName(h3).unionByName(h5), ["check"])


SQL["report_verdict"] = f"""SELECT "check", COUNT(*) FILTER (severity = 'error') = 0 AS passed, COUNT(*) FILTER (severity = 'error') AS errors FROM (
  SELECT "check", severity FROM ({SQL["schema_findings"]}) UNION ALL SELECT "check", 'error' FROM ({SQL["completeness"]})
  UNION ALL SELECT 'H5_latency', level FROM ({SQL["latency_flags"]})) GROUP BY 1"""


def manifest_verify(spark, sf_dir):
    pinned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    found = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("name")).distinct()
    both = tables.compare_keys(pinned, found, ["name"])
    return both.filter("status <> 'both'").select("name", "status")


SQL["manifest_verify"] = """SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' ELSE 'unpinned' END AS status
  FROM (SELECT o_orderkey AS name FROM orders) a FULL OUTER JOIN (SELECT DISTINCT l_orderkey + 3 AS name FROM lineitem) b ON a.name = b.name
  WHERE a.name IS NULL OR b.name IS NULL"""


def semi_anti(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = customers.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").count().select("c_mktsegment", F.lit("with").alias("kind"), F.col("count").alias("n"))
    lack = customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").count().select("c_mktsegment", F.lit("without").alias("kind"), F.col("count").alias("n"))
    return have.unionByName(lack)


SQL["semi_anti"] = """SELECT c_mktsegment, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS kind, COUNT(*) AS n FROM customer GROUP BY 1, 2"""


def lookup_left(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0")
    region = table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


SQL["lookup_left"] = """SELECT s_suppkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM supplier
  LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


def one_to_many(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    many = tables.ordered_names(orders, ["c_custkey"], "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(many, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.lit("none")).alias("names"))


SQL["one_to_many"] = """SELECT c_custkey, COUNT(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey), 'none') AS names
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"""


def consecutive_diff(spark, sf_dir):
    return tables.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "before", F.col("event_type").alias("after"))


SQL["consecutive_diff"] = """SELECT event_id, user_id, before, event_type AS after FROM (SELECT event_id, user_id, event_type,
  LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type"""


def history_node(spark, sf_dir):
    return tables.lagged(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "node", "__start__").select("event_id", "node", "event_type")


SQL["history_node"] = "SELECT event_id, coalesce(LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '__start__') AS node, event_type FROM events"


def last_write_wins(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


SQL["last_write_wins"] = """SELECT user_id, event_type, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""


def top_runs(spark, sf_dir):
    return tables.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50)


SQL["top_runs"] = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"


def first_pass(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        F.min_by(F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))).alias("first_sound"),
    )


SQL["first_pass"] = """SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type, arg_min(event_type, ts) FILTER (event_type <> 'error') AS first_sound FROM events GROUP BY 1"""


def findings_by_check(spark, sf_dir):
    return metrics.with_total(table(spark, sf_dir, "events"), "event_type")


SQL["findings_by_check"] = "SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'total' ELSE event_type END AS event_type, COUNT(*) AS n FROM events GROUP BY ROLLUP (event_type)"


def findings_zero_filled(spark, sf_dir):
    kinds = spark.createDataFrame([(i, k) for i, k in enumerate(("click", "error", "login", "purchase", "signup", "view"))], "ordinal int, event_type string")
    return metrics.zero_filled(table(spark, sf_dir, "events"), kinds, "event_type").select("ordinal", "event_type", "n", "total")


SQL["findings_zero_filled"] = """WITH k(ordinal, event_type) AS (VALUES (0, 'click'), (1, 'error'), (2, 'login'), (3, 'purchase'), (4, 'signup'), (5, 'view'))
  SELECT ordinal, k.event_type, COUNT(e.event_id) AS n, (SELECT COUNT(*) FROM events) AS total FROM k LEFT JOIN events e ON e.event_type = k.event_type GROUP BY 1, 2"""


def outcome_rates(spark, sf_dir):
    outcome = metrics.outcome(F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "escalated").otherwise("failed"), (1 + F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.avg((1 + F.col("o_orderkey") % 3).cast("double")).alias("mean_iterations"),
        F.try_divide(F.count_if(F.col("o_orderkey") % 3 == 0).cast("double"), F.count("*")).alias("first_share"),
    )


SQL["outcome_rates"] = """SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'pass' WHEN o_orderstatus = 'F' THEN 'heal' WHEN o_orderstatus = 'O' THEN 'escalate' ELSE 'failed' END AS outcome,
  COUNT(*) AS n, AVG(CAST(1 + o_orderkey % 3 AS DOUBLE)) AS mean_iterations, CAST(COUNT(*) FILTER (o_orderkey % 3 = 0) AS DOUBLE) / COUNT(*) AS first_share FROM orders GROUP BY 1"""


def set_division(spark, sf_dir):
    return tables.divides(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["error", "purchase", "signup"]).select("user_id")


SQL["set_division"] = """SELECT user_id FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1 HAVING COUNT(DISTINCT event_type) = 3"""


def union_reports(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(b.select("n", "kind"))


SQL["union_reports"] = "SELECT o_orderstatus AS kind, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_linestatus, COUNT(*) FROM lineitem GROUP BY 1"


def ordered_agg(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber")
    return tables.ordered_names(lines.distinct(), ["l_returnflag"], "l_linenumber")


SQL["ordered_agg"] = """SELECT l_returnflag, COUNT(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY l_linenumber) AS names
  FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) GROUP BY 1"""


def run_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", run_id(F.lower("c_mktsegment"), F.lit("2026-01-02").cast("timestamp"), F.col("c_custkey")).alias("run_id"))


SQL["run_ids"] = """SELECT c_custkey, lower(c_mktsegment) || '-00000000000000-' || substr(sha256(lower(c_mktsegment) || ':' || CAST(c_custkey AS VARCHAR)), 1, 6) AS run_id FROM customer"""


def defect_injection(spark, sf_dir):
    """Rows that a dropped sign and a swapped date format change, and those they make unreadable."""
    sound, out = canonical(spark, sf_dir), None
    for defect in ("amount_sign_dropped", "date_format_swapped"):
        bad = canonical(spark, sf_dir, inject(compile_plan(ORDERS), defect)).select("o_orderkey", *(F.col(c).alias(f"_{c}") for c in CANONICAL), F.col("error").alias("_error"))
        differ = F.lit(False)
        for c in CANONICAL:
            differ = differ | (F.col(c) != F.col(f"_{c}"))
        one = sound.join(bad, "o_orderkey").agg(F.count_if(differ).alias("changed"), F.count_if(F.col("_error").isNotNull()).alias("broken"))
        one = one.select(F.lit(defect).alias("defect"), "changed", "broken")
        out = one if out is None else out.unionByName(one)
    return out


SQL["defect_injection"] = """SELECT 'amount_sign_dropped' AS defect, COUNT(*) FILTER (o_orderstatus = 'F' AND o_totalprice <> 0) AS changed, CAST(0 AS BIGINT) AS broken FROM orders
  UNION ALL SELECT 'date_format_swapped', COUNT(*) FILTER (day(o_orderdate) <> month(o_orderdate)), COUNT(*) FILTER (day(o_orderdate) > 12) FROM orders"""


def lenient_values(spark, sf_dir):
    """Empty, bracketed and truncated values in the lenient reading."""
    key = F.col("o_orderkey")
    raw = {
        "n": F.when(key % 3 == 0, "").otherwise(F.concat(key.cast("string"), F.lit(".9"))),
        "a": F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat(F.lit("("), F.format_number(price(), 2), F.lit(")"))).otherwise(price().cast("string")),
        "d": F.when(key % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
    }
    spec = replace(ORDERS, columns=(ColumnSpec("n", "trade_id", "int"), ColumnSpec("a", "amount", "decimal"), ColumnSpec("d", "value_date", "date", "%Y%m%d")))
    rows = table(spark, sf_dir, "orders")
    return project(rows, raw, compile_plan(spec), strict=False, keep=("o_orderkey",)).select("o_orderkey", "trade_id", "amount", "value_date", F.col("error").isNull().alias("sound"))


SQL["lenient_values"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS trade_id,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN o_orderkey % 4 = 1 THEN -CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) ELSE CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) END AS VARCHAR) AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value_date, TRUE AS sound FROM orders"""


def nested_state(spark, sf_dir):
    """Names out of a stored state, where it has any."""
    key = F.col("event_id")
    calls = F.to_json(F.struct(F.struct(F.array(F.col("event_type"), F.lit("peek")).alias("tool_calls")).alias("plan")))
    state = F.when(key % 3 == 0, calls).when(key % 3 == 1, '{"plan": null}').otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(reports.nested_texts(state, "$.plan.tool_calls"), ",").alias("tools"))


SQL["nested_state"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',peek' ELSE '' END AS tools FROM events"


def json_recovery(spark, sf_dir):
    key = F.col("event_id")
    text = F.when(key % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))).when(key % 3 == 1, "no object").otherwise(F.concat(F.lit("{broken "), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", reports.recovered_json(text).alias("json"))


SQL["json_recovery"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS json FROM events"


def evidence_text(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", truncated(t, 40).alias("evidence"), reports.line_count(t).cast("long").alias("n_lines"))


SQL["evidence_text"] = """SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 40 THEN left(text, 40) || '...[truncated]' ELSE coalesce(text, '') END AS evidence,
  CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS n_lines FROM documents"""


def report_summaries(spark, sf_dir):
    """Findings per lot of lines, reduced to a verdict, the checks' verdicts and the messages."""
    lots = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 20).alias("lot"), F.when(F.col("event_type") == "error", checks.H1).otherwise(checks.H4).alias("check"),
        F.when(F.col("event_type").isin("error", "view"), "error").otherwise("warning").alias("severity"), F.col("event_id").cast("string").alias("message"),
    )
    found = reports.report_summary(lots, checks.checks_frame(spark), ["lot"])
    return found.select("lot", "passed", F.col("checks")[checks.H1].alias("h1"), F.col("checks")[checks.H4].alias("h4"), F.col("checks")[checks.H6].alias("h6"), F.array_join("errors", ",").alias("errors"))


SQL["report_summaries"] = """WITH f AS (SELECT event_id % 20 AS lot, event_type = 'error' AS h1, event_type IN ('error', 'view') AS bad, CAST(event_id AS VARCHAR) AS m FROM events)
  SELECT lot, NOT bool_or(bad) AS passed, NOT bool_or(bad AND h1) AS h1, NOT bool_or(bad AND NOT h1) AS h4, TRUE AS h6,
    coalesce(string_agg(m, ',' ORDER BY CASE WHEN h1 THEN 1 ELSE 4 END, m) FILTER (bad), '') AS errors FROM f GROUP BY lot"""


def custom_transform(spark, sf_dir):
    """A guarded user transform over raw rows."""
    source = (
        "def transform(rows):\n    return [{'trade_id': r['ref'].strip(), 'amount': ('-' if r['mark'] == 'F' else '') + r['amt'].replace(',', '')} for r in rows]\n"
    )
    return custom.apply_transform(raw_orders(spark, sf_dir).select("ref", "amt", "mark"), source).select("trade_id", "amount", "currency")


SQL["custom_transform"] = f"WITH {CANON} SELECT trade_id, amount, '' AS currency FROM canon"


def guard_scan(spark, sf_dir):
    """Findings of the static guard over some user code; syntax trees are beyond SQL."""
    samples = [("sound", "import csv\nrows = []\n"), ("network", "import socket\n"), ("write", "open('x', 'w')\n"), ("broken", "def\n"), ("hop", "x = ().__class__\n")]
    rows = [(name, f["message"]) for name, code in samples for f in guard.scan(code)]
    return spark.createDataFrame(rows, "name string, message string")


def guard_verdicts(spark, sf_dir):
    """How many findings the guard has in a snippet of each order; trees are parsed in tasks, a snippet once each."""
    snippets = (
        "rows = [x for x in range({k})]\n", "import typing\ntyping.sys.modules['os'].getpid({k})\n", "x = open\nx('f{k}', 'w')\n",
        "from pathlib import Path\nPath('{k}').removedirs()\n", "open('f{k}', 'rb').read()\n", "import collections.abc\ncollections.abc.sys.exit({k})\n",
    )
    key = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, snippets)), (key % len(snippets)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(code, F.lit("{k}"), key.cast("string")).alias("code"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"o_orderkey": batch["o_orderkey"], "clean": [not guard.scan(x) for x in batch["code"]]})

    return rows.mapInPandas(run, "o_orderkey long, clean boolean")


SQL["guard_verdicts"] = "SELECT o_orderkey, o_orderkey % 6 IN (0, 4) AS clean FROM orders"


def _spec(**changes) -> FeedContract:
    return replace(ORDERS, **changes)


def framed_lenient(spark, sf_dir):
    """Data lines between two header lines and one trailer line, with their places; texts too short have none."""
    texts = _document_texts(spark, sf_dir)
    lines = files.framed_lines(texts, _spec(header_rows=2, trailer_rows=1), strict=False)
    return lines.select(F.col("sample").alias("doc_id"), "idx", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


SQL["framed_lenient"] = f"""WITH l AS (SELECT doc_id, {_LINES} AS x FROM documents)
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, sha256(x[i + 2]) AS line_sha256 FROM l, unnest(range(1, len(x) - 2)) AS r(i)"""


def fixed_lenient(spark, sf_dir):
    """Fixed slices of lines that are cut off here and there, sign column included."""
    key = F.col("o_orderkey")
    whole = F.concat(F.lpad(key.cast("string"), 12, " "), F.lpad(price().cast("string"), 16, " "), F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 == 0, F.left(whole, F.lit(20))).otherwise(whole).alias("line"))
    spec = _spec(format="fixed_width", columns=(ColumnSpec("0:12", "trade_id"), ColumnSpec("12:28", "amount", "decimal", sign_column="28:29", negative_marker="f")))
    rows, raw = files.records(spark, rows, spec, strict=False)
    return project(rows, raw, compile_plan(spec), strict=False, keep=("o_orderkey",)).select("o_orderkey", "trade_id", (F.col("amount") != "").alias("there"), F.when(key % 5 != 0, F.col("amount")).alias("amount"))


SQL["fixed_lenient"] = """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS trade_id, TRUE AS there,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS VARCHAR) END AS amount FROM orders"""


def jsonl_lenient(spark, sf_dir):
    """Objects with nulls, booleans, missing keys and long decimals; lines that are none."""
    key = F.col("o_orderkey")
    line = (
        F.when(key % 4 == 0, F.concat(F.lit('{"a": null, "b": true, "c": '), key.cast("string"), F.lit(".10}")))
        .when(key % 4 == 1, F.concat(F.lit('{"a": "x", "b": false, "c": 12345678901234567.'), (key % 90 + 10).cast("string"), F.lit("}")))
        .when(key % 4 == 2, "[1, 2]").otherwise('{"a": ""}')
    )
    rows, raw = files.with_json(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), ["a", "b", "c"], strict=False)
    return rows.select("o_orderkey", *(F.coalesce(raw[k], F.lit("")).alias(k) for k in "abc"), F.col("_fault").isNull().alias("sound"))


SQL["jsonl_lenient"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'x' ELSE '' END AS a,
  CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS b,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) || '.1' WHEN 1 THEN '12345678901234567.' || rtrim(CAST(o_orderkey % 90 + 10 AS VARCHAR), '0') ELSE '' END AS c,
  o_orderkey % 4 <> 2 AS sound FROM orders"""


def format_dispatch(spark, sf_dir):
    """The same orders as delimited, fixed-width and JSON lines, each read by what its contract says."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"))
    spec = lambda form, k, p: _spec(format=form, columns=(ColumnSpec(k, "trade_id"), ColumnSpec(p, "description")))
    cases = [
        (spec("csv", "k", "p"), F.concat_ws(",", "k", "p")), (spec("fixed_width", "0:10", "10:30"), F.concat(F.rpad("k", 10, " "), F.rpad("p", 20, " "))),
        (spec("jsonl", "k", "p"), F.to_json(F.struct("k", "p"))),
    ]
    out = None
    for one, line in cases:
        rows, raw = files.records(spark, orders.select(line.alias("line")), one)
        got = project(rows, raw, compile_plan(one), keep=()).select(F.lit(one.format).alias("format"), "trade_id", "description", F.col("error").isNull().alias("sound"))
        out = got if out is None else out.unionByName(got)
    return out


SQL["format_dispatch"] = """SELECT format, CAST(o_orderkey AS VARCHAR) AS trade_id, o_orderpriority AS description, TRUE AS sound
  FROM orders, (VALUES ('csv'), ('fixed_width'), ('jsonl')) AS f(format)"""


def row_errors(spark, sf_dir):
    """Rows that don't convert, each with its place in its file; sound ones are let through."""
    key = F.col("o_orderkey")
    raw = raw_orders(spark, sf_dir).withColumns({"amt": F.when(key % 23 == 0, "n/a").otherwise(F.col("amt")), "idx": key, "sample": F.lit("day")})
    fields = {c.source: F.col(c.source) for c in ORDERS.columns}
    _, bad = quarantine(project(raw, fields, compile_plan(ORDERS)))
    return bad.select(F.col("idx").alias("o_orderkey"), F.substring_index("error", ": ", 1).alias("place"), F.col("error").contains("n/a").alias("said"))


SQL["row_errors"] = "SELECT o_orderkey, 'data row ' || CAST(o_orderkey + 1 AS VARCHAR) AS place, TRUE AS said FROM orders WHERE o_orderkey % 23 = 0"


def runtime_findings(spark, sf_dir):
    """The first row that doesn't convert in each sample, and how many there are."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("client"), F.concat(F.lit("part-"), (key % 7).cast("string")).alias("sample"), F.lit(1).alias("iteration"),
        key.alias("idx"), F.when((key % 29 == 0) & (key % 7 < 5), F.concat(F.lit("bad "), key.cast("string"))).alias("error"),
    )
    found = checks.check_runtime(rows)
    return found.select("sample", "check", "severity", "message", F.col("evidence")["rows"].cast("long").alias("rows"))


SQL["runtime_findings"] = """SELECT sample, 'H1_runtime' AS "check", 'error' AS severity, sample || ': bad ' || CAST(MIN(k) AS VARCHAR) AS message, COUNT(*) AS rows
  FROM (SELECT o_orderkey AS k, 'part-' || CAST(o_orderkey % 7 AS VARCHAR) AS sample FROM orders WHERE o_orderkey % 29 = 0 AND o_orderkey % 7 < 5) GROUP BY sample"""


def stored_reports(spark, sf_dir):
    """Error findings out of stored reports; what can't be read has none."""
    key = F.col("event_id")
    finding = F.struct(F.col("event_type").alias("check"), F.when(key % 2 == 0, "error").otherwise("warning").alias("severity"), F.lit("m").alias("message"))
    report = F.when(key % 5 == 0, "no json").otherwise(F.to_json(F.array(finding, F.struct(F.lit("z").alias("check"), F.lit("error").alias("severity"), F.lit("m").alias("message")))))
    errors = reports.stored_errors(report)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(errors, lambda e: e["check"]), ",").alias("failed"))


SQL["stored_reports"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN event_type || ',z' ELSE 'z' END AS failed FROM events"


def defects_of_framing(spark, sf_dir):
    """Rows that a kept trailer adds and that a shifted slice and kept thousands separators change."""
    out = []
    texts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.concat(F.lit("k\n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "\n"), F.lit("\nTRAILER")).alias("text"))
    sound = compile_plan(_spec(trailer_rows=1))
    lines = lambda plan: files.framed_lines(texts, plan.contract).agg(F.count("*").alias("n"))
    out.append(lines(inject(sound, "trailer_not_skipped")).select(F.lit("trailer_not_skipped").alias("defect"), "n"))
    spec = _spec(format="fixed_width", columns=(ColumnSpec("0:10", "trade_id"), ColumnSpec("10:13", "currency")))
    fixed = table(spark, sf_dir, "orders").select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("usd")).alias("line"))

    def currencies(plan):
        rows, raw = files.records(spark, fixed, plan.contract)
        return project(rows, raw, plan, keep=())

    out.append(currencies(inject(compile_plan(spec), "wrong_slice")).agg(F.lit("wrong_slice").alias("defect"), F.count_if(F.col("currency") != "USD").alias("n")))
    kept = canonical(spark, sf_dir, inject(compile_plan(ORDERS), "thousands_separator_kept"))
    out.append(kept.agg(F.lit("thousands_separator_kept").alias("defect"), F.count_if(F.col("error").isNotNull()).alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2])


SQL["defects_of_framing"] = """SELECT 'trailer_not_skipped' AS defect, COUNT(*) + COUNT(DISTINCT o_custkey) AS n FROM orders
  UNION ALL SELECT 'wrong_slice', COUNT(*) FROM orders UNION ALL SELECT 'thousands_separator_kept', COUNT(*) FILTER (CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) >= 1000) FROM orders"""


def evidence_tail(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", truncated_tail(t, 40).alias("evidence"))


SQL["evidence_tail"] = "SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 40 THEN '[truncated]...' || right(text, 40) ELSE coalesce(text, '') END AS evidence FROM documents"


def first_sound_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_type") == "error", "bad").alias("fault"))
    return tables.first_sound(rows, ["user_id"], ["ts", "event_id"], "fault").select("user_id", "event_id", "event_type")


SQL["first_sound_event"] = """SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
  FROM events WHERE event_type <> 'error') WHERE r = 1"""


def rounded_amounts(spark, sf_dir):
    """Thousandths rounded half up, on both sides of zero; there is no negative zero."""
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""), F.lit("0.0"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", money(decimal_of(text)).alias("amount"))


SQL["rounded_amounts"] = """WITH r AS (SELECT o_orderkey, (o_orderkey % 50 + 5) // 10 AS cents FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND cents > 0 THEN '-' ELSE '' END || '0.0' || CAST(cents AS VARCHAR) AS amount FROM r"""


def contract_scan(spark, sf_dir):
    """Contract blocks in texts: none, one, several, with either line end, or left open."""
    key = F.col("doc_id")
    block = F.concat(F.lit("```yaml  feed-contract \nclient: c"), key.cast("string"), F.lit("\n  x: ```\n  ```\n"))
    text = (
        F.when(key % 5 == 0, F.lit("none\n```yaml\na: 1\n```\n")).when(key % 5 == 1, F.concat(F.lit("# t\n"), block)).when(key % 5 == 2, F.concat(block, F.lit("and\n"), block))
        .when(key % 5 == 3, F.replace(block, F.lit("\n"), F.lit("\r\n"))).otherwise(F.lit("```yaml feed-contract\nnever closed\n"))
    )
    found = table(spark, sf_dir, "documents").select("doc_id", files.contract_block(text).alias("b"))
    return found.select("doc_id", F.col("b.blocks").cast("long").alias("blocks"), F.coalesce("b.block", F.lit("")).alias("block"))


SQL["contract_scan"] = """SELECT doc_id, CAST(CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS blocks,
  CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'client: c' || CAST(doc_id AS VARCHAR) || chr(10) || '  x: ```' ELSE '' END AS block FROM documents"""


def replay_figures(spark, sf_dir):
    """The headline of runs made of orders: outcomes against what was expected, first passes, findings and their total."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "escalated").otherwise("failed")
    runs = orders.select(
        key.cast("string").alias("run_id"), F.lit("c").alias("client"), status.alias("status"), (1 + key % 3).cast("int").alias("iterations"),
        F.when(key % 2 == 0, "heal").otherwise("pass").alias("expected"), F.array(F.lit("peek"), F.lit("list")).alias("tool_calls"),
    )
    steps = runs.select("run_id", F.explode(F.sequence(F.lit(1), F.col("iterations"))).alias("iteration"), "iterations").select("run_id", "iteration", (F.col("iteration") == F.col("iterations")).alias("passed"))
    found = events.select(F.col("user_id").cast("string").alias("source"), F.when(F.col("event_type") == "error", checks.H1).otherwise(checks.H4).alias("check"), F.when(F.col("event_id") % 2 == 0, "error").otherwise("warning").alias("severity"))
    cases = events.groupBy("user_id").agg(F.collect_set("event_type").alias("failed")).select(F.col("user_id").cast("string").alias("name"), F.array(F.lit("error"), F.lit("view")).alias("must_fail"), "failed")
    got = metrics.headline(runs, steps, found, cases, events.select(F.col("user_id").cast("string").alias("run_id")), checks.checks_frame(spark))
    picked = {k: got[k] for k in ("scenarios", "first_pass_rate", "healed_rate", "adversarial_rejected", "mean_iterations", "checkpoints")}
    picked |= {"errors": ",".join(str(n) for n in got["errors"].values()), "total_errors": str(got["total_errors"]), "tool_calls": str(got["tool_calls"]), "tools": ",".join(got["tools"])}
    return spark.createDataFrame(list(picked.items()), "figure string, value string")


SQL["replay_figures"] = """WITH o AS (SELECT *, 1 + o_orderkey % 3 AS it, CASE WHEN o_orderkey % 2 = 0 THEN 'heal' ELSE 'pass' END AS expected,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'pass' WHEN o_orderstatus = 'F' THEN 'heal' WHEN o_orderstatus = 'O' THEN 'escalate' ELSE 'failed' END AS observed FROM orders),
  r AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (observed = expected) AS matched, COUNT(*) FILTER (it = 1) AS firsts, COUNT(*) FILTER (expected = 'heal') AS heals,
    COUNT(*) FILTER (expected = 'heal' AND observed = 'heal') AS healed, AVG(it) AS mean FROM o),
  u AS (SELECT user_id, COUNT(DISTINCT event_type) FILTER (event_type IN ('error', 'view')) = 2 AS rejected FROM events GROUP BY 1),
  a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (rejected) AS rejected FROM u),
  e AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (event_id % 2 = 0 AND event_type = 'error') AS h1, COUNT(*) FILTER (event_id % 2 = 0 AND event_type <> 'error') AS h4 FROM events)
  SELECT 'scenarios' AS figure, CAST(matched AS VARCHAR) || ' / ' || CAST(n AS VARCHAR) AS value FROM r
  UNION ALL SELECT 'first_pass_rate', CAST(firsts AS VARCHAR) || ' / ' || CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'healed_rate', CAST(healed AS VARCHAR) || ' / ' || CAST(heals AS VARCHAR) FROM r
  UNION ALL SELECT 'adversarial_rejected', CAST(rejected AS VARCHAR) || ' / ' || CAST(n AS VARCHAR) FROM a UNION ALL SELECT 'mean_iterations', printf('%.2f', mean) FROM r
  UNION ALL SELECT 'checkpoints', CAST(n AS VARCHAR) FROM e UNION ALL SELECT 'errors', CAST(h1 AS VARCHAR) || ',0,0,' || CAST(h4 AS VARCHAR) || ',0,0' FROM e
  UNION ALL SELECT 'total_errors', CAST(h1 + h4 AS VARCHAR) FROM e UNION ALL SELECT 'tool_calls', CAST(2 * n AS VARCHAR) FROM r UNION ALL SELECT 'tools', 'list,peek'"""


def pinned_profiles(spark, sf_dir):
    """Profiles of samples as pins: expected rows, the sum as text, and the maps' values."""
    rows = canonical(spark, sf_dir).withColumn("sample", F.col("currency"))
    pins = as_pins(profile(rows))
    return pins.select("sample", "rows", "amount_sum", F.col("null_rate")["counterparty"].alias("null_counterparty"), F.col("distinct")["account_id"].alias("accounts"))


SQL["pinned_profiles"] = f"""WITH {CANON} SELECT currency AS sample, COUNT(*) AS rows, CAST(SUM(CAST(amount AS DECIMAL(38,2))) AS VARCHAR) AS amount_sum,
  AVG(CASE WHEN counterparty = '' THEN 1.0 ELSE 0.0 END) AS null_counterparty, COUNT(DISTINCT account_id) AS accounts FROM canon GROUP BY 1"""


def adversarial_division(spark, sf_dir):
    """Samples whose dropped last row shows in their row counts (the plan edit of that name)."""
    texts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("sample")).agg(F.concat(F.lit("k\n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "\n")).alias("text"))
    spec = _spec(trailer_rows=1)  # one line more than the contract has: what a dropped last row is
    rows = files.framed_lines(texts, spec, strict=False).groupBy("sample").agg(F.count("*").alias("rows"))
    profiles = texts.select("sample").join(rows, "sample", "left").select("sample", F.coalesce("rows", F.lit(0)).alias("rows")).withColumns({"client": F.lit("orders"), "iteration": F.lit(1)})
    pins = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("sample")).agg(F.count("*").alias("expected_rows"))
    return checks.check_completeness(profiles, pins).select("sample", "check", "message")


SQL["adversarial_division"] = """SELECT CAST(o_custkey AS VARCHAR) AS sample, 'H3_completeness' AS "check",
  CAST(o_custkey AS VARCHAR) || ': expected ' || CAST(COUNT(*) AS VARCHAR) || ' rows, got ' || CAST(COUNT(*) - 1 AS VARCHAR) AS message FROM orders GROUP BY o_custkey"""


def ledger_iterations(spark, sf_dir):
    """Iterations of a ledger, one for each nation, of which every third is written again: the last one counts."""
    ledger = Ledger(spark, files.work_folder(spark, "ledger"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows at any scale
    report = lambda k: f'[{{"check": "H1_runtime", "severity": "{"error" if k % 2 else "warning"}", "message": "m{k}"}}]'
    row = lambda r, ms: {"run_id": f"r{r.n_regionkey}", "iteration": r.n_nationkey, "passed": r.n_nationkey % 2 == 0, "wall_ms": ms, "rows_emitted": 1, "report_json": report(r.n_nationkey), "plan_json": ""}
    ledger.save_iterations([row(r, r.n_nationkey) for r in nations])
    ledger.save_iterations([row(r, r.n_nationkey + 1000) for r in nations if r.n_nationkey % 3 == 0])
    errors = F.array_join(F.transform(reports.stored_errors(F.col("report_json")), lambda e: e["message"]), ",")
    return ledger.iterations().select("run_id", "iteration", "passed", "wall_ms", errors.alias("errors"))


SQL["ledger_iterations"] = """SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS run_id, n_nationkey AS iteration, n_nationkey % 2 = 0 AS passed,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 1000 ELSE n_nationkey END AS BIGINT) AS wall_ms, CASE WHEN n_nationkey % 2 = 1 THEN 'm' || CAST(n_nationkey AS VARCHAR) ELSE '' END AS errors FROM nation"""


def ledger_runs(spark, sf_dir):
    """Runs of a ledger, one for each region: created, then brought to an end; a second creation and an unknown state are refused."""
    ledger, refused = Ledger(spark, files.work_folder(spark, "ledger")), {}
    for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect():  # 5 rows at any scale
        run = {"run_id": f"r{r.r_regionkey}", "client": "c", "provider": "p", "status": "planning", "max_iterations": 3}
        ledger.create(run)
        ledger.update(run["run_id"], status="approved" if r.r_regionkey % 2 else "escalated", iterations=r.r_regionkey, final_passed=r.r_regionkey % 2 == 1)
        refused[run["run_id"]] = 0
        for again in (lambda: ledger.create(run), lambda: ledger.update(run["run_id"], status="unknown"), lambda: ledger.update(run["run_id"], created_at=None)):
            try:
                again()
            except FeedError:
                refused[run["run_id"]] += 1
    seen = spark.createDataFrame(list(refused.items()), "run_id string, refused int")
    found = ledger.list(50).join(seen, "run_id").withColumn("active", F.lit(ledger.active()))
    return found.select("run_id", "status", "iterations", "final_passed", "refused", "active")


SQL["ledger_runs"] = """SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS run_id, CASE WHEN r_regionkey % 2 = 1 THEN 'approved' ELSE 'escalated' END AS status,
  r_regionkey AS iterations, r_regionkey % 2 = 1 AS final_passed, CAST(3 AS INTEGER) AS refused, FALSE AS active FROM region"""


def event_log(spark, sf_dir):
    """Events appended in two goes and read back; values that are no text are written as such."""
    path = files.work_folder(spark, "events")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows at any scale
    for part in (nations[:10], nations[10:]):
        files.append_events(spark, path, [{"ts": f"t{r.n_nationkey}", "node": r.n_name, "run_id": "r", "n": r.n_nationkey, "even": r.n_nationkey % 2 == 0} for r in part])
    return files.read_events(spark, path).select("ts", "node", "run_id", F.col("detail")["n"].alias("n"), F.col("detail")["even"].alias("even"))


SQL["event_log"] = """SELECT 't' || CAST(n_nationkey AS VARCHAR) AS ts, n_name AS node, 'r' AS run_id, CAST(n_nationkey AS VARCHAR) AS n,
  CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM nation"""

_CORPUS_SPEC = """# feed

```yaml feed-contract
client: {client}
feed_name: daily
format: csv
columns:
  - {{source: "k", target: trade_id}}
  - {{source: "d", target: value_date, dtype: date, date_format: "%d.%m.%Y"}}
  - {{source: "a", target: amount, dtype: decimal}}
  - {{source: "y", target: currency}}
```
"""


def corpus_pins(spark, sf_dir):
    """A corpus with a client for each region and its nations as a feed: catalog, contracts, profiles and written manifests, read back."""
    root = files.work_folder(spark, "corpus")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows at any scale
    for region in sorted({r.n_regionkey for r in rows}):
        client = f"r{region}"
        lines = [f"{r.n_nationkey},{r.n_nationkey % 28 + 1:02d}.01.2020,{r.n_nationkey}.5,{'eur' if r.n_nationkey % 2 else ''}\n" for r in rows if r.n_regionkey == region]
        files.put_text(spark, f"{root}/{client}/spec.md", _CORPUS_SPEC.format(client=client))
        files.put_text(spark, f"{root}/{client}/samples/nations.csv", "k,d,a,y\n" + "".join(lines))
    for client in files.list_clients(spark, root):
        files.put_text(spark, f"{root}/{client}/manifest.json", json.dumps(manifest.build_manifest(spark, root, client)))
    pins = manifest.manifests(spark, root).select("client", F.explode("samples").alias("s"), F.col("scenario")["expected_outcome"].alias("outcome"))
    disk = files.catalog(spark, root)
    same = (pins["client"] == disk["client"]) & (F.col("s.name") == disk["name"]) & (F.col("s.sha256") == disk["sha256"])
    return pins.join(disk, same).select(
        disk["client"], "name", disk["bytes"], disk["sha256"], "s.expected_rows", "s.amount_sum", "outcome",
        F.col("s.null_rate")["currency"].alias("null_currency"), F.col("s.distinct")["trade_id"].alias("distinct_ids"),
    )


SQL["corpus_pins"] = """WITH t AS (SELECT n_regionkey, 'k,d,a,y' || chr(10) || string_agg(CAST(n_nationkey AS VARCHAR) || ',' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') || '.01.2020,'
    || CAST(n_nationkey AS VARCHAR) || '.5,' || CASE WHEN n_nationkey % 2 = 1 THEN 'eur' ELSE '' END || chr(10), '' ORDER BY n_nationkey) AS x, COUNT(*) AS n, SUM(n_nationkey) AS total,
    AVG(CASE WHEN n_nationkey % 2 = 1 THEN 0.0 ELSE 1.0 END) AS null_currency FROM nation GROUP BY 1)
  SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS client, 'nations.csv' AS name, CAST(strlen(x) AS BIGINT) AS bytes, sha256(x) AS sha256, n AS expected_rows,
    CAST(CAST(total + 0.5 * n AS DECIMAL(18,2)) AS VARCHAR) AS amount_sum, 'pass' AS outcome, null_currency, n AS distinct_ids FROM t"""


def rows_sink(spark, sf_dir):
    """Canonical rows written by date, here the first day of the year, and read back; with how many the sink says it wrote."""
    path = files.work_folder(spark, "rows")
    written = load(canonical(spark, sf_dir).drop("error").withColumn("value_date", F.concat(F.left("value_date", F.lit(4)), F.lit("-01-01"))).select(*CANONICAL), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("value_date").cast("string").alias("value_date")).agg(F.count("*").alias("n"), F.lit(written).cast("long").alias("written"))


SQL["rows_sink"] = "SELECT strftime(o_orderdate, '%Y') || '-01-01' AS value_date, COUNT(*) AS n, (SELECT COUNT(*) FROM orders) AS written FROM orders GROUP BY 1"


def missing_columns(spark, sf_dir):
    """A contract's column that a feed lacks: an error where that is strict, empty where it is lenient."""
    rows = raw_orders(spark, sf_dir)
    fields = {c.source: F.col(c.source) for c in ORDERS.columns if c.source != "memo"}
    out = None
    for strict in (True, False):
        one = project(rows, fields, compile_plan(ORDERS), strict=strict, keep=("o_orderkey",)).select("o_orderkey", F.lit(strict).alias("strict"), "description", F.col("error").isNotNull().alias("failed"))
        out = one if out is None else out.unionByName(one)
    return out


SQL["missing_columns"] = "SELECT o_orderkey, strict, '' AS description, strict AS failed FROM orders, (VALUES (TRUE), (FALSE)) AS s(strict)"


def transform_by_file(spark, sf_dir):
    """A user transform that keeps count: each customer's orders are a file, whose rows it gets in their order."""
    source = (
        "def transform(rows):\n    total = 0\n    out = []\n    for n, r in enumerate(rows):\n        total += int(r['key']) % 10\n"
        "        out.append({'trade_id': r['key'], 'account_id': str(n), 'description': str(total)})\n    return out\n"
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    made = custom.apply_transform(rows, source, by="o_custkey", order="o_orderkey")
    return made.select("o_custkey", F.col("trade_id").cast("long").alias("o_orderkey"), F.col("account_id").cast("long").alias("place"), F.col("description").cast("long").alias("total"))


SQL["transform_by_file"] = """SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER w - 1 AS place, CAST(SUM(o_orderkey % 10) OVER w AS BIGINT) AS total FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


def mapping_documents(spark, sf_dir):
    """The mapping document of a contract for each nation, and its plan's declared graph against one that lacks an edge."""
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        columns = (ColumnSpec(f"k{r.n_nationkey}", "trade_id"), ColumnSpec("d", "value_date", "date", "%d.%m.%Y"), ColumnSpec("x"))
        plan = compile_plan(_spec(client=r.n_name, feed_name="daily", columns=columns))
        bad = dag(inject(plan, "dag_missing_dependency"))
        rows.append((r.n_name, mapping_document(plan), bad["dag_id"], bad["schedule"], bad["tasks"], bad["edges"], f"{r.n_name}__daily", "0 6 * * 1-5"))
    made = spark.createDataFrame(rows, "client string, document string, dag_id string, schedule string, tasks array<string>, edges array<array<string>>, expected_id string, expected_schedule string")
    return checks.dag_mismatch(made)


SQL["mapping_documents"] = """SELECT n_name AS client, 'client: "' || n_name || '"' || chr(10) || 'feed: "daily"' || chr(10) || 'format: "csv"' || chr(10) || 'fields:' || chr(10)
    || '- source: "k' || CAST(n_nationkey AS VARCHAR) || '"' || chr(10) || '  target: "trade_id"' || chr(10) || '  dtype: "str"' || chr(10)
    || '- source: "d"' || chr(10) || '  target: "value_date"' || chr(10) || '  dtype: "date"' || chr(10) || '  transform: "date in %d.%m.%Y, written YYYY-MM-DD"' || chr(10)
    || '- source: "x"' || chr(10) || '  target: null' || chr(10) || '  dtype: "str"' || chr(10) AS document,
  'edges' AS field, 'extract>transform,transform>load' AS expected, 'extract>transform' AS actual FROM nation"""


def driver_views(spark, sf_dir):
    """What the driver makes of small lists: plain names, what follows an evaluation, shortened lists, tables of text."""
    by_region: dict[int, list] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows at any scale
        by_region.setdefault(r.n_regionkey, []).append(r)
    rows = []
    for region, nations in by_region.items():
        plain = 0
        for n in nations:
            try:
                files.safe_name(n.n_name)
                plain += 1
            except FeedError:
                pass
        names = [n.n_name for n in nations]
        rows.append((region, plain, route(region == 0, region, 3), ",".join(reports.shown(names)), reports.text_table([{"k": region, "first": names[0]}], ["k", "first"])))
    return spark.createDataFrame(rows, "n_regionkey int, plain long, following string, shown string, text string")


SQL["driver_views"] = """WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
  SELECT n_regionkey, COUNT(*) FILTER (regexp_full_match(n_name, '[A-Za-z0-9._-]+')) AS plain,
    CASE WHEN n_regionkey = 0 THEN 'await_approval' WHEN n_regionkey < 3 THEN 'generate' ELSE 'escalate' END AS following,
    string_agg(n_name, ',' ORDER BY r) FILTER (r <= 3) || CASE WHEN COUNT(*) > 3 THEN ',+' || CAST(COUNT(*) - 3 AS VARCHAR) || ' more' ELSE '' END AS shown,
    'k  first' || chr(10) || CAST(n_regionkey AS VARCHAR) || '  ' || MAX(n_name) FILTER (r = 1) AS text FROM n GROUP BY 1"""


def arrivals(spark, sf_dir):
    """A file for each region arrives, a row of each of which doesn't convert; then they are taken up by a stream, twice: the second run finds nothing new."""
    top = files.work_folder(spark, "arrivals")
    by_region: dict[int, list] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows at any scale
        by_region.setdefault(r.n_regionkey, []).append(r.n_nationkey)
    spec = _spec(columns=(ColumnSpec("k", "trade_id", "int"), ColumnSpec("d", "value_date", "date", "%Y-%m-%d")))
    for region, keys in by_region.items():
        files.put_text(spark, f"{top}/in/r{region}.csv", "k,d\n" + "".join(f"{k},2026-01-{k + 1:02d}\n" for k in keys) + "x,2026-01-01\n")
    for _ in range(2):
        ingest(spark, f"{top}/in", compile_plan(spec), f"{top}/out", f"{top}/checkpoint").awaitTermination()
    good, bad = (spark.read.parquet(f"{top}/out/{n}").groupBy("sample").agg(F.count("*").alias(n)) for n in ("rows", "quarantine"))
    return good.join(bad, "sample")


SQL["arrivals"] = "SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.csv' AS sample, COUNT(*) AS rows, CAST(1 AS BIGINT) AS quarantine FROM nation GROUP BY 1"


def quoted_line_ends(spark, sf_dir):
    """Documents written as delimited files whose texts run over lines, read back: the texts, put together from their lines."""
    path = files.work_folder(spark, "quoted")
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.regexp_replace("text", LINE_END, "\n")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), quote("lang"), quote(text)).alias("value")).write.text(path)
    lines = quoted.quoted_records(spark, path, _spec(skip_blank_lines=False, header_rows=0))
    rows, raw = files.with_csv(lines, ["k", "lang", "text"], ",", strict=True)
    return rows.select(raw["k"].cast("long").alias("doc_id"), raw["lang"].alias("lang"), F.md5(raw["text"].cast("binary")).alias("text_md5"), F.col("_fault").isNull().alias("sound"))


SQL["quoted_line_ends"] = r"""SELECT doc_id, lang, md5(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')) AS text_md5, TRUE AS sound FROM documents WHERE text IS NOT NULL"""


def jailed_faults(spark, sf_dir):
    """Orders dealt to 500 files, some of whose transforms fail or reach for what isn't theirs: findings of H1, and rows of the others."""
    source = (
        "def transform(rows):\n    kind = int(rows[0]['part']) % 5\n    if kind == 1:\n        return [{'trade_id': open('/etc/passwd').read()}]\n    if kind == 2:\n        return [{'trade_id': r['none']} for r in rows]\n"
        "    if kind == 3:\n        raise RuntimeError('x')\n    return [{'trade_id': r['key']} for r in rows]\n"
    )
    part = (F.col("o_custkey") % 500).cast("string")
    rows = table(spark, sf_dir, "orders").select(part.alias("part"), part.alias("file"), F.col("o_orderkey").cast("string").alias("key"))
    tried = custom.try_transform(rows, source, by="file")
    found = custom.runtime_faults(tried, "orders", "file").select("sample", F.regexp_extract("message", r"^transform stopped: (\w+)", 1).alias("fault"), F.lit(0).cast("long").alias("rows"))
    return tried.filter("fault is null").groupBy(F.col("file").alias("sample")).agg(F.lit("").alias("fault"), F.count("*").alias("rows")).unionByName(found)


SQL["jailed_faults"] = """SELECT CAST(p AS VARCHAR) AS sample, CASE p % 5 WHEN 1 THEN 'PermissionError' WHEN 2 THEN 'KeyError' WHEN 3 THEN 'RuntimeError' ELSE '' END AS fault,
  CAST(CASE WHEN p % 5 IN (1, 2, 3) THEN 0 ELSE n END AS BIGINT) AS rows FROM (SELECT o_custkey % 500 AS p, COUNT(*) AS n FROM orders GROUP BY 1)"""


def encoded_documents(spark, sf_dir):
    """Documents written in encodings of one, two and four bytes a character, and read back by splits: their lines by encoding.

    An encoding of n bytes a character takes n turns, a part of the documents each, whose files go when their lines are settled:
    so files never take more than the texts at a byte a character do.
    """
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(","), F.regexp_replace("text", r"[^\x20-\x7e\xa1-\xff]", " "))
    settled = files.work_folder(spark, "lines")
    for name, java, width in (("cp1252", "ISO-8859-1", 1), ("utf-16-le", "UTF-16LE", 2), ("utf-32-be", "UTF-32", 4)):
        feed = "\n".encode(name).decode("latin-1")
        for turn in range(width):
            path = files.work_folder(spark, "encoded")
            some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(width)) == turn)
            some.select(F.encode(line, java).cast("string").alias("value")).write.option("lineSep", feed).text(path)
            lines = encoded.encoded_lines(spark, path, _spec(encoding=name, header_rows=0, skip_blank_lines=False))
            one = lines.select(F.lit(name).alias("encoding"), F.substring_index("line", ",", 1).cast("long").alias("doc_id"), F.md5(F.col("line").cast("binary")).alias("line_md5"))
            one.write.mode("append").parquet(settled)
            files.discard(spark, path)
    return spark.read.schema("encoding string, doc_id long, line_md5 string").parquet(settled)


SQL["encoded_documents"] = r"""SELECT encoding, doc_id, md5(CAST(doc_id AS VARCHAR) || ',' || regexp_replace(text, '[^\x20-\x7e\x{a1}-\x{ff}]', ' ', 'g')) AS line_md5
  FROM documents, (VALUES ('cp1252'), ('utf-16-le'), ('utf-32-be')) AS e(encoding) WHERE text IS NOT NULL"""


def framed_large(spark, sf_dir):
    """Documents' lines as files without a limit of size: each file is framed and numbered by splits, and digested as a stream."""
    path = files.work_folder(spark, "large")
    docs = table(spark, sf_dir, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7e]", " ").alias("t"), (F.col("doc_id") % 7).alias("file"))
    docs.repartition("file").sortWithinPartitions("file", "t").select("t", "file").write.partitionBy("file").text(path)
    top = F.regexp_extract("path", r"file=(\d+)/", 1).cast("long")
    spec = _spec(header_rows=1, trailer_rows=1, skip_blank_lines=False)
    lines = files.numbered_lines(spark, path, spec).groupBy(top.alias("file")).agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.sum(F.length("line")).alias("chars"))
    sums = encoded.digests(spark, path, large=0).select(top.alias("file"), "bytes", "sha256")
    return lines.join(sums, "file")


SQL["framed_large"] = r"""WITH t AS (SELECT doc_id % 7 AS file, regexp_replace(coalesce(text, ''), '[^\x20-\x7e]', ' ', 'g') AS t FROM documents),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY t) AS k, COUNT(*) OVER (PARTITION BY file) AS m FROM t)
  SELECT file, COUNT(*) FILTER (k > 1 AND k < m) AS n, CAST(MAX(m) - 3 AS BIGINT) AS last, CAST(SUM(length(t)) FILTER (k > 1 AND k < m) AS BIGINT) AS chars,
    CAST(SUM(length(t) + 1) AS BIGINT) AS bytes, sha256(string_agg(t || chr(10), '' ORDER BY t)) AS sha256 FROM r GROUP BY file"""


def version_diffs(spark, sf_dir):
    """Turns of conversations as versions of a text of a word a line: what each changes, and whether the patch gives the next one."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("text", F.lit("")))), " ").alias("t"))
    rows = rows.withColumn("t", F.regexp_replace("t", "[^A-Za-z0-9]+", "\n"))
    found = versions.version_diffs(rows, "conv_id", "turn", "t")
    return found.select("conv_id", "turn", "n_old", "n_new", (F.col("inserted") - F.col("deleted")).alias("growth"), "restored")


SQL["version_diffs"] = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY coalesce(text, '')), '[^A-Za-z0-9]+', chr(10), 'g') AS t FROM conversations GROUP BY 1, 2),
  n AS (SELECT *, CAST(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS n FROM t),
  p AS (SELECT *, LAG(n) OVER (PARTITION BY conv_id ORDER BY turn) AS n_old FROM n)
  SELECT conv_id, turn, n_old, n AS n_new, n - n_old AS growth, TRUE AS restored FROM p WHERE n_old IS NOT NULL"""


def merged_profiles(spark, sf_dir):
    """The feed in ten batches, each added to the kept counts, three of them reversed again: the profile of what is left."""
    kept = KeptCounts(spark, files.work_folder(spark, "counts"), ("currency",))
    rows = canonical(spark, sf_dir)
    for batch in range(10):
        kept.add(rows.filter(F.col("o_orderkey") % 10 == batch))
    for batch in (2, 5, 7):
        kept.reverse(rows.filter(F.col("o_orderkey") % 10 == batch))
    return kept.profile().select("currency", *_profile_columns())


SQL["merged_profiles"] = f"WITH {CANON} SELECT currency, {_PROFILE} FROM canon WHERE o_orderkey % 10 NOT IN (2, 5, 7) GROUP BY currency"


def plans_over_one_scan(spark, sf_dir):
    """A sound plan and three defective ones over one scan of the feed: rows, rows with an error and the sum of the others by plan."""
    sound = compile_plan(ORDERS)
    plans = {"sound": sound} | {d: inject(sound, d) for d in ("amount_sign_dropped", "date_format_swapped", "thousands_separator_kept")}
    raw = raw_orders(spark, sf_dir)
    made = project_plans(raw, {c.source: F.col(c.source) for c in ORDERS.columns}, plans, keep=("o_orderkey",))
    total = F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("amount").cast("decimal(28,2)"))), F.lit(0)).cast("decimal(38,2)").cast("string")
    return made.groupBy("plan").agg(F.count("*").alias("rows"), F.count("error").alias("broken"), total.alias("total"))


SQL["plans_over_one_scan"] = """WITH o AS (SELECT CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS a, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS s, day(o_orderdate) AS d FROM orders),
  p AS (SELECT 'sound' AS plan, s * a AS v, FALSE AS bad FROM o UNION ALL SELECT 'amount_sign_dropped', a, FALSE FROM o
    UNION ALL SELECT 'date_format_swapped', s * a, d > 12 FROM o UNION ALL SELECT 'thousands_separator_kept', s * a, a >= 1000 FROM o)
  SELECT plan, COUNT(*) AS rows, COUNT(*) FILTER (bad) AS broken, CAST(CAST(coalesce(SUM(v) FILTER (NOT bad), 0) AS DECIMAL(38,2)) AS VARCHAR) AS total FROM p GROUP BY plan"""


def contracts_in_bulk(spark, sf_dir):
    """Specs made of documents, sound and broken: their columns as rows, their faults as rows."""
    key, client = F.col("doc_id"), F.concat(F.lit("client: c"), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("# spec\n```yaml feed-contract\n"), client, F.lit("\nfeed_name: f\nformat: "), F.when(key % 7 == 1, "xml").otherwise("csv"), F.lit("\ncolumns:\n"))
    column = F.lit("  - {source: Amt, target: amount, dtype: decimal}\n")
    other = (
        F.when(key % 7 == 2, "  - {source: Day, target: nowhere}\n").when(key % 7 == 3, "  - {source: Day, dtype: date}\n").when(key % 7 == 4, "  - {source: Day, colour: red}\n")
        .when(key % 7 == 5, "  plain\n").otherwise('  - {source: "Cur", target: currency, default: EUR}\n')
    )
    block = F.concat(head, column, other, F.lit("```\n"))
    rows = bulk.contract_rows(table(spark, sf_dir, "documents"), F.when(key % 7 == 6, F.concat(block, block)).otherwise(block), ("doc_id",))
    said = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "doc_id", F.coalesce("position", F.lit(-1)).alias("position"), said("client").alias("client"), said("source").alias("source"), said("target").alias("target"),
        said("default_value").alias("default_value"), said("fault").alias("fault"),
    )


SQL["contracts_in_bulk"] = """WITH d AS (SELECT doc_id, doc_id % 7 AS k, 'c' || CAST(doc_id AS VARCHAR) AS c FROM documents)
  SELECT doc_id, p AS position, c AS client, CASE p WHEN 0 THEN 'Amt' ELSE 'Cur' END AS source, CASE p WHEN 0 THEN 'amount' ELSE 'currency' END AS target,
    CASE p WHEN 0 THEN '' ELSE 'EUR' END AS default_value, '' AS fault FROM d, (VALUES (CAST(0 AS BIGINT)), (1)) v(p) WHERE k = 0
  UNION ALL SELECT doc_id, -1, '', '', '', '', CASE k WHEN 1 THEN c || ': unknown format ' || chr(39) || 'xml' || chr(39) WHEN 2 THEN c || ': ''nowhere'' is not canonical' WHEN 3 THEN c || ': Day is a date without date_format'
    WHEN 4 THEN 'column: unknown keys [''colour'']' WHEN 5 THEN 'cannot read ' || chr(39) || 'plain' || chr(39) ELSE 'spec: expected one feed-contract block, found 2' END FROM d WHERE k > 0"""


QUERIES = {
    f.__name__: f
    for f in (
        canonical_projection, csv_roundtrip, csv_field_faults, csv_lenient, fixed_width_roundtrip, jsonl_roundtrip, json_props, framed_lines,
        header_trailer_strip, peek_lines, catalog_digest, profile_canonical, profile_by_currency, tolerant_sum, schema_violations, schema_findings,
        offending_top3, completeness, drift_findings, latency_flags, dag_contract, report_verdict, manifest_verify, semi_anti, lookup_left, one_to_many,
        consecutive_diff, history_node, last_write_wins, top_runs, first_pass, findings_by_check, findings_zero_filled, outcome_rates, set_division,
        union_reports, ordered_agg, run_ids, defect_injection, lenient_values, nested_state,
        json_recovery, evidence_text, report_summaries, custom_transform, guard_scan, guard_verdicts, framed_lenient, fixed_lenient, jsonl_lenient,
        format_dispatch, row_errors, runtime_findings, stored_reports, defects_of_framing, evidence_tail, first_sound_event, rounded_amounts,
        contract_scan, replay_figures, pinned_profiles, adversarial_division, ledger_iterations, ledger_runs, event_log, corpus_pins, rows_sink,
        missing_columns, transform_by_file, mapping_documents, driver_views, arrivals, quoted_line_ends, jailed_faults, encoded_documents, framed_large, version_diffs, merged_profiles, plans_over_one_scan,
        contracts_in_bulk,
    )
}
ORACLE_SQL = SQL
