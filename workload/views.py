"""Telemetry tables derived from the test tables, in Spark and as SQL.

Spark builds them with the DataFrame API straight from one scan each; the SQL text is the
independent statement of the same tables for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanlake.session import configure

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
SQL_START, SQL_END = f"TIMESTAMP '{START}'", f"TIMESTAMP '{END}'"

# The stored type is a zoneless timestamp; reading it as an instant keeps filter pushdown.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    reader = spark.read.schema(EVENTS) if name == "events" else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


_GROUP = "lpad(CAST(event_id - event_id % 4 + 4 AS STRING), {width}, '0')"
_SERVICE = "concat('svc-', CAST(user_id % 5 AS STRING)) AS service"
_ENV = "IF(user_id % 2 = 0, 'prod', 'staging') AS env"


def span_rows(events: DataFrame) -> DataFrame:
    """Spans out of events; works on a stream too."""
    return events.selectExpr(
        "'default' AS tenant_id", f"{_GROUP.format(width=32)} AS trace_id",
        "lpad(CAST(event_id + 4 AS STRING), 16, '0') AS span_id",
        f"IF(event_id % 4 = 0, '', {_GROUP.format(width=16)}) AS parent_span_id",
        "event_type AS name", _SERVICE, _ENV, "CAST(event_id % 6 AS INT) AS kind",
        "ts AS start_time", "CAST(round(value * 1000000) AS BIGINT) AS duration_ns",
        "CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS status_code",
        "array('event.type', 'k') AS attrs_keys",
        "array(event_type, regexp_extract(props, '([0-9]+)', 1)) AS attrs_values")


def metric_rows(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "'default' AS tenant_id", "ts AS timestamp", "concat('app.', event_type) AS name",
        "IF(event_type IN ('click', 'view'), 1, 0) AS type", "value", _SERVICE, _ENV)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(table(spark, sf_dir, "events"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_rows(table(spark, sf_dir, "events"))


def log_rows(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Logs out of events, each with a whole document as its body.

    The join shuffles, so the logs come in as many partitions as a stored table of this size would.
    """
    number = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = events.selectExpr(
        "'default' AS tenant_id", "ts AS timestamp",
        f"IF(event_type = 'signup', repeat('0', 32), {_GROUP.format(width=32)}) AS trace_id",
        "IF(event_type = 'signup', repeat('0', 16), "
        "lpad(CAST(event_id + 4 AS STRING), 16, '0')) AS span_id",
        "CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'view' THEN 5 ELSE 9 "
        "END AS severity_number",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' "
        "WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity_text",
        _SERVICE, _ENV, "array('duration_ms', 'event.type') AS attrs_keys",
        "array(CAST(value AS STRING), event_type) AS attrs_values", "event_id",
    ).withColumn("doc_id", F.col("event_id") % number).drop("event_id")
    bodies = documents.select("doc_id", F.col("text").alias("body")).hint("shuffle_hash")
    return rows.join(bodies, "doc_id").drop("doc_id")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with whole documents as opaque payloads."""
    did = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.lit("default").alias("tenant_id"),
        F.timestamp_seconds(F.lit(1704067200) + did * 7).alias("timestamp"),
        F.concat(F.lit("svc-"), (did % 5).cast("string")).alias("service"),
        F.when(did % 2 == 0, "prod").otherwise("staging").alias("env"),
        F.lpad(did.cast("string"), 32, "0").alias("profile_id"),
        F.when(did % 3 == 0, "heap").otherwise("cpu").alias("type"),
        F.base64(F.encode("text", "utf-8")).alias("payload"),
    )


def profile_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Samples (leaf first), locations, functions and the string table."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    nk, rk = F.col("n_nationkey"), F.col("r_regionkey")
    samples = customer.join(nation, F.col("c_nationkey") == nk).select(
        F.array((F.lit(1000) + nk), (F.lit(2000) + F.col("n_regionkey"))).alias("location_ids"),
        (F.lit(1) + F.col("c_custkey") % 7).cast("long").alias("value"))
    locations = nation.select(
        (nk + 1000).alias("location_id"), F.lit(0).alias("line_no"),
        (nk + 1).alias("function_id"),
    ).union(region.select(rk + 2000, F.lit(0), rk + 101))
    functions = nation.select((nk + 1).alias("function_id"), (nk + 1).alias("name_idx")).union(
        region.select(rk + 101, rk + 101))
    strings = nation.select((nk + 1).alias("idx"), F.col("n_name").alias("text")).union(
        region.select(rk + 101, "r_name"))
    return {"samples": samples, "locations": locations, "functions": functions,
            "strings": strings}


SQL_VIEWS = {
    "spans": """SELECT 'default' AS tenant_id,
      lpad(CAST(event_id - event_id % 4 + 4 AS string), 32, '0') AS trace_id,
      lpad(CAST(event_id + 4 AS string), 16, '0') AS span_id,
      CASE WHEN event_id % 4 = 0 THEN ''
           ELSE lpad(CAST(event_id - event_id % 4 + 4 AS string), 16, '0') END AS parent_span_id,
      event_type AS name, concat('svc-', CAST(user_id % 5 AS string)) AS service,
      CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env,
      CAST(event_id % 6 AS int) AS kind, CAST(ts AS timestamp) AS start_time,
      CAST(round(value * 1000000) AS bigint) AS duration_ns,
      CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 0 ELSE 1 END
        AS status_code,
      ['event.type', 'k'] AS attrs_keys,
      [event_type, regexp_extract(props, '([0-9]+)', 1)] AS attrs_values
    FROM events""",
    "metrics": """SELECT 'default' AS tenant_id, CAST(ts AS timestamp) AS timestamp,
      concat('app.', event_type) AS name,
      CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS type, value,
      concat('svc-', CAST(user_id % 5 AS string)) AS service,
      CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env
    FROM events""",
    "logs": """SELECT 'default' AS tenant_id, CAST(e.ts AS timestamp) AS timestamp,
      CASE WHEN e.event_type = 'signup' THEN repeat('0', 32)
           ELSE lpad(CAST(e.event_id - e.event_id % 4 + 4 AS string), 32, '0') END AS trace_id,
      CASE WHEN e.event_type = 'signup' THEN repeat('0', 16)
           ELSE lpad(CAST(e.event_id + 4 AS string), 16, '0') END AS span_id,
      CASE e.event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'view' THEN 5 ELSE 9 END
        AS severity_number,
      CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                        WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity_text,
      concat('svc-', CAST(e.user_id % 5 AS string)) AS service,
      CASE WHEN e.user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env,
      d.text AS body, ['duration_ms', 'event.type'] AS attrs_keys,
      [CAST(e.value AS string), e.event_type] AS attrs_values
    FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "profiles": """SELECT 'default' AS tenant_id,
      TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7) AS timestamp,
      concat('svc-', CAST(doc_id % 5 AS string)) AS service,
      CASE WHEN doc_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env,
      lpad(CAST(doc_id AS string), 32, '0') AS profile_id,
      CASE WHEN doc_id % 3 = 0 THEN 'heap' ELSE 'cpu' END AS type,
      base64(encode(text)) AS payload
    FROM documents""",
    "stacks": """SELECT concat(r.r_name, ';', n.n_name) AS stack,
      CAST(sum(1 + c.c_custkey % 7) AS bigint) AS value, count(*) AS samples
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1""",
}


def with_views(query: str, *names: str) -> str:
    """SQL of a query with the named telemetry views in front."""
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[len('WITH '):]}"
    return f"WITH {head} {body}"
