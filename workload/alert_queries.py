"""Rules, monitors, incidents, profiles and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlake.functions.attrs import attr_number
from spanlake.operators import correlate as C, flame as FL, incidents as I, metrics as M
from spanlake.operators import monitors as MO, rules as RU

from . import views as V
from .config_tables import MONITOR_VIEWS, monitors, rules
from .registry import query

_SEP = r"[\x00-/:-@\[-`{-\x7F]"

_MATCH = f"""l.tenant_id = r.tenant_id AND r.enabled AND CASE r.filter_type
    WHEN 'severity' THEN l.severity_text = r.filter_value
    WHEN 'service' THEN l.service = r.filter_value
    WHEN 'keyword' THEN list_contains(regexp_split_to_array(l.body, '{_SEP}'), r.filter_value)
    ELSE CASE r.filter_value WHEN 'th[ae]t?ou' THEN regexp_matches(l.body, 'th[ae]t?ou')
         ELSE regexp_matches(l.body, '[0-9]{{3}}-[0-9]{{4}}') END END
  AND (r.value_field = '' OR list_contains(l.attrs_keys, r.value_field))"""
_DERIVED = f"""SELECT l.tenant_id, epoch_us(l.timestamp) // 1000 AS t, r.metric_name AS name,
    CASE WHEN r.value_field = '' THEN 1 ELSE 0 END AS type,
    CASE WHEN r.value_field = '' THEN 1.0
         ELSE coalesce(TRY_CAST(l.attrs_values[list_position(l.attrs_keys, r.value_field)]
                                AS double), 0) END AS value, l.service, l.env
  FROM logs l JOIN rules r ON {_MATCH}"""


def _derived(spark, sf) -> DataFrame:
    return RU.apply_rules(V.logs(spark, sf), rules(spark, sf))


RULES_SQL = f"""SELECT name, type, service, env, count(*) AS n, round(sum(value), 6) AS total,
    min(t) AS first_t, max(t) AS last_t
  FROM ({_DERIVED}) GROUP BY ALL"""


def rule_totals(derived: DataFrame) -> DataFrame:
    t = F.unix_millis("timestamp")
    return derived.groupBy("name", "type", "service", "env").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"),
        F.min(t).alias("first_t"), F.max(t).alias("last_t"))


@query("log_metric_rules_apply", RULES_SQL, ("logs", "rules"))
def log_metric_rules_apply(spark, sf):
    return rule_totals(_derived(spark, sf))


@query("log_metric_rules_join", RULES_SQL, ("logs", "rules"))
def log_metric_rules_join(spark, sf):
    """The same with many more rules beside, one keyword per order, which no log holds."""
    idle = V.table(spark, sf, "orders").select(
        F.lit("default").alias("tenant_id"), F.lit("idle").alias("metric_name"),
        F.lit("keyword").alias("filter_type"), F.lit(True).alias("enabled"),
        F.concat(F.lit("order0"), F.col("o_orderkey").cast("string")).alias("filter_value"),
        F.lit("").alias("value_field"))
    many = rules(spark, sf).select(idle.columns).unionByName(idle)
    return rule_totals(RU.apply_rules(V.logs(spark, sf), many))


@query("rule_filter", f"""SELECT span_id, severity_text, service FROM logs WHERE
  list_contains(regexp_split_to_array(body, '{_SEP}'), 'les')""", ("logs",))
def rule_filter(spark, sf):
    keep = RU.rule_predicate({"filter_type": "keyword", "filter_value": "les"})
    return V.logs(spark, sf).where(keep).select("span_id", "severity_text", "service")


@query("attr_value_metric", """SELECT service, epoch_us(date_trunc('day', timestamp)) // 1000 AS t,
    round(avg(CAST(attrs_values[1] AS double)), 6) AS v FROM logs WHERE severity_text = 'ERROR'
  GROUP BY ALL""", ("logs",))
def attr_value_metric(spark, sf):
    """A value rule over error logs, aggregated as a daily series per service."""
    rule = {"filter_type": "severity", "filter_value": "ERROR"}
    rows = V.logs(spark, sf).where(RU.rule_predicate(rule)).select(
        "timestamp", "service", "env", F.lit("error.duration").alias("name"),
        attr_number("duration_ms").alias("value"))
    series = M.query_range(rows, "error.duration", step=86400, agg="avg", group_by=["service"])
    return series.withColumn("v", F.round("v", 6))


@query("metric_sources_union", f"""SELECT name, service, count(*) AS n FROM (
    SELECT name, service FROM metrics UNION ALL SELECT name, service FROM ({_DERIVED}))
  GROUP BY ALL""", ("metrics", "logs", "rules"))
def metric_sources_union(spark, sf):
    both = M.metric_sources(V.metrics(spark, sf), _derived(spark, sf))
    return both.groupBy("name", "service").agg(F.count(F.lit(1)).alias("n"))


@query("list_rules", "SELECT rule_id, metric_name, filter_type, filter_value, value_field, "
       "metric_type, enabled, epoch_us(created_at) // 1000 AS created_ms FROM rules "
       "ORDER BY created_at DESC, rule_id LIMIT 1000", ("rules",))
def list_rules(spark, sf):
    return RU.list_rules(rules(spark, sf)).select(
        "rule_id", "metric_name", "filter_type", "filter_value", "value_field", "metric_type",
        "enabled", F.unix_millis("created_at").alias("created_ms"))


def evaluations(spark, sf) -> DataFrame:
    return MO.evaluate_monitors(monitors(spark, sf), V.spans(spark, sf), V.logs(spark, sf),
                                V.START, V.END)


@query("interval_due", "SELECT monitor_id, count(*) AS ticks, epoch_us(min(tick)) // 1000 AS first_t, "
       "epoch_us(max(tick)) // 1000 AS last_t FROM ticks GROUP BY 1", ("monitors", "ticks"))
def interval_due(spark, sf):
    ticks = MO.due_ticks(monitors(spark, sf), V.START, V.END)
    return ticks.groupBy("monitor_id").agg(
        F.count(F.lit(1)).alias("ticks"), F.unix_millis(F.min("tick")).alias("first_t"),
        F.unix_millis(F.max("tick")).alias("last_t"))


@query("monitor_eval", "SELECT monitor_id, epoch_us(tick) // 1000 AS t, coalesce(round(value, 6), -1) AS value, "
       "violated FROM evaluations", MONITOR_VIEWS)
def monitor_eval(spark, sf):
    return evaluations(spark, sf).select(
        "monitor_id", F.unix_millis("tick").alias("t"), F.coalesce(F.round("value", 6), F.lit(-1.0)).alias("value"),
        "violated")


@query("monitor_aggregates", "SELECT monitor_id, op, threshold, count(*) AS ticks, count(value) AS "
       "with_value, round(min(value), 6) AS lowest, round(max(value), 6) AS highest "
       "FROM monitor_values GROUP BY ALL", MONITOR_VIEWS[:4])
def monitor_aggregates(spark, sf):
    values = MO.monitor_values(monitors(spark, sf), V.spans(spark, sf), V.logs(spark, sf),
                               V.START, V.END)
    return values.groupBy("monitor_id", "op", "threshold").agg(
        F.count(F.lit(1)).alias("ticks"), F.count("value").alias("with_value"),
        F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"))


# Without actions, a run of violations is one incident, ended by the next normal evaluation.
_ISLANDS = """SELECT monitor_id, min(tick) AS triggered, CASE WHEN count(ended) = count(*) THEN max(ended) END AS ended,
    min_by(value, tick) AS trigger_value, count(*) AS violations
  FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY tick)
          - row_number() OVER (PARTITION BY monitor_id, violated ORDER BY tick) AS island,
          lead(tick) OVER (PARTITION BY monitor_id ORDER BY tick) AS ended FROM evaluations)
  WHERE violated GROUP BY monitor_id, island"""


@query("incident_islands", f"""SELECT monitor_id, epoch_us(triggered) // 1000 AS triggered_t,
    coalesce(epoch_us(ended) // 1000, 0) AS resolved_t, round(trigger_value, 6) AS trigger_value
  FROM ({_ISLANDS})""", MONITOR_VIEWS)
def incident_islands(spark, sf):
    found = I.incident_spans(I.as_events(evaluations(spark, sf)))
    return found.select("monitor_id", F.unix_millis("triggered_at").alias("triggered_t"),
                        F.coalesce(F.unix_millis("resolved_at"), F.lit(0)).alias("resolved_t"),
                        F.round("trigger_value", 6).alias("trigger_value"))


# The state machine itself, folded event by event with a recursive query.
_ACTIONS_SQL = """actions AS (SELECT 'default' AS tenant_id, concat('mon-', CAST(event_id % 25 AS string)) AS
      monitor_id, CASE WHEN event_id % 2 = 1 THEN date_trunc('hour', CAST(ts AS timestamp))
        ELSE date_trunc('second', CAST(ts AS timestamp)) END AS moment,
      CASE event_type WHEN 'signup' THEN 'acknowledge' ELSE 'resolve' END AS action
    FROM events WHERE event_type IN ('signup', 'error') AND value > 60)"""
_FOLD = f"""WITH RECURSIVE {_ACTIONS_SQL}, line AS (
    SELECT monitor_id, moment, kind, value, row_number() OVER (PARTITION BY monitor_id
      ORDER BY moment, step, kind, value) AS i
    FROM (SELECT monitor_id, tick AS moment, 0 AS step, CASE WHEN violated THEN 'violation'
            ELSE 'normal' END AS kind, value FROM evaluations
          UNION ALL SELECT a.monitor_id, moment, 1, action, NULL FROM actions a
          WHERE a.monitor_id IN (SELECT monitor_id FROM evaluations))),
  fold AS (
    SELECT monitor_id, i, moment, kind, 'none' AS before,
      CASE WHEN kind = 'violation' THEN 'triggered' ELSE 'none' END AS after,
      CASE WHEN kind = 'violation' THEN moment END AS opened,
      CASE WHEN kind = 'violation' THEN value END AS v FROM line WHERE i = 1
    UNION ALL
    SELECT l.monitor_id, l.i, l.moment, l.kind, f.after AS before,
      CASE WHEN f.after = 'none' AND l.kind = 'violation' THEN 'triggered'
           WHEN f.after = 'triggered' AND l.kind = 'acknowledge' THEN 'acknowledged'
           WHEN f.after = 'triggered' AND l.kind = 'normal' THEN 'none'
           WHEN l.kind = 'resolve' THEN 'none' ELSE f.after END AS after,
      CASE WHEN f.after = 'none' AND l.kind = 'violation' THEN l.moment
           WHEN f.after = 'none' THEN NULL ELSE f.opened END AS opened,
      CASE WHEN f.after = 'none' AND l.kind = 'violation' THEN l.value
           WHEN f.after = 'none' THEN NULL ELSE f.v END AS v
    FROM fold f JOIN line l ON l.monitor_id = f.monitor_id AND l.i = f.i + 1),
  incidents AS (SELECT monitor_id, opened AS triggered, max(v) AS trigger_value,
      max(CASE WHEN before <> 'none' AND after = 'none' THEN moment END) AS ended,
      bool_or(after = 'acknowledged') AS acked
    FROM fold WHERE opened IS NOT NULL GROUP BY 1, 2),
  named AS (SELECT *, CASE WHEN ended IS NOT NULL THEN 'resolved' WHEN acked THEN 'acknowledged'
      ELSE 'triggered' END AS status FROM incidents)"""


def actions(spark, sf) -> DataFrame:
    """Operator actions made from events, many an hour; half of them fall on full hours, where
    monitors are evaluated and other actions fall too."""
    events = V.table(spark, sf, "events").where(
        F.col("event_type").isin("signup", "error") & (F.col("value") > 60))
    at = F.when(F.col("event_id") % 2 == 1, F.date_trunc("hour", "ts")).otherwise(
        F.date_trunc("second", "ts"))
    return events.select(
        F.lit("default").alias("tenant_id"),
        F.concat(F.lit("mon-"), (F.col("event_id") % 25).cast("string")).alias("monitor_id"),
        at.alias("at"),
        F.when(F.col("event_type") == "signup", "acknowledge").otherwise("resolve")
        .alias("action"))


def known_actions(spark, sf) -> DataFrame:
    enabled = monitors(spark, sf).where("enabled").select("tenant_id", "monitor_id")
    return actions(spark, sf).join(enabled, ["tenant_id", "monitor_id"], "left_semi")


def _incidents(spark, sf) -> DataFrame:
    return I.incidents_batch(evaluations(spark, sf), monitors(spark, sf),
                             known_actions(spark, sf))


def incident_view(df: DataFrame) -> DataFrame:
    return df.select("monitor_id", "status", F.unix_millis("triggered_at").alias("triggered_t"),
                     F.coalesce(F.unix_millis("resolved_at"), F.lit(0)).alias("resolved_t"),
                     F.round("trigger_value", 6).alias("trigger_value"))


INCIDENT_SQL = _FOLD + """ SELECT monitor_id, status, epoch_us(triggered) // 1000 AS triggered_t,
    coalesce(epoch_us(ended) // 1000, 0) AS resolved_t, round(trigger_value, 6) AS trigger_value FROM named"""


@query("incident_lifecycle", INCIDENT_SQL, MONITOR_VIEWS)
def incident_lifecycle(spark, sf):
    return incident_view(_incidents(spark, sf))


@query("incident_actions", _FOLD + """ SELECT monitor_id, epoch_us(moment) // 1000 AS t,
    kind AS action, CASE WHEN before <> after THEN 'applied' ELSE 'conflict' END AS outcome
  FROM fold WHERE kind IN ('acknowledge', 'resolve')""", MONITOR_VIEWS)
def incident_actions(spark, sf):
    done = I.action_outcomes(evaluations(spark, sf), known_actions(spark, sf))
    return done.select("monitor_id", F.unix_millis("at").alias("t"), "action", "outcome")


@query("incident_list", _FOLD + """ SELECT monitor_id, status,
    epoch_us(triggered) // 1000 AS triggered_t, count(*) OVER () AS total FROM named
  WHERE status = 'resolved'""", MONITOR_VIEWS)
def incident_list(spark, sf):
    listed = I.incident_list(_incidents(spark, sf), "default", "resolved")
    return listed.select("monitor_id", "status",
                         F.unix_millis("triggered_at").alias("triggered_t"), "total")


@query("incident_message", _FOLD + """ SELECT n.monitor_id, epoch_us(triggered) // 1000 AS t,
    printf('[%s] %s — 현재값 %.4f (임계값 %s %.4f)', upper(m.severity), m.name, trigger_value,
      CASE m.op WHEN 'gt' THEN '>' WHEN 'gte' THEN '>=' WHEN 'lt' THEN '<' WHEN 'lte' THEN '<='
        ELSE '==' END, m.threshold) AS title, upper(status) AS status_field,
    printf('%.4f', trigger_value) AS value_field
  FROM named n JOIN monitors m ON m.monitor_id = n.monitor_id""", MONITOR_VIEWS)
def incident_message(spark, sf):
    """The title, and two fields read back from the notification payload."""
    payload = I.incident_message(_incidents(spark, sf), keep=("monitor_id", "triggered_at", "title"))
    field = lambda i: F.get_json_object(
        "message", f"$.attachments[0].fields[{i}].value")
    return payload.select(
        "monitor_id", F.unix_millis("triggered_at").alias("t"), "title",
        field(0).alias("status_field"), field(2).alias("value_field"))


@query("profile_symbolize", "SELECT stack, value, samples FROM stacks", ("stacks",))
def profile_symbolize(spark, sf):
    return FL.symbolize(**V.profile_tables(spark, sf))


_TREE = """SELECT '' AS path, '-' AS parent, 'all' AS name, 0 AS depth,
    CAST(sum(value) AS bigint) AS value, 0 AS self_value FROM stacks UNION ALL
  SELECT split_part(stack, ';', 1), '', split_part(stack, ';', 1), 1,
    CAST(sum(value) AS bigint), 0 FROM stacks GROUP BY 1 UNION ALL
  SELECT stack, split_part(stack, ';', 1), split_part(stack, ';', 2), 2, value, value
  FROM stacks"""


def _tree(spark, sf) -> DataFrame:
    return FL.flame_tree(FL.symbolize(**V.profile_tables(spark, sf)))


@query("flame_tree", _TREE, ("stacks",))
def flame_tree(spark, sf):
    return _tree(spark, sf).withColumn("parent", F.coalesce("parent", F.lit("-")))


@query("flame_share", f"""WITH t AS ({_TREE}) SELECT path, value, round(value * 100.0 /
    (SELECT value FROM t WHERE depth = 0), 9) AS share FROM t""", ("stacks",))
def flame_share(spark, sf):
    return FL.flame_share(_tree(spark, sf)).select("path", "value",
                                                   F.round("share", 9).alias("share"))


@query("flame_offsets", f"""WITH t AS ({_TREE}), a AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE
      coalesce(sum(value) OVER (PARTITION BY parent ORDER BY name ROWS BETWEEN UNBOUNDED
        PRECEDING AND 1 PRECEDING), 0) END AS ahead FROM t),
  total AS (SELECT value AS v FROM t WHERE depth = 0)
  SELECT a.path, a.depth, round((a.ahead + coalesce(p.ahead, 0)) / CAST(total.v AS double), 9) AS x,
    round(a.value / CAST(total.v AS double), 9) AS width
  FROM a LEFT JOIN a p ON p.path = a.parent AND a.depth = 2, total""", ("stacks",))
def flame_offsets(spark, sf):
    laid = FL.flame_layout(_tree(spark, sf))
    return laid.select("path", "depth", F.round("x", 9).alias("x"),
                       F.round("width", 9).alias("width"))


@query("trace_log_correlation", """SELECT l.trace_id, l.span_id, l.severity_text,
    epoch_us(l.timestamp) // 1000 AS t, s.name AS span_name, s.service AS span_service,
    s.duration_ns, s.status_code, length(l.body) AS chars
  FROM logs l LEFT JOIN (SELECT * FROM spans WHERE kind <> 3) s
    ON s.trace_id = l.trace_id AND s.span_id = l.span_id
  WHERE NOT regexp_full_match(l.trace_id, '0*')""", ("spans", "logs"))
def trace_log_correlation(spark, sf):
    """Spans of one kind are not stored; their logs stay."""
    return C.correlate_logs(V.spans(spark, sf).where("kind <> 3"), V.logs(spark, sf)).select(
        "trace_id", "span_id", "severity_text", F.unix_millis("timestamp").alias("t"),
        "span_name", "span_service", "duration_ns", "status_code",
        F.length("body").alias("chars"))


# Deeper trees than the view's own: the n-th span of a trace hangs below the one before it.
_DEEP = """deep AS (SELECT * REPLACE (CASE WHEN CAST(span_id AS bigint) % 4 = 0 THEN ''
    ELSE lpad(CAST(CAST(span_id AS bigint) - 1 AS string), 16, '0') END AS parent_span_id)
  FROM spans)"""


@query("trace_tree", f"""WITH RECURSIVE {_DEEP}, tree AS (
    SELECT trace_id, span_id, parent_span_id, 0 AS depth, span_id AS root_span_id,
      false AS orphan FROM deep WHERE parent_span_id = ''
    UNION ALL
    SELECT d.trace_id, d.span_id, d.parent_span_id, t.depth + 1, t.root_span_id, false
    FROM deep d JOIN tree t ON d.trace_id = t.trace_id AND d.parent_span_id = t.span_id)
  SELECT * FROM tree""", ("spans",))
def trace_tree(spark, sf):
    number = F.col("span_id").cast("long")
    deep = V.spans(spark, sf).withColumn(
        "parent_span_id", F.when(number % 4 == 0, "").otherwise(
            F.lpad((number - 1).cast("string"), 16, "0")))
    return C.trace_tree(deep).select("trace_id", "span_id", "parent_span_id", "depth",
                                     "root_span_id", "orphan")
