"""Incidents from evaluations and operator actions.

Life of an incident: a violation with no open incident triggers one.  A normal evaluation
resolves a triggered incident.  Acknowledging (only from triggered) keeps it open through
recoveries until someone resolves it by hand, and an open incident suppresses new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.codes import fixed, natural_id, op_symbol

KEY = ["tenant_id", "monitor_id"]

# Fixed value: title format.
TITLE = "[%s] %s — 현재값 %.4f (임계값 %s %.4f)"
# Notification colours and symbols per severity.
COLORS = {"CRITICAL": "#FF0000", "WARNING": "#FFA500", "INFO": "#0000FF"}
SYMBOLS = {"CRITICAL": ":red_circle:", "WARNING": ":large_yellow_circle:",
           "INFO": ":large_blue_circle:"}


def as_events(evaluations: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """One time line (at, step, kind, value) of evaluations and actions.

    Kinds: violation, normal, acknowledge, resolve.  At equal times evaluations precede actions,
    and within either the kinds go by name, so an acknowledgement precedes a resolution.
    """
    events = evaluations.select(
        *KEY, F.col("tick").alias("at"), F.lit(0).alias("step"),
        F.when(F.col("violated"), "violation").otherwise("normal").alias("kind"), "value")
    if actions is None:
        return events
    return events.unionByName(actions.select(
        *KEY, "at", F.lit(1).alias("step"), F.col("action").alias("kind"),
        F.lit(None).cast("double").alias("value")))


#: Total order of a monitor's events; what is equal in all of it has the same effect.
ORDER = ["at", "step", "kind", "value"]


def incident_id(triggered_at: Column) -> Column:
    return natural_id(F.col("tenant_id"), F.col("monitor_id"), F.unix_micros(triggered_at))


def _history(events: DataFrame) -> DataFrame:
    """Events with the open state before and after each, and the incident number.

    A manual resolve always leaves the monitor without an open incident, so each stretch
    between two of them is judged on its own: it is acknowledged from the first acknowledge
    that found a violation, and otherwise open as long as the last evaluation violated.  The
    windows hold one monitor's evaluations (interval-paced), not telemetry rows.
    """
    line = W.partitionBy(*KEY).orderBy(*ORDER)
    is_eval = F.col("kind").isin("violation", "normal")
    stretch = F.coalesce(F.sum(F.when(F.col("kind") == "resolve", 1).otherwise(0)).over(
        line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = W.partitionBy(*KEY, "_stretch").orderBy(*ORDER)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    bad = F.coalesce(F.last(F.when(is_eval, F.col("kind") == "violation"),
                            ignorenulls=True).over(running), F.lit(False))
    hit = (F.col("kind") == "acknowledge") & F.col("_bad")
    acked = F.coalesce(F.max(hit).over(running), F.lit(False))
    open_after = (F.col("_acked") | F.col("_bad")) & (F.col("kind") != "resolve")
    open_before = F.coalesce(F.lag("_open").over(line), F.lit(False))
    starts = F.when(F.col("_open") & ~F.col("_was_open"), 1).otherwise(0)
    return (
        events.withColumn("_stretch", stretch).withColumn("_bad", bad)
        .withColumn("_acked", acked).withColumn("_open", open_after)
        .withColumn("_was_open", open_before).withColumn("_starts", starts)
        .withColumn("_number", F.sum("_starts").over(
            line.rowsBetween(W.unboundedPreceding, W.currentRow))))


def incident_spans(events: DataFrame) -> DataFrame:
    """Incidents as (id, status, triggered_at, resolved_at, trigger_value)."""
    concerns = F.col("_open") | F.col("_was_open")
    closes = F.col("_was_open") & ~F.col("_open")
    rows = _history(events).where(concerns)
    found = rows.groupBy(*KEY, "_number").agg(
        F.min("at").alias("triggered_at"),
        F.min(F.when(closes, F.col("at"))).alias("resolved_at"),
        F.max(F.when(F.col("_starts") == 1, F.col("value"))).alias("trigger_value"),
        F.max("_acked").alias("_acked"))
    status = (F.when(F.col("resolved_at").isNotNull(), "resolved")
              .when(F.col("_acked"), "acknowledged").otherwise("triggered"))
    return found.select(
        incident_id(F.col("triggered_at")).alias("incident_id"), *KEY, status.alias("status"),
        "triggered_at", "resolved_at", "trigger_value")


def action_outcomes(evaluations: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions with the verdict 'applied' or 'conflict'."""
    rows = _history(as_events(evaluations, actions))
    line = W.partitionBy(*KEY).orderBy(*ORDER)
    was_acked = F.coalesce(F.lag("_acked").over(line), F.lit(False))
    done = F.when(F.col("kind") == "resolve", F.col("_was_open")).otherwise(
        F.col("_was_open") & ~F.col("_acked_before"))
    return (rows.withColumn("_acked_before", was_acked)
            .where(F.col("kind").isin("acknowledge", "resolve"))
            .select(*KEY, "at", F.col("kind").alias("action"),
                    F.when(done, "applied").otherwise("conflict").alias("outcome")))


def incidents_batch(evaluations: DataFrame, monitors: DataFrame,
                    actions: DataFrame | None = None) -> DataFrame:
    """Incidents with severity and title."""
    return describe(incident_spans(as_events(evaluations, actions)), monitors)


def describe(incidents: DataFrame, monitors: DataFrame) -> DataFrame:
    """Add the monitor's severity and the incident title."""
    about = monitors.select(*KEY, "name", F.upper("severity").alias("severity"), "op",
                            "threshold")
    title = F.format_string(TITLE, "severity", "name", "trigger_value", op_symbol(F.col("op")),
                            "threshold")
    return incidents.join(about, KEY).withColumn("title", title).drop("name", "op", "threshold")


def incident_list(incidents: DataFrame, tenant_id: str | None = None,
                  status: str | None = None) -> DataFrame:
    """Incidents of a tenant and status, each optional, with their total."""
    if tenant_id is not None:
        incidents = incidents.where(F.col("tenant_id") == tenant_id)
    if status is not None:
        incidents = incidents.where(F.col("status") == status)
    return incidents.withColumn("total", incidents.agg(F.count(F.lit(1)).alias("n")).scalar())


def incident_message(incidents: DataFrame, footer: str = "spanlake",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Notification payload (JSON) per incident, beside the columns to ``keep``; sending it is left
    to the caller."""
    pick = lambda table: F.element_at(
        F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("severity"))

    def field(title: str, value: Column, short: bool = True) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"),
                        F.lit(short).alias("short"))

    attachment = F.struct(
        pick(COLORS).alias("color"),
        F.array(field("Status", F.upper("status")), field("Severity", F.col("severity")),
                field("Trigger Value", fixed(F.col("trigger_value"), 4)),
                field("Tenant", F.col("tenant_id")),
                field("Incident ID", F.col("incident_id"), False)).alias("fields"),
        F.lit(footer).alias("footer"), F.unix_seconds("triggered_at").alias("ts"))
    text = F.concat(pick(SYMBOLS), F.lit(" ["), F.col("severity"), F.lit("] "), F.col("title"))
    return incidents.select("incident_id", *keep, F.to_json(F.struct(
        text.alias("text"), F.array(attachment).alias("attachments"))).alias("message"))
