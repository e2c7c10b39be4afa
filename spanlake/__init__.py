"""Telemetry analytics on Spark: traces, logs, metrics and profiles as DataFrames.

Every function takes and returns DataFrames (or Columns).  Work stays lazy, except that exact
quantiles, trace trees, rule matching and large first-k selections run a first, aggregating pass
when called, because its result decides how the second pass is planned.  Clock reads are explicit ``as_of`` arguments.
"""
