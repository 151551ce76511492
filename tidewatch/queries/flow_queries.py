"""Projections, filters, summaries, profiles and the chronological split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import flows, profile, split, windows
from tidewatch.queries.base import FE, FL, cuts_sql, query
from tidewatch.schema import EXCLUDED_FEATURES, FULL_FEATURES, PERIODS, RESTRICTED_FEATURES, STATIC_COLUMNS
from tidewatch.sources import files, views

DERIVED_COLUMNS = ["packet_rate", "byte_rate", "mean_packet_size", "bytes_per_packet",
                   "duration_log1p", "packets_log1p", "bytes_log1p"]


PLAIN_COLUMNS = ["packet_rate", "byte_rate", "mean_packet_size", "bytes_per_packet", "bytes_ratio", "packets_ratio"]
LOG_COLUMNS = ["duration_log1p", "packets_log1p", "bytes_log1p"]


def _rounded_sql(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("derived_features_events", f"""WITH {FE}
SELECT event_id, timestamp, label, flow_duration, total_packets, total_bytes,
  {_rounded_sql(DERIVED_COLUMNS)} FROM fe""")
def derived_features_events(spark, folder):
    df = views.events_common(spark, folder)
    return df.select("event_id", "timestamp", "label", "flow_duration", "total_packets", "total_bytes",
                     *[F.round(c, 6).alias(c) for c in DERIVED_COLUMNS])


@query("derived_features_lineitem", f"""WITH {FL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_packets,
  total_bytes, {', '.join(PLAIN_COLUMNS)}, {_rounded_sql(LOG_COLUMNS)} FROM fl""")
def derived_features_lineitem(spark, folder):
    df = views.lineitem_common(spark, folder)
    return df.select(*views.LINEITEM_KEY, "total_packets", "total_bytes", *PLAIN_COLUMNS,
                     *[F.round(c, 6).alias(c) for c in LOG_COLUMNS])


@query("time_range", """SELECT event_id, ts, value FROM events
WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:00'""")
def time_range(spark, folder):
    events = views.table(spark, folder, "events")
    return windows.between(events, "2024-01-08 00:00:00", "2024-01-15 12:00:00", ts="ts").select(
        "event_id", "ts", "value")


@query("time_range_closed", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-06-30'""")
def time_range_closed(spark, folder):
    items = views.table(spark, folder, "lineitem")
    return windows.between(items, "1996-01-01 00:00:00", "1997-06-30 00:00:00", True, ts="l_shipdate").select(
        *views.LINEITEM_KEY, "l_shipdate")


@query("dataset_summary", f"""WITH {FE}
SELECT 'events' AS dataset, CAST(count(*) AS BIGINT) AS row_count, CAST(11 AS BIGINT) AS features,
  CAST(10 AS BIGINT) AS cross_dataset_features, FALSE AS has_direction,
  min(timestamp) AS time_min, max(timestamp) AS time_max,
  CAST(sum(label) AS BIGINT) AS attacks, CAST(count(*) - sum(label) AS BIGINT) AS benign,
  round(avg(label), 6) AS attack_rate FROM fe""")
def dataset_summary(spark, folder):
    df = flows.dataset_summary(views.events_common(spark, folder), "events")
    return df.withColumns({
        "attacks": F.col("label_counts")["1"], "benign": F.col("label_counts")["0"],
        "attack_rate": F.round("attack_rate", 6)}).drop("label_counts")


@query("source_first_rows", """SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 500""")
def source_first_rows(spark, folder):
    """The row cap of a source, in a stated order."""
    return flows.first_rows(views.table(spark, folder, "events"), 500, ["ts", "event_id"]).select(
        "event_id", "ts", "value")


@query("rows_per_source_cap", """SELECT user_id, event_id, ts FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 20""")
def rows_per_source_cap(spark, folder):
    """The first 20 rows of every source (here: user), as a per-file cap does."""
    events = views.table(spark, folder, "events")
    return profile.first_per_group(events, ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "ts")


@query("target_counts", f"""WITH {FL}, n AS (SELECT label AS target_value, count(*) AS row_count FROM fl GROUP BY label),
e AS (SELECT * FROM (VALUES (0), (1)) v(target_value))
SELECT coalesce(n.target_value, e.target_value) AS target_value, CAST(coalesce(row_count, 0) AS BIGINT) AS row_count,
  CASE WHEN e.target_value IS NULL THEN 'unexpected' WHEN n.target_value IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM n FULL JOIN e ON n.target_value = e.target_value""")
def target_counts(spark, folder):
    return profile.target_counts(views.lineitem_flows(spark, folder))


@query("target_counts_unexpected", """WITH n AS (SELECT l_linenumber AS target_value, count(*) AS row_count FROM lineitem GROUP BY 1),
e AS (SELECT * FROM (VALUES (0), (1)) v(target_value))
SELECT coalesce(n.target_value, e.target_value) AS target_value, CAST(coalesce(row_count, 0) AS BIGINT) AS row_count,
  CASE WHEN e.target_value IS NULL THEN 'unexpected' WHEN n.target_value IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM n FULL JOIN e ON n.target_value = e.target_value""")
def target_counts_unexpected(spark, folder):
    return profile.target_counts(views.table(spark, folder, "lineitem"), "l_linenumber")


_PROFILED = ["event_id", "ts", "user_id", "event_type", "value", "props"]


_KIND = ("CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
         "ELSE lower(typeof(any_value({c}))) END")


@query("table_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_KIND.format(c=c)} AS data_type, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, count({c}) = 0 AS all_null, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_percent FROM events" for c in _PROFILED))
def table_profile(spark, folder):
    return profile.column_profile(views.table(spark, folder, "events"))


@query("table_profile_labels", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_KIND.format(c=c)} AS data_type, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, count({c}) = 0 AS all_null, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_percent FROM j" for c in ["doc_id", "quality", "toxic"])
    .join(["WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ", ""]))
def table_profile_labels(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id")
    return profile.column_profile(docs.join(views.table(spark, folder, "labels"), "doc_id", "left"))


@query("duplicate_rows", """SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - (SELECT count(*) FROM (
SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)) AS BIGINT) AS duplicates
FROM lineitem""")
def duplicate_rows(spark, folder):
    items = views.table(spark, folder, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return profile.duplicate_rows(items)


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return profile.duplicate_keys(views.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS t, column_name, column_type FROM (DESCRIBE {t})" for t in ("documents", "labels", "conversations", "embeddings"))


@query("schema_difference", f"""WITH c AS ({_COLUMNS}), d AS (SELECT * FROM c WHERE t = 'documents'), o AS (SELECT * FROM c WHERE t <> 'documents')
SELECT o.t AS table_name, 'extra' AS difference, o.column_name FROM o WHERE column_name NOT IN (SELECT column_name FROM d)
UNION ALL SELECT t.t, 'missing', d.column_name FROM d, (SELECT DISTINCT t FROM o) t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.t = t.t AND o.column_name = d.column_name)
UNION ALL SELECT o.t, 'type', o.column_name FROM o JOIN d USING (column_name) WHERE o.column_type <> d.column_type""")
def schema_difference(spark, folder):
    """How the columns of three tables differ from those of the documents, read from the footers of their files."""
    columns = {t: files.file_columns(spark, f"{folder}/{t}.parquet") for t in ("documents", "labels", "conversations", "embeddings")}
    parts = [profile.schema_difference(columns[t], columns["documents"]).select(F.lit(t).alias("table_name"), "difference", "column_name")
             for t in ("labels", "conversations", "embeddings")]
    return reduce(DataFrame.unionByName, parts)


@query("class_distribution", """SELECT event_type, CAST(count(*) AS BIGINT) AS row_count,
round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type""")
def class_distribution(spark, folder):
    return profile.class_distribution(views.table(spark, folder, "events"), "event_type")


@query("crosstab", """SELECT l_linestatus, round(avg(CAST(l_returnflag = 'A' AS INTEGER)), 6) AS "A",
round(avg(CAST(l_returnflag = 'N' AS INTEGER)), 6) AS "N", round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS "R"
FROM lineitem GROUP BY l_linestatus""")
def crosstab(spark, folder):
    items = views.table(spark, folder, "lineitem")
    return profile.row_shares(items, "l_linestatus", "l_returnflag", ["A", "N", "R"])


_HIST = ["flow_duration", "total_packets", "total_bytes"]


@query("class_histogram", f"""WITH {FE}, m AS (UNPIVOT (SELECT label, {', '.join(_HIST)} FROM fe) ON {', '.join(_HIST)}
INTO NAME feature VALUE value), r AS (SELECT feature, label, min(value) AS lo, max(value) AS hi, count(*) AS n FROM m GROUP BY ALL)
SELECT m.feature, m.label, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin,
  CAST(count(*) AS BIGINT) AS row_count, round(count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 50)), 9) AS density
FROM m JOIN r ON m.feature = r.feature AND m.label = r.label GROUP BY 1, 2, 3""")
def class_histogram(spark, folder):
    return profile.class_histogram(views.event_flows(spark, folder), _HIST, "label", 50)


_CORR = ["flow_duration", "total_packets", "total_bytes", "forward_packets", "forward_bytes", "backward_bytes",
         "packet_rate", "bytes_log1p", "packets_log1p"]


@query("correlation_pairs", f"WITH {FL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS r FROM fl"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]) + ") WHERE abs(r) > 0.8 ORDER BY abs(r) DESC, first, second LIMIT 20")
def correlation_pairs(spark, folder):
    return profile.strong_pairs(profile.correlations(views.lineitem_common(spark, folder), _CORR), 0.8, 20)


@query("correlation_matrix", f"WITH {FE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS r FROM fe"
    for i, a in enumerate(_HIST) for b in _HIST[i + 1:]))
def correlation_matrix(spark, folder):
    return profile.correlations(views.event_flows(spark, folder), _HIST)


def _summary(spark, df, **kwargs):
    cuts = split.find_cuts(df, **kwargs)
    return split.period_summary(cuts.label(df.select("timestamp", "label")))


_SUMMARY = """SELECT period, min(timestamp) AS start_ts, max(timestamp) AS end_ts, CAST(count(*) AS BIGINT) AS row_count,
CAST(sum(label) AS BIGINT) AS attacks, round(avg(label), 6) AS attack_rate FROM sp GROUP BY period"""


@query("temporal_split_events", f"WITH {FE}, {cuts_sql('fe')} {_SUMMARY}")
def temporal_split_events(spark, folder):
    return _summary(spark, views.event_flows(spark, folder))


@query("temporal_split_lineitem", f"WITH {FL}, {cuts_sql('fl')} {_SUMMARY}")
def temporal_split_lineitem(spark, folder):
    """Boundaries fall on dates shared by many rows."""
    return _summary(spark, views.lineitem_flows(spark, folder))


@query("temporal_split_no_forward", f"WITH {FL}, {cuts_sql('fl', (0.5, 0.15, 0.35))} {_SUMMARY}")
def temporal_split_no_forward(spark, folder):
    return _summary(spark, views.lineitem_flows(spark, folder), use_forward=False)


@query("temporal_split_rows", f"WITH {FL}, {cuts_sql('fl')} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, period FROM sp")
def temporal_split_rows(spark, folder):
    df = views.lineitem_flows(spark, folder)
    return split.find_cuts(df).label(df).select(*views.LINEITEM_KEY, "period")


@query("period_slice", f"WITH {FE}, {cuts_sql('fe')} SELECT event_id, timestamp FROM sp WHERE period = 'backtest'")
def period_slice(spark, folder):
    df = views.event_flows(spark, folder)
    return split.find_cuts(df).period(df, "backtest").select("event_id", "timestamp")


@query("period_guard", f"""WITH {FL}, {cuts_sql('fl')}, s AS ({_SUMMARY}),
r AS (SELECT *, list_position(['train', 'validation', 'backtest', 'forward'], period) AS rk FROM s)
SELECT CAST(count(*) AS BIGINT) AS violations FROM (SELECT *, max(end_ts) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)
WHERE start_ts <= pe""")
def period_guard(spark, folder):
    summary = _summary(spark, views.lineitem_flows(spark, folder))
    return split.order_violations(summary).agg(F.count("*").alias("violations"))


@query("period_guard_overlaps", """WITH s AS (SELECT l_returnflag, l_linenumber % 4 AS rk, min(l_shipdate) AS start_ts, max(l_shipdate) AS end_ts FROM lineitem
WHERE l_returnflag <> 'R' OR month(l_shipdate) % 4 = l_linenumber % 4 GROUP BY 1, 2),
r AS (SELECT *, max(end_ts) OVER (PARTITION BY l_returnflag ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM s)
SELECT l_returnflag, ['train', 'validation', 'backtest', 'forward'][rk + 1] AS period, start_ts, previous_end FROM r WHERE start_ts <= previous_end""")
def period_guard_overlaps(spark, folder):
    """Periods that were not cut by time (rows dealt by line number): the guard has to report every one that overlaps."""
    items = views.table(spark, folder, "lineitem")
    place = F.pmod("l_linenumber", F.lit(4))
    items = items.where((F.col("l_returnflag") != "R") | (F.pmod(F.month("l_shipdate"), F.lit(4)) == place))
    names = F.array(*[F.lit(p) for p in PERIODS])
    summary = items.groupBy("l_returnflag", F.element_at(names, (place + 1).cast("int")).alias("period")).agg(
        F.min("l_shipdate").alias("start_ts"), F.max("l_shipdate").alias("end_ts"))
    return split.order_violations(summary, ("l_returnflag",)).select("l_returnflag", "period", "start_ts", "previous_end")


@query("feature_fingerprint", """SELECT substr(sha256(string_agg(c, chr(10) ORDER BY c)), 1, 16) AS fingerprint
FROM (SELECT DISTINCT event_type AS c FROM events)""")
def feature_fingerprint(spark, folder):
    return flows.feature_fingerprint(views.table(spark, folder, "events"), "event_type")


_NAMES = [*STATIC_COLUMNS, *EXCLUDED_FEATURES]


def _among(names):
    return "count(DISTINCT c) FILTER (c IN (" + ", ".join(repr(n) for n in names) + "))"


@query("feature_policy", f"""WITH cols AS (SELECT s_nationkey AS g, {_NAMES!r}[(p_size + s_nationkey) % {len(_NAMES) + 5} + 1] AS n, p_type FROM part JOIN supplier ON p_partkey % 40 = s_nationkey),
named AS (SELECT g, coalesce(n, p_type) AS c FROM cols)
SELECT g AS table_number, CAST(count(DISTINCT c) AS BIGINT) AS columns_seen, {_among(EXCLUDED_FEATURES)} = 0 AS policy_compliant, CAST({_among(FULL_FEATURES)} AS BIGINT) AS full_available,
CAST({len(FULL_FEATURES)} - {_among(FULL_FEATURES)} AS BIGINT) AS full_missing, CAST({len(RESTRICTED_FEATURES)} - {_among(RESTRICTED_FEATURES)} AS BIGINT) AS restricted_missing FROM named GROUP BY g""")
def feature_policy(spark, folder):
    """Policy checks of tables of column names, drawn from known, forbidden and unknown names by the sizes of parts."""
    parts = views.table(spark, folder, "part").withColumn("s_nationkey", F.pmod("p_partkey", F.lit(40)).cast("int"))
    # A report counts names, not rows: one row for each part of a table is enough, however many suppliers share it.
    parts = parts.select("s_nationkey", "p_size", "p_type").distinct()
    rows = parts.join(views.table(spark, folder, "supplier").select("s_nationkey"), "s_nationkey", "left_semi")
    names = F.array(*[F.lit(n) for n in _NAMES])
    place = F.pmod(F.col("p_size") + F.col("s_nationkey"), F.lit(len(_NAMES) + 5)) + 1
    named = rows.select(F.col("s_nationkey").alias("table_number"), F.coalesce(F.try_element_at(names, place.cast("int")), "p_type").alias("name"))
    return profile.feature_policy(named, "name", ["table_number"]).select(
        "table_number", "columns_seen", "policy_compliant", F.size("full_available").cast("long").alias("full_available"),
        F.size("full_missing").cast("long").alias("full_missing"),
        F.size("restricted_missing").cast("long").alias("restricted_missing"))


@query("trimmed_strings", """SELECT p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand, trim(p_type) AS p_type FROM part""")
def trimmed_strings(spark, folder):
    padded = views.table(spark, folder, "part").select(
        "p_partkey", *[F.concat(F.lit("  "), c, F.lit(" ")).alias(c) for c in ("p_name", "p_brand", "p_type")])
    return flows.trimmed(padded)


@query("stable_time_order", """SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position,
l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def stable_time_order(spark, folder):
    """Every row's position in time order, ties broken by the row key."""
    from tidewatch.operators.running import number_rows

    items = views.table(spark, folder, "lineitem").select(F.lit(0).alias("one"), "l_shipdate", *views.LINEITEM_KEY)
    numbered = number_rows(items, ["one"], ["l_shipdate", *views.LINEITEM_KEY], "position", items.count())
    return numbered.select("position", *views.LINEITEM_KEY)


