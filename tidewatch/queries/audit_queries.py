"""Source mappings, run tables, reports and audits.

Run tables are derived from the line items: a run is a year and a line status, a model is
picked by line number, a strategy by supplier, and the first half of a year is the backtest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import audit, documents, metrics
from tidewatch.queries.base import query
from tidewatch.queries.metric_queries import rates_sql
from tidewatch.sources import flows as readers
from tidewatch.sources import runs as run_source
from tidewatch.sources import views

MODELS = audit.REQUIRED_MODELS
STRATEGIES = audit.REQUIRED_STRATEGIES


def _pick(names, column):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(column, F.lit(len(names))) + 1).cast("int"))


def run_rows(spark, folder):
    items = views.table(spark, folder, "lineitem")
    return items.select(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("_temporal_"), "l_linestatus").alias("run"),
        _pick(MODELS, "l_linenumber").alias("model"), _pick(STRATEGIES, "l_suppkey").alias("strategy"),
        F.when(F.month("l_shipdate") <= 6, "backtest").otherwise("forward").alias("period"),
        F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10.0).alias("y_score"), (F.col("l_discount") * 10.0 >= 0.5).cast("int").alias("y_pred"))


def run_metrics(spark, folder):
    return metrics.confusion(run_rows(spark, folder), ["run", "model", "period"]).withColumn(
        "model_threshold", F.lit(0.5))


def run_strategies(spark, folder):
    rows = run_rows(spark, folder).where("period = 'forward'")
    return metrics.confusion(rows, ["run", "model", "strategy"]).withColumn(
        "strategy_threshold", F.when(F.col("strategy") == "none", 0.5).otherwise(0.4))


def _case(names, column):
    return f"CASE {column} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


ROWS = f"""rr AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_temporal_' || l_linestatus AS run, {_case(MODELS, 'l_linenumber')} AS model,
  {_case(STRATEGIES, 'l_suppkey')} AS strategy, CASE WHEN month(l_shipdate) <= 6 THEN 'backtest' ELSE 'forward' END AS period, l_shipdate AS ts,
  CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_discount * 10::DOUBLE AS y_score, CAST(l_discount * 10::DOUBLE >= 0.5 AS INTEGER) AS y_pred FROM lineitem),
rm AS (SELECT * FROM {rates_sql('rr', 'run, model, period')}), rs AS (SELECT * FROM {rates_sql('rr', 'run, model, strategy', "period = 'forward'")}),
mt AS (SELECT run, model, max(CASE WHEN period = 'backtest' THEN f1 END) AS bt_f1, max(CASE WHEN period = 'forward' THEN f1 END) AS fw_f1 FROM rm GROUP BY 1, 2)"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("bidirectional_mapping", """SELECT make_timestamp(CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) * 1000000) AS timestamp, l_tax AS flow_duration, CAST(l_returnflag = 'R' AS INTEGER) AS label,
l_linestatus AS protocol, l_quantity + l_linenumber AS total_packets, CASE WHEN l_tax > 0 THEN (l_quantity + l_linenumber) / l_tax ELSE 0 END AS packet_rate,
CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY ALL""")
def bidirectional_mapping(spark, folder):
    """Raw column names in mixed case, epoch seconds and text labels, mapped to the common schema."""
    raw = views.table(spark, folder, "lineitem").select(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("Stime"), F.col("l_tax").alias("dur"),
        F.col("l_quantity").alias("Spkts"), F.col("l_linenumber").alias("DPKTS"), F.col("l_extendedprice").alias(" sbytes "),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("dbytes"), F.col("l_linestatus").alias("proto"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("none").alias("Label"), F.col("l_partkey").alias("unused"))
    mapped = readers.map_bidirectional(raw)
    columns = ["timestamp", "flow_duration", "label", "protocol", "total_packets", "packet_rate"]
    return mapped.groupBy(*columns).agg(F.count("*").alias("copies"))


_NETFLOW = """n AS (SELECT date_trunc('second', ts) AS timestamp, value AS flow_duration, event_type AS raw_label, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS packets FROM events)"""


@query("netflow_projection", f"""WITH {_NETFLOW} SELECT timestamp, flow_duration, packets AS total_packets, packets * 40 AS total_bytes, 'TCP' AS protocol, '.AP.S.' AS tcp_flags,
CASE raw_label WHEN 'error' THEN 1 ELSE 0 END AS label, CAST(count(*) AS BIGINT) AS copies FROM n WHERE raw_label IN ('error', 'view') AND user_id % 7 <> 0 GROUP BY ALL""")
def netflow_projection(spark, folder):
    """Events written as netflow lines and parsed back; unknown labels and broken times drop out."""
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(F.col("event_type") == "error", " Blacklist").when(F.col("event_type") == "view", "background ").otherwise("scan")
    when = F.when(F.pmod("user_id", F.lit(7)) == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    lines = views.table(spark, folder, "events").select(F.concat_ws(
        ",", when, F.col("value").cast("string"), F.lit("10.0.0.1"), F.lit("10.0.0.2"), F.lit("56428"), F.lit("80"),
        F.lit(" TCP"), F.lit(".AP.S."), F.lit("0"), F.lit("0"), k.cast("string"), (k * 40).cast("string"), label).alias("value"))
    mapped = readers.map_netflow(readers.netflow_fields(lines))
    return mapped.groupBy("timestamp", "flow_duration", "total_packets", "total_bytes", "protocol", "tcp_flags", "label").agg(
        F.count("*").alias("copies"))


@query("union_archives", """SELECT source, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(n) AS BIGINT) AS total FROM (
SELECT 'documents' AS source, n_chars AS n FROM documents UNION ALL SELECT 'events', user_id FROM events UNION ALL SELECT 'conversations', turn FROM conversations) GROUP BY source""")
def union_archives(spark, folder):
    """Several sources under one schema, with the source kept."""
    parts = [views.table(spark, folder, t).select(F.lit(t).alias("source"), F.col(c).cast("long").alias("n"))
             for t, c in (("documents", "n_chars"), ("events", "user_id"), ("conversations", "turn"))]
    return audit.union_records(parts).groupBy("source").agg(F.count("*").alias("row_count"), F.sum("n").alias("total"))


@query("union_sparse_records", """SELECT ablation, CAST(count(*) AS BIGINT) AS row_count, CAST(count(f1) AS BIGINT) AS with_f1, CAST(count(alerts) AS BIGINT) AS with_alerts FROM (
SELECT 'target_fpr' AS ablation, l_discount AS f1, NULL::INT AS alerts FROM lineitem UNION ALL SELECT 'drift_threshold', NULL, user_id FROM events) GROUP BY 1""")
def union_sparse_records(spark, folder):
    a = views.table(spark, folder, "lineitem").select(F.lit("target_fpr").alias("ablation"), F.col("l_discount").alias("f1"))
    b = views.table(spark, folder, "events").select(F.lit("drift_threshold").alias("ablation"), F.col("user_id").alias("alerts"))
    return audit.union_records([a, b]).groupBy("ablation").agg(
        F.count("*").alias("row_count"), F.count("f1").alias("with_f1"), F.count("alerts").alias("with_alerts"))


_KINDS = ["temporal", "shift", "ablation", "probe"]


@query("run_kinds", "WITH r AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_' || " + _case(_KINDS, "l_partkey") + """ || '_' || l_linestatus AS run FROM lineitem)
SELECT run, CASE WHEN run LIKE '%_probe_%' THEN 'unknown' ELSE split_part(run, '_', 2) END AS kind, CAST(count(*) AS BIGINT) AS row_count FROM r GROUP BY run""")
def run_kinds(spark, folder):
    """Runs of three kinds, and of one that is none of them."""
    items = views.table(spark, folder, "lineitem")
    runs = items.select(F.concat_ws("_", F.year("l_shipdate").cast("string"), _pick(_KINDS, "l_partkey"), "l_linestatus").alias("run"))
    rows = runs.groupBy("run").agg(F.count("*").alias("row_count"))
    return rows.select("run", run_source.kind_of("run").alias("kind"), "row_count")


@query("period_bounds", """SELECT user_id, CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts FROM events GROUP BY user_id""")
def period_bounds(spark, folder):
    """Bounds stored as a list for odd users and as an object for even ones, read back the same way."""
    b = views.table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").cast("string").alias("a"), F.max("ts").cast("string").alias("b"))
    doc = F.when(F.pmod("user_id", F.lit(2)) == 1, F.to_json(F.array("a", "b"))).otherwise(
        F.to_json(F.struct(F.col("a").alias("start"), F.col("b").alias("end"))))
    stored = b.select("user_id", doc.alias("doc"))
    return stored.select("user_id", run_source.period_bound(F.col("doc")).alias("start_ts"),
                         run_source.period_bound(F.col("doc"), True).alias("end_ts"))


@query("model_table", f"WITH {ROWS} SELECT run, model, round(bt_f1, 9) AS bt_f1, round(fw_f1, 9) AS fw_f1, round(bt_f1 - fw_f1, 9) AS d_f1 FROM mt")
def model_table(spark, folder):
    return _rounded(audit.model_table(run_metrics(spark, folder)).select("run", "model", "bt_f1", "fw_f1", "d_f1"),
                    "bt_f1", "fw_f1", "d_f1")


_BEST = "CAST(count(*) AS BIGINT) AS models, CAST(count(*) FILTER (bt_f1 - fw_f1 > 0) AS BIGINT) AS degraded, arg_max(model, (coalesce(bt_f1 - fw_f1, 0), model)) AS largest_loss_model, round(max(coalesce(bt_f1 - fw_f1, 0)), 9) AS largest_loss, arg_max(model, (coalesce(fw_f1, 0), model)) AS best_model, round(max(coalesce(fw_f1, 0)), 9) AS best_forward_f1"


@query("model_summary", f"WITH {ROWS} SELECT run, {_BEST} FROM mt GROUP BY run")
def model_summary(spark, folder):
    return _rounded(audit.model_summary(audit.model_table(run_metrics(spark, folder))), "largest_loss", "best_forward_f1")


@query("model_calibration", f"""WITH {ROWS}, b AS (SELECT run, model, least(floor(y_score * 10), 9) AS bin, count(*) AS n, avg(y_score) AS mp, avg(y_true) AS ob, sum((y_score - y_true) * (y_score - y_true)) AS se
FROM rr WHERE period = 'forward' AND model <> 'majority' GROUP BY 1, 2, 3), c AS (SELECT run, model, sum(se) / sum(n) AS brier, sum(n * abs(mp - ob)) / sum(n) AS ece FROM b GROUP BY 1, 2)
SELECT mt.run, mt.model, round(fw_f1, 9) AS fw_f1, round(brier, 9) AS brier, round(ece, 9) AS ece FROM mt LEFT JOIN c ON c.run = mt.run AND c.model = mt.model""")
def model_calibration(spark, folder):
    """Calibration is recorded for some models only and joined from the left."""
    rows = run_rows(spark, folder).where("period = 'forward' AND model <> 'majority'")
    table = audit.model_table(run_metrics(spark, folder)).select("run", "model", "fw_f1")
    return _rounded(audit.with_calibration(table, metrics.calibration(rows, ["run", "model"])), "fw_f1", "brier", "ece")


@query("run_index", f"""WITH {ROWS}, n AS (SELECT run, count(DISTINCT strategy) AS strategies FROM rs GROUP BY run), f AS (SELECT run, max(ts) AS last FROM rr GROUP BY run)
SELECT mt.run, CASE WHEN mt.run LIKE '1997%' THEN 'superseded' WHEN any_value(last) >= make_timestamp(CAST(left(mt.run, 4) AS BIGINT), 12, 1, 0, 0, 0) THEN 'complete' ELSE 'incomplete' END AS status,
string_agg(model, ';' ORDER BY model) AS models, CAST(any_value(strategies) AS BIGINT) AS strategies, round(max(fw_f1), 9) AS best_forward_f1, round(max(bt_f1 - fw_f1), 9) AS worst_f1_degradation
FROM mt LEFT JOIN n ON n.run = mt.run LEFT JOIN f ON f.run = mt.run GROUP BY mt.run""")
def run_index(spark, folder):
    rows = run_rows(spark, folder)
    meta = rows.groupBy("run").agg((F.max("ts") >= F.make_timestamp_ntz(
        F.max(F.year("ts")), F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("finished"))
    old = meta.where(F.col("run").startswith("1997"))
    table = audit.model_table(run_metrics(spark, folder))
    out = audit.run_index(meta, table, run_strategies(spark, folder), old)
    return _rounded(out.drop("finished"), "best_forward_f1", "worst_f1_degradation")


@query("missing_strategies", f"""WITH {ROWS}, g AS (SELECT DISTINCT run, model FROM rs), e AS (SELECT unnest({STRATEGIES + ['ensemble']!r}) AS strategy)
SELECT run, model, strategy FROM g CROSS JOIN e EXCEPT SELECT run, model, strategy FROM rs""")
def missing_strategies(spark, folder):
    """Expected strategies that a model lacks."""
    return audit.missing_values(run_strategies(spark, folder), ["run", "model"], "strategy", STRATEGIES + ["ensemble"])


@query("requested_models", f"WITH {ROWS} SELECT DISTINCT model, CASE model WHEN 'majority' THEN 0 WHEN 'logistic_regression' THEN 1 WHEN 'random_forest' THEN 2 ELSE 3 END AS position FROM rr")
def requested_models(spark, folder):
    return audit.requested_models(run_rows(spark, folder).select("model"))


@query("unknown_models", f"SELECT DISTINCT p_brand AS model FROM part UNION SELECT p_type FROM part WHERE p_type NOT IN ({', '.join(repr(m) for m in audit.REGISTRY)})")
def unknown_models(spark, folder):
    """Requests that no registry entry meets, among requests that are met."""
    parts = views.table(spark, folder, "part")
    known = spark.createDataFrame([(m,) for m in MODELS], "model string")
    return audit.unknown_models(known.union(parts.select("p_brand")).union(parts.select("p_type")))


_GAIN_COLUMNS = ["f1", "recall", "precision", "false_positive_rate"]


@query("strategy_recovery", f"WITH {ROWS}, b AS (SELECT * FROM rm WHERE period = 'backtest'), z AS (SELECT * FROM rs WHERE strategy = 'none') SELECT rs.run, rs.model, rs.strategy, " + ", ".join(
    f"round(rs.{c} - z.{c}, 9) AS {c}_gain, round(CASE WHEN b.{c} - z.{c} <> 0 THEN 100 * (rs.{c} - z.{c}) / (b.{c} - z.{c}) END, 5) + 0.0::DOUBLE AS {c}_recovery_pct" for c in _GAIN_COLUMNS) +
    " FROM rs LEFT JOIN z ON z.run = rs.run AND z.model = rs.model LEFT JOIN b ON b.run = rs.run AND b.model = rs.model")
def strategy_recovery(spark, folder):
    back = run_metrics(spark, folder).where("period = 'backtest'")
    out = audit.strategy_gains(run_strategies(spark, folder).select("run", "model", "strategy", *_GAIN_COLUMNS), back)
    return out.select("run", "model", "strategy", *[F.round(f"{c}_gain", 9).alias(f"{c}_gain") for c in _GAIN_COLUMNS],
                      *[F.round(f"{c}_recovery_pct", 5).alias(f"{c}_recovery_pct") for c in _GAIN_COLUMNS])


@query("aliased_strategies", f"""WITH {ROWS} SELECT run, model, round(max(CASE WHEN strategy = 'recent_window_retrain' THEN f1 END), 9) AS recent_f1, round(max(CASE WHEN strategy = 'rolling_window_retrain' THEN f1 END), 9) AS rolling_f1,
coalesce(abs(max(CASE WHEN strategy = 'recent_window_retrain' THEN f1 END) - max(CASE WHEN strategy = 'rolling_window_retrain' THEN f1 END)) < 1e-9, FALSE) AS identical FROM rs GROUP BY 1, 2""")
def aliased_strategies(spark, folder):
    return _rounded(audit.aliased_strategies(run_strategies(spark, folder)), "recent_f1", "rolling_f1")


@query("reproduction_check", f"""WITH {ROWS}, f AS (SELECT * FROM rm WHERE period = 'forward'), z AS (SELECT * FROM rs WHERE strategy = 'none')
SELECT z.run, z.model, round(z.f1, 9) AS f1, round(f.f1, 9) AS forward_f1 FROM z JOIN f ON z.run = f.run AND z.model = f.model WHERE abs(z.f1 - f.f1) > 1e-9""")
def reproduction_check(spark, folder):
    out = audit.reproduction_errors(run_strategies(spark, folder), run_metrics(spark, folder))
    return _rounded(out.select("run", "model", "f1", "forward_f1"), "f1", "forward_f1")


@query("gain_directions", f"""WITH {ROWS}, z AS (SELECT * FROM rs WHERE strategy = 'none') SELECT right(rs.run, 1) AS dataset, CAST(count(*) FILTER (rs.f1 - z.f1 > 0) AS BIGINT) AS helped,
CAST(count(*) FILTER (rs.f1 - z.f1 < 0) AS BIGINT) AS hurt, round(avg(rs.f1 - z.f1), 9) AS mean_gain FROM rs LEFT JOIN z ON z.run = rs.run AND z.model = rs.model
WHERE rs.strategy = 'rolling_window_retrain' AND rs.model <> 'majority' GROUP BY 1""")
def gain_directions(spark, folder):
    gains = audit.strategy_gains(run_strategies(spark, folder).select("run", "model", "strategy", *_GAIN_COLUMNS))
    return audit.gain_directions(gains.withColumn("dataset", F.right("run", F.lit(1))))


@query("period_problems", f"""WITH {ROWS}, s AS (SELECT run, period, min(ts) AS a, max(ts) + CASE WHEN period = 'backtest' AND run LIKE '%F' THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END AS b,
count(*) AS n FROM rr GROUP BY run, period), t AS (SELECT *, lag(b) OVER (PARTITION BY run ORDER BY period) AS pb FROM s)
SELECT run, period, 'overlaps the previous period' AS problem FROM t WHERE a < pb UNION ALL SELECT run, 'backtest', 'period rows do not add up' FROM s WHERE run LIKE '1999%' GROUP BY run""")
def period_problems(spark, folder):
    """Some runs get an overlapping backtest, others a wrong total; the audit has to name them."""
    longer = F.when((F.col("period") == "backtest") & F.col("run").endswith("F"), F.expr("INTERVAL 5 DAYS")).otherwise(
        F.expr("INTERVAL 0 DAYS"))
    rows = run_rows(spark, folder).groupBy("run", "period").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("row_count"))
    totals = rows.groupBy("run").agg(F.sum("row_count").alias("rows_total"))
    stored = rows.withColumn("end_ts", F.col("end_ts") + longer).join(totals, "run").withColumn(
        "rows_total", F.col("rows_total") + F.when(F.col("run").startswith("1999"), 1).otherwise(0))
    problems = audit.period_problems(stored.withColumn("period", F.when(F.col("period") == "backtest", "train").otherwise("validation")))
    return problems.withColumn("period", F.when(F.col("period") == "train", "backtest").otherwise("forward"))


@query("latest_runs", f"WITH {ROWS}, r AS (SELECT run, right(run, 1) AS dataset, run LIKE '2001%' AS is_synthetic, count(*) AS n FROM rr GROUP BY run) SELECT dataset, arg_max(run, (CASE WHEN is_synthetic THEN 0 ELSE 1 END, run)) AS run FROM r GROUP BY dataset")
def latest_runs(spark, folder):
    runs = run_rows(spark, folder).groupBy("run").agg(F.count("*").alias("n")).select(
        "run", F.right("run", F.lit(1)).alias("dataset"), run_source.kind_of("run").alias("kind"),
        F.col("run").startswith("2001").alias("is_synthetic"), (F.col("n") > 0).alias("finished"))
    return audit.latest_runs(runs).select("dataset", "run")


@query("best_strategy", f"WITH {ROWS} SELECT run, model, arg_max(strategy, (f1, strategy)) AS strategy, round(max(f1), 9) AS f1 FROM rs GROUP BY 1, 2")
def best_strategy(spark, folder):
    return _rounded(audit.best_rows(run_strategies(spark, folder), ["run", "model"], "f1", ["strategy"]), "f1")


@query("nan_scan", """WITH t AS (SELECT event_type, CASE WHEN value < 1 THEN ' NaN' WHEN value > 200 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS value, CASE WHEN user_id = 7 THEN '-inf' ELSE 'none' END AS note FROM events)
SELECT event_type, 'value' AS column_name, CAST(count(*) AS BIGINT) AS bad FROM t WHERE lower(trim(value)) IN ('nan', 'infinity') GROUP BY 1 UNION ALL SELECT event_type, 'note', CAST(count(*) AS BIGINT) FROM t WHERE note = '-inf' GROUP BY 1""")
def nan_scan(spark, folder):
    """NaN and infinity spellings per column of an all-text table; 'none' is a legal label."""
    value = F.when(F.col("value") < 1, " NaN").when(F.col("value") > 200, "Infinity").otherwise(F.col("value").cast("string"))
    table = views.table(spark, folder, "events").select(
        "event_type", value.alias("value"), F.when(F.col("user_id") == 7, "-inf").otherwise("none").alias("note"))
    return audit.bad_cells(table, ["event_type"])


@query("nested_nan_scan", """SELECT event_id, 'doc.scores[1].v' AS path FROM events WHERE value < 1 UNION ALL SELECT event_id, 'doc.m.ratio' FROM events WHERE user_id = 7""")
def nested_nan_scan(spark, folder):
    """NaN and infinite doubles anywhere in nested result documents."""
    bad = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    docs = views.table(spark, folder, "events").select("event_id", F.struct(
        F.array(F.struct(F.lit(1.0).alias("v")), F.struct(bad.alias("v"))).alias("scores"),
        F.create_map(F.lit("ratio"), F.when(F.col("user_id") == 7, F.lit(float("inf"))).otherwise(F.lit(0.5))).alias("m"),
        F.lit("x").alias("name")).alias("doc"))
    return audit.bad_numbers(docs, ["event_id"]).select("event_id", "path")


_SHIFT = "sr AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_shift_' || l_linestatus AS run, " + _case(
    ["packet_size", "duration", "packet_rate", "byte_rate", "iat", "protocol_mixture", "class_prevalence"], "l_partkey") + """ AS shift,
avg(l_discount) - avg(l_tax) AS d, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"""


def shift_records(spark, folder):
    kinds = ["packet_size", "duration", "packet_rate", "byte_rate", "iat", "protocol_mixture", "class_prevalence"]
    rows = views.table(spark, folder, "lineitem").groupBy(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("_shift_"), "l_linestatus").alias("run"),
        _pick(kinds, "l_partkey").alias("shift")).agg(
        (F.avg("l_discount") - F.avg("l_tax")).alias("f1_degradation"), F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return rows.select("run", "shift", "f1_degradation", F.lit("m").alias("model"), F.lit(1.5).alias("magnitude"),
                       (F.pmod("n", F.lit(3)) > 0).alias("realized_verified"), F.pmod("n", F.lit(5)).alias("drift_alerts"),
                       F.when(F.pmod("n", F.lit(4)) > 0, F.col("q")).alias("realized_max_abs_cohens_d"),
                       F.lit("ok").alias("status"), F.lit(0.0).alias("adapt_recovery"))


@query("shift_families", f"WITH {_SHIFT} SELECT shift, CAST(count(*) AS BIGINT) AS settings, CAST(count(*) FILTER (n % 3 > 0) AS BIGINT) AS verified, CAST(sum(n % 5) AS BIGINT) AS alerts, round(avg(d), 9) AS mean_degradation, round(max(d), 9) AS max_degradation, round(min(d), 9) AS min_degradation FROM sr GROUP BY shift")
def shift_families(spark, folder):
    return audit.shift_families(shift_records(spark, folder))


@query("shift_totals", f"""WITH {_SHIFT} SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (n % 5 = 0) AS BIGINT) AS skipped,
CAST(count(*) FILTER (d > 0) AS BIGINT) AS degraded, CAST(count(*) FILTER (n % 5 > 2) AS BIGINT) AS recovered FROM sr""")
def shift_totals(spark, folder):
    """Totals of records of which some were skipped and some recovered."""
    alerts = F.col("drift_alerts")
    return audit.shift_totals(shift_records(spark, folder).withColumns({
        "status": F.when(alerts == 0, "skipped").otherwise("ok"), "adapt_recovery": (alerts - 2).cast("double")}))


@query("shift_run_problems", f"""WITH {_SHIFT} SELECT run, 'shift family did not run: telemetry_reduction' AS problem FROM sr GROUP BY run
UNION ALL SELECT run, 'm/' || shift || '/1.5: effect is not recorded' FROM sr WHERE n % 4 = 0 UNION ALL SELECT run, 'm/' || shift || '/1.5: nothing measurable moved' FROM sr WHERE n % 3 = 0""")
def shift_run_problems(spark, folder):
    return audit.shift_problems(shift_records(spark, folder))


_ABL = "ar AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_ablation_' || l_linestatus AS run, " + _case(
    audit.REQUIRED_ABLATIONS[:5], "l_partkey") + " AS ablation, l_discount AS f1, l_suppkey % 50 = 0 AS failed FROM lineitem)"


def ablation_records(spark, folder):
    items = views.table(spark, folder, "lineitem")
    failed = F.pmod("l_suppkey", F.lit(50)) == 0
    return items.select(F.concat(F.year("l_shipdate").cast("string"), F.lit("_ablation_"), "l_linestatus").alias("run"),
                        _pick(audit.REQUIRED_ABLATIONS[:5], "l_partkey").alias("ablation"), F.col("l_discount").alias("f1"),
                        F.when(failed, "failed").alias("status"), F.when(failed, "failed: no rows").alias("note"))


@query("ablation_run_problems", f"""WITH {_ABL} SELECT run, 'ablation family did not run: target_fpr' AS problem FROM ar GROUP BY run
UNION ALL SELECT run, CAST(count(*) AS VARCHAR) || ' ablation rows failed' FROM ar WHERE failed GROUP BY run""")
def ablation_run_problems(spark, folder):
    return audit.ablation_problems(ablation_records(spark, folder))


@query("ablation_totals", f"WITH {_ABL} SELECT run, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (failed) AS BIGINT) AS failed FROM ar GROUP BY run")
def ablation_totals(spark, folder):
    return audit.ablation_totals(ablation_records(spark, folder))


@query("best_ablation", f"WITH {_ABL} SELECT run, ablation, max(f1) AS f1 FROM ar GROUP BY 1, 2")
def best_ablation(spark, folder):
    return audit.best_rows(ablation_records(spark, folder), ["run", "ablation"], "f1", ["status"]).select("run", "ablation", "f1")


@query("temporal_run_problems", f"""WITH {ROWS}, m AS (SELECT DISTINCT run FROM rr), e AS (SELECT unnest({MODELS!r}) AS model)
SELECT run, 'metadata.git_commit is missing or empty' AS problem FROM m WHERE run LIKE '%F' UNION ALL SELECT run, 'package version of pandas is missing' FROM m WHERE run LIKE '1996%'
UNION ALL SELECT run, 'temporal_split.forward_period is missing' FROM m WHERE run LIKE '1998%' UNION ALL SELECT run, 'the drift stage measured nothing' FROM m WHERE run LIKE '2000%'
UNION ALL SELECT run, model || '.' || period || '.pr_auc is missing' FROM rm WHERE model = 'random_forest'
UNION ALL SELECT run, model || ': roc_auc is not a finite number' FROM rm WHERE run LIKE '1995%' AND model = 'majority'""")
def temporal_run_problems(spark, folder):
    """Planted gaps in run documents; the completeness audit has to list exactly those."""
    runs = run_rows(spark, folder).select("run").distinct()
    packages = {p: F.lit("1.0") for p in audit.REQUIRED_PACKAGES}
    packages["pandas"] = F.when(F.col("run").startswith("1996"), "not installed").otherwise("1.0")
    split_map = {f"{p}_period": F.lit("[]") for p in ("train", "validation", "backtest")}
    split_map["forward_period"] = F.when(~F.col("run").startswith("1998"), "[]")
    meta = runs.select(
        "run", F.when(F.col("run").endswith("O"), "abc").alias("git_commit"), F.lit(1).alias("random_seed"),
        F.lit("h").alias("feature_schema_hash"), F.lit("d").alias("dataset"),
        F.create_map(*[x for k, v in packages.items() for x in (F.lit(k), v)]).alias("package_versions"),
        F.create_map(*[x for k, v in split_map.items() for x in (F.lit(k), v)]).alias("temporal_split"),
        F.lit(None).cast("map<string,string>").alias("superseded"))
    broken = F.when(F.col("run").startswith("1995") & (F.col("model") == "majority"), F.lit(float("nan"))).otherwise(0.5)
    table = run_metrics(spark, folder).withColumns({
        "roc_auc": broken, "pr_auc": F.when(F.col("model") != "random_forest", 0.5)})
    drift_rows = runs.select("run", F.when(F.col("run").startswith("2000"), 0).otherwise(5).alias("n"))
    return audit.temporal_problems(meta, table, run_strategies(spark, folder), drift_rows, strict=True)


@query("identity_problems", """WITH r AS (SELECT DISTINCT user_id FROM events) SELECT 'run' || user_id AS run, 'recorded id differs from the folder' AS problem FROM r WHERE user_id % 10 = 1
UNION ALL SELECT 'run' || user_id, 'duplicate experiment id' FROM r WHERE user_id % 10 = 1 OR (user_id % 10 = 2 AND user_id - 1 IN (SELECT user_id FROM r))
UNION ALL SELECT 'run' || user_id, 'no commit recorded' FROM r WHERE user_id % 4 = 0""")
def identity_problems(spark, folder):
    users = views.table(spark, folder, "events").select("user_id").distinct()
    shared = F.when(F.pmod("user_id", F.lit(10)) == 1, F.col("user_id") + 1).otherwise(F.col("user_id"))
    meta = users.select(F.concat(F.lit("run"), "user_id").alias("run"), F.concat(F.lit("run"), shared).alias("experiment_id"),
                        F.lit("complete").alias("status"),
                        F.when(F.pmod("user_id", F.lit(4)) == 0, "unknown").otherwise("abc").alias("git_commit"))
    return audit.identity_problems(meta)


@query("operating_points", f"WITH {ROWS} SELECT run, model, period, round(recall, 9) AS recall, round(false_positive_rate, 9) AS false_positive_rate, round(f1, 9) AS f1 FROM rm")
def operating_points(spark, folder):
    return _rounded(audit.operating_points(run_metrics(spark, folder)), "recall", "false_positive_rate", "f1")


_SETS = ["FULL_METADATA", "RESTRICTED_METADATA"]
_STATIC = f"""x AS (SELECT CASE l_linestatus WHEN 'F' THEN 'FULL_METADATA' ELSE 'RESTRICTED_METADATA' END AS feature_set, {_case(MODELS[:3], 'l_linenumber')} AS model,
CAST(l_returnflag = 'R' AS INTEGER) AS y_true, CAST(l_discount * 10::DOUBLE >= 0.5 AS INTEGER) AS y_pred FROM lineitem), sm AS (SELECT * FROM {rates_sql('x', 'feature_set, model')})"""


def static_rows(spark, folder):
    items = views.table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", _SETS[0]).otherwise(_SETS[1]).alias("feature_set"),
        _pick(MODELS[:3], "l_linenumber").alias("model"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10.0 >= 0.5).cast("int").alias("y_pred"))
    return metrics.static_metrics(items, ["feature_set", "model"])


@query("comparison_table", f"WITH {_STATIC} SELECT feature_set, model, CASE feature_set WHEN 'FULL_METADATA' THEN 1 ELSE 2 END AS set_position, CASE model WHEN 'majority' THEN 1 WHEN 'logistic_regression' THEN 2 ELSE 3 END AS model_position, round(f1, 9) AS f1_score, tp + fp + tn + fn AS n_samples FROM sm")
def comparison_table(spark, folder):
    table = audit.comparison_table(static_rows(spark, folder), _SETS, MODELS[:3])
    return table.select("feature_set", "model", "set_position", "model_position", F.round("f1_score", 9).alias("f1_score"), "n_samples")


@query("set_differences", f"WITH {_STATIC} SELECT a.model, round(a.f1 - b.f1, 9) AS f1_score_difference, round(a.false_positive_rate - b.false_positive_rate, 9) AS false_positive_rate_difference FROM sm a JOIN sm b ON a.model = b.model WHERE a.feature_set = 'FULL_METADATA' AND b.feature_set = 'RESTRICTED_METADATA'")
def set_differences(spark, folder):
    return _rounded(audit.set_differences(static_rows(spark, folder), *_SETS), "f1_score_difference", "false_positive_rate_difference")


_USERS = """u AS (SELECT user_id, 'user' || user_id AS run, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id),
done AS (SELECT * FROM u WHERE user_id % 11 <> 0), live AS (SELECT * FROM done WHERE user_id % 7 <> 0)"""


@query("run_document_problems", f"""WITH {_USERS}
SELECT run, 'unfinished' AS "check", '' AS item, NULL AS value FROM u WHERE user_id % 11 = 0 UNION ALL SELECT run, 'superseded', '', 'by ' || run FROM done WHERE user_id % 7 = 0
UNION ALL SELECT run, 'metadata', 'dataset', NULL FROM live WHERE user_id % 9 = 1 UNION ALL SELECT run, 'package_version', 'pandas', NULL FROM live WHERE user_id % 9 = 2
UNION ALL SELECT run, 'temporal_split', 'train_count', NULL FROM live WHERE clicks = 0 UNION ALL SELECT run, 'temporal_split', 'forward_period', NULL FROM live WHERE user_id % 9 = 3
UNION ALL SELECT run, 'drift_summary', '', NULL FROM live WHERE n < 20 UNION ALL SELECT run, 'drift_table', '', NULL FROM live WHERE n < 5
UNION ALL SELECT run, 'period', 'random_forest.backtest', NULL FROM live WHERE user_id % 9 = 4 UNION ALL SELECT run, 'metric', 'majority.backtest.roc_auc', NULL FROM live WHERE user_id % 5 = 0
UNION ALL SELECT run, 'number', 'random_forest.result.forward.curve[' || (n - 1) || ']', 'NaN' FROM live WHERE user_id % 13 = 0
UNION ALL SELECT run, 'calibration', 'random_forest', NULL FROM live WHERE user_id % 3 = 0 UNION ALL SELECT run, 'calibration_metric', 'majority.forward.ece', NULL FROM live WHERE user_id % 4 = 0""")
def run_document_problems(spark, folder):
    """Documents of one run per user with planted gaps; the audit has to list exactly those."""
    events = views.table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.array_sort(F.collect_list(F.round("value", 3).cast("string"))).alias("values"))
    runs = events.withColumn("run", F.concat(F.lit("user"), "user_id"))
    of = lambda k, r: F.pmod("user_id", F.lit(k)) == r

    def part(text, unless=None):
        text = F.lit(text) if isinstance(text, str) else text
        return text if unless is None else F.when(unless, "").otherwise(text)

    packages = F.concat(part('"package_versions":{"python":"3","numpy":"2","scikit-learn":"1","pandas":'), F.when(of(9, 2), '"not installed"').otherwise('"2"'), part("},"))
    bounds = F.concat(part('"temporal_split":{"train_period":["a","b"],"validation_period":["b","c"],"backtest_period":["c","d"],'),
                      part('"forward_period":["d","e"],', of(9, 3)), part('"train_count":'), F.col("clicks").cast("string"), part("}"))
    metadata = F.concat(part('{"git_commit":"abc","random_seed":0,"feature_schema_hash":"h",'), part('"dataset":"events",', of(9, 1)),
                        F.when(of(7, 0), F.concat(F.lit('"superseded":{"reason":"by '), "run", F.lit('"},'))).otherwise(""), packages, bounds, part("}"))
    measures = '"precision":0.5,"recall":0.5,"f1":0.5,"pr_auc":null,"false_positive_rate":0.1,"balanced_accuracy":0.5'
    ranking = ',"roc_auc":null'
    curve = F.concat(part(',"curve":['), F.array_join(F.when(of(13, 0), F.concat(F.slice("values", 1, F.greatest(F.col("n").cast("int") - 1, F.lit(0))), F.array(F.lit("NaN")))).otherwise(F.col("values")), ","), part("]"))
    majority = F.concat(part(f'{{"result":{{"model":"majority","backtest":{{{measures}'), part(ranking, of(5, 0)), part(f'}},"forward":{{{measures}{ranking}}}}}}}'))
    forest = F.concat(part('{"result":{"model":"random_forest",'), part(f'"backtest":{{{measures}{ranking}}},', of(9, 4)), part(f'"forward":{{{measures}{ranking}'), curve, part("}}}"))
    summary = F.when(F.col("n") < 20, "{}").otherwise(F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}")))
    metrics = F.concat(part('{"models":['), majority, part(","), forest, part('],"drift_summary":'), summary, part("}"))
    docs = runs.select("run", documents.parsed(metadata).alias("metadata"), documents.parsed(F.when(~of(11, 0), metrics)).alias("metrics"), (F.col("n") >= 5).alias("drift_table"))
    calibration = F.concat(part('{"backtest":{"brier":0.1,"ece":0.1},"forward":{"brier":0.1,"ece":'), F.when(of(4, 0) & (F.col("model") == "majority"), "null").otherwise("0.1"), part("}}"))
    calibrations = runs.select("run", "user_id", F.explode(F.array(F.lit("majority"), F.lit("random_forest"))).alias("model")).where(
        ~(of(3, 0) & (F.col("model") == "random_forest"))).select("run", "model", documents.parsed(calibration).alias("document"))
    return documents.run_problems(docs, calibrations)
