"""Streaming monitors run to the end of the available input, and the sequential detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import from_micros, micros
from tidewatch.operators import metrics
from tidewatch.operators import psi as ps
from tidewatch.operators import twosample
from tidewatch.operators.drift import profile_reference
from tidewatch.operators.flows import with_derived
from tidewatch.operators.running import cut_slices
from tidewatch.operators.sequential import sequential_cusum
from tidewatch.operators.split import find_cuts
from tidewatch.operators.windows import HOUR
from tidewatch.plans import experiment
from tidewatch.queries.base import FE, cuts_sql, query
from tidewatch.sources import views
from tidewatch.streaming import monitor, serving
from tidewatch.streaming.sequential import cusum_stream

FEATURES = ["flow_duration", "total_bytes"]
DAY = 24 * HOUR


def flow_stream(spark, folder):
    raw = monitor.file_stream(spark, folder, "events")
    packets = F.get_json_object("props", "$.k").try_cast("bigint") + 1
    return with_derived(raw.select(
        "event_id", F.col("ts").alias("timestamp"), (F.col("event_type") == "error").cast("int").alias("y_true"),
        F.col("value").alias("flow_duration"), packets.cast("double").alias("total_packets"),
        (F.col("value") * packets).alias("total_bytes"), (F.col("value") / (F.col("value") + 50.0)).alias("y_score")))


@query("stream_window_metrics", """WITH e AS (SELECT *, CAST(event_type = 'error' AS INTEGER) AS y, value / (value + 50.0::DOUBLE) AS s FROM events),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(y) AS BIGINT) AS attacks,
round(count(*) FILTER (y = 1 AND s >= 0.6) / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE), 9) AS recall, round(count(*) FILTER (y = 0 AND s >= 0.6) / CAST(nullif(count(*) FILTER (y = 0), 0) AS DOUBLE), 9) AS fpr,
round(avg(s), 9) AS mean_score, CAST(count(*) FILTER (y = 0 AND s >= 0.6) AS BIGINT) AS false_positives, CAST(count(*) FILTER (y = 1 AND s < 0.6) AS BIGINT) AS false_negatives FROM e GROUP BY 1)
SELECT * FROM w WHERE row_count >= 20 AND bucket + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_window_metrics(spark, folder):
    """Quality per closed six-hour window of the scored stream."""
    out = monitor.scratch(spark, "quality")
    monitor.run_to_end(monitor.window_quality(flow_stream(spark, folder), 0.6, "6 hours", 20), out, out + "-progress")
    return spark.read.parquet(out).withColumns({
        "bucket": F.col("bucket").cast("timestamp_ntz"), **{c: F.round(c, 9) for c in ("recall", "fpr", "mean_score")}})


def _reference(spark, folder):
    """The training period: the first half of the rows."""
    rows = views.events_common(spark, folder)
    return find_cuts(rows).period(rows, "train")


_PSI = f"""{FE}, {cuts_sql("fe")}, r AS (SELECT fe.* FROM fe, cuts WHERE timestamp <= c1),
rm AS (UNPIVOT (SELECT flow_duration, total_bytes FROM r) ON flow_duration, total_bytes INTO NAME feature VALUE value), rt AS (SELECT feature, count(*) AS nr FROM rm GROUP BY 1),
ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i FROM rm), pos AS (SELECT feature, p, (nr - 1) * p AS h FROM rt, (SELECT CAST(unnest(range(1, 10)) AS DOUBLE) / 10 AS p)),
qs AS (SELECT pos.feature, p, CASE WHEN h - floor(h) >= 0.5 THEN b.value - (b.value - a.value) * (1 - (h - floor(h))) ELSE a.value + (b.value - a.value) * (h - floor(h)) END AS q
  FROM pos JOIN ranked a ON a.feature = pos.feature AND a.i = floor(h) JOIN ranked b ON b.feature = pos.feature AND b.i = ceil(h)),
edges AS (SELECT feature, list(q) AS e FROM qs GROUP BY feature), bins AS (SELECT feature, unnest(range(10)) AS bin FROM edges),
rb AS (SELECT rm.feature, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS c FROM rm JOIN edges ON rm.feature = edges.feature GROUP BY 1, 2)"""


def _psi_sql(windows: str) -> str:
    return f"""WITH {_PSI}, {windows},
tm AS (UNPIVOT (SELECT window_start, flow_duration, total_bytes FROM wr) ON flow_duration, total_bytes INTO NAME feature VALUE value), tt AS (SELECT feature, window_start, count(*) AS nw FROM tm GROUP BY 1, 2),
tb AS (SELECT tm.feature, window_start, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS c FROM tm JOIN edges ON tm.feature = edges.feature GROUP BY 1, 2, 3),
ps AS (SELECT tt.feature, tt.window_start, nr, nw, greatest(coalesce(rb.c, 0) / CAST(nr AS DOUBLE), 1e-6) AS p, greatest(coalesce(tb.c, 0) / CAST(nw AS DOUBLE), 1e-6) AS q FROM tt JOIN rt ON tt.feature = rt.feature
  JOIN bins ON bins.feature = tt.feature LEFT JOIN rb ON rb.feature = tt.feature AND rb.bin = bins.bin LEFT JOIN tb ON tb.feature = tt.feature AND tb.window_start = tt.window_start AND tb.bin = bins.bin)
SELECT window_start, feature, round(sum((q - p) * ln(q / p)), 6) AS psi, CAST(any_value(nr) AS BIGINT) AS n_reference, CAST(any_value(nw) AS BIGINT) AS n_window FROM ps GROUP BY 1, 2"""


def _monitor(spark, folder, window, slide=None):
    reference = _reference(spark, folder)
    counts = twosample.reference_counts(reference, FEATURES)
    source = counts.select("feature", "value", F.col("n").alias("nr"), F.lit(twosample.REFERENCE).alias("k"))
    sliced, slices = cut_slices(source, ["feature", "value"], reference.count() * len(FEATURES))
    facts = profile_reference(reference, FEATURES, twosample.ranked_reference(sliced, slices), 10)
    table = spark.createDataFrame(list(facts.edges.items()), "feature string, edges array<double>")
    reference_bins = ps.bin_table(counts, table, ["feature"], 10, weight="n")
    out = monitor.scratch(spark, "psi")
    monitor.psi_stream(flow_stream(spark, folder), reference_bins, facts.edges, out, out + "-progress", window, slide,
                       delay="1 hour").awaitTermination()
    return spark.read.parquet(out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "feature", F.round("psi", 6).alias("psi"),
        "n_reference", "n_window")


@query("stream_psi", _psi_sql("""wr AS (SELECT *, time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start FROM fe
WHERE time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM fe) - INTERVAL 1 HOUR)"""))
def stream_psi(spark, folder):
    """Daily PSI of the stream against the training period; only closed windows appear."""
    return _monitor(spark, folder, "1 day")


@query("stream_psi_sliding", _psi_sql("""starts AS (SELECT DISTINCT time_bucket(INTERVAL 12 HOUR, timestamp, TIMESTAMP '1970-01-01') - to_hours(o) AS window_start FROM fe, (SELECT unnest([0, 12]) AS o)),
wr AS (SELECT fe.*, window_start FROM fe JOIN starts ON timestamp >= window_start AND timestamp < window_start + INTERVAL 1 DAY
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM fe) - INTERVAL 1 HOUR)"""))
def stream_psi_sliding(spark, folder):
    """The same with one-day windows every twelve hours."""
    return _monitor(spark, folder, "1 day", "12 hours")


_SEQ = """WITH RECURSIVE e AS (SELECT ts, event_id, value AS x, row_number() OVER (ORDER BY ts, event_id) AS n_window FROM events),
b AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM e WHERE n_window <= 100), z AS MATERIALIZED (SELECT n_window, event_id, (x - mu) / sd AS z FROM e, b WHERE n_window > 100),
r AS (SELECT CAST(100 AS BIGINT) AS n_window, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg, 0.0::DOUBLE AS statistic, FALSE AS alert UNION ALL
SELECT n, CASE WHEN greatest(p, q) > 5 THEN 0 ELSE p END, CASE WHEN greatest(p, q) > 5 THEN 0 ELSE q END, greatest(p, q), greatest(p, q) > 5 FROM (
SELECT z.n_window AS n, greatest(0, pos + z - 0.5) AS p, greatest(0, neg - z - 0.5) AS q FROM r JOIN z ON z.n_window = r.n_window + 1))
SELECT e.event_id, e.n_window, round(coalesce(statistic, 0), 6) AS statistic, coalesce(alert, FALSE) AS alert FROM e LEFT JOIN r ON r.n_window = e.n_window AND e.n_window > 100"""


@query("sequential_cusum", _SEQ)
def sequential_cusum_query(spark, folder):
    """Every event through the self-starting detector that resets after each alarm."""
    rows = views.event_flows(spark, folder)
    out = sequential_cusum(rows, ["flow_duration"], ["event_id"])
    return out.select("event_id", "n_window", F.round("statistic", 6).alias("statistic"), "alert")


@query("sequential_cusum_stream")
def sequential_cusum_stream(spark, folder):
    """The stateful stream operator on ten-minute means."""
    out = monitor.scratch(spark, "cusum")
    flow = cusum_stream(flow_stream(spark, folder), FEATURES, delay="1 hour", block="10 minutes")
    monitor.run_to_end(flow, out, out + "-progress")
    return spark.read.parquet(out).select("feature", "n_window", "timestamp", F.round("statistic", 6).alias("statistic"), "alert")


FAR = 1e12


@query("stream_mean_shift", f"""WITH {FE}, {cuts_sql("fe")}, far AS (SELECT timestamp, flow_duration, total_bytes, flow_duration + CAST(1e12 AS DOUBLE) AS far_duration FROM fe),
long AS (UNPIVOT far ON flow_duration, total_bytes, far_duration INTO NAME feature VALUE value),
lows AS (SELECT feature, min(value) AS a FROM long, cuts WHERE timestamp <= c1 GROUP BY 1),
ref AS (SELECT feature, a, avg(value - a) AS mu, stddev_pop(value - a) AS sigma, count(*) AS n FROM long JOIN lows USING (feature), cuts WHERE timestamp <= c1 GROUP BY 1, 2),
w AS (SELECT time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, feature, avg(value - a) - any_value(mu) AS shift, stddev_pop(value - a) / any_value(sigma) AS spread, any_value(sigma) AS sigma,
any_value(n) AS n_reference, count(*) AS n_window FROM long JOIN ref USING (feature) GROUP BY 1, 2)
SELECT window_start, feature, round(shift, 6) AS mean_shift, round(abs(shift) / sigma, 6) AS effect_size, round(spread, 6) AS spread, abs(shift) / sigma > 0.1 AS alert,
CAST(n_reference AS BIGINT) AS n_reference, CAST(n_window AS BIGINT) AS n_window FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM fe) - INTERVAL 1 HOUR""")
def stream_mean_shift(spark, folder):
    """Daily shift of mean and spread of the stream against the training period, also of a column near 1e12."""
    far = lambda df: df.withColumn("far_duration", F.col("flow_duration") + F.lit(FAR))
    moments = monitor.reference_moments(far(_reference(spark, folder)), [*FEATURES, "far_duration"])
    out = monitor.scratch(spark, "shift")
    monitor.run_to_end(monitor.mean_shift(far(flow_stream(spark, folder)), moments, "1 day", threshold=0.1, delay="1 hour"),
                       out, out + "-progress")
    return spark.read.parquet(out).drop("window_end").withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"),
        **{c: F.round(c, 6) for c in ("mean_shift", "effect_size", "spread")}})


def _arriving(spark, source):
    """A folder of flow files as a stream, one file a batch."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _starts(rows, step_us):
    """Starts of fixed steps from the first timestamp to the last."""
    low, high = rows.agg(F.min(micros(F.col("timestamp"))), F.max(micros(F.col("timestamp")))).first()
    us = range(low, high + 1, step_us)
    made = rows.sparkSession.createDataFrame([(u,) for u in us], "us long").orderBy("us")
    return [r[0] for r in made.select(from_micros(F.col("us")).cast("string")).collect()]


@query("stream_model_metrics", f"""WITH {FE}, {cuts_sql("fe")}, later AS (SELECT fe.* FROM fe, cuts WHERE timestamp > c3)
SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS bucket, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(label) AS BIGINT) AS attacks, CAST(0 AS INTEGER) AS model_version,
TRUE AS as_batch FROM later GROUP BY 1 HAVING count(*) >= 10 AND time_bucket(INTERVAL 6 HOUR, any_value(timestamp), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= (SELECT max(timestamp) FROM later) - INTERVAL 10 MINUTE""")
def stream_model_metrics(spark, folder):
    """Quality per closed six-hour window of the forward period, scored in the stream by a stored model.

    The stream starts with version 0 of the registry and keeps it when version 1 is published between two of its runs.
    ``as_batch`` says whether all measures equal those of the same stored model and threshold over the same rows as a table.
    """
    bench = experiment.prepare(views.events_common(spark, folder))
    root = monitor.scratch(spark, "serving")
    registry, progress = serving.ModelRegistry(spark, f"{root}/registry"), f"{root}/progress"
    model = bench.fit("logistic_regression")
    registry.publish(0, model, metrics.threshold_for_budget(experiment.score_table(model, bench.period("validation")), bench.budget))
    forward = bench.period("forward")
    starts = _starts(forward, 3 * DAY)
    columns = ["bucket", "row_count", "attacks", "recall", "fpr", "mean_score", "false_positives", "false_negatives"]
    for run, start in enumerate(starts):
        nxt = starts[run + 1:run + 2]
        kind = forward.schema["timestamp"].dataType
        part = forward.where(F.col("timestamp") >= F.lit(start).cast(kind))
        monitor.feed(part.where(F.col("timestamp") < F.lit(nxt[0]).cast(kind)) if nxt else part, f"{root}/in", [start])
        version = registry.pinned(progress)
        scored = serving.score_stream(_arriving(spark, f"{root}/in"), version).withColumn("y_true", F.col("label"))
        quality = monitor.window_quality(scored, version.threshold, "6 hours", 10)
        monitor.run_to_end(quality.withColumn("model_version", F.lit(version.number)), f"{root}/out", progress)
        if run == 0:
            registry.publish(1, bench.fit("majority"), 0.5)
    stored = registry.load(0)
    table = metrics.predictions(experiment.score_table(stored.model, forward), stored.threshold, label="y_true", score="y_score")
    batch = metrics.window_metrics(table, 6 * HOUR, 10).select("bucket", *[F.col(c).alias(f"b_{c}") for c in columns[1:]])
    stream = spark.read.parquet(f"{root}/out").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    same = F.lit(True)
    for c in columns[1:]:
        same &= F.coalesce(F.abs(F.col(c) - F.col(f"b_{c}")) < 1e-9, F.col(c).isNull() & F.col(f"b_{c}").isNull())
    return stream.join(batch, "bucket", "left").select("bucket", "row_count", "attacks", "model_version", same.alias("as_batch"))


@query("stream_rolling_refit", f"""WITH {FE}, {cuts_sql("fe")}, f AS (SELECT timestamp, label, CAST(floor((epoch_us(timestamp) - epoch_us(min(timestamp) OVER ())) / (2 * 86400000000.0)) AS BIGINT) AS step FROM sp WHERE period = 'forward'),
b AS (SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS BIGINT) AS batch, step, count(*) AS n, sum(label) AS attacks, max(timestamp) AS latest FROM f GROUP BY step),
used AS (SELECT b.batch, count(*) AS n FROM b JOIN f ON f.step <= b.step AND f.timestamp >= b.latest - INTERVAL 3 DAY GROUP BY 1)
SELECT b.batch, CAST(b.n AS BIGINT) AS row_count, CAST(b.attacks AS BIGINT) AS attacks, CAST(b.batch AS INTEGER) AS model_version,
CAST((SELECT count(*) FROM sp WHERE period = 'train') + coalesce(u.n, 0) AS BIGINT) AS model_rows, TRUE AS as_unbroken FROM b LEFT JOIN used u ON u.batch = b.batch - 1""")
def stream_rolling_refit(spark, folder):
    """The forward period in steps of two days, each scored by a model refitted on training rows and the last three days.

    One stream runs without a break. Another one stops after two batches and is taken up by a new object, which finds models,
    history and progress in files. ``as_unbroken``: all scores of the batch are those of the unbroken stream.
    """
    bench = experiment.prepare(views.events_common(spark, folder))
    root = monitor.scratch(spark, "refit")
    forward = bench.period("forward")
    starts = _starts(forward, 2 * DAY)

    def run(name, source):
        step = serving.RollingRefit(lambda rows: bench.fit("logistic_regression", rows), bench.period("train"),
                                    serving.ModelRegistry(spark, f"{root}/{name}/registry"), f"{root}/{name}/history",
                                    f"{root}/{name}/scored", window_seconds=3 * 86_400, budget=bench.budget)
        serving.run_refit(_arriving(spark, f"{root}/{source}"), step, f"{root}/{name}/progress")
        return step.registry

    kind = forward.schema["timestamp"].dataType
    head = forward.where(F.col("timestamp") < F.lit(starts[2]).cast(kind)) if len(starts) > 2 else forward
    monitor.feed(head, f"{root}/in", starts[:2])
    run("broken", "in")
    if len(starts) > 2:
        monitor.feed(forward, f"{root}/in", starts[2:])
    registry = run("broken", "in")
    run("unbroken", "in")
    whole = spark.read.parquet(f"{root}/unbroken/scored").select("event_id", F.col("y_score").alias("other"))
    scored = spark.read.parquet(f"{root}/broken/scored").join(whole, "event_id", "left")
    batches = scored.groupBy(F.col("batch_id").cast("long").alias("batch"), "model_version").agg(
        F.count("*").alias("row_count"), F.sum("label").cast("long").alias("attacks"),
        F.bool_and(F.coalesce(F.abs(F.col("y_score") - F.col("other")) < 1e-6, F.lit(False))).alias("as_unbroken"))
    versions = registry.versions().select(F.col("version").alias("model_version"), F.col("rows").alias("model_rows"))
    return batches.join(versions, "model_version").select("batch", "row_count", "attacks", "model_version", "model_rows", "as_unbroken")
