"""Drift detectors over windows of the event flows, and the reports on the drift table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tidewatch.functions.columns import round_scaled
from tidewatch.functions.stats import kolmogorov_quantile
from tidewatch.operators import cusum as cu
from tidewatch.operators import drift, split, summaries, twosample, windows
from tidewatch.operators.flows import with_derived
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.queries.base import FE, FL, cuts_sql, query
from tidewatch.sources import views

DAY = 24 * windows.HOUR
FEATURES = ["flow_duration", "total_packets", "total_bytes", "packet_rate", "mean_packet_size", "bytes_log1p"]
SETTINGS = dict(window=DAY, min_samples=20, features=FEATURES, cusum_block=5, cusum_warmup=10,
                cusum_threshold=2.5, tiebreak=("event_id",))


def periods(spark, folder):
    df = views.events_common(spark, folder)
    cuts = split.find_cuts(views.event_flows(spark, folder))
    return cuts.period(df, "train"), cuts.period(df, "forward")


def events(spark, folder, **changes):
    reference, target = periods(spark, folder)
    return drift.drift_events(reference, target, drift.DriftSettings(**{**SETTINGS, **changes}))


@dataclass(frozen=True)
class DriftSql:
    """The SQL of one windowed drift analysis, in reusable pieces."""

    base: str
    two_sample: str
    quantiles: str
    psi: str
    cusum: str
    critical: str
    events: str

    @property
    def full(self) -> str:
        return f"WITH {self.base}, {self.two_sample}, {self.quantiles}, {self.psi}, {self.cusum}, {self.events} "


def drift_sql(cte: str, source: str, features: list[str], width: int, key: str) -> DriftSql:
    names = ", ".join(features)
    base = f"""{cte}, {cuts_sql(source)},
tw0 AS (SELECT *, CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM sp WHERE period = 'forward')) / {width}) AS BIGINT) AS k
  FROM sp WHERE period = 'forward'),
origin AS (SELECT min(timestamp) AS o FROM tw0),
tw AS (SELECT * FROM tw0 WHERE k IN (SELECT k FROM tw0 GROUP BY k HAVING count(*) >= 20)),
rm AS (UNPIVOT (SELECT {names} FROM sp WHERE period = 'train') ON {names} INTO NAME feature VALUE value),
tm AS (UNPIVOT (SELECT k, {names} FROM tw) ON {names} INTO NAME feature VALUE value),
rt AS (SELECT feature, count(*) AS nr, stddev_pop(value) AS sd, avg(value) AS mu FROM rm GROUP BY feature),
tt AS (SELECT feature, k, count(*) AS nw, avg(value) AS mw FROM tm GROUP BY feature, k)"""

    two_sample = """
pool AS (SELECT feature, k, value, sum(r) AS r, sum(w) AS w FROM (
    SELECT rm.feature, tt.k, value, 1 AS r, 0 AS w FROM rm JOIN tt ON rm.feature = tt.feature
    UNION ALL SELECT feature, k, value, 0, 1 FROM tm) GROUP BY ALL),
cdf AS (SELECT feature, k, value, lead(value) OVER w AS nv, sum(r) OVER w AS cr, sum(w) OVER w AS cw FROM pool
  WINDOW w AS (PARTITION BY feature, k ORDER BY value)),
two AS (SELECT cdf.feature, cdf.k, max(abs(CAST(cr AS DOUBLE) / nr - CAST(cw AS DOUBLE) / nw)) AS ks,
    sum(abs(CAST(cr AS DOUBLE) / nr - CAST(cw AS DOUBLE) / nw) * (nv - value)) AS w1, any_value(nr) AS nr, any_value(nw) AS nw
  FROM cdf JOIN rt ON cdf.feature = rt.feature JOIN tt ON cdf.feature = tt.feature AND cdf.k = tt.k GROUP BY 1, 2)"""

    quantiles = """
ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i,
    count(*) OVER (PARTITION BY feature) AS n FROM rm),
probs AS (SELECT CAST(unnest(range(11)) AS DOUBLE) / 10 AS p UNION ALL SELECT 0.25 UNION ALL SELECT 0.75),
pos AS (SELECT feature, p, floor((nr - 1) * p) AS lo, ceil((nr - 1) * p) AS hi, (nr - 1) * p - floor((nr - 1) * p) AS t FROM rt, probs),
ends AS (SELECT feature, p, t, lo, hi, CAST(unnest([lo, hi]) AS BIGINT) AS i FROM pos),
picked AS (SELECT feature, p, any_value(t) AS t, max(CASE WHEN i = lo THEN value END) AS a, max(CASE WHEN i = hi THEN value END) AS b
  FROM ends JOIN ranked USING (feature, i) GROUP BY feature, p),
qs AS (SELECT feature, p, CASE WHEN t >= 0.5 THEN b - (b - a) * (1 - t) ELSE a + (b - a) * t END AS q FROM picked),
spread AS (SELECT qs.feature, CASE WHEN max(CASE WHEN p = 0.75 THEN q END) - max(CASE WHEN p = 0.25 THEN q END) > 0
    THEN max(CASE WHEN p = 0.75 THEN q END) - max(CASE WHEN p = 0.25 THEN q END) WHEN any_value(sd) > 0 THEN any_value(sd) ELSE 1 END AS s
  FROM qs JOIN rt ON qs.feature = rt.feature GROUP BY qs.feature)"""

    psi = """
edges AS (SELECT feature, list_sort(list_distinct(list(q))) AS e FROM qs WHERE p NOT IN (0.25, 0.75) GROUP BY feature),
bins AS (SELECT feature, e[2:len(e) - 1] AS inner_edges, unnest(range(len(e) - 1)) AS bin FROM edges),
rb AS (SELECT rm.feature, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) AS bin, count(*) AS c FROM rm JOIN edges ON rm.feature = edges.feature GROUP BY 1, 2),
tb AS (SELECT tm.feature, k, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) AS bin, count(*) AS c FROM tm JOIN edges ON tm.feature = edges.feature GROUP BY 1, 2, 3),
ps AS (SELECT tt.feature, tt.k, greatest(coalesce(rb.c, 0) / CAST(nr AS DOUBLE), 1e-6) AS p, greatest(coalesce(tb.c, 0) / CAST(nw AS DOUBLE), 1e-6) AS q
  FROM tt JOIN rt ON tt.feature = rt.feature JOIN bins ON bins.feature = tt.feature
  LEFT JOIN rb ON rb.feature = tt.feature AND rb.bin = bins.bin LEFT JOIN tb ON tb.feature = tt.feature AND tb.k = tt.k AND tb.bin = bins.bin),
psi AS (SELECT feature, k, sum((q - p) * ln(q / p)) AS psi FROM ps GROUP BY 1, 2)"""

    cusum = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY timestamp, {key}) - 1 AS rn, count(*) OVER (PARTITION BY k) AS nw FROM tw),
blocks AS (SELECT k, CAST(floor(rn / 5) AS BIGINT) AS step, {', '.join(f'avg({f}) AS {f}' for f in features)} FROM numbered
  WHERE floor(rn / 5) < floor(nw / 5) GROUP BY 1, 2),
seq AS (UNPIVOT blocks ON {names} INTO NAME feature VALUE x),
steps AS (SELECT seq.k, seq.feature, step, (x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM seq JOIN rt ON rt.feature = seq.feature WHERE step >= 10),
sums AS (SELECT *, sum(z - 0.5) OVER w AS cu, sum(-z - 0.5) OVER w AS cd FROM steps WINDOW w AS (PARTITION BY k, feature ORDER BY step)),
lows AS (SELECT *, min(cu) OVER w AS lu, min(cd) OVER w AS ld FROM sums WINDOW w AS (PARTITION BY k, feature ORDER BY step)),
path AS (SELECT *, greatest(cu - least(0, lu), cd - least(0, ld), 0) AS cusum FROM lows),
peaks AS (SELECT k, feature, max(cusum) AS peak, min(CASE WHEN cusum > 2.5 THEN step END) AS first_alarm FROM path GROUP BY 1, 2)"""

    lam = repr(kolmogorov_quantile(0.01))
    n = "greatest(floor(nr * nw / CAST(nr + nw AS DOUBLE)), 1)"
    crit = f"(({lam} - 1 / (6 * sqrt({n})) + 1 / (4 * {n})) / (sqrt({n}) * (1 + 1 / (4 * {n}))))"
    bounds = f"o + to_microseconds(k * {width}) AS window_start, o + to_microseconds((k + 1) * {width}) AS window_end"

    events = f"""ev AS (
SELECT {bounds}, feature, 'ks' AS method, round(ks, 6) AS statistic, round({crit}, 6) AS threshold, ks > {crit} AS alert,
  round(ks, 6) AS effect_size, nr AS n_reference, nw AS n_window FROM two, origin
UNION ALL SELECT {bounds}, two.feature, 'wasserstein', round(w1, 6), 0.1, w1 / s > 0.1, round(w1 / s, 6), nr, nw
  FROM two JOIN spread ON two.feature = spread.feature, origin
UNION ALL SELECT {bounds.replace('k *', 'psi.k *').replace('(k +', '(psi.k +')}, psi.feature, 'psi', round(psi, 6), 0.2, psi > 0.2, round(psi, 6), nr, nw
  FROM psi JOIN rt ON psi.feature = rt.feature JOIN tt ON tt.feature = psi.feature AND tt.k = psi.k, origin
UNION ALL SELECT {bounds.replace('k *', 'tt.k *').replace('(k +', '(tt.k +')}, tt.feature, 'cusum', round(coalesce(peak, 0), 6), 2.5, first_alarm IS NOT NULL,
  round(abs(mw - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6), nr, nw
  FROM tt JOIN rt ON tt.feature = rt.feature LEFT JOIN peaks ON peaks.feature = tt.feature AND peaks.k = tt.k, origin)"""
    return DriftSql(base, two_sample, quantiles, psi, cusum, crit, events)


_LAM = repr(kolmogorov_quantile(0.01))
_N = "greatest(floor(nr * nw / CAST(nr + nw AS DOUBLE)), 1)"
_SQL = drift_sql(FE, "fe", FEATURES, DAY, "event_id")
BASE, TWO_SAMPLE, QUANTILES, PSI, CUSUM, EVENTS, FULL = (
    _SQL.base, _SQL.two_sample, _SQL.quantiles, _SQL.psi, _SQL.cusum, _SQL.events, _SQL.full)


@query("ks_windows", FULL + "SELECT window_start, window_end, feature, statistic, threshold, alert, effect_size, n_reference, n_window FROM ev WHERE method = 'ks'")
def ks_windows(spark, folder):
    return events(spark, folder, methods=["ks"]).drop("method", "p_value")


@query("ks_p_values", f"""WITH {BASE}, {TWO_SAMPLE}, l AS (SELECT feature, k, sqrt(n) * ks + 1 / (6 * sqrt(n)) + (sqrt(n) * ks - 1) / (4 * n) AS lam
FROM (SELECT *, nr * nw / CAST(nr + nw AS DOUBLE) AS n FROM two))
SELECT k, feature, round(CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 21),
  lambda i: CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * lam * lam))), 0), 1) END, 9) AS p_value FROM l""")
def ks_p_values(spark, folder):
    reference, target = periods(spark, folder)
    settings = drift.DriftSettings(**{**SETTINGS, "methods": ["ks"]})
    stats, _, _, _ = drift.drift_statistics(reference, target, settings)
    n_eff = drift.effective_size()
    return stats.select("k", "feature", F.round(drift.ks_p_value(F.col("ks"), n_eff), 9).alias("p_value"))


@query("wasserstein_windows", FULL + "SELECT window_start, window_end, feature, statistic, threshold, alert, effect_size, n_reference, n_window FROM ev WHERE method = 'wasserstein'")
def wasserstein_windows(spark, folder):
    return events(spark, folder, methods=["wasserstein"]).drop("method", "p_value")


@query("psi_windows", FULL + "SELECT window_start, window_end, feature, statistic, threshold, alert, effect_size, n_reference, n_window FROM ev WHERE method = 'psi'")
def psi_windows(spark, folder):
    return events(spark, folder, methods=["psi"]).drop("method", "p_value")


@query("cusum_windows", FULL + "SELECT window_start, window_end, feature, statistic, threshold, alert, effect_size, n_reference, n_window FROM ev WHERE method = 'cusum'")
def cusum_windows(spark, folder):
    return events(spark, folder, methods=["cusum"]).drop("method", "p_value")


@query("drift_events", FULL + "SELECT window_start, window_end, feature, method, statistic, threshold, alert, effect_size, n_reference, n_window FROM ev")
def drift_events(spark, folder):
    return events(spark, folder, methods=drift.METHODS).drop("p_value")


_SLIDING = f"""WITH {FE}, {cuts_sql('fe')}, t AS (SELECT timestamp FROM sp WHERE period = 'forward'),
o AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM t),
w AS (SELECT i AS k, lo + to_hours(CAST(i * 3 AS BIGINT)) AS window_start, lo + to_hours(CAST(i * 3 + 6 AS BIGINT)) AS window_end
  FROM o, range(CAST(floor((epoch_us(hi) - epoch_us(lo)) / 10800000000) AS BIGINT) + 1) r(i))
SELECT k, window_start, window_end, CAST(count(*) AS BIGINT) AS row_count FROM w JOIN t ON timestamp >= window_start AND timestamp < window_end GROUP BY 1, 2, 3"""


@query("sliding_window_counts", _SLIDING)
def sliding_window_counts(spark, folder):
    """Six-hour windows every three hours, anchored at the first row of the period."""
    df = views.event_flows(spark, folder)
    target = split.find_cuts(df).period(df, "forward").select("timestamp")
    plan = windows.plan_windows(target, 6 * windows.HOUR, 3 * windows.HOUR)
    counts = windows.assign_windows(target, plan).groupBy("k").agg(F.count("*").alias("row_count"))
    return counts.select("k", *[c.alias(n) for n, c in windows.window_bounds(plan, F.col("k")).items()], "row_count")


@query("short_period_window", f"""WITH {FE}, {cuts_sql('fe')}, t AS (SELECT timestamp FROM sp WHERE period = 'validation'),
o AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM t), s AS (SELECT lo, CAST(floor((epoch_us(hi) - epoch_us(lo)) / 1000000) AS BIGINT) AS sec FROM o)
SELECT CAST(floor((epoch_us(timestamp) - epoch_us(lo)) / (sec * 1000000)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS row_count FROM t, s GROUP BY 1""")
def short_period_window(spark, folder):
    """A window longer than the period shrinks to the period instead of vanishing."""
    df = views.event_flows(spark, folder)
    target = split.find_cuts(df).period(df, "validation").select("timestamp")
    plan = windows.plan_windows(target, 60 * DAY)
    return windows.assign_windows(target, plan).groupBy("k").agg(F.count("*").alias("row_count"))


@query("time_buckets", """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, CAST(count(*) AS BIGINT) AS row_count,
round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def time_buckets(spark, folder):
    rows = views.table(spark, folder, "events")
    return rows.groupBy(windows.bucket(F.col("ts"), 6 * windows.HOUR).alias("bucket")).agg(
        F.count("*").alias("row_count"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("reference_quantiles", f"""WITH {BASE}, {QUANTILES} SELECT feature, p, round(q, 6) AS q FROM qs""")
def reference_quantiles(spark, folder):
    reference, _ = periods(spark, folder)
    counts = twosample.reference_counts(reference, FEATURES)
    probs = sorted({*(i / 10 for i in range(11)), 0.25, 0.75})
    found = exact_quantiles(counts, ["feature"], "value", probs, reference.count() * len(FEATURES), counted=True)
    return found.withColumn("q", F.round("q", 6))


@query("cusum_blocks", f"WITH {BASE}, {CUSUM} SELECT k, feature, step, round(x, 6) AS x FROM seq")
def cusum_blocks(spark, folder):
    """Each window as a sequence of five-row means in time order."""
    _, target = periods(spark, folder)
    rows, _ = drift.windowed(target, drift.DriftSettings(**SETTINGS))
    seq = cu.sequence_means(rows, FEATURES, ["event_id"], 5, target.count())
    return seq.where(F.col("n_window") >= 20).select("k", "feature", "step", F.round("x", 6).alias("x"))


@query("cusum_first_alarm", f"WITH {BASE}, {CUSUM} SELECT tt.k, tt.feature, first_alarm FROM tt LEFT JOIN peaks ON tt.k = peaks.k AND tt.feature = peaks.feature")
def cusum_first_alarm(spark, folder):
    reference, target = periods(spark, folder)
    settings = drift.DriftSettings(**{**SETTINGS, "methods": ["cusum"]})
    _, found, _, _ = drift.drift_statistics(reference, target, settings)
    return found.select("k", "feature", "first_alarm")


@query("cusum_null_thresholds")
def cusum_null_thresholds(spark, folder):
    """Calibrated thresholds for the window lengths that occur; simulated, so no SQL."""
    _, target = periods(spark, folder)
    rows, _ = drift.windowed(target, drift.DriftSettings(**SETTINGS))
    lengths = rows.groupBy("k").agg(F.floor(F.count("*") / 5).alias("n_sequence")).where("n_sequence >= 4")
    return cu.null_thresholds(lengths.select("n_sequence"), warmup=10)


@query("drift_events_calibrated")
def drift_events_calibrated(spark, folder):
    """CUSUM with a calibrated threshold instead of a fixed one."""
    return events(spark, folder, methods=["cusum"], cusum_threshold=None)


# Events with gaps: a third of the values is missing, one feature on all odd days, one has a single value left.
GAPS = FE + """,
fg AS (SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN flow_duration END AS flow_duration,
  CASE WHEN dayofmonth(timestamp) % 2 = 0 THEN total_bytes END AS total_bytes, CASE WHEN event_id = 0 THEN packet_rate END AS packet_rate) FROM fe)"""
GAP_FEATURES = ["flow_duration", "total_bytes", "packet_rate", "mean_packet_size"]
_GAP = drift_sql(GAPS, "fg", GAP_FEATURES, DAY, "event_id")


@query("drift_events_nullable", f"""WITH {_GAP.base}, {_GAP.two_sample}, {_GAP.quantiles}, {_GAP.psi},
grid AS (SELECT k, n, unnest({GAP_FEATURES!r}) AS feature, (SELECT count(*) FROM sp WHERE period = 'train') AS m FROM (SELECT k, count(*) AS n FROM tw GROUP BY k)),
st AS (SELECT grid.k, grid.feature, n, m, two.nr, two.nw, coalesce(two.nr >= 2 AND two.nw >= 2, FALSE) AS ok, ks, w1, w1 / s AS scaled, psi
  FROM grid LEFT JOIN two ON two.k = grid.k AND two.feature = grid.feature LEFT JOIN spread ON spread.feature = grid.feature
  LEFT JOIN psi ON psi.k = grid.k AND psi.feature = grid.feature),
lim AS (SELECT *, {_SQL.critical} AS crit FROM st),
ev AS (SELECT k, feature, n, m, 'ks' AS method, CASE WHEN ok THEN ks ELSE 0 END AS statistic, CASE WHEN ok THEN crit ELSE 1 END AS threshold, CASE WHEN ok THEN ks > crit ELSE FALSE END AS alert,
    CASE WHEN ok THEN ks ELSE 0 END AS effect_size FROM lim
  UNION ALL SELECT k, feature, n, m, 'wasserstein', CASE WHEN ok THEN w1 ELSE 0 END, 0.1, CASE WHEN ok THEN scaled > 0.1 ELSE FALSE END, CASE WHEN ok THEN scaled ELSE 0 END FROM st
  UNION ALL SELECT k, feature, n, m, 'psi', CASE WHEN ok THEN coalesce(psi, 0) ELSE 0 END, 0.2, CASE WHEN ok THEN coalesce(psi, 0) > 0.2 ELSE FALSE END, CASE WHEN ok THEN coalesce(psi, 0) ELSE 0 END FROM st)
SELECT o + to_microseconds(k * {DAY}) AS window_start, feature, method, round(statistic, 6) AS statistic, round(threshold, 6) AS threshold, alert,
  round(effect_size, 6) AS effect_size, CAST(m AS BIGINT) AS n_reference, CAST(n AS BIGINT) AS n_window FROM ev, origin""")
def drift_events_nullable(spark, folder):
    """The drift table of features with gaps: every large-enough window, feature and method has its row."""
    df = views.events_common(spark, folder).withColumns({
        "flow_duration": F.when(F.col("event_id") % 3 > 0, F.col("flow_duration")),
        "total_bytes": F.when(F.dayofmonth("timestamp") % 2 == 0, F.col("total_bytes")),
        "packet_rate": F.when(F.col("event_id") == 0, F.col("packet_rate"))})
    cuts = split.find_cuts(views.event_flows(spark, folder))
    settings = drift.DriftSettings(**{**SETTINGS, "features": GAP_FEATURES, "methods": ("ks", "wasserstein", "psi")})
    return drift.drift_events(cuts.period(df, "train"), cuts.period(df, "forward"), settings).drop("window_end", "p_value")


@query("drift_summary", FULL + """SELECT CASE WHEN GROUPING(method) = 0 THEN 'method' WHEN GROUPING(feature) = 0 THEN 'feature' ELSE 'all' END AS level,
coalesce(method, feature, 'all') AS name, CAST(count(DISTINCT window_start) AS BIGINT) AS windows, CAST(count(*) AS BIGINT) AS comparisons,
CAST(count(*) FILTER (alert) AS BIGINT) AS alerts, min(CASE WHEN alert THEN window_start END) AS first_alert
FROM ev WHERE method <> 'cusum' GROUP BY GROUPING SETS ((method), (feature), ())""")
def drift_summary(spark, folder):
    return summaries.drift_summary(events(spark, folder))


@query("drift_method_table", FULL + """SELECT method, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (alert) AS BIGINT) AS alerts,
round(avg(CAST(alert AS INTEGER)), 6) AS alert_rate, round(median(abs(effect_size)), 6) AS median_effect, round(max(abs(effect_size)), 6) AS max_effect
FROM ev GROUP BY method""")
def drift_method_table(spark, folder):
    return summaries.method_table(events(spark, folder, methods=drift.METHODS)).drop("median_p")


@query("effect_by_alert", FULL + """SELECT method, round(median(CASE WHEN alert THEN abs(effect_size) END), 6) AS alerting,
round(median(CASE WHEN NOT alert THEN abs(effect_size) END), 6) AS quiet FROM ev WHERE method <> 'cusum' GROUP BY method""")
def effect_by_alert(spark, folder):
    return summaries.effect_by_alert(events(spark, folder))


@query("detector_agreement", FULL + """, p AS (SELECT window_start, feature, count(*) FILTER (alert) AS hits FROM ev WHERE method <> 'cusum' GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (hits = 3) AS BIGINT) AS all_agree,
CAST(count(*) FILTER (hits IN (1, 2)) AS BIGINT) AS split, CAST(count(*) FILTER (hits = 0) AS BIGINT) AS none_alerted FROM p""")
def detector_agreement(spark, folder):
    return summaries.detector_agreement(events(spark, folder))


@query("alert_rate_top20", FULL + """SELECT method, feature, CAST(count(*) FILTER (alert) AS BIGINT) AS alerts, CAST(count(*) AS BIGINT) AS windows,
round(count(*) FILTER (alert) / CAST(count(*) AS DOUBLE), 6) AS rate FROM ev WHERE method <> 'cusum' GROUP BY 1, 2 ORDER BY method, rate DESC, feature LIMIT 20""")
def alert_rate_top20(spark, folder):
    return summaries.alert_rates(events(spark, folder))


@query("alert_timeline", FULL + """, c AS (SELECT feature, window_start, CAST(count(*) FILTER (alert) AS BIGINT) AS alerts FROM ev WHERE method <> 'cusum' GROUP BY 1, 2)
SELECT * FROM c WHERE feature IN (SELECT feature FROM c GROUP BY feature ORDER BY sum(alerts) DESC, feature LIMIT 3)""")
def alert_timeline(spark, folder):
    return summaries.alert_timeline(events(spark, folder), 3)


@query("detector_comparison", FULL + """SELECT method, round(avg(CAST(alert AS INTEGER)), 6) AS alert_rate, round(median(abs(effect_size)), 6) AS median_effect,
CASE method WHEN 'ks' THEN 1 WHEN 'wasserstein' THEN 2 ELSE 3 END AS position FROM ev WHERE method <> 'cusum' GROUP BY method""")
def detector_comparison(spark, folder):
    return summaries.detector_comparison(events(spark, folder))


@query("strongest_drift_features", FULL + """SELECT feature, round(median(effect_size), 6) AS median_effect_size, round(max(effect_size), 6) AS max_effect_size,
CAST(count(*) AS BIGINT) AS alerting_windows FROM ev WHERE alert AND method <> 'cusum' GROUP BY feature ORDER BY median(effect_size) DESC, feature LIMIT 8""")
def strongest_drift_features(spark, folder):
    return summaries.strongest_features(events(spark, folder))


@query("strongest_feature", FULL + """SELECT method, arg_max(feature, (effect_size, feature)) AS feature, max(effect_size) AS effect_size FROM ev WHERE method <> 'cusum' GROUP BY method""")
def strongest_feature(spark, folder):
    return summaries.strongest_feature(events(spark, folder), ["method"])


_GRID = [g for g in drift.SWEEP if g[1] != "cusum"]


def _sweep_threshold(method: str, value: float) -> str:
    return f"{kolmogorov_quantile(value)!r}" if method == "ks" else repr(value)


@query("threshold_sweep", f"WITH {BASE}, {TWO_SAMPLE}, {QUANTILES}, {PSI}, " + f"""
st AS (SELECT 'ks' AS method, ks AS effect, ks * (sqrt({_N}) * (1 + 1 / (4 * {_N}))) + 1 / (6 * sqrt({_N})) - 1 / (4 * {_N}) AS score FROM two
  UNION ALL SELECT 'wasserstein', w1 / s, w1 / s FROM two JOIN spread ON two.feature = spread.feature UNION ALL SELECT 'psi', psi, psi FROM psi),
grid AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{m}', CAST({_sweep_threshold(m, v)} AS DOUBLE))" for n, m, v in _GRID)}) g(variant, method, value))
SELECT variant, CAST(count(*) FILTER (score > value) AS BIGINT) AS alerts, CAST(count(*) AS BIGINT) AS comparisons,
  round(avg(CAST(score > value AS INTEGER)), 6) AS alert_rate, round(avg(abs(effect)), 6) AS mean_effect_size
FROM st JOIN grid ON st.method = grid.method GROUP BY variant""")
def threshold_sweep(spark, folder):
    """Nine threshold settings from one computation of each statistic."""
    reference, target = periods(spark, folder)
    return drift.sweep(reference, target, drift.DriftSettings(**SETTINGS), _GRID)


@query("categorical_drift", f"""WITH {FE}, {cuts_sql('fe')},
tw AS (SELECT protocol, CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM sp WHERE period = 'forward')) / 86400000000) AS BIGINT) AS k FROM sp WHERE period = 'forward'),
r AS (SELECT protocol, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM sp WHERE period = 'train' GROUP BY 1),
w AS (SELECT k, protocol, count(*) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE) AS q FROM tw GROUP BY 1, 2),
ks AS (SELECT DISTINCT k FROM w), g AS (SELECT k, protocol FROM ks, (SELECT protocol FROM r UNION SELECT protocol FROM w))
SELECT g.k, round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS tvd FROM g LEFT JOIN r ON g.protocol = r.protocol
LEFT JOIN w ON g.k = w.k AND g.protocol = w.protocol GROUP BY g.k""")
def categorical_drift(spark, folder):
    """Total variation distance of a category mixture per window."""
    from tidewatch.operators.realized import mixture_distance

    reference, target = periods(spark, folder)
    tagged = windows.assign_windows(target, windows.plan_windows(target, DAY))
    return mixture_distance(reference, tagged, "protocol", ["k"]).select("k", F.round("tvd", 6).alias("tvd"))


@query("row_to_window", f"""WITH {FL}, m AS (SELECT min(timestamp) AS lo FROM fl)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor((epoch_us(timestamp) - epoch_us(lo)) / (30 * 86400000000)) AS BIGINT) AS k FROM fl, m""")
def row_to_window(spark, folder):
    df = views.lineitem_flows(spark, folder)
    plan = windows.plan_windows(df, 30 * DAY)
    return windows.assign_windows(df, plan).select(*views.LINEITEM_KEY, "k")


ALL_FEATURES = ["flow_duration", "total_packets", "total_bytes", "forward_packets", "backward_packets", "forward_bytes",
                "backward_bytes", "packet_rate", "byte_rate", "mean_packet_size", "bytes_per_packet", "bytes_ratio",
                "packets_ratio", "duration_log1p", "packets_log1p", "bytes_log1p"]


_LINES = drift_sql(FL, "fl", ALL_FEATURES, 120 * DAY, ", ".join([*views.LINEITEM_KEY, "forward_bytes"]))


@query("drift_events_lineitem", _LINES.full + """SELECT window_start, window_end, feature, method, round(statistic, 5) AS statistic, threshold, alert,
  round(effect_size, 5) AS effect_size, n_reference, n_window FROM ev""")
def drift_events_lineitem(spark, folder):
    """Sixteen features, all four detectors, windows of 120 days on whole dates."""
    rows = views.lineitem_flows(spark, folder)
    cuts, df = split.find_cuts(rows), rows.drop("label", "protocol", "score")
    settings = drift.DriftSettings(**{**SETTINGS, "window": 120 * DAY, "features": ALL_FEATURES,
                                      "methods": drift.METHODS, "tiebreak": (*views.LINEITEM_KEY, "forward_bytes")})
    out = drift.drift_events(cuts.period(df, "train"), cuts.period(df, "forward"), settings, with_derived).drop("p_value")
    # The SQL rounds twice, so every tenth value lies halfway here.
    return out.withColumns({c: round_scaled(F.col(c), 5) for c in ("statistic", "effect_size")})
