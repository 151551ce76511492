"""Feature scaling, sampling, controlled shifts and their measured effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import preprocess, realized, sampling, shifts, split
from tidewatch.operators.combine import fixed_rows
from tidewatch.queries.base import FE, FL, cuts_sql, query
from tidewatch.queries.metric_queries import quantile_sql
from tidewatch.sources import views

NUMERIC = ["flow_duration", "total_packets", "total_bytes"]


def _train(spark, folder):
    df = views.events_common(spark, folder)
    cuts = split.find_cuts(views.event_flows(spark, folder))
    return df, cuts.period(df, "train"), cuts


_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)


@query("standard_scale", f"WITH {FE}, {cuts_sql('fe')}, st AS (SELECT {_STATS} FROM sp WHERE period = 'train') SELECT event_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUMERIC) + " FROM sp, st")
def standard_scale(spark, folder):
    df, train, cuts = _train(spark, folder)
    fitted = preprocess.fit_features(train, NUMERIC, cutoff=cuts.bounds("train")[1])
    wide = fitted.wide(df, ["event_id"])
    return wide.withColumns({c: F.round(c, 6) for c in NUMERIC})


@query("one_hot", "SELECT event_id, " + ", ".join(
    f"CAST(event_type = '{v}' AND l.v IS NOT NULL AS DOUBLE) AS {v}" for v in ("click", "error", "view")) +
    " FROM events LEFT JOIN (SELECT DISTINCT event_type AS v FROM events WHERE event_type <> 'signup' AND event_type <> 'purchase') l ON l.v = event_type")
def one_hot(spark, folder):
    """Levels learnt without two event types: those encode as all zeros."""
    rows = views.table(spark, folder, "events")
    fitted = preprocess.fit_features(rows.where(~F.col("event_type").isin("signup", "purchase")), [], ["event_type"])
    return fitted.wide(rows, ["event_id"]).withColumnsRenamed({f"event_type={v}": v for v in fitted.levels["event_type"]})


@query("impute_median_mode", f"""WITH j AS (SELECT d.doc_id, n_chars, CAST(quality AS DOUBLE) AS quality, CASE WHEN d.doc_id % 7 > 0 THEN lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
{quantile_sql('j', 'md', '', 'quality', 'CAST(0.5 AS DOUBLE)', 'quality IS NOT NULL')},
mo AS (SELECT lang AS mode FROM j WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
f AS (SELECT doc_id, coalesce(quality, q) AS quality, CAST(n_chars AS DOUBLE) AS n_chars, coalesce(lang, mode) AS lang FROM j, md, mo),
s AS (SELECT avg(quality) AS mq, stddev_pop(quality) AS sq, avg(n_chars) AS mn, stddev_pop(n_chars) AS sn FROM f)
SELECT doc_id, round((quality - mq) / sq, 6) AS quality, round((n_chars - mn) / sn, 6) AS n_chars, lang FROM f, s""")
def impute_median_mode(spark, folder):
    """Filled and scaled columns; the language, missing in every seventh row, is read back from its indicators."""
    docs = views.table(spark, folder, "documents").select("doc_id", "n_chars", F.when(F.pmod("doc_id", F.lit(7)) > 0, F.col("lang")).alias("lang"))
    rows = docs.join(views.table(spark, folder, "labels"), "doc_id", "left")
    fitted = preprocess.fit_features(rows, ["quality", "n_chars"], ["lang"], impute=True)
    wide = fitted.wide(rows, ["doc_id"])
    levels = F.concat_ws("|", *[F.when(F.col(f"`lang={v}`") == 1.0, F.lit(v)) for v in fitted.levels["lang"]])
    return wide.select("doc_id", *[F.round(c, 6).alias(c) for c in ("quality", "n_chars")], levels.alias("lang"))


@query("class_weights", f"""WITH {FE}, c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM fe GROUP BY label)
SELECT label, round(t / (2.0 * n), 9) AS weight, CAST(n AS BIGINT) AS row_count FROM c""")
def class_weights(spark, folder):
    weighted = preprocess.balanced_weights(views.event_flows(spark, folder))
    return weighted.groupBy("label").agg(F.round(F.max("weight"), 9).alias("weight"), F.count("*").alias("row_count"))


@query("majority_class", """SELECT l_linestatus, arg_max(l_returnflag, (n, -ord)) AS majority FROM (
SELECT l_linestatus, l_returnflag, count(*) AS n, ascii(l_returnflag) AS ord FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def majority_class(spark, folder):
    items = views.table(spark, folder, "lineitem")
    return items.groupBy("l_linestatus").agg(F.mode("l_returnflag", deterministic=True).alias("majority"))


@query("stratified_sample", """WITH r AS (SELECT event_id, event_type = 'error' AS y, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5(event_id || '|42'), event_id) AS rn,
count(*) OVER (PARTITION BY event_type = 'error') AS n FROM events) SELECT event_id, CASE WHEN rn <= floor(n * 0.5) THEN 'train' ELSE 'rest' END AS arm FROM r""")
def stratified_sample(spark, folder):
    rows = views.event_flows(spark, folder).select("event_id", "label")
    return sampling.stratified_halves(rows, "label", ["event_id"]).select("event_id", "arm")


@query("random_rows", "SELECT event_id FROM events ORDER BY md5(event_id || '|42'), event_id LIMIT 777")
def random_rows(spark, folder):
    return sampling.random_rows(views.table(spark, folder, "events").select("event_id"), 777, ["event_id"])


def _u(salt: str, word: int = 0) -> str:
    return f"(CAST(('0x' || substr(md5(event_id || '|{salt}'), {1 + 8 * word}, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE"


def _z(salt: str) -> str:
    return f"sqrt(-2.0 * ln({_u(salt, 0)})) * cos(2 * pi() * {_u(salt, 1)})"


def _scaled(value: str, factor: float, salt: str) -> str:
    return f"(exp(ln(1 + {value}) + ln(CAST({factor} AS DOUBLE)) + 0.02 * {_z(salt)}) - 1)"


def _shifted(spark, folder, kind, magnitude):
    return shifts.apply_shift(views.events_common(spark, folder), kind, magnitude, ["event_id"])


@query("shift_packet_size", f"""WITH {FE}, s AS (SELECT *, {_scaled('total_bytes', 3.0, '42:total_bytes')} AS tb FROM fe)
SELECT event_id, label, round(tb, 4) AS total_bytes, round(tb / total_packets, 4) AS bytes_per_packet, round(ln(1 + tb), 6) AS bytes_log1p,
round(CASE WHEN flow_duration > 0 THEN tb / flow_duration ELSE 0 END, 4) AS byte_rate FROM s""")
def shift_packet_size(spark, folder):
    return _shifted(spark, folder, "packet_size", 3.0).select(
        "event_id", "label", *[F.round(c, d).alias(c) for c, d in (
            ("total_bytes", 4), ("bytes_per_packet", 4), ("bytes_log1p", 6), ("byte_rate", 4))])


@query("shift_duration", f"""WITH {FE}, s AS (SELECT *, {_scaled('flow_duration', 1.5, '42:flow_duration')} AS d FROM fe)
SELECT event_id, round(d, 5) AS flow_duration, round(ln(1 + d), 6) AS duration_log1p FROM s""")
def shift_duration(spark, folder):
    return _shifted(spark, folder, "duration", 1.5).select(
        "event_id", F.round("flow_duration", 5).alias("flow_duration"), F.round("duration_log1p", 6).alias("duration_log1p"))


@query("shift_packet_rate", f"""WITH {FE} SELECT event_id, round({_scaled('packet_rate', 1.5, '42:packet_rate')}, 4) AS packet_rate,
round({_scaled('byte_rate', 1.5, '42:byte_rate')}, 4) AS byte_rate FROM fe""")
def shift_packet_rate(spark, folder):
    return _shifted(spark, folder, "packet_rate", 1.5).select(
        "event_id", F.round("packet_rate", 4).alias("packet_rate"), F.round("byte_rate", 4).alias("byte_rate"))


@query("shift_byte_rate", f"WITH {FE} SELECT event_id, packet_rate, round({_scaled('byte_rate', 3.0, '42:byte_rate')}, 4) AS byte_rate FROM fe")
def shift_byte_rate(spark, folder):
    return _shifted(spark, folder, "byte_rate", 3.0).select("event_id", "packet_rate", F.round("byte_rate", 4).alias("byte_rate"))


@query("shift_iat", f"""WITH {FE}, s AS (SELECT *, {_scaled('1.0', 1.5, '42:iat')} AS f FROM fe)
SELECT event_id, total_bytes, round(packet_rate * f, 4) AS packet_rate, round(byte_rate * f, 4) AS byte_rate FROM s""")
def shift_iat(spark, folder):
    return _shifted(spark, folder, "iat", 1.5).select(
        "event_id", "total_bytes", F.round("packet_rate", 4).alias("packet_rate"), F.round("byte_rate", 4).alias("byte_rate"))


_MIX = f"mix AS (SELECT event_id, CASE WHEN {_u('42:protocol')} < CAST(0.6 AS DOUBLE) THEN 'ICMP' WHEN {_u('42:protocol')} < CAST(0.8 AS DOUBLE) THEN 'TCP' ELSE 'UDP' END AS protocol FROM events)"


@query("shift_protocol_mixture", f"WITH {_MIX} SELECT * FROM mix")
def shift_protocol_mixture(spark, folder):
    return _shifted(spark, folder, "protocol_mixture", 3.0).select("event_id", "protocol")


def _prevalence_sql(target: float) -> str:
    return f"""h AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5(event_id || '|42:prevalence'), event_id) AS rn FROM events),
c AS (SELECT sum(label) AS a, count(*) - sum(label) AS b FROM h),
quota AS (SELECT CASE WHEN {target} <= a / CAST(a + b AS DOUBLE) THEN least(greatest(round_even({target} / (1.0 - {target}) * b, 0), 1), a) ELSE a END AS qa,
  CASE WHEN {target} <= a / CAST(a + b AS DOUBLE) THEN b ELSE greatest(1, least(round_even(a * (1.0 - {target}) / {target}, 0), b)) END AS qb FROM c)"""


@query("shift_class_prevalence", f"WITH {_prevalence_sql(0.05)} SELECT event_id, label FROM h, quota WHERE rn <= CASE WHEN label = 1 THEN qa ELSE qb END")
def shift_class_prevalence(spark, folder):
    return _shifted(spark, folder, "class_prevalence", 0.05).select("event_id", "label")


@query("shift_class_prevalence_up", f"WITH {_prevalence_sql(0.30)} SELECT event_id, label FROM h, quota WHERE rn <= CASE WHEN label = 1 THEN qa ELSE qb END")
def shift_class_prevalence_up(spark, folder):
    return _shifted(spark, folder, "class_prevalence", 0.30).select("event_id", "label")


@query("shift_telemetry", f"WITH {FL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, label, total_packets, protocol FROM fl")
def shift_telemetry(spark, folder):
    reduced = shifts.apply_shift(views.lineitem_common(spark, folder), "telemetry_reduction", 0.0, views.LINEITEM_KEY)
    gone = [c for c in shifts.REDUCED if c in reduced.columns]
    if gone:
        raise ValueError(f"telemetry columns survived: {gone}")
    return reduced.select(*views.LINEITEM_KEY, "timestamp", "label", "total_packets", "protocol")


_MOVES = ["flow_duration", "total_packets", "total_bytes"]


def _median(source, out, value):
    return quantile_sql(source, out, "feature, ", value, "CAST(0.5 AS DOUBLE)", "TRUE")


@query("realized_shift", f"""WITH {FE}, {cuts_sql('fe')}, b AS (UNPIVOT (SELECT {', '.join(_MOVES)} FROM sp WHERE period = 'train') ON {', '.join(_MOVES)} INTO NAME feature VALUE value),
a AS (UNPIVOT (SELECT {', '.join(_MOVES)} FROM sp WHERE period = 'forward') ON {', '.join(_MOVES)} INTO NAME feature VALUE value),
{_median('b', 'mb', 'value')}, {_median('a', 'ma', 'value')},
sb AS (SELECT feature, avg(value) AS m, var_samp(value) AS v FROM b GROUP BY 1), sa AS (SELECT feature, avg(value) AS m, var_samp(value) AS v FROM a GROUP BY 1)
SELECT sb.feature, round(sb.m, 6) AS mean_before, round(sa.m, 6) AS mean_after, round(CASE WHEN sqrt((sb.v + sa.v) / 2) > 0 THEN (sa.m - sb.m) / sqrt((sb.v + sa.v) / 2) ELSE 0 END, 6) AS cohens_d,
round(mb.q, 6) AS median_before, round(ma.q, 6) AS median_after, round(CASE WHEN mb.q > 0 AND ma.q > 0 THEN ma.q / mb.q END, 6) AS median_ratio
FROM sb JOIN sa ON sb.feature = sa.feature JOIN mb ON mb.feature = sb.feature JOIN ma ON ma.feature = sb.feature""")
def realized_shift(spark, folder):
    df, train, cuts = _train(spark, folder)
    moves = realized.numeric_moves(train, cuts.period(df, "forward"), _MOVES)
    return moves.select("feature", *[F.round(c, 6).alias(c) for c in (
        "mean_before", "mean_after", "cohens_d", "median_before", "median_after", "median_ratio")])


_TVD = f"""WITH {_MIX}, b AS (SELECT CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol FROM events),
p AS (SELECT protocol, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM b GROUP BY 1), q AS (SELECT protocol, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM mix GROUP BY 1),
j AS (SELECT coalesce(p.protocol, q.protocol) AS level, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.protocol = q.protocol)"""


@query("mixture_tvd", _TVD + " SELECT round(0.5 * sum(abs(p - q)), 9) AS tvd, CAST(count(*) FILTER (p > 0) AS BIGINT) AS levels_before, CAST(count(*) FILTER (q > 0) AS BIGINT) AS levels_after FROM j")
def mixture_tvd(spark, folder):
    before = views.event_flows(spark, folder)
    out = realized.mixture_distance(before, _shifted(spark, folder, "protocol_mixture", 3.0), "protocol")
    return out.select(F.round("tvd", 9).alias("tvd"), "levels_before", "levels_after")


@query("mixture_top_levels", _TVD + " SELECT level, round(q, 6) AS share FROM j ORDER BY q DESC, level LIMIT 5")
def mixture_top_levels(spark, folder):
    before = views.event_flows(spark, folder)
    out = realized.mixture_distance(before, _shifted(spark, folder, "protocol_mixture", 3.0), "protocol")
    return out.select(F.explode("top_after").alias("level", "share"))


_BR = "avg(CAST(event_type = 'error' AS INTEGER))"


@query("shift_verdicts", f"""WITH {FE}, {_prevalence_sql(0.05)}, x AS (SELECT fe.* FROM fe JOIN h ON fe.event_id = h.event_id, quota WHERE rn <= CASE WHEN fe.label = 1 THEN qa ELSE qb END),
s AS (SELECT *, {_scaled('flow_duration', 1.5, '42:flow_duration')} AS d FROM fe),
r AS (SELECT 'class_prevalence' AS kind, (SELECT count(*) FROM x) AS rows_after, (SELECT avg(label) FROM x) AS ra, abs(((SELECT avg(flow_duration) FROM x) - (SELECT avg(flow_duration) FROM fe)) / sqrt(((SELECT var_samp(flow_duration) FROM x) + (SELECT var_samp(flow_duration) FROM fe)) / 2)) AS d
UNION ALL SELECT 'duration', (SELECT count(*) FROM s), (SELECT avg(label) FROM s), abs(((SELECT avg(d) FROM s) - (SELECT avg(flow_duration) FROM fe)) / sqrt(((SELECT var_samp(d) FROM s) + (SELECT var_samp(flow_duration) FROM fe)) / 2)))
SELECT kind, CAST(rows_after AS BIGINT) AS rows_after, round(ra, 6) AS attack_rate_after, round(d, 6) AS max_abs_cohens_d, d >= 0.05 OR abs(ra - (SELECT avg(label) FROM fe)) > 1e-6 AS verified FROM r""")
def shift_verdicts(spark, folder):
    """Two shifts measured together in one job: shifted tables are unioned under their kind."""
    before = views.events_common(spark, folder)
    after = None
    for kind, magnitude in (("class_prevalence", 0.05), ("duration", 1.5)):
        part = shifts.apply_shift(before, kind, magnitude, ["event_id"]).select(
            "label", "flow_duration", F.lit(kind).alias("kind"))
        after = part if after is None else after.unionByName(part)
    moves = realized.numeric_moves(before, after, ["flow_duration"], ["kind"])
    rates = realized.class_rates(before, after, ["kind"])
    out = realized.verdict(moves, None, rates, ["kind"])
    return out.select("kind", "rows_after", F.round("attack_rate_after", 6).alias("attack_rate_after"),
                      F.round("max_abs_cohens_d", 6).alias("max_abs_cohens_d"), "verified")


_GRID = ", ".join(f"('{k}', CAST({m} AS DOUBLE))" for k, m in shifts.catalogue())


@query("shift_catalogue", f"""WITH g AS (SELECT * FROM (VALUES {_GRID}) v(kind, magnitude)), p AS (SELECT DISTINCT l_linestatus AS model FROM lineitem)
SELECT model, kind, magnitude FROM p CROSS JOIN g""")
def shift_catalogue(spark, folder):
    """Every model with every shift setting."""
    models = views.table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("model")).distinct()
    return models.select("model", F.inline(fixed_rows(["kind", "magnitude"], shifts.catalogue())))


@query("one_hot_many_levels", f"""WITH {FL}, {cuts_sql("fl")}, lv AS (SELECT level, row_number() OVER (ORDER BY level COLLATE "C") AS place FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS level FROM sp WHERE period = 'train'))
SELECT coalesce(CAST(place AS BIGINT), 0) AS place, level, CAST(count(*) AS BIGINT) AS row_count FROM sp LEFT JOIN lv ON level = CAST(l_orderkey AS VARCHAR) GROUP BY ALL""")
def one_hot_many_levels(spark, folder):
    """Rows at each place of a sparse vector over all orders of the training period; place 0 is the scaled quantity, here of rows
    whose order is not known from training."""
    items = views.lineitem_common(spark, folder)
    cuts = split.find_cuts(views.lineitem_flows(spark, folder))
    train = cuts.period(items, "train")
    fitted = preprocess.fit_features(train, ["forward_packets"])
    orders = preprocess.fit_level_table(train, "l_orderkey")
    filled = F.filter(F.unwrap_udt("features")["indices"], lambda i: i > 0)
    placed = orders.vectors(items, fitted).select(F.coalesce(F.try_element_at(filled, F.lit(1)), F.lit(0)).cast("long").alias("place"))
    names = orders.table.select((F.col("place") + 1).cast("long").alias("place"), "level")
    return placed.groupBy("place").agg(F.count("*").alias("row_count")).join(names, "place", "left").select("place", "level", "row_count")
