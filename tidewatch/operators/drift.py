"""Windowed drift analysis: a reference period against every window of a later one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.columns import significant
from tidewatch.functions.stats import kolmogorov_quantile, ks_critical, ks_p_value
from tidewatch.operators import cusum as cu
from tidewatch.operators import psi as ps
from tidewatch.operators import twosample as ts2
from tidewatch.operators.quantiles import pick_quantiles
from tidewatch.operators.running import cut_slices
from tidewatch.operators.windows import HOUR, WindowPlan, assign_windows, plan_windows, window_bounds
from tidewatch.session import materialize, rows_per_slice, run_once

# Detector names.
METHODS = ("ks", "wasserstein", "psi", "cusum")

# Values that the sampled methods sort at a time: of larger inputs a few features are taken after each other, so that
# what they shuffle and store is a part of the whole.
VALUES_PER_BATCH = 60_000_000
# Windows that follow each other in one task of the sampled methods; each holds its rows, so slices are that much smaller.
WINDOWS_IN_A_TASK = 4

Derive = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DriftSettings:
    """Window sizes in microseconds and one threshold per detector."""

    window: int = HOUR
    stride: int | None = None
    min_samples: int = 200
    methods: Sequence[str] = ("ks", "wasserstein", "psi")
    features: Sequence[str] | None = None
    alpha: float = 0.01
    wasserstein_threshold: float = 0.1
    psi_threshold: float = 0.2
    psi_bins: int = 10
    cusum_threshold: float | None = None
    cusum_drift: float = 0.5
    cusum_warmup: int = 20
    cusum_block: int = 500
    cusum_rate: float = 0.01
    cusum_seed: int = 0
    tiebreak: Sequence[str] = field(default_factory=tuple)


def known_methods(names: Sequence[str]) -> list[str]:
    """``names`` without repeats; anything but the four detector names is an error."""
    wrong = [n for n in names if n not in METHODS]
    if wrong or not names:
        raise ValueError(f"drift methods must come from {METHODS}, got {list(names)!r}")
    return list(dict.fromkeys(names))


def resolve_features(reference: DataFrame, target: DataFrame, wanted: Sequence[str] | None) -> list[str]:
    """Numeric features both tables carry; explicitly named ones must exist in the reference."""
    if wanted:
        missing = [f for f in wanted if f not in reference.columns]
        if missing:
            raise KeyError(f"drift features not present: {missing}")
    names = list(wanted) if wanted else schema.flow_features(reference, "number")
    return [f for f in names if f in target.columns]


def windowed(target: DataFrame, settings: DriftSettings) -> tuple[DataFrame, WindowPlan] | None:
    """Target rows tagged with the number of every window that holds them."""
    plan = plan_windows(target, settings.window, settings.stride)
    return None if plan is None else (assign_windows(target, plan), plan)


def large_enough(windows: DataFrame, min_samples: int) -> DataFrame:
    """(k, rows) of the windows with enough rows, whatever their features hold."""
    return windows.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_samples)


def on_grid(stats: DataFrame, enough: DataFrame, features: Sequence[str], reference_rows: int) -> DataFrame:
    """A row for every large-enough window and feature; no distance below two finite values on either side.

    ``finite_reference`` and ``finite_window`` are what the distances were computed from, n_reference and
    n_window the rows of the samples.
    """
    grid = enough.select("k", F.col("rows").alias("n_window"), F.explode(F.array(*map(F.lit, features))).alias("feature"))
    found = stats.withColumnsRenamed({"n_reference": "finite_reference", "n_window": "finite_window"})
    full = grid.join(found, ["k", "feature"], "left").withColumn("n_reference", F.lit(reference_rows).cast("long"))
    usable = F.coalesce((F.col("finite_reference") >= 2) & (F.col("finite_window") >= 2), F.lit(False))
    distances = [c for c in ("ks", "wasserstein", "scaled", "psi") if c in stats.columns]
    return full.withColumn("usable", usable).withColumns(
        {c: F.when(F.col("usable"), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in distances})


def effective_size() -> Column:
    """n * m / (n + m) of the finite values, in doubles."""
    n, m = F.col("finite_reference").cast("double"), F.col("finite_window").cast("double")
    return n * m / (n + m)


def _event(method: str, statistic: Column, threshold: Column, alert: Column, effect: Column,
           p_value: Column | None = None) -> Column:
    return F.struct(
        F.lit(method).alias("method"), statistic.cast("double").alias("statistic"),
        threshold.cast("double").alias("threshold"), alert.alias("alert"),
        (F.lit(None).cast("double") if p_value is None else p_value).alias("p_value"),
        effect.cast("double").alias("effect_size"))


def _emit(stats: DataFrame, events: Sequence[Column]) -> DataFrame:
    return stats.select("k", "feature", F.col("n_reference").cast("long"), F.col("n_window").cast("long"),
                        F.inline(F.array(*events)))


@dataclass(frozen=True)
class ReferenceProfile:
    """What the windows are compared with: a few numbers per feature, kept on the driver."""

    rows: int
    moments: dict[str, tuple[float, float, int]]
    spread: dict[str, float]
    edges: dict[str, list[float] | None]


def profile_reference(reference: DataFrame, features: Sequence[str], ranked: DataFrame | None, bins: int,
                      moments: dict[str, tuple[float, float, int]] | None = None) -> ReferenceProfile:
    """Mean, deviation, quartile range and quantile bin edges of each reference feature.

    ``ranked`` holds the reference values with running counts; without it only the moments
    are known.
    """
    moments = reference_facts(reference, features) if moments is None else moments
    spread, edges = {}, {}
    if ranked is not None:
        grid = [i / bins for i in range(bins + 1)]
        picked: dict[str, dict[float, float]] = {f: {} for f in features}
        for r in run_once(pick_quantiles(ranked, ["feature"], "value", sorted({*grid, 0.25, 0.75}))).collect():
            picked[r.feature][r.p] = r.q
        for f in features:
            q = picked[f]
            iqr = q[0.75] - q[0.25] if q else 0.0  # a feature without finite values has no quantiles
            spread[f] = iqr if iqr > 0 else (moments[f][1] or 1.0)
            edges[f] = ps.inner_edges([q[p] for p in grid]) if q else None
    return ReferenceProfile(next((m[2] for m in moments.values()), 0), moments, spread, edges)


def reference_facts(reference: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, int]]:
    """feature -> (mean, population deviation, rows of the sample)."""
    return {r.feature: (r.mu, r.sigma, r.n_reference)
            for r in ts2.reference_moments(reference, features).collect()}


def profile_table(reference: DataFrame, profile: ReferenceProfile) -> DataFrame:
    """The profile as a table with one short row per feature."""
    rows = [(f, m[0], m[1], profile.rows, profile.spread.get(f), profile.edges.get(f))
            for f, m in profile.moments.items()]
    return reference.sparkSession.createDataFrame(
        rows, "feature string, mu double, sigma double, n_reference long, spread double, edges array<double>")


def sample_statistics(pool: DataFrame, slices: str | None, profile: DataFrame, methods: Sequence[str], bins: int,
                      expected_rows: int, centres: Mapping[str, float] | None = None) -> DataFrame:
    """(feature, k) -> ks, wasserstein and its scaled form, psi: each computed once."""
    out = None
    if "ks" in methods or "wasserstein" in methods:
        looked_up = ts2.reference_lookup(ts2.sorted_axis(pool, slices, centres), slices)
        if "wasserstein" in methods:
            if slices:
                # The rank stage reads the looked-up axis several times.
                looked_up = materialize(run_once(looked_up))
            out = ts2.sample_distances(looked_up, expected_rows).join(
                F.broadcast(profile.select("feature", "spread")), "feature").withColumn(
                "scaled", F.col("wasserstein") / F.col("spread"))
        else:
            out = ts2.ks_distance(looked_up)
    if "psi" in methods:
        edges = profile.select("feature", "edges")
        counted = pool.withColumn("n", F.col("nr") + F.col("nw"))
        binned = ps.bin_table(counted, edges, ["feature", "k"], bins, weight="n")
        psi = ps.psi(binned.where(F.col("k") == ts2.REFERENCE), binned.where(F.col("k") != ts2.REFERENCE),
                     edges, ["k"], bins)
        out = psi if out is None else out.join(psi.select("feature", "k", "psi"), ["feature", "k"])
    return out


def cusum_events(windows: DataFrame, features: Sequence[str], profile: DataFrame,
                 settings: DriftSettings, expected_rows: int, derive: Derive | None = None) -> DataFrame:
    """CUSUM rows of the drift table, with the first alarming step of each sequence."""
    moments = profile.select("feature", "mu", "sigma", "n_reference")
    tiebreak = [c for c in settings.tiebreak if c in windows.columns]
    sequence = cu.sequence_means(windows, features, tiebreak, settings.cusum_block, expected_rows, derive=derive)
    path = cu.cusum_path(sequence, moments, settings.cusum_drift, settings.cusum_warmup,
                         cu.longest_sequence(windows, settings.cusum_block))
    base = cu.effects(windows if derive is None else derive(windows), features, moments).withColumn(
        "n_sequence", cu.sequence_length(F.col("n_window"), settings.cusum_block).cast("long"))
    if settings.cusum_threshold is not None:
        limit = F.lit(float(settings.cusum_threshold))
        base, path = base.withColumn("limit", limit), path.withColumn("limit", limit)
    else:
        null = cu.null_thresholds(base.select("n_sequence"), settings.cusum_drift, settings.cusum_warmup,
                                  settings.cusum_rate, seed=settings.cusum_seed)
        base = base.join(null.withColumnRenamed("threshold", "limit"), "n_sequence")
        path = path.join(base.select("k", "feature", "limit"), ["k", "feature"])
    peaks = cu.cusum_peaks(path, "limit")
    full = base.join(peaks, ["k", "feature"], "left").withColumn("cusum", F.coalesce("cusum", F.lit(0.0)))
    return full.select("*", F.col("first_alarm").alias("first_alarm_offset"))


def feature_batches(features: Sequence[str], rows: int) -> list[list[str]]:
    """``features`` in groups of ``VALUES_PER_BATCH`` values of ``rows`` rows, or of one feature."""
    size = max(VALUES_PER_BATCH // max(rows, 1), 1)
    return [list(features[i:i + size]) for i in range(0, len(features), size)]


def compare_samples(reference: DataFrame, windows: DataFrame, features: Sequence[str], methods: Sequence[str], bins: int,
                    rows: int, moments: Mapping[str, tuple[float, float, int]]) -> DataFrame:
    """Statistics of the sampled methods.

    Large inputs are counted a few features at a time. Counts are stored, and features are put together up to a slice of rows;
    their statistics are stored before others follow, so that only their shuffles are on disk.
    """
    def statistics(pool: DataFrame, some: Sequence[str], expected: int, ref_counts: DataFrame | None = None) -> DataFrame:
        pool, slices = cut_slices(pool, ["feature", "value"], expected)
        ranked = None
        if {"wasserstein", "psi"} & set(methods):
            # A stored pool is at hand; another one is cheaper to count without the windows.
            source = pool if ref_counts is None else ref_counts.select("feature", "value", F.col("n").alias("nr"),
                                                                       F.lit(ts2.REFERENCE).alias("k"))
            ranked = ts2.ranked_reference(source, slices)
        profile = profile_table(reference, profile_reference(reference, some, ranked, bins, {f: moments[f] for f in some}))
        centres = {f: moments[f][0] for f in some if moments[f][0] is not None}
        return sample_statistics(pool, slices, profile, methods, bins, expected, centres)

    limit = rows_per_slice(reference.sparkSession)
    if rows * len(features) <= limit:
        ref_counts = ts2.reference_counts(reference, features)
        return statistics(ts2.pooled_counts(ref_counts, windows, features), features, rows * len(features), ref_counts)
    done: list[DataFrame] = []
    waiting: list[tuple[str, int, DataFrame]] = []

    def store() -> None:
        pools = {id(pool): pool for *_, pool in waiting}
        parts = [pool.where(F.col("feature").isin([f for f, _, p in waiting if p is pool])) for pool in pools.values()]
        held = [n * WINDOWS_IN_A_TASK for _, n, _ in waiting]
        found = statistics(reduce(DataFrame.unionByName, parts), [f for f, *_ in waiting], max(held) if max(held) <= limit else sum(held))
        done.append(materialize(run_once(found)))
        waiting.clear()

    for some in feature_batches(features, rows):
        pool = materialize(run_once(ts2.pooled_counts(ts2.reference_counts(reference, some), windows, some)))
        sizes = {r.feature: r["count"] for r in pool.groupBy("feature").count().collect()}
        for feature in some:
            size = sizes.get(feature, 0)
            if waiting and size + sum(n for _, n, _ in waiting) > limit:
                store()
            waiting.append((feature, size, pool))
    store()
    return reduce(DataFrame.unionByName, done)


def compare_windows(reference: DataFrame, windows: DataFrame, plan: WindowPlan, features: Sequence[str],
                    settings: DriftSettings, copies: int = 1, derive: Derive | None = None,
                    ) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Statistics of already numbered windows: (sampled methods, CUSUM, reference rows).

    ``copies`` says how many times the planned rows appear in ``windows``; ``derive`` adds their features where they lack them.
    """
    methods = known_methods(settings.methods)
    copies *= max(-(-plan.window // plan.stride), 1)
    sampled = [m for m in methods if m != "cusum"]
    moments = reference_facts(reference, features)
    n_ref = next((m[2] for m in moments.values()), 0)
    enough = large_enough(windows, settings.min_samples)
    stats = cusum = None
    if sampled:
        rows = n_ref + plan.rows * copies
        full = windows if derive is None else derive(windows)
        stats = compare_samples(reference, full, features, sampled, settings.psi_bins, rows, moments)
        stats = on_grid(stats, enough, features, n_ref)
    if "cusum" in methods:
        facts = profile_table(reference, profile_reference(reference, features, None, settings.psi_bins, moments))
        cusum = cusum_events(windows, features, facts, settings, plan.rows * copies, derive).join(enough, "k", "left_semi")
    return stats, cusum, n_ref


def drift_statistics(reference: DataFrame, target: DataFrame, settings: DriftSettings, derive: Derive | None = None,
                     ) -> tuple[DataFrame | None, DataFrame | None, WindowPlan, int] | None:
    """Per (window, feature) statistics: sampled methods, CUSUM, the windows, reference rows."""
    reference, full = (reference, target) if derive is None else (derive(reference), derive(target))
    features = resolve_features(reference, full, settings.features)
    tagged = windowed(target, settings)
    if tagged is None or not features:
        return None
    windows, plan = tagged
    stats, cusum, rows = compare_windows(reference, windows, plan, features, settings, derive=derive)
    return stats, cusum, plan, rows


def emit_events(stats: DataFrame | None, cusum: DataFrame | None, reference_rows: int,
                settings: DriftSettings) -> DataFrame:
    """Unrounded drift rows keyed by window number."""
    methods = known_methods(settings.methods)
    events = None
    if stats is not None:
        events = _emit(stats, [_sampled_event(m, settings) for m in methods if m != "cusum"])
    if cusum is not None:
        rows = _emit(cusum, [_event("cusum", F.col("cusum"), F.col("limit"),
                                    F.col("first_alarm").isNotNull(), F.col("effect"))])
        events = rows if events is None else events.unionByName(rows)
    if reference_rows < settings.min_samples:
        none = F.lit(None).cast("double")
        events = events.withColumns({"statistic": F.lit(0.0), "threshold": F.lit(float("nan")),
                                     "alert": F.lit(False), "p_value": none, "effect_size": none})
    return events


def drift_events(reference: DataFrame, target: DataFrame, settings: DriftSettings, derive: Derive | None = None) -> DataFrame:
    """The drift table: one row per (window, feature, method).

    ``derive`` adds features that follow from other columns of the same row, and saves shuffling them.
    """
    known_methods(settings.methods)
    found = drift_statistics(reference, target, settings, derive)
    if found is None:
        return target.sparkSession.createDataFrame([], EVENT_SCHEMA)
    stats, cusum, plan, n_ref = found
    events = emit_events(stats, cusum, n_ref, settings)
    return finish(events.withColumns(window_bounds(plan, F.col("k"))))


def _sampled_event(method: str, settings: DriftSettings) -> Column:
    if method == "ks":
        limit = F.when(F.col("usable"), ks_critical(settings.alpha, effective_size())).otherwise(1.0)
        return _event("ks", F.col("ks"), limit, F.col("ks") > limit, F.col("ks"),
                      F.when(F.col("usable"), ks_p_value(F.col("ks"), effective_size())))
    if method == "wasserstein":
        limit = F.lit(settings.wasserstein_threshold)
        return _event("wasserstein", F.col("wasserstein"), limit, F.col("scaled") > limit, F.col("scaled"))
    limit = F.lit(settings.psi_threshold)
    return _event("psi", F.col("psi"), limit, F.col("psi") > limit, F.col("psi"))


EVENT_SCHEMA = (
    "window_start timestamp_ntz, window_end timestamp_ntz, feature string, method string, "
    "statistic double, threshold double, alert boolean, p_value double, effect_size double, "
    "n_reference long, n_window long")


def finish(events: DataFrame) -> DataFrame:
    """Round and order the columns the way the table is stored."""
    return events.select(
        "window_start", "window_end", "feature", "method",
        F.round("statistic", 6).alias("statistic"), F.round("threshold", 6).alias("threshold"), "alert",
        significant(F.col("p_value")).alias("p_value"), F.round("effect_size", 6).alias("effect_size"),
        "n_reference", "n_window")


def require_events(events: DataFrame) -> DataFrame:
    """An empty drift table would read as 'no drift', so it is an error."""
    if events.isEmpty():
        raise ValueError("drift analysis produced no rows: no window reached the minimum sample count")
    return events


# The threshold settings of the sensitivity sweep.
SWEEP = [
    ("ks_alpha_0.001", "ks", 0.001), ("ks_alpha_0.01", "ks", 0.01), ("ks_alpha_0.05", "ks", 0.05),
    ("psi_0.10", "psi", 0.10), ("psi_0.20", "psi", 0.20), ("psi_0.50", "psi", 0.50),
    ("wasserstein_0.05", "wasserstein", 0.05), ("wasserstein_0.10", "wasserstein", 0.10),
    ("wasserstein_0.25", "wasserstein", 0.25),
    ("cusum_far_0.01", "cusum", 0.01), ("cusum_far_0.05", "cusum", 0.05), ("cusum_far_0.20", "cusum", 0.20),
]


def sweep(reference: DataFrame, target: DataFrame, settings: DriftSettings,
          grid: Sequence[tuple[str, str, float]] = tuple(SWEEP)) -> DataFrame:
    """Alerts per threshold setting. Statistics are computed once, thresholds are looked up.

    A KS distance is turned into the Kolmogorov variable, so one number per alpha serves
    every sample size. CUSUM settings name a false-alarm rate and get their own null table.
    """
    methods = [m for m in METHODS if any(g[1] == m for g in grid)]
    changed = replace(settings, methods=methods)
    found = drift_statistics(reference, target, changed)
    if found is None:
        raise ValueError("nothing to sweep: no window reached the minimum sample count")
    stats, cusum, _, _ = found
    spark = reference.sparkSession
    out = None
    if stats is not None:
        n = F.greatest(F.floor(F.coalesce(effective_size(), F.lit(0.0))).cast("double"), F.lit(1.0))
        shift = F.sqrt(n) * (1.0 + 1.0 / (4.0 * n))
        scores = {"ks": (F.col("ks") if "ks" in methods else None),
                  "wasserstein": F.col("scaled"), "psi": F.col("psi")}
        entries = [F.struct(F.lit(m).alias("method"), scores[m].alias("effect_size"),
                            (scores[m] * shift + 1.0 / (6.0 * F.sqrt(n)) - 1.0 / (4.0 * n) if m == "ks"
                             else scores[m]).alias("score")) for m in methods if m != "cusum"]
        rows = [(name, m, kolmogorov_quantile(v) if m == "ks" else float(v)) for name, m, v in grid if m != "cusum"]
        table = spark.createDataFrame(rows, "variant string, method string, value double")
        out = threshold_counts(stats.select(F.inline(F.array(*entries))).join(F.broadcast(table), "method"))
    if cusum is not None:
        parts = None
        for name, m, rate in grid:
            if m == "cusum":
                null = cu.null_thresholds(cusum.select("n_sequence"), settings.cusum_drift, settings.cusum_warmup,
                                          rate, seed=settings.cusum_seed).withColumnRenamed("threshold", "value")
                part = null.withColumn("variant", F.lit(name))
                parts = part if parts is None else parts.unionByName(part)
        rows = cusum.select("n_sequence", F.col("cusum").alias("score"), F.col("effect").alias("effect_size"))
        counted = threshold_counts(rows.join(parts, "n_sequence"))
        out = counted if out is None else out.unionByName(counted)
    return out


def threshold_counts(scored: DataFrame) -> DataFrame:
    hit = F.col("score") > F.col("value")
    return scored.groupBy("variant").agg(
        F.count_if(hit).alias("alerts"), F.count("*").alias("comparisons"),
        F.round(F.avg(hit.cast("int")), 6).alias("alert_rate"),
        F.round(F.avg(F.abs("effect_size")), 6).alias("mean_effect_size"))
