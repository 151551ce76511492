"""Sweeps that change one choice at a time; every result is a row of one sparse table."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import drift, metrics, sampling
from tidewatch.operators.preprocess import fit_features
from tidewatch.operators.windows import HOUR
from tidewatch.plans.adaptation import adapt, recent_history, recovery
from tidewatch.plans.experiment import Bench, at_once, evaluate, held, rows_frame, run_model, score_table
from tidewatch.schema import LABEL

RECORD = ("ablation string, variant string, model string, f1 double, precision double, recall double, "
          "false_positive_rate double, roc_auc double, pr_auc double, train_rows long, eval_rows long, n_features long, "
          "dropped array<string>, history_rows long, threshold double, f1_gain double, f1_recovery_pct double, "
          "target_fpr double, achieved_fpr double, alerts long, comparisons long, alert_rate double, "
          "mean_effect_size double, note string, seconds double")


class AblationError(RuntimeError):
    """A sweep could not run, so the table would be incomplete."""


def _fit_and_score(bench: Bench, model: str, numeric: Sequence[str], train: DataFrame, rows: DataFrame,
                   cutoff: str | None) -> dict:
    """Fit on some columns and judge at the threshold the evaluated rows themselves imply."""
    fitted = fit_features(train, numeric, cutoff=cutoff)
    with held(score_table(bench.fit(model, train, fitted), rows)) as scored:
        return evaluate(scored, metrics.threshold_for_budget(scored, bench.budget))


def split_mode(bench: Bench, model: str, keys: Sequence[str]) -> list[dict]:
    """Temporal split against a stratified random split of the same rows."""
    numeric = schema.flow_features(bench.data, "number")
    cutoff = bench.cuts.bounds("train")[1]
    forward = bench.period("forward")
    arms = sampling.stratified_halves(bench.data, LABEL, keys, 0.5, bench.seed)
    train = arms.where(F.col("arm") == "train").drop("arm")
    rest = arms.where(F.col("arm") == "rest").drop("arm")
    held_out = sampling.random_rows(rest, forward.count(), keys, bench.seed + 1)
    made = at_once(bench.data.sparkSession, [lambda: _fit_and_score(bench, model, numeric, bench.period("train"), forward, cutoff),
                                             lambda: _fit_and_score(bench, model, numeric, train, held_out, None)])
    return [{"variant": v, **row, "eval_rows": row["row_count"]} for v, row in zip(("temporal", "random"), made)]


def feature_policy(bench: Bench, model: str, keys: Sequence[str]) -> list[dict]:
    """All features against the metadata-only ones; a single row where nothing is to drop."""
    rich = [c for c in schema.PAYLOAD_FEATURES if c in bench.data.columns]
    numeric = schema.flow_features(bench.data, "number")
    train, forward, cutoff = bench.period("train"), bench.period("forward"), bench.cuts.bounds("train")[1]
    arms = [("full_metadata", numeric + rich, []), ("restricted_metadata", numeric, rich)] if rich else [
        ("not_applicable", numeric, [])]
    made = at_once(bench.data.sparkSession, [lambda c=c: _fit_and_score(bench, model, c, train, forward, cutoff) for _, c, _ in arms])
    return [{"variant": v, "n_features": len(c), "dropped": d, **row} for (v, c, d), row in zip(arms, made)]


def drift_threshold(bench: Bench, model: str, keys: Sequence[str], settings: drift.DriftSettings) -> list[dict]:
    """Alerts per threshold setting; statistics are computed once for all settings."""
    found = drift.sweep(bench.period("train"), bench.period("forward"), settings)
    return [r.asDict() for r in found.collect()]


def adaptation_window(bench: Bench, model: str, keys: Sequence[str],
                      hours: Sequence[int] = (1, 3, 6, 12)) -> list[dict]:
    """Recent-window retraining with growing windows; windows of a single class are skipped."""
    run = run_model(bench, model)
    at = {r.period: r.asDict() for r in run.metrics.collect()}

    def adapted(h: int) -> list[dict]:
        history = recent_history(bench, h * HOUR)
        size, classes = history.agg(F.count("*"), F.count_distinct(LABEL)).first()
        if classes < 2:
            return []
        done = adapt(bench, run, "recent_window_retrain", history, bench.period("forward"), h * HOUR)
        found = evaluate(done.scores, done.threshold)
        return [{"variant": f"recent_{h}h", "history_rows": size, "threshold": done.threshold, **found,
                 **recovery(at["forward"], found, at["backtest"])}]

    made = at_once(bench.data.sparkSession, [lambda h=h: adapted(h) for h in hours])
    return [{"variant": "none", **at["forward"]}, *(row for some in made for row in some)]


def telemetry_family(bench: Bench, model: str, keys: Sequence[str]) -> list[dict]:
    """Leave one feature family out at a time."""
    numeric = schema.flow_features(bench.data, "number")
    train, forward, cutoff = bench.period("train"), bench.period("forward"), bench.cuts.bounds("train")[1]
    arms = [(family, members, [c for c in numeric if c not in members]) for family, members in schema.TELEMETRY_FAMILIES.items()]
    arms = [arm for arm in arms if 0 < len(arm[2]) < len(numeric)]
    made = at_once(bench.data.sparkSession, [lambda kept=kept: _fit_and_score(bench, model, kept, train, forward, cutoff) for *_, kept in arms])
    return [{"variant": f"without_{family}", "dropped": [c for c in members if c in numeric], "n_features": len(kept), **row}
            for (family, members, kept), row in zip(arms, made)]


def target_fpr(bench: Bench, model: str, keys: Sequence[str]) -> list[dict]:
    """What each false-positive budget costs; one fit, one pass over the scores."""
    numeric = schema.flow_features(bench.data, "number")
    fitted = fit_features(bench.period("train"), numeric, cutoff=bench.cuts.bounds("train")[1])
    with held(score_table(bench.fit(model, bench.period("train"), fitted), bench.period("forward"))) as scored:
        found = metrics.budget_sweep(scored).orderBy("target_fpr").collect()
    return [{**r.asDict(), "variant": f"fpr_{r.target_fpr}"} for r in found]


ABLATIONS: dict[str, Callable[..., list[dict]]] = {
    "split_mode": split_mode, "feature_policy": feature_policy, "drift_threshold": drift_threshold,
    "adaptation_window": adaptation_window, "telemetry_family": telemetry_family, "target_fpr": target_fpr,
}


def run_ablations(bench: Bench, models: Sequence[str], keys: Sequence[str], names: Sequence[str] | None = None,
                  drift_settings: drift.DriftSettings | None = None) -> DataFrame:
    """All sweeps for all models; the others end first, then any failure fails the table."""
    for name in names or ABLATIONS:
        if name not in ABLATIONS:
            raise KeyError(f"unknown ablation {name!r}; known: {sorted(ABLATIONS)}")

    def swept(model: str, name: str) -> list[dict] | str:
        extra = {"settings": drift_settings or drift.DriftSettings(methods=drift.METHODS)} if name == "drift_threshold" else {}
        start = time.perf_counter()
        try:
            made = ABLATIONS[name](bench, model, keys, **extra)
        except Exception as error:
            return f"{model}/{name}: {type(error).__name__}: {str(error)[:300]}"
        for row in made:
            row.update(ablation=name, model=model, seconds=time.perf_counter() - start)
        return made

    tasks = [lambda m=m, n=n: swept(m, n) for m in models for n in names or ABLATIONS]
    done = at_once(bench.data.sparkSession, tasks)
    failed = [some for some in done if isinstance(some, str)]
    if failed:
        raise AblationError("sweeps failed:\n  " + "\n  ".join(failed))
    return rows_frame(bench.data.sparkSession, [row for some in done for row in some], RECORD)
