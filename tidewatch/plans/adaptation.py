"""Adaptation strategies under a fixed false-positive budget, blind to the scored period."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import from_micros, micros
from tidewatch.operators import metrics
from tidewatch.operators.split import require_no_later_rows
from tidewatch.operators.windows import HOUR
from tidewatch.plans.experiment import PARALLEL, Bench, METRIC_SCHEMA, ModelRun, at_once, evaluate, rows_frame, score_table
from tidewatch.plans.models import FittedModel
from tidewatch.schema import LABEL, TIME
from tidewatch.session import materialize

# Strategy names.
STRATEGIES = ("none", "threshold_recalibration", "recent_window_retrain", "rolling_window_retrain",
              "historical_plus_recent_retrain")
STEPS_PER_WRITE = 25


class AdaptationStudyError(RuntimeError):
    """A strategy could not run, so the comparison would be incomplete."""


@dataclass(frozen=True)
class Adapted:
    strategy: str
    scores: DataFrame
    threshold: float
    rows_used: int
    training_seconds: float
    refits: int


def recent_history(bench: Bench, window_us: int | None, before: str = "forward") -> DataFrame:
    """Rows in the window right before a period starts."""
    first = bench.period(before).agg(F.min(micros(F.col(TIME)))).first()[0]
    kind = bench.data.schema[TIME].dataType
    out = bench.data.where(F.col(TIME) < from_micros(F.lit(first)).cast(kind))
    return out if not window_us else out.where(F.col(TIME) >= from_micros(F.lit(first - window_us)).cast(kind))


def adapt(bench: Bench, run: ModelRun, strategy: str, history: DataFrame, scored: DataFrame,
          window_us: int | None, step_us: int = HOUR) -> Adapted:
    """Scores and threshold of one strategy for the rows in ``scored``."""
    if strategy not in STRATEGIES:
        raise KeyError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    if strategy == "none":
        return Adapted(strategy, score_table(run.model, scored), run.threshold, 0, 0.0, 0)
    start = scored.agg(F.min(TIME).cast("string")).first()[0]
    require_no_later_rows(history, start, f"history of {strategy}")
    if strategy == "threshold_recalibration":
        limit = metrics.threshold_for_budget(score_table(run.model, history), bench.budget)
        return Adapted(strategy, score_table(run.model, scored), limit, history.count(), 0.0, 0)
    training = history
    if strategy == "historical_plus_recent_retrain":
        training = bench.period("train").unionByName(history)
    model = bench.fit(run.name, training)
    limit = metrics.threshold_for_budget(score_table(model, history), bench.budget)
    if strategy != "rolling_window_retrain":
        return Adapted(strategy, score_table(model, scored), limit, model.rows, model.seconds, 1)
    scores, refits, seconds, used = rolling_scores(bench, run.name, scored, step_us, window_us)
    return Adapted(strategy, scores, limit, used, model.seconds + seconds, refits + 1)


def rolling_scores(bench: Bench, name: str, scored: DataFrame, step_us: int, window_us: int | None,
                   ) -> tuple[DataFrame, int, float, int]:
    """Refit before every step on train plus the last window, score only that step.

    One pass counts the rows of every step; empty steps are skipped. A step without any history keeps score 0. No step needs
    another one's model, so ``PARALLEL`` of them are fitted at a time, on one stored table of the columns that models read.
    Scores are written every few steps so the plan stays short however long the period is.
    """
    spark = bench.data.sparkSession
    kind = bench.data.schema[TIME].dataType
    inputs = [*bench.features.numeric, *bench.features.categorical]
    data = materialize(bench.data.select(TIME, LABEL, *inputs))
    scored = scored.select(TIME, LABEL, *inputs)
    us = micros(F.col(TIME))
    low = scored.agg(F.min(us)).first()[0]
    steps = [r[0] for r in scored.groupBy(F.floor((us - low) / F.lit(step_us)).alias("s")).agg(
        F.count("*")).orderBy("s").collect()]

    def rows(df, a, b):
        out = df.where(F.col(TIME) < from_micros(F.lit(b)).cast(kind))
        return out if a is None else out.where(F.col(TIME) >= from_micros(F.lit(a)).cast(kind))

    train = bench.cuts.period(data, "train")

    def fitted(s: int) -> FittedModel | None:
        start = low + s * step_us
        known = rows(data, None if window_us is None else start - window_us, start)
        return None if known.isEmpty() else bench.fit(name, train.unionByName(known))

    done, models = [], []
    with ThreadPoolExecutor(PARALLEL) as pool:
        for first in range(0, len(steps), STEPS_PER_WRITE):
            some, pending = steps[first:first + STEPS_PER_WRITE], []
            for s, model in zip(some, pool.map(inheritable_thread_target(spark)(fitted), some)):
                batch = rows(scored, low + s * step_us, low + (s + 1) * step_us)
                if model is None:
                    pending.append(batch.select(TIME, F.col(LABEL).alias("y_true"), F.lit(0.0).alias("y_score")))
                else:
                    models.append(model)
                    pending.append(score_table(model, batch))
            last = first + STEPS_PER_WRITE >= len(steps)
            part = reduce(DataFrame.unionByName, pending)
            done.append(part if last else materialize(part))
    return reduce(DataFrame.unionByName, done), len(models), sum(m.seconds for m in models), models[-1].rows if models else 0


STUDY_SCHEMA = ("model string, strategy string, threshold double, rows_used long, training_seconds double, refits long, "
                "f1_gain double, f1_recovery_pct double, recall_gain double, recall_recovery_pct double, "
                "precision_gain double, precision_recovery_pct double, false_positive_rate_gain double, "
                "false_positive_rate_recovery_pct double, " + METRIC_SCHEMA)


def recovery(before: dict, after: dict, backtest: dict) -> dict[str, float | None]:
    """Gain over not adapting, and the share of the backtest-to-forward loss recovered."""
    out = {}
    for c in ("f1", "recall", "precision", "false_positive_rate"):
        lost = backtest[c] - before[c]
        out[f"{c}_gain"] = after[c] - before[c]
        out[f"{c}_recovery_pct"] = 100.0 * (after[c] - before[c]) / lost if lost else None
    return out


def study(bench: Bench, run: ModelRun, window_us: int | None = 6 * HOUR, step_us: int = HOUR,
          rolling_window_us: int | None = None, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Every strategy on the forward period, one row each; any failure fails the study."""
    history, forward = recent_history(bench, window_us), bench.period("forward")
    by_period = {r.period: r.asDict() for r in run.metrics.collect()}

    def studied(strategy: str) -> dict | str:
        window = rolling_window_us or window_us if strategy == "rolling_window_retrain" else window_us
        try:
            done = adapt(bench, run, strategy, history, forward, window, step_us)
            found = evaluate(done.scores, done.threshold)
        except Exception as error:
            return f"{run.name}/{strategy}: {type(error).__name__}: {str(error)[:300]}"
        return {"model": run.name, "strategy": strategy, "threshold": done.threshold,
                "rows_used": done.rows_used, "training_seconds": done.training_seconds, "refits": done.refits,
                **found, **recovery(by_period["forward"], found, by_period["backtest"])}

    made = at_once(bench.data.sparkSession, [lambda s=s: studied(s) for s in strategies])
    rows, failed = [r for r in made if isinstance(r, dict)], [r for r in made if isinstance(r, str)]
    if failed:
        raise AdaptationStudyError("strategies failed:\n  " + "\n  ".join(failed))
    return rows_frame(bench.data.sparkSession, rows, STUDY_SCHEMA)
