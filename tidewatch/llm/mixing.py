"""Temperature mixing of sources.

A source with token share p gets the weight p^tau / sum(p^tau). tau = 1 keeps the corpus as it is,
tau = 0 makes all sources equal. tau is bisected to meet a target: either a target entropy of
the weights (bits, as a share of the maximum), or a limit on how often a source may be repeated. The
total budget is the smallest one at which every source is used at least once in full, so the
mix drops no document: a source is passed over budget / tokens >= 1 times.

Budgets are realised as block permutations. Documents of a source fall into blocks by hash; each
pass visits the blocks in a new pseudo-random order, full passes take all, and the last pass takes
whole blocks until the budget is used, splitting the one block that crosses it by document. Only
that block is sorted; blocks are a table of one row for about 20,000 documents.

Defined results: a null source is a source of its own; a null or empty text has no tokens and
comes once with each pass; a source without tokens is passed once; repeated rows are
documents of their own; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import whole
from tidewatch.session import materialize

DOCS_PER_BLOCK = 20_000
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Target:
    """Give one: ``entropy`` as a share of log2(sources), or ``max_passes`` over any source."""
    entropy: float | None = None
    max_passes: float | None = 2.0
    rounds: int = 6
    seed: int = 17


def tokens_of(text: str = "text") -> Column:
    """Words of the text; the unit in which budgets are kept."""
    return F.regexp_count(whole(text), F.lit("[^ \\t-\\r]+")).cast("bigint")


def _meets(totals: DataFrame, target: Target, taus: list[float]) -> list[bool]:
    """Whether the mix at each exponent meets the target, from one aggregate over the sources."""
    p = F.col("tokens") / F.col("all_tokens")
    cells = [F.count("*").alias("n")]
    for i, tau in enumerate(taus):
        w = F.pow(p, F.lit(tau))
        cells += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log2(w)).alias(f"l{i}"),
                  F.max(w / p).alias(f"a{i}"), F.min(w / p).alias(f"b{i}")]
    r = totals.where("tokens > 0").agg(*cells).first()
    if r["n"] < 2:
        return [True] * len(taus)
    if target.entropy is not None:
        return [log2(r[f"z{i}"]) - r[f"l{i}"] / r[f"z{i}"] >= target.entropy * log2(r["n"]) for i in range(len(taus))]
    return [r[f"a{i}"] <= target.max_passes * r[f"b{i}"] for i in range(len(taus))]


def exponent(totals: DataFrame, target: Target) -> float:
    """The tau in [0, 1] that meets the target, by bisection, four halvings for each Spark job.

    Evenness and passes both fall as tau rises: an entropy target takes the highest tau that is
    even enough, a limit of passes the lowest tau that keeps it.
    """
    high_wanted = target.entropy is not None
    at_zero, at_one = _meets(totals, target, [0.0, 1.0])
    if high_wanted and (at_one or not at_zero):
        return 1.0 if at_one else 0.0
    if not high_wanted and at_zero:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(target.rounds):
        taus = [low + (high - low) * k / 16 for k in range(1, 16)]
        known = dict(zip(range(1, 16), _meets(totals, target, taus)))
        a, b = 0, 16
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if known[mid] == high_wanted else (a, mid)
        low, high = low + (high - low) * a / 16, low + (high - low) * b / 16
    return low if high_wanted else high


def plan(docs: DataFrame, target: Target = Target()) -> tuple[DataFrame, DataFrame, float]:
    """(rows, blocks, tau): documents with their block, and each block's share of the budget.

    rows has struct ``row``, doc_id, h, source, block; blocks has (source, block, passes, full_copies,
    left), where ``left`` is the budget inside the one block that is used in part.
    """
    key = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(whole()).alias("h"), key.alias("source"))
    pieces = max(1, docs.select("doc_id").count() // DOCS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(target.seed)), F.lit(pieces)))
    blocks = materialize(rows.groupBy("source", "block").agg(F.sum(tokens_of()).alias("tokens"), F.count("*").alias("docs")))
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = materialize(totals.withColumn("all_tokens", F.lit(all_tokens).cast("bigint")))
    tau = exponent(totals, target)
    lift = F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(tau - 1))
    least = totals.where("tokens > 0").agg(F.min(lift)).first()[0] or 1.0
    budgets = totals.select("source", F.when(F.col("tokens") > 0, lift / F.lit(least)).otherwise(F.lit(1.0)).alias("passes"),
                            F.col("tokens").alias("source_tokens"))
    # A last pass of under a millionth of the source is rounding, not budget.
    budgets = budgets.withColumn("whole_passes", F.floor(F.col("passes") + 1e-6)).withColumn(
        "rest", F.round(F.greatest(F.col("passes") - F.col("whole_passes"), F.lit(0.0)) * F.col("source_tokens")).cast("bigint"))
    blocks = blocks.join(budgets, "source")
    turn = Window.partitionBy("source").orderBy(F.xxhash64("block", "whole_passes", F.lit(target.seed)), "block")
    done = F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("done", done).withColumn("turn", F.row_number().over(turn)).select(
        "source", "block", "passes", "turn", (F.col("whole_passes") + (F.col("done") <= F.col("rest")).cast("bigint")).alias("copies"),
        F.when((F.col("done") > F.col("rest")) & (F.col("done") - F.col("tokens") < F.col("rest")),
               F.col("rest") - F.col("done") + F.col("tokens")).alias("left"))
    return rows, materialize(blocks), tau


def mixed(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """A row for each use of a document: struct ``row``, doc_id, source, tokens, copy, copies, mix_order.

    Sorting by ``mix_order`` in [0, 1) interleaves the sources in their target proportions.
    """
    rows, blocks, _ = plan(docs, target)
    # A row for each source and about 20,000 documents; hot sources are split by Spark's skew handling.
    if blocks.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    rows = rows.join(blocks, ["source", "block"]).withColumn("tokens", tokens_of())
    settled = rows.where("left IS NULL")
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", "h", "copies", F.lit(target.seed)), "doc_id")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = rows.where("left IS NOT NULL").withColumn("before", before).withColumn(
        "copies", F.col("copies") + (F.col("before") < F.col("left")).cast("bigint")).drop("before")
    uses = settled.unionByName(split).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    jitter = F.pmod(F.xxhash64("doc_id", "h", "copy", "block", F.lit(target.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return uses.withColumn("mix_order", (F.col("copy") + jitter * F.greatest(
        F.least(F.col("passes") - F.col("copy"), F.lit(1.0)), F.lit(0.0))) / F.col("passes")).drop(
        "left", "turn", "text")
