"""Controlled shifts: table-to-table changes of one property, labels and time untouched."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import rate
from tidewatch.functions.hashing import digest, normal, uniform
from tidewatch.operators.sampling import take_smallest

# Shift names, their default magnitudes and the telemetry a reduced collector drops.
KINDS = ("packet_size", "duration", "packet_rate", "byte_rate", "iat", "protocol_mixture",
         "class_prevalence", "telemetry_reduction")
DEFAULT_MAGNITUDES = {
    "packet_size": (1.5, 3.0), "duration": (1.5, 3.0), "packet_rate": (1.5, 3.0), "iat": (1.5, 3.0),
    "byte_rate": (1.5, 3.0), "protocol_mixture": (3.0,), "class_prevalence": (0.05, 0.30),
    "telemetry_reduction": (0.0,),
}
REDUCED = ["tcp_flags", "tos", "forward_packets", "backward_packets", "forward_bytes", "backward_bytes"]
JITTER = 0.02
BROADCAST_LEVELS = 100_000


def log_scaled(value: Column, factor: float, keys: Sequence[str], salt: str) -> Column:
    """Scale a non-negative measure in log space with a little key-seeded jitter."""
    if factor == 1.0:
        return value
    noise = F.lit(JITTER) * normal(digest(keys, salt))
    return F.expm1(F.log1p(F.greatest(value, F.lit(0.0))) + F.lit(math.log(factor)) + noise)


def apply_shift(df: DataFrame, kind: str, magnitude: float, keys: Sequence[str], seed: int = 42,
                label: str = "label") -> DataFrame:
    """One shift as a lazy projection (or an exact thinning, for the class rate).

    ``magnitude`` is a factor for the scale shifts, a skew for the mixture and a target
    attack fraction for the prevalence.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown shift {kind!r}; choose from {KINDS}")

    def scaled(name: str, salt: str | None = None) -> Column:
        return log_scaled(F.col(name), magnitude, keys, f"{seed}:{salt or name}")

    if kind == "packet_size":
        size = df.withColumn("total_bytes", scaled("total_bytes"))
        per_packet = F.when(F.col("total_packets") != 0, F.col("total_bytes") / F.col("total_packets")).otherwise(0.0)
        return size.withColumns({
            "bytes_per_packet": per_packet, "mean_packet_size": per_packet,
            "bytes_log1p": F.log1p(F.greatest("total_bytes", F.lit(0.0))),
            "byte_rate": rate(F.col("total_bytes"), F.col("flow_duration"))})
    if kind == "duration":
        longer = df.withColumn("flow_duration", scaled("flow_duration"))
        return longer.withColumn("duration_log1p", F.log1p(F.greatest("flow_duration", F.lit(0.0))))
    if kind == "packet_rate":
        return df.withColumns({"packet_rate": scaled("packet_rate"), "byte_rate": scaled("byte_rate")})
    if kind == "byte_rate":
        return df.withColumn("byte_rate", scaled("byte_rate"))
    if kind == "iat":
        factor = log_scaled(F.lit(1.0), magnitude, keys, f"{seed}:iat")
        return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * factor
                               for c in ("packet_rate", "byte_rate") if c in df.columns})
    if kind == "protocol_mixture":
        return _remix(df, magnitude, keys, seed)
    if kind == "class_prevalence":
        return _thin(df, magnitude, keys, seed, label)
    return df.drop(*[c for c in REDUCED if c in df.columns])


def _remix(df: DataFrame, magnitude: float, keys: Sequence[str], seed: int) -> DataFrame:
    """Redraw the protocol from its sorted levels, the first weighted by ``magnitude``."""
    if "protocol" not in df.columns:
        raise KeyError("the mixture shift needs a protocol column")
    # A table of levels with the upper bound of each level's share of the draw, in order. The bounds of
    # all but the first level are equally spaced, so a draw finds its level by number.
    levels = df.select(F.col("protocol").cast("string").alias("_level")).distinct()
    levels = levels.withColumn("_number", F.row_number().over(Window.orderBy("_level")) - 1)
    count = levels.count()
    if count < 2:
        raise ValueError("the mixture shift needs at least two protocols")
    total = magnitude + count - 1
    first, each = magnitude / total, 1.0 / total
    draw = F.col("_draw")
    number = F.when(draw < first, 0).otherwise(
        F.least(F.floor((draw - first) / each).cast("int") + 1, F.lit(count - 1)))
    drawn = df.withColumn("_draw", uniform(digest(keys, f"{seed}:protocol"))).withColumn("_number", number)
    if count <= BROADCAST_LEVELS:
        levels = F.broadcast(levels)
    out = drawn.join(levels, "_number")
    return out.select(*[F.col("_level").alias("protocol") if c == "protocol" else F.col(c) for c in df.columns])


def prevalence_quota(attacks: int, benign: int, target: float) -> tuple[int, int]:
    """(attacks, benign) to keep for a target attack rate; no row is invented."""
    if attacks == 0 or benign == 0:
        raise ValueError("the prevalence shift needs both classes")
    if not 0.0 < target < 1.0:
        raise ValueError("the target attack rate must lie in (0, 1)")
    if target <= attacks / (attacks + benign):
        return min(max(round(target / (1.0 - target) * benign), 1), attacks), benign
    return attacks, max(1, min(round(attacks * (1.0 - target) / target), benign))


def _thin(df: DataFrame, target: float, keys: Sequence[str], seed: int, label: str) -> DataFrame:
    attacks, benign = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    keep_attacks, keep_benign = prevalence_quota(attacks, benign, float(target))
    quotas = df.sparkSession.createDataFrame([(1, keep_attacks), (0, keep_benign)], f"{label} int, quota long")
    hashed = df.withColumn("_hash", digest(keys, f"{seed}:prevalence"))
    return take_smallest(hashed, [label], "_hash", quotas, keys).drop("_hash")


def catalogue(magnitudes: dict[str, Sequence[float]] | None = None) -> list[tuple[str, float]]:
    """Every (kind, magnitude) to run, kinds in their fixed order."""
    chosen = DEFAULT_MAGNITUDES if magnitudes is None else magnitudes
    return [(kind, float(m)) for kind in KINDS for m in chosen.get(kind, ())]
