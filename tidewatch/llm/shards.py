"""Minimax contiguous shards of atomic groups.

Groups are equal texts. They are ordered by a 64-bit hash of the text; a shard is a contiguous
range of that order, so equal texts never part and placing a row is one comparison with the
23 cuts: no join, no sort of the corpus, and a group of any size is one point of the order.

The smallest feasible capacity is found by binary search with a greedy check: fill a shard as
long as the next group fits. The check needs prefix sums only where shards can end, so sums are
kept for ranges of the hash (leading bits), and only ranges that can hold a cut are resolved
further, level by level, until the lower and the upper bound of the capacity meet. The driver
sees a bounded number of ranges per level, never groups. With capacity C fixed, each cut is moved
to the place nearest to its even share that keeps all shards within C, since the greedy fill
alone would leave the last shard short.

Defined results: a null text has 0 bytes and is grouped with the empty text; repeated rows are
rows of their own; an empty table gives no rows; fewer groups than shards leave shards empty;
other columns pass through in the pipeline and are ignored by the query.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import whole

ROW_OVERHEAD = 8
FIRST_BITS, MORE_BITS = 12, 8
ROWS_PER_SLOT_RANGE = 200_000


def size_of(text: str = "text") -> Column:
    return F.octet_length(whole(text)).cast("bigint") + ROW_OVERHEAD


class _Sums:
    """Prefix sums at known hash positions; ``open`` ranges may hold more groups inside."""

    def __init__(self) -> None:
        self.at, self.sum, self.open, self.bits = [0], [0], [], {}

    @classmethod
    def of(cls, parts: list[tuple[int, int, int, int]]) -> "_Sums":
        """parts: (start, width in bits left, bytes, groups up to 2) in order of start."""
        out = cls()
        out.at, out.sum, out.open = [], [0], []
        for start, left, size, groups in parts:
            out.at.append((start, left))
            out.sum.append(out.sum[-1] + size)
            out.open.append(left > 0 and groups > 1)
        return out

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Ends (prefix sums) of greedy shards, or None. hopeful: cuts inside open ranges are allowed."""
        ends, done, total = [], 0, self.sum[-1]
        for _ in range(shards):
            k = bisect_right(self.sum, done + capacity) - 1
            end = self.sum[k]
            if hopeful and k < len(self.open) and self.open[k]:
                end = done + capacity
            if end <= done:
                return None
            ends.append(end)
            done = end
            if done >= total:
                return ends
        return None


def _smallest(sums: _Sums, shards: int, hopeful: bool) -> int:
    low, high = max(1, -(-sums.sum[-1] // shards)), max(1, sums.sum[-1])
    while low < high:
        mid = (low + high) // 2
        if sums.greedy(mid, shards, hopeful) is None:
            low = mid + 1
        else:
            high = mid
    return low


def find_cuts(sizes: DataFrame, shards: int) -> list[int]:
    """The first hash of each shard but the first, as unsigned 64-bit positions.

    ``sizes`` has ``h`` (signed 64-bit hash of the group) and ``size``, one row for each document.
    """
    def ranges(bits: int, inside: list[tuple[int, int]] | None) -> dict[int, list]:
        part = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
        rows = sizes
        if inside is not None:
            old = inside[0][1]
            kept = F.shiftrightunsigned("h", 64 - old) if old else F.lit(0)
            rows = rows.where(kept.isin([p for p, _ in inside]))
        got = rows.groupBy(part.alias("p")).agg(
            F.sum("size").alias("s"), F.min("h").alias("a"), F.max("h").alias("b")).collect()
        out: dict[int, list] = {}
        for r in got:
            p = r["p"] % (1 << 64)
            key = p >> (bits - inside[0][1]) if inside is not None else -1
            out.setdefault(key, []).append((p << (64 - bits), 64 - bits, r["s"], 2 if r["a"] != r["b"] else 1))
        return out

    # Leading bits come out of a logical shift, so parts are unsigned and ordered.
    parts = sorted(ranges(FIRST_BITS, None).get(-1, []))
    if not parts:
        return []
    bits = FIRST_BITS
    while True:
        sums = _Sums.of(parts)
        high, low = _smallest(sums, shards, False), _smallest(sums, shards, True)
        doubtful: set[int] = set()
        ends_high, ends_low = sums.greedy(high, shards, False), sums.greedy(low, shards, True)
        if high > low:
            # Where any capacity between the bounds can end a shard.
            ends_low = ends_low + [sums.sum[-1]] * (len(ends_high) - len(ends_low))
            for k in range(len(ends_high)):
                a = min(ends_high[k], ends_low[k], sums.greedy(low, shards, True)[min(k, len(ends_low) - 1)])
                b = max(ends_high[k], ends_low[k])
                first, last = bisect_right(sums.sum, a) - 1, bisect_left(sums.sum, b)
                doubtful |= {i for i in range(max(first - 1, 0), min(last + 1, len(parts))) if sums.open[i]}
        total = sums.sum[-1]
        for k in range(1, shards):  # and where the even shares lie
            i = bisect_right(sums.sum, total * k // shards) - 1
            if i < len(parts) and sums.open[i] and parts[i][2] * 1000 * shards > total:
                doubtful.add(i)
        if not doubtful:
            break
        widest = max(parts[i][1] for i in doubtful)
        chosen = [i for i in doubtful if parts[i][1] == widest]
        bits = 64 - widest
        wider = min(64, bits + MORE_BITS)
        signed = lambda x: x - (1 << 64) if bits == 64 and x >= 1 << 63 else x
        finer = ranges(wider, [(signed(parts[i][0] >> widest), bits) for i in chosen])
        gone = set(chosen)
        parts = sorted([p for i, p in enumerate(parts) if i not in gone] + [p for ps in finer.values() for p in ps])
    # Capacity is settled; move the cuts towards even shares.
    latest = sums.greedy(high, shards, False)
    latest += [sums.sum[-1]] * (shards - len(latest))
    earliest, rest = [0] * shards, sums.sum[-1]
    for k in range(shards - 1, 0, -1):
        rest = sums.sum[bisect_left(sums.sum, max(0, rest - high))]
        earliest[k - 1] = rest
    cuts, done = [], 0
    for k in range(shards - 1):
        low_end, high_end = min(earliest[k], latest[k]), max(done, sums.sum[bisect_right(sums.sum, done + high) - 1])
        share = done + (sums.sum[-1] - done) // (shards - k)
        i = bisect_left(sums.sum, share)
        near = [s for s in sums.sum[max(0, i - 1): i + 1] if max(low_end, done) <= s <= high_end]
        done = min(near, key=lambda s: abs(s - share)) if near else min(max(low_end, done), high_end) if share < low_end else high_end
        j = bisect_left(sums.sum, done)
        cuts.append(parts[j][0] if j < len(parts) else 1 << 64)
    return cuts


def placed(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` as struct ``row`` with doc_id, h, size, text_crc32, shard and slot."""
    text = whole()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text).alias("h"), size_of().alias("size"),
                       F.crc32(text).cast("bigint").alias("text_crc32"))
    # Cuts as signed positions of the same order: flipping the top bit maps unsigned onto signed.
    cuts = find_cuts(rows.select("h", "size"), shards)
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.lit(0)
    for cut in cuts:
        if cut < 1 << 64:
            shard = shard + (order >= F.lit(cut - (1 << 63))).cast("int")
        # a cut past the end leaves the later shards empty
    return with_slots(rows.withColumn("shard", shard.cast("int")))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows of a shard fall into ranges of a hash of the row; ranges are counted (a small table, a row
    for about 200,000 documents), and only the numbering inside a range sorts rows.
    """
    n = rows.select("shard").count()
    pieces = max(1, n // ROWS_PER_SLOT_RANGE)
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(pieces)))
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "h", "size", "text_crc32")
    numbered = rows.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "piece"]).withColumn(
        "slot", (F.col("start") + F.col("within")).cast("bigint")).drop("start", "within", "piece")
