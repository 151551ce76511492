"""From band keys to bounded groups of candidates, and links found inside them.

A bucket (all texts with one band key) may hold any share of the corpus. Buckets are streamed in key
order, numbered, and cut into blocks of bounded size; a task sees one pair of blocks at a time.
Links leave a task as a star (each text with the smallest text it is connected to), so the
rows grow with the members of a bucket, not with its pairs.

Pieces of documents have many keys, most of them held by one piece only. Their keys are shuffled packed: ten bytes
for 42 bits of the key, 40 of the piece's fingerprint (``short``) and its size class. Keys or shorts that
agree by chance only add candidates, as all candidates are verified by their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import shingles as sh
from tidewatch.llm.components import components

BROADCAST_ROWS = 1_000_000
PARTS = 1024
CLASSES = 24  # size classes between a size and its e-fold
HELD, MANY = 4_000_000, 256
SKETCH = 256  # bits of the smallest sketch


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it has been counted to be small; joins shuffle otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid) sorted by both -> members of keys with two texts or more, numbered from 0."""
    key = uid = None      # the last row, held back until its successor is known
    at, paired = 0, False
    for batch in batches:
        k, u = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if key is not None:
            k, u = np.r_[key, k], np.r_[uid, u]
        new = np.r_[True, (k[1:] != k[:-1]) | (u[1:] != u[:-1])]  # repeated rows count once
        k, u = k[new], u[new]
        first = np.r_[True, k[1:] != k[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        pos = np.arange(len(k)) - start
        before = ~first
        if key is not None:
            pos[start == 0] += at
            before[0] = paired
        after = np.r_[~first[1:], False]
        done = slice(0, len(k) - 1)
        keep = (before | after)[done]
        key, uid, at, paired = k[-1], u[-1], int(pos[-1]), bool(before[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[done][keep]) for x in (k, u, pos.astype(np.int64))], ["key", "uid", "at"])
    if key is not None and paired:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (int(key), int(uid), at)], ["key", "uid", "at"])


def members(bands: DataFrame) -> DataFrame:
    """(key, uid, at) of all buckets with two texts or more, from rows (key, uid)."""
    ordered = bands.select("key", "uid").repartition("key").sortWithinPartitions("key", "uid")
    return ordered.mapInArrow(_numbered, "key long, uid long, at long")


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES * np.log(sizes), 255).astype(np.uint8)


def packed(key: np.ndarray, uid: np.ndarray, size: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Keys of pieces as rows (part, rows), one for each part of the key space; bytes lie plane by plane, keys as differences."""
    key = key.view(np.uint64)
    order = np.argsort(key)
    key, size = key[order], size[order]
    short = (uid.view(np.uint64)[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
    low = (key >> np.uint64(22) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bounds = np.searchsorted(key >> np.uint64(54), np.arange(PARTS + 1, dtype=np.uint64))
    part = np.flatnonzero(np.diff(bounds))
    rows = []
    for a, b in zip(bounds[part], bounds[part + 1]):
        planes = np.empty((10, b - a), np.uint8)
        planes[:4] = np.diff(low[a:b], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
        planes[4:9], planes[9] = short[a:b].T, size[a:b]
        rows.append(planes.tobytes())
    return pa.array(part, pa.int32()), pa.array(rows, pa.binary())


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, short, size class) of the packed rows of a part."""
    key, short, size = [], [], []
    for row in rows:
        planes = np.frombuffer(row, np.uint8).reshape(10, -1)
        key.append(np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint64))
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :5] = planes[4:9].T
        short.append(wide.view("<u8").ravel())
        size.append(planes[9].astype(np.int16))
    return np.concatenate(key), np.concatenate(short), np.concatenate(size)


def _groups(short: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, short, at) of groups that lie one after the other; groups of the same pieces have the same key."""
    key = sh.mix(np.add.reduceat(sh.mix(short + np.uint64(1)), starts) + sizes.astype(np.uint64))
    return np.repeat(key, sizes).view(np.int64), short.view(np.int64), np.arange(len(short)) - np.repeat(starts, sizes)


def _buckets(threshold: float):
    """Packed rows sorted by part -> (key, short, at) of pieces that share a key with another one of about their size.

    Sizes of similar sets differ by a factor of 1 / threshold at most, so a bucket ends where sizes leave a wider gap.
    Where a part outgrows ``HELD`` rows, members of large buckets leave at once, and only their number is kept.
    """
    gap = int(CLASSES * np.log(1 / threshold) + 1 + 1e-9)

    def settled(part, rows, hot, last):
        key, short, size = rows
        order = np.argsort(key << np.uint64(32) | size.astype(np.uint64) << np.uint64(24) | short >> np.uint64(16))
        key, short, size = key[order], short[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (short[1:] != short[:-1])]
        key, short, size = key[new], short[new], size[new]
        out = []
        if hot or not last:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.r_[first, len(key)])
            leave = np.fromiter((k in hot for k in key[first].tolist()), bool, len(first))
            if not last:
                leave |= n > MANY
            for a, m in zip(first[leave], n[leave]):
                at = hot.get(int(key[a]), 0)
                hot[int(key[a])] = at + int(m)
                name = sh.mix(np.array([part << 32 | int(key[a])], np.uint64)).view(np.int64)
                out.append((np.repeat(name, m), short[a:a + m].view(np.int64), np.arange(at, at + m)))
            stay = ~np.repeat(leave, n)
            key, short, size = key[stay], short[stay], size[stay]
        if last and len(key):
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (size[1:] - size[:-1] > gap)])
            n = np.diff(np.r_[start, len(key)])
            n, several = n[n > 1], np.repeat(n > 1, n)
            if len(n):
                out.append(_groups(short[several], np.cumsum(n) - n, n))
        return (key, short, size), [pa.RecordBatch.from_arrays([pa.array(c) for c in o], ["key", "short", "at"]) for o in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, hot, count, most = None, [], {}, 0, HELD
        kept = None
        for batch in batches:
            for part, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now or count > most:
                    if rows:
                        both = _unpacked(rows) if kept is None else tuple(map(np.concatenate, zip(kept, _unpacked(rows))))
                        kept, out = settled(now, both, hot, part != now)
                        yield from out
                        rows, count = [], len(kept[0])
                        most = max(HELD, 2 * count)
                    if part != now:
                        now, rows, hot, count, most, kept = part, [], {}, 0, HELD, None
                rows.append(row.as_py())
                count += len(rows[-1]) // 10
        if rows:
            yield from settled(now, _unpacked(rows) if kept is None else tuple(map(np.concatenate, zip(kept, _unpacked(rows)))), hot, True)[1]
    return run


def bucketed(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, short, at) of all distinct groups of pieces with a common key, from packed rows (part, rows)."""
    ordered = rows.repartition("part").sortWithinPartitions("part")
    found = ordered.mapInArrow(_buckets(threshold), "key long, short long, at long")
    return found.groupBy("key", "short").agg(F.min("at").alias("at"))


def sketches(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(sizes, parities) of sets: the parity of the number of elements in each of as many classes as there are elements, about.

    Parities of two sets differ in no more places than there are elements in one set only. Numbers of classes are
    powers of two, so that a longer sketch folds to the length of a shorter one.
    """
    row, high = sh.distinct(hashes, starts)
    sizes = np.bincount(row, minlength=len(starts))
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(sizes)).astype(np.int64))
    ends = np.cumsum(bits)
    odd = np.bincount((ends - bits)[row] + (high & (bits[row] - 1)), minlength=int(ends[-1])) & 1
    flat = np.packbits(odd.astype(np.uint8)).tobytes()
    return sizes, [flat[a:b] for a, b in zip((ends - bits) // 8, ends // 8)]


def _distances(sketch: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the numbers of places in which pairs of sketches differ, folded to the shorter one."""
    width = np.fromiter(map(len, sketch), np.int64, len(sketch))
    levels, at, bits = [], np.empty(0, np.int64), np.empty((0, 0), np.uint8)
    for w in np.unique(width)[::-1].tolist():
        while bits.shape[1] > w:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        own = np.flatnonzero(width == w)
        mine = np.frombuffer(b"".join([sketch[i] for i in own]), np.uint8).reshape(-1, w)
        at, bits = np.r_[at, own], np.concatenate([bits.reshape(-1, w), mine])
        spot = np.zeros(len(width), np.int64)
        spot[at] = np.arange(len(at))
        levels.append((w, spot, np.ascontiguousarray(bits).view(np.uint64)))

    def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        low, out = np.minimum(width[left], width[right]), np.zeros(len(left), np.int64)
        for w, spot, words in levels:
            here = np.flatnonzero(low == w)
            step = max(1, 8_000_000 // w)
            for a in range(0, len(here), step):
                some = here[a:a + step]
                out[some] = np.bitwise_count(words[spot[left[some]]] ^ words[spot[right[some]]]).sum(axis=1)
        return out
    return distances


def _near(threshold: float):
    """Rows (key, left, right, side, short, size, sketch) -> (a, b): stars of pieces that may be similar by their sketches."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in in_groups(batches):
            short, side, size = (table.column(c).to_numpy() for c in ("short", "side", "size"))
            apart = _distances(table.column("sketch").to_pylist())
            left_out, right_out = [], []
            for left, right in sh.pairs_within(group, side):
                likely = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-6
                left, right = left[likely], right[likely]
                likely = apart(left, right) <= share * (size[left] + size[right]) + 1e-6
                left_out.append(left[likely])
                right_out.append(right[likely])
            if not left_out:
                continue
            root = sh.roots(len(short), np.concatenate(left_out), np.concatenate(right_out))
            moved = root != np.arange(len(root))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(short[moved]), pa.array(short[root[moved]])], ["a", "b"])
    return run


def near(groups: DataFrame, sketched: DataFrame, threshold: float, block: int) -> DataFrame:
    """``groups`` cut and joined to (key, short, at): pieces that sketches (short, uid, size, sketch) connect; loses no similar pair."""
    sketched = sketched.repartition("short").dropDuplicates(["short", "uid"])
    rows = block_pairs(groups, block, "short").join(sketched, "short").select("key", "left", "right", "side", "short", "size", "sketch")
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    found = components(rows.mapInArrow(_near(threshold), "a long, b long"))
    place = Window.partitionBy("root").orderBy("node")
    return found.select(F.col("root").alias("key"), F.col("node").alias("short"), (F.row_number().over(place) - 1).cast("long").alias("at"))


def distinct_buckets(found: DataFrame) -> DataFrame:
    """``found`` without buckets that hold the same texts as another bucket."""
    whole = found.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("s"),
                                     F.min("uid").alias("low"))
    kept = whole.groupBy("n", "s", "low").agg(F.min("key").alias("key")).select("key")
    return found.join(kept, "key", "left_semi")


def block_pairs(found: DataFrame, block: int, name: str = "uid") -> DataFrame:
    """(key, left, right, side, uid): a group is a pair of blocks of a bucket; ``name`` is the column of its members.

    side is 0 or 1 where the blocks differ (only pairs across count) and -1 inside a block.
    """
    found = found.withColumn("block", F.floor(F.col("at") / block))
    many = found.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    if many.isEmpty():
        return found.select("key", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(-1).alias("side"), name)
    rows = found.join(small(many), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                       F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), name)


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (columns key, left, right) of a sorted stream, as (rows, group number of each)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for name in ("key", "left", "right"):
            x = table.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        rest = table.slice(last)
        if last:
            yield table.slice(0, last), np.cumsum(new)[:last]
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(rest.num_rows, np.int64)


def _shares(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges with sums of about ``most``, one at least each."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def verify(threshold: float, shingler) -> Callable:
    """Rows (key, left, right, side, uid, text) -> (uid, root, links): exact similarity in each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shingler.begin()
        for table, group in in_groups(batches):
            uid, side = table.column("uid").to_numpy(), table.column("side").to_numpy()
            texts = table.column("text").to_pylist()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            bounds = np.r_[starts, len(group)]
            letters = np.add.reduceat(np.fromiter(map(len, texts), np.int64, len(texts)), starts)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            # Shingles of many groups at once, as groups of two or three are the rule.
            for g, stop in _shares(letters, 2_000_000):
                low = bounds[g]
                hashes, first = windows(texts[low:bounds[stop]])
                sets = np.split(hashes, first[1:])
                for a, b in zip(bounds[g:stop], bounds[g + 1:stop + 1]):
                    if b - a == 2:
                        if uid[a] == uid[a + 1] or (side[a] == side[a + 1] and side[a] >= 0):
                            continue
                        x, y = np.unique(sets[a - low]), np.unique(sets[a + 1 - low])
                        if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                            continue
                        both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                        if both and both >= threshold * (len(x) + len(y) - both) - 1e-9:
                            pair = uid[a:b]
                            out.append((pair, np.full(2, pair.min()), np.ones(2, np.int64)))
                        continue
                    ids, at = np.unique(uid[a:b], return_index=True)
                    if len(ids) < 2:
                        continue
                    sd = side[a:b][at]
                    both = sh.shared([np.unique(sets[a - low + i]) for i in at])
                    size = both.diagonal()
                    alike = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9) & (both > 0)
                    np.fill_diagonal(alike, False)
                    alike &= (sd[:, None] != sd[None, :]) | (sd[:, None] < 0)
                    links = alike.sum(axis=1)
                    root = sh.roots(len(ids), *np.nonzero(np.triu(alike)))
                    some = links > 0
                    out.append((ids[some], ids[root[some]], links[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["uid", "root", "links"])
    return run


def linked(groups: DataFrame, texts: DataFrame, threshold: float, shingler, on: str = "uid") -> DataFrame:
    """Exact links inside groups (see ``block_pairs``): (uid, root, links). ``texts`` has (uid, text) and the column ``on``."""
    rows = groups.join(texts, on).select("key", "left", "right", "side", "uid", "text")
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return rows.mapInArrow(verify(threshold, shingler), "uid long, root long, links long")
