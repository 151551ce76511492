"""Alignment of two tokenizers over the same text by interval coalescing.

Token spans of both sides are sorted by start together (lexsort) and their ends turned into a running maximum.
A group breaks where a start reaches the running maximum, which is where tokens of both sides
end; inside a group every token is expanded to the tokens of the other side that it overlaps.

Texts are encoded once. A task encodes and aligns whole batches of documents as one long axis, on which
documents never touch, and writes one row per document with its distinct linked id pairs. A
pair's count is the number of documents holding it. Scores look counts up twice: pairs that many documents
hold come from a broadcast table of at most ``HEAD_PAIRS`` rows (the limit follows from a histogram of counts), all
others, of which each occurs in few documents, by a shuffled join. So no key of the shuffled join is hot, nothing broadcast
grows with the corpus, and no pair is left out.

Defined results: null and empty texts, and texts that either side does not spell byte by byte, have no tokens, and so
zeros and the empty string; repeated rows and null ids are rows of their own and count as documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole
from tidewatch.llm.vocabulary import byte_tokens, piece_tokens

HEAD_PAIRS = 500_000
BYTES_AT_ONCE = 1_000_000
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "a array<int>, b array<int>, links array<int>")


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of the tokens of both sides, and the number of groups. Spans of a side are in order and not empty."""
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    side = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(order), np.int64)
    np.cumsum(start[order][1:] >= reach[:-1], out=group[1:])
    place = np.empty_like(group)
    place[order] = group
    return place[:len(start_a)], place[len(start_a):], int(group[-1]) + 1 if len(group) else 0


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all overlapping tokens. Tokens of a group are neighbours, so each expands to one run of b."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    width = np.maximum(high - low, 0)
    last = np.cumsum(width)
    in_b = np.repeat(low - last + width, width) + np.arange(last[-1] if len(last) else 0)
    return np.repeat(np.arange(len(start_a)), width), in_b


class Ragged:
    """Byte strings by number, in one array."""

    def __init__(self, items: Sequence[bytes]):
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` one after the other, and where each ends."""
        width = self.size[ids]
        ends = np.cumsum(width)
        return self.flat[np.repeat(self.first[ids] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)], ends


def spells(side: Ragged, ids: np.ndarray, lengths: np.ndarray, wanted: Sequence[bytes]) -> np.ndarray:
    """Do the ids of each text spell it?"""
    doc = np.repeat(np.arange(len(wanted)), lengths)
    size = np.fromiter(map(len, wanted), np.int64, len(wanted))
    same = np.bincount(doc, side.size[ids], len(wanted)) == size
    spelled, _ = side.of(ids[same[doc]])
    text = np.frombuffer(b"".join([w for w, s in zip(wanted, same.tolist()) if s]), np.uint8)
    same[np.repeat(np.arange(len(wanted)), np.where(same, size, 0))[spelled != text]] = False
    return same


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, digits: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` for each group in order, as bytes, and where the text of each group ends."""
    ids, key = np.concatenate((ids_a, ids_b)), np.concatenate((2 * group_a, 2 * group_b + 1))
    order = np.argsort(key, kind="stable")
    ids, key = ids[order], key[order]
    text, ends = digits.of(ids)  # every number has a place after it
    last = np.r_[key[1:] != key[:-1], True] if len(key) else np.zeros(0, bool)
    text[ends - 1] = np.where(last, np.where(key % 2 == 1, ord(";"), ord("|")), ord(","))
    return text, ends[last & (key % 2 == 1)]


@dataclass(frozen=True)
class Aligned:
    """Counts and digests of texts, and their distinct linked pairs: those of text i lie at ends[i - 1] to ends[i]."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times: np.ndarray


def align(texts: Sequence[str], a, b, spelling_a: Ragged, spelling_b: Ragged, digits: Ragged) -> Aligned:
    n = len(texts)
    wanted = [(" " + t).encode() if t else b"" for t in texts]
    ids_a, n_a = a.encode([" " + t if t else "" for t in texts])
    ids_b, n_b = b.encode(texts)
    good = spells(spelling_a, ids_a, n_a, wanted) & spells(spelling_b, ids_b, n_b, wanted)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)].astype(np.int64), ids_b[np.repeat(good, n_b)].astype(np.int64)
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    size_a, size_b = spelling_a.size[ids_a], spelling_b.size[ids_b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    group_a, group_b, groups = coalesce(end_a - size_a, end_a, end_b - size_b, end_b)
    text, group_ends = group_texts(ids_a, ids_b, group_a, group_b, digits)
    n_groups = np.bincount(np.repeat(np.arange(n), n_b)[np.r_[group_b[1:] != group_b[:-1], True]] if groups else [], minlength=n).astype(np.int64)
    stops = np.r_[0, group_ends][np.cumsum(n_groups)].tolist()
    view = memoryview(text.tobytes())
    digests = [hashlib.sha256(view[i:j - 1]).hexdigest() if j > i else "" for i, j in zip([0, *stops], stops)]
    in_a, in_b = overlaps(end_a - size_a, end_a, end_b - size_b, end_b)
    doc, width = np.repeat(np.arange(n), n_a)[in_a], len(spelling_b.size)
    every = len(spelling_a.size) * width
    pairs, times = np.unique(doc * every + ids_a[in_a] * width + ids_b[in_b], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(1, n + 1) * every)
    return Aligned(n_a, n_b, n_groups, np.bincount(doc, minlength=n).astype(np.int64), digests, ends,
                   pairs % every // width, pairs % width, times)


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(path_a), piece_tokens(path_b)
        spelling_a, spelling_b = Ragged(a.token_bytes()), Ragged(b.token_bytes())
        digits = Ragged([b"%d," % i for i in range(max(len(spelling_a.size), len(spelling_b.size)))])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            size, at = np.cumsum([len(t) + 1 for t in texts]), 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
                found = align(texts[at:stop], a, b, spelling_a, spelling_b, digits)
                counts = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                offsets = pa.array(np.r_[0, found.ends].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found.a, found.b, found.times)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), *counts, pa.array(found.digests, pa.string()), *lists],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "links"])
                at = stop
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document of (doc_id, text): counts, the digest of its groups and its distinct linked pairs."""
    return docs.select("doc_id", whole().alias("text")).mapInArrow(_aligner(path_a, path_b), ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) from rows (a, b), one for each document and pair."""
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("count"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def head_limit(counts: DataFrame, rows: int) -> int:
    """The smallest power of two such that at most ``rows`` pairs have that count or more."""
    sizes = counts.groupBy(F.floor(F.log2(F.col("count") + 0.5)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    limit = 62
    for k, n in sorted(((r.k, r.n) for r in sizes), reverse=True):
        if n > rows:
            return 1 << limit
        limit, rows = k, rows - n
    return 1


def scored(rows: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` rows with n_best and count_sum."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    linked = rows.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("row", "p.*")
    counts = stored(pair_counts(linked), "pair-counts")
    limit = head_limit(counts, head_pairs)
    head = F.broadcast(counts.where(F.col("count") >= limit))
    parts = linked.join(head, ["a", "b"])
    if limit > 1:
        parts = parts.unionByName(linked.join(head, ["a", "b"], "left_anti").join(
            counts.where(F.col("count") < limit), ["a", "b"]).select(*parts.columns))
    sums = parts.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"),
                                    F.sum(F.col("links") * F.col("count")).cast("long").alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("a", "b", "links").join(sums, "row", "left").drop("row").withColumns(
        {"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})
