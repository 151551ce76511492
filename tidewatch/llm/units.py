"""Near-duplicate classes of pieces of documents (lines, paragraphs)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import candidates, shingles
from tidewatch.llm.common import stored
from tidewatch.llm.components import components

BLOCK = 256
REMEMBERED = 200_000
KEYS_AT_ONCE = 1_000_000
LETTERS = 100_000  # their arrays fit the cache
PLACES = "doc_id long, start long, number long, stop long, words long, uid long"
BANDED = "doc_id long, number long, uid long, size long, sketch binary, part int, rows binary"
BANDED_ARROW = pa.schema({"doc_id": pa.int64(), "number": pa.int64(), "uid": pa.int64(), "size": pa.int64(), "sketch": pa.binary(),
                          "part": pa.int32(), "rows": pa.binary()})

# A piece: (start, number, end, words, text); start and end are code points.
Split = Callable[[str], Iterator[tuple[int, int, int, int, str]]]


def _banded(split: Split, shingler, banding, bands: shingles.Bands, placed: bool):
    """Rows (doc_id, text) -> band keys and size classes of pieces that are new to the task, packed by ``candidates.packed``.

    With ``placed`` also every piece with its place, and with size and sketch if it is new to the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, (signatures, keys) = shingler.begin(), bands.begin()
        wide = banding.begin() if banding is not shingler else None
        seen: set[int] = set()
        waiting, count = [], 0

        def batch_of(**columns):
            rows = len(next(iter(columns.values())))
            cols = [columns.get(f.name, pa.nulls(rows, f.type)) for f in BANDED_ARROW]
            return pa.RecordBatch.from_arrays(cols, schema=BANDED_ARROW)

        def packed():
            band, uid, size = (np.concatenate(x) for x in zip(*waiting))
            part, rows = candidates.packed(band.ravel(), np.repeat(uid, bands.bands), np.repeat(size, bands.bands))
            return batch_of(part=part, rows=rows)

        for batch in shingles.sliced(batches):
            places, fresh, at = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, number, _, _, piece in split(text or ""):
                    norm = shingler.normal(piece)
                    if not norm:
                        continue
                    uid = shingles.fingerprint(norm)
                    if uid not in seen:  # a copy has the same bands; another task may send them again
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(uid)
                        at.append(len(places))
                        fresh.append(norm)
                    places.append((doc_id, number, uid))
            if not places:
                continue
            doc, number, uid = zip(*places)
            ids, size, sketch = np.array(uid, np.int64), np.zeros(len(places), np.int64), [None] * len(places)
            for a, b in shingles.chunks(fresh, LETTERS):
                made = windows(fresh[a:b])
                band = keys(signatures(*(wide(fresh[a:b]) if wide else made)))
                if placed:
                    sizes, parities = candidates.sketches(*made)
                    for i, x in zip(at[a:b], parities):
                        sketch[i] = x
                else:
                    sizes = np.bincount(shingles.distinct(*made)[0], minlength=b - a)
                size[at[a:b]] = sizes
                waiting.append((band, ids[at[a:b]], candidates.size_class(sizes)))
                count += band.size
                if count >= KEYS_AT_ONCE:
                    yield packed()
                    waiting, count = [], 0
            if placed:
                yield batch_of(doc_id=pa.array(doc, pa.int64()), number=pa.array(number, pa.int64()), uid=pa.array(ids),
                               size=pa.array(size, mask=size == 0), sketch=pa.array(sketch, pa.binary()))
        if waiting:
            yield packed()
    return run


def _texts(split: Split, shingler):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.sliced(batches):
            uid, texts, size = [], [], 0
            for text in batch.column(0).to_pylist():
                for *_, piece in split(text or ""):
                    norm = shingler.normal(piece)
                    if norm:
                        uid.append(shingles.fingerprint(norm))
                        texts.append(norm)
                        size += len(norm)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(texts, pa.string())], ["uid", "text"])
                    uid, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(texts, pa.string())], ["uid", "text"])
    return run


def classes(docs: DataFrame, split: Split, shingler, bands: shingles.Bands, threshold: float,
            banding=None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, roots): where every piece stands, and (uid, root) of pieces that have near copies.

    Pieces that are equal in normal form share a uid. Candidates share a band key and are of about one size; each is verified by
    exact Jaccard similarity; classes are the connected components of the verified links.
    ``banding`` makes the shingles that are banded, if they aren't the ones that are verified; it has
    the same normal form. ``places`` may be handed in. Without them (doc_id, number, uid) are made together with the bands and
    with sketches, and candidates whose sketches differ too much are dropped before any text is fetched.
    """
    short = F.shiftrightunsigned("uid", 24).alias("short")
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _banded(split, shingler, banding or shingler, bands, places is None), BANDED)
    sketched = None
    if places is None:
        made = stored(made, "pieces")
        places = made.where("uid IS NOT NULL").select("doc_id", "number", "uid")
        sketched = made.where("sketch IS NOT NULL").select(short, "uid", "size", "sketch")
    groups = stored(candidates.bucketed(made.where("part IS NOT NULL").select("part", "rows"), threshold), "groups")
    if sketched is not None:
        groups = stored(candidates.near(groups, sketched, threshold, BLOCK), "near")
    wanted = candidates.small(groups.select("short").distinct())
    texts = docs.select("text").mapInArrow(_texts(split, shingler), "uid long, text string").withColumn("short", short)
    texts = texts.join(wanted, "short", "left_semi").repartition("short").dropDuplicates(["short", "uid"])
    links = candidates.linked(candidates.block_pairs(groups, BLOCK, "short"), texts, threshold, shingler, "short").select("uid", "root")
    if sketched is None:
        return places, _roots(links)
    # Now a piece is in one group only. Links of groups of one block are whole; others are joined across their blocks.
    links = stored(links, "links")
    cut = groups.join(groups.where(F.col("at") >= BLOCK).select("key").distinct(), "key", "left_semi").select(F.col("short").alias("_short"))
    across = short == F.col("_short")
    return places, links.join(cut, across, "left_anti").unionByName(_roots(links.join(cut, across, "left_semi")))


def _roots(links: DataFrame) -> DataFrame:
    roots = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    return roots.select(F.col("node").alias("uid"), "root")
