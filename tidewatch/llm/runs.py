"""Exact runs of words that repeat across documents, wherever they begin and end.

A run of ``least`` words or more that two documents share is found in two steps. Of the hashes of all
half-as-long runs of a text the least one of every ``least`` words is an anchor, so that texts with a common run have an
anchor in common; anchors that only one document holds end here. Around the others every run of ``least`` words is
hashed, and those that two documents hold are joined to the longest runs they cover. Rows grow with the words
over 13, and after that with the repeated words.

Words are runs of letters, digits and underscores, in lower case. Equal texts are hashed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import candidates, shingles
from tidewatch.llm.units import PLACES, Split
from tidewatch.session import materialize

U64 = np.uint64
NONE = np.uint64((1 << 64) - 1)
WORDS_AT_ONCE = 200_000
SCANNED = f"{PLACES}, tid long, anchors array<long>, at array<int>"
WINDOWS = "h long, tid long, pos int, span long, lines long, first long, last long"


def _sliding(best: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """The best of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = best(x[:-have], x[have:]), have * 2
    rest = width - have
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(values: np.ndarray, lengths: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of the anchors of texts; each text's values are followed by ``size`` - 1 zeros."""
    begin = np.cumsum(lengths + size - 1) - (lengths + size - 1)
    width = least - size + 1
    if len(values) < size + width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    x = shingles.mix(shingles.rolling(values, size))
    inside = np.zeros(len(x) + 1, np.int64)
    long = lengths >= least
    inside[begin[long]] += 1
    inside[(begin + lengths - size + 1)[long]] -= 1
    valid = np.cumsum(inside)[:-1] > 0
    x[~valid] = NONE
    edge = np.zeros(width - 1, U64)
    top = _sliding(np.maximum, np.concatenate([edge, _sliding(np.minimum, x, width), edge]), width)
    at = np.flatnonzero(valid & (x == top))
    text = np.searchsorted(begin, at, "right") - 1
    return text, at - begin[text], x[at]


def scanned(split: Split, least: int):
    """Rows (doc_id, text, tid) -> places; the first place of a text carries its anchors."""
    size = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingles.WordHashes()

        def out(places, head, words):
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            values = np.zeros(int(lengths.sum()) + len(words) * (size - 1), U64)
            at = 0
            for some in words:
                values[at:at + len(some)] = some
                at += len(some) + size - 1
            text, word, found = anchors(values, lengths, size, least)
            ends = np.r_[0, np.cumsum(np.bincount(np.asarray(head, np.int64)[text], minlength=len(places)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(found.view(np.int64)), pa.array(word.astype(np.int32)))]
            cols = [pa.array(c, pa.int64()) for c in zip(*places)]
            return pa.RecordBatch.from_arrays([*cols, *lists], ["doc_id", "start", "number", "stop", "words", "uid", "tid", "anchors", "at"])

        for batch in shingles.sliced(batches):
            places, head, words, count = [], [], [], 0
            for doc_id, text, tid in zip(*(batch.column(i).to_pylist() for i in range(3))):
                mine, first = [], len(places)
                for start, number, stop, n, piece in split(text or ""):
                    found = shingles.WORD.findall(piece.lower())
                    if found:
                        places.append((doc_id, start, number, stop, n, shingles.fingerprint(" ".join(found)), tid))
                        mine += map(hashes.__getitem__, found)
                if mine:
                    head.append(first)
                    words.append(np.array(mine, U64))
                    count += len(mine)
                if count > WORDS_AT_ONCE:
                    yield out(places, head, words)
                    places, head, words, count = [], [], [], 0
            if places:
                yield out(places, head, words)
    return run


def spans(line: str) -> Iterator[tuple[str, int, int]]:
    """(word, start, stop) of the words of a line, in lower case, at their places in the line itself."""
    low = line.lower()
    if len(low) == len(line):
        for m in shingles.WORD.finditer(low):
            yield m.group(), *m.span()
    else:  # some letter has a longer lower case
        origin = np.repeat(np.arange(len(line)), [len(c.lower()) for c in line])
        for m in shingles.WORD.finditer(low):
            yield m.group(), int(origin[m.start()]), int(origin[m.end() - 1]) + 1


def _windowed(split: Split, least: int):
    """Rows (text, tid, first, last, at) -> every run of ``least`` words that holds one of the anchors."""
    size = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingles.WordHashes()
        for batch in shingles.sliced(batches, 50):
            for text, tid, first, last, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                value, start, stop, line = [], [], [], []
                for number, (begin, _, _, _, piece) in enumerate(split(text or "")):
                    for word, a, b in spans(piece):
                        value.append(hashes[word])
                        start.append(begin + a)
                        stop.append(begin + b)
                        line.append(number)
                n = len(value)
                near = np.zeros(n + 1, np.int64)
                at = np.array(at, np.int64)
                np.add.at(near, np.maximum(at - (least - size), 0), 1)
                np.add.at(near, np.minimum(at, n - least) + 1, -1)
                pos = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                h = shingles.mix(shingles.rolling(np.array(value, U64), least))[pos].view(np.int64)
                end = pos + least - 1
                start, stop, line = (np.array(x, np.int64) for x in (start, stop, line))
                same = [pa.array(np.full(len(pos), x, np.int64)) for x in (tid, first, last)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), same[0], pa.array(pos.astype(np.int32)), pa.array(start[pos] << 32 | stop[end]),
                     pa.array(line[pos] << 32 | line[end]), *same[1:]], ["h", "tid", "pos", "span", "lines", "first", "last"])
    return run


def repeated(docs: DataFrame, places: DataFrame, split: Split, least: int) -> DataFrame:
    """(doc_id, start, stop, n_words, n_paragraphs, class_id, kept) of the longest runs covered by repeated runs of ``least`` words.

    ``docs`` has (doc_id, text, tid) and ``places`` is what ``scanned`` made of it.
    """
    heads = places.where(F.size("anchors") > 0)
    each = heads.select("doc_id", "tid", F.inline(F.arrays_zip("anchors", "at")))
    group = Window.partitionBy("anchors")
    shared = each.withColumns({"low": F.min("doc_id").over(group), "high": F.max("doc_id").over(group)}).where("low < high")
    wanted = materialize(shared.groupBy("tid").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.collect_set("at").alias("at")))
    texts = docs.join(candidates.small(wanted.withColumn("doc_id", F.col("first"))), ["doc_id", "tid"])
    windows = texts.select("text", "tid", "first", "last", "at").mapInArrow(_windowed(split, least), WINDOWS)
    group = Window.partitionBy("h")
    windows = windows.withColumns({"low": F.min("first").over(group), "high": F.max("last").over(group)}).where("low < high")
    windows = windows.select("h", "tid", "pos", "span", "lines", "first", (F.col("low") == F.col("first")).alias("own"))
    order = Window.partitionBy("tid").orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(order) > least, F.lit(True))
    windows = windows.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    runs = windows.groupBy("tid", "run").agg(
        F.min(F.shiftright("span", 32)).alias("start"), F.max(F.col("span").bitwiseAND(0xFFFFFFFF)).alias("stop"),
        (F.max("pos") - F.min("pos") + least).cast("long").alias("n_words"),
        (F.max(F.col("lines").bitwiseAND(0xFFFFFFFF)) - F.min(F.shiftright("lines", 32)) + 1).alias("n_paragraphs"),
        F.min("h").alias("class_id"), F.bool_and("own").alias("own"), F.min("first").alias("first"))
    return runs.join(heads.select("doc_id", "tid").distinct(), "tid").select(
        "doc_id", "start", "stop", "n_words", "n_paragraphs", "class_id", (F.col("own") & (F.col("first") == F.col("doc_id"))).alias("kept"))
