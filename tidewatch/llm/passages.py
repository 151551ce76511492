"""Removal of passages that repeat across documents, by paragraphs and by runs of words.

A paragraph is a line with words. Paragraphs are compared as sets of five-word shingles: MinHash with
14 bands of 4 values finds candidates (recall 0.9994 at similarity 0.8), exact Jaccard
similarity verifies them, and verified links join to classes. Neighbouring paragraphs that belong
to classes of several documents make up a passage; only passages of at least 50 words count,
so short stock lines stay alone.

A passage may also lie inside longer paragraphs, or begin and end inside them. Runs of at least 50 words that
several documents hold word for word are found wherever they stand (see ``runs``); those that lie inside a passage of
paragraphs are not reported again.

The copy in the first document of a class (of a run: of every 50 words of it) is kept. A passage is reported with its class and with
``kept``, true where no paragraph of it is to be removed.

Defined results: a null text has no paragraphs; paragraphs of fewer than five words are one shingle and
match only their equals; words of a run are counted without punctuation; repeats within one document do not count; rows with the same id are one document;
documents without an id are not reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import runs, shingles
from tidewatch.llm.common import whole
from tidewatch.llm.units import classes
from tidewatch.session import materialize

SHINGLER = shingles.WordShingles(5)
BANDS = shingles.Bands(14, 4)
MIN_WORDS = 50


def paragraphs(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    at = number = 0
    for line in text.split("\n"):
        n = len(line.split())
        if n:
            yield at, number, at + len(line), n, line
            number += 1
        at += len(line) + 1


def repeats(docs: DataFrame, threshold: float = 0.8, min_words: int = MIN_WORDS, bands: shingles.Bands = BANDS) -> DataFrame:
    """(doc_id, start, stop, n_words, n_paragraphs, class_id, kept) of every repeated passage."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64(whole()).alias("tid"))
    scanned = materialize(docs.mapInArrow(runs.scanned(paragraphs, min_words), runs.SCANNED))
    places, roots = classes(docs, paragraphs, SHINGLER, bands, threshold, places=scanned.drop("tid", "anchors", "at"))
    by_paragraph = materialize(_paragraph_passages(places, roots, min_words))
    exact = runs.repeated(docs, scanned, paragraphs, min_words)
    outer = by_paragraph.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("_start") <= F.col("start")) & (F.col("stop") <= F.col("_stop"))
    return by_paragraph.unionByName(exact.join(outer, inside, "left_anti"))


def _paragraph_passages(places: DataFrame, roots: DataFrame, min_words: int) -> DataFrame:
    """Runs of neighbouring paragraphs of shared classes."""
    place = places.join(roots, "uid", "left").withColumn("class_id", F.coalesce("root", "uid")).drop("root", "uid")
    kept = place.groupBy("class_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = place.join(kept.where("first < last").select("class_id", "first"), "class_id").dropDuplicates(["doc_id", "number"])
    # Runs of neighbouring shared paragraphs of a document have one value of number - rank.
    order = Window.partitionBy("doc_id").orderBy("number")
    shared = shared.withColumn("run", F.col("number") - F.row_number().over(order))
    found = shared.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"),
        F.count("*").alias("n_paragraphs"), F.min("class_id").alias("class_id"),
        F.bool_and(F.col("first") == F.col("doc_id")).alias("kept"))
    return found.where(F.col("n_words") >= min_words).drop("run")
