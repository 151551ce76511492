"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case with runs of white space as one space, as sets of 3-character
shingles: one changed character leaves a line of 30 characters above a similarity of 0.8.
Candidates come from 5-character shingles, as unrelated lines of one language share a third of
their shorter runs and would all become candidates. Edits that leave 0.8 of the former leave about
0.68 of the latter; one-pass MinHash deals these into 112 bins, banded 28 x 4, and such a pair
shares a band with probability 0.998 to 0.999. Candidates are verified by exact Jaccard similarity of
the 3-character shingles, verified links are joined to components by distributed union-find,
and one line of each component stays: the first by document and position.

Defined results: a null text has no lines; blank lines are neither counted nor removed; lines
under five characters match only their equals; a repeated row is a document of its own with
the same id, and its lines tie: all places with the kept line's id and number stay;
documents without an id come first; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shingles
from tidewatch.llm.units import classes

SHINGLER = shingles.CharShingles(3)
BANDING = shingles.CharShingles(5)
BANDS = shingles.Bands(28, 4, one_pass=True)


def lines(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    at = 0
    for number, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            yield at, number, at + len(line), 0, line
        at += len(line) + 1


def removals(docs: DataFrame, threshold: float = 0.8, bands: shingles.Bands = BANDS) -> DataFrame:
    """Lines to remove: (doc_id, line_no, kept_doc_id, kept_line_no, class_id)."""
    places, roots = classes(docs, lines, SHINGLER, bands, threshold, BANDING)
    place = places.select("uid", "doc_id", F.col("number").alias("line_no"))
    place = place.join(roots, "uid", "left").withColumn("class_id", F.coalesce("root", "uid"))
    kept = place.groupBy("class_id").agg(F.min(F.struct("doc_id", "line_no")).alias("kept"), F.count("*").alias("n"))
    kept = kept.where("n > 1").select("class_id", "kept")
    # A class may hold a third of all lines: classes with copies are few, and skewed joins are split.
    out = place.join(kept, "class_id").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("line_no") == F.col("kept.line_no"))))
    return out.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "class_id")


def cleaned(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; blank lines stay."""
    gone = removals(docs, threshold).groupBy("doc_id").agg(F.collect_set("line_no").alias("line_no"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]), "left").drop(gone["doc_id"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("line_no", i.cast("long"))), "\n")
    text = F.when(F.col("line_no").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
