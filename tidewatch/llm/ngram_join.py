"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Documents are sets of five-word shingles; a link is a pair with similarity of 0.8 or more.

1. Every document gets 150 MinHash values, banded 30 x 5: a pair at 0.8 shares a band with
   probability 1 - 7e-6. Documents with equal words are one text from here on.
2. Texts of a bucket are compared value by value: after 30, 60, ... values the posterior
   probability that the similarity reaches the threshold follows from the matches (uniform
   prior: a Beta tail); pairs under 1e-6 are dropped. What is left joins texts to groups.
3. Inside groups all pairs are verified exactly. A group is cut into blocks, a task holds two blocks,
   and rows out of a task are counts of links and stars, never pairs.

Results: class_id (smallest document id connected by links), text_id (smallest document id with
the same words), n_links (other texts linked), n_copies (documents with this text).

Defined results: a null or empty text, or one without words, matches nothing and is a class of its
own (class_id = doc_id); under five words a text is one shingle; repeated rows are documents
with one text; documents without an id get null ids if their whole class has none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import candidates, shingles
from tidewatch.llm.common import fresh, whole
from tidewatch.llm.components import components
from tidewatch.session import materialize

SHINGLER = shingles.WordShingles(5)
BANDS = shingles.Bands(30, 5)
STEP = 30
TOLERANCE = 1e-6
SIGNATURE_BLOCK, TEXT_BLOCK = 1024, 256


def posterior(matches: int, of: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of ``of`` values), uniform prior."""
    n = of + 1  # Beta(m + 1, of - m + 1) over t equals Binomial(of + 1, t) up to m
    return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(threshold) + (n - k) * log(1 - threshold))
               for k in range(matches + 1))


def least_matches(threshold: float, tolerance: float, of: int) -> int:
    return next(m for m in range(of + 1) if posterior(m, of, threshold) >= tolerance)


def _signed(shingler, bands: shingles.Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, (signatures, keys) = shingler.begin(), bands.begin()
        for batch in shingles.sliced(batches):
            texts = [shingler.normal(t) for t in batch.column(2).to_pylist()]
            for a, b in shingles.chunks(texts):
                part = texts[a:b]
                full = [i for i, t in enumerate(part) if t]
                uid, sig, band = [None] * len(part), [None] * len(part), [None] * len(part)
                if full:
                    values = signatures(*windows([part[i] for i in full]))
                    for i, v, k in zip(full, values, keys(values).tolist()):
                        uid[i], sig[i], band[i] = shingles.fingerprint(part[i]), v.tobytes(), k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(uid, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(band, pa.list_(pa.int64()))], ["doc_id", "h", "uid", "sig", "bands"])
    return run


def _normal(shingler):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.normal(t) for t in batch.column(1).to_pylist()], pa.string())], ["uid", "text"])
    return run


def _survivors(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in candidates.in_groups(batches):
            uid, side = table.column("uid").to_numpy(), table.column("side").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(uid), -1)
            least = [(n, least_matches(threshold, tolerance, n)) for n in range(STEP, sig.shape[1] + 1, STEP)]
            left_out, right_out = [], []
            for left, right in shingles.pairs_within(group, side):
                count = np.zeros(len(left), np.int16)
                for n, enough in least:
                    count += (sig[left, n - STEP:n] == sig[right, n - STEP:n]).sum(axis=1, dtype=np.int16)
                    on = count >= enough
                    left, right, count = left[on], right[on], count[on]
                left_out.append(left)
                right_out.append(right)
            if not left_out:
                continue
            left, right = np.concatenate(left_out), np.concatenate(right_out)
            root = shingles.roots(len(uid), left, right)
            moved = root != np.arange(len(uid))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[moved]), pa.array(uid[root[moved]])], ["a", "b"])
    return run


def joined(docs: DataFrame, threshold: float = 0.8, shingler=SHINGLER, bands: shingles.Bands = BANDS,
           tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, h, class_id, text_id, n_links, n_copies); h is the hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole()).alias("h"), whole().alias("text"))
    signed = materialize(rows.mapInArrow(_signed(shingler, bands), "doc_id long, h long, uid long, sig binary, bands array<long>"))
    full = signed.where("uid IS NOT NULL")
    # A copy without an id stands for its text only if no copy has one.
    first = full.groupBy("uid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "h")).alias("f"), F.count("*").alias("n_copies"))
    texts = materialize(first.select("uid", F.col("f.doc_id").alias("text_id"), F.col("f.h").alias("text_h"), "n_copies"))
    # One row of each text; rows with one uid have the same bands and signature.
    one = full.select("uid", "bands").dropDuplicates(["uid"])
    found = materialize(candidates.distinct_buckets(materialize(candidates.members(one.select("uid", F.explode("bands").alias("key"))))))
    groups = candidates.block_pairs(found, SIGNATURE_BLOCK)
    wanted = candidates.small(found.select("uid").distinct())
    sigs = full.select("uid", "sig").dropDuplicates(["uid"]).join(wanted, "uid", "left_semi")
    pairs = groups.join(sigs, "uid").select("key", "left", "right", "side", "uid", "sig")
    pairs = pairs.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    grouped = materialize(components(pairs.mapInArrow(_survivors(threshold, tolerance), "a long, b long")))
    # Exact verification inside the groups.
    place = Window.partitionBy("root").orderBy("node")
    numbered = grouped.select(F.col("root").alias("key"), F.col("node").alias("uid"), (F.row_number().over(place) - 1).cast("long").alias("at"))
    spots = candidates.small(texts.join(grouped.select(F.col("node").alias("uid")), "uid", "left_semi").select(
        "uid", F.col("text_id").alias("doc_id"), F.col("text_h").alias("h")))
    same = (rows["h"] == spots["h"]) & rows["doc_id"].eqNullSafe(spots["doc_id"])
    whole_texts = rows.join(spots, same).select("uid", "text").dropDuplicates(["uid"]).mapInArrow(
        _normal(shingler), "uid long, text string")
    links = materialize(candidates.linked(candidates.block_pairs(materialize(numbered), TEXT_BLOCK), whole_texts, threshold, shingler))
    counts = links.groupBy("uid").agg(F.sum("links").alias("n_links"))
    roots = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    known = texts.join(counts, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    low = known.groupBy("root").agg(F.min("text_id").alias("class_id"))
    known = known.join(low, "root").select("uid", "class_id", "text_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    out = signed.select("doc_id", "h", "uid").join(known, "uid", "left")
    lone = F.col("uid").isNull()
    return out.select("doc_id", "h", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(lone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    Of rows that repeat the kept document, one stays. Documents without an id or without words stay.
    """
    classes = joined(docs, threshold).where("doc_id IS NOT NULL AND class_id <> doc_id").select("doc_id", "h").distinct()
    h, row, n = fresh(docs.columns, "h", "row", "n")
    rows = docs.withColumn(h, F.xxhash64(whole()))
    gone = classes.select(F.col("doc_id").alias(row), F.col("h").alias(n))
    rows = rows.join(gone, (rows["doc_id"].cast("long") == gone[row]) & (rows[h] == gone[n]), "left_anti")
    # Repeated rows share id and text.
    order = Window.partitionBy("doc_id", h).orderBy(h)
    rows = rows.withColumn(n, F.row_number().over(order))
    return rows.where((F.col(n) == 1) | F.col("doc_id").isNull()).drop(h, n)
