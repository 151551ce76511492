"""Benchmark decontamination by templates.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after a number turn
into typed placeholders, all other words into lower case. Windows of eight template words of
documents and benchmark items are joined by hash. Windows of one item that lie in a document at one
offset make up an alignment; it covers a share of the item's windows. The values in the slots of an
alignment must map consistently: one value of the item onto one value of the document. An
alignment is a leak if it covers enough, and its slots are consistent or the windows without slots
alone cover enough; it is ``verbatim`` if all slot values are equal and ``rewritten`` otherwise.

Before the join the documents' windows pass a bitmap of fixed size (2^23 bits, one MB) of the
benchmark's window hashes; false positives end in the join, so nothing is lost, and only windows
that can match are shuffled.

Defined results: a null or empty text has no windows; an item of fewer than eight template words is one window
of its own length (of fewer than ``min_plain`` plain words: none); repeated rows give one leak; an empty
benchmark gives no leaks; items with a null id stay apart by their text; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.candidates import small
from tidewatch.llm.common import fresh, whole
from tidewatch.llm.shingles import CACHED_WORDS, mix, sliced
from tidewatch.session import materialize

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]\w*|[.!?\n]")
END, NUMBER, CAPITAL, UNIT = 1, 2, 4, 8
BITS = 23

# Units that become a placeholder after a number, and number words.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml l liter liters
litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars euro euros cent cents usd eur percent kmh mph hz khz mhz ghz w kw v a j kj pa bar kb mb gb tb""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split())


@dataclass(frozen=True)
class Templates:
    window: int = 8
    min_plain: int = 4
    coverage: float = 0.6


class _Tokens(dict):
    """Hash of a token's lower case, with its kinds in the low four bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        low = token.lower()
        kind = END if low in ".!?\n" else NUMBER if token[0].isdigit() or low in NUMBER_WORDS else 0
        kind |= CAPITAL * (token[0].isupper() and not kind) | UNIT * (low in UNITS)
        value = self[token] = (xxhash.xxh3_64_intdigest(low) & ~15) | kind
        return value


def _template(text: str, tokens: _Tokens) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, template hashes, whether a slot), without sentence ends."""
    found = TOKEN.findall(text)
    v = np.fromiter(map(tokens.__getitem__, found), np.uint64, len(found))
    kind = (v & np.uint64(15)).astype(np.uint8)
    end = (kind & END) > 0
    after_end = np.r_[True, end[:-1]] if len(end) else end
    number = (kind & NUMBER) > 0
    after_number = np.r_[False, number[:-1]] if len(end) else end
    unit = ((kind & UNIT) > 0) & after_number
    name = ((kind & CAPITAL) > 0) & ~after_end & ~unit
    h = v >> np.uint64(4)
    h[number], h[name], h[unit] = np.uint64(1), np.uint64(2), np.uint64(3)
    kept = np.flatnonzero(~end)
    return [found[i] for i in kept] if len(kept) < len(found) else found, h[kept], (number | name | unit)[kept]


def _hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    mixed = mix(h)
    for k in range(size):
        total += mixed[k:k + n] * np.uint64(pow(0x100000001B3, k + 1, 1 << 64))
    return mix(total + np.uint64(size)).astype(np.int64)


def _items(rule: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = _Tokens(), []
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, h, slot = _template(text or "", tokens)
                size = min(rule.window, len(h))
                if not size:
                    continue
                hashes = _hashes(h, size)
                plain = size - np.convolve(slot, np.ones(size, int), "valid")
                good = [i for i in range(len(hashes)) if plain[i] >= min(rule.min_plain, size)]
                key = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1
                rows += [(item_id, key, i, len(good), size, int(hashes[i]), [words[j] for j in range(i, i + size) if slot[j]]) for i in good]
        if rows:
            kinds = [pa.int64()] * 6 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             ["item_id", "item_key", "at", "windows", "size", "hash", "item_slots"])
    return run


def _hits(sizes: list[int], bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in sliced(batches):
            rows = []
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, h, slot = _template(text, tokens)
                for size in sizes:
                    hashes = _hashes(h, size)
                    if not len(hashes):
                        continue
                    bit = hashes.view(np.uint64) >> np.uint64(64 - BITS)
                    hit = np.flatnonzero(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    rows += [(doc_id, key, int(i), int(hashes[i]), [words[j] for j in range(i, i + size) if slot[j]]) for i in hit]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "h", "pos", "hash", "doc_slots"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """(doc_id, h, item_id, kind, windows, matched): the best alignment of each leaked item in a document."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        _items(rule), "item_id long, item_key long, at long, windows long, size long, hash long, item_slots array<string>")
    items = materialize(items)
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most ``window`` values
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    word = items.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")).alias("b"))
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in word.collect():  # at most 2^17 rows
        bitmap[r["w"]] = r["b"]
    bitmap = bitmap.view(np.uint64)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole()).alias("h"), whole().alias("text"))
    hits = rows.mapInArrow(_hits(sizes, bitmap), "doc_id long, h long, pos long, hash long, doc_slots array<string>")
    found = hits.join(small(items), "hash").withColumn("offset", F.col("pos") - F.col("at"))
    pairs = F.arrays_zip(F.transform("item_slots", F.lower).alias("a"), F.transform("doc_slots", F.lower).alias("b"))
    lined = found.groupBy("doc_id", "h", "item_id", "item_key", "offset", "windows").agg(
        # An alignment holds each window of an item once: sets and list are bounded by the item.
        F.size(F.collect_set("at")).alias("matched"),
        F.size(F.collect_set(F.when(F.size("item_slots") == 0, F.col("at")))).alias("plain"),
        F.array_distinct(F.flatten(F.collect_list(pairs))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.col("slots.a")))
    lined = lined.where(((F.col("matched") >= rule.coverage * F.col("windows")) & consistent)
                        | (F.col("plain") >= rule.coverage * F.col("windows")))
    kind = F.when(F.forall("slots", lambda s: s["a"] == s["b"]), "verbatim").otherwise("rewritten")
    best = lined.groupBy("doc_id", "h", "item_id", "item_key", "windows").agg(F.max(F.struct("matched", kind.alias("kind"))).alias("best"))
    return best.select("doc_id", "h", "item_id", "best.kind", "windows", F.col("best.matched").cast("long").alias("matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    h, a, b = fresh(docs.columns, "h", "a", "b")
    bad = leaks(docs, benchmark, rule).select(F.col("doc_id").alias(a), F.col("h").alias(b)).distinct()
    rows = docs.withColumn(h, F.xxhash64(whole()))
    return rows.join(small(bad), rows["doc_id"].cast("long").eqNullSafe(F.col(a)) & (rows[h] == F.col(b)), "left_anti").drop(h)
