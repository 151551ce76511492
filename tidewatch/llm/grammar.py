"""Token files compressed by Re-Pair grammars.

Documents in ascending order of their id are encoded, each followed by an end id, and cut into
shards of about ``SHARD_IDS`` ids. In every shard, frequent pairs of neighbouring symbols are replaced by new
symbols (rules), again and again: a round counts all pairs, ranks the frequent ones by count, and where occurrences
overlap the more frequent pair wins. Rounds end when no pair is frequent or a round shortens the shard by under one per cent.
No rule reaches over the end of a document, so a document is a run of symbols. With the length of every symbol's expansion
stored, any document, or any range of ids, is decoded without expanding the rest of its shard.

A token file is a Parquet file of shards: part (place of its file in the order), start (ids of the part before it), n_ids,
first_id and last_id (least and greatest document id, so that readers prune), doc_ids, lengths (ids of each document) and ``grammar``,
the bytes of one shard (see ``pack``). The ids before a shard are those of earlier parts plus ``start``; parts are as many as
the tasks that wrote them, so their sums are a small table.

Defined results: null texts are empty texts, which hold the end id only; null ids come first; rows with equal ids are ordered by
a hash of their text; a document longer than a shard is a shard of its own; an empty table gives no rows; other columns
are ignored. A shard's symbols have 16 bits: rules end when 65,536 symbols are taken, and a shard with more distinct ids than
that would keep 32-bit ids without rules.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole
from tidewatch.llm.vocabulary import byte_tokens

SHARD_IDS = 1_000_000
LEAST_COUNT = 16
PASSES = 3  # of settling overlaps in a round
GAIN = 100
SYMBOLS = 1 << 16
END_ID = 2
TEXTS_AT_ONCE = 1024
SHARDS = ("part int, start long, n_ids long, first_id long, last_id long, doc_ids array<long>, lengths array<int>, grammar binary")
_HEAD = struct.Struct("<4sIIII")
_SLOT_BITS = 18


class Grammar:
    """``ids``: what terminals stand for; ``left``, ``right``: rules, each of earlier symbols; ``body``: the symbols;
    ``ends``: for each document, the number of symbols up to its end."""

    def __init__(self, ids, left, right, body, ends):
        self.ids, self.left, self.right, self.body, self.ends = ids, left, right, body, ends
        self.size = np.ones(len(ids) + len(left), np.int64)
        n = len(ids)
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            self.size[n + i] = self.size[a] + self.size[b]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of ``symbols``, all rules of a level at once."""
        n = len(self.ids)
        out = symbols.astype(np.int64)
        while len(big := np.flatnonzero(out >= n)):
            width = np.ones(len(out), np.int64)
            width[big] = 2
            at = np.cumsum(width) - width
            rules = out[big] - n
            new = np.empty(len(out) + len(big), np.int64)
            new[at] = out
            new[at[big]], new[at[big] + 1] = self.left[rules], self.right[rules]
            out = new
        return self.ids[out]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.body[self.ends[k - 1] if k else 0:self.ends[k]])

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only symbols that reach into the range are expanded."""
        ends = np.cumsum(self.size[self.body])
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(self.body[low:high])[start - before:stop - before]


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST_COUNT) -> Grammar:
    """The grammar of documents that lie one after the other in ``ids``."""
    terminals, body = np.unique(ids, return_inverse=True)
    body = body.astype(np.uint32)
    last = np.zeros(len(body), bool)
    last[np.cumsum(lengths) - 1] = True
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    symbols = len(terminals)
    mask = (1 << _SLOT_BITS) - 1
    while symbols < SYMBOLS and len(body) > 1:
        pair = (body[:-1] << np.uint32(16)) | body[1:]
        ordered = np.sort(pair[~last[:-1]])
        cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(ordered) else np.zeros(1, np.int64)
        count = np.diff(cut)
        if not len(count) or count.max() < least:
            break
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")][:SYMBOLS - symbols]
        chosen = ordered[cut[often]]
        # Rank of each position's pair: a table of slots, each owned by its most frequent pair; others wait a round.
        slot = ((chosen * np.uint32(2654435769)) >> np.uint32(32 - _SLOT_BITS)) & np.uint32(mask)
        owner = np.full(mask + 1, -1, np.int32)
        owner[slot[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        rank = owner[((pair * np.uint32(2654435769)) >> np.uint32(32 - _SLOT_BITS)) & np.uint32(mask)]
        none = np.int32(len(chosen))
        rank = np.where((rank >= 0) & (chosen[rank] == pair) & ~last[:-1], rank, none)
        # A pair is taken where no better one overlaps it; in later passes, where those that did were not taken themselves.
        found, open_rank = [], rank.copy()
        for _ in range(PASSES):
            best = np.flatnonzero((open_rank < np.r_[none, open_rank[:-1]]) & (open_rank <= np.r_[open_rank[1:], none]))
            found.append(best)
            open_rank[best] = none
            open_rank[np.maximum(best - 1, 0)] = none
            open_rank[np.minimum(best + 1, len(rank) - 1)] = none
        at = np.sort(np.concatenate(found))
        used = np.bincount(rank[at], minlength=len(chosen))
        kept = used >= 2
        at = at[kept[rank[at]]]
        if len(at) * GAIN < len(body):
            break
        number = np.cumsum(kept) - 1 + symbols
        rules = chosen[kept]
        left.append(rules >> np.uint32(16))
        right.append(rules & np.uint32(0xFFFF))
        symbols += len(rules)
        body[at] = number[rank[at]]
        last[at] = last[at + 1]
        stay = np.ones(len(body), bool)
        stay[at + 1] = False
        body, last = body[stay], last[stay]
    return Grammar(terminals, np.concatenate(left), np.concatenate(right), body, np.flatnonzero(last) + 1)


def pack(g: Grammar) -> bytes:
    """Format: "TKG1", numbers of terminals, rules, symbols, documents (32 bits each); terminal ids (32 bits); rules as left
    and right symbols, then lengths of their expansions (32 bits); symbols (16 bits); ends of documents in symbols (32 bits). Little-endian."""
    n = len(g.ids)
    return b"".join([_HEAD.pack(b"TKG1", n, len(g.left), len(g.body), len(g.ends)), g.ids.astype("<u4").tobytes(),
                     g.left.astype("<u2").tobytes(), g.right.astype("<u2").tobytes(), g.size[n:].astype("<u4").tobytes(),
                     g.body.astype("<u2" if n <= SYMBOLS else "<u4").tobytes(), g.ends.astype("<u4").tobytes()])


def unpack(data: bytes) -> Grammar:
    magic, n, rules, symbols, docs = _HEAD.unpack_from(data)
    if magic != b"TKG1":
        raise ValueError("not a shard of a token file")
    g, at = Grammar.__new__(Grammar), _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    g.ids, g.left, g.right = take("<u4", n), take("<u2", rules), take("<u2", rules)
    g.size = np.concatenate((np.ones(n, np.int64), take("<u4", rules).astype(np.int64)))
    g.body, g.ends = take("<u2" if n <= SYMBOLS else "<u4", symbols), take("<u4", docs)
    return g


def _encoder(path: str, shard_ids: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, start = byte_tokens(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal start, held
            grammar = pack(compress(np.concatenate(parts), np.array(lengths, np.int64), least))
            known = [d for d in docs if d is not None]
            row = [part, start, held, min(known, default=None), max(known, default=None), list(docs), list(lengths), grammar]
            start, held = start + held, 0
            docs.clear(), parts.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids, n = tokens.encode(some.column(1).to_pylist())
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, np.uint32(END_ID))
                ends += np.arange(1, len(ends) + 1)
                first = 0
                for doc, end in zip(some.column(0).to_pylist(), ends.tolist()):
                    if held and held + end - first > shard_ids:
                        yield shard()
                    docs.append(doc), parts.append(ids[first:end]), lengths.append(end - first)
                    held += end - first
                    first = end
        if docs:
            yield shard()

    names = ["part", "start", "n_ids", "first_id", "last_id", "doc_ids", "lengths", "grammar"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return run


def token_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, least: int = LEAST_COUNT) -> DataFrame:
    """Shards of (doc_id, text), to be written as a token file. Equal ids are spread by hash, equal rows by a seeded draw."""
    rows = docs.select("doc_id", whole().alias("text")).withColumns({"h": F.xxhash64("text"), "r": F.rand(11)})
    ordered = rows.repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h")
    return ordered.select("doc_id", "text").mapInArrow(_encoder(path, shard_ids, least), SHARDS)


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            before = batch.column("before")[k].as_py()
            grammar = unpack(batch.column("grammar")[k].as_py())
            ids = grammar.expand(grammar.body).astype("<u4")
            low = np.concatenate(([0], grammar.ends[:-1])).astype(np.int64)
            n = np.add.reduceat(grammar.size[grammar.body], low)
            ends = np.cumsum(n)
            data, cuts = memoryview(ids.tobytes()), (4 * np.r_[0, ends]).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[k].values, pa.array(before + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(grammar.ends - low, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])


def with_offsets(shards: DataFrame) -> DataFrame:
    """Shards of a token file with ``before``, the ids of all shards before each. One row per writing task is collected."""
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    total = np.cumsum([0] + [n for _, n in sums])
    table = [(part, int(before)) for (part, _), before in zip(sums, total)]
    offsets = shards.sparkSession.createDataFrame(table, "part int, offset long")
    return shards.join(F.broadcast(offsets), "part").withColumn("before", F.col("offset") + F.col("start"))


def documents(shards: DataFrame) -> DataFrame:
    """Every document of a token file, decoded: doc_id, start, n_tokens, ids_crc32, n_symbols."""
    rows = with_offsets(shards).select("before", "doc_ids", "grammar")
    return rows.mapInArrow(_decoder, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def round_trip(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, least: int = LEAST_COUNT) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe what they hold."""
    return documents(stored(token_shards(docs, path, shard_ids, least), "tokens"))
