"""Token files, tokenizer alignment and whitening against brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import alignment, grammar, whitening
from tidewatch.llm.vocabulary import ByteTokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", None, "  ", " \n ", "a b \x1c\x85c", "▁ x", "<s> <|endoftext|> <0x41>", "字\U0001F600 é ²٣", "it's 'S we'll\t\tgo!!  \r\n1 22",
       "same words " * 400, "x" * 30_000, "Tom has 5 apples. Anna has 6 pears."]


def library():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def rows(spark):
    """Given documents and odd ones: nulls, ties, repeated rows, extra columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    odd = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (7, "other"), (None, "no id"), (None, None)], "doc_id long, text string")
    return docs.union(odd).withColumns({c: F.lit(1) for c in ("row", "h", "r", "part", "a", "links", "count", "best")}).persist()


def test_ids_are_those_of_the_library():
    own, tokenizer, rng = ByteTokens(BYTES), library(), random.Random(4)
    letters = list("ab1'!s \n\t\r") + [" ", "▁", "é", "²", "\x1c", "\x85", "​", "字", "\U0001F600", "<|endoftext|>", "́", "٣", "　", "ʰ", "\U0001E2C0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for t in ODD]
    ids, lengths = own.encode(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and lengths.tolist() == list(map(len, want))
    assert b"".join(own.token_bytes()[i] for i in want[5]) == texts[5].encode()


@pytest.mark.parametrize("least", [2, 3, 16])
def test_grammars_give_back_documents_and_ranges(least):
    rng = np.random.default_rng(least)
    for docs in (1, 2, 40):
        for alphabet in (1, 2, 30):
            n = rng.integers(1, 60, docs)
            ids = rng.choice([7, 2, 50_256, *range(100, 127)][:alphabet], n.sum()).astype(np.uint32)
            g = grammar.unpack(grammar.pack(grammar.compress(ids, n, least)))
            assert (g.expand(g.body) == ids).all()
            ends = np.cumsum(n)
            assert all((g.document(k) == ids[ends[k] - n[k]:ends[k]]).all() for k in range(docs))
            for _ in range(20):
                a, b = sorted(rng.integers(0, len(ids) + 1, 2))
                assert (g.range(a, b) == ids[a:b]).all()
            assert all(len(g.expand(np.array([len(g.ids) + i]))) == g.size[len(g.ids) + i] for i in range(len(g.left)))
    phrase = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(grammar.compress(phrase, np.array([len(phrase)])).body) < len(phrase) / 40


@pytest.mark.parametrize("shard_ids", [700, grammar.SHARD_IDS])
def test_token_files_hold_all_documents(spark, rows, shard_ids):
    got = grammar.round_trip(rows, BYTES, shard_ids, 4).toPandas().sort_values("start")
    tokenizer = library()
    want, start = defaultdict(list), 0
    for doc, text in rows.select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [grammar.END_ID]
        want[doc].append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    seen = defaultdict(list)
    for doc, at, n, crc in got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False):
        doc = None if np.isnan(doc) else int(doc)
        assert at == start
        start += n
        seen[doc].append((n, crc))
    assert {d: sorted(x) for d, x in seen.items()} == {d: sorted(x) for d, x in want.items()}
    known = got.doc_id.dropna()
    assert got.doc_id.isna().head(2).all() and known.is_monotonic_increasing


def test_token_files_prune_by_id(spark, rows):
    shards = grammar.with_offsets(grammar.stored(grammar.token_shards(rows, BYTES, 700, 4), "tokens"))
    one = shards.where((F.col("first_id") <= 5010) & (F.col("last_id") >= 5010)).collect()
    ids = grammar.unpack(one[0].grammar).document(one[0].doc_ids.index(5010))
    assert ids.tolist() == library().encode(ODD[10], add_special_tokens=False).ids + [2]


def brute_alignment(texts):
    """(n_a, n_b, groups text, {pair: times}) by walking over bytes."""
    tokenizer, pieces = library(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = ByteTokens(BYTES).token_bytes()
    out = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = [(i, table[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
             for i in (pieces.encode(text) if text else []) for p in [pieces.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append((0, 0, 0, "", {}))
            continue
        owners = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*owners)))
        pairs = defaultdict(int)
        for i, j in links:
            pairs[a[i][0], b[j][0]] += 1
        groups, x, y, at = [], [], [], 0
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
        for at in range(1, len(whole) + 1):
            if at in ends[0]:
                x.append(str(a[owners[0][at - 1]][0]))
            if at in ends[1]:
                y.append(str(b[owners[1][at - 1]][0]))
            if at in ends[0] and at in ends[1]:
                groups.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs))
    return out


@pytest.mark.parametrize("head", [0, 40, alignment.HEAD_PAIRS])
def test_alignment(spark, rows, head):
    docs = rows.select("doc_id", "text").collect()
    parts = brute_alignment([d.text for d in docs])
    count = defaultdict(int)
    for *_, pairs in parts:
        for p in pairs:
            count[p] += 1
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = sorted((d.doc_id or -1, n_a, n_b, n_groups, sum(pairs.values()), sum(m for p, m in pairs.items() if count[p] == top[p[0]]),
                   sum(m * count[p] for p, m in pairs.items()), sha) for d, (n_a, n_b, n_groups, sha, pairs) in zip(docs, parts))
    got = alignment.scored(alignment.aligned(rows, BYTES, PIECES), head)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r[0] or -1, *r[1:]) for r in got.select(names).collect()) == want


def test_coalescing_with_gaps_and_ties():
    a, b = np.array([[0, 2], [2, 5], [9, 10]]), np.array([[0, 2], [3, 4], [4, 6], [6, 7], [9, 10]])
    group_a, group_b, n = alignment.coalesce(*a.T, *b.T)
    assert group_a.tolist() == [0, 1, 3] and group_b.tolist() == [0, 1, 1, 2, 3] and n == 4
    assert list(zip(*(x.tolist() for x in alignment.overlaps(*a.T, *b.T)))) == [(0, 0), (1, 1), (1, 2), (2, 4)]


@pytest.mark.parametrize("n,k", [(1, 1), (2, 2), (3, 2), (40, 32), (64, 64)])
def test_leading_pairs(n, k):
    rng = np.random.default_rng(n)
    low = rng.normal(size=(5, n))
    for m in (np.cov(rng.normal(size=(3 * n + 5, n)), rowvar=False).reshape(n, n), np.eye(n), np.diag(np.r_[[5.0] * (n // 2), [3.0] * (n - n // 2)]), low.T @ low,
              np.diag(np.logspace(0, -9, n)), np.diag(np.abs(np.arange(n) - n / 2)) + np.eye(n, k=1) + np.eye(n, k=-1), np.zeros((n, n))):
        values, vectors = whitening.leading_pairs(m, k)
        norm = max(np.abs(m).max() * n, 1e-300)
        assert np.allclose(values / norm, np.linalg.eigvalsh(m)[::-1][:k] / norm, atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and np.allclose((m @ vectors - vectors * values) / norm, 0, atol=1e-13)


def brute_whitening(vectors, k):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * a - b for a, b in zip(v, s)] for v in x], dtype=object)
    centred = y.astype(float) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return n, [int(sum(a * a for a in v)) for v in y], centred @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / np.trace(cov)


@pytest.mark.parametrize("big", [1.0, 1e9])  # the large ones need more than 64 bits
def test_whitening(spark, big):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(300, 40)) * big * np.linspace(1, 3, 40)).astype(np.float32).tolist()
    good += good[:5] + [good[0]] * 150  # repeated rows, and one vector that makes up a third
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], good[0][:7], []]
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(good)] + [(None, good[0], 1)] + [(9000 + i, v, 1) for i, v in enumerate(bad)],
                                  "vec_id long, embedding array<float>, x int").repartition(5)
    n, deviation, want, explained = brute_whitening(good + [good[0]], 32)
    got = whitening.whitened(table).toPandas()
    assert len(got) == n * 32 and (got.n == n).all() and got.identity_error.max() < 1e-8 and got.identity_error.nunique() == 1
    assert got.vec_id.isna().sum() == 32 and got.vec_id.max() < 9000
    known = got.dropna(subset="vec_id").sort_values(["vec_id", "component"])
    one = known[known.component == 1].deviation
    # Deviations beyond 64 bits are null.
    assert one.isna().all() if big > 1 else one.tolist() == deviation[:-1]
    seen = known.whitened.to_numpy().reshape(-1, 32)
    assert np.allclose(seen * np.sign((seen * want[:-1]).sum(axis=0)), want[:-1], atol=1e-6)
    assert np.allclose(known.explained.to_numpy()[:32], explained, rtol=1e-9)


def test_whitening_of_poor_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).toPandas()
    assert len(same) == 6 and (same.whitened == 0).all() and (same.deviation == 0).all() and (same.identity_error == 0).all()
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], schema)).toPandas()
    assert sorted(flat[flat.vec_id == 0].explained.round(9)) == [0.0, 1.0] and flat.identity_error.max() < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert grammar.round_trip(none, BYTES).count() == 0
    assert alignment.scored(alignment.aligned(none, BYTES, PIECES)).count() == 0
