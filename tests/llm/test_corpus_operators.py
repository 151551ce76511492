"""Sharding, mixing, decontamination and the pipeline."""

import math
import random
import zlib

import pytest

import corpus_pipeline
from tidewatch.llm import decontaminate, mixing, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, row string, tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "h", "big", "r", "t") for i, t, s in rows], SCHEMA)


def least_capacity(sizes, n):
    low, high = max(sizes, default=1), sum(sizes) or 1
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("case", ["many", "hot", "few", "odd"])
def test_shards_are_minimax(spark, case, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_PER_SLOT_RANGE", 100)
    rng = random.Random(case)
    texts = {"many": [f"{i} " * rng.randint(1, 300) for i in range(600)],
             "hot": ["copy " * 50] * 300 + [f"{i} " * rng.randint(1, 60) for i in range(200)],
             "few": ["a", "b", "a"], "odd": [None, "", "é", None, "é", "x" * 100_000]}[case]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")])
    rows = shards.placed(docs, 24).collect()
    assert len(rows) == len(texts) + 1
    groups = {}
    for r in rows:
        text = r.row.text or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        groups.setdefault(r.h, [0, set()])
        groups[r.h][0] += r.size
        groups[r.h][1].add(r.shard)
    ordered = [groups[h] for h in sorted(groups, key=lambda h: h % (1 << 64))]
    assert all(len(s) == 1 for _, s in ordered)
    flat = [next(iter(s)) for _, s in ordered]
    assert flat == sorted(flat) and 0 <= flat[0] and flat[-1] < 24
    loads = {}
    for size, s in ordered:
        loads[next(iter(s))] = loads.get(next(iter(s)), 0) + size
    assert max(loads.values()) == least_capacity([g[0] for g in ordered], 24)
    if case == "many":
        assert min(loads.values()) > 0.9 * max(loads.values()) and len(loads) == 24
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_no_documents_to_shard(spark):
    assert shards.placed(frame(spark, []), 24).count() == 0


def mix_docs(spark):
    rng = random.Random(1)
    shares = {"a": 400, "b": 100, "c": 30, None: 10}
    rows = [(0, None, "a"), (1, "", "b"), (1, "", "b"), (None, "one two", "z")]
    for source, n in shares.items():
        rows += [(len(rows) + i, "w " * rng.randint(1, 40), source) for i in range(n)]
    return frame(spark, rows), rows


@pytest.mark.parametrize("docs_per_block", [10, 20_000])
def test_passes_keep_the_limit_and_the_budget(spark, docs_per_block, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", docs_per_block)
    docs, rows = mix_docs(spark)
    got = mixing.mixed(docs, mixing.Target(max_passes=3.0)).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split())
    used, passes = {}, {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.tokens
        passes[r.source] = r.passes
        assert 0 <= r.mix_order < 1 and 0 <= r["copy"] < math.ceil(r.passes)
    most = max(passes.values())
    assert 2.999 < most <= 3.0001 and min(passes.values()) == pytest.approx(1)
    total = sum(tokens.values())
    # The exponent: passes of a source are its share to the power tau - 1, up to a common factor.
    tau = 1 + math.log(passes["c"] / passes["b"]) / math.log(tokens["c"] / tokens["b"])
    for s in ("a", "b", ""):
        assert passes[s] / passes["c"] == pytest.approx((tokens[s] / tokens["c"]) ** (tau - 1), rel=1e-4)
        assert abs(used[s] - passes[s] * tokens[s]) <= 41
    assert total > 0
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r["copy"]), 0)
    assert {d for d, _ in seen} == {d for d, *_ in rows}  # nothing is dropped
    again = mixing.mixed(docs.repartition(5), mixing.Target(max_passes=3.0)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["copy"], r.mix_order)
    assert [(r.doc_id, r["copy"]) for r in sorted(got, key=key)] == [(r.doc_id, r["copy"]) for r in sorted(again, key=key)]


def test_entropy_target(spark):
    docs, rows = mix_docs(spark)
    _, blocks, tau = mixing.plan(docs, mixing.Target(entropy=0.9))
    passes = {r.source: r.passes for r in blocks.select("source", "passes").distinct().collect()}
    tokens = {}
    for _, t, s in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split())
    w = [passes[s] * tokens[s] for s in tokens]
    entropy = -sum(x / sum(w) * math.log2(x / sum(w)) for x in w) / math.log2(len(w))
    assert entropy == pytest.approx(0.9, abs=1e-3) and 0 < tau < 1
    assert mixing.plan(docs, mixing.Target(entropy=1e-9))[2] == 1.0
    assert mixing.mixed(docs.limit(0)).count() == 0


ITEM = "A train leaves Boston at 40 km per hour and another leaves Denver at 60 km per hour so when will both of them meet if 40 turns to 80 later on"
PROSE = "the quiet river ran along the road and nobody in the village cared about it since the mill had closed"


def leaks(spark, texts, items=(ITEM,)):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}


def test_leaks_and_their_kinds(spark):
    consistent = ITEM.replace("Boston", "Paris").replace("Denver", "Rome").replace("40", "70").replace("60", "90").replace("80", "140").replace("km", "miles")
    inconsistent = ITEM.replace("at 40", "at 70").replace("60", "90")  # 40 is both 70 and 40
    texts = [f"{PROSE}. {ITEM}. {PROSE}", f"{PROSE}. {consistent}", inconsistent, PROSE, None, "", " ".join(ITEM.split()[:12]), ITEM, ITEM + "\n" + PROSE * 500]
    got = leaks(spark, texts)
    assert got == {(0, 0): "verbatim", (1, 0): "rewritten", (7, 0): "verbatim", (8, 0): "verbatim"}


def test_odd_benchmarks(spark):
    assert leaks(spark, [ITEM], []) == {} and leaks(spark, [], [ITEM]) == {}
    assert leaks(spark, ["some five plain words here", PROSE], [None, "", "some five plain words here", "1 2 3"]) == {(0, 2): "verbatim"}


def test_plain_windows_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [a + b for a in "bcdfgklm" for b in ("a", "e", "io", "un")]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(12)]
    texts = []
    for _ in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 30))
        if rng.random() < 0.5:
            item = rng.choice(items).split()
            a, b = sorted(rng.sample(range(len(item) + 1), 2))
            text = text[:10] + item[a:b] + text[10:]
        texts.append(" ".join(text))
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for i, item in enumerate(items):
            x = item.split()
            spots = {}
            for p in range(len(w) - 7):
                for k in range(len(x) - 7):
                    if w[p:p + 8] == x[k:k + 8]:
                        spots.setdefault(p - k, set()).add(k)
            if any(len(s) >= 0.6 * (len(x) - 7) for s in spots.values()):
                want.add((d, i))
    assert set(leaks(spark, texts, items)) == want and want


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name.startswith(("mixing", "sharding")):
            assert ids == was
        before = after
    assert {"shard", "slot"} <= set(before.columns)
    odd = frame(spark, [(None, None, None), (1, "", "s"), (2, "w " * 30, "s"), (2, "w " * 30, "s")])
    for _, stage in corpus_pipeline.STAGES:
        assert set(stage(spark, odd, folder).columns) >= set(odd.columns) and stage(spark, odd.limit(0), folder).count() == 0
