"""Line dedup, passage dedup and the n-gram join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import candidates, components, line_dedup, ngram_join, passages, runs, shingles, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, h string, key int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "h", 1) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]


def near_texts(seed=1, families=12, copies=6):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = words(rng, rng.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper() + "!", None, "", "  ", "one two", "one two", "x " * 20_000]
    return texts


def sets_of(texts, shingler):
    out = []
    for t in texts:
        norm = shingler.normal(t or "")
        if not norm:
            out.append(frozenset())
            continue
        units = norm.split(" ") if isinstance(shingler, shingles.WordShingles) else norm
        k = shingler.size
        out.append(frozenset(tuple(units[i:i + k]) for i in range(max(len(units) - k + 1, 1))))
    return out


def alike(a, b, t=0.8):
    return bool(a and b) and len(a & b) >= t * len(a | b) - 1e-9


def classes_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_join_matches_brute_force(spark):
    texts = near_texts()
    norm = [ngram_join.SHINGLER.normal(t or "") for t in texts]
    sets = sets_of(texts, ngram_join.SHINGLER)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    root = classes_of(len(texts), links)
    got = {r.doc_id: r for r in ngram_join.joined(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        assert got[i].class_id == root[i]
        others = {norm[b if a == i else a] for a, b in links if i in (a, b)} - {t}
        assert got[i].n_links == len(others)
        assert got[i].n_copies == (norm.count(t) if t else 1)
        assert got[i].text_id == (norm.index(t) if t else i)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_lose_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", block)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", block)
    texts = near_texts(seed=4, families=3, copies=9)
    sets = sets_of(texts, ngram_join.SHINGLER)
    norm = [ngram_join.SHINGLER.normal(t or "") for t in texts]
    got = {r.doc_id: r.n_links for r in ngram_join.joined(frame(spark, texts)).collect()}
    for i in range(len(texts)):
        assert got[i] == len({norm[j] for j in range(len(texts)) if alike(sets[i], sets[j])} - {norm[i]})


def test_one_document_of_each_class_stays(spark):
    texts = near_texts(seed=2)
    sets = sets_of(texts, ngram_join.SHINGLER)
    root = classes_of(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])])
    docs = frame(spark, texts).unionByName(frame(spark, [texts[0], "no id", "no id"], [0, None, None]))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids == sorted(set(root)) and got.where("doc_id IS NULL").count() == 2
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_copies_with_and_without_ids(spark):
    base = words(random.Random(6), 100)
    text, near = " ".join(base), " ".join([*base[:-1], "changed"])
    docs = frame(spark, [text, text, near, near, "lone text", "lone text"], [5, None, 3, None, None, None])
    rows = ngram_join.joined(docs).collect()
    got = sorted(((r.doc_id, r.class_id, r.text_id, r.n_links, r.n_copies) for r in rows), key=str)
    assert got == sorted([(5, 3, 5, 1, 2), (None, 3, 5, 1, 2), (3, 3, 3, 1, 2), (None, 3, 3, 1, 2)] + [(None, None, None, 0, 2)] * 2, key=str)
    kept = ngram_join.one_of_each(docs)
    assert [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()] == [3] and kept.count() == 5


def test_posterior_is_the_beta_tail():
    rng = np.random.default_rng(0)
    for m, n in ((20, 30), (26, 30), (100, 150)):
        assert ngram_join.posterior(m, n, 0.8) == pytest.approx((rng.beta(m + 1, n - m + 1, 400_000) >= 0.8).mean(), abs=4e-3)


def line_docs():
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randint(6, 30))) for _ in range(30)]

    def changed(line):
        at = rng.randrange(len(line))
        return line[:at] + rng.choice("xyz") + line[at + 1:]
    docs = []
    for _ in range(25):
        lines = [rng.choice(base) for _ in range(rng.randint(1, 6))]
        docs.append("\n".join(changed(x) if rng.random() < 0.5 else x for x in lines) + rng.choice(["", "\n", "\n\n  \n"]))
    return docs + [None, "", "\n\n", "ab", "AB ", "k " * 5000 + "\n" + "k " * 5000]


def test_lines_match_brute_force(spark):
    docs = line_docs()
    spots = [(d, n, line) for d, t in enumerate(docs) for n, line in enumerate((t or "").split("\n")) if line.strip()]
    sets = sets_of([x for *_, x in spots], line_dedup.SHINGLER)
    root = classes_of(len(spots), [(a, b) for a in range(len(spots)) for b in range(a) if alike(sets[a], sets[b])])
    want = {(d, n): spots[r][:2] for (d, n, _), r in zip(spots, root) if spots[r][:2] != (d, n)}
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.removals(frame(spark, docs)).collect()}
    assert got == want
    clean = {r.doc_id: r.text for r in line_dedup.cleaned(frame(spark, docs)).collect()}
    for d, t in enumerate(docs):
        assert clean[d] == (t and "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want))


def test_a_typo_in_a_short_line(spark):
    rng = random.Random(11)
    docs, want = [], set()
    for n in range(30, 61):
        line = " ".join(words(rng, 30))[:n - 1] + "h"
        typo = line[:n // 2] + "z" + line[n // 2 + 1:]
        want.add((len(docs) + 1, 1, len(docs)))
        docs += [line, "\n" + typo]
    got = {(r.doc_id, r.line_no, r.kept_doc_id) for r in line_dedup.removals(frame(spark, docs)).collect()}
    assert got == want


def test_passages(spark):
    rng = random.Random(9)
    long_passage = [" ".join(words(rng, 30)) for _ in range(3)]
    short = "a short line that many documents share for no reason"
    own = lambda: " ".join(words(rng, 60))
    near = " ".join(long_passage[0].split()[:-1] + ["changed"])
    docs = ["\n".join([own(), *long_passage, own()]), "\n".join([short, near, "", *long_passage[1:], own()]),
            "\n".join([short, own()]), "\n".join([own(), short]), None, "", "\n".join([own()] * 1), long_passage[0]]
    docs[6] = docs[6] + "\n" + docs[6]
    got = {r.doc_id: r for r in passages.repeats(frame(spark, docs)).collect()}
    assert set(got) == {0, 1}  # the lone paragraph of document 7 has 30 words
    assert docs[0][got[0].start:got[0].stop] == "\n".join(long_passage) and got[0].kept
    assert docs[1][got[1].start:got[1].stop] == docs[1][:docs[1].rindex("\n")] and not got[1].kept
    assert passages.repeats(frame(spark, [])).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: 0 if x < 100 else 100 if x < 200 else 200 for e in edges for x in e}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_are_streamed_in_order(spark):
    rows = [(k % 7, u) for k in range(7) for u in range(k * 3)] * 2 + [(99, 1), (98, 1), (98, 2)]
    got = candidates.members(spark.createDataFrame(rows, "key long, uid long")).collect()
    want = {}
    for k, u in set(rows):
        want.setdefault(k, set()).add(u)
    want = {k: v for k, v in want.items() if len(v) > 1}
    have = {}
    for r in got:
        have.setdefault(r.key, {})[r.at] = r.uid
    assert {k: set(v.values()) for k, v in have.items()} == want and all(sorted(v) == list(range(len(v))) for v in have.values())


@pytest.mark.parametrize("one_pass", [True, False])
def test_signatures_estimate_similarity(one_pass):
    rng = random.Random(1)
    windows = shingles.WordShingles(1).begin()
    signatures, _ = shingles.Bands(64, 4, one_pass=one_pass).begin()
    vocabulary = [f"w{i}" for i in range(2000)]
    for share in (0.2, 0.5, 0.8):
        n = 600
        both = rng.sample(vocabulary, int(2 * n * share / (1 + share)))
        rest = [w for w in vocabulary if w not in set(both)]
        rng.shuffle(rest)
        k = n - len(both)
        a, b = signatures(*windows([" ".join(both + rest[:k]), " ".join(both + rest[k:2 * k])]))
        assert abs((a == b).mean() - share) < 0.1


def test_runs_inside_paragraphs_match_brute_force(spark):
    rng = random.Random(21)
    own = lambda n: [f"{w}{rng.randrange(10 ** 6)}" for w in words(rng, n)]
    shared = [own(n) for n in (49, 50, 51, 90, 200, 60)]
    shared[1][7] = shared[3][40] = "İzm"  # its lower case is longer
    parts = [own(30) + shared[0] + own(80), own(5) + shared[0], own(70) + shared[1] + own(20), shared[1] + own(90), own(90) + shared[2],
             own(3) + shared[2] + own(40) + shared[3], own(20) + shared[3][:55] + own(30), own(20) + shared[3][30:] + own(30),
             shared[4], own(9) + shared[4] + own(300), shared[4], own(10) + shared[5] + own(10) + shared[5], own(40), ["a"] * 120, ["a"] * 60 + own(9)]
    docs = []
    for p in parts:
        gaps = [rng.choice([" ", " ", " ", ", ", "\n", "\n\n...\n"]) for _ in p]
        docs.append("".join(w.upper() + g if rng.random() < 0.3 else w + g for w, g in zip(p, gaps)))
    docs[10] = docs[8]
    found = [re.findall(r"\w+", " ".join(x.lower() for x in d.split("\n"))) for d in docs]
    held = {}
    for d, w in enumerate(found):
        for i in range(len(w) - 49):
            held.setdefault(tuple(w[i:i + 50]), set()).add(d)
    want = set()
    for d, w in enumerate(found):
        hits = [i for i in range(len(w) - 49) if len(held[tuple(w[i:i + 50])]) > 1]
        starts = [i for n, i in enumerate(hits) if not n or i - hits[n - 1] > 50]
        for i, stop in zip(starts, [*starts[1:], len(w)]):
            mine = [k for k in hits if i <= k < stop]
            want.add((d, " ".join(w[i:mine[-1] + 50]), all(min(held[tuple(w[k:k + 50])]) == d for k in mine)))
    rows = frame(spark, docs).select("doc_id", "text", F.xxhash64("text").alias("tid"))
    scanned = rows.mapInArrow(runs.scanned(passages.paragraphs, 50), runs.SCANNED)
    got = runs.repeated(rows, scanned, passages.paragraphs, 50).collect()
    cut = {(r.doc_id, " ".join(re.findall(r"\w+", docs[r.doc_id][r.start:r.stop].replace("\n", " ").lower())), r.kept) for r in got}
    assert cut == want and len(got) == len(want) and len(want) > 8
    assert all(r.n_words == len(re.findall(r"\w+", docs[r.doc_id][r.start:r.stop].lower())) for r in got)
    whole = {r.doc_id for r in passages.repeats(frame(spark, docs)).collect()}
    assert whole == {d for d, _, _ in want}


def packed_rows(key, uid, size, pieces):
    """Batches (part, rows) as the bucketing task gets them: packed by several tasks, sorted by part."""
    parts = []
    for some in np.array_split(np.arange(len(key)), pieces):
        part, rows = candidates.packed(key[some], uid[some], size[some])
        parts += zip(part.to_pylist(), rows.to_pylist())
    parts.sort(key=lambda x: x[0])
    for a in range(0, len(parts), 700):
        part, rows = zip(*parts[a:a + 700])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(rows, pa.binary())], ["part", "rows"])


@pytest.mark.parametrize("held, many", [(4_000_000, 256), (50, 3)])
def test_packed_buckets_hold_all_of_about_one_size(held, many, monkeypatch):
    monkeypatch.setattr(candidates, "HELD", held)
    monkeypatch.setattr(candidates, "MANY", many)
    rng = np.random.default_rng(5)
    uid = rng.integers(-1 << 63, 1 << 63, 3000)
    length = rng.integers(20, 2000, 3000)
    key = np.r_[rng.integers(-1 << 63, 1 << 63, 400)[rng.integers(0, 400, 6000)], np.full(900, 77), rng.integers(-1 << 63, 1 << 63, 3000)]
    piece = rng.integers(0, 3000, len(key))
    packed = list(packed_rows(key, uid[piece], candidates.size_class(length)[piece], 7))
    assert sum(len(r) for b in packed for r in b.column(1).to_pylist()) == 10 * len(key)
    groups = {}
    for b in candidates._buckets(0.8)(iter(packed)):
        for k, s, at in zip(*(c.to_pylist() for c in b.columns)):
            groups.setdefault(k, {}).setdefault(at, set()).add(s)
    together = {(a, b) for g in groups.values() for a in set().union(*g.values()) for b in set().union(*g.values())}
    short = (uid.view(np.uint64) >> np.uint64(24)).astype(int)
    members = {}
    for k, p in zip(key.tolist(), piece.tolist()):
        members.setdefault(k, set()).add(p)
    for m in members.values():
        for a in m:
            for b in m:
                if a != b and min(length[a], length[b]) >= 0.8 * max(length[a], length[b]):
                    assert (short[a], short[b]) in together
    if held > 1000:  # numbered without gaps, and pieces of one size only in a small bucket stay out
        assert all(sorted(g) == list(range(len(g))) and len(g) > 1 for g in groups.values())


def test_sketches_differ_no_more_than_their_sets():
    rng = random.Random(8)
    windows = shingles.CharShingles(3).begin()
    base = " ".join(words(rng, 400))
    texts = []
    for n in (1, 2, 3, 40, 255, 256, 300, 700, 1400):
        texts += [base[:n], base[:n // 2] + "#" + base[n // 2:n], " ".join(words(rng, n))[:n]]
    texts = [line_dedup.SHINGLER.normal(t) for t in texts]
    sizes, sketched = candidates.sketches(*windows(texts))
    sets = sets_of(texts, shingles.CharShingles(3))
    assert sizes.tolist() == [len(s) for s in sets]
    left, right = np.triu_indices(len(texts), 1)
    apart = candidates._distances(sketched)(left, right)
    for a, b, d in zip(left, right, apart):
        assert d <= len(sets[a] ^ sets[b]) and (d - len(sets[a] ^ sets[b])) % 2 == 0
    unlike = [d for a, b, d in zip(left, right, apart) if b == a + 2 and a % 3 == 0 and len(texts[a]) >= 255]
    assert all(d > (sizes[a] + sizes[a + 2]) / 9 for a, d in zip(range(12, 27, 3), unlike))  # long ones are told apart too


@pytest.mark.parametrize("block", [2, 256])
def test_lines_of_large_classes(spark, block, monkeypatch):
    monkeypatch.setattr(units, "BLOCK", block)
    rng = random.Random(13)
    lines = [" ".join(words(rng, 25)) for _ in range(6)]
    docs = []
    for line in lines[:3]:
        for i in range(12):  # a chain: neighbours are alike, the ends need not be
            docs.append(line)
            at = rng.randrange(len(line))
            line = line[:at] + "#" + line[at + 1:]
    docs += lines[3:]
    sets = sets_of(docs, line_dedup.SHINGLER)
    root = classes_of(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if alike(sets[a], sets[b])])
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.removals(frame(spark, docs)).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}


def test_paragraph_bands_leave_a_task_packed():
    rng = random.Random(17)
    lines = [" ".join(words(rng, 12)) for _ in range(40)]
    texts = ["\n".join(rng.choices(lines, k=9)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = units._banded(passages.paragraphs, passages.SHINGLER, passages.SHINGLER, passages.BANDS, False)
    out = list(run(iter([batch])))
    distinct = {x for t in texts for x in t.split("\n")}
    assert sum(len(r) for b in out for r in b.column("rows").to_pylist()) == 10 * passages.BANDS.bands * len(distinct)
    assert all(b.column("uid").null_count == b.num_rows for b in out)
