"""Licence statements whose part in a text holds no licence word."""

from tidewatch.llm import licences

TEXTS = {1: "No part of this work may be reproduced without written consent.", 2: "All  rights  reserved.", 3: "A cat sat on a mat."}


def test_parts_of_statements_without_a_licence_word_are_candidates(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.paragraph_licences(docs).collect()}
    assert set(got) == {1, 2}
    assert all(r.found == "proprietary" and r.confirmed and r.containment >= 0.6 for r in got.values())


def test_every_sufficient_part_of_a_statement_holds_an_anchor_or_a_stem():
    import itertools, math, re
    anchors = set(licences.anchors(0.6))
    for text in (t for some in licences.STATEMENTS.values() for t in some):
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        grams = {" ".join(words[i:i + 3]) for i in range(len(words) - 2)}
        free = [g for g in grams if g not in anchors and not licences.LICENCE_STEM.search(g)]
        assert len(free) < math.ceil(0.6 * len(grams) - 1e-9)


def test_candidates_hold_an_anchor_whatever_its_gaps(spark):
    from pyspark.sql import functions as F
    settings = licences.Settings()
    texts = ["Be Reproduced -- without", "x.be\treproduced\nwithout.", "be reproduced without", "maybe reproduced without", "be reproduced withoutx",
             "be reproducedwithout", "ébe reproduced without", "be reproduced without\U00010400", "\U0001f600be_reproduced_without\U0001f600", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i for r in rows.where(licences.candidate(F.col("text"), settings)).collect()}
    assert got == {0, 1, 2, 8}


def test_scoring_is_planned_once(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    rows = licences.document_licences(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" :+-").startswith("Filter") and "array_intersect" in line for line in plan.split("\n"))
