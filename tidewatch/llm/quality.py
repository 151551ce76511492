"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when its measure exceeds a cutoff. Raising the bar is only
allowed where the labels prove it harmless: for every (stratum, rule, cutoff) the good
labelled documents of the stratum are counted, and a cutoff counts as safe if the exact
binomial upper bound of its false rejection rate is at most ``max_rejection``. The error
probability is divided by the number of tests, so all chosen cutoffs hold at once with
probability ``1 - delta``, and ``max_rejection`` is divided by the number of rules, so that the
union of the rules keeps the promise as well. The strictest safe cutoff of each rule is used.

All good labels count. Measures are kept without texts, and only doc_id, stratum and measures are
shuffled to the labels; the table of cutoffs, one row for each stratum, is broadcast if it has been
counted to be small.

Everything is column expressions: a scan for the measures, one join of measures and labels, and
where whole documents are asked for a second scan that measures them beside their verdict.

Defined results: a null text is empty; a document without words fails the base rule; a null
stratum is a stratum of its own; a stratum without enough labels gets no cutoff (nothing but the
base rule rejects there); without labels only the base rule acts; repeated rows are judged
alike; a document labelled more than once counts once for each of its labels; other columns pass
through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.candidates import small
from tidewatch.llm.common import fresh, whole, words
from tidewatch.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects where ``measure`` (an expression over the measure columns) is over a cutoff."""
    name: str
    measure: str
    cutoffs: tuple[float, ...]


DEFAULT_RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5)),
)


@dataclass(frozen=True)
class Risk:
    max_rejection: float = 0.02
    delta: float = 0.05
    rules: tuple[Rule, ...] = field(default=DEFAULT_RULES)


def _repeated(hashes: Column) -> Column:
    """Words under 8-word windows that occur twice or more, from the windows' hashes in order."""
    def count(spots: Column) -> Column:
        # spots: start positions of repeated windows, ascending; the union of [p, p + 8)
        return F.aggregate(
            spots, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    def spots(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(F.array(pairs), lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])),
            lambda x: x["i"])))[0]

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(count(spots(hashes)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    w, lines, h, once = fresh([*docs.columns, *names], "w", "lines", "h", "once")
    text = whole()
    step = docs.withColumn(w, words(text)).withColumn(
        lines, F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    # Hashes of 1, 2, 4 and 8 words: each level joins two neighbours of the level below.
    step = step.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    for apart in (1, 2, 4):
        step = step.withColumn(h, F.expr(f"transform(`{h}`, (x, i) -> xxhash64(x, get(`{h}`, i + {apart})))"))
    step = step.withColumn(h, F.slice(h, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))
    values = [F.size(w), F.length(F.array_join(w, "")), F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")), F.size(lines),
              F.size(lines) - F.size(F.array_distinct(lines)), _repeated(F.col(h))]
    # A later filter on a measure would be pushed below this projection and measure the text again
    # for each mention; it stops at a projection that isn't deterministic.
    step = step.select(*docs.columns, *(v.cast("bigint").alias(n) for v, n in zip(values, names)),
                       F.monotonically_increasing_id().alias(once))
    return step.where(F.col(once) >= 0).drop(once)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 20) | (100 * F.col(n_repeat_words) > 30 * F.col(n_words))


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), summed term by term in log space."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct(
        (a["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
        (F.greatest(a["sum"], a["term"] + F.log((n - i + 1) / i) + odds)
         + F.log1p(F.exp(-F.abs(a["sum"] - a["term"] - F.log((n - i + 1) / i) - odds)))).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"])


def cutoff_table(good: DataFrame, stratum: str, risk: Risk) -> DataFrame:
    """The strictest safe cutoff of each rule for each stratum: (stratum, <rule name>, ...).

    ``good`` has the measures and the stratum of the good labelled documents. A row for each
    stratum, a column for each rule; null where no cutoff is safe.
    """
    tests = [(r, c) for r in risk.rules for c in r.cutoffs]
    each = max(len(risk.rules), 1)
    counts = good.groupBy(stratum).agg(F.count("*").alias("n"), *(
        F.count_if(F.expr(r.measure) > c).alias(f"k{i}") for i, (r, c) in enumerate(tests)))
    counts = materialize(counts)
    # Bonferroni over strata and tests.
    limit = F.log(F.lit(risk.delta / (max(counts.count(), 1) * len(tests))))
    safe = lambda i, c: F.when(
        (F.col(f"k{i}") < F.col("n") * (risk.max_rejection / each))
        & (_log_tail(F.col(f"k{i}"), F.col("n"), risk.max_rejection / each) <= limit), F.lit(c))
    out, at = [], 0
    for rule in risk.rules:
        cuts = [safe(at + i, c) for i, c in enumerate(rule.cutoffs)]
        out.append((F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias(rule.name))
        at += len(rule.cutoffs)
    return counts.select(stratum, *out)


def _keyed(docs: DataFrame, stratum: str) -> DataFrame:
    key = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", key.alias("stratum"))


def _measures(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and measures of every document, written once without texts."""
    return materialize(measured(_keyed(docs, stratum).drop("row")).drop("text"))


def _verdicts(rows: DataFrame, measures: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """``rows`` (measured) with ``base_failed``, cutoffs and ``kept``; good labels (quality = 1) join ``measures`` by doc_id."""
    good = measures.where(~base_failed()).join(labels.where("quality = 1").select("doc_id"), "doc_id")
    cuts = cutoff_table(good, "stratum", risk).withColumnsRenamed({r.name: f"cut_{r.name}" for r in risk.rules})
    rows = rows.withColumn("base_failed", base_failed()).join(small(cuts), "stratum", "left")
    bad = F.col("base_failed")
    for r in risk.rules:
        bad = bad | F.coalesce(F.expr(r.measure) > F.col(f"cut_{r.name}"), F.lit(False))
    return rows.withColumn("kept", ~bad)


def verdicts(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """doc_id, measures, ``base_failed`` and ``kept`` of every document, measured once."""
    measures = _measures(docs, stratum)
    return _verdicts(measures, measures, labels, risk)


def judged(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """Every document as struct ``row`` with what ``verdicts`` gives.

    Texts are measured twice, once for the cutoffs and once beside the whole document: joining the
    measures to the documents would shuffle all texts.
    """
    return _verdicts(measured(_keyed(docs, stratum)), _measures(docs, stratum), labels, risk)


def sql(risk: Risk = Risk()) -> str:
    """The same verdict in DuckDB's SQL; binomial tails come from log-gamma terms there."""
    each, tests = risk.max_rejection / max(len(risk.rules), 1), sum(len(r.cutoffs) for r in risk.rules)
    tail = (f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) "
            f"+ i * ln({each!r}) + (n - i) * ln({1 - each!r}))))")
    cuts = ", ".join(
        f"""r{i} AS (SELECT s, min(c) AS cut FROM (SELECT s, c, count(*) AS n, count(*) FILTER (CAST({r.measure} AS DOUBLE) > c) AS k
  FROM good, (SELECT unnest([{', '.join(repr(float(c)) for c in r.cutoffs)}]) AS c) GROUP BY s, c)
  WHERE k < n * {each!r} AND {tail} <= {risk.delta!r} / ((SELECT count(DISTINCT s) FROM good) * {tests}) GROUP BY s)""" for i, r in enumerate(risk.rules))
    joins = " ".join(f"LEFT JOIN r{i} ON r{i}.s = m.s" for i in range(len(risk.rules)))
    over = " OR ".join(f"coalesce(CAST({r.measure} AS DOUBLE) > r{i}.cut, FALSE)" for i, r in enumerate(risk.rules))
    shown = ", ".join(f"CAST(r{i}.cut AS DOUBLE) AS cut_{r.name}" for i, r in enumerate(risk.rules))
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS s FROM documents),
w AS (SELECT rn, doc_id, s, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM d),
g AS (SELECT rn, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
h AS (SELECT rn, count(DISTINCT i + j) AS n FROM (SELECT rn, i, unnest(range({WINDOW})) AS j FROM (
  SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM g) WHERE c > 1) GROUP BY rn),
m AS (SELECT w.doc_id, w.s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(h.n, 0) > 30 * len(w) AS base_failed FROM w LEFT JOIN h ON h.rn = w.rn),
good AS (SELECT m.* FROM m JOIN labels ON labels.doc_id = m.doc_id WHERE quality = 1 AND NOT base_failed),
{cuts}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept, {shown} FROM m {joins}"""
