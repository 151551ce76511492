"""Secret scan: fixed patterns, and password guess costs of values in credential context.

Fixed patterns (assign, access, hex) are matched over the whole text. Besides them, every value that
stands after a credential word and a sign of assignment, or between user and host of a URL, is
priced by the number of guesses an informed attacker needs: a dynamic program finds the cheapest
segmentation of the value into

* words of a list (guesses: rank, times choices of capitals, leet letters and reversal),
* dates and years,
* repeats of a unit,
* keyboard walks and alphabetic or numeric sequences,
* brute force characters (the size of their class each).

Costs are log10 of guesses; segments add up. A value of at least ``min_cost`` is reported as a span
of kind ``guess``; cheaper values (placeholders, names, ordinary words) are counted as weak.
The program looks back a bounded number of characters (the longest word, date or unit),
so its time is linear in the value and no value is cut.

Defined results: a null or empty text gives no spans; overlapping kinds are all reported, and a
guessed value may lie inside a base span; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.shingles import sliced

# Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more

# Credential context: a word, up to a few name parts, a sign of assignment, a value up to white space or a quote.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"""
    r"""[\w-]{0,24}["']?\s{0,4}(?::=|=>|[:=])\s{0,4}["']?([^\s"'<>]+)""", re.ASCII)
USERINFO = re.compile(r"""[a-z][a-z0-9+]{1,15}://[^\s/:@"']{1,64}:([^\s/@"']+)@""")

# One of these stands in every match of ASSIGN and CONTEXT.
STEMS = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "auth")

# Common words of passwords and placeholders, most common first.
COMMON_WORDS = """password secret admin token test user login welcome changeme example letmein root master key pass
default qwerty monkey dragon sunshine princess football shadow michael superman batman trustno iloveyou hello
freedom whatever computer internet server system database service public private access account guest temp
temporary demo sample dummy dev prod staging local localhost value string here your my the none null true false
undefined insert enter change replace todo fixme redacted hidden masked removed xxx api app data config client
company summer winter spring autumn love baby angel star money ninja hunter killer soccer hockey tiger jordan
charlie daniel thomas robert jessica ashley george andrew joshua matthew pepper ginger cookie cheese coffee orange
banana flower purple yellow silver golden black white green blue red secure security safe open magic lucky power
world google apple samsung windows linux monday friday january october december""".split()

# Neighbours on a keyboard row or column, and the two sequences.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm",
        "abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("4@831!05$7", "aabeiiosst")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")


@dataclass(frozen=True)
class Guesser:
    """Prices values; ``words`` from the most to the least common."""
    words: tuple[str, ...] = field(default=tuple(COMMON_WORDS))
    longest_unit: int = 8

    def __post_init__(self):
        ranks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            ranks.setdefault(w.lower(), i + 1)
        object.__setattr__(self, "_ranks", ranks)
        object.__setattr__(self, "_longest", max(map(len, ranks), default=0))
        follows = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
        object.__setattr__(self, "_follows", follows)

    def _word(self, piece: str) -> float | None:
        low = piece.lower()
        best = None
        for form, extra in ((low, 0.0), (low.translate(LEET), None), (low[::-1], log10(2))):
            rank = self._ranks.get(form)
            if rank is None:
                continue
            if extra is None:
                extra = sum(a != b for a, b in zip(low, form)) * log10(2)
            capitals = sum(c.isupper() for c in piece)
            if capitals in (len(piece), 1) and (piece[0].isupper() or capitals > 1):
                extra += log10(2)
            elif capitals:
                extra += log10(sum(comb(len(piece), k) for k in range(1, capitals + 1)))
            cost = log10(rank + 1) + extra
            best = cost if best is None else min(best, cost)
        return best

    @staticmethod
    def _single(c: str, plain: bool) -> float:
        if c.isdigit():
            return 1.0
        if c.isalpha():
            return 0.6 if plain else 1.3  # a value of small letters only may be a word that isn't listed
        return 1.5

    def cost(self, value: str) -> float:
        """log10 of the guesses of the cheapest segmentation."""
        n = len(value)
        plain = value.isalpha() and (value[1:].islower() or not value[1:])
        low = value.lower()
        # Lengths of runs that end at each place: walks, and repeats of units of 1 to longest_unit.
        walk = [1] * n
        for i in range(1, n):
            if (low[i - 1], low[i]) in self._follows or (low[i], low[i - 1]) in self._follows:
                walk[i] = walk[i - 1] + 1
        repeat = [[0] * n for _ in range(self.longest_unit + 1)]
        for unit in range(1, self.longest_unit + 1):
            run = repeat[unit]
            for i in range(unit, n):
                run[i] = run[i - 1] + 1 if value[i] == value[i - unit] else 0
        dates: dict[int, list[tuple[int, float]]] = {}
        for pattern, price in ((DATE, 4.6), (YEAR, 2.0)):
            for start in range(n):
                if value[start].isdigit() and (m := pattern.match(value, start)):
                    dates.setdefault(m.end(), []).append((start, price))
        best = [0.0] * (n + 1)
        for end in range(1, n + 1):
            low_cost = best[end - 1] + self._single(value[end - 1], plain)
            for start in range(max(0, end - self._longest), end - 2):
                word = self._word(value[start:end])
                if word is not None:
                    low_cost = min(low_cost, best[start] + word)
            for start, price in dates.get(end, ()):
                low_cost = min(low_cost, best[start] + price)
            length = walk[end - 1]
            if length >= 4:
                low_cost = min(low_cost, best[end - length] + log10(47 * 4) + log10(length))
            for unit in range(1, self.longest_unit + 1):
                run = repeat[unit][end - 1]
                if run >= max(unit, 2):
                    start = end - run - unit
                    # The unit is paid for once; its price is what it cost where it stood first.
                    low_cost = min(low_cost, best[start + unit] + log10(run / unit + 2))
            best[end] = low_cost
        return best[n]


def _spans(text: str, guesser: Guesser, min_cost: float) -> tuple[list[tuple[int, str, int]], int, float]:
    low = text.lower()
    context = ("=" in text or ":" in text) and any(stem in low for stem in STEMS)
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if context else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    weak, most = 0, 0.0
    values = {m.span(1) for m in CONTEXT.finditer(text)} if context else set()
    if "://" in text:
        values |= {m.span(1) for m in USERINFO.finditer(text)}
    for start, end in sorted(values):
        value = text[start:end].rstrip(".,;:!?)]}")
        cost = guesser.cost(value)
        most = max(most, cost)
        if cost >= min_cost:
            spans.append((start, 3, start + len(value)))
        else:
            weak += 1
    return sorted(spans), weak, most


KINDS = ("assign", "access", "hex", "guess")


def _told(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, guesser: Guesser | None = None, min_cost: float = 10.0) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, n_weak, guess_cost."""
    guesser = guesser or Guesser()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, weak, most = _spans(text or "", guesser, min_cost)
                base = [s for s in spans if s[1] < 3]
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc_id, *n[:3], hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), n[3], weak, most))
            if rows:
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak", "guess_cost"]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_weak long, guess_cost double")
