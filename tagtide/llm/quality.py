"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_arrow, map_batches, parts_of, utf8

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"


class Page:
    """A text and what rules have asked of it so far; each figure is worked out at most once."""

    def __init__(self, text: str, words: list[bytes]):
        self.text, self.words, self.n = text, words, len(words)
        self._known: dict[str, float] = {}

    def figure(self, name: str, of: Callable[[str, list[bytes]], float]) -> float:
        if name not in self._known:
            self._known[name] = of(self.text, self.words)
        return self._known[name]


class Rule(NamedTuple):
    """``rejects`` tells whether a page with words goes. Rules are pure: their order changes only the cost."""

    name: str
    rejects: Callable[[Page], bool]


def word_chars(text: str, words=None) -> int:
    return len(text) - sum(map(text.count, SPACES))


def symbols(text: str, words=None) -> int:
    return sum(map(text.count, SYMBOLS))


def repeated_lines(text: str, words=None) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return repeats


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that are found at least twice."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window = codes[: n - width + 1]
    for k in range(1, width):
        if k > 1:  # ranks, so that a code stays under the square of n
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(ids) + codes[k : n - width + 1 + k]
    _, place, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


_letters = re.compile(r"[^\W\d_]+")


def _letter_share(text: str, words) -> float:
    return sum(map(len, _letters.findall(text))) / max(1, word_chars(text))


def _capitals(text: str, words) -> float:
    upper = sum(map(str.isupper, text))
    return upper / max(1, upper + sum(map(str.islower, text)))


#: Thresholds leave a wide margin to prose, whatever its language.
RULES = (
    Rule("symbols", lambda p: p.figure("symbols", symbols) > 0.25 * p.n),
    Rule("exclamations", lambda p: p.text.count("!") + p.text.count("?") > 0.5 * p.n),
    Rule("word_length", lambda p: not 2 <= p.figure("word_chars", word_chars) / p.n <= 16),
    Rule("capitals", lambda p: p.figure("capitals", _capitals) > 0.6),
    Rule("letters", lambda p: p.figure("letters", _letter_share) < 0.5),
    Rule("repeated_lines", lambda p: p.figure("repeated_lines", repeated_lines) > 0.5 * (p.text.count("\n") + 1)),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 1_000) -> dict[str, tuple[float, float]]:
    """Seconds and rejected share of each rule, over the first ``sample_rows`` rows that a scan gives.

    Every rule sees every page of the sample afresh. Times are added up in the tasks; two numbers a
    rule come back. The estimate decides the order of rules and nothing else.
    """

    def run(batch):
        rows = []
        for raw in batch.column(0).to_pylist():
            words = raw.split()
            if words:
                page = raw.decode("utf-8", "replace")
                for rule in rules:
                    began = time.perf_counter()
                    gone = rule.rejects(Page(page, words))
                    rows.append((rule.name, time.perf_counter() - began, float(gone)))
        names, seconds, gone = zip(*rows) if rows else ((), (), ())
        return {"rule": list(names), "seconds": list(seconds), "gone": list(gone)}

    timed = map_batches(docs.limit(sample_rows).select(utf8(text)), run, "rule string, seconds double, gone double")
    return {r.rule: (r.seconds, r.gone) for r in timed.groupBy("rule").agg(F.avg("seconds").alias("seconds"), F.avg("gone").alias("gone")).collect()}


def ordered(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Highest rejection per second first; rules without a figure stay in place at the end."""
    rate = {name: gone / max(seconds, 1e-9) for name, (seconds, gone) in measured.items()}
    return sorted(rules, key=lambda rule: -rate.get(rule.name, -1.0))


def base_fails(n_words: int, n_repeat_words: int, min_words: int = 50, max_repeat: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat_words > max_repeat * n_words


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id: str = "doc_id", text: str = "text", sample_rows: int = 1_000) -> DataFrame:
    """One row per document: its id, base figures, ``base_failed`` and ``kept``.

    A page that fails the base goes; others go at the first rule that rejects them, and later rules
    are not run. A null or empty text has no words and fails the base. Repeated rows get equal
    verdicts; ids may be null; no rows give no rows. One pass over the texts, no shuffle.
    """
    cascade = ordered(rules, measure(docs, rules, text, sample_rows))

    def run(batch):
        out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
        for raw in batch.column(1).to_pylist():
            page, words = raw.decode("utf-8", "replace"), raw.split()
            seen = Page(page, words)
            repeats = repeated_words(words)
            failed = base_fails(len(words), repeats)
            row = (
                len(words),
                seen.figure("word_chars", word_chars),
                seen.figure("symbols", symbols),
                seen.figure("repeated_lines", repeated_lines),
                repeats,
                failed,
                not failed and not any(rule.rejects(seen) for rule in cascade),
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        return out | {"id": batch.column(0)}

    kind = docs.schema[id].dataType.simpleString()
    made = map_batches(docs.select(F.col(id).alias("id"), utf8(text)), run, f"id {kind}, {FIELDS}")
    return made.withColumnRenamed("id", id)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = 1_000) -> DataFrame:
    """The rows that pass, with all their columns. Base figures are worked out only as far as needed."""
    cascade = ordered(rules, measure(docs, rules, text, sample_rows))
    schema = docs.schema
    place = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches):
        # Texts are read as they came, without a second column of them.
        for batch in (part for whole in batches for part in parts_of(whole, 512)):
            good = []
            for raw in batch.column(place).cast(pa.binary()).to_pylist():
                raw = raw or b""
                words = raw.split()
                page = Page(raw.decode("utf-8", "replace"), words)
                good.append(
                    len(words) >= 50
                    and not any(rule.rejects(page) for rule in cascade)
                    and not base_fails(len(words), repeated_words(words))
                )
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, run, schema)
