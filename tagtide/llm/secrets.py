"""Secret scans: all rules compiled into one deterministic automaton that reads each text once.

Rules are unions of sequences of byte classes with repeat bounds. They are compiled by subset
construction into one unanchored automaton over the reversed rules, minimised, and stored as a
transition array of states by bytes. Texts are read backwards in one pass, so a state that accepts a
rule marks a place where a match of that rule starts. Each rule then takes, from left to right, the
first marked start after its last match and extends it as far as the rule's own anchored automaton
allows (leftmost, longest, non-overlapping). For these rules that is what a backtracking regular
expression finds, which the tests confirm.

Many texts are read at once: a batch is laid out as lanes of a byte matrix, and all lanes advance
one byte per step. Lanes are cut only after bytes that lead every state back to the start (text
ends and bytes that no rule uses), so each lane starts in the start state and no text is ever cut
short. Everything is bytes of UTF-8; spans are reported in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagtide.llm.common import as_array, free_name, map_arrow


class Item(NamedTuple):
    """A byte class repeated between ``lo`` and ``hi`` times (``hi`` None: without bound)."""

    bytes: frozenset[int]
    lo: int = 1
    hi: int | None = 1


class Rule(NamedTuple):
    """Matches of ``alternatives``; those shorter than ``least`` bytes are found, then dropped.

    With ``last``, the bound is on the run of the last item (the value after a key word) only.
    """

    kind: str
    alternatives: tuple[tuple[Item, ...], ...]
    least: int = 0
    last: bool = False


def chars(text: str, lo: int = 1, hi: int | None = 1) -> Item:
    return Item(frozenset(text.encode()), lo, hi)


def word(text: str, either_case: bool = False) -> tuple[Item, ...]:
    return tuple(chars(c + (c.swapcase() if either_case else "")) for c in text)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"

# The rules whose spans have to be found, as regular expressions.
#   assign  (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)
#           letters of the key word in either case; group 2 of 6 or more characters
#   access  AKIA[A-Z0-9]+, 20 or more characters
#   hex     [0-9a-f]+, 24 or more characters
# Further rules of this scan, as found in published secret scanners:
#   private_key  -----BEGIN[A-Z ]* PRIVATE KEY-----
#   github       gh[pousr]_[A-Za-z0-9]+, 40 or more characters
#   slack        xox[abprs]-[A-Za-z0-9-]+, 15 or more characters
#   google       AIza[0-9A-Za-z_-]+, 39 or more characters
KEY_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = UPPER + LOWER + DIGITS + "+/_.=-"

# Bounds are counted in the automaton only for hex, which needs no rare prefix: there, runs of 24
# or more are exactly the maximal runs that the bound keeps. Other matches are found whole and then
# dropped if short, so that a short match still hides what starts inside it.
BASE = (
    Rule("assign", tuple(
        (*word(w, either_case=True), chars("\"'", 0, 1), chars(" ", 0, None), chars(":="), chars(" ", 0, None), chars("\"'", 0, 1), chars(VALUE, 1, None))
        for w in KEY_WORDS
    ), least=6, last=True),
    Rule("access", ((*word("AKIA"), chars(UPPER + DIGITS, 1, None)),), least=20),
    Rule("hex", ((chars(DIGITS + "abcdef", 24, None),),)),
)
MORE = (
    Rule("private_key", ((*word("-----BEGIN"), chars(UPPER + " ", 0, None), *word(" PRIVATE KEY-----")),)),
    Rule("github", ((*word("gh"), chars("pousr"), chars("_"), chars(UPPER + LOWER + DIGITS, 1, None)),), least=40),
    Rule("slack", ((*word("xox"), chars("abprs"), chars("-"), chars(UPPER + LOWER + DIGITS + "-", 1, None)),), least=15),
    Rule("google", ((*word("AIza"), chars(UPPER + LOWER + DIGITS + "_-", 1, None)),), least=39),
)
RULES = BASE + MORE

#: Bytes that never occur in UTF-8; a lane puts one after every text.
END = 0xFF


class Automaton(NamedTuple):
    """``step[state, byte]`` is the next state; ``accepts[state]`` a bit per rule; state 0 starts."""

    step: np.ndarray
    accepts: np.ndarray


def _nfa(rules: Sequence[Rule], reverse: bool):
    """States as (edges, epsilons), with accepting states per rule; state 0 is the start."""
    edges: list[list[tuple[frozenset[int], int]]] = [[]]
    eps: list[list[int]] = [[]]
    final: dict[int, int] = {}

    def new() -> int:
        edges.append([])
        eps.append([])
        return len(edges) - 1

    for r, rule in enumerate(rules):
        for alternative in rule.alternatives:
            at = new()
            eps[0].append(at)
            for item in reversed(alternative) if reverse else alternative:
                for _ in range(item.lo):
                    nxt = new()
                    edges[at].append((item.bytes, nxt))
                    at = nxt
                if item.hi is None:
                    loop = new()
                    eps[at].append(loop)
                    edges[loop].append((item.bytes, loop))
                    at = loop
                else:
                    for _ in range(item.hi - item.lo):
                        nxt = new()
                        edges[at].append((item.bytes, nxt))
                        eps[at].append(nxt)
                        at = nxt
            final[at] = final.get(at, 0) | (1 << r)
    return edges, eps, final


def compile_rules(rules: Sequence[Rule], reverse: bool = False, anchored: bool = False) -> Automaton:
    """Subset construction, then minimisation by refining classes of equal acceptance and moves.

    Unanchored: a match may start at every byte. Anchored: only at the first; the state without
    any live thread (the dead state) then loops on itself.
    """
    edges, eps, final = _nfa(rules, reverse)

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in eps[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    # Bytes that no class tells apart share one column of moves.
    classes: dict[tuple, list[int]] = {}
    sets = sorted({s for out in edges for s, _ in out}, key=sorted)
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    start = closure([0])
    index = {start: 0}
    order = [start]
    moves: list[list[int]] = []
    for current in order:
        row = []
        for members in classes.values():
            b = members[0]
            reached = {t for s in current for bs, t in edges[s] if b in bs}
            nxt = closure(reached) | (start if not anchored else frozenset())
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        moves.append(row)
    accepts = np.array([np.bitwise_or.reduce([final.get(s, 0) for s in state] + [0]) for state in order], dtype=np.int64)
    by_class = np.array(moves, dtype=np.int64)
    # Moore refinement: states stay together while they accept alike and move to like classes.
    label = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        signature = np.column_stack([label, label[by_class]])
        _, refined = np.unique(signature, axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == label.max():
            break
        label = refined
    # Renumber so that the start state is 0.
    first = {}
    for s in range(len(order)):
        first.setdefault(int(label[s]), s)
    ids = np.empty(len(first), dtype=np.int64)
    ranked = sorted(first, key=first.get)
    ids[ranked] = np.arange(len(ranked))
    column = np.empty(256, dtype=np.int64)
    for c, members in enumerate(classes.values()):
        column[members] = c
    step = ids[label[by_class[[first[k] for k in ranked]]]][:, column]
    return Automaton(step.astype(np.int32), accepts[[first[k] for k in ranked]])


class Scanner:
    """The reversed unanchored automaton of all rules and one anchored automaton a rule."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        self.back = compile_rules(self.rules, reverse=True)
        self.ahead = [compile_rules([rule], anchored=True) for rule in self.rules]
        # Where the bound is on the last item: the part before it, whose longest match is what the rule takes.
        heads = [compile_rules([Rule(rule.kind, tuple(a[:-1] for a in rule.alternatives))], anchored=True) if rule.last else None for rule in self.rules]
        # Bytes after which every state is the start: lanes may be cut there.
        self.resets = np.flatnonzero((self.back.step == 0).all(axis=0))
        assert END in self.resets
        self.flat = (self.back.step * 256).ravel()
        self.tables = [self._table(a) for a in self.ahead]
        self.heads = [self._table(h) if h is not None else None for h in heads]

    @staticmethod
    def _table(a: Automaton):
        """Moves as lists, acceptance, and the states without a live thread, where a match cannot go on."""
        dead = {q for q in range(len(a.step)) if not a.accepts[q] and (a.step[q] == q).all()}
        return a.step.tolist(), a.accepts.astype(bool).tolist(), dead

    def starts(self, data: np.ndarray, lanes: int = 1024) -> list[np.ndarray]:
        """Places where a match of each rule starts, in ``data``: bytes of texts each followed by :data:`END`."""
        stream = data[::-1]
        n = len(stream)
        if not n:
            return [np.zeros(0, np.int64) for _ in self.rules]
        cuttable = np.flatnonzero(np.isin(stream, self.resets)) + 1
        wanted = np.arange(1, lanes) * -(-n // lanes)
        cuts = np.unique(np.concatenate([[0], cuttable[np.minimum(np.searchsorted(cuttable, wanted), len(cuttable) - 1)]]))
        cuts = cuts[cuts < n]
        lane = np.searchsorted(cuts, np.arange(n), side="right") - 1
        offset = np.arange(n) - cuts[lane]
        # Lanes of like length share a matrix, so that a long lane does not widen the short ones.
        lengths = np.diff(np.append(cuts, n))
        order = np.argsort(-lengths, kind="stable")
        ranked = lengths[order]
        slot = np.zeros(len(cuts), dtype=np.int64)
        marks = np.zeros(n, dtype=np.int64)
        flat = self.flat
        i = 0
        while i < len(order):
            width = int(ranked[i])
            j = i + max(1, int(np.count_nonzero(ranked[i:] * 2 > width)))
            group = order[i:j]
            member = np.zeros(len(cuts), dtype=bool)
            member[group] = True
            slot[group] = np.arange(len(group))
            inside = member[lane]
            rows, cols = offset[inside], slot[lane[inside]]
            grid = np.full((width, len(group)), END, dtype=np.int32)
            grid[rows, cols] = stream[inside]
            states = np.empty((width, len(group)), dtype=np.int32)
            s = np.zeros(len(group), dtype=np.int32)
            for t in range(width):
                s = flat[s + grid[t]]
                states[t] = s
            marks[inside] = self.back.accepts[states[rows, cols] >> 8]
            i = j
        hit = np.flatnonzero(marks)
        forward = n - 1 - hit
        return [np.sort(forward[(marks[hit] >> r) & 1 == 1]) for r in range(len(self.rules))]

    def extend(self, rule: int, text: bytes, at: int, stop: int | None = None, head: bool = False) -> int:
        """End of the longest match of ``rule`` (or of the part before its last item) that starts at ``at``."""
        moves, final, dead = (self.heads if head else self.tables)[rule]
        s, end = 0, at
        for i in range(at, len(text) if stop is None else stop):
            s = moves[s][text[i]]
            if final[s]:
                end = i + 1
            elif s in dead:
                break
        return end

    def scan(self, texts: Sequence[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """Per text, (start, end, rule) in bytes, by start then rule; null texts are empty."""
        data = [t or b"" for t in texts]
        bounds = np.cumsum([0] + [len(t) + 1 for t in data])
        found = self.starts(np.frombuffer(b"".join(t + bytes([END]) for t in data), dtype=np.uint8))
        spans: list[list[tuple[int, int, int]]] = [[] for _ in data]
        for r, places in enumerate(found):
            which = np.searchsorted(bounds, places, side="right") - 1
            free = {}
            for i, at in zip(which.tolist(), (places - bounds[which]).tolist()):
                if at < free.get(i, 0):
                    continue
                end = self.extend(r, data[i], at)
                rule = self.rules[r]
                if end - (self.extend(r, data[i], at, end, head=True) if rule.last else at) >= rule.least:
                    spans[i].append((at, end, r))
                free[i] = end
        for one in spans:
            one.sort(key=lambda span: (span[0], span[2]))
        return spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def code_points(text: bytes, places: list[int]) -> list[int]:
    """Byte offsets of UTF-8 as offsets in code points."""
    raw = np.frombuffer(text, dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[places].tolist()


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", rules: Sequence[Rule] = RULES, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``into`` (a free name): the spans of every rule in the whole text, by start, then rule.

    A span is (kind, start, end) in code points, end exclusive; per rule, matches are leftmost,
    longest and do not overlap; matches of different rules may. A null or empty text has no span,
    rows are scanned alike whatever they repeat, and all other columns pass through unchanged.
    Texts are scanned in slices of about ``chunk_bytes`` of a batch, so memory is bounded by it and
    by the longest text.
    """
    out = free_name(docs, into)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, SPANS)])
    kinds = [rule.kind for rule in rules]
    field = docs.columns.index(text)
    arrow_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = [t.encode() for t in pc.fill_null(batch.column(field), "").to_pylist()]
            results = []
            at = 0
            while at < len(texts):
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) <= chunk_bytes:
                    size += len(texts[stop]) + 1
                    stop += 1
                part = texts[at:stop]
                for raw, spans in zip(part, scanner.scan(part)):
                    cps = code_points(raw, [p for s, e, _ in spans for p in (s, e)]) if spans else []
                    results.append([{"kind": kinds[r], "start": cps[2 * k], "end": cps[2 * k + 1]} for k, (_, _, r) in enumerate(spans)])
                at = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, as_array(results, arrow_type)], names=[*batch.schema.names, out])

    return map_arrow(docs, run, schema)
