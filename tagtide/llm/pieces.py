"""Encoding with a merge-type SentencePiece vocabulary, with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import map_batches, utf8
from tagtide.llm.merging import KIND, NONE, SHORT, Draws, Merges, ranges

SPACE = "▁"


class MergeVocabulary:
    """Pieces and merge ranks of a model file, and the agenda that merges them.

    Pieces hold spaces only at their front or are all spaces, so a text falls into runs of spaces
    with what follows them, and no merge crosses from one to the next. A pair of pieces merges if the
    vocabulary has what they spell together, the earlier in the vocabulary the sooner.
    """

    def __init__(self, path: str):
        model = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids[piece] = i
        if size > KIND or any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("the vocabulary is too large, or a piece has a space inside")
        if not all(self.byte_ids):
            raise ValueError("the vocabulary lacks byte pieces, without which decoding would lose text")
        self.bytes_of = [b""] * size
        for piece, i in ids.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([value])
        # Spaces are spaces here, and a written U+2581 is a character without a piece.
        self.single = {p.replace(SPACE, " "): i for p, i in ids.items() if len(p) == 1}
        order = {i: n for n, i in enumerate(sorted(ids.values(), key=lambda i: (-model.get_score(i), i)))}
        rank = {}
        for i in ids.values():  # equal scores are equal ranks: the place then decides
            rank.setdefault(model.get_score(i), order[i])
        #: Two pieces as one number, and what they merge to: rank above, piece below.
        self.merges: dict[int, int] = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.merges[left * KIND + right] = rank[model.get_score(i)] * KIND + i
        #: The same for arrays: merges, characters by code point, and what pieces spell.
        self.table = Merges(self.merges)
        self.points = -1 - np.arange(0x110000, dtype=np.int32)
        for character, i in self.single.items():
            self.points[ord(character)] = i
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.spelled_size = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size

    def split(self, text: str) -> list[str]:
        """Runs of a text with a space put before it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return re.findall(r" *[^ ]+| +", " " + text)
        return [" " + word for word in text.split(" ")]

    def encode_run(self, run: str, skips: Skips | None = None) -> bytes:
        return self.encode_counted(run, skips)[0]

    def encode_counted(self, run: str, skips: Skips | None = None) -> tuple[bytes, int]:
        """Ids of one run as little-endian int32, and the number of merges.

        The agenda holds candidate merges by rank, then place. ``skips`` tells which of the candidates
        that come up are skipped; one comes again only if a neighbour grows and makes another candidate.
        """
        try:
            symbols = [*map(self.single.__getitem__, run)]
        except KeyError:
            # Characters without a piece get numbers below 0, which no merge has, and are spelled in bytes.
            symbols = [self.single.get(c, -1 - ord(c)) for c in run]
        merged = (self._merge_short if len(symbols) <= SHORT else self._merge_long)(symbols, skips or Skips.none())
        merges = len(run) - len(merged)
        if min(merged) < 0:
            spelled: list[int] = []
            for i in merged:
                if i >= 0:
                    spelled.append(i)
                else:
                    spelled.extend(self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            merged = spelled
        return packed(merged), merges

    def _merge_short(self, symbols: list[int], skips: Skips) -> list[int]:
        """The agenda as a list by place: cheaper than a heap for the length of a word."""
        get = self.merges.get
        agenda = [get(a * KIND + b, NONE) for a, b in zip(symbols, symbols[1:])]
        left = skips.gap()
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            if not left:
                left = skips.gap()
                agenda[i] = NONE
                continue
            left -= 1
            both = best % KIND
            symbols[i] = both
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(both * KIND + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] * KIND + both, NONE)
        return symbols

    def _merge_long(self, symbols: list[int], skips: Skips) -> list[int]:
        """The agenda as a heap, and neighbours as linked places."""
        get, n = self.merges.get, len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        agenda = [(m, i, 0) for i, m in enumerate(get(a * KIND + b, NONE) for a, b in zip(symbols, symbols[1:])) if m != NONE]
        heapq.heapify(agenda)
        grown = [0] * n  # how often the pair that starts at a place has changed
        until = skips.gap()
        while agenda:
            best, i, version = heapq.heappop(agenda)
            if not alive[i] or grown[i] != version:
                continue
            if not until:
                until = skips.gap()
                continue
            until -= 1
            j = right[i]
            both = symbols[i] = best % KIND
            alive[j] = False
            k = right[i] = right[j]
            grown[i] += 1
            if k < n:
                left[k] = i
                if (m := get(both * KIND + symbols[k], NONE)) != NONE:
                    heapq.heappush(agenda, (m, i, grown[i]))
            h = left[i]
            if h >= 0:
                grown[h] += 1
                if (m := get(symbols[h] * KIND + both, NONE)) != NONE:
                    heapq.heappush(agenda, (m, h, grown[h]))
        return [s for s, ok in zip(symbols, alive) if ok]

    def plain(self, runs: list[str]) -> dict[str, tuple[bytes, int]]:
        """Ids of runs when no merge is skipped, and how many merges that takes.

        The library encodes them, behind the space that it puts first. It reads U+2581 as a space and its own way of spelling hides the number
        of merges, so runs with such characters go through the agenda here.
        """
        usual = [run for run in runs if run != " " and "\0" not in run and (run.isascii() or self.single.keys() >= set(run))]
        known = {}
        for run, ids in zip(usual, self.library.encode([run[1:] for run in usual], num_threads=1)):
            known[run] = packed(ids), len(run) - len(ids)
        for run in runs if len(known) < len(runs) else ():
            if run not in known:
                known[run] = self.encode_counted(run)
        return known

    def encode_many(
        self, texts: list[str], skip: float = 0.0, seed: int = 0, variants: int = 0, keys: list[int] | None = None, kept: Kept | None = None
    ) -> list[bytes]:
        """Ids of texts. Each run draws its skips from the seed, the text's key and its place.

        With ``variants`` a text's k-th run draws one of so many keys from the text's key and k instead. A run
        then has at most ``variants`` segmentations under a seed, each worked out once and then looked up
        in ``kept``. A hash of key and run tells how many candidate merges pass before one is skipped:
        where that is more than the run has, nothing is skipped and the plain ids stand.
        """
        if not variants:
            ids, ends = self.encode_each(texts, skip, seed, keys)
            return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        kept = Kept(variants) if kept is None else kept
        made: list[list] = []
        missing: list[tuple[list, int, str, int, bytes | None]] = []
        unknown: dict[str, None] = {}
        for t, text in enumerate(texts):
            runs = self.split(text)
            drawn = bytes(len(runs)) if not skip or variants == 1 else draws(len(runs), keys[t] if keys else 0, variants)
            late, before = kept.late, kept.before
            out = [late[v].get(run) for run, v in zip(runs, drawn)]
            if None in out:
                for k, known in enumerate(out):
                    if known is None:
                        run, v = runs[k], drawn[k]
                        old = before[v].get(run)
                        missing.append((out, k, run, v, old))
                        if old is None:
                            unknown[run] = None
            made.append(out)
        plain = self.plain(list(unknown))
        gaps, digest = gap_table(skip), xxhash.xxh3_64_intdigest
        for out, k, run, v, known in missing:
            if run not in kept.late[v]:
                if known is None:
                    known, merges = plain[run]
                    if skip:
                        bits = digest(run.encode("utf-8", "surrogatepass"), seed * 256 + v)
                        if gaps[bits & 4095] < merges:
                            known = self.encode_run(run, Skips(gaps, bits))
                kept.keep(run, v, known)
            out[k] = known or kept.late[v][run]
        return [b"".join(out) for out in made]

    def encode_each(self, texts: list[str], skip: float = 0.0, seed: int = 0, keys: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose runs draw for themselves, one text after the other, and the bounds of the texts in them."""
        split = [self.split(text) for text in texts]
        runs = [run for part in split for run in part]
        bits = [place_bits(len(part), seed, key) for part, key in zip(split, keys or [0] * len(texts))] if skip else []
        drawn = np.concatenate([np.zeros(0, np.uint64), *bits])
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(runs), PART):
            some, lengths = self._encode_runs(runs[at : at + PART], skip, drawn[at : at + PART])
            ids.append(some)
            sizes.append(lengths)
        bounds = np.cumsum([0, *map(len, split)])
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))[bounds]

    def _encode_runs(self, runs: list[str], skip: float, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, one run after the other, and how many each has.

        Distinct runs are merged once without a skip. Where a run's first skip comes before its last merge, its
        occurrence is merged anew with its own draws. Long runs go through the agenda one by one.
        """
        distinct = list(dict.fromkeys(runs))
        number = dict(zip(distinct, range(len(distinct))))
        codes = np.fromiter(map(number.__getitem__, runs), np.int64, len(runs))
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        starts = np.cumsum(lengths) - lengths
        symbols = self.points[np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), "<u4")]
        long = np.flatnonzero(lengths > SHORT)
        made, at, size = self.table.merge(symbols, starts, lengths)
        merges = lengths - size
        plain = self.plain([distinct[k] for k in long.tolist()])
        merges[long] = [plain[distinct[k]][1] for k in long.tolist()]
        made, at, size = self._spell(made, at, size, {k: plain[distinct[k]][0] for k in long.tolist()})
        if not skip:
            return made[ranges(at[codes], size[codes])], size[codes]
        gaps, steps = gap_table(skip), gap_array(skip)
        hit = np.flatnonzero(steps[bits & np.uint64(4095)] < merges[codes])
        own = codes[hit]
        varied, varied_at, varied_size = self.table.merge(symbols, starts[own], lengths[own], Draws(steps, bits[hit]))
        alone = {k: self.encode_run(distinct[own[k]], Skips(gaps, int(bits[hit[k]]))) for k in np.flatnonzero(lengths[own] > SHORT).tolist()}
        varied, varied_at, varied_size = self._spell(varied, varied_at, varied_size, alone)
        where, sizes = at[codes], size[codes]
        where[hit], sizes[hit] = varied_at + len(made), varied_size
        return np.concatenate([made, varied])[ranges(where, sizes)], sizes

    def _spell(self, made: np.ndarray, at: np.ndarray, size: np.ndarray, others: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of runs with characters that have no piece spelled in bytes, and ``others``, by run, put behind them."""
        bare = np.flatnonzero(made < 0)
        if len(bare):
            points = (-1 - made[bare]).tolist()
            ids = np.array(self.byte_ids, np.int32)[np.frombuffer("".join(map(chr, points)).encode("utf-8", "surrogatepass"), np.uint8)]
            widths = np.ones(len(made), np.int64)
            widths[bare] = [1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF) for p in points]
            ends = np.concatenate([[0], np.cumsum(widths)])
            made = np.repeat(made, widths)
            made[ranges(ends[bare], widths[bare])] = ids
            at, size = ends[at], ends[at + size] - ends[at]
        if others:
            more = [np.frombuffer(ids, "<i4") for ids in others.values()]
            which, sizes = list(others), np.fromiter(map(len, more), np.int64, len(more))
            at[which], size[which] = len(made) + np.cumsum(sizes) - sizes, sizes
            made = np.concatenate([made, *more])
        return made, at, size

    def decode_each(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 of texts, from what :meth:`encode_each` gives."""
        parts = [self.spelled[ranges(self.spelled_at[some], self.spelled_size[some])] for some in (ids[at : at + PART] for at in range(0, len(ids), PART))]
        raw = np.concatenate([np.zeros(0, np.uint8), *parts])
        bounds = np.concatenate([[0], np.cumsum(self.spelled_size[ids])])[ends].tolist()
        return [raw[a + 1 : b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, text: str, skip: float = 0.0, seed: int = 0, variants: int = 0, doc_key: int = 0) -> bytes:
        return self.encode_many([text], skip, seed, variants, [doc_key])[0]

    def decode(self, ids: bytes | Iterable[int]) -> str:
        return self.bytes_from(ids).decode("utf-8", "surrogatepass")

    def bytes_from(self, ids: bytes | Iterable[int]) -> bytes:
        """The UTF-8 that pieces spell, without the space put before the text."""
        numbers = np.frombuffer(ids, "<i4").tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.bytes_of.__getitem__, numbers))[1:]


#: Writers of few ids, the usual case.
PACK = [struct.Struct(f"<{n}i") for n in range(64)]


def packed(ids: list[int]) -> bytes:
    return (PACK[len(ids)] if len(ids) < len(PACK) else struct.Struct(f"<{len(ids)}i")).pack(*ids)


def draws(n: int, doc_key: int, variants: int) -> bytes:
    """A variant for each of ``n`` places of a text."""
    places = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(doc_key & 0xFFFFFFFFFFFFFFFF)
    places ^= places >> np.uint64(31)
    places *= np.uint64(0xD6E8FEB86659FD93)
    return ((places >> np.uint64(40)) % np.uint64(variants)).astype(np.uint8).tobytes()


def place_bits(n: int, seed: int, doc_key: int) -> np.ndarray:
    """64 bits for each of ``n`` places of a text, from the seed and the text's key."""
    key = xxhash.xxh3_64_intdigest(struct.pack("<qq", seed, doc_key if doc_key < 1 << 63 else doc_key - (1 << 64)))
    bits = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return bits ^ (bits >> np.uint64(31))


@lru_cache(8)
def gap_array(skip: float) -> np.ndarray:
    return np.array(gap_table(skip), np.int64)


@lru_cache(8)
def gap_table(skip: float) -> tuple[int, ...]:
    """How many candidates pass before the next is skipped, for 4,096 equally likely draws."""
    if skip <= 0:
        return (NONE,) * 4096
    if skip >= 1:
        return (0,) * 4096
    return tuple(int(math.log(1 - (k + 0.5) / 4096) / math.log(1 - skip)) for k in range(4096))


class Skips:
    """Which candidate merges of a run are skipped, told from a hash."""

    def __init__(self, gaps: tuple[int, ...], bits: int):
        self.gaps, self.key, self.bits, self.left, self.turn = gaps, bits, bits, 5, 0

    @classmethod
    def none(cls) -> Skips:
        return cls(gap_table(0.0), 0)

    @classmethod
    def after(cls, merges: int) -> Skips:
        """One skip, after so many merges."""
        made = cls.none()
        made.gap = iter((merges, *[NONE] * 2)).__next__
        return made

    def gap(self) -> int:
        """The candidates that pass before the next skip: 12 bits of the hash, hashed again when 60 are used up."""
        if not self.left:
            self.turn += 1
            self.bits, self.left = xxhash.xxh3_64_intdigest(self.key.to_bytes(8, "little"), self.turn), 5
        at = self.bits & 4095
        self.bits >>= 12
        self.left -= 1
        return self.gaps[at]


#: So many runs, and pieces, are worked on at once.
PART = 1 << 17
#: Texts are taken together up to so many characters.
CHARS = 1 << 20


class Kept:
    """Segmentations that a task keeps: ``limit`` of late for each variant and as many of before.

    A task starts from the first ``core`` runs that its worker has met, most of them frequent ones, and
    gives the rest back when it ends.
    """

    limit, core = 200_000, 50_000

    def __init__(self, variants: int, cores: list[dict] | None = None):
        self.cores = cores if cores is not None else [{} for _ in range(variants)]
        self.late = [dict(known) for known in self.cores]
        self.before: list[dict] = [{} for _ in range(variants)]

    def keep(self, run, v: int, known) -> None:
        late = self.late[v]
        if len(late) >= self.limit:
            self.before[v] = late
            late = self.late[v] = {}
        late[run] = known
        if len(late) == self.core and not self.cores[v]:
            self.cores[v] = dict(late)


@lru_cache(2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


@lru_cache(2)
def cores_of(path: str, skip: float, seed: int, variants: int) -> list[dict]:
    """Stays between the tasks of a worker."""
    return [{} for _ in range(variants)]


def parts_by_size(raws: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of so many bytes, or of one larger text."""
    ends = np.cumsum(pa.compute.binary_length(raws).to_numpy(zero_copy_only=False)).tolist()
    at = done = 0
    for to, end in enumerate(ends, 1):
        if to == len(ends) or ends[to] - done > size:
            yield at, to
            at, done = to, end


def encode_documents(
    docs: DataFrame, model: str, *, skip: float = 0.1, seed: int = 17, variants: int = 0, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts: (id, pieces array<int>, n_pieces, text_chars, lossless).

    ``model`` is a file that executors can read, such as one installed with them. ``lossless`` tells
    that decoding the pieces gave the text back. Each occurrence of a run draws its own skips, unless
    ``variants`` bounds the segmentations of a run to so many. The pieces depend on the seed, the id and the text
    alone. Null and empty texts have no pieces; repeated rows get equal pieces; no rows give no rows.
    """
    if not 0 <= variants <= 256:
        raise ValueError("variants must be 1 to 256, or 0 for no bound")

    task: list[Kept] = []  # a copy for each task

    def run(batch):
        vocab = vocabulary(model)
        if variants and not task:
            task.append(Kept(variants, cores_of(model, skip, seed, variants)))
        keys = batch.column(1).to_pylist()
        # In pieces, because ids take more room than the text they stand for.
        for at, to in parts_by_size(batch.column(2), CHARS):
            raws = batch.column(2).slice(at, to - at).to_pylist()
            pages = [raw.decode("utf-8", "surrogatepass") for raw in raws]
            if variants:
                made = vocab.encode_many(pages, skip, seed, variants, keys[at:to], task[0])
                ids, ends = np.frombuffer(b"".join(made), "<i4"), np.cumsum([0, *(len(m) // 4 for m in made)])
            else:
                ids, ends = vocab.encode_each(pages, skip, seed, keys[at:to])
            yield {
                "id": batch.column(0).slice(at, to - at),
                "pieces": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                "n_pieces": np.diff(ends),
                "text_chars": list(map(len, pages)),
                "lossless": [made == raw for made, raw in zip(vocab.decode_each(ids, ends), raws)],
            }

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.lit(seed), id), utf8(text))
    made = map_batches(rows, run, f"id {kind}, pieces array<int>, n_pieces long, text_chars long, lossless boolean", rows=2_000)
    return made.withColumnRenamed("id", id)


def decode_documents(encoded: DataFrame, model: str, *, id: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """Texts of encoded documents: (id, text). Null pieces give a null text."""

    def run(batch):
        vocab = vocabulary(model)
        texts = [None if p is None else vocab.decode(p) if p else "" for p in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "text": texts}

    kind = encoded.schema[id].dataType.simpleString()
    return map_batches(encoded.select(F.col(id).alias("id"), pieces), run, f"id {kind}, text string").withColumnRenamed("id", id)
