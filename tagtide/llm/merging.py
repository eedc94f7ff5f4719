"""Merges of many short runs at once: the agenda of each run is a column of an array."""

from __future__ import annotations

import numpy as np
import xxhash

#: Above all pieces, above all ranks, and the longest run that has a column.
KIND, NONE, SHORT = 1 << 20, 1 << 62, 48
#: A candidate is its rank, its piece and, in the lowest bits, its place.
PLACE = 6
#: Runs up to one of these lengths share an array.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, SHORT)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Draws:
    """The skips that ``pieces.Skips`` tells, for many runs: 5 draws of 12 bits from a hash, which is then hashed again."""

    def __init__(self, steps: np.ndarray, bits: np.ndarray):
        self.steps, self.keys, self.bits, self.drawn = steps, bits, bits.copy(), np.zeros(len(bits), np.int64)

    def gaps(self, runs: np.ndarray) -> np.ndarray:
        """The candidates that pass before the next skip, for each of the runs, none of which comes twice."""
        turn, place = np.divmod(self.drawn[runs], 5)
        for k in np.flatnonzero((place == 0) & (turn > 0)).tolist():
            key = int(self.keys[runs[k]]).to_bytes(8, "little")
            self.bits[runs[k]] = xxhash.xxh3_64_intdigest(key, int(turn[k]))
        self.drawn[runs] += 1
        return self.steps[(self.bits[runs] >> (place * 12).astype(np.uint64)) & np.uint64(4095)]

    def of(self, runs: np.ndarray) -> Draws:
        return Draws(self.steps, self.keys[runs])


class Merges:
    """What two pieces merge to, for arrays of pieces, from pairs and merges as ``pieces.MergeVocabulary`` has them."""

    def __init__(self, merges: dict[int, int]):
        pairs, found = np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges))
        bits = (8 * len(merges) + 8).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        slots, left = self.slots(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.pairs[slots[left]] == -1]
            self.pairs[slots[free]] = pairs[free]  # of several that want a slot one gets it
            placed = free[self.pairs[slots[free]] == pairs[free]]
            self.found[slots[placed]] = found[placed] << PLACE
            left = left[self.pairs[slots[left]] != pairs[left]]
            slots[left] = (slots[left] + 1) & self.mask

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece above the bits of a place; ``NONE`` where nothing merges. Numbers below 0 merge with nothing."""
        pairs = left.astype(np.int64) * KIND + right
        slots = self.slots(pairs)
        there = self.pairs[slots]
        found = np.where(there == pairs, self.found[slots], NONE)
        open_ = np.flatnonzero((there != pairs) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            there, wanted = self.pairs[slots[open_]], pairs[open_]
            same = there == wanted
            found[open_[same]] = self.found[slots[open_[same]]]
            open_ = open_[~same & (there != -1)]
        found[(left < 0) | (right < 0)] = NONE
        return found

    def merge(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, draws: Draws | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols left, start, length) of runs of at most ``SHORT`` symbols, which ``starts`` and ``lengths`` find in ``symbols``."""
        parts, size = [np.zeros(0, np.int32)], 0
        new_starts, new_lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        below = 0
        for width in WIDTHS:
            runs = np.flatnonzero((lengths > below) & (lengths <= width))
            below = width
            for at in range(0, len(runs), 1 << 16):
                some = runs[at : at + (1 << 16)]
                part, count = self._merge_array(symbols, starts[some], lengths[some], width, draws and draws.of(some))
                new_starts[some], new_lengths[some] = size + np.cumsum(count) - count, count
                parts.append(part)
                size += len(part)
        return np.concatenate(parts), new_starts, new_lengths

    def _merge_array(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, draws: Draws | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows are places, columns runs. The last row is no place: a neighbour that is missing is looked for there."""
        n = len(starts)
        state = np.full((width + 1, n), -1, np.int32)
        alive = np.arange(width)[:, None] < lengths
        state[:width][alive] = symbols[(starts + np.arange(width)[:, None])[alive]]
        after = np.repeat(np.arange(1, width + 2, dtype=np.int8)[:, None], n, 1)
        before = np.repeat(np.arange(-1, width, dtype=np.int8)[:, None], n, 1)
        before[0] = width
        agenda = np.full((width + 1, n), NONE, np.int64)
        for place in range(width - 1):
            agenda[place] = self.lookup(state[place], state[place + 1]) | place
        # Arrays of all runs are reached by flat places; the agenda holds only those that go on.
        flat_state, flat_alive, flat_after, flat_before = state.reshape(-1), alive.reshape(-1), after.reshape(-1), before.reshape(-1)
        runs = np.arange(n)
        until = draws.gaps(runs) if draws else np.full(n, NONE, np.int64)
        while True:
            best = agenda.min(0)
            on = np.flatnonzero(best < NONE)
            if not len(on):
                break
            if 4 * len(on) < 3 * len(best):
                agenda, runs, best = agenda[:, on], runs[on], best[on]
                on = np.arange(len(runs))
            best = best[on]
            place, at = best & ((1 << PLACE) - 1), runs[on]
            if draws:
                skipped = until[at] == 0
                if skipped.any():
                    agenda[place[skipped], on[skipped]] = NONE
                    until[at[skipped]] = draws.gaps(at[skipped])
                    passed = ~skipped
                    best, place, at, on = best[passed], place[passed], at[passed], on[passed]
                until[at] -= 1
            both = (best >> PLACE) & (KIND - 1)
            here = place * n + at
            gone = flat_after[here].astype(np.int64)
            there = gone * n + at
            flat_state[here] = both
            flat_alive[there] = False
            agenda[gone, on] = NONE
            behind = flat_after[there]
            flat_after[here] = behind
            behind = behind * np.int64(n) + at
            flat_before[behind] = place
            agenda[place, on] = self.lookup(both, flat_state[behind]) | place
            front = flat_before[here].astype(np.int64)
            agenda[front, on] = self.lookup(flat_state[front * n + at], both) | front
        return state[:width].T[alive.T], alive.sum(0)
