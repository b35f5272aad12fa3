"""Bootstrap estimates of large groups in pieces: the draws of ``random.Random(seed).randrange(n)``, many tasks for a group.

A resample's place in the generator's output depends on how many outputs before it were refused, so a first pass counts what each
stretch of the output has for each n (groups of one width share it); then a task takes the resamples that begin in its stretch.  A
stretch begins at the state that the Mersenne Twister has there, by a jump: its steps are linear over GF(2), so the state after
2^j steps is a sum of the first 19,937 states, as x^(2^j) modulo the characteristic polynomial says.

An output that is refused is a place past the end, so nothing is filtered: values there are zero for a sum, and a rank among
places below n is the rank among all.  Sums are whole numbers in 64 bits, so equal ``math.fsum``."""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np

DEGREE, STATE = 19937, 624
#: Outputs taken at a time, so that they stay in a core's cache.
PIECE = 1 << 16
#: Pieces drawn at once, 4 MB.
PIECES = 16
#: A stretch has 2^STRETCH outputs, or those of about 64 resamples where that is more.
STRETCH = 23
#: Ranks are looked for within so many standard deviations; beyond, the resample is drawn again and sorted.
SPREAD = 8.0
#: Up to this width the number of each place's value is held, 2 or 4 bytes each; beyond, it is searched for.
TABLE_WIDTH = 24


def _key(seed: int) -> tuple[np.ndarray, int]:
    *key, at = random.Random(seed).getstate()[1]
    return np.array(key, np.uint32), at


def _generator(key: np.ndarray, at: int) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": at}}
    return bits


def _raw(draws: np.random.RandomState, n: int) -> np.ndarray:
    return draws.randint(0, 1 << 32, n, np.uint32)


@cache
def _polynomial() -> int:
    """The characteristic polynomial, from one bit of the output (Berlekamp and Massey)."""
    out = _raw(np.random.RandomState(_generator(*_key(1))), 2 * DEGREE + 64) >> np.uint32(31)
    c = b = 1
    length, gap, seen = 0, 1, 0
    for i, bit in enumerate(out.tolist()):
        seen = seen << 1 | bit  # bit j is the output j places ago
        if (c & seen).bit_count() & 1:
            if 2 * length <= i:
                c, b, length, gap = c ^ b << gap, c, i + 1 - length, 0
            else:
                c ^= b << gap
        gap += 1
        seen &= (1 << DEGREE + 1) - 1
    assert length == DEGREE
    return int(f"{c:0{DEGREE + 1}b}"[::-1], 2)


@cache
def jump(power: int) -> int:
    """x^(2^power) modulo the polynomial."""
    if power == 0:
        return 2
    p = _polynomial()
    a = int("0".join(f"{jump(power - 1):b}"), 2)
    while (over := a.bit_length() - 1 - DEGREE) >= 0:
        a ^= p << over
    return a


def jumped(key: np.ndarray, by: int) -> np.ndarray:
    """The state (at 0) after the steps of the polynomial ``by``."""
    words = [key]
    draws = _generator(key, STATE)
    for _ in range(DEGREE // STATE + 2):
        draws.random_raw(1)  # makes the next 624 words
        words.append(draws.state["state"]["key"].copy())
        draws.random_raw(STATE - 1)
    every = np.lib.stride_tricks.sliding_window_view(np.concatenate(words), STATE)
    at = np.flatnonzero(np.frombuffer(f"{by:b}"[::-1].encode(), np.uint8) == 49)
    out = np.zeros(STATE, np.uint32)
    for i in range(0, len(at), 512):
        out ^= np.bitwise_xor.reduce(every[at[i : i + 512]], axis=0)
    return out


def stretch(width: int) -> int:
    return max(STRETCH, width + 6)


def stretches(n: int, resamples: int) -> int:
    """How many stretches hold all resamples: as many outputs as expected, and ten standard deviations."""
    need = resamples << n.bit_length()
    return (need + 10 * math.isqrt(4 * need) + 1000 >> stretch(n.bit_length())) + 1


def begun(seed: int, width: int, k: int, jumps: list[int]) -> np.random.RandomState:
    """The generator at the beginning of stretch ``k``; jumps[i] goes 2^i stretches ahead."""
    key, at = _key(seed)
    assert at == STATE
    for i, by in enumerate(jumps):
        if k >> i & 1:
            key = jumped(key, by)
    return np.random.RandomState(_generator(key, STATE))


def jumps(width: int, most: int) -> list[int]:
    return [jump(stretch(width) + i) for i in range(most.bit_length())]


def counted(seed: int, width: int, k: int, ns: list[int], by: list[int]) -> list[int]:
    """How many outputs of the stretch are places of each n."""
    draws, out = begun(seed, width, k, by), [0] * len(ns)
    for _ in range(0, 1 << stretch(width), PIECE):
        x = _raw(draws, PIECE) >> np.uint32(32 - width)
        for i, n in enumerate(ns):
            out[i] += int(np.count_nonzero(x < n))
    return out


class Means:
    """Adds up the values of places."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, width: int):
        self.values, self.ends, self.n = values, ends, int(ends[-1])
        parts = [float(x).as_integer_ratio() for x in values.tolist()]
        self.unit = max(d for _, d in parts)
        whole = [a * (self.unit // d) for a, d in parts]
        bits = 62 - self.n.bit_length()
        self.bits = bits
        self.plain = max(map(abs, whole)).bit_length() > 2 * bits
        table = np.zeros((len(values) + 1, 2), np.int64)
        if not self.plain:
            table[:-1, 0], table[:-1, 1] = [a >> bits for a in whole], [a & (1 << bits) - 1 for a in whole]
        self.table = table.view(np.complex128)[:, 0]  # both halves of a value are fetched at once
        self.rank = None
        if width <= TABLE_WIDTH:
            kind = np.uint16 if len(values) < 1 << 16 else np.uint32
            self.rank = np.repeat(np.arange(len(values) + 1, dtype=kind), np.diff([0, *ends, 1 << width]))
        self.begin(None)

    def begin(self, _) -> None:
        self.high = self.low = 0
        self.some: list[np.ndarray] = []

    def add(self, x: np.ndarray) -> None:
        if self.plain:
            self.some.append(self.values[np.searchsorted(self.ends, x[x < self.n], "right")])
            return
        at = np.searchsorted(self.ends, x, "right") if self.rank is None else self.rank.take(x.astype(np.intp), mode="clip").astype(np.intp)
        got = self.table.take(at, mode="clip").view(np.int64)
        self.high += int(got[0::2].sum())
        self.low += int(got[1::2].sum())

    def end(self) -> dict[str, float]:
        if self.plain:
            return {"mean": math.fsum(v for x in self.some for v in x.tolist()) / self.n}
        return {"mean": ((self.high << self.bits) + self.low) / self.unit / self.n}


class Ranks:
    """Finds the places of ranks: counts what is below a window and keeps what is in it."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, width: int, quantiles: dict[str, float]):
        self.values, self.ends, self.n, self.width = values, ends, int(ends[-1]), width
        self.at = {x: (self.n - 1) * q for x, q in quantiles.items()}
        self.windows = []
        for k in self.at.values():
            far = SPREAD * math.sqrt((k + 1) * max(self.n - k, 1) / self.n) + 2
            self.windows.append((max(0, math.floor(k - far)), min(self.n, math.ceil(k + far) + 1)))

    def begin(self, again) -> None:
        self.again, self.below, self.inside = again, [0] * len(self.windows), [[] for _ in self.windows]

    def add(self, x: np.ndarray) -> None:
        for i, (lo, hi) in enumerate(self.windows):
            self.below[i] += int(np.count_nonzero(x < lo))
            self.inside[i].append(x[(x - np.uint32(lo)) < np.uint32(hi - lo)])

    def end(self) -> dict[str, float]:
        out, every = {}, None
        for (name, k), below, inside in zip(self.at.items(), self.below, self.inside, strict=True):
            some, ranks = np.sort(np.concatenate(inside)), [math.floor(k), math.ceil(k)]
            if ranks[0] < below or ranks[1] >= below + len(some):
                if every is None:
                    every = self.drawn_again()
                some, below = every, 0
            lo, hi = self.values[np.searchsorted(self.ends, some[np.array(ranks) - below], "right")].tolist()
            out[name] = lo + (hi - lo) * (k - math.floor(k))
        return out

    def drawn_again(self) -> np.ndarray:
        state, skip = self.again
        draws, got, left = np.random.RandomState(np.random.MT19937()), [], self.n
        draws.set_state(state)
        _raw(draws, skip)
        while left:
            x = _raw(draws, PIECE) >> np.uint32(32 - self.width)
            x = x[x < self.n][:left]
            got.append(x)
            left -= len(x)
        return np.sort(np.concatenate(got))


def walk(taker, n: int, before: int, own: int, resamples: int):
    """Takes (a state, outputs between it and the piece, outputs) of one piece of a stretch after the other, ``before`` which places were drawn and which has ``own``.

    Gives the (number, estimates) that each piece ends, of the resamples that begin in the stretch."""
    number, last = -(-before // n), min(resamples, -(-(before + own) // n))
    done: list[tuple[int, dict[str, float]]] = []
    if number >= last:
        return done
    skip, left = number * n - before, 0
    while True:
        state, passed, x = yield done
        done, at, good = [], 0, None
        there = int(np.count_nonzero(x < n))
        while True:
            need = skip or left
            if need and there < need:
                if left:
                    taker.add(x[at:])
                    left -= there
                else:
                    skip -= there
                break
            if need:  # the piece holds the last place of what is skipped or drawn
                good = np.flatnonzero(x < n) if good is None else good
                stop = int(good[len(good) - there + need - 1]) + 1
                if not skip:
                    taker.add(x[at:stop])
                    done.append((number, taker.end()))
                    number += 1
                    if number == last:
                        return done
                at, there, skip, left = stop, there - need, 0, 0
            taker.begin((state, passed + at))
            left = n


def together(walks: list, seed: int, width: int, k: int, by: list[int]):
    """(which walk, number, estimates), with each piece of the stretch drawn once for all walks."""
    live, draws = {}, None
    for i, w in enumerate(walks):
        if next(w, None) is not None:
            live[i] = w
    while live:
        draws = draws or begun(seed, width, k, by)
        state = draws.get_state(legacy=False)
        x = _raw(draws, PIECES * PIECE) >> np.uint32(32 - width)
        for i in list(live):  # several pieces for one walk before the next, whose tables then come into the cache
            for at in range(0, len(x), PIECE):
                try:
                    got = live[i].send((state, at, x[at : at + PIECE]))
                except StopIteration as end:
                    got = end.value
                    del live[i]
                for number, of in got:
                    yield i, number, of
                if i not in live:
                    break
