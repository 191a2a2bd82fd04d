"""Runs: maximal stretches of words that repeat themselves with a period, found by block convolution.

Documents of a task stand one after the other, each closed by a word of its own, and periods are looked for by dyadic scales.
On the scale of periods 2 * B to 4 * B - 1 the words are cut into blocks of B; a run of such a period holds a whole block
that occurs again one period later. The sums of squared differences of a block and all places of the window that follows come
from one number-theoretic transform; those that are zero are occurrences. Blocks in a row that agree on the distance are chained,
and a chain is grown word by word on both sides, by less than a block, as the next block doesn't occur.

Sums are exact modulo a prime. Zero is necessary for an occurrence, and what is reported has been compared word by word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import rows_of
from threadspark.llm.ngrams import _mix

#: Least length of a run in words.
MIN_WORDS = 12
#: Periods below it share the first scale, with blocks of three: twelve words hold such a block for each of them.
SMALL, SMALL_BLOCK = 8, 3
#: Words of a task's texts that are searched together; a longer text is searched by itself.
WORDS_AT_ONCE = 1 << 17
#: Numbers in a transform's working array.
AT_ONCE = 1 << 16

#: Primes k * 2**e + 1 with a generator and the exponent e; the longest transform has 2**e places.
PRIMES = ((167_772_161, 3, 25), (2_013_265_921, 31, 27))

Run = tuple[int, int, int]


class Transform:
    """Discrete Fourier transforms of length ``n`` modulo a prime, over the first axis of arrays (n, m)."""

    def __init__(self, n: int) -> None:
        found = next((x for x in PRIMES if n <= 1 << x[2]), None)
        if found is None:
            raise ValueError(f"no transform of {n} places")
        self.n, (self.prime, generator, _) = n, found
        self.p = np.uint64(self.prime)
        self.powers = self._powers(pow(generator, (self.prime - 1) // n, self.prime))

    def _powers(self, root: int) -> np.ndarray:
        out = np.ones(self.n, np.uint64)
        have = 1
        while have < self.n:
            step = np.uint64(pow(root, have, self.prime))
            out[have : 2 * have] = self.mod(out[: min(have, self.n - have)] * step)
            have *= 2
        return out

    def mod(self, x: np.ndarray) -> np.ndarray:
        """``x`` modulo the prime, in place; numpy divides by a constant faster than it takes remainders."""
        times = x // self.p
        times *= self.p
        x -= times
        return x

    def shift(self, places: int) -> np.ndarray:
        """The factors by which a transform changes when its input moves on by ``places``."""
        return self.powers[np.arange(self.n) * places % self.n][:, None]

    def _stages(self, x: np.ndarray, n: int, width: int) -> np.ndarray:
        """The remaining stages, down from length ``n``, of rows that hold ``width`` numbers each."""
        bound = self.prime  # all numbers are below it; sums stay unreduced as long as products fit into 64 bits
        while n > 1:
            if (2 * bound + self.prime) * self.prime >= 1 << 64:
                x, bound = self.mod(x), self.prime
            half = n // 2
            x = x.reshape(2, half, width)
            out = np.empty((half, 2, width), np.uint64)
            np.add(x[0], x[1], out=out[:, 0])
            if half == 1:
                out[:, 1] = x[0] + np.uint64(-(-bound // self.prime) * self.prime) - x[1]
            else:
                apart = x[0] + np.uint64(-(-bound // self.prime) * self.prime)
                apart -= x[1]
                apart *= self.powers[:: self.n // n][:half, None]
                out[:, 1] = self.mod(apart)
            x, n, width, bound = out, half, 2 * width, 2 * bound + self.prime
        return self.mod(x)

    def full(self, x: np.ndarray) -> np.ndarray:
        return self._stages(x, self.n, x.shape[1]).reshape(self.n, -1)

    def quarter(self, x: np.ndarray) -> np.ndarray:
        """The transform of columns whose places from a quarter of the length on are zero; ``x`` is the first quarter."""
        rows, m = x.shape
        spread = np.empty((rows, 4, m), np.uint64)
        spread[:, 0] = x
        for k in range(1, 4):
            spread[:, k] = self.mod(x * self.powers[: rows * k : k][:, None])
        return self._stages(spread, rows, 4 * m).reshape(self.n, m)


class Scale:
    """Occurrences of blocks of ``block`` words at distances from ``low`` to ``high`` words."""

    def __init__(self, block: int, low: int, high: int) -> None:
        self.block, self.low, self.high = block, low, high
        self.first = low // block  # the window starts with this block, counted from the own one
        self.pieces = -(-(high + block) // block) - self.first
        places = 4 * (1 << (block - 1).bit_length())
        while places < self.pieces * block:
            places *= 2
        self.transform = Transform(places)
        self.shifts = [self.transform.shift(j * block) for j in range(self.pieces)]
        self.back = -np.arange(places) % places

    def occurrences(self, codes: np.ndarray, sums: np.ndarray, gaps: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(block number, distance) of the sums that are zero, for the first ``blocks`` blocks.

        ``codes`` must reach past all windows; ``sums`` are running sums of their squares. ``gaps`` tells how far each word comes again: a
        block with a word that does so behind the window only can't occur in it and isn't transformed.
        """
        t, size = self.transform, self.block
        near = gaps[: blocks * size].reshape(-1, size).max(axis=1) <= self.high
        asked = np.flatnonzero(near)
        distances = np.arange(self.low, self.high + 1)
        step = max(1, AT_ONCE // t.n)
        found_block, found_distance = [], []
        for low in range(0, len(asked), step):
            own = asked[low : low + step]
            parts = [own] + [own + self.first + j for j in range(self.pieces)]
            needed, places = np.unique(np.concatenate(parts), return_inverse=True)
            places = places.reshape(len(parts), -1)
            padded = np.zeros((t.n // 4, len(needed)), np.uint64)
            padded[:size] = codes[needed * size + np.arange(size)[:, None]]
            spectra = t.quarter(padded)
            window = spectra[:, places[1]]
            for j in range(1, self.pieces):
                window += spectra[:, places[1 + j]] * self.shifts[j]
                if j % 3 == 2:
                    t.mod(window)
            product = t.mod(spectra[self.back][:, places[0]] * t.mod(window))
            common = t.full(product)[self.back[distances - self.first * size]]
            start = own * size
            later = start + distances[:, None]
            total = t.mod(sums[start + size] - sums[start] + sums[later + size] - sums[later])
            total = t.mod(total * np.uint64(t.n))
            total += np.uint64(2 * t.prime) - np.uint64(2) * common
            which, column = np.nonzero(t.mod(total) == 0)
            found_block.append(own[column])
            found_distance.append(distances[which])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_block]), np.concatenate([none, *found_distance])


_scales: dict[int, Scale] = {}


def scale_of(period: int) -> Scale:
    """The scale of periods from ``period`` on, a power of two; 1 stands for all small ones."""
    if period not in _scales:
        _scales[period] = Scale(SMALL_BLOCK, 1, SMALL - 1) if period == 1 else Scale(period // 2, period, 2 * period - 1)
    return _scales[period]


def _agree(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, most: int, way: int) -> np.ndarray:
    """Number of words, ``most`` at most, that agree with those ``distance`` later, from ``start`` on in direction ``way``."""
    out = np.empty(len(start), np.int64)
    steps = np.arange(most) * way
    rows = max(1, (1 << 20) // most)
    for at in range(0, len(start), rows):
        one = start[at : at + rows, None] + steps
        other = one + distance[at : at + rows, None]
        differ = ids[np.clip(one, 0, len(ids) - 1)] != ids[np.clip(other, 0, len(ids) - 1)]
        out[at : at + rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


class _Known:
    """Runs found so far, to leave out chains that lie in one of a period dividing theirs.

    Two runs share fewer words than the sum of their periods, so at most one holds a chain and has a period that small.
    """

    def __init__(self, runs: list[Run]) -> None:
        runs = sorted(runs)
        self.starts = np.array([r[0] for r in runs], np.int64)
        ends, periods = np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)
        self.reach = np.maximum.accumulate(ends) if len(runs) else ends
        owner = np.where(ends == self.reach, np.arange(len(runs)), 0)
        self.periods = periods[np.maximum.accumulate(owner)] if len(runs) else periods

    def hold(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(start), bool)
        spot = np.searchsorted(self.starts, start, "right") - 1
        safe = np.maximum(spot, 0)
        return (spot >= 0) & (self.reach[safe] >= stop) & (period % self.periods[safe] == 0)


def _grown(ids: np.ndarray, block: np.ndarray, distance: np.ndarray, size: int, known: list[Run]) -> list[Run]:
    """Runs (start, stop, period) whose blocks occur at their period."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    new = np.r_[True, (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)]
    firsts = np.flatnonzero(new)
    lasts = np.r_[firsts[1:], len(block)] - 1
    period = distance[firsts]
    start, stop = block[firsts] * size, (block[lasts] + 1) * size
    fits = stop - start + 2 * (size - 1) + period >= np.maximum(MIN_WORDS, 2 * period)
    fits &= ~_Known(known).hold(start, stop + period, period)
    start, stop, period = start[fits], stop[fits], period[fits]
    if not len(start):
        return []
    start = start - _agree(ids, start - 1, period, size, -1)
    stop = stop + _agree(ids, stop, period, size, 1) + period
    long = stop - start >= np.maximum(MIN_WORDS, 2 * period)
    out: list[Run] = []
    for a, b, q in set(zip(start[long].tolist(), stop[long].tolist(), period[long].tolist(), strict=True)):
        differ = np.flatnonzero(ids[a : b - q] != ids[a + q : b])
        if not len(differ):
            out.append((a, b, q))
            continue
        # a sum was zero modulo the prime only
        low, high = np.r_[a, differ + a + 1], np.r_[differ + a, b - q] + q
        fits = (high - low >= max(MIN_WORDS, 2 * q)) & ~_Known(known).hold(low, high, np.full(len(low), q))
        out += [(x, y, q) for x, y in zip(low[fits].tolist(), high[fits].tolist(), strict=True)]
    return out


def runs_of(texts: list[list]) -> list[list[Run]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    # long texts first, so that those of a scale stand together
    order = sorted((i for i, words in enumerate(texts) if len(words) >= MIN_WORDS), key=lambda i: -len(texts[i]))
    if not order:
        return out
    numbers: dict = defaultdict(count().__next__)
    flat, offsets, bars = [-1], [], -1
    for i in order:
        offsets.append(len(flat))
        flat += map(numbers.__getitem__, texts[i])
        bars -= 1
        flat.append(bars)
    lengths = [len(texts[i]) for i in order]
    largest = 1 << (lengths[0] // 2).bit_length()
    # windows of the last blocks reach past the end, over words that occur once
    ids = np.array(flat + list(range(bars - 1, bars - 2 - 6 * max(largest, SMALL), -1)), np.int64)
    codes = _mix(ids.astype(np.uint64)) >> np.uint64(33)
    order_of_words = np.argsort(ids, kind="stable")
    again = ids[order_of_words[1:]] == ids[order_of_words[:-1]]
    gaps = np.full(len(ids), np.iinfo(np.int64).max)
    gaps[order_of_words[:-1][again]] = np.diff(order_of_words)[again]
    squares: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[Run] = []
    period = 1
    while period <= lengths[0] // 2:
        last = bisect_right(lengths, -max(MIN_WORDS, 2 * period), key=lambda n: -n) - 1
        scale = scale_of(period)
        size, t = scale.block, scale.transform
        if t.prime not in squares:
            # codes have 31 bits; modulo the smaller prime some fall together, which the comparison of words finds
            here = t.mod(codes.copy())
            squares[t.prime] = here, np.r_[np.uint64(0), np.cumsum(t.mod(here * here))]
        block, distance = scale.occurrences(*squares[t.prime], gaps, -(-(offsets[last] + lengths[last]) // size))
        if period == 1:
            for q in range(1, SMALL):
                mine = distance == q
                if mine.any():
                    found += _grown(ids, block[mine], distance[mine], size, found)
        elif len(block):
            found += _grown(ids, block, distance, size, found)
        period = SMALL if period == 1 else 2 * period
    for a, b, q in sorted(found, key=lambda r: (r[0], r[2])):
        k = bisect_right(offsets, a) - 1
        out[order[k]].append((a - offsets[k], b - a, q))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list], list] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period in words, by start and period), collapsed.

    Words stand between ASCII white space, as they are. A run is a stretch of at least 12 words and two periods, with its smallest period,
    that no neighbouring word continues; runs may overlap. ``collapsed`` is the text without the words that some run holds behind its
    first period, joined by single spaces. A null or empty text has no words, no runs and an empty ``collapsed``. Rows are
    judged one by one: repeated rows and ids, and null ids, give a row each. Other columns are ignored, whatever their names; an empty
    table gives an empty result. ``prepare`` may change a row's words (as UTF-8) before the search. Texts are searched whole,
    one text in one task, with memory in proportion to the longest text.
    """
    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def done() -> pa.RecordBatch:
            texts = [words for _, words in held]
            runs = runs_of(texts)
            columns = [
                pa.array([i for i, _ in held], pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
                pa.array([[{"start": a, "length": n, "period": q} for a, n, q in some] for some in runs], pa.list_(_RUN)),
                pa.array([b" ".join(collapsed(w, some)).decode("utf-8", "surrogatepass") for w, some in zip(texts, runs, strict=True)], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

        for doc_id, text in rows_of(incoming):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            if prepare is not None:
                words = prepare(doc_id, words)
            if held and weight + len(words) > WORDS_AT_ONCE:
                yield done()
                held, weight = [], 0
            held.append((doc_id, words))
            weight += len(words)
        if held:
            yield done()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, _OUT)


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of ``periodic_runs``: n_runs, the longest run (ties: smallest start, then period) and digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    period = -F.col("best.p")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(F.lit(1000).cast("long") * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
