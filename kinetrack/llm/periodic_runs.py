"""Periodic runs of words: maximal stretches that repeat with their smallest period.

A run of period p has at least 2p words, so it holds a point g of the grid 0, p, 2p, ... together with
g + p.  All pairs (period, grid point) of a slice of texts, n/p points for each p and so n log n in all,
are looked at as NumPy arrays: those whose two words agree go through one binary search of the longest
common extension forwards and one backwards, on prefix hashes, all pairs at once.  What comes out is
kept once for each stretch, with its smallest period (a stretch of at least 2p words with period p whose
smallest period is q has p as a multiple of q, and the same ends), and compared word by word.

Hashes are polynomials modulo two primes of 31 bits.  A wrong "equal" makes an extension too long, which
the words show; the slice is then done again with other bases.

The work is a map over rows without a shuffle: a task holds the words' numbers of a slice, and of a long
text the numbers of its words, never its words as objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.exprs import words
from kinetrack.llm.textbytes import lean

#: Words of the shortest run.
SHORTEST = 12

#: Words of a slice, pairs looked at at once, periods of a block of a long text, bytes of a text split at once.
SLICE_WORDS, PAIRS, PERIODS, PIECE = 1 << 16, 1 << 19, 1 << 18, 1 << 20

#: Two primes below 2^31.
PRIMES = (2147483647, 2147483629)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Prefixes:
    """Hashes of all beginnings of a sequence of numbers; equality of two stretches of one length."""

    def __init__(self, ids: np.ndarray, seed: int = 0) -> None:
        bases = np.random.default_rng(seed).integers(1 << 20, PRIMES[1], 2)
        self.sums = [self._sums(ids, int(b), p) for b, p in zip(bases, PRIMES, strict=True)]

    @staticmethod
    def _sums(ids: np.ndarray, base: int, prime: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(ids)
        power = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:  # powers double in number with each product
            more = min(done, n + 1 - done)
            power[done : done + more] = power[:more] * pow(base, done, prime) % prime
            done += more
        sums = np.zeros(n + 1, np.int64)
        np.cumsum((ids + 1) * power[:n] % prime, out=sums[1:])  # below 2^63 for 2^32 words
        sums %= prime
        return sums, power, prime

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` numbers from ``a`` equal those from ``b`` >= ``a``."""
        same = np.ones(len(a), bool)
        for sums, power, prime in self.sums:
            left = (sums[a + length] - sums[a]) % prime * power[b - a] % prime
            same &= left == (sums[b + length] - sums[b]) % prime
        return same

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of ``a`` and ``b``, up to ``most``: forwards from them, or back from before them."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo] + 1) >> 1
            shift = middle if back else 0
            same = self.equal(a[todo] - shift, b[todo] - shift, middle)
            low[todo] = np.where(same, middle, low[todo])
            high[todo] = np.where(same, high[todo], middle - 1)
            todo = todo[low[todo] < high[todo]]
        return low


def _pairs(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point in the whole sequence), some PAIRS at a time; ``at`` are the texts' beginnings."""
    n = np.diff(at)
    half = n // 2
    for first in range(1, int(half.max(initial=0)) + 1, PERIODS):
        some = np.clip(half - first + 1, 0, PERIODS)
        text = np.repeat(np.arange(len(n)), some)
        period = np.arange(len(text)) - np.repeat(np.cumsum(some) - some, some) + first
        points = (n[text] - 1) // period
        ends = np.cumsum(points)
        lo = 0
        while lo < len(text):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            row = np.repeat(np.arange(lo, hi), points[lo:hi])
            nth = np.arange(len(row)) - (ends[row] - points[row] - before)
            yield text[row], period[row], at[text[row]] + nth * period[row]
            lo = hi


def _candidates(ids: np.ndarray, at: np.ndarray, shortest: int, seed: int) -> np.ndarray:
    """Rows (first word, word after the last, period), each stretch once, by place."""
    hashes, found = None, []
    for text, p, g in _pairs(at):
        good = np.flatnonzero(ids[g] == ids[g + p])
        text, p, g = text[good], p[good], g[good]
        lo, hi = at[text], at[text + 1]
        # a run has max(shortest, 2p) - p > 1 words that agree with those p on, so a neighbour of g agrees too
        after, before = np.minimum(g + 1, hi - p - 1), np.maximum(g - 1, lo)
        good = np.flatnonzero(((g + 1 < hi - p) & (ids[after] == ids[after + p])) | ((g > lo) & (ids[before] == ids[before + p])) | (p < 2))
        if not len(good):
            continue
        p, g, lo, hi = p[good], g[good], lo[good], hi[good]
        hashes = hashes or Prefixes(ids, seed)
        # a run is taken at its first grid point only
        first = ~((g - p >= lo) & hashes.equal(np.maximum(g - p, lo), g, np.where(g - p >= lo, p, 0)))
        p, g, lo, hi = p[first], g[first], lo[first], hi[first]
        start = g - hashes.extension(g, g + p, np.minimum(g - lo, p - 1), back=True)
        end = g + p + hashes.extension(g, g + p, hi - g - p)
        long = end - start >= np.maximum(shortest, 2 * p)
        found.append(np.stack([start[long], end[long], p[long]], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1)
    return rows[~again]


def runs_of(ids: np.ndarray, at: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Runs (first word, word after the last, period) of texts that lie one after the other, by place.

    ``ids`` number the words, equal words alike; ``at`` are the texts' beginnings and the end.  ``shortest``
    is at least 3.
    """
    seed = 0
    while True:
        rows = _candidates(ids, at, shortest, seed)
        text = np.searchsorted(at, rows[:, 0], side="right") - 1
        for (s, e, p), lo, hi in zip(rows.tolist(), at[text].tolist(), at[text + 1].tolist(), strict=True):
            whole = (s == lo or ids[s - 1] != ids[s - 1 + p]) and (e == hi or ids[e] != ids[e - p])
            if not whole or not np.array_equal(ids[s : e - p], ids[s + p : e]):
                break
        else:
            return rows
        seed += 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    lo = 0
    while lo < len(raw):
        cut = _SPACE.search(raw, lo + PIECE)
        hi = cut.start() if cut else len(raw)
        yield raw[lo:hi].split()  # for bytes, split() knows just these six characters
        lo = hi


def _numbered(raw: bytes, numbers: _Numbers) -> np.ndarray:
    parts = [np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in _pieces(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])


def _collapsed(raw: bytes, runs: np.ndarray, n: int) -> bytes:
    """The words that no run holds after its first period, joined by one space; ``runs`` count from the text's first word."""
    if not len(runs):
        return b" ".join(y for y in (b" ".join(x) for x in _pieces(raw)) if y)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    keep, lo, out = np.cumsum(steps[:-1]) == 0, 0, []
    for x in _pieces(raw):
        out.append(b" ".join([w for w, k in zip(x, keep[lo : lo + len(x)].tolist(), strict=True) if k]))
        lo += len(x)
    return b" ".join(y for y in out if y)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _batch(keys: pa.Array, raws: list[bytes], ids: list[np.ndarray], shortest: int) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    runs = runs_of(np.concatenate(ids), at, shortest)
    cuts = np.searchsorted(runs[:, 0], at)
    flat = runs - np.repeat(at[:-1], np.diff(cuts))[:, None] * np.array([1, 1, 0])
    lists = pa.ListArray.from_arrays(
        pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(_RUN))
    )
    texts = [_collapsed(raw, flat[cuts[i] : cuts[i + 1]], len(ids[i])) for i, raw in enumerate(raws)]
    return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", *_OUT.names])


def _task(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    lean()
    for batch in batches:
        raws, ids, numbers, lo, n = [], [], _Numbers(), 0, 0
        for i, text in enumerate(batch.column(1)):
            raws.append((text.as_py() or "").encode())
            ids.append(_numbered(raws[-1], numbers))
            n += len(ids[-1])
            if i + 1 == batch.num_rows or n >= SLICE_WORDS:
                yield _batch(batch.column(0).slice(lo, len(raws)), raws, ids, shortest)
                raws, ids, numbers, lo, n = [], [], _Numbers(), i + 1, 0


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and then period), collapsed: one row for each row of ``docs``.

    Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return.  A run has
    a smallest period q, at least max(``shortest``, 2q) words, and no neighbouring word continues it.
    ``collapsed`` holds the words that no run contains after its first q, joined by one space.

    A null text has no words, like an empty one: no runs, collapsed ''.  A null doc_id stays null; repeated rows
    are rows of their own; of the input's other columns none is read or returned, so no name can clash; an
    empty table gives an empty one.  Texts are whole, however long; a text is one row of one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: _task(batches, shortest), schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of ``docs``, the text made periodic from some word on where crc32(doc_id) says so (10 % of the rows).

    With h = crc32 of the decimal doc_id, g = h // 10, and n words: where h % 10 = 0 and n > 0, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).  A null doc_id has no h.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8)))
    # the words that stay, then whole periods and one cut short
    tail = F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.floor((n - F.col("a")) / F.col("p")).cast("int")
    rest = ((n - F.col("a")) % F.col("p")).cast("int")
    parts = F.array(F.slice("words", F.lit(1), F.col("a").cast("int")), F.flatten(F.array_repeat(tail, times)), F.slice(tail, F.lit(1), rest))
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.flatten(parts), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    one = found.withColumn("best", best)
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"), F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.short")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
