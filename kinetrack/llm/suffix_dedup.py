"""Repeated byte strings by two shuffled rounds at half the threshold and at the threshold.

This keeps of prefix doubling what Spark can afford: a position's name by 2h bytes is the pair of the
names at the position and at the position + h, and what a round finds unique cannot repeat at a greater
length and goes.  It is not the literal method: names are content hashes (so tasks agree on them without
a global numbering and nothing is reranked), and the rounds under half the threshold, which would sort
every position of every text, are left out: the names of that length come from prefix sums of the text
in a task.  The README has the figures behind this.

* First shuffled round, half the threshold.  Any string of the full length holds, within its first
  half, one synchronised position: that with the smallest name, which any copy of the string has at
  the same place.  Only these positions are sorted, about one in half a half, each with the run of
  starts that it stands for.  Runs whose whole bytes repeat are settled here; positions whose name
  is unique settle their run as not repeated.
* Second shuffled round, the threshold: every start of the runs left, by its rank pair at offset
  half, against each other and one of each kind of settled run.  This is exact at the ends of repeats.
* Spans are the union of the repeated starts' bytes; they are cut out of the input all at once.

Edge cases: null text is empty; texts under the threshold have no start; overlapping repeats count,
in the same text too; repeated rows (even with equal doc_id) are different texts to match, each
with its own place (see ``place``); a null doc_id is one like any other; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.storage import written
from kinetrack.llm.textbytes import SLICE_BYTES, lean, slices, utf8_columns

#: Parameters of the names: an odd multiplier, a scrambler, and the seed of the byte table.
_BASE = 0x9E3779B97F4A7C15
_SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240).integers(0, 2**64, 256, np.uint64)
#: A second sum goes by a prime below 2^31.
_PRIME, _BASE2 = np.uint64(2147483647), 1103515245
_TABLE2 = np.random.default_rng(20241).integers(1, 2147483647, 256, np.uint64)
_PLACE = np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime, doubling in number with each product."""
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
        done += more
    return out


class Names:
    """Names of all strings of a buffer: ``of(i, n)`` for arrays of starts and lengths.

    A name mixes two polynomials of the bytes: one modulo 2^64, whose names alone are equal for some pairs of strings of two
    symbols (Thue-Morse strings of 1,024 bytes), and one modulo a prime, which tells these apart.
    """

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _power2 = np.ones(1, np.uint64)
    _inverse2 = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(Names._power) <= n:
            size = max(n + 1, 2 * SLICE_BYTES)
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(Names, name, np.cumprod(x))
            Names._power2, Names._inverse2 = _powers(_BASE2, size), _powers(pow(_BASE2, -1, int(_PRIME)), size)
        self.sums, self.sums2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * Names._power[:n], out=self.sums[1:])
        np.cumsum(_TABLE2[raw] * Names._power2[:n] % _PRIME, out=self.sums2[1:])

    def every(self, size: int) -> np.ndarray:
        """Of every string of that length."""
        n = len(self.sums) - size
        return self._mixed((self.sums[size:] - self.sums[:-size]) * Names._inverse[:n], (self.sums2[size:] - self.sums2[:-size]) % _PRIME * Names._inverse2[:n] % _PRIME)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        own = (self.sums[start + size] - self.sums[start]) * Names._inverse[start]
        return self._mixed(own, (self.sums2[start + size] - self.sums2[start]) % _PRIME * Names._inverse2[start] % _PRIME)

    @staticmethod
    def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a ^ (b * _SCRAMBLE)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x * _SCRAMBLE
    x ^= x >> np.uint64(32)
    return x * _SCRAMBLE


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, in linear time."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For one text: name, whole-run name, first start and number of starts of every synchronised position."""
    half = size // 2
    if len(raw) < size:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    names = Names(raw)
    short = names.every(half)
    # the upper half of a name, and the place below it (a text is shorter than 2^32): the same part of names is compared in all
    # texts, and of equal ones the leftmost counts, so what is chosen depends on the window's bytes alone
    order = ((scramble(short) >> _PLACE) << _PLACE) | np.arange(len(short), dtype=np.uint64)
    anchor = (_window_min(order, size - half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
    at = anchor[lo]
    whole = scramble(names.of(lo, hi - 1 - lo + size)) + scramble((at - lo).astype(np.uint64) * np.uint64(65537) + (hi - lo).astype(np.uint64))
    return short[at], whole, lo, hi - lo



RUNS = "doc_id long, place long, name long, whole long, start int, starts int"


def _with_place(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Rows with a ``place``: a hash of the text, so that rows with equal doc_id stay apart.

    No key is null: a null doc_id is 0 with a place of its own kind; ``own`` is the doc_id as it was.
    """
    own = F.col("doc_id").cast("long")
    place = F.when(own.isNull(), F.xxhash64("text", F.lit("no id"))).otherwise(F.xxhash64("text"))
    return docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"), place.alias("place"), own.alias("own"), "text", *([F.struct(*carry).alias("carried")] if carry else []))


def runs(docs: DataFrame, size: int) -> DataFrame:
    """The first shuffled round's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "place"))
            for lo, hi, at, raw in slices(batch.column("text")):
                parts, owner = [], []
                for k in range(hi - lo):
                    found = runs_of(raw[at[k] : at[k + 1]], size)
                    parts.append(found)
                    owner.append(np.full(len(found[0]), lo + k))
                who = np.concatenate(owner)
                name, whole, start, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[who]), pa.array(place[who]), pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32)),
                    ],
                    RUNS.replace(",", "").split()[::2],
                )

    return docs.select("doc_id", "place", "text").mapInArrow(run, RUNS)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that more than one row has (counted before the shuffle)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def _pairs(texts: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """Rank pairs of every start of the runs left, mixed to one name; texts and runs meet by document."""
    half = size // 2
    by_doc = left.groupBy("doc_id", "place").agg(F.collect_list(F.struct("start", "starts")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for k in range(batch.num_rows):
                raw = np.frombuffer((batch.column("text")[k].as_py() or "").encode(), np.uint8)
                names = Names(raw)
                own = batch.column("runs")[k].values
                lo, n = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "starts"))
                start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pair = scramble(names.of(start, half)) * np.uint64(_BASE) + scramble(names.of(start + half, size - half) + np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), batch.column("doc_id")[k].as_py(), np.int64)), pa.array(np.full(len(start), batch.column("place")[k].as_py(), np.int64)),
                        pa.array(pair.view(np.int64)), pa.array(start.astype(np.int32)),
                    ],
                    ["doc_id", "place", "pair", "start"],
                )

    # all columns of ``texts``, so that its one shuffle serves here and at the end
    return texts.join(by_doc, ["doc_id", "place"]).select(*texts.columns, "runs").mapInArrow(run, "doc_id long, place long, pair long, start int")


def merged(start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, start + size)."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    lo = start[order].astype(np.int64)
    hi = np.maximum.accumulate(lo + size[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])
    return list(zip(lo[new].tolist(), hi[last].tolist(), strict=True))


def trimmed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans, after these have drawn back to whole characters."""
    inner = lambda i: 0 < i < len(text) and text[i] & 0xC0 == 0x80
    out, last = [], 0
    for a, b in spans:
        while inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        out.append(text[last:a])
        last = max(last, b)
    return b"".join([*out, text[last:]])


def repeated_spans(docs: DataFrame, size: int = 400, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (maximal repeated byte runs) and ``kept`` (the other bytes, in order).

    With ``carry`` (names of columns) there is a ``text`` instead of ``kept`` - the same, but with spans drawn back
    to whole characters - and a struct ``carried`` of these columns.
    """
    carry = carry or []
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _with_place(docs, carry)
    texts = placed.repartition(partitions, "doc_id", "place")
    first = written(runs(placed, size), "suffix-first")
    # tables of their own, so that a join with a very frequent name can be split
    same = first.join(written(_repeated(first, "name"), "suffix-names"), "name", "left_semi")
    settled = written(_repeated(first, "whole").withColumn("settled", F.lit(True)), "suffix-settled")
    marked = written(same.join(settled, "whole", "left"), "suffix-second")
    # what is left meets one of each kind of settled run of the same name too
    left = marked.where("settled IS NULL")
    kinds = marked.where("settled").groupBy("whole").agg(F.min(F.struct("name", "doc_id", "place", "start", "starts")).alias("one")).select("one.*")
    kinds = kinds.join(left.select("name").distinct(), "name", "left_semi")
    columns = ["doc_id", "place", "start", "starts"]
    pairs = _pairs(texts, left.select(columns).unionByName(kinds.select(columns)), size)
    late = pairs.join(_repeated(pairs, "pair"), "pair", "left_semi").select("doc_id", "place", "start", F.lit(1).alias("starts"))
    early = marked.where("settled").select(columns)
    by_doc = early.unionByName(late).groupBy("doc_id", "place").agg(F.collect_list(F.struct("start", "starts")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            at, raw = utf8_columns(batch.column("text"))
            n, spans, kept, whole = [], [], [], []
            for k in range(batch.num_rows):
                text = raw[at[k] : at[k + 1]].tobytes()
                own = batch.column("runs")[k].values
                found = []
                if own is not None and len(own):
                    lo, many = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "starts"))
                    found = merged(lo, many + size - 1)
                n.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in found])
                edge = [0, *(x for s in found for x in s), len(text)]
                kept.append(None if carry else b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                whole.append(trimmed(text, found).decode() if carry else None)
            columns = [batch.column("own"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(whole, pa.string())]
            names = ["doc_id", "n_bytes", "spans", "kept", "text"]
            if carry:
                columns.append(batch.column("carried"))
                names.append("carried")
            yield pa.RecordBatch.from_arrays(columns, names)

    shape = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, text string"
    if carry:
        shape += f", carried {placed.schema['carried'].dataType.simpleString()}"
    return texts.join(by_doc, ["doc_id", "place"], "left").select(*texts.columns, "runs").mapInArrow(run, shape)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: list[bytes], size: int) -> list[list[tuple[int, int]]]:
    """The same spans by a dictionary of all strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            key = hashlib.sha1(t[i : i + size]).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t in texts:
        starts = np.array([i for i in range(len(t) - size + 1) if seen[hashlib.sha1(t[i : i + size]).digest()] > 1], np.int64)
        out.append(merged(starts, np.full(len(starts), size)))
    return out
