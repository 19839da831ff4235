"""N-gram language model in an Elias-Fano trie that tasks memory-map.

Training counts words, word pairs and (``order`` 3) triples over all training texts.  The trie has a level
for each order, cut into pieces of bounded size that are files of the shared folder:

* words: their 64-bit hashes in ascending order and sums of their counts; a word's id is its rank;
* children: for each piece, the contexts in it with their quantised back-off weights, monotone pointers to
  their first child, the children's ids relative to their context, and sums of counts, all Elias-Fano, with
  quantised log10 shares;
* the same once more for triples, whose contexts are pairs: a pair's id is its rank among the children.

A query finds its context in a piece, reads two pointers, and searches the child's successor between
them.  Pieces are cut by range over (context, child), so a frequent context is spread over many; the
weights of contexts at the ends of pieces are put together afterwards.

Counting: each task sorts the keys of some millions of tokens and sends them on in parts, as differences.
A key's part is its place among all tokens if words stood independently, from the counts of the level below:
parts follow the order of keys, and a frequent context takes many.  So keys are shuffled once, and
each part is merged and written as it arrives.

Probabilities: interpolated absolute discounting,
    P(w | u) = max(n(u, w) - D, 0) / n(u) + backoff(u) * P(w),   P(w) = (n(w) + 1) / (N + V + 1),
    P(w | t, u) = max(n(t, u, w) - D, 0) / n(t, u) + backoff(t, u) * P(w | u),
with pairs and triples seen fewer than ``min_count`` times pruned (their mass goes to the back-off weight, so that
each context's probabilities still sum to one over the words and one unknown word).

Edge cases: null and empty texts are one end token; a null doc_id is a training row; without any
training text N = V = 0 and every word is unknown; repeated rows count as often as they stand; other
columns are not read, so their names cannot clash; texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.elias_fano import EliasFano
from kinetrack.llm.storage import fresh_path, written
from kinetrack.llm.suffix_dedup import Names, scramble
from kinetrack.llm.textbytes import lean, slices

DISCOUNT = 0.75
#: Entries of a piece (also the tokens of a part), keys that a task sorts at once, and the step of quantised
#: log10 values (16 bits: 0 to -16).
PIECE = 1 << 20
KEYS = 1 << 22
STEP = 16.0 / 65535
_POWER = 10.0 ** (-STEP * np.arange(65536))
_SIGN = np.uint64(1 << 63)
_LONG, _MASKS = 64, np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
END = np.uint64(0x656E642D6F662D74)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def _hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words by eight bytes at a time, what is past 64 by its name; words of up to eight bytes never share one."""
    eights = np.lib.stride_tricks.as_strided(np.concatenate([raw, np.zeros(8, np.uint8)]).view(), (len(raw) + 1, 8), (1, 1))
    out, own = scramble(size.astype(np.uint64)), np.arange(len(size))
    for k in range(0, _LONG, 8):
        left = size[own] - k
        chunk = eights[start[own] + k].view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        out[own] = scramble(out[own] ^ chunk)
        own = own[left > 8]
        if not len(own):
            return out
    out[own] = scramble(out[own] ^ Names(raw).of(start[own] + _LONG, size[own] - _LONG))
    return out


def tokens_of(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice of texts, each text closed by END, and the number of tokens of each text."""
    raw = _LOWER[raw]
    solid = ~_SPACE[raw]
    before = np.concatenate([[False], solid[:-1]]) if len(raw) else solid
    after = np.concatenate([solid[1:], [False]]) if len(raw) else solid
    some = at[:-1] < at[1:]
    before[at[:-1][some]] = False
    after[at[1:][some] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    word = _hashes(raw, start, end - start)
    n = np.searchsorted(start, at[1:]) - np.searchsorted(start, at[:-1])
    out = np.full(len(word) + len(n), END, np.uint64)
    place = np.arange(len(word)) + np.repeat(np.arange(len(n)), n)
    out[place] = word
    return out, n + 1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [tokens_of(at, raw) for _, _, at, raw in slices(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


#: Bytes of text that a task turns into tokens at once, in counting words and else, and tokens that it looks up at once: these
#: go through every piece, so that the more there are the fewer are a token's steps.
COUNT_BYTES, PART_BYTES, TOKENS = 6 << 20, 1 << 20, 1 << 21


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in slices(batch.column("text"), most):
            yield batch.slice(lo, hi - lo)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows of some ``most`` tokens, of however many batches; all their tokens, and the number of tokens of each text."""
    held, size = [], 0
    for batch in _parts(batches, PART_BYTES):
        held.append((batch, *_tokens(batch.column("text"))))
        size += len(held[-1][1])
        if size >= most:
            rows, word, n = zip(*held, strict=True)
            held, size = [], 0
            yield list(rows), np.concatenate(word), np.concatenate(n)
    if held:
        rows, word, n = zip(*held, strict=True)
        yield list(rows), np.concatenate(word), np.concatenate(n)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.partition("/")[0] else f"file://{uri}")


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays one after the other in a file; returns its description, which is needed to map it."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    at, parts = 0, []
    with fs.open_output_stream(f"{path}/{name}") as out:
        for k, x in arrays.items():
            data = np.ascontiguousarray(x).tobytes()
            data += bytes(-len(data) % 8)
            out.write(data)
            parts.append(f"{k}:{x.dtype.str}:{len(x)}:{at}")
            at += len(data)
    return f"{folder}/{name}|" + ";".join(parts)


@lru_cache(maxsize=4096)
def mapped(described: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the store is a mounted file system."""
    uri, _, parts = described.rpartition("|")
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)  # the subclass makes each look-up dearer
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    out = {}
    for x in parts.split(";"):
        k, kind, n, at = x.split(":")
        size = int(n) * np.dtype(kind).itemsize
        out[k] = raw[int(at) : int(at) + size].view(kind)
    return out


def _ef_arrays(name: str, x: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}_low": x.low, f"{name}_high": x.high, f"{name}_zeros": x.zeros, f"{name}_n": np.array([x.n, x.bits], np.int64)}


def _ef(arrays: dict, name: str) -> EliasFano:
    """A sequence of a mapped file, kept with its arrays."""
    if name not in arrays:
        n, bits = arrays[f"{name}_n"].tolist()
        arrays[name] = EliasFano(n, bits, arrays[f"{name}_low"], arrays[f"{name}_high"], arrays[f"{name}_zeros"])
    return arrays[name]


class Pieces:
    """Pieces of a level in order of their first key."""

    def __init__(self, rows: list):
        """Rows of PIECE_ROW."""
        rows = sorted(rows, key=lambda r: int(np.int64(r["first"]).view(np.uint64)))
        self.first = np.array([r["first"] for r in rows], np.int64).view(np.uint64)
        self.base = np.concatenate([[0], np.cumsum([r["entries"] for r in rows])]).astype(np.int64)
        self.mass = np.concatenate([[0], np.cumsum([r["total"] for r in rows])]).astype(np.int64)
        self.files = [r["file"] for r in rows]
        # a context at an end of a piece may go on in others
        kept: dict[int, list[float]] = {}
        for e in (e for r in rows for e in r["edges"]):
            x = kept.setdefault(e["context"], [0.0, e["total"]])
            x[0] += e["kept"]
        self.edge = np.array(sorted(kept), np.int64)
        self.edge_weight = np.array([max(1.0 - kept[c][0] / kept[c][1], 1e-15) for c in self.edge.tolist()])

    @staticmethod
    def _spans(cut: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        cut = np.append(cut, n)
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield p, int(cut[p]), int(cut[p + 1])

    def of(self, key: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(piece, first, last + 1 of the queries that it answers) for ascending queries."""
        return self._spans(np.searchsorted(key, self.first), len(key))

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For entries by id: the sum of the counts before it, and its count."""
        before, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        order = None
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids)
            ids = ids[order]
        for p, a, b in self._spans(np.searchsorted(ids, self.base[:-1]), len(ids)):
            arrays, i = mapped(self.files[p]), ids[a:b] - self.base[p]
            if "sums_n" in arrays:
                lo, hi = (x.astype(np.int64) for x in _ef(arrays, "sums").both(i))
            else:
                lo, hi = arrays["sums"][i], arrays["sums"][i + 1]
            before[a:b], count[a:b] = lo + self.mass[p], hi - lo
        if order is not None:
            before[order], count[order] = before.copy(), count.copy()
        return before, count


class Trie:
    def __init__(self, words: list, children: list, triples: list, tokens: int, texts: int):
        self.words, self.children, self.triples = Pieces(words), Pieces(children), Pieces(triples)
        self.tokens, self.texts, self.types = tokens, texts, int(self.words.base[-1])
        #: Bits of a word's id in a key.
        self.bits = max(1, self.types.bit_length())

    def ids(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words."""
        order = np.argsort(word)
        asked, ids, n = word[order], np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        for p, a, b in self.words.of(asked):
            hashes = mapped(self.words.files[p])["hash"]
            i = np.minimum(np.searchsorted(hashes, asked[a:b]), len(hashes) - 1)
            ids[a:b] = np.where(hashes[i] == asked[a:b], i + self.words.base[p], -1)
        known = np.flatnonzero(ids >= 0)
        n[known] = self.words.counts(ids[known])[1]
        out, count = np.empty_like(ids), np.empty_like(n)
        out[order], count[order] = ids, n
        return out, count

    def found(self, level: Pieces, context: np.ndarray, word: np.ndarray, scored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: not kept) and shares (0) of a level's entries, and weights of their contexts (1).

        Queries ascend by context and word (-1: unknown); without ``scored`` shares and weights are not looked up.
        """
        ids, share, weight = np.full(len(context), -1, np.int64), np.zeros(len(context) * scored), np.ones(len(context) * scored)
        known = int(np.searchsorted(context, 0))
        key = (context[known:] << self.bits | np.maximum(word[known:], 0)).astype(np.uint64)
        for p, a, b in level.of(key):
            arrays, a, b = mapped(level.files[p]), a + known, b + known
            head = np.flatnonzero(np.diff(context[a:b], prepend=-1))
            size = np.diff(head, append=b - a)
            at = _ef(arrays, "context").find(context[a:b][head].astype(np.uint64))
            if scored:
                weight[a:b] = np.repeat(np.where(at >= 0, _POWER[arrays["backoff"][np.maximum(at, 0)]], 1.0), size)
            pointers, first, many = _ef(arrays, "pointer"), None, None
            if level is self.children:
                first, last = (x.astype(np.int64) for x in pointers.both(np.maximum(at, 0)))
                many = last - first
            values = self.spread(2 if level is self.children else 3, first, at, many, size, word[a:b])
            at = np.repeat(at, size)
            own = np.flatnonzero((at >= 0) & (word[a:b] >= 0))
            at, own = at[own], own + a
            children = lambda rows, at=at, pointers=pointers: tuple(x.astype(np.int64) for x in pointers.both(at[rows]))
            j = _ef(arrays, "child").find(values[own - a].astype(np.uint64), children)
            own, j = own[j >= 0], j[j >= 0]
            ids[own] = j + level.base[p]
            if scored:
                share[own] = _POWER[arrays["log10"][j]]
        if scored and len(level.edge):
            lo, hi = (np.searchsorted(context, level.edge, side=x) for x in ("left", "right"))
            n = hi - lo
            weight[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(level.edge_weight, n)
        return ids, share, weight

    def spread(self, order: int, first: np.ndarray | None, context: np.ndarray, many: np.ndarray | None, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Values of children in ascending order, for contexts (numbers in a piece, each for ``size`` words).

        A word's children are often very many: a context has as large a share of the values as it has children (their
        first and their number), so that those of any context lie equally dense.  Those of pairs lie by context and word.
        """
        if order > 2:
            return np.repeat(context, size) * self.types + word
        return np.repeat(first << self.bits, size) + word * np.repeat(many, size)

    def begin(self) -> int:
        """The id that stands for the start of a text, as a context."""
        return self.types

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens + self.types + 1.0)

    def contexts(self, order: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts of an order: how often those before it were followed by anything, and how often it was."""
        if order > 2:
            return self.children.counts(context)
        before, count = np.full(len(context), self.tokens, np.int64), np.full(len(context), self.texts, np.int64)
        inner = context != self.begin()
        before[inner], count[inner] = self.words.counts(context[inner])
        return before, count

    def part(self, order: int, key: np.ndarray, parts: int) -> np.ndarray:
        """The part of ascending keys: by where they would stand among all if words did not depend on their contexts.

        Nearly all contexts lie in one part whole, so that their words need no look-up.
        """
        context, total = key >> self.bits, self.tokens + self.texts if order < 3 else int(self.children.mass[-1])
        first = np.flatnonzero(np.diff(context, prepend=-1))
        size = np.diff(first, append=len(key))
        before, count = self.contexts(order, context[first])
        at = lambda x: np.minimum((x / total * parts).astype(np.int64), parts - 1)
        low, high = at(before), at(before + count)
        out, rows = np.repeat(low, size), np.flatnonzero(np.repeat(low < high, size))
        if len(rows):
            words = self.words.counts(key[rows] & ((1 << self.bits) - 1))[0] / self.tokens
            out[rows] = at(np.repeat(before, size)[rows] + np.repeat(count, size)[rows] * words)
        return out


PIECE_ROW = "first long, entries long, total long, file string, edges array<struct<context:long,kept:double,total:double>>"
_EDGE = pa.list_(pa.struct([("context", pa.int64()), ("kept", pa.float64()), ("total", pa.float64())]))
PART_ROW = "part long, first long, n long, keys binary, counts binary"


def _pieces_written(rows: DataFrame, run, name: str) -> list:
    return written(rows.mapInArrow(run, PIECE_ROW), name).collect()


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers with as few bytes as the largest needs: all lowest bytes, then all second ones, and so on."""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _parted(keys: list[np.ndarray], trie: Trie, order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys and their counts, a row for each part."""
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    if not len(key):
        return
    part = trie.part(order, key, parts)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]]).tolist()
    step = np.diff(key, prepend=0)
    step[cut[:-1]] = 0
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(part[cut[:-1]]), pa.array(key[cut[:-1]]), pa.array(np.diff(cut)),
            pa.array([_planes(step[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(n[a:b]) for a, b in spans], pa.binary()),
        ],
        ["part", "first", "n", "keys", "counts"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and summed counts of each part; rows come in the order of their parts."""
    now, held, size = None, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.add.reduceat(n, first)

    for batch in batches:
        for part, first, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and part != now:
                yield fold()
                held, size = [], 0
            now = part
            held.append((first + np.cumsum(_from_planes(keys, n)), _from_planes(counts, n)))
            size += n
            if size > KEYS:
                held = [fold()]
                size = len(held[0][0]) // 2  # folded again when as much has come in addition
    if held:
        yield fold()


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of runs of at most ``most`` rows of a sorted partition."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
        while n >= most:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield [x[:most] for x in whole]
            held, n = [[x[most:] for x in whole]], n - most
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _piece(folder: str, kind: str, first: int, n: int, total: int, arrays: dict[str, np.ndarray], edges: list[dict] | None = None) -> pa.RecordBatch:
    described = save(folder, f"{kind}-{uuid.uuid4().hex}", arrays)
    columns = [pa.array([np.uint64(first).view(np.int64)]), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([described]), pa.array([edges or []], _EDGE)]
    return pa.RecordBatch.from_arrays(columns, ["first", "entries", "total", "file", "edges"])


def _before(x: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """Each token's predecessor's value, ``start`` for the first of each text (n: tokens of texts)."""
    out = np.concatenate([[start], x[:-1]]) if len(x) else x.copy()
    out[np.cumsum(n) - n] = start
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the place of each key among them (np.unique holds twice as much)."""
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    back = np.empty(len(key), np.int32)
    back[order] = np.cumsum(first, dtype=np.int32) - 1
    return key[first], back


def _level(texts: DataFrame, trie: Trie, order: int, min_count: int, piece: int, folder: str) -> list:
    """Counts and writes the pairs (order 2) or triples of all texts."""
    spark = texts.sparkSession
    shared, bits = spark.sparkContext.broadcast(trie), trie.bits
    parts = max(1, -(-(trie.tokens + trie.texts) // piece))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model, held = shared.value, []
        for _, word, n in _gathered(batches, TOKENS):
            inverse, distinct = pd.factorize(word)
            ids = model.ids(distinct)[0][inverse]
            del word, inverse
            context = _before(ids, n, model.begin())
            if order > 2:
                pair, back = _distinct(context << bits | ids)  # in order, as the trie has them
                context = _before(model.found(model.children, pair >> bits, pair & ((1 << bits) - 1), scored=False)[0][back], n, -1)
            held.append((context << bits | ids)[context >= 0])
            if sum(map(len, held)) > KEYS:
                yield from _parted(held, model, order, parts)
                held = []
        if held:
            yield from _parted(held, model, order, parts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model = shared.value
        for all_keys, all_n in _merged(batches):
            kept = all_n >= min_count
            all_keys, all_n = all_keys[kept], all_n[kept]
            for lo in range(0, len(all_keys), piece):
                key, n = all_keys[lo : lo + piece], all_n[lo : lo + piece]
                context = key >> bits
                first = np.flatnonzero(np.diff(context, prepend=-1))
                own, size = context[first], np.diff(first, append=len(key))
                total, mass = model.contexts(order, own)[1].astype(float), np.add.reduceat(n - DISCOUNT, first)
                arrays = {
                    "log10": quantised(np.log10((n - DISCOUNT) / np.repeat(total, size))),
                    "backoff": quantised(np.log10(np.maximum(1.0 - mass / total, 1e-15))),
                }
                child = model.spread(order, first, np.arange(len(own)), size, size, key & ((1 << bits) - 1))
                sums = np.concatenate([[0], np.cumsum(n)])
                levels = {"context": own, "pointer": np.append(first, len(key)), "child": child} | ({"sums": sums} if order < 3 else {})
                for name, x in levels.items():
                    arrays |= _ef_arrays(name, EliasFano.of(x.astype(np.uint64)))
                ends = [{"context": int(own[k]), "kept": float(mass[k]), "total": float(total[k])} for k in sorted({0, len(own) - 1})]
                yield _piece(folder, f"order-{order}", int(key[0]), len(key), int(sums[-1]), arrays, ends)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(count, PART_ROW).repartition(partitions, "part").sortWithinPartitions("part")
    return _pieces_written(rows, write, f"lm-order-{order}")


def train(texts: DataFrame, min_count: int = 1, piece: int = PIECE, order: int = 3) -> Trie:
    """The trie of all rows' ``text``, of order 2 or 3.  What reaches the driver is the list of pieces and two totals."""
    spark = texts.sparkSession
    folder = fresh_path(spark, "lm")
    texts = texts.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in _parts(batches, COUNT_BYTES):
            word, _ = _tokens(batch.column("text"))
            key, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key ^ _SIGN).view(np.int64)), pa.array(n)], ["word", "n"])

    words = written(texts.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    ending = int((np.array([END]) ^ _SIGN).view(np.int64)[0])
    totals = words.agg(F.sum("n"), F.sum(F.when(F.col("word") == ending, F.col("n")))).first()
    tokens, number = totals[0] or 0, totals[1] or 0

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, n in _chunks(batches, piece):
            key = word.astype(np.int64).view(np.uint64) ^ _SIGN
            sums = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            yield _piece(folder, "words", int(key[0]), len(key), int(sums[-1]), {"sums": sums, "hash": key})

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = _pieces_written(words.repartitionByRange(partitions, "word").sortWithinPartitions("word"), write_words, "lm-word-pieces")
    trie = Trie(one, [], [], tokens, number)
    if trie.types >= 1 << 31:
        raise ValueError("ids of more than 2**31 words do not fit a pair's key")
    two = _level(texts, trie, 2, min_count, piece, folder)
    trie = Trie(one, two, [], tokens, number)
    if order < 3:
        return trie
    if int(trie.children.base[-1]) >= 1 << (62 - trie.bits):
        raise ValueError("ids of a pair and a word do not fit a triple's key")
    return Trie(one, two, _level(texts, trie, 3, min_count, piece, folder), tokens, number)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model = shared.value
        for rows, word, n in _gathered(batches, TOKENS):
            first = np.cumsum(n) - n
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            inverse, distinct = pd.factorize(word)
            known, count = model.ids(distinct)
            p = model.unigram(count)
            ids, value, base = known[inverse], p[inverse], add(np.log10(p)[inverse])
            n_known = add((ids >= 0).astype(np.int64))
            del word, inverse
            context = _before(ids, n, model.begin())
            for level in (model.children, model.triples):
                # in order, so that look-ups go through a level from its start to its end
                context += 1
                key, back = _distinct(context.view(np.uint64) << np.uint64(model.bits + 1) | (ids + 1).view(np.uint64))
                c, w = (key >> np.uint64(model.bits + 1)).view(np.int64) - 1, (key & np.uint64((2 << model.bits) - 1)).view(np.int64) - 1
                del key
                rank, share, weight = model.found(level, c, w)
                value *= weight[back]
                value += share[back]
                context = _before(rank[back], n, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x.column("doc_id") for x in rows]), pa.array(n.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(add(np.log10(value)))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)
