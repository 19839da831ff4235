"""Packing token sequences into windows: best-fit decreasing over a segment tree, in bounded blocks of a task.

A document longer than a window is first cut into full windows.  What is left of each document is an item.
Items of a block go from the longest to the shortest, each into the open window with the least room that
still holds it.  Rooms are whole numbers below the window, so the segment tree has one leaf for each room:
a leaf counts the open windows with that room, an inner node the windows below it, and the tightest window
is the first non-empty leaf from the item's length on.

Windows that end nearly full are closed.  The others are emptied from the least full on: their items are cut
to fill the fullest exactly, so that one window at most is left, which goes on into the task's next block.  At
a task's end its tokens go into windows of powers of two, which need no padding.

The work is a map without a shuffle; a task holds the tokens of one block.  Padding does not depend on the
number of partitions, lengths or copies: a window is short of full by less than ``shred`` tokens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.textbytes import lean

#: Tokens of a window, items of a block, and the smallest piece that is cut off to fill a window.
WINDOW, BLOCK, SHRED = 1024, 4096, 4

#: What ends a document.
END_ID = 0

#: Fixed value: the pre-tokenizer that a byte-level tokenizers file with ``use_regex`` stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Token ids of texts by a byte-level BPE file of the tokenizers library.

    The file's merges stand in the order of the ids they make (this is checked), so ids are ranks, and tiktoken, which
    takes a quarter of the CPU time and no memory for offsets, gives the same ids.  Other files go through tokenizers.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.encode = self._by_ranks(told) or self._by_file(path)

    @staticmethod
    def _by_ranks(told: dict) -> Callable[[str], np.ndarray] | None:
        import tiktoken

        model, before, special = told["model"], told["pre_tokenizer"] or {}, told["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told["normalizer"]
        if not plain or not bytewise or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in special):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, the rest from 256 on
        hidden = (b for b in range(256) if b not in set(shown))
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        extra = {x["content"]: x["id"] for x in special}
        vocabulary = {k: i for k, i in model["vocab"].items() if k not in extra}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if [vocabulary.get("".join(x)) for x in merges] != list(range(256, 256 + len(merges))) or any(vocabulary.get(c, 256) > 255 for c in byte):
            return None
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in k): i for k, i in vocabulary.items()}, special_tokens=extra)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")

    @staticmethod
    def _by_file(path: str) -> Callable[[str], np.ndarray]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def of(self, text: str) -> np.ndarray:
        return np.append(self.encode(text), np.uint32(END_ID))


class Rooms:
    """Open windows by the room that they have left: a segment tree over the rooms 0 to ``window``."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that a window has."""
        node = self.size + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up until something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of item numbers: longest items first, each into the tightest window; ties in the order given."""
    rooms, windows = Rooms(window), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = rooms.tightest(lengths[item])
        if room is None:
            at, room = len(windows), window
            windows.append([])
        else:
            at = rooms.take(room)
        windows[at].append(item)
        rooms.add(room - lengths[item], at)
    return windows


class Piece:
    """Tokens ``start`` to ``start + len(ids)`` of a document."""

    __slots__ = ("row", "start", "ids", "total")

    def __init__(self, row: object, start: int, ids: np.ndarray, total: int) -> None:
        self.row, self.start, self.ids, self.total = row, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[:n], self.total), Piece(self.row, self.start + n, self.ids[n:], self.total)


def fill(windows: list[list[Piece]], window: int, shred: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Closed windows, and the items of at most one that is open: the least full are cut up to fill the fullest."""
    closed, short = [], []
    for w in windows:
        (closed if window - sum(map(len, w)) < shred else short).append(w)
    short.sort(key=lambda w: -sum(map(len, w)))
    lo, hi, give = 0, len(short), []
    while lo < hi:
        room = window - sum(map(len, short[lo]))
        while room >= shred:
            if not give:
                if hi - 1 == lo:
                    return closed, short[lo]
                hi -= 1
                give = sorted(short[hi], key=len)  # the longest goes first
            piece = give.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                give.append(rest)
            short[lo].append(piece)
            room -= len(piece)
        closed.append(short[lo])
        lo += 1
    return closed, give


def powers(items: list[Piece]) -> list[list[Piece]]:
    """Windows of falling powers of two that hold the items, cut where a window ends."""
    total, todo, out = sum(map(len, items)), sorted(items, key=len), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            piece = todo.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                todo.append(rest)
            out[-1].append(piece)
            room -= len(piece)
    return out


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class _Writer:
    """Numbers the windows of a task and makes batches of their pieces."""

    def __init__(self, partition: int, kind: pa.DataType, with_ids: bool) -> None:
        self.next, self.with_ids, self.pieces, self.tokens = partition << 40, with_ids, [], 0
        self.schema = pa.schema([("doc_id", kind), *(x for x in _FIELDS if with_ids or x[0] != "ids")])

    def put(self, windows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        for w in windows:
            offset = 0
            for piece in w:
                self.pieces.append((piece, self.next, offset))
                offset += len(piece)
            self.tokens += offset
            self.next += 1
            if self.tokens >= 1 << 18:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        pieces, sequence, offset = zip(*self.pieces, strict=True) if self.pieces else ((), (), ())
        ids = [p.ids.astype("<u4", copy=False) for p in pieces]
        columns = {
            "doc_id": [p.row for p in pieces], "start": [p.start for p in pieces], "length": [len(p) for p in pieces], "ids_crc32": [zlib.crc32(x) for x in ids],
            "doc_tokens": [p.total for p in pieces], "sequence_id": sequence, "offset": offset,
        }
        if self.with_ids:
            flat = np.concatenate([np.zeros(0, "<u4"), *ids]).view(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
        self.pieces, self.tokens = [], 0
        found = (columns[f.name] for f in self.schema)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, self.schema, strict=True)], schema=self.schema)


def _task(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, block: int, shred: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    lean()
    tokens, items, writer = Tokens(vocabulary), [], None
    for batch in batches:
        writer = writer or _Writer(TaskContext.get().partitionId(), batch.schema.field(0).type, with_ids)
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = tokens.of(text.as_py() or "")
            whole = len(ids) - len(ids) % window
            yield from writer.put([[Piece(row, at, ids[at : at + window], len(ids))] for at in range(0, whole, window)])
            if whole < len(ids):
                items.append(Piece(row, whole, ids[whole:].copy(), len(ids)))
            if len(items) >= block:
                closed, items = fill([[items[i] for i in w] for w in best_fit(list(map(len, items)), window)], window, shred)
                yield from writer.put(closed)
    if writer:
        closed, items = fill([[items[i] for i in w] for w in best_fit(list(map(len, items)), window)], window, shred)
        yield from writer.put(closed + powers(items))
        yield writer.batch()


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, block: int = BLOCK, shred: int = SHRED, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Tokens are the text's by the tokenizers file ``vocabulary`` (a path on every executor), without special
    tokens, then END_ID.  Pieces of a sequence lie at gapless offsets from 0.  A sequence has ``window`` tokens,
    or up to ``shred - 1`` fewer, or a power of two of them (at most log2(window) of these for each partition).
    ``ids_crc32`` is of the ids as little-endian 32-bit numbers; ``with_ids=False`` leaves the ids themselves out.
    ``sequence_id`` is unique and depends on the partitions of ``docs``: write the result before reading it twice.

    A null text is empty: its one token is END_ID.  A null doc_id stays null; repeated rows are documents of their
    own; of the input's other columns none is read or returned, so no name can clash; an empty table gives an
    empty one.  A text is one row of one task, tokens of one text and one block are in memory at once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    schema = f"doc_id {kind}, start long, length long, {ids}ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: _task(batches, vocabulary, window, block, shred, with_ids), schema)


def padding(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, padding (to the window, but none at a power of two), documents' pieces."""
    size = F.sum("length")
    sequences = found.groupBy("sequence_id").agg(size.alias("n"), F.count("*").alias("pieces"))
    short: Column = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(window - F.col("n"))
    return sequences.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(short), F.lit(0)).alias("padding"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"))
