"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``window`` consecutive words of a benchmark item (an item of fewer words is one
window) is a pattern of one automaton over normalised text.  Each document is normalised and
scanned once; matches are mapped to words, and for hit documents to character spans of the
original text.  A benchmark too large for one automaton is cut by a hash of its items into blocks of
an automaton each; what each hits is united by document.

Edge cases: null texts have no words; an item without words has no window; equal windows of
several items count for each of them; a null item_id marks words but is not listed; documents without
hits return zero counts, an empty list of items and no span; repeated rows are separate rows; a column
``contamination`` of the input is replaced, all others pass through; an empty benchmark hits nothing;
very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.textbytes import lean

#: Fixed value: a word is a run of these characters, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A-Z are letters here too: the original text is matched before lower-casing.
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = "array<struct<start:int,end:int>>"
#: ``runs`` are the hit words (first, last + 1), ``spans`` the characters of the original text.
FOUND = f"struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,spans:{SPANS},runs:{SPANS}>"
#: Bytes of benchmark text in one automaton.  It takes some 60 times as much of a Python worker's memory.
BLOCK_BYTES = 4 << 20


def normalised(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode().translate(_CLEAN).split()


def windows_of(items: list[tuple[int, str | None]], window: int) -> dict[str, list[int]]:
    """Pattern -> item_ids.  UTF-8 bytes stand as Latin-1 characters, so that positions are byte offsets."""
    out: dict[str, set[int]] = {}
    for item, text in items:
        words = normalised(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(f" {b' '.join(words[i : i + window]).decode('latin-1')} ", set()).add(item)
    return {k: sorted(x for x in v if x is not None) for k, v in out.items()}


def automaton_of(patterns: dict[str, list[int]]) -> ahocorasick.Automaton | None:
    built = ahocorasick.Automaton()
    for k, v in patterns.items():
        built.add_word(k, (len(k), v))
    if not patterns:
        return None
    built.make_automaton()
    return built


Runs = list[tuple[int, int]]


def scan(text: str | None, automaton: ahocorasick.Automaton | None, before: Runs | None = None) -> tuple[int, int, list[int], Runs, Runs]:
    """(words, hit words, items with a window in the text, hit spans of the original text, runs of hit words).

    ``before`` are runs of words that are hit already.
    """
    words = normalised(text)
    found = []
    if words and automaton is not None:
        line = f" {b' '.join(words).decode('latin-1')} "
        found = [(end, size, items) for end, (size, items) in automaton.iter(line)]
    if not found and not before:
        return len(words), 0, [], [], []
    starts = np.cumsum([0] + [len(w) + 1 for w in words])  # where the space before each word stands
    edge = np.zeros(len(words) + 1, np.int32)
    for end, size, _ in found:
        edge[np.searchsorted(starts, end - size + 1)] += 1
        edge[np.searchsorted(starts, end)] -= 1
    for a, b in before or []:
        edge[a] += 1
        edge[b] -= 1
    hit = np.cumsum(edge)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
    runs = list(zip(turns[::2], turns[1::2], strict=True))
    places = [m.span() for m in _ORIGINAL.finditer(text)]
    return len(words), int(hit.sum()), sorted({x for _, _, items in found for x in items}), [(places[a][0], places[b - 1][1]) for a, b in runs], runs


#: The automaton that this worker has built last, by the name of its block: tasks of a worker share it.
_built: dict[str, ahocorasick.Automaton | None] = {}


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", _SPAN), ("runs", _SPAN)])


def _ends(runs: Runs) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in runs]


def _built_once(block: str, items: list[tuple[int, str | None]], window: int) -> ahocorasick.Automaton | None:
    if block not in _built:
        _built.clear()
        _built[block] = automaton_of(windows_of(items, window))
    return _built[block]


def _pass(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``docs`` with the ``contamination`` by the windows of all items."""
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])
    block, own = uuid.uuid4().hex, docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        automaton = _built_once(block, shared.value, window)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                n, hit, found, spans, runs = scan(t.as_py(), automaton)
                rows.append({"n_words": n, "n_hit": hit, "item_ids": sorted(set(map(str, found))), "spans": _ends(spans), "runs": _ends(runs)})
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(rows, _KIND)], [*(f.name for f in own), "contamination"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.mapInArrow(run, f"{shape}, contamination {FOUND}")


_HITS = f"a long, b long, block int, runs {SPANS}, item_ids array<string>"


def _hits(texts: DataFrame, items: DataFrame, window: int, number: int) -> DataFrame:
    """Of ``texts`` (a, b: a hash of the text; text) those with a window of one block of items: hit words and items."""
    shared = texts.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])
    block = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        automaton = _built_once(block, shared.value, window)
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column("text")):
                _, hit, items, _, runs = scan(t.as_py(), automaton)
                if hit:
                    at.append(k)
                    found.append((_ends(runs), sorted(set(map(str, items)))))
            some = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(some), batch.column("b").take(some), pa.array([number] * len(at), pa.int32()), pa.array([x for x, _ in found], _SPAN), pa.array([x for _, x in found], pa.list_(pa.string()))],
                ["a", "b", "block", "runs", "item_ids"],
            )

    return texts.mapInArrow(run, _HITS)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row`` and the contamination by the runs and items of all blocks."""
    lean()
    for batch in batches:
        out = []
        for t, runs, items in zip(pc.struct_field(batch.column("row"), "text"), batch.column("runs").to_pylist(), batch.column("item_ids").to_pylist(), strict=True):
            n, hit, _, spans, whole = scan(t.as_py(), None, [(r["start"], r["end"]) for r in runs or []])
            out.append({"n_words": n, "n_hit": hit, "item_ids": sorted(set(items or [])), "spans": _ends(spans), "runs": _ends(whole)})
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _KIND)], ["row", "contamination"])


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``contamination``: n_words, n_hit, item_ids (as strings, sorted), spans (characters of the original), runs.

    Up to ``block_bytes`` of items are one automaton, and documents pass once.  More items are cut into blocks by their hash;
    each block reads the texts and gives only the hit words and items of those that it hits, by a hash of 128 bits of the
    text, and these few rows meet the documents at the end.  Texts are neither written nor shuffled for a block.
    """
    items = benchmark.select("item_id", "text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    docs = docs.drop("contamination")
    if blocks == 1:
        return _pass(docs, items, window)
    a, b = F.xxhash64("text"), F.xxhash64(F.lit("b"), "text")
    texts, hits = docs.select(a.alias("a"), b.alias("b"), "text"), None
    for k in range(blocks):
        one = _hits(texts, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), window, k)
        hits = one if hits is None else hits.unionByName(one)
    # copies of a text have the same hits: one of each block stays
    hits = hits.groupBy("a", "b", "block").agg(F.first("runs").alias("runs"), F.first("item_ids").alias("item_ids"))
    hits = hits.groupBy("a", "b").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), a.alias("_a"), b.alias("_b"))
    rows = rows.join(hits, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select("row", "runs", "item_ids")
    found = rows.mapInArrow(_united, f"row {rows.schema['row'].dataType.simpleString()}, contamination {FOUND}")
    return found.select("row.*", "contamination")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id and the fields of ``contamination``."""
    found = with_contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    return found.select("doc_id", *[f"contamination.{k}" for k in ("n_words", "n_hit", "item_ids", "spans")])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without its hit spans."""
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return "".join([*out, text[last:]])


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
