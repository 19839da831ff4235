"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits from the XXH64 hashes of word shingles; fingerprints within ``distance``
(4 at most) bits are linked.  64 bits are cut into four segments of 16, and each pair of segments has a
table with keys of 32 bits.  Of two linked fingerprints either some pair of segments differs in one
bit at most, or each segment differs in exactly one: if no pair does with one bit, no segment is equal
(the three others would differ in two bits or more each), so all four have a bit and none has two.

* Tables of all pairs but the first: a *distinct* fingerprint is put in under its exact key, and asks for
  the Hamming ball of one bit round it (33 keys).
* Table of the first pair: it is put in under the ball of one bit round its first segment (17 keys), and
  asks for the ball of one bit round its second one (17): together each of the two may differ in a bit.

So a fingerprint has 198 rows, a bucket is met by chance once in 2 ** 32, and what asks is compared
with what is there by complete distances.

A bucket does not give all its pairs: with thousands of near copies these are millions.  It gives
a spanning forest of its own links (at most one pair per fingerprint), which has the same
components; ``all_links`` gives every pair where these are wanted.

Edge cases: a text without words (or null) has fingerprint zero and is linked like any other;
fewer words than a shingle give one shingle; equal fingerprints always share a component;
repeated doc_ids are separate rows with the same component; a row with a null doc_id takes part, and
its component_id is null only where no row of the component has a doc_id; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.components import connected_components
from kinetrack.llm.storage import written
from kinetrack.llm.textbytes import lean, lower_ascii

SEED = 42
#: Bits of a segment, and the pairs of segments that have a table; the first is the one with two balls.
SEGMENT = 16
TABLES = tuple(combinations(range(4), 2))
#: What a row is in its bucket: put in, asking, or both.
IN, ASKS = 1, 2
#: Stands for the smallest doc_id of a fingerprint that has none.
_NO_ID = (1 << 63) - 1
#: Pairs compared at once in a task.
_BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a whole text, as an unsigned number."""
    words = lower_ascii((text or "").encode()).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    # counted a bounded number of shingles at a time
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _balls() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the flips of a key's bits, the flip 0 first, and what the row with that flip is."""
    first, second = [1 << b for b in range(SEGMENT)], [1 << b for b in range(SEGMENT, 2 * SEGMENT)]
    out = []
    for k in range(len(TABLES)):
        what = [IN | ASKS, *([IN if k == 0 else ASKS] * SEGMENT), *([ASKS] * SEGMENT)]
        out.append((np.array([0, *first, *second], np.int64), np.array(what, np.int8)))
    return out


def _probes(distinct: DataFrame) -> DataFrame:
    """bucket, fp, what: a row for each key under which a fingerprint is put in or asks."""
    balls = _balls()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").to_numpy(zero_copy_only=False)[part : part + 4096].astype(np.int64)
                segment = lambda i: (fp.view(np.uint64) >> np.uint64(SEGMENT * i)).astype(np.int64) & 0xFFFF  # noqa: B023, E731
                for k, ((i, j), (flips, what)) in enumerate(zip(TABLES, balls, strict=True)):
                    value = (segment(i) | segment(j) << SEGMENT)[:, None] ^ flips[None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((value | (k << 32)).ravel()), pa.array(np.repeat(fp, len(flips))), pa.array(np.tile(what, len(fp)))], ["bucket", "fp", "what"]
                    )

    return distinct.mapInArrow(run, "bucket long, fp long, what tinyint")


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of a bucket: breadth first, a row of distances at a time."""
    edges, left = [], np.ones(len(fp), bool)
    for first in range(len(fp)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= distance]
            left[near] = False
            queue.extend(near.tolist())
            edges.extend((i, j) for j in near.tolist())
    return edges


def _links_of(bucket: np.ndarray, fp: np.ndarray, what: np.ndarray, distance: int, forest_from: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links in a run of whole buckets, sorted by bucket.  Small buckets give their pairs, others a forest."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
    here, asks = (what & IN) > 0, (what & ASKS) > 0
    keep = np.logical_or.reduceat(here, lo) & np.logical_or.reduceat(asks, lo) & (hi - lo > 1)
    lo, hi = lo[keep], hi[keep]
    size = hi - lo
    left, right = [], []
    large = size >= forest_from if forest_from else np.zeros(len(size), bool)
    for a, b in zip(lo[large].tolist(), hi[large].tolist(), strict=True):
        if pairs := _forest(fp[a:b], distance):
            i, j = np.array(pairs).T
            left.append(fp[a:b][i])
            right.append(fp[a:b][j])
    lo, hi, size = lo[~large], hi[~large], size[~large]
    # every row against the later ones of its bucket, a bounded block of pairs at a time
    row = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    more = np.repeat(hi, size) - row - 1
    done = np.concatenate([[0], np.cumsum(more)])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(done, done[at] + _BLOCK, side="right")) - 1)
        n = more[at:to]
        i = np.repeat(row[at:to], n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (here[i] & asks[j] | asks[i] & here[j])
        left.append(fp[i[ok]])
        right.append(fp[j[ok]])
        at = to
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, distance: int = 4, forest_from: int | None = 64) -> DataFrame:
    """Pairs (u, v) of linked fingerprints; with ``forest_from`` None every pair, else buckets of that
    many rows give a spanning forest of their links."""
    if distance > 4:
        raise ValueError("the tables find all links of 4 bits or fewer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def give(bucket: np.ndarray, fp: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
            u, v = _links_of(bucket, fp.view(np.uint64), what, distance, forest_from)
            a, b = u.view(np.int64), v.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        held: list[list[np.ndarray]] = []  # the last bucket of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "what")]
            if new[0][0] == new[0][-1] and (not held or held[-1][0][-1] == new[0][0]):
                held.append(new)
                continue
            kept = [np.concatenate(x) for x in zip(*held, new, strict=True)] if held else new
            cut = int(np.searchsorted(kept[0], kept[0][-1]))
            yield give(*(x[:cut] for x in kept))
            held = [[x[cut:] for x in kept]]
        if held:
            yield give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return _probes(distinct).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def all_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Every pair of distinct fingerprints within the distance, once."""
    return links(distinct, distance, None).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    # a node is a fingerprint behind its smallest doc_id (or the largest number), so that the smallest node of a
    # component names its smallest doc_id, and no group-by on components is needed
    node = F.struct(F.coalesce("first", F.lit(_NO_ID)).alias("first"), "fp")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", node.alias("node")), "fingerprint-nodes")
    ends = links(nodes.select("fp"), distance)
    for k in "uv":
        ends = ends.join(nodes.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}")), k)
    groups = connected_components(ends.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))
    groups = groups.select(F.col("node.fp").alias("fp"), F.col("component.first").alias("lowest"))
    labelled = nodes.join(groups, "fp", "left").select("fp", F.nullif(F.coalesce("lowest", "node.first"), F.lit(_NO_ID)).alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
