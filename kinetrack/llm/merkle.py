"""Merkle manifest of a table: a tree for each group of rows, one over their roots, and a proof for every row.

Leaves of a group have numbers in key order, from counts of range partitions.  Aligned blocks of ARITY^HEIGHT
leaves are traversed each by a task, recursively and in postorder: a call returns the digest of its subtree and,
while unwinding, appends what stands left and right of each child to the leaves in it.  The roots of blocks are
the nodes of the next such traversal, until one node is left of every tree; subroots go the same way.  A second
pass goes down: blocks get their own path from above, so that a leaf's whole proof is made where the leaf is,
and no proof of a single leaf is ever shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrack.llm.storage import written
from kinetrack.llm.textbytes import lean

#: Children of a node, and levels of a block that one task traverses.
ARITY, HEIGHT = 8, 4


def digest_of(*columns: Column) -> Column:
    """SHA-256 of fields that cannot run into each other: ``-`` for a null, else the UTF-8 length, a colon and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def traverse(digests: list[str], levels: int, paths: list[list[tuple[str, str]]] | None = None) -> str:
    """Root of the nodes, ``levels`` above them.  ``paths`` gets, for each node and level, what stands left and right of its ancestor."""

    def visit(lo: int, hi: int, level: int) -> str:
        if not level:
            return digests[lo]
        step = ARITY ** (level - 1)
        children = [(at, min(at + step, hi)) for at in range(lo, hi, step)]
        found = [visit(*child, level - 1) for child in children]
        if paths is not None:
            for i, child in enumerate(children):
                pair = "".join(found[:i]), "".join(found[i + 1 :])
                for leaf in range(*child):
                    paths[leaf].append(pair)
        return _hash("".join(found))

    return visit(0, len(digests), levels)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with position, their number from 0 by ``order`` (nulls first).

    Rows are sorted over range partitions and written; the number of rows of each partition, one line for each,
    gives where the next begins.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")  # partition, then place in it
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    begins = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))  # a row for each partition
    return marked.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("position", F.col("begin") + place).drop("part", "begin", "at")


_NODE = "tree long, position long, size long, digest string"
_PATH = "path array<struct<left:string,right:string>>, subroot string, root string"


def _block(height: int) -> Column:
    return F.floor(F.col("position") / ARITY**height).alias("block")


def _block_root(nodes: pa.Table, height: int) -> pa.Table:
    lean()
    nodes = nodes.sort_by("position")
    tree, at, size = (nodes.column(c)[0].as_py() for c in ("tree", "position", "size"))
    root = traverse(nodes.column("digest").to_pylist(), min(height, depth(size)))
    block = ARITY**height
    return pa.table({"tree": [tree], "position": [at // block], "size": [-(-size // block)], "digest": [root]})


def _climb(nodes: DataFrame, size: int, height: int) -> list[DataFrame]:
    """``nodes`` and the roots of their blocks, again and again until each tree has one; ``size`` is that of the largest tree."""
    rounds = [nodes]
    while size > 1:
        up = rounds[-1].select("tree", "position", "size", "digest").groupBy("tree", _block(height)).applyInArrow(lambda t: _block_root(t, height), _NODE)
        rounds.append(written(up, "merkle-blocks"))
        size = -(-size // ARITY**height)
    return rounds


def _paths(nodes: pa.Table, above: pa.Table, height: int) -> tuple[pa.Table, list[list[tuple[str, str]]], str, str]:
    lean()
    nodes = nodes.sort_by("position")
    found: list[list[tuple[str, str]]] = [[] for _ in range(nodes.num_rows)]
    traverse(nodes.column("digest").to_pylist(), min(height, depth(nodes.column("size")[0].as_py())), found)
    rest = [(x["left"], x["right"]) for x in above.column("path")[0].as_py()]
    return nodes, [x + rest for x in found], above.column("subroot")[0].as_py(), above.column("root")[0].as_py()


_PAIRS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _pairs(paths: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in x] for x in paths], _PAIRS)


def _nodes_down(nodes: pa.Table, above: pa.Table, height: int) -> pa.Table:
    nodes, paths, subroot, root = _paths(nodes, above, height)
    n = nodes.num_rows
    return pa.table({"tree": nodes.column("tree"), "position": nodes.column("position"), "path": _pairs(paths), "subroot": pa.array([subroot] * n, pa.string()), "root": [root] * n})


def _leaves_down(nodes: pa.Table, above: pa.Table, height: int, with_paths: bool) -> pa.Table:
    nodes, paths, subroot, root = _paths(nodes, above, height)
    folded = []
    for leaf, path in zip(nodes.column("altered").to_pylist(), paths, strict=True):
        for left, right in path:
            leaf = _hash(left + leaf + right)
        folded.append(leaf)
    n = nodes.num_rows
    out = {
        "doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), "subroot": [subroot] * n, "root": [root] * n,
        "proof_sha256": [_hash("".join(x for pair in path for x in pair)) for path in paths], "folded_root": folded,
    }
    return pa.table(out | ({"path": _pairs(paths)} if with_paths else {}))


def _descend(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    below = nodes.select("tree", "position", "size", "digest").groupBy("tree", _block(height))
    return below.cogroup(above.groupBy("tree", F.col("position").alias("block"))).applyInArrow(lambda a, b: _nodes_down(a, b, height), f"tree long, position long, {_PATH}")


def manifest(leaves: DataFrame, with_paths: bool = False, height: int = HEIGHT) -> DataFrame:
    """Roots and proofs of ``leaves`` (doc_id, lang, leaf, altered): one row for each.

    Returns doc_id, leaf, subroot (of the lang's tree), root, proof_sha256 (of all siblings from the leaf to the root, level
    by level, left to right), folded_root (computed from ``altered`` and the siblings) and verified (folded_root is
    root); ``with_paths`` adds path, a (left, right) pair of what stands beside the node for each level.  A task traverses blocks of ``height`` levels.

    In a tree ARITY consecutive nodes have the digest of their digests as parent, the last ones also if they are fewer.
    Leaves go by doc_id, nulls first, equal ones by digest; repeated rows are leaves of their own.  Trees go by lang,
    null first, in order of UTF-8 bytes.  A tree of one leaf is that leaf; an empty table gives an empty one.
    """
    schema = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string".format(leaves.schema["doc_id"].dataType.simpleString()) + (
        ", path array<struct<left:string,right:string>>" if with_paths else ""
    )
    # a number of the row tells equal leaves apart, which may be any share of all
    rows = written(leaves.select("doc_id", "lang", "leaf", "altered"), "merkle-leaves").withColumn("row", F.monotonically_increasing_id())
    placed = positions(rows, ["lang", "doc_id", "leaf", "row"]).drop("row")
    groups = positions(placed.groupBy("lang").agg(F.min("position").alias("first"), F.count("*").alias("size")), ["lang"])
    groups = written(groups.withColumnRenamed("position", "tree"), "merkle-groups")
    trees, largest = groups.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()

    inner = placed.join(groups.withColumnRenamed("lang", "group"), F.col("lang").eqNullSafe(F.col("group")))
    inner = inner.select("tree", (F.col("position") - F.col("first")).alias("position"), "size", F.col("leaf").alias("digest"), "doc_id", "altered")
    rounds = _climb(inner, largest, height)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(trees).cast("long").alias("size"), "digest")
    tops = _climb(subroots, trees, height)

    none = F.array().cast("array<struct<left:string,right:string>>")
    above = tops[-1].select("tree", "position", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(tops[:-1]):
        above = _descend(nodes, above, height)
    own = rounds[-1].select(F.col("tree").alias("own"), "digest")
    above = above.join(own, F.col("position") == F.col("own")).select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("position"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[1:-1]):
        above = _descend(nodes, above, height)
    at = _block(height) if len(rounds) > 1 else F.col("position").alias("block")  # trees of one leaf each: the leaf is the top
    found = inner.groupBy("tree", at).cogroup(above.groupBy("tree", F.col("position").alias("block"))).applyInArrow(lambda a, b: _leaves_down(a, b, height, with_paths), schema)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, altered of documents; altered is the leaf of a tampered copy, the leaf itself where nothing is tampered with.

    Tampering lower-cases A-Z of the text where 3 divides crc32 of the decimal doc_id; null doc_ids and null texts stay.
    Other columns than doc_id, source, lang, n_chars and text are left out, so no name can clash.
    """
    leaf = lambda text: digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    other = F.when(tampered, leaf(F.translate("text", _CAPITALS, _CAPITALS.lower())))
    rows = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), other.alias("other"))
    return rows.select("doc_id", "lang", "leaf", F.coalesce("other", "leaf").alias("altered"))
