"""A Merkle manifest of a dataset as a persistent tree: versions copy the ancestors of what changed and share every other node.

Rows are leaves, in the order of an id within a group; WIDTH consecutive nodes become their parent, level by level, until one is left:
the group's subroot. Subroots are the leaves of a tree of the same kind above the groups, whose last node is the root.

How it is spread: leaves are sorted by range and numbered by the counts of the ranges before theirs. BLOCK = WIDTH ** DEPTH consecutive
nodes are a block, which is aligned with the tree: its fold is one node DEPTH levels up. Roots of blocks are the nodes of the next tier, and so on, each tier
BLOCK times smaller. Then the way up from each block (the siblings of its ancestors, a bounded row) is handed down, tier by tier. In the
end each block of leaves has all that its leaves need: `versions` copies, for a changed leaf, the ancestors inside the block and goes on with copies of the ancestors
above, against the shared siblings. No group, however large, is gathered; a task holds one block and one path.

Edge cases: a missing value is hashed as `-`; a missing id comes first in its group and a missing group first of all; rows of one id
are ordered by their digests (equal rows are interchangeable: their leaves are equal, their proofs are those of their places). A group of one leaf has
that leaf as its subroot; a dataset of one group has the subroot as its root, and a single leaf's proof is the hash of nothing. An empty table gives no rows.
Only the named columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, small, stage_table

WIDTH = 8
#: Levels of the tree in a block.
DEPTH = 3
BLOCK = WIDTH**DEPTH

#: What stands left and right of a node among its siblings, as joined digests, level by level upwards.
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: each `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown]).cast("binary"), 256)


def levels_of(n: int) -> int:
    """Levels between n nodes and the one that they become."""
    found = 0
    while n > 1:
        n, found = -(-n // WIDTH), found + 1
    return found


def block_levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a block, its nodes first and its fold last; `total` nodes make the whole tier."""
    levels = [nodes]
    for _ in range(min(DEPTH, levels_of(total))):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])
    return levels


def path_in_block(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of each ancestor of node `at`, itself included, below the block's fold."""
    path = []
    for level in levels[:-1]:
        first = at - at % WIDTH
        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + WIDTH])))
        at //= WIDTH
    return path


def copied(path: list[tuple[str, str]], node: str) -> list[str]:
    """A version's own nodes: the changed node and the copies of its ancestors. All that it shares stands in `path`."""
    own = [node]
    for left, right in path:
        own.append(digest(left + own[-1] + right))
    return own


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `at`, the place in its group from 0, and `total`, the rows of the group.

    Sorted by ranges that are cut within a group, an id or equal rows alike; places are those in the range plus the rows of earlier ranges.
    """
    salt = F.monotonically_increasing_id()
    spread = rows.withColumn("_salt", salt).repartitionByRange(group, *order, "_salt").sortWithinPartitions(group, *order, "_salt").drop("_salt")
    kept = stage_table(spread.withColumn("_seq", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_seq", 33)
    ranges = kept.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    own = Window.partitionBy(group)  # a row for each range that the group reaches into
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = stage_table(ranges.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(own).alias("total")), "ranges")
    placed = kept.withColumn("_part", part).join(ranges, [group, "_part"])
    return placed.withColumn("at", F.col("_seq") - F.col("_first") + F.col("_before")).drop("_seq", "_part", "_first", "_before")


def _blocks(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """(g, block, total, nodes): the nodes of each block in order, staged."""
    block = F.floor(F.col("at") / BLOCK).cast("long")
    items = F.sort_array(F.collect_list(F.struct("at", "digest", *more)))
    return stage_table(nodes.groupBy("g", block.alias("block"), "total").agg(items.alias("nodes")), name)


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 64):
        rows = b.to_pylist()
        tops = [block_levels([x["digest"] for x in r["nodes"]], r["total"])[-1][0] for r in rows]
        totals = [-(-r["total"] // BLOCK) for r in rows]
        yield pa.RecordBatch.from_arrays([b["g"], b["block"], pa.array(totals, pa.int64()), pa.array(tops, pa.string())], ["g", "at", "total", "digest"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up of each node of a block: its siblings in the block, then those above the block."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for b in small(batches, 8):
        out: dict[str, list] = {"g": [], "block": [], "path": [], "subroot": [], "root": []}
        for r in b.to_pylist():
            levels = block_levels([x["digest"] for x in r["nodes"]], r["total"])
            for i, x in enumerate(r["nodes"]):
                path = [{"left": lo, "right": hi} for lo, hi in path_in_block(levels, i)] + (r["path"] or [])
                for c, v in zip(out, (r["g"], x["at"], path, r["subroot"], r["root"]), strict=True):
                    out[c].append(v)
        kinds = [pa.string(), pa.int64(), kind, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _tiers(blocks: DataFrame) -> list[DataFrame]:
    """Blocks of each tier; the last has one block for each group."""
    tiers = [blocks]
    widest = blocks.agg(F.max("total")).first()[0] or 0
    while widest > BLOCK:
        widest = -(-widest // BLOCK)
        tiers.append(_blocks(_folded(tiers[-1]), "tier"))
    return tiers


def _folded(blocks: DataFrame) -> DataFrame:
    return blocks.select("g", "block", "total", "nodes").mapInArrow(_folds, "g string, at long, total long, digest string")


def _paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, block, path, subroot, root) for each block of the lowest tier; `tops` has them for the groups' only blocks."""
    paths = tops
    for blocks in reversed(tiers[1:]):
        held = blocks.join(paths, ["g", "block"])
        paths = held.mapInArrow(_handed_down, f"g string, block long, path {PATH}, subroot string, root string")
    return paths


def manifest(leaves: DataFrame) -> DataFrame:
    """The tree over `leaves` (g, id, digest, changed): g orders the groups, `changed` is the digest that a tampered leaf has, else null.

    Returns (g, block, total, nodes, path, subroot, root): the leaves of each block with the way from the block's fold to the root.
    """
    nodes = numbered(leaves, "g", ["id", "digest", "changed"])
    blocks = _blocks(nodes, "blocks", "id", "changed")
    tiers = _tiers(blocks)
    subroots = stage_table(_folded(tiers[-1]).select("g", F.col("digest").alias("subroot")), "subroots")
    above = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("subroot").alias("digest")), "g", ["id"])
    upper = _blocks(above, "groups", "id")
    upper_tiers = _tiers(upper)
    root = _folded(upper_tiers[-1]).select("g", F.lit(0).cast("long").alias("block"), F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ways = _paths(upper_tiers, root)
    ways = upper.join(ways, ["g", "block"]).mapInArrow(_handed_down, f"g string, block long, path {PATH}, subroot string, root string")
    named = above.select("id", "at").join(ways, F.col("at") == F.col("block"))
    tops = named.select(F.col("id").alias("g"), "path", "root").join(subroots, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    return blocks.join(_paths(tiers, stage_table(tops, "tops")), ["g", "block"])


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 8):
        out: dict[str, list] = {"id": [], "leaf": [], "subroot": [], "root": [], "proof_sha256": [], "folded_root": [], "copied": []}
        for r in b.to_pylist():
            levels = block_levels([x["digest"] for x in r["nodes"]], r["total"])
            above = [(p["left"], p["right"]) for p in r["path"] or []]
            upper = "".join(lo + hi for lo, hi in above)
            whole = {levels[-1][0]: copied(above, levels[-1][0])[-1]}  # what an unchanged block folds to, shared by its leaves
            for i, x in enumerate(r["nodes"]):
                path = path_in_block(levels, i)
                own = copied(path, x["changed"] or x["digest"])
                folded = whole.get(own[-1])
                if folded is None:
                    own += copied(above, own[-1])[1:]
                    folded = own[-1]
                proof = digest("".join(lo + hi for lo, hi in path) + upper)
                news = own if x["changed"] and x["changed"] != x["digest"] else []
                for c, v in zip(out, (x["id"], x["digest"], r["subroot"], r["root"], proof, folded, news), strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def versions(tree: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, copied) for each leaf of `manifest`.

    `folded_root` is the root of the version in which this leaf alone has its changed digest, `copied` the nodes that this version has of
    its own, from the leaf up to its root (none where nothing changed).
    """
    kinds = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    return tree.select("nodes", "total", "path", "subroot", "root").mapInArrow(_versions, kinds)


def proven(leaves: DataFrame) -> DataFrame:
    """`versions` of the `manifest` over `leaves`, written; what was staged on the way is removed."""
    with scratch(leaves.sparkSession):
        return stage_table(versions(manifest(leaves)), "versions", keep=True)


def document_leaves(docs: DataFrame, tampered: Column, changed_text: Column) -> DataFrame:
    """The leaves of documents by language: doc_id, source, lang, n_chars and text are hashed; tampered rows have `changed_text` for their text."""
    head = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    group = F.coalesce(F.concat(F.lit("1"), docs["lang"].cast("string")), F.lit("0"))
    changed = F.when(tampered, leaf_digest(*head, changed_text))
    return docs.select(group.alias("g"), docs["doc_id"].cast("long").alias("id"), leaf_digest(*head, docs["text"]).alias("digest"), changed.alias("changed"))
