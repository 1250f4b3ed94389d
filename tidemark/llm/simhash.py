"""Near-duplicate search by SimHash with covering locality-sensitive hashing.

A fingerprint of 64 bits is the majority vote of the XXH64 values of a text's word shingles. Two
fingerprints link when they differ in at most `radius` bits. Covering hashing gives each bit position
a vector of radius+1 binary digits, not all zero; every non-zero vector v names a table whose key keeps the bits whose
vector has odd parity against v. Any `radius` differing positions leave some v orthogonal to all of
them, so every pair within the radius shares a key in at least one table: no link can be missed.

Scale: joins whose sides grow with the corpus are sort-merge joins at any size. Fingerprints are made distinct first, so exact copies cost one row. A key shared by more than
`bucket` fingerprints is not compared all against all: its members agree on the bits of the key, so
the same construction over the remaining bits, added to the key, splits it again, and again, until few bits are left.
Within a bucket only links that join something new are kept (a forest), and components are found by
star contraction on tables in the shared folder.

Masks of half the bits cover a small radius with few tables; their number doubles with each further bit. For larger radii
`block_masks` cuts the bits into blocks and keeps every choice of some of them, which any differences that leave
so many blocks alone cannot escape.

`similar_documents` finds classes by the Jaccard similarity of texts' shingles. Its nodes are the distinct sets of shingles (repeats
within a text do not vote, so a repeated line decides nothing); rows with one set are exact copies. `block_links` takes fingerprints that agree on three of nine blocks
and differ in at most `radius` bits as candidates, which joins most copies, and large groups of them, by few links; then, as fingerprints do
not bound the similarity, every pair still apart that shares a shingle of its prefixes is a candidate (prefix filtering: sets that are alike enough must share
one). Candidates whose sets differ in too many shingles by their parities, a few bits for each shingle, are dropped; the others are
confirmed on the texts before they count, and only texts with such links are moved for that.

Edge cases: a null or empty text has no words and the fingerprint zero, linked like any other; all such texts are copies of each other. Repeated
rows are separate rows with equal results. Rows whose id is null keep a null id; they join the component
of their text, and rows with one id and different texts are told apart. An empty table gives an empty result. Only the two named columns are used.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY, join_heavy, scratch, small, stage_table
from tidemark.llm.components import connected_components

BITS = 64
BLOCK = 65_536
#: What a set of shingles is told by.
SAME = ["same", "also"]
#: Rows of one shingle and band from which on they are compared in squares of blocks of so many.
SQUARE = 4096
#: What a bucket is told by: the table, and the bits that its mask keeps.
BUCKET = ["path", "key"]


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of one text, repeated ones too; none for a text without words."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, n)
    starts, ends = starts[: n - k + 1], ends[k - 1 :]
    digest, out = xxhash.xxh64_intdigest, np.empty(len(starts), "<u8")
    for at in range(0, len(starts), BLOCK):
        out[at : at + BLOCK] = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)]
    return out


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint of a text's shingle hashes as an unsigned integer."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, size): one row per row of `docs`; fp is the fingerprint as a signed long, size the number of different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [shingle_hashes(x.as_py(), width) for x in b.column(1)]
            fps = np.array([simhash(h) for h in found], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array([len(np.unique(h)) for h in found], pa.int64())], ["id", "fp", "size"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "id long, fp long, size long")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, which is sorted and may be much longer."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def parities(different: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: whether an odd number of them have it. There are two to four bits for each hash, 131,072 at most."""
    n = 1 << min(17, max(6, (2 * len(different) - 1).bit_length()))
    return np.packbits(np.bincount((different % np.uint64(n)).astype(np.int64), minlength=n) & 1 > 0, bitorder="little").tobytes()


def differing(one: bytes, two: bytes) -> int:
    """So many hashes at least are in one of two sets only, by their parities: each changes one bit."""
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, text_hash, fp, size, same, also, prefix, rare, bits): `fp` is the vote of different shingles, `same` and `also` (128 bits) tell their set, `prefix` has the hashes of which texts that are alike enough share one, `bits` their parities.

    Of n shingles a text that is alike has ceil(similarity * n) at least, so in any order that is the same for all texts,
    two such texts share one of the first n - ceil(similarity * n) + 1. `common` hashes come last in that order; `rare` counts the others.
    """
    last = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            values, same, also, sizes, rares, prefixes, bits = (*(np.zeros(b.num_rows, k) for k in (np.uint64, np.uint64, np.uint64, np.int64, np.int32)), [], [])
            for i, x in enumerate(b.column(2)):
                different = np.unique(shingle_hashes(x.as_py(), width))
                whole = xxhash.xxh3_128_intdigest(different.tobytes(), 7)
                values[i], same[i], also[i], sizes[i] = simhash(different), whole >> 64, whole & (2**64 - 1), len(different)
                rare = ~_among(different, last.value)
                rares[i] = rare.sum()
                needed = math.ceil(similarity * len(different) - 1e-9)
                prefixes.append(np.concatenate((different[rare], different[~rare]))[: len(different) - needed + 1].view(np.int64))
                bits.append(parities(different))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            made = [pa.array(values.view(np.int64)), pa.array(sizes), pa.array(same.view(np.int64)), pa.array(also.view(np.int64)), lists, pa.array(rares), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["id", "text_hash", "fp", "size", "same", "also", "prefix", "rare", "bits"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return chosen.mapInArrow(run, "id long, text_hash long, fp long, size long, same long, also long, prefix array<long>, rare int, bits binary")


def _common(docs: DataFrame, text_col: str, width: int, one_in: int = 16, share: int = 5000) -> np.ndarray:
    """Sorted hashes of shingles that more than 1 of `share` texts hold, by a sample; their number is bounded by `share` times a text's mean length.

    They only order shingles: which pairs are found does not depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_py(), width)).view(np.int64))], ["h"])

    chosen = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    least = max(4, chosen.count() // share)
    found = chosen.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """The masks over the given bit positions, one for each non-zero vector of radius+1 digits."""
    size = 2 ** (radius + 1) - 1
    vectors = [(p, i % size + 1) for i, p in enumerate(positions)]
    return [sum(1 << p for p, x in vectors if (x & v).bit_count() % 2) for v in range(1, size + 1)]


def block_masks(positions: list[int], blocks: int, keep: int) -> list[int]:
    """Masks that keep `keep` of `blocks` blocks of the bits: any blocks - keep differing bits leave one untouched."""
    parts = [sum(1 << p for p in positions[i::blocks]) for i in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(parts, keep)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keys(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Rows (fp, node, path) spread over the tables: masks[path] are those of each path; path and key are renewed."""
    own = len(masks[0])
    listed = [(path, path * own + i, _signed(m)) for path, x in enumerate(masks) for i, m in enumerate(x)]
    if len(listed) <= 1024:
        each = F.array(*[F.array(*[F.struct(F.lit(t).alias("table"), F.lit(m).cast("long").alias("mask")) for _, t, m in g]) for _, g in itertools.groupby(listed, lambda x: x[0])])
        spread = rows.select("fp", "node", F.explode(F.element_at(each, F.col("path") + 1)).alias("t")).select("fp", "node", "t.table", "t.mask")
    else:
        tables = rows.sparkSession.createDataFrame(listed, "path int, table int, mask long")
        spread = rows.join(F.broadcast(tables), "path")  # as many rows as there are masks
    return spread.select("fp", "node", F.col("table").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one bucket that join its members into their components, the closest first."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    near: list[list[tuple[int, int]]] = [[] for _ in range(radius + 1)]
    for i in range(1, len(fps)):
        far = np.bitwise_count(fps[:i] ^ fps[i])
        for j in np.flatnonzero(far <= radius).tolist():
            near[far[j]].append((i, j))
    links = []
    for i, j in itertools.chain.from_iterable(near):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            links.append((int(nodes[i]), int(nodes[j])))
    return links


def _links(keyed: DataFrame, counts: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among the members of the buckets in `counts`."""

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(fps: pd.Series, nodes: pd.Series) -> pd.Series:
        found = [_forest(np.asarray(f).view(np.uint64), np.asarray(n), radius) for f, n in zip(fps, nodes, strict=True)]
        return pd.Series([[{"a": a, "b": b} for a, b in x] for x in found])

    member = F.collect_list(F.struct("fp", "node")).alias("m")  # the caller gives buckets of bounded size
    grouped = keyed.join(counts.select(*BUCKET).hint("merge"), BUCKET).groupBy(*BUCKET).agg(member)
    return grouped.select(F.explode(forest(F.col("m.fp"), F.col("m.node"))).alias("x")).select("x.a", "x.b")


def deeper(masks: list[int], masks_of: Callable[[list[int]], list[int]]) -> list[list[int]]:
    """The masks of the next level for each mask of a level: they keep its bits and some of those it leaves out."""
    return [[x | m for m in masks_of([p for p in range(BITS) if not x >> p & 1])] for x in masks]


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket: int = 256, levels: int = 3) -> DataFrame:
    """Links (a, b) between nodes of distinct fingerprints (fp, node), enough to connect all pairs within the radius.

    Three levels of covering masks leave so few bits that a bucket of the last holds 256 fingerprints at most.
    """
    rows, found, kept = fps.select("fp", "node", F.lit(0).alias("path")), [], [0]
    for level in range(levels):
        masks = deeper(kept, lambda positions: covering_masks(positions, radius))
        kept = list(itertools.chain.from_iterable(masks))
        keyed = _keys(rows, masks)
        counts = stage_table(keyed.groupBy(*BUCKET).agg(F.count("*").alias("count")).where("count > 1"), "buckets")
        last = level + 1 == levels
        found.append(_links(keyed, counts if last else counts.where(F.col("count") <= bucket), radius))
        large = counts.where(F.col("count") > bucket)
        if last or large.isEmpty():
            break
        rows = stage_table(keyed.join(large.select(*BUCKET).hint("merge"), BUCKET).select("fp", "node", "path"), "large")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def block_links(fps: DataFrame, radius: int, blocks: int = 9, keep: int = 3, bucket: int = 256) -> DataFrame:
    """Candidate links (a, b) between nodes of fingerprints (fp, node, band) that agree on `keep` blocks, within the radius and the band.

    Buckets lie sorted in parts of like size, so a bucket that very many share goes on in the next parts, and are read in runs of at
    most `bucket` members: each run gives a forest, and its members' links to the bucket's first member in that part. Links across runs
    may be missed.
    """
    masks = [_signed(m) for m in block_masks(list(range(BITS)), blocks, keep)]
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("x")
    keyed = fps.select("fp", "node", "band", table).select(F.xxhash64("x.t", "x.key", "band").alias("bucket"), "fp", "node")
    dealt = keyed.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")

    def links(fp: np.ndarray, node: np.ndarray, first: tuple[np.uint64, int]) -> list[tuple[int, int]]:
        near = (np.bitwise_count(fp ^ first[0]) <= radius) & (node != first[1])
        return [*_forest(fp, node, radius), *((first[1], x) for x in node[near].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, at = None, None, None  # members of the bucket that goes on, its first one, its name

        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for b in batches:
            name, fp, node = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(np.append(True, np.diff(name) != 0), True))
            found: list[tuple[int, int]] = []
            if held is not None and name[0] == at:
                cut = int(cuts[1])
                held = np.append(held[0], fp[:cut]), np.append(held[1], node[:cut])
                cuts = cuts[1:]
            groups = [(s, e) for s, e in itertools.pairwise(cuts.tolist()) if e - s > 1 or e == len(name)]
            if held is not None and (len(cuts) > 1 or name[0] != at):
                found += links(*held, first)
                held = None
            for s, e in groups:
                if e == len(name):
                    held, first, at = (fp[s:e], node[s:e]), (fp[s], int(node[s])), name[s]
                    continue
                for k in range(s, e, bucket):
                    found += links(fp[k : min(k + bucket, e)], node[k : min(k + bucket, e)], (fp[s], int(node[s])))
            while held is not None and len(held[0]) > bucket:
                found += links(held[0][:bucket], held[1][:bucket], first)
                held = held[0][bucket:], held[1][bucket:]
            if found:
                yield made(found)
        if held is not None:
            yield made(links(*held, first))

    return dealt.mapInArrow(run, "a long, b long")


def _shingles(text: bytes | None, width: int) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def confirm(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (a, b), each given once, whose texts (node, text) have shingles of at least the given Jaccard similarity, a kept table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            same = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = _shingles(x, width), _shingles(y, width)
                shared = len(p & q)
                same.append(shared >= similarity * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same))

    with scratch(links.sparkSession):
        texts = stage_table(texts.dropDuplicates(["node"]), "texts")
        pairs = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
        return stage_table(pairs.select("a", "b", "one", "two").mapInArrow(run, "a long, b long"), "confirmed", keep=True)


def likely(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b), each once, but for those whose sets (node, size, bits) differ by their parities in more shingles than the similarity allows, which moves no text; a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            most = (1 - similarity) / (1 + similarity) * (b.column(2).to_numpy() + b.column(3).to_numpy()) + 1e-6
            found = [differing(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.array(found, np.int64) <= most))

    links = stage_table(links.distinct(), "candidates")
    one, two = (sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return stage_table(links.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long"), "likely")


def _bands(size: Column, similarity: float) -> Column:
    """The band of a size, by powers of two, and that of the largest size which is alike enough, where this is another: sizes that are alike enough share a band."""
    of = lambda n: F.floor(F.log2(F.greatest(n.cast("double"), F.lit(1.0)))).cast("int")
    return F.array_distinct(F.array(of(size), of(size / similarity + 1e-9)))


def _pairs(h: np.ndarray, at: np.ndarray, node: np.ndarray, size: np.ndarray, component: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of rows with equal h, of different components, whose sizes and places in the order leave enough shingles to share."""
    order = np.lexsort((size, h))
    h, at, node, size, component = h[order], at[order], node[order], size[order], component[order]
    start = np.flatnonzero(np.diff(h, prepend=h[0] - 1 if len(h) else 0))
    ends = np.append(start[1:], len(h))
    out = [np.zeros((0, 2), np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        most = np.minimum(size[i] - at[i], size[j] - at[j])  # with the shared one first
        good = (component[i] != component[j]) & (most >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6)
        a, b = node[i[good]], node[j[good]]
        out.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))

    if len(h):
        differs = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)
        start, ends = start[differs], ends[differs]
    wide = ends - start > 256
    for a, b in zip(start[wide].tolist(), ends[wide].tolist(), strict=True):
        by = a + np.argsort(component[a:b], kind="stable")  # sizes stay in order within a component
        cuts = np.append(np.flatnonzero(np.diff(component[by], prepend=component[by[0]] - 1)), b - a)
        for x, y in itertools.pairwise(cuts.tolist()):
            rest = by[y:]
            for i in by[x:y].tolist() if len(rest) else ():
                j = rest[(size[rest] >= similarity * size[i] - 1e-6) & (size[i] >= similarity * size[rest] - 1e-6)]
                keep(np.full(len(j), i), j)
    start, ends = start[~wide], ends[~wide]
    i = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]])
    end, step = np.repeat(ends, ends - start), 1
    while len(i):
        there = i + step < end
        i, end = i[there], end[there]
        near = size[i] >= similarity * size[i + step] - 1e-6  # sizes grow: nothing further on is near either
        i, end = i[near], end[near]
        keep(i, i + step)
        step += 1
    return np.unique(np.concatenate(out), axis=0)


def _squares(rows: DataFrame, square: int, keys: int = 1_000_000) -> DataFrame:
    """Rows (node, component, size, at, h, band) in groups (h) of at most about two blocks of `square` rows, in which every two rows of one h and band meet.

    The rows of a shingle and band that have more than a block are dealt into blocks, and every two blocks are a group: a row is in as many groups as there are blocks.
    Such shingles are broadcast, so that rows are shuffled once, by group. From `keys` times `square` rows on, blocks are larger, so that there are at most `keys` of those.
    """
    counts = stage_table(rows.groupBy("h", "band").agg(F.count("*").alias("_n")).where(F.col("_n") > square), "large")
    block = max(square, math.ceil((counts.agg(F.sum("_n")).first()[0] or 0) / keys))
    large = counts.where(F.col("_n") > block).select("h", "band", F.ceil(F.col("_n") / block).cast("int").alias("_k"))
    dealt = rows.join(F.broadcast(large), ["h", "band"], "left")
    others = F.when(F.col("_k").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))
    own = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int").alias("_own")
    dealt = dealt.select("node", "component", "size", "at", "h", "band", "_k", own, F.explode(others).alias("_other"))
    group = F.when(F.col("_k").isNull(), F.xxhash64("h", "band")).otherwise(F.xxhash64("h", "band", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return dealt.select("node", "component", "size", "at", group.alias("h"))


def prefix_links(nodes: DataFrame, similarity: float, rows_each: int = 400_000, square: int = SQUARE) -> DataFrame:
    """Candidate links (a, b) between nodes (node, component, size, prefix, rare): every pair of different components that is alike enough is among them.

    Rows meet by shingle; those with a shingle that many texts hold (from place `rare` on in their prefix) meet by shingle and band of sizes, and where there are very many in
    squares of blocks, so that no task grows with the texts that share a shingle.
    """
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rows = nodes.select("node", "component", "size", "rare", F.posexplode("prefix").alias("at", "h"))
    bands = F.when(F.col("at") < F.col("rare"), F.array(F.lit(-1))).otherwise(_bands(F.col("size"), similarity))
    rows = _squares(rows.select("node", "component", "size", "at", "h", F.explode(bands).alias("band")), square)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(total // rows_each + 1)))

    def run(t: pa.Table) -> pa.Table:
        found = _pairs(*[t.column(c).to_numpy() for c in ("h", "at", "node", "size", "component")], similarity)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bucket: int = 256, levels: int = 3) -> DataFrame:
    """(id, fp, component) for each row of `docs`, a kept table: component is the smallest id that links can reach."""
    with scratch(docs.sparkSession):
        prints = stage_table(fingerprints(docs, id_col, text_col, width), "fingerprints")
        distinct = stage_table(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "distinct")
        root = connected_components(fingerprint_links(distinct.where("node is not null"), radius, bucket, levels))
        classes = distinct.join(root, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "n")
        found = join_heavy(prints, stage_table(classes, "classes"), "fp", F.col("n") > HEAVY)
        return stage_table(found.select("id", "fp", "component"), "near", keep=True)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 14) -> DataFrame:
    """(id, text_hash, fp, component, first) for each row of `docs`, a kept table: classes of documents whose shingles of five words are alike by 0.8 or more; no such pair is missed.

    component is the smallest id of the class, null where no row has one; `first` tells the row that stands for the class, that with
    the smallest id and text hash (its repetitions, alike in both, have it too). text_hash is xxhash64 of the text.
    """
    with scratch(docs.sparkSession):
        sets = stage_table(shingle_sets(docs, id_col, text_col, width, similarity, _common(docs, text_col, width)), "sets")
        row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
        distinct = sets.groupBy(*SAME).agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min(row).alias("row"), F.count("*").alias("n"))
        distinct = stage_table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")  # a number of its own for each set, fixed by being written
        text = F.col(text_col).cast("string")
        own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.cast("binary").alias("text"))

        def confirmed(links: DataFrame) -> DataFrame:
            links = likely(links, distinct, similarity)
            ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
            wanted = distinct.join(ends, "node").select("node", "row.id", "row.text_hash")
            texts = own.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "text")
            return confirm(links, texts, width, similarity)

        banded = distinct.select("fp", "node", F.explode(_bands(F.col("size"), similarity)).alias("band"))
        root = connected_components(confirmed(block_links(banded, radius)))
        prefixes = sets.groupBy(*SAME).agg(F.first("prefix").alias("prefix"), F.first("rare").alias("rare"), F.first("size").alias("size"))
        nodes = prefixes.join(distinct.select(*SAME, "node"), SAME).drop(*SAME).join(root.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        more = confirmed(prefix_links(stage_table(nodes, "nodes"), similarity))
        root = connected_components(root.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        grouped = stage_table(distinct.join(root, "node", "left").withColumn("class", F.coalesce("component", "node")), "classed")
        heads = grouped.groupBy("class").agg(F.min("row").alias("head"), F.count("*").alias("members"))
        heads = join_heavy(grouped.select(*SAME, "class", "n"), stage_table(heads, "heads"), "class", F.col("members") > HEAVY)
        classes = stage_table(heads.select(*SAME, "head", "n"), "classes")
        found = join_heavy(sets.select("id", "text_hash", "fp", *SAME), classes, SAME, F.col("n") > HEAVY)
        first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))
        return stage_table(found.select("id", "text_hash", "fp", F.col("head.id").alias("component"), first.alias("first")), "similar", keep=True)
