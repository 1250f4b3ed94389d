"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are measured in tokens; one longer than the largest permitted length is cut into pieces of that
length and a rest. Pieces are packed longest first: a piece goes into the open bin that it leaves least room in. If none
fits, a bin is opened at the permitted length that costs least for the piece: the cost of a length is what
a sequence of it costs (per-sequence `overhead` in tokens plus its length) divided by the tokens that it is expected to hold, given how
full bins of that length have become so far. When all pieces are placed every bin shrinks to the
shortest permitted length that holds its contents.

Tokens come from a public vocabulary; each text that has some is closed by an end token. `pack_documents` says where every piece goes,
`packed_sequences` builds the sequences themselves.

Scale: texts are encoded once in a map and not moved; their lengths are staged. Pieces are dealt into shards of about `shard` pieces by a hash
of the row's number in that table, so that rows with one id, or none, spread like others; each shard is
packed by one task, so bins are never filled across shards, which costs at most a few open bins a shard.

Edge cases: a text without tokens is a piece of length 0 that takes no room in a bin (alone, in one of the smallest length).
Null texts count as empty. Null ids stay null. Repeated rows are pieces of their own, of equal ones in any order. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, stage_table
from tidemark.llm.tokencounts import encoder, read_ranks

LENGTHS = (512, 1024, 2048, 4096)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def token_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n): the tokens of each text, its end included."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(shared.value, pattern)
        for b in small(batches):
            n = [len(encoding.encode_to_numpy(x, disallowed_special=())) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x + (x > 0) for x in n], pa.int64())], ["id", "text_hash", "n"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, text_hash long, n long")


def pack(sizes: list[int], lengths: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """For pieces in descending order of size: the bin of each and its offset there, and the final length of each bin.

    Open bins are kept by room left, so the best fit is found by bisection.
    """
    largest = lengths[-1]
    room: list[tuple[int, int]] = []  # room left and number of each open bin
    used: list[int] = []
    capacity: list[int] = []
    filled = {c: [1.0, 1.0 * c] for c in lengths}  # bins opened and tokens put into bins of each length, by expectation at first
    bins, offsets = [], []
    for size in sizes:
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            fit = [c for c in lengths if c >= size] or [largest]

            def cost(c: int) -> float:
                share = min(1.0, max(filled[c][1] / (filled[c][0] * c), size / c))
                return (c + overhead) / (c * share)

            left = min(fit, key=lambda c: (cost(c), -c))
            b = len(used)
            used.append(0)
            capacity.append(left)
            filled[left][0] += 1
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        filled[capacity[b]][1] += size
        bisect.insort(room, (left - size, b))
    final = [next(c for c in lengths if c >= n) for n in used]
    return bins, offsets, final


def pack_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = 8, shard: int = 4096
) -> DataFrame:
    """(id, text_hash, piece, start, n_tokens, bin, offset, capacity) for each piece: where it starts in the document and in its bin, in tokens."""
    lengths = tuple(sorted(lengths))
    largest = lengths[-1]
    rows = stage_table(token_lengths(docs, path, pattern, id_col, text_col), "lengths").withColumn("rn", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.col("n") / largest).cast("int") - 1, F.lit(0))
    pieces = rows.select("rn", "id", "text_hash", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "rn", "id", "text_hash", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("n_tokens")
    )
    estimate = rows.agg(F.sum(1 + F.floor(F.col("n") / largest))).first()[0] or 0
    shards = int(estimate // shard + 1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "id", "piece", "rn"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, final = pack(group["n_tokens"].tolist(), lengths, overhead)
        name = group["shard"].astype(str)
        return group[["id", "text_hash", "piece", "start", "n_tokens"]].assign(
            bin=[f"{s}-{b}" for s, b in zip(name, bins, strict=True)], offset=offsets, capacity=[final[b] for b in bins]
        )

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("rn", "piece", F.lit(11)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "id long, text_hash long, piece int, start long, n_tokens long, bin string, offset long, capacity int")


def packed_sequences(
    placed: DataFrame, docs: DataFrame, path: str, pattern: str, end: int, id_col: str = "doc_id", text_col: str = "text", largest: int = LENGTHS[-1]
) -> DataFrame:
    """(bin, capacity, n_tokens, ids): the sequences of `pack_documents`, read once; each document closes with the id `end`. `largest` is the largest permitted length."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(shared.value, pattern)
        for b in small(batches, 64):
            rows, pieces, parts = [], [], []
            for i, x in enumerate(b.column(2).to_pylist()):
                ids = np.append(encoding.encode_to_numpy(x, disallowed_special=()).astype(np.int32), np.int32(end))
                for k in range(0, len(ids) if x else 0, largest):
                    rows.append(i)
                    pieces.append(k // largest)
                    parts.append(ids[k : k + largest])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pieces, pa.int32()), pa.array(parts, kind)], ["_id", "_hash", "_piece", "part"])

    parts = _texts(docs, id_col, text_col).dropDuplicates(["id", "text_hash"]).mapInArrow(run, "_id long, _hash long, _piece int, part array<int>")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("piece") == F.col("_piece"))
    found = placed.join(parts, same, "left").select("bin", "capacity", F.struct("offset", "piece", F.coalesce("part", F.array().cast("array<int>")).alias("part")).alias("x"))
    built = found.groupBy("bin").agg(F.first("capacity").alias("capacity"), F.array_sort(F.collect_list("x")).alias("x"))  # a bin is bounded by its capacity and its shard
    ids = F.flatten(F.transform("x", lambda x: x["part"]))
    return built.select("bin", "capacity", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"))
