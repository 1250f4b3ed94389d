"""Removal of passages that recur across or within documents.

A window is `width` consecutive words of one document; it recurs when its word sequence also starts
anywhere else, in the same document included. Every word that a recurring window covers is removed.
All windows are judged on the input.

1. `sketch`: of the hashes of all `phrase`-word phrases in a window the least one is its anchor. Equal
   windows have equal anchors, so a window can only recur if its anchor occurs twice. Only anchors, about
   one in thirteen words, are counted over the corpus.
2. `candidates`: texts with windows whose anchor recurs. Of documents whose whole word sequence recurs one stands for all, counted twice.
3. `lone_windows`: those windows are counted by a 96-bit hash. A window that is counted once is no recurring one; its place
   comes out of the same grouping. The rest confirms the recurring passages.
4. `passages`: confirmed passages are cut into patterns of `width` words, at places that depend on the words around only, so that
   copies give the same patterns. Each distinct pattern is kept once, in the shard of its anchor.
5. `locate`: each shard's patterns are compiled into an Aho-Corasick automaton whose symbols are words, and the texts are streamed
   through it: every stretch of windows that has recurring anchors of a shard, whether its windows were confirmed or not, goes to that shard, since no
   pattern elsewhere could match there. What the hits cover, and only that, is removed.

A shard with more patterns than `PATTERNS` is split, and its texts go to each part; a shard through which very many texts go is
repeated, and each text goes to one copy. So neither a passage that a third of all documents share nor one with very many variants
crowds a task, and no automaton grows beyond its bound. A shard's rows are sorted, patterns first, and streamed.

Edge cases: null and empty texts have no words. Repeated rows are documents of their own, so all their
windows recur. Rows whose id is null are handled like others. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY, join_heavy, scratch, small, stage_table

#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Bytes from which on words have a stronger hash: sums modulo 2**64 cannot tell some words of 1024 bytes, such as a Thue-Morse sequence and its complement.
LONG_WORD = 256
#: Patterns in one automaton, and stretches of text that go through one copy of it, at most about.
PATTERNS, STRETCHES = 5_000, 50_000

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
_BYTE = np.random.default_rng(20240101).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    """The first powers of an odd base, or of its inverse, modulo 2**64."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), pow(base, -1, 2**64) if inverse else base, np.uint64)
        step[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(step)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal sequences have equal hashes wherever they stand."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * _power(base, False, len(values)))))
    return _mix((sums[end] - sums[start]) * _power(base, True, len(sums))[start])


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (least or greatest) over each n values that follow one another."""
    size, out = 1, values
    while size * 2 <= n:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (n - size)], out[n - size :]) if n > size else out


class WordBatch:
    """The words of several texts: their hashes, and the text that each belongs to."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        flat = _LOWER[flat] if lower else flat
        space = _SPACE[flat]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        self.hash = _spans(_BYTE[flat], start, end, _BASES[0])
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            self.hash[i] = int.from_bytes(hashlib.blake2b(flat[start[i] : end[i]], digest_size=8).digest(), "little")
        self.flat, self.start, self.end = flat, start, end
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(limits, start, "right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # the first word of each text
        self.n = len(self.hash)

    def word(self, i: int) -> bytes:
        return self.flat[self.start[i] : self.end[i]].tobytes()

    def inside(self, width: int) -> np.ndarray:
        """For each start of a window in the batch, whether it ends in the same text."""
        return self.doc[: max(self.n - width + 1, 0)] == self.doc[width - 1 :]

    def windows(self, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start there."""
        return _spans(self.hash, start, start + width, _BASES[0]), _spans(_mix(self.hash), start, start + width, _BASES[1])

    def anchors(self, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor of each window, which windows count, and the hashes of all phrases."""
        at = np.arange(max(self.n - phrase + 1, 0))
        phrases = _spans(self.hash, at, at + phrase, _BASES[1])
        return _slide(phrases, width - phrase + 1, np.minimum), self.inside(width), phrases


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about PIECE bytes of text, or of 256 rows."""
    for part in small([batch], 256):
        texts = [x or b"" for x in part.column(column).to_pylist()]
        first = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= PIECE or i + 1 == len(texts):
                yield part.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of n owners; owner is in ascending order."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, phrase: int) -> DataFrame:
    """(rn, id, text_hash, n_words, words_sha256, anchors) for each row, staged; an anchor that occurs again in the text is listed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 2):
                w = WordBatch(texts)
                own, anchors = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                if w.n >= width:
                    least, inside, phrases = w.anchors(width, phrase)
                    reach = width - phrase
                    least = np.concatenate((np.zeros(reach, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(reach, np.uint64)))
                    chosen = np.flatnonzero((_slide(least, reach + 1, np.maximum) == phrases) & (phrases > 0))
                    own, anchors = w.doc[chosen], phrases[chosen]
                    order = np.lexsort((anchors, own))
                    own, anchors = own[order], anchors[order]
                    same = np.concatenate(([False], (own[1:] == own[:-1]) & (anchors[1:] == anchors[:-1])))
                    third = same & np.concatenate(([False], same[:-1]))
                    own, anchors = own[~third], anchors[~third]
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.diff(w.first), pa.int64()), pa.array(sha), _lists(anchors.view(np.int64), own, len(texts), pa.int64())],
                    ["id", "text_hash", "n_words", "words_sha256", "anchors"],
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    schema = f"id {rows.dtypes[0][1]}, text_hash long, n_words long, words_sha256 string, anchors array<long>"
    return stage_table(rows.mapInArrow(run, schema).withColumn("rn", F.monotonically_increasing_id()), "sketch")


def candidates(docs: DataFrame, anchors: DataFrame, known: DataFrame, hot: DataFrame, id_col: str, text_col: str, width: int, phrase: int) -> DataFrame:
    """(rn, weight, text, runs), staged: texts with windows whose anchor recurs; runs lists starts and lengths of runs of such windows.

    Of texts that are alike only one is here, with weight 2. `hot` has the recurring anchors and their counts.
    """
    spread = anchors.select("rn", F.explode(F.array_distinct("anchors")).alias("anchor"))
    by_row = join_heavy(spread, hot, "anchor", F.col("count") > HEAVY).groupBy("rn").agg(F.collect_list("anchor").alias("hot"))
    weight = F.when(F.col("copies").isNull(), 1).otherwise(2).alias("weight")
    found = known.where("copies is null or rn = copies").select("rn", F.col("id").alias("_id"), "text_hash", weight).join(by_row, "rn")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("text_hash"))).select("rn", "weight", "text", "hot")
    rows = rows.where("weight = 1").union(rows.where("weight = 2").dropDuplicates(["rn"]))  # its very row may be repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 2):
                w = WordBatch(texts)
                least, inside, _ = w.anchors(width, phrase)
                hot = np.unique(b.column(3).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                is_hot = np.isin(least, hot) & inside
                edge = np.flatnonzero(np.diff(is_hot.astype(np.int8), prepend=0, append=0))  # windows across texts part the texts' runs
                start, end = edge[::2], edge[1::2]
                own = w.doc[start]
                runs = np.stack((start - w.first[own], end - start), 1).ravel()
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(runs.astype(np.int32), np.repeat(own, 2), len(texts), pa.int32())], ["rn", "weight", "text", "runs"])

    return stage_table(rows.mapInArrow(run, "rn long, weight int, text binary, runs array<int>"), "candidates")


def _starts(w: WordBatch, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The windows in the runs of each text: their starts in the batch, and their texts."""
    pairs = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()) // 2)
    length = pairs[:, 1]
    doc = np.repeat(owner, length)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(pairs[:, 0] + w.first[owner], length) + within, doc


def lone_windows(found: DataFrame, width: int) -> DataFrame:
    """(rn, lone): for each text, the starts of its candidate windows that occur nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 2):
                w = WordBatch(texts)
                start, doc = _starts(w, b.column(3))
                one, two = w.windows(start, width)
                rn, weight = (b.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(weight), pa.array(rn), pa.array((start - w.first[doc]).astype(np.int32))],
                    ["one", "two", "weight", "rn", "start"],
                )

    rows = found.mapInArrow(run, "one long, two int, weight int, rn long, start int")
    counted = rows.groupBy("one", "two").agg(F.sum("weight").alias("n"), F.min("rn").alias("rn"), F.min("start").alias("start"))
    return counted.where("n = 1").groupBy("rn").agg(F.collect_list("start").alias("lone"))


def _picked(points: list[int], first: int, last: int, width: int) -> list[int]:
    """Some of the ascending points between first and last, with both of these, at most `width` apart; points are no farther apart."""
    out, before = [first], first
    for p in points:
        if p - out[-1] > width and before > out[-1]:
            out.append(before)
        before = p
    if last - out[-1] > width and before > out[-1]:
        out.append(before)
    return out if out[-1] == last else [*out, last]


def passages(found: DataFrame, lone: DataFrame, width: int, phrase: int) -> DataFrame:
    """(anchor, one, words), staged: each distinct pattern of `width` words (32-bit hashes) that confirmed windows are covered by, its 64-bit hash and its anchor."""
    rows = found.select("rn", "text", "runs").join(lone, "rn", "left").select("text", "runs", F.coalesce("lone", F.array().cast("array<int>")).alias("lone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 0):
                w = WordBatch(texts)
                start, _ = _starts(w, b.column(1))
                lone_of = np.repeat(np.arange(len(texts)), np.diff(b.column(2).offsets.to_numpy()))
                confirmed = np.zeros(w.n + 1, bool)
                confirmed[start] = True
                confirmed[b.column(2).flatten().to_numpy(zero_copy_only=False) + w.first[lone_of]] = False
                least, inside, phrases = w.anchors(width, phrase)
                confirmed[: len(inside)] &= inside
                turns = np.flatnonzero((np.diff(least, append=least[-1:]) != 0) | (phrases[: len(least)] == least))  # the last windows with an anchor, at whatever place of several
                edge = np.flatnonzero(np.diff((confirmed[: len(least)]).astype(np.int8), prepend=0, append=0))
                at = []
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    i, j = np.searchsorted(turns, (s, e))
                    at += _picked(turns[i:j].tolist(), s, e - 1, width)
                at = np.array(at, np.int64)
                words = _short(w.hash)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[at].view(np.int64)), pa.array(w.windows(at, width)[0].view(np.int64)), pa.array([words[k : k + width].tobytes() for k in at.tolist()], pa.binary())],
                    ["anchor", "one", "words"],
                )

    return stage_table(rows.mapInArrow(run, "anchor long, one long, words binary").dropDuplicates(["one"]), "passages")


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash."""
    return (hashes >> np.uint64(32)).astype("<u4")


def stretches(found: DataFrame, shards: int, width: int, phrase: int) -> DataFrame:
    """(shard, rn, at, words): each stretch of windows of a text whose recurring anchors are of one shard, with its words (32-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 1):
                w = WordBatch(texts)
                start, doc = _starts(w, b.column(2))
                shard = w.anchors(width, phrase)[0][start].view(np.int64) % shards
                begins = np.ones(len(start), bool)
                begins[1:] = (np.diff(start) != 1) | (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])
                first = np.flatnonzero(begins)
                last = np.append(first[1:], len(start)) - 1
                words, own = _short(w.hash), doc[first]
                cut = [words[s : e + width].tobytes() for s, e in zip(start[first].tolist(), start[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first]), b.column(0).take(pa.array(own)), pa.array((start[first] - w.first[own]).astype(np.int32)), pa.array(cut, pa.binary())],
                    ["shard", "rn", "at", "words"],
                )

    return found.select("rn", "text", "runs").mapInArrow(run, "shard long, rn long, at int, words binary")


#: Characters that stand for word hashes; as there are fewer of them, 64-bit hashes tell occurrences from others.
_CHARACTERS = 0x110000 - 0x800


def _coded(words: np.ndarray, between: np.ndarray | None = None) -> str:
    """Words as characters; the first character stands for none, and is put where texts end."""
    code = words % np.uint32(_CHARACTERS - 1) + np.uint32(1)
    code = np.where(code >= 0xD800, code + 0x800, code).astype("<u4")
    if between is not None:
        code[between] = 0
    return code.tobytes().decode("utf-32-le")


class PassageAutomaton:
    """An Aho-Corasick automaton over the patterns of one shard."""

    def __init__(self, patterns: list[bytes], width: int):
        self.width, self.machine = width, ahocorasick.Automaton()
        words = np.frombuffer(b"".join(patterns), "<u4")
        coded, at = _coded(words), np.arange(0, len(words), width)
        self.hashes = np.unique(_spans(words.astype(np.uint64), at, at + width, _BASES[0]))
        for i in at.tolist():
            self.machine.add_word(coded[i : i + width], i)
        self.machine.make_automaton()

    def covered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What occurrences of patterns cover in texts of word hashes: the text's number, the first word and the end of each stretch."""
        size = np.array([len(t) // 4 for t in texts], np.int64)
        words = np.frombuffer(b"".join(t + b"\0\0\0\0" for t in texts), "<u4")
        begin = np.cumsum(size + 1) - size - 1
        hits = np.fromiter((end for end, _ in self.machine.iter(_coded(words, begin + size))), np.int64) - self.width + 1
        hits = hits[np.isin(_spans(words.astype(np.uint64), hits, hits + self.width, _BASES[0]), self.hashes)] if len(hits) else hits
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, hits, 1)
        np.add.at(change, hits + self.width, -1)
        edge = np.flatnonzero(np.diff(np.cumsum(change)[:-1] > 0, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        own = np.searchsorted(begin, start, "right") - 1
        return own, start - begin[own], end - begin[own]


def locate(found: DataFrame, patterns: DataFrame, hot: DataFrame, width: int, phrase: int) -> DataFrame:
    """(rn, first, end): stretches of words of the texts in `found` that occurrences of patterns cover."""
    shards = patterns.count() // PATTERNS + 1
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    loads = hot.groupBy(shard).agg(F.sum("count").alias("load"))
    plan = patterns.groupBy(shard).agg(F.count("*").alias("n")).join(loads, "shard").select(
        "shard", F.ceil(F.col("n") / PATTERNS).alias("parts"), F.ceil(F.col("load") / STRETCHES).alias("copies")
    )
    plan = stage_table(plan, "plan")  # a row for each shard
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    one_part, one_copy = F.pmod("one", F.col("parts")).cast("int").alias("part"), F.pmod(F.xxhash64("rn"), F.col("copies")).cast("int").alias("copy")
    known = patterns.select(shard, "one", "words").join(plan, "shard").select("shard", one_part, each("copies").alias("copy"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rn"), F.lit(0).alias("at"), "words")
    texts = stretches(found, shards, width, phrase).join(plan, "shard").select("shard", each("parts").alias("part"), one_copy, F.lit(1).alias("kind"), "rn", "at", "words")
    place = ["shard", "part", "copy"]
    rows = known.union(texts).repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, machine = None, [], None
        for b in small(batches, 4096):
            keys = np.stack([b.column(i).to_numpy() for i in range(4)])
            cuts = np.flatnonzero(np.append(np.append(True, (np.diff(keys) != 0).any(axis=0)), True))
            for s, e in itertools.pairwise(cuts.tolist()):
                key, words = tuple(keys[:3, s].tolist()), b.column(6)[s:e].to_pylist()
                if key != now:
                    now, own, machine = key, [], None
                if not keys[3, s]:
                    own += words
                    continue
                if machine is None:
                    machine = PassageAutomaton(own, width) if own else None
                    own = []
                if machine is not None:
                    doc, first, end = machine.covered(words)
                    at = b.column(5)[s:e].to_numpy()[doc]
                    yield pa.RecordBatch.from_arrays([b.column(4)[s:e].take(pa.array(doc)), pa.array((first + at).astype(np.int32)), pa.array((end + at).astype(np.int32))], ["rn", "first", "end"])

    return rows.mapInArrow(run, "rn long, first int, end int")


def cut_out(found: DataFrame, places: DataFrame) -> DataFrame:
    """(rn, n_removed, kept): the texts that lose words, without the words at `places` (rn, first, end)."""
    lists = places.groupBy("rn").agg(F.collect_set(F.struct("first", "end")).alias("places"))
    rows = found.select("rn", "text").join(lists, "rn").select("rn", "text", "places.first", "places.end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 1):
                removed, kept = [], []
                for t, first, end in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = t.split()
                    stay = np.ones(len(words), bool)
                    for s, e in zip(first, end, strict=True):
                        stay[s:e] = False
                    removed.append(int((~stay).sum()))
                    kept.append(b" ".join(itertools.compress(words, stay.tolist())).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["rn", "n_removed", "kept"])

    return rows.mapInArrow(run, "rn long, n_removed long, kept string")


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, phrase: int = 10) -> DataFrame:
    """(id, text_hash, n_words, n_removed, words_sha256, kept) for each row of `docs`, a kept table.

    words_sha256 is that of all words joined by single spaces; kept is the rest of the text in the same
    form where words were removed, else null. text_hash is xxhash64 of the text, to join the result back.
    """
    with scratch(docs.sparkSession):
        anchors = sketch(docs, id_col, text_col, width, phrase)
        own = anchors.drop("anchors")
        groups = own.where(F.col("n_words") >= width).groupBy("words_sha256").agg(F.count("*").alias("n"), F.min("rn").alias("copies"))
        groups = stage_table(groups.where("n > 1"), "copies")
        alike = join_heavy(own, groups, "words_sha256", F.col("n") > HEAVY).select(*own.columns, "copies", "n")
        alone = own.join(groups.select("words_sha256").hint("merge"), "words_sha256", "left_anti").withColumns({"copies": F.lit(None).cast("long"), "n": F.lit(1).cast("long")})
        known = stage_table(alike.unionByName(alone), "known")
        hot = stage_table(anchors.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1"), "anchors")
        found = candidates(docs, anchors, known, hot, id_col, text_col, width, phrase)
        patterns = passages(found, lone_windows(found, width), width, phrase)
        changed = stage_table(cut_out(found, locate(found, patterns, hot, width, phrase)), "cut")
        shown = known.withColumn("rep", F.coalesce("copies", "rn"))
        of = changed.join(known.select("rn", "n"), "rn").withColumnRenamed("rn", "rep")
        whole = join_heavy(shown.where("copies is not null").drop("n"), of, "rep", F.col("n") > HEAVY)
        single = shown.where("copies is null").drop("n").join(changed.withColumnRenamed("rn", "rep"), "rep", "left")
        out = ["id", "text_hash", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "words_sha256", "kept"]
        return stage_table(whole.select(*out).union(single.select(*out)), "without_recurring", keep=True)
