"""The best-scoring collocations of each language, by best-first branch and bound over phrases that grow word by word.

A phrase of 2 to `longest` words stands for itself if it occurs at least `least` times. Cutting it after k words, with a, l and r the
counts of the phrase and both parts among n words, scores floor(1000 a n / (l r)); the lowest cut counts. As r is at least a, no phrase that begins with w can score
above floor(1000 n / f(w)): the count of a prefix bounds all that grows from it. First words are expanded from the highest bound downwards, in rounds: a round takes those
from a limit on, grows their phrases level by level (only prefixes that occur `least` times grow) and scores what survives. Once `top` survivors of a language are
known, the limit sinks no lower than the score of the last of them; when all first words whose bound reaches that score are expanded, the list is settled, ties included. Languages
are settled independently; one with fewer survivors is expanded whole.

A phrase is dropped if a longer candidate around it occurs as often. The extension by one word already does then, so each occurrence has the same
word before it, or the same word after it: what is kept with each count is the least and greatest hash (64 bits) of those neighbours.

The texts are read once, into chunks of numbered words in the shared folder. Words that occur less than `least` times are in no candidate and can be no candidate's only neighbour,
so they stand for breaks from then on: counts by hash tell most of them, and the chunks are written again without. Rounds read those. What tasks need to know of earlier levels is
sent as a bitmap of bounded size over hashes of phrases: a false hit costs a row to count, and counts and joins are by the phrases themselves.
Memory: a chunk of about CHUNK bytes (or one text) in a task, bitmaps of BITS bits, and `top` rows for a language.

Edge cases: null texts are empty, a null language is `und`; empty texts and pieces give nothing; phrases do not cross pieces or texts; repeated rows count each time;
ties in score go to the greater count, then to the lesser phrase by UTF-8 bytes; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, small, stage_table

#: Bytes of text in a chunk, about.
CHUNK = 1 << 20
#: Bits of a filter at most (a multiple of 32768, a power of two): 8 MB.
BITS = 1 << 26
#: Rows that a task hands on at once.
ROWS = 20_000
#: A round goes down to a bound so many times lower, or to the last score that may still count.
STEP = 32
#: No word stands there.
NONE = np.int64(-(2**63))

_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNKS = "lang string, words array<string>, hashes array<long>, counts array<long>, ids binary"
COUNTS = "lang string, phrase string, hash long, a long, left_min long, left_max long, right_min long, right_max long"


def word_hash(lang: str, word: str) -> int:
    h = xxhash.xxh64_intdigest(f"{lang}\n{word}", 42)
    return max(h - (1 << 64) if h >> 63 else h, int(NONE) + 1)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase that is one word longer."""
    with np.errstate(over="ignore"):
        x = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def phrase_hash(lang: str, phrase: str) -> int:
    hashes = [np.array([word_hash(lang, w)], np.int64) for w in phrase.split(" ")]
    h = hashes[0]
    for x in hashes[1:]:
        h = _mixed(h, x)
    return int(h[0])


def read_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, number of each word's word, of its piece and of its text), in the order of the texts."""
    flat = pa.concat_arrays([texts.cast(pa.large_string())])
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.unique(ends[:-1][np.diff(ends) > 0])  # where texts begin
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.searchsorted(np.union1d(np.flatnonzero(kind == _BREAK), edges), starts, "right")
    text = np.searchsorted(ends[1:], starts, "right")
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, text


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK bytes of its second column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            langs = part.column(0).dictionary_encode()
            words, ids, piece, text = read_words(part.column(1))
            own = langs.indices.to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                here = own == k
                if not here.any():
                    continue
                seen, numbers, counts = np.unique(ids[here], return_inverse=True, return_counts=True)
                breaks = piece[here]
                place = np.arange(len(numbers)) + np.cumsum(np.concatenate([[True], breaks[1:] != breaks[:-1]]))
                line = np.full(place[-1] + 2, -1, np.int32)
                line[place] = numbers
                named = words.take(pa.array(seen))
                yield _row(lang, named, np.array([word_hash(lang, w) for w in named.to_pylist()], np.int64), counts, line)


def _row(lang: str, words: pa.Array, hashes: np.ndarray, counts: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words.cast(pa.string()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *lists, pa.array([line.astype(np.int32).tobytes()], pa.binary())], ["lang", "words", "hashes", "counts", "ids"])


def chunks_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """CHUNKS: the words of many texts of one language, numbered; -1 stands before, between and after pieces."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return stage_table(rows.mapInArrow(_chunked, CHUNKS), "chunks")


def _array(column: pa.Array, k: int) -> pa.Array:
    """Row k of a column of lists, without a copy."""
    return column[k].values


def _often(counted: DataFrame, least: int) -> DataFrame:
    """(hash), staged: the hashes that occur `least` times, from counts (hash, a) of parts."""
    return stage_table(counted.groupBy("hash").agg(F.sum("a").alias("a")).where(F.col("a") >= least).select("hash"), "often")


def dense(chunks: DataFrame, least: int) -> DataFrame:
    """The chunks without words whose hashes occur less than `least` times: breaks stand for them, one for several in a row."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, group = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(group, b.column(1).flatten().to_numpy(), len(value)).astype(np.int64)
            yield from small([pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n)], ["hash", "a"])], ROWS)

    often = _often(chunks.select("hashes", "counts").mapInArrow(summed, "hash long, a long"), least)
    filter_ = _bitmap(often)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                hashes, counts = (_array(b.column(c), k).to_numpy() for c in (2, 3))
                stay = np.flatnonzero(_in(filter_.value, hashes))
                number = np.full(len(hashes) + 1, -1, np.int32)  # the last stands for -1
                number[stay] = np.arange(len(stay))
                line = number[np.frombuffer(b.column(4)[k].as_buffer(), np.int32)]
                line = line[np.append(True, (line[1:] >= 0) | (line[:-1] >= 0))]
                if len(stay):
                    yield _row(b.column(0)[k].as_py(), _array(b.column(1), k).take(pa.array(stay)), hashes[stay], counts[stay], line)

    return stage_table(chunks.mapInArrow(thinned, CHUNKS), "dense")


def _words_of(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, hash, a): the words of the chunks with their counts, summed within a task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, first, group = np.unique(b.column(2).flatten().to_numpy(), return_index=True, return_inverse=True)
            n = np.bincount(group, b.column(3).flatten().to_numpy(), len(value)).astype(np.int64)
            row = np.searchsorted(np.cumsum([len(x) for x in b.column(1)]), first, "right")
            made = [b.column(0).take(pa.array(row)), b.column(1).flatten().take(pa.array(first)), pa.array(value, pa.int64()), pa.array(n)]
            yield from small([pa.RecordBatch.from_arrays(made, ["lang", "phrase", "hash", "a"])], ROWS)

    return chunks.select("lang", "words", "hashes", "counts").mapInArrow(run, "lang string, phrase string, hash long, a long")


def _bitmap(hashed: DataFrame):
    """The hashes as a filter for tasks, of about 16 bits for each, but at most BITS in all."""
    size = min(BITS, max(1 << 15, 1 << (16 * hashed.count()).bit_length()))  # the same results at any size
    place = F.col("hash").bitwiseAND(F.lit(size - 1)) + 1
    parts = hashed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # at most BITS / 32768 rows of 4 KB
        bits[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return hashed.sparkSession.sparkContext.broadcast(bits)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & np.int64(bits.size * 8 - 1)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


class Chunk:
    """A chunk in a task: `line` holds the numbers of its words, padded at the end."""

    def __init__(self, batch: pa.RecordBatch, k: int, longest: int):
        """Row k of a batch of (hashes, ids) or (hashes, ids, lang, words)."""
        self.hashes = np.append(_array(batch.column(0), k).to_numpy(), NONE)  # the last stands for -1
        self.line = np.concatenate([np.frombuffer(batch.column(1)[k].as_buffer(), np.int32), np.full(longest, -1, np.int32)])
        self.lang, self.words = (batch.column(2)[k].as_py(), _array(batch.column(3), k)) if batch.num_columns > 2 else (None, None)

    def marks(self, bits: np.ndarray) -> np.ndarray:
        """Whether each word is in a filter; never for -1."""
        found = _in(bits, self.hashes)
        found[-1] = False
        return found

    def counted(self, at: np.ndarray, size: int, hashes: np.ndarray) -> pa.RecordBatch:
        """COUNTS of the phrases of `size` words that begin at `at`."""
        code = self.line[at].astype(np.int64)
        for k in range(1, size):
            if k > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.hashes) + self.line[at + k]
        _, first, group, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        order, begins = np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(n)[:-1]])
        left, right = self.hashes[self.line[at - 1]][order], self.hashes[self.line[at + size]][order]
        sides = [f.reduceat(x, begins) for x in (left, right) for f in (np.minimum, np.maximum)]
        shown = [self.words.take(pa.array(self.line[at[first] + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*shown, " ")
        lang = pa.repeat(pa.scalar(self.lang, pa.string()), len(n))
        return pa.RecordBatch.from_arrays(
            [lang, phrase, pa.array(hashes[first]), pa.array(n), *[pa.array(x) for x in sides]], ["lang", "phrase", "hash", "a", "left_min", "left_max", "right_min", "right_max"]
        )


def _counts(chunks: DataFrame, find, longest: int) -> DataFrame:
    """COUNTS over all chunks of what `find` (chunk -> (places, words, hashes) of phrases) gives for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                chunk = Chunk(b, k, longest)
                yield from small((chunk.counted(*x) for x in find(chunk)), ROWS)

    found = chunks.select("hashes", "ids", "lang", "words").mapInArrow(run, COUNTS)
    sides = [F.min("left_min"), F.max("left_max"), F.min("right_min"), F.max("right_max")]
    return found.groupBy("lang", "phrase", "hash").agg(F.sum("a").alias("a"), *[s.alias(c) for s, c in zip(sides, ("left_min", "left_max", "right_min", "right_max"), strict=True)])


def _hash_counts(chunks: DataFrame, find, longest: int) -> DataFrame:
    """(hash, a) of the same phrases in parts: a little number for each, for the many that occur seldom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for _, _, hashes in find(Chunk(b, k, longest)):
                    value, n = np.unique(hashes, return_counts=True)
                    yield from small([pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["hash", "a"])], ROWS)

    return chunks.select("hashes", "ids").mapInArrow(run, "hash long, a long")


def _level(chunks: DataFrame, size: int, longest: int, least: int, frontier: DataFrame, common, prefixes: list) -> DataFrame:
    """The phrases of `size` words that occur `least` times and begin with a word of `frontier`.

    `prefixes` has a filter for each shorter length; a phrase that passes one by chance is dropped by its count or its first word. Pairs, most of which are
    rare, are counted by their hashes first.
    """

    def find(chunk: Chunk, also=None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        known = chunk.marks(common.value)
        at = np.flatnonzero(chunk.marks(prefixes[0].value)[chunk.line])
        h = chunk.hashes[chunk.line[at]]
        for k in range(1, size):
            go = known[chunk.line[at + k]]
            at, h = at[go], _mixed(h[go], chunk.hashes[chunk.line[at[go] + k]])
            if k < size - 1:
                go = _in(prefixes[k].value, h)
                at, h = at[go], h[go]
        if also is not None:
            go = _in(also.value, h)
            at, h = at[go], h[go]
        if len(at):
            yield at, size, h

    pairs = _bitmap(_often(_hash_counts(chunks, find, longest), least)) if size == 2 else None
    counts = _counts(chunks, lambda chunk: find(chunk, pairs), longest)
    often = counts.where(F.col("a") >= least).withColumns({"size": F.lit(size), "_first": _words("phrase")[0]})
    found = stage_table(often.join(frontier.select("lang", F.col("phrase").alias("_first")), ["lang", "_first"], "left_semi").drop("_first"), "phrases")
    if pairs is not None:
        pairs.destroy()
    return found


def _occurrences(chunks: DataFrame, longest: int, common, firsts, wanted) -> DataFrame:
    """COUNTS of the phrases of 2 to longest - 1 words whose hashes are in `wanted`, and of some others."""

    def find(chunk: Chunk) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        known = chunk.marks(common.value)
        at = np.flatnonzero(chunk.marks(firsts.value)[chunk.line])
        h = chunk.hashes[chunk.line[at]]
        for k in range(1, longest - 1):
            go = known[chunk.line[at + k]]
            at, h = at[go], _mixed(h[go], chunk.hashes[chunk.line[at[go] + k]])
            hit = _in(wanted.value, h)
            if hit.any():
                yield at[hit], k + 1, h[hit]

    return _counts(chunks, find, longest)


def _hashed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, hash, first): `first` is the hash of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            hashes = [phrase_hash(lang, p) for lang, p in rows]
            firsts = [word_hash(lang, p.split(" ", 1)[0]) for lang, p in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.int64()), pa.array(firsts, pa.int64())], ["lang", "phrase", "hash", "first"])

    return phrases.select("lang", "phrase").mapInArrow(run, "lang string, phrase string, hash long, first long")


def _words(phrase: str | Column) -> Column:
    return F.split(F.col(phrase) if isinstance(phrase, str) else phrase, " ")


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice(_words("phrase"), start, size), " ")


def _wide(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(17,0)")


def _scored(survivors: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest cut; products have up to 37 digits."""
    cut = survivors.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("_head"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"))
    heads = parts.select(F.col("lang"), F.col("phrase").alias("_head"), F.col("a").alias("l"))
    rests = parts.select(F.col("lang"), F.col("phrase").alias("_rest"), F.col("a").alias("r"))
    both = cut.join(heads, ["lang", "_head"]).join(rests, ["lang", "_rest"]).join(totals, "lang")
    both = both.withColumns({"_over": _wide("a") * _wide("n") * F.lit(1000).cast("decimal(4,0)"), "_under": _wide("l") * _wide("r")})
    lowest = F.min(F.struct(F.expr("_over div _under").alias("score"), "k", "l", "r"))
    best = both.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("c"))
    return best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))


def _bound(n: str, a: str) -> Column:
    return F.expr(f"(cast({n} as decimal(20,0)) * cast(1000 as decimal(4,0))) div cast({a} as decimal(17,0))")


def ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # Spark keeps `top` rows of each partition before it shuffles
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` surviving phrases of each language."""
    with scratch(docs.sparkSession):
        return stage_table(_mined(chunks_of(docs, text_col, lang_col), longest, least, top), "collocations", keep=True)


def _mined(raw: DataFrame, longest: int, least: int, top: int) -> DataFrame:
    totals = raw.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    chunks = dense(raw, least)
    common = _words_of(chunks).groupBy("lang", "phrase", "hash").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    totals = stage_table(totals, "totals")
    common = stage_table(common.join(totals, "lang").withColumn("bound", _bound("n", "a")), "common")
    known = _bitmap(common)
    scored = None
    limits = stage_table(totals.select("lang", "n", F.floor(F.col("n") * 1000 / least / STEP).cast("long").alias("low"), F.lit(None).cast("long").alias("high")), "limits")
    while limits.limit(1).count():
        due = (F.col("bound") >= F.col("low")) & (F.col("high").isNull() | (F.col("bound") < F.col("high")))
        frontier = stage_table(common.join(limits.select("lang", "low", "high"), "lang").where(due).select("lang", "phrase", "hash"), "frontier")
        live = chunks.join(limits.select("lang"), "lang", "left_semi")
        levels = _grown(live, frontier, known, longest, least)
        if levels or scored is None:
            scored = _round(live, levels, common, totals, known, longest, scored)
        found = ranked(scored, top).groupBy("lang").agg(F.count("*").alias("found"), F.min("score").alias("last"))
        after = limits.join(found, "lang", "left").withColumn("last", F.when(F.col("found") >= top, F.col("last")))
        open_ = (F.col("low") > F.coalesce("last", F.lit(0))) & (F.col("low") > 1000)  # no bound is below 1000
        lower = F.greatest(F.coalesce("last", F.lit(0)), F.floor(F.col("low") / STEP), F.lit(1000)).cast("long")
        limits = stage_table(after.where(open_).select("lang", "n", lower.alias("low"), F.col("low").alias("high")), "limits")
    known.destroy()
    scored = scored if scored is not None else _round(chunks, [], common, totals, known, longest, None)
    return ranked(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _grown(live: DataFrame, frontier: DataFrame, known, longest: int, least: int) -> list[DataFrame]:
    """The phrases that grow from the frontier, by their length, as far as there are any."""
    prefixes, levels = [], [frontier]
    for size in range(2, longest + 1):
        if levels[-1].isEmpty():
            break
        prefixes.append(_bitmap(levels[-1]))
        levels.append(_level(live, size, longest, least, frontier, known, prefixes))
    for x in prefixes:
        x.destroy()
    return levels[1:]


def _round(live: DataFrame, levels: list[DataFrame], common: DataFrame, totals: DataFrame, known, longest: int, before: DataFrame | None) -> DataFrame:
    """What earlier rounds scored and the survivors of this round's levels."""
    if not levels:
        return live.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    grown = levels[0]
    for x in levels[1:]:
        grown = grown.unionByName(x)
    alone = lambda side: (F.col(f"{side}_min") == F.col(f"{side}_max")) & (F.col(f"{side}_min") != int(NONE))
    survivors = grown.where((F.col("size") == longest) | ~(alone("left") | alone("right")))
    starts = survivors.where("size > 2").select("lang", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 2)).alias("k"))
    wanted = stage_table(_hashed(starts.select("lang", _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("phrase")).distinct()), "wanted")
    if wanted.isEmpty():  # pairs only
        new = stage_table(_scored(survivors, common, totals), "scored")
        return new if before is None else before.unionByName(new)
    filters = _bitmap(wanted.select(F.col("first").alias("hash")).distinct()), _bitmap(wanted)
    counted = _occurrences(live, longest, known, *filters)
    rests = stage_table(counted.join(wanted, ["lang", "phrase"], "left_semi").select("lang", "phrase", "a"), "rests")
    for x in filters:
        x.destroy()
    prefixes = grown.select("lang", "phrase", "a").join(rests, ["lang", "phrase"], "left_anti")
    parts = common.select("lang", "phrase", "a").unionByName(rests).unionByName(prefixes)
    new = stage_table(_scored(survivors, parts, totals), "scored")
    return new if before is None else before.unionByName(new)
