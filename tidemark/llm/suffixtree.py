"""Language-model scores from a probabilistic suffix tree.

Texts are lower-cased (A-Z) and cut into words; an end follows the last. The tree's symbols are the common
tokens, one each, and classes of the other words by their first letters; a word's probability is that of
its symbol after the symbols before it, times that of the word in its class (add-one). States are contexts of variable length, up to `depth`
symbols: a context is one if it occurs `floor` times or more, the context without its first symbol is a state, and its
next-symbol counts diverge from that one's distribution by `worth` nats or more, and `worth_each` nats for each symbol seen twice or more; symbols
seen once are taken together in this test. Each state's distribution is smoothed by that of the next shorter one: a symbol seen n times of
`total` has (n + m p) / (total + seen), p being its probability there and `seen` the number of different symbols; symbols seen once count
as not seen, so m is `seen` and the number of those. A symbol is scored in the state of the longest suffix.

1. `vocabulary`: every word of the corpus, told by its 64-bit hash, with its count in training rows, summed inside tasks and then by Spark.
2. `alphabet`: words that occur N^0.75 / `own` times or more of N tokens are symbols, and so are classes; their number grows with the corpus.
3. `read_texts`: each text as symbols. Words that make up `common` of all tokens, at most 1/common of them, are
   broadcast with their counts; the other words of a text are kept as hashes and joined to the vocabulary later.
4. `grow`: level by level, what follows the contexts that occur often enough is counted, summed inside tasks and then by Spark; the
   divergence test and the smoothing are joins and sums over each context's counts, all of them. A context must occur N^0.6 / `rare` times, so the
   tree grows with the corpus, as N^0.4 at least. It is a table; nothing of it is dropped.
5. `score_texts` scores symbols in a map and adds the words' part, which comes from a join before the tree grows, by document.

The contexts to count and the states are sent to the tasks while they have at most `sent` rows; beyond that each text's own runs are joined to them (`told`), with
the same result. Of the runs in states, the `sent` that occur most often are sent, and a filter of bounded size of the others; what a text has of those is joined to
them (`score_symbols`). A run occurs no more often than the shorter one at its end, so each of the others adds to the score what it differs from the shorter one, whatever the rest.

Edge cases: null and empty texts are one token, the end. Without training rows all symbols are equally likely and
counts are 0. Repeated rows are scored alike. Rows whose id is null have the fold of the empty text; rows whose fold is null take part in training.
Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.collocations import _bitmap, _in
from tidemark.llm.common import scratch, small, stage_table
from tidemark.llm.substrings import WordBatch, _lists, _mix, _pieces

#: Hash of the end of a text, which is no word.
END_HASH = np.uint64(0x5DEECE66D1234567)
#: Distinct words, or symbol runs, that a task gathers before it hands them on.
GATHER = 250_000
#: Contexts of one length that Spark may send to be joined, at most.
JOINED = 1_000_000
#: Letters (bytes) that the class of a word goes by, and those of the end.
LETTERS = 3
END_LETTERS = 0x0B0000


def _tokens(w: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in the batch, ends included, and the text of each."""
    texts = np.arange(len(w.first) - 1)
    return np.insert(w.hash, w.first[1:], END_HASH), np.insert(w.doc, w.first[1:], texts)


def vocabulary(docs: DataFrame, text_col: str, trains: Column) -> DataFrame:
    """(hash, letters, count), staged: all words, told by their hashes, with their first letters as a number and their counts in the rows that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            every, letters, counts = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(every)
            first = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))
            return every[order[first]], letters[order[first]], np.add.reduceat(counts[order], first)

        def batch(value: np.ndarray, letters: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            return small([pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(letters), pa.array(count)], ["hash", "letters", "count"])], GATHER // 2)

        for whole in batches:
            for b, texts in _pieces(whole, 0):
                w = WordBatch(texts, lower=True)
                tokens, doc = _tokens(w)
                training = b.column(1).to_numpy(zero_copy_only=False)[doc]
                value, index, inverse = np.unique(tokens, return_index=True, return_inverse=True)
                place = np.minimum(index - doc[index], max(w.n - 1, 0))  # of the word in the batch; an end is in front of the next text's first
                letters = np.where(value == END_HASH, END_LETTERS, _letters_of(w, place) if w.n else END_LETTERS)
                held.append((value, letters, np.bincount(inverse, training).astype(np.int64)))
                size += len(value)
                if size > 4 * GATHER:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 2 * GATHER:
                        yield from batch(*held[0])
                        held, size = [], 0
        if held:
            yield from batch(*merged())

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(text.alias("text"), F.coalesce(trains, F.lit(True)).alias("trains")).mapInArrow(run, "hash long, letters long, count long")
    return stage_table(rows.groupBy("hash").agg(F.min("letters").alias("letters"), F.sum("count").alias("count")), "vocabulary")


@dataclass
class Alphabet:
    """Symbols by common word and by first letters, and the counts of common words; all in ascending order of their keys."""

    hashes: np.ndarray  # of common words
    counts: np.ndarray
    costs: np.ndarray  # log10 probability of the word in its symbol
    symbols: np.ndarray
    letters: np.ndarray  # first letters of words with a class of their own, as numbers
    classes: np.ndarray  # and their symbols
    size: int  # symbols in all; the last stands for all other words


def _letters_of(w: WordBatch, words: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The first letters of each of the words as a number; shorter words are filled up with zero bytes."""
    start, end = w.start[words], w.end[words]
    code = np.zeros(len(start), np.int64)
    for k in range(LETTERS):
        at = start + k
        code = code << 8 | np.where(at < end, w.flat[np.minimum(at, len(w.flat) - 1)], 0)
    return code


def alphabet(words: DataFrame, n: int, own_floor: float, common: float) -> tuple[Alphabet, DataFrame]:
    """The symbols, and (hash, count, cost), staged, for all words: cost is the log10 probability of the word in its symbol."""
    own = F.col("count") >= own_floor
    words = words.withColumn("letters", F.when(~own, F.col("letters")))
    groups = words.where(~own).groupBy("letters").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v"))
    large = groups.where(F.col("n") >= own_floor)
    found = sorted(large.collect(), key=lambda r: r["letters"])
    rest = groups.join(F.broadcast(large.select("letters")), "letters", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    size = F.coalesce(F.col("n") + F.col("v"), F.lit(rest[0] + rest[1])) + 1
    rated = words.join(F.broadcast(large), "letters", "left").select(
        "hash", "count", F.when(own, F.lit(0.0)).otherwise(F.log10((F.col("count") + 1) / size)).alias("cost"), "letters", own.alias("own")
    )
    rated = stage_table(rated, "rated")
    often = rated.where(F.col("count") >= max(1.0, min(common * n, own_floor))).toArrow().sort_by("hash")
    own_symbol = often.column("own").to_numpy()
    singles, alone = np.cumsum(own_symbol) - 1, int(own_symbol.sum())
    code = {r["letters"]: i + alone for i, r in enumerate(found)}
    other = alone + len(found)
    symbols = [i if o else code.get(x, other) for i, o, x in zip(singles.tolist(), own_symbol.tolist(), often.column("letters").to_pylist(), strict=True)]
    numbers = np.array(list(code), np.int64)
    made = Alphabet(
        *(often.column(c).to_numpy() for c in ("hash", "count", "cost")), np.array(symbols, np.int64),
        numbers, np.array(list(code.values()), np.int64), other + 1,
    )
    return made, rated.select("hash", "count", "cost")


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in ascending values, and whether it is there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def read_texts(docs: DataFrame, known: Alphabet, id_col: str, text_col: str, trains: Column) -> DataFrame:
    """(rn, id, trains, n_tokens, known, logs, cost, rare, symbols), a kept table: each text as symbols (unsigned 32-bit), sums over its common words, and its other words' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        logs = np.log10(own.counts + 1.0)
        table = _sorted(own.hashes.view(np.uint64), np.arange(len(own.hashes)))
        for whole in batches:
            for b, texts in _pieces(whole, 1):
                w = WordBatch(texts, lower=True)
                tokens, doc = _tokens(w)
                at, hit = table.find(tokens)
                at, miss = table.values[at[hit]], np.flatnonzero(~hit)
                symbols = np.empty(len(tokens), "<u4")
                symbols[hit] = own.symbols[at]
                word = miss[tokens[miss] != END_HASH]
                place, classed = _find(own.letters, _letters_of(w, word - doc[word]))
                symbols[miss] = own.size - 1
                symbols[word[classed]] = own.classes[place[classed]]
                each = [np.bincount(doc[hit], x[at], len(texts)).astype(float) for x in (logs, own.costs)]  # of no words the sums are whole numbers
                n = np.bincount(doc, minlength=len(texts))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(np.bincount(doc[hit], minlength=len(texts)), pa.int64()), *(pa.array(x) for x in each),
                        _lists(tokens[miss].view(np.int64), doc[miss], len(texts), pa.int64()), pa.array([symbols[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ],
                    ["id", "trains", "n_tokens", "known", "logs", "cost", "rare", "symbols"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    schema = f"id {rows.dtypes[0][1]}, trains boolean, n_tokens long, known long, logs double, cost double, rare array<long>, symbols binary"
    return stage_table(rows.mapInArrow(run, schema).withColumn("rn", F.monotonically_increasing_id()), "texts", keep=True)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of several texts in a row, and for each the number of symbols before it in its text."""
    size = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
    symbols = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
    return symbols, np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)


def _text_of(parts: list[bytes]) -> np.ndarray:
    """The number of the text that each symbol belongs to."""
    return np.repeat(np.arange(len(parts)), [len(x) // 4 for x in parts])


def _longer(run: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a run with one more symbol at its end; never 0."""
    return _mix(run * np.uint64(0xD6E8FEB86659FD93) + symbol.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def run_hashes(symbols: np.ndarray, before: np.ndarray, longest: int) -> list[np.ndarray]:
    """For lengths 0 to `longest` a hash of the run of so many symbols that ends at each place; 0 where the text has fewer before."""
    out = [np.full(len(symbols), np.uint64(1))]
    for k in range(longest):
        beginning = np.append(np.uint64(1), out[-1][:-1]) if k else out[0]
        out.append(np.where(before >= k, _longer(beginning, symbols), np.uint64(0)) if len(symbols) else out[0])
    return out


@dataclass
class Known:
    """Runs in ascending order of their hashes, and a value of each."""

    runs: np.ndarray
    values: np.ndarray
    shift: int  # what is left of a hash after its leading bits
    starts: np.ndarray  # where the runs with each leading bits begin

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each run, and whether it is known; hashes are even, so few share their leading bits."""
        lead = (wanted >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        there = np.zeros(len(wanted), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.runs[at[left]] == wanted[left]
            there[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return at, there

    def value(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each run; NaN where it is not known."""
        at, there = self.find(wanted)
        out = np.full(len(wanted), np.nan)
        out[there] = self.values[at[there]]
        return out


def _sorted(runs: np.ndarray, values: np.ndarray) -> Known:
    """Known from runs in any order; of equal ones the first counts."""
    order = np.argsort(runs, kind="stable")
    runs, values = runs[order], values[order] if len(values) else values
    del order  # there may be millions
    again = runs[1:] == runs[:-1]
    if again.any():
        once = np.append(True, ~again)
        runs, values = runs[once], values[once] if len(values) else values
    bits = max(1, len(runs).bit_length())
    starts = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount((runs >> np.uint64(64 - bits)).astype(np.int32), minlength=1 << bits), out=starts[1:])
    return Known(runs, values, 64 - bits, starts)


def _known(rows: pa.Table | pa.RecordBatch) -> Known:
    """Of rows (run) or (run, value)."""
    values = rows.column("value").to_numpy(zero_copy_only=False) if "value" in rows.schema.names else np.zeros(0)
    return _sorted(rows.column("run").to_numpy().view(np.uint64), values.astype(np.float32, copy=False))


def told(texts: DataFrame, table: DataFrame, lengths: range, sent: int, work: Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Known]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work over (batch, symbols, places, known) for the pieces of texts (..., symbols last) of a task, where known has the rows of `table` (run, value) that the piece needs.

    A table of at most `sent` rows is sent whole; of a larger one each text gets, by a join, the rows of its runs of such lengths.
    """
    names, kinds = texts.columns, dict(texts.dtypes)
    if table.count() <= sent:
        shared = texts.sparkSession.sparkContext.broadcast(_known(table.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = itertools.chain.from_iterable(_pieces(x, len(names) - 1) for x in batches)
            yield from work((b, *_joined(parts), shared.value) for b, parts in pieces)

        return texts.mapInArrow(run, schema)

    def own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, parts in itertools.chain.from_iterable(_pieces(x, 1) for x in batches):
            symbols, before = _joined(parts)
            text, hashes = _text_of(parts), run_hashes(symbols, before, lengths[-1])
            every = np.concatenate([np.unique(np.stack((text[h > 0].astype(np.uint64), h[h > 0]), 1), axis=0) for h in (hashes[k] for k in lengths)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(every[:, 0].astype(np.int64))), pa.array(every[:, 1].view(np.int64))], ["rn", "run"])

    found = texts.select("rn", "symbols").mapInArrow(own_runs, "rn long, run long").join(table, "run")
    lists = found.groupBy(F.col("rn").alias("_rn")).agg(F.collect_list(F.struct(*table.columns)).alias("_known"))  # no longer than the text
    rows = texts.join(lists, F.col("rn") == F.col("_rn"), "left").select("_known", *names)

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = itertools.chain.from_iterable(_pieces(x, len(names)) for x in batches)
        yield from work((b.select(names), *_joined(parts), _known(pa.RecordBatch.from_struct_array(b.column(0).flatten()))) for b, parts in pieces)

    assert kinds["rn"] == "bigint"
    return rows.mapInArrow(run_own, schema)


def _counted(texts: DataFrame, contexts: DataFrame, length: int, sent: int) -> DataFrame:
    """(context, symbol, n): how often each symbol follows each of the contexts (run) of `length` symbols in training."""

    def summed(known: Known, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.append(first, len(key))), key[first]
        context = known.runs[key >> 32] if length else np.ones(len(key), np.uint64)
        made = [pa.array(context.view(np.int64)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int32))]
        return small([pa.RecordBatch.from_arrays(made, ["context", "symbol", "n"])], GATHER // 2)

    def work(pieces: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Known]]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, None  # of each symbol the place of its context and its number in one
        for _, symbols, before, own in pieces:
            if held and (size > 16 * GATHER or own is not known):
                yield from summed(known, held)
                held, size = [], 0
            known, at = own, np.flatnonzero(before >= length)
            if length:
                place, stay = known.find(run_hashes(symbols, before, length)[length][at - 1])
                held.append(place[stay].astype(np.int64) << 32 | symbols[at[stay]])
            else:
                held.append(symbols)
            size += len(held[-1])
        if held:
            yield from summed(known, held)

    schema = "context long, symbol int, n int"
    rows = told(texts.where("trains").select("rn", "symbols"), contexts.select("run"), range(max(length, 1), max(length, 1) + 1), sent, work, schema)
    return rows.groupBy("context", "symbol").agg(F.sum("n").alias("n"))  # summed in each task first, then dealt by both: no context is one task


def grow(texts: DataFrame, size: int, floor: float, depth: int, worth: float, worth_each: float, sent: int) -> DataFrame:
    """(run, symbols, n, cost, rise, weight), a kept table: the tree. Runs of one symbol have a cost each; the run of none is no row.

    A run in a state has its number n in training, cost, and rise: its cost less what it would be by the next shorter state; a state has the weight of shorter ones.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # ..., context, suffix of the context, symbol
            symbol = b.column(b.num_columns - 1).to_numpy().astype(np.uint64)
            run, suffix = (_longer(b.column(b.num_columns - k).to_numpy().view(np.uint64), symbol).view(np.int64) for k in (3, 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(run), pa.array(suffix)], [*b.schema.names[:-2], "run", "suffix"])

    none = texts.sparkSession.createDataFrame([(1,)], "run long")
    single = texts.sparkSession.range(size).select(F.col("id").cast("int").alias("symbol")).join(_counted(texts, none, 0, sent).drop("context"), "symbol", "left")
    single = single.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(1).cast("long").alias("context"), F.lit(1).cast("long").alias("ends"), "symbol")
    single = stage_table(single.mapInArrow(named, "n long, context long, run long, suffix long").select("run", "n"), "symbols")
    total = single.agg(F.sum("n")).first()[0]
    chance = single.select("run", ((F.col("n") + 0.5) / F.lit(total + 0.5 * size)).alias("p"), "n", F.lit(0.0).cast("float").alias("rise"))  # of the last symbol of runs whose beginning is a state
    tree = lambda rows, length, **have: rows.select(
        "run", F.lit(length).alias("symbols"), *(have.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("n", "long"), ("cost", "float"), ("rise", "float"), ("weight", "float")))
    )
    costs = lambda rows, length: tree(rows, length, n=F.col("n"), cost=F.log10("p"), rise=F.col("rise"))
    grown = costs(chance, 1)
    contexts = stage_table(single.where(F.col("n") >= floor).select("run", F.lit(1).cast("long").alias("suffix"), F.col("n").alias("total")), "contexts")
    for length in range(1, depth + 1):
        with scratch(texts.sparkSession):  # what only this level needs goes at its end
            often = stage_table(_counted(texts, contexts, length, sent).where("n > 1"), "often")  # a table, so that the shuffle of all counts goes before the next ones
            ends = contexts.withColumnRenamed("run", "context")
            ends = F.broadcast(ends) if ends.count() <= min(sent, JOINED) else ends
            met = often.join(ends, "context").select("n", "total", "context", F.col("context").alias("_context"), "suffix", "symbol")
            met = met.mapInArrow(named, "n long, total long, context long, _context long, run long, suffix long").drop("_context")
            rated = met.join(chance.select(F.col("run").alias("suffix"), "p"), "suffix", "left")
            rated = rated.withColumn("suffix", F.when(F.col("n") >= floor, F.col("suffix")))  # only contexts of the next level need it
            known = F.col("p").isNotNull()  # else the context without its first symbol is no state, and this one cannot be
            own = Window.partitionBy("context")  # no more rows than there are symbols
            over = lambda x: F.coalesce(F.sum(F.when(known, x)).over(own), F.lit(0))
            tested = rated.withColumns({"often": over(F.lit(1)), "once": F.col("total") - over(F.col("n")), "q": over(F.col("p")), "s": over(F.col("n") * F.log(F.col("n") / (F.col("total") * F.col("p"))))})
            once = F.col("once")
            gain = F.col("s") + F.when(once > 0, once * F.log(once / (F.col("total") * F.greatest(1 - F.col("q"), F.lit(1e-12))))).otherwise(0.0)
            whole, m = F.col("total") + F.col("often") + once, F.col("often") + 2 * once
            state = known & (gain >= worth + worth_each * F.col("often"))
            kept = tested.select("n", "context", "run", "suffix", F.col("p").alias("_p"), F.when(state, F.log10(m / whole)).alias("weight"), F.when(state, (F.col("n") + m * F.col("p")) / whole).alias("p"))
            kept = kept.withColumn("rise", (F.log10("p") - F.log10("_p") - F.col("weight")).cast("float")).drop("_p")
            kept = stage_table(kept.where(F.col("p").isNotNull() | (F.col("n") >= floor)), "kept")  # rows of states, and contexts of the next level
            states = stage_table(kept.where("p is not null").groupBy(F.col("context").alias("run")).agg(F.first("weight").alias("weight")), "states", keep=True)
            new = stage_table(kept.where("p is not null").select("run", "p", "n", "rise"), "chances", keep=True)
            longer = stage_table(kept.where(F.col("n") >= floor).select("run", "suffix", F.col("n").alias("total")), "contexts", keep=True)
        grown = grown.unionByName(costs(new, length + 1)).unionByName(tree(states, length, weight=F.col("weight")))
        chance, contexts = new, longer
        if states.isEmpty() or contexts.isEmpty():
            break
    return stage_table(grown, "tree", keep=True)


def hot_from(tree: DataFrame, sent: int) -> int | None:
    """The number in training from which on runs of two symbols and more are sent: at most `sent` of them; none if all are."""
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    rows, left, least = tree.where("symbols > 1 and cost is not null").groupBy(step.alias("n")).count().collect(), sent, 2**62  # about a thousand at most
    for r in sorted(rows, reverse=True):
        left -= r["count"]
        if left < 0:
            return least
        least = r["n"]
    return None


def symbol_costs(symbols: np.ndarray, before: np.ndarray, states: Known, hot: Known, others: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log10 probability of each symbol of texts in a row, in the state of its longest suffix, as far as hot runs tell it; places and hashes of the longer runs that may be in the filter `others`.

    What occurs often is no longer than what occurs more often, so each of those adds its rise, whatever the others.
    """
    hashes = run_hashes(symbols, before, depth + 1)
    out = hot.value(hashes[1])
    at, places, runs = np.arange(len(symbols)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for length in range(2, depth + 2):
        at = at[before[at] >= length - 1]
        weight = states.value(hashes[length - 1][at - 1])
        state = ~np.isnan(weight)
        at, weight = at[state], weight[state]
        if not len(at):
            break
        run = hashes[length][at]
        cost = hot.value(run)
        out[at] = np.where(np.isnan(cost), out[at] + weight, cost)
        if len(others):
            more = np.flatnonzero(np.isnan(cost))
            more = more[_in(others, run[more].view(np.int64) >> 1)]
            places.append(at[more])
            runs.append(run[more])
    return out, np.concatenate(places), np.concatenate(runs)


def score_symbols(texts: DataFrame, tree: DataFrame, depth: int, sent: int) -> tuple[DataFrame, DataFrame | None]:
    """(rn, id, n_tokens, known, logs, cost, tree, others), staged, and (rn, rise), staged, to be added to `tree` if there are runs that are not sent.

    The runs that occur most often, `sent` at most, are sent; of the others a filter of bounded size, and what passes it is joined to them.
    """
    least = hot_from(tree, sent)
    runs = tree.where("cost is not null")
    frequent = runs if least is None else runs.where((F.col("symbols") == 1) | (F.col("n") >= least))
    shared = texts.sparkSession.sparkContext.broadcast(_known(frequent.select("run", F.col("cost").alias("value")).toArrow()))
    rest = None if least is None else runs.where((F.col("symbols") > 1) & (F.col("n") < least)).select("run", "rise")
    filter_ = None if rest is None else _bitmap(rest.select(F.shiftright("run", 1).alias("hash")))

    def work(pieces: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Known]]) -> Iterator[pa.RecordBatch]:
        others = np.zeros(0, np.uint8) if filter_ is None else filter_.value
        for b, symbols, before, states in pieces:
            starts = np.flatnonzero(before == 0)
            costs, place, run = symbol_costs(symbols, before, states, shared.value, others, depth)
            each = np.add.reduceat(costs, starts) if len(starts) else np.zeros(0)
            owner = np.searchsorted(starts, place, "right") - 1
            order = np.argsort(owner, kind="stable")
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(each), _lists(run[order].view(np.int64), owner[order], len(starts), pa.int64())], ["rn", "id", "n_tokens", "known", "logs", "cost", "tree", "others"])

    kind = dict(texts.dtypes)["id"]
    states = tree.where("weight is not null").select("run", F.col("weight").alias("value"))
    scored = told(
        texts.select("rn", "id", "n_tokens", "known", "logs", "cost", "symbols"), states, range(1, depth + 1), sent, work,
        f"rn long, id {kind}, n_tokens long, known long, logs double, cost double, tree double, others array<long>",
    )
    scored = stage_table(scored, "scored")
    shared.destroy()
    if rest is None:
        return scored, None
    met = scored.select("rn", F.explode("others").alias("run")).join(rest, "run")
    return scored, stage_table(met.groupBy("rn").agg(F.sum("rise").alias("rise")), "rises")


def score_texts(
    docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
    own: float = 200.0, common: float = 2e-6, rare: float = 512.0, depth: int = 4, worth: float = 10.0, worth_each: float = 1.0, sent: int = 6_000_000,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row; `trains` tells the rows to learn from.

    base_score is the text's log10 probability under add-one word frequencies, score that under the tree.
    """
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):  # of the words only each text's sums stay
            words = vocabulary(docs, text_col, trains)
            n, v = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
            known, rated = alphabet(words, n, max(1.0, n**0.75 / own), common)
            texts = read_texts(docs, known, id_col, text_col, trains)
            rare_words = texts.select("rn", F.explode("rare").alias("hash")).join(rated, "hash")
            sums = rare_words.groupBy("rn").agg(
                F.count_if(F.col("count") > 0).alias("more"), F.sum(F.log10(F.col("count") + 1.0)).alias("more_logs"), F.sum("cost").alias("more_cost")
            )
            sums = stage_table(sums, "sums", keep=True)
        with scratch(docs.sparkSession):  # of the levels only the tree stays
            tree = grow(texts, known.size, max(2.0, n**0.6 / rare), depth, worth, worth_each, sent)
        scored, rises = score_symbols(texts, tree, depth, sent)
        zero = lambda c: F.coalesce(c, F.lit(0))
        scored = scored.withColumn("rise", F.lit(0.0)) if rises is None else scored.join(rises, "rn", "left")
        found = scored.join(sums, "rn", "left").select(
            "id", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
            (F.col("tree") + zero("rise") + F.col("cost") + zero("more_cost")).alias("score"),
        )
        return stage_table(found, "scores", keep=True)
