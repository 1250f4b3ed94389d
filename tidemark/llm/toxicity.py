"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded texts.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and the digits and signs
that stand in for letters to Latin letters, drops invisible characters and turns everything else into spaces.
The lexicon holds word beginnings, each weighted by its smoothed log odds between toxic and clean
documents; exception phrases are words, or two words in a row, that hold a lexicon entry but occur
in clean documents at least as often as in toxic ones; what lies in one does not count. A document's weighted
hits are normalised by its length, and a small logistic curve turns them into a score.

Learning uses a bounded sample: rows of `labels` in the training fold, thinned by a hash of the id to about
`sample` rows. Everything learned (lexicon, exceptions, curve) is bounded by it and small enough to broadcast.
Scoring is a map over all rows: nothing is shuffled. What limits the lexicon are parameters of `learn`: `entries` of it at most, beginnings of
`shortest` to `longest` letters, in `rarest` of the toxic sample at least (and three of its texts), with evidence of `sure` or more.

Edge cases: labels other than 0 and 1 and labels or rows without an id do not teach. Equal labels of one id count once; an id with
both labels does not teach. Of several rows with one id the one whose text has the least hash teaches. Null and empty texts get a score like any text without hits. Repeated rows are scored alike.
Without a toxic or a clean label the score is 0. Only the named columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, small
from tidemark.llm.logistic import fit_logistic, sigmoid

# Signs that stand in for Latin letters, then look-alike letters of Cyrillic and Greek.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "г": "r", "п": "n", "и": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ʀ": "r", "ß": "ss", "æ": "ae", "œ": "oe",
}

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
#: Lengths of the word beginnings that can enter the lexicon, where nothing else is asked for.
SHORTEST, LONGEST = 4, 10


class _Folding(dict):
    """The folded form of each character, found when it is first met."""

    def __missing__(self, code: int) -> str:
        shown = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
                continue
            c = STAND_INS.get(c, LOOK_ALIKES.get(c, c))
            shown += c if LETTERS.issuperset(c) else (c if c.isalpha() else " ")
        self[code] = shown
        return shown


_FOLDING = _Folding()


def fold(text: str) -> str:
    """The folded words of a text, each between single spaces."""
    return " " + " ".join(text.translate(_FOLDING).split()) + " "


def _beginnings(folded: str, shortest: int = SHORTEST, longest: int = LONGEST) -> set[str]:
    return {w[:k] for w in set(folded.split()) for k in range(shortest, min(len(w), longest) + 1)}


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases and the curve from hits to scores."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)

    def machine(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found


def hits(machine: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """The weighted hits of a folded text and their number, less those inside exception phrases; of entries that begin at one place the heaviest counts."""
    if not len(machine):
        return 0.0, 0
    terms: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight:
            terms[start] = max(weight, terms.get(start, 0.0))
        else:
            excepted.append((start, end))
    for start, end in excepted:
        for at in [t for t in terms if start <= t < end]:
            del terms[at]
    return sum(terms.values()), len(terms)


def features(total: float, n: int, words: int) -> list[float]:
    """What the curve sees: weighted hits as such and normalised by length."""
    return [math.log1p(total), math.log1p(1000 * total / max(words, 1)), float(min(n, 3)), math.log1p(words)]


def _log_odds(a: int, b: int, toxic: int, clean: int) -> tuple[float, float]:
    """Smoothed log odds between a of toxic and b of clean documents, and the signed root of the likelihood ratio against equal rates."""
    odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    rate, ratio = (a + b) / (toxic + clean), 0.0
    for seen, of in ((a, toxic), (b, clean)):
        ratio += sum(x * math.log(x / (of * p)) for x, p in ((seen, rate), (of - seen, 1 - rate)) if x)
    return odds, math.copysign(math.sqrt(max(0.0, 2 * ratio)), odds)


def _choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int, sure: float, entries: int, shortest: int) -> dict[str, float]:
    """The strongest entries none of which is a beginning of another; of equals the longer is kept."""
    ranked = []
    for term, (a, b) in counts.items():
        odds, z = _log_odds(a, b, toxic, clean)
        if z >= sure and odds > 1:
            ranked.append((-round(z, 6), -len(term), term, odds))
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, term, odds in sorted(ranked):
        if term not in begun and not any(term[:k] in chosen for k in range(shortest, len(term))):
            chosen[term] = odds
            begun.update(term[:k] for k in range(shortest, len(term)))
            if len(chosen) == entries:
                break
    return chosen


def _count(rows: DataFrame, terms, name: str = "term") -> DataFrame:
    """(term, toxic, clean): documents of either label that hold each term of terms(folded text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in small(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[1 - toxic].update(terms(fold(text)))
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["term", "toxic", "clean"])

    out = rows.mapInArrow(run, "term string, toxic long, clean long")
    return out.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def one_each(rows: DataFrame, by: Column, order: Column) -> DataFrame:
    """Of the rows that `by` tells alike the one with the least `order`; rows for which it is null go."""
    kept = rows.columns
    first = rows.withColumns({"_by": by, "_order": order}).where("_by is not null").groupBy("_by").agg(F.min_by(F.struct(*kept), "_order").alias("_row"))
    return first.select("_row.*")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold_of: Column, id_col: str, text_col: str, sample: int) -> DataFrame:
    """The labelled rows of `docs` that `fold_of` lets learn, about `sample` of them at most, with the label in column y.

    Rows are chosen by a hash of the id, one for each id; the chosen labels are bounded by the sample and broadcast.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & fold_of).groupBy(F.col(id_col).alias("_labelled"))
    usable = usable.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_most")).where("y = _most").drop("_most")
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_labelled", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    found = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_labelled")).drop("_labelled")
    return one_each(found, F.col(id_col), F.xxhash64(text_col))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    sample: int = 8000, sure: float = 4.5, entries: int = 1000, shortest: int = SHORTEST, longest: int = LONGEST, rarest: float = 0.005,
) -> Lexicon:
    """Learn the lexicon from labelled rows whose crc32 of the id is no multiple of 5."""
    trains = F.pmod(crc_of_id(id_col), F.lit(5)) != 0
    rows = training_rows(docs.select(id_col, text_col), labels, label, trains, id_col, text_col, sample)
    rows = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), "y").persist()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        return Lexicon()
    beginnings = lambda folded: _beginnings(folded, shortest, longest)
    likely = {r["term"] for r in _count(rows.where("y = 1"), beginnings).where(F.col("toxic") >= max(3.0, rarest * toxic)).collect()}
    seen = _count(rows, lambda folded: beginnings(folded) & likely)
    found = Lexicon(_choose({r["term"]: (r["toxic"], r["clean"]) for r in seen.collect()}, toxic, clean, sure, entries, shortest))
    if found.weights:
        stems = found.weights

        def contexts(folded: str) -> set[str]:
            words, out = folded.split(), set()
            for i, w in enumerate(words):
                if any(w[:k] in stems for k in range(shortest, min(len(w), longest) + 1)):
                    out.add(w)
                    out.add(" ".join(words[i : i + 2]))
                    out.add(" ".join(words[max(i - 1, 0) : i + 1]))
            return out

        odd = _count(rows, contexts).where(F.col("clean") >= 3).collect()
        found.exceptions = sorted(r["term"] for r in odd if r["toxic"] / toxic <= r["clean"] / clean)
    plain = _hits(rows.withColumn("id", F.col("y")), found, "id", "text").collect()
    x = np.array([features(r["total"], r["n"], r["words"]) for r in plain])
    found.curve = fit_logistic(x, np.array([r["id"] for r in plain], float)).tolist()
    rows.unpersist()
    return found


def _hits(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """(id, total, n, words, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, curve = lexicon.machine(), np.array(lexicon.curve)
        for b in small(batches):
            found = []
            for text in b.column(1).to_pylist():
                folded = fold(text)
                found.append((*hits(machine, folded), folded.count(" ") - 1))
            total, n, words = (np.array(c) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
            score = np.zeros(len(found))
            if len(curve) and found:
                score = sigmoid(np.array([features(*x) for x in found]) @ curve[:-1] + curve[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.float64()), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(score)],
                ["id", "total", "n", "words", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, total double, n long, words long, score double")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits, weight) for each row of `docs`: score from 0 to 1, higher for likelier toxic."""
    return _hits(docs, lexicon, id_col, text_col).select("id", "score", F.col("n").alias("n_hits"), F.col("total").alias("weight"))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below the threshold, as they are."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, curve = lexicon.machine(), np.array(lexicon.curve)
        for b in small(batches):
            stay = []
            for text in b.column(at).to_pylist():
                folded = fold(text or "")
                seen = np.array(features(*hits(machine, folded), folded.count(" ") - 1))
                stay.append(not len(curve) or float(sigmoid(seen @ curve[:-1] + curve[-1])) < threshold)
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
