"""Document quality by co-training two views: the text, and the metadata of the page.

Each view has a logistic classifier; the text's sees counts of its kinds of characters and words, and its words themselves, hashed to
`LEXICAL` slots. Over some rounds the two score all documents that are not in the labelled sample: the `per_round` of each class
that one is surest of, anywhere in the corpus, join the other's training rows at half weight.
Then each view is calibrated on labelled rows that it did not learn from, and the calibrated log odds
are added, less the prior's that both contain, to one score for every document.

Scale: features are computed once and staged, some dozens of numbers a document; rows with equal features, so all exact copies, stand for one.
A round is a scan of them: each task keeps its surest rows, of which Spark takes the surest of all. The labelled sample, about
`sample` rows of the training fold (crc32 of the id is no multiple of 5), thinned by a hash of the id, and the rows taught are bounded
and fitted on the driver. Scoring is a map over all rows; nothing is shuffled.

Edge cases: a null or empty text has features of its own (all zero) and a score; null metadata is a value like others.
Labels other than 0 and 1 and those without an id do not teach; equal labels of one id count once, an id with both labels does not
teach; of several rows with one id the one whose text has the least hash teaches. Rows without an id are scored and can be taught from.
Without labels of both classes the score is 1 for all: nothing is rejected. Repeated rows are scored alike.
Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, scratch, small, stage_table
from tidemark.llm.logistic import fit_logistic, sigmoid
from tidemark.llm.substrings import WordBatch, _pieces
from tidemark.llm.toxicity import one_each, training_rows

_WHITE = np.array([32, 9, 10, 11, 12, 13])
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SIGNS = np.array([ord(c) for c in "#$%&*+<=>@\\^_`~"])
SLOTS = 32
#: Slots that the words of a text are hashed to.
LEXICAL = 64


def content_features(text: bytes | None) -> list[float]:
    """Numbers that describe a text: lengths, repetition, and shares of kinds of characters and words."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * 16
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(kinds[_UPPER].sum() + kinds[_LOWER].sum()))
    visible = max(1, len(text) - int(kinds[_WHITE].sum()))
    distinct = len(set(words))
    same = [a == b for a, b in zip(words, words[1:])]  # noqa: B905
    longest = run = 0
    for s in same:
        run = run + 1 if s else 0
        longest = max(longest, run)
    lines = text.split(b"\n")
    odd = sum(not (c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b".,") for c in (w[-1] for w in words))
    return [
        np.log1p(n), visible / n, distinct / n, np.log(distinct) / np.log(n + 1), sum(same) / n, (longest + 1) / n,
        int(kinds[_UPPER].sum()) / letters, int(kinds[_DIGIT].sum()) / visible, int(kinds[33]) / n, int(kinds[124]) / n,
        int(kinds[_SIGNS].sum()) / n, odd / n, int(kinds[46]) / n, int(kinds[44]) / n, len(set(lines)) / len(lines), int(kinds[128:].sum()) / visible,
    ]


def content_batch(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text: `content_features`, and the share of words in each slot, counted with the sign of their hash."""
    w = WordBatch(texts, lower=True)
    slot, sign = (w.hash >> np.uint64(8)) % np.uint64(LEXICAL), np.where(w.hash & np.uint64(1), 1.0, -1.0)
    lexical = np.bincount(w.doc * LEXICAL + slot.astype(np.int64), sign, len(texts) * LEXICAL).reshape(-1, LEXICAL)
    return np.hstack((np.array([content_features(t) for t in texts]), lexical / np.maximum(np.diff(w.first), 1)[:, None])).astype(np.float32)


def metadata_features(values: tuple) -> list[float]:
    """Numbers as logarithms, other values as slots of a hash."""
    out: list[float] = []
    for v in values:
        if isinstance(v, (int, float)):
            out += [float(np.log1p(max(v, 0))), 0.0]
        elif v is None:
            out += [0.0, 1.0]
        slots = [0.0] * SLOTS
        if isinstance(v, str):
            out += [0.0, 0.0]
            slots[zlib.crc32(v.encode()) % SLOTS] = 1.0
        out += slots
    return out


@dataclass
class QualityModel:
    """Coefficients of each view, their calibration (slope and intercept), and the prior's log odds."""

    views: dict[str, list[float]] = field(default_factory=dict)
    calibration: dict[str, list[float]] = field(default_factory=dict)
    prior: float = 0.0


def _apply(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def _numbers(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _features(rows: DataFrame, columns: list[str], text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """`columns` of the rows with both views' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for batch in batches:
            for b, texts in _pieces(batch, n):
                meta = np.array([metadata_features(x) for x in zip(*(c.to_pylist() for c in b.columns[n + 1 :]), strict=True)], np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], _numbers(content_batch(texts)), _numbers(meta)], [*columns, "content", "metadata"])

    chosen = rows.select(*columns, F.col(text_col).cast("string").cast("binary").alias("_text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(metadata)])
    schema = "".join(f"`{c}` {dict(chosen.dtypes)[c]}, " for c in columns)
    return chosen.mapInArrow(run, f"{schema}content array<float>, metadata array<float>")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The lists, all of one length, as rows of numbers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


VIEWS = ("content", "metadata")


def surest(pool: DataFrame, fitted: dict[str, np.ndarray], per_round: int, sure: float, taught: dict[str, list[int]]) -> dict[str, pa.Table]:
    """(key, label, content, metadata) by view: the rows of `pool` (key, content, metadata) that the view is surest of, `per_round` of each class at most, and that its other has not been taught."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, float], pa.Table] = {}
        for b in batches:
            for v, other in zip(VIEWS, reversed(VIEWS), strict=True):
                p = sigmoid(_apply(_matrix(b.column(VIEWS.index(v) + 1)), fitted[v]))
                free = ~np.isin(b.column(0).to_numpy(), taught[other])
                for label in (1.0, 0.0):
                    chance = p if label else 1 - p
                    at = np.flatnonzero(free & (chance >= sure))
                    own = pa.Table.from_batches([b.take(pa.array(at))]).append_column("chance", pa.array(chance[at]))
                    own = pa.concat_tables([held[v, label], own]) if (v, label) in held else own
                    held[v, label] = own.sort_by([("chance", "descending"), ("key", "ascending")]).slice(0, per_round)
        for (v, label), own in held.items():
            own = own.append_column("view", pa.array([v] * len(own), pa.string())).append_column("label", pa.array([label] * len(own), pa.float64()))
            yield from own.combine_chunks().to_batches()

    schema = "key long, content array<float>, metadata array<float>, chance double, view string, label double"
    found = stage_table(pool.select("key", *VIEWS).mapInArrow(run, schema), "surest")
    best = None
    for v in VIEWS:
        for label in (1.0, 0.0):
            own = found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.desc("chance"), "key").limit(per_round)
            best = own if best is None else best.union(own)
    rows = best.toArrow()
    view = np.array(rows.column("view").to_pylist())
    return {v: rows.filter(pa.array(view == v, pa.bool_())) for v in VIEWS}


def co_train(x: dict[str, np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int, per_round: int, sure: float) -> dict[str, np.ndarray]:
    """Coefficients of both views after they have taught each other."""
    taught = {v: (np.zeros((0, x[v].shape[1])), np.zeros(0)) for v in x}
    keys: dict[str, list[int]] = {v: [] for v in x}
    fitted: dict[str, np.ndarray] = {}
    for turn in range(rounds + 1):
        for v in x:
            rows, label = taught[v]
            weight = np.concatenate((np.ones(len(y)), np.full(len(rows), 0.5)))
            fitted[v] = fit_logistic(np.vstack((x[v], rows)), np.concatenate((y, label)), weight)
        if turn == rounds:
            break
        found = surest(pool, fitted, per_round, sure, keys)
        for v, other in zip(VIEWS, reversed(VIEWS), strict=True):
            if len(found[v]):
                rows, label = taught[other]
                taught[other] = np.vstack((rows, _matrix(found[v].column(other).combine_chunks()))), np.append(label, found[v].column("label").to_numpy())
                keys[other] += found[v].column("key").to_pylist()
    return fitted


def learn_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    metadata: tuple[str, ...] = ("source", "lang", "n_chars"), sample: int = 8000, rounds: int = 3, per_round: int = 500, sure: float = 0.95,
) -> QualityModel:
    """Fit both views from labelled rows of the training fold and from what each is sure of in all other rows."""
    trains = F.pmod(crc_of_id(id_col), F.lit(5)) != 0
    docs = docs.select(id_col, text_col, *metadata)
    labelled = training_rows(docs, labels, label, trains, id_col, text_col, sample)
    found = _features(labelled.select(F.col(id_col).cast("long").alias("_id"), "y", text_col, *metadata), ["_id", "y"], text_col, metadata).toArrow().sort_by("_id")
    y, ids = found.column("y").to_numpy(), found.column("_id").to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel()
    x = {v: _matrix(found.column(v).combine_chunks()) for v in VIEWS}
    used = F.broadcast(labelled.select(F.col(id_col).alias("_used")))  # the bounded sample
    others = _features(docs.join(used, F.col(id_col) == F.col("_used"), "left_anti"), [], text_col, metadata)
    key = F.xxhash64(*VIEWS)
    fold = np.array([zlib.crc32(b"%d" % i) // 5 % 5 == 0 for i in ids.tolist()], bool)
    fit, check = ~fold, fold
    if len(set(y[fit].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        check = fit = np.ones(len(y), bool)
    with scratch(docs.sparkSession):
        pool = stage_table(one_each(others.select(key.alias("key"), *VIEWS), F.col("key"), F.col("key")), "pool")
        fitted = co_train({v: m[fit] for v, m in x.items()}, y[fit].astype(float), pool, rounds, per_round, sure)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = QualityModel({v: b.tolist() for v, b in fitted.items()}, {}, float(np.log(mean / (1 - mean))))
    for v, b in fitted.items():
        odds = np.clip(_apply(x[v][check], b), -10, 10)
        slope, cut = fit_logistic(odds[:, None], y[check].astype(float))
        # a view that runs against the labels, or says nothing, is left out
        model.calibration[v] = [float(slope), float(cut)] if slope > 0 else [0.0, model.prior]
    return model


def _scores(model: QualityModel, content: np.ndarray, meta: list) -> list[np.ndarray]:
    """Combined, content and metadata scores of a batch."""
    odds = {}
    for v, rows in (("content", content), ("metadata", meta)):
        if v in model.views and len(rows):
            slope, cut = model.calibration[v]
            odds[v] = slope * np.clip(_apply(np.array(rows, float), np.array(model.views[v])), -10, 10) + cut
    if not odds:
        return [np.ones(len(meta))] * 3
    both = sum(odds.values()) - (len(odds) - 1) * model.prior
    return [sigmoid(both), *(sigmoid(x) for x in odds.values())]


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars")
) -> DataFrame:
    """(id, score, content_score, metadata_score) for each row: probabilities of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _pieces(batch, 1):
                meta = [metadata_features(x) for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                scores = _scores(model, content_batch(texts), meta)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s) for s in scores)], ["id", "score", "content_score", "metadata_score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(metadata)])
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, score double, content_score double, metadata_score double")


def reject_poor(
    docs: DataFrame, model: QualityModel, text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars"), threshold: float = 0.5
) -> DataFrame:
    """The rows of `docs` that score at least the threshold, as they are."""
    names = [c.lower() for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            texts = [x or b"" for x in b.column(names.index(text_col.lower())).cast(pa.binary()).to_pylist()]
            meta = [metadata_features(x) for x in zip(*(b.column(names.index(c.lower())).to_pylist() for c in metadata), strict=True)]
            yield b.filter(pa.array(_scores(model, content_batch(texts), meta)[0] >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
