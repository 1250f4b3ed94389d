"""Token counts of the fields and sections of documents, from one encoding of the whole.

A document's fields are joined by line breaks into one record, which is encoded once; a token's span in
bytes follows from the lengths of the tokens before it. Each field is a section, the last field has one
for each of its lines; a line break belongs to the section it ends. Token spans are joined to section spans by
bisection, and a token that crosses a boundary goes to one section by an explicit rule:

* "start": to the section that holds its first byte,
* "end": to the section that holds its last byte,
* "most": to the section that holds most of its bytes, of equals the first.

So the counts of a document's sections add up to its tokens. Everything is a map over rows; nothing is shuffled,
and the vocabulary, bounded by its file, is broadcast.

Edge cases: null fields are empty and still have a section, of no bytes but the line break after it. Where all fields are empty
the line breaks alone are encoded. Repeated rows are counted each. Only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small

RULES = ("start", "end", "most")
_built: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and their ids from a rank file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f)]


def encoder(ranks: list[tuple[bytes, int]], pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and the length in bytes of each token; built once in a Python worker."""
    key = hash((pattern, len(ranks), ranks[-1]))
    if key not in _built:
        length = np.zeros(max(r for _, r in ranks) + 1, np.int64)
        for token, rank in ranks:
            length[rank] = len(token)
        _built[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={}), length
    return _built[key]


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and which tokens cross a boundary; `sections` holds where sections start, of equal starts the last is meant."""
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    out = first.copy()
    for t in np.flatnonzero(crossing).tolist():
        cuts = [start[t], *sections[first[t] + 1 : last[t] + 1], end[t]]
        out[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return out, crossing


def count_tokens(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "most"
) -> DataFrame:
    """(id, section, field, start, end, n_tokens, n_crossing, doc_tokens): a row for each section of each document.

    start and end are places in the record in bytes; n_crossing counts those of the section's tokens that reach into another.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = encoder(shared.value, pattern)
        names = np.array(fields)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            cols = [np.concatenate([r[i] for r in rows]) for i in range(1, 7)]
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner + first)), pa.array(cols[0], pa.int32()), pa.array(names[cols[1]].tolist(), pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:]),
                 pa.array(np.array([r[7] for r in rows], np.int64)[owner])],
                ["id", "section", "field", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
            )

        for b in small(batches):
            ids, texts, rows, first, size = b.column(0), [c.to_pylist() for c in b.columns[1:]], [], 0, 0
            for i, parts in enumerate(zip(*texts, strict=True)):
                record = "\n".join(parts)
                flat = np.frombuffer(record.encode(), np.uint8)
                begin = np.cumsum([0, *(len(p.encode()) + 1 for p in parts[:-1])])
                lines = begin[-1] + 1 + np.flatnonzero(flat[begin[-1] :] == 10)
                sections = np.concatenate((begin, lines))
                field = np.minimum(np.arange(len(sections)), len(fields) - 1)
                end = np.cumsum(length[encoding.encode_to_numpy(record, disallowed_special=())])
                start = np.concatenate(([0], end[:-1])) if len(end) else end
                at, crossing = attribute(start, end, sections, rule)
                n = len(sections)
                rows.append((i, np.arange(n), field, sections, np.append(sections[1:], len(flat)), np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n), len(end)))
                size += len(flat)
                if size >= 1 << 21:
                    yield batch(rows)
                    rows, first, size = [], i + 1, 0
            if rows:
                yield batch(rows)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"field{i}") for i, c in enumerate(fields)]
    rows = docs.select(F.col(id_col).alias("id"), *columns)
    return rows.mapInArrow(
        run, f"id {rows.dtypes[0][1]}, section int, field string, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    )
