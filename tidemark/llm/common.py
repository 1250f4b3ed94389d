"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch, table  # noqa: F401
from tidemark.session import staged as stage_table  # noqa: F401

#: Rows with one key from which on they are too many for one task.
HEAVY = 100_000
#: Words are runs of anything but ASCII white space; Java and Spark SQL read this pattern alike.
WORD_GAP = r"[\x20\x09-\x0D]+"


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that what a task unpacks at once stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh_name(taken: list[str], wanted: str) -> str:
    """`wanted`, with underscores appended until no column is called so (names compare without case)."""
    lower = {x.lower() for x in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used in there."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """The text with A to Z in lower case and everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_of_id(id_col: str = "doc_id"):
    """crc32 of the id written as text, as the held-out folds use it; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def join_heavy(left: DataFrame, right: DataFrame, key: str | list[str], heavy: Column) -> DataFrame:
    """Inner join on `key`, unique in `right`, of which some keys occur very often in `left`.

    `heavy` marks those in `right`; the caller vouches that they are few (what occurs at least HEAVY times in a table of n rows is at
    most n / HEAVY keys). They are broadcast, so their rows in `left` stay where they are; the rest is merged by key.
    """
    few = right.where(heavy)
    rest = left.join(F.broadcast(few.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.where(~heavy).hint("merge"), key)
    return left.join(F.broadcast(few), key).select(*rest.columns).union(rest)
