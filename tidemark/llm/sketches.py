"""Document fingerprints as threshold-scaled sketches, in DataFrame and SQL functions only.

A text's words are lower-cased; each run of `width` words is hashed (a shorter text: all its words), and
every hash below a fixed fraction of the range is kept. Unlike a sketch of fixed size it grows with the
text, so the sketch of a union is the union of sketches, and the share of a small text that lies in a
very large one can be told. `likeness` is the estimated Jaccard similarity, `containment` the share of the first
sketch that is in the second. A text with words but no hash below the threshold keeps its least hash alone, which lies above the threshold
and is known by that. So a sketch is the kept hashes of a text, or else the least of all, and both merge exactly: `merged` drops a least hash
beside kept ones and takes the lesser of two, which is the sketch of both texts together. `containment` is null for a least hash, as nothing can be told.

`with_next` puts beside each row the values of the next one in descending id order, without gathering rows in one task: the
order is cut into stretches at places taken from a sample of the rows, which decide nothing but the stretches' sizes, and the first row of
the next stretch is added to each before a window over the stretch looks ahead. Places compare whole (null, id, hash of the text, number of the
row), so neither outlying ids nor an id, a missing id or a row that very many share crowd a stretch. At most `ranges` places are sent, or one for each 20,000 rows: four numbers each.

Edge cases: null texts count as empty. A text without words has an empty sketch; two empty sketches are
alike (1), an empty and another are not (0). Equal ids stand in the order of their texts' hashes, equal rows in
any; null ids come last; ids may be any long. An only row is its own successor. Only the two named columns are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_GAP

#: One hash in SCALE is kept.
SCALE = 8


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; an empty array for none."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def sketch(text: Column, width: int = 5, scale: int = SCALE) -> Column:
    """The sorted distinct hashes below 1/scale of the range, of all runs of `width` words."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def below(h: Column) -> Column:
        n = F.size(h)
        runs = F.when(
            n >= width,
            F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])),
        ).when(n > 0, F.array(F.xxhash64(h)))
        runs = F.coalesce(runs, F.array().cast("array<bigint>"))
        return F.transform(F.array(runs), lambda r: _kept(r, scale))[0]

    return F.transform(F.array(hashes), below)[0]


def _limit(scale: int) -> Column:
    return F.lit(-(2**63) + 2**64 // scale - 1).cast("long")


def _kept(runs: Column, scale: int) -> Column:
    low = F.array_sort(F.array_distinct(F.filter(runs, lambda x: x <= _limit(scale))))
    return F.when((F.size(low) == 0) & (F.size(runs) > 0), F.array(F.array_min(runs))).otherwise(low)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the first text's runs that the second has too; null if the first has no hash below 1/scale of the range, but words."""
    share = F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return F.when((F.size(a) == 0) | (F.array_min(a) <= _limit(scale)), share)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts' runs of words."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts together; `scale` is that of their sketches."""
    return F.transform(F.array(F.array_union(a, b)), lambda both: _kept(both, scale))[0]


def as_string(x: Column) -> Column:
    """A sketch as text: the last 24 bits of each hash, in base64, four letters each. Two hashes are mistaken once in 16 million."""
    bits = F.array_join(F.transform(x, lambda h: F.right(F.lpad(F.hex(h), 16, "0"), F.lit(6))), "")
    return F.translate(F.base64(F.unhex(bits)), "\r\n", "")


def _stretches(rows: DataFrame, place: list[str], ranges: int, rows_each: int, oversample: int = 20, most: int = 20_000) -> Column:
    """The number of the stretch that a row lies in, by its `place` columns: places are looked up in blocks. There is one for each `most` rows at least."""
    n = rows.count()
    wanted = max(min(ranges, n // rows_each + 1), n // most)
    share = min(1.0, oversample * wanted / max(1, n))
    seen = sorted(tuple(r) for r in rows.select(*place).sample(share, 17).collect())  # about oversample * ranges at most
    cuts = sorted(set(seen[:: max(1, len(seen) // wanted)]))
    block = max(64, math.isqrt(len(cuts)))
    kind = "struct<" + ",".join(f"p{i}:bigint" for i in range(len(place))) + ">"
    named = [{f"p{i}": x for i, x in enumerate(c)} for c in cuts]
    blocks = F.from_json(F.lit(json.dumps([named[i : i + block] for i in range(0, len(named), block)])), f"array<array<{kind}>>")
    firsts = F.from_json(F.lit(json.dumps(named[::block])), f"array<{kind}>")
    own = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(place)])
    before = F.size(F.filter(firsts, lambda x: x <= own))
    within = F.size(F.filter(F.coalesce(F.get(blocks, before - 1), F.array().cast(f"array<{kind}>")), lambda x: x <= own))
    return (F.greatest(before - 1, F.lit(0)) * block + within).cast("int")


def with_next(
    rows: DataFrame, values: dict[str, Column], id_col: str = "id", order_col: str = "text", ranges: int = 4096, rows_each: int = 100
) -> DataFrame:
    """`rows` with the columns `values` and, as next_<name>, those of the next row in descending id order; after the last comes the first."""
    kept, place = rows.columns, ["_none", "_down", "_hash", "_row"]
    rows = rows.withColumns({
        "_none": F.col(id_col).isNull().cast("long"), "_down": F.bitwise_not(F.coalesce(F.col(id_col), F.lit(0))).cast("long"),
        "_hash": F.xxhash64(order_col), "_row": F.monotonically_increasing_id(),
    })
    rows = rows.withColumn("_stretch", _stretches(rows, place, ranges, rows_each))
    heads = rows.groupBy("_stretch").agg(F.min(F.struct(*place[:3])).alias("_head"))
    every = Window.partitionBy(F.lit(0)).orderBy("_stretch")  # a row for each stretch
    before = F.coalesce(F.lag("_stretch").over(every), F.max("_stretch").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("_stretch").alias("_own"), F.col("_head"), before.alias("_before"))
    is_head = (F.col("_stretch") == F.col("_own")) & (F.struct(*place[:3]) == F.col("_head"))
    first = rows.join(F.broadcast(heads), is_head)  # at most `ranges` + 1 rows are sent
    guests = first.groupBy("_before").agg(F.first(F.struct(*kept, *place)).alias("row"))
    guests = guests.select(*[F.col("row")[c].alias(c) for c in [*kept, *place]], F.col("_before").alias("_stretch"), F.lit(1).alias("_guest"))
    own = Window.partitionBy("_stretch").orderBy("_guest", *place)
    both = rows.withColumn("_guest", F.lit(0)).unionByName(guests).repartition("_stretch").withColumns(values)  # values are not shuffled
    ahead = both.select(*dict.fromkeys([*kept, *values]), "_guest", *[F.lead(v).over(own).alias(f"next_{v}") for v in values])
    return ahead.where("_guest = 0").drop("_guest")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last third of code points (rounded down) replaced by as many, or all, of the next text's first."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(next_text, F.lit(1), third))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, scale: int = SCALE) -> DataFrame:
    """(id, text, edited, sketch, edited_sketch, next_sketch) for each row of `docs`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    ahead = with_next(rows, {"text": F.col("text"), "sketch": sketch(F.col("text"), width, scale)})
    ahead = ahead.select("id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"), "sketch", "next_sketch")
    return ahead.withColumn("edited_sketch", sketch(F.col("edited"), width, scale))
