import base64
import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import sketches as k
from tidemark.llm.queries import op6_fingerprints


def edit(text, following):
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_edits_and_likeness(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in op6_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        changed = edit(texts[a], texts[b])
        assert found[a]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and found[a]["n_chars"] == len(texts[a])
        x, y = shingles(texts[a]), shingles(changed)
        errors.append(found[a]["near_edited"] - len(x & y) / max(1, len(x | y)))
    assert abs(sum(errors) / len(errors)) < 0.05
    assert len({r["fingerprint"] for r in found.values()}) == len({r["fingerprint"] for r in found.values() if r["fingerprint"]})


def test_whole_sketch_is_exact(spark):
    df = spark.createDataFrame([("a b c d e f g", "b c d e f g h")], "x string, y string")
    row = df.select(k.likeness(k.sketch(F.col("x"), 5, 1), k.sketch(F.col("y"), 5, 1)), k.containment(k.sketch(F.col("x"), 5, 1), k.sketch(F.col("y"), 5, 1), 1)).first()
    assert tuple(row) == (0.5, 2 / 3)


def test_merging(spark):
    df = spark.createDataFrame([("a b c d e f g", "p q r s t u")], "x string, y string")
    both = df.select(k.merged(k.sketch(F.col("x"), 5, 1), k.sketch(F.col("y"), 5, 1), 1).alias("m"), k.sketch(F.col("x"), 5, 1).alias("x")).first()
    assert len(both["m"]) == 5 and set(both["x"]) <= set(both["m"])


def test_odd_rows(odd, empty):
    found = k.fingerprint_edits(odd).collect()
    assert len(found) == odd.count()
    order = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = sorted(((i, edit(t, order[(n + 1) % len(order)][1])) for n, (i, t) in enumerate(order)), key=str)
    assert sorted(((r["id"], r["edited"]) for r in found), key=str) == wanted
    assert {tuple(r["sketch"]) for r in found if r["id"] in (2, 3, 4)} == {()}
    assert all(r["sketch"] for r in found if r["id"] in (1, 8))
    assert k.fingerprint_edits(empty).count() == 0


def test_one_row_follows_itself(spark):
    row = k.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row["edited"] == "abcdab"


def test_absolute_error_of_likeness(spark, sf_dir, texts):
    found = {r["doc_id"]: r["near_edited"] for r in op6_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        x, y = shingles(texts[a]), shingles(edit(texts[a], texts[b]))
        errors.append(abs(found[a] - (len(x & y) / len(x | y) if x | y else 1.0)))
    print("mean absolute error", sum(errors) / len(errors), "off by more than 0.2", sum(e > 0.2 for e in errors) / len(errors))
    assert sum(errors) / len(errors) < 0.08 and sum(e > 0.2 for e in errors) < 0.1 * len(errors)


def test_union_and_containment_of_short_texts_in_a_long_one(spark):
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(words)
    rows = [(" ".join(words[i : i + 6]), long) for i in range(0, 2900, 6)]
    x, y = k.sketch(F.col("x"), scale=2), k.sketch(F.col("y"), scale=2)
    made = spark.createDataFrame(rows, "x string, y string").select(k.merged(x, y, 2).alias("m"), y.alias("y"), k.containment(x, y, 2).alias("c")).collect()
    assert all(r["m"] == r["y"] for r in made)  # the long text has all runs of the short one
    told = [r["c"] for r in made if r["c"] is not None]
    assert set(told) == {1.0} and len(made) / 2 < len(told) < len(made)


MASK = 2**64 - 1


def hash_long(x, seed):
    """XXH64 of eight bytes, as Spark SQL applies it to a long with the hash so far as seed."""
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed & MASK)


def plain_sketch(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.lower().split()]
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else ([words] if words else [])
    found = set()
    for run in runs:
        h = 42
        for w in run:
            h = hash_long(w, h)
        found.add(h - 2**64 if h >= 2**63 else h)
    return kept(found)


def kept(hashes):
    """Those below 1/SCALE of the range, or else the least."""
    low = {h for h in hashes if h < -(2**63) + 2**64 // k.SCALE}
    return sorted(low) or ([min(hashes)] if hashes else [])


def test_sketches_against_brute_force(spark, sf_dir, texts):
    found = {r["doc_id"]: r["fingerprint"] for r in op6_fingerprints(spark, sf_dir).collect()}
    plain = {i: t for i, t in texts.items() if t.isascii()}
    assert len(plain) > 50
    assert {i: found[i] for i in plain} == {i: base64.b64encode(b"".join((h & 2**24 - 1).to_bytes(3, "big") for h in plain_sketch(t))).decode() for i, t in plain.items()}
    assert sum(map(len, found.values())) < sum(map(len, texts.values())) / 10


def test_merged_sketches_are_those_of_the_union(spark):
    short = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(40)]
    long = [" ".join(f"x{i}{j}" for j in range(300)) for i in range(5)]
    rows = [(a, b) for a in short[:20] + long for b in short[20:] + long]
    found = spark.createDataFrame(rows, "x string, y string").select("x", "y", k.merged(k.sketch(F.col("x")), k.sketch(F.col("y"))).alias("m")).collect()
    for r in found:
        assert r["m"] == kept(set(plain_sketch(r["x"])) | set(plain_sketch(r["y"])))


@pytest.mark.parametrize("kind", ["dense", "outlier", "extremes", "null ids", "one id", "equal rows"])
def test_successors_whatever_the_ids(spark, kind):
    n = 1500
    ids = {"dense": range(n), "outlier": [*range(n - 1), 2**62], "extremes": [-(2**63), 2**63 - 1, *range(n - 2)], "null ids": [*range(200), *[None] * (n - 200)]}.get(kind, [5] * n)
    rows = [(i, "same" if kind == "equal rows" else f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    found = k.with_next(df, {"text": F.col("text")}, rows_each=20).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["text"]) for r in found) == sorted((i is None, i or 0, t) for i, t in rows)
    if kind in ("dense", "outlier", "extremes"):
        order = sorted(rows, reverse=True)
        assert {(r["text"], r["next_text"]) for r in found} == {(a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    elif kind == "equal rows":
        assert {r["next_text"] for r in found} == {"same"}
    else:  # one ring through all rows
        after = {r["text"]: r["next_text"] for r in found}
        seen, at = set(), "text 0"
        while at not in seen:
            seen.add(at)
            at = after[at]
        assert len(seen) == n


@pytest.mark.parametrize("kind", ["outlier", "null ids", "equal rows"])
def test_stretches_are_of_like_size(spark, kind):
    ids = {"outlier": [*range(4999), 2**62], "null ids": [None] * 5000}.get(kind, [5] * 5000)
    df = spark.createDataFrame([(i, "same" if kind == "equal rows" else f"t{n}") for n, i in enumerate(ids)], "id long, text string").withColumns(
        {"n": F.col("id").isNull().cast("long"), "d": F.bitwise_not(F.coalesce("id", F.lit(0))), "h": F.xxhash64("text"), "r": F.monotonically_increasing_id()}
    )
    sizes = [r["count"] for r in df.groupBy(k._stretches(df, ["n", "d", "h", "r"], 4096, 100).alias("s")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 400
