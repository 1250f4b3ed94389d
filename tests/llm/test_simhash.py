import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import classes
from tidemark.llm import simhash as s
from tidemark.llm.components import connected_components


def plain_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_every_pair_within_the_radius_shares_a_table(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    assert any(x & m == y & m for m in s.covering_masks(list(range(64)), 2))


@settings(max_examples=30)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=6, unique=True))
def test_blocks_leave_one_table_alone(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    assert any(x & m == y & m for m in s.block_masks(list(range(64)), 9, 3))


def test_against_brute_force(docs, texts):
    found = {r["id"]: r for r in s.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    assert {i: r["fp"] % 2**64 for i, r in found.items()} == prints
    links = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component"] for i, r in found.items()} == classes(prints, links)


def test_copies_beyond_the_bound_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(s, "HEAVY", 3)
    rows = [(i, "" if i % 2 else f"some words {i % 10}") for i in range(40)]
    found = {r["id"]: r["component"] for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 1 if i % 2 else i % 10 for i in range(40)}
    found = {r["id"]: r["component"] for r in s.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 1 if i % 2 else i % 10 for i in range(40)}


@pytest.mark.parametrize("bucket", [1, 8])
def test_large_buckets_are_split(spark, bucket):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    prints = list({base ^ (1 << rnd.randrange(20)) ^ (1 << rnd.randrange(64)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    rows = [(s._signed(x), i, 0) for i, x in enumerate(prints)]
    links = s.fingerprint_links(spark.createDataFrame(rows, "fp long, node long, band int"), 2, bucket)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    fps = np.array(prints, np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2)]
    wanted = classes(range(len(prints)), near)
    assert {i: found.get(i, i) for i in range(len(prints))} == wanted


def test_odd_rows(odd):
    found = s.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r["id"]: r for r in found}
    assert {by[i]["fp"] for i in (2, 3, 4)} == {0} and {by[i]["component"] for i in (2, 3, 4)} == {2}
    assert by[5]["component"] == 1 and by[1]["component"] == 1 and by[6]["component"] == 6
    assert by[None]["component"] is None  # alone with its fingerprint


def test_empty(empty):
    assert s.near_duplicates(empty).count() == 0 and s.similar_documents(empty).count() == 0


def test_similar_documents_are_confirmed(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(9999)}" for _ in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    far = [w if k % 6 else "other" for k, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper())], "doc_id long, text string")
    assert {r["id"]: r["component"] for r in s.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (None, 3), (7, 7), (201, 200)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(1, 101)} | {201: 200}


def test_sizes_of_very_long_texts_are_exact(spark):
    cycle = [f"w{i}" for i in range(600)]
    df = spark.createDataFrame([(1, " ".join(cycle * 100)), (2, " ".join((cycle * 117)[:70_000]))], "doc_id long, text string")
    assert {r["id"]: r["size"] for r in s.fingerprints(df, width=5).collect()} == {1: 600, 2: 600}
    assert {r["id"]: r["component"] for r in s.similar_documents(df).collect()} == {1: 1, 2: 1}


def test_no_similar_pair_is_missed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(0, 800, 2):
        base = [f"w{rnd.randrange(9999)}" for _ in range(rnd.choice([60, 120, 240]))]
        near = list(base)
        for k in range(len(base) // 60):  # 5 shingles of 56: similarity 51 / 61
            near[60 * k + 30] = "changed"
        rows += [(i, " ".join(base)), (i + 1, " ".join(near))]
    found = s.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: i - i % 2 for i in range(800)}


def test_classes_equal_those_of_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: set(s.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in df.collect()}
    alike = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r["id"]: r["component"] for r in s.similar_documents(df).collect()} == classes(sets, alike)


def test_deeper_masks_keep_the_bits_before():
    covering = lambda positions: s.covering_masks(positions, 2)
    kept = [0]
    for _ in range(3):
        levels = s.deeper(kept, covering)
        assert all(x & m == x for x, own in zip(kept, levels, strict=True) for m in own)
        kept = [m for own in levels for m in own]
    assert max(64 - m.bit_count() for m in kept) <= 8  # a last bucket holds 256 fingerprints at most


def test_blocks_link_what_shares_a_bucket(spark):
    rnd = random.Random(3)
    prints = []
    for _ in range(150):
        x = rnd.getrandbits(64)
        prints += [x, x ^ sum(1 << b for b in rnd.sample(range(64), 5))]
    rows = [(s._signed(x), i, 0) for i, x in enumerate(prints)]
    links = s.block_links(spark.createDataFrame(rows, "fp long, node long, band int"), 14)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert all(found.get(i, i) == found.get(i + 1, i + 1) == i for i in range(0, 300, 2))


def test_large_buckets_of_blocks_are_read_in_runs(spark):
    base = random.Random(3).getrandbits(64)
    changed = [p for i in (0, 1) for p in range(i, 64, 9)]
    prints = [base ^ sum(1 << p for k, p in enumerate(changed) if n >> k & 1) for n in range(600)]
    rows = [(s._signed(x), i, 0) for i, x in enumerate(prints)]
    links = s.block_links(spark.createDataFrame(rows, "fp long, node long, band int").repartition(1), 14, bucket=64)
    assert {r["component"] for r in connected_components(links).collect()} == {0}
    assert links.count() <= 84 * 2 * 600


def test_sizes_that_are_alike_enough_share_a_band(spark):
    pairs = [(a, b) for a in range(1, 400) for b in range(a, int(a / 0.8) + 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~s.F.arrays_overlap(s._bands(s.F.col("a"), 0.8), s._bands(s.F.col("b"), 0.8))).count() == 0


def test_repeated_lines_do_not_make_pages_alike(spark):
    menu = "Home About Contact Privacy Terms\n"
    rows = [(i, menu * n + " ".join(f"{i}x{k}" for k in range(150))) for i, n in enumerate([50, 200, 1000, 400])]
    found = s.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: i for i in range(4)} and all(r["first"] for r in found)


def test_rows_of_one_id_and_rows_without(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(7, one), (7, two), (8, one), (None, two), (None, three), (None, three), (7, one)]
    found = s.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["id"], r["text_hash"]): (r["component"], r["first"]) for r in found}
    assert len(found) == 7 and sorted(by.values(), key=str) == [(7, False), (7, False), (7, True), (7, True), (None, True)]
    assert sum(r["first"] for r in found) == 5  # both rows of three, and (7, one) twice


def template_nodes(spark, n, own=22, template=100):
    """Nodes of pages that share a template of common shingles, of which each page's prefix holds two, and have some of their own."""
    rnd = random.Random(5)
    shared = [rnd.getrandbits(62) for _ in range(2)]
    rows = [(i, i, own + template, [rnd.getrandbits(62) for _ in range(own)] + shared, own) for i in range(n)]
    return spark.createDataFrame(rows, "node long, component long, size long, prefix array<long>, rare int")


def test_no_group_grows_with_a_shared_template(spark):
    nodes = template_nodes(spark, 3000)
    rows = nodes.select("node", "component", "size", "rare", s.F.posexplode("prefix").alias("at", "h")).withColumn("band", s.F.lit(6))
    sizes = [r["count"] for r in s._squares(rows, 200).groupBy("h").count().collect()]
    assert max(sizes) <= 3 * 200 and sum(x > 1 for x in sizes) > 100


def test_squares_lose_no_pair(spark):
    """In blocks or whole, the same candidates: every two nodes of one shingle that are alike enough by size and place."""
    rnd = random.Random(6)
    rows = [(i, i % 150, 30 + rnd.randint(0, 3), [rnd.choice([11, 12, 13]), rnd.randint(100, 140)], 1) for i in range(700)]
    nodes = spark.createDataFrame(rows, "node long, component long, size long, prefix array<long>, rare int")
    whole, cut = ({tuple(r) for r in s.prefix_links(nodes, 0.8, square=x).distinct().collect()} for x in (10**6, 50))
    assert whole == cut and whole
    by = {i: (c, z, p) for i, c, z, p, _ in rows}
    for a, b in itertools.combinations(range(700), 2):
        (c, z, p), (d, y, q) = by[a], by[b]
        if c != d and p[0] == q[0]:  # first in both orders
            assert ((a, b) in cut) == (min(z, y) >= 0.8 / 1.8 * (z + y) - 1e-6)


def test_squares_do_not_shuffle_rows(spark):
    """Rows of large groups are dealt where they are; the groups are all that is shuffled afterwards."""
    nodes = template_nodes(spark, 3000)
    rows = nodes.select("node", "component", "size", "rare", s.F.posexplode("prefix").alias("at", "h")).withColumn("band", s.F.lit(6))
    dealt = s._squares(rows, 200)
    assert "Exchange hashpartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.count() == 3000 * 22 + 2 * 3000 * 15  # 15 blocks of 200
    few = s._squares(rows, 200, keys=10)  # blocks of 600
    assert few.count() == 3000 * 22 + 2 * 3000 * 5


@settings(max_examples=60)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 2**32))
def test_parities_never_count_too_many(shared, one, two, seed):
    h = np.unique(np.random.default_rng(seed).integers(0, 2**64, shared + one + two, np.uint64))
    h = np.random.default_rng(seed).permutation(h)
    x, y = np.sort(h[: shared + one]), np.sort(np.concatenate((h[:shared], h[shared + one :])))
    assert s.differing(s.parities(x), s.parities(y)) == s.differing(s.parities(y), s.parities(x)) <= len(np.setxor1d(x, y))
    assert s.differing(s.parities(x), s.parities(x)) == 0
    assert (s._among(x, y) == np.isin(x, y)).all()


def test_texts_that_share_a_passage_are_not_moved_to_be_compared(spark, monkeypatch):
    """Candidates of one passage grow with the square of the texts that hold it; none of them that is clearly unlike gets to the texts."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(60)]
    rows += [(60 + i, rows[i][1] + " more") for i in range(20)]
    moved, confirm = [], s.confirm

    def counted(links, *more):
        moved.append(links.count())
        return confirm(links, *more)

    monkeypatch.setattr(s, "confirm", counted)
    found = s.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: i % 60 for i in range(80)}
    assert 20 <= sum(moved) <= 200
