import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest as m
from tidemark.llm.queries import ORACLES, op13_manifest
from tidemark.llm.common import lower_ascii

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def way(tree, at):
    """(before, after) of node `at` and of each ancestor below the top."""
    out = []
    for level in tree[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def brute(rows):
    """The contract's columns, from (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[2] is None else "1" + r[2], []).append(r)
    order = sorted(groups, key=str.encode)
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: levels([leaf(*r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, k)
            lower = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            node = leaf(*r[:4], lower if tampered else r[4])
            for lo, hi in path:
                node = sha(lo + node + hi)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], sha("".join(lo + hi for lo, hi in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    tampered = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 0
    return m.versions(m.manifest(m.document_leaves(docs, tampered, lower_ascii(F.col("text")))))


def test_equals_brute_force_and_sql(spark, sf_dir, docs):
    found = sorted((tuple(r[c] for c in COLUMNS) for r in op13_manifest(spark, sf_dir).collect()), key=str)
    assert found == brute([tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()])
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    wanted = sorted((tuple(r) for r in duckdb.sql(ORACLES["op13_manifest"]).project(", ".join(COLUMNS)).fetchall()), key=str)
    assert found == wanted and {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("langs", [["en"], [None, "de", "en"], [f"l{i}" for i in range(70)]])
def test_many_leaves_in_blocks(spark, langs):
    """Several tiers of blocks, last runs of one, single leaves, many groups; a third of all rows are one row."""
    rows = [(i, "s", langs[i % len(langs)], i % 9, f"Text {i}") for i in range(1, 1700)] + [(5, "s", "en", 4, "Same")] * 800 + [(1, None, "zz", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = run(frame).withColumn("ok", F.col("folded_root") == F.col("root")).drop("copied").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_versions_share_what_is_untouched(spark, docs):
    """A version owns one node a level; what it changed verifies against its own root only."""
    found = run(docs).collect()
    changed = [r for r in found if r["copied"]]
    assert changed and all(r["folded_root"] != r["root"] and r["copied"][-1] == r["folded_root"] for r in changed)
    heights = {len(r["copied"]) for r in changed}
    assert max(heights) <= 6
    assert all(r["folded_root"] == r["root"] for r in found if not r["copied"])


def test_odd_rows(odd, empty):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in odd.collect()]
    found = run(odd).withColumn("ok", F.col("folded_root") == F.col("root")).drop("copied").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    assert run(empty).count() == 0


def test_one_leaf(spark):
    row = run(spark.createDataFrame([(7, "s", None, 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha("")
