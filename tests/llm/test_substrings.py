import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings
from tidemark.llm.queries import ORACLES, op9_substrings
from tidemark.llm.substrings import PassageAutomaton, WordBatch, _slide, remove_recurring


def brute(rows, width):
    """(n_words, n_removed, kept words) for each text."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in tokens for i in range(len(w) - width + 1))
    out = []
    for w in tokens:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def result(df, **kw):
    found = []
    for r in remove_recurring(df, **kw).collect():
        kept = r["words_sha256"] if not r["n_removed"] else hashlib.sha256(r["kept"].encode()).hexdigest()
        found.append((r["id"], r["n_words"], r["n_removed"], kept))
    return sorted(found, key=str)


def wanted(rows, width):
    return sorted(((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, m, k) in zip(rows, brute([t for _, t in rows], width), strict=True)), key=str)


def test_corpus(docs, texts):
    assert result(docs) == wanted(list(texts.items()), 35)


def test_odd_rows(odd, empty):
    assert result(odd) == wanted([(r["doc_id"], r["text"]) for r in odd.collect()], 35)
    assert remove_recurring(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_repeats(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 40)))) for i in range(30)]
    rows += [(100, "x y " * 20), (101, "p q r s t u v w x y z " * 2), (102, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, width=8, phrase=3) == wanted(rows, 8)


def test_word_hashes_do_not_depend_on_the_place():
    a, b = WordBatch([b"alpha beta gamma"]), WordBatch([b"x", b"", b"  beta\ngamma\talpha"])
    assert a.hash.tolist() == b.hash[[3, 1, 2]].tolist() and b.first.tolist() == [0, 1, 1, 4]
    assert WordBatch([b"ALPHA"], lower=True).hash[0] == a.hash[0] and len(set(a.hash.tolist())) == 3


def test_slide():
    x = np.array([5, 1, 4, 1, 5, 9, 2, 6])
    for n in range(1, 9):
        assert _slide(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = op9_substrings(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLES["op9_substrings"]).fetchall())


def test_shards_that_are_split_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PATTERNS", 7)
    monkeypatch.setattr(substrings, "STRETCHES", 20)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 500, 200)]
    rows = [(i, " ".join([*base[i % 50 : 120 + i % 7], f"own{i}", *base[150 - i % 9 :]])) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(base, 80))) for i in range(10)] + [(200, rows[0][1]), (201, rows[0][1])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == wanted(rows, 35)


def test_only_hits_of_the_automaton_are_removed(spark, monkeypatch):
    rows = [(1, " ".join(f"a{k}" for k in range(50)) + " x"), (2, "y " + " ".join(f"a{k}" for k in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in remove_recurring(df).collect()] == [50, 50]
    real = substrings.locate
    monkeypatch.setattr(substrings, "locate", lambda *a: real(*a).where("rn < 0"))  # no hits
    assert [r["n_removed"] for r in remove_recurring(df).collect()] == [0, 0]
    monkeypatch.setattr(substrings, "locate", lambda *a: real(*a).withColumn("end", F.least("end", F.col("first") + 40)))  # fewer
    assert [r["n_removed"] for r in remove_recurring(df).collect()] == [40, 40]
    found = PassageAutomaton([np.arange(35, dtype="<u4").tobytes()], 35).covered([np.arange(3, 50, dtype="<u4").tobytes(), np.arange(0, 50, dtype="<u4").tobytes()])
    assert [x.tolist() for x in found] == [[1], [0], [35]]


def test_passages_in_which_one_phrase_comes_again_and_again(spark):
    heads = [[f"head{i}x{k}" for k in range(10)] for i in range(3000)]
    first = [WordBatch([" ".join(h).encode()]).anchors(10, 10)[0][0] for h in heads]
    head = " ".join(heads[int(np.argmin(first))])  # the anchor of all windows below
    passage = " ".join(f"{head} " + " ".join(f"v{i}x{k}" for k in range(3 + i % 13)) for i in range(30))
    rows = [(1, f"own {passage}"), (2, f"{passage} last"), (3, f"{head} " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == wanted(rows, 35)


def test_long_words_that_sums_cannot_tell():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    a, b = WordBatch([f"x {word} y".encode()]), WordBatch([word.translate(str.maketrans("ab", "ba")).encode(), word.encode()])
    assert a.hash[1] == b.hash[1] != b.hash[0]
