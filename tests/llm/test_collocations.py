import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations as c
from tidemark.llm.queries import ORACLES, op12_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def brute(rows, longest=5, least=100, top=2000):
    out = []
    for lang in {"und" if x is None else x for x, _ in rows}:
        f, n = Counter(), 0
        for text in (t or "" for x, t in rows if (x or "und") == lang):
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
                w = re.findall(r"[^ \t]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[p[i : i + k]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(frame, **more):
    return sorted(tuple(r[x] for x in COLUMNS) for r in c.collocations(frame, **more).collect())


def texts(seed, n, vocabulary=60):
    """Skewed words, set phrases within longer and shorter ones, pieces, capitals."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    fixed = ["New York City", "as soon as possible", "a b c d e f g", "x y x y x", "w0 of w1"]
    out = []
    for _ in range(n):
        t = rnd.choices(words, weights, k=rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 4)):
            t.insert(rnd.randint(0, len(t)), rnd.choice(fixed))
        out.append("".join(x + rnd.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for x in t))
    return out


def test_words_of_texts():
    words, ids, piece, text = c.read_words(pa.array(["Ab c.d", "", "É ab,,x", " ", "c"]))
    assert [words[int(i)].as_py() for i in ids] == ["ab", "c", "d", "É", "ab", "x", "c"]
    assert text.tolist() == [0, 0, 0, 2, 2, 2, 4]
    assert (np.diff(piece) > 0).tolist() == [False, True, True, False, True, True]


@pytest.mark.parametrize(("least", "top", "longest"), [(100, 2000, 5), (10, 25, 5), (5, 40, 3), (3, 7, 4)])
def test_equals_brute_force(spark, least, top, longest):
    """Several languages, ties at the last rank, lists settled before everything is expanded."""
    rows = [(x, t) for k, x in enumerate(["en", None, "und", "de"]) for t in texts(k, 250)] + [("fr", "one two"), ("fr", None)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert run(frame, least=least, top=top, longest=longest) == brute(rows, longest, least, top)


def test_rounds_stop_early(spark, monkeypatch):
    """A list is settled as soon as no bound reaches its last score; the rest is never grown."""
    grown = []
    level = c._level
    monkeypatch.setattr(c, "_level", lambda chunks, size, longest, least, frontier, *more: (size == 2 and grown.append(frontier.count()), level(chunks, size, longest, least, frontier, *more))[1])
    monkeypatch.setattr(c, "STEP", 4)
    rows = [("en", t) for t in texts(5, 600, 300)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert run(frame, least=5, top=3) == brute(rows, 5, 5, 3)
    counted = Counter(w for _, t in rows for w in re.findall(r"[^ \t\n.,]+", lower(t)))
    assert sum(grown) < sum(n >= 5 for n in counted.values())


def test_small_filters_only_cost(spark, monkeypatch):
    """With filters of the least size, which let many other phrases through, the result is the same."""
    monkeypatch.setattr(c, "BITS", 1 << 15)
    rows = [("en", t) for t in texts(6, 400, 2000)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert run(frame, least=2, top=300) == brute(rows, 5, 2, 300)


def test_chunks_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 500)
    some = texts(7, 80)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 80), pa.array(some)], ["lang", "text"])
    made = [b for b in c._chunked(iter([batch]))]
    assert len(made) > 5 and sum(sum(x) for b in made for x in b["counts"].to_pylist()) == len(re.findall(r"[^ \t\n.,]+", " ".join(some)))


def test_query_equals_sql(spark, sf_dir):
    found = sorted(tuple(r[x] for x in COLUMNS) for r in op12_collocations(spark, sf_dir).collect())
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    assert found == sorted(duckdb.sql(ORACLES["op12_collocations"]).project(", ".join(COLUMNS)).fetchall())


def test_odd_rows(odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert run(odd, least=2, top=50) == brute(rows, 5, 2, 50)
    assert run(empty) == []
