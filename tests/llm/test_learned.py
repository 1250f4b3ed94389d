import math
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, suffixtree, toxicity
from tidemark.llm.common import crc_of_id
from tidemark.llm.queries import op2_quality, op4_suffix_tree, op5_toxicity
from tidemark.llm.suffixtree import score_texts
from tidemark.session import shared_folder

BIGGER = "/root/testdata/sf0.1"


def test_folding():
    assert toxicity.fold("Ｉd1öт, ѕtup​id!") == " idiot stupid "


def test_toxicity_on_held_out_rows(spark):
    found = op5_toxicity(spark, BIGGER).join(spark.read.parquet(f"{BIGGER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) / len(found) > 0.97
    assert sum(r["predicted"] and not r["toxic"] for r in found) <= 0.01 * len(found)


def test_disguised_words_and_exceptions(spark):
    rows = [(i, f"{'idiot moron ' if i % 4 == 0 else 'kind '}text number {i}" + (" clown fish" if i % 4 == 1 else "") + (" clown" if i % 4 == 0 else "")) for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    lexicon = toxicity.learn(docs, labels)
    assert "clown fish" in lexicon.exceptions
    probe = spark.createDataFrame([(1, "you 1d1ot m0r0n cl0wn"), (2, "you іdiоt mоrоn clоwn"), (3, "a clown fish"), (4, "a kind text"), (5, None)], "doc_id long, text string")
    score = {r["id"]: r["score"] for r in toxicity.score_toxicity(probe, lexicon).collect()}
    assert score[1] >= 0.5 and score[2] >= 0.5 and score[3] < 0.5 and score[4] < 0.5 and score[5] < 0.5
    assert toxicity.reject_toxic(probe, lexicon).select("doc_id").toPandas()["doc_id"].tolist() == [3, 4, 5]


def test_toxicity_of_odd_rows(spark, odd, empty, no_labels):
    nothing = toxicity.learn(odd, no_labels)
    assert {r["score"] for r in toxicity.score_toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.reject_toxic(odd, nothing).count() == odd.count() and toxicity.reject_toxic(odd, nothing).columns == odd.columns
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (9, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(odd, labels)
    scores = [r["score"] for r in toxicity.score_toxicity(odd, lexicon).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_toxicity(empty, lexicon).count() == 0


def test_quality_on_held_out_rows(spark):
    found = op2_quality(spark, BIGGER).join(spark.read.parquet(f"{BIGGER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.98
    assert sum(not r["predicted"] and r["quality"] for r in found) <= 0.005 * len(found)


def test_quality_of_odd_rows(spark, odd, empty, no_labels):
    nothing = quality.learn_quality(odd, no_labels)
    assert {r["score"] for r in quality.score_quality(odd, nothing).collect()} == {1.0}
    assert quality.reject_poor(odd, nothing).count() == odd.count()
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (9, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.learn_quality(odd, labels)
    assert quality.score_quality(odd, model).count() == odd.count() and quality.reject_poor(odd, model).columns == odd.columns
    assert quality.score_quality(empty, model).count() == 0


def test_rounds_help_where_labels_are_few(spark):
    """The given texts, with metadata that say something about their quality; the rounds carry it to the other view."""
    import numpy as np

    labels = spark.read.parquet(f"{BIGGER}/labels.parquet").select("doc_id", "quality")
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet").join(labels, "doc_id").withColumn("links", (F.col("quality") * 30 + 20 * noise).cast("long")).cache()
    few = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(60)) == 0)
    right = []
    for rounds in (0, 3):
        model = quality.learn_quality(docs, few, metadata=("links",), rounds=rounds, per_round=200)
        found = quality.score_quality(docs, model, metadata=("links",)).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
        right.append(np.mean([(r["content_score"] >= 0.5) == r["quality"] for r in found]))
    docs.unpersist()
    print("content view alone, and taught", right)
    assert right[1] > right[0]


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_conflicting_and_repeated_labels(spark, docs, label):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, "d"), (None, "e"), (4, "f")]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, 5)], f"doc_id long, {label} int")
    found = toxicity.training_rows(own, marks, label, F.lit(True), "doc_id", "text", 8000).collect()
    assert sorted((r["doc_id"], r["y"]) for r in found) == [(1, 1), (3, 0)]


def test_a_repeated_id_does_not_fill_the_sample(spark):
    own = spark.range(20_000).selectExpr("if(id < 15000, 1, id) as doc_id", "concat('text ', id) as text")
    marks = own.selectExpr("doc_id", "1 as quality").distinct()
    assert toxicity.training_rows(own, marks, "quality", F.lit(True), "doc_id", "text", 1000).count() < 1300


def test_surest_rows_are_those_of_all(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, [float(a)], [float(b)]) for i, (a, b) in enumerate(rng.normal(0, 4, (500, 2)))]
    pool = spark.createDataFrame(rows, "key long, content array<float>, metadata array<float>").repartition(7)
    fitted = {v: np.array([1.0, 0.0]) for v in quality.VIEWS}
    found = quality.surest(pool, fitted, 20, 0.9, {"content": [], "metadata": [3, 4]})
    for n, v in enumerate(quality.VIEWS):
        free = [r for r in rows if v == "metadata" or r[0] not in (3, 4)]
        high = sorted(free, key=lambda r: -np.float32(r[n + 1][0]))
        assert {k for k, y in zip(found[v]["key"].to_pylist(), found[v]["label"].to_pylist(), strict=True) if y} == {r[0] for r in high[:20]}
        assert {k for k, y in zip(found[v]["key"].to_pylist(), found[v]["label"].to_pylist(), strict=True) if not y} == {r[0] for r in high[-20:]}


def test_null_ids_have_a_fold(spark):
    own = spark.createDataFrame([(None,), (3,)], "doc_id long")
    assert [r[0] for r in own.select(crc_of_id("doc_id")).collect()] == [0, zlib.crc32(b"3")]


def brute_base(rows, trains):
    low = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for i, t in rows:
        if trains(i):
            c.update([*low(t), 0])
    n, v = sum(c.values()), len(c)
    return {i: (len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), 0]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*low(t), 0])) for i, t in rows}


def test_suffix_tree(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in op4_suffix_tree(spark, sf_dir).collect()}
    wanted = brute_base(list(texts.items()), lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    for i, (n, known, total, base) in wanted.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
    out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def brute_tree(rows, trains, own, rare, depth, worth, worth_each):
    """The score of each text under a tree built by the definitions, with nested counts of whole runs."""
    low = lambda t: [*(t or "").encode().lower().split(), None]
    texts = {i: low(t) for i, t in rows}
    c = Counter(w for i, t in texts.items() if trains(i) for w in t)
    n = sum(c.values())
    own_floor, floor = max(1.0, n**0.75 / own), max(2.0, n**0.6 / rare)
    words = {w for t in texts.values() for w in t}
    alone = {w for w in words if c[w] >= own_floor}
    letters = lambda w: w[:3]
    size = Counter()
    for w in words - alone:
        size[letters(w)] += c[w]
    large = {x for x, k in size.items() if k >= own_floor}
    symbol = {w: ("word", w) if w in alone else ("class", letters(w)) if letters(w) in large else "rest" for w in words}
    mass, types = Counter(), Counter()
    for w in words - alone:
        mass[symbol[w]] += c[w]
        types[symbol[w]] += c[w] > 0
    alphabet = {("word", w) for w in alone} | {("class", x) for x in large} | {"rest"}
    coded = {i: [symbol[w] for w in t] for i, t in texts.items()}
    runs = Counter()
    for i, t in coded.items():
        if trains(i):
            for k in range(len(t)):
                for d in range(min(depth, k) + 1):
                    runs[tuple(t[k - d : k + 1])] += 1
    after = {}
    for run, k in runs.items():
        after.setdefault(run[:-1], {})[run[-1]] = k
    total = sum(after.get((), {}).values()) + 0.5 * len(alphabet)
    states = {(): ({x: (after.get((), {}).get(x, 0) + 0.5) / total for x in alphabet}, 0.0)}

    def chance(context, x):
        while context not in states:
            context = context[1:]
        known, m = states[context]
        return known[x] if x in known else m * chance(context[1:], x)

    for d in range(1, depth + 1):
        for context in [x for x in after if len(x) == d and x[1:] in states]:
            found = after[context]
            t = sum(found.values())
            often = {x: (k, chance_before(context[1:], x, states, after)) for x, k in found.items() if k > 1}
            once = sum(k == 1 for k in found.values())
            gain = sum(k * math.log(k / (t * p)) for k, p in often.values())
            gain += once * math.log(once / (t * max(1 - sum(p for _, p in often.values()), 1e-12))) if once else 0.0
            if often and t >= floor and gain >= worth + worth_each * len(often):
                m = (len(found) + once) / (t + len(found))
                states[context] = ({x: k / (t + len(found)) + m * p for x, (k, p) in often.items()}, m)
    scores = {}
    for i, t in coded.items():
        s = 0.0
        for k, (x, w) in enumerate(zip(t, texts[i], strict=True)):
            s += math.log10(chance(tuple(t[max(0, k - depth) : k]), x))
            if w not in alone:
                s += math.log10((c[w] + 1) / (mass[x] + types[x] + 1))
        scores[i] = s
    return scores, states


def chance_before(context, x, states, after):
    """The chance of a symbol in a state, that of one seen once worked out like that of one not seen."""
    known, m = states[context]
    return known[x] if x in known else m * chance_before(context[1:], x, states, after)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_tree_against_brute_force(spark, sent):
    import random

    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    follow = {w: rnd.sample(names, 3) for w in names}
    rows = []
    for i in range(80):
        w = rnd.choice(names)
        text = [w]
        for _ in range(rnd.randint(0, 90)):
            w = rnd.choice(follow[w]) if rnd.random() < 0.8 else rnd.choice(names)
            text.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, " ".join(text)))
    rows += [(80, None), (81, ""), (82, "qqq " * 30), (83, "never seen words"), (84, rows[3][1]), (85, rows[3][1])]
    trains = lambda i: i % 7 != 2
    settings = {"own": 40.0, "rare": 30.0, "depth": 4, "worth": 2.0, "worth_each": 0.3}
    wanted, states = brute_tree(rows, trains, **settings)
    assert {len(x) for x in states} >= {1, 2, 3}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: r["score"] for r in score_texts(df, F.col("doc_id") % 7 != 2, sent=sent, **settings).collect()}
    assert found.keys() == wanted.keys()
    for i in wanted:
        assert found[i] == pytest.approx(wanted[i], rel=1e-5), i


def test_runs_that_are_not_sent_are_few(spark, monkeypatch):
    """Of a tree that is too large to send, a text deals only what a filter lets through, not all its runs; scores are the same."""
    import random

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("xy") * (rnd.random() < 0.2) for _ in range(150))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(70, None)]
    settings = {"own": 60.0, "rare": 40.0, "depth": 3, "worth": 1.0, "worth_each": 0.0}
    wanted, _ = brute_tree(rows, lambda i: i % 7 != 2, **settings)
    tables, real = {}, suffixtree.stage_table

    def stage(df, name, **kw):
        out = real(df, name, **kw)
        if name in ("tree", "scored"):
            tables[name] = out.toPandas()
        return out

    monkeypatch.setattr(suffixtree, "stage_table", stage)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["id"]: r["score"] for r in score_texts(df, F.col("doc_id") % 7 != 2, sent=200, **settings).collect()}
    dealt, tokens = tables["scored"]["others"].map(len).sum(), tables["scored"]["n_tokens"].sum()
    tree = tables["tree"]
    assert ((tree["symbols"] > 1) & tree["cost"].notna()).sum() > 200 and 0 < dealt < tokens
    for i in wanted:
        assert found[i] == pytest.approx(wanted[i], rel=1e-5), i


def test_held_out_rows_and_copies(spark):
    """Held-out rows are likelier than by word frequencies; texts that occur twice in training more so than others: longer contexts know them."""
    found = op4_suffix_tree(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in found if r["held_out"]]
    each = lambda c: sum(r[c] for r in out) / sum(r["n_tokens"] for r in out)
    assert each("score") > -3.822 and each("base_score") < -4.06
    learned = [r for r in found if not r["held_out"] and r["n_tokens"] > 100]
    times = Counter(texts[r["doc_id"]] for r in learned)
    gain = lambda r: (r["score"] - r["base_score"]) / r["n_tokens"]
    twice, once = ([gain(r) for r in learned if (times[texts[r["doc_id"]]] > 1) == more] for more in (True, False))
    assert sum(twice) / len(twice) > sum(once) / len(once)


def test_suffix_tree_of_odd_rows(odd, empty):
    everything = F.lit(True)
    found = {r["id"]: r for r in score_texts(odd, everything).collect()}
    wanted = brute_base([(r["doc_id"], r["text"]) for r in odd.collect()], lambda i: True)
    for i, (n, known, total, base) in wanted.items():
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (n, known, total) and found[i]["base_score"] == pytest.approx(base)
    assert score_texts(empty, everything).count() == 0
    untrained = score_texts(odd, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0}


def test_tables_of_levels_go_before_texts_are_scored(spark, monkeypatch):
    folder, names, there = shared_folder(spark).removeprefix("file://"), [], []
    before, real = set(os.listdir(folder)), suffixtree.stage_table

    def stage(df, name, **kw):
        names.append(name)
        if name == "scored":
            there.extend(x for x in os.listdir(folder) if x not in before)
        return real(df, name, **kw)

    monkeypatch.setattr(suffixtree, "stage_table", stage)
    df = spark.createDataFrame([(i, "a b c d a b c e " * 9) for i in range(9)], "doc_id long, text string")
    assert score_texts(df, F.col("doc_id") % 7 != 2, worth=0.5, worth_each=0.0).count() == 9
    assert names.index("often") < names.index("kept")  # counts are a table before they are joined
    assert any("-tree-" in x for x in there) and not any(k in x for x in there for k in ("-often-", "-kept-", "-chances-", "-states-", "-contexts-"))
