import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from llm_helpers import classes
from tidemark.llm.common import stage_table
from tidemark.llm.tokencounts import read_ranks

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = [out]
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, out, FOLDER), name)
        made.append(out)
    return made


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == before.columns and set(rows(after)) <= set(rows(before))
    assert len(rows(stages[1])) < len(rows(stages[0])) and len(rows(stages[2])) < len(rows(stages[1]))


def test_one_of_each_class_stays(stages):
    texts, kept = rows(stages[2]), set(rows(stages[3]))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    ids = sorted(shingles)
    alike = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    wanted = classes(ids, alike)
    assert kept == set(wanted.values())


def test_near_dedup_judges_rows(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(7, one, 1), (7, two, 2), (8, one, 3), (None, two, 4), (None, "c", 5), (None, "c", 6), (7, one, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ int")
    kept = corpus_pipeline.near_dedup(spark, df, FOLDER)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, one), (7, two), (None, "c")], key=str)


def test_recurring_windows_are_gone(stages):
    before, after = rows(stages[3]), rows(stages[4])
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in before.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in tokens.values() for k in range(len(w) - 34))
    for i, w in tokens.items():
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert after[i] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else before[i])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect() if r["text"] != before[r["doc_id"]])


def test_everything_is_packed(stages):
    found, texts = stages[5].collect(), rows(stages[4])
    assert {r["doc_id"] for r in found} == set(texts)
    ranks = dict(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sum(r["n_tokens"] for r in found) == sum(len(encoding.encode_ordinary(t)) + 1 for t in texts.values() if t)


def test_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for own in (odd, empty):
            made = stage(spark, own, FOLDER)
            assert made.count() <= 80, name
            if name != "packing":
                assert made.columns == own.columns


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[5].count()
