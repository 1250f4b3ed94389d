import random
import re

import duckdb
import pytest

from tidemark.llm import licenses as x
from tidemark.llm.queries import ORACLES, op11_licenses

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEMPLATES = [*x.PHRASES, *x.NOTICES]
APACHE = x.NOTICES[1].text


def tokens(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def scanned(spark, rows, templates=TEMPLATES):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["id"]: r for r in x.scan_licenses(frame, templates).collect()}


def labels(row, templates=TEMPLATES):
    return {templates[m["template"]].label for m in row["matches"]}


def test_base_places_are_all_found(spark):
    """Against a plain search, in texts made of licence words and others, with overlaps and repeats."""
    rnd = random.Random(3)
    pool = ["MIT", "mit", "license", "License", "apache", "general", "public", "gnu", "LICENSE", "the", "x", "mitlicense", "licenſe"]
    rows = [(i, "".join(rnd.choice(pool) + rnd.choice([" ", " ", "-", "\n", "'", "é "]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    found = scanned(spark, rows)
    for i, text in rows:
        w = tokens(text)
        wanted = sorted((k, at) for k, t in enumerate(x.PHRASES) for at in places(w, t.text))
        assert sorted((m["template"], m["start"]) for m in found[i]["matches"] if m["template"] < len(x.PHRASES)) == wanted
        assert found[i]["n_words"] == len(w)


def brute(rows, templates):
    """Every start of every template, by the rule: enough indexed words in their places, all key phrases around."""
    held = [(i, tokens(t)) for i, t in rows]
    df = {w: sum(w in own for _, own in held) for t in templates for w in t.words}
    out = {}
    for i, w in held:
        out[i] = []
        for k, t in enumerate(templates):
            size, slack = len(t.words), x.SLACK if t.keys else 0
            rare = sorted({v for v in t.words if df[v]}, key=lambda v: (df[v], v))[: x.RARE if t.keys else None]
            for start in range(-size, len(w)):
                votes = sum(0 <= start + p < len(w) and w[start + p] == v for p, v in enumerate(t.words) if v in rare)
                around = w[max(start - slack, 0) : max(start + size + slack, 0)]
                if votes >= x.needed(t) and all(places(around, key) for key in t.keys or (t.text,)):
                    out[i].append((k, start, len(set(around) & set(t.words)) / len(set(t.words))))
    return out


def test_equals_brute_force_on_damaged_notices(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        w = rnd.choice(x.NOTICES).words
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + ["odd"] + w[at:], w[:at] + ["odd"] + w[at + 1 :]]) or ["a"]
        rows.append((i, " ".join([*["pad"] * rnd.randint(0, 12), *w, *rnd.choices(["the", "of", "license", "software"], k=rnd.randint(0, 9))])))
    found = scanned(spark, rows)
    wanted = brute(rows, TEMPLATES)
    for i, _ in rows:
        assert sorted((m["template"], m["start"], m["share"]) for m in found[i]["matches"]) == sorted(wanted[i])


def test_notices_with_changed_words_are_known(spark):
    others = [(100 + i, "the software and a copy of this notice in all files with or without words") for i in range(30)]
    cut = APACHE.replace("obtain a copy", "get one copy")
    rows = [(1, f"Header. {cut.upper()}. End"), (2, APACHE.replace("except in compliance", "in compliance")), (3, " ".join(reversed(APACHE.split()))), *others]
    found = scanned(spark, rows)
    assert labels(found[1]) == {"apache-2.0"} and not labels(found[2]) and not labels(found[3])
    assert not any(labels(found[i]) for i, _ in others)


@pytest.mark.parametrize("n", [20_000])
def test_text_full_of_places(spark, n):
    """As many places as words cost a sort, not a comparison of pairs."""
    row = scanned(spark, [(1, "mit license " * n)])[1]
    assert sum(m["template"] == 0 for m in row["matches"]) == n and row["n_words"] == 2 * n


def test_query_equals_sql(spark, sf_dir):
    found = sorted((tuple(r[c] for c in COLUMNS) for r in op11_licenses(spark, sf_dir).collect()), key=str)
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    assert found == sorted(duckdb.sql(ORACLES["op11_licenses"]).project(", ".join(COLUMNS)).fetchall(), key=str)
    assert {"mit", "apache,apache-2.0", "cc-by-nc-4.0", ""} <= {r[6] for r in found}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op11_licenses(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd, empty):
    found = x.scan_licenses(odd, TEMPLATES).collect()
    assert len(found) == odd.count() and all(r["matches"] == [] for r in found)
    assert sorted(r["n_words"] for r in found) == sorted(len(tokens(r["text"])) for r in odd.collect())
    assert x.scan_licenses(empty, TEMPLATES).count() == 0
