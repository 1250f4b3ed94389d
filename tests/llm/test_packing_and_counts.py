from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import pack, pack_documents, packed_sequences
from tidemark.llm.tokencounts import attribute, count_tokens, read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.lists(st.integers(0, 100), max_size=80))
def test_bins_hold_their_pieces(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, final = pack(sizes, (10, 30, 100), 2)
    used = [0] * len(final)
    for size, b, at in zip(sizes, bins, offsets, strict=True):
        assert at == used[b]
        used[b] += size
    for n, c in zip(used, final, strict=True):
        assert n <= c and all(smaller < n for smaller in (10, 30, 100) if smaller < c)
    assert sum(1 for n in used if n == 0) <= 1


def test_best_fit_and_downsizing():
    bins, _, final = pack([90, 60, 40, 9], (50, 100), 0)
    assert bins == [0, 1, 1, 0] and final == [100, 100]
    assert pack([20], (10, 30, 100), 0)[2] == [30]


def plain_pack(sizes, lengths, overhead):
    """Best fit by trying every open bin."""
    used, room, bins, opened, put = [], [], [], {c: 1.0 for c in lengths}, {c: 1.0 * c for c in lengths}
    for size in sizes:
        fitting = [(room[b] - used[b], b) for b in range(len(used)) if room[b] - used[b] >= size]
        if fitting:
            b = min(fitting)[1]
        else:
            able = [c for c in lengths if c >= size]
            cost = {c: (c + overhead) / (c * min(1.0, max(put[c] / (opened[c] * c), size / c))) for c in able}
            best = max(c for c in able if cost[c] == min(cost.values()))
            b = len(used)
            used.append(0)
            room.append(best)
            opened[best] += 1
        bins.append(b)
        used[b] += size
        put[room[b]] += size
    return bins, [min(c for c in lengths if c >= n) for n in used]


@given(st.lists(st.integers(0, 100), max_size=120))
def test_against_trying_every_bin(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, _, final = pack(sizes, (10, 30, 100), 2)
    assert (bins, final) == plain_pack(sizes, (10, 30, 100), 2)


ENCODING = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks(RANKS)), special_tokens={})
END = 50256


def test_documents(docs, texts):
    placed = pack_documents(docs, RANKS, public_tokenizers.PATTERN)
    found = placed.collect()
    ids = {i: ENCODING.encode_ordinary(t) for i, t in texts.items()}
    total = Counter()
    for r in found:
        total[r["id"]] += r["n_tokens"]
    assert total == {i: len(x) + 1 for i, x in ids.items()}
    room = {r["bin"]: r["capacity"] for r in found}
    built = {r["bin"]: r for r in packed_sequences(placed, docs, RANKS, public_tokenizers.PATTERN, END).collect()}
    assert built.keys() == room.keys() and all(len(r["ids"]) == r["n_tokens"] <= r["capacity"] == room[b] for b, r in built.items())
    for r in found:
        assert built[r["bin"]]["ids"][r["offset"] : r["offset"] + r["n_tokens"]] == [*ids[r["id"]], END][r["start"] : r["start"] + r["n_tokens"]]
    assert sum(total.values()) > 0.9 * sum(room.values())


def test_packing_odd_rows(odd, empty):
    placed = pack_documents(odd, RANKS, public_tokenizers.PATTERN)
    found = placed.collect()
    assert {r["id"] for r in found} == {r["doc_id"] for r in odd.collect()}
    long = next(r["text"] for r in odd.collect() if r["doc_id"] == 7)
    assert sum(r["n_tokens"] for r in found if r["id"] == 7) == len(ENCODING.encode_ordinary(long)) + 1 and max(r["n_tokens"] for r in found) == 4096
    assert [r["n_tokens"] for r in found if r["id"] in (2, 3)] == [0, 0] and len([r for r in found if r["id"] == 6]) == 2
    built = packed_sequences(placed, odd, RANKS, public_tokenizers.PATTERN, END).collect()
    assert sum(r["n_tokens"] for r in built) == sum(r["n_tokens"] for r in found)
    assert pack_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packed_sequences(pack_documents(empty, RANKS, public_tokenizers.PATTERN), empty, RANKS, public_tokenizers.PATTERN, END).count() == 0


def test_rows_without_an_id_spread_over_shards(spark):
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'some words' as text")
    found = pack_documents(rows, RANKS, public_tokenizers.PATTERN, shard=1000).selectExpr("split(bin, '-')[0] as shard").groupBy("shard").count().collect()
    assert sum(r["count"] for r in found) == 20_000 and max(r["count"] for r in found) < 1500


def test_counts_against_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    found = {}
    for r in count_tokens(docs, RANKS, public_tokenizers.PATTERN).collect():
        found.setdefault(r["id"], []).append(r)
    for r in docs.limit(60).collect():
        record = f"{r['source']}\n{r['lang']}\n{r['text']}"
        spans, own = library.encode(record, add_special_tokens=False).offsets, sorted(found[r["doc_id"]], key=lambda x: x["section"])
        assert sum(x["n_tokens"] for x in own) == len(spans) == own[0]["doc_tokens"]
        assert own[0]["n_tokens"] == sum(s < len(r["source"]) + 1 for s, _ in spans)
        assert b"".join(record.encode()[x["start"] : x["end"]] for x in own) == record.encode()


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_every_line_against_brute_force(docs, rule):
    """Each token goes byte by byte to the sections it lies in; the rule is applied to these counts."""
    found = {(r["id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in count_tokens(docs, RANKS, public_tokenizers.PATTERN, rule=rule).collect()}
    wanted = {}
    for r in docs.collect():
        parts = [r["source"], r["lang"], *r["text"].split("\n")]
        owner = [i for i, x in enumerate(parts) for _ in range(len(x.encode()) + (i + 1 < len(parts)))]
        for i in range(len(parts)):
            wanted[r["doc_id"], i] = [0, 0]
        at = 0
        for t in ENCODING.encode_ordinary("\n".join(parts)):
            n = len(ENCODING.decode_single_token_bytes(t))
            own = owner[at : at + n]
            at += n
            best = {"start": own[0], "end": own[-1], "most": min(set(own), key=lambda i: (-own.count(i), i))}[rule]
            wanted[r["doc_id"], best][0] += 1
            wanted[r["doc_id"], best][1] += own[0] != own[-1]
    assert found == {k: tuple(v) for k, v in wanted.items()}


@pytest.mark.parametrize(("rule", "wanted"), [("start", [0, 0, 1]), ("end", [0, 1, 2]), ("most", [0, 0, 1])])
def test_rules(rule, wanted):
    import numpy as np

    at, crossing = attribute(np.array([0, 2, 6]), np.array([2, 6, 10]), np.array([0, 4, 8]), rule)
    assert at.tolist() == wanted and crossing.tolist() == [False, True, True]


def test_counts_of_odd_rows(odd, empty):
    found = count_tokens(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert {r["id"] for r in found} == {r["doc_id"] for r in odd.collect()}
    assert sum(r["n_tokens"] for r in found if r["id"] == 9 and r["field"] == "text") > 5
    assert count_tokens(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        count_tokens(odd, RANKS, public_tokenizers.PATTERN, rule="none")
