import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import MergeAutomaton, compiled, decode_ids, encode_texts, read_merges
from tidemark.llm.queries import op10_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
MERGES = read_merges(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return compiled(MERGES)


def successive(word, merges):
    """Merges applied one after the other, each from left to right."""
    parts = [x for x in word]
    for u, v, w in merges:
        i, out = 0, []
        while i < len(parts):
            if parts[i : i + 2] == [u, v]:
                out.append(w)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_random_merges(seed):
    rnd = random.Random(seed)
    labels, merges = {i: bytes([97 + i]) for i in range(3)}, []
    for _ in range(12):
        u, v = rnd.choice(list(labels)), rnd.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = labels[u] + labels[v]
    machine = MergeAutomaton(labels, merges, {})
    for _ in range(40):
        word = [rnd.randrange(3) for _ in range(rnd.randint(1, 14))]
        assert machine.path(bytes(97 + x for x in word)) == successive(word, merges)


def test_odd_texts(library, automaton):
    rnd = random.Random(1)
    cases = ["", "a" * 3000, " " * 300 + "x", "<|endoftext|>a<|endoftext|> <|endoftext|>", "é́ǅ​\x85 x", "\x1c\x1d a", "don't I'D", "😀 👨‍👩‍👧", "<|endoftext|"]
    cases += ["".join(rnd.choice("ab thein \n'sé1中😀<|>") for _ in range(120)) for _ in range(200)]
    for text in cases:
        ids = np.frombuffer(automaton.encode(text), "<u4").tolist()
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == wanted and automaton.decode(automaton.encode(text)) == library.decode(wanted, skip_special_tokens=False)


def test_corpus(spark, sf_dir, texts, library):
    found = {r["doc_id"]: r for r in op10_bpe(spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(odd, empty):
    found = {r["id"]: r for r in decode_ids(encode_texts(odd, MERGES), MERGES).collect()}
    assert all(found[r["doc_id"]]["text"] == (r["text"] or "") for r in odd.collect())
    assert found[2]["ids"] == b"" and encode_texts(odd, MERGES).count() == odd.count()
    assert decode_ids(encode_texts(empty, MERGES), MERGES).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert decode_ids(rows, MERGES).first()["text"] == ""
