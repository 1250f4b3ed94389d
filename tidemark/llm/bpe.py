"""Byte-pair encoding and decoding through a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges yield. It starts as one state with
a loop for every byte. Merge number i of (u, v) adds a gadget: wherever an arc u leads to a state with an
arc v, the state behind u is cloned without its arc v, the arcs u lead to the clone, and an arc for the new
token uv goes beside every arc u to where v led. So the automaton is deterministic and its state depends on the last token only; the states of
one token form a line of clones, each short of one more arc. The compiled form is that of the gadgets: the arcs that each one
removed, by its number, and for each token the line of states that its own descends from (`behind`) and the line of
tokens that begin it (`begun`). A row of the transition table is written out when a state is first entered by a token.

A word is encoded in one pass over its bytes, without turning back: every prefix of a word has exactly one accepted
path, so the state after each prefix is settled once, by the longest vocabulary entry that ends there (found by a trie with
suffix links) and that the table lets leave the state where the entry begins. The states' tokens, read from the end, are the
encoding. Decoding emits the arcs' labels.

Both operators are maps over rows; nothing is shuffled. The merges (bounded by the file) are broadcast, the automaton is compiled once in each Python worker.

Edge cases: null and empty texts encode to no ids and decode to the empty text. Repeated rows are kept.
Very long words take time in proportion to their length. Columns other than the named ones are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as Unicode lists it, and the pattern that splits texts before the merges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words whose ids are kept in a Python worker before the table is emptied.
KEPT_WORDS = 400_000
#: Transitions that are kept, likewise.
KEPT_ARCS = 2_000_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """What an automaton is compiled from: bytes by id; (left, right, made) in order; texts with ids of their own."""

    labels: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class MergeAutomaton:
    """The deterministic automaton over tokens, and the tables that drive it."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """labels: bytes by id; merges: (left, right, made) in order; special: texts with ids of their own."""
        self.labels, self.special = labels, special
        never = len(merges) + 1
        #: The tokens whose states a token's state descends from, each with the gadget at which the line left it; and the tokens that begin it, alike.
        self.behind = {t: ((t, never),) for t, x in labels.items() if len(x) == 1}
        self.begun = dict(self.behind)
        self.removed: dict[tuple[int, int], int] = {}  # arc missing behind a token, and since which gadget
        for i, (u, v, w) in enumerate(merges, 1):
            if u in self.behind and v in self.behind and w not in self.behind and self.leads(u, v):
                self.removed[u, v] = i
                self.behind[w] = ((w, never), (v, i), *self.behind[v][1:])
                self.begun[w] = ((w, never), (u, i), *self.begun[u][1:])
        self.ends = ahocorasick.Automaton()
        for t in self.behind:
            self.ends.add_word(labels[t].decode("latin-1"), (len(labels[t]), t))
        if len(self.ends):
            self.ends.make_automaton()
        self.whole = {labels[t]: t for t in self.behind}
        self.table: dict[int, bool] = {}  # transitions written out so far, by state and token
        self.words: dict[str, bytes] = {}
        self.pattern = regex.compile(PIECES)
        self.split = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None

    def leads(self, u: int, t: int) -> bool:
        """Whether the state behind u has an arc t: no gadget on its line removed t, or what t was then a part of."""
        removed = self.removed
        for a, until in self.behind[u]:
            for x, born in self.begun[t]:
                lost = removed.get((a, x))
                if lost is not None and lost < until and lost <= born:
                    return False
        return True

    def path(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        table, n = self.table, len(word)
        state, begins = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and where it begins
        for end, (size, t) in self.ends.iter(word.decode("latin-1")):
            end += 1
            if state[end] >= 0:  # a longer one was let through
                continue
            start = end - size
            if start:
                arc = state[start] << 32 | t
                let = table.get(arc)
                if let is None:
                    let = table[arc] = self.leads(state[start], t)
                if not let:
                    continue
            state[end], begins[end] = t, start
        out, at = [], n
        while at:
            out.append(state[at])
            at = begins[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned integers of 32 bits."""
        words, out = self.words, []
        for part in self.split.split(text) if self.split else [text]:
            if not part:
                continue
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            pieces = self.pattern.findall(part)
            for w in set(pieces).difference(words):
                words[w] = np.array(self.path(w.encode()), "<u4").tobytes()
            out += map(words.__getitem__, pieces)
        if len(words) > KEPT_WORDS:
            words.clear()
        if len(self.table) > KEPT_ARCS:
            self.table.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text whose arcs' labels the ids are."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def read_merges(path: str) -> Merges:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, names = spec["model"], _byte_names()
    if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a plain byte-level BPE vocabulary is asked for")
    vocab = model["vocab"]
    labels = {i: bytes(names[c] for c in x) for x, i in vocab.items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Merges(labels | {i: x.encode() for x, i in special.items()}, merges, special)


_compiled: dict[str, MergeAutomaton] = {}


def compiled(own: Merges) -> MergeAutomaton:
    """The automaton of these merges, compiled when a Python worker first asks for it."""
    if own.name not in _compiled:
        _compiled.clear()
        _compiled[own.name] = MergeAutomaton(own.labels, own.merges, own.special)
    return _compiled[own.name]


def _by_size(values: list, limit: int = 1 << 20) -> Iterator[list]:
    """Runs of values of about `limit` characters or bytes."""
    own, size = [], 0
    for x in values:
        own.append(x)
        size += len(x)
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def _mapped(rows: DataFrame, own: Merges, work: Callable[[MergeAutomaton, list], list[pa.Array]], schema: str, limit: int) -> DataFrame:
    """(id, x) to (id, *work(automaton, values of x)), in small batches."""
    shared = rows.sparkSession.sparkContext.broadcast(own)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for b in batches:
            at = 0
            for x in _by_size(b.column(1).to_pylist(), limit):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(x)], *work(machine, x)], names)
                at += len(x)

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, {schema.split(', ', 1)[1]}")


def encode_texts(docs: DataFrame, merges: Merges, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each text as little-endian unsigned 32-bit integers in one binary value."""

    def work(machine: MergeAutomaton, texts: list[str]) -> list[pa.Array]:
        return [pa.array(map(machine.encode, texts), pa.binary(), size=len(texts))]

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _mapped(rows, merges, work, "id, ids binary", 1 << 20)


def decode_ids(encoded: DataFrame, merges: Merges, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the ids and the text that they stand for; null ids give the empty text."""

    def work(machine: MergeAutomaton, ids: list[bytes]) -> list[pa.Array]:
        return [pa.array(ids, pa.binary()), pa.array(map(machine.decode, ids), pa.string(), size=len(ids))]

    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _mapped(rows, merges, work, "id, ids binary, text string", 1 << 21)
