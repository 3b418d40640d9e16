"""Byte-pair encoding of a whole corpus through a tokenization automaton.

The merge list of a byte-level BPE vocabulary is compiled, merge by merge, into
a deterministic automaton over *token* arcs that accepts exactly the canonical
tokenizations.  The start automaton has the byte arcs and one state per byte
(the state is the arc last taken), every arc allowed from every state.  The
gadget of the merge ``(a, b) -> ab``

* adds an arc ``ab`` wherever ``a`` could be followed by ``b``: its way *in* is
  that of ``a`` after the gadget, its way *out* that of ``b`` before it;
* deletes the arc ``b`` from the state reached by ``a``.

Copying whole rows of arcs for 50,000 gadgets would need billions of arcs, so a
gadget is stored as the three integers it consists of (``left``, ``right``,
``rank``) and a transition is looked up in these tables: the later of two
tokens refers to the row it was made from, as it stood at that moment.  A token
that the automaton can never emit (its halves are never neighbours when its
gadget is built) gets no arc.

A pre-split word is encoded in one run from left to right.  The state at a byte is
the token whose arc ends there; from it the byte trie of the arcs, a table of
transitions, is followed as far as it spells the word, and every arc that the
state has sets the state at its end.  The automaton being unambiguous, a position
gets one state only, so nothing is ever taken back; the path is read off at the end.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt

#: Pre-splitting pattern of the vocabulary (a fixed value of byte_bpe_50k).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
NEVER = 2**31 - 1


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k.json``; ``PAGELENS_TOKENIZER`` overrides it."""
    if path := os.environ.get("PAGELENS_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Compact tables of a byte-level BPE file: bounded by the vocabulary.

    ``spelling``: bytes of each id; ``left``/``right``: halves of each id (-1
    for the bytes); ``rank``: place of its merge (-1 for the bytes).
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, of = model["vocab"], byte_alphabet()
    n = max(vocab.values()) + 1
    left, right, rank = (np.full(n, -1, np.int32) for _ in range(3))
    for k, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        i = vocab[a + b]
        left[i], right[i], rank[i] = vocab[a], vocab[b], k
    spelling: list[bytes | None] = [None] * n
    for token, i in vocab.items():
        if rank[i] >= 0 or len(token) == 1:
            spelling[i] = bytes(of[c] for c in token)
    return {"spelling": spelling, "left": left, "right": right, "rank": rank}


class Automaton:
    """Deterministic tokenization automaton; see the module text."""

    def __init__(self, tables: dict):
        self.left = tables["left"].tolist()
        self.right = tables["right"].tolist()
        self.rank = tables["rank"].tolist()
        self.spelling = tables["spelling"]
        self.pair = {
            (a, b): r for a, b, r in zip(self.left, self.right, self.rank) if r >= 0
        }
        self._follows: dict[int, bool] = {}
        self.arc: dict[bytes, int] = {}
        # successive gadgets: in rank order, each sees the arcs built so far
        emitted = [False] * len(self.rank)
        for i in sorted(range(len(self.rank)), key=self.rank.__getitem__):
            if self.spelling[i] is None:
                continue
            a, b, r = self.left[i], self.right[i], self.rank[i]
            emitted[i] = r < 0 or (
                emitted[a] and emitted[b] and self._arc_at(a, b, r)
            )
            if emitted[i]:
                self.arc[self.spelling[i]] = i
        # trie: node * 256 + byte -> node; token: arc that ends at a node, or -1
        self.trie: dict[int, int] = {}
        self.token = [-1]
        for spelled, i in self.arc.items():
            node = 0
            for x in spelled:
                to = self.trie.get(node << 8 | x)
                if to is None:
                    to = self.trie[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.size = [0 if x is None else len(x) for x in self.spelling]
        self._words: dict[str, tuple[int, ...]] = {}

    def _arc_at(self, t: int, u: int, before: int) -> bool:
        """Whether state ``t`` has arc ``u`` once the gadgets of rank < ``before`` stand."""
        rank, pair = self.rank, self.pair
        while True:
            if pair.get((t, u), NEVER) < before:
                return False
            rt, ru = rank[t], rank[u]
            if rt < 0 and ru < 0:
                return True
            if ru >= rt:  # the way in is the left half's, after the gadget
                u, before = self.left[u], ru + 1
            else:  # the way out is the right half's, before the gadget
                t, before = self.right[t], rt

    def follows(self, t: int, u: int) -> bool:
        """The transition table: state ``t`` has an arc ``u``."""
        key = t << 32 | u
        if (x := self._follows.get(key)) is None:
            if len(self._follows) > 2_000_000:  # memory of a worker; only a cache
                self._follows.clear()
            x = self._follows[key] = self._arc_at(t, u, NEVER)
        return x

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """Ids along the only accepting path that spells ``word``: one run, no search."""
        whole = self.arc.get(word)
        if whole is not None:
            return (whole,)
        n, trie, token, known, follows = len(word), self.trie, self.token, self._follows, self.follows
        states = [-1] * (n + 1)
        for at in range(n):
            state = states[at]
            if state < 0 and at:
                continue  # no arc ends here
            node, high = 0, state << 32
            for end in range(at, n):
                node = trie.get(node << 8 | word[end])
                if node is None:
                    break
                t = token[node]
                if t >= 0:
                    ok = True if not at else known.get(high | t)
                    if ok or ok is None and follows(state, t):
                        states[end + 1] = t
        if n and states[n] < 0:
            raise ValueError("the vocabulary lacks a byte of the word")
        path, at = [], n
        while at:
            path.append(states[at])
            at -= self.size[states[at]]
        return tuple(path[::-1])

    def encode(self, text: str | None, split) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        words = self._words
        for w in split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    if len(words) > 400_000:  # memory of a worker; only a cache
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """Labels of the arcs, one after another."""
        return b"".join(self.spelling[i] for i in ids).decode("utf-8", "replace")


def _automaton(shared) -> Automaton:
    """The automaton of this worker process, built once per vocabulary.

    This module travels with each task, so what outlives a task is kept in ``sys``.
    """
    name, tables = shared
    held = sys.__dict__.setdefault("_pagelens_automata", {})
    if name not in held:
        held.clear()
        held[name] = Automaton(tables.value)
    return held[name]


def _share(spark: SparkSession, path: str | None):
    """Name and broadcast of the compact tables: under 2 MB, bounded by the vocabulary."""
    path = path or default_vocabulary()
    stat = os.stat(path)
    name = f"{path} {stat.st_size} {stat.st_mtime_ns}"
    return name, spark.sparkContext.broadcast(read_vocabulary(path))


def encode(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None
) -> DataFrame:
    """``(key, ids)``: token ids of every row's whole text.

    No special tokens are added and their spellings in a text are ordinary text.
    Null and empty texts give an empty list; repeated keys keep a row each; other
    columns are not read, so clashing names do no harm.  No shuffle.
    """
    shared, typ = _share(df.sparkSession, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        fa, split = _automaton(shared), regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the lists held at once
                part = batch.slice(at, 512)
                ends, flat = [0], []
                for t in part.column(1):
                    flat += fa.encode(t.as_py(), split)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat, pa.int32())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return dealt(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {typ}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``(key, text)`` of ``(key, ids)``; null ids give an empty text."""
    shared, typ = _share(df.sparkSession, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fa = _automaton(shared)
        for batch in batches:
            texts = [fa.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=[key, "text"]
            )

    return df.select(F.col(key), F.col("ids")).mapInArrow(run, f"`{key}` {typ}, text string")


def count(df: DataFrame, key: Column | str, text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, n_tokens)`` of every row: as :func:`encode`, but only the sizes leave Python."""
    rows = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.col(text).alias("text"))
    shared, typ = _share(df.sparkSession, path), rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        fa, split = _automaton(shared), regex.compile(PATTERN).findall
        for batch in batches:
            n = [len(fa.encode(t.as_py(), split)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"]
            )

    return dealt(rows).mapInArrow(run, f"key {typ}, n_tokens bigint")
