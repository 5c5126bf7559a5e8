"""Byte-pair encoding by speculation: greedy longest match proposes, a pair test verifies, only failing words are merged exactly.

A text falls apart at white space, and tokens never cross it; so each distinct word is encoded
once in a task and a text's ids are gathered from its words. For a word:

1. propose: the longest token at each position, left to right;
2. verify: a proposal is the true encoding if each of its tokens encodes to itself and each
   adjacent pair does. Pairs are tested all together, as one sorted array of pair codes against
   those already judged; a pair not seen before is judged once, by merging its string exactly;
3. repair: a word with an incompatible pair is merged exactly, lowest rank first.

The tokenizer's file gives vocabulary, merges and normalisation (NFC, lower case, the word
pattern, byte-level letters, a word-end mark). Its special tokens are recognised in the raw text.

Defined results: a null or empty text has no ids; equal texts have equal ids; a lone space, very
long words and texts of any length are encoded whole; decoding joins the tokens' strings with one
space, as the tokenizer without a decoder does, and fails on an unknown id. Further columns are
passed through only where named.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm import textkernel as K
from isoloom.runtime import prepare

#: Distinct words remembered in a task; beyond, it starts over.
CACHE_WORDS = 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Encoder:
    """A tokenizer file's rules, and what has been found out about words and pairs of tokens so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pair_rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.no_rank = len(merges)
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.letter_of = dict(enumerate(byte_letters()))
        self.longest = max(map(len, self.vocab))
        self.whole: dict[str, list[int]] = {}
        self.good: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.repaired = 0

    # One piece (a match of the word pattern), as byte letters with the end mark on the last.

    def symbols(self, piece: str) -> list[str]:
        out = list(piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letter_of))
        out[-1] += self.end
        return out

    def merged(self, symbols: list[str]) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost among equals.

        A heap of (rank, place) over a linked list: n log n in the length of the word.
        """
        get, none, made = self.pair_rank.get, self.no_rank, self.made
        ids = [self.vocab[x] for x in symbols]
        n = len(ids)
        if n < 2:
            return ids
        heap = [(rank, i) for i, (a, b) in enumerate(pairwise(ids)) if (rank := get(a << 20 | b, none)) != none]
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j == n or get(ids[i] << 20 | ids[j], none) != rank:
                continue  # one of the two has merged since
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get(ids[i] << 20 | ids[k], none)) != none:
                    heappush(heap, (rank, i))
            k = before[i]
            if k >= 0 and (rank := get(ids[k] << 20 | ids[i], none)) != none:
                heappush(heap, (rank, k))
        return [t for t in ids if t >= 0]

    def greedy(self, symbols: list[str]) -> list[int] | None:
        """The longest token at each position; None where no token fits."""
        text = "".join(symbols)
        body = len(symbols) - 1  # letters before the last, which carries the end mark
        vocab, out, i = self.vocab, [], 0
        while i <= body:
            token = vocab.get(text[i:]) if body - i < self.longest else None
            if token is not None:
                out.append(token)
                return out
            for j in range(min(body, i + self.longest), i, -1):
                token = vocab.get(text[i:j])
                if token is not None:
                    break
            else:
                return None
            out.append(token)
            i = j
        return out

    def units(self, token: int) -> list[str]:
        text = self.tokens[token]
        if self.end and text.endswith(self.end) and len(text) > len(self.end):
            text = text[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(text)

    def judge(self, left: int, right: int) -> bool:
        """Does the string of two tokens encode to just these two? Decided by exact merging, once."""
        return self.merged(self.units(left) + self.units(right)) == [left, right]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pieces: proposed, all pairs verified at once, failures merged."""
        symbols = [self.symbols(p) for p in pieces]
        proposed = [self.greedy(s) for s in symbols]
        fails = [p is None for p in proposed]
        counts = np.array([0 if p is None else len(p) for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed if p for t in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(pieces)), counts)
        bad = np.zeros(len(pieces), bool)
        if len(flat):
            singles, where = np.unique(flat, return_inverse=True)
            for t in singles.tolist():
                if t not in self.alone:
                    self.alone[t] = self.merged(self.units(t)) == [t]
            bad[owner[~np.array([self.alone[t] for t in singles.tolist()])[where]]] = True
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            codes, where = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
            for code in codes.tolist():
                if code not in self.good:
                    self.good[code] = self.judge(code >> 20, code & 0xFFFFF)
            if len(codes):
                verdict = np.array([self.good[c] for c in codes.tolist()])
                bad[owner[inner[~verdict[where]]]] = True
        out = []
        for i, p in enumerate(proposed):
            if fails[i] or bad[i]:
                self.repaired += 1
                p = self.merged(symbols[i])
            out.append(p)
        return out

    def pieces(self, word: str) -> list[str | int]:
        """A word's pieces; a special token is its id."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        out: list[str | int] = []
        for part in self.split_special.split(word) if self.split_special and self.split_special.search(word) else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = part if part.isascii() else unicodedata.normalize("NFC", part)
                low = "".join(c.lower() for c in low) if "\u03a3" in low else low.lower()
                out.extend(self.pattern.findall(low))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words (no white space within)."""
        parts = [self.pieces(w) for w in words]
        new = list(dict.fromkeys(p for ps in parts for p in ps if isinstance(p, str) and p not in self.whole))
        if len(self.whole) + len(new) > CACHE_WORDS:
            self.whole.clear()
            new = list(dict.fromkeys(p for ps in parts for p in ps if isinstance(p, str)))
        self.whole.update(zip(new, self.encode_pieces(new), strict=True))
        return [[i for p in ps for i in ([p] if isinstance(p, int) else self.whole[p])] for ps in parts]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


class WordTable:
    """Distinct words of a task by hash, with what `describe` makes of each; `lookup` gives rows of the table."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, K.U)
        self.rows = np.zeros(0, np.int64)
        self.ids: list = []

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each word; unknown words are encoded first."""
        distinct, first, where = np.unique(K.span_hash(K.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        rows = np.zeros(len(distinct), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = buf.tobytes()
            words = [data[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            rows[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self.ids.extend(self.encode(words))
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], rows[new])
        return rows[where]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def table(path: str) -> WordTable:
    """Words with (number of ids, ids as text, decoded text); one for each Python worker."""
    e = encoder(path)

    def describe(words: list[str]):
        return [(len(i), " ".join(map(str, i)), e.decode(i)) for i in e.encode_words(words)]

    return WordTable(describe)


@lru_cache(maxsize=2)
def id_table(path: str) -> WordTable:
    return WordTable(encoder(path).encode_words)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the ids (array<int>) of every whole text."""
    prepare(docs.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = id_table(path)
        for batch in batches:
            for lo, hi, buf, offsets in K.text_chunks(batch.column("_text")):
                starts, ends, bounds = K.word_spans(buf, offsets)
                rows = words.lookup(buf, starts, ends).tolist()
                b = bounds.tolist()
                ids = [[t for r in rows[b[i] : b[i + 1]] for t in words.ids[r]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "ids array<int>"])
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the decoded text of `ids` (null: empty)."""
    prepare(ids.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join([*(f"`{n}` {ids.schema[n].dataType.simpleString()}" for n in names), "text string"])
    return ids.select(*names, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text in one pass; only counts and digests leave the task."""
    prepare(docs.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table(path)
        for batch in batches:
            n_tokens, ids, texts = [], [], []
            for lo, hi, buf, offsets in K.text_chunks(batch.column("_text")):
                starts, ends, bounds = K.word_spans(buf, offsets)
                rows = words.lookup(buf, starts, ends).tolist()
                b = bounds.tolist()
                for i in range(hi - lo):
                    found = [w for r in rows[b[i] : b[i + 1]] if (w := words.ids[r])[0]]
                    n_tokens.append(sum(w[0] for w in found))
                    ids.append(hashlib.sha256(" ".join([w[1] for w in found]).encode()).hexdigest())
                    texts.append(hashlib.sha256(" ".join([w[2] for w in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)
