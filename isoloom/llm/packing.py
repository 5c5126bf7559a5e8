"""Packing documents into training sequences by the sum-of-squares rule, online within each task.

A task keeps an array of levels: how many open windows are filled to each level. A document's
whole windows are closed at once; its rest goes to the level whose choice makes the sum of the
squared counts smallest (an empty window is level 0), ties to the fullest. That keeps windows of
every kind in stock, so later rests find a fit. At the end of a task, or when too many windows
are open, what is still open is poured together and cut at the window size; the last piece is cut
into powers of two, so nothing needs padding.

No shuffle: every task packs what it has read, and its sequence ids carry the partition number,
so a repeated task gives the same rows.

Defined results: a null or empty text is the end token alone; a null doc_id is kept; repeated
rows are packed each on its own; very long texts are cut in whole windows as they are read; an
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm import textkernel as K
from isoloom.runtime import prepare

WINDOW = 4096
END_TOKEN = 2
#: Open windows a task holds at most; their ids are kept in memory until they close.
MOST_OPEN = 2048
#: Distinct words and their ids remembered in a worker; beyond either, it starts over.
CACHE_WORDS, CACHE_IDS = 1_000_000, 6_000_000
#: Words given to the tokenizer at a time: its results are large objects.
ENCODED_WORDS = 2048
#: Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 18


class Packer:
    """Sum-of-squares packing of one task's documents."""

    def __init__(self, window: int, first_sequence: int):
        self.window = window
        self.next_sequence = first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids), total, self.next_sequence, at, ids))
            at += len(ids)
        self.next_sequence += 1

    def level_for(self, size: int) -> int:
        """The level to fill up: the smallest change of the sum of squares, ties to the fullest."""
        room = self.window - size
        here, there = self.levels[: room + 1], self.levels[size : self.window + 1].copy()
        there[room] = 0  # a full window is closed, not counted
        change = 2 * (there - here) + 2
        change[0] = 2 * there[0] + 1 if room else 1
        if room:
            change[room] = 1 - 2 * here[room]
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.close([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        size = total - start
        if not size:
            return
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append((doc, start, ids[start:].copy() if start else ids, total))  # a view would hold the whole document
        if level + size == self.window:
            self.close(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open > MOST_OPEN:
            self.pour()

    def pour(self) -> None:
        """Close every open window: its pieces are cut anew at the window size, the last ones at powers of two."""
        loose = []
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                if level & (level - 1):
                    loose.extend(pieces)
                else:
                    self.close(pieces)
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) for p in loose)
        target, filled, now = 0, 0, []
        for doc, start, ids, total in loose:
            while len(ids):
                if not target:
                    target = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(target - filled, len(ids))
                now.append((doc, start, ids[:take], total))
                start, ids, filled = start + take, ids[take:], filled + take
                if filled == target:
                    self.close(now)
                    left -= target
                    target, filled, now = 0, 0, []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


class IdTable:
    """The ids of distinct words, flat, found by the words' hashes."""

    def __init__(self, encode, kind=np.uint32):
        self.encode, self.kind = encode, kind
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, K.U), np.zeros(0, np.int32)
        self.starts, self.flat = np.zeros(1, np.int32), np.zeros(0, self.kind)

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of each word's."""
        distinct, first, where = np.unique(K.span_hash(K.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        rows = np.zeros(len(distinct), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = buf.data
            rows[new] = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(new))
            sizes, flat = [], [self.flat]
            for k in range(0, len(new), ENCODED_WORDS):
                some = first[new[k : k + ENCODED_WORDS]]
                got = self.encode([str(data[s:e], "utf-8") for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                sizes.extend(map(len, got))
                flat.append(np.fromiter(chain.from_iterable(got), self.kind, sum(map(len, got))))
            sizes = np.array(sizes, np.int64)
            self.flat = np.concatenate(flat)
            self.starts = np.concatenate([self.starts, (self.starts[-1] + np.cumsum(sizes)).astype(np.int32)])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], rows[new])
        rows = rows[where]
        sizes = (self.starts[rows + 1] - self.starts[rows]).astype(np.int64)
        ends_at = np.cumsum(sizes)
        total = int(ends_at[-1]) if len(ends_at) else 0
        shift = np.repeat(self.starts[rows] - (ends_at - sizes), sizes)
        return self.flat[np.arange(total) + shift], sizes


@lru_cache(maxsize=2)
def id_table(path: str) -> IdTable:
    """Words and their ids by the tokenizers library; one table for each Python worker."""
    # Tasks are the threads here: a pool in every worker would hold memory and fight for the same cores.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    return IdTable(encode, np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    `path` names a tokenizer file in which white space separates words (see bpe.py): a text's ids
    are those of its words, so each distinct word is encoded once in a task.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        table, id_type = id_table(path), None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.taken(), strict=True))
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[7], pa.list_(pa.int32()))] if with_ids else [])], names=names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in K.text_chunks(batch.column("text"), CHUNK_BYTES):
                starts, ends, bounds = K.word_spans(buf, offsets)
                ids, sizes = table.ids(buf, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                cut = np.concatenate([[0], np.cumsum(sizes)])[bounds]
                for i in range(hi - lo):
                    packer.add(doc_ids[lo + i], np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_token)).astype("<u4"))
                if packer.out:
                    yield rows()
        packer.pour()
        if packer.out:
            yield rows()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
