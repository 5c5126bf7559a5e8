"""Minimizers, the anchors two sequences share, and the chain through them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoloom.operators.seeds import codes, kmer_values
from isoloom.runtime import prepare


def kmers(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and position of every k-mer of bases only."""
    code = codes(seq)
    if len(code) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.concatenate([[0], np.cumsum(code == 4)])
    at = np.flatnonzero(other[k:] == other[:-k])
    return kmer_values(code, k)[at].view(np.int64), at


def homopolymers(k: int) -> np.ndarray:
    """The values of the four k-mers of one base."""
    return np.arange(4, dtype=np.int64) * ((4**k - 1) // 3)


def minimizers(seq: str, k: int = 15, w: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer, position) of the smallest k-mer of each w consecutive ones, sorted; homopolymers are left out."""
    value, at = kmers(seq, k)
    if len(value) >= max(w, 1):
        lead = np.lib.stride_tricks.sliding_window_view(value, w).argmin(axis=1) + np.arange(len(value) - w + 1)
        lead = lead[np.concatenate([[True], lead[1:] != lead[:-1]])]
        value, at = value[lead], at[lead]
    keep = ~np.isin(value, homopolymers(k))
    value, at = value[keep], at[keep]
    order = np.lexsort((at, value))
    return value[order], at[order]


def read_minimizers(reads: DataFrame, k: int = 15, w: int = 10) -> DataFrame:
    """(read_idx, kmer, pos) of every read."""
    prepare(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimizers(s or "", k, w) for s in batch.column("seq").to_pylist()]
            sizes = [len(v) for v, _ in found]
            ids = np.repeat(batch.column("read_idx").to_numpy(), sizes)
            join = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(join(0)), pa.array(join(1).astype(np.int32))], names=["read_idx", "kmer", "pos"])

    return reads.select("read_idx", "seq").mapInArrow(run, "read_idx long, kmer long, pos int")


def shared_anchors(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every (read_pos, backbone_pos) at which two sequences share a k-mer: an equi-join on the pair's keys and k-mer."""
    return left.withColumnRenamed("pos", "read_pos").join(right.withColumnRenamed("pos", "backbone_pos"), [*keys, "kmer"])


def greedy_chain(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The anchors above every earlier backbone position, by a running maximum."""
    order = Window.partitionBy(*keys).orderBy("read_pos", F.desc("backbone_pos"))
    before = F.max("backbone_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return anchors.withColumn("before", before).where("before IS NULL OR backbone_pos > before").drop("before")


# ---- kernels on one pair ----


def anchors_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows (position in a, position in b) of all shared k-mers."""
    lo, hi = np.searchsorted(b[0], a[0], "left"), np.searchsorted(b[0], a[0], "right")
    times = hi - lo
    total = int(times.sum())
    if not total:
        return np.zeros((0, 2), np.int64)
    within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    return np.stack([np.repeat(a[1], times), b[1][np.repeat(lo, times) + within]], axis=1)


def chain(anchors: np.ndarray) -> np.ndarray:
    """The longest run of anchors that rises strictly in both positions."""
    if len(anchors) < 2:
        return anchors
    anchors = anchors[np.lexsort((-anchors[:, 1], anchors[:, 0]))]
    y = anchors[:, 1]
    if (y[1:] > y[:-1]).all():
        return anchors
    tops: list[int] = []  # smallest end of a chain of each length
    ends: list[int] = []  # and the anchor there
    back = [-1] * len(anchors)
    for i, v in enumerate(y.tolist()):
        n = bisect_left(tops, v)
        back[i] = ends[n - 1] if n else -1
        tops[n : n + 1], ends[n : n + 1] = [v], [i]
    path, i = [], ends[-1]
    while i >= 0:
        path.append(i)
        i = back[i]
    return anchors[path[::-1]]
