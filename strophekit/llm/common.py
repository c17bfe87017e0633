"""Helpers shared by the operators: table access, written intermediate tables,
and vectorised word hashing."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophekit.session import scratch_path

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives the loss
    of executors, and is computed once however often it is read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python a few at a time, so that a worker's
    memory does not depend on Spark's default of 10,000 rows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def task_cache(owner: str) -> dict:
    """A dictionary that a Python worker process keeps for its next tasks, for
    automata and memo tables that are costly to build.  It holds one operator's
    entries: when another operator's task comes, they go."""
    held = sys.__dict__.setdefault("_strophekit_task_cache", {})
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner
        release()
    return held


def release() -> None:
    """Memory that is no longer used goes back to the system, so that a worker
    which waits for its next task does not hold it."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(owner: str):
    """Decorator of functions from an iterator of batches to one of results:
    what other operators left in the worker goes first, and what this task used
    goes at its end, but for its entries in ``task_cache``."""
    def around(run):
        @functools.wraps(run)
        def wrapped(batches):
            task_cache(owner)
            yield from run(batches)
            release()
        return wrapped
    return around


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.  A bound variable stays one
    when a filter is pushed below a projection; a column would be copied into
    every place that reads it, and so into lambdas that run once per word."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_fold(doc_id, folds: int):
    """crc32 of the id written in decimal, modulo ``folds`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POSITION_FACTOR = np.uint64(0xD1342543DE82EF95)
# 0x20 and 0x09-0x0D
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BLOCK_BYTES = 1 << 20


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every non-empty byte run ``buf[starts[i]:ends[i]]``; runs
    are ascending and do not overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    longest = int(lens.max())
    powers = np.cumprod(np.full(longest, POSITION_FACTOR, np.uint64))
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    within = np.arange(total) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    sums = np.add.reduceat(BYTE_CODE[buf[at]] * powers[within], first)
    return mix64(sums ^ (lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def space_blocks(data: bytes) -> Iterator[np.ndarray]:
    """``data`` in blocks of about a megabyte, cut only at white space, so that
    very long texts need bounded working memory."""
    buf = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(buf):
        end = min(len(buf), at + BLOCK_BYTES)
        while end < len(buf):
            gap = np.flatnonzero(IS_SPACE[buf[end:end + BLOCK_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(buf), end + BLOCK_BYTES)
        yield buf[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word, words being runs without ASCII white space."""
    out = []
    for buf in space_blocks(data):
        inside = np.concatenate(([False], ~IS_SPACE[buf], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(run_hashes(buf, edges[::2], edges[1::2]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words: one hash of them all;
    no word: none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    acc = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[i:n - k + 1 + i])
    return acc
