"""Operator 13: vectors compressed to codes by exact integer product quantisation.

Each component x becomes the integer floor(4096 x).  A vector is cut into 8 equal
consecutive parts; every part position has a codebook of 16 entries, which starts as
that part of the 16 smallest ids and is moved 6 times to the floor of the mean of the
parts assigned to each entry.  An entry without parts stays.

The nearest entry is found on Walsh-Hadamard coefficients.  Parts and entries are padded
with zeros to a power of two m and transformed by integer additions alone; the squared
differences of all m coefficients add up to m times the squared distance.  They are
added in sequency order, the slowest patterns first.  A first guess is measured in full;
an entry leaves as soon as its sum exceeds that of the guess, since a sum only grows.
Entries equally near all last to the end, where the lowest index wins.  There is no
floating point after the first floor: blocks whose sums might pass 64 bits are computed
with Python integers instead.

A round is one pass over the vectors; each task returns sums and counts per entry, Spark
adds them, and only the codebooks (16 entries) come to the driver.

Left out: null vectors, empty ones, those with null or non-finite components, and those whose
length differs from that of the smallest id kept.  Null ids come last among ids; equal ids are
ordered by their vectors.  A length that 8 does not divide is padded with zeros at its end.
Fewer than 16 vectors: as many entries.  Errors beyond 64 bits are given as the greatest long.
Repeated rows are rows of their own.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
GREATEST = (1 << 63) - 1
SALTS = 16


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x), as 64-bit integers, or as Python integers when some are large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0) < 1 << 52:
        return scaled.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def cut(vectors: np.ndarray) -> np.ndarray:
    """``(n, PARTS, width)``, padded with zeros at the end where 8 does not divide the length."""
    n, length = vectors.shape
    width = -(-length // PARTS)
    out = np.zeros((n, PARTS * width), vectors.dtype)
    out[:, :length] = vectors
    return out.reshape(n, PARTS, width)


def sequency_order(m: int) -> np.ndarray:
    """Places of the coefficients of a natural-order transform by number of sign changes."""
    bits = m.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(m)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows, zero-padded, in sequency order."""
    n, width = x.shape
    m = 1 << (width - 1).bit_length()
    out = np.zeros((n, m), x.dtype)
    out[:, :width] = x
    step = 1
    while step < m:
        pairs = out.reshape(n, m // (2 * step), 2, step)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack((a + b, a - b), axis=2).reshape(n, m)
        step *= 2
    return out[:, sequency_order(m)]


def fits(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether m times every squared distance is below 2^62."""
    width = points.shape[-1]
    m = 1 << (width - 1).bit_length()
    top = max(abs(points.max(initial=0)), abs(points.min(initial=0)), abs(entries.max(initial=0)), abs(entries.min(initial=0)))
    return m * width * (2 * int(top)) ** 2 < 1 << 62


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower one of ties, and its squared distance."""
    kind = np.int64 if fits(points, entries) else object
    x, e = hadamard(points.astype(kind)), hadamard(entries.astype(kind))
    n, m = x.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, kind)
    sums = (x[:, None, 0] - e[None, :, 0]) ** 2
    guess = sums.argmin(axis=1)
    limit = ((x - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= limit[:, None])
    total = sums[row, entry]
    for c in range(1, m):
        total = total + (x[row, c] - e[entry, c]) ** 2
        stays = (total <= limit[row]).astype(bool)
        row, entry, total = row[stays], entry[stays], total[stays]
    # rows ascend and entries ascend within a row: the first of the least is the answer
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero((total == least[row]).astype(bool))
    _, first = np.unique(row[hits], return_index=True)
    return entry[hits[first]], least // m


def vectors_kept(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec``: the rows whose vector is whole and finite."""
    vec = F.col("embedding")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return rows.select("vec_id", "label", vec.alias("vec")).filter(vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(whole, F.lit(False)))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moved(kept: DataFrame, books: list) -> list:
    """The codebooks after one round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = cut(integers(_matrix(batch.column("vec"))))
            for p, book in enumerate(books):
                at, _ = nearest(parts[:, p], book)
                counts[p] += np.bincount(at, minlength=len(book))
                for k in np.unique(at):  # 1,024 components below 2^52 add up to less than 2^63
                    some = parts[at == k, p]
                    sums[p][k] += sum(s.sum(axis=0).astype(object) for s in np.array_split(some, -(-len(some) // 1024)))
        out = [(p, k, int(n), [str(v) for v in sums[p][k]]) for p in range(PARTS) for k, n in enumerate(counts[p]) if n]
        if out:
            yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(("part", "entry", "n", "sums"), zip(*out))})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        """One row of each task for one entry: sums of any size."""
        total = [sum(map(int, some)) for some in zip(*frame["sums"])]
        return pd.DataFrame({"part": frame["part"].iloc[:1], "entry": frame["entry"].iloc[:1],
                             "n": [frame["n"].sum()], "sums": [[str(v) for v in total]]})

    schema = "part long, entry long, n long, sums array<string>"
    added = kept.select("vec").mapInArrow(run, schema).groupBy("part", "entry").applyInPandas(add, schema)
    books = [b.astype(object) for b in books]
    for r in added.collect():  # PARTS * ENTRIES rows at most
        books[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"]]
    return [_narrow(b) for b in books]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if max(map(abs, book.ravel().tolist()), default=0) < 1 << 52 else book


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list]:
    """The written table of vectors, and the codebooks (none for an empty table)."""
    kept = written(vectors_kept(rows), "vectors")
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("vec")]
    least = kept.orderBy(*order).limit(1).collect()
    if not least:
        return kept, []
    kept = kept.filter(F.size("vec") == len(least[0]["vec"]))
    start = kept.orderBy(*order).limit(entries).collect()
    parts = cut(integers(np.array([r["vec"] for r in start], np.float64)))
    books = [_narrow(parts[:, p].astype(object)) for p in range(PARTS)]
    for _ in range(rounds):
        books = _moved(kept, books)
    return kept, books


def encoded(kept: DataFrame, books: list) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = cut(integers(_matrix(batch.column("vec"))))
            at, apart = zip(*[nearest(parts[:, p], book) for p, book in enumerate(books)])
            codes = np.stack(at, axis=1).astype(np.uint8)
            error = [min(GREATEST, sum(map(int, e))) for e in zip(*apart)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def codebooks_sha256(books: list) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(rows: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector kept."""
    kept, books = train(rows)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    if not books:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(encoded(kept, books), "codes")
    totals = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    totals = totals.select(F.col("label").alias("l"), F.least("total", F.lit(GREATEST)).cast("long").alias("label_error"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    # a label may hold a third of all rows: its rows meet its total in SALTS places
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    out = salted.join(totals, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return out.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books))).select(*columns)
