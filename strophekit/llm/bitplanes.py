"""Operator 1: token ids as binary output, bit-plane shuffled.

Texts are encoded in ascending ``doc_id`` order.  Ids fill blocks of a fixed
size; a block is transposed into byte planes (or bit planes), every plane is
compressed with zstandard, and blocks are rows of a table: the planes beside a
chunk index (place of the block, its ids, and the documents it covers).  The
index columns can be read without the planes.

One range exchange puts documents in order; every task then streams its rows
and holds one block at a time.  Files are committed by Spark's writer, so a
lost executor costs its tasks only, and any file system Spark knows will do.
A document's first id in the whole output follows from the id counts of the
parts before its own: one row per part.

Null or empty text: no ids but the end id.  Null ``doc_id``: before all others.
Repeated ids or rows: each row is a document, ordered by id, then by text hash.
An empty table gives an empty table of chunks.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strophekit.llm.common import small_batches, task
from strophekit.llm.tokens import encode_texts

BLOCK_IDS = 1 << 16
CHUNKS = ("part int, chunk long, first_id long, n_ids int, plane_kind string, planes array<binary>, "
          "doc_ids array<long>, doc_rows array<long>, doc_offsets array<long>, doc_lengths array<long>, doc_totals array<long>")
PIECES = "part int, doc_row long, doc_id long, first_id long, offset long, length long, total long, crc long"


# ------------------------------------------------------------- one block

def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of a block of ids, least significant plane first;
    planes above the largest id are left out."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=level).compress
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [pack(np.ascontiguousarray(cells[:, i]).tobytes()) for i in range((top + 7) // 8)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [pack(np.packbits(bits[:, i], bitorder="little").tobytes()) for i in range(top)]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    if kind == "byte":
        cells = np.zeros((n_ids, 4), np.uint8)
        for i, plane in enumerate(planes):
            cells[:, i] = np.frombuffer(unpack(plane), np.uint8)
        return cells.reshape(-1).view("<u4")
    bits = np.zeros((n_ids, 32), np.uint8)
    for i, plane in enumerate(planes):
        bits[:, i] = np.unpackbits(np.frombuffer(unpack(plane), np.uint8), count=n_ids, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Blocks:
    """Cuts a stream of documents into blocks, one row of ``CHUNKS`` each."""

    def __init__(self, part: int, block_ids: int, kind: str):
        self.part, self.size, self.kind = part, block_ids, kind
        self.chunk = self.first = self.row = 0
        self.done: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.arrays, self.spans, self.n = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while True:
            take = min(self.size - self.n, len(ids) - at)
            self.spans.append((doc_id, self.row, at, take, len(ids)))
            self.arrays.append(ids[at:at + take])
            self.n, at = self.n + take, at + take
            if self.n == self.size:
                self.close()
            if at >= len(ids):
                break
        self.row += 1

    def close(self) -> None:
        if not self.spans:
            return
        docs, rows, offsets, lengths, totals = (list(x) for x in zip(*self.spans))
        planes = to_planes(np.concatenate(self.arrays), self.kind)
        self.done.append((self.part, self.chunk, self.first, self.n, self.kind, planes, docs, rows, offsets, lengths, totals))
        self.chunk, self.first = self.chunk + 1, self.first + self.n
        self._clear()

    def taken(self) -> list[tuple]:
        rows, self.done = self.done, []
        return rows


# ------------------------------------------------------------- writing

def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None,
              block_ids: int = BLOCK_IDS, kind: str = "byte") -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the chunk table."""
    small_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    tail = np.array([] if end_id is None else [end_id], "<u4")

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = _kinds(CHUNKS)

    @task("tokens")
    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        blocks = Blocks(TaskContext.get().partitionId(), block_ids, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                for doc_id, got in zip(ids, encode_texts(spec.value, texts)):
                    blocks.add(doc_id, np.concatenate((got, tail)))
                if blocks.done:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in blocks.taken()], kinds)
        blocks.close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in blocks.taken()], kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(chunks, CHUNKS).write.option("compression", "uncompressed").parquet(path)


# ------------------------------------------------------------- reading

def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def part_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each part, from the index columns: one row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _kinds(schema: str):
    return to_arrow_schema(_parse_datatype_string(schema))


def _decoded(batches: Iterator, value: Callable, kinds) -> Iterator:
    """Per document and block the place of its ids, and ``value`` of them."""
    import pyarrow as pa
    for batch in batches:
        cell = {n: batch.column(n) for n in batch.schema.names}
        spans = cell["doc_rows"].value_lengths().to_numpy(zero_copy_only=False)
        flat = {n: cell[n].flatten() for n in ("doc_rows", "doc_ids", "doc_offsets", "doc_lengths", "doc_totals")}
        offsets, lengths = (flat[n].to_numpy(zero_copy_only=False) for n in ("doc_offsets", "doc_lengths"))
        values, places, at = [], [], 0
        for i, n in enumerate(spans.tolist()):
            ids = from_planes(cell["planes"][i].as_py(), cell["n_ids"][i].as_py(), cell["plane_kind"][i].as_py())
            cuts = np.concatenate(([0], np.cumsum(lengths[at:at + n])))
            places.append(cell["first_id"][i].as_py() + cuts[:-1] - offsets[at:at + n])
            cuts = cuts.tolist()
            values += [value(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
            at += n
        parts = np.repeat(cell["part"].to_numpy(zero_copy_only=False), spans)
        columns = [parts, flat["doc_rows"], flat["doc_ids"], np.concatenate(places) if places else [], flat["doc_offsets"],
                   flat["doc_lengths"], flat["doc_totals"], values]
        yield pa.RecordBatch.from_arrays(
            [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def read_pieces(chunks: DataFrame) -> DataFrame:
    """Per document and block: its ids' place and crc32, from the planes."""
    kinds = _kinds(PIECES)
    return chunks.mapInArrow(lambda batches: _decoded(batches, lambda ids: zlib.crc32(ids.tobytes()), kinds), PIECES)


def read_documents(chunks: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``ids`` (array)."""
    schema = PIECES.replace("crc long", "ids array<long>")
    kinds = _kinds(schema)
    got = chunks.mapInArrow(lambda batches: _decoded(batches, lambda ids: ids.astype(np.int64), kinds), schema)
    whole = got.groupBy("part", "doc_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("first_id").alias("first_id"),
        F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]).alias("ids"))
    return whole.join(part_starts(chunks), "part").select(
        "doc_id", (F.col("part_start") + F.col("first_id")).alias("start"), "ids")


def crc32_join(first: int, second: int, n_second: int) -> int:
    """crc32 of two strings one after the other, from both crc32 values and the
    second's length: the first is carried over ``n_second`` zero bytes, a linear
    map over GF(2) that is applied by repeated squaring."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit

    def apply(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
            if not v:
                break
        return out

    bits = 8 * n_second
    while bits:
        if bits & 1:
            first = apply(step, first)
        step = [apply(step, row) for row in step]
        bits >>= 1
    return first ^ second


def digests(chunks: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, read back from the
    planes.  Each block is decoded alone; a document over several blocks is put
    together from one crc32 per block."""
    def joined(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for cs, ns in zip(crcs, lengths):
            crc = int(cs[0])
            for c, n in zip(cs[1:], ns[1:]):
                crc = crc32_join(crc, int(c), 4 * int(n))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    join_crcs = F.pandas_udf(joined, "long")
    docs = read_pieces(chunks).groupBy("part", "doc_row").agg(
        F.first("first_id").alias("first_id"), F.first("doc_id").alias("doc_id"), F.first("total").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "crc", "length"))).alias("p"))
    # One exchange serves both; only documents over several blocks go to Python.
    alone = docs.filter(F.size("p") == 1).withColumn("ids_crc32", F.col("p")[0]["crc"])
    cut = docs.filter(F.size("p") > 1).withColumn("ids_crc32", join_crcs(F.col("p")["crc"], F.col("p")["length"]))
    return alone.unionByName(cut).join(part_starts(chunks), "part").select(
        "doc_id", (F.col("part_start") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")
