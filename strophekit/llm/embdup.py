"""Operator 7: embedding near-duplicates by randomised-rotation binary codes.

Within a label, vectors with cosine of at least 0.98 are linked.

1. Rows with equal label and vector form a class; one of each goes on, with
   its size, so repeated rows cost nothing further.
2. A unit vector is turned by random rotations; the signs are its code.  Stored
   with it is the correction factor: the mean of the inner products of vector and
   code, one per rotation, by which an inner product with the code alone
   becomes an unbiased estimate of the inner product with the vector.
3. Bands of 16 code bits retrieve pairs.  At cosine 0.98 a bit differs with
   probability 0.064, so a pair shares none of the 20 bands with probability 2e-4.
   A pair is made in its first shared band only, and only if the whole codes differ
   in no more bits than a pair at 0.98 would but for five standard deviations.
4. The estimate and its confidence bound (five standard deviations) decide
   which pairs can reach 0.98; only for those the second vector is
   fetched and the cosine computed in double precision.
5. Members of a band's bucket of more than ``LIGHT`` are compared in tiles of twice
   ``TILE`` vectors by the same bits, estimate, bound and cosine, as matrices; a tile
   gives for each vector the number of its links and one edge of a spanning forest, so rows grow
   with the members of a group, not with their pairs, and no bucket is one task's.

Labels are compared as values; vectors of different length are never linked.
Null label or id, null or empty vector, zero vector, null or non-finite component:
linked with nothing.  Each row is a vector of its own, repeated ids included.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import written
from strophekit.llm.components import components

COSINE = 0.98
BAND_BITS, BANDS = 16, 20
SIGMAS = 5.0
LIGHT, TILE = 64, 512  # members of a bucket that is joined; vectors of a chunk of a larger one
PAIRS_AT_ONCE = 1 << 16
SEED = 7
VECTORS = "vec_id long, grp string, node long, vec binary"


def unit(vec) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision, or None."""
    if vec is None or len(vec) == 0:
        return None
    v = np.asarray(vec, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def rotations(dim: int, bits: int = BAND_BITS * BANDS) -> np.ndarray:
    """As many random rotations of ``dim`` as give at least ``bits`` signs."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(-(-bits // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def codes(units: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits ``(n, rotations * dim)`` and correction factors."""
    z = np.einsum("rij,nj->nri", turns, units)
    factor = np.abs(z).sum(axis=2).mean(axis=1) / np.sqrt(units.shape[1])
    return (z > 0).reshape(len(units), -1), factor


def estimates(units: np.ndarray, bits: np.ndarray, factor: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products of ``units`` with the coded vectors,
    and the standard deviation of the estimate of a pair at the threshold."""
    m, dim = turns.shape[0], turns.shape[1]
    z = np.einsum("rij,nj->nri", turns, units).reshape(len(units), -1)
    raw = (z * (2.0 * bits - 1)).sum(axis=1) / (m * np.sqrt(dim))
    spread = np.sqrt((1 - COSINE ** 2) * np.maximum(0, 1 - factor ** 2) / max(1, (dim - 1) * m)) / factor
    return raw / factor, spread


def _vectors(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        for frame in frames:
            grps, nodes, vecs = [], [], []
            for vec_id, label, vec in zip(frame["vec_id"], frame["label"], frame["vec"]):
                u = None if pd.isna(label) or pd.isna(vec_id) else unit(vec)
                if u is None:
                    grps.append(None), nodes.append(None), vecs.append(None)
                    continue
                grp, data = f"{len(u)}|{label}", np.asarray(vec, np.float64)
                grps.append(grp)
                nodes.append(xxhash.xxh3_64_intdigest(grp.encode() + data.tobytes()) - (1 << 63))
                low = data.astype(np.float32)
                vecs.append((low if (low == data).all() else data).tobytes())
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "grp": grps, "node": pd.array(nodes, "Int64"), "vec": vecs})

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").cast("array<double>").alias("vec")).mapInPandas(run, VECTORS)


def _read(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if len(data) == 8 * dim else np.float32).astype(np.float64)


def _by_dim(frame: pd.DataFrame):
    dims = frame["grp"].str.split("|", n=1).str[0].astype(int)
    return frame.groupby(dims, sort=False)


def _units(data, dim: int) -> np.ndarray:
    v = np.stack([_read(d, dim) for d in data])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def coded(classes: DataFrame) -> DataFrame:
    """``node, grp, code, factor, l0 ..``: code in full, and its first bits as longs."""
    longs = BAND_BITS * BANDS // 64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, some in _by_dim(frame):
                bits, factor = codes(_units(some["vec"], dim), rotations(dim))
                packed = np.packbits(bits, axis=1, bitorder="little")
                words = np.ascontiguousarray(packed[:, :8 * longs]).view("<i8")
                yield pd.DataFrame({"node": some["node"], "grp": some["grp"], "code": [p.tobytes() for p in packed],
                                    "factor": factor} | {f"l{i}": words[:, i] for i in range(longs)})

    return classes.select("node", "grp", "vec").mapInPandas(
        run, "node long, grp string, code binary, factor double, " + ", ".join(f"l{i} long" for i in range(longs)))


def banded(code: DataFrame) -> DataFrame:
    """Rows of ``code`` once per band, with the key of the bucket."""
    longs, per = BAND_BITS * BANDS // 64, 64 // BAND_BITS
    low = (1 << BAND_BITS) - 1

    keys = [F.xxhash64("grp", F.lit(w * per + i), F.shiftrightunsigned(f"l{w}", BAND_BITS * i).bitwiseAND(F.lit(low)))
            for w in range(longs) for i in range(per)]
    return code.select("node", *[f"l{i}" for i in range(longs)], F.posexplode(F.array(*keys)).alias("band", "key"))


def most_bits() -> int:
    """Differing bits of a pair at the threshold, but for five standard deviations."""
    n, p = BAND_BITS * BANDS, np.arccos(COSINE) / np.pi
    return int(np.ceil(n * p + SIGMAS * np.sqrt(n * p * (1 - p))))


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes, each in its first shared band, whose codes are near enough."""
    longs, per = BAND_BITS * BANDS // 64, 64 // BAND_BITS
    low, most = (1 << BAND_BITS) - 1, most_bits()

    def part(x, i):
        return F.shiftrightunsigned(x, BAND_BITS * i).bitwiseAND(F.lit(low))

    words = [f"l{i}" for i in range(longs)]
    diffs = [F.col(w).bitwiseXOR(F.col(w + "_b")) for w in words]
    apart = sum((F.bit_count(d) for d in diffs[1:]), F.bit_count(diffs[0]))
    first = F.coalesce(*[F.when(part(d, i) == 0, F.lit(w * per + i)) for w, d in enumerate(diffs) for i in range(per)])
    other = rows.select(*[F.col(c).alias(c + "_b") for c in rows.columns])
    pairs = rows.join(other, (F.col("key") == F.col("key_b")) & (F.col("band") == F.col("band_b"))
                      & (F.col("node") < F.col("node_b")) & (apart <= most) & (first == F.col("band")))
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def tile_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links inside a tile whose first shared band is the tile's: per linked vector the
    number of its links, by the rows of each class, and the least node it is connected with."""
    out, band, same_chunk = [], int(frame["band"].iloc[0]), frame["lo"].iloc[0] == frame["hi"].iloc[0]
    for dim, some in _by_dim(frame):
        some = some.sort_values("node")
        n, turns, units = len(some), rotations(dim), _units(some["vec"], dim)
        packed = np.frombuffer(b"".join(some["code"]), np.uint8).reshape(n, -1)
        signs = 2.0 * np.unpackbits(packed, axis=1, count=turns.shape[0] * dim, bitorder="little") - 1
        grp, chunk, factor = pd.factorize(some["grp"])[0], some["chunk"].to_numpy(), some["factor"].to_numpy()
        open_pairs = np.triu(grp[:, None] == grp[None, :], 1)
        if not same_chunk:
            open_pairs &= chunk[:, None] != chunk[None, :]
        words = np.ascontiguousarray(packed[:, :BAND_BITS * BANDS // 8]).view("<u2")
        open_pairs &= words[:, None, band] == words[None, :, band]
        for earlier in range(band):
            open_pairs &= words[:, None, earlier] != words[None, :, earlier]
        first = signs[:, :BAND_BITS * BANDS]
        open_pairs &= (BAND_BITS * BANDS - first @ first.T) / 2 <= most_bits()
        turned = np.einsum("rij,nj->nri", turns, units).reshape(n, -1)
        got = turned @ signs.T / (turns.shape[0] * np.sqrt(dim)) / factor[None, :]
        spread = np.sqrt((1 - COSINE ** 2) * np.maximum(0, 1 - factor ** 2) / max(1, (dim - 1) * turns.shape[0])) / factor
        x, y = np.nonzero(open_pairs & (got + SIGMAS * spread[None, :] >= COSINE))
        near = np.concatenate([np.einsum("ij,ij->i", units[x[k:k + PAIRS_AT_ONCE]], units[y[k:k + PAIRS_AT_ONCE]]) >= COSINE
                               for k in range(0, len(x), PAIRS_AT_ONCE)] or [np.empty(0, bool)])
        x, y = np.concatenate((x[near], y[near])), np.concatenate((y[near], x[near]))
        linked = np.zeros(n, np.int64)
        np.add.at(linked, x, some["size"].to_numpy()[y])
        root, was = np.arange(n), None
        while was is None or (root != was).any():  # the least member reached, by neighbours and by leaps
            was = root.copy()
            np.minimum.at(root, x, root[y])
            root = root[root]
        held, node = linked > 0, some["node"].to_numpy()
        out.append(pd.DataFrame({"node": node[held], "linked": linked[held], "root": node[root[held]]}))
    return pd.concat(out)


def heavy_links(rows: DataFrame, heavy: DataFrame, code: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, linked, root`` of each tile of the buckets in ``heavy`` (``key``, ``n``)."""
    some = rows.select("node", "band", "key").join(heavy, "key").withColumn("chunks", F.ceil(F.col("n") / TILE))
    some = some.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    some = some.select("node", "band", "key", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    some = some.join(code.select("node", "code", "factor"), "node").join(classes.select("node", "grp", "vec", "size"), "node")
    return some.groupBy("key", "lo", "hi").applyInPandas(tile_links, "node long, linked long, root long")


def links(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of classes: pairs found by joins, and tiles' ``node, linked, root``."""
    code = written(coded(classes), "codes")
    rows = banded(code)
    heavy = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LIGHT), "heavy")
    vecs = classes.select("node", "grp", "vec")

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, some in _by_dim(frame):
                turns = rotations(dim)
                packed = np.frombuffer(b"".join(some["code"]), np.uint8).reshape(len(some), -1)
                bits = np.unpackbits(packed, axis=1, count=turns.shape[0] * dim, bitorder="little")
                got, spread = estimates(_units(some["vec"], dim), bits, some["factor"].to_numpy(), turns)
                yield some.loc[got + SIGMAS * spread >= COSINE, ["a", "b", "grp", "vec"]]

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, some in _by_dim(frame[frame["grp"] == frame["grp_b"]]):
                x, y = _units(some["vec"], dim), _units(some["vec_b"], dim)
                yield some.loc[np.einsum("ij,ij->i", x, y) >= COSINE, ["a", "b"]]

    pairs = candidates(rows.join(heavy, "key", "left_anti")).join(code.select(F.col("node").alias("b"), "code", "factor"), "b")
    pairs = pairs.join(vecs.withColumnRenamed("node", "a"), "a").mapInPandas(bounded, "a long, b long, grp string, vec binary")
    pairs = pairs.join(vecs.select(F.col("node").alias("b"), F.col("grp").alias("grp_b"), F.col("vec").alias("vec_b")), "b")
    return pairs.mapInPandas(exact, "a long, b long"), heavy_links(rows, heavy, code, classes)


def near_duplicate_vectors(rows: DataFrame) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    vectors = written(_vectors(rows), "vectors")
    classes = written(vectors.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("grp").alias("grp"), F.first("vec").alias("vec")), "classes")
    pairs, tiles = links(classes)
    found, tiles = written(pairs, "links"), written(tiles, "tiles")
    sizes = classes.select("node", "size")
    ways = found.select(F.col("a").alias("x"), F.col("b").alias("node")).unionByName(
        found.select(F.col("b").alias("x"), F.col("a").alias("node")))
    counts = ways.join(sizes, "node").select("x", F.col("size").alias("linked")).unionByName(
        tiles.select(F.col("node").alias("x"), "linked"))
    linked = counts.groupBy("x").agg(F.sum("linked").alias("linked"))
    group = components(found.unionByName(tiles.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = classes.select("node", "least", "size").join(group, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).join(linked, F.col("node") == F.col("x"), "left")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        "node", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = vectors.select("vec_id", "node").join(named, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
