"""Operator 5: lexical retrieval packing into windows of at most 1024 tokens.

Every document is encoded once.  Its full windows become sequences of their
own where they are made; only the rest of each document, shorter than a window,
still needs company.  Statistics cover all rests: the document frequency of every
word, their number and mean length are counted in Spark before anything is packed.
A task counts the words of some 2,000 rests as one block; blocks are cut into ranges of the words'
hashes, each range is summed over all blocks, and the sums go back to the blocks.  There
are as many ranges as it takes for one to hold some ``RANGE_WORDS`` counts.
Each rest is routed by content: by its rarest word that at least ``shard_docs`` / 16 rests
share, then by its rarest word that any other rest shares, so that copies and rests on one
subject stand side by side.  A range exchange deals that order to as many tasks as the
session has shuffle partitions, and each streams its sorted part and closes a shard every
``SHARD_DOCS`` rests; many rests with the same words fill several shards, so a shard
and a task's memory are bounded.  A shard holds a BM25 inverted index over the words of its rests, weighed by
the statistics of all rests.  The first unused rest seeds a window; its best scored
unused neighbours are appended until the window is full.  The one that overflows is
cut, and what is left of it seeds the next window; rests that share no word with a
seed follow in order.  So only the last window of a shard is padded.

Words are read from the ids: an id whose token begins with a space or line
feed starts a word.  All words of a seed are scored.  A neighbour that shares neither
routing word can still stand in another shard; no document is left out.

Null or empty text: just the end id.  Null ids and repeated rows: each row is a
document of its own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strophekit.llm.common import POSITION_FACTOR, mix64, small_batches, task, task_cache, written
from strophekit.llm.tokens import encode_texts, text_groups

WINDOW = 1024
SHARD_DOCS = 2048
RANGE_WORDS, LEAST_RANGES = 200_000, 512  # counts that are summed together, ranges of words
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FULL, REST, VOCABULARY = 0, 1, 2  # kinds of encoded rows
REST_COLUMNS = "doc_id long, start long, length long, doc_tokens long, row_no long, ids binary, wide boolean"
ENCODED = PIECES + ", kind int, block long, row_no long, ids binary, wide boolean, counts binary, words long"
RANGES = "block long, range long, terms binary, counts binary"
ROUTED = REST_COLUMNS + ", frequencies binary, subject long, word long"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def ids_bytes(ids: np.ndarray) -> tuple[bytes, bool]:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return ids.astype("<u4" if wide else "<u2").tobytes(), wide


def word_terms(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of ids that begins at ``starts``."""
    lens = np.diff(np.append(starts, len(ids)))
    within = np.arange(len(ids)) - np.repeat(starts, lens)
    powers = np.cumprod(np.full(int(lens.max()), POSITION_FACTOR, np.uint64))
    most = int(ids.max()) + 1
    mixed = mix64(np.arange(1, most + 1, dtype=np.uint64))[ids] if most < len(ids) else mix64(ids.astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(mixed * powers[within], starts))


def by_doc_and_term(doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Order by rest, then term: one sort of the rest's number with the leading bits of
    the term behind it; where these agree for different terms, the full sort."""
    bits = np.uint64(int(doc[-1]).bit_length() if len(doc) else 0)
    key = term >> bits
    if bits:
        key |= doc.astype(np.uint64) << (np.uint64(64) - bits)
    order = np.argsort(key)
    key, sorted_term = key[order], term[order]
    if np.any((key[1:] == key[:-1]) & (sorted_term[1:] != sorted_term[:-1])):
        return np.lexsort((term, doc))
    return order


def rest_terms(rests: list[np.ndarray], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rest, term, times)`` of each distinct term, ascending by rest and term,
    and the words of each rest."""
    lens = np.array([len(r) for r in rests])
    ids = np.concatenate(rests)
    begins = leads[ids]
    begins[np.cumsum(lens) - lens] = True
    starts = np.flatnonzero(begins)
    doc, term = np.repeat(np.arange(len(rests)), lens)[starts], word_terms(ids, starts)
    words = np.bincount(doc, minlength=len(rests))
    order = by_doc_and_term(doc, term)
    doc, term = doc[order], term[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))))
    return doc[first], term[first], np.diff(np.append(first, len(doc))), words


def binaries(values: np.ndarray, cuts: np.ndarray):
    """An Arrow column of the bytes of ``values`` between neighbouring ``cuts``."""
    import pyarrow as pa
    offsets = (np.asarray(cuts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def range_cuts(term: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` (a power of two) equal ranges of hashes begins in
    ascending ``term``, and the end."""
    step = 1 << (65 - ranges.bit_length())
    begins = np.arange(1, ranges, dtype=np.uint64) * np.uint64(step % (1 << 64))
    return np.concatenate(([0], np.searchsorted(term, begins), [len(term)]))


def summed(term: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each entry the sum of ``held`` over all entries of its term."""
    order = np.argsort(term)
    ascending = term[order]
    first = np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1])))
    out = np.empty(len(term), np.int64)
    out[order] = np.repeat(np.add.reduceat(held[order], first, dtype=np.int64), np.diff(np.append(first, len(term))))
    return out


def routing_word(doc: np.ndarray, term: np.ndarray, frequency: np.ndarray, n: int, least: int) -> list[int | None]:
    """Per rest its rarest term that ``least`` rests hold, the smaller hash first."""
    first = np.searchsorted(doc, np.arange(n))  # every rest has a term
    none = np.iinfo(np.int64).max
    rare = np.where(frequency >= least, frequency, none)
    rarest = np.minimum.reduceat(rare, first)
    tied = np.where(rare == np.repeat(rarest, np.diff(np.append(first, len(doc)))), term, np.uint64(2**64 - 1))
    words = np.minimum.reduceat(tied, first).view(np.int64).tolist()
    return [None if r == none else t for r, t in zip(rarest.tolist(), words)]


class Index:
    """BM25 inverted index of one shard.  ``frequencies`` are those of the terms of
    ``rest_terms`` among all ``total`` rests of ``mean_words`` words; without
    them the given rests are all."""

    def __init__(self, rests: list[np.ndarray], leads: np.ndarray, frequencies: np.ndarray | None = None,
                 total: int = 0, mean_words: float = 0):
        n = self.n = len(rests)
        doc, term, tf, words = rest_terms(rests, leads)
        order = np.argsort(term)  # a term's postings may stand in any order
        ascending = term[order]
        new = np.concatenate(([True], ascending[1:] != ascending[:-1]))
        code = np.empty(len(term), np.int64)
        code[order] = np.cumsum(new) - 1
        held = np.diff(np.append(np.flatnonzero(new), len(term)))
        if frequencies is None:
            frequencies, total, mean_words = held[code], n, words.mean()
        idf = np.log1p((total - frequencies + 0.5) / (frequencies + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / mean_words))
        self.by_doc, self.code = np.searchsorted(doc, np.arange(n + 1)), code
        # terms of a quarter of the rests as rows of a matrix, the others as postings
        self.dense = np.full(len(held), -1)
        common = np.flatnonzero(4 * held > n)
        self.dense[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n))
        row = self.dense[code]
        self.matrix[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.docs, self.weight = doc[order], weight[order]
        self.held, self.first = held, np.cumsum(held) - held

    def scores(self, doc: int) -> np.ndarray:
        """Of every rest, by all terms of one."""
        terms = self.code[self.by_doc[doc]:self.by_doc[doc + 1]]
        row = self.dense[terms]
        asked = np.zeros(len(self.matrix))
        asked[row[row >= 0]] = 1
        terms = terms[(row < 0) & (self.held[terms] > 1)]
        lens = self.held[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return asked @ self.matrix + np.bincount(self.docs[at], self.weight[at], self.n)


def pack_shard(rests: list[np.ndarray], leads: np.ndarray, window: int = WINDOW, *statistics) -> list[tuple]:
    """``(rest, start, length, sequence, offset)`` for each piece; ``statistics``
    as for the index."""
    if not rests:
        return []
    index, used = Index(rests, leads, *statistics), np.zeros(len(rests), bool)
    pieces, sequence, next_free = [], 0, 0
    seed, seed_at = -1, 0
    while True:
        if seed < 0:
            while next_free < len(rests) and used[next_free]:
                next_free += 1
            if next_free == len(rests):
                return pieces
            seed, seed_at = next_free, 0
            used[seed] = True
        fill = len(rests[seed]) - seed_at
        pieces.append((seed, seed_at, fill, sequence, 0))
        scores = np.where(used, 0, index.scores(seed)) if fill < window else None
        seed = -1
        while fill < window:
            ranked = []
            if scores is not None:
                top = np.argpartition(-scores, min(32, index.n - 1))[:32]
                top = top[scores[top] > 0]
                ranked = top[np.lexsort((top, -scores[top]))].tolist()
                scores[ranked] = 0
                if not ranked:
                    scores = None
            if not ranked:  # nothing more in common: the next unused rest
                while next_free < len(rests) and used[next_free]:
                    next_free += 1
                if next_free == len(rests):
                    break
                ranked = [next_free]
            for doc in ranked:
                used[doc] = True
                take = min(window - fill, len(rests[doc]))
                pieces.append((doc, 0, take, sequence, fill))
                fill += take
                if take < len(rests[doc]):
                    seed, seed_at = doc, take
                if fill == window:
                    break
        sequence += 1


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = WINDOW,
         shard_docs: int = SHARD_DOCS, range_words: int = RANGE_WORDS) -> DataFrame:
    """Pieces of all documents, ``PIECES``."""
    from tokenizers import Tokenizer
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vocab = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True)
    leads = np.zeros(max(*vocab.values(), end_id) + 1, bool)
    leads[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = sc.broadcast((f.read(), leads))  # one vocabulary file
    least = max(2, shard_docs // 16)

    kinds = {s: to_arrow_schema(_parse_datatype_string(s)) for s in (PIECES, ENCODED, ROUTED)}

    def batch_of(rows, schema):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds[schema])], names(schema))

    def ids_of(data, wides):
        return [np.frombuffer(d, "<u4" if w else "<u2").astype("<u4") for d, w in zip(data, wides)]

    @task("tokens")
    def encode(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        base, row_no, sequence = TaskContext.get().partitionId() << 33, 0, 0
        end = np.array([end_id], "<u4")
        for block, (doc_ids, texts) in enumerate(text_groups(batches), base):
            rows, rests = [], []
            for doc_id, ids in zip(doc_ids, encode_texts(shared.value[0], texts)):
                ids = np.concatenate((ids, end))
                full = len(ids) // window * window
                for start in range(0, full, window):
                    crc = zlib.crc32(ids[start:start + window].tobytes())
                    rows.append((doc_id, start, window, crc, len(ids), 2 * (base + sequence), 0, FULL, -1, 0, None, False, None, 0))
                    sequence += 1
                if full < len(ids):
                    rests.append((doc_id, full, len(ids), base + row_no, ids[full:]))
                row_no += 1
            if rests:
                _, term, _, words = rest_terms([r[-1] for r in rests], shared.value[1])
                for (doc_id, full, total, own, ids), n in zip(rests, words.tolist()):
                    data, wide = ids_bytes(ids)
                    rows.append((doc_id, full, len(ids), 0, total, 0, 0, REST, block, own, data, wide, None, n))
                term, held = np.unique(term, return_counts=True)
                rows.append((None, 0, 0, 0, 0, 0, 0, VOCABULARY, block, 0, term.tobytes(), False, held.astype("<u4").tobytes(), len(term)))
            for at in range(0, len(rows), 512):
                yield batch_of(rows[at:at + 512], ENCODED)

    def into_ranges(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for block, terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                term = np.frombuffer(terms, "<u8")
                cuts = range_cuts(term, ranges)
                some = np.flatnonzero(np.diff(cuts))
                cuts = np.append(cuts[some], len(term))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), binaries(term, cuts),
                                                  binaries(np.frombuffer(counts, "<u4"), cuts)], names(RANGES))

    def add(counted):
        """Of a range of words: the frequencies that each block's words have in all blocks."""
        import pyarrow as pa
        terms, counts = (counted[c].to_pylist() for c in ("terms", "counts"))
        often = summed(np.frombuffer(b"".join(terms), "<u8"), np.frombuffer(b"".join(counts), "<u4"))
        cuts = np.cumsum([0] + [len(t) // 8 for t in terms])
        return pa.table({"block": counted["block"], "range": counted["range"], "often": binaries(often.astype("<u4"), cuts)})

    def route(rests, counted):
        """Rests of a block with the frequencies of their terms and their routing words."""
        import pyarrow as pa
        task_cache("packing")
        if not rests.num_rows:
            return pa.Table.from_batches([], kinds[ROUTED])
        columns = [rests[c].to_pylist() for c in names(REST_COLUMNS)]
        doc, term, _, _ = rest_terms(ids_of(columns[5], columns[6]), shared.value[1])
        _, code = np.unique(term, return_inverse=True)
        data = np.frombuffer(b"".join(counted.sort_by("range")["often"].to_pylist()), "<u4")[code]
        n = rests.num_rows
        frequencies = binaries(data, np.searchsorted(doc, np.arange(n + 1)))
        routing = [routing_word(doc, term, data.astype(np.int64), n, k) for k in (least, 2)]
        return pa.table([*(rests[c] for c in names(REST_COLUMNS)), frequencies, *(pa.array(w, pa.int64()) for w in routing)], kinds[ROUTED])

    @task("packing")
    def pack_part(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        sequence, base, held = 0, TaskContext.get().partitionId() << 33, []

        def shard(some):
            nonlocal sequence
            doc_ids, starts, _, totals, _, data, wides, frequencies, _, _ = zip(*some)
            rests = ids_of(data, wides)
            pieces = pack_shard(rests, shared.value[1], window, np.frombuffer(b"".join(frequencies), "<u4").astype(np.int64), total, mean_words)
            out = batch_of([(doc_ids[d], starts[d] + at, n, zlib.crc32(rests[d][at:at + n].tobytes()), totals[d],
                             2 * (base + sequence + seq) + 1, offset) for d, at, n, seq, offset in pieces], PIECES)
            sequence += pieces[-1][3] + 1
            return out

        for batch in batches:  # sorted; a shard is closed as soon as it is full
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= shard_docs:
                yield shard(held[:shard_docs])
                held = held[shard_docs:]
        if held:
            yield shard(held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = written(texts.mapInArrow(encode, ENCODED), "encoded")
    sizes = {r["kind"]: r for r in encoded.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("words").alias("words")).collect()}
    total, all_words = (sizes[REST]["rows"], sizes[REST]["words"]) if REST in sizes else (0, 0)
    mean_words = all_words / max(1, total)
    entries = sizes[VOCABULARY]["words"] if VOCABULARY in sizes else 0
    ranges = max(LEAST_RANGES, 1 << (entries // range_words).bit_length())
    counted = (encoded.filter(F.col("kind") == VOCABULARY).select("block", "ids", "counts").mapInArrow(into_ranges, RANGES)
               .groupBy("range").applyInArrow(add, "block long, range long, often binary"))
    rests = encoded.filter(F.col("kind") == REST).select("block", *names(REST_COLUMNS))
    routed = written(rests.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(route, ROUTED), "routed")
    order = [F.asc_nulls_last("subject"), F.asc_nulls_last("word"), F.asc("row_no")]
    packed = routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack_part, PIECES)
    return encoded.filter(F.col("kind") == FULL).select(names(PIECES)).unionByName(packed)
