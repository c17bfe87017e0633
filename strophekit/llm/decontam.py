"""Operator 10: benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: lower case, ASCII punctuation and white
space as single spaces.  An item of n bytes may differ from a passage in an error
budget of 8 % of n edits.  It is split into budget + 1 pieces; a passage within the
budget holds at least one piece unchanged, so no such passage is missed.
An Aho-Corasick automaton over all pieces finds the exact piece hits of a
whole text; hits that imply overlapping places of one item are put together, and
Myers' bit-parallel algorithm gives the least edit distance of the item to any part
of that place.

The document side is one narrow pass without a shuffle; all other columns stay in
the JVM.  Items are sent to the executors in blocks bounded in number and bytes; with
several blocks there is one written pass for each, and its finds are united by text.

Null or empty text: no leak.  Null or empty items, also those of punctuation only, match
nothing.  An item without an id is reported with a null id.  Repeated items are each reported; so are
items of one letter, inside any word.  Empty tables on either side: no leak.
The added column is ``leaks`` (name is a parameter): ``item_id`` and ``errors``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import small_batches, task, task_cache, written

ERROR_PERCENT = 8
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 2 << 20  # of items in one automaton
LEAKS = "array<struct<item_id: long, errors: int>>"
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str) -> str:
    """UTF-8 bytes of the normalised text, one character each."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    return b" ".join(data.split()).decode("latin-1")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def bit_distance(item: str, masks: dict[str, int], text: str) -> int:
    """Least edit distance of ``item`` to any part of ``text``."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for char in text:
        eq = masks.get(char, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERROR_PERCENT):
        import ahocorasick
        self.items = [(i, normalised(t)) for i, t in items]
        self.items = [(i, s, len(s) * percent // 100) for i, s in self.items if s]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, s, budget) in enumerate(self.items):
            for at, piece in pieces(s, budget):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            own: dict[str, int] = {}
            for i, char in enumerate(self.items[k][1]):
                own[char] = own.get(char, 0) | 1 << i
            self.masks[k] = own
        return self.masks[k]

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """``(item_id, errors)`` of the items found, ascending."""
        if not text or not self.items:
            return []
        data = normalised(text)
        starts: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(data):
            for k, at in where:
                starts.setdefault(k, set()).add(last - length + 1 - at)
        found = []
        for k, at in starts.items():
            item_id, item, budget = self.items[k]
            best, end, begin = budget + 1, None, None
            for s in [*sorted(at), None]:  # windows that overlap are looked at once
                if s is not None and end is not None and s - budget <= end:
                    end = s + len(item) + budget
                    continue
                if end is not None:
                    best = min(best, bit_distance(item, self._masks(k), data[max(0, begin):end]))
                    if best == 0:
                        break
                if s is not None:
                    begin, end = s - budget, s + len(item) + budget
            if best <= budget:
                found.append((item_id, best))
        return sorted(found, key=lambda f: (f[0] is not None, f))


def _leaks_udf(shared, percent: int):
    name = uuid.uuid4().hex

    @task("decontamination")
    def leaks(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = task_cache("decontamination")
        if cache.get("name") != name:
            cache["name"], cache["matcher"] = name, Matcher(shared.value, percent)
        matcher = cache["matcher"]
        for texts in columns:
            yield pd.Series([[{"item_id": i, "errors": e} for i, e in matcher.leaks(t)] for t in texts], dtype=object)

    return F.pandas_udf(leaks, LEAKS)


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", percent: int = ERROR_PERCENT,
               block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one more column: the test items that each text holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and length(text) > 0")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // block_items), -(-(size or 0) // block_bytes))

    def matched(block: int) -> Column:
        # about block_items rows and block_bytes at most, besides a single item longer than that
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        return _leaks_udf(spark.sparkContext.broadcast([tuple(r) for r in some.collect()]), percent)(F.col("text"))

    if blocks == 1:
        return docs.withColumn(column, matched(0))
    # One written pass for each block, of the texts that hold something; what is found depends on
    # the text alone, so it is brought back by the text's hash.
    name = uuid.uuid4().hex
    keys = [F.xxhash64("text").alias(f"a_{name}"), F.xxhash64(F.lit(name), "text").alias(f"b_{name}")]
    ids = [f"a_{name}", f"b_{name}"]
    found = None
    for block in range(blocks):
        some = docs.select(*keys, "text").withColumn("leak", matched(block)).filter(F.size("leak") > 0).select(*ids, "leak")
        some = written(some.distinct(), "leaks")
        found = some if found is None else found.unionByName(some)
    found = found.groupBy(*ids).agg(F.array_sort(F.flatten(F.collect_list("leak"))).alias(f"l_{name}"))
    none = F.array().cast(found.schema[f"l_{name}"].dataType)
    out = docs.select("*", *keys).join(found, ids, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"l_{name}"), none).alias(column))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, all columns as they were."""
    mark = "leaks_" + uuid.uuid4().hex
    return with_leaks(docs, benchmark, mark).filter(F.size(mark) == 0).drop(mark)
