"""Operator 4: token counts by a count-only Viterbi pass.

For a unigram vocabulary, an Aho-Corasick automaton lists every vocabulary match
of a text chunk; dynamic programming over end positions carries the best score and
the piece count of the best path, and no path is rebuilt.  Ties follow the
``tokenizers`` Unigram model: candidates for an end are met in ascending order of
their start, and only a strictly better score replaces the best one, so the
longest last piece wins a tie.  A character that no single-character piece covers costs
the lowest score less 10; with byte fallback it counts its UTF-8 bytes, else a
run of such characters counts one.

Chunks are what the pre-tokenizer makes: a text's spaces become U+2581, one is put
before the text, and a chunk begins at each.  Counts of chunks are kept per worker in a
bounded memo; texts are read whole, in pieces of bounded size, so a very
long text needs little memory beyond itself.

The given unigram table is the 32k piece vocabulary with its stored scores.
Null or empty text: 0 tokens.  Every row gives one row, repeated or null ids
included; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import small_batches, task_cache

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_CHUNKS = 300_000


def piece_vocabulary(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """``(piece, score)`` by id, and the unknown id, of a SentencePiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    """Counts pieces of chunks under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.singles = {p for p in names if len(p) == 1}
        self.in_bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.memo: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Pieces on the best path over ``text``."""
        n = len(text)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends up to here are final
        singles, unknown = self.singles, self.unknown

        def settle(end: int, found: list) -> None:
            found.sort(reverse=True)  # ascending start
            top = None
            for length, score in found:
                got = best[end - length] + score
                if top is None or got > top:
                    top, count[end], open_run[end] = got, count[end - length] + 1, False
            char = text[end - 1]
            if char not in singles:
                got = best[end - 1] + unknown
                if top is None or got > top:
                    top, open_run[end] = got, True
                    if self.in_bytes:
                        count[end] = count[end - 1] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        count[end] = count[end - 1] + (not open_run[end - 1])
            best[end] = top

        found: list = []
        at = 0
        for last, match in self.automaton.iter(text):
            if last + 1 != at:
                if at:
                    settle(at, found)
                    done = at
                for end in range(done + 1, last + 1):
                    settle(end, [])
                at, found = last + 1, []
            found.append(match)
        if at:
            settle(at, found)
            done = at
        for end in range(done + 1, n + 1):
            settle(end, [])
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        if text[0] == SPACE:  # a first chunk that begins so gets no second mark
            text = " " + text[1:]
        elif text[0] != " ":
            text = " " + text
        total, memo = 0, self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        chunks = text.replace(SPACE, " ").split(" ")[1:]
        for chunk in chunks:
            n = memo.get(chunk)
            if n is None:
                n = memo[chunk] = self.chunk(SPACE + chunk)
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """``doc_id, n_tokens`` for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = task_cache("viterbi")
        key = ("viterbi", hash(tuple(shared.value)), byte_fallback)
        if key not in cache:
            cache[key] = Counter(shared.value, byte_fallback)
        counter = cache[key]
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": [counter.count(t) for t in frame["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, n_tokens long")
