"""Fast exact encoding with the ``tokenizers`` library inside tasks.

The byte-level pre-tokenizer never joins a token across a space that stands
alone between two other characters, nor across such a line break, so a text can be
cut there and each distinct chunk encoded once.  Texts are cut many at a time, as one
Arrow column; a chunk is looked up once for all of them, and their ids are gathered
from its.  The library does all encoding; this only avoids asking it the same question again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np

from strophekit.llm.common import task_cache

MEMO_BYTES = 96 << 20  # per generation and worker; two generations are kept
ENTRY_BYTES = 200      # of an entry besides its characters and ids
TEXT_BYTES = 16 << 20  # of texts and their ids kept per worker
GROUP_ROWS, GROUP_CHARS = 2048, 6 << 20  # of texts cut together
# White space besides the space and the line feed.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]
TOKEN_ID = attrgetter("id")
TAIL = ".,;:!?)]}\"'*%$&#|-"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if
    it is a printable Latin-1 character, else the next from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Memo(dict):
    """Ids of chunks, as bytes; a chunk not held is encoded.

    A chunk that starts with a line feed or NUL (the mark of a text's first chunk) stands at a
    line's or text's start, any other one after a space.  A word of letters is one
    pre-token, and punctuation behind it is another, so such words go to the library's
    model directly and are shared by all chunks that hold them, which have no entry of their
    own; other chunks go through the whole library.  What ``old``, the generation before,
    holds is taken from it."""

    def __init__(self, tok, old: dict):
        super().__init__()
        self.tok, self.tokenize, self.old, self.bytes = tok, tok.model.tokenize, old, 0
        self.letters = dict(enumerate(byte_letters()))
        self.line_feed = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return array("I", self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word(self, mark: str, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", map(TOKEN_ID, self.tokenize(mark + spelt))).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.old.get(chunk) or self.word("\u0120", chunk)
        elif chunk[0] == "\n":
            return self.line_feed + self["\0" + chunk[1:]]
        else:
            mark, body = (chunk[0], chunk[1:]) if chunk[0] <= "\1" else ("", chunk)
            word = body.rstrip(TAIL)
            letters = mark != "\1" and word.isalpha()  # else a tail, or no word of letters
            if letters and len(word) < len(body):
                return self[mark + word] + self["\1" + body[len(word):]]
            ids = self.old.get(chunk) or (self.word("", word) if letters else self.encode(body if mark else " " + body))
        self[chunk] = ids
        self.bytes += ENTRY_BYTES + len(chunk) + len(ids)
        return ids


class Encoder:
    """Ids of whole texts.  Chunks are remembered in two generations bounded in bytes:
    what is used moves to the young one, and when that is full the old one goes."""

    def __init__(self, spec: str, memo_bytes: int, control_ids: bool):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = not control_ids
        # strings that the library takes for one id wherever they stand
        self.controls = [t.content for t in self.tok.get_added_tokens_decoder().values() if control_ids or not t.special]
        self.memo_bytes, self.memo = memo_bytes, Memo(self.tok, {})
        self.texts: dict[str, np.ndarray] = {}
        self.held = 0

    def chunked(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that can be cut at each space and line feed; not empty."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if self.memo.bytes > self.memo_bytes:
            self.memo.old = {}
            self.memo = Memo(self.tok, self.memo)
        joined = pa.array(["\0" + " \0".join(texts).replace("\n", " \n")], pa.large_string())
        chunks = pc.split_pattern(joined, " ").values.dictionary_encode()
        held = self.ids_of_chunks(chunks.dictionary)
        lens = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        of_chunks = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(lens)), np.frombuffer(b"".join(held), "<u4"))
        taken = of_chunks.take(chunks.indices)
        ids, begins = taken.values.to_numpy(), taken.offsets.to_numpy()
        cuts = begins[np.cumsum([0] + [t.count(" ") + t.count("\n") + 1 for t in texts])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def ids_of_chunks(self, chunks) -> list[bytes]:
        """Of each distinct chunk; a word of letters is looked up once for all chunks that
        are this word with some tail, any other chunk as it is."""
        import pyarrow.compute as pc
        words = pc.utf8_rtrim(chunks, TAIL)
        tail = (pc.binary_length(chunks).to_numpy() - pc.binary_length(words).to_numpy())
        words = words.dictionary_encode()
        code, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
        letters = np.fromiter(map(str.isalpha, names), bool, len(names))[code]
        asked = np.zeros(len(names), bool)
        asked[code[letters | (tail == 0)]] = True
        held = np.empty(len(names), object)
        held[asked] = list(map(self.memo.__getitem__, names[asked]))
        ids = held[code].tolist()
        at = np.flatnonzero(tail)
        for i, chunk, n, word in zip(at.tolist(), chunks.take(at).to_numpy(zero_copy_only=False), tail[at].tolist(), letters[at].tolist()):
            ids[i] = ids[i] + self.memo["\1" + chunk[-n:]] if word else self.memo[chunk]
        return ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; copies that come soon after it are not encoded again."""
        out: dict[str, np.ndarray] = {}
        group, chars = [], 0
        for text in dict.fromkeys(texts):
            if text in self.texts:
                out[text] = self.texts[text]
            elif not text:
                out[text] = np.empty(0, "<u4")
            elif crowded(text) or any(c in text for c in self.controls):
                out[text] = np.frombuffer(self.memo.encode(text), "<u4")
            else:
                group.append(text)
                chars += len(text)
                if chars >= GROUP_CHARS:
                    out.update(zip(group, self.chunked(group)))
                    group, chars = [], 0
        if group:
            out.update(zip(group, self.chunked(group)))
        for text in out:
            if text not in self.texts:
                if self.held > TEXT_BYTES:
                    self.texts, self.held = {}, 0
                self.texts[text] = out[text]
                self.held += len(text) + out[text].nbytes
        return [out[text] for text in texts]


def load_tokenizer(spec: str, memo_bytes: int = MEMO_BYTES, control_ids: bool = True) -> Encoder:
    """The encoder of a JSON ``spec``, once per worker process.  Control strings inside a
    text are their control ids, as the library has it, or with
    ``control_ids=False`` ordinary text."""
    cache = task_cache("tokens")
    key = (hash(spec), memo_bytes, control_ids)
    if key not in cache:
        cache[key] = Encoder(spec, memo_bytes, control_ids)
    return cache[key]


def crowded(text: str) -> bool:
    """Whether white space stands beside white space or at an end, or control
    marks or white space occur besides the space and the line feed."""
    return (text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
            or "\0" in text or "\1" in text or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)))


def text_groups(batches: Iterator) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of Arrow batches of both, so many rows at a time as are cut together."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            doc_ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if len(texts) == GROUP_ROWS or chars >= GROUP_CHARS:
                yield doc_ids, texts
                doc_ids, texts, chars = [], [], 0
    if texts:
        yield doc_ids, texts


def encode_texts(spec: str, texts: list[str], memo_bytes: int = MEMO_BYTES, control_ids: bool = True) -> list[np.ndarray]:
    """Ids of each text as ``uint32`` arrays, equal to encoding whole texts."""
    return load_tokenizer(spec, memo_bytes, control_ids).whole(texts)
