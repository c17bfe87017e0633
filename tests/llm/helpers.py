"""Small documents with every odd case, and brute-force versions."""

import collections
import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, leaks int, licenses int, key int, grp string"


def odd_documents():
    """Nulls in every column, empty and white texts, ties, repeats, a very long text."""
    long = " ".join(f"word{i % 977} and, then" for i in range(20_000))
    texts = [(1, "One two three four five six."), (2, None), (3, ""), (4, "  \t\n "), (5, "One two three four five six."),
             (5, "One two three four five six."), (None, "A text without an id"), (None, None), (6, long), (7, "x"),
             (8, "tabs\tand\r\nlines  and   gaps "), (9, "日本語 ünïcode 😀 <|endoftext|> \u0000 ́"), (10, "a" * 5000)]
    return [(i, t, None if i == 1 else "en", None, None, 0.5, 1, 2, 3, "g") for i, t in texts]


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(odd_documents() if rows is None else rows, schema)


def shingles(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_pairs(sets, percent=85):
    held = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    out = []
    for d, s in sets.items():
        both = collections.Counter(e for g in s for e in held[g] if e > d)
        out += [(d, e) for e, n in both.items() if 100 * n >= percent * (len(s) + len(sets[e]) - n)]
    return out
