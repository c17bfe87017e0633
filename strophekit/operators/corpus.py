"""Corpus jobs: HTML extraction (C6), JSON fields (C7), prompt and chat
records (C10-C12), n-gram overlap with a protected corpus (M20, U2, U3) and
term counts (A10, A11).

The overlap and term jobs never cross-join texts with a word list: texts
are tokenised, grams are exploded with their positions, and the word list
joins on equality (broadcast when its size is checked to be small).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from strophekit.functions.text import ngram_key

# ---------------------------------------------------------------------------
# Fixed values.
PROMPT_INSTRUCTION = (
    "Below will be the lyrics of a song.  Consider the lyrics, themes, musical styles, and "
    "cultural aspects. Generate a one paragraph condensed prompt that requests that song in an "
    "active voice, specifying the artist style to mimic. For example: \"Write me a song in the "
    "style of [ARTIST] that [insert song characteristics]...\" "
)
# Extra common words appended to the common-word list of the n-gram study.
COMMON_EXTRAS = ("didnt", "wont", "shouldnt", "wouldnt", "couldnt", "cant", "im", "youre",
                 "hes", "shes", "thats", "its", "ive")
# HTML entities as the oracle unescapes them ('&amp;' last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# ---------------------------------------------------------------------------



# --- C6 -------------------------------------------------------------------------
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Containers(HTMLParser):
    """Text nodes of a page and the span of each ``(tag, class)`` container.

    An end tag closes the innermost open element of its name and what was left open
    inside; elements never closed end with the page."""

    def __init__(self, wanted: Sequence[tuple[str, str | None]]):
        super().__init__(convert_charrefs=True)
        self.wanted = [(t.lower(), c) for t, c in wanted]
        self.nodes: list[str] = []
        self.spans: list[list[list]] = [[] for _ in wanted]
        self.open: list[tuple[str, list[list]]] = []
        self.names: Counter = Counter()
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        self.fresh = True
        if tag in VOID_TAGS:
            return
        value = next((v or "" for k, v in attrs if k == "class"), "")
        mine = []
        for (name, css_class), spans in zip(self.wanted, self.spans):
            if name == tag and (css_class is None or css_class in value.split()):
                spans.append([len(self.nodes), None])
                mine.append(spans[-1])
        self.open.append((tag, mine))
        self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.fresh = True
        while self.names[tag]:
            name, mine = self.open.pop()
            self.names[name] -= 1
            for span in mine:
                span[1] = len(self.nodes)
            if name == tag:
                break

    def handle_data(self, data):
        if self.names["script"]:
            return
        if self.fresh:
            self.nodes.append(data)
            self.fresh = False
        else:
            self.nodes[-1] += data

    def other(self, _):
        self.fresh = True

    handle_comment = handle_decl = handle_pi = unknown_decl = other


def container_texts(html: str | None, wanted: Sequence[tuple[str, str | None]]) -> list[str | None]:
    """For each ``(tag, class)`` the text of every such container, nested ones
    included (scripts removed, text nodes joined by '\n'), containers joined by a space."""
    if html is None:
        return [None] * len(wanted)
    page = Containers(wanted)
    page.feed(html.replace("&nbsp;", " "))
    page.close()
    return [" ".join("\n".join(page.nodes[a:b]) for a, b in spans) for spans in page.spans]


def extract_page_text(pages: DataFrame, html_col: str = "html", keys: Sequence[str] = ("page_id",),
                      lyric_tag: str = "article", desc_tag: str = "div",
                      desc_class: str | None = "ad") -> DataFrame:
    """Lyrics and description out of raw HTML pages."""
    wanted, keys = [(lyric_tag, None), (desc_tag, desc_class)], list(keys)
    schema = StructType(pages.select(*keys).schema.fields).add("lyrics", StringType()).add("description", StringType())

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            texts = [container_texts(h, wanted) for h in batch.column(len(keys)).to_pylist()]
            columns = [pa.array([t[i] for t in texts], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(batch.columns[:len(keys)] + columns, schema.names)

    return pages.select(*keys, html_col).mapInArrow(extract, schema)


# --- C7 -------------------------------------------------------------------------
def json_field(c: Column, path: str, dtype: str) -> Column:
    """One field of a JSON string column."""
    return F.get_json_object(c, path).cast(dtype)


SONG_LIST = "struct<response: struct<songs: array<struct<id: bigint, title: string, annotation_count: bigint>>>>"


def response_songs(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """A row ``(keys, song_id, song)`` for each song of ``response.songs``
    with annotations; null or malformed responses and empty lists give none."""
    songs = df.select(*keys, F.explode(F.from_json(F.col(col), SONG_LIST)["response"]["songs"]).alias("_s"))
    return songs.filter(F.col("_s.annotation_count") > 0).select(*keys, F.col("_s.id").alias("song_id"), F.col("_s.title").alias("song"))


def first_hit_artist(c: Column) -> Column:
    """The artist id of the first search hit; null without a hit."""
    return json_field(c, "$.response.hits[0].result.primary_artist.id", "long")


# --- C10-C12 ----------------------------------------------------------------------
def render_prompt(lyrics: Column, artist: Column) -> Column:
    """Instruction + artist + song + prompt marker (``concat``, not a
    format string, since lyrics may hold '%')."""
    return F.concat(F.lit(PROMPT_INSTRUCTION), F.lit("\n\n[ARTIST]: "), artist,
                    F.lit("\n\n[SONG]:\n"), lyrics, F.lit("\n\n[PROMPT]:\n"))


def merge_generated(inputs: DataFrame, results: DataFrame, key: str, out_col: str) -> DataFrame:
    """C11: inner join of generation results; failed generations dropped."""
    return inputs.join(results, on=key, how="inner").filter(F.col(out_col).isNotNull())


def chat_record(prompt: Column, answer: Column) -> Column:
    """Two-turn conversation ``[{from: human}, {from: gpt}]``."""
    return F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")),
                   F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


# --- M20 --------------------------------------------------------------------------
def gram_tokens(text: Column) -> Column:
    """Space-split tokens without blanks."""
    return F.filter(F.split(text, " ", -1), lambda t: (t != "") & (t != " "))


def doc_ngrams(df: DataFrame, keys: Sequence[str], tokens: Column, ns: Sequence[int],
               common: Sequence[str] | None = None) -> DataFrame:
    """Distinct n-grams of every text, for each n; grams made only of common
    words (and blanks) are dropped.  ``(keys, n, gram)``.

    Grams come from ``pyspark.ml.feature.NGram`` (a compiled sliding window)
    over the tokens; the "all common" test runs the same window over a
    per-token flag ('1' common, '0' not), so a gram is kept when its flag
    gram holds a '0'.  Grams are strings before ``array_distinct`` (a hash
    set)."""
    from pyspark.ml.feature import NGram
    keys = list(keys)
    d = df.select(*keys, tokens.alias("_tok"))
    if common:
        lst = F.lit(sorted(set(common) | {"", " "}))
        d = d.withColumn("_c", F.transform("_tok", lambda w: F.when(F.array_contains(lst, w), "1")
                                           .otherwise("0")))
    for n in ns:
        d = NGram(n=n, inputCol="_tok", outputCol=f"_g{n}").transform(d)
        if common:
            d = NGram(n=n, inputCol="_c", outputCol=f"_f{n}").transform(d)
    per_n = []
    for n in ns:
        if common:
            kept = F.filter(F.zip_with(f"_g{n}", f"_f{n}", lambda g, f: F.when(f.contains("0"), g)),
                            lambda g: g.isNotNull())
        else:
            kept = F.col(f"_g{n}")
        per_n.append(F.struct(F.lit(n).alias("n"), F.array_distinct(kept).alias("g")))
    ex = d.select(*keys, F.inline_outer(F.array(*per_n)))
    return ex.select(*keys, "n", F.explode("g").alias("gram"))


def ngram_overlap(texts: DataFrame, keys: Sequence[str], text_col: str, corpus: DataFrame,
                  corpus_text_col: str, ns: Sequence[int] = (3, 4, 5, 6),
                  common: Sequence[str] | None = COMMON_EXTRAS) -> DataFrame:
    """Per text and n, the number of distinct n-grams it shares with
    the corpus; texts without any shared gram get 0.  Corpus grams are
    formed inside each corpus text."""
    keys = list(keys)
    # The common-word filter is applied to the corpus grams only: a text
    # gram made of common words can never equal a kept corpus gram, so
    # filtering the (much larger) text side as well changes no count.
    mine = doc_ngrams(texts, keys, gram_tokens(ngram_key(F.col(text_col))), ns, None)
    theirs = doc_ngrams(corpus.select(F.monotonically_increasing_id().alias("_cid"), corpus_text_col),
                        ["_cid"], gram_tokens(ngram_key(F.col(corpus_text_col), keep_brackets=True)),
                        ns, common).select("n", "gram").distinct()
    # A semi-join: Spark may drop grams that the corpus does not hold before the exchange
    # (runtime bloom filter), and a gram that very many texts hold can be split, since no row is
    # made on the corpus side.  Texts without a shared gram come from a narrow scan of the keys.
    hits = mine.join(theirs, on=["n", "gram"], how="left_semi").select(*keys, "n", F.lit(1).cast("long").alias("_hit"))
    none = texts.select(*keys, F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"), F.lit(0).cast("long").alias("_hit"))
    return hits.unionByName(none).groupBy(*keys, "n").agg(F.sum("_hit").alias("shared"))


# --- A10 / A11 ------------------------------------------------------------------------
def padded_terms(words: DataFrame, col: str) -> DataFrame:
    """Word list -> terms padded with a space on both sides."""
    w = words.select(F.col(col).alias("w")).filter(F.col("w").isNotNull() & (F.col("w") != ""))
    return w.select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("term")).distinct()


def term_counts(texts: DataFrame, keys: Sequence[str], group: str, text_col: str,
                terms: DataFrame, term_col: str = "term") -> DataFrame:
    """A10: non-overlapping occurrences of each space-padded term in every
    text (``str.count`` semantics), summed per ``group``; zero counts left
    out.

    Texts are split on single spaces (empty pieces kept, so token i > 0 has
    a space before it and token i < last one after it); a term ' w1 .. wk '
    matches tokens i..i+k-1 with 0 < i and i+k-1 < last.  Matches are
    counted greedily left to right per (text, term); the next match of a
    k-word term must start at least k+1 tokens later (they may not share
    the separating space).
    """
    keys = list(keys)
    t = terms.select(F.col(term_col).alias("term")).filter(
        F.col("term").startswith(" ") & F.col("term").endswith(" ") & (F.length("term") >= 3))
    t = t.select("term", F.split(F.expr("substring(term, 2, length(term) - 2)"), " ", -1).alias("_w"))
    t = t.select("term", F.size("_w").alias("k"), F.array_join("_w", " ").alias("gram")).distinct()
    sizes = [r["k"] for r in t.select("k").distinct().collect()]  # a few small ints
    tok = texts.select(*keys, group, F.split(F.col(text_col), " ", -1).alias("_tok"))
    parts = []
    for k in sizes:
        if k == 1:
            # single words: the gram is the token itself (codegen'd explode)
            g = tok.select(*keys, group, F.size("_tok").alias("_T"), F.posexplode("_tok").alias("i", "gram"))
            g = g.filter((F.col("i") >= 1) & (F.col("i") <= F.col("_T") - 2))
            parts.append(g.select(*keys, group, F.lit(1).alias("k"), F.col("i").cast("int").alias("i"), "gram"))
            continue
        starts = F.sequence(F.lit(1), F.size("_tok") - k - 1)  # 0-based start i in [1, T-k-1]
        grams = F.transform(starts, lambda i: F.struct(
            i.alias("i"), F.array_join(F.slice("_tok", i + 1, k), " ").alias("gram")))
        grams = F.when(F.size("_tok") - k - 1 >= 1, grams)
        g = tok.select(*keys, group, F.lit(k).alias("k"), F.explode_outer(grams).alias("_g"))
        parts.append(g.filter(F.col("_g").isNotNull()).select(*keys, group, "k", "_g.i", "_g.gram"))
    if not parts:
        return texts.sparkSession.createDataFrame([], f"{group} string, term string, n long")
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    hits = cand.join(t, on=["k", "gram"], how="inner")
    per_doc = hits.groupBy(*keys, group, "term", "k").agg(F.array_sort(F.collect_list("i")).alias("_pos"))
    greedy = F.aggregate("_pos", F.struct(F.lit(-10).cast("int").alias("end"), F.lit(0).alias("n")),
                         lambda acc, i: F.when(i > acc["end"], F.struct(
                             (i + F.col("k")).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc),
                         lambda acc: acc["n"])
    per_doc = per_doc.select(group, "term", greedy.alias("n"))
    return per_doc.groupBy(group, "term").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")


def term_totals(counts: DataFrame, group: str, legacy_double: bool = False) -> DataFrame:
    """A10 totals per group (``legacy_double`` reproduces the reference's
    doubled totals, SURVEY quirk 8)."""
    out = counts.groupBy(group).agg(F.sum("n").cast("long").alias("total"))
    return out.withColumn("total", F.col("total") * 2) if legacy_double else out
