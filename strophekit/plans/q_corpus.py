"""Corpus queries (C1-C12, T10, M20, A10) over documents, benchmark, pages,
events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.functions import text as TX
from strophekit.operators import corpus as C
from strophekit.operators.structure import keyword_in_context
from strophekit.plans.catalog import register, table

SQL_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NGRAM_NS = (3, 4, 5, 6)
KWIC_PATTERN = "the"


def _sql_c5(x: str, keep_brackets: bool = False) -> str:
    y = x if keep_brackets else f"regexp_replace({x}, '\\[.*?\\]', '', 'g')"
    y = f"translate(replace({y}, chr(10), ' '), chr(13) || '''.!,?', '')"
    return SQL_STRIP.format(x=f"lower({y})")


def _sql_entities(x: str) -> str:
    for a, b in C.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a.replace("'", "''"), b.replace("'", "''"))
    return x


def _sql_container(tag: str, css_class: str | None) -> str:
    attr = f'[^>]*class="{css_class}"[^>]*' if css_class else "[^>]*"
    ns = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g')"
    blocks = f"regexp_extract_all({ns}, '(?s)<{tag}{attr}>(.*?)</{tag}>', 1)"
    texts = (f"list_transform({blocks}, lambda b: array_to_string(list_filter("
             f"regexp_split_to_array(b, '<[^>]*>'), lambda p: p <> ''), chr(10)))")
    return _sql_entities(f"array_to_string({texts}, ' ')")


@register("html_extract", f"""
SELECT page_id, {_sql_container('article', None)} AS lyrics,
       {_sql_container('div', 'ad')} AS description
FROM pages
""")
def q_html(spark, sf):
    return C.extract_page_text(table(spark, sf, "pages", spread=True))


@register("json_field", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events
""")
def q_json(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", C.json_field(F.col("props"), "$.k", "long").alias("k"))


def _responses(spark, sf):
    """API responses made of events: up to four songs and two hits each; no list
    in every seventh."""
    e = table(spark, sf, "events")
    n = (F.col("event_id") % 5).cast("int")
    song = lambda i: F.struct((F.col("event_id") * 4 + i).alias("id"),
                              F.concat("event_type", F.lit(" \""), i.cast("string")).alias("title"),
                              ((F.col("event_id") + i) % 3).alias("annotation_count"))
    songs = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), n), song)
    hit = lambda a: F.struct(F.struct(F.struct(a.alias("id")).alias("primary_artist")).alias("result"))
    hits = F.when(n > 0, F.array(hit(F.col("user_id")), hit(F.lit(-1).cast("long"))))
    hits = F.struct(songs.alias("songs"), F.coalesce(hits, F.slice(F.array(hit(F.lit(-1).cast("long"))), 1, 0)).alias("hits"))
    return e.select("event_id", F.to_json(F.struct(F.when(F.col("event_id") % 7 > 0, hits).alias("response"))).alias("body"))


@register("response_songs", """
SELECT event_id, event_id * 4 + i AS song_id, event_type || ' "' || i AS song
FROM events, (SELECT unnest(range(4)) AS i)
WHERE event_id % 7 > 0 AND i < event_id % 5 AND (event_id + i) % 3 > 0
""")
def q_response_songs(spark, sf):
    return C.response_songs(_responses(spark, sf), ["event_id"], "body")


@register("first_hit_artist", """
SELECT event_id, CASE WHEN event_id % 7 > 0 AND event_id % 5 > 0 THEN user_id END AS artist_id FROM events
""")
def q_first_hit(spark, sf):
    return _responses(spark, sf).select("event_id", C.first_hit_artist(F.col("body")).alias("artist_id"))


@register("title_key", """
SELECT doc_id, replace(lower(regexp_replace(split_part(text, '(', 1), '^\\s+|\\s+$', '', 'g')),
                       chr(8203), '') AS title_key
FROM documents
""")
def q_title_key(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.title_key(F.col("text")).alias("title_key"))


@register("annotation_trim", """
SELECT doc_id, CASE
  WHEN contains(text, 'Expand +') AND contains(text, ' contributors')
    THEN split_part(split_part(text, 'Expand +', 1), ' contributors', 2)
  WHEN contains(text, 'Expand +') AND contains(text, ' contributor')
    THEN split_part(split_part(text, 'Expand +', 1), ' contributor', 2)
  WHEN contains(text, 'Expand +') THEN split_part(text, 'Expand +', 1)
  WHEN contains(text, ' contributors') THEN split_part(text, ' contributors', 2)
  WHEN contains(text, ' contributor') THEN split_part(text, ' contributor', 2)
  ELSE text END AS annotation
FROM documents
""")
def q_annotation_trim(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.annotation_trim(F.col("text")).alias("annotation"))


@register("bracket_repair", """
SELECT doc_id, replace(replace(replace(replace(replace(text, '(' || chr(10), ''), chr(10) || ')', ''),
                       chr(10) || ']', ']'), '[' || chr(10), '['), ':', '') AS text
FROM documents
""")
def q_bracket_repair(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.bracket_repair(F.col("text")).alias("text"))


@register("drop_last_line", """
SELECT doc_id, array_to_string((string_split(text, chr(10)))[1:len(string_split(text, chr(10))) - 1],
                               chr(10)) AS text
FROM documents
""")
def q_drop_last_line(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.drop_last_line(F.col("text")).alias("text"))


@register("ngram_text_key", f"""
SELECT doc_id, {_sql_c5('text')} AS answer_key, {_sql_c5('text', True)} AS corpus_key FROM documents
""")
def q_ngram_key(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.ngram_key(F.col("text")).alias("answer_key"),
                    TX.ngram_key(F.col("text"), keep_brackets=True).alias("corpus_key"))


def _sql_prompt(lyrics: str, artist: str) -> str:
    instr = C.PROMPT_INSTRUCTION.replace("'", "''")
    return (f"'{instr}' || chr(10) || chr(10) || '[ARTIST]: ' || {artist} || chr(10) || chr(10) || "
            f"'[SONG]:' || chr(10) || {lyrics} || chr(10) || chr(10) || '[PROMPT]:' || chr(10)")


@register("prompt_render", f"""
SELECT doc_id, {_sql_prompt('text', 'source')} AS prompt FROM documents
""")
def q_prompt(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", C.render_prompt(F.col("text"), F.col("source")).alias("prompt"))


@register("merge_generated", """
SELECT d.doc_id AS id, d.source, length(c.text)::BIGINT AS out_chars
FROM documents d JOIN conversations c
  ON d.doc_id = c.conv_id AND c.turn = 1 AND c.role = 'assistant'
WHERE c.text IS NOT NULL
""")
def q_merge_generated(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    res = table(spark, sf, "conversations").filter((F.col("turn") == 1) & (F.col("role") == "assistant"))
    res = res.select(F.col("conv_id").alias("id"), F.col("text").alias("out"))
    m = C.merge_generated(d, res, "id", "out")
    return m.select("id", "source", F.length("out").cast("long").alias("out_chars"))


@register("chat_records", f"""
SELECT doc_id AS id, 0 AS idx, 'human' AS "from", md5({_sql_prompt('text', 'source')}) AS value_md5
FROM documents
UNION ALL
SELECT doc_id AS id, 1 AS idx, 'gpt' AS "from", md5(text) AS value_md5 FROM documents
""")
def q_chat(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    rec = d.select(F.col("doc_id").alias("id"),
                   C.chat_record(C.render_prompt(F.col("text"), F.col("source")), F.col("text")).alias("conv"))
    ex = rec.select("id", F.posexplode("conv").alias("idx", "t"))
    return ex.select("id", "idx", F.col("t.from").alias("from"), F.md5(F.col("t.value")).alias("value_md5"))


@register("keyword_in_context", f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '.{{0,50}}{KWIC_PATTERN}.{{0,50}}') AS ms FROM documents)
SELECT doc_id, unnest(range(len(ms)))::INT AS match_no, unnest(ms) AS context FROM m
""")
def q_kwic(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return keyword_in_context(d, "text", KWIC_PATTERN, ["doc_id"])


_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(C.COMMON_EXTRAS) | {"", " "})) + "]"

_NGRAM_CTE = f"""
mt AS (SELECT doc_id, source, list_filter(string_split({_sql_c5('text')}, ' '),
                                          lambda t: t <> '' AND t <> ' ') AS tok FROM documents),
ct AS (SELECT item_id, list_filter(string_split({_sql_c5('text', True)}, ' '),
                                   lambda t: t <> '' AND t <> ' ') AS tok FROM benchmark),
ns AS (SELECT unnest({list(NGRAM_NS)}) AS n),
mi AS (SELECT doc_id, n, tok, unnest(range(1, len(tok) - n + 2)) AS i FROM mt, ns WHERE len(tok) >= n),
mg AS (SELECT DISTINCT doc_id, n, tok[i:i + n - 1] AS g FROM mi),
ci AS (SELECT n, tok, unnest(range(1, len(tok) - n + 2)) AS i FROM ct, ns WHERE len(tok) >= n),
cg AS (SELECT DISTINCT n, tok[i:i + n - 1] AS g FROM ci),
keep_m AS (SELECT * FROM mg WHERE len(list_filter(g, lambda w: NOT list_contains({_COMMON_SQL}, w))) > 0),
keep_c AS (SELECT * FROM cg WHERE len(list_filter(g, lambda w: NOT list_contains({_COMMON_SQL}, w))) > 0),
shared AS (SELECT m.doc_id, m.n, count(*) AS c FROM keep_m m
           JOIN keep_c c ON m.n = c.n AND array_to_string(m.g, ' ') = array_to_string(c.g, ' ')
           GROUP BY m.doc_id, m.n),
per_doc AS (SELECT mt.doc_id, mt.source, ns.n, coalesce(shared.c, 0)::BIGINT AS shared
            FROM mt CROSS JOIN ns LEFT JOIN shared ON mt.doc_id = shared.doc_id AND ns.n = shared.n)
"""


def _overlap(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", "source", "text")
    b = table(spark, sf, "benchmark")
    return C.ngram_overlap(d, ["doc_id", "source"], "text", b, "text", NGRAM_NS)


@register("ngram_overlap", f"""
WITH {_NGRAM_CTE}
SELECT doc_id, n::INT AS n, shared FROM per_doc
""")
def q_ngram_overlap(spark, sf):
    return _overlap(spark, sf).select("doc_id", F.col("n").cast("int").alias("n"), "shared")


@register("ngram_overlap_by_model", f"""
WITH {_NGRAM_CTE}
SELECT source AS model, n::INT AS n, sum(shared)::BIGINT AS shared FROM per_doc GROUP BY source, n
""")
def q_ngram_overlap_model(spark, sf):
    o = _overlap(spark, sf)
    return o.groupBy(F.col("source").alias("model"), F.col("n").cast("int").alias("n")).agg(
        F.sum("shared").cast("long").alias("shared"))


def _terms(spark, sf):
    b = table(spark, sf, "benchmark")
    w = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    return C.padded_terms(w, "w")


_TERMS_SQL = """
terms AS (SELECT DISTINCT ' ' || w || ' ' AS term
          FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)),
cnt AS (SELECT d.source AS model, t.term,
               sum((length(d.text) - length(replace(d.text, t.term, ''))) // length(t.term))::BIGINT AS n
        FROM documents d, terms t GROUP BY d.source, t.term)
"""


@register("term_counts", f"""
WITH {_TERMS_SQL}
SELECT model, term, n FROM cnt WHERE n > 0
""")
def q_term_counts(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", F.col("source").alias("model"), "text")
    return C.term_counts(d, ["doc_id"], "model", "text", _terms(spark, sf))


@register("term_totals", f"""
WITH {_TERMS_SQL}
SELECT model, sum(n)::BIGINT AS total FROM cnt WHERE n > 0 GROUP BY model
""")
def q_term_totals(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", F.col("source").alias("model"), "text")
    return C.term_totals(C.term_counts(d, ["doc_id"], "model", "text", _terms(spark, sf)), "model")
