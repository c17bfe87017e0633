"""Hand-sized fixtures with expected values (FIXTURES.md §3)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophekit.functions.syllables import syllable_rule
from strophekit.functions.text import lev_norm
from strophekit.operators import measures as M
from strophekit.operators import relational as R
from strophekit.operators.corpus import term_counts
from strophekit.operators.structure import parse_songs, stanza_matching
from strophekit.plans.scoring import score_stanzas

F1 = ("Here is your song:\n[Verse 1: Ann]\nred sky\nlow tide\n[Chorus]\nsing it on\n[Verse 2]\n"
      "red sea\nlow tide now\n[Chorus]\nsing it out\n\nHope you like it!")
F2 = "[Verse]\n\nred sky\nlow tide"
F3 = "red sky\nlow tide"
F4 = "Intro: Ann\nhey\n(Part of me) stays\n[Shout]\nho (yeah)"
F5 = "[Ponte]\nun\n[Pont]\ndeux\n[?] [...] [laughs]"


def _songs(spark):
    return spark.createDataFrame([(1, F1), (2, F2), (3, F3), (4, F4), (5, F5)], "id long, text string")


def test_parser_fixtures(spark):
    st = parse_songs(_songs(spark), "text", ["id"])
    got = {}
    for r in st.orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["keyword"], list(r["lines"])))
    assert got[1] == [("verse", ["red sky", "low tide"]), ("chorus", ["sing it on"]),
                      ("verse", ["red sea", "low tide now"]), ("chorus", ["sing it out"])]
    assert 2 not in got and 3 not in got
    assert got[4] == [("intro", [" ann", "hey"]), ("part", [" stays"]), ("shout", ["ho (yeah)"])]
    assert got[5] == [("ponte", ["un"]), ("pont", ["deux", "nan nan nan"])]
    m = {r["id"]: r["matching"] for r in stanza_matching(st, ["id"]).collect()}
    assert m[1] == "0-1-0-1" and m[4] == "0-1-2" and m[5] == "0-1"


def test_levenshtein_fixtures(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("red sky", "red sea"),
                                ("low tide", "low tide now"), ("", "abc")], "a string, b string")
    rows = df.select(F.levenshtein("a", "b").alias("d"), lev_norm("a", "b").alias("s")).collect()
    assert [r["d"] for r in rows] == [3, 2, 4, 3]
    assert rows[0]["s"] == pytest.approx(0.5)
    assert rows[1]["s"] == pytest.approx(2 / 7)
    assert rows[2]["s"] == pytest.approx(0.5)
    assert rows[3]["s"] is None


@pytest.mark.parametrize("measure,expected", [
    ("string_similarity", 0.296429), ("head_similarity", 0.071429), ("tail_similarity", 0.521429)])
def test_pair_measures_over_f1(spark, measure, expected):
    songs = _songs(spark)
    st = parse_songs(songs, "text", ["id"])
    s = score_stanzas(st, songs.select("id"), ["id"], [measure])
    got = {r["id"]: (r["score"], r["n_pairs"]) for r in s.collect()}
    assert got[1][0] == pytest.approx(expected, abs=1e-6)
    assert got[1][1] == 2
    assert got[3] == (0.0, 0)  # A12: no pairs -> 0
    scaled = s.filter("id = 3").select(M.scale_score(F.col("measure"), F.col("score"))).first()[0]
    assert scaled == pytest.approx(100.0)


@pytest.mark.parametrize("a,b,window,offset,score", [
    ([5, 7, 5], [5, 7, 5], "suffix", 0, 0.0),
    ([8, 8, 6, 6], [6, 6], "suffix", 2, 0.0),
    ([4, 9, 4, 9], [9, 4, 9], "suffix", 3, 0.541667),
    ([4, 9, 4, 9], [9, 4, 9], "fixed", 1, 0.0),
    ([3], [10, 10], "suffix", 1, 0.875),
    ([3], [10, 10], "fixed", -1, 0.375),
])
def test_dtw_offset(a, b, window, offset, score):
    off = M.best_offset(a, b, window)[0]
    assert off == offset
    assert M.syllable_score_value(a, b, window) == pytest.approx(score, abs=1e-6)


def dtw(x, y):
    """Textbook dynamic time warping with cost |a - b|."""
    acc = {(i, -1): float("inf") for i in range(len(x))} | {(-1, j): float("inf") for j in range(len(y))} | {(-1, -1): 0.0}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            acc[i, j] = abs(a - b) + min(acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
    return acc[len(x) - 1, len(y) - 1]


def test_long_stanzas_are_fast():
    import random
    import time
    rnd = random.Random(1)
    a, b = ([rnd.randint(0, 12) for _ in range(160)] for _ in range(2))
    began = time.time()
    M.syllable_score_value(a, b)
    assert time.time() - began < 0.1


def test_dtw_brute_force():
    """Best offset equals an exhaustive search over offsets."""
    import random
    rnd = random.Random(7)
    for _ in range(30):
        a = [rnd.randint(0, 9) for _ in range(rnd.randint(1, 6))]
        b = [rnd.randint(0, 9) for _ in range(rnd.randint(1, 6))]
        long_, short = (a, b) if len(a) >= len(b) else (b, a)
        w = len(short)
        padded = [0.0] * w + [float(x) for x in long_] + [0.0] * w
        errs = [dtw(padded[j:], short) for j in range(len(padded) - w)]
        best = min(range(len(errs)), key=lambda j: (errs[j], j))
        assert M.best_offset(a, b)[0] == best - w


def test_mtld_fixtures():
    assert M.mtld_value("a b a b a b a b a b a b".split()) == pytest.approx(12.0)
    assert M.mtld_value("a a b c d e f g h i j k a b".split()) == pytest.approx(18.293333, abs=1e-5)
    assert M.mtld_value([str(i) for i in range(10)]) == 0.0  # zero factors -> guard


SYLLABLES = {"sky": 1, "tide": 1, "speed": 1, "whole": 1, "table": 2, "counted": 2, "jumped": 1,
             "rhythm": 1, "beautiful": 3, "queue": 0, "trial": 2, "serious": 3, "fortunately": 4,
             "coed": 2, "cooperate": 4, "preempt": 2, "preach": 1, "mcgee": 1, "italian": 4,
             "physician": 3, "twilight": 2}


def test_syllable_rule(spark):
    df = spark.createDataFrame([(w,) for w in SYLLABLES], "w string")
    got = {r["w"]: r["n"] for r in df.select("w", syllable_rule(F.col("w")).alias("n")).collect()}
    assert got == SYLLABLES


def test_term_count_overlap(spark):
    texts = spark.createDataFrame([(1, "m", " hot hot x"), (2, "m", "a hot hot hot b")],
                                  "id long, model string, text string")
    terms = spark.createDataFrame([(" hot ",)], "term string")
    got = {r["model"]: r["n"] for r in term_counts(texts, ["id"], "model", "text", terms).collect()}
    assert got == {"m": 1 + 2}
    assert " hot hot x".count(" hot ") + "a hot hot hot b".count(" hot ") == 3


def test_dedup_first(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "id long, o long")
    got = sorted(tuple(r) for r in R.dedup_first(df, ["id"], ["o"]).collect())
    assert got == [(1, 1), (2, 1)]


def test_mean_skips_invalid(spark):
    df = spark.createDataFrame([("m", "c", 5.0), ("m", "c", -1.0), ("m", "c", 7.0)],
                               "model string, category string, score double")
    r = R.mean_by_group(df, ["model", "category"], "score", F.col("score") >= 0).first()
    assert r["score"] == 6.0


def test_votes_from_json(spark):
    from strophekit.sources.io import votes_from_json_text
    df = spark.createDataFrame([('[{"1":"a","2":"b"}]',)], "value string")
    got = sorted(tuple(r) for r in votes_from_json_text(df, "value").collect())
    assert got == [(1, "a"), (2, "b")]


def test_global_row_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = R.global_row_index(df, "k", n_buckets=5).collect()
    assert sorted((r["k"], r["row_no"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_label_cap(spark):
    def song(n):
        return "\n".join(f"[label{chr(97 + i)}]\nx" for i in range(n))
    df = spark.createDataFrame([(1, song(10)), (2, song(11))], "id long, text string")
    got = {r["id"]: r["error"] for r in stanza_matching(parse_songs(df, "text", ["id"]), ["id"]).collect()}
    assert got == {1: None, 2: "labels"}


def test_measure_names(spark):
    assert "phonetics" in M.resolve_measures(["all"])
    with pytest.raises(ValueError):  # no lexicon attached
        songs = spark.createDataFrame([(1, [(0, "verse", ["a"])])], "id long, stanzas array<struct<pos:int,keyword:string,lines:array<string>>>")
        M.score_song_arrays(songs, ["id"], ["phonetics"])
    with pytest.raises(NotImplementedError):
        M.resolve_measures(["nonsense"])


NUMBERS = {"999999999999999999": "nine hundred and ninety-nine quadrillion, nine hundred and ninety-nine trillion, "
                                 "nine hundred and ninety-nine billion, nine hundred and ninety-nine million, "
                                 "nine hundred and ninety-nine thousand, nine hundred and ninety-nine",
           "1000000000000000000000002": "one septillion and two", "000": "zero", "5" + "0" * 33: "five decillion",
           "1" + "0" * 303: "one centillion",
           "0": "zero", "7": "seven", "007": "seven", "21": "twenty-one", "100": "one hundred",
           "101": "one hundred and one", "555": "five hundred and fifty-five",
           "1000": "one thousand", "1001": "one thousand and one", "1100": "one thousand, one hundred",
           "1234": "one thousand, two hundred and thirty-four", "1000000": "one million",
           "1000034": "one million and thirty-four", "2050000": "two million, fifty thousand",
           "abc12": "abc12"}


def test_spell_number(spark):
    from strophekit.functions.syllables import spell_number, word_syllables
    df = spark.createDataFrame([(k,) for k in NUMBERS], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", spell_number(F.col("w")).alias("s")).collect()}
    assert got == NUMBERS
    n = df.filter("w = '7'").select(word_syllables(F.col("w"))).first()[0]
    assert n == 2  # "seven"


def test_lexicon_encodings(spark):
    from strophekit.operators.encode import with_lexicon_encodings
    from strophekit.operators.structure import parse_song_arrays
    songs = spark.createDataFrame([(1, F1), (3, F3)], "id long, text string")
    arrays = parse_song_arrays(songs, "text", ["id"])
    # without lexica the encoded measures equal the rule-based ones
    enc = with_lexicon_encodings(arrays, ["id"])
    a = {(r["measure"]): r["score"] for r in M.score_song_arrays(
        enc, ["id"], ["meter_lexicon", "syllable_lexicon"]).filter("id = 1").collect()}
    b = {(r["measure"]): r["score"] for r in M.score_song_arrays(
        arrays, ["id"], ["meter", "syllable"]).filter("id = 1").collect()}
    assert a["meter_lexicon"] == pytest.approx(b["meter"])
    assert a["syllable_lexicon"] == pytest.approx(b["syllable"])
    pron = spark.createDataFrame(
        [("red", ["R", "EH1", "D"]), ("sky", ["S", "K", "AY1"]), ("sea", ["S", "IY1"]),
         ("low", ["L", "OW1"]), ("tide", ["T", "AY1", "D"]), ("now", ["N", "AW1"])],
        "word string, phonemes array<string>")
    enc = with_lexicon_encodings(arrays, ["id"], pron=pron)
    got = {r["measure"]: (r["score"], r["n_pairs"]) for r in M.score_song_arrays(
        enc, ["id"], ["meter_lexicon", "phonetics_lexicon"]).filter("id = 1").collect()}
    # verse pair: stresses 1111 vs 11111 -> 1/4; chorus pair: 'sing it on' vs
    # 'sing it out' have no lexicon entries -> rule zeros, equal -> 0
    assert got["meter_lexicon"][0] == pytest.approx((0.25 + 0.0) / 2)
    # verse lines are four distinct syllable lists -> 2/2; chorus lines encode
    # to the same empty list -> 0
    assert got["phonetics_lexicon"][0] == pytest.approx((1.0 + 0.0) / 2)


def test_seq_levenshtein(spark):
    df = spark.createDataFrame([(list("kitten"), list("sitting")), ([], ["a"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(M.seq_levenshtein(F.col("a"), F.col("b"))).collect()]
    assert got == [3, 1]


def test_semantic_measures(spark):
    from strophekit.operators.embeddings import attach_line_embeddings
    from strophekit.operators.structure import parse_song_arrays
    arrays = parse_song_arrays(spark.createDataFrame([(1, F1)], "id long, text string"), "text", ["id"])
    vecs = spark.createDataFrame(
        [(1, 0, 0, [0.0, 0.0]), (1, 0, 1, [2.0, 0.0]), (1, 1, 0, [0.0, 1.0]),
         (1, 2, 0, [4.0, 0.0]), (1, 2, 1, [4.0, 2.0]), (1, 3, 0, [0.0, 1.0])],
        "id long, pos int, line_no int, embedding array<float>")
    a = attach_line_embeddings(arrays, ["id"], vecs)
    got = {r["measure"]: r["score"] for r in M.score_song_arrays(
        a, ["id"], ["semantics", "semantics_internal"]).collect()}
    # verse centroids (1,0) and (4,1): distance sqrt(10); chorus centroids equal: 0
    assert got["semantics"] == pytest.approx((10 ** 0.5 + 0.0) / 2)
    # internal: stanza 0 -> 1, stanza 1 -> 0, stanza 2 -> 1, stanza 3 -> 0
    assert got["semantics_internal"] == pytest.approx(0.5)


def test_lemma_lexicon(spark):
    from strophekit.operators.encode import with_lexicon_encodings
    from strophekit.operators.structure import parse_song_arrays
    arrays = parse_song_arrays(spark.createDataFrame(
        [(1, "[verse]\nred skies, red sky\nblue sky")], "id long, text string"), "text", ["id"])
    lemma = spark.createDataFrame([("skies", "sky")], "word string, value string")
    enc = with_lexicon_encodings(arrays, ["id"], lemma=lemma)
    toks = enc.select(F.col("stanzas")[0]["div_tokens"]).first()[0]
    assert toks == ["red", "sky", "red", "sky", "blue", "sky"]
    a = M.score_song_arrays(enc, ["id"], ["diversity_lexicon"]).first()["score"]
    assert a == pytest.approx(-M.mtld_value(toks) / 65)


def test_exact_quantiles_narrowing(spark):
    """Bit-equal to the built-in percentile: ties, values next to each other, far
    apart, of both signs, infinite, a NULL group and a group of one row."""
    rows = [("a", float(i % 37)) for i in range(3000)] + [("a", 100.0)] * 2000 + [("a", None)] * 5
    rows += [("b", float(i) / 7 - 30) for i in range(500)] + [("b", -0.0), ("b", 0.0)]
    rows += [("c", (-1.0) ** i * 2.0 ** (i - 600)) for i in range(1200)]
    close = np.full(400, 1.0).view(np.int64) + np.arange(400)
    rows += [("d", x) for x in close.view(np.float64).tolist()]
    rows += [(None, 3.5), (None, float("inf")), (None, -7.0), ("e", 5e-324), ("f", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    ref = df.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(f"q_{p}") for p in probs])
    assert {tuple(r) for r in R.exact_quantiles(df, ["g"], "v", probs).collect()} == {
        tuple(r) for r in ref.filter("n > 0").collect()}
    whole = df.filter("g in ('a', 'b', 'd')")
    assert R.exact_quantiles(whole, [], "v", [0.3], ["x"]).first() == whole.agg(
        F.count("v").alias("n"), F.percentile("v", F.lit(0.3)).alias("x")).first()
    assert R.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_outliers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 60]] + [("b", 1.0)], "g string, v double")
    assert [tuple(r) for r in R.outliers(df, ["g"], "v").collect()] == [("a", 60.0)]


def test_mtld_moving_average():
    # every start position closes a factor after exactly 10 tokens
    assert M.mtld_ma_wrap_value("a b a b a b a b a b a b".split()) == pytest.approx(10.0)
    assert M.mtld_ma_wrap_value([str(i) for i in range(12)]) == 0.0


def test_term_count_multiword(spark):
    texts = spark.createDataFrame([(1, "m", "x a b a b y"), (2, "m", "a b x a b z a b")],
                                  "id long, model string, text string")
    terms = spark.createDataFrame([(" a b ",), (" x ",)], "term string")
    got = {r["term"]: r["n"] for r in term_counts(texts, ["id"], "model", "text", terms).collect()}
    want = {t: "x a b a b y".count(t) + "a b x a b z a b".count(t) for t in (" a b ", " x ")}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_row_api_pairs_and_stanzas(spark):
    from strophekit.operators.structure import stanzas_from_rows
    rows = spark.createDataFrame([(1, 0, "v", "Red sky"), (1, 1, "c", "sing"), (1, 2, "v", "red sea"),
                                  (1, 3, "c", "  "), (2, 0, "v", "x")],
                                 "id long, turn long, role string, text string")
    st = stanzas_from_rows(rows, ["id"], "turn", "role", "text")
    got = sorted((r["id"], r["pos"], r["keyword"], tuple(r["lines"])) for r in st.collect())
    assert got == [(1, 0, "v", ("red sky",)), (1, 1, "c", ("sing",)), (1, 2, "v", ("red sea",)),
                   (2, 0, "v", ("x",))]
    pairs = M.build_pairs(st, ["id"]).collect()
    assert [(r["pos1"], r["pos2"]) for r in pairs] == [(0, 2)]


def test_line_phonetics(spark):
    from strophekit.operators.encode import line_phonetics
    pron = spark.createDataFrame([("red", ["R", "EH1", "D"]), ("sky", ["S", "K", "AY1"])],
                                 "word string, phonemes array<string>")
    lines = spark.createDataFrame([(1, "Red, sky! blue")], "id long, line string")
    r = line_phonetics(lines, ["id"], "line", pron).first()
    assert list(r["phonemes"]) == ["REH1", "D", "SKAY1"]


def test_letters_beyond_the_basic_blocks(spark):
    from strophekit.operators.encode import tokens
    texts = ["caf\u00e9 noir", "cafe\u0301 noir", "đường đi về", "мир и война", "日本語 の 歌"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", tokens(F.col("t")).alias("w")).collect()}
    assert got == {0: ["cafe", "noir"], 1: ["cafe", "noir"], 2: ["duong", "di", "ve"], 3: ["мир", "и", "война"], 4: ["日本語", "の", "歌"]}


def test_model_outputs_skip_nothing_by_default(spark, tmp_path):
    from strophekit.sources.io import read_model_outputs
    path = f"{tmp_path}/explorations/a_lora.json"
    spark.createDataFrame([(1, "x")], "id long, model_response string").write.json(path)
    read = lambda **k: read_model_outputs(spark, {"a": path}, schema="id long, model_response string", multiline=False, **k)
    assert read().count() == 1 and read(skip="explorations").count() == 1
    with pytest.raises(ValueError):
        read(skip="lora")


def test_containers_nested_and_class_lists(spark):
    """Nested containers, class lists, quotes, entities, unclosed elements."""
    from strophekit.operators.corpus import extract_page_text
    pages = [
        ("<article>a<article>b</article>c</article>", "a\nb\nc b", ""),  # every container, as find_all has it
        ('<div class="ad"><div>x</div>y</div>z', "", "x\ny"),
        ("<div class='ad'>p</div><DIV id=1 class=\"big ad\">q<br>r</DIV><div class=bad>s</div>", "", "p q\nr"),
        ("<article>&#x41;&eacute;&amp;lt; 1 < 2<script>if (a</article>b) x;</script><!-- </article> -->d</article>", "A\u00e9&lt; 1 < 2\nd", ""),
        ("<section><article>e<p>f</section>g", "e\nf", ""),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "page_id long, html string")
    got = {r["page_id"]: (r["lyrics"], r["description"]) for r in extract_page_text(df).collect()}
    assert got == {i: p[1:] for i, p in enumerate(pages)}


def test_response_songs_and_first_hit(spark):
    """Every annotated song of a list, and the first hit's artist."""
    from strophekit.operators.corpus import first_hit_artist, response_songs
    songs = '{"response": {"songs": [{"id": 1, "title": "a", "annotation_count": 2}, {"id": 2, "title": "b", "annotation_count": 0}, {"id": 3, "title": "c", "annotation_count": 1, "x": []}], "next_page": 2}}'
    hits = '{"response": {"hits": [{"result": {"primary_artist": {"id": 7}}}, {"result": {"primary_artist": {"id": 8}}}]}}'
    df = spark.createDataFrame([(1, songs), (2, hits), (3, '{"response": {"songs": [], "hits": []}}'), (4, "{oops"), (5, None)], "k long, body string")
    assert sorted(tuple(r) for r in response_songs(df, ["k"], "body").collect()) == [(1, 1, "a"), (1, 3, "c")]
    got = {r["k"]: r["a"] for r in df.select("k", first_hit_artist(df["body"]).alias("a")).collect()}
    assert got == {1: None, 2: 7, 3: None, 4: None, 5: None}
