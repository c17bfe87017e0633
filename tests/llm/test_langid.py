"""Operator 11: gram sets and scores against plain sets, held-out accuracy, odd inputs."""

import unicodedata
import zlib

import numpy as np

from strophekit.llm import langid as L
from strophekit.llm import queries
from strophekit.llm.common import table
from tests.llm.helpers import frame, odd_documents


def plain_grams(text):
    out, word = set(), []
    for c in (text or "").lower() + " ":
        if unicodedata.category(c).startswith("L"):
            word.append(c)
        elif word:
            padded = " " + "".join(word) + " "
            out |= {padded[i:i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1)} - {" "}
            word = []
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def test_grams_of_odd_texts(monkeypatch):
    texts = [t for _, t, *_ in odd_documents()] + ["it's ½ of Ⅷ_x9y", "Straße ÀÉ", "a", "日本語", "۱۲ 5", "éa"]
    for block in (1 << 20, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        for text in texts[:-1] if block == 7 else texts:
            if block == 7 and text and len(text) > 10_000:
                continue
            assert sorted(map(number, plain_grams(text))) == L.grams_of(text).tolist()


def test_scores_equal_the_kernel_written_out(spark):
    docs = table(spark, queries_dir(), "documents")
    languages, sets, coefficients = model = L.fit(docs, train_docs=150, landmarks=12)
    got = docs.limit(40).select("text", L.predictor(spark, model)("text").alias("p")).collect()
    marks = [set(s.tolist()) for s in sets]
    for r in got:
        own = set(map(number, plain_grams(r["text"])))
        if not own:
            assert r["p"]["lang"] == "und"
            continue
        k = np.array([len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks])
        f = k @ coefficients
        assert languages[int(f.argmax())] == r["p"]["lang"]
        assert abs(min(1, max(0, (f.max() + 1) / 2)) - r["p"]["score"]) < 1e-6


def queries_dir():
    return "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").toPandas()
    got = queries.op11_language_id(spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert set(got["lang_pred"]) <= set(docs["lang"].dropna()) | {"und"}
    held = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95


def test_odd_documents_and_nothing_to_learn(spark):
    got = L.language_predictions(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    for r, (i, text, *_) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(odd_documents(), key=lambda r: str(r[0]))):
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, 6, 7)} == {"en"}
    nothing = [(i, t, None, *rest) for i, t, _, *rest in odd_documents()]
    assert {r["lang_pred"] for r in L.language_predictions(frame(spark, nothing)).collect()} == {"und"}
    assert L.language_predictions(frame(spark, [])).count() == 0


def test_more_languages_than_landmarks(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} word", f"l{i % 10}", *[None] * 7) for i in range(60)]
    languages, sets, _ = L.fit(frame(spark, rows), train_docs=40, landmarks=4)
    assert len(languages) == 10 and len(sets) == 4
