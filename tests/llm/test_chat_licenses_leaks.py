"""Operators 6, 9 and 10."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from strophekit.llm import chat, decontam, licenses, queries
from strophekit.llm.common import table
from tests.llm.helpers import SF, frame, odd_documents

TURNS = "conv_id long, turn int, role string, text string, formatted string, turns int, opens string"


# ----------------------------------------------------------------- chat

def odd_turns():
    rows = [(1, 0, "a\\b\nc", "x<|im_end|>\n"), (1, 1, "a\\b\nc", "<\\|turn|>"), (1, None, "assistant", None), (1, 3, "assistant", "<\\\\|a<"),
            (1, 3, "assistant", "|é😀"), (1, 4, "<|im_start|>user\\n", ""), (2, 0, None, None), (None, 1, "assistant", "z"),
            (3, 1, "user", "b"), (3, 0, "user", "a"), (3, 1, "user", "b")]
    rng = random.Random(1)
    rows += [(10 + i % 40, i, rng.choice(["user", "assistant", "system"]),
              "".join(rng.choice(["<", "|", "\\", "<|turn|>", "<|im_end|>", "im_start|>", "é😀", "\ufeff", "\n", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    return rows


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*r, "f", 1, "o") for r in odd_turns()], TURNS)
    made = chat.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    told = {}
    for c, turn, role, text in odd_turns():
        told.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(back) == set(told)
    for c, rows in told.items():
        got = [(t["role"], t["text"]) for t in back[c]["turns"]]
        assert sorted(got) == sorted((r[2], r[3]) for r in rows)
        assert got == [(r[2], r[3]) for r in sorted(rows)]
        assert list(back[c]["loss_texts"]) == [t for r, t in got if r == "assistant"]
    for r in made.collect():
        for at, n in r["loss_spans"]:
            assert not any(mark in r["formatted"][at:at + n] for mark in (chat.START, chat.END, chat.TURN))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    """20,000 turns of one conversation, and 20,000 of one role, in linear time."""
    n = 20_000
    rows = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("conv_id"), F.col("id").cast("int").alias("turn")).select(
        "conv_id", "turn", F.when((F.col("conv_id") == 1) & (F.col("turn") % 2 == 0), "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é<|turn|> "), F.col("turn").cast("string")).alias("text"))
    began = time.monotonic()
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert time.monotonic() - began < 60
    texts = [f"é<|turn|> {i}" for i in range(n)]
    assert [t["text"] for t in got[1]["turns"]] == texts and list(got[1]["loss_texts"]) == texts[1::2]
    assert got[2]["formatted"].count(chat.START) == 1 and list(got[2]["loss_texts"]) == texts


def test_chat_plan_is_native(spark):
    plan = queries.op9_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_injected_conversation(spark):
    row = queries.op9_chat_format(spark, SF).filter("conv_id = -1").first()
    text = queries.INJECTION
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ------------------------------------------------------------- licenses

def test_license_plan_is_native(spark):
    plan = queries.op6_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange", "Join"))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_at_every_offset(spark, name):
    template = licenses.TEMPLATES[name]
    rows = [(i, " ".join(f"pad{j}" for j in range(i)) + " \n" + template.upper() + ", and" * (i % 3), *[None] * 8) for i in range(9)]
    rows.append((99, "unrelated words only, licensed to nobody at all", *[None] * 8))
    got = {r["doc_id"]: [m["name"] for m in r["licenses"]] for r in licenses.with_licenses(frame(spark, rows)).collect()}
    assert all(name in got[i] for i in range(9)) and got[99] == []


def test_license_containment(spark):
    words = licenses.TEMPLATES["mit-permission"].split()
    half, most = " ".join(words[:len(words) // 2]), " ".join(words[:-4])
    rows = [(1, half, *[None] * 8), (2, "x " + most, *[None] * 8)]
    got = {r["doc_id"]: [m["name"] for m in r["found"]] for r in licenses.with_licenses(frame(spark, rows), column="found").collect()}
    assert got == {1: [], 2: ["mit-permission"]}


def test_license_odd_documents(spark):
    out = licenses.with_licenses(frame(spark), column="found")
    assert out.count() == len(odd_documents()) and out.filter(F.size("found") > 0).count() == 0
    assert licenses.with_licenses(frame(spark, []), column="found").count() == 0
    with pytest.raises(ValueError):
        licenses.with_licenses(frame(spark), {"short": "too few words"}, column="found")


# ---------------------------------------------------------------- leaks

def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_bit_distance():
    rng = random.Random(4)
    for _ in range(400):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontam.bit_distance(item, masks, text) == least_edits(item, text)


def test_leaks_equal_brute_force():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 25)))) for i in range(25)] + [(90, "?!"), (91, ""), (92, "ab")]
    matcher = decontam.Matcher(items)
    hits = 0
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(copy) // 9))):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(["", "x", "yz", " "])
            parts += ["".join(copy).upper(), " ".join(word() for _ in range(rng.randint(0, 20)))]
        text = rng.choice([". ", "\n", "  "]).join(parts)
        data, expected = decontam.normalised(text), []
        for item_id, item in items:
            item = decontam.normalised(item)
            if item and (e := least_edits(item, data)) <= len(item) * decontam.ERROR_PERCENT // 100:
                expected.append((item_id, e))
        assert matcher.leaks(text) == expected
        hits += len(expected)
    assert hits > 50


def test_op10_over_the_table(spark):
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = {r["doc_id"]: r for r in queries.op10_benchmark_decontamination(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        held = {i for i, t in bench if decontam.normalised(t) in decontam.normalised(r["text"] or "")}
        assert held <= set(got[r["doc_id"]]["item_ids"])
        assert got[r["doc_id"]]["contaminated"] == (got[r["doc_id"]]["n_items"] > 0)


def test_leaks_odd_tables_and_blocks(spark):
    bench = spark.createDataFrame([(1, "one two three FOUR five"), (1, "one two three FOUR five"), (2, None), (None, "x"), (3, ""), (4, "text without an id")],
                                  "item_id long, text string")
    one = decontam.with_leaks(frame(spark), bench, "found").select("doc_id", "found").collect()
    blocks = decontam.with_leaks(frame(spark), bench, "found", block_items=1).select("doc_id", "found").collect()
    assert sorted(map(str, one)) == sorted(map(str, blocks))
    # the item without an id, a single x, stands in two more documents
    assert {r["doc_id"] for r in one if r["found"]} == {1, 5, 7, 9, None}
    kept = decontam.clean(frame(spark), bench)
    assert kept.columns == frame(spark).columns and kept.count() == len(odd_documents()) - 6
    assert decontam.clean(frame(spark), bench.limit(0)).count() == len(odd_documents())
    assert decontam.clean(frame(spark, []), bench).count() == 0


def test_brief_notices(spark):
    """A notice of fewer than five words is found as a whole word run only."""
    texts = ["All rights reserved.", "(c) 2020 X. ALL RIGHTS\nRESERVED! Released under the MIT License.", "all rights are reserved", "all rights", "rights reserved all",
             "all all rights reserved", None, ""]
    rows = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    out = licenses.with_licenses(frame(spark, rows), brief=licenses.BRIEF_TEMPLATES).collect()
    got = {r["doc_id"]: [(m["name"], m["containment"]) for m in r["licenses"]] for r in out}
    brief = ("all-rights-reserved", 1.0)
    assert got == {0: [brief], 1: [brief, ("mit-notice", 1.0)], 2: [], 3: [], 4: [], 5: [brief], 6: [], 7: []}
    with pytest.raises(ValueError):
        licenses.with_licenses(frame(spark), brief={"none": "..."})
    told = queries.op6_license_scan(spark, "/root/testdata/sf0.1").filter("licenses = 'all-rights-reserved'")
    assert told.count() == 66


def test_items_without_an_id_and_blocks_by_bytes(spark):
    item = "a passage of some length that stands in the test set as it is"
    bench = spark.createDataFrame([(None, item), (7, "quite another sentence which the second block may hold"), (8, "!!"), (None, None)],
                                  "item_id long, text string")
    docs = [(1, "so " + item + " end"), (2, "quite another sentence which the second block may hold"), (3, "clean"), (1, "so " + item + " end"), (None, None)]
    rows = frame(spark, [(i, t, *[None] * 8) for i, t in docs])
    want = [(1, [None]), (1, [None]), (2, [7]), (3, []), (None, [])]
    for size in (1 << 20, 8):
        got = decontam.with_leaks(rows, bench, "found", block_bytes=size)
        assert got.columns == [*rows.columns, "found"]
        assert sorted(((r["doc_id"], [x["item_id"] for x in r["found"]]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted(r["doc_id"] or 0 for r in decontam.clean(rows, bench).collect()) == [0, 3]


def test_short_templates_are_retrieved_at_the_stated_rate(spark):
    """100 random five-word templates at both parities: 10,000 passages, 0.64 misses expected."""
    import random
    rng = random.Random(11)
    known = {f"t{k:03d}": " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(5)) for k in range(100)}
    rows = []
    for name, text in known.items():
        for i in range(100):
            lead = " ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(4 + i % 2))
            rows.append((len(rows), f"{lead} {text} {' '.join(f'y{rng.randrange(10 ** 6)}' for _ in range(5))}", name, *[None] * 7))
    out = licenses.with_licenses(frame(spark, rows).repartition(4), known).select("lang", "licenses.name").collect()
    missed = sum(r["lang"] not in r["name"] for r in out)
    assert missed <= 5 and all(set(r["name"]) <= {r["lang"]} for r in out)
