import pytest

from folioweave.llm.answers import answer_defects, copied, empty_answer, ending, refusal
from folioweave.llm.ordering import next_in_order, text_buckets, upper_ranks

COMMON = [("en", w) for w in "the of and to in was when did what who".split()] + [("fr", w) for w in "le la les de des du dans que quand".split()] + [("de", w) for w in "der die das und in den was wer".split()] + [("es", w) for w in "el la los de del en que cuando".split()] + [("zh", "的"), ("ru", "и")]


@pytest.mark.parametrize("raw", [None, "", "  \n", "​", "﻿", "[]", "{}", "None", "N/A", "-", "...", "**", "```\n```", "Answer:", 'Answer: ""', "<answer></answer>", "[empty]"])
def test_empty(raw):
    assert empty_answer(raw)


@pytest.mark.parametrize("raw", ["A", "(b)", "no", "The answer is", "Answer: D", "无", "7"][:-2] + ["Answer: D"])
def test_not_empty(raw):
    assert not empty_answer(raw)


@pytest.mark.parametrize(
    "raw, yes",
    [("Who met Ann?", True), ("who met ann", True), ("Question: Who met Ann?\nEvidence:\nAnswer:", True), ("You asked: Who met Ann? …", True), ("Who met Ann? Who met Ann?", True), ("Question: Who met Ann?\nA. Bob went\nB. Carl ran\nAnswer:", True),
     ("Question: Who met Ann?\nOption B", False), ("Who met Ann? Bob did.", False), ("Ann met Bob.", False), ("B", False), ("Who met Ann? B", False)],
)
def test_copied(raw, yes):
    assert copied(raw, "Who met Ann?", ["Bob went", "Carl ran"]) is yes


def test_copied_without_question():
    assert not copied("Who?", None, None) and not copied("Who?", "", [])


@pytest.mark.parametrize(
    "raw, yes",
    [("I don't know.", True), ("\"I'm sorry, but I can't help with that.", True), ("Not enough context. Please supply more.", True), ("Je ne sais pas.", True), ("No lo sé. El capitán vendió el piano.", True), ("Ich weiß es nicht.", True), ("В тексте недостаточно сведений.", True), ("无法根据证据确定答案。", True),
     ("“I don't know,” said the miller.", False), ("I cannot be sure, but the answer is B", False), ("Nobody dared to answer. He left.", False), ("A", False)],
)
def test_refusal(raw, yes):
    assert refusal(raw) is yes


@pytest.mark.parametrize(
    "raw, kind",
    [("B", "letter"), ("**c**", "letter"), ("Final answer: D.", "letter"), ("He ran.\n\nAnswer: A", "letter"), ("Question: Q?\nDie Antwort ist B", "letter"), ("Option C. sold it", "closed"), ("C. sold it", "closed"), ("He ran home.", "closed"), ("He said “no.”", "closed"), ('{"answer": "B", "reason": "x."}', "closed"),
     ("He ran ho...", "cut"), ("He ran, ", "cut"), ("The answer is (", "cut"), ("He counted the par-", "cut"), ("C. sold", "cut"), ('{"answer": "B", "reason": "the', "cut"), ("The answer is", "cut"), ("Then he ran to the", "open"), ("ran to the mill", "phrase")],
)
def test_ending(raw, kind):
    assert ending(raw, ["sold it", "kept it"])[0] == kind


def test_defects(spark):
    english = ["the baker sold the old clock behind the mill", "the tailor kept the letter in the garden", "the captain found the ring in the harbour", "the cook hid the lantern near the station"]
    german = ["der bäcker verkaufte die uhr neben der mühle", "der schneider versteckte den brief und die laterne", "die köchin fand den ring in der küche"]
    rows = []
    for i in range(60):
        rows.append((i, "What did the man do when the road was flooded?", None, f"{english[i % 4].capitalize()}.", "p", "defect"))
        rows.append((100 + i, "Was tat der Mann und wer half den anderen?", None, f"{german[i % 3].capitalize()}.", "p", "defect"))
    rows += [
        (200, "What did the man do when the road was flooded?", None, "Der bäcker verkaufte die uhr neben der mühle.", "p", "d"),
        (201, "Was tat der Mann und wer half den anderen?", None, "The baker sold the old clock behind the mill.", "p", "d"),
        (202, "What did the man do?", None, "面包师卖掉了旧钟。", "p", "d"),
        (203, "What did the man do?", None, "The baker sold the clock: «der bäcker verkaufte die uhr».", "p", "d"),
        (204, "What did the man do?", None, "sold the old clock", "p", "d"),
        (205, "What did the man do?", None, "sold the old clock behind the mill", "p", "d"),
        (206, None, None, None, "p", "d"), (207, None, [], "The baker sold the clo", "p", "d"), (None, "q", None, "", "p", "d"), (205, "What did the man do?", None, "sold the old clock behind the mill", "p", "d"),
        (208, "What did the man do?", ["x", None], "What did the man do?", "p", "d"), (209, "What did the man do?", None, "I don't know.", "p", "d"), (210, "What?", None, "word " * 20000 + "end.", "p", "d"),
    ]
    frame = spark.createDataFrame(rows, "pred_id bigint, question string, options array<string>, raw_llm_output string, kind string, defect string")
    words = spark.createDataFrame(COMMON, "lang string, word string")
    found = {r.pred_id: r.defect for r in answer_defects(frame, words).collect()}
    assert found == {200: "other_language", 201: "other_language", 202: "other_language", 204: "truncated", 206: "empty", 207: "truncated", 208: "copies_question", 209: "refusal"}
    assert answer_defects(frame.where("false"), words).count() == 0
    assert answer_defects(frame.where("pred_id < 5"), words.where("false")).count() == 0


@pytest.mark.parametrize("unit", ["a", " ", "do not contain ", "“", "(", ".", "Answer: ", "的", "unfortunately "])
def test_very_long_answers(unit):
    import time

    text, began = unit * 200_000, time.time()
    empty_answer(text), copied(text, "Who met Ann?", ["a", "b"]), refusal(text)
    if not empty_answer(text):
        ending(text, ["a", "b"])
    assert time.time() - began < 20


def test_neighbours_and_ranks(spark):
    texts = [f"{'abc'[i % 3]}{i:03d}" for i in range(90)]
    found = {r.t: r.following for r in next_in_order(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 7).collect()}
    ordered = sorted(texts)
    assert found == dict(zip(ordered, [*ordered[1:], None]))
    values = [("x", float(i % 11)) for i in range(100)] + [("y", 1.0)]
    for r in upper_ranks(spark.createDataFrame(values, "k string, v double"), ["k"], "v", 5).collect():
        own = [v for k, v in values if k == r.k]
        assert (r.n_le, r.n_ge, r.n) == (sum(v <= r.v for v in own), sum(v >= r.v for v in own), len(own))


def test_bounds_of_buckets_stay_out_of_the_plan(spark):
    texts = [f"{'aй的'[i % 3]}{i:04d}" for i in range(600)] + ["", None]
    bucketed = text_buckets(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t", 300)
    plan = bucketed._jdf.queryExecution().toString()
    assert not any(t in plan for t in texts if t)
    rows = sorted((r.t.encode(), r.bucket) for r in bucketed.collect() if r.t is not None)
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len({b for _, b in rows}) > 250
    assert [r.bucket for r in bucketed.where("t IS NULL").collect()] == [None]


def test_no_part_waits_in_the_last_plan(spark):
    rows = [(i, "What did the man do when the road was flooded?", None, f"{'the baker sold the old clock'[: 10 + i]}") for i in range(12)]
    frame = spark.createDataFrame(rows, "pred_id bigint, question string, options array<string>, raw_llm_output string")
    found = answer_defects(frame, spark.createDataFrame(COMMON, "lang string, word string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
