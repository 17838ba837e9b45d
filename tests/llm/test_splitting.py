import random

import pytest

from folioweave.llm.splitting import split_oversized, split_spans

SCHEMA = "field_name string, book_id string, chunk_id string, text string, max_chars int, overlap_chars int, piece string"


def checked(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    if not text:
        assert spans == []
        return []
    whole = text[spans[0][0] : spans[0][1]]
    for (_, before), (start, end) in zip(spans, spans[1:]):
        assert start == before - overlap and end > before
        whole += text[before:end]
    assert whole == text and all(end - start <= limit for start, end in spans)
    return [text[a:b] for a, b in spans]


def test_round_trip_of_random_texts():
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice("ab c.\n,é的。 ́") for _ in range(rng.randint(0, 300)))
        limit = rng.randint(2, 60)
        checked(text, limit, rng.randint(0, limit - 1))


def test_cuts_at_natural_boundaries():
    text = "First one here. Second one here.\n\nThird one here. Fourth one here."
    assert checked(text, 40, 0) == ["First one here. Second one here.\n\n", "Third one here. Fourth one here."]
    assert checked("x" * 100, 30, 5)[0] == "x" * len(checked("x" * 100, 30, 5)[0])
    pieces = checked(("Some words are here, and more are there. " * 40).strip(), 200, 20)
    assert all(p.endswith(". ") for p in pieces[:-1])
    assert checked("Alpha ends here.\n\nCHAPTER TWO\n\nBeta begins here and runs.", 48, 0)[1].startswith("CHAPTER TWO")


@pytest.mark.parametrize("unit", ["a", " ", "\n", ".", "的", "a ", "“", "\u0301", "x.\n\n"])
def test_very_long_texts(unit):
    checked(unit * 300_000, 1600, 120)


def test_rejects_bad_limits():
    for limit, overlap in ((5, 5), (5, -1), (0, 0)):
        with pytest.raises(ValueError):
            split_spans("abcdefgh", limit, overlap)


def test_rows(spark):
    rows = [("f", "b", "c1", "word " * 50, 100, 10, "x"), ("f", "b", "c1", "word " * 50, 100, 10, "x"), ("f", "b", "c2", None, 100, 10, "x"), ("f", "b", "c3", "", 100, 10, "x"), ("f", "b", "c4", "y" * 100, 100, 10, "x"), ("f", "b", "c5", "y" * 101, 100, None, "x"), ("g", "b", "c6", "y" * 500, None, 10, "x"), ("f", None, "c7", "é " * 60, 100, 0, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = split_oversized(frame).collect()
    assert {r.chunk_id for r in found} == {"c1", "c5", "c7"}
    one = sorted((r.piece_no, r.piece, r.overlap) for r in found if r.chunk_id == "c1")
    assert [p[0] for p in one] == list(range(len(one))) and one[0][1] + "".join(p[10:] for _, p, _ in one[1:]) == "word " * 50
    assert split_oversized(frame, with_text=False).count() == len(found)
    assert split_oversized(frame.where("false")).count() == 0
