import random

import pytest

from folioweave.llm.bpe import Encoder, add_token_counts, default_vocabulary, encoder, frequencies, once, token_counts, token_ids

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello world", "a" * 3000, "ab" * 2000, "\n" * 500, "的" * 900, "naïve café’s 123456 <|endoftext|>", "x‍👩‍🌾 ퟿", "don't  stop\t\r\n!!", "ﬁ ﬀ ǅ ½ ①"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(library, text):
    assert encoder(default_vocabulary()).encode(text) == library(text)


def test_random_texts_equal_the_library(library):
    rng = random.Random(4)
    own = encoder(default_vocabulary())
    for _ in range(400):
        text = "".join(rng.choice("abcdefghijklm  nopqrst  ,.'0123é的ñ😀\n\t") for _ in range(rng.randint(1, 120)))
        assert own.encode(text) == library(text)


def test_words_equal_plain_merging():
    """Without the library: the best pair merged again and again."""
    own = Encoder(default_vocabulary())
    rng = random.Random(8)
    for _ in range(200):
        word = bytes(rng.choice(b"etaoinshr tion") for _ in range(rng.randint(1, 30))).decode("latin-1")
        parts = [own.words[c] for c in word]
        while True:
            best = min(((own.merged.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert own.encode_word(word) == parts


def test_a_small_memo_changes_nothing(monkeypatch):
    import folioweave.llm.bpe as module

    text = " ".join(f"word{i} und noch {i * 7}" for i in range(300))
    whole = Encoder(default_vocabulary()).encode(text)
    monkeypatch.setattr(module, "MEMO", 5)
    assert Encoder(default_vocabulary()).encode(text) == whole


def test_defined_ids_for_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, ids string")
    found = sorted((r.doc_id, list(r.ids)) for r in token_ids(rows).collect())
    assert [x[1] for x in found[:2]] == [[], []] and found[2] == found[3]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(rows).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert token_ids(rows.where("false")).count() == 0
    assert sorted((r.doc_id, r.ids, r.n_tokens) for r in add_token_counts(rows).collect()) == [(1, "x", 0), (2, "x", 0), (3, "x", 2), (3, "x", 2)]
    assert sorted(r.doc_id for r in once(rows).collect()) == [1, 2, 3]
    assert frequencies(token_ids(rows)).count() == 2
