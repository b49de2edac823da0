import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdictframe.llm import byte_bpe, token_counts
from verdictframe.llm.byte_bpe import PrefixTable, encoder


@pytest.fixture(scope="module")
def enc():
    return encoder()


@pytest.fixture(scope="module")
def reference(enc):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=enc.vocabulary.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_equals_the_library(texts):
    import tiktoken

    enc = encoder()
    ref = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=enc.vocabulary.ranks, special_tokens={})
    for text, got in zip(texts, enc.encode_all(texts)):
        assert ids(got) == ref.encode_ordinary(text)
        assert enc.decode(got) == text.encode()


def test_many_words_at_once_and_long_pieces(enc, reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeinrstuhé '12\n") for _ in range(4000)) for _ in range(4)]
    texts += ["a" * 5000, " " * 3000, "ab" * 700, "日本語" * 200, ""]
    for text, got in zip(texts, enc.encode_all(texts)):
        assert ids(got) == reference.encode_ordinary(text)


def test_more_pieces_than_are_remembered(enc, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    enc.known.clear()
    text = " ".join(f"word{k}x" for k in range(400))
    assert ids(next(enc.encode_all([text]))) == reference.encode_ordinary(text)


def test_prefix_table_appends_and_edits(enc):
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdehinrst") for _ in range(rng.randint(0, 40)))
        table = PrefixTable(enc.vocabulary, data)
        table.append(b"ing")
        data += b"ing"
        assert table.ids() == PrefixTable(enc.vocabulary, data).ids()
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        table.replace(a, b, b"the")
        data = data[:a] + b"the" + data[b:]
        assert table.data == data and table.ids() == PrefixTable(enc.vocabulary, data).ids()
        for end in range(1, len(data) + 1):  # every prefix is encoded
            assert table.last[end] == PrefixTable(enc.vocabulary, data[:end]).ids()[-1]


def test_documents(docs_of, reference):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x'll 12 é")]
    out = byte_bpe.encode_documents(docs_of(rows, extra=True)).collect()
    assert len(out) == 5 and all(r["n"] == "own n" for r in out)
    for r in out:
        want = reference.encode_ordinary(r["text"] or "")
        assert list(r["token_ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs_of([])).count() == 0


def test_token_tree_follows_edits(enc):
    rng = random.Random(3)
    letters = "ab cd  \n'st'12..é\t"
    for _ in range(250):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        tree = token_counts.TokenTree(enc, enc.split(text))
        for _ in range(4):
            a = rng.randint(0, len(text) + 1)
            b = a + rng.randint(0, 12)
            new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
            tree.replace(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))):]
            assert tree.text() == text
            assert [p for block in tree.blocks for p in block] == enc.split(text)
            assert tree.tokens == len(ids(next(enc.encode_all([text])))) and tree.chars == len(text)


def test_edit_touches_few_pieces(enc):
    text = "the quick brown fox jumps over the lazy dog " * 2000
    tree = token_counts.TokenTree(enc, enc.split(text))
    tree.replace(40_000, 40_003, "xyz")
    assert tree.reencoded < 10


def test_edited_counts(spark, docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(1, "some words here"), (2, None), (3, ""), (4, "tail"), (4, "tail")], extra=True)
    edits = token_counts.edits_column((F.lit(0), F.lit(4), F.lit("other")), (F.lit(None), F.lit(None), F.lit(None)))
    out = token_counts.edited_token_counts(df, edits, edited=True).collect()
    for r in out:
        assert r["edited_text"] == "other" + (r["text"] or "")[4:]
        assert r["n_tokens_after"] == len(ids(next(encoder().encode_all([r["edited_text"]]))))
        assert r["n_tokens"] == len(ids(next(encoder().encode_all([r["text"] or ""]))))
    none = F.lit(None).cast("array<struct<start: long, stop: long, text: string>>")
    assert all(r["n_tokens"] == r["n_tokens_after"] for r in token_counts.edited_token_counts(df, none).collect())
    assert token_counts.edited_token_counts(docs_of([]), none).count() == 0
