import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm import text, token_store
from meshwork.llm.token_store import SegmentEncoder, open_store, read_document, round_trip, write_store

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, LIB = SegmentEncoder(PATH), tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab's .\n\t  é\x1c<|>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=30), max_size=4))
def test_segments_encode_as_whole_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in OURS.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["", " ", "  a", "a ", "a  b", "a\n b", "x<|endoftext|> y", "\n \n x", "a\xa0 b", "a b", "a\0 b", " a b é\n", " x\n", "a <b\t c"])
def test_edge_texts(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def expected(rows):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 200)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(500, None), (None, "no id"), (400, "x" * 9000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_tokens string")
    store = write_store(df, PATH, str(tmp_path / "s"), bucket_chars=300, sample_docs=50)
    got = sorted(map(tuple, token_store.read_store(spark, store).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert open_store(spark, store)[0].count() > 10
    assert read_document(spark, store, 400) == [LIB.encode("x" * 9000).ids + [0]]
    assert read_document(spark, store, 12345) == []


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    assert sorted(r.start for r in round_trip(df, PATH).collect()) == [0, 3, 6, 9, 12]
    assert round_trip(df.limit(0), PATH).collect() == []


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "MEMORY", 4_000)
    ours = SegmentEncoder(PATH)
    texts = [" ".join(f"word{i * k % 61}" for i in range(40)) for k in range(1, 60)]
    for i in range(0, len(texts), 3):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts[i : i + 3])] == [LIB.encode(t, add_special_tokens=False).ids for t in texts[i : i + 3]]
        assert ours.held >= sum(map(len, ours.known))
    assert len(ours.known) < 100


def test_letters_and_what_follows_them_are_remembered_apart():
    ours = SegmentEncoder(PATH)
    words, signs = [f"wo{'rd' * i}" for i in range(1, 21)], [".", ",", "!!", "'s", "'", "7", ".\nThe", "\n\nx", "é.", "-a"]
    texts = [" ".join(w + s for w in words) for s in signs]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(ours.known) < 80  # 200 of letters and signs together


def test_first_words_and_lines_of_letters_skip_the_pre_tokenizer(monkeypatch):
    ours, asked = SegmentEncoder(PATH), []
    ids = ours._ids
    monkeypatch.setattr(ours, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    texts = ["Uvwxyz abc\nÉtuvw\nabc d", "Uvwxyz\n", "Uvwxyz Uvwxyz\n1a\nB'c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {"Uvwxyz", "\nÉtuvw", "\nabc"} & set(asked)


def test_texts_are_put_together_whole_and_in_order():
    rows = [(i, "x" * (7 * i % 5)) for i in range(23)]
    parts = [([i for i, _ in rows[k : k + 2]], [t for _, t in rows[k : k + 2]]) for k in range(0, 23, 2)]
    got = list(text.gathered(iter(parts), 10))
    assert [x for ids, texts in got for x in zip(ids, texts, strict=True)] == rows
    assert all(sum(map(len, texts)) >= 10 for _, texts in got[:-1]) and len(got) < len(parts)
    assert not list(text.gathered(iter([]), 10))
