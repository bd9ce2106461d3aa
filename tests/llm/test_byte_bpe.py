import base64
import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm import byte_bpe
from meshwork.llm.byte_bpe import BacktrackEncoder, decode_documents, encode_documents, round_trip

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


LIB, RANKS = library(PATH)
OURS = BacktrackEncoder(PATH, PATTERN)
LONG = "ab" * 60_000 + "theion" * 20_000

CASES = [
    "", " ", "\n\n  \n", "Hello, World!!", "aaaaaaaaaaaaa", "it's we'll they've x'd", "12345 3.14", "É é É ΣΑΣ İstanbul", "<|endoftext|>", "tab\tx\x1cy\x1fz\x85",
    "日本語のテキスト 🙂🙂", "x\xa0y　z w", "ab" * 3000, "the " * 2000, "́ á", "\0\0\0", "\U0010ffff", "ﬁ ẞ  ", LONG,
]


@pytest.mark.parametrize("text", CASES)
def test_ids_and_bytes_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == LIB.encode_ordinary(text) and OURS.decode(ids) == text.encode("utf-8")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abetionrs'S .\n<|>1é"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text_as_the_library(texts):
    assert [OURS.encode(t) for t in texts] == [LIB.encode_ordinary(t) for t in texts]


def test_compatible_pairs_are_those_that_merging_keeps():
    r, ids = random.Random(3), list(RANKS.values())
    common = [i for i in ids if i < 3000]
    for k in range(20_000):
        a, b = r.choice(common if k % 2 else ids), r.choice(common if k % 2 else ids)
        assert OURS._compatible(a, b) == (OURS.merged(OURS.token_of[a] + OURS.token_of[b]) == [OURS.token_of[a], OURS.token_of[b]])


def test_ranks_in_any_order(tmp_path):
    """Vocabularies whose tokens may rank before their parts, or be out of reach, against merging by definition."""
    r = random.Random(5)
    for trial in range(60):
        extra = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(12)})
        r.shuffle(extra)
        tokens = [bytes([b]) for b in range(256)] + [t.encode() for t in extra]
        path = tmp_path / f"{trial}.ranks"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        ours, (lib, _) = BacktrackEncoder(str(path), PATTERN), library(path)
        reached = all(ours.merged(t) == [t] for t in extra)
        for _ in range(80):
            text = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            assert ours.encode(text) == lib.encode_ordinary(text), (reached, extra, text)


def test_decoding_any_ids():
    r = random.Random(8)
    ids = [r.randrange(len(RANKS)) for _ in range(5000)]
    assert OURS.decode(ids) == LIB.decode_bytes(ids) and OURS.decode([]) == b""
    for bad in (-1, len(RANKS)):
        with pytest.raises(ValueError, match="vocabulary"):
            OURS.decode([5, bad])


def test_what_is_forgotten_comes_back(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 20)
    ours, r = BacktrackEncoder(PATH, PATTERN), random.Random(4)
    for _ in range(40):
        text = " ".join("".join(r.choice("abetions") for _ in range(r.randint(1, 9))) for _ in range(15))
        assert ours.encode(text) == LIB.encode_ordinary(text)


def test_missing_byte(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        BacktrackEncoder(str(tmp_path / "few"), PATTERN)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hi there", "x"), (3, "Hi there", "x"), (None, "é", None), (4, LONG, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    want = []
    for i, t, _ in rows:
        ids = LIB.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, round_trip(df, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    encoded = encode_documents(df, PATH, PATTERN)
    assert {r.doc_id: bytes(r.bytes).decode() for r in decode_documents(encoded, PATH, PATTERN).collect()} == {1: "", 2: "", 3: "Hi there", None: "é", 4: LONG}
    assert round_trip(df.limit(0), PATH, PATTERN).collect() == []
    bare = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(decode_documents(bare, PATH, PATTERN).first().bytes) == b""
