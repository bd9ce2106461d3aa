import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm.token_counts import PairMerger, count_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
OURS, LIB = PairMerger(PATH), tokenizers.Tokenizer.from_file(PATH)

CASES = [
    "", " ", "\n\n", "Hello, World!!", "aaaaaaaaaaaaa", "it's we'll they've x'd", "12345 3.14", "É é É ΣΑΣ İstanbul",
    "a<|endoftext|>b<|startoftext|>", "<|endoftext|>", "<|endoftext", "tab\tx\x1cy\x1fz", "日本語のテキスト 🙂🙂", "x\xa0y　z w",
    "ab" * 3000, "the " * 2000, "́ á", "'S 'LL", "ﬁ ẞ",
]


@pytest.mark.parametrize("text", CASES)
def test_counts_as_the_library(text):
    assert OURS.count([text]) == [len(LIB.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abet'S .\n<|>1é"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=5))
def test_batches_as_the_library(texts):
    assert OURS.count(texts) == [len(LIB.encode(t, add_special_tokens=False).ids) for t in texts]


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hi there", "x"), (3, "Hi there", "x"), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(df, PATH, 1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 8, 2, True), (3, 8, 2, True), (None, 2, 1, False)], key=str)
    assert count_tokens(df.limit(0), PATH).collect() == []
