"""Nulls in every column, empty and very long texts, repeats, empty tables and clashing columns, for each operator on documents."""

import pytest

from meshwork.llm import byte_bpe, decontamination, fingerprints, mixing, near_copies, quality, scoring, secrets, simhash, token_counts, token_store
from meshwork.llm.queries import tokenizer_file

pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{i * i % 7919}" for i in range(150_000))
PASSAGE = " ".join(f"item{i}" for i in range(50))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (None, "no id here " * 9, None, "a"), (None, None, None, None),
    (3, LONG, "en", "b"), (4, "same text twice", "en", "b"), (4, "same text twice", "en", "b"), (5, "same text twice", "en", "c"),
    (6, LONG[:900_000] + " " + PASSAGE, "en", "c"), (7, " \n\t ", "en", ""),
]
EXTRA = "size string, score string, h string, key string, row string, taken string, component_id string, fingerprint string, n_tokens string, start string, n string, bucket string, spans string, similarity string"


def frame(spark):
    n = EXTRA.count(",") + 1
    return spark.createDataFrame([(*r, *["x"] * n) for r in ROWS], f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)


def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, PASSAGE, "h"), (None, None, "h"), (2, "", "h")], "item_id long, text string, h string")


def byte_bpe_pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


WHOLE = {
    "op1": lambda s, d: mixing.mix_sources(d),
    "op3": lambda s, d: simhash.near_groups(d),
    "op4": lambda s, d: secrets.find_secrets(d),
    "op5": lambda s, d: scoring.score_documents(d, tokenizer_file("byte_bpe_50k.json")),
    "op6": lambda s, d: token_counts.count_tokens(d, tokenizer_file("word_bpe_49k.json")),
    "op7": lambda s, d: quality.score_quality(d, labels(s)),
    "op8": lambda s, d: fingerprints.fingerprint_neighbours(d),
    "op9": lambda s, d: token_store.round_trip(d, tokenizer_file("byte_bpe_50k.json")),
    "op13": lambda s, d: byte_bpe.round_trip(d, tokenizer_file("byte_bpe_multi_50k.tiktoken"), byte_bpe_pattern()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_for_each_row(spark, name):
    docs = frame(spark)
    got = WHOLE[name](spark, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert WHOLE[name](spark, docs.limit(0)).collect() == []
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "op1":
        assert by[1][0]["size"] == by[2][0]["size"] == by[7][0]["size"] == 0 and by[3][0]["size"] == 150_000
    if name == "op3":
        assert {r.component_id for r in by[4] + by[5]} == {4} and {r.fingerprint for r in (by[1][0], by[2][0], by[7][0])} == {"0" * 16}
    if name == "op5":
        assert by[1][0].n_tokens == by[2][0].n_tokens == 1 and by[3][0].n_tokens == 150_001 and by[1][0].score == by[2][0].score
    if name == "op6":
        assert by[1][0].n_bytes == 0 and by[3][0].n_bytes == len(LONG) and by[3][0].over_limit
    if name == "op7":
        assert by[1][0].score == by[2][0].score and by[4][0].score == by[5][0].score
    if name == "op8":
        assert by[1][0].fingerprint == by[2][0].fingerprint == "" and by[4][0].fingerprint == by[5][0].fingerprint and by[3][0].n_chars == len(LONG)
    if name == "op13":
        assert by[1][0].n_tokens == by[2][0].n_tokens == 0 and by[1][0].ids_sha256 == by[2][0].decoded_sha256 and by[4][0].ids_sha256 == by[5][0].ids_sha256 and by[3][0].n_tokens > 150_000
    if name == "op9":
        assert by[1][0].n_tokens == by[2][0].n_tokens == 1 and sorted(r.start for r in by[None])[0] == 0


def test_leaks(spark):
    docs = frame(spark)
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontamination.find_leaks(docs, items(spark)).collect()] == [(6, 1, 1.0)]
    clean = decontamination.without_leaks(docs, items(spark))
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 1


def test_filters_keep_the_columns(spark):
    docs = frame(spark)
    one = simhash.one_of_each(docs, near_copies.near_copies)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "4", "None"]  # 6 has 3's shingles and a passage
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {None, 3, 4, 5, 6}
    for f in (lambda d: simhash.one_of_each(d, near_copies.near_copies), mixing.mixed_documents, lambda d: decontamination.without_leaks(d, items(spark))):
        assert f(docs.limit(0)).count() == 0


def test_columns_named_as_those_in_between(spark):
    """Columns of the names that the filters use inside pass as they are."""
    names = ["leaked", "__row", "__row_", "__PART", "__copies"]
    docs = spark.createDataFrame([(i, text, "en", "a", *[f"{n}{i}" for n in names]) for i, text in ((1, PASSAGE), (2, "some words of no item"), (2, "some words of no item"), (3, None))], f"doc_id long, text string, lang string, source string, {', '.join(f'{n} string' for n in names)}")
    rows = lambda df: sorted((r.doc_id, *[r[n] for n in names]) for r in df.collect())
    own = lambda i: (i, *[f"{n}{i}" for n in names])
    clean = decontamination.without_leaks(docs, items(spark))
    assert clean.columns == docs.columns and rows(clean) == [own(2), own(2), own(3)]
    one = simhash.one_of_each(docs, near_copies.near_copies)
    assert one.columns == docs.columns and rows(one) == [own(1), own(2), own(3)]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(rows(mixed)) <= {own(1), own(2)}
