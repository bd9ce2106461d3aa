import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from meshwork.llm import decontamination, mixing, quality
from meshwork.llm.queries import table, tokenizer_file
from test_near_copies import brute_groups

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_on_its_own_input(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_store"]
    docs = table(spark, str(DATA), "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], str(DATA)).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    for k in kept[:-1]:
        assert k.columns == columns
    good = quality.score_quality(docs, table(spark, str(DATA), "labels")).where("predicted = 1")
    assert ids(kept[1]) == ids(good)
    groups = brute_groups([(r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect()])
    assert ids(kept[2]) == Counter({least for _, least in groups})
    leaked = {r.doc_id for r in decontamination.find_leaks(kept[2], table(spark, str(DATA), "benchmark")).collect()}
    assert leaked and ids(kept[3]) == Counter({d: 1 for d in ids(kept[2]) if d not in leaked})
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kept[3]).collect()}
    assert ids(kept[4]) == Counter({d: n for d, n in copies.items() if n})
    library, at, want = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0, []
    for r in sorted(kept[4].collect(), key=lambda r: r.doc_id):
        x = library.encode(r.text, add_special_tokens=False).ids + [0]
        want.append((r.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, kept[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_odd_documents_pass(spark, tmp_path):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (2, "", None, "a", 0), (None, "word " * 50, "en", "a", 1), (3, "Some words here. " * 9, "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{start is docs}")
            stage(spark, now, str(DATA)).write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (start is docs)
