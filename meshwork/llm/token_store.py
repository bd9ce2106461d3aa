"""Token ids in binary shards: one zstandard frame per document under a shared dictionary.

A store is a folder with two Parquet tables, written and read by Spark alone, so
it lives wherever Spark's file systems reach:

``dictionary``  one row: hash (SHA-256, hex) and bytes of the zstandard
    dictionary, the width of an id in bytes, the tokenizer's name.
``shards``      one row per run of documents in ascending doc_id order: bucket,
    chunk, ahead (ids of the bucket's documents before it), first_doc, last_doc,
    dict_hash, index and payload. The index has for each document doc_id (int64),
    offset in the payload (uint32), n_tokens (uint32), little-endian. The payload is
    the frames, one after another. A single document is read from its shard's row by
    decompressing its own frame only.

Buckets are runs of doc_id with about BUCKET_CHARS of text, so a task's share stays
the same however large the table is. Ids are serialised little-endian in two bytes
where the vocabulary allows it, else in four. The dictionary is trained on a bounded
sample of documents (``sample_docs`` expected, twice as many at most, by a hash of id
and text), whole, in pieces of SAMPLE_IDS ids; it affects the size only. All
documents are encoded, whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, shared_dir
from .ranges import TOGETHER, range_cuts
from .text import ROWS, map_texts, small_batches
from .token_counts import _byte_chars

#: Documents that the dictionary is trained on, ids of a piece of them, and its size.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 2_000, 4_096, 64 << 10

#: Characters of a bucket, payload after which a shard row is closed, bytes of a Parquet row group of shards.
BUCKET_CHARS, SHARD_BYTES, GROUP_BYTES = 4 << 20, 1 << 20, 8 << 20

#: Bytes of remembered segments after which a worker forgets those not met for longest, OWN of each included, and segments that go to the library as one text.
MEMORY, OWN, JOINT = 64 << 20, 220, 200

#: Characters that are encoded in one call: the more, the fewer of their segments are different ones.
CALL_CHARS = 1_000_000

_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u4"), ("n_tokens", "<u4")])
#: Letters of U+0041 to U+024F; places in a text where a pre-token always begins, besides blanks, with what is put there.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_PLACES = ((f"({_LETTERS})([!-@\\[-`{{-~])", "\\1 \0\\2"), ("([^ \t-\r])\n", "\\1 \0\n"))
_WORD = re.compile(f"{_LETTERS}+").fullmatch


class SegmentEncoder:
    """Ids of whole texts by a byte-level ``tokenizers`` file, remembered by segment.

    A blank that follows anything but white space always begins a pre-token, and so does
    a sign or digit after a letter, and a line's end after anything but white space. So a
    text may be cut there and the segments encoded on their own. Texts where white space
    precedes a blank or a cut, or with one of the special strings, go to the library whole. Arrow cuts
    the texts of a call and finds the different segments, and only these are looked up.

    New segments go to the library many at a time. Letters, with a blank or without, are one pre-token,
    and so is the line's end before them; runs of these go to its model without the pre-tokenizer. Others go through it, joined: each
    begins with a blank after a character that is none, so the joined text splits as
    they do. The tokens' lengths in bytes tell where each one's ids end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        asked = spec["pre_tokenizer"] or {}
        self.words = None
        if spec["normalizer"] is None and spec["model"]["type"] == "BPE" and plain.items() <= asked.items():
            model = {k: v for k, v in spec["model"].items() if k != "type" and v is not None}
            model["merges"] = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.words = Tokenizer(models.BPE(**model, cache_capacity=0))
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            self.line = self._ids(["\n"])[0]
        self.chars = dict(enumerate(_byte_chars())) | {10: "\n"}
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        #: ids by segment without its blank, and those of longer ago
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max([*vocab.values(), *special]) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a byte is one character in the vocabulary

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _parted(self, parts: list[str], letters: bool) -> list[bytes]:
        """Ids of each of ``parts``, which begin with a blank; with ``letters`` each is one pre-token and may begin without."""
        runs = [parts[i : i + JOINT] for i in range(0, len(parts), JOINT)]
        if letters:
            library, texts = self.words, ["\n".join(r).encode("utf-8").decode("latin-1").translate(self.chars) for r in runs]
        else:
            library, texts = self.tokenizer, ["".join(r) for r in runs]
        ids = np.array(list(chain.from_iterable(e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
        size = pc.binary_length(pa.array(parts, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size), "left") + 4).tolist()
        return list(map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new segments; one that follows no blank begins with a blank or a NUL in its place."""
        found = {}
        alone = [s for s in new if s[0] in " \0"]
        new = [s for s in new if s[0] not in " \0"] if alone else new
        if self.words:
            begun = [s for s in alone if s[0] == " " and _WORD(s, 1)]
            lines = [s for s in alone if s[:2] == "\0\n" and _WORD(s, 2)]
            letters = list(filter(_WORD, new))
            ids = iter(self._parted([*[" " + s for s in letters], *[s[1:] for s in begun], *[s[2:] for s in lines]], True))
            found.update(zip(chain(letters, begun), ids, strict=False))
            found.update((s, self.line + x) for s, x in zip(lines, ids, strict=True))
        new, alone = (list(filterfalse(found.__contains__, x)) for x in (new, alone))
        found.update(zip(new, self._parted([" " + s for s in new], False), strict=True))
        found.update(zip(alone, self._ids([s[1:] for s in alone]), strict=True))
        return found

    def _found(self, words: list[str], firsts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of different segments, then of texts' first ones; places of those that end with white space."""
        if self.held > MEMORY // 2:
            self.old, self.known, self.held = self.known, {}, 0
        keys = words + [" " + s for s in firsts]
        got = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(got) if x is None]
        names = list(map(keys.__getitem__, missing))
        inner = bisect_left(missing, len(words))
        odd = [i for i, s in zip(missing[:inner], names, strict=False) if not s or s[-1].isspace()]
        ends = dict(zip(map(words.__getitem__, odd), self._ids([(" " + words[i]).removeprefix(" \0") for i in odd]), strict=True))
        back = {k: x for k, x in zip(names, map(self.old.get, names), strict=True) if x is not None}  # of longer ago, met anew
        new = dict.fromkeys(names)
        for k in chain(back, ends):
            new.pop(k, None)
        back.update(self._learned(list(new)))
        self.known.update(back)
        self.held += OWN * len(back) + sum(map(len, back)) + sum(map(len, back.values()))
        back.update(ends)
        for i, x in zip(missing, map(back.__getitem__, names), strict=True):
            got[i] = x
        return got, np.array(odd, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if not texts:
            return []
        whole = {i for i, t in enumerate(texts) if "\0" in t or any(s in t for s in self.special)}
        cut = pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string())
        for place, put in _PLACES:
            cut = pc.replace_substring_regex(cut, place, put)
        cut = pc.split_pattern(cut, " ")
        every, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words, at = every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy().astype(np.int32)
        del cut, every
        firsts = [words[i] for i in at[ends[:-1]]]
        got, odd = self._found(words, firsts)
        if len(odd):  # white space before a blank: neither the text's beginning nor its end
            marked = np.zeros(len(words), bool)
            marked[odd] = True
            marked = marked[at]
            marked[ends[1:] - 1] = False
            marked[ends[:-1][[not s for s in firsts]]] = False
            whole.update(np.flatnonzero(np.logical_or.reduceat(marked, ends[:-1])).tolist())
        at[ends[:-1]] = len(words) + np.arange(len(texts))
        ids = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        n = size[at]
        upto = np.cumsum(n)
        places = np.int32 if max(len(ids), upto[-1]) < 1 << 31 else np.int64
        ids = ids[np.repeat(((np.cumsum(size) - size)[at] - (upto - n)).astype(places), n) + np.arange(upto[-1], dtype=places)].tobytes()
        stops = (4 * upto[ends[1:] - 1]).tolist()
        out = list(map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)))
        for i in whole:
            out[i] = self._ids([texts[i]])[0]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    """One encoder for each file and worker process."""
    return SegmentEncoder(path)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary, or empty bytes where the samples are too few for one."""
    samples = [s for s in samples if len(s) > 8]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frames(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=False, write_dict_id=False),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def _sample(docs: DataFrame, rows: int, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` of ``rows`` documents, by a hash; copies under one id count once, twice as many are the most."""
    space = 1 << 40
    share = min(space, -(-space * sample_docs // max(1, rows)))
    chosen = docs.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(space)) < share)
    return chosen.dropDuplicates(["h"]).select("doc_id", "text").limit(2 * sample_docs)


def write_store(docs: DataFrame, path: str, store: str, end_id: int = 0, bucket_chars: int = BUCKET_CHARS, sample_docs: int = SAMPLE_DOCS) -> str:
    """Encode ``docs`` (doc_id, text) with the tokenizer file at ``path`` into the folder ``store``.

    Each document's ids end with ``end_id``. A null text is an empty one; a null
    doc_id sorts first and is kept as the smallest long; rows that share a doc_id
    are all kept, ordered by their frames' bytes. Returns ``store``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, cuts = range_cuts(docs, "doc_id", bucket_chars)
    end = np.array([end_id], "<u4").tobytes()
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    encoder.cache_clear()  # the driver doesn't encode
    narrow = (lambda raw: np.frombuffer(raw, "<u4").astype("<u2").tobytes()) if width == 2 else (lambda raw: raw)

    def sample():
        enc = encoder(path)

        def run(ids, texts):
            raw = [narrow(x) for x in enc.encode(texts)]
            return {"raw": [x[i : i + SAMPLE_IDS * width] for x in raw for i in range(0, len(x), SAMPLE_IDS * width)]}

        return run

    pieces = sorted(bytes(r.raw) for r in map_texts(_sample(docs, rows, sample_docs), sample, "raw binary").toLocalIterator())
    dictionary = train_dictionary(pieces)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary, width, path.rpartition("/")[2])], "hash string, bytes binary, width int, tokenizer string").coalesce(1).write.parquet(f"{store}/dictionary")

    def encode():
        enc, pack = encoder(path), _frames(dictionary)[0]

        def run(ids, texts):
            raw = [x + end for x in enc.encode(texts)]
            return {"doc_id": ids, "bucket": np.searchsorted(cuts, ids, "left").tolist() if len(cuts) else [0] * len(ids), "n_tokens": [len(x) // 4 for x in raw], "frame": [pack.compress(narrow(x)) for x in raw]}

        return run

    coded = map_texts(docs, encode, "doc_id long, bucket long, n_tokens long, frame binary", CALL_CHARS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "chunk", "ahead", "n_docs", "n_tokens", "first_doc", "last_doc", "dict_hash", "index", "payload"]
        bucket, chunk, ahead, index, frames, size = None, 0, 0, [], [], 0
        encoder.cache_clear()  # what earlier tasks of this worker have remembered

        def row():
            made = np.array(index, _INDEX)
            n = int(made["n_tokens"].sum(dtype=np.int64))
            values = (bucket, chunk, ahead, len(index), n, index[0][0], index[-1][0], digest, made.tobytes(), b"".join(frames))
            kinds = (*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary())
            return n, pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

        for b in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            for k, doc, tokens, frame in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "frame")), strict=True):
                if index and (k != bucket or size >= SHARD_BYTES):
                    n, made = row()
                    yield made
                    chunk, ahead, index, frames, size = (chunk + 1, ahead + n, [], [], 0) if k == bucket else (0, 0, [], [], 0)
                bucket = k
                index.append((doc, size, tokens))
                frames.append(frame)
                size += len(frame)
        if index:
            yield row()[1]

    ordered = coded.repartition(-(-(len(cuts) + 1) // TOGETHER), "bucket").sortWithinPartitions("bucket", "doc_id", "frame").select("bucket", "doc_id", "n_tokens", "frame")
    packed = ordered.mapInArrow(pack, "bucket long, chunk long, ahead long, n_docs long, n_tokens long, first_doc long, last_doc long, dict_hash string, index binary, payload binary")
    packed.write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{store}/shards")
    return store


def open_store(spark: SparkSession, store: str) -> tuple[DataFrame, bytes, int]:
    """(shards with start, dictionary, width of an id); raises where a shard names another dictionary.

    start adds the ids of the buckets before to those of the bucket's documents
    before; one row of two numbers per bucket is handed out, no payload moves.
    """
    d = spark.read.parquet(f"{store}/dictionary").first()
    dictionary = bytes(d.bytes)
    if hashlib.sha256(dictionary).hexdigest() != d.hash:
        raise ValueError(f"{store}: the dictionary doesn't have its hash")
    shards = spark.read.parquet(f"{store}/shards")
    at, rows = 0, []
    for r in shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").toLocalIterator():
        rows.append((r.bucket, at))
        at += r.n
    base = broadcast_if_small(spark.createDataFrame(rows, "bucket long, base long"))
    return shards.join(base, "bucket").withColumn("start", F.col("base") + F.col("ahead")), dictionary, d.width


def _decode(payload: bytes, index: np.ndarray, which: Iterator[int], dictionary: bytes, width: int) -> Iterator[np.ndarray]:
    unpack, view = _frames(dictionary)[1], memoryview(payload)
    ends = np.r_[index["offset"][1:], len(payload)]
    for i in which:
        yield np.frombuffer(unpack.decompress(view[int(index["offset"][i]) : int(ends[i])], max_output_size=int(index["n_tokens"][i]) * width), f"<u{width}").astype("<u4")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files, in no order."""
    small_batches(spark)
    shards, dictionary, width = open_store(spark, store)
    digest = hashlib.sha256(dictionary).hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        for b in (b.slice(i, 1) for b in batches for i in range(len(b))):  # a shard at a time
            named, start, raw, payload = (b.column(c)[0] for c in ("dict_hash", "start", "index", "payload"))
            if named.as_py() != digest:
                raise ValueError(f"{store}: a shard was written with dictionary {named}")
            index = np.frombuffer(raw.as_buffer(), _INDEX)
            n = index["n_tokens"].astype(np.int64)
            crc = [zlib.crc32(x.tobytes()) for x in _decode(payload.as_buffer(), index, range(len(index)), dictionary, width)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((index["doc_id"], pa.int64()), (start.as_py() + np.cumsum(n) - n, pa.int64()), (n, pa.int64()), (crc, pa.int64()))], schema=schema)

    got = shards.select("dict_hash", "start", "index", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63)).cast("long")))


def read_document(spark: SparkSession, store: str, doc_id: int) -> list[list[int]]:
    """Ids of one document (of each row that has this id), by its shard's offset index."""
    shards, dictionary, width = open_store(spark, store)
    out = []
    for r in shards.where(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc"))).orderBy("start").select("index", "payload").collect():
        index = np.frombuffer(bytes(r["index"]), _INDEX)
        out += [x.tolist() for x in _decode(bytes(r["payload"]), index, np.flatnonzero(index["doc_id"] == doc_id), dictionary, width)]
    return out


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write a store in the shared folder and return what its files say of each document.

    One row per input row, also of repeated ones; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, path, f"{shared_dir(spark)}/meshwork/tokens-{uuid.uuid4().hex}", end_id))
