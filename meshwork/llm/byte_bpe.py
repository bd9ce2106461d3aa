"""Byte-level BPE by backtracking over longest matches; encoding and decoding.

The vocabulary is a rank file (base64 token and rank in each line). Bytes are mapped
to the Latin-1 characters of the same numbers, so that one Aho-Corasick automaton over
strings finds the tokens of any bytes. A pre-token is read once by the automaton,
which gives the longest token from every place. The encoder takes the longest one,
as long as it is compatible with the token before: merging the two tokens' bytes by
rank must give these two again. Otherwise it takes the next shorter token from the
same place, and where none is left it steps back and marks the place as one that no
encoding reaches. A place is marked once at most, so the time is linear in the
length. A sequence whose neighbours are all compatible is the one that merging by
rank gives, so the ids are the same, whatever the pre-token. Compatibility of a pair
is found once and remembered, as are the ids of short pre-tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import STEP_ROWS, map_texts, small_batches

#: Pre-tokens that a worker remembers at most, in two generations, and three times as many pairs; pre-tokens over SHORT characters are not remembered.
MEMORY, SHORT = 400_000, 64
_NONE: dict[int, bool] = {}

#: Ids that one step of decoding holds at most, besides a single longer row.
STEP_IDS = 500_000


class BacktrackEncoder:
    """Ids of whole texts by a rank file, pre-token by pre-token; special strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in map(bytes.split, f)}
        self.token_of = {r: t for t, r in self.rank.items()}
        #: By id: length, and the longest token that is a proper prefix (-1 for a byte).
        self.size, self.shorter = [0] * (max(self.token_of) + 1), [-1] * (max(self.token_of) + 1)
        missing = [b for b in range(256) if chr(b) not in self.rank]
        if missing:
            raise ValueError(f"{path}: no token for the bytes {missing}")
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, (len(t) - 1, r))
            self.size[r] = len(t)
            self.shorter[r] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        self.automaton.make_automaton()
        self.lengths = np.array(self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer("".join(self.token_of.get(r, "") for r in range(len(self.size))).encode("latin-1"), np.uint8)
        self.split = regex.compile(pattern)
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.edges: tuple[dict[int, list | None], dict[int, list | None]] = ({}, {})
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Parts of a few bytes by the definition: again and again the adjacent pair of the lowest rank merges, from the left; ``least`` are left."""
        parts, rank = list(text), self.rank
        while len(parts) > least:
            ranks = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[str, int, int]] | None:
        """What lies at the right (side 1) or left (0) edge of the token while it is made: (bytes, rank, rank at which it is consumed).

        None where a token ranks before a part of its own, so that ranks don't tell the order of merges.
        """
        found = self.edges[side].get(token, ())
        if found == ():
            text, until, found = self.token_of[token], 1 << 60, []
            while found is not None:
                made = self.rank[text]
                found.append((text, made if len(text) > 1 else -1, until))
                if len(text) == 1:
                    break
                parts, until = self.merged(text, 2), made
                ordered = len(parts) == 2 and all(len(p) == 1 or self.rank[p] < made for p in parts)
                text, found = (parts[side], found) if ordered else ("", None)
            self.edges[side][token] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged; left is -1 at the begin.

        They don't if a part at the right edge of the one and a part at the left edge
        of the other make a token at a time when both are there; of equal ranks the
        left one is merged first.
        """
        a, b = self._edge(left, 1) if left >= 0 else [], self._edge(right, 0)
        if a is None or b is None:
            parts = [self.token_of[t] for t in (left, right) if t >= 0]
            apart = self.merged("".join(parts)) == parts
        else:
            apart, get = True, self.rank.get
            for x, from_x, until_x in a:
                for y, from_y, until_y in b:
                    r = get(x + y)
                    if r is not None and r < until_x and r <= until_y and from_y < until_x and from_x <= until_y:
                        apart = False
        if self.n_pairs > 3 * MEMORY:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        self.pairs.setdefault(left, {})[right] = apart
        return apart

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token as int32; a whole token is its own encoding."""
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        longest = [0] * len(text)
        for end, (back, token) in self.automaton.iter(text):  # of the tokens from one place the last is the longest
            longest[end - back] = token
        size, shorter, pairs, fits, most = self.size, self.shorter, self.pairs, self._compatible, len(text)
        closed: set[int] = set()
        out, at, token, before, after = array("i"), 0, longest[0], -1, pairs.get(-1, _NONE)
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in closed:
                    known = after.get(token)
                    if known or known is None and fits(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == most:
                    return out.tobytes()
                at, before, token = end, token, longest[end]
            else:
                closed.add(at)
                token = out.pop()  # its end is closed now, so a shorter one comes
                at, before = at - size[token], out[-1] if out else -1
            after = pairs.get(before, _NONE)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        pieces, known, older = self.split.findall(text), self.pieces, self.older
        if len(known) > MEMORY:  # what isn't asked for until the next time is forgotten
            self.pieces, self.older = known, older = {}, known
        out = list(map(known.get, pieces))
        if None in out:
            for i, p in enumerate(pieces):
                if out[i] is None:
                    found = known.get(p) or older.get(p) or self.encode_piece(p)
                    if len(p) <= SHORT:
                        known[p] = found
                    out[i] = found
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str) -> list[int]:
        """The same as a list."""
        return self.ids(text).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after another; an unknown id raises."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BacktrackEncoder:
    """One encoder for each file and worker process."""
    return BacktrackEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each document's whole text.

    One row per input row, also of repeated ones and of null ids. A null or empty
    text has no ids; an empty table gives an empty result; other columns are ignored.
    """

    def make():
        enc = encoder(path, pattern)
        return lambda ids, texts: {"doc_id": ids, "ids": [enc.ids(t) for t in texts]}

    return map_texts(docs, make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes) of rows (doc_id, ids): what the ids stand for; null ids are none, an unknown or null id raises."""
    small_batches(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)

        def made(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = b.column(1).cast(pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([enc.decode(x.values.to_numpy()) if x.is_valid else b"" for x in ids], pa.binary())], schema=schema)

        for b in (b.slice(i, STEP_ROWS) for b in batches for i in range(0, len(b), STEP_ROWS)):
            size, start = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while start < len(b):
                done = size[start - 1] if start else 0
                n = max(1, int(np.searchsorted(size, done + STEP_IDS, "right")) - start)
                yield made(b.slice(start, n))
                start += n

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 of each document, encoded and decoded."""
    both = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
