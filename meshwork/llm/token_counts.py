"""Token counts by rank-synchronous merging of byte-pair sequences in numpy.

All pre-tokens of a step that are not known yet are held as one ragged array of
symbols. In each round every sequence merges all places of its own lowest-rank
pair at once. A merged symbol's pairs rank after the merge that made it, so this
ends where merging one place at a time ends. What is counted are the symbols
that survive; no token strings or ids are built.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .text import map_texts

#: Entries that a worker remembers (chunk or pre-token to count) before it starts anew.
MEMORY = 400_000

_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
_NONE = np.int64(1) << 40


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PairMerger:
    """Counts of a ``tokenizers`` BPE file: NFC, white space dropped, lower case, split, merges with word ends."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab, chars = model["vocab"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merge_counts(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.inner[flat], np.cumsum(size)
        sym[ends - 1] = self.last[flat[ends - 1]]
        seq, out = np.repeat(np.arange(len(raw)), size), size.copy()
        while len(sym) > 1:
            key = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], _NONE)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(np.r_[rank, _NONE], first)
            each = np.repeat(least, np.diff(np.r_[first, len(seq)]))
            hit = (rank == each[:-1]) & (rank < _NONE)
            if not hit.any():
                break
            # of places that overlap (a a a) every second one merges, from the left
            run = np.flatnonzero(hit)
            lead = np.r_[True, np.diff(run) != 1]
            begin = run[lead][np.cumsum(lead) - 1]
            run = run[(run - begin) % 2 == 0]
            sym[run] = self.made[rank[run]]
            keep = each < _NONE  # sequences without a known pair are done
            keep[run + 1] = False
            np.subtract.at(out, seq[run], 1)
            sym, seq = sym[keep], seq[keep]
        return out

    def _learn(self, chunks: set[str]) -> None:
        split = {c: self.split.findall(c.replace("Σ", "σ").lower()) for c in chunks}
        new = list({p for ps in split.values() for p in ps}.difference(self.pieces))
        if new:
            self.pieces.update(zip(new, self.merge_counts(new).tolist(), strict=True))
        self.chunks.update({c: sum(map(self.pieces.__getitem__, ps)) for c, ps in split.items()})

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text, without begin and end tokens; special strings inside count as one."""
        every: list[str] = []
        extra, ends = [0] * len(texts), []
        for i, t in enumerate(texts):
            parts = [t]
            if self.special and "<" in t:
                parts = self.special.split(t)
                extra[i] = len(parts) - 1
            for p in parts:
                if not p.isascii() and not unicodedata.is_normalized("NFC", p):
                    p = unicodedata.normalize("NFC", p)
                every += [c for c in _SPACES.split(p) if c] if _ODD.search(p) else p.split()
            ends.append(len(every))
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        self._learn(set(every).difference(self.chunks))
        total = np.r_[0, np.cumsum(np.fromiter(map(self.chunks.__getitem__, every), np.int64, len(every)))]
        ends = np.array(ends, np.int64)
        return (total[ends] - total[np.r_[0, ends[:-1]]] + np.array(extra)).tolist() if len(texts) else []


@lru_cache(maxsize=4)
def merger(path: str) -> PairMerger:
    """One merger for each file and worker process."""
    return PairMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One row per input row. A null or empty text has zero bytes and tokens; the
    whole of long texts is counted; repeated rows give equal rows; an empty table
    gives an empty result; other columns are ignored.
    """

    def make():
        m = merger(path)

        def run(ids, texts):
            n = m.count(texts)
            return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return run

    return map_texts(docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
