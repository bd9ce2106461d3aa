"""Secret scan: Aho-Corasick prefilter, anchored expressions, checksum validation.

One automaton finds every keyword in a single pass over an ASCII shadow of the
text (each other character becomes one ``?``, so positions stay code points and
no expression can match it). Expressions are then applied anchored at the hits
alone. Runs of hexadecimal digits have no keyword, so the shadow is mapped to
character classes first and 24 class marks in a row are the keyword.

Spans of the base kinds are reported as matched. Tokens that carry a checksum in
themselves are added only where the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .text import map_texts

# The kinds in reporting order, their keywords and expressions.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

_CLASSES = bytes(0x68 if c in b"0123456789abcdef" else 0x2E for c in range(256))


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    known, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, words in ((0, ASSIGN_WORDS), (1, (ACCESS_WORD,)), (3, CHECKED_WORDS)):
        for w in words:
            known.add_word(w, (kind, len(w)))
    runs.add_word("h" * MIN_HEX, MIN_HEX)
    known.make_automaton()
    runs.make_automaton()
    return known, runs


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits, the checksum of the checked kinds."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in a whole text, by start, then kind; none for None."""
    raw = (text or "").encode("ascii", "replace")
    shadow = raw.decode("ascii")
    known, runs = _automata()
    hits: tuple[list[int], ...] = ([], [], [], [])
    for end, (kind, n) in known.iter(raw.lower().decode("ascii")):
        hits[kind].append(end - n + 1)
    found = []

    def matches(kind: int, pattern: re.Pattern):
        last = 0
        for at in sorted(hits[kind]):
            if at >= last and (m := pattern.match(shadow, at)):
                last = m.end()
                yield m

    found += [(m.start(), 0, m.end()) for m in matches(0, ASSIGN) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in matches(1, ACCESS) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 3, m.end()) for m in matches(3, CHECKED) if base62_crc(m[1]) == m[2]]
    last = 0
    for end, n in runs.iter(raw.translate(_CLASSES).decode("ascii")):
        if end >= last:
            m = HEX.match(shadow, end - n + 1)
            found.append((m.start(), 2, m.end()))
            last = m.end()
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each document.

    Returns one row per input row: doc_id, the number of spans of each kind,
    base_sha256 (of the listed spans of the first three kinds) and spans (all).
    A null or empty text has none (the digest is that of the empty string);
    repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored.
    """

    def make():
        def run(ids, texts):
            out = {"doc_id": ids, "n_assign": [], "n_access": [], "n_hex": [], "n_checked": [], "base_sha256": [], "spans": []}
            for t in texts:
                spans = scan(t)
                kinds = [k for _, k, _ in spans]
                for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_checked")):
                    out[name].append(kinds.count(k))
                base = listed([s for s in spans if s[1] < 3])
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(listed(spans))
            return out

        return run

    return map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")
