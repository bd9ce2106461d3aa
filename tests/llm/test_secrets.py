import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm.secrets import base62_crc, find_secrets, listed, scan

BASE = (
    (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 1),
    (re.compile("AKIA[A-Z0-9]+"), 20, 0),
    (re.compile("[0-9a-f]+"), 24, 0),
)


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, n, g) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= n)


PIECES = ["password", "PassWd", "secret", "tokentoken", "token", "api_key", "APIKEY", "=", ": ", "'", '"', " ", "abcdef", "abc", "é", "🙂", "AKIA", "AKIAAKIA", "Z9" * 9, "0123456789abcdef" * 2, "f" * 23, "\n", "ſecret", "toKen"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    assert [s for s in scan(text) if s[1] < 3] == brute(text)


def test_checked_token_needs_its_checksum():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + base62_crc(body)
    assert scan(f"é {good}") == [(2, 3, 2 + len(good))]
    assert scan("ghp_" + body + "000000") == []


def test_frame(spark):
    text = "x token = 'abcdef0123' y"
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 3)], "doc_id long, text string, n_hex long")
    got = {tuple(r) for r in find_secrets(df).collect()}
    empty, base = hashlib.sha256(b"").hexdigest(), listed(brute(text))
    assert got == {(1, 0, 0, 0, 0, empty, ""), (2, 0, 0, 0, 0, empty, ""), (3, 1, 0, 0, 0, hashlib.sha256(base.encode()).hexdigest(), base)}
    assert find_secrets(df).count() == 4
    assert find_secrets(df.limit(0)).count() == 0
