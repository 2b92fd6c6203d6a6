import hashlib
import random
import re

from centavo.llm import secrets

PATTERNS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
BITS = (
    "password PassWd secret token api_key apikey API_KEY = : ' \" AKIA ABCDEF012345 0123456789abcdef é \n abc x tok "
    "AKI a-b == pass word ghp_ 😀"
).split(" ") + [" ", "  "]


def brute(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f"{kind}:{b}:{e}" for b, _, kind, e in sorted(out)]


def texts():
    random.seed(3)
    made = ["".join(random.choices(BITS, k=random.randint(0, 60))) for _ in range(1500)]
    return [*made, None, "", "a" * 300_000, "token=" + "b" * 100_000, "x" * 5, "x" * 5, "A" * 10 + "AKIA" + "Z" * 70_000]


def test_base_spans_equal_the_patterns(frame):
    given = texts()
    rows = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(frame(given))).collect()}
    assert len(rows) == len(given)
    for i, text in enumerate(given):
        want = brute(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(rows[i].spans.split(","))
        assert rows[i].n_hex == sum(s.startswith("hex") for s in want)


def test_added_kinds(frame):
    text = "é ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----"
    row = secrets.digest(secrets.find_secrets(frame([text]))).first()
    assert row.spans == f"github:2:{2 + 40},private:{43}:{43 + 26}"
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_redaction_keeps_rows_and_columns(frame):
    given = frame(["é token = abcdefgh12 é", None, "", "clean text", "clean text"])
    out = secrets.redact_secrets(given)
    assert out.columns == given.columns
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == ["é [SECRET] é", None, "", "clean text", "clean text"]
    assert [r.n_chars for r in rows] == [12, None, 0, 10, 10]
    assert {r.found for r in rows} == {"x"}


def test_empty_table(frame):
    assert secrets.digest(secrets.find_secrets(frame([]))).collect() == []
    assert secrets.redact_secrets(frame([])).collect() == []
