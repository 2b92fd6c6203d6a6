import hashlib
import random
import re

import numpy as np

from centavo.llm import personal
from centavo.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]


def texts():
    random.seed(5)
    bits = ["a", "b.c", "@", ".", "-", " ", "1", "22", "255", "256", "0", "+", "(", ")", "4539", "1488", "0343", "6467", "é", "x_y", "%", "😀",
            "+1 (555) 555-1234", "10.0.0.1", "me@x.org", "4539 1488 0343 6467", "\x01", "\n"]
    made = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(2500)]
    long = ["7" * 60_000, "a." * 30_000 + "@b.c", "x@" + "a." * 30_000 + "c", "1 " * 30_000, "1.2.3.4 " * 2000, "+" + "1 " * 20_000]
    return [*made, *long, None, "", "me@x.org", "me@x.org"]


def test_base_spans_equal_the_plain_forms(frame):
    given = texts()
    rows = {r.doc_id: r for r in personal.digest(personal.personal_spans(frame(given))).collect()}
    for i, text in enumerate(given):
        want = brute(text)
        got = [s for s in rows[i].spans.split(",") if s and not s.startswith("number")]
        assert got == want, text
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]


def test_redaction(frame):
    given = ["write to me@x.org or +1 (555) 555-1234!", None, "é 10.0.0.1", "none"]
    rows = {r.doc_id: r.text for r in personal.redact(frame(given)).collect()}
    assert rows == {0: "write to [email] or [phone]!", 1: "", 2: "é [ip]", 3: "none"}


def test_boosting_separates_and_calibrates():
    rng = np.random.default_rng(0)
    cells = []
    for bits in range(1 << 12):
        good = (bits >> 2 & 1) ^ (bits >> 7 & 1)
        n = int(rng.integers(1, 9))
        cells.append((bits, n, int(rng.binomial(n, 0.97 if good else 0.03))))
    fitted = personal.boost(cells)
    want = np.array([(b >> 2 & 1) ^ (b >> 7 & 1) for b in range(1 << 12)], bool)
    assert ((fitted.scores() >= 0.5) == want).mean() > 0.99
    chosen = [c for c in cells if fitted.scores()[c[0]] >= fitted.threshold]
    assert sum(c[2] for c in chosen) >= personal.PRECISION * sum(c[1] for c in chosen) and len(chosen) >= want.sum()
    assert personal.boost([]).threshold > 1 and personal.boost([(3, 5, 0)]).threshold > 1


def test_additions_leave_the_base_alone(frame):
    given = ["call +1 (555) 555-1234 now"] * 40 + ["pages 12.10.1999 - 3000 of it"] * 40 + ["call (555) 555-1234 now"] * 3
    rows = {r.doc_id: r for r in personal.digest(personal.personal_spans(frame(given))).collect()}
    assert rows[0].spans == "phone:5:22" and rows[50].spans == ""


def test_native_and_empty(frame, spark, small):
    assert personal.digest(personal.personal_spans(frame([]))).collect() == []
    plan = QUERIES["op3_personal_data"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
