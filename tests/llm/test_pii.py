import hashlib
import re

import pytest

from slopeworks.llm.pii import find_pii, pii_digest, redact

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


TEXTS = [
    None, "", "plain words only", "a@b.c_d@e.f x@y z@q.r. a@b..c u.v%w+x@sub-1.mail.example.com,", "é💡 mail@ex.org 💡+1 (974) 555-3436 tel",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9.", "4111 1111 1111 1111 and 4111-1111-1111-1111, 41111111--11111111 4111 1111 1111 1112",
    "12 34  56 4417744280351547 +49 30 123456 7890 +1-(2)+12345678901", "+1234567890123456 +12 3456789 0. +1.", "5 " * 30, "9" * 20000, "a" * 50000, "a@" * 5000, "1." * 20000, "x@" + "a." * 20000,
    "a@b.c@d.e@f.g", "@@a@b.c-.d", "0000000000000000 00000000000000", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "DE89 3704 0044 0532 0130 00 is the iban", "my ssn is 123-45-6789 and not 123-45-67805",
]


def test_spans_match_the_patterns(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, pii string")
    got = pii_digest(find_pii(rows)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = brute(TEXTS[r["doc_id"]])
        named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest(), (r, named[:200])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "iban:0:27" in spans[19] and "ssn:10:21" in spans[20] and spans[20].count("ssn") == 1


def test_redaction_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "write to ab@cd.org now"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in redact(find_pii(rows)).orderBy("doc_id").collect()] == ["write to <email> now", None]
    assert find_pii(rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    import random

    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("019+-. @a()é") for _ in range(rnd.randrange(120))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii_digest(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, t in enumerate(texts):
        named = ",".join(f"{KINDS[j]}:{s}:{e}" for s, j, e in brute(t))
        assert got[k]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest(), (t, named, got[k])
