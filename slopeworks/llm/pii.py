"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Only DataFrame functions are used, and every pattern is linear in the length of a text: runs start
at their first character and repeat possessively, which also keeps Java's engine from recursing. Offsets count code points, ends are exclusive.

| kind | proposed by | confirmed by |
|---|---|---|
| email, ip, phone | pattern | parts up to 255; 10 to 15 digits |
| card | runs of digits with single blanks or hyphens | 14 to 19 digits and the Luhn sum |
| iban | country, check digits, groups of four | remainder 1 modulo 97 |
| ssn | 3-2-4 digits | a context word nearby |

A span without a checksum scores 0.5, with one 0.8; a context word in the 40 characters before adds 0.2. `ssn` spans start
at 0.3 and need 0.5 to stay. The first four kinds are always kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.plans import fenced

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")  # their order among spans of one start
CONTEXT_CHARS = 40
LEAST_SCORE = 0.5

# A match begins where a run of its characters does, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer digits are no cards
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CONTEXT = {
    "email": "mail|contact|kontakt|contacto|courriel|write to", "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|handy",
    "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social|security",
}
SPANS = "array<struct<start:int,kind:int,end:int,score:double,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    turned = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        value = F.substr(turned, k, F.lit(1)).cast("int")
        twice = value * 2
        return total + F.when(k % 2 == 1, value).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(value: Column) -> Column:
    """The remainder of an account number by 97, with its first four characters last and letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substr(turned, k, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _matches(kind: str, text: Column, pattern: str) -> Column:
    """The matches as spans: what lies between them gives their places."""
    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = start + F.coalesce(F.char_length(part["value"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.lit(0.0).alias("score"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(part["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), add, lambda acc: acc["found"])


def pii_spans(text: Column) -> Column:
    """All spans of a text (none of a null one), by start and kind."""
    none = F.array().cast(SPANS)
    digit = text.rlike("[0-9]")

    def scored(spans: Column, kind: str, base: float) -> Column:
        near = lambda s: F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))))
        return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], (F.lit(base) + F.when(near(s).rlike(rf"\b(?:{CONTEXT[kind]})\b"), 0.2).otherwise(0.0)).alias("score"), s["value"]))

    email = F.when(text.contains("@"), _matches("email", text, EMAIL))
    ip = F.filter(F.when(text.rlike(r"[0-9]\.[0-9]"), _matches("ip", text, IP)), lambda s: s["value"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
    card = F.filter(F.when(digit, _matches("card", text, CARD)), lambda s: F.length(_digits(s["value"])).between(14, 19) & luhn(_digits(s["value"])))
    phone = F.filter(F.when(text.contains("+"), _matches("phone", text, PHONE)), lambda s: F.length(_digits(s["value"])).between(10, 15))
    iban = F.filter(F.when(digit, _matches("iban", text, IBAN)), lambda s: mod_97(s["value"]) == 1)
    ssn = F.when(digit, _matches("ssn", text, SSN))
    found = [scored(email, "email", 0.5), scored(ip, "ip", 0.5), scored(card, "card", 0.8), scored(phone, "phone", 0.5), scored(iban, "iban", 0.8),
             F.filter(scored(ssn, "ssn", 0.3), lambda s: s["score"] >= LEAST_SCORE)]
    return F.array_sort(F.concat(*[F.coalesce(f, none) for f in found]))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `pii`: array of (start, kind, end, score, value), replacing a column of that name. Null and empty texts have none."""
    return docs.withColumn("pii", fenced(pii_spans(F.coalesce(F.col(text), F.lit("")))))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span of `pii` in the text by its kind in angle brackets; of overlapping spans the first counts."""
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["kind"] + 1))
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("pii", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(F.col(text)))


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("pii", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"))
