"""Rules for text quality: a table of thresholds compiled into one projection, without user functions.

A word is a run of characters other than the six ASCII white-space characters. Null and empty texts have no words; they fail.
Repeated rows are judged alike. The measures replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.plans import fenced

BLANK = r"[\x20\x09-\x0D]"
# Frequent function words of the languages that are kept, in lower case and with a capital.
STOP_WORDS = (
    "the be to of and that have with is was it in for on as at by this are from or an "
    "der die das und ist von mit den ein eine nicht auch zu für sie "
    "le la les un une de des et est que qui dans pas pour avec "
    "el los las una y en por con del se no lo su para"
).split()


@dataclass(frozen=True)
class Rule:
    """The measure must lie between `least` and `most`; a measure that is null fails."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("exclamations_per_word", None, 0.25),
    Rule("n_stop_words", 2, None),
    Rule("dup_line_share", None, 0.5),
    Rule("short_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("letter_word_share", 0.8, None),
    Rule("repeat_word_share", None, 0.5),
)


def _compiled(rules: tuple[Rule, ...]) -> Column:
    verdict = F.lit(True)
    for r in rules:
        if r.least is not None:
            verdict = verdict & (F.col(r.measure) >= r.least)
        if r.most is not None:
            verdict = verdict & (F.col(r.measure) <= r.most)
    return F.coalesce(verdict, F.lit(False))


def _without(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a text has."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, characters, ""))


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more, from `_windows` and, sorted, `_placed`."""
    same = lambda x, j: ((j > 0) & (F.get("__quality_placed", j - 1)["h"] == x["h"])) | F.coalesce(F.get("__quality_placed", j + 1)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("__quality_placed", same), lambda x: x["p"]))
    add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), add, lambda acc: acc["n"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds all measures of the rules and the counts they come from."""
    words = F.filter(F.split(F.col("__quality_text"), f"{BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("__quality_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.get("__quality_words", i), F.get("__quality_words", i + 1), F.get("__quality_words", i + 2))
    no_windows = F.array().cast("array<bigint>")
    split = docs.withColumn("__quality_text", F.coalesce(F.col(text), F.lit(""))).withColumns({"__quality_words": words, "__quality_lines": lines})
    counted = split.withColumns({
        "n_words": F.size("__quality_words").cast("long"),
        "word_chars": F.char_length(F.array_join("__quality_words", "")).cast("long"),
        "n_symbols": _without(F.col("__quality_text"), r"[#*$%&|<>]+").cast("long"),
        "__quality_exclamations": _without(F.col("__quality_text"), "!+"),
        "n_lines": F.size("__quality_lines").cast("long"),
        "n_dup_lines": (F.size("__quality_lines") - F.size(F.array_distinct("__quality_lines"))).cast("long"),
        "__quality_short": F.size(F.filter("__quality_lines", lambda x: F.octet_length(x) < 20)),
        "__quality_ellipsis": F.size(F.filter("__quality_lines", lambda x: x.endswith("...") | x.endswith("…"))),
        "__quality_letters": F.size(F.filter("__quality_words", lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.array_intersect("__quality_words", F.array(*[F.lit(v) for w in STOP_WORDS for v in (w, w.capitalize())]))).cast("long"),
        "__quality_windows": F.when(F.size("__quality_words") > 3, F.transform(F.sequence(F.lit(0), F.size("__quality_words") - 3), window)).otherwise(no_windows),
    })
    # Only texts with a repeated window are sorted.
    placed = counted.withColumn("__quality_placed", F.when(
        F.size(F.array_distinct("__quality_windows")) < F.size("__quality_windows"),
        F.sort_array(F.transform("__quality_windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    done = placed.withColumn("n_repeat_words", F.when(F.col("__quality_placed").isNull(), 0).otherwise(_repeat_words()).cast("long"))
    per = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return done.withColumns({
        "mean_word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "exclamations_per_word": per("__quality_exclamations", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "short_line_share": per("__quality_short", "n_lines"), "ellipsis_line_share": per("__quality_ellipsis", "n_lines"),
        "letter_word_share": fenced(per("__quality_letters", "n_words")), "repeat_word_share": per("n_repeat_words", "n_words"),
    }).drop("__quality_text", "__quality_words", "__quality_lines", "__quality_windows", "__quality_placed", "__quality_exclamations", "__quality_short", "__quality_ellipsis", "__quality_letters")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, `base_failed` (under 50 words, or more than half of them in repeated windows) and `kept`."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, text).withColumns({"base_failed": base, "kept": fenced(~base & _compiled(rules))})


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) > 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) v(k) WHERE c.n > 1 GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS bangs,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(l, lambda x: strlen(x) < 20)) AS short,
  len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS ellipsis, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letters,
  len(list_intersect(list_distinct(w), [{', '.join(f"'{v}'" for w in STOP_WORDS for v in (w, w.capitalize()))}])) AS n_stop, coalesce(r.n, 0) AS n_repeat_words
  FROM s LEFT JOIN r ON r.doc_id = s.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND n_repeat_words / n_words <= 0.5 AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
  AND bangs / n_words <= 0.25 AND n_stop >= 2 AND n_dup_lines / n_lines <= 0.5 AND short / n_lines <= 0.9 AND ellipsis / n_lines <= 0.3
  AND letters / n_words >= 0.8 AS kept
FROM m
"""
