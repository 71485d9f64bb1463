"""Benchmark passages in documents, found by spaced seeds.

Fixed masks keep some of neighbouring words and ignore the others. The hash of the kept words joins documents and test items;
around each hit the words are then compared one by one. Words are lower-cased and freed of all but letters and digits. Only
DataFrame functions are used: documents test the bits of small tables of item hashes first, of word pairs and then of masks,
and only positions that pass leave their row.

An item of five words or more is found in a document when some window of 16 words (or of the item, if it is shorter) has at
least 75 % of its words in place. The masks miss no such window: whichever words of it are replaced, one mask has all that it
keeps in place. Which masks an item gets follows from its own length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.plans import broadcast_within, fenced, spare_names
from slopeworks.session import shared_folder

WINDOW = 16
PERCENT = 75
# By the least length of the item; all masks begin with a pair of kept words. Fewer words leave room for fewer replaced ones.
SEEDS = {5: ("111", "1101"), 6: ("11101", "1111", "11000011", "11011"), 14: ("111011", "1100001011", "111000010001")}
PAIR = "11"
BEFORE, AFTER = 13, 15  # the words around a position that windows with its hit can hold
MOST_BITS = 2**22
INDEX_BROADCAST = 200_000


def _hashes(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.transform(F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _key(words: str, at: Column, mask: str) -> Column:
    """The hash of the kept words of the window at a position; null where the text ends before the window does."""
    kept = [F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


def _around(words: str, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(-BEFORE), F.lit(AFTER)), lambda k: F.get(words, at + k))


def _index(items: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(key, item_id, length, around) of every window of every item, stored; the keys of its word pairs; and the masks in use."""
    spark = items.sparkSession
    folder = shared_folder(spark)
    words = items.select("item_id", _hashes(F.col("text")).alias("words"))
    words = words.withColumn("length", fenced(F.size("words"))).filter("length >= 5")
    words.write.parquet(f"{folder}/items")
    stored = spark.read.parquet(f"{folder}/items")
    least = F.lit(min(SEEDS))
    for n in sorted(SEEDS):
        least = F.when(F.col("length") >= n, F.lit(n)).otherwise(least)
    stored = stored.withColumn("least", least)
    # Masks that no item has are left out: no key of theirs could be met.
    masks = [m for r in stored.select("least").distinct().orderBy("least").collect() for m in SEEDS[r["least"]]] or list(SEEDS[max(SEEDS)])
    placed = stored.select("item_id", "length", "least", "words", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("at"))
    own = [F.when(F.col("least") == n, _key("words", F.col("at"), m)) for n, seeds in SEEDS.items() for m in seeds if m in masks]
    keyed = placed.select("item_id", "length", _around("words", F.col("at")).alias("around"), F.explode(F.array(*own)).alias("key"))
    keyed.filter(F.col("key").isNotNull()).distinct().write.parquet(f"{folder}/index")
    pairs = placed.select(_key("words", F.col("at"), PAIR).alias("key")).filter(F.col("key").isNotNull()).distinct()
    return spark.read.parquet(f"{folder}/index"), pairs, masks


def _bits(index: DataFrame) -> tuple[Column, int]:
    """A table of bits by key as a constant array, of a size that follows the index up to a bound; it lets all keys pass."""
    keys = index.select("key").distinct().count()
    size = 2**12
    while size < min(64 * keys, MOST_BITS):
        size *= 2
    place = F.pmod(F.col("key"), F.lit(size))
    words = index.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {size}) & 63 as int))")).alias("bits"))
    table = [0] * (size // 64)
    for r in words.collect():  # at most MOST_BITS / 64 rows
        table[r["w"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), size


def _met(table: Column, size: int, key: Column) -> Column:
    place = F.pmod(key, F.lit(size))
    return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, of): each document with each item found in it, and the words in place in the best window.

    Null and empty texts hold nothing; items of fewer than five words are no evidence and are left out
    (`left_out` lists them), and items without an
    id count under a null id. Repeated rows and repeated items give one row. Extra columns are ignored. An empty table on
    either side gives an empty result.
    """
    index, item_pairs, masks = _index(items)
    table, pair_table = _bits(index), _bits(item_pairs)
    shortest = min(map(len, masks))
    words = docs.select("doc_id", fenced(_hashes(F.col("text"))).alias("words"))

    def known(at: Column) -> Column:
        hit = None
        for m in masks:
            bit = F.coalesce(_met(*table, _key("words", at, m)), F.lit(False))
            hit = bit if hit is None else hit | bit
        # The pair first: few positions have one of an item's.
        return F.coalesce(_met(*pair_table, _key("words", at, PAIR)), F.lit(False)) & hit

    positions = F.when(F.size("words") >= shortest, F.filter(F.sequence(F.lit(0), F.size("words") - shortest), known))
    hit = lambda at: F.struct(_around("words", at).alias("around"), F.array(*[_key("words", at, m) for m in masks]).alias("keys"))
    hits = words.select("doc_id", F.explode(F.transform(positions, hit)).alias("hit")).select("doc_id", F.col("hit.around").alias("here"), F.explode("hit.keys").alias("key"))
    ready, _ = broadcast_within(index, INDEX_BROADCAST)
    pairs = hits.filter(F.col("key").isNotNull()).join(ready, "key")
    same = F.zip_with("here", "around", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(BEFORE + 1)), lambda s: F.aggregate(F.slice(same, s, F.lit(WINDOW)), F.lit(0), lambda n, x: n + x)))
    scored = pairs.select("doc_id", "item_id", F.least(F.col("length"), F.lit(WINDOW)).alias("of"), best.alias("matched"))
    found = scored.groupBy("doc_id", "item_id").agg(F.max(F.when(100 * F.col("matched") >= PERCENT * F.col("of"), F.struct("matched", "of"))).alias("m")).filter("m IS NOT NULL")
    return found.select("doc_id", "item_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.of").cast("long").alias("of"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item; rows of a null doc_id go together."""
    doc, = spare_names(docs, "_doc")
    found = find_leaks(docs, items).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")


def left_out(items: DataFrame) -> DataFrame:
    """(item_id, n_words) of the items that `find_leaks` leaves out, since so few words are no evidence."""
    return items.select("item_id", F.size(_hashes(F.col("text"))).alias("n_words")).filter(f"n_words < {min(SEEDS)}")


def _sql() -> str:
    """The rule itself: every way to lay an item over a document is looked at that can hold enough words in place. With m of n
    words in place, at least 2 m - n - 1 neighbours among them are."""
    words = "list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH dw AS MATERIALIZED (SELECT DISTINCT doc_id, {words} AS dw FROM documents), bw AS MATERIALIZED (SELECT DISTINCT item_id, {words} AS bw FROM benchmark),
item AS MATERIALIZED (SELECT item_id, bw, least(len(bw), {WINDOW}) AS n, ceil({PERCENT} * least(len(bw), {WINDOW}) / 100.0)::BIGINT AS m FROM bw WHERE len(bw) >= {min(SEEDS)}),
dp AS (SELECT doc_id, dw, unnest(range(1, len(dw))) AS i FROM dw), bp AS (SELECT item_id, bw, n, m, unnest(range(1, len(bw))) AS i FROM item),
laid AS (SELECT doc_id, item_id, dw, bw, n, m, dp.i - bp.i AS shift FROM dp JOIN bp ON dw[dp.i] = bw[bp.i] AND dw[dp.i + 1] = bw[bp.i + 1] GROUP BY ALL HAVING count(*) >= 2 * m - n - 1),
win AS (SELECT doc_id, item_id, n, m, unnest(list_transform(range(0, len(bw) - n + 1), lambda s: len(list_filter(range(s + 1, s + n + 1), lambda k: k + shift >= 1 AND k + shift <= len(dw) AND dw[k + shift] = bw[k])))) AS matched FROM laid)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(n)::BIGINT AS "of" FROM win WHERE matched >= m GROUP BY doc_id, item_id
"""


ORACLE = _sql()
