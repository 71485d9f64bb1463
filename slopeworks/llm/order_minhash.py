"""Order MinHash: fingerprints of texts that fall with their edit distance.

A text is cut into words, long words into pieces; its k-mers are runs of three pieces, numbered by how often each occurred
before. A hash places the numbered k-mers on a circle. From each of 64 fixed points the first two k-mers on the circle are
taken, put back in the order they have in the text, and hashed as a pair; the 64 hashes are the fingerprint. Texts with few
k-mers are handled like others: a point walks on as far as it must. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.plans import fenced, spare_names
from slopeworks.session import shared_folder

PIECE = 8  # code points of a word that are one piece
K = 3
POINTS = 64
_PLACE_BITS = 27  # of a sorted number that tell the place in the text
BUCKET_BYTES = 32 * 2**20
MOST_BUCKETS = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halvings(n: Column) -> Column:
    """..., 8, 4, 2, 1: the steps of a binary search among n."""
    return F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))


def _kmers(pieces: Column) -> Column:
    """Hashes of the k-mers in text order; fewer than three pieces are one k-mer."""
    n = F.size(pieces)
    at = F.sequence(F.lit(0), F.greatest(n - K, F.lit(0)))
    return F.when(n > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(pieces, i + j) for j in range(K)]))).otherwise(F.array().cast("array<bigint>"))


def _placed(number: Column, place: Column) -> Column:
    """The high bits of a hash with a place in the text below them."""
    return number.bitwiseAND(F.lit(-1 << _PLACE_BITS)).bitwiseOR(place.cast("bigint"))


def _numbered(kmers: Column) -> Column:
    """Sorted hashes of (k-mer, how often it occurred before), with their places."""
    def occurrence(ordered: Column, x: Column, i: Column) -> Column:
        same = lambda j: F.shiftright(F.get(ordered, j), _PLACE_BITS) == F.shiftright(x, _PLACE_BITS)
        # Equal k-mers stand side by side in text order; the first of them is found by halving.
        first = F.aggregate(_halvings(i), i, lambda lo, s: F.when((lo >= s) & same(F.greatest(lo - s, F.lit(0))), lo - s).otherwise(lo))
        return F.when((i > 0) & same(F.greatest(i - 1, F.lit(0))), i - first).otherwise(F.lit(0))

    def numbers(ordered: Column) -> Column:
        return F.transform(ordered, lambda x, i: _placed(F.xxhash64(F.shiftright(x, _PLACE_BITS), occurrence(ordered, x, i)), x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))))

    return _let(F.sort_array(F.transform(kmers, _placed)), lambda ordered: F.sort_array(numbers(ordered)))


def _pairs(kmers: Column, circle: Column) -> Column:
    """The hash of the first two k-mers after each point of the circle, in text order."""
    n = F.size(circle)

    def pair(point: Column) -> Column:
        start = F.shiftleft((point - POINTS // 2).cast("bigint"), 65 - POINTS.bit_length())
        first = F.aggregate(_halvings(n), F.lit(0), lambda lo, s: F.when(F.get(circle, lo + s - 1) < start, lo + s).otherwise(lo))
        place = lambda k: F.get(circle, (first + k) % n).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
        return _let(F.array(place(0), place(1)), lambda p: F.xxhash64(F.get(kmers, F.array_min(p)), F.get(kmers, F.array_max(p))))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), pair)).otherwise(F.array_repeat(F.lit(0).cast("bigint"), POINTS))


def fingerprint(text: Column) -> Column:
    """The 64 pair hashes of a text, as longs. A text without words has zeros. Null is an empty text."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    return _let(pieces, lambda p: _let(_kmers(p), lambda kmers: _let(_numbered(kmers), lambda circle: _pairs(kmers, circle))))


def as_text(pairs: Column) -> Column:
    """A fingerprint as hex digits, eight for each pair."""
    return F.lower(F.array_join(F.transform(pairs, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(2**32 - 1))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of pairs that two fingerprints have in common, from 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(POINTS))


def _searched(firsts: list[tuple[int, int, int]], key: list[Column]) -> tuple[Column, Column]:
    """The bucket of a key, that is the last whose first key is not above it; and whether it is that first key."""
    columns = [F.split(F.lit(",".join(str(f[k]) for f in firsts)), ",").cast("array<bigint>") for k in range(3)]
    first = lambda i: F.struct(*[F.get(c, i).alias(f"k{k}") for k, c in enumerate(columns)])
    mine = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(key)])
    steps = F.array(*[F.lit(2**e) for e in range(len(firsts).bit_length(), -1, -1)])
    bucket = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s < len(firsts)) & (first(F.least(lo + s, F.lit(len(firsts) - 1))) <= mine), lo + s).otherwise(lo))
    return bucket, first(bucket) == mine


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next document by descending doc_id, after the last in the first.

    Equal doc_ids are ordered by a hash of the text, null ones come last. Documents are dealt into ranges of that order, and the
    first of a range is also given to the range before, so a range is complete in itself. Rows equal in doc_id and text are
    one row meanwhile: each is followed by its like.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    names = spare_names(docs, "_null", "_down", "_hash", "_bytes", "_copies", "_range", "_last")
    null, down, hashed, size, copies, bucket, last = names
    keys = [null, down, hashed]
    keyed = docs.withColumns({null: F.col("doc_id").isNull().cast("long"), down: F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long"), hashed: F.xxhash64("text")})
    keyed.select(*keys, F.octet_length("text").alias(size)).write.parquet(folder)
    thin = spark.read.parquet(folder)
    total = thin.agg(F.sum(size)).first()[0] or 0
    repeated = not thin.groupBy(*keys).count().filter("count > 1").isEmpty()
    ranges = min(MOST_BUCKETS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    found = thin.repartitionByRange(ranges, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("k"))
    firsts = sorted(tuple(r["k"]) for r in found.collect())  # one for each range
    if repeated:
        keyed = keyed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in docs.columns], F.count(F.lit(1)).alias(copies))
    place, is_first = _searched(firsts or [(0, 0, 0)], [F.col(c) for c in keys])
    there = keyed.withColumn(bucket, place).withColumn(last, is_first)
    n = max(len(firsts), 1)
    own = F.struct(F.col(bucket).alias("b"), F.lit(False).alias("l"))
    before = F.struct(F.pmod(F.col(bucket) - 1, F.lit(n)).alias("b"), F.lit(True).alias("l"))
    dealt = there.withColumn(bucket, F.explode(F.when(F.col(last), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.withColumns({last: F.col(bucket)["l"], bucket: F.col(bucket)["b"]})
    order = Window.partitionBy(bucket).orderBy(last, *keys)
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter(~F.col(last))
    if repeated:
        # Of n equal rows all but one have their like next.
        out = out.withColumn(copies, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col(copies)), lambda k: k == 1)))
        out = out.withColumns({f"next_{c}": F.when(F.col(copies), F.col(f"next_{c}")).otherwise(F.col(c)) for c in carried})
    return out.select(*docs.columns, *[f"next_{c}" for c in carried])


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document's. A null
    text is empty; the fingerprint sees words only, so texts that differ in white space have the same. Repeated rows stay
    rows; a single document is its own next. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    followed = with_next(texts.withColumn("pairs", fenced(fingerprint(F.col("text")))), ["text", "pairs"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = followed.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_pairs", fenced(fingerprint(F.col("edited"))))
    return edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("pairs")).alias("fingerprint"),
        as_text(F.col("edited_pairs")).alias("edited_fingerprint"), likeness(F.col("pairs"), F.col("edited_pairs")).alias("near_edited"),
        likeness(F.col("pairs"), F.col("next_pairs")).alias("near_next"))
