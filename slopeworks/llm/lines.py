"""Removal of lines that many sites share.

The spread of a line is the number of distinct sites it stands on. HyperLogLog sketches of the sites, one for each line hash,
merge map-side and after the shuffle, so a line on every page of the web costs one small row for each task. Where the
estimate is near the threshold, the distinct sites of just those lines are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.plans import broadcast_within, spare_names
from slopeworks.session import shared_folder

MIN_SITES = 8
MARGIN = 0.25  # estimates within this share of the threshold are counted; a sketch of 2^12 registers errs by 1.6 %
SKETCH_BITS = 12
LINES_BROADCAST = 500_000
BLANKS = " \t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site, position, line hash) of every line with a visible character; lines are compared without outer blanks."""
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")
    bare = F.btrim("line", F.lit(BLANKS))
    rows = docs.select("doc_id", "source", line).filter(F.length(bare) > 0)
    return rows.select("doc_id", F.col("source").alias("site"), "at", F.sha2(bare, 256).substr(1, 32).alias("line"))


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first_doc): hashes of the lines on at least `min_sites` distinct sites, with the smallest doc_id that has them."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    sketch = F.hll_sketch_agg("site", SKETCH_BITS)
    spread = _lines(docs).groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.min("site").alias("lo"), F.max("site").alias("hi"), F.hll_sketch_estimate(sketch).alias("sites"))
    spread.filter((F.col("lo") != F.col("hi")) & (F.col("sites") >= min_sites * (1 - MARGIN))).select("line", "first_doc", "sites").write.parquet(f"{folder}/spread")
    found = spark.read.parquet(f"{folder}/spread")
    near = found.filter(F.col("sites") <= min_sites * (1 + MARGIN))
    some, _ = broadcast_within(near.select("line"), LINES_BROADCAST)
    exact = _lines(docs).join(some, "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites)
    near = near.join(exact.select("line"), "line", "left_semi")
    found.filter(F.col("sites") > min_sites * (1 + MARGIN)).unionByName(near).select("line", "first_doc").write.parquet(f"{folder}/shared")
    return spark.read.parquet(f"{folder}/shared")


def drop_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with text freed of lines on `min_sites` sites or more (column `source`), plus `lines_removed`.

    A shared line stays in the document of the smallest doc_id that has it, so nothing is lost from the corpus as a whole.
    Lines without a visible character are never counted and stay. A null source is no site; null texts stay null; a text may
    become empty. Rows of one doc_id are treated alike, repeated rows too. Extra columns pass through; `lines_removed` is
    replaced. An empty table stays empty.
    """
    shared, _ = broadcast_within(shared_lines(docs, min_sites), LINES_BROADCAST)
    hits = _lines(docs).join(shared, "line").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone, doc, rest = spare_names(docs, "_gone", "_doc", "_rest")
    marks = hits.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(gone))
    joined = docs.drop("lines_removed").join(marks, F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(gone, F.sha2(F.btrim(x, F.lit(BLANKS)), 256).substr(1, 32)))
    texts = joined.withColumn(rest, F.when(F.col(gone).isNotNull(), kept))
    changed = F.col(rest).isNotNull()
    return texts.select(*[F.when(changed, F.array_join(rest, "\n")).otherwise(F.col(c)).alias(c) if c == "text" else c for c in docs.columns if c != "lines_removed"],
                        F.when(changed, F.size(split) - F.size(rest)).otherwise(0).cast("long").alias("lines_removed"))


_BARE = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
s AS (SELECT {_BARE} AS line, min(doc_id) AS first_doc FROM l WHERE {_BARE} <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.*, s.line IS NOT NULL AND l.doc_id <> s.first_doc AS gone FROM l LEFT JOIN s ON {_BARE.replace('line', 'l.line')} = s.line)
SELECT d.doc_id, md5(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5, count(*) FILTER (gone) AS lines_removed
FROM documents d JOIN k USING (doc_id) GROUP BY d.doc_id
"""
