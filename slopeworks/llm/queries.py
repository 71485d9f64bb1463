"""The registered queries of this package, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4(spark, sf):
    from slopeworks.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_sharding")
def op7(spark, sf):
    from slopeworks.llm.sharding import shard_rows

    placed = shard_rows(table(spark, sf, "documents"))
    bytes_of = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return placed.select("doc_id", (F.length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_token_files")
def op10(spark, sf):
    from slopeworks.llm.token_files import token_files

    return token_files(spark, table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op2_pii")
def op2(spark, sf):
    from slopeworks.llm.pii import find_pii, pii_digest

    return pii_digest(find_pii(table(spark, sf, "documents").select("doc_id", "text")))


def _op3_sql() -> str:
    from slopeworks.llm.quality import ORACLE

    return ORACLE


@query("op3_quality_rules", _op3_sql())
def op3(spark, sf):
    from slopeworks.llm.quality import judge

    judged = judge(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_ngram_jaccard")
def op8(spark, sf):
    from slopeworks.llm.jaccard import shingle_components

    return shingle_components(table(spark, sf, "documents"))


def _op1_sql() -> str:
    from slopeworks.llm.lines import ORACLE

    return ORACLE


@query("op1_line_dedup", _op1_sql())
def op1(spark, sf):
    from slopeworks.llm.lines import drop_shared_lines

    freed = drop_shared_lines(table(spark, sf, "documents"))
    return freed.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lines_removed")


def _op5_sql() -> str:
    from slopeworks.llm.decontaminate import ORACLE

    return ORACLE


@query("op5_decontamination", _op5_sql())
def op5(spark, sf):
    from slopeworks.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_language_id")
def op9(spark, sf):
    from slopeworks.llm.language import fit_languages, held_out, predict_language

    docs = table(spark, sf, "documents")
    network = fit_languages(docs)
    return predict_language(docs.select("doc_id", "text", held_out().alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_html_text")
def op6(spark, sf):
    from slopeworks.llm.html_text import extract_text, fit_blocks

    pages = table(spark, sf, "pages")
    return extract_text(pages, fit_blocks(pages))


@query("op11_order_minhash")
def op11(spark, sf):
    from slopeworks.llm.order_minhash import order_fingerprints

    return order_fingerprints(table(spark, sf, "documents"))


def _op12_sql() -> str:
    from slopeworks.llm.trie import ORACLE

    return ORACLE


@query("op12_conversation_trie", _op12_sql())
def op12(spark, sf):
    from slopeworks.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf, "conversations"))


def _op13_sql() -> str:
    from slopeworks.llm.vector_codes import ORACLE

    return ORACLE


@query("op13_vector_codes", _op13_sql())
def op13(spark, sf):
    from slopeworks.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf, "embeddings"))
