"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.llm.collocations import collocations
from teleproof.llm.common import table
from teleproof.llm.crosspolytope import near_vectors
from teleproof.llm.html_text import extract, learn
from teleproof.llm.language import fit_open, held_out, identify
from teleproof.llm.lexical import ranked_search
from teleproof.llm.lines import dedup_lines
from teleproof.llm.neighbours import nearest
from teleproof.llm.packing import pack_texts
from teleproof.llm.pieces import decode_pieces, encode_pieces
from teleproof.llm.repeats import remove_repeats
from teleproof.llm.sharding import shard_rows
from teleproof.llm.simhash import near_duplicates
from teleproof.llm.token_files import token_files
from teleproof.llm.twins import COLLOCATIONS, LINES, SEARCH

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: number and crc32 of its ids, sha256 of what they spell."""
    both = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), PIECE_BPE), PIECE_BPE)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=0.8)
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_open(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, most=10)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=10)


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance by rows: counts of shards are at most one apart."""
    found = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, most=2_000)


QUERIES = {"op1_pieces": op1_pieces, "op2_packing": op2_packing, "op3_vectors": op3_vectors, "op4_lines": op4_lines, "op5_token_files": op5_token_files, "op6_simhash": op6_simhash, "op7_language": op7_language, "op8_html": op8_html, "op9_neighbours": op9_neighbours, "op10_repeats": op10_repeats, "op11_search": op11_search, "op12_shards": op12_shards, "op13_phrases": op13_phrases}
TWINS: dict[str, str] = {"op4_lines": LINES, "op11_search": SEARCH, "op13_phrases": COLLOCATIONS}
