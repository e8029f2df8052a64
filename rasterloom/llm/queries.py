"""The registered queries of the training-data operators and their SQL."""
from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jpeg, langid, outliers, packing, shards, simhash, substring, unigram, urls, wavelet



def tokenizer_file(name: str) -> str:
    """A public tokenizer file: in the folder ``RASTERLOOM_TOKENIZERS`` names, else the installed one."""
    folder = os.environ.get("RASTERLOOM_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.encode(_documents(spark, sf_dir), WORDS, end_id=2)
    return wavelet.read_documents(manifest, with_ids=False)


def op2_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.report(_documents(spark, sf_dir), PIECES)


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules(_documents(spark, sf_dir))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.inspect(common.materialize(jpeg.store(_documents(spark, sf_dir)), "media"))


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shuffle_to_shards(_documents(spark, sf_dir)))


def op7_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op8_url_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, urls.standing_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_documents(spark, sf_dir), WORDS, end_id=1), WORDS)


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_wavelet_shards, op2_sentencepiece_unigram, op3_mcd_outliers, op4_jpeg_media, op5_simhash_ball, op6_two_pass_shuffle, op7_subword_langid, op8_url_prefix_filter, op9_bounded_packing, op10_suffix_automata)}
ORACLES = {"op8_url_prefix_filter": urls.ORACLE, "op10_suffix_automata": substring.ORACLE}
