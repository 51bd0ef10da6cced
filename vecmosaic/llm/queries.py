"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmosaic.llm.alignment import AlignmentOptions, aligned_counts
from vecmosaic.llm.ann_tree import nearest_neighbours
from vecmosaic.llm.fingerprint import edited_fingerprints
from vecmosaic.llm.language_id import language_id
from vecmosaic.llm.license_scan import license_scan
from vecmosaic.llm.near_dup import near_duplicates
from vecmosaic.llm.oracles import ORACLES  # noqa: F401
from vecmosaic.llm.packing import pack
from vecmosaic.llm.piece_fst import PieceOptions, piece_digests
from vecmosaic.llm.quality_rules import quality_verdicts
from vecmosaic.llm.runs import periodic_runs
from vecmosaic.llm.secret_scan import secret_spans
from vecmosaic.llm.token_store import TokenStoreOptions, read_tokens, write_tokens
from vecmosaic.llm.warc import read_records, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(_table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op7_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), PieceOptions(model=_tokenizer("piece_bpe_32k.model")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = TokenStoreOptions(tokenizer=_tokenizer("byte_bpe_50k.json"))
    files, dictionary = write_tokens(_table(spark, sf_dir, "documents"), options)
    return read_tokens(files, dictionary, options)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), planted=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(_table(spark, sf_dir, "documents"), AlignmentOptions(_tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")))


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_warc": op2_warc,
    "op3_ann_tree": op3_ann_tree,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_piece_fst": op7_piece_fst,
    "op8_license_scan": op8_license_scan,
    "op9_token_store": op9_token_store,
    "op10_secret_scan": op10_secret_scan,
    "op11_fingerprint": op11_fingerprint,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_alignment": op13_alignment,
}
