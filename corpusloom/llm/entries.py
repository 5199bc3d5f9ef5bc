"""The queries that __spark_entry__.py registers for the operators of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, importance, linededup, media, merkle, mixing, quality, resampling, simhash, toolchat, urlfilter, warc
from .oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return ctw.score(_table(spark, sf_dir, "documents"), seventh != 2, scanned=True)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def byte_bpe() -> tuple[bytes, str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_table(spark, sf_dir, "documents"), *byte_bpe(), keep=["doc_id"], outputs=["n_tokens", "ids_sha256", "decoded_sha256"])


REPLY = {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 20, "maxLength": 100_000}, "turn": {"type": "integer", "minimum": 0}}}


def op4_toolchat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolchat.tool_chats(_table(spark, sf_dir, "conversations"), {"reply": REPLY})


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(media.payload_media(_table(spark, sf_dir, "documents")))
    tiles = media.store(media.features(stored, ["doc_id", "n_bytes"]), "tiles")
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.octet_length("tile").cast("long").alias("tile_bytes"), F.sha2("tile", 256).alias("tile_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.remove_boilerplate(_table(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


#: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = resampling.resampled(_table(spark, sf_dir, "clicks"), "client_id", "ts", "value", "click_id", linear=True, zone="Europe/Berlin")
    # Sums beyond a long, which no table here comes near, are null.
    return buckets.select(F.col("series").alias("client_id"), "bucket_start", "n_points", "covered_seconds", F.col("area2").try_cast("long").alias("area2"), F.col("avg_units").alias("avg_cents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.edited_copies(_table(spark, sf_dir, "documents"))
    own, edited, after = F.col("tree"), F.col("edited_tree"), F.col("next_tree")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        merkle.written(own).alias("fingerprint"),
        merkle.written(edited).alias("edited_fingerprint"),
        merkle.likeness(own, edited).alias("near_edited"),
        merkle.likeness(own, after).alias("near_next"),
        merkle.first_change(own, edited)["section"].alias("changed_section"),
        merkle.first_change(own, edited)["paragraph"].alias("changed_paragraph"),
    )


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_toolchat": op4_toolchat,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_lines": op7_lines,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_urls": op10_urls,
    "op11_tiles": op11_tiles,
    "op12_merkle": op12_merkle,
    "op13_importance": op13_importance,
}
