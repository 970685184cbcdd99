"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from defectscope.llm import centroids, chunks, decontaminate, fixity, languages, manifest, minmax, packing, phrases, secrets, simhash, token_counts, url_filters
from defectscope.llm.registry import ORACLE, QUERIES, query  # noqa: F401
from defectscope.llm.tables import read
from defectscope.session import scratch_path, written

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op2_phrase_fingerprints")
def op2(spark, sf_dir):
    return phrases.fingerprint_neighbours(read(spark, sf_dir, "documents"))


@query("op3_repeated_passages")
def op3(spark, sf_dir):
    return chunks.repeated_passages(read(spark, sf_dir, "documents"))


@query("op4_mixture_packing")
def op4(spark, sf_dir):
    pieces = packing.pack(read(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_decontamination", decontaminate.SQL)
def op5(spark, sf_dir):
    leaks = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return leaks.drop("text_md5", "spans")


@query("op6_simhash_groups")
def op6(spark, sf_dir):
    return simhash.near_groups(read(spark, sf_dir, "documents")).drop("text_md5", "group")


@query("op7_merkle_audit", fixity.SQL)
def op7(spark, sf_dir):
    """The archive of the pages against a replica with damage at known places."""
    pages = read(spark, sf_dir, "pages")
    primary = written(fixity.listing(pages), "listing")
    worn = fixity.damaged(pages)
    text = fixity.record(F.col("url"), F.col("html"))
    worn = worn.select(F.col("page_id").alias("record_id"), F.octet_length(text).cast("bigint").alias("length"), F.sha2(text, 256).alias("digest"))
    # Damage leaves the offsets of the other records as they were.
    replica = written(worn.join(primary.select("record_id", "offset"), "record_id"), "listing")
    found = fixity.audit(primary, replica)
    return found.select("record_id", "offset", "status", F.col("lengths")[0].alias("length"), F.col("replica_lengths")[0].alias("replica_length"),
                        F.col("digests")[0].alias("digest"), F.col("replica_digests")[0].alias("replica_digest"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), WORD_TOKENIZER, scratch_path(spark, "token-cache"))


@query("op9_language_id")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return languages.identify(docs, languages.fit(docs))


@query("op10_url_verdicts", url_filters.oracle(URL_RULES))
def op10(spark, sf_dir):
    return url_filters.judge(read(spark, sf_dir, "pages"), URL_RULES).drop("class_blocked")


@query("op11_merkle_manifest", manifest.SQL)
def op11(spark, sf_dir):
    """Every proof of the documents' manifest, checked against rows of which some were tampered with."""
    return manifest.manifest(read(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


@query("op12_centroid_clusters", centroids.SQL)
def op12(spark, sf_dir):
    return centroids.clustered(read(spark, sf_dir, "embeddings"))


@query("op13_minmax_duplicates")
def op13(spark, sf_dir):
    return minmax.near_duplicates(read(spark, sf_dir, "documents"))
