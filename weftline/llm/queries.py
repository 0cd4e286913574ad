"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_quality as lines
from weftline.llm import lexical_search, preference, run_length_index, url_filter, warc
from weftline.llm.best_fit import packed
from weftline.llm.bit_packing import read_ids, write_ids
from weftline.llm.bpe import decode, encode
from weftline.llm.chaining import shared_passages
from weftline.llm.iblt import fingerprints
from weftline.llm.prob_minhash import near_duplicates
from weftline.llm.run_length_index import remove_repeats
from weftline.llm.spill import shared_folder
from weftline.llm.token_alignment import align_tokens
from weftline.sources import read_table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether line-first cleaning keeps it."""
    judged = lines.line_quality(read_table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "quality.*").drop("cleaned")


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document; the document that gives the class its id is kept."""
    classes = near_duplicates(read_table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op5_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that every document shares with earlier ones, and what is left without them."""
    found = shared_passages(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "found.n_words",
        F.size("found.passages").cast("bigint").alias("n_passages"),
        "found.n_removed",
        F.col("found.partners").alias("partner_ids"),
        F.sha2(F.col("found.text").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of every document, packed into sequences of at most 1024 tokens."""
    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from the normalised WARC archives that it was written to."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid4().hex}"
    written = warc.write_archives(read_table(spark, sf_dir, "pages"), f"{folder}/written")
    normal = warc.normalise(written, f"{folder}/written", f"{folder}/normal")
    return warc.read_records(warc.index(normal, f"{folder}/normal"), f"{folder}/normal").drop("payload")


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of conversations with the same first turn, and of each with its last reply cut; loss spans as text."""
    conversations = read_table(spark, sf_dir, "conversations")
    pairs = preference.pairs_by_first_turn(conversations).unionByName(preference.pairs_with_cut_reply(conversations))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from"], s["to"])), " ")
    return preference.format_preferences(pairs).withColumns({c: spans(c) for c in ("chosen_loss", "rejected_loss")})


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start anywhere else, removed from every document."""
    cleaned = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["to"] - x["from"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = decode(encode(read_table(spark, sf_dir, "documents"), path), path)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from files of packed ids."""
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid4().hex}"
    files = write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for every benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with the counts of their links over all documents."""
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(read_table(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_quality": op2_line_quality,
    "op3_prob_minhash": op3_prob_minhash,
    "op4_iblt": op4_iblt,
    "op5_chaining": op5_chaining,
    "op6_best_fit": op6_best_fit,
    "op7_warc": op7_warc,
    "op8_preference": op8_preference,
    "op9_run_length_index": op9_run_length_index,
    "op10_bpe": op10_bpe,
    "op11_bit_packing": op11_bit_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.oracle(),
    "op2_line_quality": lines.SQL,
    "op7_warc": warc.SQL,
    "op8_preference": preference.SQL,
    "op9_run_length_index": run_length_index.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
