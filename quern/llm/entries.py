"""Thin queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chosen_path, collocation, fixity, line_dedup, longest_match, mixing, packing, prefix_trie, repetition, segment_crf, suffix_tree, telephony, url_lists
from quern.llm.common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages' records against a replica in which one of 256 records is damaged and one is lost.

    Which ones is told by a digest of the record, so that the damage is the
    same wherever the query runs.
    """
    content = fixity.record(F.col("url"), F.col("html"))
    name = F.md5(content.cast("binary"))
    damaged = fixity.record(F.col("url"), F.concat(F.lit("X"), F.expr("substring(html, 2)")))
    stored = F.when(name.startswith("01"), F.lit(None)).when(name.startswith("00"), damaged).otherwise(content)
    rows = fixity.manifest(table(spark, sf_dir, "pages"), content, stored)
    place = ["volume", "offset", "length", "copies"]
    replica = rows.where("stored_digest is not null").select(*place, F.col("stored_digest").alias("digest"))
    return fixity.audit(rows.select(*place, "digest"), replica)


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op4_segment_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_crf.find_personal_data(table(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def _number(text: Column, first: int, digits: int) -> Column:
    """Some hexadecimal digits of a text's digest as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures of 2024 against a dated list on their hosts and these hosts' domains.

    Pages have no dates and there is no list among the tables, so both are
    made here: a page's day from its id, and three entries for each host and
    two for each domain from digests of their names.
    """
    pages = table(spark, sf_dir, "pages")
    first_day = F.to_date(F.lit("2024-01-01"))
    captures = pages.select("page_id", "url", F.date_add(first_day, F.expr("cast(pmod(page_id * 37, 365) as int)")).alias("fetch_date"))
    hosts = pages.select(url_lists.host(F.col("url")).alias("key")).where("key is not null").distinct()
    tops = hosts.select(F.element_at(url_lists.domains(F.col("key")), -1).alias("key")).distinct()
    keys = hosts.select("key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("place")).unionByName(
        tops.select("key", F.explode(F.sequence(F.lit(11), F.lit(12))).alias("place"))
    )
    name = F.concat_ws("#", "key", F.col("place").cast("string"))
    day = F.date_add(first_day, F.pmod(_number(name, 1, 6), F.lit(365)).cast("int"))
    action = F.get(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), F.pmod(_number(name, 7, 2), F.lit(3)).cast("int"))
    entries = keys.select("key", "place", day.alias("entry_date"), action.alias("action"))
    out = url_lists.judge_captures(captures, entries, keep=("page_id",))
    return out.select("page_id", "host", F.col("fetch_date").cast("string"), "action", "matched", F.col("since").cast("string"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_as_media(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op9_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.count_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def mix_options() -> dict:
    """Documents name no domain, so the last digits of the source tell it: d0 to d3."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    lang = F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    domain = F.when(F.col("domain") == "d0", 4).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1)
    return {
        "domain": F.concat(F.lit("d"), (number % 4).cast("string")),
        "weights": {"domain": domain, "lang": lang, "source": F.lit(1)},
        "share": (4, 5),
        "epochs": 2,
        "seed": 23,
    }


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), **mix_options())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_fixity": op2_fixity,
    "op3_chosen_path": op3_chosen_path,
    "op4_segment_crf": op4_segment_crf,
    "op5_repetition": op5_repetition,
    "op6_url_lists": op6_url_lists,
    "op7_telephony": op7_telephony,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_longest_match": op9_longest_match,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocation": op12_collocation,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}
