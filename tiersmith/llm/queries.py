"""Queries over the test data, one for each operator of this package, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.llm import ann, centroids, chat_format, embedding_dedup, line_dedup, mixing, packing, ppm, simhash, span_dedup, spelling, sql, token_store, toxicity
from tiersmith.llm.common import cut, scratch, table
from tiersmith.llm.tokens import default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(token_store.encode_documents(table(spark, sf_dir, "documents"), default_tokenizer(), 0), path)
    return token_store.checked_tokens(spark, path)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), 2, 1024)


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, and the shard and place of each copy."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    mixed = cut(mixed.drop("text")).withColumn("row", F.monotonically_increasing_id())  # of a checkpoint: the same each time
    places = F.array_sort(F.collect_list(F.struct("shard", "position")))
    dealt = mixing.deal(mixed.select("row", "doc_id", "size", "shards"))
    dealt = dealt.groupBy(F.col("row").alias("dealt_row")).agg(F.sum("size").alias("words"), places.alias("places"))
    rows = mixed.join(dealt, F.col("row") == F.col("dealt_row"), "left")
    return rows.select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
        F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["shard"], p["position"])), " ").alias("places"),
    )


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that they link."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"), 3, 3)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an equal or near line precedes."""
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under models of nine tenths of them."""
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 100 bytes that start earlier."""
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the words one edit away, and the forms that they are variants of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64)


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts read like control strings, formatted, written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(more).withColumn("content", chat_format.text_content(F.col("text")))
    path = f"{scratch(spark)}/chat-{uuid.uuid4().hex}"
    chat_format.format_chat(turns).write.parquet(path)
    return chat_format.checked_chat(spark.read.parquet(path))


# The other queries use hashes, tokens, learned models or random draws that SQL lacks, or would compare all strings.
ORACLE_SQL["op2_embedding_dedup"] = """
    with recursive good as (
        select vec_id, label, cast(embedding as double[]) as e from embeddings
        where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (
        select a.vec_id as a, b.vec_id as b from good a join good b
            on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
        where list_cosine_similarity(a.e, b.e) >= 0.93),
    reach as (
        select vec_id as id, vec_id as other from embeddings
        union
        select r.id, l.b from reach r join links l on l.a = r.other),
    least as (select id, min(other) as component_id from reach group by id),
    degree as (select a, count(*) as n_links from links group by a)
    select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept
    from embeddings v join least on least.id = v.vec_id left join degree on degree.a = v.vec_id
"""
ORACLE_SQL["op11_spelling_variants"] = sql.SPELLING
ORACLE_SQL["op12_centroids"] = sql.centroids()
ORACLE_SQL["op13_chat_format"] = sql.chat_format()
