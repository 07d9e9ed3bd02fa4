"""A corpus pipeline of operators: each stage takes documents and returns what the next one gets.

In every stage null and empty texts are documents without words, texts may have any
length, repeated rows are documents each (equal ones share their fate), an empty
table gives an empty one, and further columns pass through unread, whatever their
names. A null id is an id like any other, except where a stage says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tiersmith.llm import line_dedup, mixing, packing, simhash, toxicity
from tiersmith.llm.common import lean_workers, plain_names, prepare, scratch, table
from tiersmith.llm.tokens import default_tokenizer

#: Bytes of a row group of the tables between the stages. A task holds a row group when it writes one and when it reads one.
ROW_GROUP_BYTES = 16 << 20


def ready(spark: SparkSession) -> None:
    """All stages run in the same executors and workers, one after the other, so each leaves room for the next.

    The settings stay with the session, since a stage's table is written after the stage has returned it.
    """
    prepare(spark)
    lean_workers(spark)
    spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go: those with a score of 0.5 or more. Without labels of both kinds none goes."""
    ready(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal or near line precedes go; every document stays. Documents come in the order of their ids, null
    first, and then of a hash; a text of which nothing is left is empty, a null text stays null."""
    ready(spark)
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays, with its repeated rows; rows of a null id stay only where
    their group has no other. Documents without words are copies of each other."""
    ready(spark)
    return simhash.keep_first(docs, 3, 3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a document stays once for each time that the mix takes it, not at all or up to
    twice. The rows of a shard stand together, in the shuffled order of the shard. A null source is one of its own."""
    ready(spark)
    rows, new = plain_names(docs)
    mixed = mixing.mix(rows, source=new["source"], text=new["text"], row_id=new["doc_id"])
    return mixing.shuffled(mixed, row_id=new["doc_id"]).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 1024 ids; a document without words is its end id."""
    ready(spark)
    return packing.pack_documents(docs, default_tokenizer(), 2, 1024, keep_words=KEEP_WORDS, take_chars=TAKE_CHARS)


#: The workers that pack have run the stages before, so they keep fewer words and encode fewer characters at once.
KEEP_WORDS, TAKE_CHARS = 300_000, 2 << 20

STAGES = [
    ("drop_toxic", drop_toxic),
    ("drop_lines", drop_lines),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the learned stages, fingerprints by words, random mixing or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written to a new folder of this run and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
