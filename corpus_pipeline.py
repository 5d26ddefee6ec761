"""The training-data pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

All stages: columns other than those of documents are left out, so no name can clash; null text counts as empty; an empty
table gives an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from lectern.llm import decontaminate, mixing, resemblance, toxicity
from lectern.llm.common import new_path, table
from lectern.llm.token_output import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # compression lengths, XXH64 and alignment are beyond SQL


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; rows without an id or a label are scored like others, equal rows alike."""
    return toxicity.reject_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more over five-word shingles) one row stays, that with the least id.
    Candidates are the links of the SimHash grid of segment popcounts and, beyond its 4 bits, texts that share a band of
    min-hashes; the sets of shingles decide about both.

    Groups are of texts, not of ids: rows that share a doc_id but not their text, or have none, are judged by their texts."""
    table(spark, sf_dir, "documents")
    return resemblance.keep_one(docs.select(*COLUMNS), shingle=5, least=0.8)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with a test item at 0.8 or more go; empty texts and an empty benchmark align with nothing."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources follow the square root of their size, in global random order: the rows of each
    partition are sorted by it. Null sources are one source."""
    return mixing.mix(docs.select(*COLUMNS), temperature=0.5, seed=42).select(*COLUMNS)


def write_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in binary shards with a hash index; what keyed access reads back, a row for each copy. Shards keep the order of
    rows, a shard for each partition, so that the mixed order is the order of training."""
    table(spark, sf_dir, "documents")
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, ordered=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
