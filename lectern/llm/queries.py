"""One query for each operator, over whole tables, with production parameters; and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, embeddings, line_dedup, mixing, pii, secrets, toxicity
from .common import table
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_output import token_output


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark, sf_dir):
    """Counts, digest and spans of secrets, document by document."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    """Counts, digest and spans of personal data, document by document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Documents and test items that align at 0.8 or more."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_output(spark, sf_dir):
    """Ids of the byte-level tokenizer with end id 0, read back from the shards by the hash index."""
    return token_output(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end=0)


def op5_embeddings(spark, sf_dir):
    """Links at a cosine of 0.9 and their components."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark, sf_dir):
    """Documents without the lines that 8 or more sources use."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_sites=8)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_mixing(spark, sf_dir):
    """Documents repeated so that sources follow the square root of their size."""
    out = mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, seed=42)
    return out.select("doc_id", "source", "lang", "text", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


def op8_token_counts(spark, sf_dir):
    """Counts of the word tokenizer, against a limit of 2048."""
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op9_simhash(spark, sf_dir):
    """Fingerprints of 4-word shingles, linked at 4 or fewer bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, k=4)


def op10_toxicity(spark, sf_dir):
    """Scores from dictionaries trained on the rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pii, op3_decontamination, op4_token_output, op5_embeddings, op6_line_dedup, op7_mixing, op8_token_counts, op9_simhash, op10_toxicity)
}

#: Only what SQL can say; the others are tested against brute force.
ORACLE_SQL = {
    "op5_embeddings": embeddings.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
}
