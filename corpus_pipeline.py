"""From raw documents to token files: five stages, each on all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last
return documents with the columns of ``documents``; the last returns what its token
files hold of each document; the files stay in ``output_folder``. Stages are written
and read again in between.

Every stage handles null texts (no words: rejected or kept by the classifier's score,
one class to near-dedup, clean, of size 0 and so in no copy of the mix), null, tied and
repeated ids (each row is judged by itself; near-dedup keeps one row of a class; the
mix makes copies of rows), texts of any length, whole, columns beside those named, and
an empty table, which gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, near_copies, quality_pu, token_output
from plumbline.llm.common import Scratch, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WEIGHTS = [3, 1, 2]
#: The session setting that names the folder of the token files, which stay there.
OUTPUT = "plumbline.corpus.output"


def output_folder(spark: SparkSession) -> str:
    """The folder of the token files: the session's, or one in the folder that driver and executors share."""
    return spark.conf.get(OUTPUT, None) or f"{shared_dir(spark)}/corpus"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality_pu.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of Jaccard similarity 0.8 or more, or SimHash fingerprints that link as in op1."""
    return near_copies.keep_one(docs, shingle=3, max_dist=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their copies in the mix: none, one or two rows each."""
    return mixing.repeated(mixing.mix(docs, mixing.word_count(F.col("text")), weights=WEIGHTS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in order of id, and what they hold."""
    import public_tokenizers

    return token_output.round_trip(docs, public_tokenizers.path(TOKENIZER), END_ID, out_uri=output_folder(spark))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The classifier is trained by iterations that SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{k}")
    return docs
