"""The corpus pipeline: quality, near duplicates, personal data, source mix, byte-level BPE.

``run`` writes each stage as Parquet into the shared folder of ``spark.checkpoint.dir`` and
reads it again for the next, so a lost executor costs no more than the stage at hand. A
stage's folder goes as soon as the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import stages
from sluice.llm.common import remove, shared_folder, table

STAGES = [
    ("quality", stages.keep_good),
    ("near_duplicates", stages.keep_one_of_each),
    ("personal_data", stages.redact_personal_data),
    ("mixing", stages.mix_sources),
    ("byte_bpe", stages.encode),
]

#: The classifier, the hashes of the mix and the tokenizer are beyond SQL; tests hold each
#: stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; the folder that they are read from stays."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            if before:
                remove(spark, before)
            before = f"{folder}/{k}"
            docs = spark.read.parquet(before)
    return docs
