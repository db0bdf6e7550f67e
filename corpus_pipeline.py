"""From raw documents to mixing rates, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from credsieve.llm import compression, decontaminate, linededup, mixing, simhash
from credsieve.llm.common import read, written


def quality_classifier(spark, docs, sf_dir):
    """Documents that the compression classifier accepts."""
    return compression.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Documents without lines that copy earlier ones; those left without a line go."""
    return linededup.without_copied_lines(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates, with the smallest doc_id."""
    return simhash.keep_one_of_each_group(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents without a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark, docs, sf_dir):
    """Domain posteriors and the rate at which each document enters the mix."""
    labels = mixing.quality_domains(read(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, "domain", mixing.TARGETS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_targets", mixing_to_targets),
]

#: No stage but the filters' bookkeeping could be put in SQL. tests/llm/test_pipeline.py
#: compares every stage with a plain version on what its predecessor kept.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
