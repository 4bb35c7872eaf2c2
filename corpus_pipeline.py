"""Documents to packed training sequences in stages, each the next one's input.

Every stage works on all that the one before it kept; what a stage rejects is gone.  A stage's
result is written to the shared folder and read again, so a lost executor costs one stage's tasks.

All stages take rows as they come.  A null text is an empty one; null and empty texts have no words,
so the rules reject them.  Long texts are read whole.  Of equal or repeated rows, and of rows with
the same smallest id, one stays; a null id comes after all others.  Other columns may have any name,
nulls and type, and are returned as they are until packing.  An empty table gives an empty result.
"""

from __future__ import annotations

from starling.llm import exact_dedup, order_minhash, packing, quality_mil, quality_rules
from starling.llm.common import staged

ORACLE_SQL = None  # a trained classifier, sketches and packing have no SQL form


def good_form(spark, docs, sf_dir):
    """Documents that pass the quality rules; rows without words fail, repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def good_quality(spark, docs, sf_dir):
    """Documents that the classifier accepts; it learns from the labelled ones among its input.

    Where their labels hold one class or none, or are null, nothing is learned and every row stays.
    """
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_copies(spark, docs, sf_dir):
    """One document of each group of equal texts: the smallest id, of repeated rows one, a null id last."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark, docs, sf_dir):
    """One document of each class of near duplicates: the smallest id, of repeated rows one, a null id last."""
    return order_minhash.drop_near(docs)


def sequences(spark, docs, sf_dir):
    """The pieces of the documents in sequences of a fixed length; an empty text is its end id alone."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality rules", good_form), ("quality classifier", good_quality), ("exact dedup", no_copies),
          ("near dedup", no_near_copies), ("packing", sequences)]


def run(spark, sf_dir):
    """All stages over ``documents``; what every stage writes stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "-".join(name.split()))
    return STAGES[-1][1](spark, docs, sf_dir)
