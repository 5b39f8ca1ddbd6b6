"""Free-text category labels: comparison form, missing labels, canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that name no category.
NO_CATEGORY = ("", "na", "unknown", "unassigned")


def label_key(c: Column) -> Column:
    """Comparison form: trimmed, lower case, ``-``, ``_`` and blanks as one sign.

    Null for null and for labels that name no category.
    """
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-_\s]", "_")
    return F.when(~t.isin(*NO_CATEGORY), t)


def canonical_spellings(df: DataFrame, label: str) -> DataFrame:
    """(label_key, canonical): the most frequent trimmed spelling of each category.

    Counts take every row; ties go to the smaller spelling.  Two small shuffles
    of pre-aggregated counts, whatever the skew of the labels.
    """
    s = df.select(label_key(F.col(label)).alias("label_key"), F.regexp_replace(F.col(label), r"^\s+|\s+$", "").alias("canonical"))
    n = s.filter(F.col("label_key").isNotNull()).groupBy("label_key", "canonical").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label_key").orderBy(F.desc("n"), "canonical")
    return n.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("label_key", "canonical")
