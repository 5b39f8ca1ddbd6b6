"""Queries of the training-data operators over the test tables; each reads its tables whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellorium.llm import clusters, language, leaks, neighbours, packing, quantiles, quota, topn, vectors
from cellorium.operators.labels import canonical_spellings, label_key
from cellorium.operators.relational import finite, latest_per_key
from cellorium.session import cut_lineage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten genes with the highest current auc of every cluster."""
    scores = topn.current_marker_scores(_t(spark, d, "gene_de_list"))
    return topn.top_n_per_group(scores, ["cluster_id"], "auc", ["gene_id"], 10).select("cluster_id", "gene_id")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with rank and value."""
    scores = topn.current_marker_scores(_t(spark, d, "gene_de_list"))
    return topn.top_n_per_group(scores, ["cluster_id"], "auc", ["gene_id"], 10).select("cluster_id", "gene_id", "auc", F.col("rank").cast("long").alias("rank"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cells among each other's ten most similar, correlation at least 0.96."""
    v = vectors.usable_vectors(_t(spark, d, "cell_exprs"))
    return neighbours.mutual_neighbours(v, "cell_id", "exprs", 10, 0.96).select("cell_a", "cell_b")


#: field, value column, day column, range, whether the upper end is inside, limits of the median and of the 90th percentile.
_P3 = {"exprs": ("expr", "exprs", "run_day", 0.0, 100.0, False, 0.8, 4.5), "median_f_rank": ("gene_de_list", "median_f_rank", "de_day", 0.0, 1.0, True, 0.15, 0.42)}


def _p3_values(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field, (table, col, day, lo, hi, closed, _, _) in _P3.items():
        x = F.col(col)
        ok = finite(x) & (x >= lo) & ((x <= hi) if closed else (x < hi))
        part = _t(spark, d, table).filter(ok).select(
            F.concat_ws("\u0002", F.lit(field), "dataset_id").alias("k"), F.date_format(day, "yyyy-MM-dd").alias("day"), x.cast("double").alias("x"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _p3_sketched(values: DataFrame) -> DataFrame:
    """Days with their own percentiles and those of the whole data set beside them."""
    s = quantiles.percentile_sketches(values, "k", "day", "x", F.col("lo"), F.col("hi"), (0.5, 0.9), log_scale=True)
    w = Window.partitionBy("k")
    for c in ("n", "q0", "q0_lo", "q0_hi", "q0_from", "q0_to"):
        s = s.withColumn(f"w_{c}", F.max(F.when(F.col("day").isNull(), F.col(c))).over(w))
    return s.filter(F.col("day").isNotNull()).withColumn("field_name", F.split("k", "\u0002")[0])


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 90th percentile of every data set and day with their bounds, from merged sketches."""
    s = _p3_sketched(_p3_values(spark, d))
    return s.select("field_name", F.split("k", "\u0002")[1].alias("dataset_id"), F.col("day").alias("run_day"), "n", F.col("q0").alias("median"), F.col("q0_lo").alias("median_lo"), F.col("q0_hi").alias("median_hi"), F.col("q1").alias("p90"), F.col("q1_lo").alias("p90_lo"), F.col("q1_hi").alias("p90_hi"), F.col("w_q0").alias("whole_median"))


def _p3_limit(i: int) -> Column:
    return F.when(F.col("field_name") == "exprs", F.lit(_P3["exprs"][i])).otherwise(F.lit(_P3["median_f_rank"][i]))


def _p3_judged(s: DataFrame) -> DataFrame:
    """``hit``: whether the day differs from its data set; null where the sketches' bounds leave it open."""
    median, tail = _p3_limit(6), _p3_limit(7)
    low, high = F.col("q0_lo") - F.col("w_q0_hi"), F.col("q0_hi") - F.col("w_q0_lo")
    sure = (low > median) | (high < -median) | (F.col("q1_lo") - F.col("w_q0_hi") > tail)
    never = (high <= median) & (low >= -median) & (F.col("q1_hi") - F.col("w_q0_lo") <= tail)
    return s.withColumn("hit", F.when(sure, True).when(never, False))


def _p3_wanted(s: DataFrame) -> DataFrame:
    """The percentiles that decide days: their own, and the medians of their data sets."""
    own = lambda i, q: s.select("k", "day", F.lit(i).alias("i"), F.lit(q).alias("q"), "n", F.col(f"q{i}_from").alias("a"), F.col(f"q{i}_to").alias("b"))
    whole = s.select("k", F.lit(None).cast("string").alias("day"), F.lit(0).alias("i"), F.lit(0.5).alias("q"), F.col("w_n").alias("n"), F.col("w_q0_from").alias("a"), F.col("w_q0_to").alias("b"))
    return own(0, 0.5).unionByName(own(1, 0.9)).unionByName(whole.distinct())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Days that differ from their data set: by the sketches' bounds; the few they leave open by counting inside these bounds."""
    values = _p3_values(spark, d)
    s = cut_lineage(_p3_judged(_p3_sketched(values)))
    hits = s.filter("hit").select("k", "day", "field_name")
    undecided = s.filter("hit IS NULL")
    if not undecided.isEmpty():
        v = quantiles.exact_percentiles(values, _p3_wanted(undecided))
        own = undecided.select("k", "day", "field_name")
        for i, day, name in ((0, True, "m"), (1, True, "p"), (0, False, "w")):
            part = v.filter((F.col("i") == i) & (F.col("day").isNotNull() if day else F.col("day").isNull())).withColumnRenamed("value", name)
            own = own.join(part.select("k", "day", name) if day else part.select("k", name), ["k", "day"] if day else "k")
        own = own.filter((F.abs(F.col("m") - F.col("w")) > _p3_limit(6)) | (F.col("p") - F.col("w") > _p3_limit(7)))
        hits = hits.unionByName(own.select("k", "day", "field_name"))
    return hits.select("field_name", F.split("k", "\u0002")[1].alias("dataset_id"), F.col("day").alias("run_day"))


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact median and 90th percentile of every data set's every day, found by counting inside the sketches' bounds."""
    values = _p3_values(spark, d)
    s = cut_lineage(_p3_sketched(values))
    v = quantiles.exact_percentiles(values, _p3_wanted(s).filter(F.col("day").isNotNull()))
    at = lambda i: F.round(F.max(F.when(F.col("i") == i, F.col("value"))), 6)
    q = v.groupBy("k", "day").agg(at(0).alias("median"), at(1).alias("p90")).join(s.select("k", "day", "field_name", "n"), ["k", "day"])
    return q.select("field_name", F.split("k", "\u0002")[1].alias("dataset_id"), F.col("day").alias("run_day"), "n", "median", "p90")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose supply falls short of their share or minimum."""
    _, report = quota.sample_to_targets(_t(spark, d, "cells"), _t(spark, d, "sample_targets"))
    return report.filter(F.col("short_share") | F.col("short_min")).select("target_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Supply, wanted count and quota of every target."""
    _, report = quota.sample_to_targets(_t(spark, d, "cells"), _t(spark, d, "sample_targets"))
    return report.select("target_id", "supply", "wanted", "quota", "exhausted")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled cells of every target set."""
    return quota.sample_to_targets(_t(spark, d, "cells"), _t(spark, d, "sample_targets"))[0]


def _labelled_clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = cut_lineage(vectors.usable_vectors(_t(spark, d, "cell_exprs")))
    assigned, typical = clusters.similarity_clusters(v, "cell_id", "exprs")
    cells = _t(spark, d, "cells")
    cur = latest_per_key(cells.filter(F.col("cell_id").isNotNull()), ["cell_id"], "loaded_at", ["major_cluster"]).select("cell_id", label_key(F.col("major_cluster")).alias("label"))
    inside = cut_lineage(assigned.filter(F.col("cluster_no").isNotNull()).join(cur, "cell_id", "left"))
    w = Window.partitionBy("cluster_no")
    n = inside.groupBy("cluster_no", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("n_members", F.sum("n").over(w))
    best = n.filter(F.col("label").isNotNull()).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "label"))).filter("rn = 1").select("cluster_no", "n_members", F.col("label").alias("main"))
    named = best.join(canonical_spellings(cells, "major_cluster"), F.col("main") == F.col("label_key"), "left").select("cluster_no", "n_members", "main", F.coalesce("canonical", "main").alias("major_cluster"))
    return inside, named, typical


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells in groups of at least 8 whose label is missing or not the group's most frequent one."""
    inside, named, _ = _labelled_clusters(spark, d)
    hit = inside.join(F.broadcast(named), "cluster_no").filter((F.col("n_members") >= 8) & ~F.col("label").eqNullSafe(F.col("main")))
    return hit.select("cell_id", "major_cluster")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its size, its most typical cells and the category it stands for."""
    _, named, typical = _labelled_clusters(spark, d)
    return typical.join(named.drop("n_members"), "cluster_no", "left").select("cluster_no", "n_members", "major_cluster", "rank", "cell_id", "similarity")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    placed = packing.pack_documents(_t(spark, d, "documents"))
    return placed.filter("piece_no = 1").select("doc_id")  # a second piece has been placed


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its pieces and tokens."""
    placed = packing.pack_documents(_t(spark, d, "documents")).filter(F.col("container_id").isNotNull())
    return placed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "eval_items").filter(F.col("split_name").isin("test", "validation"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least 8 consecutive words with a held-out item."""
    return leaks.leaked_passages(_t(spark, d, "documents"), _held_out(spark, d)).filter("shares_run").select("doc_id", "eval_id")


def p8_regions(spark: SparkSession, d: str) -> DataFrame:
    """Leaked regions, those with edits included."""
    return leaks.leaked_passages(_t(spark, d, "documents"), _held_out(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose language is not the one the document's label names."""
    lines = language.identify_languages(_t(spark, d, "documents"), _t(spark, d, "lang_samples"))
    return lines.filter(~F.col("declared").eqNullSafe(F.col("lang"))).select("doc_id", "line_no", "lang")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document with letters."""
    return language.document_languages(language.identify_languages(_t(spark, d, "documents"), _t(spark, d, "lang_samples")))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_ranked, p2_found, p3_found, p3_percentiles, p3_exact, p4_found, p4_report, p4_sample, p6_found, p6_clusters, p7_found, p7_containers, p8_found, p8_regions, p9_found, p9_documents)}
