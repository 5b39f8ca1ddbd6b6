"""Classification of cells: forests, margins, signatures, models, and subsample-then-classify."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, LinearSVC, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet
from cellorium.operators import cluster, reduce
from cellorium.operators.neighbors import knn_classify
from cellorium.operators.relational import hash_order, nan_to_null, split_sample

UNKNOWN = "unkown"  # spelled as users of such tables expect it
#: Training rows to a task of a forest; its jobs, one or more per level of the trees, each run all tasks.
TRAIN_ROWS = 2000
#: Cells to a task that applies the forests of all signatures, which each task unpacks.
APPLY_ROWS = 1000
#: Forests of signatures trained at a time.
FORESTS = 8


def _vec(df: DataFrame) -> DataFrame:
    return df.withColumn("__x", array_to_vector("features")) if dict(df.dtypes)["features"].startswith("array") else df.withColumn("__x", F.col("features"))


def _scaled(df: DataFrame, normalise: bool) -> DataFrame:
    """Features z-scaled within this table when ``normalise``."""
    v = _vec(df)
    if not normalise:
        return v
    return StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z").fit(v).transform(v).drop("__x").withColumnRenamed("__z", "__x")


class _ForestModel(RandomForestClassificationModel):
    """PySpark lists a model's parameters by reading its attributes, all but properties; its cached ``trees`` cost seconds for 500 trees."""

    @property
    def trees(self) -> list[DecisionTreeClassificationModel]:
        return [DecisionTreeClassificationModel(m) for m in self._call_java("trees")]


class _Forest(RandomForestClassifier):
    def _create_model(self, java_model) -> _ForestModel:
        return _ForestModel(java_model)


def train_forest(train: DataFrame, label: str, trees: int = 500, normalise: bool = False, seed: int = 1) -> PipelineModel:
    """A forest over (features, label); trees grow in parallel on the executors.

    Rows are laid out by their number, in the order of cells, so that a small set is
    not trained by many empty tasks and the bootstrap does not depend on how
    ``train`` is partitioned.
    """
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"),
        _Forest(featuresCol="__x", labelCol="__y", numTrees=trees, seed=seed, maxDepth=8, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred"),
    ]
    rows = _scaled(train.filter(F.col(label).isNotNull()), normalise).select(CELL, label, "__x").persist()
    laid = rows.repartition(-(-max(rows.count(), 1) // TRAIN_ROWS), CELL).sortWithinPartitions(CELL, label).persist()
    try:
        return Pipeline(stages=stages).fit(laid)
    finally:
        laid.unpersist()
        rows.unpersist()


def predict_forest(model: PipelineModel, pred: DataFrame, normalise: bool = False) -> DataFrame:
    """(cell_id, predicted, second, prob, second_prob, probs MAP): the two best classes; the first class wins a tie."""
    labels = list(model.stages[0].labels)
    p = model.stages[1].transform(_scaled(pred, normalise)).select(CELL, vector_to_array("__p").alias("p"))
    return top_two(p, labels)


def top_two(probs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """From (cell_id, p ARRAY) the best and second label with their values; ties to the first label."""
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_position("p", F.array_max("p")).cast("int")
    rest = F.transform("p", lambda x, i: F.when(i + 1 == F.col("b"), F.lit(-1.0)).otherwise(x))
    second = F.array_position("q", F.array_max("q")).cast("int")
    d = probs.withColumn("b", best).withColumn("q", rest).withColumn("s", second)
    two = F.lit(len(labels) > 1)
    return d.select(CELL, F.get(names, F.col("b") - 1).alias("predicted"), F.when(two, F.get(names, F.col("s") - 1)).alias("second"), F.array_max("p").alias("prob"), F.when(two, F.array_max("q")).alias("second_prob"), F.map_from_arrays(names, "p").alias("probs"))


def select_features(train: DataFrame, label: str, trees: int = 100, drop: float = 0.2, least: int = 2, seed: int = 1) -> list[int]:
    """Backward elimination by importance: the smallest set within one standard error of the best held-out error."""
    width = len(train.select("features").first()[0])
    base = train.withColumn("__fold", F.conv(F.substring(F.md5(F.col(CELL).cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0).persist()
    n = base.filter("__fold").count()
    keep, tried = list(range(width)), []
    while len(keep) >= least:
        ks = F.array(*[F.lit(i) for i in keep])
        cur = base.withColumn("features", F.transform(ks, lambda i: F.get("features", i)))
        m = train_forest(cur.filter(~F.col("__fold")), label, trees, seed=seed)
        err = predict_forest(m, cur.filter("__fold")).join(base.select(CELL, label), CELL).agg(F.avg((F.col("predicted") != F.col(label)).cast("double"))).first()[0]
        tried.append((float(err if err is not None else 1.0), list(keep)))
        imp = m.stages[1].featureImportances.toArray()
        k = max(least, int(len(keep) * (1 - drop)))
        if k == len(keep):
            break
        keep = sorted(keep[i] for i in np.argsort(-imp, kind="stable")[:k])
    base.unpersist()
    low = min(e for e, _ in tried)
    limit = low + float(np.sqrt(max(low * (1 - low), 0) / max(n, 1)))
    return min((s for e, s in tried if e <= limit), key=len)


def train_svm(train: DataFrame, label: str) -> PipelineModel:
    """Linear margins one-vs-rest on scaled features; other kernels are not offered."""
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"),
        StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z"),
        OneVsRest(classifier=LinearSVC(featuresCol="__z", maxIter=50, regParam=0.01), featuresCol="__z", labelCol="__y", predictionCol="__pred"),
    ]
    m = Pipeline(stages=stages).fit(_vec(train.filter(F.col(label).isNotNull())))
    m.stages.append(IndexToString(inputCol="__pred", outputCol="predicted", labels=m.stages[0].labels))
    return m


def predict_svm(model: PipelineModel, pred: DataFrame) -> DataFrame:
    d = _vec(pred)
    for s in model.stages[1:]:
        d = s.transform(d)
    return d.select(CELL, "predicted")


def error_table(pred: DataFrame, truth: DataFrame, label: str) -> DataFrame:
    """Error rate per class and over all of predictions joined with their truth."""
    from cellorium.operators.groupstats import error_rates

    return error_rates(pred.join(truth.select(CELL, label), CELL), label, "predicted")


def signature_scores(expr: DataFrame, value: str, signature: DataFrame, z_over: float = 0.3, batch: str | None = None, module: str = "meta_cluster") -> DataFrame:
    """(cell, module, score): share of a module's genes whose z-score exceeds ``z_over``; genes the data lack do not count.

    Genes with zero sd have no z-score and do not count either.
    """
    from cellorium.operators.groupstats import remove_batch_effect
    from cellorium.operators.relational import zscore

    sig = signature.select(GENE, module).distinct()
    e = expr.join(sig.select(GENE).distinct(), GENE, "left_semi")
    if batch:
        e, value = remove_batch_effect(e, value, batch, "__adj"), "__adj"
    z = zscore(e, [GENE], value, "__z")
    return z.filter(F.col("__z").isNotNull()).join(sig, GENE).groupBy(CELL, module).agg(F.avg((F.col("__z") > z_over).cast("double")).alias("score"))


def signature_gates(expr: DataFrame, value: str, positive: DataFrame | None, negative: DataFrame | None, pos_over: float = 0.3, neg_under: float = 0.3, module: str = "meta_cluster") -> DataFrame:
    """(cell, module, passes): every positive gene's z over and every negative gene's z under its threshold."""
    from cellorium.operators.relational import zscore

    z = zscore(expr, [GENE], value, "__z").select(GENE, CELL, "__z")
    parts = []
    if positive is not None:
        parts.append(z.join(positive.select(GENE, module).distinct(), GENE).select(CELL, module, F.coalesce(F.col("__z") > pos_over, F.lit(False)).alias("ok")))
    if negative is not None:
        parts.append(z.join(negative.select(GENE, module).distinct(), GENE).select(CELL, module, F.coalesce(F.col("__z") < neg_under, F.lit(False)).alias("ok")))
    if not parts:
        raise ValueError("positive or negative genes are needed")
    d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return d.groupBy(CELL, module).agg(F.bool_and("ok").alias("passes"))


def top_signature(scores: DataFrame, module: str = "meta_cluster", least: float = 0.65) -> DataFrame:
    """(cell, meta_cluster_top, score, bin): first best module; bin 1 if its score reaches ``least``."""
    w = Window.partitionBy(CELL).orderBy(F.desc("score"), module)
    d = scores.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return d.select(CELL, F.col(module).alias("meta_cluster_top"), "score", (F.col("score") >= least).cast("int").alias("bin"))


def classify_by_signature(es: ExprSet, assay: str, signature: DataFrame, positive: DataFrame | None = None, negative: DataFrame | None = None, batch: str | None = None, prob: float = 0.8, train_pos: float = 0.8, train_neg: float = 0.2, least: int = 20, trees: int = 500, seed: int = 123456) -> DataFrame:
    """Scores, then one forest per signature trained on its clear cells, and the two best classes.

    A signature with fewer than ``least`` training rows gets probability -1 and
    label -1.  Training sides are balanced in hash order, so runs repeat.
    Columns: cell_id, meta_cluster_top, bin, rf_probs MAP, rf_max, rf_second,
    rf_class_max (UNKNOWN under ``prob``), rf_class_second.
    """
    scores = signature_scores(es.expr, assay, signature, batch=batch).persist()
    pos = scores.filter(F.col("score") >= train_pos)
    if positive is not None or negative is not None:
        gates = signature_gates(es.expr, assay, positive, negative)
        pos = pos.join(gates.filter("passes").select(CELL, "meta_cluster"), [CELL, "meta_cluster"], "left_semi")
    sides = pos.select(CELL, "meta_cluster", F.lit("pos").alias("label")).unionByName(scores.filter(F.col("score") < train_neg).select(CELL, "meta_cluster", F.lit("neg").alias("label"))).persist()
    n = {(r[0], r[1]): r[2] for r in sides.groupBy("meta_cluster", "label").count().collect()}  # two rows a signature
    mods = [r[0] for r in signature.select("meta_cluster").distinct().orderBy("meta_cluster").collect()]  # signatures, a short list
    vec = es.cell_vectors(assay).persist()
    ks = {m: k for m in mods if 2 * (k := min(n.get((m, "pos"), 0), n.get((m, "neg"), 0))) >= max(least, 1)}
    if ks:
        most = F.element_at(F.create_map(*[F.lit(x) for m, k in ks.items() for x in (m, k)]), F.col("meta_cluster"))
        w = Window.partitionBy("meta_cluster", "label").orderBy(hash_order(CELL, seed), CELL)
        train = sides.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).join(vec, CELL).drop("rn")
        train = train.repartition(-(-2 * sum(ks.values()) // TRAIN_ROWS), CELL).persist()
    fit = lambda m: train_forest(train.filter(F.col("meta_cluster") == m), "label", trees, seed=seed) if m in ks else None
    with ThreadPoolExecutor(FORESTS) as pool:
        models = list(pool.map(inheritable_thread_target(es.expr.sparkSession)(fit), mods))
    for d in (train, sides) if ks else (sides,):
        d.unpersist()
    p = vec.coalesce(-(-max(vec.count(), 1) // APPLY_ROWS)).select(CELL, array_to_vector("features").alias("__x"))
    for i, model in enumerate(models):
        if model is None:
            p = p.withColumn(f"__p{i}", F.lit(-1.0))
        else:
            at = list(model.stages[0].labels).index("pos")
            p = model.stages[1].transform(p).withColumn(f"__p{i}", F.get(vector_to_array("__p"), F.lit(at))).drop("__raw", "__p", "__pred")
    arr = p.select(CELL, F.array(*[f"__p{i}" for i in range(len(mods))]).alias("p")).persist()
    probs = arr.select(CELL, F.map_from_arrays(F.array(*[F.lit(m) for m in mods]), "p").alias("rf_probs"))
    t = top_two(arr, mods).select(CELL, F.col("predicted"), "second", "prob", "second_prob")
    cls = lambda c, p: F.when(F.col(p) < prob, F.lit(UNKNOWN)).otherwise(F.col(c))
    t = t.select(CELL, F.col("prob").alias("rf_max"), F.col("second_prob").alias("rf_second"), cls("predicted", "prob").alias("rf_class_max"), cls("second", "second_prob").alias("rf_class_second"))
    return top_signature(scores).join(probs, CELL, "right").join(t, CELL)


def classify_by_module_score(es: ExprSet, signature: DataFrame, assay: str = "norm_exprs", batch: str | None = None, least: float = 1.0) -> DataFrame:
    """Module scores after optional batch correction; bin 1 from ``least`` on."""
    from cellorium.operators.groupstats import module_score, remove_batch_effect

    e = es.expr
    if batch:
        e, assay = remove_batch_effect(e.join(es.cells.select(CELL, batch), CELL), assay, batch, "__adj"), "__adj"
    s = module_score(e, assay, signature)
    return top_signature(s, least=least)


def classify_pool(vectors: DataFrame, labels: DataFrame, label: str, per_class: int = 1500, priority: DataFrame | None = None, trees: int = 500, seed: int = 123456, prob: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(predictions, test errors): train on per-class downsamples (by silhouette ``priority`` if given), test on the next half as many."""
    j = vectors.join(labels.filter(F.col(label).isNotNull()).select(CELL, label), CELL)
    order = [hash_order(CELL, seed), F.col(CELL)]
    if priority is not None:
        j = j.join(priority.select(CELL, "width"), CELL, "left")
        order = [F.desc_nulls_last("width"), *order]
    w = Window.partitionBy(label)
    j = j.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("k", F.least(F.floor(F.count(F.lit(1)).over(w) * 2 / 3), F.lit(per_class)))
    model = train_forest(j.filter(F.col("rn") <= F.greatest(F.col("k"), F.lit(1))), label, trees, seed=seed)
    test = j.filter((F.col("rn") > F.col("k")) & (F.col("rn") <= F.col("k") * 1.5))
    pred = predict_forest(model, vectors)
    cls = F.when(F.col("prob") < prob, F.lit(UNKNOWN)).otherwise(F.col("predicted"))
    return pred.withColumn("class_max", cls), error_table(predict_forest(model, test), test, label)


def classify_by_model(es: ExprSet, model: PipelineModel, assay: str, required: DataFrame, pad: bool = False, zero_low: bool = False, meta: DataFrame | None = None) -> DataFrame:
    """Predict with a stored model on per-gene z-scores of the required genes.

    Missing genes raise unless ``pad``; genes that are zero everywhere get z =
    -10000 if ``zero_low``, else 0.  ``meta`` is joined to the result.
    """
    from cellorium.operators.relational import pad_missing, zscore

    have = es.genes.join(required.select(GENE), GENE, "left_semi").count()
    if have < required.count() and not pad:
        raise ValueError("genes of the model are missing; pad=True fills them with zeros")
    e = pad_missing(es.expr, required, GENE, es.cells, CELL, assay)
    z = zscore(e, [GENE], assay, "z")
    zero = F.max(F.abs(nan_to_null(F.col(assay)))).over(Window.partitionBy(GENE)) == 0
    z = z.withColumn("z", F.when(zero, F.lit(-10000.0 if zero_low else 0.0)).otherwise(F.coalesce("z", F.lit(0.0))))
    v = ExprSet.from_long(z.select(GENE, CELL, "z"), es.cells, required, value="z").cell_vectors("exprs")
    p = predict_forest(model, v)
    return p.join(meta, CELL, "left") if meta is not None else p


def out_of_sample_embedding(es: ExprSet, frac: float = 0.2, vgene_column: str = "hvg_sd", assay: str = "exprs", embedding: DataFrame | None = None, icor_method: str = "spearman", perplexity: float = 30.0, seed: int = 1, max_iter: int = 1000) -> DataFrame:
    """(cell_id, is_train, features): a t-SNE of a sample, and all other cells placed in it by their correlations with the sample.

    New cells get A pinv(S) Y, where A are their correlations with the sample's
    cells, S the sample's own and Y its embedding (``embedding``: another one).  The
    sample is bounded by ``MAX_CELLS``; the others stream past it.
    """
    from cellorium.operators import embed

    cells = split_sample(es.cells.select(CELL), CELL, frac, seed).persist()
    v = es.cell_vectors(assay, vgene_column if vgene_column in es.genes.columns else None).join(cells, CELL).persist()
    train, rest = v.filter("is_train").drop("is_train"), v.filter("NOT is_train").drop("is_train")
    ids, s = reduce.collect_matrix(reduce.correlation_space(train, icor_method))
    if embedding is None:
        y = embed.run_tsne(s, perplexity, True, seed=seed, max_iter=max_iter)
        if y is None:
            raise ValueError("the sample is too small for a t-SNE of this perplexity")
    else:
        y = reduce.collect_matrix(embedding.join(cells.filter("is_train").select(CELL), CELL, "left_semi"))[1]
    placed = reduce.map_out_of_sample(reduce.correlation_space(rest, icor_method, against=train), s, y)
    own = reduce.matrix_frame(train, ids, y)
    return own.withColumn("is_train", F.lit(True)).unionByName(placed.withColumn("is_train", F.lit(False))).select(CELL, "is_train", "features")


def subsample_cluster_classify(es: ExprSet, frac: float = 0.2, reduction: str = "iCor", method: str = "kmeans", ks: Sequence[int] = (2, 3, 4, 5, 6), classifier: str = "knn", vgene_column: str = "hvg_sd", assay: str = "exprs", use_proj: bool = True, icor_method: str = "spearman", trees: int = 500, seed: int = 1) -> DataFrame:
    """(cell_id, is_train, one label column per k): cluster a sample, classify all other cells.

    The sample is reduced and clustered; the others are placed in its space
    (correlation with the sample's cells, or PCA rotation with the sample's means)
    batch by batch against the broadcast sample, so their number is free.
    """
    from cellorium.operators.groupstats import genes_varying_in_both

    if reduction not in ("iCor", "pca"):
        raise ValueError(f"{reduction!r} has no projection of new cells")
    cells = split_sample(es.cells.select(CELL), CELL, frac, seed).persist()
    e = es.expr.join(cells, CELL)
    ok = genes_varying_in_both(e, assay, "is_train")
    es = es.subset_genes(ok)
    v = es.cell_vectors(assay, vgene_column if vgene_column in es.genes.columns else None).join(cells, CELL).persist()
    train, rest = v.filter("is_train").drop("is_train"), v.filter("NOT is_train").drop("is_train")
    if reduction == "pca":
        train_emb, info = reduce.pca(train)
        rest_emb = reduce.project_pca(rest, info)
    else:
        train_emb = reduce.correlation_space(train, icor_method)
        rest_emb = reduce.correlation_space(rest, icor_method, against=train)
    sub = ExprSet(es.expr, es.genes, cells.filter("is_train").select(CELL), {reduction: train_emb.persist()})
    lab = cluster.clust(sub, reduction, method, ks, seed=seed).cells
    space, other = (train_emb, rest_emb) if use_proj else (train, rest)
    out = cells
    for name in [c for c in lab.columns if c != CELL]:
        t = space.join(lab.select(CELL, F.col(f"`{name}`").alias("label")), CELL)
        if classifier == "knn":
            p = knn_classify(t, "label", other)
        elif classifier == "RF":
            p = predict_forest(train_forest(t, "label", trees, True, seed), other, True).select(CELL, "predicted")
        elif classifier == "svm":
            p = predict_svm(train_svm(t, "label"), other)
        else:
            raise ValueError(f"unknown classifier {classifier!r}")
        both = t.select(CELL, "label").unionByName(p.select(CELL, F.col("predicted").alias("label")))
        keep = [F.col(f"`{c}`") for c in out.columns]
        out = out.select(*keep).join(both.withColumnRenamed("label", name), CELL, "left")
    return out
