"""The whole analysis: variable genes, reduction, clustering, refinement, nested clustering, markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet
from cellorium.operators import classify, cluster, de, reduce, vgene
from cellorium.sources.tables import normal_run_id, read_params

DENSITY = ("adpclust", "dpclust")


def run(es: ExprSet, assay: str = "exprs", method_vgene: str = "HVG.sd", method_reduction: str = "iCor", method_clust: str = "kmeans", ks: Sequence[int] = (2, 3, 4, 5, 6), n_iter: int = 1, sd_n: int = 1500, n_pc: int | None = None, refine: bool = False, n_refine: int = 30, do_de: bool = False, params: str | dict | None = None, subsampling: bool = False, sub_frac: float = 0.4, classifier: str = "knn", seed: int = 9997, snn_k: int = 10, snn_method: str = "eigen") -> ExprSet:
    """Add label columns, embeddings and marker tables to the set.

    Top level run id ``L1C1``; a cluster c of run r is clustered again while
    the level is below ``n_iter`` as ``r.L<level+1><c>``, its labels
    ``<child>.L<level+2><label>``; clusters of ten cells or fewer stay whole (``C1``).
    ``params`` overrides rho, delta and k per run id; k = 1 leaves a run alone.
    """
    for name, table, col in (("genes", es.genes, GENE), ("cells", es.cells, CELL)):
        if col not in table.columns:
            raise ValueError(f"{name} have no column {col}")
    overrides = read_params(params) if params is not None else {}
    es = vgene.variable_genes(es, method_vgene, sd_n, assay=assay)
    if subsampling:
        lab = classify.subsample_cluster_classify(es, sub_frac, method_reduction, method_clust, ks, classifier, vgene.VGENE_COLUMN[method_vgene], assay, seed=seed)
        return es.with_(cells=es.cells.join(lab, CELL, "left"))
    es = _one(es, "L1C1", 0, ks, overrides, assay, method_vgene, method_reduction, method_clust, n_iter, sd_n, n_pc, refine, n_refine, seed, snn_k, snn_method)
    if do_de:
        col = next(c for c in es.cells.columns if c.startswith(f"{method_reduction}.{method_clust}."))
        e = es.expr.join(es.cells.select(CELL, F.col(f"`{col}`").alias("group")), CELL)
        table, _ = de.marker_genes(e, assay, "group")
        es = es.with_meta(de_res=table)
        if method_clust in (*DENSITY, "SNN"):
            es = _for_view(es, e, assay, sd_n, seed)
    return es


def _for_view(es: ExprSet, e, assay: str, sd_n: int, seed: int) -> ExprSet:
    """Flag hvg_de, the first significant genes of the variance analysis, and add the t-SNE ``vis.tsne`` on them."""
    if e.select("group").distinct().limit(2).count() < 2:
        return es
    sig = de.find_de_genes(e, assay, "group").filter("significant").orderBy("f_adjp", GENE).limit(sd_n).select(GENE).withColumn("hvg_de", F.lit(True)).persist()
    if sig.count() < 2:
        return es
    flag = es.genes.drop("hvg_de").join(sig, GENE, "left").withColumn("hvg_de", F.coalesce("hvg_de", F.lit(False)))
    return reduce.reduce_dim(es.with_(genes=flag), "tsne", assay, "hvg_de", auto_tsne=False, name="vis.tsne", seed=seed)


def _one(es, rid, level, ks, overrides, assay, mv, mr, mc, n_iter, sd_n, n_pc, refine, n_refine, seed, snn_k, snn_method) -> ExprSet:
    own = overrides.get(normal_run_id(rid), {})
    if own.get("k") == 1:
        col = f"{mr}.{mc}.k{1}"
        return es.with_(cells=es.cells.withColumn(col, F.lit("C1")))
    n = es.cells.count()
    ks = [int(own["k"])] if "k" in own else [k for k in ks if k < n] or [1]
    es = vgene.variable_genes(es, mv, sd_n, assay=assay)
    es = reduce.reduce_dim(es, mr, assay, mv, n_pc, auto_tsne=mc in DENSITY and mr != "umap", seed=seed)
    space = f"{mr}.tsne" if mc in DENSITY and f"{mr}.tsne" in es.emb else mr
    before = set(es.cells.columns)
    es = cluster.clust(es, space, mc, ks, assay, mv, snn_k, snn_method, own.get("rho"), own.get("delta"), seed=seed)
    if space != mr:
        es = es.with_(cells=es.cells.select(*[F.col(f"`{c}`").alias(c.replace(f"{space}.", f"{mr}.", 1) if c not in before else c) for c in es.cells.columns]))
    names = [c for c in es.cells.columns if c not in before]
    if refine and mc in (*DENSITY, "SNN"):
        es = _refine(es, names[0], assay, mr, mc, ks, n_pc, n_refine, seed, snn_k, snn_method)
    if level + 1 < n_iter:
        name = names[0]
        done = None
        for (c,) in es.cells.select(f"`{name}`").distinct().orderBy(f"`{name}`").collect():  # clusters, a short list
            ids = es.cells.filter(F.col(f"`{name}`") == c).select(CELL).persist()
            child = f"{rid}.L{level + 1}{c}"
            if ids.count() <= 10:
                part = ids.withColumn(name, F.lit(f"{child}.L{level + 2}C1"))
            else:
                sub = es.subset_cells(ids)
                sub = sub.with_(cells=sub.cells.select(CELL), genes=sub.genes.select(GENE), emb={}, meta={})
                sub = _one(sub, child, level + 1, ks, overrides, assay, mv, mr, mc, n_iter, sd_n, n_pc, refine, n_refine, seed, snn_k, snn_method)
                got = next(x for x in sub.cells.columns if x != CELL)
                part = sub.cells.select(CELL, F.concat(F.lit(f"{child}.L{level + 2}"), F.col(f"`{got}`")).alias(name))
            done = part if done is None else done.unionByName(part)
        keep = [F.col(f"`{c}`") for c in es.cells.columns if c != name]
        es = es.with_(cells=es.cells.select(*keep).join(done, CELL, "left"))
    return es


def _refine(es, name, assay, mr, mc, ks, n_pc, n_refine, seed, snn_k, snn_method) -> ExprSet:
    """Recluster on the genes that separate the first clusters, if more than ``n_refine`` are significant."""
    e = es.expr.join(es.cells.select(CELL, F.col(f"`{name}`").alias("group")), CELL)
    if e.select("group").distinct().limit(2).count() < 2:
        return es
    sig = de.find_de_genes(e, assay, "group").filter("significant").select(GENE).persist()
    if sig.count() <= n_refine:
        return es
    flag = es.genes.drop("hvg_refine_de").join(sig.withColumn("hvg_refine_de", F.lit(True)), GENE, "left").withColumn("hvg_refine_de", F.coalesce("hvg_refine_de", F.lit(False)))
    es = es.with_(genes=flag)
    es = reduce.reduce_dim(es, mr, assay, "hvg_refine_de", n_pc, auto_tsne=mc in DENSITY, name=f"de.{mr}", seed=seed)
    space = f"de.{mr}.tsne" if f"de.{mr}.tsne" in es.emb else f"de.{mr}"
    before = set(es.cells.columns)
    es = cluster.clust(es, space, mc, ks, assay, snn_k=snn_k, snn_method=snn_method, seed=seed)
    new = next(c for c in es.cells.columns if c not in before)
    keep = [F.col(f"`{c}`") for c in es.cells.columns if c not in (name, new)]
    return es.with_(cells=es.cells.select(*keep, F.col(f"`{new}`").alias(name)))
