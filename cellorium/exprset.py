"""The annotated expression container: DataFrames for assays, genes, cells and embeddings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENE, CELL = "gene_id", "cell_id"


@dataclass(frozen=True)
class ExprSet:
    """Immutable; every operation returns a new one.

    expr: (gene_id, cell_id, one DOUBLE column per assay); NaN is turned into null.
    genes: one row per gene with gene_idx, cells: one row per cell with cell_idx.
    emb: embeddings (cell_id, features ARRAY<DOUBLE>).  meta: tables and models of
    earlier steps.  dense: every (gene, cell) pair has a row; otherwise absent
    pairs are zeros and :meth:`completed` fills them in.
    """

    expr: DataFrame
    genes: DataFrame
    cells: DataFrame
    emb: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    dense: bool = True

    @staticmethod
    def from_long(expr: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None, value: str = "value", assay: str = "exprs", dense: bool = True) -> ExprSet:
        """From (gene_id, cell_id, value); missing annotation tables are derived from the keys."""
        v = F.col(value).cast("double")
        e = expr.select(F.col(GENE), F.col(CELL), F.when(~F.isnan(v), v).alias(assay))
        genes = genes if genes is not None else e.select(GENE).distinct().withColumn("display_name", F.col(GENE).cast("string"))
        cells = cells if cells is not None else e.select(CELL).distinct()
        return ExprSet(e, genes, cells, dense=dense)

    @staticmethod
    def from_array_column(df: DataFrame, cell: str, vec: str, assay: str = "exprs", keep: tuple[str, ...] = (), prefix: str = "G") -> ExprSet:
        """From one array per cell; genes are named by position (0-based, four digits)."""
        long = df.select(F.col(cell).alias(CELL), F.posexplode(vec).alias("gene_idx", "value"))
        named = long.withColumn(GENE, F.concat(F.lit(prefix), F.lpad(F.col("gene_idx").cast("string"), 4, "0")))
        genes = named.select(GENE, "gene_idx").distinct().withColumn("display_name", F.col(GENE))
        return ExprSet.from_long(named, df.select(F.col(cell).alias(CELL), *keep), genes, assay=assay)

    @staticmethod
    def from_wide(df: DataFrame, gene: str, symbol: str | None = None, assay: str = "exprs") -> ExprSet:
        """From a matrix with genes in rows and one column per cell (names with dots are allowed)."""
        fixed = [gene] + ([symbol] if symbol else [])
        cols = [c for c in df.columns if c not in fixed]
        long = df.unpivot([F.col(f"`{c}`") for c in fixed], [F.col(f"`{c}`").cast("double").alias(c) for c in cols], CELL, "value")
        genes = df.select(F.col(f"`{gene}`").alias(GENE), F.col(f"`{symbol or gene}`").alias("display_name"))
        return ExprSet.from_long(long.withColumnRenamed(gene, GENE), genes=genes, assay=assay)

    build = from_wide

    def with_(self, **kw) -> ExprSet:
        return replace(self, **kw)

    def with_embedding(self, name: str, df: DataFrame) -> ExprSet:
        return replace(self, emb=self.emb | {name: df})

    def with_meta(self, **kw) -> ExprSet:
        return replace(self, meta=self.meta | kw)

    def with_gene_columns(self, df: DataFrame, *cols: str) -> ExprSet:
        """Attach or replace gene annotations; genes without a row get null."""
        return replace(self, genes=self.genes.drop(*cols).join(df.select(GENE, *cols), GENE, "left"))

    def with_cell_columns(self, df: DataFrame, *cols: str) -> ExprSet:
        return replace(self, cells=self.cells.drop(*cols).join(df.select(CELL, *cols), CELL, "left"))

    def subset_genes(self, ids: DataFrame) -> ExprSet:
        return replace(self, expr=self.expr.join(ids.select(GENE), GENE, "left_semi"), genes=self.genes.join(ids.select(GENE), GENE, "left_semi"))

    def subset_genes_by(self, column: str) -> ExprSet:
        """Genes whose boolean column is true."""
        return self.subset_genes(self.genes.filter(F.col(column)))

    def subset_cells(self, ids: DataFrame, anti: bool = False) -> ExprSet:
        how = "left_anti" if anti else "left_semi"
        k = ids.select(CELL)
        return replace(self, expr=self.expr.join(k, CELL, how), cells=self.cells.join(k, CELL, how), emb={n: d.join(k, CELL, how) for n, d in self.emb.items()})

    def prefixed(self, dataset: str) -> ExprSet:
        """Cell ids get ``dataset.`` in front and a dataset_id column."""
        pre = lambda d: d.withColumn(CELL, F.concat(F.lit(dataset + "."), F.col(CELL).cast("string")))
        return replace(self, expr=pre(self.expr), cells=pre(self.cells).withColumn("dataset_id", F.lit(dataset)), emb={n: pre(d) for n, d in self.emb.items()})

    def completed(self, assay: str = "exprs") -> ExprSet:
        """Fill in the zeros of a sparse set; the result is genes x cells, use it after gene selection."""
        if self.dense:
            return self
        grid = self.genes.select(GENE).crossJoin(self.cells.select(CELL))
        full = grid.join(self.expr.select(GENE, CELL, assay), [GENE, CELL], "left").withColumn(assay, F.coalesce(assay, F.lit(0.0)))
        return replace(self, expr=full, dense=True)

    def cell_vectors(self, assay: str = "exprs", gene_column: str | None = None) -> DataFrame:
        """(cell_id, features) with genes in the order of their ids; absent pairs are 0."""
        s = self.subset_genes_by(gene_column) if gene_column else self
        ids = [r[0] for r in s.genes.select(GENE).orderBy(GENE).collect()]  # gene-level: tens of thousands at most
        pos = F.create_map(*[x for i, g in enumerate(ids) for x in (F.lit(g), F.lit(i))]) if len(ids) <= 200 else None
        if pos is not None:
            placed = s.expr.withColumn("__i", F.element_at(pos, F.col(GENE)))
        else:
            table = s.expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(ids)], f"{GENE} {dict(s.genes.dtypes)[GENE]}, __i int")
            placed = s.expr.join(F.broadcast(table), GENE)  # one row per gene of a checked, gene-level list
        packed = placed.groupBy(CELL).agg(F.map_from_entries(F.collect_list(F.struct("__i", assay))).alias("m"))
        get = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
        return packed.select(CELL, F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), get).alias("features"))

    def save(self, path: str) -> None:
        """One parquet folder per table."""
        for n, d in {"expr": self.expr, "genes": self.genes, "cells": self.cells, **{f"emb={k}": v for k, v in self.emb.items()}}.items():
            d.write.mode("overwrite").parquet(f"{path}/{n}")
        info = self.expr.sparkSession.createDataFrame([(json.dumps({"dense": self.dense, "emb": list(self.emb)}),)], "info string")
        info.coalesce(1).write.mode("overwrite").json(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ExprSet:
        info = json.loads(spark.read.json(f"{path}/info").first()["info"])
        r = lambda n: spark.read.parquet(os.path.join(path, n))
        return ExprSet(r("expr"), r("genes"), r("cells"), {k: r(f"emb={k}") for k in info["emb"]}, dense=info["dense"])


def ids_of(display: DataFrame, column: str, genes: DataFrame) -> DataFrame:
    """Add gene_id for display names: the gene of smallest gene_idx that carries the name, null if none."""
    from cellorium.operators.relational import lookup

    return lookup(display, column, genes, "display_name", GENE, "gene_idx", GENE)


def names_of(ids: DataFrame, genes: DataFrame) -> DataFrame:
    """Add the display name of each gene_id; genes without one keep their id."""
    n = genes.select(GENE, "display_name")
    return ids.join(n, GENE, "left").withColumn("display_name", F.coalesce("display_name", F.col(GENE)))
