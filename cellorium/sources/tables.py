"""Readers and writers of matrices, result tables, ortholog maps and parameters."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet
from cellorium.operators.relational import nan_to_null


def read_matrix_tsv(spark: SparkSession, path: str, gene: str | None = None, symbol: str | None = None) -> ExprSet:
    """Genes in rows, first column id, second symbol, then one column per cell; .gz is read as well."""
    df = spark.read.csv(path, sep="\t", header=True)
    gene = gene or df.columns[0]
    return ExprSet.from_wide(df, gene, symbol or df.columns[1])


def read_umi_csv(spark: SparkSession, path: str, cluster: str = "assigned_cluster", annotations: int = 3) -> ExprSet:
    """Cells in rows; the first columns are annotations (the first one the cell id), the others gene counts."""
    df = spark.read.csv(path, header=True)
    notes, genes = df.columns[:annotations], df.columns[annotations:]
    cell = notes[0]
    long = df.unpivot([F.col(f"`{cell}`")], [F.col(f"`{g}`").cast("double").alias(g) for g in genes], GENE, "value").withColumnRenamed(cell, CELL)
    return ExprSet.from_long(long, df.select(F.col(f"`{cell}`").alias(CELL), *[F.col(f"`{n}`") for n in notes[1:]]), assay="counts")


def write_tsv(df: DataFrame, path: str, gz: bool = False) -> None:
    """A result table as tab-separated files with header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if gz else "none", nullValue="NA")


def map_orthologs(expr: DataFrame, orthologs: DataFrame, source: str, target: str, kind: str = "orthology_type", confidence: str = "orthology_confidence", keep_all: bool = False) -> DataFrame:
    """Rename genes by a supplied map, one-to-one pairs of confidence 1 only; genes without one are dropped.

    ``keep_all`` is the keyed right join: every target gene of the map comes out,
    those without a measurement once with nulls.  NaN values become null.
    """
    expr = expr.select(*[nan_to_null(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in expr.dtypes])
    m = orthologs.filter((F.col(kind) == "ortholog_one2one") & (F.col(confidence).cast("int") == 1) & F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias(GENE), F.col(target).alias("__to")).distinct()
    return expr.join(m, GENE, "right" if keep_all else "inner").drop(GENE).withColumnRenamed("__to", GENE)


def normal_run_id(rid: str) -> str:
    """Run ids agree whether cluster numbers are zero padded or not."""
    return re.sub(r"C0+(\d)", r"C\1", rid)


def read_params(source: str | dict) -> dict[str, dict[str, float]]:
    """Per-run overrides from a JSON file or a dict: {run id: {name: number}}; never executed."""
    raw = source if isinstance(source, dict) else json.load(open(source))
    return {normal_run_id(k): {n: float(v) for n, v in d.items()} for k, d in raw.items()}
