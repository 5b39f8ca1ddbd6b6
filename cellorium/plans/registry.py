"""All queries of the core, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellorium.operators.labels import label_key
from cellorium.operators.skew import balanced_key_stats
from cellorium.plans import suite


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p5(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    expr, cells = _t(spark, d, "expr"), _t(spark, d, "cells")
    labels = cells.select(label_key(F.col("major_cluster")).alias("label"), F.trim(F.col("major_cluster")).alias("spelling"), F.lit(1.0).alias("one"))
    return [("cell_id", expr, balanced_key_stats(expr, "cell_id", "gene_id", "exprs")), ("major_cluster", cells, balanced_key_stats(labels, "label", "spelling", "one"))]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 6 % of all rows of their table."""
    out = None
    for field, table, stats in _p5(spark, d):
        name = F.col("mode_secondary") if field == "major_cluster" else F.col("key_value")
        part = stats.filter(F.col("n_rows") >= 0.06 * table.count()).select(F.lit(field).alias("field_name"), name.alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_key_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, usable values, sum and distinct genes of every cell of expr."""
    stats = _p5(spark, d)[0][2]
    return stats.select("key_value", "n_rows", "n_values", F.round("sum_value", 4).alias("sum_value"), F.col("n_secondary").alias("n_genes"), "mode_secondary", "mode_count")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Marker genes of every group of cells."""
    return suite.marker_genes(spark, d)


_KEY = "regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[-_\\s]', '_', 'g')".format(c="major_cluster")

_SQL = {
    "p5_found": f"""WITH k AS (SELECT {_KEY} AS k, trim(major_cluster) AS s, count(*) AS n FROM cells GROUP BY 1, 2), t AS (SELECT k, sum(n) AS n, arg_max(s, n) AS s FROM k WHERE k NOT IN ('', 'na', 'unknown', 'unassigned') GROUP BY 1)
SELECT 'cell_id' AS field_name, cell_id AS key_value FROM expr GROUP BY 2 HAVING cell_id IS NOT NULL AND count(*) >= 0.06 * (SELECT count(*) FROM expr)
UNION ALL SELECT 'major_cluster', s FROM t WHERE n >= 0.06 * (SELECT count(*) FROM cells)""",
    "p5_key_stats": """WITH g AS (SELECT cell_id, gene_id, count(*) AS n FROM expr GROUP BY 1, 2), m AS (SELECT cell_id, gene_id, n FROM g QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, gene_id NULLS FIRST) = 1),
s AS (SELECT cell_id, count(*) AS n_rows, count(*) FILTER (WHERE exprs IS NOT NULL AND NOT isnan(exprs) AND abs(exprs) < 'Infinity'::DOUBLE) AS n_values, coalesce(sum(exprs) FILTER (WHERE NOT isnan(exprs) AND abs(exprs) < 'Infinity'::DOUBLE), 0) AS s, count(DISTINCT gene_id) AS g FROM expr WHERE cell_id IS NOT NULL GROUP BY 1)
SELECT s.cell_id AS key_value, n_rows, n_values, round(s, 4) AS sum_value, g AS n_genes, gene_id AS mode_secondary, n AS mode_count FROM s JOIN m ON s.cell_id = m.cell_id""",
}


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_key_stats)} | suite.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | suite.SQL
