"""Queries of the analysis operators over the test tables, each with its SQL twin where SQL can express it.

Bindings: ``embeddings`` is the dense matrix (cell = vec_id, gene = position, group
= label, batch = vec_id % 3, data set = vec_id % 2); ``expr``, ``cells``, ``genes`` and
``gene_de_list`` are used as they are.  Doubles are rounded to six digits on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellorium.exprset import CELL, GENE, ExprSet, ids_of, names_of
from cellorium.operators import classify, cluster, de, groupstats, integrate, metrics, mixture, neighbors, reduce, relational, vgene
from cellorium.operators.labels import canonical_spellings, label_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias(CELL), F.col("embedding").cast("array<double>").alias("features"), F.concat(F.lit("C"), F.col("label")).alias("label"), (F.col("vec_id") % 3).alias("batch"), F.concat(F.lit("D0"), F.col("vec_id") % 2 + 1).alias("dataset_id"))


def _expr(spark: SparkSession, d: str) -> DataFrame:
    v = _vec(spark, d).select(CELL, "label", "batch", "dataset_id", F.posexplode("features").alias("i", "value"))
    return v.withColumn(GENE, F.concat(F.lit("G"), F.lpad(F.col("i").cast("string"), 4, "0"))).drop("i")


def _set(spark: SparkSession, d: str) -> ExprSet:
    v = _vec(spark, d)
    return ExprSet.from_array_column(v, CELL, "features", keep=("label", "batch", "dataset_id"))


def _r(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


E = """WITH e AS (SELECT vec_id AS cell_id, 'G' || lpad((i - 1)::VARCHAR, 4, '0') AS gene_id, embedding[i]::DOUBLE AS x, 'C' || label AS label, vec_id % 3 AS batch, 'D0' || (vec_id % 2 + 1) AS dataset_id
FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM embeddings))"""
LAB = "CASE WHEN {k} IN ('', 'na', 'unknown', 'unassigned') THEN NULL ELSE {k} END"


def _key(c: str) -> str:
    k = f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[-_\\s]', '_', 'g')"
    return LAB.format(k=k)


def _simpson(f: str, upto: str) -> str:
    """SQL of the integral of ``f`` (of u) from 0 to ``upto``, 6,000 steps."""
    return f"(({upto}) / 18000 * (SELECT sum((CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('{u}', f'(({upto}) * i / 6000)')})) FROM range(0, 6001) q(i)))"


def _beta_sql(a: str, b: str, x: str) -> str:
    """SQL of the regularised incomplete beta function."""
    return f"(exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b})) * 2 * {_simpson('pow(sin({u}), 2 * (' + a + ') - 1) * pow(cos({u}), 2 * (' + b + ') - 1)', f'asin(sqrt({x}))')})"


def _t_sql(t: str, k: str) -> str:
    return _beta_sql(f"({k}) / 2.0", "0.5", f"({k}) / (({k}) + ({t}) * ({t}))")


def _f_sql(f: str, d1: str, d2: str) -> str:
    return _beta_sql(f"({d2}) / 2.0", f"({d1}) / 2.0", f"({d2}) / (({d2}) + ({d1}) * ({f}))")


def _norm_sql(z: str) -> str:
    """SQL of the two-sided normal tail."""
    return f"greatest(1 - sqrt(2 / pi()) * {_simpson('exp(-{u} * {u} / 2)', f'least(abs({z}), 12)')}, 0)"


def _chi2_sql(x: str, k: str) -> str:
    return f"greatest(1 - exp((1 - ({k}) / 2.0) * ln(2) - lgamma(({k}) / 2.0)) * {_simpson('pow({u}, (' + k + ') - 1) * exp(-{u} * {u} / 2)', f'sqrt({x})')}, 0)"


def _bh_sql(table: str, p: str, out: str, family: str) -> str:
    """SQL: ``table`` with the Benjamini-Hochberg adjusted ``p`` inside ``family``."""
    part = f"PARTITION BY {family}" if family else ""
    ranks = f"SELECT *, rank() OVER ({part} ORDER BY {p}) + count(*) OVER (PARTITION BY {family + ', ' if family else ''}{p}) - 1 AS bh_rk, count(*) OVER ({part}) AS bh_n FROM {table}"
    return f"(SELECT * EXCLUDE (bh_rk, bh_n), least(1.0, min({p} * bh_n / bh_rk) OVER ({part} ORDER BY bh_rk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {out} FROM ({ranks}))"


def _near(*names: str) -> list:
    """Columns rounded to six digits after a nudge, as SQL does it with :func:`_near_sql`."""
    return [F.round(F.col(n) + 1e-11, 6).alias(n) for n in names]


def _near_sql(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-11, 6) AS {n}" for n in names)


# ---- reshaping, selection, ranking -------------------------------------------------


@query(f"{E} SELECT gene_id, cell_id, round(x, 6) + 0.0 AS value FROM e")
def expr_long(spark, d):
    return _set(spark, d).expr.select(GENE, CELL, _r("exprs", "value"))


@query(f"{E} SELECT gene_id, round(avg(x), 6) + 0.0 AS row_mean, round(stddev_samp(x), 6) + 0.0 AS row_sd FROM e GROUP BY 1")
def gene_sd_mean(spark, d):
    return groupstats.gene_moments(_expr(spark, d), "value").select(GENE, _r("row_mean", "row_mean"), _r("row_sd", "row_sd"))


@query(f"{E}, m AS (SELECT gene_id, stddev_samp(x) AS s FROM e GROUP BY 1) SELECT gene_id, round(s, 6) + 0.0 AS row_sd, row_number() OVER (ORDER BY s DESC, gene_id) <= 16 AS hvg_sd FROM m")
def hvg_sd(spark, d):
    return vgene.hvg_sd(_set(spark, d), 16).genes.select(GENE, _r("row_sd", "row_sd"), "hvg_sd")


@query(f"""{E}, m AS (SELECT gene_id, stddev_samp(x) AS s, avg(x) AS a FROM e GROUP BY 1), k AS (SELECT gene_id FROM m WHERE s > 0.12 AND a > 0 ORDER BY s DESC, gene_id LIMIT 10)
SELECT gene_id, gene_id IN (SELECT gene_id FROM k) AS hvg_mean_sd FROM m""")
def hvg_mean_sd(spark, d):
    return vgene.hvg_mean_sd(_set(spark, d), 10, least_sd=0.12, least_mean=0.0).genes.select(GENE, "hvg_mean_sd")


@query()
def trend_var(spark, d):
    return vgene.trend_var(_set(spark, d), mean_min=-1.0, assay="exprs").meta["trend_var"].select(GENE, "row_mean", "total_var", "trend_var", "p_value", "fdr")


#: One value for a gene and cell of the sparse table: the mean of its usable measurements; absent pairs are zeros.
_ONE = "(SELECT gene_id, cell_id, avg(exprs) FILTER (WHERE NOT isnan(exprs) AND exprs >= 0 AND exprs < 100) AS x FROM expr GROUP BY 1, 2)"


def _one(spark, d) -> tuple[DataFrame, int]:
    e = _t(spark, d, "expr")
    x = F.when(~F.isnan("exprs") & (F.col("exprs") >= 0) & (F.col("exprs") < 100), F.col("exprs"))
    return e.groupBy(GENE, CELL).agg(F.avg(x).alias("x")), e.select(CELL).distinct().count()


@query(f"SELECT gene_id FROM {_ONE} GROUP BY 1 HAVING count(x) = count(*) AND (min(x) < max(x) OR (max(x) <> 0 AND count(*) < (SELECT count(DISTINCT cell_id) FROM expr)))")
def drop_zero_var(spark, d):
    x, n = _one(spark, d)
    return groupstats.drop_flat_genes(x, "x", n_cells=n)


@query(f"SELECT gene_id, count(*) FILTER (WHERE x > 0) AS n_pos, (SELECT count(DISTINCT cell_id) FROM expr) AS n_cells FROM {_ONE} GROUP BY 1 HAVING count(*) FILTER (WHERE x > 0) > 5 AND count(*) FILTER (WHERE x > 0) / (SELECT count(DISTINCT cell_id) FROM expr) > 0.01")
def expressed_filter(spark, d):
    x, n = _one(spark, d)
    return groupstats.expressed_genes(x, "x", n_cells=n)


@query(f"""WITH c AS (SELECT cell_id, max(loaded_at) AS t FROM cells GROUP BY 1), k AS (SELECT cell_id, max(batch) AS batch FROM cells JOIN c USING (cell_id) WHERE loaded_at = t AND batch IS NOT NULL GROUP BY 1), n AS (SELECT batch, count(*) AS size FROM k GROUP BY 1),
x AS (SELECT gene_id, batch, sum(x) AS s, sum(x * x) AS q, count(*) FILTER (WHERE x IS NULL) AS bad, count(*) FILTER (WHERE x > 1) AS over FROM {_ONE} JOIN k USING (cell_id) GROUP BY 1, 2), g AS (SELECT DISTINCT gene_id FROM x),
y AS (SELECT g.gene_id, n.batch, size - coalesce(bad, 0) AS length, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(over, 0) AS over FROM g CROSS JOIN n LEFT JOIN x ON x.gene_id = g.gene_id AND x.batch = n.batch)
SELECT gene_id, batch, round(s / length + 1e-11, 6) AS mean, round(sqrt(greatest((q - s * s / length) / (length - 1), 0)) + 1e-11, 6) AS sd, length, round(over / length + 1e-11, 6) AS freq FROM y""")
def sparse_group_stats(spark, d):
    """Mean, sd and share over 1 of every gene and batch of the sparse table, zeros included."""
    x, _ = _one(spark, d)
    cells = relational.latest_per_key(_t(spark, d, "cells"), [CELL], "loaded_at", ["batch"]).select(CELL, "batch")
    return groupstats.sparse_group_stats(x, "x", cells, "batch", 1.0).select(GENE, "batch", *[_r(F.col(c) + 1e-11, c) for c in ("mean", "sd", "freq")], "length")


@query("SELECT cell_id, round(stddev_samp(CASE WHEN isnan(exprs) THEN NULL ELSE exprs END), 6) + 0.0 AS cell_sd FROM expr GROUP BY 1")
def cell_sd(spark, d):
    return groupstats.cell_sd(_t(spark, d, "expr"), "exprs").select(CELL, _r("cell_sd", "cell_sd"))


@query(f"{E} SELECT gene_id FROM e GROUP BY 1 HAVING stddev_samp(x) FILTER (WHERE batch = 0) > 0 AND stddev_samp(x) FILTER (WHERE batch <> 0) > 0")
def varying_in_both(spark, d):
    return groupstats.genes_varying_in_both(_expr(spark, d).withColumn("tr", F.col("batch") == 0), "value", "tr")


@query("WITH x AS (SELECT gene_id, cell_id, exprs AS v FROM expr WHERE exprs IS NOT NULL AND NOT isnan(exprs) AND exprs > 0 AND exprs < 100), n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT cell_id FROM x)), m AS (SELECT gene_id, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1) SELECT gene_id, round(s / n, 6) + 0.0 AS row_mean, round(sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0.0)), 6) + 0.0 AS row_sd FROM m, n")
def sparse_moments(spark, d):
    x = _t(spark, d, "expr").filter(relational.finite(F.col("exprs")) & (F.col("exprs") > 0) & (F.col("exprs") < 100))
    n = x.select(CELL).distinct().count()
    return groupstats.sparse_gene_moments(x, "exprs", n).select(GENE, _r("row_mean", "row_mean"), _r("row_sd", "row_sd"))


@query(f"{E} SELECT gene_id, cell_id, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0 AS z FROM e WINDOW w AS (PARTITION BY gene_id)")
def zscore_gene(spark, d):
    return relational.zscore(_expr(spark, d), [GENE], "value").select(GENE, CELL, _r("z", "z"))


@query(f"{E} SELECT gene_id, cell_id, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0 AS z FROM e WINDOW w AS (PARTITION BY gene_id, batch = 0)")
def zscore_split(spark, d):
    return relational.zscore(_expr(spark, d).withColumn("tr", F.col("batch") == 0), [GENE, "tr"], "value").select(GENE, CELL, _r("z", "z"))


_FIN = "exprs IS NOT NULL AND NOT isnan(exprs) AND abs(exprs) < 'Infinity'::DOUBLE"


@query(f"SELECT gene_id, cell_id, exprs, CAST(rank() OVER (PARTITION BY gene_id ORDER BY exprs) + (count(*) OVER (PARTITION BY gene_id, exprs) - 1) / 2.0 AS DOUBLE) AS mid_rank FROM expr WHERE {_FIN}")
def midrank(spark, d):
    x = _t(spark, d, "expr").filter(relational.finite(F.col("exprs"))).select(GENE, CELL, "exprs")
    return relational.midrank(x, [GENE], "exprs").select(GENE, CELL, "exprs", F.col("mid_rank").cast("double").alias("mid_rank"))


_DE = "(SELECT * FROM gene_de_list WHERE auc IS NOT NULL AND NOT isnan(auc) AND abs(auc) < 'Infinity'::DOUBLE)"


@query(f"SELECT cluster_id, gene_id, auc, round((rank() OVER (PARTITION BY cluster_id ORDER BY auc DESC) + (count(*) OVER (PARTITION BY cluster_id, auc) - 1) / 2.0) / count(*) OVER (PARTITION BY cluster_id), 6) + 0.0 AS frac_rank FROM {_DE}")
def frac_rank(spark, d):
    x = _t(spark, d, "gene_de_list").filter(relational.finite(F.col("auc")))
    return relational.fractional_rank(x, ["cluster_id"], "auc").select("cluster_id", GENE, "auc", _r("frac_rank", "frac_rank"))


@query("""WITH a AS (SELECT cluster_id, gene_id, score_p_value AS p, count(*) OVER (PARTITION BY cluster_id) AS n, rank() OVER (PARTITION BY cluster_id ORDER BY score_p_value) + count(*) OVER (PARTITION BY cluster_id, score_p_value) - 1 AS rk
FROM gene_de_list WHERE score_p_value IS NOT NULL AND NOT isnan(score_p_value))
SELECT cluster_id, gene_id, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * n / rk) OVER (PARTITION BY cluster_id ORDER BY rk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + 1e-11, 6) + 0.0 AS p_adj FROM a""")
def bh_adjust(spark, d):
    x = _t(spark, d, "gene_de_list").filter(relational.finite(F.col("score_p_value")))
    return relational.bh_adjust(x, "score_p_value", ["cluster_id"]).select("cluster_id", GENE, _r("score_p_value", "p"), _r(F.col("p_adj") + 1e-11, "p_adj"))


@query("SELECT gene_id, sum(n)::BIGINT AS n FROM (SELECT gene_id, count(*) AS n FROM expr GROUP BY 1) GROUP BY 1 ORDER BY n DESC, gene_id LIMIT 20")
def topk_global(spark, d):
    return relational.top_k(_t(spark, d, "expr").groupBy(GENE).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc(GENE)], 20)


@query(f"SELECT cluster_id, gene_id, auc FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY auc DESC, gene_id, dataset_id, loaded_at) AS rn FROM {_DE}) WHERE rn <= 5")
def topk_per_group(spark, d):
    x = _t(spark, d, "gene_de_list").filter(relational.finite(F.col("auc")))
    return relational.top_k_per_group(x, ["cluster_id"], [F.desc("auc"), F.asc(GENE), F.asc("dataset_id"), F.asc("loaded_at")], 5).select("cluster_id", GENE, "auc")


@query("SELECT gene_id, min(cluster_id) AS cluster_id FROM gene_de_list GROUP BY 1")
def dedup_first(spark, d):
    return relational.dedup_first(_t(spark, d, "gene_de_list"), [GENE], [F.asc("cluster_id")]).select(GENE, "cluster_id")


@query(f"""{E}, r AS (SELECT cell_id, gene_id, x, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, gene_id) AS rn FROM e)
SELECT cell_id, max(CASE WHEN rn = 1 THEN gene_id END) AS predicted, max(CASE WHEN rn = 2 THEN gene_id END) AS second, round(max(CASE WHEN rn = 1 THEN x END), 6) + 0.0 AS prob, round(max(CASE WHEN rn = 2 THEN x END), 6) + 0.0 AS second_prob FROM r GROUP BY 1""")
def top2_label(spark, d):
    v = _vec(spark, d).select(CELL, F.col("features").alias("p"))
    t = classify.top_two(v, [f"G{i:04d}" for i in range(64)])
    return t.select(CELL, "predicted", "second", _r("prob", "prob"), _r("second_prob", "second_prob"))


@query("SELECT cell_id FROM (SELECT cell_id, row_number() OVER (PARTITION BY dataset_id ORDER BY md5(cell_id || ':9999'), cell_id) AS rn FROM (SELECT DISTINCT cell_id, dataset_id FROM cells WHERE dataset_id IS NOT NULL)) WHERE rn <= 20")
def downsample_per_group(spark, d):
    c = _t(spark, d, "cells").filter(F.col("dataset_id").isNotNull()).select(CELL, "dataset_id").distinct()
    return relational.downsample_per_group(c, ["dataset_id"], CELL, 20).select(CELL)


@query("WITH n AS (SELECT floor(count(*) * 0.2)::BIGINT AS k FROM embeddings) SELECT vec_id AS cell_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || ':1'), vec_id) <= k AS is_train FROM embeddings, n")
def train_pred_split(spark, d):
    return relational.split_sample(_vec(spark, d).select(CELL), CELL, 0.2, 1)


@query("SELECT gene_id FROM (SELECT DISTINCT gene_id, dataset_id FROM gene_de_list) GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(DISTINCT dataset_id) AS c FROM gene_de_list GROUP BY gene_id))")
def common_genes(spark, d):
    x = _t(spark, d, "gene_de_list")
    k = x.select(GENE, "dataset_id").distinct().groupBy(GENE).count().agg(F.max("count")).first()[0] or 0
    return relational.common_keys(x, GENE, "dataset_id", k)


@query("SELECT g.gene_id FROM genes g WHERE g.gene_id NOT IN (SELECT gene_id FROM gene_de_list WHERE gene_id IS NOT NULL)")
def anti_subset(spark, d):
    return relational.anti_subset(_t(spark, d, "genes"), _t(spark, d, "gene_de_list"), GENE).select(GENE)


@query("SELECT g.gene_id, g.gene_idx::BIGINT AS gene_idx FROM genes g WHERE g.gene_id IN (SELECT gene_id FROM gene_de_list)")
def semi_subset(spark, d):
    return relational.subset(_t(spark, d, "genes"), _t(spark, d, "gene_de_list"), GENE).select(GENE, F.col("gene_idx").cast("long").alias("gene_idx"))


@query(f"{E}, q AS (SELECT * FROM e WHERE gene_id >= 'G0008' UNION ALL SELECT c.vec_id, g.g, 0.0, NULL, NULL, NULL FROM embeddings c, (SELECT 'G' || lpad(i::VARCHAR, 4, '0') AS g FROM range(64, 68) t(i)) g) SELECT gene_id, cell_id, round(x, 6) + 0.0 AS value FROM q")
def pad_missing(spark, d):
    e = _expr(spark, d)
    need = spark.createDataFrame([(f"G{i:04d}",) for i in range(8, 68)], f"{GENE} string")
    return relational.pad_missing(e, need, GENE, e.select(CELL).distinct(), CELL, "value").select(GENE, CELL, _r("value", "value"))


@query("SELECT g.gene_id, x.dataset_id, coalesce(n, 0)::DOUBLE AS n FROM genes g CROSS JOIN (SELECT DISTINCT dataset_id FROM gene_de_list) x LEFT JOIN (SELECT gene_id, dataset_id, count(*)::DOUBLE AS n FROM gene_de_list GROUP BY 1, 2) c ON c.gene_id = g.gene_id AND c.dataset_id = x.dataset_id")
def complete_grid(spark, d):
    x = _t(spark, d, "gene_de_list")
    n = x.groupBy(GENE, "dataset_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return relational.complete_grid(n, _t(spark, d, "genes"), GENE, x, "dataset_id", "n", 0.0)


_CUR = "(SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells)"


@query(f"SELECT cell_id, dataset_id, {_key('major_cluster')} AS label FROM {_CUR} WHERE rn = 1")
def current_cells(spark, d):
    c = relational.latest_per_key(_t(spark, d, "cells"), [CELL], "loaded_at", ["dataset_id", "major_cluster"])
    return c.select(CELL, "dataset_id", label_key(F.col("major_cluster")).alias("label"))


@query(f"WITH n AS (SELECT {_key('cell_type1')} AS label_key, regexp_replace(cell_type1, '^\\s+|\\s+$', '', 'g') AS canonical, count(*) AS n FROM cells GROUP BY 1, 2) SELECT label_key, canonical FROM n WHERE label_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY n DESC, canonical) = 1")
def canonical_labels(spark, d):
    return canonical_spellings(_t(spark, d, "cells"), "cell_type1")


@query("WITH f AS (SELECT display_name, arg_min(gene_id, gene_idx) AS gene_id FROM genes WHERE display_name IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT gene_symbol AS name FROM gene_de_list) SELECT name, gene_id FROM n LEFT JOIN f ON name = display_name")
def names_to_ids(spark, d):
    n = _t(spark, d, "gene_de_list").select(F.col("gene_symbol").alias("name")).distinct()
    return ids_of(n, "name", _t(spark, d, "genes"))


@query("SELECT DISTINCT x.gene_id, coalesce(display_name, x.gene_id) AS display_name FROM gene_de_list x LEFT JOIN genes USING (gene_id)")
def ids_to_names(spark, d):
    return names_of(_t(spark, d, "gene_de_list").select(GENE).distinct(), _t(spark, d, "genes"))


@query("WITH a AS (SELECT gene_id, gene_symbol, count(*) AS n FROM gene_de_list GROUP BY 1, 2), b AS (SELECT gene_id, gene_symbol, max(f_rank) AS top FROM gene_de_list WHERE NOT isnan(f_rank) GROUP BY 1, 2) SELECT a.gene_id, a.gene_symbol, n, round(top, 6) + 0.0 AS top FROM a JOIN b ON a.gene_id = b.gene_id AND a.gene_symbol IS NOT DISTINCT FROM b.gene_symbol")
def natural_join(spark, d):
    x = _t(spark, d, "gene_de_list")
    a = x.groupBy(GENE, "gene_symbol").agg(F.count(F.lit(1)).alias("n"))
    b = x.filter(~F.isnan("f_rank")).groupBy(GENE, "gene_symbol").agg(F.max("f_rank").alias("top"))
    return relational.null_safe_join(a, b, [GENE, "gene_symbol"]).select(GENE, "gene_symbol", "n", _r("top", "top"))


@query("SELECT vec_id AS cell_id, CASE WHEN vec_id % 5 = 0 THEN 'new' || (vec_id % 3) ELSE 'C' || label END AS label FROM embeddings")
def scatter_labels(spark, d):
    v = _vec(spark, d).select(CELL, "label", "batch")
    return relational.scatter(v.select(CELL, "label"), v.filter(F.col(CELL) % 5 == 0).select(CELL, F.concat(F.lit("new"), "batch").alias("label")), CELL, "label")


@query("SELECT g.gene_id, g.gene_idx::BIGINT AS gene_idx, coalesce(n, 0) AS n FROM genes g LEFT JOIN (SELECT gene_id, count(*) AS n FROM gene_de_list GROUP BY 1) x USING (gene_id)")
def keyed_reorder(spark, d):
    n = _t(spark, d, "gene_de_list").groupBy(GENE).agg(F.count(F.lit(1)).alias("n"))
    return relational.reorder(n, _t(spark, d, "genes"), GENE, "gene_idx").select(GENE, F.col("gene_idx").cast("long").alias("gene_idx"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT cell_id, dataset_id, patient, NULL::DOUBLE AS exprs FROM cells UNION ALL SELECT cell_id, dataset_id, NULL, exprs FROM expr WHERE NOT isnan(exprs) AND exprs > 5")
def union_filled(spark, d):
    x = _t(spark, d, "expr").filter(~F.isnan("exprs") & (F.col("exprs") > 5)).select(CELL, "dataset_id", "exprs")
    return relational.union_filled([_t(spark, d, "cells").select(CELL, "dataset_id", "patient"), x]).select(CELL, "dataset_id", "patient", "exprs")


@query(f"{E} SELECT gene_id, dataset_id, " + ", ".join(f"round(avg(x) FILTER (WHERE label = 'C{i}'), 6) + 0.0 AS C{i}" for i in range(10)) + " FROM e GROUP BY 1, 2")
def melt_dcast(spark, d):
    w = relational.group_average_wide(_expr(spark, d), [GENE, "dataset_id"], "label", "value", [f"C{i}" for i in range(10)])
    return w.select(GENE, "dataset_id", *[_r(f"C{i}", f"C{i}") for i in range(10)])


@query("SELECT m.mouse AS gene_id, x.cell_id, CASE WHEN isnan(x.exprs) THEN NULL ELSE x.exprs END AS exprs FROM expr x RIGHT JOIN (SELECT gene_id, 'm' || gene_id AS mouse FROM genes WHERE gene_idx % 3 = 0) m USING (gene_id)")
def ortholog_map(spark, d):
    from cellorium.sources.tables import map_orthologs

    m = _t(spark, d, "genes").select(F.col(GENE).alias("human"), F.concat(F.lit("m"), GENE).alias("mouse"), F.when(F.col("gene_idx") % 3 == 0, "ortholog_one2one").otherwise("ortholog_one2many").alias("orthology_type"), F.lit(1).alias("orthology_confidence"))
    return map_orthologs(_t(spark, d, "expr").select(GENE, CELL, "exprs"), m, "human", "mouse", keep_all=True).select(GENE, CELL, "exprs")


# ---- group statistics ---------------------------------------------------------------


@query(f"{E} SELECT gene_id, label, round(avg(x), 6) + 0.0 AS avg, round(stddev_samp(x), 6) + 0.0 AS sd, count(x) AS n FROM e GROUP BY 1, 2")
def group_mean_sd(spark, d):
    return groupstats.group_mean_sd(_expr(spark, d), "value", "label").select(GENE, "label", _r("avg", "avg"), _r("sd", "sd"), "n")


@query(f"{E} SELECT gene_id, " + ", ".join(f"round(avg(x) FILTER (WHERE label = 'C{i}'), 6) + 0.0 AS avg_C{i}" for i in range(10)) + " FROM e GROUP BY 1")
def group_mean_wide(spark, d):
    m = groupstats.group_mean_sd(_expr(spark, d), "value", "label")
    w = groupstats.widen(m, [GENE], "label", [f"C{i}" for i in range(10)], {"avg": "avg"})
    return w.select(GENE, *[_r(F.col(f"`avg.C{i}`"), f"avg_C{i}") for i in range(10)])


@query(f"{E} SELECT gene_id, label, round(avg((x > 0)::INT), 6) + 0.0 AS hi_frac FROM e GROUP BY 1, 2")
def expressed_fraction(spark, d):
    e = _expr(spark, d).withColumn("b", (F.col("value") > 0).cast("int"))
    return groupstats.expressed_fraction(e, "b", "label").select(GENE, "label", _r("hi_frac", "hi_frac"))


@query(f"{E} SELECT gene_id, label, round(avg(x) FILTER (WHERE x > 0.2), 6) + 0.0 AS avg_hi_expr FROM e GROUP BY 1, 2")
def hi_expressor_mean(spark, d):
    e = _expr(spark, d).withColumn("b", (F.col("value") > 0.2).cast("int"))
    return groupstats.hi_expressor_mean(e, "b", "value", "label").select(GENE, "label", _r("avg_hi_expr", "avg_hi_expr"))


@query(f"{E} SELECT gene_id, label, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS sd, count(x) AS length, round(avg((x > 0.1)::INT), 6) + 0.0 AS freq FROM e GROUP BY 1, 2")
def group_stats_freq(spark, d):
    return groupstats.group_stats(_expr(spark, d), "value", "label", 0.1).select(GENE, "label", _r("mean", "mean"), _r("sd", "sd"), "length", _r("freq", "freq"))


@query(f"SELECT {_key('major_cluster')} AS label, dataset_id, count(*) AS n FROM cells GROUP BY 1, 2")
def group_counts(spark, d):
    return _t(spark, d, "cells").groupBy(label_key(F.col("major_cluster")).alias("label"), "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_key('major_cluster')} AS a, {_key('cell_type1')} AS b, count(*) AS n FROM cells GROUP BY 1, 2")
def confusion(spark, d):
    c = _t(spark, d, "cells").select(label_key(F.col("major_cluster")).alias("a"), label_key(F.col("cell_type1")).alias("b"))
    return groupstats.confusion(c, "a", "b")


@query("WITH p AS (SELECT 'C' || label AS a, 'C' || CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS b FROM embeddings) SELECT a, round(avg((a <> b)::INT), 6) + 0.0 AS error_rate, count(*) AS n FROM p GROUP BY GROUPING SETS ((a), ())")
def error_rate(spark, d):
    e = _t(spark, d, "embeddings")
    p = e.select(F.concat(F.lit("C"), "label").alias("a"), F.concat(F.lit("C"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).alias("b"))
    return groupstats.error_rates(p, "a", "b").select("a", _r("error_rate", "error_rate"), "n")


_ST = "(SELECT regexp_replace(cluster_id, '^.+?\\.', '') AS meta_cluster, gene_id, dataset_id, auc, score_p_value AS p, f_rank, substr(dataset_id, 2)::BIGINT * 2 + (cluster_id LIKE 'POOL.%')::INT AS ord, row_number() OVER (PARTITION BY dataset_id, cluster_id, gene_id ORDER BY loaded_at DESC, auc DESC NULLS LAST, score_p_value DESC NULLS LAST, f_rank DESC NULLS LAST) AS rn FROM gene_de_list)"


def _study(spark, d) -> DataFrame:
    """Current marker rows as studies: meta-cluster (the part after the data set), gene, data set."""
    x = relational.latest_per_key(_t(spark, d, "gene_de_list"), ["dataset_id", "cluster_id", GENE], "loaded_at", ["auc", "score_p_value", "f_rank"])
    x = x.withColumn("meta_cluster", F.regexp_replace("cluster_id", r"^.+?\.", "")).withColumn("no", F.substring("dataset_id", 2, 9).cast("long"))
    return x.withColumn("ord", F.col("no") * 2 + F.col("cluster_id").startswith("POOL.").cast("long"))


@query(f"WITH s AS (SELECT * FROM {_ST} WHERE rn = 1 AND auc IS NOT NULL AND NOT isnan(auc)) SELECT meta_cluster, gene_id, auc, p AS score_p_value FROM s QUALIFY row_number() OVER (PARTITION BY meta_cluster, gene_id ORDER BY auc DESC, ord) = 1")
def argmax_companion(spark, d):
    return relational.max_companion(_study(spark, d), ["meta_cluster", GENE], "auc", ["score_p_value"], "ord")


@query(f"SELECT meta_cluster, gene_id, round(median(CASE WHEN isnan(f_rank) THEN NULL ELSE f_rank END), 6) + 0.0 AS median_rank FROM {_ST} WHERE rn = 1 GROUP BY 1, 2")
def study_median(spark, d):
    return _study(spark, d).groupBy("meta_cluster", GENE).agg(_r(F.median(relational.nan_to_null(F.col("f_rank"))), "median_rank"))


@query(f"SELECT meta_cluster, gene_id, round(sum(f_rank * w) / sum(CASE WHEN f_rank IS NOT NULL THEN w END) + 1e-11, 6) + 0.0 AS pooled FROM (SELECT *, 1.0 + (substr(dataset_id, 2)::BIGINT % 5) AS w FROM {_ST} WHERE rn = 1) GROUP BY 1, 2")
def weighted_pool(spark, d):
    s = _study(spark, d).withColumn("w", 1.0 + F.col("no") % 5)
    return s.groupBy("meta_cluster", GENE).agg(_r(groupstats.weighted_mean("f_rank", "w") + 1e-11, "pooled"))


@query("SELECT gene_id, count(DISTINCT dataset_id) AS n_sources FROM gene_de_list GROUP BY 1 HAVING count(DISTINCT dataset_id) >= 0.3 * (SELECT count(DISTINCT dataset_id) FROM gene_de_list)")
def occurrence(spark, d):
    return groupstats.occurrence(_t(spark, d, "gene_de_list"), GENE, "dataset_id", 0.3)


@query("""WITH r AS (SELECT gene_id, dataset_id, min(f_rank) AS f FROM gene_de_list GROUP BY 1, 2), x AS (SELECT DISTINCT dataset_id FROM gene_de_list)
SELECT g.gene_id, round(median(coalesce(r.f, 1.0)), 6) + 0.0 AS median_rank FROM (SELECT DISTINCT gene_id FROM genes) g CROSS JOIN x LEFT JOIN r ON r.gene_id = g.gene_id AND r.dataset_id = x.dataset_id GROUP BY 1""")
def rank_median_fill(spark, d):
    r = _t(spark, d, "gene_de_list").groupBy(GENE, "dataset_id").agg(F.min("f_rank").alias("f_rank"))
    return groupstats.median_rank_filled(r, _t(spark, d, "genes"), GENE, "dataset_id", "f_rank").select(GENE, _r("median_rank", "median_rank"))


@query(f"{E} SELECT dataset_id, gene_id, label, round(avg(x), 6) + 0.0 AS avg FROM e GROUP BY 1, 2, 3")
def pseudobulk_mean(spark, d):
    return groupstats.pseudobulk(_expr(spark, d), "value", ["dataset_id", "label"], "mean", over=["dataset_id"]).select("dataset_id", GENE, "label", _r("avg", "avg"))


@query(f"{E}, z AS (SELECT *, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY dataset_id, gene_id)) SELECT dataset_id, gene_id, label, round(avg(z), 6) + 0.0 AS avg FROM z GROUP BY 1, 2, 3")
def pseudobulk_zscore(spark, d):
    return groupstats.pseudobulk(_expr(spark, d), "value", ["dataset_id", "label"], "zscore", over=["dataset_id"]).select("dataset_id", GENE, "label", _r("avg", "avg"))


@query(f"{E}, b AS (SELECT gene_id, dataset_id || '.' || label AS c, avg(x) AS a FROM e GROUP BY 1, 2) SELECT p.c AS cell_a, q.c AS cell_b, round(corr(p.a, q.a), 6) + 0.0 AS r FROM b p JOIN b q ON p.gene_id = q.gene_id AND p.c <= q.c GROUP BY 1, 2")
def pseudobulk_corr(spark, d):
    b = groupstats.pseudobulk(_expr(spark, d), "value", ["dataset_id", "label"], "mean", over=["dataset_id"]).withColumn(CELL, F.concat_ws(".", "dataset_id", "label"))
    return integrate.column_correlations(b, "avg").select("cell_a", "cell_b", _r("r", "r"))


@query(f"{E} SELECT gene_id, cell_id, round(x - avg(x) OVER (PARTITION BY gene_id, batch) + avg(x) OVER (PARTITION BY gene_id), 6) + 0.0 AS value FROM e")
def batch_removed(spark, d):
    return groupstats.remove_batch_effect(_expr(spark, d), "value", "batch", "adj").select(GENE, CELL, _r("adj", "value"))


def _sig(spark) -> DataFrame:
    return spark.createDataFrame([(f"M{i % 8}", f"G{i:04d}") for i in range(48)], f"meta_cluster string, {GENE} string")


_Z = f"{E}, z AS (SELECT *, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY gene_id)), s AS (SELECT 'M' || (i % 8) AS meta_cluster, 'G' || lpad(i::VARCHAR, 4, '0') AS gene_id FROM range(48) t(i))"


@query(f"{_Z}, a AS (SELECT cell_id, sum(z) AS s, count(z) AS n FROM z GROUP BY 1) SELECT z.cell_id, meta_cluster, round(sum(z) / count(z) - (any_value(a.s) - sum(z)) / (any_value(a.n) - count(z)), 6) + 0.0 AS score FROM z JOIN s USING (gene_id) JOIN a ON a.cell_id = z.cell_id GROUP BY 1, 2")
def module_score(spark, d):
    return groupstats.module_score(_expr(spark, d), "value", _sig(spark)).select(CELL, "meta_cluster", _r("score", "score"))


# ---- tests --------------------------------------------------------------------------


@query(f"""{E}, m AS (SELECT gene_id, label, count(*) AS n, avg(x) AS m, coalesce(var_samp(x) * (count(*) - 1), 0) AS ss FROM e GROUP BY 1, 2), g AS (SELECT gene_id, sum(n * m) / sum(n) AS gm, sum(n) AS nt, count(*) AS k FROM m GROUP BY 1)
SELECT gene_id, round((sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (sum(ss) / (any_value(nt) - any_value(k))), 6) + 0.0 AS f_stat FROM m JOIN g USING (gene_id) GROUP BY 1""")
def aov_f(spark, d):
    return de.aov_f(_expr(spark, d), "value", "label").select(GENE, _r("f_stat", "f_stat"))


_F = f"""{E}, m AS (SELECT gene_id, label, count(*) AS n, avg(x) AS m, coalesce(var_samp(x) * (count(*) - 1), 0) AS ss FROM e GROUP BY 1, 2), g AS (SELECT gene_id, sum(n * m) / sum(n) AS gm, sum(n)::DOUBLE AS nt, count(*)::DOUBLE AS k FROM m GROUP BY 1),
f AS (SELECT gene_id, any_value(k) AS k, any_value(nt) AS nt, sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1) / (sum(ss) / (any_value(nt) - any_value(k))) AS f_stat FROM m JOIN g USING (gene_id) GROUP BY 1)"""


@query(f"{_F}, p AS (SELECT *, {_f_sql('f_stat', 'k - 1', 'nt - k')} AS f_pvalue FROM f) SELECT gene_id, {_near_sql('f_pvalue', 'f_adjp')} FROM {_bh_sql('p', 'f_pvalue', 'f_adjp', '')}")
def aov_p(spark, d):
    return relational.bh_adjust(de.aov(_expr(spark, d), "value", "label"), "f_pvalue", out="f_adjp").select(GENE, *_near("f_pvalue", "f_adjp"))


#: Studentized range: the range of ten normals on a grid of 0.01, then the mean over the scaled chi of 200 steps; pairs with p_adj are in ``tk``.
_TUKEY = f"""{_F}, z AS (SELECT gi AS i, -8 + gi * 0.01 AS z, 0.5 + sign(gi - 800) * (1 - ({_norm_sql('-8 + gi * 0.01')})) / 2 AS cdf FROM range(0, 2801) g(gi)), rg AS (SELECT j, 10 * sum((CASE WHEN a.i IN (0, 1600) THEN 1 WHEN a.i % 8 = 4 THEN 4 ELSE 2 END) * 0.04 / 3 * exp(-a.z * a.z / 2) / sqrt(2 * pi()) * pow(b.cdf - a.cdf, 9)) AS r
FROM (SELECT * FROM z WHERE i <= 1600 AND i % 4 = 0) a CROSS JOIN range(0, 1201) w(j) JOIN z b ON b.i = a.i + j GROUP BY 1),
pr AS (SELECT a.gene_id, a.label AS g_low, b.label AS g_high, b.m - a.m AS diff, a.n AS n_low, b.n AS n_high, e.mse, e.df, abs(b.m - a.m) / sqrt(e.mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q FROM m a JOIN m b ON a.gene_id = b.gene_id AND a.label < b.label JOIN (SELECT gene_id, sum(ss) / (any_value(nt) - any_value(k)) AS mse, any_value(nt) - any_value(k) AS df FROM m JOIN g USING (gene_id) GROUP BY 1) e ON e.gene_id = a.gene_id),
sg AS (SELECT i, 1 + (i - 100) * 0.09 / sqrt(2 * df) AS s, df, (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.09 / sqrt(2 * df) / 3 AS w FROM range(0, 201) g(i), (SELECT DISTINCT df FROM pr)), sd AS (SELECT df, s, w * exp(ln(2) + df / 2 * ln(df / 2) - lgamma(df / 2) + (df - 1) * ln(s) - df * s * s / 2) AS w FROM sg),
tk AS (SELECT gene_id, g_low, g_high, any_value(diff) AS diff, any_value(n_low) AS n_low, any_value(n_high) AS n_high, least(greatest(1 - sum(w * r * CASE h WHEN -1 THEN -f * (f - 1) * (f - 2) / 6 WHEN 0 THEN (f + 1) * (f - 1) * (f - 2) / 2 WHEN 1 THEN -(f + 1) * f * (f - 2) / 2 ELSE (f + 1) * f * (f - 1) / 6 END), 0), 1) AS p_adj
FROM (SELECT pr.*, w, h, greatest(floor(q * s * 100), 1) + h AS j, q * s * 100 - greatest(floor(q * s * 100), 1) AS f FROM pr JOIN sd ON sd.df = pr.df CROSS JOIN range(-1, 3) x(h)) JOIN rg USING (j) GROUP BY 1, 2, 3)"""
_TABLE = f"""{_TUKEY}, fa AS (SELECT * FROM {_bh_sql(f"(SELECT *, {_f_sql('f_stat', 'k - 1', 'nt - k')} AS f_pvalue FROM f)", 'f_pvalue', 'f_adjp', '')}),
kr AS (SELECT gene_id, label, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene_id, x) AS t FROM e), kg AS (SELECT gene_id, label, count(*)::DOUBLE AS n, sum(r) AS s, sum(t * t - 1)::DOUBLE AS ties FROM kr GROUP BY 1, 2),
kh AS (SELECT gene_id, count(*)::DOUBLE AS k, sum(ties) AS ties, sum(n) AS nt, (12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - sum(ties) / (sum(n) * sum(n) * sum(n) - sum(n))) AS h_stat FROM kg GROUP BY 1), ka AS (SELECT * FROM {_bh_sql(f"(SELECT *, {_chi2_sql('h_stat', 'k - 1')} AS kruskal_pvalue FROM kh)", 'kruskal_pvalue', 'kruskal_adjp', '')}),
bp AS (SELECT gene_id, p_adj AS min_padj, diff AS min_padj_diff, g_high || '-' || g_low AS min_padj_cmp FROM tk QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY p_adj, abs(diff) DESC, g_low, g_high) = 1),
tp AS (SELECT gene_id, max(CASE WHEN rn = 1 THEN label END) AS g1, max(CASE WHEN rn = 2 THEN label END) AS g2 FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY m DESC, label) AS rn FROM m) GROUP BY 1),
td AS (SELECT tk.gene_id, p_adj AS min_diff_padj, diff AS min_diff, g_high || '-' || g_low AS min_diff_cmp FROM tk JOIN tp ON tp.gene_id = tk.gene_id AND g_low = least(g1, g2) AND g_high = greatest(g1, g2)),
tb AS (SELECT gene_id, f_stat, f_pvalue, f_adjp, h_stat, kruskal_pvalue, kruskal_adjp, min_padj, min_padj_diff, min_padj_cmp, min_diff_padj, min_diff, min_diff_cmp, f_adjp < 0.01 AND min_padj < 0.01 AND abs(min_padj_diff) >= 0.01 AS significant FROM fa JOIN ka USING (gene_id) JOIN bp USING (gene_id) JOIN td USING (gene_id))"""
_TABLE_COLS = ("f_stat", "f_pvalue", "f_adjp", "h_stat", "kruskal_pvalue", "kruskal_adjp", "min_padj_diff", "min_diff")


def _table_cols() -> list:
    return [*_near(*_TABLE_COLS), *[F.round(F.col(c) + 1e-11, 4).alias(c) for c in ("min_padj", "min_diff_padj")], "min_padj_cmp", "min_diff_cmp", "significant"]


_TABLE_SQL = _near_sql(*_TABLE_COLS) + ", round(min_padj + 1e-11, 4) AS min_padj, round(min_diff_padj + 1e-11, 4) AS min_diff_padj, min_padj_cmp, min_diff_cmp, significant"


@query(f"""{_TABLE}, hf AS (SELECT gene_id, g_high AS g, p_adj, diff FROM tk UNION ALL SELECT gene_id, g_low, p_adj, -diff FROM tk), gs AS (SELECT gene_id, g, bool_and(p_adj < 0.01) AS sp, bool_and(diff > 0) AS up, bool_and(diff < 0) AS down FROM hf GROUP BY 1, 2),
sp AS (SELECT gene_id, count(*) FILTER (WHERE sp) = 1 AS is_specific, max(CASE WHEN sp THEN g END) AS g, max(CASE WHEN sp THEN CASE WHEN up THEN 'UP' WHEN down THEN 'DOWN' ELSE 'INCONSISTANT' END END) AS dir FROM gs GROUP BY 1)
SELECT gene_id, {_TABLE_SQL}, is_specific, CASE WHEN is_specific THEN g END AS label, CASE WHEN is_specific THEN dir END AS direction FROM tb JOIN sp USING (gene_id)""")
def aov_table(spark, d):
    return de.find_de_genes(_expr(spark, d), "value", "label", pair_diff=0.01, specific=True).select(GENE, *_table_cols(), "is_specific", "label", "direction")


#: Additive group + batch model of every gene by backfitting; rows are (gene, group, batch) with effects a and b.
_ADD = f"""WITH RECURSIVE {E[5:]}, c AS (SELECT gene_id, label, batch, count(*)::DOUBLE AS n, avg(x) AS m, coalesce(var_samp(x) * (count(*) - 1), 0) AS ss FROM e GROUP BY 1, 2, 3),
it AS (SELECT 0 AS step, *, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM c UNION ALL
SELECT step + 1, gene_id, label, batch, n, m, ss, a, sum(n * (m - a)) OVER (PARTITION BY gene_id, batch) / sum(n) OVER (PARTITION BY gene_id, batch) FROM
(SELECT step, gene_id, label, batch, n, m, ss, sum(n * (m - b)) OVER (PARTITION BY gene_id, label) / sum(n) OVER (PARTITION BY gene_id, label) AS a FROM it WHERE step < 60)), fit AS (SELECT * FROM it WHERE step = 60)"""


@query(f"""{_ADD}, g AS (SELECT gene_id, sum(n * m) / sum(n) AS gm, sum(n) AS nt, count(DISTINCT label)::DOUBLE AS k, count(DISTINCT batch)::DOUBLE AS nb FROM c GROUP BY 1), b AS (SELECT gene_id, label, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1, 2),
s AS (SELECT gene_id, sum(n * (m - gm) * (m - gm)) AS ssb FROM b JOIN g USING (gene_id) GROUP BY 1), r AS (SELECT gene_id, sum(ss + n * (m - a - b) * (m - a - b)) AS rss FROM fit GROUP BY 1),
y AS (SELECT gene_id, k, nt - k - nb + 1 AS df_residual, rss / (nt - k - nb + 1) AS mse, ssb / (k - 1) / (rss / (nt - k - nb + 1)) AS f_stat FROM g JOIN s USING (gene_id) JOIN r USING (gene_id)), z AS (SELECT *, {_f_sql('f_stat', 'k - 1', 'df_residual')} AS f_pvalue FROM y)
SELECT gene_id, {_near_sql('f_stat', 'f_pvalue', 'mse')}, df_residual FROM z""")
def aov_batch(spark, d):
    return de.aov_batch(_expr(spark, d), "value", "label", "batch").select(GENE, *_near("f_stat", "f_pvalue", "mse"), "df_residual")


@query(f"""{E}, r AS (SELECT gene_id, label, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene_id, x) AS t FROM e),
g AS (SELECT gene_id, label, count(*) AS n, sum(r) AS s, sum(t * t - 1) AS ties FROM r GROUP BY 1, 2), a AS (SELECT gene_id, sum(n)::DOUBLE AS n, sum(s * s / n) AS q, sum(ties) AS ties FROM g GROUP BY 1)
SELECT gene_id, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) + 0.0 AS h_stat FROM a""")
def kruskal_h(spark, d):
    return de.kruskal_h(_expr(spark, d), "value", "label").select(GENE, _r("h_stat", "h_stat"))


_KW = f"""{E}, r AS (SELECT gene_id, label, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene_id, x) AS t FROM e),
g AS (SELECT gene_id, label, count(*)::DOUBLE AS n, sum(r) AS s, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1, 2), a AS (SELECT gene_id, sum(n) AS n, count(*)::DOUBLE AS k, sum(s * s / n) AS q, sum(ties) AS ties FROM g GROUP BY 1),
h AS (SELECT gene_id, n, k, ties, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h_stat FROM a)"""


@query(f"{_KW} SELECT gene_id, round({_chi2_sql('h_stat', 'k - 1')} + 1e-11, 6) AS kruskal_pvalue FROM h")
def kruskal_p(spark, d):
    return de.kruskal(_expr(spark, d), "value", "label").select(GENE, *_near("kruskal_pvalue"))


@query(f"{E}, m AS (SELECT gene_id, label, avg(x) AS m FROM e GROUP BY 1, 2) SELECT a.gene_id, a.label AS g_low, b.label AS g_high, round(b.m - a.m, 6) + 0.0 AS diff FROM m a JOIN m b ON a.gene_id = b.gene_id AND a.label < b.label")
def tukey_diff(spark, d):
    return de.pair_differences(_expr(spark, d), "value", "label").select(GENE, "g_low", "g_high", _r("diff", "diff"))


@query(f"{_TUKEY} SELECT gene_id, g_low, g_high, {_near_sql('diff')}, round(p_adj + 1e-11, 4) AS p_adj, n_low, n_high FROM tk")
def tukey_p(spark, d):
    return de.tukey_hsd(_expr(spark, d), "value", "label").select(GENE, "g_low", "g_high", *_near("diff"), F.round(F.col("p_adj") + 1e-11, 4).alias("p_adj"), "n_low", "n_high")


@query(f"""{_KW}, w AS (SELECT a.gene_id, a.label AS g_low, b.label AS g_high, b.s / b.n - a.s / a.n AS diff, a.n AS n1, b.n AS n2, h.n, h.k, h_stat, ((h.n * (h.n + 1) * (2 * h.n + 1)) / 6 - h.ties / 12 - h.n * (h.n + 1) * (h.n + 1) / 4) / (h.n - 1) AS s2 FROM g a JOIN g b ON a.gene_id = b.gene_id AND a.label < b.label JOIN h ON h.gene_id = a.gene_id),
t AS (SELECT *, diff / sqrt(s2 * (n - 1 - h_stat) / (n - k) * (1 / n1 + 1 / n2)) AS t FROM w), p AS (SELECT *, {_t_sql('t', 'n - k')} AS p FROM t)
SELECT gene_id, g_low, g_high, {_near_sql('diff', 'p_adj')}, n1::BIGINT AS n_low, n2::BIGINT AS n_high FROM {_bh_sql('p', 'p', 'p_adj', 'gene_id')}""")
def kruskal_posthoc(spark, d):
    return de.kruskal_posthoc(_expr(spark, d), "value", "label").select(GENE, "g_low", "g_high", *_near("diff", "p_adj"), "n_low", "n_high")


@query(f"{E}, m AS (SELECT gene_id, label, avg(x) AS m FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY m DESC, label) AS rn FROM m) SELECT gene_id, max(CASE WHEN rn = 1 THEN label END) AS g_first, max(CASE WHEN rn = 2 THEN label END) AS g_second FROM r GROUP BY 1")
def top2_pair(spark, d):
    return de.top_two_groups(_expr(spark, d), "value", "label").select(GENE, "g_first", "g_second")


@query(f"""{E}, r AS (SELECT gene_id, label, x, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0 AS r FROM e),
g AS (SELECT gene_id, label, count(*) AS n, sum(r) AS s, avg(x) AS m, sum(count(*)) OVER (PARTITION BY gene_id) AS nt, row_number() OVER (PARTITION BY gene_id ORDER BY avg(x) DESC, label) AS rn FROM r GROUP BY 1, 2)
SELECT gene_id, label AS cluster, round((s - n * (n + 1) / 2.0) / (n * (nt - n)), 6) + 0.0 AS auc FROM g WHERE rn = 1""")
def marker_auc(spark, d):
    return de.marker_auc(_expr(spark, d), "value", "label").select(GENE, "cluster", _r("auc", "auc"))


@query(f"""{_TABLE}, mg AS (SELECT kg.gene_id, kg.label AS cluster, kg.n AS n1, nt - kg.n AS n0, kg.s AS rs, kh.ties FROM kg JOIN kh USING (gene_id) JOIN m ON m.gene_id = kg.gene_id AND m.label = kg.label QUALIFY row_number() OVER (PARTITION BY kg.gene_id ORDER BY m.m DESC, kg.label) = 1),
mu AS (SELECT *, (rs - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc, rs - n1 * (n1 + 1) / 2 - n1 * n0 / 2 AS dv, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sdv FROM mg), mp AS (SELECT gene_id, cluster, auc, {_norm_sql('(dv - sign(dv) * 0.5) / sdv')} AS score_p_value FROM mu),
mq AS (SELECT * FROM {_bh_sql('mp', 'score_p_value', 'score_q_value', '')}) SELECT gene_id, cluster, {_near_sql('auc', 'score_p_value', 'score_q_value')}, {_TABLE_SQL} FROM tb JOIN mq USING (gene_id)""")
def marker_genes(spark, d):
    got = de.marker_genes(_expr(spark, d), "value", "label", pair_diff=0.01, keep_all=True)[0]
    return got.select(GENE, "cluster", *_near("auc", "score_p_value", "score_q_value"), *_table_cols())


_OVR = f"{E}, g AS (SELECT gene_id, label AS cluster FROM e GROUP BY 1, 2), v AS (SELECT g.gene_id, g.cluster, count(*) FILTER (WHERE e.label = g.cluster)::DOUBLE AS n1, count(*) FILTER (WHERE e.label <> g.cluster)::DOUBLE AS n0, avg(x) FILTER (WHERE e.label = g.cluster) AS m1, avg(x) FILTER (WHERE e.label <> g.cluster) AS m0, stddev_samp(x) FILTER (WHERE e.label = g.cluster) AS s1, stddev_samp(x) FILTER (WHERE e.label <> g.cluster) AS s0 FROM g JOIN e USING (gene_id) GROUP BY 1, 2)"


@query(f"{_OVR} SELECT gene_id, cluster, n1::BIGINT AS n_case, n0::BIGINT AS n_control, round(m1, 6) + 0.0 AS mean_case, round(m0, 6) + 0.0 AS mean_control, round(s1, 6) + 0.0 AS sd_case, round(s0, 6) + 0.0 AS sd_control FROM v")
def one_vs_rest_moments(spark, d):
    v = de.naive_t(de.one_vs_rest(_expr(spark, d), "value", "label"))
    return v.select(GENE, "cluster", "n_case", "n_control", _r("mean_case", "mean_case"), _r("mean_control", "mean_control"), _r("sd_case", "sd_case"), _r("sd_control", "sd_control"))


@query(f"{_OVR} SELECT gene_id, cluster, round(m1 - m0, 6) + 0.0 AS log_fc, round((m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 6) + 0.0 AS t_stat FROM v")
def naive_de_t(spark, d):
    return de.naive_t(de.one_vs_rest(_expr(spark, d), "value", "label")).select(GENE, "cluster", _r("log_fc", "log_fc"), _r("t_stat", "t_stat"))


@query(f"{_OVR}, w AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2)) AS dp FROM v) SELECT gene_id, cluster, round(dp, 6) + 0.0 AS dprime, round((n1 + n0) / (n1 * n0) + dp * dp / (2 * (n1 + n0)), 6) + 0.0 AS vardprime FROM w")
def effect_size(spark, d):
    return de.effect_size(de.one_vs_rest(_expr(spark, d), "value", "label")).select(GENE, "cluster", _r("dprime", "dprime"), _r("vardprime", "vardprime"))


_TT = f"""{_OVR}, t AS (SELECT *, m1 - m0 AS log_fc, n1 + n0 - 2 AS df, (m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t_stat FROM v), tp AS (SELECT *, {_t_sql('t_stat', 'df')} AS p_value FROM t)"""


@query(f"""{_TT}, r AS (SELECT gene_id, label, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene_id, x) AS t FROM e), rt AS (SELECT gene_id, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1),
u AS (SELECT gene_id, label AS cluster, sum(r) AS rs FROM r GROUP BY 1, 2), w AS (SELECT tp.*, rs - n1 * (n1 + 1) / 2 - n1 * n0 / 2 AS dv, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sdv FROM tp JOIN u USING (gene_id, cluster) JOIN rt USING (gene_id)),
x AS (SELECT *, {_norm_sql('(dv - sign(dv) * 0.5) / sdv')} AS wilcox_p_value FROM w), y AS (SELECT * FROM {_bh_sql('x', 'p_value', 'adj_p_value', 'cluster')}), z AS (SELECT * FROM {_bh_sql('y', 'wilcox_p_value', 'wilcox_adj_p_value', 'cluster')})
SELECT gene_id, cluster, n1::BIGINT AS n_case, n0::BIGINT AS n_control, {_near_sql('log_fc', 't_stat', 'p_value', 'wilcox_p_value', 'adj_p_value', 'wilcox_adj_p_value')}, adj_p_value < 0.05 AND abs(log_fc) > 0.05 AS significant FROM z""")
def naive_de(spark, d):
    v = de.naive_de(_expr(spark, d), "value", "label", least_fc=0.05)
    return v.select(GENE, "cluster", "n_case", "n_control", *_near("log_fc", "t_stat", "p_value", "wilcox_p_value", "adj_p_value", "wilcox_adj_p_value"), "significant")


@query(f"""{E}, c AS (SELECT gene_id, batch, label, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY 1, 2, 3), b AS (SELECT gene_id, batch, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM c GROUP BY 1, 2),
w AS (SELECT c.gene_id, c.label AS cluster, c.n * (b.n - c.n) / b.n AS w, c.s / c.n - (b.s - c.s) / (b.n - c.n) AS d FROM c JOIN b ON c.gene_id = b.gene_id AND c.batch = b.batch), k AS (SELECT gene_id, cluster, sum(w) AS w, sum(w * d) / sum(w) AS log_fc FROM w GROUP BY 1, 2),
g AS (SELECT gene_id, sum(n) AS n, sum(s) / sum(n) AS ave_expr, sum(q - s * s / n) AS within, count(*) AS nb FROM b GROUP BY 1), f AS (SELECT gene_id, cluster, log_fc, ave_expr, n - nb - 1 AS df, (within - w * log_fc * log_fc) / (n - nb - 1) AS s2, 1 / sqrt(w) AS u FROM k JOIN g USING (gene_id))
SELECT gene_id, cluster, {_near_sql('log_fc', 'ave_expr', 's2', 'u')}, df FROM f""")
def limma_fit(spark, d):
    """Coefficient, residual variance and unscaled deviation of every group against the rest, batches modelled."""
    f = de.linear_fits(_expr(spark, d), "value", "label", [f"C{i}" for i in range(10)], "batch", as_two=True)
    return f.select(GENE, "cluster", *_near("log_fc", "ave_expr", "s2", "u"), "df")


@query()
def limma_de(spark, d):
    return de.limma(_expr(spark, d), "value", "label", "C3", "batch", stats_over=0.1)


@query()
def de_genes(spark, d):
    return de.de_genes(_expr(spark, d), "value", "label", method="limma", threshold=0.1)


@query(f"{E} SELECT gene_id, label AS cluster, sum((x > 0.1)::INT)::BIGINT AS a, sum((x <= 0.1)::INT)::BIGINT AS b, (sum(sum((x > 0.1)::INT)) OVER (PARTITION BY gene_id) - sum((x > 0.1)::INT))::BIGINT AS c, (sum(sum((x <= 0.1)::INT)) OVER (PARTITION BY gene_id) - sum((x <= 0.1)::INT))::BIGINT AS d FROM e GROUP BY 1, 2")
def fisher_counts(spark, d):
    return de.fisher_expressing(_expr(spark, d), "value", "label", 0.1).select(GENE, "cluster", "a", "b", "c", "d")


_FISHER = f"""{E}, c AS (SELECT gene_id, label AS cluster, sum((x > 0.1)::INT)::BIGINT AS a, sum((x <= 0.1)::INT)::BIGINT AS b, (sum(sum((x > 0.1)::INT)) OVER (PARTITION BY gene_id) - sum((x > 0.1)::INT))::BIGINT AS c, (sum(sum((x <= 0.1)::INT)) OVER (PARTITION BY gene_id) - sum((x <= 0.1)::INT))::BIGINT AS d FROM e GROUP BY 1, 2),
l AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + c, a + b) + 1)) AS x FROM c), h AS (SELECT *, -lgamma(x + 1.0) - lgamma(a + b - x + 1.0) - lgamma(a + c - x + 1.0) - lgamma(d - a + x + 1.0) + lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0) AS lp FROM l),
k AS (SELECT *, max(CASE WHEN x = a THEN lp END) OVER (PARTITION BY gene_id, cluster) AS own FROM h), p AS (SELECT gene_id, cluster, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1.0, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)) AS or_p_value FROM k GROUP BY 1, 2)"""


@query(f"{_FISHER} SELECT gene_id, cluster, a, b, c, d, {_near_sql('or_p_value', 'or_adj_p_value')} FROM {_bh_sql('p', 'or_p_value', 'or_adj_p_value', 'cluster')}")
def fisher_p(spark, d):
    return de.fisher_expressing(_expr(spark, d), "value", "label", 0.1).select(GENE, "cluster", "a", "b", "c", "d", *_near("or_p_value", "or_adj_p_value"))


@query()
def fisher_exact(spark, d):
    return de.fisher_expressing(_expr(spark, d), "value", "label", 0.1)


@query(f"""{_OVR}, z AS (SELECT gene_id, label, x, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY gene_id)), gr AS (SELECT gene_id, label, avg(x) AS mean, avg(z) AS mean_scale, stddev_samp(x) AS sd, count(x) AS length, avg((z > 0.1)::INT) AS freq FROM z GROUP BY 1, 2),
y AS (SELECT gr.*, (m1 - m0) / (s1 + s0) AS snr FROM gr JOIN v ON v.gene_id = gr.gene_id AND v.cluster = gr.label) SELECT gene_id, label, {_near_sql('mean', 'mean_scale', 'sd', 'freq', 'snr')}, length FROM y""")
def group_profile(spark, d):
    return de.group_profile(_expr(spark, d), "value", "label", 0.1).select(GENE, "label", *_near("mean", "mean_scale", "sd", "freq", "snr"), "length")


@query(f"{_ADD}, o AS (SELECT gene_id, batch, any_value(b) AS b FROM fit GROUP BY 1, 2), z AS (SELECT gene_id, b AS b0 FROM o WHERE batch = 0), y AS (SELECT e.gene_id, e.cell_id, e.x - o.b + z.b0 AS adj FROM e JOIN o ON o.gene_id = e.gene_id AND o.batch = e.batch JOIN z ON z.gene_id = e.gene_id) SELECT gene_id, cell_id, {_near_sql('adj')} FROM y")
def batch_coefficients_removed(spark, d):
    return de.remove_batch_coefficients(_expr(spark, d), "value", "label", "batch", "adj").select(GENE, CELL, *_near("adj"))


# ---- integration ----------------------------------------------------------------------


@query(f"WITH s AS (SELECT meta_cluster, gene_id, CASE WHEN f_rank IS NULL OR isnan(f_rank) THEN NULL ELSE 0.5 - f_rank END AS z, sqrt(1.0 + substr(dataset_id, 2)::BIGINT % 5) AS w FROM {_ST} WHERE rn = 1) SELECT meta_cluster, gene_id, round(sum(z * w) / sqrt(sum(CASE WHEN z IS NOT NULL THEN w * w END)), 6) + 0.0 AS z_sum FROM s GROUP BY 1, 2")
def stouffer_z(spark, d):
    s = _study(spark, d).withColumn("z", 0.5 - relational.nan_to_null(F.col("f_rank"))).withColumn("w", F.sqrt(1.0 + F.col("no") % 5))
    return s.groupBy("meta_cluster", GENE).agg(_r(integrate.stouffer("z", "w")[0], "z_sum"))


@query(f"""WITH s AS (SELECT meta_cluster || '/' || gene_id AS k, p FROM {_ST} WHERE rn = 1), a AS (SELECT k, count(p) AS n_p, coalesce(sum(-ln(greatest(p, 1e-300))), 0) AS h, max(p) AS one FROM s GROUP BY 1)
SELECT k, n_p, round(CASE WHEN n_p = 0 THEN 1.0 WHEN n_p = 1 THEN one ELSE least(1.0, exp(-h) * (SELECT sum(CASE WHEN j = 0 THEN 1.0 ELSE exp(j * ln(greatest(h, 1e-300)) - lgamma(j + 1)) END) FROM range(0, n_p) t(j))) END, 6) + 0.0 AS p_comb FROM a""")
def fisher_chisq_p(spark, d):
    s = _study(spark, d).withColumn("k", F.concat_ws("/", "meta_cluster", GENE))
    return integrate.combine_pvalues(s, "k", "dataset_id", "score_p_value").select("k", "n_p", _r("p_comb", "p_comb"))


def _studies(spark, d) -> DataFrame:
    """A multi-assay study table from one-vs-rest comparisons of each batch: groups are meta-clusters, batches are studies."""
    from cellorium.functions import udfs

    e = _expr(spark, d)
    out = None
    for b in range(3):
        own = e.filter(F.col("batch") == b)
        v = de.effect_size(de.naive_t(de.one_vs_rest(own, "value", "label")))
        over = de.expressing_counts(own, "value", "label", 0.1)
        scaled = groupstats.pseudobulk(own, "value", ["label"], "zscore").select(GENE, F.col("label").alias("cluster"), F.col("avg").alias("mean_scale"))
        p = v.join(over, [GENE, "cluster"]).join(scaled, [GENE, "cluster"]).select(
            F.col("cluster").alias("meta_cluster"), GENE, F.lit(f"S{b}").alias("study"), "dprime", "vardprime", F.col("t_stat").alias("t"), "log_fc", "mean_scale", "n_case", "n_control", F.col("t_stat").alias("z"),
            udfs.t_sf2(F.col("t_stat"), F.col("df")).alias("p_value"), (F.col("a") / (F.col("a") + F.col("b"))).alias("freq_case"), (F.col("c") / (F.col("c") + F.col("d"))).alias("freq_control"),
        )
        out = p if out is None else out.unionByName(p)
    out = relational.bh_adjust(out, "p_value", ["meta_cluster", "study"], "adj_p")
    return out.withColumn("sig", ((F.col("p_value") < 0.05) & (F.col("log_fc") > 0)).cast("int"))


_STUDY = f"""{E}, g AS (SELECT gene_id, batch, label, count(*)::DOUBLE AS n1, avg(x) AS m1, var_samp(x) AS v1, sum((x > 0.1)::INT)::DOUBLE AS a FROM e GROUP BY 1, 2, 3), w AS (SELECT gene_id, batch, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS vv, stddev_samp(x) AS sd, sum((x > 0.1)::INT)::DOUBLE AS over FROM e GROUP BY 1, 2),
o AS (SELECT g.gene_id, 'S' || g.batch AS study, label AS meta_cluster, n1, n - n1 AS n0, m1, (n * m - n1 * m1) / (n - n1) AS m0, (n1 - 1) * v1 AS ss1, (n - 1) * vv AS sst, m, (m1 - m) / sd AS mean_scale, a / n1 AS freq_case, (over - a) / (n - n1) AS freq_control FROM g JOIN w ON g.gene_id = w.gene_id AND g.batch = w.batch),
q AS (SELECT *, m1 - m0 AS log_fc, sqrt((sst - n1 * (m1 - m) * (m1 - m) - n0 * (m0 - m) * (m0 - m)) / (n1 + n0 - 2)) AS s FROM o), t AS (SELECT *, log_fc / (s * sqrt(1 / n1 + 1 / n0)) AS t, log_fc / s AS dprime, (n1 + n0) / (n1 * n0) + (log_fc / s) * (log_fc / s) / (2 * (n1 + n0)) AS vardprime FROM q),
tp AS (SELECT *, {_t_sql('t', 'n1 + n0 - 2')} AS p_value FROM t), ap AS (SELECT * FROM {_bh_sql('tp', 'p_value', 'adj_p', 'meta_cluster, study')}),
st AS (SELECT *, (p_value < 0.05 AND log_fc > 0)::INT AS sig, (rank() OVER (PARTITION BY meta_cluster, study ORDER BY t DESC) + (count(*) OVER (PARTITION BY meta_cluster, study, t) - 1) / 2.0) / count(*) OVER (PARTITION BY meta_cluster, study) AS t_rank, sqrt(n1 + n0) AS w, count(*) OVER (PARTITION BY meta_cluster, gene_id) AS k FROM ap)"""
_RANKED = f"""{_STUDY}, rk AS (SELECT meta_cluster, gene_id, sum(sig)::BIGINT AS n_sig, avg(sig) AS freq_sig, count(*) AS n_studies, median(log_fc) AS median_log_fc, median(mean_scale) AS median_mean_scale, median(t_rank) AS median_rank, sum(t * w) / sqrt(sum(w * w)) AS z_sum, sum(freq_case * n1) / sum(n1) AS freq_comb, median(freq_case) AS freq_median, avg(freq_case) AS freq_mean,
max(dprime) AS dprime_max, arg_max(p_value, dprime) AS dprime_max_p, arg_max(adj_p, dprime) AS dprime_max_adj_p, sum(dprime / vardprime) / sum(1 / vardprime) AS es_combi, 1 / sqrt(sum(1 / vardprime)) AS es_combi_sd, sum(-ln(greatest(p_value, 1e-300))) AS h FROM st GROUP BY 1, 2),
rp AS (SELECT *, {_norm_sql('z_sum')} AS p_stouffer, least(1.0, exp(-h) * (1 + h + h * h / 2)) AS p_fisher FROM rk), ra AS (SELECT * FROM {_bh_sql('rp', 'p_stouffer', 'p_stouffer_adj', 'meta_cluster')}), rf AS (SELECT * FROM {_bh_sql('ra', 'p_fisher', 'p_fisher_adj', 'meta_cluster')})"""
_RANK_COLS = ("freq_sig", "median_log_fc", "median_mean_scale", "median_rank", "z_sum", "freq_comb", "freq_median", "freq_mean", "dprime_max", "dprime_max_p", "dprime_max_adj_p", "es_combi", "es_combi_sd", "p_stouffer", "p_stouffer_adj", "p_fisher", "p_fisher_adj")


@query()
def rank_genes(spark, d):
    return integrate.rank_genes(_studies(spark, d))


@query(f"{_RANKED} SELECT meta_cluster, gene_id, n_sig, n_studies, {_near_sql(*_RANK_COLS)}, es_combi > 0.15 AND p_stouffer_adj < 0.01 AS sig_comb FROM rf")
def rank_genes_values(spark, d):
    """The ranked table without the odds ratio, which has no closed form."""
    return integrate.rank_genes(_studies(spark, d)).select("meta_cluster", GENE, "n_sig", "n_studies", *_near(*_RANK_COLS), "sig_comb")


@query(f"""{_OVR.replace("FROM g JOIN e USING (gene_id) GROUP BY 1, 2", "FROM g JOIN e USING (gene_id) WHERE batch = 0 GROUP BY 1, 2")}, w AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2)) AS dp FROM v), y AS (SELECT gene_id, cluster, dp, (n1 + n0) / (n1 * n0) + dp * dp / (2 * (n1 + n0)) AS vd FROM w)
SELECT cluster, round(sum(dp / vd) / sum(1 / vd), 6) + 0.0 AS es_combi, round(1 / sqrt(sum(1 / vd)), 6) + 0.0 AS es_combi_sd FROM y GROUP BY 1""")
def combine_effects(spark, d):
    v = de.effect_size(de.one_vs_rest(_expr(spark, d).filter(F.col("batch") == 0), "value", "label"))
    return de.combine_effects(v, ["cluster"]).select("cluster", _r("es_combi", "es_combi"), _r("es_combi_sd", "es_combi_sd"))


@query(f"""{E}, g AS (SELECT gene_id, label AS cluster, batch FROM e GROUP BY 1, 2, 3), v AS (SELECT g.gene_id, g.cluster, g.batch, count(*) FILTER (WHERE e.label = g.cluster)::DOUBLE AS n1, count(*) FILTER (WHERE e.label <> g.cluster)::DOUBLE AS n0, avg(x) FILTER (WHERE e.label = g.cluster) AS m1, avg(x) FILTER (WHERE e.label <> g.cluster) AS m0, var_samp(x) FILTER (WHERE e.label = g.cluster) AS s1, var_samp(x) FILTER (WHERE e.label <> g.cluster) AS s0 FROM g JOIN e ON e.gene_id = g.gene_id AND e.batch = g.batch GROUP BY 1, 2, 3), w AS (SELECT *, (m1 - m0) / sqrt((coalesce((n1 - 1) * s1, 0) + coalesce((n0 - 1) * s0, 0)) / (n1 + n0 - 2)) AS dp FROM v), y AS (SELECT gene_id, cluster, dp, (n1 + n0) / (n1 * n0) + dp * dp / (2 * (n1 + n0)) AS vd FROM w)
SELECT cluster, gene_id, round(sum(dp / vd) / sum(1 / vd), 6) + 0.0 AS es_combi, round(1 / sqrt(sum(1 / vd)), 6) + 0.0 AS es_combi_sd FROM y GROUP BY 1, 2""")
def combine_effects_studies(spark, d):
    """Effects of all three batches, combined per cluster and gene."""
    v = _studies(spark, d).withColumnRenamed("meta_cluster", "cluster")
    return de.combine_effects(v, ["cluster", GENE]).select("cluster", GENE, _r("es_combi", "es_combi"), _r("es_combi_sd", "es_combi_sd"))


@query(f"""{_STUDY}, cb AS (SELECT meta_cluster, gene_id, CASE WHEN study = 'S2' THEN 'L1' ELSE 'L0' END AS lab, sum(dprime / vardprime) / sum(1 / vardprime) AS dprime, 1 / sqrt(sum(1 / vardprime)) AS se FROM st GROUP BY 1, 2, 3), cp AS (SELECT *, {_norm_sql('dprime / se')} AS p_value FROM cb),
ca AS (SELECT *, (adj_p < 0.01 AND dprime > 0.15)::INT AS sig FROM {_bh_sql('cp', 'p_value', 'adj_p', 'meta_cluster, lab')}), y AS (SELECT meta_cluster, gene_id, sum(sig)::BIGINT AS n_sig_2nd, avg(sig) AS freq_sig_2nd, count(*) AS n_2nd, max(dprime) AS dprime_max_2nd, arg_max(p_value, dprime) AS dprime_max_p_2nd, arg_max(adj_p, dprime) AS dprime_max_adj_p_2nd FROM ca GROUP BY 1, 2)
SELECT meta_cluster, gene_id, n_sig_2nd, n_2nd, {_near_sql('freq_sig_2nd', 'dprime_max_2nd', 'dprime_max_p_2nd', 'dprime_max_adj_p_2nd')} FROM y""")
def rank_genes_second_group(spark, d):
    """Effects collapsed over a second grouping of the studies."""
    s = _studies(spark, d).withColumn("lab", F.when(F.col("study") == "S2", "L1").otherwise("L0"))
    got = integrate.rank_genes(s, group_2nd="lab")
    return got.select("meta_cluster", GENE, "n_sig_2nd", "n_2nd", *_near("freq_sig_2nd", "dprime_max_2nd", "dprime_max_p_2nd", "dprime_max_adj_p_2nd"))


@query()
def integrate_datasets(spark, d):
    es = _set(spark, d)
    parts = [es.subset_cells(es.cells.filter(F.col("dataset_id") == n)) for n in ("D01", "D02")]
    parts = [p.with_(cells=p.cells.drop("dataset_id")) for p in parts]
    return integrate.integrate_by_average(integrate.unite(parts), "label", gene_threshold=32, snn_k=3)[0].cells


@query("SELECT DISTINCT cluster_id, regexp_extract(cluster_id, '^(.+?)\\.', 1) AS dataset FROM gene_de_list")
def dataset_of_id(spark, d):
    return _t(spark, d, "gene_de_list").select("cluster_id", integrate.dataset_of(F.col("cluster_id")).alias("dataset")).distinct()


@query(f"{E}, a AS (SELECT gene_id, x FROM e WHERE cell_id = (SELECT min(vec_id) FROM embeddings)) SELECT e.cell_id, round(corr(a.x, e.x), 6) + 0.0 AS r FROM e JOIN a USING (gene_id) WHERE e.cell_id <> (SELECT min(vec_id) FROM embeddings) GROUP BY 1")
def correlations_with(spark, d):
    e = _expr(spark, d)
    first = e.agg(F.min(CELL)).first()[0]
    return integrate.correlations_with(e, "value", first)[0].select(CELL, _r("r", "r"))


@query(f"{_Z} SELECT meta_cluster, label, gene_id, round(avg(z), 6) + 0.0 AS avg FROM z JOIN s USING (gene_id) GROUP BY 1, 2, 3")
def signature_heatmap(spark, d):
    e = _expr(spark, d)
    return integrate.signature_heatmap(e.select(GENE, CELL, "value"), "value", _sig(spark), _vec(spark, d).select(CELL, "label"), "label").select("meta_cluster", "label", GENE, _r("avg", "avg"))


@query(f"{_Z} SELECT cell_id, meta_cluster, round(avg((z > 0.3)::INT), 6) + 0.0 AS score FROM z JOIN s USING (gene_id) GROUP BY 1, 2")
def sig_score(spark, d):
    return classify.signature_scores(_expr(spark, d), "value", _sig(spark)).select(CELL, "meta_cluster", _r("score", "score"))


@query(f"{_Z} SELECT cell_id, meta_cluster, bool_and(CASE WHEN gene_id < 'G0008' THEN z > 0.3 ELSE z < 0.3 END) AS passes FROM z JOIN s USING (gene_id) WHERE gene_id < 'G0016' GROUP BY 1, 2")
def sig_gates(spark, d):
    s = _sig(spark)
    return classify.signature_gates(_expr(spark, d), "value", s.filter(F.col(GENE) < "G0008"), s.filter((F.col(GENE) >= "G0008") & (F.col(GENE) < "G0016")))


@query(f"{_Z} SELECT meta_cluster, gene_id, cell_id, label, {_near_sql('z')} FROM z JOIN s USING (gene_id)")
def signature_violin(spark, d):
    e = _expr(spark, d)
    return integrate.signature_violin(e.select(GENE, CELL, "value"), "value", _sig(spark), _vec(spark, d).select(CELL, "label"), "label").select("meta_cluster", GENE, CELL, "label", *_near("z"))


@query(f"""{E}, c AS (SELECT gene_id, cell_id, x - avg(x) OVER (PARTITION BY gene_id, batch) + avg(x) OVER (PARTITION BY gene_id) AS x FROM e), z AS (SELECT gene_id, cell_id, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM c WINDOW w AS (PARTITION BY gene_id)), s AS (SELECT 'M' || (i % 8) AS meta_cluster, 'G' || lpad(i::VARCHAR, 4, '0') AS gene_id FROM range(48) t(i)),
a AS (SELECT cell_id, sum(z) AS s, count(z) AS n FROM z GROUP BY 1), m AS (SELECT z.cell_id, meta_cluster, sum(z) / count(z) - (any_value(a.s) - sum(z)) / (any_value(a.n) - count(z)) AS score FROM z JOIN s USING (gene_id) JOIN a ON a.cell_id = z.cell_id GROUP BY 1, 2)
SELECT cell_id, meta_cluster AS meta_cluster_top, {_near_sql('score')}, (score >= 1.0)::INT AS bin FROM m QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, meta_cluster) = 1""")
def module_score_classes(spark, d):
    """Batch-corrected module scores, the best module of every cell and whether it is reached."""
    got = classify.classify_by_module_score(_set(spark, d), _sig(spark), "exprs", "batch")
    return got.select(CELL, "meta_cluster_top", *_near("score"), "bin")


# ---- reduction, neighbours, clustering, classification ----------------------------------


@query(f"{E} SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, round(corr(a.x, b.x), 6) + 0.0 AS r FROM e a JOIN e b ON a.gene_id = b.gene_id AND a.cell_id <= b.cell_id GROUP BY 1, 2")
def icor_pearson(spark, d):
    v = _vec(spark, d)
    ids = [r[0] for r in v.select(CELL).orderBy(CELL).collect()]  # the reference side, bounded by MAX_CELLS
    return _pairs(reduce.correlation_space(v, "pearson"), ids)


def _pairs(emb: DataFrame, ids: list) -> DataFrame:
    names = F.broadcast(emb.sparkSession.createDataFrame([(i, c) for i, c in enumerate(ids)], "i int, cell_b long"))
    p = emb.select(F.col(CELL).alias("cell_a"), F.posexplode("features").alias("i", "r")).join(names, "i")
    return p.filter("cell_a <= cell_b").select("cell_a", "cell_b", _r("r", "r"))


@query(f"{E}, k AS (SELECT cell_id, gene_id, rank() OVER (PARTITION BY cell_id ORDER BY x) + (count(*) OVER (PARTITION BY cell_id, x) - 1) / 2.0 AS x FROM e) SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, round(corr(a.x, b.x), 6) + 0.0 AS r FROM k a JOIN k b ON a.gene_id = b.gene_id AND a.cell_id <= b.cell_id GROUP BY 1, 2")
def icor_spearman(spark, d):
    v = _vec(spark, d)
    ids = [r[0] for r in v.select(CELL).orderBy(CELL).collect()]
    return _pairs(reduce.correlation_space(v, "spearman"), ids)


@query(f"{E} SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, round(corr(a.x, b.x), 6) + 0.0 AS r FROM e a JOIN e b ON a.gene_id = b.gene_id WHERE a.batch <> 0 AND b.batch = 0 GROUP BY 1, 2")
def cross_corr(spark, d):
    v = _vec(spark, d)
    train = v.filter("batch = 0")
    ids = [r[0] for r in train.select(CELL).orderBy(CELL).collect()]
    emb = reduce.correlation_space(v.filter("batch <> 0"), "pearson", against=train)
    names = F.broadcast(spark.createDataFrame([(i, c) for i, c in enumerate(ids)], "i int, cell_b long"))
    return emb.select(F.col(CELL).alias("cell_a"), F.posexplode("features").alias("i", "r")).join(names, "i").select("cell_a", "cell_b", _r("r", "r"))


@query()
def pca_scores(spark, d):
    return reduce.pca(_vec(spark, d))[0]


@query()
def pca_explained(spark, d):
    info = reduce.pca(_vec(spark, d))[1]
    return spark.createDataFrame([(i + 1, float(x), int(info["npc"])) for i, x in enumerate(info["explained"])], "component int, explained double, knee int")


_D = f"""v AS (SELECT vec_id AS c, embedding, label, vec_id % 3 AS batch FROM embeddings), d AS (SELECT a.c AS src, b.c AS dst, a.label AS la, b.label AS lb, a.batch AS ba, b.batch AS bb, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM v a JOIN v b ON a.c <> b.c)"""


@query(f"WITH {_D}, k AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM d) SELECT src, dst, rank, round(dist, 6) + 0.0 AS dist FROM k WHERE rank <= 5")
def knn_graph(spark, d):
    return neighbors.knn_graph(_vec(spark, d), 5).select("src", "dst", F.col("rank").cast("long").alias("rank"), _r("dist", "dist"))


@query(f"""WITH {_D}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS r FROM d), n AS (SELECT src AS c, dst AS via, r FROM k WHERE r <= 5 UNION ALL SELECT c, c, 0 FROM v)
SELECT a.c AS src, b.c AS dst, max(greatest(5.0 - (a.r + b.r) / 2.0, 1e-6))::DOUBLE AS weight FROM n a JOIN n b ON a.via = b.via AND a.c < b.c GROUP BY 1, 2""")
def snn_edges(spark, d):
    return neighbors.snn_edges(neighbors.knn_graph(_vec(spark, d), 5), 5)


@query(f"WITH {_D} SELECT src AS cell_id, 'C' || lb AS predicted FROM d WHERE ba <> 0 AND bb = 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist * dist, 9), lb) = 1")
def knn_label(spark, d):
    v = _vec(spark, d)
    return neighbors.knn_classify(v.filter("batch = 0"), "label", v.filter("batch <> 0"), 1)


@query(f"WITH {_D}, r AS (SELECT src, sum(exp(-(dist * dist))) AS rho FROM d GROUP BY 1), m AS (SELECT d.src, min(dist) AS delta FROM d JOIN r a ON a.src = d.src JOIN r b ON b.src = d.dst WHERE b.rho > a.rho OR (b.rho = a.rho AND d.dst < d.src) GROUP BY 1), f AS (SELECT src, max(dist) AS far FROM d GROUP BY 1) SELECT r.src AS cell_id, round(rho, 6) + 0.0 AS rho, round(coalesce(delta, far), 6) + 0.0 AS delta FROM r JOIN f USING (src) LEFT JOIN m USING (src)")
def density_rho_delta(spark, d):
    ids, x = reduce.collect_matrix(_vec(spark, d))
    rho, delta, _, _ = cluster.density_peaks(cluster.distances(x), 1.0)
    out = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in zip(ids, rho, delta)], "cell_id long, rho double, delta double")
    return out.select(CELL, _r("rho", "rho"), _r("delta", "delta"))


@query(f"""WITH {_D}, g AS (SELECT src, la, lb, avg(dist) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT src, la, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM g GROUP BY 1, 2)
SELECT src AS cell_id, 'C' || la AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS width FROM s""")
def silhouette(spark, d):
    v = _vec(spark, d)
    return metrics.silhouette(v.select(CELL, "features"), v).select(CELL, "label", _r("width", "width"))


_P2 = "WITH p AS (SELECT 'C' || label AS a, 'K' || CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label % 6 END AS b FROM embeddings), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM t GROUP BY 1), k AS (SELECT sum(n) AS n FROM t)"


def _two(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.concat(F.lit("C"), "label").alias("a"), F.concat(F.lit("K"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label") % 6)).alias("b"))


@query(f"{_P2}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ab, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, (SELECT n * (n - 1) / 2 FROM k) AS w) SELECT round((ab - sa * sb / w) / ((sa + sb) / 2 - sa * sb / w), 6) + 0.0 AS ari FROM s")
def ari(spark, d):
    return metrics.ari(_two(spark, d), "a", "b").select(_r("ari", "ari"))


@query(f"{_P2} SELECT round((SELECT sum(t.n / k.n * ln(t.n * k.n / (ra.n * rb.n))) FROM t JOIN ra USING (a) JOIN rb USING (b), k) / (((SELECT -sum(ra.n / k.n * ln(ra.n / k.n)) FROM ra, k) + (SELECT -sum(rb.n / k.n * ln(rb.n / k.n)) FROM rb, k)) / 2), 6) + 0.0 AS nmi")
def nmi(spark, d):
    return metrics.nmi(_two(spark, d), "a", "b").select(_r("nmi", "nmi"))


@query()
def kmeans_labels(spark, d):
    return cluster.kmeans(_vec(spark, d), 10)


@query()
def hclust_labels(spark, d):
    return _labels(spark, d, "hclust")


@query()
def tree_cut_labels(spark, d):
    return _labels(spark, d, "dynamicTreeCut")


@query()
def dpclust_labels(spark, d):
    return _labels(spark, d, "dpclust")


@query()
def adpclust_labels(spark, d):
    return _labels(spark, d, "adpclust")


@query()
def snn_leiden_labels(spark, d):
    return _labels(spark, d, "SNN", snn_method="leiden")


def _community(method: str) -> None:
    def f(spark, d):
        return _labels(spark, d, "SNN", snn_method=method)

    f.__name__ = f"snn_{method}_labels"
    query()(f)


for _m in ("louvain", "prop", "greedy", "eigen", "walktrap", "spinglass", "infomap"):
    _community(_m)


def _labels(spark, d, method: str, **kw) -> DataFrame:
    v = _vec(spark, d)
    es = _set(spark, d).with_embedding("emb", v.select(CELL, "features"))
    got = cluster.clust(es, "emb", method, [8, 10], **kw).cells
    return got.select(CELL, *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in got.columns if c.startswith("emb.")])


@query()
def consensus_labels(spark, d):
    return _labels(spark, d, "SC3")


@query()
def tsne_embedding(spark, d):
    from cellorium.operators import embed

    v = _vec(spark, d)
    ids, x = reduce.collect_matrix(v)
    return reduce.matrix_frame(v, ids, embed.run_tsne(x))


@query()
def umap_embedding(spark, d):
    from cellorium.operators import embed

    v = _vec(spark, d)
    ids, x = reduce.collect_matrix(v)
    return reduce.matrix_frame(v, ids, embed.umap(x))


@query(f"""{_RANKED}, pick AS (SELECT *, row_number() OVER (PARTITION BY meta_cluster ORDER BY round(median_rank, 9), gene_id) AS rn FROM rf WHERE freq_sig > 0.3 AND median_rank < 0.1 + 1e-9), y AS (SELECT * FROM pick WHERE rn <= 30)
SELECT meta_cluster, gene_id, {_near_sql('median_rank')} FROM y QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY round(median_rank, 9), meta_cluster) = 1""")
def top_meta_genes(spark, d):
    got = integrate.top_meta_genes(integrate.rank_genes(_studies(spark, d)), 30, 0.3, 0.1)
    return got.select("meta_cluster", GENE, *_near("median_rank"))


@query()
def signature_classes(spark, d):
    got = classify.classify_by_signature(_set(spark, d), "exprs", _sig(spark), train_pos=0.6)
    return got.drop("rf_probs")


@query()
def forest_labels(spark, d):
    v = _vec(spark, d)
    m = classify.train_forest(v.filter("batch = 0"), "label")
    return classify.predict_forest(m, v.filter("batch <> 0")).drop("probs")


@query()
def pooled_classes(spark, d):
    v = _vec(spark, d)
    return classify.classify_pool(v.select(CELL, "features"), v.select(CELL, "label"), "label")[0].drop("probs")


@query()
def model_classes(spark, d):
    """A forest stored for z-scores of four genes more than the set has, applied with padding."""
    es = _set(spark, d)
    z = relational.zscore(_expr(spark, d), [GENE], "value", "z")
    need = spark.createDataFrame([(f"G{i:04d}",) for i in range(68)], f"{GENE} string")
    train = ExprSet.from_long(relational.pad_missing(z.select(GENE, CELL, "z"), need, GENE, es.cells, CELL, "z"), es.cells, need, value="z")
    model = classify.train_forest(train.cell_vectors("exprs").join(es.cells.filter("batch = 0").select(CELL, "label"), CELL), "label")
    return classify.classify_by_model(es, model, "exprs", need, pad=True).drop("probs")


@query()
def out_of_sample_tsne(spark, d):
    return classify.out_of_sample_embedding(_set(spark, d), 0.4)


@query()
def svm_labels(spark, d):
    v = _vec(spark, d)
    return classify.predict_svm(classify.train_svm(v.filter("batch = 0"), "label"), v.filter("batch <> 0"))


@query()
def subsample_classified(spark, d):
    got = classify.subsample_cluster_classify(_set(spark, d), 0.2, "iCor", "kmeans", [10])
    return got.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in got.columns])


@query()
def binarized(spark, d):
    x = _expr(spark, d).select(GENE, CELL, "value")
    return mixture.binarize(x, GENE, CELL, "value", g=2)


@query()
def outliers(spark, d):
    return mixture.classify_outliers(_expr(spark, d).select(GENE, CELL, "value"), GENE, CELL, "value", 0.5)


@query()
def pipeline_labels(spark, d):
    from cellorium.plans.pipeline import run

    got = run(_set(spark, d), method_reduction="pca", method_clust="kmeans", ks=[10], sd_n=32).cells
    return got.select(CELL, *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in got.columns if c.startswith("pca.")])
