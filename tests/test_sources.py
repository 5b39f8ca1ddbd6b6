import gzip
import os

import pytest
from pyspark.sql import functions as F

from cellorium.exprset import ExprSet
from cellorium.operators import integrate
from cellorium.sources import tables
from cellorium.streaming import scoring


def test_matrix_round_trip(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("geneID\tgeneSymbol\tc.1\tc.2\nE1\tAA\t1.5\t0\nE2\tBB\tNA\t2\n")
    es = tables.read_matrix_tsv(spark, str(p))
    got = {(r["gene_id"], r["cell_id"]): r["exprs"] for r in es.expr.filter("gene_id = 'E1'").collect()}
    assert got == {("E1", "c.1"): 1.5, ("E1", "c.2"): 0.0} and {r["display_name"] for r in es.genes.collect()} == {"AA", "BB"}


def test_umi_csv(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("id,barcode,assigned_cluster,g1,g2\nx,AC,alpha,1,0\ny,GT,beta,0,3\n")
    es = tables.read_umi_csv(spark, str(p))
    assert es.expr.agg(F.sum("counts")).first()[0] == 4 and {r["assigned_cluster"] for r in es.cells.collect()} == {"alpha", "beta"}


def test_tables_out(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", None)], "geneID string, F double")
    tables.write_tsv(d, str(tmp_path / "t"), gz=True)
    f = next(x for x in sorted(os.listdir(tmp_path / "t")) if x.endswith(".gz"))
    assert gzip.open(tmp_path / "t" / f, "rt").readline().strip() == "geneID\tF"


def test_set_saved_and_loaded(spark, tmp_path):
    e = spark.createDataFrame([("g", "c", 1.0), ("h", "c", float("nan"))], "gene_id string, cell_id string, value double")
    es = ExprSet.from_long(e, dense=False).with_embedding("pca", spark.createDataFrame([("c", [1.0])], "cell_id string, features array<double>"))
    es.save(str(tmp_path / "s"))
    got = ExprSet.load(spark, str(tmp_path / "s"))
    assert not got.dense and set(got.emb) == {"pca"} and got.expr.filter("exprs IS NULL").count() == 1


def test_sparse_is_completed(spark):
    e = spark.createDataFrame([("g", "c", 1.0), ("h", "d", 2.0)], "gene_id string, cell_id string, value double")
    full = ExprSet.from_long(e, dense=False).completed()
    assert full.expr.count() == 4 and full.expr.agg(F.sum("exprs")).first()[0] == 3.0
    v = {r["cell_id"]: r["features"] for r in full.cell_vectors().collect()}
    assert v == {"c": [1.0, 0.0], "d": [0.0, 2.0]}


def test_run_ids_and_params():
    assert tables.normal_run_id("L1C1.L2C01") == "L1C1.L2C1" == tables.normal_run_id("L1C1.L2C1")
    assert tables.read_params({"L1C01": {"k": 3}}) == {"L1C1": {"k": 3.0}}


def test_orthologs(spark):
    m = spark.createDataFrame([("A", "a", "ortholog_one2one", 1), ("B", "b", "ortholog_one2many", 1), ("C", "c", "ortholog_one2one", 0)], "hs string, mm string, orthology_type string, orthology_confidence int")
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "gene_id string, v double")
    assert [tuple(r) for r in tables.map_orthologs(e, m, "mm", "hs").select("gene_id", "v").collect()] == [("A", 1.0)]


def test_combined_p(spark):
    rows = [("none", "s1", None), ("one", "s1", 0.2), ("one", "s2", None), ("two", "s1", 0.1), ("two", "s2", 0.1), ("three", "s1", 0.5), ("three", "s2", 0.5), ("three", "s3", 0.5)]
    d = spark.createDataFrame(rows, "k string, s string, p double")
    got = {r["k"]: r["p_comb"] for r in integrate.combine_pvalues(d, "k", "s", "p").collect()}
    from cellorium.functions.special import chi2_sf
    import math

    assert got["none"] == 1.0 and got["one"] == 0.2
    assert got["two"] == pytest.approx(float(chi2_sf(-4 * math.log(0.1), 4))) and got["three"] == pytest.approx(float(chi2_sf(-6 * math.log(0.5), 6)))
    strict = {r["k"]: r["p_comb"] for r in integrate.combine_pvalues(d, "k", "s", "p", strict_df=True).collect()}
    assert strict["two"] is None and strict["three"] is not None


def test_gene_choice(spark):
    d = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 0.2), ("b", "1", 0.05), ("c", "1", 0.9), ("c", "2", 0.9)], "gene_id string, dataset_id string, f_rank double")
    genes = spark.createDataFrame([("a",), ("b",), ("c",)], "gene_id string")
    ids = lambda x: sorted(r[0] for r in x.collect())
    assert ids(integrate.choose_genes(d, genes, threshold=1)) == ["a"]
    assert ids(integrate.choose_genes(d, genes, threshold=0.6)) == ["a", "b"]
    assert ids(integrate.choose_genes(d, genes, "occurence", 2)) == ["a", "c"]
    assert ids(integrate.choose_genes(d, genes, threshold=0.001)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        integrate.choose_genes(d, genes, "other")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(20)], "id int, t string, v double").select("id", F.to_timestamp("t").alias("t"), "v")
    d.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    scoring.score_stream(stream, lambda b: b.withColumn("s", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("s")).first()[0] == 380.0
    agg = scoring.running_group_stats(stream.withColumn("k", F.lit("a")), "t", "1 minute", "10 minutes", ["k"], "v")
    q = agg.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select * from stats").collect()) == [10, 10]
