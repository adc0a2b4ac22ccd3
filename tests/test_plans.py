"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from cytomosaic.operators import metrics as M
from cytomosaic.operators import neighbourhood as N
from cytomosaic.operators import spatial as X
from cytomosaic.operators.genes import top_expressed
from cytomosaic.operators.indexing import dense_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "t")
    at = spark.range(2000).select(
        F.concat(F.lit("c"), "id").alias("cell_id"), (F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"),
        F.concat(F.lit("T"), F.col("id") % 3).alias("cell_type"), F.lit(1.5).alias("unused"),
    )
    at.write.parquet(path)
    return spark.read.parquet(path)


def test_position_joins_are_equi_joins(spark, cells):
    square = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    rings = cells.select("cell_id", square.alias("ring"))
    for df in (X.neighbour_graph(cells, 2.0), N.contact_counts(cells, 2.0), X.overlap_pairs(rings, rings, 3.0)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(cells):
    text = plan(N.type_counts(cells))
    assert "unused" not in text and "ReadSchema: struct<cell_type:string>" in text


def test_index_does_not_gather_rows(spark, cells):
    text = plan(dense_index(cells.select("cell_id"), "cell_id", n_ranges=5))
    # the only single-partition step adds up range sizes
    head = text.split("Exchange SinglePartition")[0]
    assert text.count("Exchange SinglePartition") == 1 and "_n" in head


def test_top_genes_limit_before_the_shuffle(spark, cells):
    e = cells.select("cell_id", F.col("cell_type").alias("gene"), F.col("x").alias("value"))
    assert plan(top_expressed(e, 3)).count("WindowGroupLimit") == 2


def test_metrics_aggregate_before_the_shuffle(spark, cells):
    edges = cells.select(
        F.lit("s").alias("sample"), F.col("cell_id").alias("from_cell"), F.col("cell_id").alias("to_cell"),
        F.lit("L").alias("ligand"), F.col("cell_type").alias("receptor"), F.col("x").alias("attention_score"),
    )
    samples = spark.createDataFrame([("s", "k", 9)], "sample string, condition string, n_cells long")
    text = plan(M.sample_metrics(edges, samples))
    assert "partial_count" in text and "partial_avg" in text
