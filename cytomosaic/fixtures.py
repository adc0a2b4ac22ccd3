"""Tissue-like tables derived from the order/part/supplier test tables.

Each text is a SELECT that both Spark and DuckDB accept; ``{name}`` stands for another table. Spark runs them as
views over the parquet files, the SQL checks inline them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("orders", "lineitem", "part", "supplier", "embeddings")

TEXT = {
    "cells": """
        SELECT 's' || CAST(o_orderkey % 6 AS STRING) AS sample, 'c' || CAST(o_orderkey AS STRING) AS cell_id,
               CAST((o_orderkey % 120) * 12 + o_custkey % 10 AS DOUBLE) AS x,
               CAST(floor(o_orderkey / 120) * 12 + floor(o_custkey / 10) % 10 AS DOUBLE) AS y,
               o_totalprice / 1000 AS cell_area,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS cell_type,
               CAST(o_custkey % 10 + 1 AS STRING) AS cluster
        FROM {orders}""",
    "samples": """
        SELECT sample, CASE WHEN sample < 's3' THEN 'ctrl' ELSE 'treat' END AS condition, count(*) AS n_cells
        FROM {cells} GROUP BY sample""",
    "transcripts": """
        SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE c.cell_id END AS cell_id,
               'G' || CAST(l_partkey % 64 AS STRING) AS gene,
               c.x + (l_discount - 0.05) * 40 AS x, c.y + (l_tax - 0.04) * 40 AS y, l_quantity AS qv
        FROM {lineitem} l JOIN {cells} c ON c.cell_id = 'c' || CAST(l_orderkey AS STRING)""",
    "expr": """
        SELECT cell_id, gene, CAST(count(*) AS DOUBLE) AS value FROM {transcripts}
        WHERE cell_id IS NOT NULL AND qv >= 20 GROUP BY cell_id, gene""",
    "genes": """
        SELECT gene, min(CAST(substr(gene, 2) AS INT)) AS ord, min(CAST(substr(gene, 2) AS INT)) >= 56 AS is_imputed
        FROM {transcripts} GROUP BY gene""",
    "edges": """
        SELECT 's' || CAST(l_orderkey % 6 AS STRING) AS sample, 'c' || CAST(l_orderkey AS STRING) AS from_cell,
               'c' || CAST(CAST((floor(l_orderkey / 6) + l_linenumber) * 6 + l_orderkey % 6 AS BIGINT) AS STRING) AS to_cell,
               'L' || CAST(CASE WHEN l_linenumber = 1 THEN 8 + l_partkey % 400 ELSE l_partkey % 8 END AS STRING) AS ligand,
               'R' || CAST(l_suppkey % 4 AS STRING) AS receptor, l_discount * 10 AS attention_score
        FROM {lineitem}""",
    "cohort_edges": """
        SELECT 't' || CAST(l_orderkey % 10 AS STRING) AS sample, 'c' || CAST(l_orderkey AS STRING) AS from_cell,
               'c' || CAST(l_orderkey + l_linenumber * 10 AS STRING) AS to_cell, 'L' || CAST(l_partkey % 8 AS STRING) AS ligand,
               'R' || CAST(l_suppkey % 4 AS STRING) AS receptor, l_discount * 10 AS attention_score
        FROM {lineitem}
        UNION ALL
        SELECT 't' || CAST(l_orderkey % 10 AS STRING), 'c' || CAST(l_orderkey + 7 AS STRING), 'c' || CAST(l_orderkey AS STRING),
               'L' || CAST(l_partkey % 8 AS STRING), 'R' || CAST(l_suppkey % 4 AS STRING), l_tax * 10
        FROM {lineitem} WHERE l_orderkey % 10 >= 5 AND l_partkey % 8 < 3""",
    "cohort_samples": """
        SELECT sample, CASE WHEN sample < 't5' THEN 'ctrl' ELSE 'treat' END AS condition, count(DISTINCT from_cell) AS n_cells
        FROM {cohort_edges} GROUP BY sample""",
    "ppi": """
        SELECT DISTINCT 'G' || CAST(p_partkey % 64 AS STRING) AS source,
               'G' || CAST((p_partkey * 7 + p_size) % 64 AS STRING) AS target FROM {part} WHERE p_size <= 5""",
    "tf_target": """
        SELECT DISTINCT 'G' || CAST(s_suppkey % 64 AS STRING) AS tf,
               'G' || CAST((s_nationkey * 3) % 64 AS STRING) AS target FROM {supplier}""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS {double_array}) AS embedding, label FROM {embeddings}""",
    "boundaries": """
        SELECT cell_id, 'ref' AS kind, v AS vertex_ord,
               x + CASE WHEN v IN (0, 3) THEN -5 ELSE 5 END AS x, y + CASE WHEN v IN (0, 1) THEN -5 ELSE 5 END AS y
        FROM (SELECT *, {zero_to_three} AS v FROM {cells}) r
        UNION ALL
        SELECT cell_id, 'query' AS kind, v AS vertex_ord,
               x + 3 + CASE v WHEN 0 THEN 6 WHEN 2 THEN -6 ELSE 0 END AS x,
               y + 2 + CASE v WHEN 1 THEN 6 WHEN 3 THEN -6 ELSE 0 END AS y
        FROM (SELECT *, {zero_to_three} AS v FROM {cells}) q""",
}

DEPENDS = {
    "cells": ["orders"],
    "samples": ["cells"],
    "transcripts": ["lineitem", "cells"],
    "expr": ["transcripts"],
    "genes": ["transcripts"],
    "edges": ["lineitem"],
    "cohort_edges": ["lineitem"],
    "cohort_samples": ["cohort_edges"],
    "ppi": ["part"],
    "tf_target": ["supplier"],
    "vectors": ["embeddings"],
    "boundaries": ["cells"],
}

# the two places where the dialects differ
SPARK_WORDS = {"zero_to_three": "explode(array(0, 1, 2, 3))", "double_array": "array<double>"}
DUCKDB_WORDS = {"zero_to_three": "unnest([0, 1, 2, 3])", "double_array": "DOUBLE[]"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived (or raw) table as a DataFrame over the parquet files in ``sf_dir``."""
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {d: table(spark, sf_dir, d) for d in DEPENDS[name]}
    words = {k: v for k, v in SPARK_WORDS.items() if "{" + k + "}" in TEXT[name]}
    text = TEXT[name]
    for k, v in words.items():
        text = text.replace("{" + k + "}", v)
    return spark.sql(text, **inputs)


def with_tables(*names: str) -> str:
    """``WITH`` clause defining the named tables and whatever they need, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in order:
            return
        for d in DEPENDS[name]:
            visit(d)
        order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({TEXT[n].format(**{d: d for d in DEPENDS[n]}, **DUCKDB_WORDS)})" for n in order]
    return "WITH " + ",\n".join(parts)
