"""Imputation of unmeasured genes and label transfer from a reference dataset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.operators import genes as G
from cytomosaic.operators import matrix as M
from cytomosaic.operators.cells import majority_label
from cytomosaic.operators.indexing import dense_index
from cytomosaic.operators.knn import BROADCAST_BYTES, K_NEIGHBOURS, knn_join
from cytomosaic.session import cut_lineage


def neighbour_weights(neighbours: DataFrame) -> DataFrame:
    """Weight of each neighbour: only those nearer than 1 count; (1 - d / sum of d) / max(number of them - 1, 1)."""
    valid = neighbours.filter(F.col("distance") < 1)
    sums = valid.groupBy("query_id").agg(F.sum("distance").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    total = F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    weight = (1 - F.col("distance") / total) / F.greatest(F.col("_n") - 1, F.lit(1))
    return valid.join(sums, "query_id").select("query_id", "ref_id", weight.alias("weight"))


def weighted_values(weights: DataFrame, reference_expression: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Sum of weight x value over the neighbours: (cell_id, gene, value), for genes that one of the neighbours has.

    A reference whose counted table of cells x genes fits is sent to the tasks, which add up a query's neighbours there:
    what is shuffled is the neighbours alone. A larger one is multiplied block by block (``blocked_product``).
    """
    ref = reference_expression.select(F.col("ref_cell").alias("ref_id"), "gene", "value")
    n_cells, n_genes = ref.agg(F.countDistinct("ref_id"), F.countDistinct("gene")).first()
    if n_cells * (n_genes * 8 + 64) > broadcast_bytes:
        return blocked_product(weights, ref, n_cells)
    local = ref.groupBy("ref_id", "gene").agg(F.sum("value").alias("value")).toPandas()  # size checked above
    wide = local.pivot(index="ref_id", columns="gene", values="value")
    shipped = weights.sparkSession.sparkContext.broadcast((wide.index.to_numpy(), list(wide.columns), wide.to_numpy(dtype=float)))
    near = weights.groupBy("query_id").agg(F.collect_list("ref_id").alias("refs"), F.collect_list("weight").alias("weights"))  # k of each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, genes, values = shipped.value
        place = {v: i for i, v in enumerate(ids)}
        names = np.array(genes, dtype=object)
        for batch in batches:
            for query, refs, own in zip(batch["query_id"], batch["refs"], batch["weights"], strict=True):
                known = [(place[r], w) for r, w in zip(refs, own, strict=True) if r in place]
                if known:
                    rows = values[[p for p, _ in known]]
                    has = ~np.isnan(rows).all(axis=0)
                    total = np.array([w for _, w in known]) @ np.nan_to_num(rows[:, has])
                    yield pd.DataFrame({"cell_id": [query] * len(total), "gene": names[has], "value": total})

    kind = dict(weights.dtypes)["query_id"]
    return near.mapInPandas(run, f"cell_id {kind}, gene string, value double")


#: Sides of a block of reference rows x genes, weights in one slice of a block, queries summed up at once.
BLOCK_REFS, BLOCK_GENES, SLICE_WEIGHTS, BLOCK_QUERIES = 2_048, 1_024, 200_000, 64
#: Products held at once inside a task, in rows of a block.
WEIGHTS_AT_ONCE = 2_048


def blocked_product(weights: DataFrame, reference: DataFrame, n_refs: int) -> DataFrame:
    """Weights (query_id, ref_id, weight) times values (ref_id, gene, value): (cell_id, gene, value).

    References are dealt into blocks of rows and genes, which meet the weights of their rows in one task. A task adds up
    each query's neighbours in its block and passes on one sparse row, so there is no row for a query, neighbour and gene.
    A block with very many weights, as one with a hub, is met by slices of them.
    """
    types = dict(weights.dtypes)
    numbered = cut_lineage(dense_index(reference.select("gene").distinct(), "gene", "gene_no"))
    n_blocks = max(1, -(-n_refs // BLOCK_REFS))
    ref_block = F.pmod(F.xxhash64("ref_id"), F.lit(n_blocks)).cast("int").alias("ref_block")
    genes = F.broadcast(numbered) if numbered.count() <= M.SENT_GENES else numbered
    placed = reference.join(genes, "gene").groupBy(ref_block, F.floor(F.col("gene_no") / BLOCK_GENES).cast("int").alias("gene_block"), "ref_id", "gene_no")
    entry = F.struct((F.col("gene_no") % BLOCK_GENES).cast("int").alias("at"), "value")
    rows = placed.agg(F.sum("value").alias("value")).groupBy("ref_block", "gene_block", "ref_id").agg(F.collect_list(entry).alias("entries"))

    dealt = cut_lineage(weights.select("query_id", "ref_id", "weight", ref_block))
    slices = dealt.groupBy("ref_block").agg(F.ceil(F.count(F.lit(1)) / SLICE_WEIGHTS).cast("int").alias("n_slices"))  # a row for each block
    blocks = rows.join(slices, "ref_block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).drop("n_slices")
    own = F.pmod(F.xxhash64("query_id"), F.col("n_slices")).cast("int")
    last = numbered.agg(F.max("gene_no")).first()[0]
    gene_blocks = F.sequence(F.lit(0), F.lit((last or 0) // BLOCK_GENES))
    sent = dealt.join(slices, "ref_block").select("query_id", "ref_id", "weight", "ref_block", own.alias("slice"), F.explode(gene_blocks).alias("gene_block"))

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "gene_block": [], "at": [], "value": []}
        schema = pa.schema([("query_id", left.schema.field("query_id").type), ("gene_block", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
        if left.num_rows and right.num_rows:
            refs = {v: i for i, v in enumerate(right["ref_id"].to_pylist())}
            held = right["entries"].combine_chunks()
            owner = np.repeat(np.arange(len(refs)), np.asarray(held.value_lengths()))
            at, value = (np.asarray(held.flatten().field(c)) for c in ("at", "value"))
            dense, has = np.zeros((len(refs), BLOCK_GENES)), np.zeros((len(refs), BLOCK_GENES), bool)
            dense[owner, at], has[owner, at] = value, True
            left = left.sort_by("query_id")
            ids = left["query_id"].to_pylist()
            row = np.fromiter((refs.get(v, -1) for v in left["ref_id"].to_pylist()), np.int64, len(ids))
            weight = left["weight"].to_numpy()
            known = row >= 0
            ids, row, weight = [v for v, k in zip(ids, known, strict=True) if k], row[known], weight[known]
            starts = np.array([i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]], np.int64)
            step = 0
            while step < len(starts):  # whole queries, about so many weights at once
                begin = starts[step]
                stop = max(int(np.searchsorted(starts, begin + WEIGHTS_AT_ONCE, "right")) - 1, step + 1)
                end = starts[stop] if stop < len(starts) else len(ids)
                first = starts[step:stop] - begin
                sums = np.add.reduceat(weight[begin:end, None] * dense[row[begin:end]], first)
                any_has = np.logical_or.reduceat(has[row[begin:end]], first)
                for k in range(stop - step):
                    places = np.flatnonzero(any_has[k])
                    if len(places):
                        out["query_id"].append(ids[starts[step + k]])
                        out["at"].append(places.astype(np.int32))
                        out["value"].append(sums[k, places])
                step = stop
            out["gene_block"] = [right["gene_block"][0].as_py()] * len(out["query_id"])
        return pa.table(out, schema=schema)

    def add(table: pa.Table) -> pa.Table:
        ids = table["query_id"].to_pylist()
        place = {v: i for i, v in enumerate(dict.fromkeys(ids))}
        sums, has = np.zeros((len(place), BLOCK_GENES)), np.zeros((len(place), BLOCK_GENES), bool)
        for query, at, value in zip(ids, table["at"], table["value"], strict=True):
            where = at.values.to_numpy()
            sums[place[query], where] += value.values.to_numpy()
            has[place[query], where] = True
        row, at = np.nonzero(has)
        names = pa.array(list(place), table.schema.field("query_id").type)
        number = at + table["gene_block"][0].as_py() * BLOCK_GENES
        return pa.table({"cell_id": names.take(pa.array(row)), "gene_no": pa.array(number, pa.int64()), "value": pa.array(sums[row, at])})

    keys = ["ref_block", "slice", "gene_block"]
    partial = sent.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(multiply, f"query_id {types['query_id']}, gene_block int, at array<int>, value array<double>")
    n_groups = max(1, -(-dealt.select("query_id").distinct().count() // BLOCK_QUERIES))
    group = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("_group")
    summed = partial.groupBy(group, "gene_block").applyInArrow(add, f"cell_id {types['query_id']}, gene_no long, value double")
    return summed.join(genes, "gene_no").select("cell_id", "gene", "value")


def align(query: DataFrame, reference: DataFrame, width: int, n_vectors: int = M.N_PRINCIPAL_VECTORS) -> tuple[DataFrame, DataFrame, M.Alignment]:
    """Both sets z-scored and projected on the reference's principal vectors; inputs are (id, sparse or dense row)."""
    found = [M.columns(rows, width) for rows in (query, reference)]
    n = min(n_vectors, width)
    (_, own), (_, theirs) = (M.leading(rows, width, n, c.mean, c.scale) for rows, c in zip((query, reference), found, strict=True))
    pairs = M.principal_vectors(theirs, own)
    q, r = (M.project(rows, pairs.loadings * c.scale[:, None], c.mean, ["id"]) for rows, c in zip((query, reference), found, strict=True))
    return q, r, pairs


def as_rows(expression: DataFrame, id_col: str, genes: Sequence[str], cells: DataFrame) -> DataFrame:
    """(id, at, value), written, as it is read in each pass."""
    long = expression.select(F.col(id_col).alias("cell_id"), "gene", "value")
    return cut_lineage(M.gene_rows(long, genes, cells.select(F.col(id_col).alias("cell_id"))).withColumnRenamed("cell_id", "id"))


def impute_vectors(query: DataFrame, reference: DataFrame, width: int, targets: DataFrame,
                   n_vectors: int = M.N_PRINCIPAL_VECTORS, k: int = K_NEIGHBOURS) -> DataFrame:
    """Impute ``targets`` (ref_cell, gene, value) for the query from rows over the shared genes."""
    q, r, _ = align(query, reference, width, n_vectors)
    near = cut_lineage(knn_join(cut_lineage(q), cut_lineage(r), k, "cosine"))
    return weighted_values(neighbour_weights(near), targets)


def impute(
    cells: DataFrame,
    expression: DataFrame,
    genes: DataFrame,
    reference_cells: DataFrame,
    reference_genes: DataFrame,
    reference_expression: DataFrame,
    wanted: DataFrame | None = None,
    n_vectors: int = M.N_PRINCIPAL_VECTORS,
    k: int = K_NEIGHBOURS,
    use_corrected: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Expression and gene tables extended by imputed genes.

    ``wanted`` = (gene, ord) names the genes; without it the most variable reference genes outside the panel are taken.
    Reference values are log-normalised already; the query's counts are normalised over the shared genes.
    """
    if use_corrected and expression.filter(F.col("layer") == G.CORRECTED).isEmpty():
        raise ValueError("there is no corrected layer to impute from")
    panel = G.panel_genes(genes)
    shared = [r.gene for r in G.shared_genes(panel, reference_genes).collect()]
    if wanted is None:
        n_ref = reference_cells.agg(F.count(F.lit(1))).scalar()
        chosen = G.variable_genes(reference_genes, panel, reference_expression, n_ref)
        targets = [r.gene for r in chosen.collect()]
    else:
        status = G.requested_genes(wanted, reference_genes, panel).filter(F.col("status") == "impute")
        targets = [r.gene for r in status.orderBy("ord").collect()]
    if not targets:
        raise ValueError("no gene to impute: all are missing from the reference or already in the panel")
    layer = expression.filter(F.col("layer") == (G.CORRECTED if use_corrected else G.RAW))
    spark = expression.sparkSession
    listed = {n: F.broadcast(spark.createDataFrame([(g,) for g in names], "gene string")) for n, names in (("shared", shared), ("targets", targets))}
    normal = M.log_normalise(layer.join(listed["shared"], "gene", "left_semi"))
    query = as_rows(normal, "cell_id", shared, cells)
    reference = as_rows(reference_expression, "ref_cell", shared, reference_cells)
    target_values = reference_expression.join(listed["targets"], "gene", "left_semi")
    values = impute_vectors(query, reference, len(shared), target_values, n_vectors, k)
    return G.append_imputed(expression, genes, values, targets, use_corrected)


def transfer_labels(
    cells: DataFrame, expression: DataFrame, reference_cells: DataFrame, reference_expression: DataFrame,
    reference_labels: DataFrame, shared: Sequence[str], n_components: int = M.MAX_COMPONENTS, k: int = K_NEIGHBOURS,
) -> DataFrame:
    """Majority label among the nearest reference cells in the reference's principal components: (cell_id, label, votes).

    Both sets are log-normalised over the shared genes and z-scored on their own.
    """
    listed = F.broadcast(expression.sparkSession.createDataFrame([(g,) for g in shared], "gene string"))  # one panel
    query = as_rows(M.log_normalise(expression.join(listed, "gene", "left_semi")), "cell_id", shared, cells)
    ref_long = reference_expression.join(listed, "gene", "left_semi").withColumnRenamed("ref_cell", "cell_id")
    reference = as_rows(M.log_normalise(ref_long), "cell_id", shared, reference_cells.withColumnRenamed("ref_cell", "cell_id"))
    return vote(query, reference, reference_labels, len(shared), n_components, k)


def vote(query: DataFrame, reference: DataFrame, reference_labels: DataFrame, width: int,
         n_components: int = M.MAX_COMPONENTS, k: int = K_NEIGHBOURS) -> DataFrame:
    q, r = M.columns(query, width), M.columns(reference, width)
    _, loadings = M.leading(reference, width, max(1, min(n_components, r.n - 1, width)), r.mean, r.scale)
    # written, as a search reads its sides several times and beside the tasks' workers for the product
    sides = [M.project(rows, loadings * c.scale[:, None], c.mean, ["id"]) for rows, c in ((query, q), (reference, r))]
    near = knn_join(*[cut_lineage(side) for side in sides], k)
    labels = reference_labels.select(F.col("ref_cell").alias("ref_id"), "label")
    return majority_label(near.join(labels, "ref_id"), "query_id").withColumnRenamed("query_id", "cell_id")

