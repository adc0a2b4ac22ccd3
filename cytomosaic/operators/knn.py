"""Exact nearest neighbours between two sets of vectors.

Tables are (id, features array<double>). Distances are 1 - cosine, or Euclidean. Ties go to the smaller id after
rounding distances to twelve decimals.

A reference set whose measured size fits the limit is broadcast and every task handles a bounded number of pairs. A larger one
is split by nearest pivot into blocks of bounded size. A query is first searched in the blocks that surely hold enough
rows nearest to it; the k-th distance found there and the triangle inequality tell which blocks can hold one of its
k nearest. Blocks are put together into groups of many thousand rows, a query goes once to each group that has a possible
block, and there only rows within its bound are looked at closely; the results of groups are merged. Nothing is left out
either way. In many dimensions without clusters most blocks stay possible, and exact search is then near all pairs: a query
becomes a row for each group then, not for each block.

Cells with few counts often have equal vectors. Where at least half of the rows of a large table do, each vector is searched
once on either side, and its neighbours go to all its rows; where fewer do, rows are searched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.operators.indexing import dense_index
from cytomosaic.operators.skew import sliced_join, sliced_sides
from cytomosaic.session import cut_lineage

# fixed values
K_NEIGHBOURS = 50
DIGITS = 12

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4_096
MAX_BLOCKS = 20_000
#: Rows of either side that meet in one task of the second search.
GROUP_ROWS = 32_768
#: Distances held at once in a task, references and queries measured together, and pairs of one task.
CHUNK_CELLS, SEARCH_ROWS, SEARCH_QUERIES, TASK_PAIRS = 1_000_000, 8_192, 4_096, 500_000_000
#: Distances to blocks of one task.
TASK_CELLS = 20_000_000
#: Rows of one vector that get its neighbours in one task, and different vectors of a row at most where each is searched once.
SLICE_ROWS, MOST_DIFFERENT = 20_000, 0.5


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of prepared rows: unit vectors for cosine."""
    if metric == "cosine":
        return np.round(1.0 - q @ r.T, DIGITS)
    # summed over differences: the form with squared lengths loses half the digits of small distances
    square = np.zeros((len(q), len(r)))
    for a, b in zip(q.T, r.T, strict=True):
        gap = a[:, None] - b[None, :]
        gap *= gap
        square += gap
    np.sqrt(square, out=square)
    return np.round(square, DIGITS, out=square)


def _result_schema(queries: DataFrame, references: DataFrame) -> str:
    types = dict(queries.dtypes)["id"], dict(references.dtypes)["id"]
    return f"query_id {types[0]}, ref_id {types[1]}, distance double"


def knn_join(
    queries: DataFrame,
    references: DataFrame,
    k: int = K_NEIGHBOURS,
    metric: str = "cosine",
    not_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    n_pivots: int | None = None,
) -> DataFrame:
    """(query_id, ref_id, distance, place) with place 1..k. ``not_self`` leaves out pairs of equal id."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    n, width = references.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    limits = broadcast_bytes, block_rows, n_pivots
    if not not_self and n * (width * 8 + 64) > broadcast_bytes:
        near = _by_vectors(queries, references, n, width, k, metric, *limits)
        if near is not None:
            return near
    return _placed(_search(queries, references, n, width, k, metric, not_self, *limits), k)


def _placed(near: DataFrame, k: int) -> DataFrame:
    order = W.Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _search(
    queries: DataFrame, references: DataFrame, n: int, width: int, k: int, metric: str, not_self: bool, broadcast_bytes: int,
    block_rows: int, n_pivots: int | None, different: bool = False,
) -> DataFrame:
    """(query_id, ref_id, distance) with the k nearest of each query and maybe more; ``different`` if no reference equals another."""
    if n * (width * 8 + 64) <= broadcast_bytes:
        return _by_broadcast(queries, references, n, k, metric, not_self, different)
    # the list of blocks goes to every task, so its length is held while blocks grow with the data
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    # about two pivots per full block: many small blocks would send each query to more places than they rule out
    n_pivots = n_pivots or min(max(2 * n // block_rows, 8), 2_048)
    return _by_blocks(queries, references, k, metric, not_self, block_rows, n_pivots, different)


def _by_vectors(
    queries: DataFrame, references: DataFrame, n: int, width: int, k: int, metric: str, broadcast_bytes: int, block_rows: int,
    n_pivots: int | None,
) -> DataFrame | None:
    """The k nearest, each different vector of either side searched once; None where too few rows are equal.

    A reference vector stands for its first k ids and is known by a number in the order of the first of them. The k nearest
    rows are then among the rows of the k nearest vectors, ties by number. Vectors of queries are known by 128 bits. Null ids
    come last where ties are cut.
    """
    keys = ["_h1", "_h2"]
    hashed = queries.select("id", "features", F.xxhash64("features").alias("_h1"), F.xxhash64(F.lit(1), "features").alias("_h2"))
    asked = cut_lineage(hashed.select(*keys, "features").distinct().withColumn("_vec", F.monotonically_increasing_id()))
    ids = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id")))  # k at most
    held = cut_lineage(_first_copies(references, k).groupBy("features").agg(ids.alias("ids")))
    n_different = held.count()
    if asked.count() + n_different > MOST_DIFFERENT * (queries.count() + n):
        return None
    first = held.select("features", "ids", F.size("ids").alias("n"), F.col("ids")[0]["id"].alias("first"))
    number = F.when(F.col("first").isNull(), F.col("ref_id") + n_different).otherwise(F.col("ref_id"))
    numbered = cut_lineage(dense_index(first, "first", "ref_id").withColumn("ref_id", number).drop("first"))
    near = _search(
        asked.select(F.col("_vec").alias("id"), "features"), numbered.select(F.col("ref_id").alias("id"), "features"),
        n_different, width, k, metric, False, broadcast_bytes, block_rows, n_pivots, different=True,
    )
    # vectors are needed until those strictly nearer hold k rows
    sized = _placed(near, k).drop("place").join(numbered.select("ref_id", "n"), "ref_id")
    upto = F.sum("n").over(W.Window.partitionBy("query_id").orderBy("distance"))
    nearer = upto - F.sum("n").over(W.Window.partitionBy("query_id", "distance"))
    needed = sized.withColumn("_nearer", nearer).filter(F.col("_nearer") < k).select("query_id", "ref_id", "distance")
    rows = needed.join(numbered.select("ref_id", "ids"), "ref_id").select("query_id", F.explode("ids").alias("r"), "distance")
    cut = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "r"))
    rows = rows.withColumn("_cut", cut).filter(F.col("_cut") <= k).select("query_id", F.col("r.id").alias("ref_id"), "distance")
    rows = _placed(rows, k)
    lists = rows.groupBy(F.col("query_id").alias("_vec")).agg(F.collect_list(F.struct("ref_id", "distance", "place")).alias("near"))
    told = cut_lineage(asked.select("_vec", *keys).join(lists, "_vec").drop("_vec"))
    met = sliced_join(hashed.select("id", *keys), told, keys, F.col("id"), F.col("_h1"), SLICE_ROWS)
    out = met.select(F.col("id").alias("query_id"), F.explode("near").alias("r")).select("query_id", "r.ref_id", "r.distance", "r.place")
    if queries.groupBy("id").count().filter("count > 1").isEmpty():
        return out
    return _placed(out.drop("place"), k)  # rows of one id share their places


def _first_copies(references: DataFrame, n: int) -> DataFrame:
    """Of equal vectors only the first few ids can be among the nearest."""
    copies = F.row_number().over(W.Window.partitionBy("features").orderBy("id"))
    return references.select("id", "features").withColumn("_copy", copies).filter(F.col("_copy") <= n).drop("_copy")


def _by_broadcast(
    queries: DataFrame, references: DataFrame, n_refs: int, k: int, metric: str, not_self: bool, different: bool = False
) -> DataFrame:
    held = references.select("id", "features") if not_self or different else _first_copies(references, k)
    local = held.toArrow().sort_by("id").combine_chunks()  # size checked by the caller
    shipped = queries.sparkSession.sparkContext.broadcast((local["id"].combine_chunks(), _rows(local["features"], metric) if len(local) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref_ids, ref = shipped.value
        for batch in batches:
            if batch.num_rows and len(ref_ids):
                yield from _found(pa.Table.from_batches([batch]), ref_ids, ref, None, k, metric, not_self).to_batches()

    # few files of queries may make up many pairs
    n_tasks = -(-queries.count() * n_refs // TASK_PAIRS)
    rows = queries.select("id", "features")
    return (rows.repartition(n_tasks, "id") if n_tasks > 1 else rows).mapInArrow(run, _result_schema(queries, references))


def _by_blocks(
    queries: DataFrame, references: DataFrame, k: int, metric: str, not_self: bool, block_rows: int, n_pivots: int, different: bool = False
) -> DataFrame:
    """Pivot blocks. For cosine all rows become unit vectors, where Euclidean order is cosine order."""
    sc = queries.sparkSession.sparkContext
    unit = metric == "cosine"
    wanted = k + 1 if not_self else k
    if not different:
        references = cut_lineage(_first_copies(references, wanted))  # the limit applies before the shuffle
    chosen = references.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    pivots = np.unique(_unit(_matrix(chosen["features"])) if unit else _matrix(chosen["features"]), axis=0)
    pivot_bc = sc.broadcast(pivots)

    def prepared(batch: pd.DataFrame) -> np.ndarray:
        m = _matrix(batch["features"])
        return _unit(m) if unit else m

    def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = max(1, CHUNK_CELLS // len(pivot_bc.value))
                for start in range(0, len(batch), rows):
                    part = batch.iloc[start : start + rows]
                    d = _distances(prepared(part), pivot_bc.value, "euclidean")
                    at = d.argmin(axis=1)
                    yield part.assign(pivot=at.astype(np.int32), to_pivot=d[np.arange(len(at)), at])

    ref_id, query_id = dict(references.dtypes)["id"], dict(queries.dtypes)["id"]
    assigned = references.select("id", "features").mapInPandas(
        nearest_pivot, f"id {ref_id}, features array<double>, pivot int, to_pivot double"
    )
    # shells of equal width around the pivot keep the distance bounds of a block narrow; slices bound its size
    spans = assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("far")).toPandas()
    shells = {int(p): max(1, -(-int(c) // block_rows)) for p, c in zip(spans["pivot"], spans["n"], strict=True)}
    far = {int(p): float(f) for p, f in zip(spans["pivot"], spans["far"], strict=True)}
    n_shells = F.element_at(F.create_map(*[F.lit(v) for p, s in shells.items() for v in (p, s)]), F.col("pivot"))
    reach = F.element_at(F.create_map(*[F.lit(v) for p, f in far.items() for v in (p, f)]), F.col("pivot"))
    shell = F.least(F.floor(F.coalesce(F.try_divide("to_pivot", reach), F.lit(0.0)) * n_shells), n_shells - 1).cast("int")
    shelled = assigned.withColumn("shell", shell)
    sizes = shelled.groupBy("pivot", "shell").agg(
        F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("lo"), F.max("to_pivot").alias("hi")
        ).toPandas()  # at most MAX_BLOCKS + pivots rows
    table = (
        sizes["pivot"].to_numpy(), sizes["shell"].to_numpy(), sizes["n"].to_numpy(), sizes["lo"].to_numpy(), sizes["hi"].to_numpy(),
    )
    # two cosine distances count as tied below 1e-12, which is this much in squared length: a block of ties stays in
    slack = 4e-12

    def home_blocks(d: np.ndarray, b_n: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
        """Per query and block, whether it is among the surely nearest blocks that together hold enough rows."""
        order = np.argsort(d + b_hi, axis=1, kind="stable")
        held = np.cumsum(b_n[order], axis=1)
        needed = np.concatenate([np.ones((len(d), 1), dtype=bool), held[:, :-1] < wanted], axis=1)
        home = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(home, order, needed, axis=1)
        return home

    # blocks in order of pivot and shell make up groups; a group is searched as a whole
    table_order = np.lexsort((table[1], table[0]))
    table = tuple(column[table_order] for column in table)
    held_before = np.cumsum(table[2]) - table[2]
    _, group_starts, group_of = np.unique(held_before // GROUP_ROWS, return_index=True, return_inverse=True)
    table_bc = sc.broadcast((*table, group_starts))

    def distances(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Parts of a batch with their distances to the pivots of all blocks."""
        b_pivot = table_bc.value[0]
        rows = max(1, CHUNK_CELLS // max(1, len(b_pivot)))
        for start in range(0, len(batch), rows):
            part = batch.iloc[start : start + rows]
            yield part, _distances(prepared(part), pivot_bc.value, "euclidean")[:, b_pivot]

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b_pivot, b_shell, b_n, _, b_hi, _ = table_bc.value
        for batch in batches:
            for part, d in distances(batch):
                row, col = np.nonzero(home_blocks(d, b_n, b_hi))
                sent = part[["id", "features"]].iloc[row]
                yield sent.assign(pivot=b_pivot[col].astype(np.int32), shell=b_shell[col].astype(np.int32))

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, _, b_lo, b_hi, starts = table_bc.value
        for batch in batches:
            for part, d in distances(batch):
                # the k-th distance found at home is the bound; a query that found fewer has none
                found = part["bound"].to_numpy(dtype=float)
                found = np.where(np.isnan(found), np.inf, found)
                bound = np.sqrt(2 * found) if unit else found
                bound = np.sqrt(bound * bound + slack) * (1 + 1e-9) + 1e-9
                chosen = np.maximum(np.maximum(d - b_hi, b_lo - d), 0.0) <= bound[:, None]
                groups = np.logical_or.reduceat(chosen, starts, axis=1)
                yield part[["id", "features"]].assign(bound=found, groups=[np.flatnonzero(g).astype(np.int32) for g in groups])

    n_tasks = -(-queries.count() * len(table[0]) // TASK_CELLS)
    if n_tasks > 1:  # few files of queries may make up many distances to blocks
        queries = queries.select("id", "features").repartition(n_tasks, "id")
    search = _BlockSearch(cut_lineage(shelled), block_rows, k, metric, not_self, _result_schema(queries, references))
    at_home = cut_lineage(queries.select("id", "features").mapInPandas(home, f"id {query_id}, features array<double>, pivot int, shell int"))
    order = W.Window.partitionBy("query_id").orderBy("distance", "ref_id")
    kth = search.run(at_home).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == k)
    bounded = queries.select("id", "features").join(kth.select(F.col("query_id").alias("id"), F.col("distance").alias("bound")), "id", "left")
    routed = cut_lineage(bounded.mapInPandas(possible, f"id {query_id}, features array<double>, bound double, groups array<int>"))
    groups = queries.sparkSession.createDataFrame(
        [(int(p), int(s), int(g)) for p, s, g in zip(table[0], table[1], group_of, strict=True)], "pivot int, shell int, grp int"
    )
    grouped = search.shelled.join(F.broadcast(groups), ["pivot", "shell"]).select("id", "features", "grp")
    return _within_groups(routed.withColumn("grp", F.explode("groups")).drop("groups"), grouped, k, metric, not_self)


def _within_groups(routed: DataFrame, grouped: DataFrame, k: int, metric: str, not_self: bool) -> DataFrame:
    """The k nearest rows within its bound of each (id, features, bound, grp) among the rows (id, features, grp) of its group."""
    own = F.struct("id", "features")
    sides = sliced_sides(routed, grouped, ["grp"], own, own, GROUP_ROWS)
    keys = ["grp", "_ls", "_rs"] if sides else ["grp"]
    routed, grouped = sides or (routed, grouped)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", left.schema.field("id").type), ("ref_id", right.schema.field("id").type), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        return _found(left, right["id"], _rows(right["features"], metric), left["bound"].to_numpy(), k, metric, not_self)

    return routed.groupBy(*keys).cogroup(grouped.groupBy(*keys)).applyInArrow(meet, _result_schema(routed, grouped))


def _found(queries: pa.Table, ref_ids: pa.Array | pa.ChunkedArray, r: np.ndarray, bound: np.ndarray | None, k: int, metric: str, not_self: bool) -> pa.Table:
    """(query_id, ref_id, distance) of the k nearest of ``r``, sorted by id, for each row of (id, features)."""
    parts = []
    for start in range(0, len(queries), SEARCH_QUERIES):
        part = queries.slice(start, SEARCH_QUERIES)
        own = np.full(len(part), np.inf) if bound is None else bound[start : start + SEARCH_QUERIES]
        q_code, r_code = _id_codes(part["id"], ref_ids) if not_self else (None, None)
        row, col, value = _nearest(_rows(part["features"], metric), r, own, k, metric, q_code, r_code)
        columns = [part["id"].take(pa.array(row)), ref_ids.take(pa.array(col)), pa.array(value)]
        parts.append(pa.table(columns, names=["query_id", "ref_id", "distance"]))
    return pa.concat_tables(parts)


def _rows(features: pa.ChunkedArray, metric: str) -> np.ndarray:
    if features.null_count:
        raise ValueError("a row without features has no neighbours")
    flat = features.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(features), -1).astype(np.float64, copy=False)
    return _unit(m) if metric == "cosine" else m


def _id_codes(left: pa.ChunkedArray, right: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are; a missing id equals none."""
    both = pa.chunked_array([*left.chunks, *(right.chunks if isinstance(right, pa.ChunkedArray) else [right])]).combine_chunks().dictionary_encode()
    code = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    q, r = code[: len(left)].copy(), code[len(left) :]
    q[q < 0] = -2
    return q, r


def _nearest(
    q: np.ndarray, r: np.ndarray, bound: np.ndarray, k: int, metric: str, q_code: np.ndarray | None, r_code: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_nearest_within`` a part of ``r`` after the other: the k-th distance found so far is the bound in the next part."""
    row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = bound.astype(float)
    for start in range(0, len(r), SEARCH_ROWS):
        part = slice(start, start + SEARCH_ROWS)
        own = _nearest_within(q, r[part], bound, k, metric, q_code, None if r_code is None else r_code[part])
        row, col, value = np.concatenate([row, own[0]]), np.concatenate([col, own[1] + start]), np.concatenate([value, own[2]])
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == k - 1
        bound[row[last]] = value[last]
        kept = place < k
        row, col, value = row[kept], col[kept], value[kept]
    return row, col, value


def _nearest_within(
    q: np.ndarray, r: np.ndarray, bound: np.ndarray, k: int, metric: str, q_code: np.ndarray | None, r_code: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, distance) of the k nearest within each row's bound; ``r`` is sorted by id.

    A product of short floats rules out what is surely farther than the bound, or than the k-th of a part of the rows; its
    error is bounded from above. What is left is measured row by row.
    """
    width = q.shape[1]
    if metric == "cosine":
        # half the squared distance of unit vectors; sums of ``width`` products of short floats
        left, right, error = q.astype(np.float32), r.astype(np.float32).T, (width + 8) * 1.2e-7 + 2 * 10.0**-DIGITS
        q_half = r_half = None
        limit = bound + error
    else:
        left, right = q, r.T
        q_half, r_half = (q * q).sum(axis=1) / 2, (r * r).sum(axis=1) / 2
        error = (width + 8) * 2.3e-16 * 4 * (q_half + r_half[np.isfinite(r_half)].max(initial=0.0))
        limit = (bound + 2 * 10.0**-DIGITS) ** 2 / 2 * (1 + 1e-12) + error
    found = ([], [], [])
    rows = max(1, CHUNK_CELLS // max(1, len(r)))
    for start in range(0, len(q), rows):
        part = slice(start, start + rows)
        near = left[part] @ right
        near = np.subtract(1, near, out=near) if q_half is None else q_half[part, None] + r_half[None, :] - near
        most = limit[part].astype(near.dtype) * (1 + 1e-6 if near.dtype == np.float32 else 1)
        if q_code is not None:
            near[q_code[part][:, None] == r_code[None, :]] = np.inf
        at = np.flatnonzero((near <= most[:, None]) & (near < np.inf))
        row, col = np.divmod(at, len(r))
        if len(row) > 4 * k * len(near) and len(r) > k:  # a wide bound: the k-th of the product and twice its error are a closer one
            slack = 2 * (error if q_half is None else error[part, None])
            near[np.isnan(near)] = np.inf
            kth = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack + 4 * 10.0**-DIGITS
            if q_half is not None:  # distances tie after rounding, not their squares
                kth = (np.sqrt(2 * np.maximum(kth, 0)) + 2 * 10.0**-DIGITS) ** 2 / 2
            kept = near[row, col] <= kth[row, 0]
            row, col = row[kept], col[kept]
        row = row + start
        value = np.concatenate([np.zeros(0), *[_pairwise(q[row[i : i + 10_000]], r[col[i : i + 10_000]], metric) for i in range(0, len(row), 10_000)]])
        kept = value <= bound[row]
        row, col, value = row[kept], col[kept], value[kept]
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        for out, v in zip(found, (row, col, value), strict=True):
            out.append(v[kept])
    return tuple(np.concatenate(v) for v in found)


def _pairwise(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows side by side."""
    if metric == "cosine":
        return np.round(1.0 - np.einsum("ij,ij->i", q, r), DIGITS)
    gap = q - r
    return np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), DIGITS)


class _BlockSearch:
    """The nearest rows of each routed query in each of its blocks."""

    def __init__(self, shelled: DataFrame, block_rows: int, k: int, metric: str, not_self: bool, schema: str):
        self.shelled, self.block_rows, self.k, self.metric = shelled, block_rows, k, metric
        self.not_self, self.schema = not_self, schema

    def run(self, routed: DataFrame) -> DataFrame:
        block_rows, k, metric, not_self, shelled = self.block_rows, self.k, self.metric, self.not_self, self.shelled
        # both sides of a block are cut into slices of at most about block_rows rows, and every slice meets every other
        per_block = routed.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("_q")).join(
            shelled.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("_r")), ["pivot", "shell"]
        )
        cuts = F.broadcast(  # one row per block
            per_block.select(
                "pivot", "shell", F.ceil(F.col("_q") / block_rows).cast("int").alias("_qn"), F.ceil(F.col("_r") / block_rows).cast("int").alias("_rn")
            )
        )

        def cut(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
            return (
                df.join(cuts, ["pivot", "shell"])
                .withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .select("id", "features", "pivot", "shell", "_qs", "_rs")
            )

        keys = ["pivot", "shell", "_qs", "_rs"]
        q_side, r_side = cut(routed, "_qs", "_qn", "_rs", "_rn"), cut(shelled, "_rs", "_rn", "_qs", "_qn")

        def meet(q: pa.Table, r: pa.Table) -> pa.Table:
            if not q.num_rows or not r.num_rows:
                types = [q.schema.field("id").type, r.schema.field("id").type, pa.float64()]
                return pa.schema(list(zip(("query_id", "ref_id", "distance"), types, strict=True))).empty_table()
            r = r.sort_by("id")
            return _found(q, r["id"], _rows(r["features"], metric), None, k, metric, not_self)

        return q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInArrow(meet, self.schema)
