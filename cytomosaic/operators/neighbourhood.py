"""Cell-type statistics on the neighbour graph, communication summaries and signalling paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.functions.scalar import edge_width, observed_over_expected
from cytomosaic.operators import pyramid
from cytomosaic.operators.spatial import neighbour_graph, neighbour_pairs
from cytomosaic.session import cut_lineage

# fixed values
HOPS = 2
TOP_PAIRS = 30

MAX_TYPES = 500


def _slides(cells: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The cells and the columns that tell slides apart; without any, one constant column stands for the only slide."""
    return (cells.dropna(subset=list(by)), list(by)) if by else (cells.withColumn("_slide", F.lit(0)), ["_slide"])


def typed_points(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positions with a type and how many cells share both; copies collapse before any join."""
    return (
        cells.dropna(subset=["cell_type", "x", "y"])
        .groupBy(*by, "x", "y", "cell_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("point", F.struct("x", "y", "cell_type"))
    )


def _pair_types(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("type_a"), F.greatest(a, b).alias("type_b")]


def binned_pairs(cells: DataFrame, radii: Sequence[float], by: Sequence[str] = (), leaf: float | None = None) -> DataFrame:
    """(by, type_a, type_b, step, n) with n unordered cell pairs whose distance is the first to fit in radius number ``step``.

    Where the last radius holds many points, pairs of tiles are counted at once (see ``pyramid``); ``leaf`` sets the width of
    the lowest tiles, a power of two, instead of the measured one. Else pairs are listed, which is less work there.
    """
    points = cut_lineage(typed_points(cells, by))  # read by both sides of the joins, the choice and the count of rows per tile
    leaf = leaf or pyramid.leaf_size(points, radii[-1], by)
    if leaf:
        return pyramid.binned_pairs(points, radii, leaf, by)
    apart = neighbour_pairs(points, radii[-1], "point", ["cell_type", "n"], by).select(
        *by, *_pair_types(F.col("a_cell_type"), F.col("b_cell_type")), "distance", (F.col("a_n") * F.col("b_n")).alias("n")
    )
    same = points.filter(F.col("n") > 1).select(
        *by, F.col("cell_type").alias("type_a"), F.col("cell_type").alias("type_b"), F.lit(0.0).alias("distance"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"),
    )
    step = F.array_position(F.transform(F.array(*[F.lit(float(r)) for r in radii]), lambda r: F.col("distance") <= r), True)
    return apart.union(same).groupBy(*by, "type_a", "type_b", step.cast("int").alias("step")).agg(F.sum("n").alias("n"))


def contact_counts(cells: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Contacts per unordered pair of cell types: cell pairs at most ``radius`` apart, on each slide that ``by`` tells apart."""
    return binned_pairs(cells, [radius], by).select(*by, "type_a", "type_b", F.col("n").alias("n_contacts"))


def type_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.dropna(subset=["cell_type"]).groupBy(*by, "cell_type").agg(F.count(F.lit(1)).alias("n"))


def type_names(counts: DataFrame) -> list[str]:
    """The types in name order; an error if there are more than a table of type pairs can hold."""
    found = counts.orderBy("cell_type").limit(MAX_TYPES + 1).collect()
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} cell types")
    return [r.cell_type for r in found]


def _with_type_counts(pairs: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(*by, F.col("cell_type").alias(f"type_{side}"), F.col("n").alias(f"n_{side}")), [*by, f"type_{side}"])
    return pairs


def normalised_contacts(contacts: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Contacts over what random mixing would give: observed / (share A x share B x all contacts), on each slide."""
    cells, slide = _slides(cells, by)
    if not by:
        contacts = contacts.withColumn("_slide", F.lit(0))
    counts = type_counts(cells, slide)
    sizes = counts.groupBy(*slide).agg(F.sum("n").alias("_cells"))
    totals = contacts.groupBy(*slide).agg(F.sum("n_contacts").alias("_total"))
    joined = _with_type_counts(contacts, counts, slide).join(sizes, slide).join(totals, slide)
    share_a, share_b = F.col("n_a") / F.col("_cells"), F.col("n_b") / F.col("_cells")
    return joined.select(
        *by, "type_a", "type_b", "n_contacts", observed_over_expected("n_contacts", share_a, share_b, F.col("_total")).alias("oe")
    )


def neighbourhood_enrichment(cells: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Z-score of each type pair's contacts against shuffled labels, on each slide that ``by`` tells apart.

    Mean and standard deviation over all label permutations follow in closed form from the type counts, the number of
    contacts M and the number S of ordered contact pairs that share a cell, so no shuffling takes place: two contacts
    are the same, share one cell, or are disjoint, and each case has a known chance of carrying the labels.
    """
    typed, slide = _slides(cells.dropna(subset=["cell_type", "x", "y"]), by)
    counts = cut_lineage(type_counts(typed, slide))  # one row per slide and type
    type_names(counts.select("cell_type").distinct())
    ends = {s: counts.select(*slide, F.col("cell_type").alias(f"type_{s}"), F.col("n").alias(f"n_{s}")) for s in ("a", "b")}
    grid = ends["a"].join(ends["b"], slide).filter(F.col("type_a") <= F.col("type_b"))

    points = cut_lineage(typed_points(typed, slide))
    pairs = neighbour_pairs(points, radius, "point", ["n", "cell_type"], slide)

    def seen_from(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"{own}_point").alias("point"), F.col(f"{own}_n").alias("n"), F.col(f"{other}_cell_type").alias("near"), F.col(f"{other}_n").alias("d")
        )

    # neighbours of each point by type: at most points x types rows, from which contacts and degrees both follow
    alone = points.select(*slide, "point", "n", F.col("cell_type").alias("near"), (F.col("n") - 1).alias("d"))
    around = pairs.select(*slide, F.inline(F.array(seen_from("a", "b"), seen_from("b", "a")))).union(alone)
    around = cut_lineage(around.groupBy(*slide, "point", "n", "near").agg(F.sum("d").alias("d")))
    contacts = (
        around.select(*slide, *_pair_types(F.col("point.cell_type"), F.col("near")), (F.col("n") * F.col("d")).alias("twice"))
        .groupBy(*slide, "type_a", "type_b").agg((F.sum("twice") / 2).cast("long").alias("n_contacts"))
    )
    degree = around.groupBy(*slide, "point", "n").agg(F.sum("d").alias("d"))
    # n cells at a point have the same degree; long arithmetic would overflow on the products, so doubles
    d = F.col("d").cast("double")
    sums = degree.groupBy(*slide).agg(
        (F.sum(F.col("n") * d) / 2).alias("_m"), F.sum(F.col("n") * d * (d - 1)).alias("_s"), F.sum("n").cast("double").alias("_cells")
    )
    full = grid.join(contacts, [*slide, "type_a", "type_b"], "left").join(sums, slide)
    full = full.withColumn("observed", F.coalesce("n_contacts", F.lit(0)).cast("double"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    m, s, n = F.col("_m"), F.col("_s"), F.col("_cells")

    def falling(x: Column, k: int) -> Column:
        out = x
        for i in range(1, k):
            out = out * (x - i)
        return out

    same = F.col("type_a") == F.col("type_b")
    one = F.when(same, falling(a, 2)).otherwise(2 * a * b)
    shared = F.when(same, falling(a, 3)).otherwise(a * b * (a + b - 2))
    disjoint = F.when(same, falling(a, 4)).otherwise(4 * falling(a, 2) * falling(b, 2))
    mean = m * F.try_divide(one, falling(n, 2))
    second = (
        mean
        + s * F.coalesce(F.try_divide(shared, falling(n, 3)), F.lit(0.0))
        + (m * (m - 1) - s) * F.coalesce(F.try_divide(disjoint, falling(n, 4)), F.lit(0.0))
    )
    out = full.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))))
    return out.select(
        *by, "type_a", "type_b", "observed", "mean", "sd", F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")).alias("z")
    )


def co_occurrence(cells: DataFrame, radii: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """P(type_a near type_b within d) / P(type_a) for each distance d; both orders of each pair, on each slide.

    The chance is over the neighbours of cells of type_b, and the base rate is type_a's share of all cells.
    """
    radii = sorted(float(r) for r in radii)
    cells, slide = _slides(cells, by)
    binned = binned_pairs(cells, radii, slide)

    def direction(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("type_a"), F.col(y).alias("type_b"), F.col("step"), F.col("n"))

    # a pair within one type counts once for each of its two cells
    both = binned.select(*slide, F.inline(F.array(direction("type_a", "type_b"), direction("type_b", "type_a"))))
    both = both.groupBy(*slide, "type_a", "type_b", "step").agg(F.sum("n").alias("n"))
    reached = both.select(*slide, "type_a", "type_b", "n", F.explode(F.sequence("step", F.lit(len(radii)))).alias("step"))
    within = reached.groupBy(*slide, "type_a", "type_b", "step").agg(F.sum("n").alias("n"))  # slides x types x types x radii
    around = within.groupBy(*slide, "type_b", "step").agg(F.sum("n").alias("all"))
    counts = type_counts(cells.dropna(subset=["x", "y"]), slide)
    sizes = counts.groupBy(*slide).agg(F.sum("n").alias("_cells"))
    share = counts.join(sizes, slide).select(*slide, F.col("cell_type").alias("type_a"), (F.col("n") / F.col("_cells")).alias("share"))
    radius = F.element_at(F.array(*[F.lit(r) for r in radii]), F.col("step"))
    return within.join(around, [*slide, "type_b", "step"]).join(share, [*slide, "type_a"]).select(
        *by, "type_a", "type_b", radius.alias("radius"), F.try_divide(F.col("n") / F.col("all"), "share").alias("score")
    )


def niche_features(cells: DataFrame, radius: float, types: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of each type among a cell's typed neighbours on its slide; cells without neighbours have zeros."""
    typed = cells.dropna(subset=["cell_type", "x", "y", *by])
    graph = neighbour_graph(typed.select(*by, "cell_id", "x", "y", "cell_type"), radius, ["cell_type"], by)
    sums = [F.count_if(F.col("neighbour_cell_type") == t).alias(f"_{i}") for i, t in enumerate(types)]
    counts = graph.groupBy(*by, "cell_id").agg(F.count(F.lit(1)).alias("n_neighbours"), *sums)
    vector = F.array(*[F.coalesce(F.col(f"_{i}") / F.col("n_neighbours"), F.lit(0.0)) for i in range(len(types))])
    return typed.select(*by, "cell_id").join(counts, [*by, "cell_id"], "left").select(
        *by, "cell_id", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), vector.alias("features")
    )


# --- communication edges ---------------------------------------------------------------------------------------------


def pair_frequency(edges: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """The most frequent ligand-receptor pairs, ties by name."""
    counts = edges.filter(F.col("lr_pair").isNotNull()).groupBy("lr_pair").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "lr_pair").limit(top)


def type_flow(typed_edges: DataFrame) -> DataFrame:
    """Summed attention from type to type, with the square root used for drawing."""
    sums = typed_edges.dropna(subset=["from_type", "to_type"]).groupBy("from_type", "to_type").agg(
        F.sum("attention_score").alias("weight")
    )
    return sums.withColumn("drawn", F.sqrt("weight"))


def cell_degree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Interactions per participating cell, and whether any of them is with itself."""
    ends = F.array(
        F.struct(F.col("from_cell").alias("cell_id"), F.lit(1).alias("d"), (F.col("from_cell") == F.col("to_cell")).alias("own")),
        F.struct(F.col("to_cell").alias("cell_id"), F.lit(1).alias("d"), F.lit(False).alias("own")),
    )
    return edges.select(*by, F.inline(ends)).groupBy(*by, "cell_id").agg(
        F.sum("d").alias("degree"), F.coalesce(F.max("own"), F.lit(False)).alias("autocrine")
    )


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest-scoring edges of each pair; ties by the cells' ids."""
    order = W.Window.partitionBy("lr_pair").orderBy(F.col("attention_score").desc(), "from_cell", "to_cell")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def with_edge_width(edges: DataFrame) -> DataFrame:
    """Line width from the attention score over the range present."""
    low, high = edges.agg(F.min("attention_score")).scalar(), edges.agg(F.max("attention_score")).scalar()
    return edges.withColumn("width", edge_width("attention_score", low, high))


# --- signalling ------------------------------------------------------------------------------------------------------


def reachable(ppi: DataFrame, start: str, hops: int = HOPS) -> DataFrame:
    """Proteins within ``hops`` steps downstream of ``start``, with the smallest number of steps."""
    spark = ppi.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        step = (
            ppi.join(frontier.select(F.col("node").alias("source")), "source")
            .select(F.col("target").alias("node")).distinct()
            .join(seen.select("node"), "node", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        seen, frontier = seen.union(step), step
    return seen


def downstream_factors(ppi: DataFrame, tf_target: DataFrame, panel: DataFrame, receptor: str, hops: int = HOPS) -> DataFrame:
    """Transcription factors downstream of a receptor that are in the panel or have targets there."""
    factors = tf_target.select(F.col("tf").alias("node")).distinct()
    near = reachable(ppi, receptor, hops).join(factors, "node", "left_semi")
    own = panel.select(F.col("gene").alias("node"), F.lit(True).alias("in_panel")).distinct()
    targets = (
        tf_target.distinct().join(panel.select(F.col("gene").alias("target")).distinct(), "target", "left_semi")
        .groupBy(F.col("tf").alias("node")).agg(F.count(F.lit(1)).alias("n_panel_targets"))
    )
    out = near.join(own, "node", "left").join(targets, "node", "left").select(
        F.col("node").alias("tf"), "hop", F.coalesce("in_panel", F.lit(False)).alias("in_panel"),
        F.coalesce("n_panel_targets", F.lit(0)).alias("n_panel_targets"),
    )
    return out.filter(F.col("in_panel") | (F.col("n_panel_targets") > 0))


def factor_expression(cells: DataFrame, expression: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Value of each chosen factor in every cell, zero where absent."""
    wide = expression.filter(F.col("gene").isin(list(factors))).groupBy("cell_id").pivot("gene", list(factors)).agg(F.sum("value"))
    joined = cells.select("cell_id").join(wide, "cell_id", "left").fillna(0.0, subset=list(factors))
    return joined.select("cell_id", F.inline(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").alias("value")) for g in factors])))
