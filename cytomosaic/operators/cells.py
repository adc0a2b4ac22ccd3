"""Aggregation and lookup on cells, molecules and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from cytomosaic.functions.scalar import short_text

# fixed values: column names tried in this order
X_NAMES = ("x", "imagerow", "x_centroid", "centroid_x")
Y_NAMES = ("y", "imagecol", "y_centroid", "centroid_y")
META_PAIRS = (("x_centroid", "y_centroid"), ("centroid_x", "centroid_y"), ("x", "y"))
FOV_NAMES = ("fov", "FOV", "orig.ident", "sample", "dataset", "batch", "slide", "section", "replicate")
CORRECTED_UMAP = ("split_umap_1", "split_umap_2")
PLAIN_UMAP = ("umap_1", "umap_2")
MAX_FOVS = 100


def molecules_to_cells(transcripts: DataFrame) -> DataFrame:
    """Centroid and molecule count of each cell from its assigned molecules."""
    return (
        transcripts.filter(F.col("cell_id").isNotNull())
        .groupBy("cell_id")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("x").alias("transcript_counts"))
    )


def molecules_to_counts(transcripts: DataFrame, genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Counts per (cell, gene), limited to known genes and cells where given."""
    out = transcripts.filter(F.col("cell_id").isNotNull())
    if genes is not None:
        out = out.join(genes.select("gene"), "gene", "left_semi")
    if cells is not None:
        out = out.join(cells.select("cell_id"), "cell_id", "left_semi")
    return out.groupBy("cell_id", "gene").agg(F.count(F.lit(1)).cast("double").alias("value"))


def bounding_box(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extent per group; zeros where there are no coordinates."""
    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return cells.groupBy(*by).agg(
        or_zero(F.min("x")).alias("x_min"), or_zero(F.min("y")).alias("y_min"),
        or_zero(F.max("x")).alias("x_max"), or_zero(F.max("y")).alias("y_max"),
    )


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of each value."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        out, total = counts.join(totals, list(by)), F.col("_total")
    else:
        out, total = counts, counts.agg(F.sum("n")).scalar()
    return out.select(*by, column, "n", (F.lit(100.0) * F.col("n") / total).alias("percent"))


def dataset_summary(cells: DataFrame, transcripts: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: number of cells, of molecules and of panel genes."""
    n_transcripts = transcripts.agg(F.count(F.lit(1))).scalar()
    n_genes = panel.agg(F.countDistinct("gene")).scalar()
    return cells.agg(F.count(F.lit(1)).alias("n_cells")).select(
        "n_cells", n_transcripts.alias("n_transcripts"), n_genes.alias("n_panel_genes")
    )


def match_report(ids: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """How many rows of ``ids`` find their key in ``other``."""
    marked = ids.select(key).join(other.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_matched")).select(
        "n", "n_matched", F.try_divide(F.lit(100.0) * F.col("n_matched"), F.col("n")).alias("percent")
    )


def align_labels(cells: DataFrame, labels: DataFrame, out: str, fill: str | None = "Unknown") -> DataFrame:
    """Labels matched by id text, or by id number if strictly more cells match that way; the rest get ``fill``.

    Number matching applies only if every id on both sides is a whole number. Of an id listed with several labels the last
    in text order counts.
    """
    # texts such as 007 and 7 meet as numbers
    as_number = F.expr("try_cast(cell_id AS bigint)")
    by_text = labels.groupBy("cell_id").agg(F.max("label").alias("_text"))
    by_number = (
        labels.withColumn("_num", as_number).dropna(subset=["_num"]).groupBy("_num").agg(F.max("label").alias("_number"))
    )
    joined = cells.withColumn("_num", as_number).join(by_text, "cell_id", "left").join(by_number, "_num", "left")
    convertible = (
        cells.select("cell_id").union(labels.select("cell_id")).agg(F.count_if(F.expr("try_cast(cell_id AS bigint)").isNull()) == 0)
    ).scalar()
    more = joined.agg(F.count("_number") > F.count("_text")).scalar()
    chosen = F.when(convertible & more, F.col("_number")).otherwise(F.col("_text"))
    if fill is not None:
        chosen = F.coalesce(chosen, F.lit(fill))
    return joined.withColumn(out, chosen).drop("_num", "_text", "_number")


def align_column(index: DataFrame, values: DataFrame, key: str, column: str, fill: str | None = None) -> DataFrame:
    """``column`` carried onto every row of ``index``; NULL, or ``fill``, where there is no match."""
    out = index.join(values.select(key, column), key, "left")
    return out if fill is None else out.withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def pick_label_source(cells: DataFrame, sources: list[dict], labels: DataFrame,
                      dataset_hash: str | None = None, param_tag: str | None = None) -> str | None:
    """Name of the label source to use. ``sources``: dicts with ``name`` and ``mtime``; ``labels`` has a ``source`` column.

    Sources of the same dataset (name ending in its hash) come first, among those the ones of the same parameter tag.
    With the hash known the newest wins; without it, the one sharing most cell ids, the oldest on a tie.
    """
    found = sorted(sources, key=lambda s: s["mtime"])
    if dataset_hash:
        found = [s for s in found if s["name"].endswith(f"_{dataset_hash}.parquet")]
    if param_tag:
        found = [s for s in found if param_tag in s["name"]] or found
    if not found:
        return None
    if dataset_hash or len(found) == 1:
        return found[-1]["name"]
    counts = source_overlap(cells, labels.filter(F.col("source").isin([s["name"] for s in found])))
    overlap = {r.source: r.n_matched for r in counts.collect()}  # one row per listed file
    return max(found, key=lambda s: overlap.get(s["name"], 0))["name"]


def source_overlap(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of cells each label source covers."""
    ids = cells.select("cell_id")
    return labels.join(ids, "cell_id", "left_semi").groupBy("source").agg(F.countDistinct("cell_id").alias("n_matched"))


def majority_label(labelled: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Most frequent label per key, the first in name order on a tie; with the number of votes."""
    votes = labelled.groupBy(key, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), label))
    return votes.groupBy(key).agg(best.alias("_b")).select(key, f"_b.{label}", "_b.votes")


def column_profile(df: DataFrame, n_samples: int = 3) -> DataFrame:
    """Per column: type, number of non-null rows, number of distinct values and the first few values in text order."""
    names = df.columns
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])
    counts = (
        df.select(F.inline(cells))
        .filter(F.col("v").isNotNull())
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.row_number().over(W.Window.partitionBy("column").orderBy("v"))
    samples = (
        counts.withColumn("_p", place).filter(F.col("_p") <= n_samples).groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("samples"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    listed = df.sparkSession.createDataFrame([(c, types[c]) for c in names], "column string, dtype string")
    return (
        listed.join(totals, "column", "left").join(samples, "column", "left")
        .select("column", "dtype", F.coalesce("n_values", F.lit(0)).alias("n_values"),
                F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("samples", F.lit("")).alias("samples"))
    )


def detect_fov_column(meta: DataFrame) -> str | None:
    """The column that tells fields of view apart: 2 to 100 distinct values.

    A conventional name first, then the first text column, then any; names starting with ``_`` are passed over.
    """
    counts = meta.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(c) for c in meta.columns]).first().asDict()
    # the estimate only rules out what is far above the limit; the rest is counted exactly
    near = [c for c in meta.columns if counts[c] <= 2 * MAX_FOVS]
    if not near:
        return None
    exact = meta.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(c) for c in near]).first().asDict()
    fits = [c for c in near if 1 < exact[c] <= MAX_FOVS]
    types = dict(meta.dtypes)
    for name in FOV_NAMES:
        if name in fits:
            return name
    plain = [c for c in fits if not c.startswith("_")]
    return next((c for c in plain if types[c] == "string"), plain[0] if plain else None)


def fov_from_images(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """Field of view of each cell from (cell_id, image, ord); the last image listing a cell wins, cells in none drop out."""
    owner = membership.groupBy("cell_id").agg(F.max_by("image", "ord").alias("fov"))
    return cells.join(owner, "cell_id")


def resolve_coordinates(meta: DataFrame, tissue: DataFrame | None = None, embedding: DataFrame | None = None) -> DataFrame:
    """Add ``_x`` and ``_y``: from tissue coordinates if they cover all cells, else from the table's own columns, else from
    the first two columns of a spatial ``embedding`` (cell_id, then two or more numbers).

    Column names are tried in a fixed order. Cells that tissue coordinates leave out keep NULL only if there is no other
    usable pair.
    """
    from_tissue = None
    if tissue is not None:
        xs, ys = next((c for c in X_NAMES if c in tissue.columns), None), next((c for c in Y_NAMES if c in tissue.columns), None)
        if xs and ys:
            at = tissue.select("cell_id", F.col(xs).cast("double").alias("_x"), F.col(ys).cast("double").alias("_y"))
            from_tissue = meta.join(at, "cell_id", "left")
            missing, found = from_tissue.agg(F.count_if(F.col("_x").isNull()), F.count("_x")).first()
            if missing == 0:
                return from_tissue
            if found == 0:
                from_tissue = None
    for xs, ys in META_PAIRS:
        if xs in meta.columns and ys in meta.columns:
            return meta.withColumn("_x", F.col(xs).cast("double")).withColumn("_y", F.col(ys).cast("double"))
    axes = [] if embedding is None else [c for c in embedding.columns if c != "cell_id"][:2]
    if len(axes) == 2:
        at = embedding.select("cell_id", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(axes, ("_x", "_y"), strict=True)])
        return meta.join(at, "cell_id", "left")
    if from_tissue is not None:
        return from_tissue
    raise ValueError(f"no coordinate columns; tried {META_PAIRS}; available: {meta.columns}")


def resolve_cell_area(cells: DataFrame) -> DataFrame:
    """``cell_area``, taken from ``volume`` where the table has no such column."""
    if "cell_area" in cells.columns or "volume" not in cells.columns:
        return cells
    return cells.withColumn("cell_area", F.col("volume"))


def resolve_umap(cells: DataFrame, corrected: bool) -> tuple[str, str] | None:
    """The embedding columns to use: the corrected pair if wanted and present, else the plain pair, else none."""
    for pair in ([CORRECTED_UMAP] if corrected else []) + [PLAIN_UMAP]:
        if all(c in cells.columns for c in pair):
            return pair
    return None


def coerce_columns(df: DataFrame, most_of_array: int | None = None) -> DataFrame:
    """Numbers as doubles; text columns as doubles if every value parses, else as text with NULL empty.

    The text of an array is cut after ``most_of_array`` characters if given.
    """
    numeric = (T.NumericType,)
    texts = [f.name for f in df.schema.fields if not isinstance(f.dataType, numeric)]
    parses: dict[str, bool] = {}
    if texts:
        checks = [
            F.coalesce(F.count(f"`{c}`") == F.count(F.expr(f"try_cast(CAST(`{c}` AS string) AS double)")), F.lit(True)).alias(c)
            for c in texts
        ]
        parses = df.agg(*checks).first().asDict()

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name not in parses:
            return c.cast("double").alias(f.name)
        if parses[f.name]:
            return F.expr(f"try_cast(CAST(`{f.name}` AS string) AS double)").alias(f.name)
        return short_text(c, most_of_array if isinstance(f.dataType, T.ArrayType) else None).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def labels_wide(labels: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One column per clustering method."""
    return labels.groupBy("cell_id").pivot("method", list(methods)).agg(F.first("label"))
