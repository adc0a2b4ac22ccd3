"""Readers. Schemas are given, not inferred, so that a read is lazy and filters and columns reach the files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic import schema as S

# fixed values: file names and name parts of the formats read here
ALL_EDGES, TOP_EDGES = "allCCC", "top20percent"
SEGMENTATION_FILE = "segmentation.csv"
POLYGON_FILES = ("segmentation_polygons_2d.json", "segmentation_polygons.json", "polygons.json", "cell_polygons.json")
RUN_FILE = "params.json"
CLUSTER_FILE = "clusters.csv"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, modification time) of everything a glob matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return [(f.getPath().toString(), f.getModificationTime()) for f in found]


def _files(spark: SparkSession, paths: Sequence[str], recursive: bool = False, name: str = "*") -> list[str]:
    """The data files that paths or globs lead to; a folder stands for its files, with ``recursive`` on all levels."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for path in paths:
        start = jvm.org.apache.hadoop.fs.Path(path)
        system = start.getFileSystem(conf)
        for top in system.globStatus(start) or []:
            if top.isFile():
                found.append(top.getPath().toString())
                continue
            listed = system.listFiles(top.getPath(), recursive)
            matching = jvm.org.apache.hadoop.fs.GlobPattern(name)
            while listed.hasNext():
                entry = listed.next().getPath()
                if not entry.getName().startswith(("_", ".")) and matching.matches(entry.getName()):
                    found.append(entry.toString())
    return sorted(found)


def _first_lines(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, str]]:
    """(first line, path) of each text file that has one, read in the executors; packed files are unpacked by their names.

    A session of its own has one file to a task, so a task's first row is the file's first line, and the rest stays unread.
    """
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, str(1 << 40))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.iloc[:1]
                return

    lines = own.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    found = lines.filter("at = 0").select("value", "path").mapInPandas(first, "value string, path string").collect()  # a row for each listed file
    return [(r["value"], unquote(r["path"])) for r in found]


def read_csv_by_name(spark: SparkSession, files: Sequence[str]) -> list[DataFrame]:
    """CSV files with header lines, one scan for each kind of header, so that columns go by name and not by place.

    The header lines are read in the executors. A scan of files with different headers would take the first one's names for all.
    """
    groups: dict[str, list[str]] = {}
    for header, path in _first_lines(spark, files) if files else ():
        groups.setdefault(header, []).append(path)
    return [spark.read.csv(sorted(paths), header=True) for _, paths in sorted(groups.items())]


def _stacked(spark: SparkSession, parts: Sequence[DataFrame], schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _no_nan(name: str) -> Column:
    return F.nanvl(F.col(name), F.lit(None).cast("double")).alias(name)


# --- tissue tables ---------------------------------------------------------------------------------------------------


def read_cells(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Cells parquet; centroid columns become ``x`` and ``y``, NaN becomes NULL, absent columns NULL."""
    df = spark.read.parquet(path)
    renames = {"x_centroid": "x", "y_centroid": "y"}
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "cell_id" not in df.columns:
        raise KeyError(f"column cell_id not found; available: {df.columns}")
    df = df.withColumn("cell_id", F.col("cell_id").cast("string"))
    for name in ("x", "y", "cell_area", "nucleus_area"):
        df = df.withColumn(name, F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if name in df.columns else F.lit(None).cast("double"))
    return df if sample is None else df.withColumn("sample", F.lit(sample))


def read_boundaries(spark: SparkSession, path: str, kind: str = "cell") -> DataFrame:
    """Vertex rows with their order: the column ``vertex_ord`` if present, else the row's place in its file."""
    df = spark.read.parquet(path)
    xs, ys = ("vertex_x", "vertex_y") if "vertex_x" in df.columns else ("x", "y")
    order = F.col("vertex_ord") if "vertex_ord" in df.columns else F.col("_metadata.row_index")
    return df.select(
        F.col("cell_id").cast("string").alias("cell_id"), F.lit(kind).alias("kind"), order.alias("vertex_ord"),
        F.col(xs).cast("double").alias("x"), F.col(ys).cast("double").alias("y"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Molecules; an empty cell id means unassigned."""
    df = spark.read.parquet(path)
    names = {"x_location": "x", "y_location": "y", "feature_name": "gene"}
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    cell = F.col("cell_id").cast("string")
    return df.withColumn("cell_id", F.when(F.trim(cell) != "", cell)).withColumn("qv", F.col("qv").cast("double"))


def read_expression(spark: SparkSession, path: str, layers: Sequence[str] | None = None) -> DataFrame:
    """Long counts partitioned by layer on disk; unwanted layers are not read."""
    df = spark.read.schema(S.EXPRESSION + ", layer string").parquet(path)
    return df if layers is None else df.filter(F.col("layer").isin(list(layers)))


def _line_place() -> Column:
    """Where a text line stands: file, split, and order inside the split. Part files are named in their order."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with zero-based line numbers of a text file or folder of part files, counted per file split and shifted."""
    lines = spark.read.text(path).select("value", _line_place().alias("_p")).select("value", "_p.file", "_p.block", "_p.at")
    inside = F.row_number().over(W.Window.partitionBy("file", "block").orderBy("at"))
    before = W.Window.orderBy("file", "block").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per file split
    return lines.withColumn("_inside", inside).join(F.broadcast(offsets), ["file", "block"]).select(
        (F.col("_offset") + F.col("_inside") - 1).alias("line"), "value"
    )


def read_matrix_market(spark: SparkSession, matrix: str | list[str], rows: str, columns: str,
                       row_name: str = "gene", column_name: str = "cell_id") -> DataFrame:
    """Coordinate text plus name lists; one-based positions become names. The matrix is rows x columns.

    The first line that is no comment states the size and is passed over. Repeated entries add up.
    """
    lines = spark.read.text(matrix).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    placed = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), _line_place().alias("_at"))
    size_line = placed.agg(F.min("_at")).scalar()
    entries = placed.filter(F.col("_at") > size_line).select(
        F.col("p")[0].cast("long").alias("_i"), F.col("p")[1].cast("long").alias("_j"),
        F.coalesce(F.try_element_at("p", F.lit(3)), F.lit("1")).cast("double").alias("value"),
    )
    named = entries.join(read_names(spark, rows, row_name, "_i"), "_i").join(read_names(spark, columns, column_name, "_j"), "_j")
    return named.groupBy(column_name, row_name).agg(F.sum("value").alias("value"))


def read_names(spark: SparkSession, path: str, name: str, position: str) -> DataFrame:
    """Names with their one-based line number; of tab-separated lines the first field."""
    return numbered_lines(spark, path).select((F.col("line") + 1).alias(position), F.split(F.trim("value"), "\t")[0].alias(name))


def read_clusters(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<method>/clusters.csv`` of all methods: (cell_id, method, label)."""
    df = spark.read.schema("cell_id string, label string").csv(f"{root.rstrip('/')}/*/{CLUSTER_FILE}", header=True, enforceSchema=True)
    method = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{CLUSTER_FILE}(/|$)", 1)
    return df.select("cell_id", F.url_decode(method).alias("method"), "label")


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional embedding: (cell_id, umap_1, umap_2)."""
    return spark.read.schema("cell_id string, umap_1 double, umap_2 double").csv(path, header=True, enforceSchema=True)


# --- communication ---------------------------------------------------------------------------------------------------


def parse_samples(specs: Sequence[str]) -> list[tuple[str, str]]:
    """``name:condition`` texts to pairs."""
    out = []
    for text in specs:
        parts = [p.strip() for p in text.split(":")]
        if len(parts) != 2:
            raise ValueError(f"sample {text!r} is not of the form name:condition")
        out.append((parts[0], parts[1]))
    return out


def read_ccc_edges(spark: SparkSession, root: str, samples: Sequence[str], use_all: bool = False) -> DataFrame:
    """``output/<sample>/*_<sample>_<kind>.csv`` of all samples with a ``sample`` column; files may order columns differently."""
    kind = ALL_EDGES if use_all else TOP_EDGES
    paths = []
    for s in samples:
        glob = f"{root.rstrip('/')}/output/{s}/*_{s}_{kind}.csv"
        if not _exists(spark, glob):
            raise FileNotFoundError(f"no edge file {glob}")
        paths.append(glob)
    sample = F.regexp_extract(F.col("_metadata.file_path"), r"/output/([^/]+)/", 1)
    columns = [
        F.url_decode(sample).alias("sample"), *[F.col(c) for c in ("from_cell", "to_cell", "ligand", "receptor")],
        F.col("attention_score").cast("double").alias("attention_score"),
    ]
    parts = [raw.select(*columns) for raw in read_csv_by_name(spark, _files(spark, paths))]
    return _stacked(spark, parts, "sample string, " + S.CCC_EDGES)


def read_barcodes(spark: SparkSession, root: str, samples: Sequence[str]) -> DataFrame:
    """``metadata/<sample>/cell_barcode_<sample>.csv`` without a header line: (sample, barcode)."""
    paths = []
    for s in samples:
        path = f"{root.rstrip('/')}/metadata/{s}/cell_barcode_{s}.csv"
        if not _exists(spark, path):
            raise FileNotFoundError(f"no barcode file {path}")
        paths.append(path)
    sample = F.regexp_extract(F.col("_metadata.file_path"), r"/metadata/([^/]+)/", 1)
    return spark.read.schema(S.BARCODES).csv(paths, header=False).select(F.url_decode(sample).alias("sample"), "barcode")


def sample_sizes(barcodes: DataFrame) -> DataFrame:
    """Rows of each list, repeated barcodes included."""
    return barcodes.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))


def sample_table(barcodes: DataFrame, samples: Sequence[tuple[str, str]]) -> DataFrame:
    """(sample, condition, n_cells)."""
    listed = barcodes.sparkSession.createDataFrame(list(samples), "sample string, condition string")
    return listed.join(sample_sizes(barcodes), "sample", "left").select("sample", "condition", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def read_annotations(spark: SparkSession, folder: str, samples: Sequence[str], column: str = "cell_type") -> DataFrame:
    """``<sample>_annotation.csv``: (sample, cell_id, cell_type), the named column or else the first.

    Samples without a file have no rows. A barcode listed twice keeps its last entry.
    """
    paths = [p for p in (f"{folder.rstrip('/')}/{s}_annotation.csv" for s in samples) if _exists(spark, p)]
    sample = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_annotation\.csv(/|$)", 1))
    parts = []
    for raw in read_csv_by_name(spark, _files(spark, paths)):
        key, *rest = raw.columns
        used = column if column in rest else rest[0]
        parts.append(raw.select(
            sample.alias("sample"), F.col(f"`{key}`").alias("cell_id"), F.col(f"`{used}`").alias("cell_type"), _line_place().alias("_at")
        ))
    rows = _stacked(spark, parts, "sample string, cell_id string, cell_type string, _at int")
    return rows.groupBy("sample", "cell_id").agg(F.max_by("cell_type", "_at").alias("cell_type"))


# --- labels, segmentation, regions -----------------------------------------------------------------------------------


def read_labels(spark: SparkSession, path: str, column: str | None = None, strict: bool = False) -> DataFrame:
    """Label table in parquet or CSV: (cell_id, label).

    The column named ``label`` is used, else ``column``, else the first one after the id; ``strict`` demands ``column``.
    """
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    ids = next((c for c in ("cell_id", "__index_level_0__", "index", "barcode", "_c0") if c in raw.columns), raw.columns[0])
    rest = [c for c in raw.columns if c != ids]
    if strict and column not in rest:
        raise KeyError(f"column {column!r} not found; available: {sorted(rest)}")
    used = column if strict else "label" if "label" in rest else column if column in rest else rest[0]
    return raw.select(F.col(f"`{ids}`").cast("string").alias("cell_id"), F.col(f"`{used}`").cast("string").alias("label"))


def read_segmentation(spark: SparkSession, root: str, name: str = SEGMENTATION_FILE) -> DataFrame:
    """All ``segmentation.csv`` files below a folder: (cell_id, gene, x, y), unassigned molecules left out.

    Files may differ in layout: coordinates are ``x``, ``y`` or ``x_location``, ``y_location``, and a gene column may lack.
    """
    parts = []
    for raw in read_csv_by_name(spark, _files(spark, [root], recursive=True, name=name)):
        if "cell" not in raw.columns:
            raise KeyError(f"column cell not found; available: {raw.columns}")
        xs, ys = ("x" if "x" in raw.columns else "x_location"), ("y" if "y" in raw.columns else "y_location")
        gene = F.col("gene") if "gene" in raw.columns else F.lit(None).cast("string")
        parts.append(raw.filter(F.col("cell").isNotNull()).select(
            F.col("cell").cast("string").alias("cell_id"), gene.alias("gene"),
            F.col(xs).cast("double").alias("x"), F.col(ys).cast("double").alias("y"),
        ))
    return _stacked(spark, parts, "cell_id string, gene string, x double, y double")


FEATURE = "id: string, properties: struct<cell: string, cell_id: string>, geometry: struct<type: string, coordinates: string>"


def _features(spark: SparkSession, path: str) -> DataFrame:
    """The features of collections of any size, one row each, read by as many tasks as the files have splits.

    The text between two ``"Feature"`` is the rest of one feature, followed by what leads to the next. Spark's text reader
    aligns its splits to such a separator like to line ends. What follows the feature's own closing brace is not looked at.
    A feature must start with its type, as tools write it; other text is an error, not a loss. A file without any type is
    one row, and read as a whole.
    """
    value, corrupt = F.col("value"), {"columnNameOfCorruptRecord": "_corrupt"}
    parts = spark.read.option("lineSep", '"Feature"').text(path)
    leads, head = value.rlike(r"\{\s*\"type\"\s*:\s*$"), value.rlike(r"^\s*\{")  # the text before a file's first feature is a head
    parsed = F.from_json(F.concat(F.lit('{"type":"Feature"'), value), f"struct<{FEATURE}, _corrupt: string>", corrupt)
    whole = F.from_json(value, f"struct<features: array<struct<{FEATURE}>>, _corrupt: string>", corrupt)
    read = parts.filter(~(head & leads)).withColumns({"_one": F.when(~head, parsed), "_all": F.when(head, whole)})
    broken = F.coalesce("_one._corrupt", "_all._corrupt").isNotNull() | ~(leads | value.rlike(r"\}\s*$"))
    refused = F.raise_error(F.lit("a feature does not start with its type, or is broken; read the file with whole=True")).cast("boolean")
    fields = [F.col(f"_one.{c}").alias(c) for c in ("id", "properties", "geometry")]
    features = F.when(F.col("_all").isNotNull(), F.col("_all.features")).otherwise(F.array(F.struct(*fields)))
    return read.filter(F.when(broken, refused).otherwise(F.lit(True))).select(F.explode(features).alias("f"))


def read_geojson_polygons(spark: SparkSession, path: str, lines: bool = False, whole: bool = False) -> DataFrame:
    """Outer rings of feature collections: (cell_id, ring). The id is ``cell``, else ``cell_id``, else the feature's own.

    A file is one collection, or with ``lines`` one collection per line. A collection's features are spread over tasks
    (see ``_features``); ``whole`` reads a file in one task, which takes any order of the features' fields.
    """
    if lines or whole:
        layout = f"features array<struct<{FEATURE}>>"
        feature = spark.read.schema(layout).json(path, multiLine=not lines).select(F.explode("features").alias("f"))
    else:
        feature = _features(spark, path)
    # a polygon nests its rings one level deep, a multi-polygon two; its first part counts
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.get(F.from_json(text, "array<array<array<double>>>"), F.lit(0))
    multi = F.get(F.get(F.from_json(text, "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0))
    points = F.when(kind == "MultiPolygon", multi).otherwise(single)
    out = feature.select(
        F.coalesce("f.properties.cell", "f.properties.cell_id", "f.id", F.lit("")).alias("cell_id"),
        F.transform(points, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"),
    )
    return out.filter(F.size("ring") >= 3)


def polygon_files(spark: SparkSession, folder: str) -> list[str]:
    """The polygon file of the folder and of each direct subfolder: the first of the known names."""
    found: dict[str, str] = {}
    for name in POLYGON_FILES:
        for pattern in (f"{folder.rstrip('/')}/{name}", f"{folder.rstrip('/')}/*/{name}"):
            for path, _ in _listing(spark, pattern):
                found.setdefault(path.rsplit("/", 1)[0], path)
    return [found[d] for d in sorted(found)]


def read_rois(spark: SparkSession, path: str, cls: str | None = None, name: str | None = None) -> DataFrame:
    """Regions as (cls, name, ring); an error listing what there is if the asked one is missing."""
    raw = spark.read.schema(S.ROIS).json(path, multiLine=True)
    rois = raw.select(
        F.col("cls").cast("string").alias("cls"), F.col("name").cast("string").alias("name"),
        F.transform("polygon_xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"),
    )
    if cls is None:
        return rois
    found = rois.filter((F.col("cls") == str(cls)) & (F.col("name") == str(name)))
    if found.isEmpty():
        listed = [(r.cls, r.name) for r in rois.select("cls", "name").limit(100).collect()]
        raise ValueError(f"no region {cls}/{name}; available: {listed}")
    return found


def read_roi_assignment(spark: SparkSession, path: str, cls: str) -> DataFrame:
    """(cell_id, roi_<cls>) from a table written earlier."""
    column = f"roi_{cls}"
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise KeyError(f"column {column} not found; available: {df.columns}")
    return df.select(F.col("cell_id").cast("string").alias("cell_id"), column)


# --- lists and parameters --------------------------------------------------------------------------------------------


def read_gene_list(spark: SparkSession, path: str, given: Sequence[str] = ()) -> DataFrame:
    """(gene, ord): the given names followed by the file's lines, trimmed, blanks dropped, first mention kept."""
    listed = spark.createDataFrame([(g, i) for i, g in enumerate(given)], "gene string, ord long")
    lines = numbered_lines(spark, path).select(F.trim("value").alias("gene"), (F.col("line") + len(given)).alias("ord"))
    return listed.union(lines.filter(F.col("gene") != "")).groupBy("gene").agg(F.min("ord").alias("ord"))


def read_links(spark: SparkSession, path: str, source: str, target: str, names: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Two named columns of a CSV as a distinct edge list."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(f"`{source}`").alias(names[0]), F.col(f"`{target}`").alias(names[1])).dropna().distinct()


def read_run_params(spark: SparkSession, root: str) -> DataFrame:
    """Parameters of every run below a folder; fields a run lacks are NULL."""
    raw = spark.read.schema(S.RUN_PARAMS).json(f"{root.rstrip('/')}/*/{RUN_FILE}", multiLine=True)
    run = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{RUN_FILE}(/|$)", 1)
    return raw.select(F.url_decode(run).alias("run"), *raw.columns)


def list_label_files(spark: SparkSession, folder: str, part: str) -> list[dict]:
    """Label files whose name contains ``part``, with their modification times, for ``pick_label_source``."""
    files = _listing(spark, f"{folder.rstrip('/')}/*.parquet")
    return [{"name": p.rsplit("/", 1)[1], "path": p, "mtime": t} for p, t in files if part in p.rsplit("/", 1)[1]]
