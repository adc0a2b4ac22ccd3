"""Column layouts of the input tables, as DDL strings."""

CELLS = (
    "sample string, cell_id string, x double, y double, transcript_counts long, "
    "cell_area double, nucleus_area double"
)
BOUNDARIES = "cell_id string, kind string, vertex_ord int, x double, y double"
TRANSCRIPTS = "transcript_id string, cell_id string, gene string, x double, y double, qv double"
EXPRESSION = "cell_id string, gene string, value double"
LABELS = "cell_id string, method string, label string"
CCC_EDGES = "from_cell string, to_cell string, ligand string, receptor string, attention_score double"
BARCODES = "barcode string"
ROIS = "cls string, name string, polygon_xy array<array<double>>"
RUN_PARAMS = (
    "tool string, param_tag string, dataset_hash string, n_cells long, "
    "x_min double, x_max double, y_min double, y_max double"
)
