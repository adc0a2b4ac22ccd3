"""Normalisation, nearest neighbours, imputation, mixtures and clusters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cytomosaic.operators import deconvolve as D
from cytomosaic.operators import genes as G
from cytomosaic.operators import matrix as M
from cytomosaic.operators import spatial as X
from cytomosaic.operators.cells import majority_label
from cytomosaic.operators.knn import knn_join
from cytomosaic.plans import correct as correction
from cytomosaic.plans import impute as I
from cytomosaic.session import cut_lineage
from registry.base import Tables, query, rounded

# --- normalisation ---------------------------------------------------------------------------------------------------

NORMAL = """--more
shared AS (SELECT e.* FROM expr e WHERE gene IN (SELECT gene FROM genes WHERE ord >= 8 AND ord < 56)),
normal AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000) AS value FROM shared)"""


def normal(t: Tables):
    return M.log_normalise(t.expr, t.genes.filter("ord >= 8 AND ord < 56"))


@query(NORMAL + " SELECT cell_id, gene, round(value, 6) AS value FROM normal", ("expr", "genes"))
def lognorm(t: Tables):
    return rounded(normal(t), "value")


@query("""SELECT cell_id, gene, round(value / sqrt(sum(value * value) OVER (PARTITION BY cell_id)), 6) AS value
       FROM (SELECT cell_id, gene, ln(1 + value) AS value FROM expr)""", ("expr",))
def unit_rows(t: Tables):
    return rounded(M.l2_normalise(t.expr.withColumn("value", F.log1p("value"))), "value")


@query(NORMAL + """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
mom AS (SELECT gene, sum(value) / (SELECT n FROM n) AS mean, sqrt(sum(value * value) / (SELECT n FROM n)
        - (sum(value) / (SELECT n FROM n)) * (sum(value) / (SELECT n FROM n))) AS sd FROM normal GROUP BY gene)
SELECT cell_id, v.gene, round((value - mean) / sd, 6) AS value, round(-mean / sd, 6) AS zero_score FROM normal v JOIN mom m ON m.gene = v.gene""",
       ("expr", "genes", "cells"))
def zscore(t: Tables):
    return rounded(M.z_scores(normal(t), t.cells), "value", "zero_score")


@query(NORMAL + """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
odd AS (SELECT gene, avg(value) * count(*) / (SELECT n FROM n) AS mean,
               sqrt((var_pop(value) * count(*) + avg(value) * avg(value) * count(*) * ((SELECT n FROM n) - count(*)) / (SELECT n FROM n)) / (SELECT n FROM n)) AS sd
        FROM normal GROUP BY gene)
SELECT v.gene, count(*) AS n, round(sum((value - mean) / sd), 3) AS total FROM normal v JOIN odd m ON m.gene = v.gene GROUP BY v.gene""",
       ("expr", "genes", "cells"))
def zscore_constant_gene(t: Tables):
    """Two genes that every cell has at one value, 3.7 and log1p(1234.567), join the rest: they have no score and drop out."""
    level = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.lit(v).alias("value")) for g, v in (("same", 3.7), ("same2", math.log1p(1234.567)))]))
    constant = t.cells.select("cell_id", level.alias("s")).select("cell_id", "s.gene", "s.value")
    scores = M.z_scores(normal(t).union(constant), t.cells)
    return rounded(scores.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=3)


EVEN = "CAST(substr(cell_id, 2) AS BIGINT) % 2 = 0"


@query(f"""--more
ref AS (SELECT * FROM expr WHERE {EVEN}),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells WHERE {EVEN}),
pool AS (SELECT gene, ord FROM genes WHERE ord >= 20),
spread AS (SELECT p.gene, p.ord, coalesce((sum(value * value) - sum(value) * sum(value) / (SELECT n FROM n)) / ((SELECT n FROM n) - 1), 0) AS variance
           FROM pool p LEFT JOIN ref r ON r.gene = p.gene GROUP BY p.gene, p.ord)
SELECT gene, ord, round(variance, 9) AS variance FROM spread ORDER BY spread.variance DESC, ord LIMIT 10""", ("expr", "genes", "cells"))
def hvg_top(t: Tables):
    n = t.cells.filter(EVEN).agg(F.count(F.lit(1))).scalar()
    out = G.variable_genes(t.genes, t.genes.filter("ord < 20"), t.expr.filter(EVEN), n, top=10)
    return rounded(out, "variance", digits=9)


# --- nearest neighbours ----------------------------------------------------------------------------------------------

KNN = """--more
q AS (SELECT vec_id, embedding FROM vectors WHERE vec_id % 2 = 1),
r AS (SELECT vec_id, embedding, label FROM vectors WHERE vec_id % 2 = 0),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, round(1 - list_cosine_similarity(q.embedding, r.embedding), 12) AS distance FROM q, r),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS INT) AS place FROM d QUALIFY place <= 50)"""


def halves(t: Tables):
    v = t.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")
    return v.filter("id % 2 = 1"), v.filter("id % 2 = 0")


def near(t: Tables, **how):
    q, r = halves(t)
    return knn_join(q, r, 50, **how)


KNN_ROWS = KNN + " SELECT query_id, ref_id, round(distance, 6) AS distance, place FROM near"


@query(KNN_ROWS, ("vectors",))
def knn_cosine(t: Tables):
    return rounded(near(t), "distance")


@query(KNN_ROWS, ("vectors",))
def knn_cosine_blocks(t: Tables):
    """The same join on the path for reference sets too large to broadcast."""
    return rounded(near(t, broadcast_bytes=0, block_rows=64, n_pivots=12), "distance")


@query("""--more
tile AS (SELECT *, CAST(floor(x / 48) AS BIGINT) AS tx, CAST(floor(y / 48) AS BIGINT) AS ty FROM cells),
spread AS (SELECT t.*, t.tx + dx AS ux, t.ty + dy AS uy FROM tile t, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
d AS (SELECT a.cell_id AS query_id, b.cell_id AS ref_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) AS distance
      FROM tile a JOIN spread b ON a.tx = b.ux AND a.ty = b.uy AND a.cell_id <> b.cell_id)
SELECT query_id AS cell_id, ref_id AS neighbour_id, round(distance, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY d.distance, ref_id) AS INT) AS place FROM d QUALIFY place <= 4""", ("cells",))
def nearest_graph(t: Tables):
    """Four nearest cells of each cell."""
    return rounded(X.nearest_graph(t.cells, 4), "distance")


@query("""--more
tile AS (SELECT *, CAST(floor(x / 48) AS BIGINT) AS tx, CAST(floor(y / 48) AS BIGINT) AS ty FROM cells),
spread AS (SELECT t.*, t.tx + dx AS ux, t.ty + dy AS uy FROM tile t, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
d AS (SELECT a.cell_id AS query_id, b.cell_id AS ref_id, b.cluster, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) AS distance
      FROM tile a JOIN spread b ON a.tx = b.ux AND a.ty = b.uy AND a.cell_id <> b.cell_id),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.distance, ref_id) <= 4),
votes AS (SELECT query_id AS cell_id, cluster AS label, count(*) AS votes FROM near GROUP BY ALL)
SELECT cell_id, label, votes FROM votes QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY votes DESC, label) = 1""", ("cells",))
def nearest_label_vote(t: Tables):
    """The commonest cluster among the four nearest cells."""
    return X.nearest_labels(X.nearest_graph(t.cells, 4), t.cells.select("cell_id", F.col("cluster").alias("label")))


@query(KNN + """ SELECT query_id, CAST(label AS STRING) AS label, votes FROM (
       SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, CAST(label AS STRING)) AS p
       FROM near GROUP BY query_id, label) WHERE p = 1""", ("vectors",))
def knn_vote(t: Tables):
    _, r = halves(t)
    labels = r.select(F.col("id").alias("ref_id"), F.col("label").cast("string").alias("label"))
    return majority_label(near(t).join(labels, "ref_id"), "query_id")


WEIGHTS = KNN + """,
valid AS (SELECT * FROM near WHERE distance < 1),
w AS (SELECT query_id, ref_id, (1 - distance / CASE WHEN sum(distance) OVER p = 0 THEN 1 ELSE sum(distance) OVER p END) / greatest(count(*) OVER p - 1, 1)
      AS weight FROM valid WINDOW p AS (PARTITION BY query_id))"""


@query(WEIGHTS + " SELECT query_id, ref_id, round(weight, 6) AS weight FROM w", ("vectors",))
def neighbour_weights(t: Tables):
    return rounded(I.neighbour_weights(near(t)), "weight")


def targets(r):
    values = r.select(F.col("id").alias("ref_cell"), F.posexplode("features").alias("i", "value"))
    return values.filter("i >= 48").select("ref_cell", F.concat(F.lit("E"), F.col("i").cast("string")).alias("gene"), "value")


@query(WEIGHTS + """,
target AS (SELECT vec_id AS ref_id, 'E' || CAST(i - 1 AS STRING) AS gene, embedding[i] AS value
           FROM r, (SELECT unnest(range(49, 65)) AS i))
SELECT query_id AS cell_id, gene, round(sum(weight * value), 6) AS value FROM w JOIN target ON target.ref_id = w.ref_id GROUP BY query_id, gene""",
       ("vectors",))
def imputed_values(t: Tables):
    _, r = halves(t)
    return rounded(I.weighted_values(I.neighbour_weights(near(t)), targets(r)), "value")


def zscore_sql(width: int) -> str:
    """Both halves z-scored on their own over the first dimensions, then the nearest neighbours by cosine."""
    return f"""--more
long AS (SELECT vec_id, vec_id % 2 AS half, label, i, embedding[i] AS v FROM vectors, (SELECT unnest(range(1, {width} + 1)) AS i)),
mom AS (SELECT half, i, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY half, i),
z AS (SELECT vec_id, any_value(l.half) AS half, any_value(label) AS label, list((v - m) / s ORDER BY l.i) AS embedding
      FROM long l JOIN mom ON mom.half = l.half AND mom.i = l.i GROUP BY vec_id),
q AS (SELECT * FROM z WHERE half = 1),
r AS (SELECT * FROM z WHERE half = 0),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, 1 - list_cosine_similarity(q.embedding, r.embedding) AS distance FROM q, r),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), ref_id) AS INT) AS place FROM d QUALIFY place <= 50)"""


WEIGHT_STEP = WEIGHTS[len(KNN):]


@query(WEIGHTS + """,
target AS (SELECT vec_id AS ref_id, 'E' || CAST(i - 1 AS STRING) AS gene, embedding[i] AS value
           FROM r, (SELECT unnest(range(49, 65)) AS i))
SELECT query_id AS cell_id, gene, round(sum(weight * value), 6) AS value FROM w JOIN target ON target.ref_id = w.ref_id GROUP BY query_id, gene""",
       ("vectors",))
def imputed_values_long(t: Tables):
    """The same sums on the path for references too large to send."""
    _, r = halves(t)
    return rounded(I.weighted_values(I.neighbour_weights(near(t)), targets(r), broadcast_bytes=0), "value")


@query("SELECT gene, CAST(ord AS INT) AS ord, is_imputed FROM genes WHERE ord < 56 UNION ALL SELECT gene || ' [imp]', CAST(ord AS INT), true FROM genes WHERE ord >= 56",
       ("genes",))
def imputation_job_genes(t: Tables):
    """The whole imputation job: its gene list, with every reference gene outside the panel appended under its tag."""
    expr, listed = cut_lineage(t.expr), cut_lineage(t.genes)  # made once: the job reads them in every step
    panel = listed.filter("ord < 56").select("gene", "ord", F.lit(False).alias("is_imputed"))
    raw = expr.filter(f"NOT {EVEN}").withColumn("layer", F.lit(G.RAW))
    ids = t.cells.select(F.col("cell_id").alias("ref_cell")).filter(EVEN.replace("cell_id", "ref_cell"))
    reference = expr.filter(EVEN).withColumnRenamed("cell_id", "ref_cell").withColumn("value", F.log1p("value"))
    wanted = listed.filter("ord >= 56").select("gene", "ord")
    _, genes = I.impute(t.cells.filter(f"NOT {EVEN}"), raw, panel, ids, listed.select("gene", "ord"), reference, wanted)
    return genes.select("gene", F.col("ord").cast("int").alias("ord"), "is_imputed")


@query(lambda: zscore_sql(48) + WEIGHT_STEP + """,
target AS (SELECT vec_id AS ref_id, 'E' || CAST(i - 1 AS STRING) AS gene, embedding[i] AS value
           FROM vectors, (SELECT unnest(range(49, 65)) AS i) WHERE vec_id % 2 = 0)
SELECT query_id AS cell_id, gene, round(sum(weight * value), 6) AS value FROM w JOIN target ON target.ref_id = w.ref_id GROUP BY query_id, gene""",
       ("vectors",))
def impute_all_vectors(t: Tables):
    """As many principal vectors as genes: they are then a rotation, which leaves cosines of z-scores as they are."""
    q, r = halves(t)
    shared = F.slice("features", 1, 48).alias("features")
    return rounded(I.impute_vectors(q.select("id", shared), r.select("id", shared), 48, targets(r), n_vectors=48), "value")


@query(lambda: zscore_sql(64) + """
SELECT query_id AS cell_id, CAST(label AS STRING) AS label, votes FROM (
       SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, CAST(label AS STRING)) AS p
       FROM near GROUP BY query_id, label) WHERE p = 1""", ("vectors",))
def label_transfer_all_components(t: Tables):
    """All components kept, which is a rotation as well."""
    q, r = halves(t)
    labels = r.select(F.col("id").alias("ref_cell"), F.col("label").cast("string").alias("label"))
    return I.vote(q.select("id", "features"), r.select("id", "features"), labels, 64, 64)


def repeated(rows, latent: int, width: int):
    """Rows of ``width`` genes out of ``latent`` numbers, each standing several times at another scale: z-scores of a gene's
    copies are equal, so the leading components of any such set span the same space, and cosines there are those of the
    latent z-scores."""
    genes = [(F.col("features")[i % latent] * (1 + i // latent) + i % 3).alias(f"g{i}") for i in range(width)]
    return rows.select("id", F.array(*genes).alias("features"))


@query(lambda: zscore_sql(12) + WEIGHT_STEP + """,
target AS (SELECT vec_id AS ref_id, 'E' || CAST(i - 1 AS STRING) AS gene, embedding[i] AS value
           FROM vectors, (SELECT unnest(range(49, 65)) AS i) WHERE vec_id % 2 = 0)
SELECT query_id AS cell_id, gene, round(sum(weight * value), 6) AS value FROM w JOIN target ON target.ref_id = w.ref_id GROUP BY query_id, gene""",
       ("vectors",))
def impute(t: Tables):
    """Imputation in its default form, through 30 principal vectors of 48 genes, where 12 numbers make up all genes."""
    q, r = halves(t)
    return rounded(I.impute_vectors(repeated(q, 12, 48), repeated(r, 12, 48), 48, targets(r)), "value")


@query(lambda: zscore_sql(16) + """
SELECT query_id AS cell_id, CAST(label AS STRING) AS label, votes FROM (
       SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, CAST(label AS STRING)) AS p
       FROM near GROUP BY query_id, label) WHERE p = 1""", ("vectors",))
def label_transfer(t: Tables):
    """Label transfer in its default form, in 50 components of 64 genes, where 16 numbers make up all genes."""
    q, r = halves(t)
    labels = r.select(F.col("id").alias("ref_cell"), F.col("label").cast("string").alias("label"))
    return I.vote(repeated(q, 16, 64), repeated(r, 16, 64), labels, 64)


@query()
def impute_error(t: Tables):
    """Imputation through principal vectors over dimensions 0-47; error per imputed dimension."""
    q, r = halves(t)
    shared = F.slice("features", 1, 48).alias("features")
    values = I.impute_vectors(q.select("id", shared), r.select("id", shared), 48, targets(r))
    truth = targets(q).select(F.col("ref_cell").alias("cell_id"), "gene", F.col("value").alias("truth"))
    gap = F.col("value") - F.col("truth")
    return truth.join(values, ["cell_id", "gene"]).groupBy("gene").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


@query()
def label_transfer_hits(t: Tables):
    """Labels by vote in the reference's principal components, with how often they are right."""
    q, r = halves(t)
    labels = r.select(F.col("id").alias("ref_cell"), F.col("label").cast("string").alias("label"))
    voted = I.vote(q.select("id", "features"), r.select("id", "features"), labels, 64)
    truth = q.select(F.col("id").alias("cell_id"), F.col("label").cast("string").alias("truth"))
    return voted.join(truth, "cell_id").groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("n_right"))


#: Cosines between the planted directions of two sets; the last is too small to be kept.
PLANTED = (0.9, 0.6, 0.2)


@query(f"""SELECT CAST(i AS INT) AS place, CAST(CASE i WHEN 1 THEN {PLANTED[0]} ELSE {PLANTED[1]} END AS DOUBLE) AS cosine, round(var_pop(embedding[i]), 6) AS variance
       FROM vectors, (SELECT unnest([1, 2]) AS i) WHERE vec_id % 2 = 0 GROUP BY i""", ("vectors",))
def principal_vectors(t: Tables):
    """Both halves in three directions each of ten genes, at known angles: the kept vectors' cosines, and the reference's spread along them."""
    q, r = halves(t)
    side = [math.sqrt(1 - c * c) for c in PLANTED]
    apart = [F.col("features")[i] * c for i, c in enumerate(PLANTED)] + [F.col("features")[i] * s for i, s in enumerate(side)]
    zeros = [F.lit(0.0)] * 4
    query_rows = q.select("id", F.array(*apart, *zeros).alias("features"))
    rows = r.select("id", F.array(*[F.col("features")[i] for i in range(3)], *[F.lit(0.0)] * 3, *zeros).alias("features"))
    means = [M.columns(x, 10).mean for x in (query_rows, rows)]
    own, theirs = (M.leading(x, 10, 3, mean)[1] for x, mean in zip((query_rows, rows), means, strict=True))
    found = M.principal_vectors(theirs, own)
    spread = M.project(rows, found.loadings, means[1], ["id"]).select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("variance"))
    cosine = F.element_at(F.array(*[F.lit(float(c)) for c in found.cosines]), F.col("i") + 1)
    return rounded(rounded(spread.select((F.col("i") + 1).alias("place"), cosine.alias("cosine"), "variance"), "cosine", digits=9), "variance")


# --- products, components, clusters ----------------------------------------------------------------------------------


@query("""--more
long AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, embedding[i] AS v FROM vectors, (SELECT unnest(range(1, 65)) AS i)
         UNION ALL SELECT vec_id, 64, 1.0 FROM vectors)
SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM long a JOIN long b ON b.vec_id = a.vec_id GROUP BY a.i, b.i""", ("vectors",))
def gram_matrix(t: Tables):
    return rounded(M.product_table(t.vectors.select(F.col("embedding").alias("features")), 64), "v")


def scores(t: Tables):
    vectors = t.vectors.select(F.col("vec_id").cast("string").alias("cell_id"), F.col("embedding").alias("features"))
    return M.pca(vectors, 64)


@query("""--more
long AS (SELECT vec_id, i, embedding[i] AS v FROM vectors, (SELECT unnest(range(1, 65)) AS i)),
cov AS (SELECT a.i, b.i AS j, covar_pop(a.v, b.v) AS c FROM long a JOIN long b ON b.vec_id = a.vec_id GROUP BY a.i, b.i)
SELECT CAST(64 AS BIGINT) AS n_components, round(sum(c) FILTER (WHERE i = j), 6) AS total, round(sum(c * c), 6) AS total_squares, true AS falling FROM cov""",
       ("vectors",))
def principal_components(t: Tables):
    """All components: the variances of the projected rows fall, add up to the trace, and their squares to that of the square."""
    vectors = t.vectors.select(F.col("vec_id").cast("string").alias("cell_id"), F.col("embedding").alias("features"))
    mean = M.columns(vectors, 64).mean
    projected = M.project(vectors, M.leading(vectors, 64, 64, mean)[1], mean).select(F.posexplode("features").alias("component", "v"))
    spread = projected.groupBy("component").agg(F.var_pop("v").alias("variance"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("component", "variance"))), lambda s: s.variance)
    out = spread.agg(F.count(F.lit(1)).alias("n_components"), F.sum("variance").alias("total"), F.sum(F.col("variance") * F.col("variance")).alias("total_squares"), listed.alias("v"))
    falls = F.forall(F.arrays_zip(F.slice("v", 2, 63).alias("b"), F.slice("v", 1, 63).alias("a")), lambda p: p["b"] <= p["a"] * (1 + 1e-9))
    return rounded(out.withColumn("falling", falls).drop("v"), "total", "total_squares")


@query("SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_misplaced, true AS few_groups FROM vectors", ("vectors",))
def kmeans(t: Tables):
    """Every row has a group, none is nearer to another group's centre, and every label has a centre."""
    rows = cut_lineage(scores(t)[0])
    return M.misplaced(rows, *M.fit_clusters(rows))


@query("""--more
long AS (SELECT cell_id, list(gene ORDER BY gene) AS genes FROM expr WHERE gene IN ('G1', 'G2', 'G3') GROUP BY cell_id),
v AS (SELECT cell_id, gene, value FROM expr)
SELECT c.cell_id, coalesce(a.value, 0) AS g1, coalesce(b.value, 0) AS g2, coalesce(d.value, 0) AS g3 FROM cells c
LEFT JOIN v a ON a.cell_id = c.cell_id AND a.gene = 'G1' LEFT JOIN v b ON b.cell_id = c.cell_id AND b.gene = 'G2'
LEFT JOIN v d ON d.cell_id = c.cell_id AND d.gene = 'G3'""", ("expr", "cells"))
def gene_vectors(t: Tables):
    out = M.gene_vectors(t.expr, ["G1", "G2", "G3"], t.cells)
    return out.select("cell_id", *[F.col("features")[i].alias(f"g{i + 1}") for i in range(3)])


# --- mixtures --------------------------------------------------------------------------------------------------------

PROFILES = f"""--more
ref AS (SELECT e.*, c.cell_type AS label FROM expr e JOIN cells c ON c.cell_id = e.cell_id
        WHERE CAST(substr(e.cell_id, 2) AS BIGINT) % 2 = 0 AND c.cell_type IS NOT NULL),
share AS (SELECT label, gene, value / sum(value) OVER (PARTITION BY cell_id) AS v FROM ref),
size AS (SELECT cell_type AS label, count(*) AS n FROM cells WHERE {EVEN} AND cell_type IS NOT NULL GROUP BY cell_type),
profile AS (SELECT s.label, gene, sum(v) / any_value(n) AS mu FROM share s JOIN size z ON z.label = s.label GROUP BY s.label, gene)"""

FIT = PROFILES + f""",
x AS (SELECT * FROM expr WHERE NOT {EVEN}),
types AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS i FROM (SELECT DISTINCT label FROM profile)),
g AS (SELECT a.label AS la, b.label AS lb, sum(a.mu * b.mu) AS v FROM profile a JOIN profile b ON a.gene = b.gene GROUP BY a.label, b.label),
known AS (SELECT x.* FROM x WHERE gene IN (SELECT gene FROM profile)),
xx AS (SELECT cell_id, sum(value * value) AS xx FROM known GROUP BY cell_id),
d AS (SELECT xx.cell_id, xx.xx, t.label, coalesce(s.v, 0) AS v FROM xx CROSS JOIN types t
      LEFT JOIN (SELECT cell_id, label, sum(value * mu) AS v FROM known k JOIN profile p ON p.gene = k.gene GROUP BY cell_id, label) s
      ON s.cell_id = xx.cell_id AND s.label = t.label),
trial AS (SELECT a.cell_id, a.xx, a.label AS la, b.label AS lb, a.v AS da, b.v AS db, gaa.v AS gaa, gab.v AS gab, gbb.v AS gbb,
                 (a.v * gbb.v - b.v * gab.v) / (gaa.v * gbb.v - gab.v * gab.v) AS wa, (b.v * gaa.v - a.v * gab.v) / (gaa.v * gbb.v - gab.v * gab.v) AS wb
          FROM d a JOIN d b ON b.cell_id = a.cell_id AND a.label < b.label JOIN g gaa ON gaa.la = a.label AND gaa.lb = a.label
          JOIN g gab ON gab.la = a.label AND gab.lb = b.label JOIN g gbb ON gbb.la = b.label AND gbb.lb = b.label),
solved AS (SELECT cell_id, la, lb, xx, da, db, CASE WHEN wa > 0 AND wb > 0 THEN wa WHEN da * da / gaa >= db * db / gbb THEN da / gaa ELSE 0 END AS wa,
                  CASE WHEN wa > 0 AND wb > 0 THEN wb WHEN da * da / gaa >= db * db / gbb THEN 0 ELSE db / gbb END AS wb FROM trial),
best AS (SELECT *, round(xx - wa * da - wb * db, 9) AS residual FROM solved
         QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(xx - wa * da - wb * db, 9), la, lb) = 1),
fit AS (SELECT cell_id, CASE WHEN wa >= wb THEN la ELSE lb END AS first_type,
               CASE WHEN least(wa, wb) > 0 THEN CASE WHEN wa >= wb THEN lb ELSE la END END AS second_type,
               greatest(wa, wb) AS first_weight, least(wa, wb) AS second_weight, residual FROM best)"""


def reference(t: Tables, expr=None):
    labels = t.cells.filter(EVEN).filter("cell_type IS NOT NULL").select(F.col("cell_id").alias("ref_cell"), F.col("cell_type").alias("label"))
    expression = (t.expr if expr is None else expr).filter(EVEN).withColumnRenamed("cell_id", "ref_cell").join(labels.select("ref_cell"), "ref_cell", "left_semi")
    return expression, labels


def fitted(t: Tables):
    profiles = cut_lineage(D.reference_profiles(*reference(t)))
    return t.expr.filter(f"NOT {EVEN}"), profiles


@query(PROFILES + " SELECT label, gene, round(mu, 9) AS mu FROM profile", ("expr", "cells"))
def reference_profiles(t: Tables):
    return rounded(D.reference_profiles(*reference(t)), "mu", digits=9)


@query(FIT + """ SELECT cell_id, first_type, second_type, round(first_weight, 6) AS first_weight, round(second_weight, 6) AS second_weight,
       round(residual, 6) AS residual FROM fit""", ("expr", "cells"))
def doublet_fit(t: Tables):
    return rounded(D.doublet_fit(*fitted(t)), "first_weight", "second_weight", "residual")


AMBIENT = FIT + """,
cleaned AS (SELECT x.cell_id, x.gene, x.value * CASE WHEN f.second_type IS NULL OR {keep} THEN 1 ELSE coalesce(f.first_weight * coalesce(p.mu, 0)
              / nullif(f.first_weight * coalesce(p.mu, 0) + f.second_weight * coalesce(s.mu, 0), 0), 1) END AS value
            FROM x JOIN fit f ON f.cell_id = x.cell_id LEFT JOIN profile p ON p.label = f.first_type AND p.gene = x.gene
            LEFT JOIN profile s ON s.label = f.second_type AND s.gene = x.gene)
SELECT cell_id, gene, round(value, 6) AS value FROM cleaned WHERE value > 0"""


@query(AMBIENT.replace("{keep}", "false"), ("expr", "cells"))
def ambient_removed(t: Tables):
    counts, profiles = fitted(t)
    return rounded(D.remove_ambient(counts, D.doublet_fit(counts, profiles), profiles), "value")


@query(AMBIENT.replace("{keep}", "f.second_weight / (f.first_weight + f.second_weight) < 0.2"), ("expr", "cells"))
def ambient_removed_doublets(t: Tables):
    counts, profiles = fitted(t)
    return rounded(D.remove_ambient(counts, D.doublet_fit(counts, profiles), profiles, purify_singlets=False), "value")


@query(AMBIENT.replace("{keep}", "false") + " AND cell_id IN (SELECT cell_id FROM known GROUP BY cell_id HAVING sum(value) >= 2)", ("expr", "cells"))
def corrected_layer(t: Tables):
    """The corrected layer of the whole job, for cells with at least two counts."""
    return rounded(corrected(t)[0].filter(F.col("layer") == G.CORRECTED).select("cell_id", "gene", "value"), "value")


@query(AMBIENT.replace("{keep}", "false").replace("SELECT cell_id, gene, round(value, 6) AS value FROM cleaned WHERE value > 0", f""",
enough AS (SELECT cell_id FROM known GROUP BY cell_id HAVING sum(value) >= 2)
SELECT (SELECT count(*) FROM cells WHERE NOT {EVEN}) AS n_cells,
       (SELECT count(*) FROM cells WHERE NOT {EVEN} AND cell_id NOT IN (SELECT cell_id FROM cleaned WHERE value > 0 AND cell_id IN (SELECT cell_id FROM enough))) AS n_without,
       round(sum(value), 3) AS total FROM cleaned WHERE value > 0 AND cell_id IN (SELECT cell_id FROM enough)"""), ("expr", "cells"))
def correction_job(t: Tables):
    """The whole job: all cells, those that end up without a cluster, and the corrected total."""
    layers, clusters = corrected(t)
    total = layers.filter(F.col("layer") == G.CORRECTED).agg(F.sum("value")).scalar()
    out = clusters.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("cluster_split_10").isNull()).alias("n_without"))
    return rounded(out.withColumn("total", total), "total", digits=3)


def corrected(t: Tables):
    expr, genes = cut_lineage(t.expr), cut_lineage(t.genes)  # made once: the job reads them in every step
    expression = expr.filter(f"NOT {EVEN}").withColumn("layer", F.lit(G.RAW))
    return correction.correct(t.cells.filter(f"NOT {EVEN}"), expression, genes.withColumn("is_imputed", F.lit(False)), *reference(t, expr), min_umi=2)


CLASSES = {"c0": 0.1, "c1": 0.0, "c2": -0.2, "c3": 0.05}


def linear_sql() -> str:
    classes = ", ".join(f"('{c}', {v}::DOUBLE)" for c, v in CLASSES.items())
    return f"""--more
class(class, intercept) AS (VALUES {classes}),
coef AS (SELECT gene, class, ((ord * 7 + CAST(substr(class, 2) AS INT) * 13) % 11 - 5) / 10.0 AS weight FROM genes, class),
score AS (SELECT c.cell_id, k.class, k.intercept + coalesce(sum(e.value * f.weight), 0) AS score FROM cells c CROSS JOIN class k
          LEFT JOIN expr e ON e.cell_id = c.cell_id LEFT JOIN coef f ON f.gene = e.gene AND f.class = k.class GROUP BY c.cell_id, k.class, k.intercept)
SELECT cell_id, class AS label, round(score, 6) AS score FROM score QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(-score.score, 9), class) = 1"""


@query(linear_sql, ("expr", "cells", "genes"))
def linear_annotate(t: Tables):
    options = F.array(*[F.lit(c) for c in CLASSES])
    weight = ((F.col("ord") * 7 + F.substring("class", 2, 1).cast("int") * 13) % 11 - 5) / 10
    coefficients = t.genes.withColumn("class", F.explode(options)).select("gene", "class", weight.alias("weight"))
    return rounded(D.linear_annotate(t.cells, t.expr, coefficients, CLASSES), "score")


WEIGHTED = """--more
w AS (SELECT cell_id, 'T' || CAST(CAST(substr(gene, 2) AS INT) % 5 AS STRING) AS cell_type, sum(value) AS v FROM expr GROUP BY ALL),
weight AS (SELECT cell_id, cell_type, v / sum(v) OVER (PARTITION BY cell_id) AS weight FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY weight DESC, cell_type) AS p FROM weight)"""


def weights(t: Tables):
    kind = F.concat(F.lit("T"), (F.substring("gene", 2, 9).cast("int") % 5).cast("string"))
    sums = t.expr.groupBy("cell_id", kind.alias("cell_type")).agg(F.sum("value").alias("v"))
    totals = sums.groupBy("cell_id").agg(F.sum("v").alias("total"))
    return sums.join(totals, "cell_id").select("cell_id", "cell_type", (F.col("v") / F.col("total")).alias("weight"))


@query(WEIGHTED + " SELECT cell_id, cell_type AS label FROM ranked WHERE p = 1", ("expr",))
def weight_labels_full(t: Tables):
    return D.label_from_weights(weights(t), "full")


@query(WEIGHTED + """ SELECT cell_id, max(cell_type) FILTER (WHERE p = 1) AS label, max(cell_type) FILTER (WHERE p = 2) AS second_label
       FROM ranked GROUP BY cell_id""", ("expr",))
def weight_labels_doublet(t: Tables):
    return D.label_from_weights(weights(t), "doublet")


@query(WEIGHTED + " SELECT cell_id, string_agg(cell_type, ',' ORDER BY p) AS label FROM ranked WHERE weight > 0.3 GROUP BY cell_id", ("expr",))
def weight_labels_multi(t: Tables):
    return D.label_from_weights(weights(t), "multi", 0.3)
