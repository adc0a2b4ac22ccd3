"""Polygons, neighbours, niches and signalling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomosaic.functions import geometry as GEO
from cytomosaic.functions import scalar as C
from cytomosaic.operators import genes as G
from cytomosaic.operators import metrics as M
from cytomosaic.operators import neighbourhood as N
from cytomosaic.operators import spatial as X
from cytomosaic.session import cut_lineage
from registry.base import Tables, query, rounded

RADIUS = 20.0

# fixed test regions; y points up
ROIS = [
    ("tissue", "A", [(100.0, -100.0), (600.0, -100.0), (600.0, -400.0), (350.0, -250.0), (100.0, -400.0)]),
    ("tissue", "B", [(700.0, -50.0), (1200.0, -50.0), (950.0, -700.0)]),
    ("tissue", "B", [(1100.0, -800.0), (1300.0, -800.0), (1300.0, -900.0), (1100.0, -900.0)]),
]


def rois(t: Tables):
    return t.spark.createDataFrame(ROIS, "cls string, name string, ring array<struct<x: double, y: double>>")


def roi_sql() -> str:
    edges = []
    for i, (cls, name, ring) in enumerate(ROIS):
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            edges.append(f"({i}, '{cls}', '{name}', {x0}, {y0}, {x1}, {y1})")
    return f"""--more
e(roi, cls, name, x0, y0, x1, y1) AS (VALUES {', '.join(edges)}),
p AS (SELECT cell_id, x, -y AS y FROM cells),
s AS (SELECT cell_id, roi, cls, name, (x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0) AS turn, p.x AS px, p.y AS py, x0, y0, x1, y1
      FROM p CROSS JOIN e),
r AS (SELECT cell_id, roi, cls, name, count(*) FILTER (WHERE (y0 <= py) <> (y1 <= py) AND (turn > 0) = (y1 > y0)) % 2 = 1
      AND NOT bool_or(turn = 0 AND px BETWEEN least(x0, x1) AND greatest(x0, x1) AND py BETWEEN least(y0, y1) AND greatest(y0, y1)) AS inside
      FROM s GROUP BY cell_id, roi, cls, name)
SELECT DISTINCT cell_id, cls, name FROM r WHERE inside"""


@query(roi_sql, ("cells",))
def roi_cells(t: Tables):
    return X.cells_in_rois(t.cells, rois(t))


@query("""--more
turned AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn
           FROM boundaries WINDOW w AS (PARTITION BY kind, cell_id ORDER BY vertex_ord))
SELECT kind, cell_id, round(abs(sum(x * yn - xn * y)) / 2, 6) AS area FROM turned GROUP BY kind, cell_id""", ("boundaries",))
def polygon_areas(t: Tables):
    ring = X.rings(t.boundaries, ["kind", "cell_id"])
    return rounded(ring.select("kind", "cell_id", GEO.polygon_area("ring").alias("area")), "area")


@query("""SELECT kind, cell_id, vertex_ord, x + 250 AS x, y - 40 AS y FROM boundaries""", ("boundaries",))
def translated_outlines(t: Tables):
    ring = X.rings(t.boundaries, ["kind", "cell_id"]).withColumn("ring", GEO.translate("ring", F.lit(250.0), F.lit(-40.0)))
    return X.vertices(ring, ["kind", "cell_id"])


# The overlap of every candidate pair by clipping edge against edge, on the rows of an edge-pair join.
OVERLAP = """--more
ring AS (SELECT kind, cell_id, vertex_ord, x AS xa, y AS ya,
                first_value(x) OVER w AS xf, first_value(y) OVER w AS yf, lead(x) OVER w AS xn, lead(y) OVER w AS yn
         FROM boundaries WINDOW w AS (PARTITION BY kind, cell_id ORDER BY vertex_ord)),
edge AS (SELECT kind, cell_id, xa, ya, coalesce(xn, xf) AS xb, coalesce(yn, yf) AS yb FROM ring),
seg AS (SELECT kind, cell_id, least(xa, xb) AS x0, greatest(xa, xb) AS x1, CASE WHEN xa < xb THEN ya ELSE yb END AS y0,
               CASE WHEN xa < xb THEN yb ELSE ya END AS y1, CASE WHEN xa < xb THEN 1.0 ELSE -1.0 END AS s FROM edge WHERE xa <> xb),
box AS (SELECT kind, cell_id, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM boundaries GROUP BY kind, cell_id),
tiles AS (SELECT *, unnest(range(CAST(floor(bx0 / 24) AS BIGINT), CAST(floor(bx1 / 24) AS BIGINT) + 1)) AS tx FROM box),
tiled AS (SELECT *, unnest(range(CAST(floor(by0 / 24) AS BIGINT), CAST(floor(by1 / 24) AS BIGINT) + 1)) AS ty FROM tiles),
cand AS (SELECT DISTINCT q.cell_id AS query_id, r.cell_id AS ref_id, least(q.by0, r.by0) AS base
         FROM tiled q JOIN tiled r ON q.kind = 'query' AND r.kind = 'ref' AND q.tx = r.tx AND q.ty = r.ty
         AND q.bx0 <= r.bx1 AND r.bx0 <= q.bx1 AND q.by0 <= r.by1 AND r.by0 <= q.by1),
part AS (SELECT query_id, ref_id, base, e.s * f.s AS s, greatest(e.x0, f.x0) AS l, least(e.x1, f.x1) AS r,
                e.y0 + (e.y1 - e.y0) / (e.x1 - e.x0) * (greatest(e.x0, f.x0) - e.x0) AS e0,
                e.y0 + (e.y1 - e.y0) / (e.x1 - e.x0) * (least(e.x1, f.x1) - e.x0) AS e1,
                f.y0 + (f.y1 - f.y0) / (f.x1 - f.x0) * (greatest(e.x0, f.x0) - f.x0) AS f0,
                f.y0 + (f.y1 - f.y0) / (f.x1 - f.x0) * (least(e.x1, f.x1) - f.x0) AS f1
         FROM cand JOIN seg e ON e.kind = 'query' AND e.cell_id = query_id JOIN seg f ON f.kind = 'ref' AND f.cell_id = ref_id
         WHERE greatest(e.x0, f.x0) < least(e.x1, f.x1)),
under AS (SELECT *, CASE WHEN (e0 - f0) * (e1 - f1) < 0 THEN (e0 - f0) / ((e0 - f0) - (e1 - f1)) END AS t FROM part),
areas AS (SELECT query_id, ref_id, abs(sum(s * (r - l) * (CASE WHEN t IS NULL THEN (least(e0, f0) + least(e1, f1)) / 2
                 ELSE t * (least(e0, f0) + e0 + t * (e1 - e0)) / 2 + (1 - t) * (e0 + t * (e1 - e0) + least(e1, f1)) / 2 END - base))) AS area
          FROM under GROUP BY query_id, ref_id),
pairs AS (SELECT * FROM areas WHERE area > 1e-9)"""


def outline(t: Tables, kind: str):
    return X.rings(t.boundaries.filter(F.col("kind") == kind))


@query(OVERLAP + " SELECT query_id, ref_id, round(area, 6) AS area FROM pairs", ("boundaries",))
def overlap_areas(t: Tables):
    return rounded(X.overlap_pairs(outline(t, "query"), outline(t, "ref"), 24.0), "area")


TRANSFER = """ SELECT q.cell_id AS query_cell_id, coalesce(c.cell_type, 'Unassigned') AS transferred_identity
       FROM (SELECT DISTINCT cell_id FROM boundaries) q
       LEFT JOIN (SELECT query_id, arg_min(ref_id, (-round(area, 9), ref_id)) AS ref_id FROM pairs GROUP BY query_id) b ON b.query_id = q.cell_id
       LEFT JOIN (SELECT cell_id, cell_type FROM cells) c ON c.cell_id = b.ref_id"""


def overlap_of_loops(shapes: str) -> str:
    """``OVERLAP`` for outlines of several loops that do not cover one another: ``shapes`` defines a table of that name."""
    text = OVERLAP.replace("FROM boundaries", "FROM shapes").replace("kind, cell_id", "kind, cell_id, loop")
    text = text.replace("r.cell_id AS ref_id,", "r.cell_id AS ref_id, q.loop AS ql, r.loop AS rl,").replace("query_id, ref_id, base,", "query_id, ref_id, ql, rl, base,")
    text = text.replace("e.cell_id = query_id", "e.cell_id = query_id AND e.loop = ql").replace("f.cell_id = ref_id", "f.cell_id = ref_id AND f.loop = rl")
    text = text.replace("FROM under GROUP BY query_id, ref_id", "FROM under GROUP BY query_id, ref_id, ql, rl")
    text = text.replace("SELECT * FROM areas WHERE area > 1e-9", "SELECT query_id, ref_id, sum(area) AS area FROM areas GROUP BY ALL HAVING sum(area) > 1e-9")
    return text.replace("--more", f"--more\n{shapes},", 1)


@query(OVERLAP + TRANSFER, ("boundaries", "cells"))
def transfer_idents(t: Tables):
    labels = t.cells.select("cell_id", F.col("cell_type").alias("label"))
    return X.transfer_labels(outline(t, "query"), outline(t, "ref"), labels)


@query(OVERLAP + """ SELECT q.cell_id AS query_cell_id, coalesce(least(c.cell_type, 'a' || c.cell_type), 'Unassigned') AS transferred_identity
       FROM (SELECT DISTINCT cell_id FROM boundaries) q
       LEFT JOIN (SELECT query_id, arg_min(ref_id, (-round(area, 9), ref_id)) AS ref_id FROM pairs GROUP BY query_id) b ON b.query_id = q.cell_id
       LEFT JOIN (SELECT cell_id, cell_type FROM cells) c ON c.cell_id = b.ref_id""", ("boundaries", "cells"))
def transfer_duplicate_labels(t: Tables):
    """Every reference cell is listed with two labels: one row for each query cell, and the first label in text order."""
    labels = t.cells.select("cell_id", F.explode(F.array("cell_type", F.concat(F.lit("a"), "cell_type"))).alias("label"))
    return X.transfer_labels(outline(t, "query"), outline(t, "ref"), labels)


# --- neighbours ------------------------------------------------------------------------------------------------------

NEAR = """--more
tile AS (SELECT *, CAST(floor(x / 20) AS BIGINT) AS tx, CAST(floor(y / 20) AS BIGINT) AS ty FROM cells),
spread AS (SELECT t.*, t.tx + dx AS ux, t.ty + dy AS uy FROM tile t, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
near AS (SELECT a.cell_id AS cell_id, b.cell_id AS neighbour_id, a.cell_type AS type_1, b.cell_type AS type_2,
                sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
         FROM tile a JOIN spread b ON a.tx = b.ux AND a.ty = b.uy AND a.cell_id <> b.cell_id
         AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400)"""
CONTACTS = NEAR + """,
contacts AS (SELECT type_1 AS type_a, type_2 AS type_b, CAST(CASE WHEN type_1 = type_2 THEN count(*) / 2 ELSE count(*) END AS BIGINT) AS n_contacts
             FROM near WHERE type_1 <= type_2 GROUP BY type_1, type_2),
sizes AS (SELECT cell_type, count(*) AS n FROM cells WHERE cell_type IS NOT NULL GROUP BY cell_type)"""


@query(NEAR + " SELECT cell_id, neighbour_id, round(distance, 6) AS distance FROM near", ("cells",))
def neighbour_graph(t: Tables):
    return rounded(X.neighbour_graph(t.cells, RADIUS), "distance")


@query(CONTACTS + " SELECT * FROM contacts", ("cells",))
def contacts(t: Tables):
    return N.contact_counts(t.cells, RADIUS)


# the same on each sample's own slide
SLIDES = NEAR.replace("a.cell_id <> b.cell_id", "a.cell_id <> b.cell_id AND a.sample = b.sample").replace("a.cell_id AS cell_id,", "a.sample AS sample, a.cell_id AS cell_id,")
SLIDE_CONTACTS = SLIDES + """,
contacts AS (SELECT sample, type_1 AS type_a, type_2 AS type_b, CAST(CASE WHEN type_1 = type_2 THEN count(*) / 2 ELSE count(*) END AS BIGINT) AS n_contacts
             FROM near WHERE type_1 <= type_2 GROUP BY sample, type_1, type_2),
sizes AS (SELECT sample, cell_type, count(*) AS n FROM cells WHERE cell_type IS NOT NULL GROUP BY sample, cell_type),
alls AS (SELECT sample, sum(n) AS cells FROM sizes GROUP BY sample)"""
BY = ["sample"]


@query(SLIDE_CONTACTS + " SELECT * FROM contacts", ("cells",))
def contacts_by_sample(t: Tables):
    return N.contact_counts(t.cells, RADIUS, BY)


@query(SLIDE_CONTACTS + """ SELECT sample, type_a, type_b, n_contacts, round(n_contacts / ((a.n / s.cells) * (b.n / s.cells)
       * sum(n_contacts) OVER (PARTITION BY sample)), 6) AS oe FROM contacts JOIN alls s USING (sample)
       JOIN (SELECT sample, cell_type AS type_a, n FROM sizes) a USING (sample, type_a) JOIN (SELECT sample, cell_type AS type_b, n FROM sizes) b USING (sample, type_b)""",
       ("cells",))
def contacts_oe_by_sample(t: Tables):
    return rounded(N.normalised_contacts(N.contact_counts(t.cells, RADIUS, BY), t.cells, BY), "oe")


@query(SLIDE_CONTACTS + """,
deg AS (SELECT sample, cell_id, count(*) AS d FROM near WHERE type_1 IS NOT NULL AND type_2 IS NOT NULL GROUP BY sample, cell_id),
g AS (SELECT s.sample, CAST(coalesce(sum(d), 0) / 2 AS DOUBLE) AS m, CAST(coalesce(sum(d * (d - 1)), 0) AS DOUBLE) AS s, CAST(any_value(cells) AS DOUBLE) AS n
      FROM alls s LEFT JOIN deg ON deg.sample = s.sample GROUP BY s.sample),
grid AS (SELECT a.sample, a.cell_type AS type_a, b.cell_type AS type_b, CAST(a.n AS DOUBLE) AS na, CAST(b.n AS DOUBLE) AS nb, m, s, g.n,
                coalesce(c.n_contacts, 0) AS observed
         FROM sizes a JOIN sizes b ON a.sample = b.sample AND a.cell_type <= b.cell_type JOIN g ON g.sample = a.sample
         LEFT JOIN contacts c ON c.sample = a.sample AND c.type_a = a.cell_type AND c.type_b = b.cell_type),
chance AS (SELECT *, CASE WHEN type_a = type_b THEN na * (na - 1) ELSE 2 * na * nb END / (n * (n - 1)) AS p1,
                CASE WHEN type_a = type_b THEN na * (na - 1) * (na - 2) ELSE na * nb * (na + nb - 2) END / (n * (n - 1) * (n - 2)) AS p2,
                CASE WHEN type_a = type_b THEN na * (na - 1) * (na - 2) * (na - 3) ELSE 4 * na * (na - 1) * nb * (nb - 1) END
                  / (n * (n - 1) * (n - 2) * (n - 3)) AS p3 FROM grid),
moments AS (SELECT sample, type_a, type_b, observed, m * p1 AS mean, sqrt(greatest(m * p1 + s * p2 + (m * (m - 1) - s) * p3 - m * p1 * m * p1, 0)) AS sd FROM chance)
SELECT sample, type_a, type_b, CAST(observed AS DOUBLE) AS observed, round(mean, 6) AS mean, round(sd, 4) AS sd,
       round((observed - mean) / nullif(sd, 0), 4) AS z FROM moments""", ("cells",))
def neighbourhood_enrichment_by_sample(t: Tables):
    return rounded(rounded(N.neighbourhood_enrichment(t.cells, RADIUS, BY), "mean"), "sd", "z", digits=4)


@query(SLIDE_CONTACTS + """,
typed AS (SELECT * FROM near WHERE type_1 IS NOT NULL AND type_2 IS NOT NULL),
within AS (SELECT sample, type_1 AS type_a, type_2 AS type_b, r AS radius, count(*) AS n FROM typed
           JOIN (VALUES (8.0), (14.0), (20.0)) v(r) ON distance <= r GROUP BY sample, type_1, type_2, r)
SELECT w.sample, type_a, type_b, CAST(radius AS DOUBLE) AS radius,
       round(w.n / sum(w.n) OVER (PARTITION BY w.sample, type_b, radius) / (s.n / a.cells), 6) AS score
FROM within w JOIN sizes s ON s.sample = w.sample AND s.cell_type = type_a JOIN alls a ON a.sample = w.sample""", ("cells",))
def co_occurrence_by_sample(t: Tables):
    return rounded(N.co_occurrence(t.cells, [8.0, 14.0, 20.0], BY), "score")


@query(lambda: niche_sql(SLIDES, "c.sample, "), ("cells",))
def niche_features_by_sample(t: Tables):
    out = N.niche_features(t.cells, RADIUS, TYPES, BY)
    return out.select("sample", "cell_id", "n_neighbours", *[F.col("features")[i].alias(f"share_{i}") for i in range(len(TYPES))])


@query(CONTACTS + """ SELECT type_a, type_b, n_contacts, round(n_contacts / ((a.n / (SELECT sum(n) FROM sizes)) * (b.n / (SELECT sum(n) FROM sizes))
       * (SELECT sum(n_contacts) FROM contacts)), 6) AS oe FROM contacts JOIN sizes a ON a.cell_type = type_a JOIN sizes b ON b.cell_type = type_b""",
       ("cells",))
def contacts_oe(t: Tables):
    return rounded(N.normalised_contacts(N.contact_counts(t.cells, RADIUS), t.cells), "oe")


@query(CONTACTS + """,
deg AS (SELECT cell_id, count(*) AS d FROM near WHERE type_1 IS NOT NULL AND type_2 IS NOT NULL GROUP BY cell_id),
g AS (SELECT CAST(sum(d) / 2 AS DOUBLE) AS m, CAST(sum(d * (d - 1)) AS DOUBLE) AS s, CAST((SELECT sum(n) FROM sizes) AS DOUBLE) AS n FROM deg),
grid AS (SELECT a.cell_type AS type_a, b.cell_type AS type_b, CAST(a.n AS DOUBLE) AS na, CAST(b.n AS DOUBLE) AS nb, m, s, g.n,
                coalesce(c.n_contacts, 0) AS observed
         FROM sizes a JOIN sizes b ON a.cell_type <= b.cell_type CROSS JOIN g
         LEFT JOIN contacts c ON c.type_a = a.cell_type AND c.type_b = b.cell_type),
chance AS (SELECT *, CASE WHEN type_a = type_b THEN na * (na - 1) ELSE 2 * na * nb END / (n * (n - 1)) AS p1,
                CASE WHEN type_a = type_b THEN na * (na - 1) * (na - 2) ELSE na * nb * (na + nb - 2) END / (n * (n - 1) * (n - 2)) AS p2,
                CASE WHEN type_a = type_b THEN na * (na - 1) * (na - 2) * (na - 3) ELSE 4 * na * (na - 1) * nb * (nb - 1) END
                  / (n * (n - 1) * (n - 2) * (n - 3)) AS p3 FROM grid),
moments AS (SELECT type_a, type_b, observed, m * p1 AS mean, sqrt(m * p1 + s * p2 + (m * (m - 1) - s) * p3 - m * p1 * m * p1) AS sd FROM chance)
SELECT type_a, type_b, CAST(observed AS DOUBLE) AS observed, round(mean, 6) AS mean, round(sd, 4) AS sd, round((observed - mean) / sd, 4) AS z FROM moments""",
       ("cells",))
def neighbourhood_enrichment(t: Tables):
    return rounded(rounded(N.neighbourhood_enrichment(t.cells, RADIUS), "mean"), "sd", "z", digits=4)


@query(CONTACTS + """,
typed AS (SELECT * FROM near WHERE type_1 IS NOT NULL AND type_2 IS NOT NULL),
within AS (SELECT type_1 AS type_a, type_2 AS type_b, r AS radius, count(*) AS n FROM typed JOIN (VALUES (8.0), (14.0), (20.0)) v(r) ON distance <= r
           GROUP BY type_1, type_2, r)
SELECT type_a, type_b, CAST(radius AS DOUBLE) AS radius, round(w.n / sum(w.n) OVER (PARTITION BY type_b, radius) / (s.n / (SELECT sum(n) FROM sizes)), 6) AS score
FROM within w JOIN sizes s ON s.cell_type = type_a""", ("cells",))
def co_occurrence(t: Tables):
    return rounded(N.co_occurrence(t.cells, [8.0, 14.0, 20.0]), "score")


# radii that hold hundreds of cells: pairs of tiles are counted at once
WIDE = CONTACTS.replace("/ 20)", "/ 256)").replace("<= 400", "<= 65536")


@query(WIDE + " SELECT * FROM contacts", ("cells",))
def contacts_wide(t: Tables):
    return N.contact_counts(t.cells, 256.0)


@query(WIDE + """,
typed AS (SELECT * FROM near WHERE type_1 IS NOT NULL AND type_2 IS NOT NULL),
within AS (SELECT type_1 AS type_a, type_2 AS type_b, r AS radius, count(*) AS n FROM typed JOIN (VALUES (64.0), (128.0), (256.0)) v(r) ON distance <= r
           GROUP BY type_1, type_2, r)
SELECT type_a, type_b, CAST(radius AS DOUBLE) AS radius, round(w.n / sum(w.n) OVER (PARTITION BY type_b, radius) / (s.n / (SELECT sum(n) FROM sizes)), 6) AS score
FROM within w JOIN sizes s ON s.cell_type = type_a""", ("cells",))
def co_occurrence_wide(t: Tables):
    return rounded(N.co_occurrence(t.cells, [64.0, 128.0, 256.0]), "score")


TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def niche_sql(near: str = NEAR, own: str = "") -> str:
    shares = ", ".join(f"coalesce(count(*) FILTER (WHERE type_2 = '{v}') / nullif(count(type_2), 0), 0) AS share_{i}" for i, v in enumerate(TYPES))
    return near + f""" SELECT {own}c.cell_id, count(type_2) AS n_neighbours, {shares} FROM cells c
LEFT JOIN near n ON n.cell_id = c.cell_id WHERE c.cell_type IS NOT NULL GROUP BY {own}c.cell_id"""


@query(niche_sql, ("cells",))
def niche_features(t: Tables):
    out = N.niche_features(t.cells, RADIUS, TYPES)
    return out.select("cell_id", "n_neighbours", *[F.col("features")[i].alias(f"share_{i}") for i in range(len(TYPES))])


@query("SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_misplaced, true AS few_groups FROM cells WHERE cell_type IS NOT NULL", ("cells",))
def niches(t: Tables):
    """KMeans on the neighbours' type shares: all typed cells, none of them nearer to another group's centre, and only labels that have a centre."""
    from cytomosaic.operators.matrix import fit_clusters, misplaced

    features = cut_lineage(N.niche_features(t.cells, RADIUS, TYPES))
    return misplaced(features, *fit_clusters(features, 6))


# --- communication edges ---------------------------------------------------------------------------------------------


@query("""SELECT ligand || '-' || receptor AS lr_pair, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, lr_pair LIMIT 30""", ("edges",))
def lr_frequency(t: Tables):
    return N.pair_frequency(M.with_lr_pair(t.edges))


@query("""SELECT a.cell_type AS from_type, b.cell_type AS to_type, round(sum(attention_score), 6) AS weight, round(sqrt(sum(attention_score)), 6) AS drawn
       FROM edges e JOIN cells a ON a.cell_id = from_cell JOIN cells b ON b.cell_id = to_cell
       WHERE a.cell_type IS NOT NULL AND b.cell_type IS NOT NULL GROUP BY ALL""", ("edges", "cells"))
def chord_weights(t: Tables):
    typed = M.annotate_endpoints(t.edges, t.cells.select("cell_id", "cell_type"))
    return rounded(N.type_flow(typed), "weight", "drawn")


@query("""SELECT cell_id, count(*) AS degree, bool_or(own) AS autocrine FROM (
       SELECT from_cell AS cell_id, from_cell = to_cell AS own FROM e2 UNION ALL SELECT to_cell, false FROM e2) GROUP BY cell_id"""
       .replace("e2", "(SELECT from_cell, CASE WHEN receptor = 'R1' THEN from_cell ELSE to_cell END AS to_cell FROM edges)"), ("edges",))
def degree(t: Tables):
    """Some edges are turned into self-loops first, since the table has none."""
    looped = t.edges.withColumn("to_cell", F.when(F.col("receptor") == "R1", F.col("from_cell")).otherwise(F.col("to_cell")))
    return N.cell_degree(looped)


@query("""SELECT lr_pair, from_cell, to_cell, attention_score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER
       (PARTITION BY lr_pair ORDER BY attention_score DESC, from_cell, to_cell) AS place FROM (SELECT DISTINCT ligand || '-' || receptor AS lr_pair,
       from_cell, to_cell, attention_score FROM edges)) WHERE place <= 5""", ("edges",))
def top_edges_per_pair(t: Tables):
    edges = M.with_lr_pair(t.edges).select("lr_pair", "from_cell", "to_cell", "attention_score").distinct()
    return N.top_edges(edges, 5)


@query("""SELECT from_cell, to_cell, ligand, receptor, round(0.5 + 1.5 * (attention_score - (SELECT min(attention_score) FROM edges))
       / ((SELECT max(attention_score) FROM edges) - (SELECT min(attention_score) FROM edges)), 6) AS width FROM edges""", ("edges",))
def edge_widths(t: Tables):
    return rounded(N.with_edge_width(t.edges).select("from_cell", "to_cell", "ligand", "receptor", "width"), "width")


@query("""SELECT v.vec_id, round(1 - list_cosine_similarity(v.embedding, f.embedding), 6) AS distance FROM vectors v JOIN vectors f ON f.vec_id = 0""",
       ("vectors",))
def cosine_to_first(t: Tables):
    first = t.vectors.filter("vec_id = 0").select(C.unit_vector("embedding")).scalar()
    paired = t.vectors.select("vec_id", C.unit_vector("embedding").alias("u")).withColumn("v", first)
    return rounded(paired.select("vec_id", C.cosine_distance("u", "v").alias("distance")), "distance")


# --- signalling ------------------------------------------------------------------------------------------------------

REACH = """--more
h1 AS (SELECT DISTINCT target AS node FROM ppi WHERE source = 'G3' AND target <> 'G3'),
h2 AS (SELECT DISTINCT target AS node FROM ppi JOIN h1 ON source = node WHERE target <> 'G3' AND target NOT IN (SELECT node FROM h1)),
reach AS (SELECT 'G3' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""


@query(REACH + " SELECT node, hop FROM reach", ("ppi",))
def reachable_two_hops(t: Tables):
    return N.reachable(t.ppi, "G3")


@query(REACH + """,
panel AS (SELECT gene FROM genes WHERE ord < 30)
SELECT node AS tf, hop, node IN (SELECT gene FROM panel) AS in_panel,
       (SELECT count(*) FROM tf_target WHERE tf = node AND target IN (SELECT gene FROM panel)) AS n_panel_targets
FROM reach WHERE node IN (SELECT tf FROM tf_target)
AND (node IN (SELECT gene FROM panel) OR node IN (SELECT tf FROM tf_target WHERE target IN (SELECT gene FROM panel)))""",
       ("ppi", "tf_target", "genes"))
def tf_two_hop(t: Tables):
    return N.downstream_factors(t.ppi, t.tf_target, t.genes.filter("ord < 30"), "G3")


@query("""SELECT c.cell_id, g.gene, coalesce(e.value, 0) AS value FROM cells c CROSS JOIN (VALUES ('G1'), ('G9')) g(gene)
       LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene""", ("cells", "expr"))
def tf_expression(t: Tables):
    return N.factor_expression(t.cells, t.expr, ["G1", "G9"])


@query("SELECT gene, ord FROM genes WHERE NOT is_imputed", ("genes",))
def panel_listing(t: Tables):
    return G.panel_genes(t.genes).select("gene", "ord").orderBy("ord")
