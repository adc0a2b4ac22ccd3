"""Scalar expressions. Each takes column names or Columns and returns a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tags that mark imputed genes, counted per cell to this total, floor for p-values
RAW_IMPUTED_TAG = " [imp]"
CORRECTED_IMPUTED_TAG = " [corr+imp]"
COUNTS_PER_CELL = 10_000.0
P_FLOOR = 1e-300


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lr_pair(ligand, receptor) -> Column:
    """``ligand-receptor``; NULL if either is."""
    return F.concat(_c(ligand), F.lit("-"), _c(receptor))


def log1p_value(value) -> Column:
    return F.log1p(_c(value))


def log1p_per_total(value, total) -> Column:
    """Library-size normalised log value; a zero total counts as one."""
    total = _c(total)
    return F.log1p(_c(value) / F.when(total == 0, 1.0).otherwise(total) * COUNTS_PER_CELL)


def log2_fold_change(mean_a, mean_b, eps) -> Column:
    return F.log2((_c(mean_b) + _c(eps)) / (_c(mean_a) + _c(eps)))


def neg_log10(p) -> Column:
    return -F.log10(F.greatest(_c(p), F.lit(P_FLOOR)))


def cosine_distance(u, v) -> Column:
    """One minus the dot product of two unit vectors held as arrays."""
    dot = F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return 1.0 - dot


def unit_vector(v) -> Column:
    """L2-normalised array; an all-zero array stays as it is."""
    v = _c(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + t * t))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda t: t / norm))


def euclidean(x0, y0, x1, y1) -> Column:
    return F.hypot(_c(x0) - _c(x1), _c(y0) - _c(y1))


def observed_over_expected(observed, freq_a, freq_b, total) -> Column:
    return F.try_divide(_c(observed).cast("double"), _c(freq_a) * _c(freq_b) * _c(total))


def edge_width(score, lowest, highest) -> Column:
    """0.5 at the lowest score to 2.0 at the highest; 0.5 if all are equal."""
    share = F.try_divide(_c(score) - _c(lowest), _c(highest) - _c(lowest))
    return F.lit(0.5) + F.lit(1.5) * F.coalesce(share, F.lit(0.0))


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(_c(value), F.lit(float(low))), F.lit(float(high)))


def clip_negative(value) -> Column:
    return F.greatest(_c(value), F.lit(0.0))


def whole_counts(value) -> Column:
    """Round half to even; anything below one becomes zero."""
    rounded = F.rint(_c(value))
    return F.when(rounded < 1, 0.0).otherwise(rounded)


def strip_suffix(value, suffix: str = "_4") -> Column:
    return F.regexp_replace(_c(value), f"{re.escape(suffix)}$", "")


def prefixed(label, value) -> Column:
    return F.concat(_c(label), F.lit("_"), _c(value).cast("string"))


def tag_gene(gene, corrected: bool) -> Column:
    return F.concat(_c(gene), F.lit(CORRECTED_IMPUTED_TAG if corrected else RAW_IMPUTED_TAG))


def clean_fov(name) -> Column:
    return F.regexp_replace(_c(name), "[/ ]", "_")


def md5_tag(text) -> Column:
    return F.substring(F.md5(_c(text)), 1, 8)


def cluster_label(index) -> Column:
    """Zero-based cluster index to a one-based text label."""
    return (_c(index).cast("int") + 1).cast("string")


def label_text(column, dtype: str) -> Column:
    """Numeric labels lose their fraction on the way to text; others are cast as they are."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return _c(column).cast("long").cast("string")
    return _c(column).cast("string")


def short_text(value, most: int | None = None) -> Column:
    """Text form of any value, cut after ``most`` characters if given; NULL becomes an empty text."""
    text = _c(value).cast("string")
    return F.coalesce(text if most is None else F.substring(text, 1, most), F.lit(""))
