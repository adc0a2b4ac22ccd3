"""Mixing sources to target weights that change over the course of training.

Each source has a schedule, its weight as a piecewise linear function of the training time from 0 to 1. The integral of a
schedule is the source's share of the mix; a source gives each of its documents a bounded number of times, and what it
cannot give is shared among the others. A source's documents stand in an order drawn by hash, pass after pass, as a stream
of words, and the schedule's integral up to a time says how much of the stream is used by then. Inverting it gives each
visit of a document its training position, by which the documents are sorted.

Texts are read once, for their words and hash. Running sums are taken in hash buckets within a source, and over the buckets'
totals, so no task holds a source's documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.llm.common import Workspace
from cytomosaic.operators.indexing import dense_index

# fixed values
WORD = r"[^\x20\x09-\x0D]+"
SEED = 1
#: Times that a document may be visited.
MOST_VISITS = 3
#: Weights at training times, dealt to the sources in their order; the integrals are 5, 2 and 1.
CYCLE = [
    [(0.0, 6.0), (0.5, 5.0), (1.0, 4.0)],
    [(0.0, 1.5), (0.5, 2.0), (1.0, 2.5)],
    [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
]
#: Documents that a bucket of a source's order has about, and the number of buckets in bits at most (both set memory, not results).
BUCKET_ROWS, MOST_BITS = 1_000, 16
#: Equal rows that stand as one until the end.
TOGETHER = 1_000


def order_key(source: Column) -> Column:
    """Sorts like the source's code points, null last, and is never null."""
    return F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source.cast("string")))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(schedule: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(begin, length, weight at the begin, slope, integral before) of each piece from 0 to 1, constant beyond the knots."""
    knots = sorted(schedule)
    if not knots or any(not 0 <= t <= 1 or not 0 <= w < math.inf for t, w in knots):
        raise ValueError("a schedule has weights of 0 or more at times from 0 to 1")
    knots = [(0.0, knots[0][1]), *knots, (1.0, knots[-1][1])]
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), done))
            done += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(schedule: list[tuple[float, float]]) -> float:
    begin, length, weight, slope, done = segments(schedule)[-1]
    return done + (weight + slope * length / 2) * length


def time_of(demand: Column, schedule: list[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches ``demand``: a linear weight makes it a quadratic equation."""
    out = None
    for begin, length, weight, slope, done in segments(schedule):
        rest = demand - done
        root = F.sqrt(F.greatest(weight * weight + 2.0 * slope * rest, F.lit(0.0)))
        inside = F.when(rest <= 0, 0.0).otherwise(F.least(F.coalesce(F.try_divide(2.0 * rest, weight + root), F.lit(length)), F.lit(length)))
        here = F.lit(begin) + inside
        # a piece without weight is passed over: its integral before is the next one's too
        out = here if out is None else F.when(rest >= 0, here).otherwise(out)
    return out


def dealt(sources: DataFrame, cycle: list, name: str = "_cycle") -> DataFrame:
    """Adds the place in ``cycle`` of each source, dealt in the order of the unique column ``_source``."""
    return dense_index(sources, "_source", "_rank").withColumn(name, (F.col("_rank") % len(cycle)).cast("int")).drop("_rank")


def targets(sources: DataFrame, most: int = MOST_VISITS) -> DataFrame:
    """Adds ``target`` to (weight, source_size, ...): all words shared by weight, at most ``most`` times a source's size.

    Sources above that limit stop there and the rest is shared by weight among the others, until none is above: the level
    of words for each unit of weight only rises, and each step is one aggregation of the table of sources.
    """
    size, weight, limit = F.col("source_size"), F.col("weight"), most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, stopped, words = F.lit(False), 0, float(total)
    free = sources.agg(F.sum("weight")).first()[0] or 0.0
    while True:
        share = weight * F.lit(words) / F.lit(free) if free else F.lit(0.0)
        full = full | (share > limit)
        n, held, rest = sources.agg(
            F.count_if(full), F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(weight))
        ).first()
        if not n or n == stopped:
            return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(share))
        stopped, words, free = n, float(total - held), rest


def curriculum(docs: DataFrame, cycle: list = CYCLE, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_VISITS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, visits) for every row; visits are (position, words), in their order.

    ``size`` counts words. ``cycle`` lists schedules, dealt to the sources by code point, null last. ``position`` is the
    number of words of the mix before a visit, ``words`` what the visit takes: all words of the document, except that of
    each source the one visit at which its target is reached ends there. So a source takes its target, rounded down, and
    no document more than ``most`` times its size. The order within a source is that of a hash of seed, id and text.

    Null texts and texts without a word have size 0 and no visit; null ids are ids like any other; equal rows (id, source,
    text) are documents of their own that follow each other; an empty table gives an empty one. Only the named columns are
    read, so other columns cannot clash.
    """
    ws = Workspace(docs.sparkSession, "mix")
    said = F.coalesce(F.col(text), F.lit(""))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), said).cast("binary"))
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), order_key(F.col(source)).alias("_source"), n_words(F.col(text)).alias("size"), drawn.alias("_drawn"))
    once = ws.keep(sized.groupBy("doc_id", "source", "_source", "size", "_drawn").agg(F.count(F.lit(1)).alias("_n")), "sizes")

    sums = ws.keep(once.groupBy("source", "_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("_rows")), "sources")
    weight = F.element_at(F.array(*[F.lit(integral(s)) for s in cycle]), F.col("_cycle") + 1)
    shared = ws.keep(dealt(sums, cycle).withColumn("weight", weight), "weights")
    shared = targets(shared, most).drop("source", "_rows", "weight")
    total = sums.agg(F.sum("source_size")).first()[0] or 0

    # buckets are ranges of the hash; (source, bucket) groups have BUCKET_ROWS rows or so at most, a source's buckets are few
    n_rows = sums.agg(F.sum("_rows")).first()[0] or 0
    bits = min(max(math.ceil(math.log2(n_rows / BUCKET_ROWS)), 0), MOST_BITS) if n_rows else 0
    first = F.conv(F.substring("_drawn", 1, MOST_BITS // 4), 16, 10).cast("long")
    spread = once.withColumn("_bucket", F.shiftright(first, MOST_BITS - bits).cast("int"))
    parts = spread.groupBy("_source", "_bucket").agg(F.sum(F.col("size") * F.col("_n")).alias("_words"))
    before = W.Window.partitionBy("_source").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    begins = parts.select("_source", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_begin")).join(shared, "_source")

    # equal rows move on in groups of a bounded size
    grouped = spread.withColumn("_group", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {TOGETHER}"))))
    grouped = grouped.withColumn("_n", F.least(F.lit(TOGETHER), F.col("_n") - F.col("_group") * TOGETHER))
    inside = W.Window.partitionBy("_source", "_bucket").orderBy("_drawn", "doc_id", "size", "_group").rowsBetween(W.Window.unboundedPreceding, -1)
    summed = grouped.withColumn("_before", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0)))
    rows = summed.join(begins, ["_source", "_bucket"]).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.withColumn("_at", F.col("_begin") + F.col("_before") + F.col("_i") * F.col("size"))

    at = [F.lit(k) * F.col("source_size") + F.col("_at") for k in range(most)]
    words = [F.greatest(F.least(F.floor("target").cast("long") - a, F.col("size")), F.lit(0).cast("long")) for a in at]
    rows = rows.withColumn("_words", F.array(*words)).withColumn("_demand", F.array(*[F.try_divide(weight * a.cast("double"), F.col("target")) for a in at]))

    def visit(k: int) -> Column:
        time = F.lit(None).cast("double")
        for i, schedule in enumerate(cycle):
            time = F.when(F.col("_cycle") == i, time_of(F.col("_demand")[k], schedule)).otherwise(time)
        return F.struct((time * float(total)).alias("position"), F.col("_words")[k].alias("words"))

    visits = F.filter(F.array(*[visit(k) for k in range(most)]), lambda v: v["words"] > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", visits.alias("visits"), F.col("_drawn").alias("drawn"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first visit, those without one last."""
    return mixed.orderBy(F.get("visits", F.lit(0))["position"].asc_nulls_last(), "drawn", "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, visit, doc_id, source, words), a row for each visit, visits numbered from 0, range-sorted by position."""
    each = mixed.select("doc_id", "source", "drawn", F.posexplode("visits").alias("visit", "v"))
    return each.select(F.col("v.position").alias("position"), "visit", "doc_id", "source", F.col("v.words").alias("words"), "drawn").orderBy("position", "drawn", "doc_id").drop("drawn")
