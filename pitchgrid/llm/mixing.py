"""Mixing sources to target weights over a time-varying curriculum.

Each source's weight schedule is integrated over training time; the integral, scaled to the source's target, is its
cumulative demand. A copy of a document takes the demand that follows the copies before it, and inverting the
cumulative demand gives the copy its training position. Documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.llm.common import Scratch, log2_ceil

#: Knots (time from 0 to 1, weight) of a piecewise linear schedule.
Schedule = Sequence[tuple[float, float]]

CONSTANT: Schedule = ((0.0, 1.0), (1.0, 1.0))
FADING: Schedule = ((0.0, 1.5), (1.0, 0.5))
RISING: Schedule = ((0.0, 0.5), (1.0, 1.5))

#: A word, as sizes count them.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[float], weights: Sequence[float], most: float, total: float) -> np.ndarray:
    """Shares of ``total`` by weight; none above ``most`` times its size: the excess is reshared by weight."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    target, open_, rest = np.zeros(len(size)), weight > 0, float(total)
    while open_.any():
        share = np.where(open_, rest * weight / weight[open_].sum(), 0.0)
        over = open_ & (share > most * size)
        if not over.any():
            return np.where(open_, share, target)
        target[over] = most * size[over]
        rest -= target[over].sum()
        open_ &= ~over
    return target


def integral(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(start, weight there, slope, share of the whole integral before it) of each piece of a schedule."""
    t, w = (np.array(x, float) for x in zip(*schedule, strict=True))
    if len(t) < 2 or t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any() or (w < 0).any() or not w.any():
        raise ValueError("a schedule goes from time 0 to 1 in ascending knots with weights of 0 or more, not all 0")
    area = np.diff(t) * (w[1:] + w[:-1]) / 2
    before = np.concatenate([[0.0], np.cumsum(area)[:-1]]) / area.sum()
    return [(float(a), float(x / area.sum()), float(s / area.sum()), float(b)) for a, x, s, b in zip(t[:-1], w[:-1], np.diff(w) / np.diff(t), before, strict=True)]


def _time(share: Column, pieces: Column) -> Column:
    """When the share of the demand is reached: the inverse of the integral, which is quadratic in each piece."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= share), -1)
    need = share - piece["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["weight"] * piece["weight"] + 2 * piece["slope"] * need))
    return F.when(need <= 0, piece["start"]).otherwise(piece["start"] + 2 * need / (piece["weight"] + root))


def plan(
    docs: DataFrame,
    weight_of: Callable[[int, str | None], float],
    schedule_of: Callable[[int, str | None], Schedule] = lambda k, source: CONSTANT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: float = 3.0,
    whole: bool = False,
    max_sources: int = 100_000,
    rows_per_bucket: int = 1_000,
    carry: Sequence[str] = (),
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: the id, ``size`` (words), ``source_size``, ``target`` (of its source), ``taken`` (words
    the mix takes of it, repeats counted) and ``copies``, an array of (copy, words, position), plus ``carry``.

    Sources are numbered by code point, null last, and get the weight and schedule of their number and name. Within
    a source, documents come in the order of a hash of id and text: equal rows tie and are ordered arbitrarily, which
    changes nothing but which of them is taken. Copy k of the source follows copy k - 1; the last copy is cut at the
    target, so the taken words are the rounded target exactly; with ``whole`` a copy is taken or not as its middle
    lies before the target or not, and words differ from the target by half a document at most. No document
    is taken more than ``most`` times, rounded up. Null and empty texts have size 0 and are never taken; a null id is kept; an empty
    table gives an empty result. The driver holds one row per source and refuses more than ``max_sources``. A source
    of any size is summed by hash buckets of about ``rows_per_bucket`` rows, and these by ranges of buckets, so a task
    that sums a source has the root of its number of buckets. ``scratch`` holds what the result reads; whoever gives it
    may drop it when the result is written.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col(id_col).cast("long").alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
            # 60 bits of MD5, which other engines have as well
            F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), text)), 1, 15), 16, 10).cast("long").alias("_hash"),
            *(F.col(c).alias(f"_carry_{c}") for c in carry),
        )
    )
    per_source = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = per_source.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    names = [r["_source"] for r in found]
    total = sum(r["size"] for r in found)
    aims = targets([r["size"] for r in found], [weight_of(k, s) for k, s in enumerate(names)], most, total)
    dim = spark.createDataFrame(
        [(s, k, r["size"], float(t), int(np.floor(t + 0.5)), integral(schedule_of(k, s))) for k, (s, r, t) in enumerate(zip(names, found, aims, strict=True))],
        "_source string, _k int, _source_size long, _target double, _aim long, _pieces array<struct<start: double, weight: double, slope: double, before: double>>",
    )
    bits = log2_ceil(max([1, *(r["n"] for r in found)]) // rows_per_bucket + 1)
    bucket = F.shiftright("_hash", 60 - bits).cast("int") if bits else F.lit(0)
    rows = rows.join(F.broadcast(dim), rows["_source"].eqNullSafe(dim["_source"])).drop("_source").withColumn("_bucket", bucket)
    # prefix sums in two levels: ranges of buckets within a source, then buckets within a range
    sums = rows.groupBy("_k", "_bucket").agg(F.sum("_size").alias("_in_bucket")).withColumn("_range", F.shiftright("_bucket", bits // 2))
    sums = scratch.write(sums)
    ahead = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy("_k", "_range").agg(F.sum("_in_bucket").alias("_in_range"))
    ranges = ranges.select("_k", "_range", F.coalesce(F.sum("_in_range").over(ahead), F.lit(0)).alias("_before_range"))
    before = Window.partitionBy("_k", "_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_range", "_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_in_range_before"))
    sums = sums.join(ranges, ["_k", "_range"]).select("_k", "_bucket", (F.col("_before_range") + F.col("_in_range_before")).alias("_before"))
    within = Window.partitionBy("_k", "_bucket").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["_k", "_bucket"]).withColumn("_at", F.col("_before") + F.sum("_size").over(within) - F.col("_size"))

    def copy(k: Column) -> Column:
        start = k * F.col("_source_size") + F.col("_at")
        if whole:
            words = F.when(start + F.col("_size") / 2 < F.col("_aim"), F.col("_size")).otherwise(F.lit(0))
        else:
            words = F.least(F.greatest(F.col("_aim") - start, F.lit(0)), F.col("_size"))
        share = F.least(F.lit(1.0), start / F.greatest(F.col("_target"), F.lit(1.0)))
        return F.struct((k + 1).cast("int").alias("copy"), words.cast("long").alias("words"), _time(share, F.col("_pieces")).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1)), copy), lambda c: c["words"] > 0)
    rows = rows.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(F.slice(copies, 1, 0)))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
        F.col("_copies").alias("copies"),
        *(F.col(f"_carry_{c}").alias(c) for c in carry),
    )


def by_position(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The plan's documents range-sorted by the position of their first copy; those not taken come last.

    The plan is written first, as range-sorting reads its input twice."""
    return Scratch(planned.sparkSession).write(planned).withColumn("position", F.get("copies", F.lit(0))["position"]).orderBy(F.col("position").asc_nulls_last(), id_col)


def training_order(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per taken copy, range-sorted by training position; columns of the plan, and ``copy``, ``words``, ``position``."""
    copies = planned.select("*", F.explode("copies").alias("_c")).drop("copies")
    return copies.select("*", "_c.copy", "_c.words", "_c.position").drop("_c").orderBy("position", id_col, "copy")
