"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule, piecewise linear over training time 0 to 1.
Its integral sets the source's share of all words; shares stop at ``most``
times a source's own words, and what is left over is reshared by weight until
none is above.  The schedule's integral up to a time, scaled to the target, is
the source's cumulative word demand.  Within a source, documents stand in a fixed
pseudo-random order (by a hash of key and text), once for each pass over the
source; the demand, inverted at a document's first word of a pass, is the
position in training of that pass.  The result is range-sorted by first position;
``training_order`` makes a row of each pass.

Unless told otherwise, sources take turns at the shapes of ``SHAPES`` (falling,
with a hump, rising), each scaled so that the schedules' integrals are 1, 2, 3,
repeating.  ``schedules`` gives sources schedules of their own.

Scale: documents are summed by source and hash bucket before anything else, so
prefix sums run over at most ``16 ** digits`` buckets of a source and then over
the documents of one bucket; a source with a third of all rows is spread over
all its buckets, whose number follows the number of rows.  Words are counted
once, into a table of narrow rows, where the texts themselves are not kept;
with the texts, they are counted again as the texts are dealt, which costs less
than a further shuffle of them.  Tables of one row a source are the only ones that
meet in one task.  Rows alike in key and text share a bucket.

Edge cases: null text has size 0; a null source is a source of its own, last in
order; a null key is hashed as empty; rows that repeat are taken like different
documents; a source without words has target 0, and its documents are not taken;
an empty table gives an empty result; further columns are ignored, and kept ones
may have any name, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
Schedule = list[tuple[float, float]]
#: Shapes of weight over training time, each with an integral of 1.
SHAPES: tuple[Schedule, ...] = ([(0.0, 1.6), (1.0, 0.4)], [(0.0, 0.5), (0.5, 1.5), (1.0, 0.5)], [(0.0, 0.4), (1.0, 1.6)])
#: Rows that a bucket should hold.
BUCKET = 2000


def words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def position_names(most: int = MOST) -> list[str]:
    """A column for each pass: position, position_2 and so on."""
    return ["position", *(f"position_{k}" for k in range(2, most + 1))]


def _integral(points: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))


def _segments(points: Schedule) -> list[tuple[float, ...]]:
    """Start, start weight, slope, and the shares of the integral before and after each piece."""
    whole, before, out = _integral(points), 0.0, []
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        after = before + (t1 - t0) * (w0 + w1) / 2 / whole
        if after > before:
            out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, before, after))
        before = after
    return out


def invert(share: Column, points: Schedule) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral has passed."""
    segments = _segments(points)
    out = F.lit(float(points[-1][0]))
    for t0, w0, slope, before, after in reversed(segments):
        area = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * area, F.lit(0.0)))
        x = F.when(area <= 0, F.lit(0.0)).otherwise(2 * area / (F.lit(w0) + root))
        out = F.when(share < F.lit(after), F.lit(t0) + x).otherwise(out)
    return out


def targets(sources: DataFrame, weight: Column, most: float = MOST) -> DataFrame:
    """Add total, weight and target to rows of (skey, source_size), one a source.

    A source's limit over its weight says when it fills up; in that order, a
    source is full if its limit is at most its share of what is left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a source from here to the end of this function.
    s = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey"))).withColumn("weight", weight)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("limit", F.lit(most) * F.col("source_size").cast("double"))
    order = Window.orderBy(F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).otherwise(F.lit(float("inf"))), "rank")
    s = s.withColumn("filled", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("limit") * F.col("left") <= (F.col("total") - F.col("filled")) * F.col("weight"))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0)))
    s = s.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    return s.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("rest") / F.col("open") * F.col("weight"))).select("skey", "source_size", "weight", "rank", "target")


def mix(docs: DataFrame, keep: list[str] = ("doc_id",), key: str = "doc_id", source: str = "source", text: str = "text", schedules: dict[str | None, Schedule] | None = None, cycle: tuple[float, ...] = (1, 2, 3), shapes: tuple[Schedule, ...] = SHAPES, most: int = MOST, digits: int | None = None) -> DataFrame:
    """``keep`` with size, source_size, target, taken and the positions of its passes, sorted by position.

    ``schedules`` maps a source to its (time, weight) points; the others take turns
    at ``shapes``, weighted by the ``cycle`` over the sources in code point order.
    taken counts words with repeats: whole passes over the source, then its first
    documents until the target, the last of them in part.  Each position is that
    of a document's first word in a pass, null where the pass doesn't take it.
    """
    schedules, results = schedules or {}, ("size", "source_size", "target", "taken", *position_names(most))
    skey = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~"))  # a null source sorts last
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    # Kept columns go by number on the way, so that no name of theirs meets one used here.
    held = {f"kept{i}": c for i, c in enumerate(keep) if c.lower() not in results}
    whole = docs.select(*[F.col(c).alias(k) for k, c in held.items()], skey.alias("skey"), words(text).alias("size"), digest.alias("place"))
    narrow = Scratch(docs.sparkSession).save(whole.select("skey", "size", "place", *([] if text in keep else held)))
    if digits is None:
        rows, digits = narrow.count(), 1
        while 16**digits * BUCKET < rows and digits < 8:
            digits += 1
    sized = (whole if text in keep else narrow).withColumn("bucket", F.substring("place", 1, digits))
    buckets = narrow.groupBy("skey", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1)
    turn = F.pmod(F.col("rank") - 1, F.lit(len(shapes)))
    own = [(F.col("skey") == F.lit("~" if name is None else f"={name}"), points) for name, points in schedules.items()]
    for this, points in own:
        weight = F.when(this, F.lit(_integral(points))).otherwise(weight)

    def time(at: Column) -> Column:
        """The training time at which a share of a source's demand is met."""
        out = invert(at, shapes[-1])
        for i, points in enumerate(shapes[:-1]):
            out = F.when(turn == i, invert(at, points)).otherwise(out)
        for this, points in own:
            out = F.when(this, invert(at, points)).otherwise(out)
        return out

    goals = targets(buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weight, most)
    within = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(within), F.lit(0))).join(goals, "skey")
    order = Window.partitionBy("skey", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(placed, ["skey", "bucket"]).withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    quota = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), quota - passes * F.col("source_size") - F.col("before")))
    out = out.withColumn("passes", passes).withColumn("part", part).withColumn("taken", (F.col("size") * F.col("passes") + F.col("part")).cast("long"))
    begins = [F.when((F.col("size") > 0) & ((F.col("passes") > k) | ((F.col("passes") == k) & (F.col("part") > 0))), time((F.col("before") + k * F.col("source_size")) / F.col("target"))) for k in range(most)]
    in_order = [F.col("position").asc_nulls_last(), *([key] if key in keep else [])]
    return out.select(*[F.col(k).alias(c) for k, c in held.items()], "size", "source_size", "target", "taken", *[b.alias(n) for b, n in zip(begins, position_names(most), strict=True)]).repartitionByRange(*in_order).sortWithinPartitions(*in_order)


def training_order(mixed: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each pass of each document of ``mix``: its pass (from 1), position and words, sorted by position."""
    names = position_names(most)
    before = lambda k: F.col("size") * k
    turns = F.array(*[F.struct(F.lit(k + 1).alias("pass"), F.col(n).alias("position"), F.least(F.col("size"), F.col("taken") - before(k)).alias("words")) for k, n in enumerate(names)])
    rest = [c for c in mixed.columns if c not in names]
    each = mixed.select(*rest, F.explode(F.filter(turns, lambda t: t["position"].isNotNull())).alias("turn")).select(*rest, "turn.*")
    return each.repartitionByRange("position").sortWithinPartitions("position")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
ranked AS (SELECT skey, source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 AS shape, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * CAST(source_size AS DOUBLE) AS lim,
         row_number() OVER (ORDER BY skey) AS rnk FROM src),
filling AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(weight) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM ranked),
marked AS (SELECT *, lim * remaining <= (total - filled) * weight AS is_full FROM filling),
goals AS (SELECT skey, source_size, shape, CASE WHEN is_full THEN lim ELSE
         (total - coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0.0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM marked),
run AS (SELECT s.doc_id, s.size, g.source_size, g.shape, g.target, CAST(floor(g.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.place, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
         FROM sized s JOIN goals g USING (skey)),
pass AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(quota // source_size AS BIGINT) ELSE 0 END AS passes FROM run),
got AS (SELECT *, greatest(0, least(size, quota - passes * source_size - before)) AS part FROM pass),
-- Each pass's share of the source's demand met before the document.
turns AS (SELECT *, k, CASE WHEN size > 0 AND (passes > k OR (passes = k AND part > 0)) THEN (before + k * source_size) / target END AS share FROM got, (SELECT unnest([0, 1, 2]) AS k)),
-- The piece of the shape that the share falls in: its start, weight there, slope, and the share before it.
-- 0: 1.6 falling to 0.4; 1: 0.5 rising to 1.5 at one half and back; 2: 0.4 rising to 1.6.
pieces AS (SELECT *, CASE WHEN shape = 1 AND share >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS t0, CASE shape WHEN 0 THEN 1.6 WHEN 1 THEN CASE WHEN share < 0.5 THEN 0.5 ELSE 1.5 END ELSE 0.4 END::DOUBLE AS w0,
         CASE shape WHEN 0 THEN 0.4::DOUBLE - 1.6::DOUBLE WHEN 1 THEN CASE WHEN share < 0.5 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END ELSE 1.6::DOUBLE - 0.4::DOUBLE END AS slope FROM turns),
timed AS (SELECT *, CASE WHEN share - t0 <= 0 THEN t0 ELSE t0 + 2 * (share - t0) / (w0 + sqrt(greatest(w0 * w0 + 2.0::DOUBLE * slope * (share - t0), 0.0::DOUBLE))) END AS moment FROM pieces)
SELECT doc_id, size, source_size, target, CAST(size * passes + part AS BIGINT) AS taken,
       max(moment) FILTER (k = 0) AS position, max(moment) FILTER (k = 1) AS position_2, max(moment) FILTER (k = 2) AS position_3
FROM timed GROUP BY doc_id, size, source_size, target, passes, part, before
""",
}
