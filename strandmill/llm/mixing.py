"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a base weight and a schedule: how its weight moves over training time t in [0, 1], given as knots
(t, multiplier) joined by straight lines. A source's documents form a token stream in hash order, repeated as often
as its target asks. The integral of its schedule is its cumulative token demand; a copy that begins c words into the
stream stands at the t where the demand reaches c. Range-sorting all copies by t gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, row_key, table

#: Schedules by weight class: early, steady and late sources.
SCHEDULES = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]]
MOST_REPEATS = 3
#: Tasks over which the copies of fully equal rows are dealt.
SALTS = 64


def words(text: Column) -> Column:
    """Words as runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> also weight, class and target; one row per source.

    All sizes together are shared out by weight; a target stops at `most_repeats` times its source's size and what it
    leaves is reshared by weight until none is above. In order of cap / weight the capped sources are a prefix: a
    source is capped when the level that the rest would get, (total - caps so far) / (weights not yet capped), is not
    below its own cap / weight. Sources are ordered by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_class") + 1).cast("int"))
    s = sizes.withColumn("_class", (F.row_number().over(by_name) - 1) % n).withColumn("_w", w)
    s = s.withColumn("_cap", F.col("source_size") * float(most_repeats))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_weights"))
    s = s.withColumn("_capped", F.col("_level") * F.col("_w") >= F.col("_cap"))
    first_open = F.first(F.when(~F.col("_capped"), F.col("_level")), ignorenulls=True).over(everything)
    s = s.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(first_open * F.col("_w")))
    return s.select("source", "source_size", F.col("_w").alias("weight"), F.col("_class").alias("class"), "target")


def position(share: Column, group: Column, schedules: list = SCHEDULES) -> Column:
    """The time at which the normalised integral of a class's schedule reaches `share`."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, done, piece = sum(areas), 0.0, F.lit(1.0)
        parts = []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            need, slope = share * whole - F.lit(done), (w1 - w0) / (t1 - t0)
            if slope:
                at = (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * (2 * slope))) - w0) / slope
            else:
                at = need / (w0 or 1.0)
            parts.append((done + area, F.lit(t0) + at))
            done += area
        for end, at in reversed(parts):
            piece = F.when(share * whole <= end, at).otherwise(piece)
        out = F.when(group % len(schedules) == k, piece).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def mix(docs: DataFrame, seed: int = 0, weights: tuple = (1, 2, 3), most_repeats: int = MOST_REPEATS, key_columns: tuple = ("doc_id", "text")) -> DataFrame:
    """One row per input row: doc_id, _key, _row, source, size, source_size, target, taken, copies, positions (of each copy).

    A source's stream goes on for target words: full passes over all its documents in hash order, the last pass cut
    at the target's word. taken is what a document gives to it, copies how often it begins in it (a cut copy counts
    from half of its words on). Null texts and texts without words have size 0, are never taken and have no copies;
    a null source is a source of its own; rows with equal doc_ids are told apart by their text, rows with equal key columns
    share what they are given in some order. An empty table gives no rows.

    Texts are read once, into a narrow table. The stream's offsets are prefix sums in two levels, by slices of the hash and
    within a slice, so no task holds more of a hot source than 1/4096. Only the table of sources is ordered in one task.
    """
    base = docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), row_key(docs, list(key_columns), seed).alias("_key"))
    base = materialize(base, "mixing-sizes").withColumn("_row", F.conv(F.substring("_key", 1, 15), 16, 10).cast("long"))
    base = base.withColumn("_slice", F.shiftright("_row", 48).cast("int"))
    slices = base.groupBy("source", "_slice").agg(F.sum("size").alias("_bytes"))
    by_source = slices.groupBy("source").agg(F.sum("_bytes").alias("source_size"))
    targets = source_targets(by_source, weights, most_repeats).withColumnRenamed("source", "_s")
    over = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source"), F.col("_slice"), F.coalesce(F.sum("_bytes").over(over), F.lit(0)).alias("_start"))
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_slice").alias("_sl"), "_start", "source_size", "class", "target")
    inside = Window.partitionBy("source", "_slice").orderBy("_row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = base.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_sl")))
    at = F.col("_start") + F.col("_in")
    begins = [at + F.col("source_size") * e for e in range(most_repeats)]
    end = F.round("target").cast("long")
    took = [F.greatest(F.lit(0), F.least(F.col("size"), end - b)).cast("long") for b in begins]
    taken = sum(took[1:], took[0])
    full = [(t > 0) & (t * 2 >= F.col("size")) for t in took]
    copies = sum([f.cast("int") for f in full[1:]], full[0].cast("int"))
    places = F.filter(F.array(*[F.when(f, position(b / F.col("target"), F.col("class"))) for f, b in zip(full, begins)]), lambda x: x.isNotNull())
    return laid.select("doc_id", "_key", "_row", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), places.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts by the first copy's position; what is never taken goes behind, spread by its hash."""
    key = F.coalesce(F.try_element_at("positions", F.lit(1)), 1.0 + F.col("_row") / F.lit(2.0**60))
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.withColumn("_at", key).repartitionByRange(n, "_at", "_row").sortWithinPartitions("_at", "_row", "doc_id").drop("_at")


def training_copies(docs: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """The mixed documents themselves: one row for each copy, range-sorted by position, with the given columns.

    Rows are found again by a 128-bit key over all the columns, in which null differs from empty. Fully equal rows have one
    key: their copies, however many, are made from one of them, dealt over SALTS tasks. Columns of any name may come along.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    placed = mix(docs, seed, key_columns=tuple(columns))
    equal = materialize(placed.groupBy("_key").count().where("count > 1").select(F.col("_key").alias("_again")), "mixing-equal")
    copies = placed.where("copies > 0").select("_key", F.explode("positions").alias("_at"))
    whole = docs.select(row_key(docs, columns, seed).alias("_k"), *[quoted(c).alias(n) for c, n in zip(columns, names)])
    if equal.limit(1).count():
        is_equal = lambda k: F.col(k) == F.col("_again")
        comparable = [n for n, c in zip(names, columns) if "map" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        again = whole.join(equal, is_equal("_k"), "left_semi").dropDuplicates(["_k", *comparable]).select("*", salt.alias("_salt"))
        whole = whole.join(equal, is_equal("_k"), "left_anti").withColumn("_salt", F.lit(0)).unionByName(again)
        salted = copies.join(equal, is_equal("_key"), "left").withColumn("_salt", F.when(F.col("_again").isNull(), 0).otherwise(F.pmod(F.xxhash64("_at"), F.lit(SALTS))))
        out = whole.join(salted.select("_key", "_at", F.col("_salt").cast("int").alias("_salt2")), (F.col("_k") == F.col("_key")) & (F.col("_salt") == F.col("_salt2")))
    else:
        out = whole.join(copies, F.col("_k") == F.col("_key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.select(*names, "_k", "_at").repartitionByRange(n, "_at", "_k").sortWithinPartitions("_at", "_k")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


ORACLE = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         cast(concat('0x', substr(md5(concat_ws('#', '0', coalesce(length(doc_id::varchar) || ':' || doc_id::varchar, 'n'),
           coalesce(length(text) || ':' || text, 'n'))), 1, 15)) as bigint) as r
  from documents),
sums as (select source, sum(size)::double as s from base group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sums),
levels as (
  select *, (sum(s) over () - coalesce(sum(3 * s) over lower, 0)) / (sum(w) over () - coalesce(sum(w) over lower, 0)) as level
  from weighed window lower as (order by 3 * s / w, source nulls last rows between unbounded preceding and 1 preceding)),
marked as (select *, level * w >= 3 * s as capped from levels),
targets as (
  select source, s, w, case when capped then 3 * s else w * first_value(case when not capped then level end ignore nulls)
         over (order by 3 * s / w, source nulls last rows between unbounded preceding and unbounded following) end as target
  from marked),
laid as (
  select b.*, t.s, t.w, t.target, round(t.target)::bigint as stop,
         coalesce(sum(b.size) over (partition by b.source order by b.r, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0)::bigint as began
  from base b join targets t on b.source is not distinct from t.source),
took as (
  select *, greatest(0, least(size, stop - began)) as t0, greatest(0, least(size, stop - began - s::bigint)) as t1,
         greatest(0, least(size, stop - began - 2 * s::bigint)) as t2 from laid),
firsts as (
  select *, case when t0 > 0 and 2 * t0 >= size then began when t1 > 0 and 2 * t1 >= size then began + s::bigint
                 when t2 > 0 and 2 * t2 >= size then began + 2 * s::bigint end / target as share from took)
select doc_id, size, s::bigint as source_size, round(target, 6) as target, (t0 + t1 + t2)::bigint as taken,
       ((t0 > 0 and 2 * t0 >= size)::int + (t1 > 0 and 2 * t1 >= size)::int + (t2 > 0 and 2 * t2 >= size)::int)::bigint as copies,
       case when share is not null then round(least(1.0, greatest(0.0, case w when 1 then 1.5 - sqrt(greatest(0.0, 2.25 - 2 * share)) when 2 then share
             else case when share <= 0.375 then sqrt(greatest(0.0, 0.25 + 2 * share)) - 0.5 else 0.5 + sqrt(greatest(0.0, 1 + 2 * (share - 0.375))) - 1 end end)), 9) end as position
from firsts
"""


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = in_training_order(mix(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.col("copies").cast("long").alias("copies"), F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position"))
