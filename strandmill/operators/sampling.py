"""Splits, folds, bootstrap and draws. Every seeded draw orders rows by MD5 of id and seed, so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import md5_order
from .storage import cut


def numbered(rows: DataFrame, keys: list[str], name: str = "position", by: list[str] | None = None) -> DataFrame:
    """Adds the row's place, from 0, in order of the keys (columns), in its group where `by` names some. Rows are range-dealt,
    sorted in their range, numbered there and written down with both numbers: a second look at the same plan would sample
    other ranges. Only a count for each range and group comes together, never the rows of a group."""
    n, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by or []
    dealt = rows.repartitionByRange(n, *by, *keys).sortWithinPartitions(*by, *keys)
    inside = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = inside.groupBy("_part", *by).agg(F.count("*").alias("_k"), F.min("_in").alias("_least"))
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_least")).alias("_start"))
    mine = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        mine = mine & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    placed = inside.join(starts if by else F.broadcast(starts), mine)  # without groups a row for each range
    return placed.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_p", "_in", "_start", *[f"_by{i}" for i in range(len(by))])


#: Leading hexadecimal digits of a hash by which draws are counted: 65,536 cells.
DIGITS = 4


def bottom_k(rows: DataFrame, order: Column, tie: str, most: Column, by: list[str] | None = None) -> DataFrame:
    """Of each group the `most` rows with the smallest `order` (a hexadecimal hash, the tie by `tie`); `most` is the same for
    all rows of a group. Hash prefixes are counted, the prefix that holds the last wanted row is found, all rows below it
    are kept where they are, and only the rows of that one cell meet to be sorted: the rows themselves aren't shuffled."""
    by = by or []
    h = rows.withColumn("_h", order).withColumn("_cell", F.substring("_h", 1, DIGITS)).withColumn("_most", most)
    counts = h.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), F.first("_most").alias("_k"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell"))  # as many rows as cells
    ends = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.greatest(F.col("_k"), F.lit(1))))
    ends = ends.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_cell").alias("_end"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_more"))
    mine = F.lit(True)
    for i, c in enumerate(by):
        mine = mine & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = h.join(F.broadcast(ends), mine, "left")  # a row for each group
    below = joined.where(F.col("_end").isNull() | (F.col("_cell") < F.col("_end")))
    last = joined.where(F.col("_cell") == F.col("_end")).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_h", tie))).where(F.col("_i") <= F.col("_more"))
    return below.select(*rows.columns).unionByName(last.select(*rows.columns))


def with_count(rows: DataFrame, **counts) -> DataFrame:
    """Adds aggregates over all rows (one row, broadcast) as columns."""
    return rows.crossJoin(F.broadcast(rows.agg(*[c.alias(n) for n, c in counts.items()])))


def split_by_column(rows: DataFrame, column: str, labels: list[str]) -> dict[str, DataFrame]:
    """One frame for each label; at least two labels, all of them present."""
    if len(labels) < 2:
        raise ValueError("a split needs two labels")
    there = {r[0] for r in rows.where(F.col(column).isin(labels)).select(column).distinct().collect()}  # as many as labels at most
    if missing := set(labels) - there:
        raise ValueError(f"no rows for {sorted(missing)}")
    return {x: rows.where(F.col(column) == x) for x in labels}


def head_tail(rows: DataFrame, test_size: float, by: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Adds is_train: the first int(n (1 - test_size)) rows by sample_idx, or by MD5 with a seed; within groups of `by`."""
    order = F.col("sample_idx") if seed is None else md5_order(seed, "sample_idx")
    if not by:
        placed = with_count(numbered(rows.withColumn("_o", order), ["_o", "sample_idx"], "_at"), _n=F.count("*"))
        return placed.withColumn("is_train", (F.col("_at") < (F.col("_n") * (1 - test_size)).cast("int")).cast("int")).drop("_o", "_at", "_n")
    sizes = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    placed = numbered(rows.withColumn("_o", order), ["_o", "sample_idx"], "_at", by)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = placed.join(F.broadcast(sizes), same)  # a row for each group
    return placed.withColumn("is_train", (F.col("_at") < (F.col("_n") * (1 - test_size)).cast("int")).cast("int")).select(*rows.columns, "is_train")


def kfold(rows: DataFrame, k: int, stratify: str | None = None, shuffle: int | None = None) -> DataFrame:
    """Adds fold: contiguous, the first n mod k folds one row longer; stratified: the row's number in its class mod k. Rows are
    taken in order of sample_idx, or with `shuffle` (a seed) of its hash."""
    if shuffle is not None:
        return kfold(rows.withColumn("_id", F.col("sample_idx")).withColumn("sample_idx", F.concat(md5_order(shuffle, "_id"), F.lit("_"), F.col("_id").cast("string"))), k, stratify).withColumn("sample_idx", F.col("_id")).drop("_id")
    if stratify:
        return numbered(rows, ["sample_idx"], "_i", [stratify]).withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")
    rows = with_count(numbered(rows, ["sample_idx"], "_i"), _n=F.count("*")).withColumn("_q", F.expr(f"_n div {k}")).withColumn("_r", F.col("_n") % k)
    return rows.withColumn("fold", F.expr("case when _i < _r * (_q + 1) then _i div (_q + 1) else _r + (_i - _r * (_q + 1)) div _q end").cast("int")).drop("_i", "_n", "_q", "_r")


def bootstrap(rows: DataFrame, seed: int) -> DataFrame:
    """n draws with replacement, as rows with a multiplicity."""
    n = rows.count()
    draw = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#b{seed}"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    drawn = rows.sparkSession.range(n).groupBy(draw.alias("_row")).agg(F.count("*").alias("multiplicity"))
    return numbered(rows, ["sample_idx"], "_row").join(drawn, "_row").drop("_row")


def stratified(rows: DataFrame, label: str, size: int, seed: int) -> DataFrame:
    """Half cases, half controls, with replacement only where a class is short: rows with a multiplicity."""
    half = size // 2
    sizes = rows.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    r = numbered(rows.withColumn("_o", md5_order(seed, "sample_idx")), ["_o", "sample_idx"], "_at", [label]).withColumn("_i", F.col("_at") + 1)
    r = r.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l")))  # a row for each class
    times = F.greatest(F.lit(0), F.floor((half - F.col("_i")) / F.col("_n")) + 1).cast("int")
    return r.withColumn("multiplicity", times).where("multiplicity > 0").select(*rows.columns, "multiplicity")


def balanced(rows: DataFrame, label: str, k: int, seed: int) -> DataFrame:
    """All cases and k controls for each, as far as there are controls."""
    from .selection import balanced_draw

    return balanced_draw(rows, label, k, seed)


def quantile_strata(rows: DataFrame, label: str, size: int, bins: int, seed: int) -> DataFrame:
    """A draw in proportion to quantile bins of a continuous label."""
    cuts = [f"percentile({label}, {i / bins}D)" for i in range(1, bins)]
    q = rows.agg(F.expr(f"array({', '.join(cuts)})").alias("_q"))
    r = rows.crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter("_q", lambda x: x < F.col(label)))).drop("_q")
    sizes = r.groupBy(F.col("bin").alias("_b")).agg(F.count("*").alias("_in"))
    sizes = with_count(sizes, _n=F.sum("_in")).select("_b", F.round(size * F.col("_in") / F.col("_n")).cast("long").alias("_k"))
    r = r.join(F.broadcast(sizes), F.col("bin") == F.col("_b"))  # a row for each bin
    return bottom_k(r, md5_order(seed, "sample_idx"), "sample_idx", F.col("_k"), ["bin"]).drop("_b", "_k")


def strata_draw(rows: DataFrame, label: str, size: int, seed: int, bins: int = 10) -> DataFrame:
    """`size` rows (all where there are fewer) in proportion to quantile bins of a continuous label. What rounding leaves short
    is topped up from the other rows by hash, what it gives too much is trimmed; rows without a label go, and a label that
    doesn't vary makes a plain draw."""
    rows = rows.where(F.col(label).isNotNull())
    order = md5_order(seed, "sample_idx")
    ends = rows.agg(F.min(label) == F.max(label)).first()[0]
    if ends is None or ends:
        return bottom_k(rows, order, "sample_idx", F.lit(size))
    drawn = quantile_strata(rows, label, size, bins, seed).drop("bin")
    have = drawn.count()
    if have > size:
        return bottom_k(drawn, order, "sample_idx", F.lit(size))
    rest = rows.join(drawn.select("sample_idx"), "sample_idx", "left_anti").select(*rows.columns)
    return drawn.unionByName(bottom_k(rest, order, "sample_idx", F.lit(size - have)))


def background(rows: DataFrame, label: str, classes: bool, size: int = 500, seed: int = 22) -> DataFrame:
    """(sample_idx) of the rows that stand for all when values are explained: drawn by class, or by strata of a continuous
    label, each row once, sorted."""
    if not classes:
        return strata_draw(rows, label, size, seed).select("sample_idx").orderBy("sample_idx")
    return stratified(rows, label, size, seed).select("sample_idx").orderBy("sample_idx")


def split_by_labels(samples: DataFrame, labels: DataFrame, wanted: list[str]) -> dict[str, DataFrame]:
    """A frame of samples (sample_idx, iid) for each wanted label of labels (iid, label): ids are looked up, labels of ids that
    aren't there are dropped."""
    tagged = samples.join(labels.select("iid", F.col("label").alias("_label")), "iid").select(*samples.columns, "_label")
    return {x: part.drop("_label") for x, part in split_by_column(tagged, "_label", wanted).items()}


def per_population(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """size // populations rows of each population."""
    r = with_count(rows, _p=F.count_distinct("population"))
    return bottom_k(r, md5_order(seed, "sample_idx"), "sample_idx", F.expr(f"{size} div _p"), ["population"]).drop("_p")


def uniform(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return rows.orderBy(md5_order(seed, key), key).limit(size)


def patches(samples: DataFrame, variants: DataFrame, estimators: int, n_samples: int, n_variants: int, seed: int) -> DataFrame:
    """(estimator_idx, kind, idx): each weak estimator's samples and variants, drawn with seed + estimator."""
    e = samples.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator_idx"))

    def draw(rows, key, n, kind):
        order = F.md5(F.concat_ws("_", F.col(key).cast("string"), (F.col("estimator_idx") + seed).cast("string")))
        r = rows.select(key).crossJoin(F.broadcast(e))  # each row once for each estimator, a parameter
        return bottom_k(r, order, key, F.lit(n), ["estimator_idx"]).select("estimator_idx", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("idx"))

    return draw(samples, "sample_idx", n_samples, "sample").unionByName(draw(variants, "variant_idx", n_variants, "variant"))


def sample_plan(rows: DataFrame, estimators: int, size: int, seed: int, how: str = "random", fixed: bool = False, controls: int = 1) -> DataFrame:
    """(estimator_idx, sample_idx): each estimator's samples, drawn with seed + estimator, or with one seed for all.

    random: `size` rows; stratified: half of them of each of two classes; balanced: all cases and `controls` controls for
    each, `size` at most; per-population: size // populations rows of each. y is the label, population the group."""
    e = rows.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator_idx"))
    order = F.md5(F.concat_ws("_", F.col("sample_idx").cast("string"), (F.lit(seed) if fixed else F.col("estimator_idx") + seed).cast("string")))
    within = {"random": [], "stratified": ["y"], "balanced": ["y"], "per-population": ["population"]}[how]
    counts = {"random": {}, "stratified": {"_k": F.count_distinct("y")}, "balanced": {"_k": F.count_if(F.col("y") == 1)}, "per-population": {"_k": F.count_distinct("population")}}[how]
    counted = with_count(rows, **counts) if counts else rows
    drawn = counted.crossJoin(F.broadcast(e))  # each row once for each estimator, a parameter
    if how == "balanced":
        cases = F.least(F.col("_k"), F.lit(size))
        most = F.when(F.col("y") == 1, cases).otherwise(F.least(controls * F.col("_k"), F.greatest(F.lit(0), size - cases)))
    else:
        most = F.lit(size) if how == "random" else F.floor(F.lit(size) / F.col("_k"))
    return bottom_k(drawn, order, "sample_idx", most.cast("long"), ["estimator_idx", *within]).select("estimator_idx", "sample_idx")


def variant_plan(variants: DataFrame, estimators: int, size: int, seed: int) -> DataFrame:
    """(estimator_idx, variant_idx): each estimator's variants, drawn with seed + estimator."""
    e = variants.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator_idx"))
    order = F.md5(F.concat_ws("_", F.col("variant_idx").cast("string"), (F.col("estimator_idx") + seed).cast("string")))
    r = variants.select("variant_idx").crossJoin(F.broadcast(e))
    return bottom_k(r, order, "variant_idx", F.lit(size), ["estimator_idx"]).select("estimator_idx", "variant_idx")
