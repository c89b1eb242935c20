"""Order-dependent operators that hold when one key owns a large part of all rows.

A plain window puts a whole key (or, without a key, the whole table) into one task. The operators
here cut hot keys into time slices or value ranges, work per slice, and carry only small,
bounded state across the cuts. Results are the same as those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk.session import stage

HOT_ROWS = 5_000_000
#: Most slices of a key.
SLICES = 4096
PERCENTILE_ACCURACY = 100_000
#: Values that one task may order.
TASK_ROWS = 1_000_000
BROADCAST_GROUPS = 10_000


def limit_if_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> int | None:
    """`hot_rows` if a key of the table has more rows, else None: the operators below then plan no cuts at all."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    return None if hot.isEmpty() else hot_rows


def sliced(df: DataFrame, keys: list[str], ts: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add __hot and __slice: keys with more than `hot_rows` rows are cut into time slices of about equally many rows.

    The cuts are quantiles of the key's own times, so a burst is cut as finely as it is dense. There are at most rows / hot_rows
    hot keys and cuts, which bounds the broadcast tables. Rows of one microsecond stay together.
    """
    if hot_rows is None:
        return df.withColumns({"__hot": F.lit(False), "__slice": F.lit(0)})
    at = F.unix_micros(ts)
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    # only rows of hot keys are sketched; without any, nothing is read
    known = df.select(*keys, at.alias("__at")).join(F.broadcast(hot), keys)
    wanted = F.least(F.lit(SLICES), F.ceil(F.max("__n") / hot_rows).cast("int"))
    # one literal: an array of thousands of expressions would make the plan slow to analyse
    shares = F.split(F.lit(",".join(str(i / SLICES) for i in range(1, SLICES))), ",").cast("array<double>")
    quantiles = F.percentile_approx("__at", shares, 10 * SLICES)
    cuts = known.groupBy(*keys).agg(quantiles.alias("__q"), wanted.alias("__w")).select(*keys, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.col("__w") - 1), lambda i: F.get("__q", F.floor(i * SLICES / F.col("__w")).cast("int") - 1))).alias("__cuts"))
    return df.join(F.broadcast(cuts), keys, "left").select(
        *df.columns,
        F.col("__cuts").isNotNull().alias("__hot"),
        F.coalesce(F.size(F.filter("__cuts", lambda c: c < at)), F.lit(0)).alias("__slice"),
    )


def framed(df: DataFrame, keys: list[str], ts: str, tie: str, depth: int,
           build: Callable[[Window], dict[str, Column]], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add window columns over (keys, ordered by ts and tie) that look at most `depth` rows back.

    Hot keys are cut into slices. Each slice gets the last `depth` rows before it as a halo, so every frame is complete, and the
    halo is dropped at the end.
    """
    if hot_rows is None:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(ts, tie)))
    tagged = sliced(df, keys, ts, hot_rows).withColumn("__halo", F.lit(False))
    slice_keys = [*keys, "__slice"]
    recent = Window.partitionBy(*slice_keys).orderBy(F.desc(ts), F.desc(tie))
    row = F.struct(ts, tie, *[c for c in df.columns if c not in (ts, tie)])
    tails = (
        tagged.filter("__hot")
        .withColumn("__rn", F.row_number().over(recent))
        .filter(F.col("__rn") <= depth)
        .groupBy(*slice_keys)
        .agg(F.sort_array(F.collect_list(row)).alias("__tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(-depth, -1)
    halo = (
        tails.withColumn("__before", F.flatten(F.collect_list("__tail").over(earlier)))
        .select(*slice_keys, F.explode(F.slice(
            F.col("__before"), F.greatest(F.lit(1), F.size("__before") - depth + 1), F.lit(depth))).alias("__r"))
        .select(*[F.col(f"__r.{c}").alias(c) for c in df.columns],
                F.lit(True).alias("__hot"), "__slice", F.lit(True).alias("__halo"))
    )
    w = Window.partitionBy(*slice_keys).orderBy(ts, tie)
    return (
        tagged.unionByName(halo).withColumns(build(w)).filter("not __halo")
        .drop("__hot", "__slice", "__halo")
    )


def previous(df: DataFrame, keys: list[str], ts: str, tie: str, columns: dict[str, str],
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add the previous row's value of some columns: {new name: column}."""
    build = lambda w: {new: F.lag(old).over(w) for new, old in columns.items()}
    return framed(df, keys, ts, tie, 1, build, hot_rows)


def rolling_counts(df: DataFrame, key: str, ts: str, measures: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add counts over the trailing hours, both ends included: {name: (condition, hours)}.

    Events are first reduced to one row per (key, second). A count then is a running sum in
    which each second adds its events and takes them away again once the horizon has passed.
    Running sums are cut at day borders, so a task holds one day of one key, never a whole key.
    """
    second = F.unix_seconds(ts)
    tagged = df.withColumn("__sec", second)
    names = list(measures)
    per_second = tagged.groupBy(key, "__sec").agg(
        *[F.count_if(condition).alias(n) for n, (condition, _) in measures.items()]
    )
    zero = {n: F.lit(0).cast("long").alias(n) for n in names}
    hours = sorted({h for _, h in measures.values()})
    parts = [F.struct(F.col("__sec").alias("s"), F.lit(1).alias("seen"), *[F.col(n) for n in names])]
    for h in hours:
        expired = [
            (-F.col(n)).alias(n) if measures[n][1] == h else zero[n] for n in names
        ]
        parts.append(F.struct((F.col("__sec") + h * 3600 + 1).alias("s"), F.lit(0).alias("seen"), *expired))
    deltas = (
        per_second.select(key, F.explode(F.array(*parts)).alias("d"))
        .groupBy(key, F.col("d.s").alias("__sec"))
        .agg(F.max("d.seen").alias("__seen"), *[F.sum(f"d.{n}").alias(n) for n in names])
        .withColumn("__day", F.floor(F.col("__sec") / 86400))
    )
    within = Window.partitionBy(key, "__day").orderBy("__sec").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    opening = deltas.groupBy(key, "__day").agg(*[F.sum(n).alias(n) for n in names]).select(
        key, "__day", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in names]
    )
    totals = (
        deltas.withColumns({f"__r_{n}": F.sum(n).over(within) for n in names})
        .filter("__seen = 1")
        .join(opening, [key, "__day"])
        .select(key, "__sec", *[(F.col(f"__r_{n}") + F.col(f"__o_{n}")).alias(n) for n in names])
    )
    return tagged.join(totals, [key, "__sec"]).drop("__sec")


def percentiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                max_groups: int | None = None, accuracy: int = PERCENTILE_ACCURACY, task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact, linearly interpolated percentiles: by..., n, p array<double> in the order of `probs`.

    A mergeable sketch first brackets every wanted percentile. Its rank error is proven, so the
    exact value lies inside; rows outside the brackets are only counted, rows inside are reduced
    to value counts. Per group about 8 * len(probs) / accuracy of the rows remain to be ordered, or at most `accuracy` rows of
    a small group. Where that can be more than `task_rows` values in a group, they are dealt in value ranges of
    about so many, summed within each range, and the totals of the lower ranges are added: no task orders a whole group.

    `max_groups` is the caller's proven bound on the number of groups. Under BROADCAST_GROUPS the
    brackets are broadcast and the rows stay where they are; otherwise rows and brackets are
    joined by group.
    """
    by = by or []
    base = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    margin = 4.0 / accuracy
    lows = [max(0.0, p - margin) for p in probs]
    highs = [min(1.0, p + margin) for p in probs]
    sketch = base.groupBy(*by).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", lows + highs, accuracy).alias("__b"),
    )
    k = len(probs)
    # twice the width of a bracket covers the errors of both its ends
    left = lambda n: n if n <= accuracy else min(n, math.ceil(n * 16 * k / accuracy))
    if by:
        bracket = F.transform(
            F.sequence(F.lit(1), F.lit(k)),
            lambda i: F.struct(F.element_at("__b", i).alias("lo"), F.element_at("__b", i + k).alias("hi")),
        )
        marks = stage(sketch.select(*by, "__n", bracket.alias("__br")), "brackets")
        largest = left(marks.agg(F.max("__n")).first()[0] or 0)
        # null-safe, so that a null group keeps its percentiles
        m = marks.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__n", "__br")
        condition = _same(by, "__by_")
        small_side = max_groups is not None and max_groups <= BROADCAST_GROUPS
        rows = base.join(F.broadcast(m) if small_side else m, condition).drop(*[f"__by_{c}" for c in by])
    else:
        one = sketch.first()
        largest = left(one["__n"])
        ends = one["__b"] or [0.0] * (2 * k)
        rows = base.withColumns({"__n": F.lit(one["__n"]), "__br": F.array(*[
            F.struct(F.lit(float(ends[i])).alias("lo"), F.lit(float(ends[i + k])).alias("hi")) for i in range(k)])})
    small = F.col("__n") <= accuracy
    inside = small | F.exists("__br", lambda b: F.col("__v").between(b["lo"], b["hi"]))
    passed = F.when(small, F.lit(0)).otherwise(F.size(F.filter("__br", lambda b: b["hi"] < F.col("__v"))))
    runs = (
        rows.select(*by, "__n", "__v", passed.alias("__seg"), F.when(inside, F.col("__v")).alias("__key"))
        .groupBy(*by, "__seg", "__key")
        .agg(F.count("*").alias("__c"), F.min("__v").alias("__rep"), F.max("__n").alias("__n"))
    )
    if largest > task_rows:
        ranked = _ranked_in_ranges(_in_ranges(runs, by, "__rep", task_rows), by)
    else:
        w = Window.partitionBy(*by, F.lit(0)).orderBy("__rep").rowsBetween(Window.unboundedPreceding, 0)
        ranked = runs.withColumn("__hi", F.sum("__c").over(w)).withColumn("__lo", F.col("__hi") - F.col("__c"))
    wanted = F.filter(
        F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p, i: F.struct(
            i.alias("i"), (p * (F.col("__n") - 1)).alias("at"))),
        lambda w: (F.col("__lo") <= F.ceil(w["at"])) & (F.floor(w["at"]) < F.col("__hi")),
    )
    hit = lambda index: F.max(F.when(
        (F.col("__lo") <= index) & (index < F.col("__hi")), F.col("__key")))
    at = F.col("__w.at")
    picked = ranked.withColumn("__w", F.explode(wanted)).groupBy(*by, "__w.i").agg(
        F.max("__n").alias("n"), F.max(at - F.floor(at)).alias("__f"),
        hit(F.floor(at)).alias("__a"), hit(F.ceil(at)).alias("__b"),
    )
    value_at = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")
    listed = F.sort_array(F.collect_list(F.struct("i", value_at.alias("v"))))
    return picked.groupBy(*by).agg(F.max("n").alias("n"), F.transform(listed, lambda e: e["v"]).alias("p"))


def _same(by: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return condition


def _in_ranges(runs: DataFrame, by: list[str], value: str, task_rows: int) -> DataFrame:
    """`runs` written in ranges of (by..., value) with about `task_rows` rows each, and `__range`, the number of the range."""
    written = stage(runs, "runs")
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // task_rows))
    return stage(written.repartitionByRange(ranges, *by, value).withColumn("__range", F.spark_partition_id()), "ranges")


def _ranked_in_ranges(placed: DataFrame, by: list[str]) -> DataFrame:
    """Add __lo and __hi: rows of the group before a run, and up to its end."""
    totals = placed.groupBy("__range", *by).agg(F.sum("__c").alias("__t"))
    # a row per range that the group reaches into
    lower = Window.partitionBy(*by, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__range").alias("__in"), *[F.col(c).alias(f"__of_{c}") for c in by],
                            F.coalesce(F.sum("__t").over(lower), F.lit(0)).alias("__o"))
    inner = Window.partitionBy("__range", *by).orderBy("__rep").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, (F.col("__range") == F.col("__in")) & _same(by, "__of_"))
    return joined.withColumn("__hi", F.sum("__c").over(inner) + F.col("__o")).withColumn("__lo", F.col("__hi") - F.col("__c")).drop(
        "__in", "__o", *[f"__of_{c}" for c in by])


def cumulative(df: DataFrame, value: str, measures: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """One row per distinct value: value, measures, and `below_<m>` = total of smaller values.

    Rows are reduced to distinct values first. These are dealt in value ranges and written once with the number of
    their range; then they are summed within each range, and the totals of the lower ranges are added. There are as
    many ranges as shuffle partitions; set these by the size of the table.
    """
    names = list(measures)
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    placed = stage(distinct.repartitionByRange(ranges, value).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__range").agg(*[F.sum(n).alias(n) for n in names])
    lower = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__range", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"__o_{n}") for n in names]
    )
    inner = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "__range")  # at most `ranges` rows
        .withColumns({f"below_{n}": F.coalesce(F.sum(n).over(inner), F.lit(0)) + F.col(f"__o_{n}") for n in names})
        .select(value, *names, *[f"below_{n}" for n in names])
    )


def total_rank(df: DataFrame, score: str, key: str, ranges: int | None = None) -> DataFrame:
    """Rank all rows by score, highest first: `rank` (ties share) and `position` (unique).

    Rows without a score share the last rank. Ties are ordered by the MD5 of the key, whose first two
    digits also split a score that very many rows share, so neither a window nor the join ever holds all rows of one score.
    """
    digest = F.md5(F.col(key).cast("string"))
    last = F.lit(float("inf"))
    rows = df.withColumns({"__neg": F.coalesce(-F.col(score).cast("double"), last), "__h": digest, "__cell": F.substring(digest, 1, 2)})
    cells = rows.groupBy("__neg", "__cell").agg(F.count("*").alias("__c"))
    values = cumulative(
        cells, "__neg", {"__rows": F.sum("__c")}, ranges
    ).select("__neg", F.col("below___rows").alias("__above"))
    inner = Window.partitionBy("__neg").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.join(values, "__neg").select(
        "__neg", "__cell", "__above", F.coalesce(F.sum("__c").over(inner), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("__neg", "__cell").orderBy("__h", key)
    return (
        rows.join(offsets, ["__neg", "__cell"])
        .withColumn("rank", F.col("__above") + 1)
        .withColumn("position", F.col("__above") + F.col("__before") + F.row_number().over(within))
        .drop("__neg", "__h", "__cell", "__above", "__before")
    )


def hash_position(df: DataFrame, key: str) -> DataFrame:
    """Add `position`: the unique place (from 1) of each row in the order of its key's MD5.

    Offsets come from counts per four-digit prefix, at most 65,536 rows.
    """
    rows = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__px", F.substring("__h", 1, 4))
    before = Window.partitionBy(F.lit(0)).orderBy("__px").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__px").agg(F.count("*").alias("__c")).select(
        "__px", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__px").orderBy("__h", key)
    return rows.join(F.broadcast(offsets), "__px").withColumn(
        "position", F.col("__before") + F.row_number().over(within)).drop("__h", "__px", "__before")


def smallest(df: DataFrame, hashed: str, wanted: Column) -> DataFrame:
    """Exactly `wanted` rows with the smallest 32-digit hex hash, without sorting the table.

    Counts per four-digit prefix (65,536 at most) find the prefix in which the cut lies; only
    the rows of that prefix are ranked.
    """
    rows = df.withColumn("__px", F.substring(hashed, 1, 4))
    counts = rows.groupBy("__px").agg(F.count("*").alias("__c"))
    running = Window.partitionBy(F.lit(0)).orderBy("__px").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("__hi", F.sum("__c").over(running))
        .withColumn("__lo", F.col("__hi") - F.col("__c"))
        .filter((F.col("__lo") < wanted) & (wanted <= F.col("__hi")))
        .agg(F.struct(F.max("__px").alias("px"), F.max("__lo").alias("lo")).alias("s"))
        .scalar()
    )
    edge = Window.partitionBy("__px").orderBy(hashed)
    below = rows.filter(F.col("__px") < cut["px"])
    at = (
        rows.filter(F.col("__px") == cut["px"]).withColumn("__rn", F.row_number().over(edge))
        .filter(F.col("__rn") + cut["lo"] <= wanted).drop("__rn")
    )
    return below.unionByName(at).drop("__px")


def split(df: DataFrame, key: str, share: float, by: list[str] | None = None) -> DataFrame:
    """Add `in_first`: true for exactly floor(share * n) rows per group, chosen by key hash.

    The cut per group is found from counts per hash prefix, so no group is ever sorted whole.
    """
    by = by or []
    names = [f"__by_{i}" for i in range(len(by))]
    rows = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__px", F.substring("__h", 1, 4))
    counts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], "__px").agg(F.count("*").alias("__c"))
    everything = Window.partitionBy(*names, F.lit(0))
    running = everything.orderBy("__px").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.withColumns({
        "__hi": F.sum("__c").over(running),
        "__want": F.floor(F.sum("__c").over(everything) * share),
    }).withColumn("__lo", F.col("__hi") - F.col("__c"))
    condition = F.col("__px") == F.col("__cell_px")
    for c, n in zip(by, names):
        condition = condition & F.col(c).eqNullSafe(F.col(n))
    joined = rows.join(cells.withColumnRenamed("__px", "__cell_px"), condition)
    inner = Window.partitionBy(*by, "__px").orderBy("__h", key)
    return joined.withColumn("in_first", F.row_number().over(inner) + F.col("__lo") <= F.col("__want")).drop(
        "__h", "__px", "__cell_px", "__c", "__hi", "__lo", "__want", *names
    )
