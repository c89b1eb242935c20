"""Sliding sequences of daily rows and the sequence anomaly score.

Daily rows are keyed by user and day, so a user's series is bounded by the days of history and a
plain window per user is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators.ordered import framed, percentiles


def _by_user(order: str = "day"):
    return Window.partitionBy("user").orderBy(order)


def sequences(daily: DataFrame, features: list[str] | None = None, length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """Complete sequences: user, day of the last row, `sequence` array<array<double>>."""
    features = features or C.DAILY_FEATURES
    w = _by_user()
    row = F.array(*[F.col(f).cast("double") for f in features])
    return (
        daily.withColumns({
            "rn": F.row_number().over(w),
            "sequence": F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)),
        })
        .filter(F.col("rn") >= length)
    )


def event_sequences(events: DataFrame, features: list[str], length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """Sequences of single events of a user, cut into slices where a user is very busy."""
    row = F.array(*[F.col(f).cast("double") for f in features])
    build = lambda w: {
        "sequence": F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)),
        "n_in_frame": F.count("*").over(w.rowsBetween(-(length - 1), 0)),
    }
    return framed(events, ["user"], "date", "id", length - 1, build).filter(F.col("n_in_frame") >= length)


def labelled_sequences(daily: DataFrame, length: int, label: str = "label", rule: str = "last") -> DataFrame:
    """Sequences labelled by their last row, or by any of their rows."""
    w = _by_user().rowsBetween(-(length - 1), 0)
    value = F.last(label).over(w) if rule == "last" else F.max(label).over(w)
    return sequences(daily.withColumn("sequence_label", value), C.CORE_FEATURES, length)


def sequence_weight(length: int = C.SEQUENCE_LENGTH) -> Column:
    """In how many sequences of its user a daily row takes part."""
    per_user = Window.partitionBy("user")
    i, n = F.row_number().over(_by_user()), F.count("*").over(per_user)
    first, last = F.greatest(F.lit(1), i - (length - 1)), F.least(i, n - (length - 1))
    return F.greatest(F.lit(0), last - first + 1).cast("long")


def scaler(weighted: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation per feature, a row counting once per sequence it is in.

    Output: by..., mean array<double>, scale array<double>; a constant feature gets scale 1.
    """
    sums = weighted.filter("weight > 0").groupBy(*by).agg(
        F.sum("weight").alias("w"),
        *[F.expr(f"sum(weight * double({f})) AS a_{f}") for f in features],
        *[F.expr(f"sum(weight * double({f}) * double({f})) AS b_{f}") for f in features],
    )
    variance = "(b_{0} / w - (a_{0} / w) * (a_{0} / w))"
    floor = "1e-12 * (1 + (a_{0} / w) * (a_{0} / w))"
    mean = [F.expr(f"a_{f} / w") for f in features]
    scale = [
        F.expr(f"CASE WHEN {variance} > {floor} THEN sqrt({variance}) ELSE 1.0D END".format(f))
        for f in features
    ]
    return sums.select(*by, F.array(*mean).alias("mean"), F.array(*scale).alias("scale"))


def _row_error(features: list[str], mean: Column, scale: Column) -> Column:
    """Mean squared standardised value of one daily row."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    z = F.transform(F.arrays_zip(values.alias("x"), mean.alias("m"), scale.alias("s")), lambda e: (e["x"] - e["m"]) / e["s"])
    return F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v * v) / len(features)


def sequence_errors(daily: DataFrame, features: list[str] | None = None,
                    length: int = C.SEQUENCE_LENGTH, roles: list[str] | None = None) -> DataFrame:
    """Error of the sequence ending at each daily row, under the role's and the global scaler.

    This is the reconstruction error of a model without components: the mean squared
    standardised value over the sequence. Rows before a user's first full sequence get none.
    Adds `own_error` (null without a model for the role) and `global_error`.
    """
    features = features or C.DAILY_FEATURES
    weighted = daily.withColumn("weight", sequence_weight(length))
    # one row per modelled role: a fixed bound
    own = scaler(weighted.filter(F.col("role").isin(roles or C.MODEL_ROLES)), features, ["role"])
    everyone = scaler(weighted, features, []).select(F.struct("mean", "scale").alias("s")).scalar()
    # one column for the shared scaler, so that the subquery is planned once
    rows = weighted.join(F.broadcast(own), "role", "left").withColumn("__all", everyone).withColumns({
        "own_row": _row_error(features, F.col("mean"), F.col("scale")),
        "global_row": _row_error(features, F.col("__all.mean"), F.col("__all.scale")),
    })
    w = _by_user()
    frame, complete = w.rowsBetween(-(length - 1), 0), F.row_number().over(w) >= length
    return rows.withColumns({
        "own_error": F.when(complete, F.avg("own_row").over(frame)),
        "global_error": F.when(complete, F.avg("global_row").over(frame)),
    }).drop("weight", "mean", "scale", "__all", "own_row", "global_row")


def model_metadata(errors: DataFrame) -> DataFrame:
    """Per model: sequences, threshold, error mean, population deviation, percentiles."""
    own = errors.filter("own_error is not null").select(F.col("role").alias("model"), F.col("own_error").alias("error"))
    everyone = errors.filter("global_error is not null").select(
        F.lit(C.GLOBAL_MODEL).alias("model"), F.col("global_error").alias("error")
    )
    both = own.unionByName(everyone)
    moments = both.groupBy("model").agg(
        F.count("*").alias("n_sequences"),
        F.avg("error").alias("error_mean"),
        F.stddev_pop("error").alias("error_std"),
    )
    cuts = percentiles(both, "error", [C.TARGET_PERCENTILE, 0.5, 0.95, 0.99], ["model"],
                       max_groups=len(C.MODEL_ROLES) + 1)
    return moments.join(cuts, "model").select(
        "model", "n_sequences", F.col("p")[0].alias("threshold"), "error_mean", "error_std",
        F.col("p")[1].alias("error_p50"), F.col("p")[2].alias("error_p95"), F.col("p")[3].alias("error_p99"),
    )


def with_model(df: DataFrame, metadata: DataFrame, role: str = "role") -> DataFrame:
    """Attach the metadata of the role's own model, else of the global one, else of the first there is, else none."""
    names = ["error_mean", "error_std", "threshold"]
    packed = metadata.select("model", F.struct(*names).alias("m"))
    names_in_order = [C.GLOBAL_MODEL, *C.MODEL_ROLES]
    place = F.array_position(F.array(*[F.lit(n) for n in names_in_order]), F.col("model"))
    turn = F.struct(F.when(place == 0, len(names_in_order) + 1).otherwise(place), F.col("model"))
    shared = packed.agg(F.min_by("m", turn).alias("m")).scalar()
    # one row per model: a fixed bound
    own = packed.select(F.col("model").alias(role), F.col("m").alias("__own"))
    joined = df.join(F.broadcast(own), role, "left").withColumn("__m", F.coalesce("__own", shared))
    return joined.withColumns({n: F.col("__m")[n] for n in names}).drop("__own", "__m")


def anomaly_scores(errors: DataFrame) -> DataFrame:
    """`anomaly_score`: own model first, then global, 0 before the first full sequence."""
    return errors.withColumn(
        "anomaly_score", F.coalesce("own_error", "global_error", F.lit(0.0))
    ).drop("own_error", "global_error")
