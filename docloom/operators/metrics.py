"""Size, pool and step metrics as plain aggregations (partial on the map side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.validate import MODEL_CAPS

MB = 1048576


def _day(time_col: str) -> Column:
    return F.to_date(time_col).alias("__day")


def previous_in_group(df: DataFrame, keys: list[str], time_col: str, id_col: str) -> DataFrame:
    """(id, previous): the row before each one of its group by (time, id).

    A group may hold a tenth of all rows, so it is cut into days: rows look back
    within their day, and the first of a day takes the last of the day before from
    a table of one row a group and day.
    """
    x = df.select(*keys, time_col, id_col, _day(time_col))
    last = x.groupBy(*keys, "__day").agg(F.max(F.struct(time_col, id_col))[id_col].alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__day"))).drop("__last")
    w = Window.partitionBy(*keys, "__day").orderBy(time_col, id_col)
    y = x.withColumn("__own", F.lag(id_col).over(w)).join(carry, [*keys, "__day"], "left")
    return y.select(id_col, F.coalesce("__own", "__carry").alias("previous"))


def running_in_group(df: DataFrame, keys: list[str], time_col: str, id_col: str, value_col: str, rows: int = 3) -> DataFrame:
    """(id, place, total): each row's place in its group by (time, id) and the sum of the last ``rows`` values.

    By days as in ``previous_in_group``: places start after the counts of the days
    before, sums take up the last values of those days. Keys and times may be null.
    """
    x = df.select(*[F.coalesce(F.col(k), F.lit("\0")).alias(k) for k in keys], time_col, id_col, value_col, F.coalesce(_day(time_col), F.lit("0001-01-01").cast("date")).alias("__day"))
    w = Window.partitionBy(*keys, "__day").orderBy(time_col, id_col)
    x = x.withColumns({"__n": F.row_number().over(w), "__own": F.collect_list(F.struct(F.col(value_col).alias("v"))).over(w.rowsBetween(1 - rows, 0))})
    day = x.groupBy(*keys, "__day").agg(F.count("*").alias("__size"), F.max_by("__own", "__n").alias("__tail"))
    d = Window.partitionBy(*keys).orderBy("__day")
    before = d.rowsBetween(Window.unboundedPreceding, -1)
    # every day has a row, so the last rows - 1 days hold what a sum can need
    tails = F.flatten(F.collect_list("__tail").over(d.rowsBetween(1 - rows, -1)))
    day = day.select(*keys, "__day", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), tails.alias("__tails"))
    y = x.join(day, [*keys, "__day"])
    values = F.concat("__tails", "__own")
    values = F.slice(values, F.greatest(F.lit(1), F.size(values) - (rows - 1)), F.lit(rows))
    # a window within the day that is already full has no need of the days before: its values come last
    some = F.filter(values, lambda v: v["v"].isNotNull())
    total = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("bigint"), lambda a, v: a + v["v"]))
    return y.select(id_col, (F.col("__before") + F.col("__n")).cast("int").alias("place"), total.alias("total"))


def size_metrics(pages: DataFrame, doc_col: str = "run_id") -> DataFrame:
    """Pages, megabytes before and after, and the unweighted mean of the page
    ratios (optimised / original), null where no page has both sizes."""
    ratio = F.try_divide(F.col("optimized_bytes").cast("double"), F.col("original_bytes"))
    return pages.groupBy(doc_col).agg(
        F.count("*").alias("page_count"),
        (F.sum("original_bytes") / MB).alias("original_mb"),
        (F.sum("optimized_bytes") / MB).alias("optimized_mb"),
        F.avg(ratio).alias("compression_ratio"),
    )


def pool_stats(tasks: DataFrame, pool_col: str, active: Column, pending: Column) -> DataFrame:
    """Tasks by state and the share of active ones in per cent."""
    t = tasks.select(F.col(pool_col).alias("pool"), active.alias("a"), pending.alias("p"))
    return t.groupBy("pool").agg(
        F.count("*").alias("total"),
        F.count_if("a").alias("active"),
        F.count_if("p").alias("pending"),
        F.count_if(~F.col("a") & ~F.col("p")).alias("available"),
        F.coalesce(F.try_divide(F.count_if("a") * F.lit(100.0), F.count("*")), F.lit(0.0)).alias("utilisation"),
    )


def step_report(steps: DataFrame, group_col: str, step_col: str, duration: Column, success: Column, slowest: int = 3) -> tuple[DataFrame, DataFrame]:
    """(totals by group and step with the step's share, the slowest steps of each group)."""
    s = steps.select(F.col(group_col), F.col(step_col), duration.alias("d"), success.alias("ok"))
    by = s.groupBy(group_col, step_col).agg(F.sum("d").alias("duration"), F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"))
    share = F.try_divide(F.col("duration") * 100, F.sum("duration").over(Window.partitionBy(group_col)))
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy(F.col("duration").desc_nulls_last(), step_col))
    return by.withColumn("percentage", share), by.withColumn("place", rank).where(F.col("place") <= slowest)


def model_cost(images: DataFrame, doc_col: str, model_col: str) -> DataFrame:
    """(doc, model, n_images, cost, error) against the table of model limits."""
    caps = images.sparkSession.createDataFrame(MODEL_CAPS, "name string, max_tokens int, cost_per_image double, max_images int, side int")
    n = images.groupBy(doc_col, model_col).agg(F.count("*").alias("n_images"))
    x = n.join(F.broadcast(caps), F.col(model_col) == F.col("name"), "left")  # five rows
    error = F.when(F.col("name").isNull(), "unknown model").when(F.col("n_images") > F.col("max_images"), "too many images")
    return x.select(doc_col, F.col(model_col).alias("model"), "n_images", F.when(error.isNull(), F.col("n_images") * F.col("cost_per_image")).alias("cost"), error.alias("error"))


def message_severity(messages: Column) -> Column:
    """struct(errors, warnings) of an array of (type, message)."""
    n = lambda kind: F.size(F.filter(messages, lambda m: m["type"] == kind))
    return F.struct(n("error").alias("errors"), n("warning").alias("warnings"))
