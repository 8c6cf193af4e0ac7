"""Counters, histograms, rates, percentiles and health, from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histograms in seconds.
BOUNDS = {
    "http": (0.01, 0.05, 0.1, 0.5, 1.0, 5.0),
    "search": (0.01, 0.05, 0.1, 0.5, 1.0),
    "insert": (0.001, 0.005, 0.01, 0.05, 0.1),
    "pdf": (0.1, 0.5, 1.0, 5.0, 10.0),
    "queue": (0.1, 0.5, 1.0, 5.0, 10.0),
}


def label(c: Column, known: tuple[str, ...], other: str) -> Column:
    """Labels that aren't known fold into one."""
    return F.when(c.isin(*known), c).otherwise(F.lit(other))


def counters(events: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else []))


def histogram(events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(labels, le, n): cumulative counts per bound and infinity. All bounds are counted in one aggregation."""
    edges = [*bounds, float("inf")]
    counted = events.where(F.col(value).isNotNull()).groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(edges)))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(edges))))
    return counted.select(*labels, rows.alias("x")).select(*labels, "x.le", "x.n")


def histogram_sums(events: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, n, total): what a histogram counts and sums beside its bounds."""
    return events.where(F.col(value).isNotNull()).groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def histogram_quantile(counted: DataFrame, labels: list[str], shares: dict[str, float]) -> DataFrame:
    """(labels, a column for each share) of cumulative counts (labels, le, n), which may be rates as well: a straight line
    within the bucket that holds the share, from 0 in the first. The largest finite bound if that is the last one; null
    where nothing was counted or the largest bound isn't infinity."""
    by = counted.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("_b"))
    b, count = F.col("_b"), F.get("_b", F.size("_b") - 1)["n"]
    whole = (count > 0) & (F.get(b, F.size(b) - 1)["le"] == F.lit(float("inf"))) & (F.size(b) > 1)

    def at(share: float) -> Column:
        rank = count * share
        # Counts grow with bounds, so the buckets below are those that don't reach the rank.
        i = F.size(F.filter(b, lambda x: x["n"] < rank))
        low, under = (F.when(i > 0, F.get(b, i - 1)[c]).otherwise(0) for c in ("le", "n"))
        inside = low + (F.get(b, i)["le"] - low) * F.coalesce(F.try_divide(rank - under, F.get(b, i)["n"] - under), F.lit(0.0))
        first = F.when((i == 0) & (F.get(b, i)["le"] <= 0), F.get(b, i)["le"]).otherwise(inside)
        return F.when(whole, F.when(i == F.size(b) - 1, F.get(b, i - 1)["le"]).otherwise(first))

    return by.select(*labels, *(at(share).alias(name) for name, share in shares.items()))


def alerts(series: DataFrame, labels: list[str], failing: Column, step: int, hold: int, at: str = "at") -> DataFrame:
    """(labels, pending_at, firing_at, ended_at, steps): runs of evaluations, `step` seconds apart, at which the condition
    holds. A run fires once it has held for `hold` seconds; firing_at is null for one that ended before. A step at which the
    condition doesn't hold, or that is missing, ends a run. One row of a label and time counts; its group holds one row a step."""
    seconds = F.unix_micros(at) / 1_000_000
    bad = series.where(F.coalesce(failing, F.lit(False))).select(*labels, F.floor(seconds / step).alias("_step")).distinct()
    island = F.col("_step") - F.row_number().over(Window.partitionBy(*labels).orderBy("_step"))
    runs = bad.withColumn("_island", island).groupBy(*labels, "_island").agg(F.min("_step").alias("_from"), F.max("_step").alias("_to"), F.count("*").alias("steps"))
    needed = -(-hold // step)
    when = lambda n: F.timestamp_seconds(n * step)
    fired = F.when(F.col("_to") >= F.col("_from") + needed, when(F.col("_from") + needed))
    return runs.select(*labels, when(F.col("_from")).alias("pending_at"), fired.alias("firing_at"), when(F.col("_to") + 1).alias("ended_at"), "steps")


def gauges(events: DataFrame, labels: list[str], value: str, ts: str) -> DataFrame:
    """The last value of each label; of equal times the largest."""
    return events.groupBy(*labels).agg(F.max(F.struct(ts, value))[value].alias("value"))


def sliding_rate(events: DataFrame, failed: Column, minutes: int = 5, step: int = 1, ts: str = "ts") -> DataFrame:
    """(start, n, errors, per_second, error_ratio) of overlapping windows."""
    by = events.groupBy(F.window(ts, f"{minutes} minutes", f"{step} minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
    return by.select(F.col("w.start").alias("start"), "n", "errors", (F.col("n") / (minutes * 60)).alias("per_second"), (F.col("errors") / F.col("n")).alias("error_ratio"))


def nearest_rank(events: DataFrame, labels: list[str], value: str, shares: dict[str, float], cuts: int = 256) -> DataFrame:
    """Percentiles as the value at place int(n * share) of the sorted values, from 0, without gathering a group.

    Distinct values are counted first. Approximate quantiles part each label's values into some `cuts` ranges; only the
    ranges that hold a place are sorted, each by itself, so no task sees a label whole.
    """
    key = F.struct(*labels)
    counted = events.where(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("_n")).select(key.alias("_key"), F.col(value).alias("_v"), "_n")
    parts = [i / cuts for i in range(1, cuts)]
    of = counted.groupBy("_key").agg(F.percentile_approx("_v", parts, 10 * cuts).alias("_cuts"), F.sum("_n").alias("n"))
    # Struct keys compare with nulls in them, so labels that are null are kept.
    placed = counted.join(of, "_key").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = placed.groupBy("_key", "n", "_part").agg(F.sum("_n").alias("_s"))
    # At most as many rows of a label as there are ranges.
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * share), F.col("n") - 1).alias("place")) for name, share in shares.items()))
    held = sums.withColumn("_before", before).withColumn("_places", F.filter(places, lambda p: (p["place"] >= F.col("_before")) & (p["place"] < F.col("_before") + F.col("_s"))))
    wanted = held.where(F.size("_places") > 0).select("_key", "_part", "_before", "_places")
    inside = placed.join(wanted, ["_key", "_part"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    # The first value whose running count passes the place.
    found = inside.withColumn("_upto", upto).select("_key", "n", "_v", "_upto", F.explode("_places").alias("_p"))
    picks = [F.min(F.when((F.col("_p.name") == name) & (F.col("_upto") > F.col("_p.place")), F.col("_v"))).alias(name) for name in shares]
    out = found.groupBy("_key").agg(F.max("n").alias("n"), *picks)
    return out.select(*(F.col("_key")[c].alias(c) for c in labels), "n", *shares)


def responses(events: DataFrame, status: Column) -> DataFrame:
    """Adds error: client_error from 400, server_error from 500, null below."""
    return events.withColumn("error", F.when(status >= 500, "server_error").when(status >= 400, "client_error"))


def health(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, status): healthy if all are, unhealthy if any is, else degraded."""
    s = F.col("status")
    return components.groupBy(*by).agg(F.when(F.bool_and(s == "healthy"), "healthy").when(F.bool_or(s == "unhealthy"), "unhealthy").otherwise("degraded").alias("status"))


def _escaped(c: Column, quotes: bool = True) -> Column:
    out = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"')) if quotes else out


def _sample(name: str, labels: dict[str, Column], value: Column) -> Column:
    """name{label="value",...} value; a null label is left out."""
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), _escaped(c), F.lit('"')) for k, c in labels.items()))
    return F.concat(F.lit(name + "{"), inner, F.lit("} "), value.cast("string"))


def exposition(counted: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One line of text per row, in the Prometheus format."""
    return counted.select(_sample(name, {c: F.col(c) for c in labels}, F.col(value)).alias("line"))


def histogram_lines(counted: DataFrame, sums: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """The lines of a histogram: _bucket from counted(labels, le, n), _sum and _count from sums(labels, n, total)."""
    own = {c: F.col(c) for c in labels}
    bound = F.when(F.col("le") == F.lit(float("inf")), "+Inf").otherwise(F.col("le").cast("string"))
    lines = counted.select(_sample(f"{name}_bucket", own | {"le": bound}, F.col("n")).alias("line"))
    for part, value in (("sum", "total"), ("count", "n")):
        lines = lines.unionByName(sums.select(_sample(f"{name}_{part}", own, F.col(value)).alias("line")))
    return lines


def family(lines: DataFrame, name: str, kind: str, help_: str) -> DataFrame:
    """(place, line): the lines of a metric below its HELP and TYPE, by place."""
    if kind not in ("counter", "gauge", "histogram", "summary", "untyped"):
        raise ValueError(f"unknown kind of metric: {kind}")
    about = help_.replace("\\", "\\\\").replace("\n", "\\n")
    head = lines.sparkSession.createDataFrame([(0, f"# HELP {name} {about}"), (1, f"# TYPE {name} {kind}")], "place int, line string")
    return head.unionByName(lines.select(F.lit(2).alias("place"), "line"))
