"""Distributions and volumes over the message table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def language_distribution(messages: DataFrame, language: str = "language") -> DataFrame:
    """Messages per language, nulls left out."""
    counted = messages.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("language"))
    return counted.agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), "language")


def top_senders(messages: DataFrame, limit: int = 20, sender: str = "actor") -> DataFrame:
    """The senders with most messages; equal counts are ordered by name."""
    counted = messages.where(F.col(sender).isNotNull()).groupBy(F.col(sender).alias("sender"))
    return (
        counted.agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), "sender").limit(limit)
    )


def fill_gaps(counts: DataFrame, by: Sequence[str], day: str, count: str, step: int) -> DataFrame:
    """Insert a zero row for every missing step between a group's first and last day.

    Each row stretches to the day before the next one, so no calendar has to be
    joined. The input has one row per day, which the calendar bounds.
    """
    following = F.lead(day).over(Window.partitionBy(*by).orderBy(day))
    stretched = counts.withColumn("_until", F.coalesce(F.date_sub(following, step), F.col(day)))
    days = F.sequence(F.col(day), F.col("_until"), F.make_interval(days=F.lit(step)))
    return stretched.select(*by, F.col(count).alias("_n"), F.posexplode(days).alias("_pos", day)).select(
        *by, F.col(day), F.when(F.col("_pos") == 0, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias(count)
    )


def daily_volume(messages: DataFrame, timestamp: str = "timestamp", text: str = "raw_text") -> DataFrame:
    """Messages with a text per day from the first to the last day, empty days as zero."""
    dated = messages.where(F.col(timestamp).isNotNull())
    counts = dated.groupBy(F.col(timestamp).cast("date").alias("day")).agg(F.count(text).alias("messages"))
    return fill_gaps(counts, [], "day", "messages", 1).orderBy("day")


def weekly_volume(
    messages: DataFrame,
    languages: Sequence[str] = ("ru", "en", "unknown"),
    timestamp: str = "timestamp",
    language: str = "language",
    text: str = "raw_text",
) -> DataFrame:
    """Messages per language and week, named by the Sunday that ends it.

    Empty weeks count zero within the range of each language.
    """
    chosen = messages.where(F.col(language).isin(*languages) & F.col(timestamp).isNotNull())
    sunday = F.date_add(F.date_trunc("week", F.col(timestamp)).cast("date"), 6)
    counts = chosen.groupBy(F.col(language).alias("language"), sunday.alias("week")).agg(
        F.count(text).alias("messages")
    )
    return fill_gaps(counts, ["language"], "week", "messages", 7).orderBy("language", "week")


def length_histogram(lengths: DataFrame, length: str = "body_len", bins: int = 60, clip: int = 1000) -> DataFrame:
    """Equal-width bins between the smallest and the largest clipped length.

    The last bin includes its upper end; empty bins are listed. Counting equal
    lengths first leaves at most ``clip + 1`` rows for everything after it.
    """
    clipped = F.least(F.col(length), F.lit(clip))
    counts = lengths.where(F.col(length).isNotNull()).groupBy(clipped.alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(
        F.min("_len").alias("low"),
        F.max("_len").alias("high"),
        F.collect_list(F.struct("_len", "_n")).alias("cells"),
    ).where("low IS NOT NULL")
    # A single value gets a range of one around it, as plotting tools do.
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low").cast("double"))
    high = F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high").cast("double"))
    ranged = whole.select(low.alias("low"), high.alias("high"), "cells")
    width = (F.col("high") - F.col("low")) / bins
    cells = F.transform(
        F.col("cells"),
        lambda cell: F.struct(
            F.least(F.floor((cell["_len"] - F.col("low")) * bins / (F.col("high") - F.col("low"))) + 1, F.lit(bins))
            .cast("int")
            .alias("bin"),
            cell["_n"].alias("n"),
        ),
    )
    spread = ranged.select("low", width.alias("width"), cells.alias("cells")).select(
        "low", "width", "cells", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    in_bin = F.filter("cells", lambda cell: cell["bin"] == F.col("bin"))
    return spread.select(
        "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_end"),
        F.aggregate(in_bin, F.lit(0).cast("bigint"), lambda total, cell: total + cell["n"]).alias("messages"),
    ).orderBy("bin")


_SKETCH_ACCURACY = 10_000
_MARGIN = 3 / _SKETCH_ACCURACY
_CELLS = 4096


def exact_quantiles(rows: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row with the exact, linearly interpolated quantiles, one column ``q<i>`` each.

    No task orders more than a sliver of the data. A sketch brackets every
    quantile; its error bound puts the true value inside the bracket. A second
    pass counts equal values inside the brackets and lumps everything between
    two brackets into one count. Each bracket is cut into cells; running totals
    over the cells tell which few hold the wanted ranks, and only the distinct
    values of those are put in order. The sketch is taken when this is called:
    its few numbers become constants of the plan.
    """
    edges = [(max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0)) for p in probabilities]
    if any(later[0] <= earlier[1] for earlier, later in zip(edges, edges[1:])):
        raise ValueError("probabilities have to be ascending and further apart than the sketch's error")
    present = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    sketch = F.percentile_approx("_v", [edge for pair in edges for edge in pair], _SKETCH_ACCURACY)
    known = present.agg(sketch.alias("edges"), F.count(F.lit(1)).alias("n")).first()
    total = known["n"]
    if total == 0:
        return present.limit(0).agg(*[F.max("_v").cast("double").alias(f"q{i}") for i in range(len(edges))])
    limits = [F.lit(edge) for edge in known["edges"]]

    counts = (
        present.select(_cell_of(F.col("_v"), limits).alias("_c"))
        .groupBy(F.col("_c.part").alias("_part"), F.col("_c.cell").alias("_cell"), F.col("_c.at").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cells = counts.groupBy("_part", "_cell").agg(F.sum("_n").alias("_cell_n"), F.max("_at").alias("_top"))
    upto = F.sum("_cell_n").over(Window.orderBy("_part", "_cell"))
    cells = cells.withColumn("_before", upto - F.col("_cell_n"))
    places = [(total - 1) * p for p in probabilities]
    wanted = F.lit(False)
    for index in {end(place) for place in places for end in (math.floor, math.ceil)}:
        wanted = wanted | ((F.col("_before") <= index) & (F.lit(index) < F.col("_before") + F.col("_cell_n")))
    # At most two cells per quantile.
    chosen = F.broadcast(cells.where(wanted).select("_part", "_cell", "_before"))
    order = Window.partitionBy("_part", "_cell").orderBy("_at")
    running = counts.join(chosen, ["_part", "_cell"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(order)
    )

    def value_at(index: int) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col("_at"))).cast("double")

    columns = []
    for i, place in enumerate(places):
        low, high = value_at(math.floor(place)), value_at(math.ceil(place))
        columns.append((low + (high - low) * (place - math.floor(place))).alias(f"q{i}"))
    return running.agg(*columns)


def _cell_of(value: Column, edges: Sequence[Column]) -> Column:
    """``(part, cell, at)``, never decreasing in the value.

    Inside bracket ``i`` the part is ``i`` and ``at`` the value; behind it, the
    part is ``i`` too, in a last cell without a value.
    """

    def inside(i: int) -> Column:
        low, high = edges[2 * i].cast("double"), edges[2 * i + 1].cast("double")
        share = F.when(high > low, (value.cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(i).alias("part"), F.floor(share * _CELLS).cast("int").alias("cell"), value.alias("at")
        )

    def behind(i: int) -> Column:
        nothing = F.when(F.lit(False), value)
        return F.struct(F.lit(i).alias("part"), F.lit(_CELLS + 1).alias("cell"), nothing.alias("at"))

    brackets = len(edges) // 2
    cell = behind(brackets - 1)
    for i in reversed(range(brackets)):
        in_bracket = F.when(value >= edges[2 * i], inside(i)).otherwise(behind(i - 1))
        cell = F.when(value <= edges[2 * i + 1], in_bracket).otherwise(cell)
    return cell


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of a numeric column."""
    quartiles = exact_quantiles(rows, column, (0.25, 0.5, 0.75))
    quartiles = quartiles.select(F.struct("q0", "q1", "q2").alias("q")).scalar()
    value = F.col(column)
    basics = rows.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ).withColumn("q", quartiles)
    return basics.select(
        "count",
        "mean",
        "std",
        "min",
        F.col("q.q0").alias("q25"),
        F.col("q.q1").alias("q50"),
        F.col("q.q2").alias("q75"),
        "max",
    )


def presence(messages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: how many values are present and whether there is any."""
    counted = messages.agg(*[F.count(name).alias(name) for name in columns])
    named = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("present")) for name in columns])
    return counted.select(F.inline(named)).select("column", "present", (F.col("present") > 0).alias("any_present"))


def by_time(messages: DataFrame, timestamp: str = "timestamp", tie: str = "message_id") -> DataFrame:
    """Oldest first, undated last."""
    return messages.orderBy(F.col(timestamp).asc_nulls_last(), tie)


def head(messages: DataFrame, limit: int, timestamp: str = "timestamp", tie: str = "message_id") -> DataFrame:
    """The first ``limit`` messages by time; each task keeps only that many."""
    return by_time(messages, timestamp, tie).limit(limit)
