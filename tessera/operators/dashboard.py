"""Aggregates of a portfolio: score histograms, pass rates, breakdowns, heat maps, trends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def score(columns: Sequence[str], prefix: str = "") -> Column:
    """How many columns say yes, in any case; nulls count as no."""
    return reduce(lambda a, b: a + b, (F.when(F.lower(prefix + c) == "yes", 1).otherwise(0) for c in columns))


def histogram(scores: DataFrame, most: int) -> DataFrame:
    """score, n, mean, median, total: one row for each score from 0 to most, empty ones too.

    Scores are counted once; all else comes from the counts, of which there are as many as different scores.
    """
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    whole = counts.agg(
        F.round(F.coalesce(F.sum(F.col("score") * F.col("n")) / F.sum("n"), F.lit(0.0)), 2).alias("mean"),
        F.round(F.coalesce(F.percentile("score", F.lit(0.5), F.col("n")), F.lit(0.0)), 2).alias("median"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_list(F.struct(F.least("score", F.lit(most)).alias("score"), "n")).alias("_counts"))
    of = lambda i: F.aggregate(F.filter("_counts", lambda x: x["score"] == i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    bins = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("score"), of(i).alias("n")))
    return whole.select(F.inline(bins), "mean", "median", "total")


def own_scores(base: DataFrame, criteria: DataFrame, columns: Sequence[str], level: str) -> DataFrame:
    return base.where(F.col("level") == level).select("id").join(criteria.select("id", score(columns).alias("score")), "id")


def inherited_scores(base: DataFrame, criteria: DataFrame, parent: DataFrame, own: Sequence[str], above: Sequence[str]) -> DataFrame:
    """Scores of second-level rows: their own criteria and those of their parent (0 where it has none)."""
    up = parent.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("parent_id"))
    parents = criteria.select(F.col("id").alias("parent_id"), score(above).alias("_above"))
    rows = base.where(F.col("level") == "Level 2").select("id").join(criteria.select("id", score(own).alias("_own")), "id")
    return rows.join(up, "id", "left").join(parents, "parent_id", "left").select("id", (F.col("_own") + F.coalesce("_above", F.lit(0))).alias("score"))


def pass_rates(rows: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """criterion, level, passed, total, rate; groups: criteria by level."""
    sums = rows.agg(*(count_where((F.col("level") == level) & (F.lower(c) == "yes")).alias(c) for level, names in groups.items() for c in names), *(count_where(F.col("level") == level).alias(f"_n{i}") for i, level in enumerate(groups)))
    entries = [F.struct(F.lit(c).alias("criterion"), F.lit(level).alias("level"), F.col(c).alias("passed"), F.col(f"_n{i}").alias("total")) for i, (level, names) in enumerate(groups.items()) for c in names]
    each = sums.select(F.inline(F.array(*entries)))
    return each.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total"), 4)).otherwise(0.0))


def attribute_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """attribute, value, n; null and empty values are Unknown."""
    shown = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "Unknown").otherwise(F.col(c).cast("string"))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("attribute"), shown(c).alias("value")) for c in columns)))).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def top_by_count(edges: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The keys with most distinct ids; ties by key."""
    return edges.groupBy(key).agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def month(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def month_spine(df: DataFrame, as_of: str, months: int) -> DataFrame:
    """month: as_of's and the months before it, months + 1 in all."""
    first = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -months)
    return df.sparkSession.range(1).select(F.explode(F.sequence(first, F.trunc(F.lit(as_of).cast("date"), "month"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def lifecycle(rows: DataFrame, created: str, expired: str, as_of: str, months: int) -> DataFrame:
    """month, created, expired over a dense run of months."""
    start = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -months)
    both = rows.select(F.inline(F.array(F.struct(F.col(created).alias("at"), F.lit(1).alias("c"), F.lit(0).alias("e")), F.struct(F.col(expired).alias("at"), F.lit(0).alias("c"), F.lit(1).alias("e")))))
    counts = both.where(F.col("at") >= start).groupBy(month("at").alias("month")).agg(F.sum("c").alias("created"), F.sum("e").alias("expired"))
    return month_spine(rows, as_of, months).join(counts, "month", "left").select("month", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("expired", F.lit(0)).alias("expired"))


def normalised(column: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def concentration(rows: DataFrame, value: str, at: str, top: int) -> DataFrame:
    """month, label, n: the most frequent values by month, the rest as Others. A label is a value's most frequent spelling."""
    raw = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(month(at).alias("month"), F.col(value).alias("raw")).agg(F.count("*").alias("n")).withColumn("key", normalised("raw"))
    spelled = raw.groupBy("key", "raw").agg(F.sum("n").alias("n"))
    labels = spelled.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("d"), "raw"))["raw"].alias("label"))
    best = labels.orderBy(F.desc("total"), "key").limit(top)
    return raw.join(F.broadcast(best), "key", "left").groupBy("month", F.coalesce("label", F.lit("Others")).alias("label")).agg(F.sum("n").alias("n"))


def prior_matches(rows: DataFrame, pairs: DataFrame, at: str, high: float) -> DataFrame:
    """month, total, near, weak, near_pct: rows by month, and those whose best match with an earlier row is near or weak."""
    a, b = rows.select("id", F.col(at).alias("at")), rows.select(F.col("id").alias("similar_id"), F.col(at).alias("before"))
    best = pairs.join(a, "id").join(b, "similar_id").where(F.col("before") < F.col("at")).groupBy("id").agg(F.max("score").alias("best"))
    marked = a.join(best, "id", "left")
    out = marked.groupBy(month("at").alias("month")).agg(F.count("*").alias("total"), count_where(F.col("best") >= high).alias("near"), count_where(F.col("best") < high).alias("weak"))
    return out.withColumn("near_pct", F.round(100.0 * F.col("near") / F.col("total"), 1))


def snapshot(base: DataFrame, histograms: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """One row: the portfolio's counts, and for each histogram its mean, median and a map of counts."""
    out = counts
    for name, bins in histograms.items():
        part = bins.agg(F.first("mean").alias(f"{name}_mean"), F.first("median").alias(f"{name}_median"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("score", "n")))).alias(f"{name}_bins"))
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def inventory(rows: DataFrame, at: str, since: Column, done: Column) -> DataFrame:
    """One row: all rows, those since a time, and the latest time of those that are done."""
    return rows.agg(F.count("*").alias("total"), count_where(F.col(at) >= since).alias("today"), F.max(F.when(done, F.col(at))).alias("last_success"))


def catalogue(tables: dict[str, DataFrame], kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """name, category, domain, n of each table; kinds: category and domain by the part of a name before its first underscore, else other."""
    each = []
    for name, df in tables.items():
        category, domain = kinds.get(name, kinds.get(name.split("_")[0], ("other", "other")))
        each.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(domain).alias("domain"), "n"))
    return reduce(DataFrame.unionAll, each)


def packed(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """One row: a small table's values by label, as a map in order of labels."""
    entry = F.struct(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def whole_snapshot(parts: Sequence[DataFrame]) -> DataFrame:
    """One row of tables of one row each."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out


def trend(points: DataFrame, at: str, limit: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The newest points of a range (its ends included), oldest first, with the number of all in it."""
    if start is not None:
        points = points.where(F.col(at) >= start)
    if end is not None:
        points = points.where(F.col(at) <= end)
    total = points.agg(F.count("*").alias("total"))
    return points.orderBy(F.desc(at)).limit(limit).crossJoin(F.broadcast(total)).orderBy(at)


def shares(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))
