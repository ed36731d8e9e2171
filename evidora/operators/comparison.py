"""Comparison of runs: paired flips, table deltas with gates, replicates, metric diffs, regression checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(baseline: DataFrame, treatment: DataFrame, keys: list[str], value: str = "answer_correct", keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, keep (of the baseline), base, treat, flip: rows that both runs have."""
    b = baseline.select(*keys, *keep, F.col(value).alias("base"))
    joined = b.join(treatment.select(*keys, F.col(value).alias("treat")), keys)
    up, was = F.coalesce("treat", F.lit(0.0)) >= 1, F.coalesce("base", F.lit(0.0)) >= 1
    return joined.withColumn("flip", F.when(up & ~was, "recovery").when(~up & was, "regression").otherwise("unchanged"))


def flip_summary(pairs: DataFrame, domain: str = "domain") -> DataFrame:
    """One row a domain and one for all: pairs, both accuracies, recoveries, regressions and their net share."""
    n = F.count(F.lit(1))
    out = pairs.groupingSets([[domain], []], domain).agg(
        F.grouping(domain).alias("_all"), n.alias("n"),
        F.avg(F.coalesce("base", F.lit(0.0))).alias("base_accuracy"), F.avg(F.coalesce("treat", F.lit(0.0))).alias("treat_accuracy"),
        F.count_if(F.col("flip") == "recovery").alias("recoveries"), F.count_if(F.col("flip") == "regression").alias("regressions"),
    )
    net = (F.col("recoveries") - F.col("regressions")) / F.col("n")
    return out.select(F.when(F.col("_all") == 1, "_overall").otherwise(F.col(domain)).alias("domain"), "n", "base_accuracy", "treat_accuracy", "recoveries", "regressions", net.alias("net"))


def only_counts(baseline: DataFrame, treatment: DataFrame, keys: list[str]) -> DataFrame:
    """baseline_only, treatment_only and paired_n from one full join of keys."""
    a, b = baseline.select(*keys, F.lit(1).alias("_a")), treatment.select(*keys, F.lit(1).alias("_b"))
    return a.join(b, keys, "full").agg(F.count_if(F.col("_b").isNull()).alias("baseline_only"), F.count_if(F.col("_a").isNull()).alias("treatment_only"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("paired_n"))


def delta_last_wins(a: DataFrame, b: DataFrame, order: list[str], key: str = "example_id", domain: str = "domain", value: str = "answer_correct") -> DataFrame:
    """domain, n, accuracies and flips of two runs collapsed by id, where the last row of an id in order counts."""
    last = lambda df, v: df.groupBy(key).agg(F.max_by(F.struct(domain, value), F.struct(*order)).alias(v))
    j = last(a, "a").join(last(b, "b"), key)
    ok = lambda s: F.coalesce(F.col(f"{s}.{value}"), F.lit(0.0)) >= 0.999
    return j.groupBy(F.col(f"a.{domain}").alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok("a")).alias("a_correct"), F.count_if(ok("b")).alias("b_correct"),
        F.count_if(~ok("a") & ok("b")).alias("gained"), F.count_if(ok("a") & ~ok("b")).alias("lost"),
    )


def intervals_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Closed intervals; a missing one overlaps everything."""
    missing = a_lo.isNull() | a_hi.isNull() | b_lo.isNull() | b_hi.isNull()
    return missing | ~((a_hi < b_lo) | (b_hi < a_lo))


def gate(delta: Column, overlap: Column, metric: Column, threshold: float = 0.03) -> Column:
    """ship, sig+, hold, noise- or regress; lower cost is better. '-' without a delta."""
    signed = F.when(metric == "usd_per_correct", -delta).otherwise(delta)
    return (
        F.when(delta.isNull(), "-")
        .when((signed >= threshold) & ~overlap, "ship")
        .when((signed >= 0) & ~overlap, "sig+")
        .when(signed >= 0, "hold")
        .when(signed > -threshold, "noise-")
        .otherwise("regress")
    )


def table_delta(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("label", "domain", "metric")) -> DataFrame:
    """Two long tables (keys, value, lo, hi) by cell: values, delta, overlap of intervals and gate."""
    named = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("value", "lo", "hi")])
    j = named(a, "a").join(named(b, "b"), list(keys), "full")
    j = j.withColumn("delta", F.col("value_b") - F.col("value_a")).withColumn("overlap", intervals_overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")))
    return j.withColumn("gate", gate(F.col("delta"), F.col("overlap"), F.col("metric")))


def replicate_summary(replicates: DataFrame, keys: tuple[str, ...] = ("label", "domain", "metric")) -> DataFrame:
    """Mean over replicates and the union of their intervals, null if any lacks one."""
    whole = F.count("lo") == F.count(F.lit(1))
    return replicates.groupBy(*keys).agg(F.avg("value").alias("value"), F.when(whole, F.min("lo")).alias("lo"), F.when(whole, F.max("hi")).alias("hi"), F.count("value").alias("n_values"))


def metric_diff(a: DataFrame, b: DataFrame, path: str = "metric_path") -> DataFrame:
    """Full outer diff of (path, value) tables without paths that are null in both; section is the path's first part."""
    j = a.select(path, F.col("value").alias("a")).join(b.select(path, F.col("value").alias("b")), path, "full").where("a is not null or b is not null")
    return j.withColumn("delta", F.col("b") - F.col("a")).withColumn("section", F.substring_index(path, ".", 1))


def regression_gate(current: DataFrame, pinned: DataFrame, keys: tuple[str, ...] = ("label", "domain"), tolerance_points: float = 2.0) -> DataFrame:
    """Pinned cells whose accuracy moved by more than the tolerance; cells that are missing now are skipped."""
    j = pinned.select(*keys, F.col("value").alias("pinned")).join(current.select(*keys, F.col("value").alias("current")), list(keys))
    return j.withColumn("points", (F.col("current") - F.col("pinned")) * 100).where(F.abs("points") > tolerance_points)


def merge_cells(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Upsert: cells of new replace those of old with equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def pivot_matrix(cells: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    """One row of each `rows`, a column for each given name; names are given so that no pass over the data looks for them."""
    return cells.groupBy(rows).pivot(columns, names).agg(F.first(value))


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def pad_domains(df: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """Every label with every domain of the short list; missing cells have null values."""
    grid = labels.select("label").distinct().withColumn("domain", F.explode(F.array(*[F.lit(d) for d in domains])))
    return grid.join(df, ["label", "domain"], "left")


def backfill(table: DataFrame, measured: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value where the table lacks it: the mean over the measured rows."""
    mean = measured.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return table.join(mean, keys, "left").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def headline(specs: DataFrame, summaries: DataFrame, key: str = "label") -> DataFrame:
    """Summaries by spec; specs without one are kept and marked missing."""
    return specs.join(summaries.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def failure_buckets(correct: DataFrame, names: list[str], key: str = "example_id", spec: str = "spec", value: str = "answer_correct") -> DataFrame:
    """key, bucket: all_correct, all_wrong, only_<first> wrong or mixed, over the specs in names."""
    wide = correct.groupBy(key).pivot(spec, names).agg(F.max(value))
    ok = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) >= 1 for n in names]
    every, some = reduce(lambda a, b: a & b, ok), reduce(lambda a, b: a | b, ok)
    bucket = F.when(every, "all_correct").when(~some, "all_wrong").when(~ok[0], "recovered_later").otherwise("lost_later")
    return wide.select(key, bucket.alias("bucket"))


def seeded_pick(df: DataFrame, by: str, key: str, seed: int, n: int = 1) -> DataFrame:
    """n keys of each group, by hash order."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose id is listed, repeats kept."""
    return df.join(ids.select(key).distinct(), key, "left_semi").select(*df.columns)
