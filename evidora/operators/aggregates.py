"""Aggregation of scored records: by domain with the union, resampled intervals, stage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEANS = ("page_recall", "bbox_iou", "evidence_reward", "is_lazy", "tool_calls", "tokens_in", "tokens_out", "latency_ms")
OVERALL = "_overall"


def zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def metrics(df: DataFrame) -> list[Column]:
    """n, accuracy, means (nulls count as 0), usd_total and usd_per_correct (null without a correct answer)."""
    correct = F.count_if(F.col("answer_correct") != 0)
    out = [F.count(F.lit(1)).alias("n"), F.avg(zero("answer_correct")).alias("accuracy")]
    out += [F.avg(zero(c)).alias(f"{c}_mean") for c in MEANS if c in df.columns]
    return [*out, F.sum(zero("usd")).alias("usd_total"), F.try_divide(F.sum(zero("usd")), correct).alias("usd_per_correct")]


def aggregate_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*metrics(df))


def aggregate_by_domain(df: DataFrame, domain: str = "domain") -> DataFrame:
    """One row a domain and one for all, from one partial aggregation (grouping sets)."""
    d = df.withColumn("_domain", F.coalesce(F.col(domain), F.lit("?")))
    out = d.groupingSets([["_domain"], []], "_domain").agg(F.grouping("_domain").alias("_all"), *metrics(df))
    return out.select(F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("_domain")).alias("domain"), *[c for c in out.columns if c not in ("_domain", "_all")])


def mean_skipping_nulls(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def _resample(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], resamples: int, seed: int) -> DataFrame:
    """by, b, n and the sums of each value over a resample of n draws with replacement.

    The rows of a group are numbered; draw i of resample b is row md5(seed:b:i) mod n. Draws are joined to rows by number, so a
    group's rows, not its draws, are what is shuffled with values.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, (F.row_number().over(w) - 1).cast("long").alias("_i"), *[F.col(e).cast("double").alias(n) for n, e in values.items()])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("b"), F.col("_d")))
    draws = draws.withColumn("_i", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n"))
    return draws.join(rows, [*by, "_i"]).groupBy(*by, "b").agg(F.first("n").alias("n"), *[F.sum(v).alias(v) for v in values])


def _order_statistics(df: DataFrame, by: list[str], value: str, confidence: float) -> DataFrame:
    """lo and hi: the sorted values at int(alpha * count) and int((1 - alpha) * count), within bounds."""
    w = Window.partitionBy(*by)
    alpha = (1 - confidence) / 2
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    lo = F.floor(F.lit(alpha) * F.col("_m"))
    hi = F.least(F.col("_m") - 1, F.floor(F.lit(1 - alpha) * F.col("_m")))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == lo, F.col(value))).alias("lo"), F.max(F.when(F.col("_r") == hi, F.col(value))).alias("hi"))


def bootstrap_mean(df: DataFrame, by: list[str], order: list[str], value: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """by, lo, hi of the resampled mean; 0 and 0 for groups of one row."""
    means = _resample(df, by, order, {"v": value}, resamples, seed).withColumn("m", F.col("v") / F.col("n"))
    ci = _order_statistics(means, by, "m", confidence).join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return ci.select(*by, *[F.when(F.col("n") < 2, 0.0).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")])


def bootstrap_ratio(df: DataFrame, by: list[str], order: list[str], top: str, bottom: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """by, lo, hi of sum(top) / sum(bottom) over paired resamples; resamples without any bottom are left out."""
    sums = _resample(df, by, order, {"t": top, "u": bottom}, resamples, seed).where("u > 0 and n >= 2").withColumn("r", F.col("t") / F.col("u"))
    return _order_statistics(sums, by, "r", confidence)


def _block_resample(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], resamples: int, seed: int, block_rows: int) -> DataFrame:
    """by, b, n and the sums of each value over a resample of n draws with replacement, for groups of any size.

    Rows are dealt by hash into blocks of about block_rows. A resample first draws how many of its n draws fall on each block
    (multinomial by the blocks' sizes) and then, in each block, the rows: together the same as n draws from the whole group. One
    task holds a block's rows, or one number a block and resample of a group.
    """
    import numpy as np
    import pandas as pd

    types = dict(df.dtypes)
    keys, names = ", ".join(f"{c} {types[c]}" for c in by), list(values)
    rows = df.select(*by, F.xxhash64(*order).alias("_h"), *order, *[zero(e).alias(f"_{n}") for n, e in values.items()])
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(totals, by).withColumn("_block", F.pmod("_h", F.ceil(F.col("n") / F.lit(block_rows)))).drop("n", "_h")
    sizes = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_size"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        size = pdf["_size"].to_numpy()
        counts = np.random.default_rng(seed).multinomial(size.sum(), size / size.sum(), size=resamples)
        return pdf[[*by, "_block"]].assign(_draws=list(counts.T.astype(np.int64)))

    def draw(mine: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values([*order, *[f"_{n}" for n in names]])
        v = mine[[f"_{n}" for n in names]].to_numpy()
        rng = np.random.default_rng([seed, 1, int(mine["_block"].iloc[0])])
        sums = np.stack([np.bincount(rng.integers(0, len(v), k), minlength=len(v)) @ v for k in dealt["_draws"].iloc[0]])
        return pd.DataFrame({**{c: [mine[c].iloc[0]] * resamples for c in by}, "b": range(resamples), **dict(zip(names, sums.T))})[[*by, "b", *names]]

    dealt = sizes.groupBy(*by).applyInPandas(deal, f"{keys}, _block long, _draws array<long>")
    parts = rows.groupBy(*by, "_block").cogroup(dealt.groupBy(*by, "_block")).applyInPandas(draw, f"{keys}, b int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy(*by, "b").agg(*[F.sum(n).alias(n) for n in names]).join(totals, by)


def bootstrap_mean_large(df: DataFrame, by: list[str], order: list[str], value: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """bootstrap_mean for groups of any size, by blocks; groups by null keys are left out."""
    sums = _block_resample(df, by, order, {"v": value}, resamples, seed, block_rows).withColumn("m", F.when(F.col("n") < 2, 0.0).otherwise(F.col("v") / F.col("n")))
    return _order_statistics(sums, by, "m", confidence)


def bootstrap_ratio_large(df: DataFrame, by: list[str], order: list[str], top: str, bottom: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """bootstrap_ratio for groups of any size, by blocks; groups by null keys are left out."""
    sums = _block_resample(df, by, order, {"t": top, "u": bottom}, resamples, seed, block_rows).where("u > 0 and n >= 2").withColumn("r", F.col("t") / F.col("u"))
    return _order_statistics(sums, by, "r", confidence)


# ---- stage metrics over steps (trace, stage, latency, tool, tokens...)


def stage_efficiency(steps: DataFrame, trace: str = "trace", stage: str = "stage") -> DataFrame:
    """trace, stage: summed latency and number of tool steps."""
    return steps.where(F.coalesce(stage, F.lit("")) != "").groupBy(trace, stage).agg(F.sum(F.coalesce("latency", F.lit(0.0))).alias("latency"), F.count_if(F.col("tool").isNotNull()).alias("tool_calls"))


def stage_efficiency_means(per_trace: DataFrame, stage: str = "stage") -> DataFrame:
    """Means over the traces that have the stage, cut towards zero."""
    return per_trace.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg("latency").cast("long").alias("latency"), F.avg("tool_calls").cast("long").alias("tool_calls"))


def stage_aggregates(df: DataFrame, floats: list[str], booleans: list[str]) -> DataFrame:
    """Means that skip nulls for floats, rates for booleans."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in floats], *[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(f"{c}_rate") for c in booleans])


def shares(df: DataFrame, value: str) -> DataFrame:
    """value, n and its share of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over distinct values, not rows
    return counts.withColumn("share", F.col("n") / total)


def first_and_last(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The first and the last value of each group in order; minimum and maximum by struct combine before the shuffle."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))


def top_sequences(df: DataFrame, by: list[str], order: list[str], value: str, k: int = 5) -> DataFrame:
    """The k most frequent sequences of value within groups: ties to the sequence seen first by its group key."""
    seqs = df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), ">").alias("sequence"))
    return seqs.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*by)).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def price(df: DataFrame, prices: DataFrame, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """df with usd: tokens times the price per million of their model, by keys in lower case; null where no price is known.

    prices: keys, price_in, price_out; a short list, one row a model.
    """
    known = prices.select(*[F.lower(k).alias(f"_{k}") for k in keys], "price_in", "price_out").dropDuplicates([f"_{k}" for k in keys])
    j = df.join(known, [F.lower(df[k]) == F.col(f"_{k}") for k in keys], "left")
    usd = (F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) / 1e6
    return j.withColumn("usd", usd).drop("price_in", "price_out", *[f"_{k}" for k in keys])
