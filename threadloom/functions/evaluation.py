"""Retrieval measures and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dcg(grades: Column) -> Column:
    """Discounted gain of an array of grades in rank order."""
    terms = F.transform(grades, lambda g, i: g / F.log2(i + F.lit(2.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def ndcg(grades: Column, k: int) -> Column:
    """F31. Against the best order of the same grades; 0 where none is positive."""
    best = dcg(F.slice(F.sort_array(grades, asc=False), 1, k))
    return F.when(best > 0, dcg(F.slice(grades, 1, k)) / best).otherwise(0.0)


def precision(grades: Column, k: int, rel: int) -> Column:
    """F31. Always over k."""
    return F.size(F.filter(F.slice(grades, 1, k), lambda g: g >= rel)) / F.lit(float(k))


def recall(grades: Column, k: int, rel: int, relevant: Column) -> Column:
    return F.when(relevant > 0, F.size(F.filter(F.slice(grades, 1, k), lambda g: g >= rel)) / relevant).otherwise(0.0)


def reciprocal_rank(grades: Column, rel: int) -> Column:
    hit = F.array_position(F.transform(grades, lambda g: (g >= rel).cast("int")), 1)
    return F.when(hit > 0, 1.0 / hit).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """F33. Struct low, high."""
    p, zz = hits / n, z * z
    centre, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.struct(F.greatest(F.lit(0.0), centre - spread).alias("low"), F.least(F.lit(1.0), centre + spread).alias("high"))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """F34. Two-sided exact p of discordant counts, by sums of log factorials."""
    n, least = b + c, F.least(b, c)
    log_fact = lambda m: F.aggregate(F.sequence(F.lit(0), m.cast("int")), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1))))
    term = lambda i: F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.transform(F.sequence(F.lit(0), least.cast("int")), term), F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def grouped_means(df: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """A9. Means over all rows and per category in one pass; nulls are skipped."""
    means = [F.avg(m).alias(m) for m in metrics]
    out = df.groupingSets([[], [F.col(category)]], F.col(category)).agg(F.grouping(category).alias("_all"), F.count("*").alias("n"), *means)
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(category)).alias("grp"), "n", *metrics)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """A33. One row: kappa of two label columns."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    left = cells.select(F.col(a).alias("v"), F.col("n").alias("l"), zero.alias("r"), F.when(F.col(a) == F.col(b), F.col("n")).otherwise(zero).alias("s"))
    right = cells.select(F.col(b).alias("v"), zero.alias("l"), F.col("n").alias("r"), zero.alias("s"))
    margins = left.unionByName(right).groupBy("v").agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r"), F.sum("s").alias("s"))
    po, pe = F.sum("s") / F.sum("l"), F.sum(F.col("l") * F.col("r")) / (F.sum("l") * F.sum("r"))
    return margins.agg(po.alias("po"), pe.alias("pe")).select(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def average_rank(c: str, partition: list[str] | None = None) -> Column:
    """W9. Rank with the mean of ties."""
    w = Window.partitionBy(*(partition or [])).orderBy(c)
    ties = Window.partitionBy(*(partition or []), c)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0


def spearman(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """A34. Rank correlation per key; 0 where it is undefined."""
    ranked = df.withColumns({"_ra": average_rank(a, key), "_rb": average_rank(b, key)})
    return ranked.groupBy(*key).agg(F.coalesce(F.nanvl(F.corr("_ra", "_rb"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def average_precision(hits: DataFrame, query: str, rank: str, hit: str) -> DataFrame:
    """W12, F32. Mean of the precision at each hit, over the hits."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    run = hits.withColumn("_h", F.sum(F.col(hit).cast("int")).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(rank)))
    return run.groupBy(query).agg(F.coalesce(F.avg(F.when(F.col(hit), F.col("_h") / F.col("_n"))), F.lit(0.0)).alias("ap"))
