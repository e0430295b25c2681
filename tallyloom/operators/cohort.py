"""Cohorts, deltas and samples that come out alike whatever the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_order


def hash_sample(df: DataFrame, group: list[str], key: str, quota: int, seed: object = 0) -> DataFrame:
    """The first `quota` rows of each group in the order of a seeded hash of the key."""
    order = W.partitionBy(*group).orderBy("__hash", key)
    return df.withColumn("__hash", hash_order(seed, F.col(key).cast("string"))).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= quota).drop("__hash")


def tier_delta(cohort: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """What a tier adds to the one that it inherits from."""
    return cohort.join(parent.select(key).distinct(), key, "left_anti")


def work_items(cases: DataFrame, models: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a case and a model that have no finished record. models has a row per model."""
    return cases.crossJoin(F.broadcast(models)).join(done.select(*keys).distinct(), keys, "left_anti")


def balanced_units(df: DataFrame, unit: str, columns: list[str], size: int, seed: object = 0, inherited: list | None = None) -> DataFrame:
    """Units of a cohort of `size` units whose shares of each column's values come near the whole's.

    Units of one histogram are interchangeable but for their hash, so the driver works on distinct histograms, of which there are few,
    each with its first `size` units in hash order, and adds the unit that leaves the least sum of |share - target|; ties go to
    the lower hash, then the lower id."""
    values = F.array_sort(F.flatten(F.collect_list(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in columns]))))
    units = df.groupBy(unit).agg(values.alias("profile")).withColumn("hash", hash_order(seed, F.col(unit).cast("string")))
    first = W.partitionBy("profile").orderBy("hash", unit)
    known = {*(inherited or [])}
    kept = units.withColumn("k", F.row_number().over(first)).where((F.col("k") <= size) | F.col(unit).isin(list(known)))
    target: dict[str, float] = {}
    for r in units.select(F.explode("profile").alias("v")).groupBy("v").count().collect():
        target[r["v"]] = r["count"]
    by_column: dict[str, float] = {}
    for v, n in target.items():
        by_column[v.split("=")[0]] = by_column.get(v.split("=")[0], 0) + n
    target = {v: n / by_column[v.split("=")[0]] for v, n in target.items()}
    pools: dict[tuple, list] = {}
    taken: dict[str, int] = {}
    chosen = []
    for r in kept.orderBy("hash", unit).collect():
        profile = tuple(r["profile"])
        if r[unit] in known:
            chosen.append(r[unit])
            for v in profile:
                taken[v] = taken.get(v, 0) + 1
        else:
            pools.setdefault(profile, []).append((r["hash"], r[unit]))

    def distance(profile: tuple) -> float:
        counts = dict(taken)
        for v in profile:
            counts[v] = counts.get(v, 0) + 1
        total: dict[str, int] = {}
        for v, n in counts.items():
            total[v.split("=")[0]] = total.get(v.split("=")[0], 0) + n
        return sum(abs(counts.get(v, 0) / max(1, total.get(v.split("=")[0], 0)) - t) for v, t in target.items())

    while len(chosen) < size and pools:
        _, _, best = min((round(distance(p), 12), pool[0], p) for p, pool in pools.items())
        chosen.append(pools[best].pop(0)[1])
        for v in best:
            taken[v] = taken.get(v, 0) + 1
        if not pools[best]:
            del pools[best]
    return df.sparkSession.createDataFrame([(u, k + 1) for k, u in enumerate(chosen)], T.StructType([df.schema[unit], T.StructField("pick", T.IntegerType())]))


def share_distance(sample: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of |share in sample - share in whole| over the values of each column."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
        counts = df.select(each).groupBy("x.column", "x.value").count()
        return counts.withColumn(name, F.col("count") / F.sum("count").over(W.partitionBy("column"))).drop("count")

    a, b = shares(sample, "a").alias("a"), shares(whole, "b").alias("b")
    both = a.join(b, (F.col("a.column") == F.col("b.column")) & F.col("a.value").eqNullSafe(F.col("b.value")), "full_outer")
    return both.groupBy(F.coalesce("a.column", "b.column").alias("column")).agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("distance"))


def audit_sample(df: DataFrame, group: list[str], item: str, quota: int, seed: object, prefix: str) -> DataFrame:
    """At most one row per item, then `quota` rows of each group in hash order, with sequence ids."""
    one = df.withColumn("__h", hash_order(seed, F.lit("audit"), F.col(item).cast("string"), *[F.col(g).cast("string") for g in group], separator="|"))
    one = one.withColumn("__one", F.row_number().over(W.partitionBy(item).orderBy("__h"))).where("__one = 1")
    picked = one.withColumn("pick", F.row_number().over(W.partitionBy(*group).orderBy("__h", item))).where(F.col("pick") <= quota)
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*group, "pick"))  # as many rows as the quotas allow
    return picked.withColumn("audit_id", F.format_string(f"{prefix}-%04d", number)).drop("__h", "__one")


def cost_preflight(pending: DataFrame, sample: DataFrame, multiplier: float, limit: float) -> DataFrame:
    """Expected cost of pending requests per model, mean sample cost times count, with a safety multiplier, against a limit."""
    mean = sample.groupBy("model_name").agg(F.avg("generation_cost_usd").alias("sample_mean_usd"), F.max("generation_cost_usd").alias("sample_max_usd"))
    out = pending.groupBy("model_name").agg(F.count(F.lit(1)).alias("pending")).join(mean, "model_name", "left")
    expected = F.col("pending") * F.col("sample_mean_usd") * multiplier
    return out.withColumns({"expected_usd": expected, "request_ceiling_usd": F.col("sample_max_usd") * multiplier, "within_limit": F.coalesce(expected <= limit, F.lit(False))})


def tier_chain(parents: dict[str, str | None], tier: str) -> list[str]:
    """A tier and those that it inherits from, nearest first. An unknown parent or a circle is an error. Tiers are a handful."""
    out: list[str] = []
    while tier is not None:
        if tier in out:
            raise ValueError(f"tiers inherit in a circle: {' -> '.join([*out, tier])}")
        if tier not in parents:
            raise ValueError(f"unknown tier: {tier}")
        out.append(tier)
        tier = parents[tier]
    return out


def diverse_products(products: DataFrame, targets: dict[str, int], routes: dict[str, list[str]], seed: object = 0) -> list[str]:
    """product_ids for a demonstration, in order: first one product for each group of routes, then each stratum up to its
    target, each the first by seeded hash that shares no ingredient with those chosen before. Too few products are an error.

    products: (product_id, stratum, ingredients array, routes array). A choice depends on all before it, so each is a
    query of its own that brings back one row; targets are small."""
    strata = list(targets)
    chosen: list[str] = []
    used: list[str] = []
    taken = dict.fromkeys(targets, 0)

    def pick(rows: DataFrame, purpose: str, group: str) -> bool:
        free = rows.where(~F.col("product_id").cast("string").isin(chosen)).where(~F.arrays_overlap("ingredients", F.lit(used).cast("array<string>")))
        order = hash_order(seed, F.lit(purpose), F.lit(group), F.col("product_id").cast("string"), separator="|")
        found = free.withColumn("place", order).orderBy("place").limit(1).collect()
        for r in found:
            chosen.append(str(r["product_id"]))
            used.extend(r["ingredients"])
            taken[r["stratum"]] += 1
        return bool(found)

    for group, accepted in routes.items():
        open_strata = [s for s in strata if taken[s] < targets[s]]
        if not pick(products.where(F.col("stratum").isin(open_strata) & F.arrays_overlap("routes", F.lit(accepted))), "route", group):
            raise ValueError(f"no product for the routes of {group}")
    for s in strata:
        while taken[s] < targets[s]:
            if not pick(products.where(F.col("stratum") == s), "fill", s):
                raise ValueError(f"{s}: {taken[s]} of {targets[s]} products")
    return chosen
