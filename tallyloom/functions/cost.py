"""Token cost, its precedence, and ceilings, in decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLION = 1_000_000
#: Fixed value: tokens that a prompt takes beyond its bytes.
PROMPT_OVERHEAD = 256


def token_cost(prompt: Column, cached: Column, completion: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """USD of a request from rates per million tokens; null when a count is missing, negative, or cached exceeds prompt.

    A missing cached count is 0, a missing cached rate the input rate."""
    cached = F.coalesce(cached, F.lit(0))
    tokens, rates = [(prompt - cached), cached, completion], [rate_in, F.coalesce(rate_cached, rate_in), rate_out]
    usable = prompt.isNotNull() & completion.isNotNull() & (prompt >= 0) & (completion >= 0) & (cached >= 0) & (cached <= prompt)
    parts = [t.cast("decimal(20,0)") * r.cast("decimal(18,9)") for t, r in zip(tokens, rates, strict=True)]
    return F.when(usable, (parts[0] + parts[1] + parts[2]).cast("double") / MILLION)


def preferred_cost(configured: Column, provider: Column) -> tuple[Column, Column]:
    """Cost and where it comes from: configured rates first, then what the provider reports."""
    source = F.when(configured.isNotNull(), "configured").when(provider.isNotNull(), "provider")
    return F.coalesce(configured, provider), source


def prompt_ceiling(text: Column) -> Column:
    """Most tokens that a prompt can take."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + PROMPT_OVERHEAD


def retry_reserve(failed_attempts: Column, ceiling: Column) -> Column:
    return F.coalesce(failed_attempts, F.lit(0)) * ceiling


def bounded_inverse(value: Column, most: float) -> Column:
    """1 - value / most, within [0, 1]."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - value / F.lit(float(most)))))


def complete_sum(value: Column, requests: Column) -> Column:
    """Sum where every request has a value, else null."""
    return F.when((requests > 0) & (F.count(value) == requests), F.sum(value))


def observed_sum(value: Column) -> Column:
    """Sum of the values that are there, null if none is."""
    return F.sum(value)


def filled_sum(value: Column) -> Column:
    """Sum with missing values as 0."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def skipping_sum(value: Column) -> Column:
    """Sum of the values that are there, 0 if none is."""
    return F.coalesce(F.sum(F.when(~F.isnan(value.cast("double")), value)), F.lit(0.0))


def overdue_days(as_of: Column, review_by: Column) -> Column:
    return F.greatest(F.datediff(as_of, review_by), F.lit(0))


#: What is wrong with a request's price, in the order in which it is found.
PRICE_PROBLEMS = ("no price of that id", "price of another route", "no price in force", "several prices of one day")


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests (pricing_id, route, requested_on, prompt_tokens, cached_tokens, completion_tokens, ...) with effective_on, rates, cost_usd and price_problem.

    prices: (pricing_id, route, effective_on, rate_in, rate_cached, rate_out), rates per million tokens. The price is the last one of the id in force on the
    day of the request. A request without pricing_id has no price and no problem; one whose id is unknown, declares another route, was not yet in
    force, or has two prices of that day, says so and costs null, as do missing or impossible token counts. The versions of an id are one sorted array, so a
    request meets one row however often its price has changed, and no range join is needed."""
    version = F.struct("effective_on", "route", "rate_in", "rate_cached", "rate_out")
    of = prices.where("pricing_id is not null and effective_on is not null").groupBy("pricing_id").agg(F.sort_array(F.collect_list(version)).alias("versions"))
    met = requests.join(of, "pricing_id", "left")
    due = F.filter("versions", lambda v: v["effective_on"] <= F.col("requested_on"))
    met = met.withColumn("__due", due).withColumn("__price", F.try_element_at("__due", F.lit(-1)))
    same_day = F.filter("__due", lambda v: v["effective_on"] == F.col("__price.effective_on"))
    route = F.exists("versions", lambda v: F.coalesce(v["route"] != F.col("route"), F.lit(True)))
    found = F.when(F.col("pricing_id").isNull(), None).when(F.col("versions").isNull(), PRICE_PROBLEMS[0]).when(route, PRICE_PROBLEMS[1]).when(F.col("__price").isNull(), PRICE_PROBLEMS[2]).when(F.size(same_day) > 1, PRICE_PROBLEMS[3])
    fine = found.isNull()
    rate = lambda name: F.when(fine, F.col(f"__price.{name}"))
    usd = token_cost(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"), rate("rate_in"), rate("rate_cached"), rate("rate_out"))
    return met.select(*[f"`{c}`" for c in requests.columns], *[rate(c).alias(c) for c in ("effective_on", "rate_in", "rate_cached", "rate_out")], usd.alias("cost_usd"), found.alias("price_problem"))
