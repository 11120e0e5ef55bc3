"""Token and cost metering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate

ASSUMED_OUTPUT, PROMPT_OVERHEAD, PROMPT_CODE = 500, 800, 2000

#: Dollars per million tokens in and out; callers add rows for the models that they use.
PRICES = [("openai", "gpt-4o", 2.5, 10.0), ("openai", "gpt-4o-mini", 0.15, 0.6), ("tier", "large", 15.0, 75.0), ("tier", "medium", 3.0, 15.0), ("tier", "small", 1.0, 5.0)]
PRICE_SCHEMA = "provider string, model string, input_per_mtok double, output_per_mtok double"


#: Providers whose models run on the caller's own machines: nothing is charged.
FREE = ("local",)


def price_table(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*PRICES, *extra], PRICE_SCHEMA)


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``input_cost_usd, output_cost_usd, total_usd, exact``.

    Usage is exact where the provider told both counts; where one is missing,
    both are estimates: the output is assumed, and so is the input unless it is
    given as ``estimated_input``. Negative counts count as none. Models of
    ``FREE`` providers cost nothing; other models without a price have null costs.
    A price list is a few rows, which Spark sends by its own size check.
    """
    exact = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    guess = F.col("estimated_input") if "estimated_input" in usage.columns else F.col("input_tokens")
    n_in = F.greatest(F.coalesce(F.when(exact, F.col("input_tokens")).otherwise(guess), F.lit(0)), F.lit(0))
    n_out = F.greatest(F.when(exact, F.col("output_tokens")).otherwise(F.lit(ASSUMED_OUTPUT)), F.lit(0))
    counted = usage.withColumns({"exact": exact, "input_tokens": n_in, "output_tokens": n_out, "provider": F.lower("provider")}).drop("estimated_input")
    priced = counted.join(prices.withColumn("provider", F.lower("provider")), ["provider", "model"], "left")
    free = F.col("provider").isin(*FREE)
    cost = lambda n, price: F.when(free, F.lit(0.0)).otherwise(F.col(n) * F.col(price) / 1_000_000)
    cost_in, cost_out = cost("input_tokens", "input_per_mtok"), cost("output_tokens", "output_per_mtok")
    return priced.withColumns({"input_cost_usd": cost_in, "output_cost_usd": cost_out, "total_usd": cost_in + cost_out}).drop("input_per_mtok", "output_per_mtok")


def cost_line(priced: DataFrame) -> DataFrame:
    """Adds ``line``, the meter's one-line rendering; guesses are marked, free and unpriced models show no money."""
    about = F.when(F.col("exact"), "").otherwise("~")
    counts = F.concat(about, F.format_number("input_tokens", 0), F.lit(" in + "), about, F.format_number("output_tokens", 0))
    who = F.concat(F.lit(" ("), "provider", F.lit(":"), "model", F.lit(")"))
    money = F.concat(
        counts, F.lit(" out tok | $"), F.format_string("%.4f", "input_cost_usd"), F.lit(" + $"), F.format_string("%.4f", "output_cost_usd"),
        F.lit(" = $"), F.format_string("%.4f", "total_usd"), who,
    )
    free = F.concat(counts, F.lit(" out tokens | no API cost"), who)
    unknown = F.concat(counts, F.lit(" out tokens | pricing unknown"), who)
    return priced.withColumn("line", F.when(F.col("provider").isin(*FREE), free).when(F.col("total_usd").isNull(), unknown).otherwise(money))


def prompt_tokens(hits: DataFrame) -> DataFrame:
    """``query_id, prompt_tokens`` of hits (``query_id, code, question``): capped code, the question and a fixed overhead."""
    n = F.sum(F.least(F.length("code"), F.lit(PROMPT_CODE))) + F.coalesce(F.max(F.length("question")), F.lit(0)) + PROMPT_OVERHEAD
    return hits.groupBy("query_id").agg(F.floor(n / 4).cast("bigint").alias("prompt_tokens"))


def token_count(text: Column, encoding: str | None = None) -> Column:
    """Tokens of a text by an encoding of the tiktoken library where it is given and at hand, else by the estimate."""
    try:
        import tiktoken

        tiktoken.get_encoding(encoding or "")
    except Exception:  # noqa: BLE001 - no library, no such encoding, or no file of it here
        return token_estimate(text)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        coder = tiktoken.get_encoding(encoding)
        return texts.fillna("").map(lambda t: len(coder.encode(t, disallowed_special=())))

    return count(text)
