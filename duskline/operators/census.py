"""Population per city from a wide census table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from duskline.fixed import CENSUS_HEADING, CENSUS_NOTE, CENSUS_PERCENTS, CENSUS_TOTAL
from duskline.functions import text


def join_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two census tables side by side, matched on the fact and not on position.

    A fact that only one part has, or that a part lists twice, stops the job.
    """
    notes = [
        name
        for df in (left, right)
        for name in df.columns
        if name == "Fact Note" or name.startswith(CENSUS_NOTE)
    ]
    a = _once(left.drop(*notes)).withColumnRenamed("Fact", "left_fact")
    b = _once(right.drop(*notes)).withColumnRenamed("Fact", "right_fact")
    joined = a.join(b, F.col("left_fact") == F.col("right_fact"), "full")
    either = F.coalesce("left_fact", "right_fact")
    both = F.col("left_fact").isNotNull() & F.col("right_fact").isNotNull()
    fact = F.when(both, either).otherwise(
        F.raise_error(F.concat(F.lit("fact missing from one census part: "), either))
    )
    cities = [c for c in joined.columns if c not in ("left_fact", "right_fact")]
    return joined.select(fact.alias("Fact"), *[F.col(f"`{c}`") for c in cities])


def _once(part: DataFrame) -> DataFrame:
    """The facts of a part, each listed once."""
    values = [c for c in part.columns if c != "Fact"]
    one = F.count(F.lit(1)) == 1
    twice = F.raise_error(F.concat(F.lit("fact listed twice: "), F.col("Fact"))).cast("string")
    facts = part.where(F.col("Fact").isNotNull()).groupBy("Fact")
    return facts.agg(*[F.when(one, F.first(f"`{c}`")).otherwise(twice).alias(c) for c in values])


def transpose(wide: DataFrame, key: str, facts: list[str], into: str) -> DataFrame:
    """Facts in rows and cities in columns become the other way round.

    Works on any number of rows: nothing is collected. A fact that is missing
    altogether stops the job; one without a value for some city gives a null.
    """
    cities = [F.col(f"`{c}`") for c in wide.columns if c != key]
    long = wide.where(F.col(key).isin(*facts)).unpivot([key], cities, into, "value")
    both = F.first("value").alias("value"), F.count(F.lit(1)).alias("rows")
    listed = long.groupBy(into).pivot(key, facts).agg(*both)
    columns = []
    for fact in facts:
        missing = F.raise_error(F.lit(f"fact not listed: {fact}")).cast("string")
        there = F.coalesce(F.col(f"`{fact}_rows`"), F.lit(0)) > 0
        columns.append(F.when(there, F.col(f"`{fact}_value`")).otherwise(missing).alias(fact))
    return listed.select(into, *columns)


def census_by_city(
    wide: DataFrame,
    total: str = CENSUS_TOTAL,
    percents: Mapping[str, str] = CENSUS_PERCENTS,
) -> DataFrame:
    """``City, Total`` and one number of people per percent fact."""
    cities = [c for c in wide.columns if c == "Fact" or c.endswith(CENSUS_HEADING)]
    rows = transpose(
        wide.select(*[F.col(f"`{c}`") for c in cities]), "Fact", [total, *percents], "City"
    )
    renamed = rows.withColumnsRenamed({total: "Total", **percents})
    typed = renamed.withColumns(
        {
            "City": text.city_from_heading(F.col("City")),
            "Total": text.count_from_text(F.col("Total")),
        }
    )
    return typed.withColumns(
        {name: text.people_from_percent(F.col(name), F.col("Total")) for name in percents.values()}
    )


def census_report(census: DataFrame) -> DataFrame:
    """The columns rates need; the number of women is left out."""
    return census.select(
        F.col("City").alias("city"),
        F.col("Total").alias("total_pop"),
        F.col("black").alias("black_pop"),
        F.col("hispanic").alias("hispanic_pop"),
        F.col("white").alias("white_pop"),
    )
