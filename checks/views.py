"""The given tables in the shape of stop files and census files."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duskline.fixed import CENSUS_HEADING, CENSUS_NOTE, CENSUS_TOTAL

# The regions stand for cities, at the points of five cities.
POINTS = (
    ("AFRICA", 35.3733, -119.0187, "America/Los_Angeles"),
    ("AMERICA", 34.0522, -118.2437, "America/Los_Angeles"),
    ("ASIA", 37.8044, -122.2712, "America/Los_Angeles"),
    ("EUROPE", 32.7157, -117.1611, "America/Los_Angeles"),
    ("MIDDLE EAST", 37.7749, -122.4194, "America/Los_Angeles"),
)
CITIES = tuple(point[0] for point in POINTS)

RACES = {
    "view": "white",
    "click": "black",
    "purchase": "hispanic",
    "signup": "asian/pacific islander",
    "error": "unknown",
}

# City and race that never occur together.
ABSENT = ("EUROPE", "hispanic")

# Census percents come from market segments.
SEGMENT_FACTS = {
    "Female persons, percent": "AUTOMOBILE",
    "Black or African American alone, percent": "BUILDING",
    "Hispanic or Latino, percent": "FURNITURE",
    "White alone, not Hispanic or Latino, percent": "HOUSEHOLD",
    "Households with a computer, percent": "MACHINERY",
}
PEOPLE_PER_CUSTOMER = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


@lru_cache
def _schema(path: str) -> T.StructType:
    """Read from the file footer once, as a catalog would keep it."""
    return SparkSession.active().read.parquet(path).schema


def customer_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer key, segment and city; Catalyst picks the joins from the file sizes."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_mktsegment", F.col("r_name").alias("city"))
    )


# The typed columns of a stop. Missing values: about one race in a hundred, one date
# in a hundred, one time in 25, one sex in ten and others, as ``k`` runs over 0 to 99.
# An age of 0 occurs, and stands for an unknown one.
STOP_COLUMNS = """
    CAST(event_id AS STRING) AS raw_row_number
    if(event_id % 97 <> 0, date_add(DATE '2014-01-01', CAST(event_id * 7 % 365 AS INT)), NULL) AS date
    if(k % 25 <> 1, substr(CAST(ts AS STRING), 12, 8), NULL) AS time
    if(k % 7 <> 0, 30 + k % 10 + 0.5D, NULL) AS lat
    if(k % 3 <> 0, -(120 + k % 5 + 0.25D), NULL) AS lng
    if(k >= 5 OR k = 0, CAST(k AS DOUBLE), NULL) AS subject_age
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 2 = 1 THEN 'female' ELSE 'male' END AS subject_sex
    if(event_id % 101 <> 0, race, NULL) AS subject_race
    if(k % 4 = 0, 'pedestrian', 'vehicular') AS type
    CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'arrest' ELSE 'citation' END AS outcome
    if(k % 2 = 0, 'TRUE', 'FALSE') AS search_conducted
    CASE WHEN k % 2 <> 0 THEN NULL WHEN k % 8 = 0 THEN 'TRUE' ELSE 'FALSE' END AS contraband_found
    if(k % 25 <> 1, hour(ts) * 3600 + minute(ts) * 60 + CAST(second(ts) AS INT), NULL) AS second_of_day
    user_id
"""

# What a file holds where a value is missing.
TOKENS = {
    "date": "NaN",
    "time": "N/A",
    "lat": "",
    "lng": "NA",
    "subject_age": "nan",
    "subject_sex": "N/A",
    "subject_race": "NULL",
    "outcome": "",
    "contraband_found": "None",
}


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the merged table with types, as the merge job saves it.

    The join with the customers has no hint: its size grows with the data.
    """
    race = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in RACES.items())
    typed = (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id",
            "user_id",
            "ts",
            "CAST(get_json_object(props, '$.k') AS INT) AS k",
            f"CASE event_type {race} END AS race",
        )
        .selectExpr(*STOP_COLUMNS.strip().split("\n"))
    )
    cities = customer_cities(spark, sf_dir).select("c_custkey", "city")
    joined = typed.join(cities, F.col("user_id") == F.col("c_custkey"))
    # One city has no stops of one race.
    absent = (F.col("city") == ABSENT[0]) & (F.col("subject_race") == ABSENT[1])
    race = F.when(absent, "other").otherwise(F.col("subject_race"))
    return joined.withColumn("subject_race", race).drop("user_id", "c_custkey")


def raw_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text, missing values as the tokens files hold."""
    typed = stops(spark, sf_dir).drop("second_of_day")
    return typed.select(
        [
            F.coalesce(F.col(c).cast("string"), F.lit(TOKENS[c])).alias(c)
            if c in TOKENS
            else F.col(c).cast("string").alias(c)
            for c in typed.columns
        ]
    )


# One stop in so many, by its number, has a text that is no date, time or number, too many or
# too few fields, or a line break inside quotes.
PLANTED = {
    "date": (211, "2014-02-30"),
    "time": (223, "25:99:00"),
    "lat": (227, "north"),
    "subject_age": (229, "forty"),
    "outcome": (241, '"quoted\nbreak"'),
}
MORE_FIELDS, FEWER_FIELDS = 233, 239
FILES_PER_CITY = 3


def write_planted_files(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The stops as text files with planted faults, several a city; the files of each city."""
    raw = raw_stops(spark, sf_dir)
    number = F.col("raw_row_number").cast("long")
    names = [name for name in raw.columns if name != "city"]
    fields = {
        name: F.when(number % PLANTED[name][0] == 0, PLANTED[name][1]).otherwise(F.col(name))
        if name in PLANTED
        else F.col(name)
        for name in names
    }
    whole = F.concat_ws(",", *fields.values())
    fewer = F.concat_ws(",", *list(fields.values())[:3])
    line = F.when(number % MORE_FIELDS == 0, F.concat(whole, F.lit(",1"))).when(
        number % FEWER_FIELDS == 0, fewer
    )
    city = F.array_position(F.array(*map(F.lit, CITIES)), F.col("city")).cast("int")
    part = (number % FILES_PER_CITY).cast("int")
    rows = raw.select(
        city.alias("place"), part.alias("part"), F.lit(1).alias("row"), F.coalesce(line, whole).alias("value")
    )
    heads = [(i, part, 0, ",".join(names)) for i in range(1, len(CITIES) + 1) for part in range(FILES_PER_CITY)]
    both = rows.union(spark.createDataFrame(heads, rows.schema)).repartition("place", "part")
    ordered = both.sortWithinPartitions("place", "part", "row").drop("row")
    ordered.write.partitionBy("place", "part").text(folder)
    return {city: f"{folder}/place={i}/part=*" for i, city in enumerate(CITIES, start=1)}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three tables with differing columns as three cities' text tables."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raw_row_number"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("outcome"),
        F.col("o_custkey").alias("raw_customer"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("raw_row_number"),
        F.col("l_returnflag").alias("type"),
        F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("date"),
        F.col("l_linestatus").alias("search_conducted"),
        F.col("l_linenumber").alias("beat"),
    )
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("raw_row_number"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("date"),
        F.substring(F.col("ts").cast("string"), 12, 8).alias("time"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("beat"),
    )
    named = {"Orders": orders, "Lines": lines, "Events": events}
    return {
        city: df.select([F.col(name).cast("string") for name in df.columns])
        for city, df in named.items()
    }


def census_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as two wide census tables: facts in rows, cities in columns."""
    segments = list(SEGMENT_FACTS.values())
    counts = (
        customer_cities(spark, sf_dir)
        .groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("c_mktsegment") == s).alias(s) for s in segments],
        )
    )
    tenths = {s: F.floor(F.col(s) * 1000 / F.col("total")).cast("long") for s in segments}
    facts = [
        F.struct(
            F.lit(CENSUS_TOTAL).alias("Fact"),
            F.format_number(F.col("total") * PEOPLE_PER_CUSTOMER, 0).alias("value"),
        )
    ] + [
        F.struct(
            F.lit(fact).alias("Fact"),
            F.concat(F.floor(tenths[s] / 10), F.lit("."), tenths[s] % 10, F.lit("%")).alias(
                "value"
            ),
        )
        for fact, s in SEGMENT_FACTS.items()
    ]
    long = counts.select(
        F.concat("city", F.lit(CENSUS_HEADING)).alias("heading"), F.inline(F.array(*facts))
    )
    return _wide(long, CITIES[3:]), _wide(long, CITIES[:3])


def _wide(long: DataFrame, cities: tuple[str, ...]) -> DataFrame:
    headings = [city + CENSUS_HEADING for city in cities]
    wide = long.groupBy("Fact").pivot("heading", headings).agg(F.first("value"))
    notes = {CENSUS_NOTE + heading: F.lit(None).cast("string") for heading in headings}
    return wide.withColumns({"Fact Note": F.lit(None).cast("string"), **notes})
