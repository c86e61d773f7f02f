"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from math import pi

from checks import newton

STOPS = """
raw AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events
),
stops AS (
  SELECT CAST(event_id AS VARCHAR) AS raw_row_number,
         CASE WHEN event_id % 97 <> 0
              THEN CAST(DATE '2014-01-01' + CAST(event_id * 7 % 365 AS INT) AS DATE) END AS date,
         CASE WHEN k % 25 <> 1 THEN strftime(ts, '%H:%M:%S') END AS time,
         CASE WHEN k % 7 <> 0 THEN CAST('3' || (k % 10) || '.5' AS DOUBLE) END AS lat,
         CASE WHEN k % 3 <> 0 THEN CAST('-12' || (k % 5) || '.25' AS DOUBLE) END AS lng,
         CASE WHEN k >= 5 OR k = 0 THEN CAST(k AS DOUBLE) END AS subject_age,
         CASE WHEN k % 10 = 0 THEN NULL WHEN k % 2 = 1 THEN 'female' ELSE 'male' END
           AS subject_sex,
         CASE WHEN event_id % 101 = 0 THEN NULL
              WHEN event_type = 'view' THEN 'white' WHEN event_type = 'click' THEN 'black'
              WHEN event_type = 'purchase' AND r_name = 'EUROPE' THEN 'other'
              WHEN event_type = 'purchase' THEN 'hispanic'
              WHEN event_type = 'signup' THEN 'asian/pacific islander'
              WHEN event_type = 'error' THEN 'unknown' END AS subject_race,
         CASE WHEN k % 4 = 0 THEN 'pedestrian' ELSE 'vehicular' END AS type,
         CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 'arrest' ELSE 'citation' END AS outcome,
         CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS search_conducted,
         CASE WHEN k % 2 <> 0 THEN NULL WHEN k % 8 = 0 THEN 'TRUE' ELSE 'FALSE' END
           AS contraband_found,
         CASE WHEN k % 25 <> 1 THEN CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT)
           END AS second_of_day,
         r_name AS city
  FROM raw
  JOIN customer ON user_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
known AS (
  SELECT *, second_of_day // 3600 AS hour, CAST(isodow(date) - 1 AS INT) AS weekday
  FROM stops WHERE subject_race IS NOT NULL AND date IS NOT NULL
),
study AS (
  SELECT * FROM known
  WHERE date BETWEEN DATE '2014-03-01' AND DATE '2014-09-30' AND city <> 'ASIA'
),
whole AS (SELECT * FROM known WHERE date BETWEEN DATE '2014-01-01' AND DATE '2014-12-31')
"""

STOP_COLUMNS = (
    "raw_row_number date time lat lng subject_age subject_sex subject_race type outcome "
    "search_conducted contraband_found city second_of_day hour weekday"
).split()
SAVED_COLUMNS = [c for c in STOP_COLUMNS if c not in ("hour", "weekday")]
TYPES = {
    "date": "date",
    "lat": "double",
    "lng": "double",
    "subject_age": "double",
    "second_of_day": "int",
    "hour": "int",
    "weekday": "int",
}

CENSUS = """
people AS (
  SELECT r_name AS city, count(*) AS total,
         count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS f,
         count(*) FILTER (c_mktsegment = 'BUILDING') AS b,
         count(*) FILTER (c_mktsegment = 'FURNITURE') AS h,
         count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS w
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1
),
census AS (
  SELECT city AS "City", CAST(total * 1000 AS DOUBLE) AS "Total",
         (f * 1000 // total) / 10.0 / 100 * (total * 1000) AS female,
         (b * 1000 // total) / 10.0 / 100 * (total * 1000) AS black,
         (h * 1000 // total) / 10.0 / 100 * (total * 1000) AS hispanic,
         (w * 1000 // total) / 10.0 / 100 * (total * 1000) AS white
  FROM people
),
pop AS (
  SELECT "City" AS city, "Total" AS total_pop, black AS black_pop, hispanic AS hispanic_pop,
         white AS white_pop
  FROM census
)
"""

# A census without one of the cities.
GAP = CENSUS.replace("  FROM census\n)", "  FROM census WHERE \"City\" <> 'MIDDLE EAST'\n)")

HEADS = """
matrix AS (
  SELECT city, nullif(count(*) FILTER (subject_race = 'black'), 0) AS black,
         nullif(count(*) FILTER (subject_race = 'hispanic'), 0) AS hispanic,
         nullif(count(*) FILTER (subject_race = 'white'), 0) AS white
  FROM known WHERE subject_race IN ('black', 'hispanic', 'white') GROUP BY city
),
heads AS (
  SELECT matrix.*, total_pop, black_pop, hispanic_pop, white_pop,
         black / nullif(black_pop, 0) AS black_per_cap,
         hispanic / nullif(hispanic_pop, 0) AS hispanic_per_cap,
         white / nullif(white_pop, 0) AS white_per_cap
  FROM matrix LEFT JOIN pop USING (city)
),
means AS (
  SELECT CASE WHEN count(*) = count(black_per_cap) THEN avg(black_per_cap) END AS black_mean,
         CASE WHEN count(*) = count(hispanic_per_cap) THEN avg(hispanic_per_cap) END
           AS hispanic_mean,
         CASE WHEN count(*) = count(white_per_cap) THEN avg(white_per_cap) END AS white_mean,
         CASE WHEN count(*) = count(black_pop) THEN sum(black_pop) END AS black_pop_sum,
         CASE WHEN count(*) = count(hispanic_pop) THEN sum(hispanic_pop) END AS hispanic_pop_sum,
         CASE WHEN count(*) = count(white_pop) THEN sum(white_pop) END AS white_pop_sum
  FROM heads
)
"""

RAD = repr(pi / 180)
TURN = repr(2 * pi)
SUN = f"""
evening AS (
  SELECT * FROM known
  WHERE type = 'vehicular' AND subject_race IN ('black', 'hispanic', 'white')
),
points(city, lat, lon) AS (
  VALUES ('AFRICA', 35.3733::DOUBLE, -119.0187::DOUBLE),
         ('AMERICA', 34.0522, -118.2437),
         ('ASIA', 37.8044, -122.2712),
         ('EUROPE', 32.7157, -117.1611),
         ('MIDDLE EAST', 37.7749, -122.4194)
),
s1 AS (
  SELECT city, date, -lon * {RAD} AS lw, lat * {RAD} AS phi,
         date_diff('day', DATE '2000-01-01', date) AS d
  FROM (SELECT DISTINCT city, date FROM evening) JOIN points USING (city)
),
s2 AS (SELECT *, round(d - 0.0009 - lw / {TURN}) AS n FROM s1),
s3 AS (SELECT *, 0.0009 + lw / {TURN} + n AS ds FROM s2),
s4 AS (SELECT *, {RAD} * (357.5291::DOUBLE + 0.98560028::DOUBLE * ds) AS m FROM s3),
s5 AS (
  SELECT *, m + {RAD} * (1.9148::DOUBLE * sin(m) + 0.02::DOUBLE * sin(2 * m)
              + 0.0003::DOUBLE * sin(3 * m)) + {RAD} * 102.9372::DOUBLE + pi() AS l
  FROM s4
),
s6 AS (SELECT *, asin(sin({RAD} * 23.4397::DOUBLE) * sin(l)) AS dec FROM s5),
s7 AS (
  SELECT *,
         acos((sin(-0.833::DOUBLE * {RAD}) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))) AS w1,
         acos((sin(-6::DOUBLE * {RAD}) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))) AS w2
  FROM s6
),
s8 AS (
  SELECT city, date,
         floor((2451545 + 0.0009::DOUBLE + (w1 + lw) / {TURN} + n + 0.0053::DOUBLE * sin(m)
                - 0.0069::DOUBLE * sin(2 * l) - 2440587.5::DOUBLE) * 86400) AS sunset_second,
         floor((2451545 + 0.0009::DOUBLE + (w2 + lw) / {TURN} + n + 0.0053::DOUBLE * sin(m)
                - 0.0069::DOUBLE * sin(2 * l) - 2440587.5::DOUBLE) * 86400) AS dusk_second
  FROM s7
),
s9 AS (
  SELECT city, date,
         timezone('America/Los_Angeles', make_timestamptz(sunset_second::BIGINT * 1000000)) AS a,
         timezone('America/Los_Angeles', make_timestamptz(dusk_second::BIGINT * 1000000)) AS b
  FROM s8
),
sun AS (
  SELECT city, date, strftime(a, '%H:%M:%S') AS sunset, strftime(b, '%H:%M:%S') AS dusk,
         CAST(hour(a) * 60 + minute(a) AS INT) AS sunset_minute,
         CAST(hour(b) * 60 + minute(b) AS INT) AS dusk_minute
  FROM s9
),
lit AS (
  SELECT evening.*, sunset, dusk, sunset_minute, dusk_minute,
         second_of_day // 60 AS at_minute,
         min(dusk_minute) OVER (PARTITION BY city) AS min_dusk_minute,
         max(dusk_minute) OVER (PARTITION BY city) AS max_dusk_minute
  FROM evening LEFT JOIN sun USING (city, date)
),
vod AS (
  SELECT *, at_minute - dusk_minute AS minutes_after_dark, at_minute > dusk_minute AS is_dark,
         subject_race = 'black' AS is_black
  FROM lit
  WHERE at_minute >= min_dusk_minute AND at_minute <= max_dusk_minute
    AND NOT (at_minute > sunset_minute AND at_minute < dusk_minute)
    AND subject_race IN ('black', 'white')
)
"""


def _with(*parts_and_query: str) -> str:
    *parts, query = parts_and_query
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n" + query.strip()


def _histogram(rows: str, bins: int) -> str:
    """Bins by comparing with the edges; the last one is closed."""
    return _with(
        STOPS,
        f"""
        x AS ({rows}),
        span AS (
          SELECT min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS low,
                 max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS high FROM x
        ),
        edges AS (
          SELECT CAST(i AS INT) AS bin, low + i * ((high - low) / {bins}) AS lower,
                 CASE WHEN i = {bins - 1} THEN high
                      ELSE low + (i + 1) * ((high - low) / {bins}) END AS upper
          FROM span, range({bins}) AS r(i)
        )""",
        f"""
        SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(v) AS n
        FROM edges LEFT JOIN x
          ON v >= lower AND (v < upper OR (bin = {bins - 1} AND v <= upper))
        GROUP BY ALL""",
    )


def _share(column: str) -> str:
    return _with(
        STOPS,
        f"""SELECT {column}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM whole WHERE {column} IS NOT NULL GROUP BY {column}""",
    )


def _percent(column: str, extra: str = "") -> str:
    return _with(
        STOPS,
        f"""SELECT city, {column},
               round(count(*) / sum(count(*)) OVER (PARTITION BY city) * 100, 6) AS pct {extra}
        FROM whole WHERE {column} IS NOT NULL GROUP BY city, {column}""",
    )


def _share_by_city(column: str, names: dict[str, str], keep: str) -> str:
    shares = ", ".join(
        f"round(count(*) FILTER ({column} = '{value}') / count(*), 6) AS {name}"
        for value, name in names.items()
    )
    return _with(STOPS, f"SELECT city, {shares} FROM whole WHERE {keep} GROUP BY city")


def _dark_share(group: str) -> str:
    return _with(
        STOPS,
        SUN,
        f"""SELECT {group} is_dark, round(avg(CAST(is_black AS INT)), 6) AS prop_black,
               count(*) AS n
        FROM vod WHERE second_of_day > 66600 AND second_of_day < 67500 GROUP BY ALL""",
    )


def _stages(source: str, conditions: dict[str, str]) -> str:
    parts, kept = [], "TRUE"
    for step, (stage, condition) in enumerate(conditions.items()):
        kept = f"{kept} AND ({condition})"
        parts.append(
            f"SELECT {step} AS step, '{stage}' AS stage, count(*) AS rows FROM {source} WHERE {kept}"
        )
    return "\nUNION ALL ".join(parts)


def _counts_by_column(columns: list[str], extra: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {extra.format(kind=TYPES.get(c, 'string'))} "
        f"count({c}) AS non_null FROM stops"
        for c in columns
    )


INVENTORY = """
SELECT 'date' AS column_name, 'Orders,Lines,Events' AS sources,
       (SELECT count(o_orderdate) FROM orders) + (SELECT count(l_shipdate) FROM lineitem)
         + (SELECT count(ts) FROM events) AS non_null
UNION ALL SELECT 'type', 'Orders,Lines,Events',
       (SELECT count(o_orderstatus) FROM orders) + (SELECT count(l_returnflag) FROM lineitem)
         + (SELECT count(event_type) FROM events)
UNION ALL SELECT 'outcome', 'Orders', (SELECT count(o_orderpriority) FROM orders)
UNION ALL SELECT 'search_conducted', 'Lines', (SELECT count(l_linestatus) FROM lineitem)
UNION ALL SELECT 'beat', 'Lines,Events',
       (SELECT count(l_linenumber) FROM lineitem) + (SELECT count(user_id) FROM events)
UNION ALL SELECT 'time', 'Events', (SELECT count(ts) FROM events)
"""

NOTHING = "CAST(NULL AS VARCHAR)"
UNION = f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, {NOTHING} AS time, {NOTHING} AS lat,
       {NOTHING} AS lng, {NOTHING} AS subject_age, {NOTHING} AS subject_sex,
       {NOTHING} AS subject_race, o_orderstatus AS type, o_orderpriority AS outcome,
       {NOTHING} AS search_conducted, {NOTHING} AS contraband_found, 'Orders' AS city
FROM orders
UNION ALL
SELECT strftime(l_shipdate, '%Y-%m-%d'), NULL, NULL, NULL, NULL, NULL, NULL, l_returnflag, NULL,
       l_linestatus, NULL, 'Lines'
FROM lineitem
UNION ALL
SELECT strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'), NULL, NULL, NULL, NULL, NULL,
       event_type, NULL, NULL, NULL, 'Events'
FROM events
"""

LABELLED = ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}"
    if c in ("contraband_found", "search_conducted", "lat", "lng", "time", "subject_sex", "outcome")
    else f"coalesce({c}, -1) AS {c}"
    if c in ("subject_age", "hour")
    else c
    for c in STOP_COLUMNS
    if c != "second_of_day"
)

RACES = {
    "hispanic": "hispanic",
    "black": "black",
    "white": "white",
    "asian/pacific islander": "asian_pacific_islander",
}

HEAD_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}"
    for c in (
        "total_pop black_pop hispanic_pop white_pop black_per_cap hispanic_per_cap white_per_cap"
    ).split()
)


def _interval(other: str) -> str:
    variance = (
        f"sqrt(white_mean * (1 - white_mean) / white_pop_sum"
        f" + {other}_mean * (1 - {other}_mean) / {other}_pop_sum)"
    )
    return f"""SELECT 'white' AS base, '{other}' AS other,
       round(white_mean - {other}_mean, 6) AS difference,
       round(white_mean - {other}_mean - 2.58 * {variance}, 6) AS lower_bound,
       round(white_mean - {other}_mean + 2.58 * {variance}, 6) AS upper_bound FROM means"""


STAGES = {
    "read": "TRUE",
    "complete": "subject_race IS NOT NULL AND date IS NOT NULL",
    "in period": "date BETWEEN DATE '2014-03-01' AND DATE '2014-09-30'",
    "listed cities": "city <> 'ASIA'",
    "listed races": "subject_race IN ('black', 'hispanic', 'white')",
    "vehicular": "type = 'vehicular'",
}


def _stage_completeness() -> str:
    parts, kept = [], "TRUE"
    for step, (stage, condition) in enumerate(STAGES.items()):
        kept = f"{kept} AND ({condition})"
        parts += [
            f"SELECT {step} AS step, '{stage}' AS stage, '{c}' AS column_name, "
            f"count({c}) AS non_null FROM stops WHERE {kept}"
            for c in STOP_COLUMNS
            if c not in ("raw_row_number", "hour", "weekday")
        ]
    return _with(STOPS, "\nUNION ALL ".join(parts))


# Faults that are planted in the text files, by the stop's number.
FAULTS = """
numbered AS (SELECT *, CAST(raw_row_number AS BIGINT) AS number FROM stops),
faults AS (
  SELECT city, number, unnest(
           CASE WHEN number % 233 = 0 OR number % 239 = 0 THEN ['fields']
           ELSE list_filter([
             CASE WHEN number % 211 = 0 THEN 'date' END,
             CASE WHEN number % 223 = 0 THEN 'time' END,
             CASE WHEN number % 227 = 0 THEN 'lat' END,
             CASE WHEN number % 229 = 0 THEN 'subject_age' END], lambda x: x IS NOT NULL) END) AS found
  FROM numbered
),
outcomes AS (
  SELECT city, found FROM faults
  UNION ALL
  SELECT city, CASE WHEN number % 241 = 0 THEN 'good, with a line break' ELSE 'good' END
  FROM numbered ANTI JOIN faults USING (city, number)
)
"""

ALL_CITIES = "'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'"
FEWER_CITIES = "'AMERICA', 'ASIA', 'MIDDLE EAST'"
LATER_CITIES = "'ASIA', 'EUROPE', 'MIDDLE EAST'"


def _fit(by_city: bool, query: str, cities: str = ALL_CITIES, where: str = "TRUE", **parting) -> str:
    parts = _with(STOPS, SUN, newton.model(cities, by_city, where, **parting), query)
    return parts.replace("WITH ", "WITH RECURSIVE ", 1)


COEFFICIENTS = f"""
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(z, 6) AS z, round({newton.P_VALUE}, 6) AS p, 'fitted' AS status
FROM estimates
"""


def _separated(found: str, separated: str, fit: str) -> str:
    """The fit without the separated term and the stops it parts, and that term without numbers."""
    return f"""SELECT '{found}' AS found, * FROM ({fit})
UNION ALL SELECT '{found}', '{separated}', NULL, NULL, NULL, NULL, 'separated'"""


ORACLE: dict[str, str] = {
    "stage_completeness": _stage_completeness(),
    "column_inventory": INVENTORY,
    "harmonized_union": UNION,
    "csv_files": _with(
        STOPS,
        "SELECT city, count(*) AS rows, "
        + ", ".join(
            f"count({c}) AS {c}" for c in STOP_COLUMNS if c not in (
                "raw_row_number", "city", "hour", "weekday"
            )
        )
        + " FROM stops WHERE date BETWEEN DATE '2014-03-01' AND DATE '2014-09-30' GROUP BY city",
    ),
    "rejected_rows": _with(
        STOPS, FAULTS, "SELECT city, found, count(*) AS rows FROM outcomes GROUP BY ALL"
    ),
    "replaced_city": _with(
        STOPS,
        """SELECT city, CAST(year(date) AS INT) AS year, count(*) AS rows FROM stops
        WHERE city = 'MIDDLE EAST'
           OR (city = 'ASIA' AND type = 'pedestrian' AND date < DATE '2014-07-01')
        GROUP BY ALL""",
    ),
    "parsed_stops": _with(
        STOPS,
        f"SELECT {', '.join(c for c in STOP_COLUMNS if c not in ('hour', 'weekday'))} FROM stops",
    ),
    "completeness": _with(STOPS, _counts_by_column(SAVED_COLUMNS)),
    "column_report": _with(STOPS, _counts_by_column(SAVED_COLUMNS[1:], "'{kind}' AS data_type,")),
    "indexed_file": _with(
        STOPS,
        "SELECT 'city' AS column_name, count(DISTINCT city) AS non_null FROM known "
        "UNION ALL SELECT 'stops', count(DISTINCT city) FROM known",
    ),
    "clean_stops": _with(
        STOPS,
        f"SELECT {', '.join(STOP_COLUMNS)} FROM study "
        "WHERE subject_race IN ('black', 'hispanic', 'white')",
    ),
    "labelled_stops": _with(STOPS, f"SELECT {LABELLED} FROM study"),
    "first_rows": _with(
        STOPS,
        "SELECT CAST(raw_row_number AS BIGINT) AS row, city, date, subject_race "
        "FROM whole ORDER BY 1 LIMIT 5",
    ),
    "stage_counts": _with(STOPS, _stages("stops", STAGES)),
    "date_span": _with(
        STOPS,
        "SELECT city, min(date) AS first_date, max(date) AS last_date "
        "FROM stops GROUP BY ROLLUP (city)",
    ),
    "city_counts": _with(
        STOPS,
        "SELECT city, count(*) AS n, CAST(row_number() OVER (ORDER BY city) AS INT) AS rank "
        "FROM whole GROUP BY city",
    ),
    "race_counts": _with(
        STOPS,
        "SELECT subject_race, count(*) AS n, "
        "CAST(row_number() OVER (ORDER BY count(*) DESC, subject_race) AS INT) AS rank "
        "FROM whole GROUP BY subject_race",
    ),
    "distinct_city_race": _with(STOPS, "SELECT DISTINCT city, subject_race FROM whole"),
    "type_share": _share("type"),
    "sex_share": _with(
        STOPS,
        """SELECT coalesce(subject_sex, 'N/A') AS subject_sex, count(*) AS n,
               round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM whole GROUP BY 1""",
    ),
    "race_share": _share("subject_race"),
    "race_share_by_city": _share_by_city(
        "subject_race", RACES, "subject_race NOT IN ('other', 'unknown')"
    ),
    "sex_share_by_city": _share_by_city(
        "subject_sex", {"male": "male", "female": "female"}, "subject_sex IN ('male', 'female')"
    ),
    "hour_pct": _percent(
        "hour", ", CAST(row_number() OVER (ORDER BY city, hour) AS INT) AS rank"
    ),
    "hour_pct_from_cells": _percent("hour"),
    "weekday_pct": _percent("weekday"),
    "weekday_pct_from_cells": _percent("weekday"),
    "age_hist": _histogram("SELECT subject_age AS v FROM whole WHERE subject_age > 0", 20),
    "date_hist": _histogram(
        "SELECT CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS v FROM whole", 10
    ),
    "race_matrix": _with(STOPS, CENSUS, HEADS, "SELECT * FROM matrix"),
    "census_by_city": _with(
        CENSUS,
        """SELECT "City", "Total", round(female, 6) AS female, round(black, 6) AS black,
               round(hispanic, 6) AS hispanic, round(white, 6) AS white FROM census""",
    ),
    "population_share": _with(
        CENSUS,
        """SELECT city, total_pop, round(black_pop, 6) AS black_pop,
               round(hispanic_pop, 6) AS hispanic_pop, round(white_pop, 6) AS white_pop,
               round(black_pop / total_pop, 6) AS black_prop,
               round(hispanic_pop / total_pop, 6) AS hispanic_prop,
               round(white_pop / total_pop, 6) AS white_prop
        FROM pop""",
    ),
    "per_capita": _with(
        STOPS, CENSUS, HEADS, f"SELECT city, black, hispanic, white, {HEAD_COLUMNS} FROM heads"
    ),
    "per_capita_report": _with(
        STOPS,
        CENSUS,
        HEADS,
        """SELECT city, round(black_per_cap, 6) AS black_per_cap,
               round(hispanic_per_cap, 6) AS hispanic_per_cap,
               round(white_per_cap, 6) AS white_per_cap FROM heads""",
    ),
    "rate_means": _with(
        STOPS,
        CENSUS,
        HEADS,
        """SELECT round(black_mean, 6) AS black_mean, round(hispanic_mean, 6) AS hispanic_mean,
               round(white_mean, 6) AS white_mean, round(black_pop_sum, 6) AS black_pop_sum,
               round(hispanic_pop_sum, 6) AS hispanic_pop_sum,
               round(white_pop_sum, 6) AS white_pop_sum
        FROM means""",
    ),
    "per_capita_gap": _with(
        STOPS, GAP, HEADS, f"SELECT city, black, hispanic, white, {HEAD_COLUMNS} FROM heads"
    ),
    "rate_means_gap": _with(
        STOPS,
        GAP,
        HEADS,
        """SELECT round(black_mean, 6) AS black_mean, round(hispanic_mean, 6) AS hispanic_mean,
               round(white_mean, 6) AS white_mean, round(black_pop_sum, 6) AS black_pop_sum,
               round(hispanic_pop_sum, 6) AS hispanic_pop_sum,
               round(white_pop_sum, 6) AS white_pop_sum
        FROM means""",
    ),
    "census_files": _with(
        CENSUS,
        """SELECT "City", "Total", round(female, 6) AS female, round(black, 6) AS black,
               round(hispanic, 6) AS hispanic, round(white, 6) AS white FROM census""",
    ),
    "rate_interval": _with(
        STOPS, CENSUS, HEADS, f"{_interval('black')} UNION ALL {_interval('hispanic')}"
    ),
    "rate_ratio": _with(
        STOPS,
        CENSUS,
        HEADS,
        """SELECT 'white' AS base, 'black' AS other, round(black_mean / white_mean, 6) AS ratio
        FROM means
        UNION ALL SELECT 'white', 'hispanic', round(hispanic_mean / white_mean, 6) FROM means""",
    ),
    "solar_table": _with(STOPS, SUN, "SELECT * FROM sun"),
    "dusk_extremes": _with(
        STOPS,
        SUN,
        """SELECT * FROM sun
        QUALIFY dusk = min(dusk) OVER (PARTITION BY city)
             OR dusk = max(dusk) OVER (PARTITION BY city)""",
    ),
    "twilight_stops": _with(
        STOPS,
        SUN,
        """SELECT raw_row_number, city, date, time, subject_race, sunset, dusk, sunset_minute,
               dusk_minute, min_dusk_minute, max_dusk_minute, at_minute AS minute,
               minutes_after_dark, is_dark, is_black FROM vod""",
    ),
    "twilight_stages": _with(
        STOPS,
        SUN,
        _stages(
            "lit",
            {
                "vehicular": "TRUE",
                "between twilights": "at_minute BETWEEN min_dusk_minute AND max_dusk_minute",
                "not ambiguous": "NOT (at_minute > sunset_minute AND at_minute < dusk_minute)",
                "two races": "subject_race IN ('black', 'white')",
            },
        ),
    ),
    "twilight_counts": _with(
        STOPS, SUN, "SELECT city, count(*) AS n FROM vod WHERE city <> 'EUROPE' GROUP BY city"
    ),
    "dark_share_slice": _dark_share("city,"),
    "dark_share_overall": _dark_share(""),
    "dark_share_total": _with(
        STOPS,
        SUN,
        """SELECT city, is_dark, round(avg(CAST(is_black AS INT)), 6) AS prop_black,
               count(*) AS n
        FROM vod GROUP BY GROUPING SETS ((city, is_dark), (is_dark))""",
    ),
    "model_cells": _with(
        STOPS,
        SUN,
        """SELECT city, at_minute AS minute, is_dark, is_black, count(*) AS n
        FROM vod GROUP BY ALL""",
    ),
    "spline_knots": _with(
        STOPS,
        SUN,
        "SELECT CAST(min(at_minute) AS DOUBLE) AS low, CAST(max(at_minute) AS DOUBLE) AS high, "
        + ", ".join(
            f"round(quantile_cont(at_minute, CAST({i} AS DOUBLE) / 6), 6) AS knot_{i}"
            for i in range(1, 6)
        )
        + " FROM vod",
    ),
    "spline_basis": _with(
        STOPS,
        SUN,
        "used AS (SELECT * FROM vod)",
        newton.ENDS,
        newton.BASIS,
        "SELECT at_minute AS minute, "
        + ", ".join(f"round(z[{i}], 6) AS minute_{i}" for i in range(1, newton.INNER + 2))
        + " FROM basis",
    ),
    "model_base": _fit(False, COEFFICIENTS),
    "model_city": _fit(True, COEFFICIENTS),
    "model_city_fewer": _fit(True, COEFFICIENTS, FEWER_CITIES, "city <> 'EUROPE'"),
    "model_fit": _fit(
        True,
        """SELECT CAST(n_rows AS BIGINT) AS n_rows, CAST(n_light AS BIGINT) AS n_light,
               CAST(n_dark AS BIGINT) AS n_dark, 6 AS spline_df, round(deviance, 6) AS deviance,
               CAST(n_rows - p.p AS BIGINT) AS df_residual,
               round(null_deviance, 6) AS null_deviance, CAST(n_rows - 1 AS BIGINT) AS df_null,
               round(deviance + 2 * p.p, 6) AS aic, converged
        FROM summary, p, last_step""",
    ),
}
ORACLE["model_separated"] = " UNION ALL ".join(
    [
        _separated("city", "city_EUROPE", _fit(True, COEFFICIENTS, FEWER_CITIES, parted="city = 'EUROPE'")),
        _separated("base", "city_AFRICA", _fit(True, COEFFICIENTS, LATER_CITIES, parted="city = 'AFRICA'")),
        _separated(
            "light",
            "is_dark",
            _fit(True, COEFFICIENTS, parted="(city = 'EUROPE') = is_dark", dark=False),
        ),
    ]
)
ORACLE["model_margins"] = _with(
    STOPS,
    SUN,
    """SELECT is_dark, city, count(*) AS n, CAST(count(*) FILTER (is_black) AS DOUBLE) AS black
    FROM vod GROUP BY GROUPING SETS ((is_dark), (city))""",
)
ORACLE["model_estimates"] = (
    "SELECT estimate, std_error, FALSE AS by_city FROM ("
    + ORACLE["model_base"]
    + ") WHERE term = 'is_dark' UNION ALL SELECT estimate, std_error, TRUE FROM ("
    + ORACLE["model_city"]
    + ") WHERE term = 'is_dark'"
)
