"""Names, labels and points that results have to agree on."""

from __future__ import annotations

# Texts read as missing in a stop or census file.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The columns every city table is brought to.
STOP_COLUMNS = (
    "date",
    "time",
    "lat",
    "lng",
    "subject_age",
    "subject_sex",
    "subject_race",
    "type",
    "outcome",
    "search_conducted",
    "contraband_found",
)
ROW_NUMBER = "raw_row_number"

# Headings given to a saved row index by the usual CSV readers.
INDEX_COLUMNS = ("Unnamed: 0", "_c0", "X1", "...1")

# Columns a stop must have to be counted at all.
KEY_COLUMNS = ("date", "subject_race", "type", "city")

# Labels put on unknown values in reports.
UNKNOWN_TEXT = "N/A"
UNKNOWN_NUMBER = -1
LABELLED_TEXT_COLUMNS = (
    "contraband_found",
    "search_conducted",
    "lat",
    "lng",
    "time",
    "subject_sex",
    "outcome",
)
LABELLED_NUMBER_COLUMNS = ("subject_age", "hour")

# Groups compared in the reports.
PROFILE_RACES = {
    "hispanic": "hispanic",
    "black": "black",
    "white": "white",
    "asian/pacific islander": "asian_pacific_islander",
}
RATE_RACES = ("black", "hispanic", "white")
UNLISTED_RACES = ("other", "unknown")
SEXES = {"male": "male", "female": "female"}

# Census fact headings and the column each becomes.
CENSUS_TOTAL = "Population, Census, April 1, 2010"
CENSUS_PERCENTS = {
    "Female persons, percent": "female",
    "Black or African American alone, percent": "black",
    "Hispanic or Latino, percent": "hispanic",
    "White alone, not Hispanic or Latino, percent": "white",
}
CENSUS_HEADING = " city, California"
CENSUS_NOTE = "Value Note for "

# City centre, latitude and longitude in degrees, and time zone.
CITY_POINTS = (
    ("Bakersfield", 35.3733, -119.0187, "America/Los_Angeles"),
    ("Los Angeles", 34.0522, -118.2437, "America/Los_Angeles"),
    ("Oakland", 37.8044, -122.2712, "America/Los_Angeles"),
    ("San Diego", 32.7157, -117.1611, "America/Los_Angeles"),
    ("San Francisco", 37.7749, -122.4194, "America/Los_Angeles"),
    ("San Jose", 37.3382, -121.8863, "America/Los_Angeles"),
)

# Fixed value: normal quantile of the interval between two rates.
INTERVAL_Z = 2.58

# The quarter hour shown as an example, in seconds of the day.
EXAMPLE_WINDOW = (18 * 3600 + 30 * 60, 18 * 3600 + 45 * 60)
