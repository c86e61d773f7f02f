"""Missing-value tokens and census number texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from duskline.fixed import CENSUS_HEADING, NULL_TOKENS


def blank_to_null(
    df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, but: Sequence[str] = ()
) -> DataFrame:
    """Turn every missing-value token in a text column into a null, but in the columns of ``but``."""
    listed = ", ".join("'" + token.replace("\\", "\\\\").replace("'", "\\'") + "'" for token in tokens)
    columns = []
    for field in df.schema.fields:
        name = "`" + field.name.replace("`", "``") + "`"
        is_text = isinstance(field.dataType, T.StringType) and field.name not in but
        columns.append(f"if({name} IN ({listed}), NULL, {name}) AS {name}" if is_text else name)
    return df.selectExpr(*columns)


def read_as(text: Column, kind: str, strict: bool = True) -> Column:
    """``text`` as ``kind``. A text that is none stops the job, whatever the session's ANSI
    mode; with ``strict=False`` it becomes null."""
    value = text.try_cast(kind)
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(kind)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(bad)


def count_from_text(text: Column, strict: bool = True) -> Column:
    """``1,234`` as 1234.0."""
    return read_as(F.replace(text, F.lit(","), F.lit("")), "double", strict)


def people_from_percent(text: Column, total: Column, strict: bool = True) -> Column:
    """``12.3%`` of a total, as a number of people that is not rounded."""
    return read_as(F.rtrim(text, F.lit("%")), "double", strict) / 100 * total


def city_from_heading(heading: Column) -> Column:
    return F.regexp_replace(heading, CENSUS_HEADING + "$", "")
