"""Engagement counts kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest magnitude that is counted; the exact decimals below hold sums of such numbers.
LARGEST = 1e20
AMOUNT = "decimal(30,8)"


def engagement_numbers(json: Column, keys: tuple[str, ...] = ("score", "comments")) -> Column:
    """Array of the JSON numbers under ``keys``; whatever is no number counts 0.

    NULL, text that is not one whole JSON object (cut off, followed by anything, an array, a repeated
    key), strings, booleans, NaN, infinities and magnitudes from 1e20 on count 0.
    """
    # In a list of its own, text behind the object is a second element or no JSON at all.
    listed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))

    def of(parsed: Column, key: str) -> Column:
        held = F.try_variant_get(parsed, f"$[0].{key}", "variant")
        value = F.try_variant_get(parsed, f"$[0].{key}", "double")
        numeric = F.schema_of_variant(held).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
        return F.when(numeric & F.try_variant_get(parsed, "$[1]", "variant").isNull() & (F.abs(value) < LARGEST), value).otherwise(F.lit(0.0))

    # The variable of the lambda holds what was parsed, so that no reader of a part parses the text again.
    return F.transform(F.array(listed), lambda parsed: F.array(*[of(parsed, k) for k in keys]))[0]


def engagement_value(json: Column, keys: tuple[str, ...] = ("score", "comments")) -> Column:
    """Sum of the JSON numbers under ``keys`` as a double, from left to right."""
    numbers = engagement_numbers(json, keys)
    return F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)


def engagement_amount(json: Column, keys: tuple[str, ...] = ("score", "comments")) -> Column:
    """The same sum as an exact decimal, so that running sums come back to exactly 0."""
    return F.aggregate(engagement_numbers(json, keys), F.lit(0).cast(AMOUNT), lambda acc, x: (acc + x.cast(AMOUNT)).cast(AMOUNT))
