"""Slugs, locator labels, JSON contracts and content addresses."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, prefix: str = "item", fold: bool = False) -> Column:
    """Lower-case ASCII words joined by hyphens; prefix and hash where nothing is left.

    With ``fold`` letters are decomposed (NFKD) first and what is not ASCII goes, so "Café" gives "cafe"
    and not "caf".  Text in ASCII has nothing to decompose and does not leave the JVM."""
    given = F.coalesce(text, F.lit(""))
    if fold:
        plain = F.when(given.rlike(r"^[\x00-\x7f]*$"), given).otherwise(F.regexp_replace(normal_form(given, "NFKD"), r"[^\x00-\x7f]", ""))
    else:
        plain = given
    bare = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(given, 256), F.lit(12)))).otherwise(bare)


def _span(first: Column, last: Column) -> Column:
    return F.when(F.coalesce(last, first) == first, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def locator_label(locator: Column) -> Column:
    """How a place in a source is shown: pages, file and fragment, or lines; null if it names none."""
    page, href, line, source = locator["physical_page_start"], locator["href"], locator["line_start"], locator["source_line_start"]
    return (
        F.when(page.isNotNull(), F.concat(F.lit("p. "), _span(page, locator["physical_page_end"])))
        .when(href.isNotNull(), F.concat(href, F.coalesce(F.concat(F.lit("#"), locator["fragment"]), F.lit(""))))
        .when(line.isNotNull(), F.concat(F.lit("lines "), _span(line, locator["line_end"])))
        .when(source.isNotNull(), F.concat(F.lit("lines "), _span(source, locator["source_line_end"])))
    )


class ContractError(ValueError):
    """JSON that breaks its contract."""


def strict_object(text: str) -> dict:
    """One JSON object: no other value, no repeated keys, nothing after it."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ContractError("repeated key")
        return dict(items)

    try:
        value = json.loads(text, object_pairs_hook=pairs)
    except json.JSONDecodeError as error:
        raise ContractError(str(error)) from error
    if not isinstance(value, dict):
        raise ContractError("not an object")
    return value


def repaired_object(text: str) -> dict:
    """A JSON object from a model's answer: fences, text around it and trailing commas are forgiven."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    start, end = body.find("{"), body.rfind("}")
    body = body[start : end + 1] if 0 <= start < end else body
    for attempt in (body, re.sub(r",(\s*[}\]])", r"\1", body), re.sub(r'([}\]"0-9el])(\s*\n\s*)"', r'\1,\2"', re.sub(r",(\s*[}\]])", r"\1", body))):
        try:
            return strict_object(attempt)
        except ContractError as error:
            problem = error
    raise problem


def is_strict_object(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        def good(value) -> bool:
            try:
                return value is not None and isinstance(strict_object(value), dict)
            except ContractError:
                return False

        return values.map(good).astype(bool)

    return check(text)


def normal_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normalisation, which the JVM's expressions lack."""

    @F.pandas_udf("string")
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normalise(text)
