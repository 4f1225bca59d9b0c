"""Masking of secrets in connection strings and JSON text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tablemill.functions.jsontext import (
    MASK,
    PASSWORD_PATTERN,
    STRICT_URI_PATTERN,
    URI_PATTERN,
    json_masker,
)


def mask_connection_string(text: Column, strict: bool = False) -> Column:
    """Passwords in a connection string replaced by the mask.

    By default a URI password that holds an ``@`` is masked up to its first ``@``
    only; ``strict`` masks all of it.
    """
    uri = STRICT_URI_PATTERN if strict else URI_PATTERN
    first = F.regexp_replace(text, f"(?i){PASSWORD_PATTERN}", f"$1={MASK}")
    return F.regexp_replace(first, f"(?i){uri}", f"$1{MASK}$3")


def mask_json(text: Column, strict: bool = False) -> Column:
    """JSON text with the values of sensitive keys masked, at any depth, as compact JSON.

    Text that is no JSON stays as it is. No built-in rewrites JSON of unknown
    shape, so this runs in Python over Arrow batches.
    """

    @F.pandas_udf(T.StringType())
    def mask(values: pd.Series) -> pd.Series:
        return values.map(json_masker(strict), na_action="ignore")

    return mask(text)
