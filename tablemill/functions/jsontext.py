"""Python helpers that rewrite or read one JSON text, for use in Arrow batches.

This module is shipped with the jobs that use it, so executors need not have the
package installed.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from json.encoder import encode_basestring, encode_basestring_ascii

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The mask, the sensitive JSON keys, the signs of a connection
# string, and what is replaced in one.
MASK = "*** MASKED ***"
SENSITIVE_KEYS = (
    "connectionString",
    "password",
    "pwd",
    "token",
    "secret",
    "apiKey",
    "access_token",
    "client_secret",
)
CONNECTION_SIGNS = ("Server=", "Data Source=", "mongodb://")
PASSWORD_PATTERN = r"(Password|Pwd)\s*=\s*[^;]+"
URI_PATTERN = r"(mongodb(?:\+srv)?://[^:]+:)([^@]+)(@[^/]+)"

# Ours: takes the password up to the last @ before the host.
STRICT_URI_PATTERN = r"(mongodb(?:\+srv)?://[^:/]+:)([^/]*)(@[^/@]+)"


def connection_masker(strict: bool):
    password = re.compile(PASSWORD_PATTERN, re.IGNORECASE)
    uri = re.compile(STRICT_URI_PATTERN if strict else URI_PATTERN, re.IGNORECASE)

    def connection(text: str) -> str:
        return uri.sub(rf"\g<1>{MASK}\g<3>", password.sub(rf"\g<1>={MASK}", text))

    return connection


class _Number(str):
    """A number as written, so that masking doesn't reprint it."""


class _Object(list):
    """An object as key-value pairs, so that a repeated key isn't lost."""


_SENSITIVE = frozenset(k.lower() for k in SENSITIVE_KEYS)
_SIGNS = tuple(s.lower() for s in CONNECTION_SIGNS)
_LITERALS = {None: "null", True: "true", False: "false"}


_HALF_PAIR = re.compile("[\ud800-\udfff]")


def _quote(text: str) -> str:
    """A JSON string; half of a surrogate pair stays an escape, as UTF-8 has no form for it."""
    if text.isascii() or not _HALF_PAIR.search(text):
        return encode_basestring(text)
    return encode_basestring_ascii(text)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _text_of(node) -> str:
    return node if isinstance(node, str) else _emit(node, None)


def _emit(node, connection) -> str:
    """Compact JSON of a node; with ``connection`` given, sensitive keys are masked."""
    if isinstance(node, _Object):
        parts = []
        for key, value in node:
            if connection is None or key.lower() not in _SENSITIVE:
                parts.append(f"{_quote(key)}:{_emit(value, connection)}")
                continue
            shown = MASK
            if value is not None:
                text = _text_of(value)
                if any(sign in text.lower() for sign in _SIGNS):
                    shown = connection(text)
            parts.append(f"{_quote(key)}:{_quote(shown)}")
        return "{" + ",".join(parts) + "}"
    if isinstance(node, list):
        return "[" + ",".join(_emit(v, connection) for v in node) + "]"
    if isinstance(node, _Number):
        return node
    return _quote(node) if isinstance(node, str) else _LITERALS[node]


def json_masker(strict: bool = False) -> Callable[[str | None], str | None]:
    """A function that masks one text; text that is no JSON comes back as it is."""
    connection = connection_masker(strict)
    decode = json.JSONDecoder(
        object_pairs_hook=_Object,
        parse_int=_Number,
        parse_float=_Number,
        parse_constant=_no_constant,
    ).decode

    def mask(text: str | None) -> str | None:
        if text is None or not text.lstrip().startswith(("{", "[")):
            return text
        try:
            return _emit(decode(text), connection)
        except (ValueError, RecursionError):
            return text

    return mask
