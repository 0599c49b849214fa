"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

import re

from ..functions import text as T


def re2(pattern: str) -> str:
    """A Java pattern in RE2 syntax, ready to stand in a SQL string."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


SPACE = re2(T.SPACE)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{re2(pattern)}', '{to}', 'g')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{re2(pattern)}')"
