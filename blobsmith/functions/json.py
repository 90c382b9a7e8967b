"""JSON as shown and as stored, and values left out of it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of the stored form, and what is shown for them.
SHOWN = ((r"\u0027", "'"), (r"\u0026", "&"), (r"\u003c", "<"), (r"\u003e", ">"), (r"\u002f", "/"))
_PARTS = re.compile(r'"(?:\\.|[^"\\])*"?|[{}\[\],:]|[^"{}\[\],:]+', re.DOTALL)
DEEPEST = 63


def indented(stored: str, spaces: int = 2) -> str:
    """One JSON text with an element a line; lines end as the archive's texts do."""
    for code, char in SHOWN:
        stored = stored.replace(code, char)
    out, depth = [], 0

    def fresh() -> str:
        return "\r\n" + " " * (spaces * max(0, min(depth, DEEPEST)))

    for part in _PARTS.findall(stored):
        if part in ("{", "["):
            depth += 1
            out += [part, fresh()]
        elif part in ("}", "]"):
            depth -= 1
            out += [fresh(), part]
        else:
            out.append(part + (fresh() if part == "," else " " if part == ":" else ""))
    return "".join(out)


@F.pandas_udf(T.StringType())
def pretty(stored: pd.Series) -> pd.Series:
    """JSON texts laid out over lines; empty for null."""
    return stored.map(lambda s: indented(s) if s else "")


def unpretty(shown: Column) -> Column:
    """The escapes of the stored form put back. Line breaks stay, as JSON allows them."""
    for code, char in SHOWN:
        shown = F.replace(shown, F.lit(char), F.lit(code))
    return shown


def unless(value: Column, *, empty: bool = False, zero: bool = False, always: bool = False) -> Column:
    """The value, or null where a rule leaves it out. Empty is for texts, zero for numbers.

    to_json drops properties that are null, unless its option ignoreNullFields is off.
    """
    out = F.lit(always)
    if empty:
        out = out | F.coalesce(F.length(value) == 0, F.lit(False))
    if zero:
        out = out | F.coalesce(value == 0, F.lit(False))
    return F.when(out, None).otherwise(value)


def ordered_object(columns: list[str], first: tuple[str, ...] = ()) -> Column:
    """A struct of columns whose fields come in the order of `first`, the rest by code point."""
    rank = {name: i for i, name in enumerate(first)}
    return F.struct(*sorted(columns, key=lambda c: (rank.get(c, len(rank)), c)))
