"""Inputs of the rule queries: texts of the tables crossed with what rules look for, and with near misses of it.

A row's probe goes by its key, and stands in the middle of the row's own text. What
a rule then says of it is not known here: the queries and their SQL both read the
made text, and both take the rules from the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def near_miss(literal: str) -> str:
    """The literal without the character in its middle."""
    return literal[: len(literal) // 2] + literal[len(literal) // 2 + 1 :]


def probes(literals: Sequence[str]) -> list[str]:
    """Each literal as it stands, in capitals, in lower case and missed by a character, and nothing at all."""
    return [y for x in literals for y in (x, x.upper(), x.lower(), near_miss(x))] + [""]


def chosen(key: str, values: Sequence[object], step: int = 1) -> Column:
    """One of ``values`` by a key of whole numbers."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(F.col(key) / step), F.lit(len(values))).cast("int"))


def chosen_sql(key: str, values: Sequence[object], step: int = 1) -> str:
    said = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else quoted(v) for v in values)
    return f"([{said}])[({key} // {step}) % {len(values)} + 1]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def amid(text: str, probe: Column) -> Column:
    """The probe as a line of its own in the middle of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), half), F.lit("\n"), probe, F.lit("\n"), F.substring(t, half + 1, F.length(t)))


def amid_sql(text: str, probe: str) -> str:
    t = f"coalesce({text}, '')"
    return f"substr({t}, 1, length({t}) // 2) || chr(10) || {probe} || chr(10) || substr({t}, length({t}) // 2 + 1)"


def holds_sql(column: str, literal: str) -> str:
    """A literal in lower case is met in any case, another as it stands."""
    return f"contains(lower({column}), {quoted(literal)})" if literal == literal.lower() else f"contains({column}, {quoted(literal)})"
