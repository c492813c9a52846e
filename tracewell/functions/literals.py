"""Many literals in one pass over a text: an automaton compiled from a table of them, once for each worker.

A literal in lower case is met in any case, another as it stands. The cost of a
text does not grow with the number of literals, where a ``contains`` for each would
read the text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=16)
def compiled(literals: tuple[str, ...]):
    """(automaton of those met in any case, of the others); None for an empty one. Equal literals share a place."""
    import ahocorasick

    out = []
    for any_case in (True, False):
        machine = ahocorasick.Automaton()
        for n, x in enumerate(literals):
            if x and (x == x.lower()) is any_case:
                machine.add_word(x, [*machine.get(x, []), n])
        if len(machine):
            machine.make_automaton()
        out.append(machine if len(machine) else None)
    return out


def met(text: str | None, literals: tuple[str, ...]) -> list[int]:
    """Numbers of the literals that a text holds, rising. An empty literal is met in every text."""
    if text is None:
        return []
    low, exact = compiled(literals)
    got = {n for n, x in enumerate(literals) if not x}
    for machine, read in ((low, text.lower()), (exact, text)):
        if machine is not None:
            for _, numbers in machine.iter(read):
                got.update(numbers)
    return sorted(got)


def found(text: Column, literals: Sequence[str]) -> Column:
    """array<int>: numbers of the literals that ``text`` holds; empty for a null text."""
    table = tuple(literals)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: met(t, table))

    return F.pandas_udf(run, "array<int>")(text)
