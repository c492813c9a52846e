"""Search for a phrase in any case over named fields: by an index of grams with their places, or by a scan.

The index holds each run of three characters of each field with its places. A
phrase is looked up by the few of its grams that are rarest in the table, whose
places must lie as far apart as in the phrase; what is left is verified against
the text, so only texts that hold the rarest grams in the right places are read.
A phrase under three characters has no gram and is met by a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, grams of a phrase that are looked up, and characters shown before the first match and in all.
GRAM, LOOKED_UP, BEFORE, SHOWN = 3, 2, 60, 120


def by_field(rows: DataFrame, *, key: str, fields: Sequence[str]) -> DataFrame:
    """key, place (of the field in ``fields``), field and value (as text) of what is filled."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return rows.select(key, F.explode(each).alias("f")).select(key, "f.*").filter(F.col("value").isNotNull())


def index(rows: DataFrame, *, key: str, fields: Sequence[str]) -> DataFrame:
    """gram, key, field and places (from 1, rising) of every field in lower case."""
    low = F.lower(F.col("value"))
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.struct(F.substring(low, i, F.lit(GRAM)).alias("gram"), i.alias("at")))
    long_enough = by_field(rows, key=key, fields=fields).filter(F.length(low) >= GRAM)
    each = long_enough.select(key, "field", F.explode(grams).alias("g"))
    return each.groupBy(F.col("g.gram").alias("gram"), key, "field").agg(F.array_sort(F.collect_list("g.at")).alias("places"))  # the places of one gram in one field


def counts(index_: DataFrame) -> DataFrame:
    """gram and n: in how many fields it stands; kept beside the index, it tells which grams are rare."""
    return index_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def rarest(counts_: DataFrame, phrase: str, most: int = LOOKED_UP) -> list[tuple[int, str]]:
    """(offset, gram) of the rarest grams of a phrase; empty if it is too short, one that stands nowhere coming first."""
    low = phrase.lower()
    grams: dict[str, int] = {}
    for i in range(len(low) - GRAM + 1):
        grams.setdefault(low[i : i + GRAM], i)
    held = {r["gram"]: r["n"] for r in counts_.filter(F.col("gram").isin(*grams)).collect()} if grams else {}  # at most one row a gram of the phrase
    return [(grams[g], g) for g in sorted(grams, key=lambda g: (held.get(g, 0), grams[g]))[:most]]


def told(hits: DataFrame, phrase: str, *, key: str) -> DataFrame:
    """key, matches in all fields (each begins after the one before it has ended), the fields met in their order, and the surroundings of the first match. hits: key, place, field and value."""
    low, value = phrase.lower(), F.lower(F.col("value"))
    pieces = F.split(value, "\\Q" + low.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    shown = F.substring(F.col("value"), F.greatest(F.instr(value, low) - BEFORE, F.lit(1)), F.lit(SHOWN))
    met = hits.select(key, F.struct("place", "field", (F.size(pieces) - 1).alias("n"), shown.alias("snippet")).alias("hit"))
    all_ = met.groupBy(key).agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # at most one a field
    return all_.select(key, F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["n"]).alias("matches"), F.transform("hits", lambda h: h["field"]).alias("fields"), F.element_at("hits", 1)["snippet"].alias("snippet"))


def scan(rows: DataFrame, phrase: str, *, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the phrase in a field, as ``told``, by reading all of them. An empty phrase is met nowhere."""
    low = phrase.lower()
    values = by_field(rows, key=key, fields=fields).filter(F.lower("value").contains(low) & F.lit(bool(low)))
    return told(values, phrase, key=key)


def lookup(index_: DataFrame, counts_: DataFrame, rows: DataFrame, phrase: str, *, key: str, fields: Sequence[str]) -> DataFrame:
    """The same as ``scan`` by the index of ``rows`` over ``fields``."""
    low, grams = phrase.lower(), rarest(counts_, phrase)
    if not grams:
        return scan(rows, phrase, key=key, fields=fields)
    begun = lambda offset: F.transform("places", lambda p: p - F.lit(offset))
    looked = [index_.filter(F.col("gram") == g).select(key, "field", begun(offset).alias(f"_s{n}")) for n, (offset, g) in enumerate(grams)]
    met = reduce(lambda a, b: a.join(b, [key, "field"]), looked)
    starts = reduce(F.array_intersect, [F.col(f"_s{n}") for n in range(len(looked))])
    placed = met.select(key, "field", F.filter(starts, lambda i: i > 0).alias("_starts")).filter(F.size("_starts") > 0)
    values = by_field(rows, key=key, fields=fields).join(placed, [key, "field"])
    right = F.exists("_starts", lambda i: F.substring(F.lower(F.col("value")), i, F.lit(len(low))) == low)
    return told(values.filter(right).drop("_starts"), phrase, key=key)
