"""Many literals in one pass: against a search for each, and every rule met and missed in the made inputs."""

import random
import time

from pyspark.sql import functions as F

from tracewell.functions import literals as L
from tracewell.functions import rules, text
from tracewell.plans import inputs


def plain(t, table):
    return [n for n, x in enumerate(table) if t is not None and (x in t.lower() if x == x.lower() else x in t)]


def test_one_pass_finds_what_each_search_finds():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB ") for _ in range(n))
    for _ in range(200):
        table = tuple([word(rng.randrange(1, 5)) for _ in range(12)] + ["ab", "ab", "É", "é", ""][: rng.randrange(6)])
        t = rng.choice([None, "", word(40), word(200) + " École É"])
        assert L.met(t, table) == plain(t, table)
    assert L.met("x", ()) == []


def test_column_and_keywords(spark):
    df = spark.createDataFrame([("The MIT token",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(L.found(F.col("t"), ["mit", "MIT", "Mit", "tok"])).collect()] == [[0, 1, 3], [], []]
    assert [r[0] for r in df.select(text.keywords_in(F.col("t"), ["MIT", "nothing", "TOKEN"])).collect()] == [["MIT", "TOKEN"], [], None]


def test_cost_is_flat_in_the_number_of_literals():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(4000)]
    t = " ".join(rng.choice("klmnop") * 7 for _ in range(40_000))

    def took(table):
        L.met("", table)  # compiled before
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            L.met(t, table)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(tuple(words)) < 4 * took(tuple(words[:20]))


def test_categories_by_one_pass_equal_those_by_each_literal(spark):
    rows = [(i, f"line\n{p}\nend", c) for i, (p, c) in enumerate((p, c) for p in inputs.probes(rules.output_literals()) for c in ("pytest -q", "make x", None))]
    df = spark.createDataFrame(rows, "id int, output string, command string")
    null = F.lit(None)
    given = {"text": F.lit(""), "output": F.col("output"), "command": F.col("command"), "tool": F.lit("Edit"), "exit_code": null.cast("int"), "is_error": null.cast("boolean"), "abort_reason": null.cast("string"), "expected": null.cast("boolean")}
    one, each = rules.category(**given, held=L.found(F.col("output"), rules.output_literals())), rules.category(**given)
    got = df.select("id", *[c.alias(f"{k}{i}") for k, pair in (("one", one), ("each", each)) for i, c in enumerate(pair)]).collect()
    assert all((r["one0"], r["one1"]) == (r["each0"], r["each1"]) for r in got)
    met = {r["one0"] for r in got}
    assert met == {r.category for r in rules.OUTPUT_RULES} | {None}  # each rule is met, and some rows meet none


def test_every_literal_is_met_and_missed():
    table = tuple(rules.output_literals())
    for n, x in enumerate(table):
        assert n in L.met(f"a {x} b", table) and n not in L.met(f"a {inputs.near_miss(x)} b", table)
