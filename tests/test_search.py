"""Search by the index of grams and by a scan against plain Python."""

import random

import pytest

from tracewell.operators import search as S

FIELDS = ["title", "task", "id"]


def plain(rows, phrase):
    low, out = phrase.lower(), []
    for key, *values in rows:
        hits = [(f, v.lower().count(low), v[max(v.lower().find(low) - 60, 0) :][:120]) for f, v in zip(FIELDS, values, strict=True) if v is not None and low and low in v.lower()]
        if hits:
            # A snippet begins 60 characters before the match, or with the text.
            f, _, _ = hits[0]
            v = values[FIELDS.index(f)]
            at = max(v.lower().find(low) + 1 - 60, 1)
            out.append((key, sum(n for _, n, _ in hits), [f for f, _, _ in hits], v[at - 1 : at - 1 + 120]))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abAB .\\$") for _ in range(n))
    made = [(i, text(rng.randrange(0, 300)), text(30) if i % 3 else None, f"ID-{i % 10}") for i in range(120)]
    return [*made, (1000, "aaaaaaa", "x\\Ey", ""), (1001, None, None, None), (1002, "Née À l'ÉCOLE " * 30, "été", "q")]


@pytest.mark.parametrize("phrase", ["abA", "ab ab", "aaa", "ba.b", "a\\$", "\\Ey", "id-3", "école", "ab", "é", "", "not there at all", "b\\"])
def test_index_and_scan_equal_plain_search(spark, rows, phrase):
    df = spark.createDataFrame(rows, "key int, title string, task string, id string")
    want = plain(rows, phrase)
    told = lambda got: sorted((r["key"], r["matches"], r["fields"], r["snippet"]) for r in got.collect())
    assert told(S.scan(df, phrase, key="key", fields=FIELDS)) == want
    index = S.index(df, key="key", fields=FIELDS)
    assert told(S.lookup(index, S.counts(index), df, phrase, key="key", fields=FIELDS)) == want


def test_only_the_rarest_grams_are_looked_up(spark):
    df = spark.createDataFrame([(i, "common words " + ("with zebra" if i == 5 else "again")) for i in range(50)], "key int, title string")
    index = S.index(df, key="key", fields=["title"])
    held = S.rarest(S.counts(index), "words with zebra")
    assert len(held) == 2 and all(index.filter(f"gram = '{g}'").count() == 1 for _, g in held)
    assert [(r["key"], r["matches"]) for r in S.lookup(index, S.counts(index), df, "words with zebra", key="key", fields=["title"]).collect()] == [(5, 1)]
    assert S.index(df.limit(0), key="key", fields=["title"]).count() == 0
