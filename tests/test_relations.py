"""Relations of records against the rules, pair by pair."""

import random

import pytest

from textloom.operators import relations as R

SCHEMA = "id int, source string, ncid string, isbns array<string>, title string, authors array<string>, year int, publisher string"


def brute(rows):
    out = {}
    for i, s, n, isbns, t, authors, y, p in rows:
        found = set()
        for i2, s2, n2, isbns2, t2, authors2, y2, p2 in rows:
            if i == i2:
                continue
            if s and s == s2:
                found.add(0)
            elif n and n == n2 or set(isbns or []) & set(isbns2 or []):
                found.add(1)
            elif t and t == t2:
                shared = set(authors or []) & set(authors2 or [])
                differ = y is not None and y2 is not None and y != y2 or p is not None and p2 is not None and p != p2
                found.add(2 if shared and differ else 3 if authors and authors2 and not shared else 4)
        out[i] = R.RULES[min(found)] if found else "UNIQUE_RECORD"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_statuses_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, *values: rng.choice(values) if rng.random() < p else None
    few = lambda p, letters: rng.sample(letters, rng.randint(1, 3)) if rng.random() < p else rng.choice([None, []])
    rows = [
        (k, f"s{k if rng.random() < 0.9 else 0}", pick(0.05, "n1", "n2", ""), [f"i{rng.randint(0, 40)}"] if rng.random() < 0.15 else None, pick(0.9, *[f"t{j}" for j in range(12)]), few(0.8, "abcdefg"), pick(0.5, 1990, 1990, 1991), pick(0.5, "x", "x", "x", "y"))
        for k in range(120)
    ]
    got = {r["id"]: r["status"] for r in R.relations(spark.createDataFrame(rows, SCHEMA), "id", "source", ["ncid", "isbns"], "title", "authors", "year", "publisher").collect()}
    assert got == brute(rows)
    assert len(set(got.values())) >= 5


def test_a_block_is_a_star(spark):
    """A title that 3,000 records share: as many rows of membership, no pairs."""
    records = spark.range(3000).selectExpr("cast(id AS int) id", "'s' || id source", "cast(NULL AS string) ncid", "array(cast(id % 7 AS string), 'i' || id) isbns", "'t' title", "array('a') authors", "2000 year", "'p' publisher")
    rows = R.membership(records, "id", "source", ["ncid", "isbns"], "title")
    assert {(r["key"], r["count"]) for r in rows.groupBy("key").count().collect()} == {("title", 3000), ("isbns", 3000)}
    assert {(r["value"], r["leader"], r["members"]) for r in rows.where("key = 'isbns'").select("value", "leader", "members").distinct().collect()} == {(str(k), k, 3000 // 7 + (k < 3000 % 7)) for k in range(7)}
    statuses = R.relations(records.drop("isbns").selectExpr("*", "array('i' || id) isbns"), "id", "source", ["ncid", "isbns"], "title", "authors", "year", "publisher")
    assert [tuple(r) for r in statuses.groupBy("status").count().collect()] == [("UNCERTAIN_RELATIONSHIP", 3000)]
    assert R.relations(records.limit(0), "id", "source", ["ncid"], "title", "authors", "year", "publisher").count() == 0
