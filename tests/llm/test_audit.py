"""The filter audit against orders applied one by one, and its edges."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from gradelake.llm import audit
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, mask int, part string, digest string, own int, "
    "first long, total long, n_1 long, step int"
)
EXTRA = (9, "p", "d", 1, 2, 3, 4, 5)


def plain(docs, labels):
    """(part, order, step) -> the seven counts, by applying every order to every document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    texts = [(i, t or "", p or "") for i, t, p in docs]

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = set()
        if len(words) < 100:
            found.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            found.add("C")
        if re.search(r"[#$%&*|]", t):
            found.add("D")
        if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts):
            found.add("E")
        return found

    judged = [(i, p, fails(i, t)) for i, t, p in texts]
    result, removals = {}, {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in mine)
                result[part, order, step] = [
                    len(left), len(gone), failing - len(gone),
                    sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                key = (part, letter)
                removals[key] = removals.get(key, 0) + len(gone)
    for (part, order, step), row in result.items():
        row.append(removals[part, order[step - 1]])
    return result


def found(rows):
    return {
        (r["part"], r["filter_order"], r["step"]): [
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
            r["toxic_lost"], r["shapley"],
        ]
        for r in rows
    }


@pytest.fixture(scope="module")
def odd():
    many = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, many, "en"), (5, many, "en"),
        (5, many, "en"), (6, many + " #", ""), (7, "A " * 200, "fr"), (8, "A " * 200, None),
        (None, many, "en"), (9, many.upper(), "fr"), (10, "x | y", "fr"), (11, many * 300, "en"),
        (12, "\xa0".join("ab" for _ in range(150)), "en"), (12, "other", "en"),
    ]
    labels = [(4, 1, 0), (4, 0, 0), (5, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (1, 0, 1)]
    return rows, labels


def test_orders(spark, odd):
    rows, labels = odd
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    result = audit.audit(docs, marks).collect()
    assert len(result) == 3 * 600
    assert found(result) == plain(rows, labels)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in result)


def test_no_rows(spark, odd):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in odd[0]], SCHEMA).where("doc_id > 1000")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, marks).count() == 0


def test_other_numbers_of_filters(spark):
    """The potential gives the Shapley value for any number of filters."""
    rows = [("p", m, 1, 0) for m in (1, 1, 2, 3, 3, 3, 0, 7, 4, 5)]
    masks = spark.createDataFrame(rows, "part string, mask int, good int, toxic int")
    result = audit.interactions(masks, "XYZ").collect()
    assert len(result) == 6 * 3
    for letter in "XYZ":
        mine = [r for r in result if r["filter"] == letter]
        assert {r["shapley"] for r in mine} == {sum(r["removed"] for r in mine)}
        assert sum(r["good_lost"] for r in mine) == mine[0]["shapley"]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_against_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert compare(spark, duck(folder), audit.op13, audit.ORACLE, folder) == []
