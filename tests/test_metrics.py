import random
from collections import defaultdict

import pytest

from forgetide.operators import metrics as M


def cube(spark, rows, schema="project string, period string, member long"):
    return spark.createDataFrame(rows, schema)


def as_dict(df, *values):
    return {(r.project, r.period): tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    return [(f"p{rng.randint(0, 3)}", f"2024{rng.randint(1, 6):02d}", rng.randint(0, 9)) for _ in range(120)]


def test_arrivals_and_departures_add_up(spark, sample):
    df = cube(spark, sample)
    users = as_dict(M.count_unique(df), "n")
    for frame, name, pick in ((M.arrivers(df), "arrivers", min), (M.leavers(df), "leavers", max)):
        found, edge = as_dict(frame, name), defaultdict(dict)
        for project, period, member in sample:
            edge[project][member] = pick(period, edge[project].get(member, period))
        for project, members in edge.items():
            assert found[project, "total"] == users[project, "total"] == len(members)
            assert sum(n for (p, q), n in found.items() if p == project and q != "total") == len(members)
            for period in set(members.values()):
                assert found[project, period] == list(members.values()).count(period)


def test_sums_maxima_and_last(spark):
    rows = [("a", "1", 3, 1), ("a", "1", -5, 2), ("a", "2", 4, 3), ("a", "2", 2, 4)]
    df = spark.createDataFrame(rows, "project string, period string, num int, seq int")
    assert as_dict(M.count_sum(df), "n") == {("a", "1"): 3, ("a", "2"): 6, ("a", "total"): 9}
    assert as_dict(M.count_max(df), "n") == {("a", "1"): 3, ("a", "2"): 4, ("a", "total"): 4}
    assert as_dict(M.count_last(df), "n") == {("a", "1"): 3, ("a", "2"): 6, ("a", "total"): 2}
    assert as_dict(M.count_average(df), "sum", "count", "avg")["a", "2"] == (6, 2, 3.0)


def test_a_null_period_is_not_the_total(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "1", 2)], "project string, period string, member int")
    rows = [(r.period, r.n) for r in M.count_unique(df).collect()]
    assert sorted(rows, key=str) == [("1", 1), ("total", 2), (None, 1)]


def test_running_tally(spark):
    rows = [("a", "1", 2, 0), ("a", "3", 0, 1), ("b", "2", 0, 3), ("b", "3", 5, 0)]
    df = spark.createDataFrame(rows, "project string, period string, o int, c int")
    got = as_dict(M.running_tally(df, "o", "c"), "opened", "closed")
    assert got == {("a", "1"): (2, 0), ("a", "2"): (2, 0), ("a", "3"): (1, 1), ("a", "total"): (1, 1),
                   ("b", "1"): (0, 0), ("b", "2"): (0, 3), ("b", "3"): (2, 3), ("b", "total"): (2, 3)}


def test_forward_fill(spark):
    rows = [("a", "2", 7), ("b", "1", 0), ("b", "3", 4)]
    df = spark.createDataFrame(rows, "project string, period string, n int")
    got = as_dict(M.forward_fill(df, "n", start=1), "n")
    assert got == {("a", "1"): 1, ("a", "2"): 7, ("a", "3"): 7, ("b", "1"): 0, ("b", "2"): 0, ("b", "3"): 4}


def test_measures_must_be_declared(spark):
    df = spark.createDataFrame([("a", "1", "x", 1)], "project string, period string, measure string, n int")
    assert M.wide(df, ["y", "x"]).columns == ["project", "period", "x", "y"]
    with pytest.raises(Exception, match="measure not declared: x"):
        M.wide(df, ["y"]).collect()


def test_report_keeps_all_periods_and_hides_zeroes(spark):
    rows = [("a", "1", "x", 1), ("a", "total", "x", 1), ("b", "2", "y", 5), ("b", "total", "y", 5)]
    df = spark.createDataFrame(rows, "project string, period string, measure string, n int")
    assert as_dict(M.report(df, ["x", "y", "z"], "^a"), "x", "y") == {
        ("a", "1"): (1, 0), ("a", "2"): (0, 0), ("a", "total"): (1, 0)}
    shown = M.report(df, ["x", "y", "z"], hide_zeroes=True)
    assert sorted(as_dict(shown, "x")) == [("a", "1"), ("a", "total")]


def test_totals_are_never_carried(spark):
    rows = [("a", "1", 1, 9), ("a", "total", 1, 9), ("b", "2", 2, None), ("b", "total", 2, None)]
    df = spark.createDataFrame(rows, "project string, period string, s int, f int")
    got = as_dict(M.filled(df, ["s"], ["f"]), "s", "f")
    assert got == {("a", "1"): (1, 9), ("a", "2"): (0, 9), ("a", "total"): (1, 9),
                   ("b", "1"): (0, 0), ("b", "2"): (2, 0), ("b", "total"): (2, 0)}
