import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from forgetide.operators import commits as C
from forgetide.operators import jobs
from forgetide.operators.ordinals import ordinal

SCHEMA = "project string, sha string, parents array<string>, author_email string, committer_email string, committed_date timestamp"


def commit(sha, parents, who, day, project="p"):
    return (project, sha, parents, who, who, dt.datetime(2020, 1, 1) + dt.timedelta(days=day))


def test_mainline_of_a_long_history(spark):
    rows = [commit(f"s{i:03d}", [f"s{i - 1:03d}", f"x{i}"] if i else [], "a", i) for i in range(300)]
    rows += [commit(f"x{i}", [f"s{i - 1:03d}"], "b", i) for i in range(1, 300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    heads = C.newest_heads(frame.filter("sha LIKE 's%'"))
    line = {r.ix: r.sha for r in C.mainline(frame, heads).collect()}
    assert line == {i: f"s{299 - i:03d}" for i in range(300)}


@pytest.mark.parametrize(("block_rows", "shuffled"), [(7, False), (7, True), (40, True), (1 << 16, True)])
def test_mainlines_over_any_blocks(spark, block_rows, shuffled):
    """Three histories, one with side branches, one whose oldest parent has no row; times in order or not."""
    rng, rows, want = random.Random(block_rows), [], {}
    for project, n in (("p", 60), ("q", 25), ("lone", 1)):
        days = rng.sample(range(1000), n) if shuffled else list(range(n))
        for i in range(n):
            up = [f"s{i - 1}"] if i else (["gone"] if project == "q" else [])
            rows.append(commit(f"s{i}", up + [f"x{i}"], "a", days[i], project) if up else commit(f"s{i}", [], "a", days[i], project))
            rows.append(commit(f"x{i}", [f"s{i - 1}"] if i > 1 else [], "b", days[i], project))
            want[project, f"s{i}"] = n - 1 - i
    want["q", "gone"] = 25
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    heads = spark.createDataFrame([("p", "s59"), ("q", "s24"), ("lone", "s0")], "project string, sha string")
    got = C.mainline(frame, heads, block_rows).collect()
    assert len(got) == len(want) and {(r.project, r.sha): r.ix for r in got} == want
    assert {(r.project, r.sha): r.ix for r in C.mainline(frame.drop("committed_date"), heads, block_rows).collect()} == want


def test_mainline_of_a_hundred_thousand_commits(spark, monkeypatch):
    """The list between blocks is short, so a few rounds do whatever the length of the line."""
    n, rounds, inner = 100_000, [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: rounds.append(1) or inner(df))
    frame = spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("s"), "id").alias("sha"), F.when(F.col("id") > 0, F.array(F.concat(
        F.lit("s"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"), F.timestamp_seconds(F.col("id") * 60).alias(
        "committed_date")).orderBy(F.xxhash64("sha"))
    heads = spark.createDataFrame([("p", f"s{n - 1}")], "project string, sha string")
    line = C.mainline(frame, heads, 10_000)
    assert line.filter(F.concat(F.lit("s"), F.lit(n - 1) - F.col("ix")) == F.col("sha")).count() == n == line.count()
    assert len(rounds) <= 13  # the jump table over all commits took 36


@pytest.mark.parametrize("parts", [1, 4, 31])
def test_ordinals_of_one_group(spark, parts):
    rng = random.Random(1)
    data = [("p", rng.choice([1, 2, 2, 2, 3]), rng.randrange(3), f"{rng.randrange(10)}{i:03d}") for i in range(200)]
    df = spark.createDataFrame(data, "g string, a int, b int, tie string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = ordinal(df, ["g"], [F.asc("a"), F.desc("b"), F.asc("tie")]).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [r.ordinal for r in out] == list(range(200))
    assert [r.tie for r in out] == [d[3] for d in sorted(data, key=lambda d: (d[1], -d[2], d[3]))]


def test_undated_commits_are_numbered_last(spark):
    rows = [commit("b", [], "a", 1), commit("a", [], "a", 1), commit("c", [], "a", 2),
            ("p", "z", [], "a", "a", None), ("p", "y", [], "a", "a", None)]
    out = {r.ix: r.sha for r in C.newest_first(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: "c", 1: "a", 2: "b", 3: "y", 4: "z"}


def test_merges_of_own_work_do_not_count(spark):
    rows = [commit("r", [], "ann", 0), commit("a1", ["r"], "ann", 1), commit("b1", ["r"], "bob", 1),
            commit("m1", ["a1", "b1"], "ann", 2), commit("m2", ["a1", "r"], "ann", 3),
            commit("m3", ["a1", "gone"], "ann", 4), commit("m4", ["a1", "r", "b1"], "ann", 5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.sha for r in C.coordinating_merges(frame).collect()) == ["m1", "m3"]


def test_aliases_apply_to_merges(spark):
    rows = [commit("r", [], "ann", 0), commit("a", ["r"], "ann@x", 1), commit("m", ["r", "a"], "ann", 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    names = spark.createDataFrame([("ann@x", "ann")], "alias string, canonical string")
    assert C.coordinating_merges(C.resolved(frame, names)).count() == 0


def test_path_classes(spark):
    paths = ["a/test/x.py", "testing/x.py", "spec", "lib/tests.rb", "tests/a"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = frame.select("path", *[e.alias(n) for n, e in C.path_classes("path").items()]).collect()
    assert [r.path for r in rows if r.is_test] == ["a/test/x.py", "spec", "tests/a"]
    assert [r.path for r in rows if r.is_py] == ["a/test/x.py", "testing/x.py"]


def test_report(spark):
    rows = [commit("r", [], "ann", 0), commit("b", ["r"], "bob", 40), commit("q", [], "cy", 70, "other")]
    frame = spark.createDataFrame(rows, SCHEMA)
    files = spark.createDataFrame([("p", "r", "a.py"), ("p", "r", "test/b.rb"), ("p", "b", "a.py")],
                                  "project string, sha string, path string")
    names = spark.createDataFrame([], "alias string, canonical string")
    out = {(r.project, r.period): r for r in jobs.periodic_report(frame, files, names).collect()}
    assert sorted(out) == [(p, q) for p in ("other", "p") for q in ("202001", "202002", "202003", "total")]
    row = out["p", "202002"]
    assert (row.commits_recheck, row.arriving_commit_authors_email, row.leaving_commit_authors_email) == (1, 1, 1)
    assert [out["p", q].num_files_existing for q in ("202001", "202002", "202003", "total")] == [2, 1, 1, 2]
    assert out["other", "202001"].num_files_existing == 0
    assert out["p", "total"].arriving_commit_authors_email == 2


def test_report_sorts_no_members_and_no_files(spark):
    """Stays are hashed, and files are counted before a join: neither sorts one row for each commit or file to aggregate."""
    rows = spark.createDataFrame([("p", "s1", "202401", dt.datetime(2024, 1, 15), "a", "c"), ("p", "s2", "202403", dt.datetime(2024, 3, 15), "a", None),
                                  ("p", "s3", None, None, None, "c")],
                                 "project string, sha string, period string, start timestamp, author_email string, committer_email string")
    stays = C.stays(rows, rows.limit(0))
    moves = {(r.measure, r.period): r.n for r in C.member_moves(stays, ["commit_authors_email"], "month").collect()}
    assert moves == {("arriving_commit_authors_email", "202401"): 1, ("arriving_commit_authors_email", None): 1,
                     ("arriving_commit_authors_email", "total"): 2, ("leaving_commit_authors_email", "202403"): 1,
                     ("leaving_commit_authors_email", None): 1, ("leaving_commit_authors_email", "total"): 2}
    assert "SortAggregate" not in stays._jdf.queryExecution().executedPlan().toString()
    commits = spark.createDataFrame([("p", "s1", dt.datetime(2024, 1, 15)), ("p", "s2", dt.datetime(2024, 1, 15))], "project string, sha string, committed_date timestamp")
    files = spark.createDataFrame([("p", "s2", "a/test/b.py"), ("p", "s2", "test"), ("p", "s2", "a/tests.rb"), ("p", "s2", None), ("p", "s1", "x")],
                                  "project string, sha string, path string")
    found = C.file_snapshot(commits, files)
    assert sorted(tuple(r) for r in found.collect()) == [("p", "202401", 4, 1, 1, 2), ("p", "total", 4, 1, 1, 2)]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
