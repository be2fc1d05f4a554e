"""Stored keyed tables: what a batch reads, replaces and leaves alone."""

import json
import random

import pytest
from pyspark.sql import functions as F

from forgetide.operators import jobs, landing
from forgetide.sources import store
from forgetide.sources.keyed import FAN, BucketStore, KeyedTable, whole_records

SHAPE = "owner string, number int, at long, body string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SHAPE)


def opened(spark, tmp_path, **kw):
    return KeyedTable.open(spark, str(tmp_path / "t"), rows(spark).schema, ["owner", "number"], **kw)


def folders(frame):
    return {name.rsplit("/", 2)[0].rsplit("/", 1)[1] + "/" + name.rsplit("/", 2)[1] for name in frame.inputFiles()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_the_whole_upsert(spark, tmp_path, seed):
    rng, table, known = random.Random(seed), opened(spark, tmp_path, buckets=4), {}
    assert table.read().count() == 0
    for n in range(4):
        batch = [(rng.choice(["a", "b", None]), rng.choice([*range(6), None]), rng.randrange(100), f"{n}-{i}") for i in range(15)]
        table.merge(rows(spark, *batch), ["at", "body"])
        last = {}
        for r in sorted(batch, key=lambda r: (r[2], r[3])):
            last[r[:2]] = r
        known |= last
        assert sorted(map(tuple, table.read().collect()), key=str) == sorted(known.values(), key=str)
    assert sorted(map(str, table.lookup(owner=None, number=None).collect())) == sorted(
        str(r) for r in table.read().collect() if r.owner is None and r.number is None)


def test_only_touched_buckets_are_opened(spark, tmp_path):
    table = opened(spark, tmp_path, buckets=16)
    table.merge(rows(spark, *[("o", i, 0, "old") for i in range(200)]), ["at"])
    before, batch = table.state().folders, rows(spark, ("o", 7, 1, "new"), ("o", 900, 1, "new"))
    touched = set(table.buckets_of(batch))
    table.merge(batch, ["at"])
    after = table.state().folders
    assert {b for b in after if after[b] != before[b]} == touched and 1 <= len(touched) <= 2 < len(after)
    assert {f.split("bucket=")[1] for f in folders(table.rows_of(batch))} == {str(b) for b in touched}
    assert len(folders(table.lookup(owner="o", number=7))) == 1
    assert table.lookup(owner="o", number=7).first().body == "new" and table.read().count() == 201
    assert not [f for f in folders(table.rows_of(batch)) if f.split("/")[0] in {x for held in before.values() for _, x in held}]


def test_a_failed_or_repeated_attempt_changes_nothing(spark, tmp_path, monkeypatch):
    table = opened(spark, tmp_path, buckets=2)
    table.merge(rows(spark, ("o", 1, 0, "first")), ["at"], token="one")

    def fail(state):
        raise OSError("lost before the manifest")
    with monkeypatch.context() as broken:
        broken.setattr(table, "_commit", fail)
        with pytest.raises(OSError, match="lost"):
            table.merge(rows(spark, ("o", 1, 1, "second")), ["at"], token="two")
    assert [r.body for r in table.read().collect()] == ["first"]
    table.merge(rows(spark, ("o", 1, 1, "second")), ["at"], token="two")
    assert table.merge(rows(spark, ("o", 1, 9, "again")), ["at"], token="two") == table.state().version
    assert [r.body for r in table.read().collect()] == ["second"]
    assert table.vacuum() > 0 and [r.body for r in table.read().collect()] == ["second"]


def test_two_writers_are_told(spark, tmp_path):
    one, two = opened(spark, tmp_path), opened(spark, tmp_path)
    state = two.state()
    one.append(rows(spark, ("o", 1, 0, "x")))
    with pytest.raises(RuntimeError, match="two writers"):
        two._next(state, None)


def test_new_columns_and_types(spark, tmp_path):
    table = opened(spark, tmp_path, buckets=2)
    table.merge(rows(spark, ("o", 1, 0, "x"), ("o", 2, 0, "y")), ["at"])
    table.merge(spark.createDataFrame([("o", 2, 1, "z", True)], "owner string, number long, at long, body string, seen boolean"), ["at"])
    assert sorted((r.number, r.body, r.seen) for r in table.read().collect()) == [(1, "x", None), (2, "z", True)]


def test_whole_records_are_inserted_once(spark, tmp_path):
    table = whole_records(spark, str(tmp_path / "t"), rows(spark).schema, buckets=2)
    for n in range(FAN + 3):
        table.insert_absent(rows(spark, ("o", n, 0, None), ("o", n, 0, None), ("o", 0, 0, None)))
    got = sorted(r.number for r in table.read().collect())
    assert got == list(range(FAN + 3))
    assert max(len(held) for held in table.state().folders.values()) < FAN + 2


def test_compaction_by_levels(spark, tmp_path):
    table = BucketStore.open(spark, str(tmp_path / "t"), rows(spark).schema, ["owner"], buckets=1)
    for n in range(FAN):
        table.append(rows(spark, ("a", n, 0, "x"), ("b", n, 0, "x")))
    assert table.compact(lambda df: df.filter("owner = 'a'")) and not table.compact()
    assert [level for level, _ in table.state().folders[0]] == [1]
    assert sorted(r.number for r in table.read().collect()) == list(range(FAN))
    assert table.rows_of(spark.createDataFrame([("b",), (None,)], "owner string")).isEmpty()


def test_one_large_bucket(spark, tmp_path):
    """A third of all rows under one value: they are dealt out, and all come back."""
    table = BucketStore.open(spark, str(tmp_path / "t"), rows(spark).schema, ["owner"], buckets=4)
    every = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), "id")).alias("owner"), F.col("id").cast(
        "int").alias("number"), F.col("id").alias("at"), F.lit("x").alias("body"))
    table.append(every)
    assert table.read().count() == 30_000 and table.rows_of(spark.createDataFrame([("hot",)], "owner string")).count() == 10_000


def test_lookups_read_few_row_groups(spark, tmp_path):
    every = spark.range(200_000).select(
        F.concat(F.lit("own"), F.col("id") % 40).alias("project_owner"), F.concat(F.lit("p"), F.col("id") % 400).alias("project_name"),
        F.sha1(F.col("id").cast("string")).alias("sha"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("message"))
    path = str(tmp_path / "t")
    store.write_clustered(every, path, ["sha"], group_bytes=1 << 18)

    def read(frame):
        """Rows that come back, and rows in the row groups that were opened."""
        rows = frame.collect()
        return len(rows), frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    found, opened = read(store.read_project(spark, path, "own7", "p47"))
    assert found == 500 and opened < 200_000 / 20
    sha = every.filter("id = 77777").first().sha
    found, opened = read(store.find(spark, path, sha=sha))
    assert found == 1 and opened < 200_000 / 10
    assert read(store.find(spark, path, sha=None))[0] == 0


def raw(spark, *docs, **columns):
    frame = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string").select(F.lit("o").alias("project_owner"), F.lit("p").alias("project_name"), "doc")
    return frame.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_every_raw_table_lands(spark, tmp_path):
    doc = {"sha": "s", "number": 1, "id": 2, "commit_id": "c", "created_at": "t", "tag_name": "v", "full_name": "f", "login": "l", "path": "r",
           "issue_url": "https://x/issues/1"}
    out = str(tmp_path)
    landing.land_documents(spark, {name: raw(spark, doc, {**doc, "extra": 1}, {}, issueid=1).withColumn(
        "landed", F.monotonically_increasing_id()) for name in store.RAW_KEYS}, out, buckets=1)
    assert len(store.RAW_KEYS) == 20
    for name in store.RAW_KEYS:
        held = landing.raw_table(spark, out, name).read().select(F.to_json("doc").alias("j"), *store.keys_of(name)).collect()
        if name in ("requested_reviewers", "reviews"):  # keyed by the issue alone
            assert len(held) == 1
        else:
            assert [json.loads(r.j).get("extra") for r in held] == [1]
    rejects = spark.read.parquet(f"{out}/rejects").groupBy("raw_table").count().collect()
    assert {r.raw_table for r in rejects} == set(store.RAW_KEYS) - {"requested_reviewers", "reviews"}


def test_a_scrape_and_its_repeat(spark, tmp_path):
    out, day = str(tmp_path), "2020-01-01T00:00:00Z"
    issue = {"number": 1, "id": 10, "user": {"login": "ann"}, "created_at": day, "title": "see #2", "body": "one", "closed_at": None}
    commit = {"sha": "s1", "author": {"login": "ann"}, "commit": {"author": {"date": day}, "message": "m"}}
    first = {"issue_info": raw(spark, issue, {**issue, "number": 2, "id": 11}), "gh_commits": raw(spark, commit)}
    jobs.land_and_update(spark, first, out, token="a", buckets=4)
    table = lambda name: KeyedTable(spark, f"{out}/{name}").read()
    assert [r.paths for r in table("project_events").collect()] == [["(unknown)"]]
    second = {"issue_info": raw(spark, {**issue, "body": "two +1", "closed_at": day, "closed_by": {"login": "bob"}}),
              "git_commits": raw(spark, {"sha": "s1", "paths": ["a.py"], "insertions": 3, "deletions": 1})}
    for _ in range(2):
        jobs.land_and_update(spark, second, out, token="b", buckets=4)
        assert sorted((r.rectype, r.issueid, r.text) for r in table("issue_events").collect()) == [
            ("issue_closed", 1, ""), ("issue_title", 1, "two +1"), ("issue_title", 2, "one")]
        assert [(r.paths, r.insertions) for r in table("project_events").collect()] == [(["a.py"], 3)]
    assert landing.raw_table(spark, f"{out}/raw", "issue_info").read().count() == 2
