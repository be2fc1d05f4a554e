"""The jobs end to end, and the stream that does the batch job's work."""

import gzip
import json
import os

from pyspark.sql import functions as F

from forgetide.operators import jobs
from forgetide.sources import tables
from forgetide.sources.keyed import FAN, BucketStore
from forgetide.streaming import ingest
from forgetide.streaming.ingest import current_rows, stream_event_table, stream_lines


def push(number, second, sha):
    return json.dumps({"id": str(number), "type": "PushEvent", "actor": {"login": "ann"}, "repo": {"id": 5, "name": "o/p"},
                       "payload": {"ref": "r", "commits": [{"sha": sha}]}, "created_at": f"2015-01-01T00:00:{second:02d}Z"})


def canon(spark):
    return spark.createDataFrame([(5, ["o/p"], "o/p")], "id long, aliases array<string>, canonical string")


def write(path, *texts):
    with gzip.open(path, "wt") as out:
        out.write("\n".join(texts) + "\n")


def test_event_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "2015-01-01-0.json.gz", push(1, 1, "a") + push(2, 1, "b"), push(3, 2, "c"), "{broken")
    jobs.event_tables(spark, str(tmp_path / "in"), canon(spark), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out" / "PushEvents")).collect()
    assert sorted((r.id, r.shas) for r in rows) == [("2", "b"), ("3", "c")]
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out" / "unreadable")).collect()] == ["{broken"]


def test_alias_tables_feed_event_tables(spark, tmp_path):
    """Two archives, the older one second: the name seen last stays canonical, events under both names are found."""
    def named(number, name, second):
        return json.dumps({**json.loads(push(number, second, f"s{number}")), "repo": {"id": 5, "name": name}})
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    write(tmp_path / "a" / "2015-01-01-0.json.gz", named(1, "o/New", 30), named(2, "o/Old", 10))
    write(tmp_path / "b" / "2015-01-01-0.json.gz", named(3, "x/First", 5), named(4, "o/Old", 7), "{broken")
    for folder in ("a", "b"):
        listed = jobs.alias_tables(spark, str(tmp_path / folder), str(tmp_path / "out"), token=folder, buckets=2)
    assert [tuple(r) for r in listed.select("id", "aliases", "canonical").collect()] == [(5, ["o/new", "o/old", "x/first"], "o/new")]
    jobs.event_tables(spark, [str(tmp_path / "a"), str(tmp_path / "b")], listed, str(tmp_path / "tables"))
    rows = spark.read.parquet(str(tmp_path / "tables" / "PushEvents")).collect()
    assert {(r.id, r.canonical_project) for r in rows} == {(str(n), "o/new") for n in (1, 2, 3, 4)}


def test_stream_follows_arriving_files(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def run():
        job = stream_event_table(stream_lines(spark, source, max_files=1), "PushEvents", canon(spark), target, progress,
                                 availableNow=True)
        job.awaitTermination()
        return sorted((r.id, r.shas) for r in current_rows(spark, "PushEvents", target).collect())

    write(tmp_path / "in" / "2015-01-01-0.json.gz", push(1, 1, "a"), push(2, 2, "b"))
    assert run() == [("1", "a"), ("2", "b")]
    write(tmp_path / "in" / "2015-01-01-1.json.gz", push(3, 2, "later"))
    assert run() == [("1", "a"), ("3", "later")]
    assert run() == [("1", "a"), ("3", "later")]


def test_stream_deals_out_the_lines_of_one_file(spark, tmp_path):
    """A compressed file is one task's to read; parsing and normalising it is not."""
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "2015-01-01-0.json.gz", *[push(n, n % 50, f"s{n}") for n in range(200)])
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    stream_event_table(stream_lines(spark, str(tmp_path / "in")), "PushEvents", canon(spark), target, progress, availableNow=True).awaitTermination()
    parsed = spark.read.parquet(f"{progress}-state/events")
    assert parsed.count() == 200 and parsed.select(F.input_file_name()).distinct().count() > 1
    rows = {r.created_at.second: r.shas for r in current_rows(spark, "PushEvents", target).collect()}
    assert rows == {s: f"s{150 + s}" for s in range(50)}  # the last line of a second, whichever task had it


def test_stream_learns_names_before_and_after(spark, tmp_path):
    """An event without id comes under a name that another batch learns from a known id; both orders."""
    def push_as(number, name, repo_id):
        doc = json.loads(push(number, 1, f"s{number}"))
        doc["repo"] = {"name": name, **({"id": repo_id} if repo_id else {})}
        doc["created_at"] = f"2015-01-01T0{number}:00:00Z"
        return json.dumps(doc)

    known = canon(spark).first().id
    for order in ((1, 2), (2, 1)):
        folder = tmp_path / f"{order[0]}"
        texts = {1: push_as(1, "o/renamed", known), 2: push_as(2, "o/renamed", None)}
        (folder / "in").mkdir(parents=True)
        for hour, number in enumerate(order):
            write(folder / "in" / f"2015-01-01-{hour}.json.gz", texts[number])
            job = stream_event_table(stream_lines(spark, str(folder / "in"), max_files=1), "PushEvents", canon(spark),
                                     str(folder / "out"), str(folder / "progress"), availableNow=True)
            job.awaitTermination()
        assert sorted(r.id for r in current_rows(spark, "PushEvents", str(folder / "out")).collect()) == ["1", "2"]


def stage_bytes(spark, after):
    """The last stage's number, and the bytes that the stages after one have read."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    read = {s.stageId(): s.inputBytes() for s in (stages.apply(i) for i in range(stages.size()))}
    return max(read, default=-1), sum(n for stage, n in read.items() if stage > after)


def test_a_batch_does_not_read_the_batches_before(spark, tmp_path, monkeypatch):
    """Thirty batches of events on foreign repositories; batch 12 learns one of their names, 20 another, which then come in late."""
    (tmp_path / "in").mkdir()

    def event(number, name, repo_id):
        doc = json.loads(push(number, number % 60, f"s{number}" + "x" * 300))
        doc["repo"] = {"name": name, **({"id": repo_id} if repo_id else {})}
        doc["created_at"] = f"2015-01-{1 + number // 1440:02d}T{number // 60 % 24:02d}:{number % 60:02d}:00Z"
        return json.dumps(doc)

    for hour in range(30):
        texts = [event(hour * 40 + i, f"some/r{i}", None) for i in range(40)]
        if hour in (12, 20):
            texts.append(event(5000 + hour, f"some/r{hour}", 5))
        write(tmp_path / "in" / f"2015-01-02-{hour:02d}.json.gz", *texts)
        os.utime(tmp_path / "in" / f"2015-01-02-{hour:02d}.json.gz", (1e9 + hour, 1e9 + hour))  # they come in this order
    seen, inner = [], ingest.learned_names
    monkeypatch.setattr(ingest, "learned_names", lambda *args: seen.append(stage_bytes(spark, seen[-1][0] if seen else -1)) or inner(*args))
    job = stream_event_table(stream_lines(spark, str(tmp_path / "in"), max_files=1), "PushEvents", canon(spark), str(tmp_path / "out"),
                             str(tmp_path / "progress"), buckets=2, availableNow=True)
    job.awaitTermination()
    read = [n for _, n in seen[1:]] + [stage_bytes(spark, seen[-1][0])[1]]  # from one batch's start to the next one's
    assert len(read) == 30
    rows = {r.id for r in current_rows(spark, "PushEvents", str(tmp_path / "out")).collect()}
    assert rows == {str(h * 40 + n) for n in (12, 20) for h in range(30)} | {"5012", "5020"}
    # rounds of eight batches, each with one compaction; nothing was learned in the first and the last
    assert sum(read[22:30]) < 1.6 * sum(read[2:10]), read
    waiting = BucketStore(spark, f"{tmp_path}/progress-state/waiting")
    assert max(len(held) for held in waiting.state().folders.values()) < 2 * FAN
    assert "some/r12" not in {r["_name"] for r in waiting.read().filter("batch BETWEEN 8 AND 11").collect()}  # put together after it was learned


def test_the_last_fetched_version_stays(spark):
    """A pull request fetched twice, with one creation time; the order of the input does not matter."""
    pull = {"number": 3, "id": 5, "user": {"login": "ann"}, "created_at": "2020-01-01T00:00:00Z", "title": "t", "body": "old", "comments": 1}
    old = documents(spark, pull)
    new = documents(spark, {**pull, "body": "new", "comments": 2}).withColumn("retrieved_at", F.lit("2021-01-01").cast("timestamp"))
    nothing = documents(spark, {}).limit(0)
    for both in (old.unionByName(new), new.unionByName(old)):
        row = jobs.issue_timeline(nothing, both, nothing, nothing, nothing, nothing).first()
        assert row.text == "new" and row.status.comments == 2
    landed = [old.withColumn("landed", F.lit(n).cast("bigint")) for n in (1, 2)]
    landed[1] = documents(spark, {**pull, "body": "again"}).withColumn("landed", F.lit(2).cast("bigint"))
    for both in (landed[0].unionByName(landed[1]), landed[1].unionByName(landed[0])):
        assert jobs.issue_timeline(nothing, both, nothing, nothing, nothing, nothing).first().text == "again"


def documents(spark, *docs, extra="CAST(NULL AS INT) AS issueid"):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").selectExpr(
        "'own' AS project_owner", "'p' AS project_name", "parse_json(j) AS doc",
        "timestamp'2020-01-01 00:00:00' AS retrieved_at", extra)


def test_documents_to_membership(spark, tmp_path):
    day = lambda n: f"2020-01-0{n}T00:00:00Z"
    issue = {"number": 1, "id": 10, "user": {"login": "ann"}, "created_at": day(2), "closed_at": None, "title": "+1 see #2",
             "body": None}
    closed = {**issue, "number": 2, "id": 11, "closed_at": day(3), "closed_by": {"login": "own"}}
    commit = {"sha": "s1", "author": None, "commit": {"author": {"email": "ann@x", "date": day(1)}, "message": "m",
                                                      "comment_count": 0}}
    issues = documents(spark, issue, issue, closed)
    nothing = documents(spark, {}).limit(0)
    left = jobs.issue_timeline(issues, nothing, nothing, nothing, nothing, nothing)
    assert left.count() == 3
    title = left.filter("rectype = 'issue_title' AND issueid = 1").first()
    assert title.plus_1 is True and title.issues[0].parts == ["own", "p", "2", ""]
    assert left.filter("rectype = 'issue_closed'").first().plus_1 is False
    clone = spark.createDataFrame([], "project_owner string, project_name string, sha string, paths array<string>, "
                                      "insertions int, deletions int")
    right = jobs.project_timeline(documents(spark, commit), clone, nothing)
    assert right.first().paths == ["(unknown)"]
    numbered = lambda df: df.withColumn("seq", F.xxhash64("uid"))
    sample = spark.createDataFrame([("OWN/P",)], "project string")
    pairs = spark.createDataFrame([("ann@x", "ann")], "alias1 string, alias2 string")
    people, counts = jobs.membership(numbered(left), numbered(right), sample, pairs)
    out = {r.actor: (r.first_participation_action, r.first_member_action) for r in people.collect()}
    assert out == {"ann": ("commit_messages", "commit_messages"), "own": ("issue_closed", "owner")}
    jobs.write_membership(people, counts, str(tmp_path))
    written = spark.read.csv(str(tmp_path / "atcount"), header=True).collect()
    assert sorted(r["project"] for r in written) == ["all", "own/p"]


def test_readmes(spark):
    files = spark.createDataFrame(
        [("own", "p", n, n, "file", "sha" + n, "see #4") for n in ("README.md", "INSTALL", "a.py", "LICENSE", "Makefile")],
        "project_owner string, project_name string, name string, path string, type string, sha string, text string")
    touches = spark.createDataFrame(
        [("own", "p", "README.md", "c1", "ann", None, "2020-01-01"), ("own", "p", "README.md", "c2", None, "b@x", "2020-01-02")],
        "project_owner string, project_name string, path string, sha string, author_login string, author_email string, d string")
    rows = jobs.readme_table(files, touches.withColumn("committed_date", F.to_timestamp("d"))).collect()
    assert {(r.title, r.actor, r.issues[0].raw) for r in rows} == {("README.md", "b@x", "#4"), ("INSTALL", None, "#4")}


TIMELINE = ("project_owner string, project_name string, issueid int, rectype string, actor string, action string, "
            "time timestamp, seq long")


def test_aliases_from_timelines_to_clusters(spark, tmp_path):
    out, day = str(tmp_path), lambda n: f"2016-01-0{n}"
    rows = lambda *data: spark.createDataFrame(
        [("o", "p", i, k, a, s, d, n) for n, (i, k, a, s, d) in enumerate(data)], TIMELINE.replace("timestamp", "string")
    ).withColumn("time", F.to_timestamp("time"))
    issues = rows((1, "issue_title", "ann", None, day(1)), (1, "pull_request_title", "ann", None, day(1)),
                  (1, "pull_request_commit", "ann@x", "s1", day(2)), (1, "pull_request_commit", "late@x", "s2", day(3)))
    commits = rows((None, "commit_messages", "bob@x", "s3", day(4)), (None, "commit_messages", "ann@x", "s4", day(4)))
    pushes = spark.createDataFrame([("o/p", "s3", "bob"), ("o/p", "s4", "ann"), ("o/p", "s3;s4", "no")],
                                   "project string, shas string, actor string")
    sample = spark.createDataFrame([("o", "p")], "project_owner string, project_name string")
    jobs.write_alias_pairs(pushes, issues, commits, sample, out)
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True).withColumn(
        "seq", F.monotonically_increasing_id())
    assert sorted((r.alias1, r.alias2) for r in read("aliases_pushes").collect()) == [("ann", "ann@x"), ("bob", "bob@x")]
    assert [(r.provenance, r.alias1, r.alias2) for r in read("aliases_prs").collect()] == [("o/p:issue:1", "ann", "ann@x")]

    profiles = spark.createDataFrame([("ann", "ann@home", "0", 0), ("bot", "bot@x", "1", 1), ("bob", " ", None, 2)],
                                     "login string, email string, fake string, seq long")
    jobs.identities(profiles, read("aliases_prs"), read("aliases_pushes"), f"{out}/one")
    names = lambda at: {r.alias: r.canonical for r in spark.read.parquet(f"{at}/canonical").collect()}
    expected = {"ann": "ann", "ann@x": "ann", "ann@home": "ann", "bob": "bob", "bob@x": "bob"}
    assert names(f"{out}/one") == expected
    more = spark.createDataFrame([("bob", "ann@x", "odd", 0), ("bob", "bob@new", "new", 1)],
                                 "alias1 string, alias2 string, provenance string, seq long")
    jobs.identities(profiles.limit(0), more, more.limit(0), f"{out}/two", old=f"{out}/one")
    assert names(f"{out}/two") == {**expected, "bob@new": "bob"}
    reasons = {r.text for r in spark.read.parquet(f"{out}/two/provenance").collect()}
    assert "new (bob=bob@new)" in reasons and "Github profile (ann=ann@home)" in reasons
    refused = spark.read.parquet(f"{out}/two/refused").collect()
    assert [(r.alias1, r.alias2) for r in refused] == [("bob", "ann@x")]


def test_lists_and_actor_table(spark, tmp_path):
    row = lambda a: spark.createDataFrame([("o", "p", a)], "project_owner string, project_name string, actor string")
    jobs.write_users_and_projects(row("zed"), row("ann"), str(tmp_path))
    lists = [[r[0] for r in spark.read.csv(f"{tmp_path}/{n}").collect()] for n in ("users", "projects")]
    assert lists == [["ann", "zed"], ["o/p"]]
    cache = spark.createDataFrame([("ann", "a, \"b\"\nc")], "login string, bio string")
    blank = [F.lit(None).cast("string").alias(c) for c in tables.ACTOR_COLUMNS if c not in cache.columns]
    users = spark.createDataFrame([("zed", "here")], "login string, location string")
    jobs.write_actor_info(row("zed"), row("ann"), cache.select("*", *blank), users, str(tmp_path))
    back = {r.login: r for r in tables.read_actor_cache(spark, f"{tmp_path}/actor_info").collect()}
    assert back["ann"].bio == "a, \"b\"\nc" and back["zed"].location == "here" and set(back) == {"ann", "zed"}
