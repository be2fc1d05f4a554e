import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from forgetide.functions import documents as D
from forgetide.operators import normalize as N
from forgetide.operators import routing as R
from forgetide.sources import archive as A


def texts(records):
    return [r.text.strip() for r in records.orderBy("seq").collect()]


def test_records_on_one_line(lines):
    line = '{"a":1}{"b":"x } { y"}  {"c":{"d":[{},{}]}}'
    good = A.accepted(A.parse_records(lines([line, '{"e":2}', "", "   "])))
    assert texts(good) == ['{"a":1}', '{"b":"x } { y"}', '{"c":{"d":[{},{}]}}', '{"e":2}']


def test_quarantine_keeps_every_text(lines):
    records = A.parse_records(lines(['{"a":1}{"b":', "5", '[1]', '{"c":3}', "nonsense", '{"d":{"x"}{"f":1}']))
    assert texts(A.accepted(records)) == ['{"a":1}', '{"c":3}']
    assert sorted((r.text.strip(), r.error_reason) for r in A.rejected(records).collect()) == sorted([
        ('{"b":', "not JSON"), ("5", "not an object"), ("[1]", "not an object"), ("nonsense", "not JSON"),
        ('{"d":{"x"}{"f":1}', "not JSON")])


def test_repeated_keys_take_the_last(lines):
    good = A.accepted(A.parse_records(lines(['{"a":1,"a":2}'])))
    assert good.select(D.get("v", "a", "int")).first()[0] == 2


def test_gzip_scan_in_file_order(spark, tmp_path):
    for hour in range(3):
        with gzip.open(tmp_path / f"2015-01-22-{hour}.json.gz", "wb") as out:
            for i in range(50):
                out.write(json.dumps({"id": hour * 100 + i}).encode() + (b"" if i % 2 else b"\n"))
    good = A.accepted(A.read_archive(spark, str(tmp_path)))
    ids = [r[0] for r in good.orderBy("seq").select(D.get("v", "id", "int")).collect()]
    assert ids == [h * 100 + i for h in range(3) for i in range(50)]


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b'{"a":"p\xffq"}\n')
    for errors, value in (("replace", "p�q"), ("ignore", "pq")):
        good = A.accepted(A.read_archive(spark, str(tmp_path), errors))
        assert good.select(D.get("v", "a")).first()[0] == value


def test_hours_between():
    hours = A.hours_between("2015-01-22 08:23:18", "2015-01-22 12:23:18")
    assert [h.hour for h in hours] == [8, 9, 10, 11, 12] and all(h.minute == 0 for h in hours)
    assert len(A.hours_between("2015-01-22T23:00:00", "2015-01-23T01:59:00")) == 3


def test_hourly_files_of_a_range(spark, tmp_path):
    (tmp_path / "2015").mkdir()
    for hour in (7, 8, 10, 12, 13):
        with gzip.open(tmp_path / "2015" / f"2015-01-22-{hour}.json.gz", "wt") as out:
            out.write(json.dumps({"h": hour}))
    found = lambda a, b: sorted(r[0] for r in A.read_hours(spark, str(tmp_path), a, b).select(D.get("v", "h", "int")).collect())
    assert found("2015-01-22 08:23:18", "2015-01-22 12:23:18") == [8, 10, 12]
    assert found("2016-01-22 08:23:18", "2016-01-22 12:23:18") == []


def test_hour_scan_opens_only_the_range(spark, tmp_path):
    rows = spark.range(72).select("id", F.timestamp_seconds(F.lit(1421884800) + F.col("id") * 3600).alias("created_at"))
    A.land(rows, str(tmp_path / "landed"))
    found = A.scan_hours(spark, str(tmp_path / "landed"), "2015-01-22 22:10:00", "2015-01-23 01:10:00")
    assert sorted(r.id for r in found.collect()) == [22, 23, 24, 25]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_sample_projects(spark, tmp_path):
    (tmp_path / "s.txt").write_text("octo/Hello \n\n  octo/Spoon\nocto/hello\n")
    names = A.sample_projects(spark, str(tmp_path / "s.txt"), lower=True)
    assert sorted(r[0] for r in names.collect()) == ["octo/hello", "octo/spoon"]


def test_dotted_access(lines):
    frame = A.parse_records(lines(['{"a":{"b":1,"c":1,"n":null},"d":{"e":1},"f":2,"g":null}']))
    row = frame.select(
        D.get("v", "f", "int"), D.get("v", "a.b", "int"), D.get("v", "a.q", "int"), D.get_or("v", "b", 44, "int"),
        D.first("v", "a.q,a.b", "int"), D.first("v", "a.b,a.q", "int"), D.first_or("v", "a.q", "None"),
        D.get_or("v", "a.n", 44, "int"), D.get_or("v", "g.x", 44, "int"), D.present("v", "g"),
        D.is_null_leaf("v", "g"), D.is_null_leaf("v", "f"), D.last_segment(F.lit("http://x/y/17"))).first()
    assert list(row) == [2, 1, None, 44, 1, 1, "None", None, 44, True, True, False, 17]


# One record per case: what it is, and the columns expected of it.
NEW = {"id": "1", "type": "WatchEvent", "actor": {"login": "ann", "url": "u"}, "repo": {"id": 5, "name": "o/p"},
       "payload": {"action": "started"}, "created_at": "2015-03-10T22:55:48Z"}
CASES = [
    (NEW, dict(actor="ann", repo_id=5, project="o/p", event_id="1")),
    ({"type": "WatchEvent", "actor": "bob", "actor_attributes": {"login": "bobby"}, "payload": {},
      "repository": {"id": 6, "owner": "o", "name": "q"}, "created_at": "2012-03-10T22:55:48Z"},
     dict(actor="bobby", repo_id=6, project="o/q", event_id=None)),
    ({"type": "WatchEvent", "actor": "blogin", "payload": {}, "url": "https://github.com/a/b/c", "created_at": "x"},
     dict(actor="blogin", repo_id=None, project="a/b", created_at=None)),
    ({"type": "WatchEvent", "actor": "c", "payload": {"repo": "/b"}, "url": "https://github.com/a/b",
      "created_at": "2011/02/12 00:00:00 -0800"}, dict(project="a/b", created_at="2011-02-12 08:00:00")),
    ({**NEW, "actor": None}, dict(actor=None)),
    ({**NEW, "payload": {"repo": ""}, "repo": None}, dict(project=None)),
    ({**NEW, "payload": {"repo": "/b"}, "repo": None}, dict(project=None)),
    ({"type": "MemberEvent", "actor": {"id": 3}, "payload": {"actor": {"login": "deep"}, "member": "mem"}},
     dict(actor="deep", member="mem", project=None)),
]


@pytest.mark.parametrize("record, expected", CASES)
def test_normalise(lines, record, expected):
    frame = N.normalise(A.parse_records(lines([json.dumps(record)])))
    row = frame.withColumn("created_at", F.col("created_at").cast("string")).select(*expected).first()
    assert row.asDict() == expected


def canon(spark):
    return spark.createDataFrame([(5, ["o/p", "o/older"], "o/p")], "id long, aliases array<string>, canonical string")


def test_membership_by_id_alias_and_learned_name(spark, lines):
    old = lambda name: {"type": "WatchEvent", "actor": "x", "payload": {}, "url": f"https://github.com/{name}/w"}
    renamed = {**NEW, "repo": {"id": 5, "name": "O/Renamed"}}
    records = [NEW, renamed, old("o/renamed"), old("O/Older"), old("o/stranger"), {**NEW, "repo": {"id": 9, "name": "z/z"}}]
    events = N.normalise(A.parse_records(lines([json.dumps(r) for r in records])))
    seen = lambda names: sorted(r[0] for r in N.in_projects(events, canon(spark), names).select("seq.row").collect())
    assert seen(N.known_names(events, canon(spark))) == [0, 1, 2, 3]
    assert seen(N.all_aliases(canon(spark))) == [0, 1, 3]
    rows = {r.row: (r.github_project_id, r.canonical_project) for r in N.canonical_project(events, canon(spark)).select(
        "seq.row", "github_project_id", "canonical_project").collect()}
    assert rows == {0: (5, "o/p"), 1: (5, "o/p"), 2: (-2, "o/renamed"), 3: (5, "o/p"), 4: (-2, "o/stranger"), 5: (9, "z/z")}


def test_event_tables_count_every_record_once(spark, lines, tmp_path):
    push = {**NEW, "type": "PushEvent", "payload": {"ref": "refs/heads/m", "commits": [{"sha": "s1"}, {"sha": "s2"}]}}
    wiki = {**NEW, "type": "GollumEvent", "payload": {"pages": [
        {"title": "A", "action": "created", "sha": "1", "page_name": "a", "summary": None},
        {"title": "B", "action": "created", "sha": "2", "page_name": "b", "summary": None}]}}
    noshas = {**push, "payload": {}}
    nobody = {**push, "actor": None}
    skipped = {**NEW, "type": "GistEvent"}
    records = [push, wiki, noshas, nobody, skipped, NEW, {**NEW, "payload": {"action": "again"}}]
    events = N.normalise(A.parse_records(lines([json.dumps(r) for r in records])))
    chosen = R.chosen(events, canon(spark))
    assert [r.shas for r in R.typed_table(chosen, "PushEvents").collect()] == ["s1;s2"]
    assert [r.title for r in R.typed_table(chosen, "GollumEvents").collect()] == ["B"]
    both = R.typed_table(chosen, "GollumEvents", key=["created_at", "project", "page_name"])
    assert sorted(r.title for r in both.collect()) == ["A", "B"]
    other = R.other_table(chosen).select(D.get("raw", "payload.action")).collect()
    assert [r[0] for r in other] == ["again"]
    foreign = {**noshas, "repo": {"id": 77, "name": "some/other"}}
    nowhere = {**noshas, "repo": None}
    more = N.normalise(A.parse_records(lines([json.dumps(r) for r in [*records, foreign, nowhere]])))
    assert sorted(r.error_reason for r in R.rejects(more, canon(spark)).collect()) == ["no actor", "no repository", "no shas"]


def test_placeholder_actor(lines):
    bad = {**NEW, "actor": {"login": "", "url": "https://api.github.dev/users/"}}
    events = N.normalise(A.parse_records(lines([json.dumps(r) for r in (NEW, bad)])))
    assert N.not_placeholder(events).count() == 1


def test_number_inside_a_string_is_no_number(lines):
    note = {**NEW, "payload": {"body": 'say "number": 7'}}
    deep = {**NEW, "payload": {"x": [{"number": 7}]}}
    records = A.parse_records(lines([json.dumps(r) for r in (note, deep)]))
    assert [r.row for r in N.mentions_number(records, "o", "p", 7).select("seq.row").collect()] == [1]


def test_normalise_goes_through_a_document_once(lines):
    """Fields are read from the opened document, not each by its own path from the start; odd kinds give null."""
    records = A.parse_records(lines([
        json.dumps({"type": "PushEvent", "repo": {"id": "x", "name": "a/b"}, "actor": ["x"], "payload": {
            "comment": None, "comment_id": 4, "commit": "c", "shas": [["s", "m"], [], None, {"a": 1}], "pages": {"a": 1}, "number": "17"}}),
        json.dumps({"type": 5, "payload": [1], "repo": "a/b", "url": {"a": 1}}), "null", '{"type":"A","type":"B"}']))
    events = N.normalise(records)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"try_variant_get\(v#\d+", plan)) == 1
    first, second, third, last = events.orderBy("seq").collect()
    assert (first.repo_id, first.project, first.actor, first.issue_number) == (None, "a/b", None, 17)
    assert first.shas == ["s", None, None, None] and len(first.pages) == 1
    assert (first.commit_comment_id, first.commit_comment_sha) == (None, None)  # the comment is there and is null
    assert (second.event_type, second.project, second.action) == ("5", None, None)
    assert third.event_type is None and last.event_type == "B"


def test_landed_events_hold_a_document_once(spark, tmp_path):
    from forgetide.plans import routing
    ts = "timestamp'2020-01-01 00:00:00'"
    spark.sql(f"SELECT id AS event_id, {ts} AS ts, id % 9 AS user_id, 'view' AS event_type, 1.0D AS value, '' AS props FROM range(40)"
              ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    landed = routing.landed(spark, str(tmp_path))
    assert landed.count() == 40
    assert landed.filter("v IS NOT NULL AND text IS NOT NULL").count() == 0
