import datetime as dt

from forgetide.operators import people as P
from forgetide.operators import timeline as L
from forgetide.sources import store

SCHEMA = "project_owner string, project_name string, actor string, rectype string, time timestamp, seq long"


def rows(spark, *data):
    return spark.createDataFrame([("Own", "p", a, k, dt.datetime(2020, 1, d), i) for i, (a, k, d) in enumerate(data)], SCHEMA)


def test_ties_go_to_the_issue_timeline(spark):
    both = L.both_timelines(rows(spark, ("ann", "issue_comment", 2)), rows(spark, ("ann", "commit_messages", 2)))
    row = P.participation(both).first()
    assert row.first_participation_action == "issue_comment" and row.first_member_action == "commit_messages"


def test_owner_is_a_member_from_the_first_act(spark):
    both = L.both_timelines(rows(spark, ("Own", "issue_title", 3), ("Own", "commit_messages", 5), ("bob", "issue_title", 1),
                                 (None, "issue_title", 1)), rows(spark))
    out = {r.actor: (r.first_member_action, r.first_member_date) for r in P.participation(both).collect()}
    assert out == {"Own": ("owner", dt.datetime(2020, 1, 3)), "bob": (None, None)}


def test_sample_ignores_case(spark):
    sample = spark.createDataFrame([("oWN/P",)], "project string")
    assert P.in_sample(rows(spark, ("a", "issue_title", 1)), sample).count() == 1


def test_usermap(spark):
    pairs = [("ann@x", "ann"), ("b.ob@x", "zed"), ("b.ob@x", "Bob"), ("c@x", "u"), ("c@x", "v"), ("p", "q"), ("d", "d@x")]
    found = P.usermap(spark.createDataFrame(pairs, "alias1 string, alias2 string")).collect()
    assert {r.email: r.login for r in found} == {"ann@x": "ann", "b.ob@x": "Bob", "d@x": "d"}


def test_whole_row_wins_in_enrichment(spark):
    from forgetide.sources.tables import ACTOR_COLUMNS
    blank = {c: None for c in ACTOR_COLUMNS}
    schema = ", ".join(f"{c} string" for c in ACTOR_COLUMNS)
    cache = spark.createDataFrame([{**blank, "login": "ann", "bio": "b"}], schema)
    users = spark.createDataFrame([("ann", "here"), ("bob", "there")], "login string, location string")
    actors = spark.createDataFrame([("ann",), ("bob",), ("cy",), ("d@x",), ("cy",)], "actor string")
    out = {r.login: r for r in P.enrich(actors, cache, users).collect()}
    assert out["ann"].location is None and out["ann"].bio == "b" and out["bob"].location == "there"
    assert (out["cy"].type, out["cy"].error) == ("deleted", "not found") and out["d@x"].error == "Not a github username"


def test_latest_write_wins_and_repeats_change_nothing(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (1, None, 2, "b"), (2, 5, 1, "c")], "k int, n int, seq int, v string")
    once = store.keep_last(df, ["k", "n"], ["seq"])
    assert sorted(r.v for r in once.collect()) == ["b", "c"]
    assert sorted(r.v for r in store.upsert(once, once, ["k", "n"], ["seq"]).collect()) == ["b", "c"]
    new = spark.createDataFrame([(1, None, 0, "new")], "k int, n int, seq int, v string")
    assert sorted(r.v for r in store.upsert(once, new, ["k", "n"], ["seq"]).collect()) == ["c", "new"]


def test_versions_are_thinned_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS seq")
    plan = store.keep_last(df, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_insert_absent(spark):
    old = spark.createDataFrame([(1, None)], "a int, b int")
    new = spark.createDataFrame([(1, None), (2, 3), (2, 3)], "a int, b int")
    assert [tuple(r) for r in store.insert_absent(old, new).collect()] == [(2, 3)]


def test_unknown_table_has_no_key():
    assert store.keys_of("issue_comments") == ["project_owner", "project_name", "id", "issueid"]
    try:
        store.keys_of("nothing")
    except KeyError:
        return
    raise AssertionError
