"""Clusters against a plain one-by-one replay of the rule."""

import random

import pytest

from forgetide.operators import identity as I
from forgetide.operators.components import components

SCHEMA = "alias1 string, alias2 string, provenance string, ord long"


def replay(pairs):
    """One pass in order with explicit sets."""
    home = {}
    for a, b in pairs:
        mine, theirs = home.get(a), home.get(b)
        if mine is None or theirs is None:
            group = mine or theirs or set()
            group |= {a, b}
            for alias in (a, b):
                home[alias] = group
        elif mine is not theirs and sum("@" not in x for x in mine | theirs) < 2:
            mine |= theirs
            for alias in theirs:
                home[alias] = mine
    return {frozenset(g) for g in home.values()}


def groups(df, key="cluster", member="alias"):
    out = {}
    for row in df.collect():
        out.setdefault(row[key], set()).add(row[member])
    return {frozenset(g) for g in out.values()}


def random_pairs(seed, n=60, logins=6, mails=18):
    rng = random.Random(seed)
    name = lambda: f"u{rng.randrange(logins)}" if rng.random() < 0.25 else f"m{rng.randrange(mails)}@x"
    return [(name(), name()) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_same_clusters_as_one_by_one(spark, seed):
    pairs = random_pairs(seed)
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    assert groups(I.alias_clusters(df)) == replay(pairs)


def test_pairs_without_neighbours_need_no_components(spark, monkeypatch):
    """Forty mail trees, each tied to a login of its own: one round, two searches for components in all."""
    pairs = [p for i in range(40) for p in ((f"u{i}", f"u{i}@x"), (f"a{i}@y", f"b{i}@y"))] + [(f"b{i}@y", f"u{i}") for i in range(40)]
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    calls, inner = [], I.components
    monkeypatch.setattr(I, "components", lambda *args: calls.append(1) or inner(*args))
    assert groups(I.alias_clusters(df)) == replay(pairs)
    assert len(calls) == 2


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_resumed_clusters_equal_the_whole_replay(spark, monkeypatch, seed):
    """New pairs on some clusters only: the others are not clustered again."""
    pairs = random_pairs(seed, 70, 12, 60)
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    saved = I.alias_clusters(df.filter("ord < 62")).cache()
    seen, inner = [], I._cluster
    monkeypatch.setattr(I, "_cluster", lambda rows: seen.append(rows) or inner(rows))
    clusters, _ = I.resumed(df.filter("ord >= 62"), saved)
    assert groups(clusters) == replay(pairs)
    new = {x for p in pairs[62:] for x in p}
    old = {r.alias for r in seen[0].filter("ord < 0").select("alias1").union(seen[0].filter("ord < 0").select("alias2")).toDF("alias").collect()}
    held = groups(saved)
    assert old == {x for g in held if g & new for x in g} and len(old) < sum(map(len, held))


@pytest.mark.parametrize("ends", [[], ["u1"], ["u1", "u2"]])
def test_rounds_do_not_grow_with_a_chain(spark, monkeypatch, ends):
    """Twelve mail trees joined in a row, each pair after the one before; a name at the first or at both."""
    pairs = [(f"a{i}@x", f"b{i}@x") for i in range(12)]
    pairs += [(name, f"a{11 * k}@x") for k, name in enumerate(ends)]
    pairs += [(f"b{i}@x", f"a{i + 1}@x") for i in range(11)]
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    rounds, certain = [], I._certain
    monkeypatch.setattr(I, "_certain", lambda *args: rounds.append(1) or certain(*args))
    assert groups(I.alias_clusters(df)) == replay(pairs)
    assert len(rounds) <= 2


def test_merges_wait_for_the_state_of_their_time(spark):
    """The mails join before either side has a name; later names close the cluster."""
    pairs = [("a@x", "b@x"), ("c@x", "d@x"), ("e@x", "f@x"), ("b@x", "c@x"), ("u1", "a@x"), ("u2", "d@x"),
             ("f@x", "a@x"), ("e@x", "g@x"), ("u3", "g@x")]
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    expected = {frozenset({"a@x", "b@x", "c@x", "d@x", "u1", "u2"}), frozenset({"e@x", "f@x", "g@x", "u3"})}
    assert replay(pairs) == expected
    clusters = I.alias_clusters(df)
    assert groups(clusters) == expected
    refused = I.refused_pairs(df, clusters).collect()
    assert [(r.alias1, r.alias2) for r in refused] == [("f@x", "a@x")]
    names = {r.alias: r.canonical for r in I.canonical_names(clusters).collect()}
    assert names["d@x"] == "u1" and names["f@x"] == "u3"


def test_saved_clusters_come_first(spark):
    pairs = random_pairs(9)
    df = spark.createDataFrame([(a, b, "p", i) for i, (a, b) in enumerate(pairs)], SCHEMA)
    first = I.alias_clusters(df.filter("ord < 30"))
    resumed = I.alias_clusters(I.saved_pairs(first).unionByName(df.filter("ord >= 30")))
    assert groups(resumed) == replay(pairs)


def test_provenance(spark):
    df = spark.createDataFrame([("u", "a@x", "one", 0), ("b@x", "c@x", "two", 1), ("b@x", "u", "three", 2),
                                ("c@x", "a@x", "four", 3)], SCHEMA)
    rows = {r.text for r in I.cluster_provenance(df).collect()}
    assert rows == {"one (u=a@x)", "two (b@x=c@x)", "three"}
    moved = I.carried_provenance(spark.createDataFrame([("b@x", "old")], "cluster string, text string"),
                                 I.alias_clusters(df))
    assert [tuple(r) for r in moved.collect()] == [("a@x", "old")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)]
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("lone", "lone")]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == label


def test_no_pairs(spark):
    assert I.alias_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
