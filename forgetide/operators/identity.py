"""Alias clusters under the conflict rule.

Pairs are taken in the order of `ord` (a unique long). A pair with a name not met before
always joins that name to its partner's cluster. A pair of two known names in different
clusters merges them only if the union has fewer than two names that are not e-mails.

What is decided in one go: the pairs that bring a new name form trees, whatever else
happens, and each tree's names come at known times. What is left are pairs between
trees, decided in rounds. As long as no cluster closes (gets its second name by a name
that comes late), the rule is that of a minimum spanning forest in which all named
clusters hang on one root. So the earliest open pair of a cluster that has no name yet
merges, as in Boruvka's algorithm: all such pairs of a round at once, however long the
chains they form. Around closings, a pair that is the earliest open one at both its
clusters is decided, as all that came before it there is known. A closed cluster's later
pairs are refused without waiting.

Such pairs share no cluster, so they are put together without a search for components. Rounds
that decide a fair part of the open pairs this way do no more; only others look at whole components.

Saved clusters that no new pair names stay as they are: `resumed` clusters anew what new pairs touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.operators.components import components
from forgetide.operators.people import is_email
from forgetide.session import cut
from forgetide.sources.store import keep_first, keep_last

NEVER = 2**63 - 1
SOURCE_SPAN = 2**55
FEW = 8  # one in so many open pairs is a fair part


def combine_sources(profiles: DataFrame, pulls: DataFrame, pushes: DataFrame,
                    old: DataFrame | None = None) -> DataFrame:
    """Pairs of all sources in their order: saved clusters, profiles (login, email, fake),
    pull requests, pushes. `seq` orders the rows of a source and is unique in it."""
    usable = ((F.trim("login") != "") & (F.trim("email") != "")
              & F.coalesce(F.col("fake") != "1", F.lit(True)))
    first = profiles.filter(usable).select(
        F.col("login").alias("alias1"), F.col("email").alias("alias2"),
        F.lit("Github profile").alias("provenance"), "seq")
    columns = ["alias1", "alias2", "provenance", "seq"]
    out = None
    for rank, source in enumerate((first, pulls, pushes)):
        ranked = source.select(*columns).withColumn("ord", F.lit(rank * SOURCE_SPAN) + F.col("seq")).drop("seq")
        out = ranked if out is None else out.unionByName(ranked)
    return out if old is None else saved_pairs(old).unionByName(out)


def saved_pairs(clusters: DataFrame) -> DataFrame:
    """Saved clusters (alias, cluster) as pairs before all others."""
    return clusters.select(F.col("cluster").alias("alias1"), F.col("alias").alias("alias2"),
                           F.lit("saved").alias("provenance"), F.lit(-1).cast("bigint").alias("ord"))


def _names_at(n1: str, n2: str) -> Column:
    """Names (none, one, two or more) a cluster holds when the pair comes."""
    return (F.col(n1) < F.col("ord")).cast("int") + (F.col(n2) < F.col("ord")).cast("int")


def _with_names(pairs: DataFrame, names: DataFrame) -> DataFrame:
    for side in ("1", "2"):
        pairs = pairs.join(names.select(F.col("tree").alias("t" + side), F.col("n1").alias("first" + side),
                                        F.col("n2").alias("second" + side)), "t" + side, "left")
    return pairs.fillna(NEVER, ["first1", "second1", "first2", "second2"])


def _certain(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The open pairs that merge whatever else happens."""
    ends = pairs.select(F.col("t1").alias("tree"), "ord").union(pairs.select("t2", "ord"))
    first = ends.groupBy("tree").agg(F.min("ord").alias("first")).join(names, "tree", "left").fillna(NEVER, ["n1", "n2"])
    parts = components(pairs, "t1", "t2").withColumnRenamed("node", "tree")
    nodes = cut(first.join(parts, "tree"))
    # the times of names in a component: its second one, and the first that may close a cluster
    times = nodes.select("component", "tree", F.explode(F.array("n1", "n2")).alias("at"))
    ranked = keep_first(times, ["component"], ["at", "tree"], 2).groupBy("component").agg(
        F.max("at").alias("second"))
    late = F.when(F.col("n1") > F.col("first"), F.col("n1")).otherwise(NEVER)
    closing = nodes.groupBy("component").agg(F.min(F.least(late, "n2")).alias("closing"))
    known = nodes.join(ranked, "component").join(closing, "component")
    side = lambda n: known.select(F.col("tree").alias(f"t{n}"), F.col("first").alias(f"first{n}"), F.col("n1").alias(f"n{n}"),
                                  *(["second", "closing"] if n == 1 else []))
    both = pairs.select("t1", "t2", "ord").join(side(1), "t1").join(side(2), "t2")
    at = lambda n: F.col(f"first{n}") == F.col("ord")
    alone = lambda n: at(n) & ((F.col("ord") <= F.col("second")) | ((F.col(f"n{n}") > F.col("ord")) & (F.col("ord") <= F.col("closing"))))
    return both.filter((at(1) & at(2)) | alone(1) | alone(2)).select("t1", "t2", "ord")


def _earliest_at_both(pairs: DataFrame) -> DataFrame:
    """The pairs that are the earliest open ones at both their trees. No two of them share a tree."""
    ends = pairs.select(F.col("t1").alias("tree"), "ord").union(pairs.select("t2", "ord"))
    first = ends.groupBy("tree").agg(F.min("ord").alias("ord"))
    for side in ("t1", "t2"):
        pairs = pairs.join(first.withColumnRenamed("tree", side), [side, "ord"], "left_semi")
    return pairs.select("t1", "t2", "ord")


def _merging_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """ord of the pairs (t1, t2, ord), t1 < t2, that merge two trees."""
    decided = pairs.select("ord").limit(0)
    while True:
        pairs = cut(_with_names(pairs, names).filter(
            _names_at("first1", "second1") + _names_at("first2", "second2") < 2).select("t1", "t2", "ord"))
        if pairs.isEmpty():
            return decided
        ready = cut(_earliest_at_both(pairs))
        if ready.count() * FEW >= pairs.count():
            moved = ready.select(F.col("t2").alias("tree"), F.col("t1").alias("into"))
        else:
            ready = cut(_certain(pairs, names))
            moved = components(ready, "t1", "t2").select(F.col("node").alias("tree"), F.col("component").alias("into"))
        decided = decided.union(ready.select("ord"))
        new = lambda df, c: (df.join(moved.withColumnRenamed("tree", c), c, "left")
                               .withColumn(c, F.coalesce("into", c)).drop("into"))
        open_pairs = new(new(pairs, "t1"), "t2").filter("t1 <> t2")
        pairs = open_pairs.groupBy(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2")).agg(
            F.min("ord").alias("ord"))
        # the two earliest names of what was put together
        times = new(names, "tree").select("tree", F.explode(F.array("n1", "n2")).alias("at")).filter(F.col("at") < NEVER)
        two = keep_first(times, ["tree"], ["at"], 2).groupBy("tree").agg(F.min("at").alias("n1"), F.max("at").alias("n2"), F.count("*").alias("_k"))
        names = cut(two.select("tree", "n1", F.when(F.col("_k") == 2, F.col("n2")).otherwise(NEVER).alias("n2")))


def alias_clusters(pairs: DataFrame) -> DataFrame:
    """(alias, cluster) of pairs (alias1, alias2, ord); the cluster is its smallest alias
    among the trees it is made of. See `merged_pairs` for what joined them."""
    return _cluster(pairs)[0]


def _cluster(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = pairs.select(F.col("alias1").alias("alias"), "ord").union(pairs.select("alias2", "ord"))
    met = ends.groupBy("alias").agg(F.min("ord").alias("met"))
    at = lambda n: met.select(F.col("alias").alias(f"alias{n}"), F.col("met").alias(f"met{n}"))
    timed = cut(pairs.join(at(1), "alias1").join(at(2), "alias2").withColumn(
        "brings_name", (F.col("ord") == F.col("met1")) | (F.col("ord") == F.col("met2"))))
    trees = cut(components(timed.filter("brings_name"), "alias1", "alias2").select(
        F.col("node").alias("alias"), F.col("component").alias("tree")))

    # The two earliest names of each tree.
    names = met.filter(~is_email("alias")).join(trees, "alias").withColumn("_late", -F.col("met"))
    first = keep_last(names, ["tree"], ["_late", "alias"])
    rest = names.join(first.select("tree", "alias"), ["tree", "alias"], "left_anti")
    second = keep_last(rest, ["tree"], ["_late", "alias"])
    names = first.select("tree", F.col("met").alias("n1")).join(
        second.select("tree", F.col("met").alias("n2")), "tree", "left").fillna(NEVER, ["n2"])

    tree = lambda n: trees.select(F.col("alias").alias(f"alias{n}"), F.col("tree").alias(f"t{n}"))
    between = timed.filter("NOT brings_name").join(tree(1), "alias1").join(tree(2), "alias2").filter("t1 <> t2")
    open_pairs = between.groupBy(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2")).agg(
        F.min("ord").alias("ord"))
    open_pairs = cut(open_pairs)
    merging = cut(_merging_pairs(open_pairs, names))
    joined = components(open_pairs.join(merging, "ord", "left_semi"), "t1", "t2").select(
        F.col("node").alias("tree"), "component")
    clusters = trees.join(joined, "tree", "left").select(
        "alias", F.coalesce("component", "tree").alias("cluster"))
    used = timed.join(merging.withColumn("merges", F.lit(True)), "ord", "left").filter("brings_name OR merges")
    return clusters, used.select("alias1", "alias2", "provenance", "ord", "brings_name")


def canonical_names(clusters: DataFrame) -> DataFrame:
    """(alias, canonical): the smallest name that is no e-mail, else the smallest."""
    name = F.coalesce(F.min(F.when(~is_email("alias"), F.col("alias"))), F.min("alias"))
    return clusters.join(clusters.groupBy("cluster").agg(name.alias("canonical")), "cluster").select("alias", "canonical")


def refused_pairs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs whose sides stayed apart: a refusal is final, an accepted pair is one cluster."""
    side = lambda n: clusters.select(F.col("alias").alias(f"alias{n}"), F.col("cluster").alias(f"cluster{n}"))
    return pairs.join(side(1), "alias1").join(side(2), "alias2").filter("cluster1 <> cluster2").select(
        "alias1", "alias2", "provenance")


def resumed(pairs: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and used pairs after new pairs on top of saved clusters (alias, cluster). A pair changes only clusters that it
    names, so the others are carried over; only the named ones are clustered anew, each as it was saved."""
    named = pairs.select(F.col("alias1").alias("alias")).union(pairs.select("alias2")).distinct()
    touched = cut(saved.join(named, "alias", "left_semi").select("cluster").distinct())
    clusters, used = _cluster(saved_pairs(saved.join(touched, "cluster", "left_semi")).unionByName(pairs))
    carried = saved.join(touched, "cluster", "left_anti").select("alias", "cluster")
    return clusters.unionByName(carried), used


def cluster_provenance(pairs: DataFrame) -> DataFrame:
    """(cluster, text): why the members are together, one row per reason. Pairs of
    saved clusters give none, see `carried_provenance`."""
    return clusters_and_reasons(pairs)[1]


def clusters_and_reasons(pairs: DataFrame, saved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The clusters and their reasons out of one run, on top of saved clusters if there are any."""
    clusters, used = _cluster(pairs) if saved is None else resumed(pairs, saved)
    both = F.concat("provenance", F.lit(" ("), "alias1", F.lit("="), "alias2", F.lit(")"))
    reason = F.when(F.col("brings_name"), both).otherwise(F.col("provenance"))
    reasons = used.filter(F.col("ord") >= 0).select(F.col("alias1").alias("alias"), reason.alias("text"))
    return clusters, reasons.join(clusters, "alias").select("cluster", "text").distinct()


def carried_provenance(saved: DataFrame, clusters: DataFrame) -> DataFrame:
    """Reasons saved for old clusters (cluster, text) under the clusters they are in now;
    an old cluster is named by one of its aliases."""
    now = clusters.select(F.col("alias").alias("_old"), F.col("cluster").alias("_now"))
    return saved.join(now, F.col("cluster") == F.col("_old")).select(F.col("_now").alias("cluster"), "text").distinct()


def canonical_of(rows: DataFrame, column: str, canonical: DataFrame) -> DataFrame:
    """Replace a column by its canonical name; an unknown value is itself."""
    known = canonical.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = rows.join(known, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")
