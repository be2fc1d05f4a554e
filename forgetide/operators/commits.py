"""Commit metrics and the commit graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.functions.periods import period_label
from forgetide.operators import metrics as M
from forgetide.operators.identity import canonical_of
from forgetide.operators.ordinals import ordinal
from forgetide.session import cut, scratch_path
from forgetide.sources.store import keep_last
BLOCK_ROWS = 1 << 16  # commits whose lines one task follows

# Folder names that mark a test file.
TEST_FOLDERS = ["test", "tests", "spec"]
FILE_MEASURES = ["num_files_existing", "num_py_files_existing", "num_rb_files_existing", "num_test_files_existing"]


def likely_test(path: Column | str) -> Column:
    whole = F.concat(F.lit("/"), path, F.lit("/"))
    return reduce(or_, (whole.contains(f"/{folder}/") for folder in TEST_FOLDERS))


def path_classes(path: Column | str) -> dict[str, Column]:
    path = F.col(path) if isinstance(path, str) else path
    return {"is_py": path.endswith(".py"), "is_rb": path.endswith(".rb"), "is_test": likely_test(path)}


def file_counts(files: DataFrame) -> DataFrame:
    """Files of each commit: all, .py, .rb and test files."""
    kinds = path_classes("path")
    return files.groupBy("project", "sha").agg(
        F.count("*").alias(FILE_MEASURES[0]),
        *[F.count_if(kinds[k]).alias(m) for k, m in zip(("is_py", "is_rb", "is_test"), FILE_MEASURES[1:])])


def resolved(commits: DataFrame, canonical: DataFrame) -> DataFrame:
    """Author (the committer where absent) and committer as canonical names."""
    filled = commits.withColumn("author_email", F.coalesce("author_email", "committer_email"))
    return canonical_of(canonical_of(filled, "author_email", canonical), "committer_email", canonical)


def coordinating_merges(commits: DataFrame) -> DataFrame:
    """Merges of someone else's work: the committer differs from that of one of the
    first two parents, or a parent is unknown. `commits` is resolved."""
    who = commits.select("project", "sha", "committer_email")
    parent = lambda n: who.select("project", F.col("sha").alias(f"_p{n}"), F.col("committer_email").alias(f"_c{n}"))
    merges = commits.filter(F.size("parents") > 1).withColumns(
        {"_p0": F.col("parents")[0], "_p1": F.col("parents")[1]})
    joined = merges.join(parent(0), ["project", "_p0"], "left").join(parent(1), ["project", "_p1"], "left")
    others = lambda c: F.coalesce(F.col(c) != F.col("committer_email"), F.lit(True))
    return joined.filter(others("_c0") | others("_c1")).drop("_p0", "_p1", "_c0", "_c1")


def dated(commits: DataFrame, canonical: DataFrame, grain: str = "month") -> tuple[DataFrame, DataFrame]:
    """Resolved commits with their period, and the coordinating merges among them. Both
    are read several times by the measures, so both are written once."""
    rows = cut(resolved(commits, canonical).select(
        "project", "sha", "parents", "author_email", "committer_email",
        period_label("committed_date", grain).alias("period"), F.date_trunc(grain, "committed_date").alias("start")))
    return rows, cut(coordinating_merges(rows))


def member_rows(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """(project, period, start, measure, member) of all distinct-member measures; start is the time at which the period starts."""
    named = lambda measure, member: F.struct(F.lit(measure).alias("measure"), F.col(member).alias("member"))
    each = rows.select("project", "period", "start", F.inline(F.array(
        named("commits_recheck", "sha"), named("commit_authors_email", "author_email"),
        named("commit_committers_email", "committer_email"))))
    return each.unionByName(merges.select("project", "period", "start", F.lit("mergers_email").alias("measure"),
                                          F.col("committer_email").alias("member")))


def stays(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """(project, measure, member, first, last): the starts of the first and last period of each member. Times are compared, not
    labels, so that the aggregation hashes and does not sort."""
    return member_rows(rows, merges).groupBy("project", "measure", "member").agg(
        F.min("start").alias("first"), F.max("start").alias("last"))


def member_moves(members: DataFrame, measures: Sequence[str], grain: str) -> DataFrame:
    """(project, measure, period, n) of members that arrive and leave, from what `stays` gives; a null member is one too."""
    moved = members.filter(F.col("measure").isin(list(measures))).select("project", F.inline(F.array(*[
        F.struct(F.concat(F.lit(side + "_"), "measure").alias("measure"), period_label(edge, grain).alias("period"))
        for side, edge in (("arriving", "first"), ("leaving", "last"))])), F.lit(1).alias("num"))
    return M.count_sum(moved, keys=["project", "measure", "period"])


def commit_metrics(rows: DataFrame, merges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(project, measure, period, n): commits, authors, committers, mergers and merges. Totals are counted from `members`, what
    `stays` gives, which holds every member once."""
    keys = ["project", "measure", "period"]
    unique = member_rows(rows, merges).groupBy(keys).agg(F.count_distinct("member").alias("n"))
    members = stays(rows, merges) if members is None else members
    totals = members.groupBy("project", "measure").agg(F.count("member").alias("n")).withColumn("period", F.lit(M.TOTAL))
    sums = M.count_sum(merges.select("project", "period", F.lit("merges").alias("measure"), F.lit(1).alias("num")),
                       keys=keys)
    return unique.unionByName(totals).unionByName(sums)


def file_snapshot(commits: DataFrame, files: DataFrame, grain: str = "month") -> DataFrame:
    """File counts at the newest commit of each project and period; the total is the
    largest. Files are counted per commit first, so that counts are sorted for the join and not files."""
    newest = keep_last(commits.select("project", "sha", "committed_date",
                                      period_label("committed_date", grain).alias("period")),
                       ["project", "period"], ["committed_date", "sha"])
    cells = newest.join(file_counts(files), ["project", "sha"], "left").fillna(0, FILE_MEASURES)
    totals = cells.groupBy("project").agg(*[F.max(m).alias(m) for m in FILE_MEASURES]).withColumn(
        "period", F.lit(M.TOTAL))
    return cells.select("project", "period", *FILE_MEASURES).unionByName(totals)


def newest_first(commits: DataFrame) -> DataFrame:
    """Commits with their place in the project's history, newest first, equal times by
    sha, undated ones last."""
    return ordinal(commits, ["project"], [F.desc_nulls_last("committed_date"), F.asc("sha")], "ix")


def newest_heads(commits: DataFrame) -> DataFrame:
    """The newest commit of each project, for histories without a recorded head."""
    return keep_last(commits.select("project", "sha", "committed_date"), ["project"], ["committed_date", "sha"])


def _block_functions() -> tuple[Callable, Callable]:
    """What is done inside one block. The functions are local, so they travel to the executors as they are."""
    def up_rows(rows: pd.DataFrame) -> np.ndarray:
        """Which row of a block holds each row's first parent, -1 for none."""
        names = rows["project"] + "\0" + rows["sha"]
        codes, known = pd.factorize(names)
        first = np.full(len(known), -1)
        first[codes[::-1]] = np.arange(len(rows))[::-1]
        at = pd.Index(known).get_indexer(rows["project"] + "\0" + rows["up"])
        return np.where(rows["up"].notna().to_numpy() & (at >= 0), first[at] if len(first) else at, -1)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each commit of a block with the parent at which its line leaves the block, and how many commits on that is."""
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        rows = pa.Table.from_batches(held).to_pandas()
        up = up_rows(rows)
        last, steps = np.where(up >= 0, up, np.arange(len(rows))), (up >= 0).astype(np.int64)
        while (steps[last] > 0).any():  # pointer doubling inside the block
            steps, last = steps + steps[last], last[last]
        out = rows.assign(block=TaskContext.get().partitionId(), leaves=rows["up"].to_numpy()[last], steps=steps + 1)
        kinds = {"block": pa.int32(), "steps": pa.int64()}
        yield pa.RecordBatch.from_pandas(out, pa.schema([(c, kinds.get(c, pa.string())) for c in out.columns]), preserve_index=False)

    def on_line(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        """The commits of a block that lines run through, from the commit where each comes in."""
        up = up_rows(rows).tolist()
        row_of = {name: row for row, name in reversed(list(enumerate(zip(rows["project"], rows["sha"]))))}
        found, places = [], []
        for project, sha, ix in zip(entries["project"], entries["sha"], entries["ix"]):
            row = row_of[project, sha]
            while row >= 0:
                found.append(row)
                places.append(ix)
                row, ix = up[row], ix + 1
        return rows.iloc[found][["project", "sha"]].assign(ix=np.array(places, np.int64))

    return exits, on_line


def mainline(commits: DataFrame, heads: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(project, sha, ix) of the first-parent chain from each head. (project, sha) is unique in `commits`.

    Commits are dealt by project and time into blocks of about `block_rows`. Inside a block every line is followed to where it
    leaves, so what is left between blocks is a short list of the commits where lines come in; a jump table over these leads 1, 2, 4,
    ... of them back. Then the lines that heads reach are written out block by block. A commit that is named as a parent but has no
    row ends its line and is on it. Without `committed_date` blocks are cut by sha, which is as right but leaves longer lists."""
    dated = [c for c in ("committed_date",) if c in commits.columns]
    exits, on_line = _block_functions()
    rows = commits.select("project", "sha", F.try_element_at("parents", F.lit(1)).alias("up"), *dated)
    blocks = rows.count() // block_rows + 1
    path = scratch_path(commits.sparkSession, "blocks")
    dealt = rows.repartitionByRange(blocks, "project", *dated, "sha").drop(*dated)
    dealt.mapInArrow(exits, "project string, sha string, up string, block int, leaves string, steps bigint").write.parquet(path)
    located = commits.sparkSession.read.parquet(path)
    leaving = located.filter("leaves IS NOT NULL")
    # a line comes in at a head or where another block's line goes
    entries = leaving.select("project", F.col("leaves").alias("sha")).union(heads.select("project", "sha")).distinct()
    jump = cut(leaving.select("project", "sha", F.col("leaves").alias("up"), "steps").join(entries, ["project", "sha"], "left_semi"))
    line = cut(heads.select("project", "sha", F.lit(0).cast("bigint").alias("ix")))
    while True:
        ahead = cut(line.join(jump, ["project", "sha"]).select("project", F.col("up").alias("sha"), (F.col("ix") + F.col("steps")).alias("ix")))
        if ahead.isEmpty():
            break
        line = line.union(ahead)
        further = jump.select("project", F.col("sha").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        jump = cut(jump.join(further, ["project", "up"]).select("project", "sha", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps")))
    placed = cut(line.join(located.select("project", "sha", "block"), ["project", "sha"], "left"))
    touched = located.join(placed.select("block").distinct(), "block", "left_semi").select("block", "project", "sha", "up")
    inside = placed.filter("block IS NOT NULL").select(F.col("block").alias("at"), "project", "sha", "ix")
    walked = touched.groupBy("block").cogroup(inside.groupBy("at")).applyInPandas(on_line, "project string, sha string, ix bigint")
    return walked.unionByName(placed.filter("block IS NULL").select("project", "sha", "ix"))
