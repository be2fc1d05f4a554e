"""One row shape for archive events of every year.

Three shapes occur: `repo` and `actor` objects; `repository`, an actor string and
`actor_attributes`; and only a `url` or `payload.repo`. Each column takes the first
source that is there; a column is computed only if a later step reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.functions.documents import get, present
from forgetide.session import cut

# Fixed values.
PLACEHOLDER_ACTOR_URL = "https://api.github.dev/users/"
SKIPPED_TYPES = ["FollowEvent", "GistEvent"]
API_ROOT = "https://api.github.com/repos/"


# What is read of a document, of its payload and of the comment in it. A part that comes as an object or as plain
# text stays a variant.
DOCUMENT = """struct<`type`:string, `id`:string, `url`:variant, `created_at`:string, `repo`:struct<`id`:bigint, `name`:string>,
  `repository`:struct<`id`:bigint, `owner`:string, `name`:string>, `actor`:variant, `actor_attributes`:struct<`login`:string>,
  `member`:variant, `member_attributes`:struct<`login`:string>, `payload`:variant>"""
PAYLOAD = """struct<`repo`:variant, `actor`:variant, `member`:variant, `pages`:array<variant>, `shas`:array<variant>, `commits`:array<variant>,
  `forkee`:struct<`full_name`:string>, `ref`:string, `ref_type`:string, `object`:string, `object_name`:string, `action`:string,
  `manager`:string, `number`:int, `issue`:struct<`number`:int, `title`:string, `body`:string>, `pull_request`:struct<`number`:string,
  `merged_at`:string, `title`:string, `base`:struct<`ref`:string>, `head`:struct<`ref`:string>>, `release`:struct<`tag_name`:string,
  `target_commitish`:string, `author`:struct<`login`:string>>, `comment`:variant, `comment_id`:string, `commit`:string>"""
COMMENT = """struct<`id`:string, `commit_id`:string, `original_commit_id`:string, `path`:string, `position`:int, `original_position`:int,
  `body`:string, `html_url`:string, `_links`:struct<`html`:struct<`href`:string>>, `pull_request_url`:string>"""


def opened(records: DataFrame) -> DataFrame:
    """Add `_d`, `_p` and `_c`: the document, its payload and the comment in it as structs. Each is gone through once, where a lookup
    of every field by its path would start at the document's first key again. The row id keeps later filters above this step."""
    document = F.when(F.monotonically_increasing_id() >= 0, get("v", "$", DOCUMENT))
    return (records.withColumn("_d", document).withColumn("_p", get("_d.payload", "$", PAYLOAD))
                   .withColumn("_c", get("_p.comment", "$", COMMENT)))


def _plain(part: str) -> Column:
    """A variant column if it is a string."""
    return F.when(F.schema_of_variant(part) == "STRING", get(part, "$"))


def person(kind: str) -> Column:
    return F.coalesce(F.col(f"_d.{kind}_attributes.login"), get(f"_d.{kind}", "login"), _plain(f"_d.{kind}"),
                      get(f"_p.{kind}", "login"), _plain(f"_p.{kind}"))


def repo_id() -> Column:
    return F.coalesce("_d.repo.id", "_d.repository.id")


def with_full_name(rows: DataFrame) -> DataFrame:
    """Add `project`, owner/name; null when no source gives one. Built in steps, so
    that each value is worked out once."""
    url = F.col("_url")
    listed = F.concat("_d.repository.owner", F.lit("/"), "_d.repository.name")
    from_url = F.array_join(F.slice(F.split(url, "/"), 4, 2), "/")
    after_host = F.split(F.try_element_at(F.split(url, "github.com/"), F.lit(2)), "/")
    derived = F.concat_ws("/", F.try_element_at(after_host, F.lit(1)), F.try_element_at(after_host, F.lit(2)))
    rooted = F.col("_name").startswith("/")
    fixed = F.when(~rooted & (F.col("_name") != ""), F.col("_name")).when(
        rooted & (F.length("_name") > 1) & url.contains("github.com/") & ~derived.startswith("/"), derived)
    return (rows.withColumn("_url", _plain("_d.url"))
                .withColumn("_name", F.coalesce(_plain("_p.repo"), F.col("_d.repo.name"), listed, from_url))
                .withColumn("project", fixed).drop("_url", "_name"))


def created_at(value: Column | None = None) -> Column:
    value = get("v", "created_at") if value is None else value
    return F.coalesce(F.try_to_timestamp(value),
                      F.try_to_timestamp(value, F.lit("yyyy/MM/dd HH:mm:ss Z")))


def wiki_pages() -> Column:
    return F.coalesce("_p.pages", F.array("_d.payload"))


def pushed_shas() -> Column:
    old = F.transform("_p.shas", lambda s: get(s, "$[0]"))
    new = F.transform("_p.commits", lambda c: get(c, "sha"))
    return F.coalesce(old, new)


def created_what(project: Column, kind: Column) -> Column:
    return F.coalesce(F.col("_p.ref"), F.col("_p.object_name"), F.when(kind == "repository", project))


def commit_comment(project: Column) -> dict[str, Column]:
    has = F.col("_p.comment").isNotNull()  # JSON null included
    number = F.when(has, F.col("_c.id")).otherwise(F.col("_p.comment_id"))
    return {
        "commit_comment_id": number,
        "commit_comment_url": F.concat(F.lit(API_ROOT), project, F.lit("/comments/"), number),
        "commit_comment_sha": F.when(has, F.col("_c.commit_id")).otherwise(F.col("_p.commit")),
        "commit_comment": F.when(has, F.col("_c.body")).otherwise(F.lit("")),
    }


def branches(event_type: Column) -> dict[str, Column]:
    def side(name):
        return (F.when(event_type == "PullRequestEvent", F.col(f"_p.pull_request.{name}.ref"))
                 .when(event_type == "PushEvent", F.col("_p.ref")))
    return {"into_branch": side("base"), "from_branch": side("head")}


def review_comment() -> dict[str, Column]:
    field = lambda n: F.col(f"_c.{n}")
    last_part = F.try_element_at(F.split(field("pull_request_url"), "/"), F.lit(-1))
    return {
        "path": field("path"), "position": field("position"),
        "original_position": field("original_position"),
        "commit_sha": field("commit_id"), "original_commit_sha": field("original_commit_id"),
        "body": field("body"),
        "html_url": F.coalesce(field("html_url"), field("_links.html.href")),
        "pr_num": F.coalesce(F.col("_p.pull_request.number"), last_part).try_cast("int"),
    }


def normalise(records: DataFrame) -> DataFrame:
    """Parsed records (`v`, `seq`) to event rows."""
    base = with_full_name(opened(records)).withColumns({
        "event_type": F.col("_d.type"), "event_id": F.col("_d.id"), "repo_id": repo_id(),
        "actor": person("actor"), "created_at": created_at(F.col("_d.created_at")),
    })
    project = F.col("project")
    what_type = F.coalesce("_p.ref_type", "_p.object")
    return base.withColumns({
        "repo_owner": F.split_part(project, F.lit("/"), F.lit(1)),
        "repo_name": F.split_part(project, F.lit("/"), F.lit(2)),
        "actor_url": get("_d.actor", "url"),
        "pages": wiki_pages(), "shas": pushed_shas(),
        "forked_to": F.coalesce(F.col("_p.forkee.full_name"), F.concat(
            F.col("actor"), F.lit("/"), F.split_part(project, F.lit("/"), F.lit(2)))),
        "what": created_what(project, what_type), "what_type": what_type,
        "action": F.col("_p.action"),
        "pr_merged": F.col("_p.pull_request.merged_at"),
        "pr_title": F.col("_p.pull_request.title"),
        "issue_number": F.coalesce("_p.issue.number", "_p.number"),
        "issue_title": F.col("_p.issue.title"), "issue_body": F.col("_p.issue.body"),
        "member": person("member"), "manager": F.col("_p.manager"),
        "author": F.coalesce("_p.release.author.login", "_d.actor_attributes.login"),
        "tag": F.col("_p.release.tag_name"),
        "target_commitish": F.col("_p.release.target_commitish"),
        **commit_comment(project), **branches(F.col("event_type")), **review_comment(),
    }).drop("_d", "_p", "_c")


def not_placeholder(events: DataFrame) -> DataFrame:
    """Drop records whose actor is the placeholder user."""
    return events.filter(F.coalesce(F.col("actor_url") != PLACEHOLDER_ACTOR_URL, F.lit(True)))


def not_skipped(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("event_type").isin(SKIPPED_TYPES))


def usable(events: DataFrame) -> DataFrame:
    """Events of real users on a known repository, of the types that are kept."""
    return not_placeholder(not_skipped(events)).filter("project IS NOT NULL")


def learned_names(events: DataFrame, canon: DataFrame) -> DataFrame:
    """Names met under a known repository id."""
    known = canon.select(F.col("id").alias("repo_id")).distinct()
    return (events.select("repo_id", F.lower("project").alias("name")).distinct()
                  .join(known, "repo_id", "left_semi").select("name").distinct())


def all_aliases(canon: DataFrame) -> DataFrame:
    return canon.select(F.explode("aliases").alias("name")).distinct()


def known_names(events: DataFrame, canon: DataFrame) -> DataFrame:
    """The aliases, and the names learned from anywhere in the events."""
    return all_aliases(canon).union(learned_names(events, canon)).distinct()


def _id_key() -> Column:
    """repo_id as a join key. Old records have none; they get scattered negative keys,
    which match no id, instead of one null key that all of them share."""
    return F.coalesce("repo_id", -F.pmod(F.xxhash64("project", "created_at"), F.lit(1 << 40)) - 10)


def by_id(events: DataFrame, canon: DataFrame, how: str = "left_semi") -> DataFrame:
    """Events under a known repository id, or with how="left_anti" the others."""
    ids = canon.select(F.col("id").alias("_id")).distinct()
    return events.join(ids, _id_key() == F.col("_id"), how)


def in_projects(events: DataFrame, canon: DataFrame, names: DataFrame) -> DataFrame:
    """Events of the chosen projects: a known id, or one of `names`. Two equality joins
    give two flags; one join on either condition would compare all pairs."""
    names = names.select(F.col("name").alias("_name"), F.lit(True).alias("_by_name"))
    ids = canon.select(F.col("id").alias("_id")).distinct().withColumn("_by_id", F.lit(True))
    flagged = (events.join(ids, _id_key() == F.col("_id"), "left")
                     .join(names, F.lower("project") == F.col("_name"), "left"))
    return flagged.filter("_by_id OR _by_name").drop("_id", "_by_id", "_name", "_by_name")


def canonical_project(events: DataFrame, canon: DataFrame) -> DataFrame:
    """Add github_project_id and canonical_project: by id, else by alias, else the
    lower-cased name with id -2 when there is none. An alias of several ids takes the
    smallest."""
    by_id = canon.select(F.col("id").alias("_id"), F.col("canonical").alias("_c1"))
    by_name = (canon.select("id", "canonical", F.explode("aliases").alias("_alias"))
                    .groupBy("_alias").agg(F.min_by("canonical", "id").alias("_c2"), F.min("id").alias("_id2")))
    joined = (events.join(by_id, _id_key() == F.col("_id"), "left")
                    .join(by_name, F.lower("project") == F.col("_alias"), "left"))
    return joined.withColumns({
        "github_project_id": F.coalesce("repo_id", "_id2", F.lit(-2)),
        "canonical_project": F.coalesce("_c1", "_c2", F.lower("project")),
    }).drop("_id", "_c1", "_alias", "_c2", "_id2")


def alias_table(events: DataFrame) -> DataFrame:
    """Names seen under each repository id."""
    return events.filter("repo_id IS NOT NULL").select(
        F.col("repo_id").alias("github_project_id"), F.lower("project").alias("full_name")).distinct()


def canonical_list(events: DataFrame, order: str = "seq") -> DataFrame:
    """Per id its names and the most recent one. Names per id are few (renames); they
    are made distinct before they are gathered."""
    names = events.filter("repo_id IS NOT NULL AND project IS NOT NULL").select(
        F.col("repo_id").alias("id"), F.lower("project").alias("name"), order)
    last = names.groupBy("id", "name").agg(F.max(order).alias("_last"))
    return last.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("aliases"),
                                  F.max_by("name", "_last").alias("canonical"))


def classify(records: DataFrame) -> DataFrame:
    """The uniform activity row of any event; old records lack issue texts."""
    old = present("v", "repository")
    kind = get("v", "type")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json(get("v", "payload", "variant")))), "//")
    issue, pull = "payload.issue", "payload.pull_request"
    is_issue, is_comment, is_pull = (kind == k for k in ("IssuesEvent", "IssueCommentEvent", "PullRequestEvent"))
    new_comment = present("v", "repo")
    repo = get("v", "repo.name")
    return records.select(
        "seq", created_at().alias("time"), kind.alias("rectype"),
        F.when(old, get("v", "repository.owner")).otherwise(F.split_part(repo, F.lit("/"), F.lit(1))).alias("project_owner"),
        F.when(old, get("v", "repository.name")).otherwise(F.split_part(repo, F.lit("/"), F.lit(2))).alias("project_name"),
        F.when(old, get("v", "actor_attributes.login")).otherwise(get("v", "actor.login")).alias("actor"),
        F.when(is_issue & old, get("v", "payload.number")).when(is_issue, get("v", f"{issue}.number"))
         .when(is_comment & new_comment, get("v", f"{issue}.id"))
         .when(is_comment, F.lit("missing issue number (pre 2015)"))
         .when(is_pull, get("v", f"{pull}.number")).otherwise(F.lit("unknown")).alias("issueid"),
        get("v", "payload.action").alias("action"),
        F.when(is_issue & old, F.lit("missing issue title (pre 2015)"))
         .when(is_issue | (is_comment & new_comment), get("v", f"{issue}.title"))
         .when(is_comment, F.lit("missing issue comment title (pre 2015)"))
         .when(is_pull, get("v", f"{pull}.title")).otherwise(F.lit("")).alias("title"),
        F.lit("githubarchive").alias("provenance"),
        F.when(is_issue & old, F.lit("missing issue text (pre 2015)")).when(is_issue, get("v", f"{issue}.body"))
         .when(is_comment & new_comment, get("v", "payload.comment.body"))
         .when(is_comment, F.lit("missing issue comment text (pre 2015)"))
         .when(is_pull, get("v", f"{pull}.body")).otherwise(keys).alias("text"))


def mentions_number(records: DataFrame, owner: str, project: str, number: int) -> DataFrame:
    """Records of one project that hold "number": `number` at any depth. The project
    is tested first. A quote inside a string is escaped in JSON text, so the pattern
    meets keys only."""
    same = F.when(present("v", "repository"),
                  (get("v", "repository.name") == project) & (get("v", "repository.owner") == owner)
                  ).otherwise(get("v", "repo.name") == f"{owner}/{project}")
    found = F.regexp_extract_all(F.to_json("v"), F.lit(r'"number":\s*"?(\d+)'), F.lit(1))
    return records.filter(same).filter(F.array_contains(found, str(number)))


def find_payload(records: DataFrame, event_type: str, part: str, number: int) -> DataFrame:
    """Events of a type whose payload part has the given id."""
    return records.filter((get("v", "type") == event_type)
                          & (get("v", f"payload.{part}.id", "long") == number))


def _lookup(found: DataFrame, issueid: Column, body: str) -> DataFrame:
    repo = get("v", "repo.name")
    return found.select(
        "seq", get("v", "type").alias("rectype"), issueid.alias("issueid"),
        F.split_part(repo, F.lit("/"), F.lit(1)).alias("project_owner"),
        F.split_part(repo, F.lit("/"), F.lit(2)).alias("project_name"), get("v", "actor.login").alias("actor"),
        created_at().alias("time"), get("v", "payload.action").alias("action"),
        get("v", "payload.issue.title").alias("title"), F.lit("githubarchive").alias("provenance"),
        get("v", body).alias("text"))


def issue_lookup(records: DataFrame, number: int) -> DataFrame:
    """What happened to the issue with this id, in the records of its hour."""
    found = find_payload(records, "IssuesEvent", "issue", number)
    return _lookup(found, F.lit(str(number)), "payload.issue.body")


def issue_comment_lookup(records: DataFrame, number: int) -> DataFrame:
    """The comment with this id, in the records of its hour."""
    found = find_payload(records, "IssueCommentEvent", "comment", number)
    return _lookup(found, get("v", "payload.issue.id"), "payload.comment.body")


def key_signatures(records: DataFrame, names: tuple[str, ...] = ("repo", "repository")) -> DataFrame:
    """Distinct key sets of the objects under each name, at any depth: every round opens the objects and arrays that the last
    one found, so there are as many rounds as levels."""
    tvf, found, level = records.sparkSession.tvf, None, records.select(F.col("v").alias("_inner"))
    while True:
        inner = level.select("_inner").lateralJoin(tvf.variant_explode(F.col("_inner").outer())).select("key", F.col("value").alias("_inner"))
        kind = F.schema_of_variant("_inner")
        level = cut(inner.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        if level.isEmpty():
            break
        keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json("_inner"))), "//")
        here = level.filter(F.col("key").isin(*names)).select(F.col("key").alias("name"), keys.alias("keys")).filter("keys IS NOT NULL").distinct()
        found = here if found is None else found.union(here)
    empty = records.sparkSession.createDataFrame([], "name string, keys string")
    return empty if found is None else found.distinct()
