"""Forge-shaped inputs derived from the test tables.

The test tables hold no forge data, so each input is a list of column expressions
over one table, in SQL that Spark and DuckDB both read. `frame` gives the Spark
DataFrame, `sql` the DuckDB subquery. Text is composed with templates: in
t('user<user_id>') the part in angle brackets is an expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


DIALECTS = {
    "spark": {"iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
              "day": "date_format({0}, 'yyyyMMdd')", "idiv": "({0} div {1})"},
    "duckdb": {"iso": "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')",
               "day": "strftime({0}, '%Y%m%d')", "idiv": "({0} // {1})"},
}


def t(template: str) -> str:
    """A template as a SQL concatenation."""
    parts = re.split(r"<([^<>]+)>", template)
    out = [f"CAST({p} AS STRING)" if i % 2 else "'" + p.replace("'", "''") + "'"
           for i, p in enumerate(parts) if p or i % 2]
    return "concat(" + ", ".join(out) + ")"


def render(sql: str, dialect: str) -> str:
    """Fill the $iso(x), $day(x) and $idiv(x, y) marks for one engine."""
    for name, form in DIALECTS[dialect].items():
        sql = re.sub(rf"\${name}\(([^(),]+)(?:, ([^(),]+))?\)",
                     lambda m, f=form: f.format(m.group(1), m.group(2)), sql)
    return sql


@dataclass
class Input:
    """Columns over a table or over another input, one layer per expression list."""
    table: str
    layers: list[list[str]] = field(default_factory=list)

    def then(self, *columns: str) -> "Input":
        return Input(self.table, [*self.layers, list(columns)])

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self._over(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"))

    def heavy(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same for jobs whose work per row is large: the rows of the table, one file, are
        dealt out first."""
        source = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        names = set(re.findall(r"[a-z_]+", " ".join(self.layers[0])))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return self._over(source.select(*[c for c in source.columns if c in names]).repartition(parts))

    def _over(self, df: DataFrame) -> DataFrame:
        for layer in self.layers:
            df = df.selectExpr(*[render(c, "spark") for c in layer])
        return df

    @property
    def sql(self) -> str:
        text = self.table
        for layer in self.layers:
            text = f"(SELECT {render(', '.join(layer), 'duckdb')} FROM {text})"
        return text


def table(name: str, *columns: str) -> Input:
    return Input(name, [list(columns)])


# Measures: project, period and member of every event, plus an amount.
MEASURES = table("events", "event_type AS project", "$day(ts) AS period", "user_id AS member",
                 "event_id % 5 AS num", "event_id AS seq")

# Comment text: votes, references in every style, links, mentions and code.
FENCE = "```"
COMMENT_TEXT = "concat(" + ", ".join([
    "CASE WHEN event_id % 5 = 0 THEN '+1 ' ELSE '' END",
    t("see #<event_id % 97> and user<user_id>/proj<event_id % 7>#<event_id % 31>"
      " or user<user_id>#<event_id % 13> GH-<event_id % 17>"),
    "CASE WHEN event_id % 3 = 0 THEN "
    + t(" https://github.com/own/rep<event_id % 4>/pull/<event_id % 19>") + " ELSE '' END",
    "CASE WHEN event_id % 7 = 0 THEN ' http://example.com/p#9' ELSE '' END",
    t(" cc @user<user_id>"),
    "CASE WHEN event_id % 4 = 0 THEN concat(chr(10), '```python', chr(10), 'x #5', chr(10), "
    "'```', chr(10)) ELSE '' END"]) + ")"
COMMENTS = table("events", "event_id", "user_id", "event_type", "ts",
                 t("user<user_id % 10>") + " AS project_owner",
                 t("p<event_id % 7>") + " AS project_name",
                 "CASE WHEN event_id % 6 = 0 THEN NULL ELSE "
                 + t("title #<event_id % 11> by @user<user_id % 3> http://a.example.org/<event_id % 4>")
                 + " END AS title",
                 COMMENT_TEXT + " AS text",
                 "CASE WHEN event_id % 10 = 0 THEN 'issue_crossref' ELSE 'api.github.com' END"
                 " AS provenance")

# Timelines: issue and project events with login or e-mail actors.
TIMELINE = table(
    "events", "event_id",
    t("user<user_id % 10>") + " AS project_owner", t("p<event_id % 7>") + " AS project_name",
    "CASE event_type WHEN 'purchase' THEN 'pull_request_merged' WHEN 'signup' THEN 'issue_title'"
    " WHEN 'view' THEN 'issue_comment' WHEN 'click' THEN 'commit_messages'"
    " ELSE 'pull_request_commit' END AS rectype",
    "CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'ghost'"
    " WHEN event_id % 4 = 0 THEN " + t("user<user_id>@x.org")
    + " ELSE " + t("user<user_id>") + " END AS actor",
    "ts AS time", "event_id % 40 + 1 AS issueid", t("s<event_id>") + " AS uid",
    t("Title <event_id % 23>") + " AS title",
    "concat('line one', chr(10), 'line two of " + "', " + t("<event_id>") + ") AS text",
    "event_type")
ISSUE_TIMELINE = TIMELINE.then("*", "event_type <> 'click' AS in_issue")

# Archive records: 16 event types in the three shapes of the archive, by event_id.
TYPES = ["PushEvent", "GollumEvent", "ForkEvent", "CommitCommentEvent", "CreateEvent", "DeleteEvent",
         "PullRequestReviewCommentEvent", "PublicEvent", "MemberEvent", "MemberStatusEvent",
         "ReleaseEvent", "IssuesEvent", "IssueCommentEvent", "PullRequestEvent", "WatchEvent",
         "FollowEvent"]


def choose(subject: str, options: dict) -> str:
    """A CASE over values; the key None is the rest."""
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in options.items() if k is not None)
    return f"CASE {subject} {whens} ELSE {options[None]} END"


def by_age(new: str, old: str) -> str:
    return f"CASE WHEN fmt = 0 THEN {t(new)} ELSE {t(old)} END"


PAYLOADS = {
    0: choose("event_id % 5", {
        0: t('"size":0'),
        1: by_age('"ref":"refs/heads/b<event_id % 3>","commits":[{"sha":"s<event_id>"}]',
                  '"ref":"refs/heads/b<event_id % 3>","shas":[["s<event_id>","m@x.org","msg","N"]]'),
        None: by_age('"ref":"refs/heads/b<event_id % 3>","commits":[{"sha":"s<event_id>"},{"sha":"t<event_id>"}]',
                     '"ref":"refs/heads/b<event_id % 3>","shas":[["s<event_id>","m@x.org"],["t<event_id>","n@x.org"]]')}),
    1: by_age('"pages":[{"title":"A<event_id>","action":"created","html_url":"http://w/<event_id>","sha":"g<event_id>",'
              '"page_name":"PA","summary":"s"},{"title":"B<event_id>","action":"edited","sha":"h<event_id>",'
              '"page_name":"PB","summary":null}]',
              '"title":"C<event_id>","action":"edited","html_url":"http://w/<event_id>","sha":"g<event_id>",'
              '"page_name":"PC","summary":null'),
    2: by_age('"forkee":{"id":<event_id>,"full_name":"user<user_id>/Fork<p>"}', '"forkee":<event_id>'),
    3: by_age('"comment":{"id":<event_id>,"commit_id":"c<event_id % 50>","body":"Body } { <event_id>"}',
              '"comment_id":<event_id>,"commit":"c<event_id % 50>"'),
    4: choose("user_id % 3", {0: t('"ref":"r<event_id>","ref_type":"branch"'),
                              1: t('"ref":null,"ref_type":"repository"'),
                              None: t('"object_name":"o<event_id>","object":"tag"')}),
    5: t('"ref":"r<event_id>","ref_type":"branch"'),
    6: by_age('"comment":{"path":"a/b.py","position":<event_id % 9>,"original_position":<event_id % 5>,'
              '"commit_id":"c<event_id>","original_commit_id":"d<event_id>","body":"B <event_id>",'
              '"html_url":"http://h/<event_id>"},"pull_request":{"number":<event_id % 300>}',
              '"comment":{"path":"a/c.rb","position":null,"original_position":<event_id % 5>,'
              '"commit_id":"c<event_id>","original_commit_id":"d<event_id>","body":"B <event_id>",'
              '"_links":{"html":{"href":"http://l/<event_id>"}},'
              '"pull_request_url":"https://api.github.com/repos/a/b/pulls/<event_id % 300>"}'),
    8: by_age('"action":"added","member":{"login":"mem<event_id % 40>"}',
              '"action":"added","member":"mem<event_id % 40>"'),
    9: t('"action":"added","manager":"man<event_id % 4>"'),
    10: by_age('"action":"published","release":{"tag_name":"v<event_id % 20>","target_commitish":"master",'
               '"author":{"login":"rel<user_id>"}}',
               '"action":"published","release":{"tag_name":"v<event_id % 20>","target_commitish":"dev"}'),
    11: by_age('"action":"opened","issue":{"id":<event_id>,"number":<event_id % 200>,"title":"Issue <event_id>",'
               '"body":"Text <event_id>"}', '"action":"opened","number":<event_id % 200>,"issue":<event_id>'),
    12: by_age('"action":"created","issue":{"id":<event_id % 500>,"number":<event_id % 200>,"title":"Issue <event_id>"},'
               '"comment":{"id":<event_id>,"body":"C <event_id>"}',
               '"action":"created","issue_id":<event_id>,"comment_id":<event_id>'),
    13: t('"action":"closed","pull_request":{"number":<event_id % 300>,"title":"PR <event_id>","body":"PB",'
          '"merged_at":"<iso>","base":{"ref":"master"},"head":{"ref":"f<event_id>"}}'),
    None: t('"action":"started"'),
}

DOC = choose("fmt", {
    0: t('{"id":"<event_id>","type":"<etype>","actor":{"id":<user_id>,"login":"user<user_id>","url":"<aurl>"},'
         '"repo":{"id":<rid>,"name":"<repo_full>"},"payload":{<body>},"created_at":"<iso>"}'),
    1: "CASE WHEN user_id % 29 = 4 THEN "
       + t('{"type":"<etype>","actor":null,"repository":{"owner":"Own<o>","name":"Proj<p>"},'
           '"payload":{<body>},"created_at":"<iso>"}') + " ELSE "
       + t('{"type":"<etype>","actor":"user<user_id>","actor_attributes":{"login":"user<user_id>"},'
           '"repository":{"id":<rid>,"owner":"Own<o>","name":"Proj<p>"},"url":"https://github.com/<repo_full>",'
           '"payload":{<body>},"created_at":"<iso>"}') + " END",
    None: "CASE WHEN user_id % 25 = 3 THEN "
          + t('{"type":"<etype>","actor":"user<user_id>","payload":{<body>},"created_at":"<iso>"}')
          + " ELSE " + t('{"id":"<event_id>","type":"<etype>","actor":"user<user_id>",'
                         '"url":"https://github.com/<repo_full>/commit/<event_id>",'
                         '"payload":{<body><old_repo>},"created_at":"<iso>"}') + " END"})

ARCHIVE = table(
    "events", "event_id", "user_id", "ts", "event_type AS src_type", "$iso(ts) AS iso",
    "event_id % 16 AS kind", "$idiv(event_id, 16) % 3 AS fmt", "user_id % 10 AS o", "event_id % 7 AS p",
).then("*", "o * 7 + p AS rid", t("Own<o>/Proj<p>") + " AS repo_full",
       choose("kind", {**{i: f"'{n}'" for i, n in enumerate(TYPES[:-1])}, None: f"'{TYPES[-1]}'"}) + " AS etype",
       "CASE WHEN user_id % 50 = 7 THEN 'https://api.github.dev/users/' ELSE "
       + t("https://api.github.com/users/user<user_id>") + " END AS aurl",
       choose("user_id % 5", {0: t(',"repo":"Own<o>/Proj<p>"'), 1: t(',"repo":"/Proj<p>"'), None: "''"}) + " AS old_repo",
).then("*", choose("kind", PAYLOADS) + " AS body").then("*", DOC + " AS doc")

# The chosen projects: ids of owners 0 to 6, each with its present and one older name.
def canon_frame(spark, sf_dir):
    rows = table("events", "user_id % 10 AS o", "event_id % 7 AS p").frame(spark, sf_dir)
    return rows.distinct().filter("o < 7").selectExpr(
        "o * 7 + p AS id", f"array({t('own<o>/proj<p>')}, {t('old<o>/proj<p>')}) AS aliases",
        f"{t('canon<o>/proj<p>')} AS canonical")


CANON_SQL = f"""(SELECT o * 7 + p AS id, [{t('own<o>/proj<p>')}, {t('old<o>/proj<p>')}] AS aliases,
  {t('canon<o>/proj<p>')} AS canonical
  FROM (SELECT DISTINCT user_id % 10 AS o, event_id % 7 AS p FROM events) WHERE o < 7)"""


def archive_records(spark, sf_dir):
    """Parsed records without a round trip through files; the event number is the line."""
    from pyspark.sql import functions as F

    from forgetide.sources.archive import parse_records
    place = F.struct(F.lit("events").alias("file"), F.lit(0).cast("bigint").alias("block"),
                     F.col("event_id").alias("row"))
    return parse_records(ARCHIVE.heavy(spark, sf_dir).select(F.col("doc").alias("value"), place.alias("place")))


def _person(kind: str) -> str:
    scalar = lambda path: f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN j->>'{path}' END"
    return (f"coalesce(j->>'$.{kind}_attributes.login', j->>'$.{kind}.login', {scalar(f'$.{kind}')}, "
            f"j->>'$.payload.{kind}.login', {scalar(f'$.payload.{kind}')})")


# The normalised rows once more, by DuckDB's JSON functions.
EVENTS_SQL = f"""(SELECT *, split_part(project, '/', 1) AS repo_owner, split_part(project, '/', 2) AS repo_name FROM (
SELECT event_id AS line, j, j->>'$.type' AS event_type, j->>'$.id' AS event_id,
  CAST(coalesce(j->>'$.repo.id', j->>'$.repository.id') AS BIGINT) AS repo_id,
  CASE WHEN name LIKE '/%' THEN split_part(url, '/', 4) || '/' || split_part(url, '/', 5)
       WHEN name = '' THEN NULL ELSE name END AS project,
  {_person('actor')} AS actor, j->>'$.created_at' AS created_at, j->>'$.actor.url' AS actor_url,
  {_person('member')} AS member
FROM (SELECT event_id, j, j->>'$.url' AS url,
  coalesce(j->>'$.payload.repo', j->>'$.repo.name',
    (j->>'$.repository.owner') || '/' || (j->>'$.repository.name'),
    split_part(j->>'$.url', '/', 4) || '/' || split_part(j->>'$.url', '/', 5)) AS name
  FROM (SELECT event_id, doc::JSON AS j FROM {ARCHIVE.sql}))))"""
