"""Text features over composed comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.functions import text as T
from forgetide.plans.fixtures import COMMENTS, table, t
from forgetide.plans.registry import query

SRC = COMMENTS.sql

# The patterns again in DuckDB's dialect (no look-behind there; the text is ASCII).
URL = r"(?i)(?:https?|ftp)://[^\s/$.?#].[^\s()\[\]<>,''\"`]*"
CODE = r"```\S*\n.*?\n```"
LANG = r"```(\S*)\n.*?\n```"
PASSES = [("o/p#d", r"\b[A-Za-z][A-Z0-9a-z_.-]+/[A-Za-z][A-Z0-9a-z_.-]+#\d+"),
          ("o#d", r"\b[A-Za-z][A-Z0-9a-z_.-]+#\d+"), ("#d", r"#\d+"), ("gh-d", r"\b[Gg][Hh]-\d+")]
ISSUE_URL = r"https?://github.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/(?:pull|issues)/\d+"
ERASE = "list_reduce({found}, lambda acc, m: replace(acc, m, '{by}'), {text})"


def found(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, '{pattern}', {group})"


def uniq(expr: str) -> str:
    return f"list_sort(list_distinct({expr}))"


def bare(col: str) -> str:
    return ERASE.format(found=found(col, CODE), by="", text=col)


def langs(col: str) -> str:
    return (f"list_transform({found(col, LANG, 1)}, "
            "lambda n: CASE WHEN n = '' THEN 'unspecified' ELSE n END)")


def refs_cte(src: str, col: str, name: str) -> str:
    """The pass chain over `col` of `src`: relation `name` with styled references `refs`,
    each written "raw |style" (the blank sorts before every other character)."""
    keep = lambda style: f"list_transform(list_distinct(hits), lambda r: r || ' |{style}')"
    steps = [f"{name}_0 AS (SELECT event_id, {col} AS txt, {found(col, ISSUE_URL)} AS hits FROM {src})",
             f"{name}_1 AS (SELECT event_id, {ERASE.format(found='hits', by=' ', text='txt')} AS txt, "
             f"{keep('url')} AS refs FROM {name}_0)",
             f"{name}_2 AS (SELECT event_id, refs, {found('txt', URL)} AS hits, txt FROM {name}_1)",
             f"{name}_3 AS (SELECT event_id, refs, {ERASE.format(found='hits', by='', text='txt')} AS txt "
             f"FROM {name}_2)"]
    last = f"{name}_3"
    for i, (style, pattern) in enumerate(PASSES):
        hits, out = f"{name}_h{i}", f"{name}_p{i}"
        steps.append(f"{hits} AS (SELECT event_id, refs, txt, {found('txt', pattern)} AS hits FROM {last})")
        steps.append(f"{out} AS (SELECT event_id, list_concat(refs, {keep(style)}) AS refs, "
                     f"{ERASE.format(found='hits', by=' ', text='txt')} AS txt FROM {hits})")
        last = out
    steps.append(f"{name} AS (SELECT event_id, refs FROM {last})")
    return ",\n".join(steps)


def joined(col):
    return F.array_join(col, " ")


@query("T1_urls", f"SELECT event_id, array_to_string(list_sort({found('text', URL)}), ' ') AS urls FROM {SRC}")
def t1(spark, sf):
    return COMMENTS.heavy(spark, sf).select("event_id", joined(T.urls("text")).alias("urls"))


# Forms of links, the first half valid.
FORMS = ["http://a-b.example.org", "https://xn--bcher-kva.example/x", "ftp://10.1.2.3:65535/y", "http://localhost:80?q", "http://user:pw@1a.example",
         "http://223.255.255.255#z", "HTTP://EXAMPLE.ORG:1", "http://example.xn--p1ai",
         "http://a_b.example", "http://-a.example.org", "http://256.1.1.1/x", "http://224.0.0.1", "http://example.org:65536", "http://example.org:0",
         "http://example.123", "http://1.2.3"]
LINKS = table("events", "event_id", "event_id % 16 AS form").then(
    "event_id", "form", "CASE form " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(FORMS)) + " END AS link").then(
    "event_id", "form", "link", "concat('see ', link, ' now') AS text")


@query("T1_link_forms", f"SELECT event_id, CASE WHEN form < 8 THEN link ELSE '' END AS urls FROM {LINKS.sql}")
def t1_forms(spark, sf):
    return LINKS.frame(spark, sf).select("event_id", joined(T.urls("text")).alias("urls"))


@query("T2_plus_one", rf"""SELECT event_id, event_id % 5 = 0 AND event_id % 4 <> 0 AS plus_1,
CASE WHEN event_id % 5 = 0 AND event_id % 4 <> 0 THEN substr(text, 4) ELSE text END AS remainder
FROM {SRC}""")
def t2(spark, sf):
    return COMMENTS.heavy(spark, sf).select(
        "event_id", T.plus_one("text").alias("plus_1"), T.plus_one_remainder("text").alias("remainder"))


CODE_SQL = f"""SELECT event_id, array_to_string({uniq(langs('text'))}, ' ') AS code,
{bare('text')} AS bare FROM {SRC}"""


@query("T3_code", CODE_SQL)
def t3(spark, sf):
    return COMMENTS.heavy(spark, sf).select(
        "event_id", joined(T.code_languages("text")).alias("code"), T.without_code("text").alias("bare"))


# Blocks of two lines with either line end: only the fenced mode sees them.
BLOCKS = table("events", "event_id",
               "CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END AS eol",
               "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'ruby' ELSE 'go' END AS lang").then(
    "event_id", "lang", "concat('before', eol, '```', lang, eol, 'a = 1', eol, 'b', eol, '```', eol, 'after') AS text",
    "concat('before', eol, eol, 'after') AS bare")


@query("T4_code_fenced", f"""SELECT event_id, CASE WHEN lang = '' THEN 'unspecified' ELSE lang END AS code,
bare, '' AS line_mode FROM {BLOCKS.sql}""")
def t4(spark, sf):
    return BLOCKS.frame(spark, sf).select(
        "event_id", joined(T.code_languages("text", "fenced")).alias("code"),
        T.without_code("text", "fenced").alias("bare"), joined(T.code_languages("text")).alias("line_mode"))


# Texts with line ends written as "|", their languages and what is left of them.
MARKDOWN = [("see|````md|```py|x|```|````|end", "md", "see|end"), ("> ~~~ r opts|> x|out #2", "r", "out #2"),
            ("- item|    ```sh|    x|    ```|after", "sh", "- item|after"), ("a|```go|never closed #1", "go", "a"),
            ("use `f(x)` here|```l|```|b", "l unspecified", "use  here|b"), ("p|    ```no fence|q", "", "p|    ```no fence|q")]
CHOICE = lambda k: "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{row[k]}'" for i, row in enumerate(MARKDOWN)) + " END"
READ = table("events", "event_id", f"replace({CHOICE(0)}, '|', chr(10)) AS text", f"{CHOICE(1)} AS code", f"replace({CHOICE(2)}, '|', chr(10)) AS bare")


@query("T4_code_markdown", f"SELECT event_id, code, bare FROM {READ.sql}")
def t4_markdown(spark, sf):
    return READ.frame(spark, sf).select(
        "event_id", joined(T.code_languages("text", "markdown")).alias("code"), T.without_code("text", "markdown").alias("bare"))


@query("T5_issue_references", f"""WITH src AS {SRC}, b AS (SELECT event_id, {bare('text')} AS body FROM src),
{refs_cte('b', 'body', 'r')}
SELECT event_id, array_to_string(list_sort(refs), ' ') AS refs FROM r""")
def t5(spark, sf):
    df = T.with_issue_references(COMMENTS.heavy(spark, sf), {"issues": T.without_code("text")})
    styled = F.transform("issues", lambda r: F.concat(r.raw, F.lit(" |"), r.refstyle))
    return df.select("event_id", joined(F.array_sort(styled)).alias("refs"))


REFS = table("events", "event_id", "user_id", "event_id % 5 AS style").then("event_id", "CASE style "
             "WHEN 0 THEN " + t("own<user_id>/proj-<event_id % 7>#<event_id>")
             + " WHEN 1 THEN " + t("own<user_id>#<event_id>") + " WHEN 2 THEN " + t("#<event_id>")
             + " WHEN 3 THEN " + t("gH-<event_id>")
             + " ELSE " + t("https://github.com/own<user_id>/proj-<event_id % 7>/issues/<event_id>")
             + " END AS ref", "style", "user_id", "event_id % 7 AS p")


@query("T6_parse_reference", f"""SELECT event_id,
CASE WHEN style IN (0, 1, 4) THEN 'own' || CAST(user_id AS STRING) ELSE 'me' END AS owner,
CASE WHEN style IN (0, 4) THEN 'proj-' || CAST(p AS STRING) ELSE 'mine' END AS project,
CAST(event_id AS STRING) AS number FROM {REFS.sql}""")
def t6(spark, sf):
    parts = T.parse_reference(F.col("ref"), F.lit("me"), F.lit("mine"))
    return REFS.frame(spark, sf).select("event_id", parts.alias("parts")).select(
        "event_id", F.col("parts")[0].alias("owner"), F.col("parts")[1].alias("project"),
        F.col("parts")[2].alias("number"))


@query("T7_user_references", f"""SELECT event_id,
array_to_string({uniq(found('text', '@[A-Za-z][A-Za-z0-9_]*'))}, ' ') AS userref FROM {SRC}""")
def t7(spark, sf):
    return COMMENTS.heavy(spark, sf).select("event_id", joined(T.user_references("text")).alias("userref"))


def annotate_sql(votes: bool) -> str:
    both = lambda a, b: f"list_sort(list_concat(coalesce({a}, []), coalesce({b}, [])))"
    flat = "list_transform({0}, lambda r: {1})"
    raw = "split_part(r, ' |', 1)"
    number = f"regexp_extract({raw}, '(\\d+)$', 1)"
    owner = (f"CASE WHEN split_part(r, '|', 2) IN ('#d', 'gh-d') THEN project_owner "
             f"WHEN split_part(r, '|', 2) = 'url' THEN split_part({raw}, '/', 4) "
             f"WHEN split_part(r, '|', 2) = 'o#d' THEN split_part({raw}, '#', 1) "
             f"ELSE split_part({raw}, '/', 1) END")
    project = (f"CASE WHEN split_part(r, '|', 2) = 'url' THEN split_part({raw}, '/', 5) "
               f"WHEN split_part(r, '|', 2) = 'o/p#d' THEN split_part(split_part({raw}, '/', 2), '#', 1) "
               f"ELSE project_name END")
    full = (f"r || '|' || {owner} || '|' || {project} || '|' || {number} || '|' || "
            "CASE WHEN provenance = 'issue_crossref' THEN 'rev' ELSE '' END")
    extra = (", b.event_id % 5 = 0 AND b.event_id % 4 <> 0 AS plus_1, array_to_string("
             + both(uniq(found("title", "@[A-Za-z][A-Za-z0-9_]*")),
                    uniq(found("body", "@[A-Za-z][A-Za-z0-9_]*"))) + ", ' ') AS userref") if votes else ""
    return f"""WITH src AS {SRC}, b AS (SELECT *, {bare('text')} AS body FROM src),
{refs_cte('b', 'body', 'rt')}, {refs_cte('(SELECT * FROM b WHERE title IS NOT NULL)', 'title', 'rh')}
SELECT b.event_id, array_to_string({both(found('title', URL), found('text', URL))}, ' ') AS urls,
array_to_string({uniq(langs('text'))}, ' ') AS code,
array_to_string({flat.format(both('rh.refs', 'rt.refs'), full)}, ' ') AS issues{extra}
FROM b JOIN rt ON rt.event_id = b.event_id LEFT JOIN rh ON rh.event_id = b.event_id"""


def flat_issues():
    return joined(F.transform("issues", lambda r: F.concat_ws(
        "|", F.concat(r.raw, F.lit(" ")), r.refstyle, r.parts[0], r.parts[1], r.parts[2], r.parts[3])))


@query("T8_annotate", annotate_sql(True))
def t8(spark, sf):
    return T.annotate(COMMENTS.heavy(spark, sf)).select(
        "event_id", joined("urls").alias("urls"), joined("code").alias("code"),
        flat_issues().alias("issues"), "plus_1", joined("userref").alias("userref"))


@query("T9_references_only", annotate_sql(False))
def t9(spark, sf):
    return T.annotate(COMMENTS.heavy(spark, sf), references_only=True).select(
        "event_id", joined("urls").alias("urls"), joined("code").alias("code"),
        flat_issues().alias("issues"))


MAILS = table("events", "event_id", t("User.<user_id> A@x.org") + " AS email",
              t("USER<user_id>a") + " AS hit", t("other<event_id>") + " AS miss",
              "event_id % 3 AS k")


@query("T10_local_part_match", f"""SELECT event_id, lower(replace(replace(split_part(email, '@', 1), '.', ''), ' ', '')) AS front,
CASE WHEN k = 0 THEN NULL ELSE hit END AS login FROM {MAILS.sql}""")
def t10(spark, sf):
    mails = MAILS.frame(spark, sf)
    candidates = F.when(F.col("k") == 0, F.array("miss")).otherwise(F.array("miss", "hit"))
    return mails.select("event_id", T.local_part("email").alias("front"),
                        T.closest_login("email", candidates).alias("login"))


@query("X1_row_annotator", f"""SELECT event_id,
array_to_string({uniq(found('text', '@[A-Za-z][A-Za-z0-9_]*'))}, ' ') AS userref FROM {SRC}""")
def x1(spark, sf):
    titleless = COMMENTS.heavy(spark, sf).withColumn("title", F.lit(""))
    return titleless.transform(T.annotate).select("event_id", joined("userref").alias("userref"))


@query("X2_finder_chain", f"""SELECT event_id,
array_to_string(list_sort({found('text', URL)}), ' ') AS urls,
array_to_string({uniq(langs('text'))}, ' ') AS code,
array_to_string({uniq(found(bare('text'), '@[A-Za-z][A-Za-z0-9_]*'))}, ' ') AS userref FROM {SRC}""")
def x2(spark, sf):
    df = COMMENTS.heavy(spark, sf).withColumn("bare", T.without_code("text"))
    built = {n: b("text" if reads_code else "bare") for n, b, reads_code in T.FINDERS}
    return df.select("event_id", *[joined(built[n]).alias(n) for n in ("urls", "code", "userref")])
