import random
import re

from pyspark.sql import functions as F

from forgetide.functions import text as T

FENCE = "```"


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


def test_urls(spark):
    assert one(spark, "ftp:// and http://'quoted and https://", T.urls("text"))[0] == []
    text = "docs [https://wiki.example.net/v2?tab=3#top], then\tftp://files.example.net/~kim/a.tgz\nand <http://a.example.net:81> too"
    assert one(spark, text, T.urls("text"))[0] == [
        "ftp://files.example.net/~kim/a.tgz", "http://a.example.net:81", "https://wiki.example.net/v2?tab=3#top"]
    assert one(spark, "HTTP://b.org x ftp://a.org/1 http://b.org", T.urls("text"))[0] == [
        "HTTP://b.org", "ftp://a.org/1", "http://b.org"]
    assert one(spark, "http://nodots/x http://10.0.0.1:8080/y http://localhost/z", T.urls("text"))[0] == [
        "http://10.0.0.1:8080/y", "http://localhost/z"]


VALID = """http://a.de https://a.b.c.d.example.org HTTP://EXAMPLE.ORG ftp://ftp.example.org/a http://example.org? http://example.org#x
http://example.org/?q=a#b http://example.org:1 http://example.org:65535/x http://example.org:080/ http://localhost http://LOCALHOST:8080/a
http://user@example.org http://user:pw@example.org:81/ http://1.2.3.4 http://223.255.255.255/x http://10.0.0.1:80 http://127.0.0.1
http://bücher.example http://例え.テスト http://xn--bcher-kva.example http://example.xn--p1ai http://a-b.example.org http://a--b.example
http://1a.example http://9.example http://[::1] http://[::]/x http://[2001:db8::7]:8080/a http://[1:2:3:4:5:6:7:8] http://[::ffff:1.2.3.4]
http://[1:2:3:4:5:6:1.2.3.4] http://[FE80::A] http://user@[::1]:81""".split()
INVALID = """http:// http:///x http://? http://example http://example. http://.example.org http://a..example http://-a.example
http://a-.example http://a_b.example http://example.o http://example.123 http://256.1.1.1 http://1.2.3 http://1.2.3.4.5 http://01.2.3.4
http://0.1.2.3 http://224.0.0.1 http://255.255.255.255 http://example.org: http://example.org:0 http://example.org:65536
http://example.org:99999999999 http://example.org:8a http://[::1 http://[:1] http://[1::2::3] http://[1:2:3:4:5:6:7] http://[1:2:3:4:5:6:7:8:9]
http://[12345::] http://[::g] http://[::256.1.1.1] http://[1:2:3:4:5:6:7::8:9] gopher://example.org example.org http://localhost.
http://a@b@example.org http://:80""".split()


def test_valid_links(spark):
    long = ["http://" + "a" * 63 + ".example", "http://" + ".".join(["a" * 49] * 5) + ".de"]
    too_long = ["http://" + "a" * 64 + ".example", "http://" + ".".join(["a" * 50] * 5) + ".com"]
    wanted = dict.fromkeys([*VALID, *long], True) | dict.fromkeys([*INVALID, *too_long], False)
    assert len(wanted) >= 70
    rows = spark.createDataFrame([(u,) for u in wanted], "u string").select("u", T.valid_url(F.col("u"))).collect()
    assert {u: v for u, v in rows if v != wanted[u]} == {}


def test_plus_one(spark):
    cases = {"+1 ship it, please": (True, "ship it, please"), "\t\n+1\n\t\n go": (True, "go"), " +1yes": (True, "yes"),
             "+1": (False, "+1"), "+10 x": (True, "0 x"), "+1\nx": (True, "x"), "+1 a\nb": (False, "+1 a\nb"),
             "+1 a\n": (True, "a"), "no +1 x": (False, "no +1 x"), "": (False, "")}
    frame = spark.createDataFrame([(k,) for k in cases], "text string")
    rows = frame.select("text", T.plus_one("text"), T.plus_one_remainder("text")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_plus_one_like_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["+1", "+", "1", " ", "\n", "\r", "a", " "]) for _ in range(rng.randint(0, 8)))
             for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", T.plus_one("text"), T.plus_one_remainder("text")).collect()
    for text, vote, rest in rows:
        match = re.match(r"^\s*(\+1)\s*(.+)$", text, flags=re.ASCII)
        assert vote == bool(match), repr(text)
        assert rest == (match.group(2) if match else text)


def test_code(spark):
    def run(text, mode="line"):
        return tuple(one(spark, text, T.code_languages("text", mode), T.without_code("text", mode)))

    def block(language, body="x = 1"):
        return f"{FENCE}{language}\n{body}\n{FENCE}"
    assert run(f"try {block('scala')} instead") == (["scala"], "try  instead")
    assert run(block("")) == (["unspecified"], "")
    assert run(f"{block('r')}1{block('')}2{block('c++', 'y')}3{block('r', 'z')}") == (["c++", "r", "unspecified"], "123")
    assert run(f"{FENCE}sql\nnever closed") == ([], f"{FENCE}sql\nnever closed")
    long = f"a\r\n{FENCE}go\r\nx\r\ny\r\n{FENCE}\r\nb"
    assert run(long) == ([], long)
    assert run(long, "fenced") == (["go"], "a\r\n\r\nb")


def test_markdown_blocks(spark):
    long, tick = "````", "`"
    cases = {
        f"a\n{FENCE}go\nx\ny\n{FENCE}\nb": (["go"], "a\nb"), f"a\r\n~~~ r opts\r\nx\r\n~~~~\r\nb": (["r"], "a\nb"),
        f"{long}md\n{FENCE}py\nx\n{FENCE}\n{long}\nz": (["md"], "z"), f"{FENCE}\nnever closed\n#1": (["unspecified"], ""),
        f"{FENCE}a\n~~~\n{FENCE}\n~~~b\n{FENCE}\n~~~": (["a", "b"], ""), f"   {FENCE}c\nx\n  {FENCE}\nd": (["c"], "d"),
        f"p\n    {FENCE}no fence\nq": ([], f"p\n    {FENCE}no fence\nq"), f"- item\n    {FENCE}sh\n    x\n    {FENCE}\nafter": (["sh"], "- item\nafter"),
        f"1. {FENCE}sql\n   x\n   {FENCE}\nafter": (["sql"], "after"), f"> {FENCE}js\n> x\n> {FENCE}\n> said": (["js"], "> said"),
        f"> {FENCE}js\n> x\nout #2": (["js"], "out #2"), f"{FENCE}x{tick}y\nno": ([], f"{FENCE}x{tick}y\nno"),
        f"{FENCE}k\n{FENCE} not the end\n{FENCE}  \nz": (["k"], "z"),
        f"use {tick}f(x){tick} or {tick}{tick}a{tick}b{tick}{tick}\n{FENCE}l\n{FENCE}": (["l", "unspecified"], "use  or "),
        f"t\n\n    x = 1\n\n    y = 2\nu\n{FENCE}l\n{FENCE}": (["l", "unspecified"], "t\n\n\nu"),
        f"para\n    goes on\n~~~\n~~~": (["unspecified"], "para\n    goes on"), "    indented, no fence": ([], "    indented, no fence"), "": ([], "")}
    frame = spark.createDataFrame([(k,) for k in cases], "text string")
    rows = frame.select("text", T.code_languages("text", "markdown"), T.without_code("text", "markdown")).collect()
    got = {t: (languages, kept) for t, languages, kept in rows}
    assert {t: got[t] for t in cases if got[t] != cases[t]} == {}
    assert tuple(one(spark, None, T.code_languages("text", "markdown"), T.without_code("text", "markdown"))) == (None, None)


def test_issue_references(spark):
    text = "fixes kim/tool.kit#7 and #8\nsee http://github.com/lee_2/lib-x/issues/90, kim#11; dup of #8"
    frame = spark.createDataFrame([(text,)], "text string")
    refs = T.with_issue_references(frame, {"issues": F.col("text")}).first().issues
    assert [(r.raw, r.refstyle, tuple(r.parts)) for r in refs] == [
        ("#8", "#d", ("%OWNER%", "%PROJECT%", "8")), ("http://github.com/lee_2/lib-x/issues/90", "url", ("lee_2", "lib-x", "90")),
        ("kim#11", "o#d", ("kim", "%PROJECT%", "11")), ("kim/tool.kit#7", "o/p#d", ("kim", "tool.kit", "7"))]


def test_references_in_other_links_do_not_count(spark):
    text = "http://x.org/a/b#12 https://github.com/a/b/issues/3#c gh-7 _gh-8 #1 #12 #1"
    frame = spark.createDataFrame([(text,)], "text string")
    refs = T.with_issue_references(frame, {"issues": F.col("text")}).first().issues
    assert [(r.raw, r.refstyle) for r in refs] == [
        ("#1", "#d"), ("#12", "#d"), ("gh-7", "gh-d"), ("https://github.com/a/b/issues/3", "url")]


def test_parts_agree_with_the_general_parser(spark):
    raws = [("o/p#d", "a-b/c.d_e#7"), ("o#d", "a.b#8"), ("#d", "#9"), ("gh-d", "gH-10"),
            ("url", "http://github.com/x_y/z.w/issues/11"), ("url", "https://github/com/x/z/pull/12")]
    for style, raw in raws:
        frame = spark.createDataFrame([(raw,)], "raw string")
        own, general = frame.select(F.expr(f"transform(array(raw), r -> array({T.PARTS[style]}))[0]"),
                                    T.parse_reference(F.col("raw"))).first()
        assert own == general, raw


def test_parse_reference(spark):
    cases = {"kim-9/lib.x_1#6": ["kim-9", "lib.x_1", "6"], "kim-9#70": ["kim-9", "here", "70"], "#1": ["me", "here", "1"],
             "gh-22": ["me", "here", "22"], "https://github.com/kim/lib/pull/5": ["kim", "lib", "5"]}
    for raw, parts in cases.items():
        assert one(spark, raw, T.parse_reference(F.col("text"), F.lit("me"), F.lit("here")))[0] == parts


def test_user_references(spark):
    text = "cc @zoe_9, @adam-k: mail to root@Host.example; @zoe_9 knows, @7up does not"
    assert one(spark, text, T.user_references("text"))[0] == ["@Host", "@adam", "@zoe_9"]


def annotated(spark, title, text, provenance="api.github.com"):
    frame = spark.createDataFrame([(title, text, "own", "pro", provenance)],
                                  "title string, text string, project_owner string, project_name string, provenance string")
    return T.annotate(frame).first()


def test_annotate_joins_title_and_text(spark):
    row = annotated(spark, "+1 for #5 @a http://b.org", "see #5 and qq/rr#6 @a http://a.org", "issue_crossref")
    assert row.urls == ["http://a.org", "http://b.org"] and row.userref == ["@a", "@a"] and row.plus_1 is False
    assert [(r.raw, list(r.parts)) for r in row.issues] == [
        ("#5", ["own", "pro", "5", "rev"]), ("#5", ["own", "pro", "5", "rev"]), ("qq/rr#6", ["qq", "rr", "6", "rev"])]


def test_annotate_skips_null_fields(spark):
    row = annotated(spark, "+1 good #1", None)
    assert row.plus_1 is True and [r.raw for r in row.issues] == ["#1"]
    assert annotated(spark, "+1 good", "").plus_1 is False
    nothing = annotated(spark, None, None)
    assert nothing.plus_1 is None and nothing.urls is None


def test_references_inside_code_do_not_count(spark):
    row = annotated(spark, "", f"a\n{FENCE}sh\nfix #3 @b http://c.org\n{FENCE}\n#4")
    assert [r.raw for r in row.issues] == ["#4"] and row.userref == []
    assert row.urls == ["http://c.org"] and row.code == ["sh"]


def test_local_part(spark):
    frame = spark.createDataFrame([("J.Doe x@m.org", ["zed", "JDoeX"]), ("none@m.org", ["zed"])], "e string, c array<string>")
    assert [r[0] for r in frame.select(T.closest_login("e", "c")).collect()] == ["JDoeX", None]
