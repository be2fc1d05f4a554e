"""Features mined from free text: links, +1 votes, code blocks, issue and user references.

Only built-in functions. Patterns use (?d) so that "." and "$" know "\\n" as the only
line end, and an explicit look-behind as the ASCII word start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text patterns that define each convention.
URL_PATTERN = r"(?i)((?:https?|ftp)://[^\s/$.?#].[^\s\(\)\[\]\<\>,'\"`]*)"
PLUS_ONE_PATTERN = r"(?d)^\s*(\+1)\s*(.+)$"
CODE_PATTERN = r"(?d)(```(\S*)\n(.*?\n)```)"
FENCED_PATTERN = r"(?ds)(```(\S*)[ \t]*\r?\n(.*?\n)```)"
# Markdown: a quoted line, a list item, a fence with its first word, blanks that make a line code, code inside a line.
QUOTE_PATTERN = r"^(?: {0,3}> ?)+"
ITEM_PATTERN = r"^\s*(?:[-*+]|[0-9]{1,9}[.)])\s"
FENCE_PATTERN = r"^( *(?:(?:[-*+]|[0-9]{1,9}[.)]) +)*)(`{3,}(?=[^`]*$)|~{3,})[ \t]*(\S*).*$"
INDENT_PATTERN = r"^(?: {4}| {0,3}\t)"
SPAN_PATTERN = r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)"
ISSUE_URL_PATTERN = r"(https?://github.com/[A-Za-z0-9_\.-]+/[A-Za-z0-9_\.-]+/(?:pull|issues)/\d+)"
OWNER_PROJECT_PATTERN = (r"((?<![A-Za-z0-9_])[A-Za-z][A-Z0-9a-z_\.-]+/"
                         r"[A-Za-z][A-Z0-9a-z_\.-]+#\d+)")
OWNER_PATTERN = r"((?<![A-Za-z0-9_])[A-Za-z][A-Z0-9a-z_\.-]+#\d+)"
NUMBER_PATTERN = r"(#\d+)"
GH_PATTERN = r"((?<![A-Za-z0-9_])[Gg][Hh]-\d+)"
USER_PATTERN = r"(@[A-Za-z][A-Z0-9a-z_]*)"
HASH_REFERENCE_PATTERN = r"^([A-Z0-9a-z_\.-]+/)?([A-Z0-9a-z_\.-]+)?#(\d+)"
GH_REFERENCE_PATTERN = r"^[Gg][Hh]-(\d+)"
URL_REFERENCE_PATTERN = r"^https?://github.com/([A-Za-z0-9_\.-]+)/([A-Za-z0-9_\.-]+)/\S+/(\d+)"
FENCE = "```"
OWNER_MARK = "%OWNER%"
PROJECT_MARK = "%PROJECT%"

# The parts of a link. Letters of host names are those of any script; the flags stand for all that follows.
AUTHORITY_PATTERN = r"^(?i)(?:https?|ftp)://([^/?#\s]*)(?:[/?#]\S*)?$"
USER_INFO_PATTERN = r"^[^\s@]*@"
PORT_PATTERN = r":([0-9]*)$"
HOST_LETTER = r"[a-z0-9\x{a1}-\x{10ffff}]"
HOST_LABEL = rf"{HOST_LETTER}(?:(?:{HOST_LETTER}|-){{0,61}}{HOST_LETTER})?"
DOMAIN_PATTERN = rf"^(?i)(?:{HOST_LABEL}\.)+(?:xn--[a-z0-9-]{{0,58}}[a-z0-9]|[a-z\x{{a1}}-\x{{10ffff}}]{{2,63}})$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV6_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
IPV6_PATTERN = rf"^(?i)(?:{IPV6_GROUPS}|(?:{IPV6_GROUPS})?::(?:{IPV6_GROUPS})?)$"
LONGEST_HOST, LAST_PORT = 253, 65535

REF_STYLES = (("o/p#d", OWNER_PROJECT_PATTERN, "#"), ("o#d", OWNER_PATTERN, "#"),
              ("#d", NUMBER_PATTERN, "#"), ("gh-d", GH_PATTERN, "-"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(text: Column, pattern: str, mark: str, group: int = 1) -> Column:
    """All matches. Texts without the mark every match holds are spared the pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(mark)), found).when(text.isNotNull(), none)


def _erase(text: Column, found: Column, by: str) -> Column:
    """Replace each found string everywhere, one after the other."""
    return F.aggregate(F.array_distinct(found), text, lambda acc, m: F.replace(acc, m, F.lit(by)))


def _valid_ipv4(host: Column) -> Column:
    """Four numbers up to 255 without leading zeros; the first is neither 0 nor one of those beyond 223, which are no hosts."""
    first = F.split_part(host, F.lit("."), F.lit(1)).try_cast("int")
    return host.rlike(IPV4_PATTERN) & first.between(1, 223)


def _valid_ipv6(address: Column) -> Column:
    """Eight groups of four digits; one "::" stands for one or more groups of zeros, and the last two may be written as IPv4."""
    tail = F.regexp_extract(address, r"([0-9.]+\.[0-9.]+)$", 1)
    plain = F.when(tail == "", address).otherwise(F.regexp_replace(address, r"[0-9.]+\.[0-9.]+$", "0:0"))
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    counted = F.when(F.contains(plain, F.lit("::")), groups <= 7).otherwise(groups == 8)
    return plain.rlike(IPV6_PATTERN) & counted & ((tail == "") | tail.rlike(IPV4_PATTERN))


def valid_url(url: Column) -> Column:
    """Whether a link has a host that can be: a domain of labels of at most 63 letters, digits and inner hyphens that ends in
    letters, localhost, an IPv4 or a bracketed IPv6 address; a port, where there is one, from 1 to 65535."""
    authority = F.regexp_extract(url, AUTHORITY_PATTERN, 1)
    place = F.regexp_replace(authority, USER_INFO_PATTERN, "")
    host = F.regexp_replace(place, PORT_PATTERN, "")
    port = F.regexp_extract(place, PORT_PATTERN, 1).try_cast("int")
    name = host.rlike(DOMAIN_PATTERN) & (F.length(host) <= LONGEST_HOST)
    known = (F.when(host.startswith("["), host.endswith("]") & _valid_ipv6(F.substr(host, F.lit(2), F.length(host) - 2)))
              .when(host.rlike(r"^[0-9.]+$"), _valid_ipv4(host)).otherwise(name | (F.lower(host) == "localhost")))
    return (authority != "") & known & (~place.rlike(PORT_PATTERN) | F.coalesce(port.between(1, LAST_PORT), F.lit(False)))


def urls(text: Column | str) -> Column:
    """Valid links, sorted, repeats kept."""
    return F.array_sort(F.filter(_all(_col(text), URL_PATTERN, "://"), valid_url))


def plus_one(text: Column | str) -> Column:
    return _col(text).rlike(PLUS_ONE_PATTERN)


def plus_one_remainder(text: Column | str) -> Column:
    """The text after the vote, or the whole text when there is none."""
    text = _col(text)
    return F.when(plus_one(text), F.regexp_extract(text, PLUS_ONE_PATTERN, 2)).otherwise(text)


def _markdown(text: Column) -> Column:
    """(languages, kept) of a text read line by line as Markdown blocks: fences of ` or ~, closed by one at least as long, by the end of
    the quote they stand in, or by the end of the text; blocks indented by four after a blank line, outside lists; code inside lines."""
    none = F.array().cast("array<string>")
    unnamed = F.array(F.lit("unspecified"))
    start = F.struct(F.lit("").alias("fence"), F.lit(False).alias("quoted"), F.lit(True).alias("blank"), F.lit(False).alias("indented"),
                     F.lit(False).alias("listed"), none.alias("languages"), none.alias("kept"))

    def step(state: Column, line: Column) -> Column:
        quoted = line.rlike(QUOTE_PATTERN)
        body = F.regexp_replace(line, QUOTE_PATTERN, "")
        bare = F.regexp_replace(body, r"^\s+|\s+$", "")
        inside = (state.fence != "") & (quoted | ~state.quoted)
        closes = inside & bare.startswith(state.fence) & (F.replace(bare, F.substring(state.fence, 1, 1), F.lit("")) == "")
        opens = ~inside & body.rlike(FENCE_PATTERN) & (body.rlike(r"^ {0,3}\S") | state.listed)
        code = ~inside & ~opens & (bare != "") & body.rlike(INDENT_PATTERN) & (state.blank | state.indented) & ~state.listed
        plain = ~inside & ~opens & ~code
        word = F.regexp_extract(body, FENCE_PATTERN, 3)
        named = (F.when(opens, F.array(F.when(word == "", "unspecified").otherwise(word))).when(code & ~state.indented, unnamed)
                  .when(plain & line.rlike(SPAN_PATTERN), unnamed).otherwise(none))
        return F.struct(
            F.when(opens, F.regexp_extract(body, FENCE_PATTERN, 2)).when(inside & ~closes, state.fence).otherwise("").alias("fence"),
            F.when(opens, quoted).otherwise(state.quoted & inside).alias("quoted"), (plain & (bare == "")).alias("blank"),
            (code | (state.indented & plain & (bare == ""))).alias("indented"),
            F.when(inside, state.listed).otherwise(line.rlike(ITEM_PATTERN) | (state.listed & ((bare == "") | line.rlike(r"^\s")))).alias("listed"),
            F.concat(state.languages, named).alias("languages"),
            F.concat(state.kept, F.when(plain, F.array(F.regexp_replace(line, SPAN_PATTERN, ""))).otherwise(none)).alias("kept"))

    return F.aggregate(F.split(text, r"\r?\n", -1), start, step, lambda s: F.struct(
        F.array_sort(F.array_distinct(s.languages)).alias("languages"), F.array_join(s.kept, "\n").alias("kept")))


def _fenced(text: Column) -> Column:
    """Only texts with a fence are read as Markdown."""
    return F.contains(text, F.lit(FENCE)) | F.contains(text, F.lit("~~~"))


def code_languages(text: Column | str, mode: str = "line") -> Column:
    """Languages of code blocks, distinct and sorted. Mode "line" takes blocks of one
    line, mode "fenced" blocks of any length and either line end, mode "markdown" reads
    the lines as Markdown (a text without a fence has no code)."""
    if mode == "markdown":
        text = _col(text)
        return F.when(_fenced(text), _markdown(text).languages).when(text.isNotNull(), F.array().cast("array<string>"))
    names = _all(_col(text), CODE_PATTERN if mode == "line" else FENCED_PATTERN, FENCE, 2)
    named = F.transform(names, lambda n: F.when(n == "", F.lit("unspecified")).otherwise(n))
    return F.array_sort(F.array_distinct(named))


def without_code(text: Column | str, mode: str = "line") -> Column:
    text = _col(text)
    if mode == "markdown":
        return F.when(_fenced(text), _markdown(text).kept).otherwise(text)
    return _erase(text, _all(text, CODE_PATTERN if mode == "line" else FENCED_PATTERN, FENCE), "")


def user_references(text: Column | str) -> Column:
    """@names, distinct and sorted."""
    return F.array_sort(F.array_distinct(_all(_col(text), USER_PATTERN, "@")))


def parse_reference(ref: Column, owner: Column | None = None, project: Column | None = None) -> Column:
    """(owner, project, number) of one reference, the absent parts from the defaults."""
    owner = F.lit(OWNER_MARK) if owner is None else owner
    project = F.lit(PROJECT_MARK) if project is None else project
    group = lambda pattern, n: F.regexp_extract(ref, pattern, n)
    first = F.replace(group(HASH_REFERENCE_PATTERN, 1), F.lit("/"), F.lit(""))
    second, number = group(HASH_REFERENCE_PATTERN, 2), group(HASH_REFERENCE_PATTERN, 3)
    by_hash = (F.when((first == "") & (second == ""), F.array(owner, project, number))
                .when(first == "", F.array(second, project, number))
                .when(second == "", F.array(F.lit(""), F.lit(""), F.lit("")))
                .otherwise(F.array(first, second, number)))
    return (F.when(ref.rlike(HASH_REFERENCE_PATTERN), by_hash)
             .when(ref.rlike(GH_REFERENCE_PATTERN), F.array(owner, project, group(GH_REFERENCE_PATTERN, 1)))
             .otherwise(F.array(*[group(URL_REFERENCE_PATTERN, n) for n in (1, 2, 3)])))


# The parts of a reference `r` whose style is known, without matching it again. A link
# is read from its end: owner, project, kind of page, number.
PARTS = {
    "url": "substring_index(substring_index(r, '/', -4), '/', 1), substring_index(substring_index(r, '/', -3), '/', 1), "
           "substring_index(r, '/', -1)",
    "o/p#d": "substring_index(r, '/', 1), substring_index(substring_index(r, '/', -1), '#', 1), substring_index(r, '#', -1)",
    "o#d": f"substring_index(r, '#', 1), '{PROJECT_MARK}', substring_index(r, '#', -1)",
    "#d": f"'{OWNER_MARK}', '{PROJECT_MARK}', substring_index(r, '#', -1)",
    "gh-d": f"'{OWNER_MARK}', '{PROJECT_MARK}', substring_index(r, '-', -1)",
}


def _refs(hits: str, style: str) -> str:
    """The references of one style out of a column of raw forms."""
    return (f"transform(array_distinct(`{hits}`), r -> named_struct('raw', r, 'refstyle', '{style}', "
            f"'parts', array({PARTS[style]})))")


def with_issue_references(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add a column per entry of `texts`: the issue references of that text, sorted by
    raw form. Each pass erases what it found before the next one looks, as the longer
    forms hold the shorter; so every pass is two steps, for all texts at once."""
    left, hits, refs = ({o: f"_{o}_{part}" for o in texts} for part in ("left", "hits", "refs"))
    step = lambda frame, names, build: frame.withColumns({names[o]: build(o) for o in texts})
    erased = lambda by: {left[o]: F.expr(
        f"aggregate(array_distinct(`{hits[o]}`), `{left[o]}`, (acc, m) -> replace(acc, m, '{by}'))") for o in texts}

    df = step(df, left, lambda o: texts[o])
    df = step(df, hits, lambda o: _all(F.col(left[o]), ISSUE_URL_PATTERN, "://"))
    df = df.withColumns({**{refs[o]: F.expr(_refs(hits[o], "url")) for o in texts}, **erased(" ")})
    df = step(df, hits, lambda o: urls(left[o])).withColumns(erased(""))
    for style, pattern, mark in REF_STYLES:
        df = step(df, hits, lambda o: _all(F.col(left[o]), pattern, mark))
        more = {refs[o]: F.expr(f"concat(`{refs[o]}`, {_refs(hits[o], style)})") for o in texts}
        df = df.withColumns({**more, **erased(" ")})
    df = df.withColumns({o: F.array_sort(refs[o]) for o in texts})
    return df.drop(*left.values(), *hits.values(), *refs.values())


# The finders that need the text only, in the order they run: (feature, builder, reads code).
FINDERS = (("plus_1", plus_one, True), ("urls", urls, True),
           ("code", code_languages, True), ("userref", user_references, False))
VOTES_AND_USERS = ("plus_1", "userref")


def _sorted_concat(a: str, b: str) -> Column:
    empty = F.expr(f"filter(coalesce({a}, {b}), x -> false)")
    return F.array_sort(F.concat(F.coalesce(F.col(a), empty), F.coalesce(F.col(b), empty)))


def annotate(df: DataFrame, title: str = "title", text: str = "text", owner: str = "project_owner",
             project: str = "project_name", provenance: str = "provenance",
             references_only: bool = False, mode: str = "line") -> DataFrame:
    """Add the features of title and text. A null field is skipped; a field the row
    kind lacks is passed as "". References get the row's own project as default."""
    fields = (title, text)
    names = [n for n, _, _ in FINDERS if not (references_only and n in VOTES_AND_USERS)]
    df = df.withColumns({f"_{f}_bare": without_code(f, mode) for f in fields})
    found = {}
    for field in fields:
        for name, build, reads_code in FINDERS:
            if name in names:
                source = F.col(field) if reads_code else F.col(f"_{field}_bare")
                found[f"_{field}_{name}"] = build(source, mode) if name == "code" else build(source)
    df = df.withColumns(found)
    df = with_issue_references(df, {f"_{f}_issues": F.col(f"_{f}_bare") for f in fields})
    pair = lambda name: (f"_{title}_{name}", f"_{text}_{name}")
    out = {"urls": _sorted_concat(*pair("urls")),
           "code": F.array_distinct(_sorted_concat(*pair("code")))}
    if not references_only:
        out["plus_1"] = F.coalesce(F.col(f"_{text}_plus_1"), F.col(f"_{title}_plus_1"))
        out["userref"] = _sorted_concat(*pair("userref"))
    direction = F.when(F.col(provenance) == "issue_crossref", F.lit("rev")).otherwise(F.lit(""))
    own = lambda part, mark, value: F.when(part == mark, F.col(value)).otherwise(part)
    out["issues"] = F.transform(_sorted_concat(*pair("issues")), lambda r: F.struct(
        r.raw.alias("raw"), r.refstyle.alias("refstyle"),
        F.array(own(r.parts[0], OWNER_MARK, owner), own(r.parts[1], PROJECT_MARK, project),
                r.parts[2], direction).alias("parts")))
    scratch = [f"_{f}_{n}" for f in fields for n in [*names, "bare", "issues"]]
    return df.withColumns(out).drop(*scratch)


def local_part(email: Column | str) -> Column:
    """The part before "@" without dots and blanks, in lower case."""
    return F.lower(F.translate(F.split_part(_col(email), F.lit("@"), F.lit(1)), ". ", ""))


def closest_login(email: Column | str, candidates: Column | str) -> Column:
    """The candidate equal to the local part ignoring case, or null."""
    wanted = local_part(email)
    hits = F.filter(F.array_sort(_col(candidates)), lambda c: F.lower(c) == wanted)
    return F.try_element_at(hits, F.lit(1))
