"""Personal data by patterns, and the terms that give it away, in DataFrame functions only.

Base kinds are patterns over the whole text: email, ip, card, phone. On top, every value
found is a protected entity, and all words of the documents that hold it are measured over the corpus, wherever they
stand: a term whose documents hold the entity at least SHARE of the time, in at least SUPPORT different texts, and
which raises the entity's probability by at least BITS bits, discloses it. Each place where such a term stands outside the
base spans of a document that holds the entity is reported as `term`.

Pairs of entities and terms are made only where the bounds can still be met: an entity in SUPPORT different texts and in no
more documents than BITS allow, a term in SUPPORT different texts and in no more documents than SHARE allows for any entity.

Null text counts as empty. Repeated rows count as documents, not as different texts. Every row gives one
row; columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgetide.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds. Possessive runs and the look-behind spare the matcher starts that cannot
# give a match; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}{3,}+"
SUPPORT = 2
SHARE = 0.5
BITS = 6.0
SPAN = "array<struct<start:int,end:int,value:string>>"
BLOCK = 64


def spans(text: Column, pattern: str) -> Column:
    """Start, end and text of all matches, in code points: what lies between matches, and the matches,
    have lengths, and their running sum gives the places. It is taken by blocks, so many matches stay cheap."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(found, lambda value, i: F.struct(
        F.length(F.get(between, i)).alias("gap"), F.length(value).alias("size"), value.alias("value")))

    def block(of: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(of, empty, lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["size"]).alias("end"),
                                                  p["value"].alias("value")))).alias("out")))

    def all_blocks(of: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / BLOCK).cast("int")),
                             lambda i: block(F.slice(of, i * BLOCK + 1, BLOCK)))
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda b, o: F.transform(
            b["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value")))))

    return F.aggregate(F.array(pairs), F.array().cast(SPAN), lambda _, of: F.when(F.size(of) == 0, F.array().cast(SPAN))
                       .when(F.size(of) <= BLOCK, block(of)["out"]).otherwise(all_blocks(of)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: F.when(c == "", 0).otherwise(c.cast("int")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
            F.split(value, r"\."), lambda part: F.substring(F.concat(F.lit("000"), part), -3, 3).cast("int") <= 255)
    if kind == "card":
        return count.between(13, 19) & _luhn(value)
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add an array of valid spans for each base kind."""
    for kind, pattern in PATTERNS.items():
        found = F.when(_may_have(kind, F.col(text)), spans(F.col(text), pattern)).otherwise(F.array().cast(SPAN))
        docs = docs.withColumn(f"_all_{kind}", found).withColumn(
            kind, F.filter(f"_all_{kind}", lambda s: _valid(kind, s["value"]))).drop(f"_all_{kind}")
    return docs


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.xxhash64(F.lit(kind), s["value"]))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _document_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _term))


def _outside(words: DataFrame, taken: DataFrame) -> DataFrame:
    """Those of the `words` of a text that overlap none of its `taken` spans, both (text_hash, start, end). In the order of places a word
    overlaps when a span that began before its end goes on beyond its start."""
    places = words.select("text_hash", F.col("end").alias("at"), F.lit(0).alias("span"), "start", "end").unionByName(
        taken.select("text_hash", F.col("start").alias("at"), F.lit(1).alias("span"), "start", "end"))
    before = Window.partitionBy("text_hash").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("span") == 1, F.col("end"))).over(before)
    return places.withColumn("_reach", reach).filter("span = 0 AND (_reach IS NULL OR _reach <= start)").select("text_hash", "start", "end")


def personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    folder = scratch_path(spark, "personal")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    base = stored(base_spans(hashed).select("doc_id", "text_hash", F.array_distinct(F.concat(*(_entities(kind) for kind in KINDS))).alias("entities"), *(
        F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind) for kind in KINDS)), "base")
    total = F.lit(float(base.count()))

    # a text with its copies is one row; `n` counts the copies
    texts = base.filter(F.size("entities") > 0).groupBy("text_hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"))
    held = texts.select("text_hash", "n", F.explode("entities").alias("entity"))
    of_entity = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("with_entity")).filter(
        (F.col("texts") >= SUPPORT) & (F.log2(total / F.col("with_entity")) >= BITS)).drop("texts")
    held = stored(held.join(of_entity, "entity"), "held")
    of_term = rows.select(F.explode(_document_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term")).filter(
        (F.col("with_term") >= SUPPORT) & (F.log2(total / F.col("with_term")) >= BITS))
    in_texts = hashed.join(held.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select(
        "text_hash", F.explode(_document_words(F.col("text"))).alias("term")).join(of_term, "term")
    pairs = stored(held.join(in_texts, "text_hash").filter(F.col("with_entity") >= SHARE * F.col("with_term")), "pairs")
    telling = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.count("*").alias("texts"), F.sum("n").alias("both")).filter(
        (F.col("texts") >= SUPPORT) & (F.col("both") >= SHARE * F.col("with_term")) &
        (F.log2(F.col("both") * total / (F.col("with_term") * F.col("with_entity"))) >= BITS)).select("entity", "term")
    told = stored(pairs.join(telling, ["entity", "term"]).select("text_hash", "term").distinct(), "told")

    of_texts = told.select("text_hash").distinct()
    words = hashed.join(of_texts, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select(
        "text_hash", F.explode(spans(F.col("text"), WORD)).alias("w")).select("text_hash", "w.start", "w.end", _term(F.col("w.value")).alias("term"))
    taken = base.join(of_texts, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", F.inline(F.concat(*KINDS)))
    extra = _outside(words.join(told, ["text_hash", "term"]), taken).groupBy(F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    joined = base.join(extra, F.col("text_hash") == F.col("_hash"), "left").select(
        "doc_id", *KINDS, F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("term"))

    def shown(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*(_named(kind) for kind in kinds)), ",")
    return joined.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
                         F.sha2(shown(KINDS), 256).alias("base_sha256"), shown((*KINDS, "term")).alias("spans"))
