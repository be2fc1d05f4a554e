"""Document fingerprints: a threshold-scaled sketch, in DataFrame functions only.

A document's set is its runs of five words (all its words when it has fewer), hashed to 64 bits. The
fingerprint keeps every hash below one SCALE-th of the range, so its size follows the document's, the sketch of a union
is the union of sketches, and containment between very unequal documents can be estimated. The fraction is the same for every
document: a short one of which no hash is that small has an empty sketch. Likeness is the Jaccard similarity of two
sketches; of two empty ones it is 1 when the texts are equal and 0 otherwise.

The next document, descending by id, is found without a global order: ids are put into buckets of
1 << BUCKET_BITS numbers, each a window of its own. A bucket also gets the first row of the next bucket that has rows; which that is
is found level by level in the same way, over bucket numbers only.

Null text counts as empty. Rows of one id follow each other by text, descending; rows without an id come last. Those two
kinds sit in one window group. One row alone is its own next document. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgetide.session import cut

SIZE = 5
SCALE = 8
BELOW = -(1 << 63) + (1 << 64) // SCALE
BUCKET_BITS = 9
LEVEL_BITS = 14
LEVELS = 4  # 9 + 4 * 14 bits are more than 63
NO_ID = -(1 << 62)  # below every bucket


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of a text column, ascending hashes."""
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_words")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SIZE - 1), F.lit(1))),
                       lambda i: F.xxhash64(F.slice("_words", i, SIZE)))
    every = hashed.withColumn("_runs", F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))).drop("_words")
    below = F.filter("_runs", lambda h: h < F.lit(BELOW))
    return every.withColumn(name, F.array_sort(F.array_distinct(below))).drop("_runs")


def likeness(a: str, b: str, same: Column) -> Column:
    """Jaccard similarity of two sketches. Two empty ones tell nothing about their texts: 1 if `same`, else 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: str, b: str) -> Column:
    """Share of sketch a that is in sketch b, 1 for an empty one."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def spelled(sketch: str) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_lower(keys: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, lower): the next lower key of distinct numbers, null for the least."""
    if levels == 0:  # all bits are used up: two keys at most, and the one for rows without id
        return keys.select("key", F.lead("key").over(Window.orderBy(F.desc("key"))).alias("lower"))
    grouped = keys.withColumn("group", F.shiftright("key", LEVEL_BITS))
    tops = grouped.groupBy("group").agg(F.max("key").alias("top"))
    above = next_lower(tops.select(F.col("group").alias("key")), levels - 1)
    border = above.join(tops.withColumnRenamed("group", "lower"), "lower").select(F.col("key").alias("group"), "top")
    inside = grouped.withColumn("lower", F.lead("key").over(Window.partitionBy("group").orderBy(F.desc("key"))))
    return inside.join(border, "group", "left").select("key", F.coalesce("lower", "top").alias("lower"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the sketch of each document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return with_sketch(rows, "text", "sketch").drop("text")


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness."""
    bucket = F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.lit(NO_ID))
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")).withColumn(
        "bucket", bucket)
    buckets = cut(plain.select(F.col("bucket").alias("key")).distinct())
    highest = buckets.agg(F.max("key")).first()[0]  # one number
    chain = next_lower(buckets).select(F.col("key").alias("bucket"), F.coalesce("lower", F.lit(highest)).alias("from"))
    # the first row of each bucket goes to the bucket before it as well, behind its last row
    heads = plain.groupBy(F.col("bucket").alias("from")).agg(F.max(F.struct("doc_id", "text")).alias("head"))
    borders = chain.join(heads, "from").select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), "bucket")
    rows = with_sketch(plain.withColumn("border", F.lit(False)).unionByName(borders.withColumn("border", F.lit(True))), "text", "sketch")
    order = Window.partitionBy("bucket").orderBy("border", F.desc_nulls_last("doc_id"), F.desc("text"))
    inside = rows.withColumn("following", F.lead(F.struct("text", "sketch")).over(order)).filter("NOT border").select(
        "doc_id", "text", "sketch", "following")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = inside.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("following.text", F.lit(1), half))).withColumn(
        "next_sketch", F.col("following.sketch")).withColumn("same_edited", F.col("edited") == F.col("text")).withColumn(
        "same_next", F.col("following.text") == F.col("text")).drop("text", "following")
    done = with_sketch(pairs, "edited", "edited_sketch")
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("sketch").alias("fingerprint"),
                       spelled("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch", F.col("same_edited")).alias("near_edited"),
                       likeness("sketch", "next_sketch", F.col("same_next")).alias("near_next"),
                       containment("edited_sketch", "sketch").alias("edited_in_text"))
