"""The registered queries of this package, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.op1_repeats import without_repeats
from forgetide.llm.op2_toxicity import fit, severity
from forgetide.llm.op3_lines import repeated_lines
from forgetide.llm.op4_jaccard_join import joined
from forgetide.llm.op5_fingerprints import compared
from forgetide.llm.op6_secrets import secrets
from forgetide.llm.op7_pieces import encode_decode
from forgetide.llm.op8_decontamination import matches
from forgetide.llm.op9_personal import personal
from forgetide.llm.op10_tokens import token_files
from forgetide.llm.op11_whitening import components_of, whitened
from forgetide.llm.op12_alignment import aligned
from forgetide.llm.op13_simhash import near_texts
from forgetide.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows that a Python worker gets at once; a text may be megabytes long.
BATCH_ROWS = "1024"


def prepare(spark: SparkSession) -> SparkSession:
    configure(ship(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    # the operators write what they use again, so shuffle files go when their job is done
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def query(name: str, sql: str | None = None):
    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = name, job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    """What is left of every document without strings of 200 bytes that also start elsewhere."""
    return without_repeats(documents(spark, sf_dir))


@query("op2_toxicity")
def toxicity(spark, sf_dir):
    """Expected severity of every document."""
    docs = documents(spark, sf_dir)
    return severity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op3_line_dedup")
def line_dedup(spark, sf_dir):
    """Lines of every document that go because a near-equal line stays elsewhere."""
    return repeated_lines(documents(spark, sf_dir), shortest=1)


#: Sets of three-word runs, links at 9/10, and for each document the smallest one that links lead to.
NEAR_DOCUMENTS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS run FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT id, b FROM reach JOIN links ON other = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach ON id = d.doc_id GROUP BY d.doc_id, n
"""


@query("op4_jaccard_join", NEAR_DOCUMENTS)
def near_documents(spark, sf_dir):
    """Components of documents with nearly equal sets of three-word runs."""
    return joined(documents(spark, sf_dir))


@query("op5_fingerprints")
def fingerprint_likeness(spark, sf_dir):
    """Fingerprints of every document and its edited text, and how alike they are."""
    return compared(documents(spark, sf_dir))


@query("op6_secrets")
def secret_spans(spark, sf_dir):
    """Secrets of every document: counts, digest of the base spans, all spans."""
    return secrets(documents(spark, sf_dir))


@query("op7_sentencepiece")
def sentencepiece(spark, sf_dir):
    """Ids of all documents, and whether decoding gives the text back."""
    rows = encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "ids", "n_tokens", "n_fallback", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "same")


#: Words of letters and digits with A-Z folded; an item is found when a document holds 4/5 of its runs of five words.
LEAKS = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
runs AS (
  SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS run FROM words WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM runs WHERE kind = 'i' GROUP BY id),
held AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM runs d JOIN runs i ON d.run = i.run AND d.kind = 'd' AND i.kind = 'i'
  GROUP BY ALL)
SELECT doc_id, item_id, k / n AS containment FROM held JOIN sizes ON item_id = id WHERE 5 * k >= 4 * n
"""


@query("op8_decontamination", LEAKS)
def leaked_items(spark, sf_dir):
    """Benchmark items that documents hold."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op9_personal_data")
def personal_data(spark, sf_dir):
    """Personal data of every document: counts, digest of the base spans, all spans."""
    return personal(documents(spark, sf_dir))


@query("op10_token_files")
def token_file_query(spark, sf_dir):
    """Every document's place in the shard files, its ids summed up from them."""
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    """Every vector along the 32 widest directions, scaled to unit variance."""
    return components_of(whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    """Links between the tokens of two tokenizers in every document, with their counts over the corpus."""
    return aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_simhash")
def simhash(spark, sf_dir):
    """Components of documents whose fingerprints differ in at most four bits."""
    return near_texts(documents(spark, sf_dir))
