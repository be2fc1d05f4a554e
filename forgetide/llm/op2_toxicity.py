"""Toxicity by cumulative-link ordinal regression over sparse word counts.

Grades are ordered: 0 harmless, 1 toxic, 2 toxic and of low quality. One weight vector serves all
thresholds: P(grade > k) = 1 / (1 + exp(cut_k - weights . counts)). The expected severity is the sum
of these probabilities. Words are runs of letters, A-Z folded; the text's counts of them are
the features, so a score takes one pass over the bytes and no shuffle.

The model is fitted on the driver on at most SAMPLE labelled rows, those with the smallest hash of
their id, each with one text however many documents share its id; FEATURES words are kept, by the information they give about
the grade, counted in Spark. These two are the bounds of what the driver holds. Everything else covers all rows.

Null text counts as empty. Labels that are null are left out; without any label the severity is 0 and no
document is toxic. Every row of the documents gives one row; other columns are kept by `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import NOT_LETTER, Words, pieces, text_bytes
from forgetide.llm.regions import store
from forgetide.session import scratch_path

SAMPLE = 8_000
FEATURES = 256
MIN_DOCUMENTS = 3
RIDGE = 0.1  # on the sum over the sample
CLIP = 8.0  # a word counts so many times at most
GRADES = 3


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one for each grade above 0

    def above(self, logits: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - logits[:, None], -500, 500)))

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bounds) - 1)
        for a, b in pieces(bounds):
            rows, places, counts = _counts(Words(data, bounds[a:b + 1], NOT_LETTER), self.words)
            np.add.at(out, a + rows, self.weights[places] * np.minimum(counts, CLIP))
        return out


def _counts(found: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, count) of its words in some texts."""
    if not len(vocabulary) or not len(found.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    place = np.minimum(np.searchsorted(vocabulary, found.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[place] == found.hash)
    row = np.searchsorted(found.first, hit, "right") - 1
    pairs, counts = np.unique(row * len(vocabulary) + place[hit], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), counts.astype(float)


def _slopes(x: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all grades, and the slopes of P(grade > k), with 0 at both ends."""
    above = 1 / (1 + np.exp(np.clip(cuts[None, :] - (x @ weights)[:, None], -500, 500)))
    side = np.ones((len(x), 1))
    p = -np.diff(np.concatenate([side, above, 0 * side], 1), axis=1)
    return np.maximum(p, 1e-12), np.concatenate([0 * side, above * (1 - above), 0 * side], 1)


def fit_cuts(x: np.ndarray, grade: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts: Fisher scoring on the penalised likelihood, a step is halved until it helps."""
    n, rows = x.shape[1], np.arange(len(x))
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    values = np.concatenate([np.zeros(n), np.maximum.accumulate(np.log((1 - share) / share) + 1e-2 * np.arange(GRADES - 1))])

    def loss(v):
        if (np.diff(v[n:]) <= 0).any():
            return np.inf
        return -np.log(_slopes(x, v[:n], v[n:])[0][rows, grade]).sum() + ridge / 2 * (v[:n] ** 2).sum() + 1e-3 / 2 * (v[n:] ** 2).sum()

    now = loss(values)
    for _ in range(rounds):
        p, slope = _slopes(x, values[:n], values[n:])
        # how the probability of each grade moves with the logit and with each cut
        by_logit = slope[:, :-1] - slope[:, 1:]
        by_cut = np.zeros((GRADES - 1, len(x), GRADES))
        for k in range(GRADES - 1):
            by_cut[k, :, k], by_cut[k, :, k + 1] = slope[:, k + 1], -slope[:, k + 1]
        pull = by_logit[rows, grade] / p[rows, grade]
        slant = np.concatenate([x.T @ pull - ridge * values[:n],
                                [(by_cut[k][rows, grade] / p[rows, grade]).sum() - 1e-3 * values[n + k] for k in range(GRADES - 1)]])
        bend = np.zeros((len(values), len(values)))
        bend[:n, :n] = (x * (by_logit ** 2 / p).sum(1)[:, None]).T @ x + ridge * np.eye(n)
        for k in range(GRADES - 1):
            bend[:n, n + k] = bend[n + k, :n] = x.T @ (by_logit * by_cut[k] / p).sum(1)
            for j in range(GRADES - 1):
                bend[n + k, n + j] = (by_cut[k] * by_cut[j] / p).sum()
            bend[n + k, n + k] += 1e-3
        step, size = np.linalg.solve(bend, slant), 1.0
        while size > 1e-4 and (new := loss(values + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-7 * now:
            break
        values, now = values + size * step, new
    return values[:n], values[n:]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from labels (id, toxic, quality) and the documents they name."""
    ship(docs.sparkSession)
    named = labels.select(F.col(id_column).cast("long").alias("_id"), F.when(F.col("toxic") == 0, 0).when(
        F.col("toxic").isNotNull(), F.when(F.col("quality") == 0, 2).otherwise(1)).alias("_grade")).dropna()
    chosen = named.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)  # at most `sample` short rows
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text")).join(
        F.broadcast(chosen), "_id").select("_id", "_grade", "_text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            out = []
            for a, b in pieces(bounds):
                found = Words(data, bounds[a:b + 1], NOT_LETTER)
                for i in range(b - a):
                    values, counts = np.unique(found.hash[found.first[i]:found.first[i + 1]], return_counts=True)
                    out.append((values.view(np.int64), np.minimum(counts, int(CLIP))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.int64())),
                 pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=["id", "grade", "words", "counts"])

    listed = rows.mapInArrow(words, "id long, grade int, words array<long>, counts array<long>")
    # one text for each labelled id, however many documents share it
    one = store(listed.groupBy("id", "grade").agg(F.max(F.struct("words", "counts")).alias("text")).select("id", "grade", "text.*"),
                scratch_path(docs.sparkSession, "toxicity"), "labelled")
    n, all_bad = one.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    if all_bad in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 500.0))
    every = one.select("id", "grade", F.explode(F.arrays_zip("words", "counts")).alias("e")).select(
        "id", "grade", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))
    seen = every.groupBy("word").agg(F.count("*").cast("double").alias("seen"), F.count_if(F.col("grade") > 0).cast("double").alias("bad"))
    telling = seen.filter(F.col("seen") >= MIN_DOCUMENTS).withColumn("information", _information(float(n), float(all_bad))).orderBy(
        F.desc("information"), "word").limit(features)
    vocabulary = np.sort(np.array([r["word"] for r in telling.collect()], np.int64).view(np.uint64))
    kept = every.join(F.broadcast(docs.sparkSession.createDataFrame([(int(w),) for w in vocabulary.view(np.int64)], "word long")), "word")
    cells = kept.groupBy("id", "grade").agg(F.collect_list(F.struct("word", "count")).alias("cells"))
    got = one.select("id", "grade").join(cells, ["id", "grade"], "left").orderBy("id", "grade").collect()  # `sample` rows of `features` cells
    x = np.zeros((len(got), len(vocabulary)))
    for row, line in enumerate(got):
        for cell in line["cells"] or ():
            x[row, np.searchsorted(vocabulary, np.int64(cell["word"]).view(np.uint64))] = cell["count"]
    weights, cuts = fit_cuts(x, np.array([line["grade"] for line in got], np.int64))
    return Model(vocabulary, weights, cuts)


def _information(n: float, all_bad: float) -> Column:
    """Mutual information of a word's presence (`seen` texts, `bad` of them graded above 0) and a grade above 0."""
    seen, bad = F.col("seen"), F.col("bad")

    def cell(both: Column, texts: Column, share: float) -> Column:
        return F.when(both > 0, both / n * F.log(both * n / F.greatest(texts * share, F.lit(1e-9)))).otherwise(0.0)
    return (cell(bad, seen, all_bad) + cell(seen - bad, seen, n - all_bad)
            + cell(all_bad - bad, n - seen, all_bad) + cell(n - all_bad - seen + bad, n - seen, n - all_bad))


def _scorer(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(batch.num_columns - 1))
            above = model.above(model.logits(data, bounds))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(above.sum(1)), *(pa.array(above[:, k].copy()) for k in range(above.shape[1])),
                 pa.array(above[:, 0] > 0.5)], names=names)
    return run


def _score(docs: DataFrame, kept: list[Column], text_column: str, model: Model) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(*kept, F.coalesce(text_column, F.lit("")).alias("_scored_text"))
    added = ["severity", *(f"p_above_{k}" for k in range(GRADES - 1)), "toxic"]
    fields = [f"{i}" for i in range(len(kept))]
    plain = rows.toDF(*(f"c{i}" for i in fields), "_scored_text")
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in zip(fields, rows.schema[:-1], strict=True)]
    shape = ", ".join([*kinds, "severity double", *(f"p_above_{k} double" for k in range(GRADES - 1)), "toxic boolean"])
    return plain.mapInArrow(_scorer(model, [*(f"c{i}" for i in fields), *added]), shape)


def severity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, severity (0 to 2), p_above_0, p_above_1, toxic (p_above_0 over one half)."""
    return _score(docs, [F.col(id_column)], text_column, model).withColumnRenamed("c0", "doc_id")


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    scored = _score(docs, [F.col(f"`{c}`") for c in docs.columns], text_column, model)
    kept = scored.filter(~F.col("toxic")).select(*(f"c{i}" for i in range(len(docs.columns))))
    return kept.toDF(*docs.columns)
