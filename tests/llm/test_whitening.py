import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgetide.llm.op11_whitening import Slabs, components_of, whitened
from forgetide.llm.queries import QUERIES

SHAPE = "vec_id long, embedding array<float>, label int"


def expected(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], n, deviation, centred, values[::-1], vectors[:, ::-1]


def compare(got, rows, kept):
    ids, n, deviation, centred, values, vectors = expected(rows)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(ids) * kept
    for k in range(kept):
        mine = np.array([table[i, k + 1].whitened for i in ids])
        true = centred @ vectors[:, k] / math.sqrt(values[k])
        sign = np.sign(true[np.abs(true).argmax()] * mine[np.abs(true).argmax()])
        assert np.allclose(mine, sign * true, atol=1e-7)
        assert np.allclose([table[i, k + 1].explained for i in ids], values[k] / values.sum(), rtol=1e-6)
    assert [table[i, 1].deviation for i in ids] == deviation and {r.n for r in got} == {n}
    assert {r.identity_error for r in got}.pop() < 1e-6


@pytest.mark.parametrize(("width", "block_rows", "slab_blocks"), [(5, 2048, 1 << 16), (40, 16, 1 << 16), (6, 8, 2)])
def test_equal_to_numpy(llm, width, block_rows, slab_blocks):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, width)) * np.linspace(1, 4, width)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    bad = [(1000, None), (1001, [None] * width), (1002, [float("nan")] * width), (1003, [math.inf] + [0.0] * (width - 1)), (1004, [])]
    table = llm.createDataFrame([(i, v, 1) for i, v in rows + bad], SHAPE).withColumns({c: F.lit("x") for c in (
        "n", "x", "place", "index", "vector", "d")}).repartition(7)
    got = components_of(whitened(table, block_rows=block_rows, slab_blocks=slab_blocks)).collect()
    compare(got, rows, min(32, width))


def test_slabs_are_consecutive(llm):
    rows = llm.range(1000).repartition(9).withColumn("place", F.monotonically_increasing_id())
    slabs = Slabs(rows.cache(), 10, 30)
    seen = [sorted(r["index"] for r in numbered.collect()) for numbered, _ in slabs]
    assert len(seen) > 2 and all(indices == list(range(len(indices))) for indices in seen) and sum(map(len, seen)) == 1000


def test_flat_directions_have_no_scale(llm):
    """Constant dimensions, repeated rows, fewer rows than dimensions."""
    table = llm.createDataFrame([(i % 3, [float(i % 2), 2.0, -1.0], 0) for i in range(10)], SHAPE)
    got = components_of(whitened(table)).collect()
    assert len(got) == 30
    assert {abs(round(r.whitened, 9)) for r in got if r.component == 1} == {1.0}
    assert {r.whitened for r in got if r.component > 1} == {None}
    assert {round(r.explained, 9) for r in got} == {1.0, 0.0}
    same = components_of(whitened(llm.createDataFrame([(1, [0.5], 0)], SHAPE))).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, None)]


def test_wide_numbers_and_odd_lengths(llm):
    shape = "vec_id long, embedding array<double>"
    rows = [(1, [2.0 ** 40, 0.0]), (2, [-(2.0 ** 40), 1.0]), (3, [2.0 ** 60, 0.0]), (4, [1.0, 2.0, 3.0]), (None, [0.0, 0.5])]
    got = {(r.vec_id, r.component): r for r in components_of(whitened(llm.createDataFrame(rows, shape))).collect()}
    assert {i for i, _ in got} == {1, 2, None} and got[1, 1].n == 3 and got[1, 1].deviation is None
    assert got[None, 1].deviation == 96 ** 2 - 96 * 96 + (3 * 1000032 - 3000096) ** 2


def test_empty_table(llm):
    assert components_of(whitened(llm.createDataFrame([], SHAPE))).count() == 0


def test_query(llm):
    rows = [tuple(r) for r in llm.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(QUERIES["op11_embedding_whitening"](llm, "/root/testdata/sf0.001").collect(), rows, 32)
