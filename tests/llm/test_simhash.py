import random
import re

import numpy as np
import pytest
import xxhash

from forgetide.llm import op13_simhash as S
from forgetide.llm.op13_simhash import fingerprint, flips, links, near_texts
from forgetide.operators.components import components
from forgetide.session import scratch_path
from tests.llm.conftest import CLASHING, corpus, edited, text


def plain(value):
    """The fingerprint, bit by bit."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in value or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", folded)
    runs = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def joined_up(rows):
    """Smallest id over fingerprints within four bits, by all pairs."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                root[top(p)] = top(q)
    least = {}
    for i, p in rows:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return sorted(((i, f"{p:016x}", least.get(top(p))) for i, p in rows), key=str)


def test_fingerprints(monkeypatch):
    for value in (None, "", " \n\t", "one", "Two words", "A b C d", "a b c d a b c d a b c d", text(1, 500), "é É İ   x y z", "\0 a b\x0bc"):
        assert fingerprint(value) & (1 << 64) - 1 == plain(value)
    long, spaced = text(2, 3000), " \n".join(text(3, 300).split(" ")) + " " * 50
    monkeypatch.setattr(S, "PIECE", 7)  # cut in many pieces
    for value in (long, spaced, text(4, 4), "a b c d e", " " * 30, "abcdefghijklmnop q"):
        assert fingerprint(value) & (1 << 64) - 1 == plain(value)


def test_ball_sizes():
    assert [len(flips(22, 1)), len(flips(32, 2)), len(flips(64, 2)), len(flips(5, 0))] == [23, 529, 2081, 1]
    for segments in (S.THREE, S.TWO):
        assert sum(w for w, _ in segments) == 64 and sum(r + 1 for _, r in segments) == S.RADIUS + 1


def test_components_equal_all_pairs(docs):
    base = text(50, 400)
    rows = corpus() + [(100 + i, edited(base, i, i % 6)) for i in range(60)] + [(-5, text(3)), (300, "  ")]
    got = near_texts(docs(rows, CLASHING)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == joined_up([(i, plain(t)) for i, t in rows])


@pytest.mark.parametrize(("segments", "crowd"), [(S.THREE, 48), (S.TWO, 48), (S.THREE, 1), (S.TWO, 2)])
def test_links_of_any_table(llm, segments, crowd):
    rng = random.Random(7)
    values = {0, -1}
    for _ in range(40):  # balls around random centres, and chains that leave them
        value = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(64)
            values.add(int(np.array([value], np.uint64).view(np.int64)[0]))
    nodes = llm.createDataFrame([(v,) for v in values], "node long")
    found = links(nodes, scratch_path(llm, "links"), segments, crowd)
    assert found.filter("x >= y OR bit_count(x ^ y) > 4").isEmpty()
    got = {r.node: r.component for r in components(found, "x", "y").collect()}
    unsigned = [(i, v & (1 << 64) - 1) for i, v in enumerate(sorted(values))]
    groups = {}
    for (_, v), (_, _, least) in zip(unsigned, sorted(joined_up(unsigned)), strict=True):
        groups.setdefault(least, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(got.get(v, v), set()).add(v & (1 << 64) - 1)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_crowds_cost_no_pairs(llm):
    """Many fingerprints that share a segment and are linked with none: work grows with them, not with their pairs."""
    rng = random.Random(3)
    values: list[int] = []
    while len(values) < 1500:
        value = rng.getrandbits(40) << 22
        if all((value ^ other).bit_count() > 4 for other in values):
            values.append(value)
    nodes = llm.createDataFrame([(v,) for v in values], "node long")
    folder = scratch_path(llm, "links")
    assert links(nodes, folder).isEmpty()
    assert llm.read.parquet(f"{folder}/there").count() == len(values)


def test_no_rows(docs):
    got = near_texts(docs([]))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0
