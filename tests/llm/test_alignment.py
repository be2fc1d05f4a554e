import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from forgetide.llm import op12_alignment as A
from forgetide.llm.op12_alignment import Csr, aligned, group_links, incidence, overlap_links
from tests.llm.conftest import CLASHING, corpus, text

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(value):
    """(id, start, end) of both tokenizers, whole text at once; nothing where the bytes do not come back."""
    if not value:
        return [], []
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + value, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode())
         for i in model.encode(value)]
    sides = []
    for side in (a, b):
        if b"".join(w for _, w in side) != (" " + value).encode():
            return [], []
        at, spans = 0, []
        for i, w in side:
            spans.append((i, at, at + len(w)))
            at += len(w)
        sides.append(spans)
    return sides


def brute(rows):
    """The result by comparing all tokens of a text."""
    every, held = [], Counter()
    for i, value in rows:
        a, b = tokens(value)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [[[x[0] for x in side if lo < x[2] <= hi] for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        held.update(set(links))
        every.append((i, a, b, links, groups))
    best = {}
    for (x, _), k in held.items():
        best[x] = max(best.get(x, 0), k)
    out = []
    for i, a, b, links, groups in every:
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(held[e] == best[e[0]] for e in links),
                    sum(held[e] for e in links), hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    return sorted(map(str, out))


def test_products_equal_dense():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = rng.integers(0, 3, (6, 9)) * (rng.random((6, 9)) < 0.4), rng.integers(0, 3, (9, 7)) * (rng.random((9, 7)) < 0.4)

        def sparse(m):
            return Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])

        def dense(c):
            m = np.zeros((len(c.first) - 1, c.width), np.int64)
            np.add.at(m, (c.rows(), c.indices), c.values)
            return m
        assert (dense(sparse(x).times(sparse(y))) == x @ y).all()
        assert (dense(sparse(x).transposed()) == x.T).all()
        product = sparse(x).times(sparse(y))
        assert len(set(zip(product.rows().tolist(), product.indices.tolist()))) == len(product.indices)
    assert incidence(np.array([2, 1])).product_sizes(incidence(np.array([1, 1, 1])).transposed()).tolist() == [2, 1]


ROWS = [r for r in corpus() if len(r[1] or "") < 4000] + [
    (60, "a  b "), (61, " lead"), (62, "<|endoftext|> <s> x</s>"), (63, "x▁y"), (64, "tab\tand\r\nline\n\n"), (65, "日本語のテキスト"), (66, "\0 nul"),
    (67, "naïve café ½ ﬁ"), (68, "🙂🙃 👩‍👩‍👧"), (69, "▁"), (70, " "), (71, "    deep   indent"), (72, "https://example.org/a?b=c&d=1234567890")]


def test_equal_to_all_pairs(docs, monkeypatch):
    got = [tuple(r) for r in aligned(docs(ROWS, CLASHING), *PATHS).collect()]
    assert sorted(map(str, got)) == brute(ROWS)


def test_long_text_and_many_chunks(docs):
    rows = [(1, text(9, 60_000)), (2, text(9, 60_000)), *((10 + i, text(i, 200)) for i in range(50))]
    got = {r.doc_id: r for r in aligned(docs(rows).repartition(3), *PATHS).collect()}
    assert got[1].groups_sha256 == got[2].groups_sha256 and got[1].n_links == got[2].n_links > 60_000
    assert got[1].count_sum >= 2 * got[1].n_links and len(got) == 52


@pytest.mark.parametrize("stretch", [1, 5, 1 << 19])
def test_links_with_places(docs, monkeypatch, stretch):
    rows = [(1, "Alignment of tokenizers, naïve 日本"), (2, None), (3, "x▁y")]
    monkeypatch.setattr(A, "STRETCH", stretch)
    pair, found = A.pair_of(*PATHS), {}
    ids_a, ids_b, n_a, _ = pair.encoded([t or "" for _, t in rows])
    both = A.Alignment(pair.bytes_a.size[ids_a], pair.bytes_b.size[ids_b], n_a)
    a, b = tokens(rows[0][1])
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2])
    assert sorted(t for part in both.overlaps() for t in zip(*map(np.ndarray.tolist, part))) == want
    cuts = sorted({x[2] for x in a} & {y[2] for y in b})
    group = {end: sum(c < end for c in cuts) for _, _, end in a + b}
    assert sorted(t for part in both.group_links() for t in zip(*map(np.ndarray.tolist, part))) == [
        (i, j) for i, x in enumerate(a) for j, y in enumerate(b) if group[x[2]] == group[y[2]]]
    if stretch == 5:
        got = sorted((r.a_place, r.b_place, r.n_bytes) for r in overlap_links(docs(rows), *PATHS).collect() if r.doc_id == 1)
        assert got == want
        assert group_links(docs(rows), *PATHS).filter("doc_id <> 1").isEmpty()


def test_no_rows(docs):
    assert aligned(docs([]), *PATHS).count() == 0
