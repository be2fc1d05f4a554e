import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from forgetide.llm.op10_tokens import WaveletMatrix, encode_to_shards, occurrences, read_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(5, "A cat, a hat.\nA  double   space \n and\ttabs "), (3, ""), (1, None), (9, " leadé \U0001F600 ▁ x"),
         (2, "the the the " * 300), (2, "same id"), (2, "same id"), (None, "no id"), (7, "nul \0 in it"), (8, " \n x    y")]


def expected(rows):
    model = Tokenizer.from_file(BPE)
    model.encode_special_tokens = True
    return {t: [*model.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}


def test_files_hold_the_library_ids(docs, llm, tmp_path):
    ids = expected(TEXTS)
    folder = encode_to_shards(docs(TEXTS), BPE, str(tmp_path / "shards"), shard_tokens=64)
    rows = [tuple(r) for r in read_documents(llm, folder).collect()]
    assert len(rows) == len(TEXTS)
    assert sorted((r[0] is not None, r[0], r[2], r[3]) for r in rows if r[0] is not None) == sorted(
        (True, i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in TEXTS if i is not None)
    ordered = sorted(rows, key=lambda r: r[1])
    at = 0
    for row in ordered:
        assert row[1] == at
        at += row[2]
    known = [r[0] for r in ordered if r[0] is not None]
    assert known == sorted(known) and ordered[0][0] is None
    token = ids["the the the " * 300][0]
    assert occurrences(llm, folder, token).count() == sum(i == token for _, t in TEXTS for i in ids[t])


def test_empty_table(docs, llm, tmp_path):
    folder = encode_to_shards(docs([]), BPE, str(tmp_path / "none"))
    assert read_documents(llm, folder).count() == 0


def test_rank_select_access():
    codes = np.random.default_rng(1).integers(0, 37, 3000)
    matrix = WaveletMatrix.build(codes, 6)
    assert (matrix.decode() == codes).all()
    for i in (0, 511, 512, 1700, 2999):
        assert matrix.access(i) == codes[i]
    for code in (0, 5, 36, 40):
        places = np.flatnonzero(codes == code)
        assert matrix.count(code, 100, 2500) == ((places >= 100) & (places < 2500)).sum()
        assert [matrix.select(code, k) for k in range(len(places))] == places.tolist()
        assert matrix.select(code, len(places)) == -1
