"""Repeats, lines and near documents against brute force."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import forgetide.llm.op4_jaccard_join as J
from forgetide.llm.op1_repeats import maximal_repeats, repeat_groups, without_repeats
from forgetide.llm.op3_lines import SHORTEST, line_classes, repeated_lines, without_repeated_lines
from forgetide.llm.op4_jaccard_join import joined, one_of_each
from forgetide.llm.regions import region_members
from tests.llm.conftest import CLASHING, corpus, edited, text


def cut(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k:k + 200] for _, r in raws for k in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_on_strange_rows(docs):
    rows = corpus()
    found = without_repeats(docs(rows, CLASHING)).collect()
    assert sorted((tuple(r) for r in found), key=str) == cut(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_with_many_contexts(docs, monkeypatch, hot):
    """A passage in many documents, also where its anchors are too many for one task."""
    import forgetide.llm.op1_repeats as R
    if hot:
        monkeypatch.setattr(R, "HOT", 3)
    passage = text(9, 60)
    rows = [(i, f"{text(300 + i, 20 + i)} {edited(passage, i, i % 3)} {text(400 + i, 30)}") for i in range(25)]
    assert sorted((tuple(r) for r in without_repeats(docs(rows)).collect()), key=str) == cut(rows)


def test_maximal_repeats_cannot_grow():
    anchor = text(7)[:64].encode()
    after = [anchor + b"x" * 130 + b"abcdef", anchor + b"x" * 130 + b"abzzzz", anchor + b"x" * 130 + b"abcdee"]
    before = [b"p" * 30 + b"1", b"p" * 30 + b"2", b"q" * 31]
    assert sorted(maximal_repeats(before, after)) == [(30, 196, [0, 1])]
    before = [b"p" * 30 + b"1", b"p" * 30 + b"2", b"p" * 20 + b"q"]
    assert sorted(maximal_repeats(before, after)) == [(20, 196, [0, 1, 2]), (20, 199, [0, 2]), (30, 196, [0, 1])]


def test_repeat_groups_have_all_occurrences(docs):
    passage = text(9, 60)
    rows = [(i, f"{text(300 + i, 20)} {passage} {text(400 + i, 20)}") for i in range(5)]
    raws = {r[0]: r[1].encode() for r in docs(rows).select(F.xxhash64("doc_id", "text"), "text").collect()}
    groups = {}
    for r in repeat_groups(docs(rows)).collect():
        groups.setdefault((r.anchor, r.number, r.length), []).append((r.row, r.start))
    assert any(len(g) == 5 for g in groups.values())
    for (_, _, length), places in groups.items():
        strings = {raws[row][start:start + length] for row, start in places}
        assert length >= 200 and len(strings) == 1 and len(places) >= 2
        string = strings.pop()
        assert len(places) == sum(string in raw for raw in raws.values())  # no occurrence is left out


def jaccard_components(rows, size, top, bottom):
    sets = []
    for i, t in rows:
        parts = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(parts[k:k + size]) for k in range(max(len(parts) - size + 1, 1))) if parts else frozenset()))
    group = list(range(len(sets)))
    for _ in sets:
        for a, (i, x) in enumerate(sets):
            for b, (j, y) in enumerate(sets[:a]):
                if i is not None and j is not None and x and y and bottom * len(x & y) >= top * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), g in zip(sets, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least[g] if i is not None else None) for (i, s), g in zip(sets, group)), key=str)


@pytest.mark.parametrize("size, top, bottom", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_join_on_strange_rows(docs, size, top, bottom):
    rows = [r for r in corpus() if r[0] != 53]
    found = joined(docs(rows, CLASHING), size, (top, bottom)).collect()
    assert sorted((tuple(r) for r in found), key=str) == jaccard_components(rows, size, top, bottom)


def test_jaccard_join_of_chains(docs, monkeypatch):
    """Copies that differ more and more, so that ends are far apart; regions need several rounds."""
    import forgetide.llm.regions as R
    monkeypatch.setattr(R, "PIVOTS", 2)
    rows, now = [], text(11, 80)
    for i in range(25):
        rows.append((i, now))
        now = edited(now, i, 1 + i % 3)
    rows += [(100 + i, edited(text(11, 80), 50 + i, 2)) for i in range(12)]
    found = joined(docs(rows), 3, (9, 10)).collect()
    assert sorted((tuple(r) for r in found), key=str) == jaccard_components(rows, 3, 9, 10)


def test_jaccard_join_of_a_node_without_home(docs):
    """The first two are linked; the third agrees with the first alone, and is the least by hash: the second is nobody's home."""
    base = text(742, 80)
    rows = [(1, base), (2, edited(base, 1, 1)), (3, edited(base, 3, 7))]
    assert jaccard_components(rows, 3, 9, 10) == [(1, 78, 1), (2, 78, 1), (3, 78, 3)]
    assert sorted(tuple(r) for r in joined(docs(rows), 3, (9, 10)).collect()) == jaccard_components(rows, 3, 9, 10)


def test_one_of_each_keeps_columns(docs):
    rows = [(1, text(1)), (2, text(1)), (3, text(2)), (None, text(1)), (4, None)]
    frame = docs(rows, CLASHING)
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def line_groups(rows):
    """The (id, line) that stays, of every line of SHORTEST characters or more."""
    lines = [(i, n, x) for i, t in {(i, t) for i, t in rows if i is not None and t is not None} for n, x in enumerate(t.split("\n")) if len(x) >= SHORTEST]
    sets = [{x[k:k + 8] for k in range(len(x) - 7)} for _, _, x in lines]
    group = list(range(len(lines)))
    for _ in lines:
        for a in range(len(lines)):
            for b in range(a):
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    first = {}
    for (i, n, _), g in zip(lines, group):
        first[g] = min(first.get(g, (i, n)), (i, n))
    return {(i, n, *first[g]) for (i, n, _), g in zip(lines, group)}


def near_lines():
    base = [text(20 + k, 30) for k in range(4)]
    rows = [(i, "\n".join([edited(base[i % 4], i, i % 3), "short", "", text(500 + i, 12)])) for i in range(16)]
    return rows + [(20, base[0]), (21, f"{base[0]}\n{base[1]}"), (22, ""), (23, None), (None, base[0]), (24, "}\n}\n}"),
                   (25, text(600, 3)), (25, text(600, 3)), (26, base[2] + "\n" + base[2]), (27, text(601, 20_000))]


def test_lines_against_all_pairs(docs):
    rows = near_lines()
    found = {tuple(r) for r in line_classes(docs(rows, CLASHING)).collect()}
    wanted = line_groups(rows)
    assert found == wanted
    report = {r.doc_id: r for r in repeated_lines(docs(rows)).collect()}
    assert list(report[26].removed) == [0, 1] and report[24].n_removed == 0 and report[22].n_lines == 0


def test_lines_in_crowded_regions(docs):
    """Many versions of one line, of which the least and the greatest of a band are like few others."""
    rng, base, rows = random.Random(805), text(805, 14), []
    for i in range(24):
        line = list(base)
        for place in rng.sample(range(len(line)), rng.randint(0, 3)):
            line[place] = rng.choice("0123456789")
        rows.append((i, "".join(line)))
    assert {tuple(r) for r in line_classes(docs(rows)).collect()} == line_groups(rows)


def test_short_lines_of_the_pipeline(docs):
    """Equal lines of any length keep one copy, empty lines all stay."""
    import corpus_pipeline
    rows = [(1, "And so.\n\nThe end of it.\n}"), (2, "}\nAnd so.\n\nThe end of it."), (3, "And no.\nThe end of it.")]
    kept = corpus_pipeline.line_dedup(docs(rows).sparkSession, docs(rows), "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == [(1, rows[0][1], 25), (2, "", 0), (3, "And no.", 7)]


def test_documents_without_repeated_lines(docs):
    rows = near_lines()
    frame = docs(rows, CLASHING)
    kept = without_repeated_lines(frame)
    assert kept.columns == frame.columns
    gone = {(i, n) for i, n, a, b in line_groups(rows) if (i, n) != (a, b)}
    wanted = []
    for i, t in rows:
        parts = (t or "").split("\n")
        left = [x for n, x in enumerate(parts) if (i, n) not in gone]
        if left:
            wanted.append((i, t if len(left) == len(parts) else "\n".join(left)))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(wanted, key=str)
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)


def test_lines_of_texts_that_share_an_id(docs):
    rows = [(0, "S"), (1, "S\ntail one unique words"), (1, "COMPLETELY different unique content here\nsecond unique line zzz"), (2, "S\nS"), (2, "S\nS")]
    kept = without_repeated_lines(docs(rows, CLASHING), shortest=1)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "S"), (1, rows[2][1]), (1, "tail one unique words")]
    report = repeated_lines(docs(rows), shortest=1).collect()
    assert sorted((r.doc_id, list(r.removed), list(r.kept_in)) for r in report) == [(0, [], []), (1, [], []), (1, [0], [0]), (2, [0, 1], [0, 0]), (2, [0, 1], [0, 0])]


def test_a_text_of_very_many_lines(docs):
    """Time grows with the lines."""
    rows = [(1, "\n".join(["the same line again"] * 80_000 + ["the end"])), (2, "\n".join(f"line {i} of its own {i * i}" for i in range(3_000)))]
    start = time.time()
    kept = {r.doc_id: r.text for r in without_repeated_lines(docs(rows), shortest=1).collect()}
    assert kept[1] == "the same line again\nthe end" and time.time() - start < 120


def test_copies_of_one_row_are_not_squared(docs, monkeypatch):
    import forgetide.llm.regions as R
    folders, store = {}, R.store
    monkeypatch.setattr(R, "store", lambda df, folder, name: folders.setdefault(name, store(df, folder, name)))
    base = text(77)
    joined(docs([(1, base)] * 60 + [(2, edited(base, 1, 1))] * 60)).count()
    assert folders["home"].count() == 1


def test_sketches_exclude_no_linked_pair():
    """No more bits of two sketches differ than elements."""
    from forgetide.llm.regions import SKETCH, sketch
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 700, 9_000):
        values = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))
        for gone, more in ((0, 0), (1, 0), (0, 1), (n // 9, n // 7)):
            other = np.unique(np.concatenate([values[gone:], rng.integers(0, 1 << 63, more, np.uint64)]))
            differ = int(np.bitwise_count((sketch(values) ^ sketch(other)).view(np.uint64)).sum())
            assert len(sketch(values)) == SKETCH and differ <= len(np.setxor1d(values, other))


def test_near_copies_that_are_not_linked_are_not_paired(docs, monkeypatch):
    """Copies of one text that share some edits and have others of their own: near each other, but below the limit."""
    import forgetide.llm.regions as R
    measured, compare = [], R.store
    monkeypatch.setattr(R, "store", lambda df, folder, name: measured.append((name, compare(df, folder, name))) or measured[-1][1])
    base = text(5, 300)
    rows = [(i, edited(edited(base, 1, 6), 100 + i, 9)) for i in range(60)]
    found = joined(docs(rows), 3, (9, 10)).collect()
    assert sorted((tuple(r) for r in found), key=str) == jaccard_components(rows, 3, 9, 10)
    names = [name for name, _ in measured]
    assert "both" not in names  # no regions of common edits: here all copies would meet in each
    assert not any("added" in frame.columns for _, frame in measured)


def test_home_of_a_line_stores_numbers_only(docs, monkeypatch):
    """What a line adds to its home is as long as the line; no stored or shuffled frame holds it."""
    import forgetide.llm.op3_lines as L
    import forgetide.llm.regions as R
    folders, store = {}, R.store
    monkeypatch.setattr(R, "store", lambda df, folder, name: folders.setdefault(name, store(df, folder, name)))
    line = text(9, 60)
    frame = docs([(i, line + "\n" + edited(line, i, 2)) for i in range(4)])
    assert line_classes(frame).select("class_id", "class_line").distinct().count() == 1
    assert folders["home"].columns == ["x", "p", "common", "total"]
    lines = [line, "", "short", line + "\u00e9"]
    for one, (name, values) in zip(lines, L._described(lines), strict=True):
        (alone, same), = L._described([one])
        assert name == alone and values.tolist() == same.tolist()


def test_empty_tables(docs):
    none = docs([])
    for frame in (without_repeats(none), joined(none), one_of_each(none), repeated_lines(none), without_repeated_lines(none)):
        assert frame.count() == 0


def test_region_entries_are_dealt_once(spark):
    rows = [(1, 10), (1, 11), (1, 11), (2, 10), (3, 12), (3, 9), (4, 9)]
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "-1")
    try:
        found = region_members(spark.createDataFrame(rows, "key long, node long"))
        assert sorted((r.key, r.node, r.pivot) for r in found.collect()) == [(1, 10, 10), (1, 11, 10), (3, 9, 9), (3, 12, 9)]
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1, plan


def test_equal_sets_of_a_batch_give_their_keys_once():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text(1, 90)] * 2 + [text(2, 90)])], names=["id", "text"])
    (out,) = J._describe(3, (9, 10))(iter([batch]))
    assert out.column(2)[0] == out.column(2)[1]
    keys = out.column(3).to_pylist()
    (alone,) = J._describe(3, (9, 10))(iter([batch.slice(1)]))
    assert keys[0] and not keys[1] and [keys[0], keys[2]] == alone.column(3).to_pylist()


def test_equal_lines_of_a_batch_give_their_keys_once(monkeypatch):
    import forgetide.llm.op3_lines as L
    lines = [text(1, 12), "short", text(2, 12), text(1, 12), "x", "short", "", text(3, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(lines)], names=["id", "doc", "text"])
    whole = {}
    for chunk in (1 << 16, 10):  # a chunk of its own for every text
        monkeypatch.setattr(L, "CHUNK", chunk)
        found = [r for out in L._describe(1)(iter([batch])) for r in out.to_pylist()]
        assert [r["id"] for r in found] == [0, 1, 2, 3, 4, 5, 7] and found[0]["node"] == found[3]["node"]
        assert [len(r["keys"]) for r in found] == [L.BANDS] * 3 + [0, L.BANDS, 0, L.BANDS]
        whole[chunk] = found
    assert whole[10] == whole[1 << 16]


def test_stars_connect_what_links_connect(monkeypatch):
    import forgetide.llm.regions as R
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k + 1, k) for k in range(400, 460)] + [(500, 500)]

    def groups(edges):
        least = {x: x for x in range(600)}
        for _ in range(600):
            for x, p in edges:
                least[x] = least[p] = min(least[x], least[p])
        return least

    batches = [pa.RecordBatch.from_arrays([pa.array([e[i] for e in links[k:k + 50]]) for i in (0, 1)], names=["x", "p"]) for k in range(0, len(links), 50)]
    for room in (1 << 18, 40):
        monkeypatch.setattr(R, "ROOM", room)
        rays = [(r["x"], r["p"]) for out in R.stars(iter(batches)) for r in out.to_pylist()]
        assert groups(rays) == groups(links) and len(rays) <= len(links)
        assert room == 40 or all(p == groups(links)[x] for x, p in rays)


def test_rounds_are_few_jobs(docs):
    """A round labels regions in one step and joins components, not all links again: 87 jobs before on these rows."""
    rows = [(i, edited(text(i // 3, 40), i, 1 + i % 2) if i % 3 else text(i // 3, 40)) for i in range(60)]
    frame = docs(rows)
    context = frame.sparkSession.sparkContext
    context.setJobGroup("few-jobs", "few jobs")
    try:
        found = joined(frame).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((tuple(r) for r in found), key=str) == jaccard_components(rows, 3, 9, 10)
    assert jobs < 80


def test_jaccard_join_stores_little(docs, monkeypatch, tmp_path):
    """Neither keys nor hashes are stored, what sketches exclude is not measured, and of what was stored only the ids of copies stay."""
    import forgetide.llm.regions as R
    frames, held, store = {}, set(), R.store

    def seen(df, folder, name, **options):
        out = store(df, folder, name, **options)
        frames[name] = out.columns, out.count()
        held.update(bytes(r.elements).decode() for r in (out.collect() if "elements" in out.columns else []))
        return out

    monkeypatch.setattr(J, "scratch_path", lambda spark, name: str(tmp_path / name))
    for module in (J, R):
        monkeypatch.setattr(module, "store", seen)
    passage = text(9, 40)
    rows = [(i, f"{passage} {text(300 + i, 20)}") for i in range(30)] + [(50 + i, edited(text(8, 80), i, min(i, 1))) for i in range(4)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (61, rows[3][1])]  # equal texts, one of them twice under one id
    kept = one_of_each(docs(rows), 3, (9, 10))
    wanted = {i for i, _, c in jaccard_components(rows, 3, 9, 10) if i == c}
    assert {r.doc_id for r in kept.collect()} == wanted and 51 not in wanted
    assert not any("keys" in columns for columns, _ in frames.values())
    assert held and held <= {t for _, t in rows}
    assert 0 < frames["home"][1] < frames["around"][1]
    assert [p.name for p in (tmp_path / "jaccard-join").iterdir() if any(p.rglob("*.parquet")) and p.name != "home"] == ["gone"]


def test_parts_share_all_keys():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text(1, 90), text(2, 900)])], names=["id", "text"])
    (whole,) = J._describe(3, (9, 10))(iter([batch]))
    parts = [next(J._describe(3, (9, 10), part, 3)(iter([batch]))) for part in range(3)]
    for row, keys in enumerate(whole.column(3).to_pylist()):
        dealt = [part.column(3)[row].as_py() for part in parts]
        assert all(dealt) and sorted(sum(dealt, [])) == sorted(keys)


def test_characters_of_the_table_and_others():
    import forgetide.llm.op3_lines as L
    for line in ("", "plain", "café ÿ", "Ā wide \U0001f600"):
        characters = L._characters(line)
        for shift in (1, 7):
            assert L._spread(characters, shift).tolist() == L.mix((characters.astype(np.uint64) + np.uint64(shift)) * L.BASE).tolist()
