"""Mixing against a plain version and its rules."""

import re

from folioflow.llm import mixing

ROWS = [
    (1, "a b c", "s1"), (2, None, "s1"), (3, "", None), (4, "x " * 300, None), (5, "one", "tiny"), (6, "q " * 5000, "s2"), (7, "y\tz\nw", "s2"), (7, "y\tz\nw", "s2"),
    (None, "no id here", "s1"), (8, "w " * 40, "s1"), (9, None, "void"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, sid string, size int").repartition(3)


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, capped, out = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            capped.add(s)
            left -= out[s]


def test_targets_and_taken(spark):
    rows = ROWS + [(100 + i, "w " * (i % 37), f"s{i % 5}") for i in range(400)]
    got = mixing.taken_words(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    want = targets(sums)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    taken = {}
    source_of = {(i, size(t)): s for i, t, s in rows}
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2), s
    again = mixing.taken_words(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(300)]
    _, mixture = mixing.mix(frame(spark, rows))
    slots = mixture.select("slot", "sid").distinct().orderBy("slot").collect()
    for part in range(1, 5):
        some = [r.sid for r in slots[: len(slots) * part // 4]]
        for sid, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
            assert abs(some.count(sid) / len(some) - share) < 0.02


def test_mixed_documents_hold_the_taken_words(spark):
    rows = ROWS + [(100 + i, "w%d " % i * (i % 37), f"s{i % 5}") for i in range(200)]
    df = frame(spark, rows)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, want = {}, {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    for r in mixing.taken_words(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in want.items() if v} == got


def test_mixed_documents_of_awkward_tables(spark, tmp_path):
    """Repeated ids and rows, ids that are null, and columns named like the operator's own; from files and not; the same on every run."""
    rows = [(i % 7 if i % 3 else None, f"a{i} b{i} c{i} d{i}"[: 3 * (i % 5)] or None, f"s{i % 2}", i, "x", i, {"k": i}) for i in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key0 int, row_file string, words int, m map<string,int>")
    df.repartition(3).write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    plain = lambda t: sorted((str(r.doc_id), r.text, r.source, r.key0, r.row_file, r.words, str(r.m)) for r in t.collect())
    first = plain(mixing.mixed_documents(table))
    assert first == plain(mixing.mixed_documents(table)) and mixing.mixed_documents(table).columns == df.columns
    of = {r[3]: r[1] for r in rows}
    assert all(r[1] and set(r[1].split()) <= set(of[r[3]].split()) and r[3] == r[5] for r in first)
    taken = sum(r.taken for r in mixing.taken_words(table).collect())
    assert sum(len(r[1].split()) for r in first) == taken == sum(len(r[1].split()) for r in plain(mixing.mixed_documents(df)))
    assert mixing.mixed_documents(table.where("false")).count() == 0


def test_empty(spark):
    assert mixing.taken_words(frame(spark, [(1, "a", "b")]).where("false")).count() == 0
    got = mixing.taken_words(frame(spark, [(1, None, None), (2, "", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
