import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from duopanel.llm import components as C
from duopanel.llm import jaccard_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda k: k if label[k] == k else find(label[k])
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                label[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = lambda k: min((i for i in groups[find(k)] if i is not None), default=None) if sets[k] else rows[k][0]
    return sorted(((rows[k][0], len(sets[k]), least(k)) for k in range(len(rows))), key=str)


def made():
    r = random.Random(8)
    word = lambda: f"W{r.randrange(4000)}"
    rows = []
    for f in range(6):  # families: copies with edits of growing size, chains, hot lines
        base = [word() for _ in range(r.choice([6, 20, 80, 200]))]
        for k in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = word()
            rows.append(w)
            if k % 3 == 0:
                base = w
    line = [f"hot{k}" for k in range(12)]
    rows += [[*line, *(word() for _ in range(r.randrange(1, 8)))] for _ in range(80)]
    rows += [[word() for _ in range(r.randrange(0, 60))] for _ in range(60)] + [["a"], ["A"], ["a", "b"], line, line]
    rows = [(k * 3, " ".join(w)) for k, w in enumerate(rows)]
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (None, rows[0][1]), (None, "lonely one here now then"), (3, rows[1][1]), (9004, "long " * 5 + "x " * 30000)]


@pytest.mark.parametrize("tile", [4096, 7])
def test_query(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "FANOUT", 4 if tile < 100 else 32)
    monkeypatch.setattr(J, "SHARD", 300)
    rows = made()
    spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n long, node string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, J.query(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_keep_one_and_empty(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in J.keep_one(docs).collect()]
    want = {i for i, n, c in brute(rows) if i is not None and (i == c or n == 0)}
    assert sorted({i for i in kept if i is not None}) == sorted(want)
    assert kept.count(None) == 1  # the other one is a copy
    assert J.similar(docs.limit(0)).count() == 0


def test_keep_one_same_ids(spark):
    """Rows of one id: different texts are documents of their own, equal ones are one; other columns may have any names."""
    rows = [(7, "one two three four five six", 1), (7, "completely other words that nobody else has", 2), (7, "one two three four five six", 3), (8, "one two three four five six", 4), (9, None, 5), (9, "", 6), (9, " ", 7), (None, "a b c d e f", 8), (None, "a b c d e f", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int").withColumn("mark", F.lit("m")).withColumn("d", F.lit(1)).withColumn("empty", F.lit(True))
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.component for r in kept.collect()]
    assert sum(x in got for x in (1, 3)) == 1 and sum(x in got for x in (8, 9)) == 1
    assert sorted(x for x in got if x not in (1, 3, 8, 9)) == [2, 5, 6, 7]
    assert J.keep_one(docs.limit(0)).count() == 0


def test_regular_words(spark):
    """Two words whose sums of powers are equal are not linked."""
    morse = ["".join("ab"[(bin(k).count("1") + x) % 2] for k in range(1024)) for x in (0, 1)]
    got = J.similar(spark.createDataFrame([(1, morse[0]), (2, morse[1]), (3, morse[1])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 2)]


def test_rows_of_tiles_and_shards(spark, monkeypatch):
    """Near copies and passages in texts of other sizes: more shards do not repeat the tiles that no pair needs."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for _ in range(40):
        own = [word() for _ in range(400)]
        rows += [own, [*own[:-3], *(word() for _ in range(3))]]
        passage = [word() for _ in range(100)]
        rows += [[*(word() for _ in range(r.randrange(100, 200) * k)), *passage] for k in (1, 4)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    order = np.ceil(np.log2(J.sketch(docs) + 1)).astype(np.int64)
    monkeypatch.setattr(type(docs), "distinct", lambda table: table)
    few, many = (J.shared_prefixes(J.describe(docs, order, k).where("shard >= 0").select("shard", "data")).collect() for k in (1, 64))
    assert len(set(few)) == len(few) and set(few) == set(many)
    assert {x.tile for x in few} and len(many) <= 4 * len(few)
    monkeypatch.undo()
    assert {(x.doc_id, x.component_id) for x in J.similar(docs).collect()} == {(k, k - (k % 4 == 1)) for k in range(len(rows))}


def test_threshold(spark, monkeypatch):
    """Sets of exactly 0.8, of equal and of different sizes, and just below: whatever the order of the shingles, the links stay."""
    monkeypatch.setattr(J, "SHARD", 300)
    rows = []
    for m in range(1, 30):
        w = [f"{m}x{k}" for k in range(10 * m + 5)]
        rows += [w[: 9 * m + 4], w[m : 10 * m + 4]]  # 8 m of 10 m
        w = [f"{m}y{k}" for k in range(5 * m + 5)]
        rows += [w[: 5 * m + 4], w[: 4 * m + 4]]  # 4 m of 5 m
        w = [f"{m}z{k}" for k in range(5 * m + 5)]
        rows += [w, w[: 4 * m + 4]]  # 4 m of 5 m + 1
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    assert sorted(map(tuple, J.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_partnered():
    r = np.random.default_rng(0)
    for _ in range(500):
        sizes = r.integers(1, 9, r.integers(1, 8))
        first = np.cumsum(sizes) - sizes
        n = r.integers(1, r.choice([4, 20, 300]), sizes.sum())
        rest = n - (r.random(len(n)) * (n // 5 + 1)).astype(int)
        run = np.repeat(np.arange(len(sizes)), sizes)
        pair = (run[:, None] == run) & ~np.eye(len(n), dtype=bool) & (9 * np.minimum(rest[:, None], rest) >= 4 * (n[:, None] + n))
        assert (J.partnered(first, n, rest) == pair.any(axis=1)).all()
    assert not len(J.partnered(*[np.zeros(0, np.int64)] * 3))


def test_tree():
    r = np.random.default_rng(1)
    points = r.poisson(3, (500, J.GROUPS))
    points[100:200] = points[:100] + r.poisson(0.1, (100, J.GROUPS))
    sizes = points.sum(axis=1)
    tree = J.CountTree(sizes, points)
    got = {(int(u), int(v)) for q, p in tree.search(sizes, points, 300) for u, v in zip(q, p)}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(int(u), int(v)) for u, v in zip(*np.nonzero(9 * bound >= 4 * (sizes[:, None] + sizes)))}
    assert got == want


def test_components(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.node: x.component for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links for x in p}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == label[x] for x in label)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
