import hashlib
import random

import numpy as np
import pytest
from duopanel.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    order = sorted({(S.LAST if i is None else i, t or "") for i, t in rows})
    for i, t in order:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            x = data[p : p + length]
            if x in seen:
                gone[p : p + length] = True
            seen.add(x)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, t] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh éß\n") for _ in range(n))
    shared = [text(150), text(400), text(101), text(99), "ab" * 80]
    rows = []
    for k in range(90):
        t = "".join(r.choice([text(r.randrange(0, 200)), r.choice(shared)[r.randrange(0, 20) :]]) for _ in range(r.randrange(0, 6)))
        rows.append((k * 5 % 91, t))
    rows += [(200, rows[0][1]), (201, rows[3][1] * 3), (202, None), (203, ""), (204, "z" * 5000), (205, "xy" * 700 + "z" * 300), (5, "q" * 120), (None, shared[1]), (206, text(30000))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(S, "BATCH", 64)
    monkeypatch.setattr(S, "SHARD", 10000)
    monkeypatch.setattr(S, "CHUNK", [700, 1 << 22][seed - 1])
    monkeypatch.setattr(S, "BITS", 16)
    rows = [r for r in made(seed) if r[0] != 5 or r[1] == "q" * 120]
    spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n_bytes long, mark string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows, 100)
    got = S.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {(S.LAST if i is None else i): w for (i, _), w in want.items()}
    for g in got:
        assert tuple(g)[1:] == by_id[S.LAST if g.doc_id is None else g.doc_id], g.doc_id


def test_family():
    r = np.random.default_rng(3)
    family, seen = S.Family(4), set()
    for _ in range(40):
        batch = r.integers(0, 3, (50, 4)).astype(np.uint8)
        want = []
        for x in map(bytes, batch):
            want.append(x in seen)
            seen.add(x)
        assert family.add(batch).tolist() == want
        assert all(len(a) >= len(b) for a, b in zip(family.levels, family.levels[1:]))
    assert sum(map(len, family.levels)) == len(seen)


def test_texts_repeated_rows_empty(spark):
    p = "wörter " * 3 + "".join(chr(0x4E00 + k) for k in range(60))
    docs = spark.createDataFrame([(1, "x" + p + "y", "en"), (2, "é" + p + "ü", None), (2, "é" + p + "ü", None)], "doc_id long, text string, lang string")
    out = sorted(map(tuple, S.deduplicate(docs).collect()), key=str)
    assert out == [(1, "x" + p + "y", "en"), (2, "éü", None), (2, "éü", None)]
    assert S.digests(docs.limit(0)).count() == 0


def test_period_of_the_grams_of_a_string(spark, monkeypatch):
    monkeypatch.setattr(S, "BITS", 16)
    r = random.Random(9)
    line = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(S.LENGTH - S.GRAM)) + "\n"
    rows = [(1, line * 3), (2, "other text")]
    want = brute(rows, S.LENGTH)
    assert want[1, rows[0][1]][1] > 0
    got = S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(g.doc_id, dict(rows)[g.doc_id]): tuple(g)[1:] for g in got} == want


def test_repeated_rows_of_one_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BITS", 16)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(1, text(300)), (1, None), (2, text(150) * 2), (None, text(200))]
    rows = [*rows, *rows, (3, rows[0][1]), (None, rows[3][1])]
    want = brute(rows, S.LENGTH)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((g.doc_id or -1, *tuple(g)[1:]) for g in S.digests(docs).collect())
    assert got == sorted((-1 if i is None else i, *want[S.LAST if i is None else i, t or ""]) for i, t in rows)


def test_regular_texts_and_clashes(spark):
    """Passages that collide under sums of powers are no repeats; columns of any name stay."""
    morse = ["".join("ab"[(bin(k).count("1") + x) % 2] for k in range(2048)) for x in (0, 1)]
    rows = [(1, f"{morse[0]} one"), (2, f"{morse[1]} two"), (3, morse[1])]
    docs = spark.createDataFrame([(*x, "d", "r", 1) for x in rows], "doc_id long, text string, doc string, runs string, row int").coalesce(1)
    want = brute(rows, 100)
    assert {(g.doc_id, g.n_removed) for g in S.digests(docs).collect()} == {(i, w[1]) for (i, _), w in want.items()}
    out = S.deduplicate(docs)
    assert out.columns == docs.columns
    assert all((r.doc, r.runs, r.row) == ("d", "r", 1) and len(r.text) == want[r.doc_id, dict(rows)[r.doc_id]][0] - want[r.doc_id, dict(rows)[r.doc_id]][1] for r in out.collect())
    assert S.deduplicate(docs.limit(0)).count() == 0
