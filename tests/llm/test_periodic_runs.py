import random
import zlib

import duckdb
import numpy as np
from duopanel.llm import periodic_runs
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(w, least=24, turns=3):
    """Runs by comparing all words with all periods; a stretch counts for its smallest period."""
    n, out = len(w), []
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, turns * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def local(w, least=24, turns=3):
    """Marked tiles of one list of words, solved and stitched without Spark."""
    ids = np.unique(w, return_inverse=True)[1].astype("<i4") if w else np.zeros(0, "<i4")
    found = set()
    for lo, hi, step, _, cut in periodic_runs.marked(ids, np.array([0, len(w)]), least, turns):
        for c in cut.tolist():
            x, y = max(0, c - step), min(len(w), c + step + hi)
            found |= {(q, a + x, b + x) for q, a, b in periodic_runs.solve_tile(ids[x:y].tolist(), c - x, lo, hi, step, least, turns)}
    whole = []
    for q, a, b in sorted(found):
        if whole and whole[-1][0] == q and a <= whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], b)
        else:
            whole.append([q, a, b])
    return sorted([(a, b - a + q, q) for q, a, b in whole if b - a + q >= max(least, turns * q)], key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 200), st.integers(1, 3)), min_size=1, max_size=5), st.integers(0, 10**6))
def test_tiles_of_stitched_periods(parts, seed):
    rng, w = random.Random(seed), []
    for period, length, letters in parts:
        unit = [rng.choice("abc"[:letters]) for _ in range(period)]
        w += [unit[i % period] for i in range(length)]
    assert local(w) == brute(w)


def test_one_word_and_fibonacci():
    a, b = "a", "ab"
    while len(b) < 800:
        a, b = b, b + a
    for w in (["x"] * 700, list(b), ["x"] * 23, ["x"] * 24, (["a", "b"] * 200 + ["c"]) * 3, []):
        assert local(w) == brute(w)


def test_other_bounds():
    w = list("abcd" * 7 + "xyz" + "pqrstuvwxyabcdefghij" * 6)
    assert local(w, 30, 5) == brute(w, 30, 5)


def test_operator(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = {}
    for i in range(60):
        unit = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        texts[i] = " ".join([rng.choice(words) for _ in range(40)] + unit * rng.randrange(1, 9) + [rng.choice(words) for _ in range(9)])
    texts |= {60: None, 61: "", 62: " \t\n", 63: "é ß " * 30, 64: "long " * 30_000, 65: "a\x0bb\x0cc\rd\te " * 20}
    rows = [(i, t, "s", 1, 2, [3]) for i, t in texts.items()] + [(None, texts[0], "s", 1, 2, [3]), (7, texts[8], "s", 1, 2, [3]), (7, texts[7], "s", 1, 2, [3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start int, kind int, runs array<int>")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]

    def want(text):
        w = (text or "").encode().split()
        w = [x.decode() for x in w]
        runs = brute(w) if len(w) < 2000 else [(0, len(w), 1)]
        return tuple(runs), collapsed(w, runs)

    key = lambda x: (x[0] is not None, x[0] or 0, x[2], x[1])
    assert sorted([(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()], key=key) == sorted([(r[0], *want(r[1])) for r in rows], key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_text(spark):
    text = " ".join(f"w{i}" for i in range(57))
    docs = spark.createDataFrame([(i, text if i % 7 else None) for i in range(300)], "doc_id long, text string")
    hit = 0
    for r in docs.select("doc_id", "text", periodic_runs.planted(docs.doc_id, docs.text).alias("edited")).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        g, w = h // 10, (r.text or "").split()
        n = len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.edited.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            hit += 1
        else:
            assert r.edited == r.text
    assert hit > 10


def test_query_against_sql(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k * k) % 13}" for k in range(i % 90)), None) for i in range(200)] + [(500, None, "s"), (501, "x " * 100, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    order = sorted(got.columns)
    want = con.sql(f"select {', '.join(order)} from ({periodic_runs.SQL})").fetchall()
    assert sorted([tuple(r) for r in got.select(*order).collect()], key=str) == sorted(want, key=str)
