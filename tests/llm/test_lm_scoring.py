import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from duopanel.llm import lm_scoring as L

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def brute_trie(texts):
    """Counts of (context, symbol) for each order, by a plain loop."""
    seen = [defaultdict(Counter) for _ in range(L.ORDER + 1)]
    for t in texts:
        data = b"\0" * L.ORDER + t + b"\0"
        for k in range(L.ORDER, len(data)):
            for o in range(L.ORDER + 1):
                seen[o][data[k - o : k]][data[k]] += 1
    return seen


def brute_score(seen, t):
    data, out = b"\0" * L.ORDER + t + b"\0", 0.0
    for k in range(L.ORDER, len(data)):
        out_of = set()
        for o in range(L.ORDER, -1, -1):
            c = seen[o].get(data[k - o : k])
            if not c:
                continue
            left = {s: n for s, n in c.items() if s not in out_of}
            if not left:
                continue
            total = sum(left.values())
            if data[k] in left:
                out += math.log10((left[data[k]] - 0.5) / total)
                break
            out += math.log10(0.5 * len(left) / total)
            out_of |= set(left)
        else:
            out -= math.log10(max(256 - len(out_of), 1))
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 2000)
    monkeypatch.setattr(L, "SHARD", 3000)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["The", "ümlaut", "cat", "sat.", "é", f"x{i}"]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\x01 zzz\nQQ"), (None, "cat"), (7, rows[7][1])]
    spark.createDataFrame([(*x, 1.0, "c") for x in rows], "doc_id long, text string, score double, block string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.query(spark, str(tmp_path)).collect()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = [lower(t) for i, t in rows if not out(i)]
    counts = Counter(w for t in train for w in [*WORD.findall(t), None])
    n, v = sum(counts.values()), len(counts)
    seen = brute_trie(train)
    want = []
    for i, t in rows:
        w = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((i, out(i), len(w), sum(counts[x] > 0 for x in w), n, base, brute_score(seen, lower(t))))
    key = lambda r: (str(r[0]), r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:])


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra"), (2, "abba ab")], "doc_id long, text string")
    trie, _ = L.train(docs)
    for context in (b"abrac", b"\0\0\0ab", b"zzzzz", b"zzzra"):
        g = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert math.isclose((10 ** trie.log10(g)).sum(), 1, rel_tol=1e-9)


def test_pruned_trie_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abracadabra"), (2, "abba ab")], "doc_id long, text string")
    monkeypatch.setattr(L, "MODEL_ROWS", 8)
    trie, _ = L.train(docs)
    g = np.array([int.from_bytes(b"abrac" + bytes([s]), "big") for s in range(256)])
    assert math.isclose((10 ** trie.log10(g)).sum(), 1, rel_tol=1e-9)
    assert L.score(docs.limit(0), L.F.lit(True)).count() == 0


def test_whole_model(spark, monkeypatch):
    """No count of grams leaves any of them out, in one shard or in many."""
    monkeypatch.setattr(L, "MODEL_ROWS", 8)
    monkeypatch.setattr(L, "BLOCK", 500)
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abcd é\n") for _ in range(r.randrange(0, 60)))) for i in range(80)]
    seen = brute_trie([lower(t) for i, t in rows if i % 3])
    for size, listed in ((10**6, 10**6), (300, 700)):
        monkeypatch.setattr(L, "SHARD", size)
        monkeypatch.setattr(L, "LISTED", listed, raising=False)
        got = L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), L.F.col("doc_id") % 3 != 0).collect()
        assert len(got) == len(rows)
        for g in got:
            assert math.isclose(g.score, brute_score(seen, lower(rows[g.doc_id][1])), rel_tol=1e-9)
