import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from duopanel.llm import toxicity as T


def made(n, seed=5):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 1
        w = [f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(r.randrange(20, 200))]
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(["vile", "Vile!", "scumx", "rotten"])
        docs.append((i, " ".join(w), "label", 1))
        if i % 3:
            labels.append((i, 0, int(toxic)))
    docs += [(n, None, "", 1), (n + 1, "", "", 1), (n + 2, "?? !!", "", 1), (None, "vile", "", 1), (1, docs[1][1], "", 1)]
    return docs, labels


def test_query(spark, tmp_path):
    docs, labels = made(900)
    spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: i % 4 == 1 for i in range(900)}
    wrong = sum(truth[r.doc_id] != r.predicted for r in got if r.held_out and r.doc_id in truth)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert wrong <= 0.05 * sum(r.held_out for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901, 902))
    again = {r.doc_id: r.score for r in T.query(spark, str(tmp_path)).collect()}
    assert all(np.isclose(again[r.doc_id], r.score) for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(r.score for r in T.scored(docs, T.fit(docs, labels)).collect()) < 1e-9
    assert T.scored(docs.limit(0), T.fit(docs, labels)).count() == 0


def test_evidence(spark):
    """Both levels of both models against Kneser-Ney's formulas, count by count."""
    r = random.Random(8)
    rows = [(" ".join(f"w{int(r.paretovariate(0.8)) % 40}" for _ in range(r.randrange(0, 60))), k % 2) for k in range(40)]
    model = T.Model(T.bigrams(spark.createDataFrame(rows, "text string, toxic int")))
    n, contexts, words = Counter(), Counter(), Counter()
    for text, c in rows:
        for h, w in zip(["", *text.split()], text.split()):
            n[c, h, w] += 1
    for c, h, w in n:
        contexts[c, w] += 1
        words[c] += 1
    shared = {w: math.log2(1 + contexts[0, w] + contexts[1, w]) for _, w in contexts}
    whole = sum(shared.values()) + 0.5 * (len(n) // 10)

    def probability(c, h, w):
        left = sum(min(contexts[c, x], T.DISCOUNT) for x in shared) / words[c]
        lower = max(contexts[c, w] - T.DISCOUNT, 0) / words[c] + left * shared.get(w, 0.5) / whole
        own = {x: m for (k, g, x), m in n.items() if (k, g) == (c, h)}
        if not own:
            return lower, lower
        total = sum(own.values())
        return lower, max(own.get(w, 0) - T.DISCOUNT_BIGRAM, 0) / total + sum(min(m, T.DISCOUNT_BIGRAM) for m in own.values()) / total * lower

    texts = [*(t for t, _ in rows[:6]), "w1 w2 new w1 new new", "w1", "", None, "w3 " * 5000]
    got, size = model.evidence(pa.array(texts))
    for k, text in enumerate(texts):
        own = (text or "").split()
        both = [[probability(c, h, w) for c in (0, 1)] for h, w in zip(["", *own], own)]
        assert size[k] == len(own)
        for level, column in ((0, 0), (1, 2)):
            want = sum(math.log(p[1][level] / p[0][level]) for p in both) / max(1, len(own))
            assert math.isclose(got[k, column], want, rel_tol=1e-4, abs_tol=1e-5), (k, level)


def test_ties_long_texts_and_clashes(spark):
    docs, labels = made(300)
    rows = [(*d[:2], 1.0, "x") for d in docs] + [(7000, "vile word " * 200_000, 2.0, "y"), (7001, "vile w1", 3.0, "z"), (7002, "vile w1", 3.0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, row string")
    model = T.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = T.scored(df, model).collect()
    assert len(got) == len(rows)
    by = {r.row.doc_id: r for r in got}
    assert by[7001].score == by[7002].score
    assert by[7000].row.score == 2.0 and 0 <= by[7000].score <= 1
    kept = T.reject(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.score < T.THRESHOLD for r in got)


def test_words():
    codes, first = T.word_codes(pa.array(["Ab, ab!", None, "", "É x"]))
    assert first.tolist() == [0, 2, 2, 2, 4]
    assert codes[0] == codes[1]
