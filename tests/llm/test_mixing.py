import math

from duopanel.llm import mixing
from duopanel.llm.common import written


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left, rest = total - sum(done.values()), [s for s in names if s not in done]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "é": 0, None: 70, "Z": 5, "z": 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 50)) if i % 11 else None, "hot" if i % 3 else f"s{i % 7}", 9) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    first = sorted(out.select("doc_id").collect())
    assert first == sorted(mixing.mix(docs.repartition(7)).select("doc_id").collect())
    taken = {r[0]: r[1] for r in out.groupBy("source").agg({"doc_id": "count"}).collect()}
    sized = docs.select("source", mixing.n_words().alias("size"))
    for r in mixing.source_targets(sized).collect():
        n = sum(1 for x in rows if x[2] == r.source)
        assert abs(taken[r.source] - n * r.target / r.source_size) < 5 * math.sqrt(n)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b", None), (1, "a b", None)], "doc_id long, text string, source string")
    assert mixing.mix(twice).count() == 2
    assert written(twice, "t").count() == 2


def test_null_ids_and_clashes(spark):
    rows = [(None, "a b c", "s", 5, 6, 7, "w"), (None, None, "t", 5, 6, 7, "w"), (1, "a " * 50_000, "s", 5, 6, 7, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int, target int, row int, weight string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert all((r.rate, r.target, r.row, r.weight) == (5, 6, 7, "w") for r in out.collect())
    found = {r.row.text: r.copies for r in mixing.with_copies(docs.withColumn("n", mixing.n_words()), "n").collect()}
    assert found[None] == 0 and set(found) == {x[1] for x in rows}
