import corpus_pipeline as P
import pyarrow as pa
from duopanel.llm import toxicity

from . import test_jaccard_join, test_suffix_dedup
from .test_packing import check_places
from .test_toxicity import made

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string"


def test_stages(spark, tmp_path):
    """Each stage against a plain version of its own: formulas, all pairs, all strings, sums by source, places."""
    docs, labels = made(300)
    passage = " ".join(f"shared{k}" for k in range(40))
    rows = [(i, f"{t} {passage}" if i in (10, 22) else t, "en", f"s{(i or 0) % 4}", len(t or ""), 0.5, "x") for i, t, *_ in docs]
    rows += [(5000 + k, rows[8][1] + " tail" * (k > 0), "en", "s1", 7, 0.5, "x") for k in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    truth = {i for i in range(300) if i % 4 == 1}
    for name, stage in P.STAGES:
        out = stage(spark, current, str(tmp_path))
        if name != "packing":
            assert out.columns == current.columns
        rows_in, rows_out = current.collect(), out.collect()
        if name == "toxicity":
            left = {r.doc_id for r in rows_out}
            gone = {r.doc_id for r in rows_in} - left
            assert len(truth - gone) <= 0.1 * len(truth)
            assert len(gone - truth - {None}) <= 0.05 * len(rows_in)
            assert {r.doc_id for r in rows_in if not toxicity_words(r.text)} <= left
        if name == "jaccard":
            want = test_jaccard_join.brute([(r.doc_id, r.text) for r in rows_in])
            kept = {i for i, n, c in want if i is not None and (i == c or n == 0)}
            assert {r.doc_id for r in rows_out if r.doc_id is not None} == kept
        if name == "suffix":
            want = test_suffix_dedup.brute([(r.doc_id, r.text) for r in rows_in], 100)
            sizes = {i: w[0] - w[1] for (i, _), w in want.items()}
            assert all(len(r.text.encode()) == sizes[r.doc_id] for r in rows_out if r.doc_id is not None)
            assert all(r.n_chars == len(r.text) for r in rows_out)
            assert sum(passage in r.text for r in rows_out) <= 1
        if name == "mixing":
            assert {(r.doc_id, r.text) for r in rows_out} <= {(r.doc_id, r.text) for r in rows_in}
            assert max(sum(r.doc_id == x.doc_id for r in rows_out) for x in rows_in) <= 3
        if name == "packing":
            check_places(rows_out, 1024)
        path = str(tmp_path / f"out-{name}")
        out.write.parquet(path)
        current = spark.read.parquet(path)
    assert current.count() > 0
    assert P.run(spark, str(tmp_path)).count() == current.count()


def toxicity_words(text):
    return toxicity.word_codes(pa.array([text], pa.string()))[1][-1]


def test_empty_and_null_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(None, None, None, None, None, None, None)] * 2)):
        path = tmp_path / str(k)
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        assert P.run(spark, str(path)).count() == 0  # a source without words is not taken
