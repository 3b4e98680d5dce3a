import zlib

import numpy as np
from duopanel.llm import token_files as T
from duopanel.llm.tokens import vocabulary
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_pack(values):
    control, data = T.pack(np.array(values, np.uint32))
    assert T.unpack(control, data, len(values)).tolist() == values


def brute(rows):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 9000)
    rows = [(i * 7 % 501, None if i % 50 == 0 else "" if i % 51 == 0 else f"the word{i} of Ünïcode " * (i % 9)) for i in range(501)] + [(9999, "long text " * 30000), (8888, "junk <|endoftext|> line")]
    spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, start string, n_tokens int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.query(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_repeated_null_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    manifest, order, folder = T.write_tokens(empty, vocabulary("word_bpe_49k.json"), 1)
    assert T.read_files(manifest, order, folder).count() == 0
    twice = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b c"), (2, "d")], "doc_id long, text string")
    got = sorted(T.read_files(*T.write_tokens(twice, vocabulary("word_bpe_49k.json"), 1)).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (2, 2, 2), (2, 4, 3), (2, 7, 3)]
