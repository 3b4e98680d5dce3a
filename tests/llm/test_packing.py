import zlib
from collections import defaultdict

import numpy as np
from duopanel.llm import packing as P
from duopanel.llm.tokens import vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_rounds(counts):
    plan = P.match_rounds(counts, 64)
    fill, gaps = defaultdict(int), defaultdict(int)
    for length, a, b, first, offset in plan:
        for k in range(b - a):
            assert fill[first + k] == offset
            fill[first + k] += length
    assert all(v <= 64 for v in fill.values())
    done = defaultdict(list)
    for length, a, b, _, _ in plan:
        done[length] += range(a, b)
    assert {k: sorted(v) for k, v in done.items()} == {k: list(range(n)) for k, n in counts.items()}
    # Plain best fit, one piece at a time, opens as many.
    bins: list[int] = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k, g in enumerate(bins) if g >= length]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= length
        else:
            bins.append(64 - length)
    assert len(fill) <= len(bins) + 2


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 40)
    rows = [(i, None if i % 40 == 0 else f"some text {i} " * (i % 90)) for i in range(400)] + [(400, "long one " * 20000), (5, "again"), (5, "again"), (None, "x")]
    spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, length int, offset string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.query(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i or -1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = check_places(got, 1024)
    assert n <= 1.03 * sum(w[3] for w in want) / 1024 + 2


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).count() == 0
