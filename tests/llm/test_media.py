import hashlib
import io
import zlib

import numpy as np
import pytest
from duopanel.llm import media

ROWS = [(1, ""), (2, None), (3, "abc"), (3, "abc"), (4, "ü" * 500), (5, "x" * 192), (6, "word " * 20000)]


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_round_trip_and_features(spark, form):
    df = spark.createDataFrame([(i, t, "clash", 1, b"p") for i, t in ROWS], "doc_id long, text string, media string, n_bytes int, payload binary")
    got = media.decode_column(media.encode_column(df, form=form)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r.row.row)[2:] == ("clash", 1, b"p")
        raw = (r.row.row.text or "").encode()
        assert r.row.n_bytes == len(raw)
        assert r.payload == raw + b" " * (-len(raw) % 192 if raw else 192)
        grey = np.frombuffer(r.payload, np.uint8).reshape(-1, 64, 3).mean(axis=2)
        tile = np.load(io.BytesIO(r.tile))
        fine = np.repeat(np.repeat(grey, 8, axis=0), 9, axis=1)  # brute force: every pixel cut into 8 x 9 parts
        want = fine.reshape(8, grey.shape[0], 9, 64).mean(axis=(1, 3))
        assert np.allclose(tile, want, rtol=1e-6)
        assert r.dhash == np.packbits(media.area_resize(np.frombuffer(r.payload, np.uint8).reshape(-1, 64, 3), media.TILE)[:, 1:] > media.area_resize(np.frombuffer(r.payload, np.uint8).reshape(-1, 64, 3), media.TILE)[:, :-1]).tobytes().hex()


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.query(spark, str(tmp_path)).collect()
    for r in got:
        text = dict(ROWS)[r.doc_id] or ""
        raw = text.encode() + b" " * (-len(text.encode()) % 192 if text else 192)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert len({r.feature for r in got if r.doc_id == 3}) == 1


def test_other_netpbm():
    assert (media.decode(b"P5 # note\n2 1 255\n\x01\x02") == [[1, 2]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF8")


def test_null_image(spark):
    r = media.decode_column(spark.createDataFrame([(None, 1)], "media binary, row int")).first()
    assert (r.payload, r.tile, r.dhash, r.row.row) == (None, None, None, 1)


def test_empty_table(spark):
    assert media.decode_column(media.encode_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
