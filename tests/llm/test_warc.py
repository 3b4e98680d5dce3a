import gzip
import hashlib

from duopanel.llm import warc as W

PAGES = [
    (1, "http://www.A.org:80/x?y", "<p>" + "same " * 300),
    (2, "https://b.a.org/é x", "<p>" + "same " * 300),
    (3, None, None),
    (4, "not a url\r\nX: y", "short"),
    (5, "http://[::1", "short"),
    (6, "http://www.A.org/x?y", ""),
    (9, "http://www.A.org/x?y", "<p>" + "same " * 300),
    (9, "http://www.A.org/x?y", "<p>" + "same " * 300),
    (None, "http://c.d/", "<p>" + "same " * 300),
    (-7, "http://10.0.0.1:8080", "ü\r\n\r\n" * 400),
    (11, "http://long.org/", "long " * 400_000),
]


def want(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == p and k is not None]
        again = len(p) >= 1000 and same and i != max(same)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 3)
    key = lambda r: tuple(map(str, r))
    spark.createDataFrame([(*r, 1, "l") for r in PAGES], "page_id long, url string, html string, key int, last string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, W.query(spark, str(tmp_path)).collect()), key=key) == sorted(want(PAGES), key=key)
    monkeypatch.setattr(W, "PAGE", 2)
    assert sorted(map(tuple, W.query(spark, str(tmp_path)).collect()), key=key) == sorted(want(PAGES), key=key)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert W.query(spark, str(tmp_path)).count() == 0


def test_keys_and_lookup(spark, tmp_path):
    assert W.url_key("http://www.A.org:80/x?y") == "org,a,www)/x?y"
    assert W.url_key("https://a.org:8443") == "org,a:8443)/"
    pages = spark.createDataFrame([(i, f"http://h{i % 17}.org/{i}", f"page {i}") for i in range(500)], "page_id long, url string, html string")
    captures = W.write_archives(pages, str(tmp_path / "a"))
    directory = W.write_index(captures, str(tmp_path / "i"))
    asked = spark.createDataFrame([(W.line_key("http://h3.org/3", 3),), (W.line_key("http://none/", 3),)], "key string")
    got = W.look_up(asked, directory, str(tmp_path / "i")).collect()
    assert [r.page_id for r in got] == [3]
    r = got[0]
    data = (tmp_path / "a" / r.file).read_bytes()[r.offset : r.offset + r.length]
    assert W.parse(gzip.decompress(data))[2] == b"page 3"
