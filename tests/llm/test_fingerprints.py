import hashlib
import random
import re
import struct

import xxhash
from duopanel.llm import fingerprints as P


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    """The hash of a row: texts by their bytes, bins as int (number, 4), values as long (number, 8)."""
    seed = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else struct.pack("<i" if x[1] == 4 else "<q", x[0])
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


def plain(text):
    """The fingerprint step by step: least value of each bin, empty bins filled from the bins that they try, digits."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return ""
    codes = [hashed(w) for w in words]
    least = {}
    for k in range(max(len(codes) - 4, 1)):
        h = hashed(*[(c, 8) for c in codes[k : k + 5]])
        # Bins in order of the signed number: bin 0 holds the lowest hashes.
        at = (h >> 56) + 128
        if h & P.LOW != P.LOW:
            least[at] = min(least.get(at, h), h)
    out = []
    for i in range(256):
        if i in least:
            v = least[i]
        else:
            x, found = (i * 2654435761 + 12345) % (1 << 32), None
            for _ in range(P.PROBES):
                x = (x * 1664525 + 1013904223) % (1 << 32)
                if found is None and x >> 24 in least:
                    found = least[x >> 24]
            if found is None:
                found = min((hashed((i, 4), (v >> 56, 8)), v) for v in least.values())[1]
            v = hashed((found, 8), (i, 4))
        out.append("0123456789abcdef"[v & 15])
    return "".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "ROWS_TOGETHER", 7)
    r = random.Random(3)
    rows = [(k * k, " ".join(f"Wört{r.randrange(3000)}" for _ in range(r.choice([0, 1, 4, 5, 30, 400])))) for k in range(120)]
    rows += [(20000, None), (20001, " \n "), (20002, rows[5][1]), (20003, "a b c d e f"), (20004, "日本語🙂x")]
    base = " ".join(f"w{r.randrange(9999)}" for _ in range(600))
    rows += [(30000 + k, base + " " + "z " * 0 + " ".join(f"q{r.randrange(9999)}" for _ in range(k * 100))) for k in range(5)]
    spark.createDataFrame([(*x, 5, "c") for x in rows], "doc_id long, text string, n_chars int, edited string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in P.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    far, by_text = [], {}
    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (plain(text), plain(edited))
        assert abs(x.near_edited - plain_likeness(plain(text), plain(edited))) + abs(x.near_next - plain_likeness(plain(text), plain(nxt))) < 1e-12
        far += [abs(x.near_edited - jaccard(text, edited)), abs(x.near_next - jaccard(text, nxt))]
        by_text.setdefault(frozenset(shingles(text)), set()).add(x.fingerprint)
        assert len(x.fingerprint) == (256 if shingles(text) else 0)
    assert all(len(v) == 1 for v in by_text.values())
    assert max(far) < 0.2 and sum(far) / len(far) < 0.02


def test_ties_nulls_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert P.query(spark, str(tmp_path / "e")).count() == 0
    spark.createDataFrame([(None, "x y"), (1, "b"), (1, "b"), (1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "t/documents.parquet"))
    got = sorted(P.query(spark, str(tmp_path / "t")).collect(), key=str)
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("b", "b", "a", "x " + "a"))
    assert sorted(x.edited_sha256 for x in got) == want
    spark.createDataFrame([(7, "one two three four five six")], "doc_id long, text string").write.parquet(str(tmp_path / "o/documents.parquet"))
    assert P.query(spark, str(tmp_path / "o")).first().near_next == 1.0
