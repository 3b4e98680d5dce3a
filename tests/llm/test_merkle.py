import hashlib
import random
import zlib

import duckdb
import pytest
from duopanel.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = ""
    for value in row:
        text = None if value is None else str(value)
        out += "-" if text is None else f"{len(text.encode())}:{text}"
    return h([out])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        lo = i - i % 3
        out.append((level[lo:i], level[i + 1 : lo + 3]))
        i //= 3
    return out


def plain(rows):
    """Everything of every row, from lists of all levels."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            edit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            x = leaf([*r[:4], r[4].replace("\n", "")]) if edit else leaf(r)
            for a, b in steps:
                x = h([*a, x, *b])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h([d for a, b in steps for d in [*a, *b]]), x, x == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, rng):
    texts = [None, "", "a\nb", "é\n\n", "long " * 20_000]
    out = [(i, rng.choice(["hot"] * 5 + ["é", "Z", "z", None, "one\nline"]), rng.choice(["en", None]), rng.choice([None, -3, 17]), rng.choice(texts) if i % 9 == 0 else f"t{i}\nx") for i in range(n)]
    return out + [out[3], out[3], (None, "hot", None, None, "x"), (None, None, None, None, None), (4, "hot", "en", 1, "other"), (900, "single", "en", 1, "x\ny")]


@pytest.mark.parametrize("height", range(7))
def test_layout(height):
    at = [a for level in merkle.veb(height) for a in level.tolist()]
    assert sorted(at) == list(range((3 ** (height + 1) - 1) // 2))
    if height == 3:  # the root and its children, then each lower subtree in one stretch
        assert sorted(merkle.veb(3)[1].tolist()) == [1, 2, 3]
        assert merkle.veb(3)[2].tolist() == list(range(4, 40, 4)) and merkle.veb(3)[3].tolist() == [x + k for x in range(4, 40, 4) for k in (1, 2, 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 81])
def test_block(n):
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    tree = levels([x.hex() for x in leaves])
    height = len(tree) - 1
    nodes, root = merkle.build(leaves, height)
    assert root.hex() == tree[-1][0]
    for i in range(n):
        got = merkle.siblings(nodes, n, height, i)
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in got] == path(tree, i)
        packed = merkle.pack(got)
        assert merkle.fold(leaves[i], packed) == root
        assert n == 1 or merkle.fold(leaves[i - 1], packed) != root


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "SIZE", 9)
    rows = rows_of(300, random.Random(1))
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, tree string, block int")
    got = merkle.verified(merkle.manifest_of(docs.repartition(5)))
    text = lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else x
    assert sorted([tuple(text(x) for x in r) for r in got.collect()], key=str) == plain(rows)
    assert merkle.verified(merkle.manifest_of(docs.limit(0))).count() == 0


def test_query_against_sql(spark, tmp_path):
    rows = rows_of(290, random.Random(2))
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"select {', '.join(names)} from ({merkle.SQL})").fetchall(), key=str) == plain(rows)
