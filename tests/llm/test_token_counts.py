import pyarrow as pa
import pytest
from duopanel.llm import token_counts
from duopanel.llm.tokens import vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PLACES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", None, " ", "  a  b", "a\n\n b's it'll don't", "é  x　 y \nz", "<|endoftext|> x <|startoftext|>", "x<|endoftext|>y <|endoftext", "ä ö\tü", "日本 語 です。 1 234", "a" * 3000 + " " * 50, "\x1c x\x85 y \x00 z", "🙂 🙂 👩‍👩‍👧", "\r\n x\r\ny", "Σς ΑΣ ΑΣ. İ ı", "unbelievably discombobulated " * 3]


def counts(path, texts):
    """Tokens of some texts from one packed block."""
    _, ones, units, kinds, unit, n = token_counts.pack_block(path, pa.array(texts, pa.string()))
    pieces, at, out = [token_counts.splitter(path).pieces(x) for x in units], 0, []
    for k in range(len(texts)):
        out.append(int(ones[k]) + sum(pieces[u] * m for u, m in zip(unit[at : at + kinds[k]], n[at : at + kinds[k]])))
        at += kinds[k]
    return out


def plain(path, texts):
    return [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", PLACES)
def test_odd(name):
    assert counts(vocabulary(name), ODD) == plain(vocabulary(name), ODD)


@pytest.mark.parametrize("name", PLACES)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list(" \n\t\r'sabtvZé  　\x1c\x850.,-ß́日🙂<|>"))), max_size=4))
def test_random(name, texts):
    path = vocabulary(name)
    known = token_counts.splitter(path).tokenizer
    assert counts(path, texts) == [len(known.encode(t, add_special_tokens=False).ids) for t in texts]


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 2000)
    texts = ODD * 5 + [f"word{i} zyxwv{i % 17} the cat's {'hat ' * i}" for i in range(300)] + ["qwertz asdfg " * 20_000]
    rows = [(i if i % 50 else None, t, "s", 1, "u") for i, t in enumerate(texts)] + [(3, "other text", "s", 1, "u"), (3, "other text", "s", 1, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n int, unit string")
    path = vocabulary("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    want = [(r[0], len((r[1] or "").encode()), len(known.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    got = token_counts.count_tokens(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, None), (2, "a b"), (3, "x " * 1025), (4, "x" + " x" * 1023)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.query(spark, str(tmp_path)).collect()}
    known = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert got == {i: (len((t or "").encode()), n := len(known.encode(t or "").ids), n > 1024) for i, t in rows}
