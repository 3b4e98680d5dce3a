import pyarrow as pa
import pytest
from duopanel.llm import tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PLACES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", None, " ", "  a  b", "a\n\n b's it'll", "é  x　 y \nz", "<|endoftext|> x <|startoftext|>", "ä ö\tü", "é ö ́x", "日本 語 です。 1 234", "a" * 3000 + " " * 50, "\x1c x\x85 y \x00 z", "🙂 🙂 👩‍👩‍👧", "\r\n x\r\ny", "Σς ΑΣ ΑΣ. İ ı"]


@pytest.mark.parametrize("name", PLACES)
def test_odd(name):
    memory = tokens.WordMemory(tokens.vocabulary(name))
    for _ in range(2):
        ids, at = memory.encode(pa.array(ODD))
        for k, text in enumerate(ODD):
            assert ids[at[k] : at[k + 1]].tolist() == memory.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", PLACES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list(" \n\t\r'sabZé  　\x1c\x850.,-ß́日🙂"))), max_size=5))
def test_random(name, texts):
    memory = tokens.memory(tokens.vocabulary(name))
    ids, at = memory.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    memory = tokens.WordMemory(tokens.vocabulary(PLACES[0]))
    for text in ("one two three", "four five six seven", "one two"):
        ids, _ = memory.encode(pa.array([text]))
        assert ids.tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", PLACES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "a", "junk", "é", "\u3000", "'s", "."])).map("".join), max_size=5))
def test_added_tokens(name, texts):
    """Ids are those of the library as it comes, which knows the added tokens in a text."""
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    texts = ["junk <|endoftext|> line", *texts]
    ids, at = tokens.memory(tokens.vocabulary(name)).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def morse(bit):
    return "".join("ab"[(bin(k).count("1") + bit) % 2] for k in range(1024))


@pytest.mark.parametrize("name", PLACES)
def test_words_of_a_regular_shape(name):
    """Words that collide under sums of powers, and hits that are not what the memory holds."""
    plain, memory = Tokenizer.from_file(tokens.vocabulary(name)), tokens.WordMemory(tokens.vocabulary(name))
    for texts in ([morse(0), morse(1)], [f"x {morse(1)} {morse(0)}"]):
        ids, at = memory.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    memory.encode(pa.array(["some other words"]))
    memory.text[:] = 0  # every hit now fails its comparison
    ids, _ = memory.encode(pa.array(["some other words"]))
    assert ids.tolist() == plain.encode("some other words", add_special_tokens=False).ids


def test_keeps_frequent_parts(monkeypatch):
    memory = tokens.WordMemory(tokens.vocabulary(PLACES[0]))
    monkeypatch.setattr(tokens, "MEMORY", 60)
    for k in range(30):
        text = "often met. " * 3 + f"once{k} and{k} never{k}"
        ids, _ = memory.encode(pa.array([text]))
        assert ids.tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids
    assert 0 < len(memory.keys) <= 60
