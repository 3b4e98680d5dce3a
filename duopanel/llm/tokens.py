"""Exact tokenization of whole texts with a memory of the words already met.

A text is cut before each ASCII blank, tab or line feed that follows a character that is no white space, and between an ASCII letter and a mark;
neither vocabulary has a pre-token over such a cut, so that the ids of the parts, put together, are the
ids of the text; added tokens hold no white space and take none beside them. Each distinct part is encoded once by the tokenizers library and then looked up by its
64-bit hash and compared, which makes long corpora of recurring words several times cheaper.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import ragged, same_spans, span_hashes, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that a worker keeps in memory (about 60 bytes each); beyond, it forgets those met once, or all.
MEMORY = 1_000_000
_known: dict[str, WordMemory] = {}


#: Marks before which a text is cut if an ASCII letter stands before them: runs of letters end there in both vocabularies, and no added token holds them.
MARK = np.zeros(256, bool)
MARK[list(b".,!?;:%*")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of all rows, in order."""
    blank = (buf == 0x20) | (buf == 0x0A) | (buf == 0x09)
    before = np.zeros(len(buf), np.uint8)
    before[1:] = buf[:-1]
    cut = blank & (before > 0x20) & (before < 0x7F)
    # After a longer character: those that may be white space begin with C2, E1, E2 or E3.
    wide = np.flatnonzero(blank & (before >= 0x80))
    second = buf[np.maximum(wide - 2, 0)]
    third = buf[np.maximum(wide - 3, 0)]
    cut[wide[(second != 0xC2) & (third != 0xE1) & (third != 0xE2) & (third != 0xE3)]] = True
    cut |= MARK[buf] & LETTER[before]
    filled = offs[:-1][offs[:-1] < offs[1:]]
    cut[filled] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf))


class WordMemory:
    """Ids of parts by hash, with their bytes, as arrays; one for each vocabulary in a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int64)  # of each key: place and number of its ids, place and number of its bytes
        self.n = np.zeros(0, np.int64)
        self.text_at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # how often
        self.ids = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)

    def _forget(self) -> None:
        keep = self.met > 1
        if keep.sum() > MEMORY // 2:
            return self.clear()
        self.keys = self.keys[keep]
        self.ids = self.ids[ragged(self.at[keep], self.n[keep])]
        self.text = self.text[ragged(self.text_at[keep], self.size[keep])]
        self.n, self.size, self.met = self.n[keep], self.size[keep], self.met[keep] // 2
        self.at, self.text_at = np.cumsum(self.n) - self.n, np.cumsum(self.size) - self.size

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and the number of each part's."""
        found, count = [np.zeros(0, np.uint32)], np.zeros(len(parts), np.int64)
        for k in range(0, len(parts), 2000):
            e = self.tokenizer.encode(parts[k : k + 2000], is_pretokenized=True, add_special_tokens=False)
            found.append(np.array(e.ids, np.uint32))
            count += np.bincount(np.array(e.word_ids, np.int64) + k, minlength=len(parts)) if len(e.ids) else 0
        return np.concatenate(found), count

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, count = self._ids(_decoded(buf, starts, ends))
        size = ends - starts
        at = len(self.ids) + np.cumsum(count) - count
        text_at = len(self.text) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.text = np.concatenate([self.text, buf[ragged(starts, size)]])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys = keys[order]
        for name, new in (("at", at), ("n", count), ("text_at", text_at), ("size", size), ("met", np.zeros(len(size), np.int64))):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's ids begin (n + 1); null and empty texts have none.

        Hits are compared byte by byte with the part that the memory holds; a part whose hash belongs to another one is encoded by itself.
        """
        buf, offs = utf8(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, ends = _cuts(buf, offs)
        coded = pa.array(span_hashes(buf, starts, ends)).dictionary_encode()
        which, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            if len(self.keys) + (~known).sum() > MEMORY:
                self._forget()
                place = np.searchsorted(self.keys, keys)
                known = place < len(self.keys)
                known[known] = self.keys[place[known]] == keys[known]
            first = np.zeros(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            new = first[~known]
            self._learn(keys[~known], buf, starts[new], ends[new])
            place = np.searchsorted(self.keys, keys)
        self.met[place] += np.bincount(which, minlength=len(keys))
        place, size = place[which], ends - starts
        n, at, ids = self.n[place], self.at[place], self.ids
        other = (size != self.size[place]) | ~same_spans(buf, starts, self.text, self.text_at[place], np.minimum(size, self.size[place]))
        if other.any():
            more, n[other] = self._ids(_decoded(buf, starts[other], ends[other]))
            at[other] = len(ids) + np.cumsum(n[other]) - n[other]
            ids = np.concatenate([ids, more])
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return ids[ragged(at, n)], total[np.searchsorted(starts, offs)]


def _decoded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(buf))
    return [str(raw[a:b], "utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]


def memory(path: str) -> WordMemory:
    if path not in _known:
        _known[path] = WordMemory(path)
    return _known[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
