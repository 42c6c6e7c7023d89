"""Whole texts to token ids with the ``tokenizers`` library, inside Spark tasks.

For a tokenizer that drops white space, a text's ids are its words' ids in a
row, and a word of letters and marks is its runs of either in a row.  Texts are
cut into such units in array operations, a block of some hundred kilobytes at a
time; of some blocks together each distinct unit is looked up once, and each
distinct unit is encoded once per worker while the memo holds it.
The memo is bounded (``max_words``) and has two halves: when the new one is
full the old one goes, and of that only units met again since are kept.  Results
never depend on it.  Other tokenizers encode whole texts.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from itertools import islice

import numpy as np

from .common import KEPT, release
from .wordhash import _LOWER, _SPACE, raw_bytes

_MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # ASCII punctuation without ' and <, which begin contractions and special tokens
_LETTER, _MARK, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[_SPACE] = 0
_KIND[0x61:0x7B] = _LETTER
_KIND[list(_MARKS)] = _MARK
_LATIN = np.zeros(256, bool)  # second UTF-8 byte, after 0xC3, of a Latin letter
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LOWER_LATIN = np.arange(256, dtype=np.uint8)
_LOWER_LATIN[0x80:0x9F] += 0x20
_UNIT = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[" + re.escape(_MARKS) + rb"]+")
_BREAK = re.compile(rb"[ \t-\r]")


def _byte_chars() -> str:
    """The characters that byte-level models take bytes for: printable ones stay, others follow from 256 on."""
    odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
    return "".join(chr(256 + odd.index(b)) if b in odd else chr(b) for b in range(256))


_BYTE_CHARS = _byte_chars()


class TextEncoder:
    """``encode(text: bytes) -> bytes``: ids as little-endian integers of ``dtype``."""

    def __init__(self, path: str, max_words: int = 300_000, block: int = 1 << 18, blocks: int = 8):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_words, self.block, self.blocks = max_words, block, blocks
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.by_word = self._drops_space()

    def _drops_space(self) -> bool:
        """Whether units can be encoded on their own: tried on all letters and marks; no special token may be cut."""
        one = self._ids("ab")
        if not one or not self.tokenizer.id_to_token(one[-1]).endswith("</w>"):
            return False
        special = [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(_BREAK.search(t) or (_KIND[_LOWER[list(t)]] != _OTHER).all() for t in special):
            return False
        self.by_word = True
        letters = "".join(bytes([0xC3, b]).decode() for b in np.flatnonzero(_LATIN).tolist())
        tries = [f"{w}{m}{m}{w}{m} {m}{w}" for w in ("ab", "Cd", "\u00e9\u00c9n") for m in _MARKS.decode()]
        tries += [*letters, *map(chr, range(0x61, 0x7B)), letters, _MARKS.decode(), "ab cd\n\tab\r\n"]
        same = self.encode(" ".join(tries).encode()) == self._pack(self._ids(" ".join(tries)))
        self.memo, self.old = {}, {}
        return same

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.binary()))

    def encode_column(self, column) -> list[bytes]:
        """The ids of each text of an Arrow column; null is an empty text."""
        if not self.by_word:
            return [self._pack(self._ids(t.decode())) for t in texts_of(column)]
        raw, at = raw_bytes(column)
        parts: list[list[bytes]] = [[] for _ in range(len(column))]
        ranges = self._blocks(raw, at)
        while some := list(islice(ranges, self.blocks)):
            cut = []
            for begin, end in some:
                low, high = int(np.searchsorted(at, begin, side="right")) - 1, int(np.searchsorted(at, end))
                units, first = _units(raw[begin:end], np.clip(at[low:high + 1], begin, end) - begin)
                if len(units):
                    cut.append((low, units, first))
            for (low, _, first), (data, offsets) in zip(cut, self._encode_units([units for _, units, _ in cut])):
                cuts = offsets[first].tolist()
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), low):
                    if a < b:
                        parts[k].append(data[a:b])
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def _blocks(self, raw: np.ndarray, at: np.ndarray):
        """Ranges of about ``block`` bytes that end where a text or a word does."""
        begin = 0
        while begin < len(raw):
            end = begin + self.block
            if end < len(raw):
                edge = int(at[np.searchsorted(at, end)])
                space = _BREAK.search(raw[end:edge])
                end = end + space.start() if space else edge
            else:
                end = len(raw)
            yield begin, end
            begin = end

    def _encode_units(self, blocks: list):
        """Of each block the ids of its units in a row, and the byte offset of each unit in them."""
        import pyarrow as pa

        coded = pa.chunked_array(blocks, pa.binary()).dictionary_encode().chunks  # they share one dictionary
        found = pa.array(self._look_up(coded[0].dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        for block in coded:
            _, offsets, data = found.take(block.indices).buffers()
            yield (data.to_pybytes() if data else b""), np.frombuffer(offsets, np.int64, len(block) + 1)

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.max_words // 2:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        found = list(map(memo.get, units))
        missing = [w for w, ids in zip(units, found) if ids is None]
        if missing:
            memo.update([(w, ids) for w, ids in zip(missing, map(old.get, missing)) if ids is not None])
            new = [w for w in missing if w not in memo]
            if new:
                self._learn(new)
            rest = map(memo.__getitem__, missing)
            found = [next(rest) if ids is None else ids for ids in found]
        return found

    def _learn(self, units: list[bytes]) -> None:
        memo, packed, tokenize, rest = self.memo, self.packed, self.tokenizer.model.tokenize, []
        for w in units:
            if w.isalpha():  # ASCII letters: the model's own input, as they stand
                memo[w] = b"".join([packed[t.id] for t in tokenize(w.decode())])
            elif _UNIT.fullmatch(w):
                memo[w] = b"".join([packed[t.id] for t in tokenize(charmap_decode(w, "strict", _BYTE_CHARS)[0])])
            else:
                rest.append(w)
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
                memo[w] = self._pack(e.ids)


def _units(raw: np.ndarray, edges: np.ndarray):
    """The units of the texts between ``edges``, as an Arrow array, and the number of units before each edge.

    A unit is a run of lower-cased letters or of marks, or, where a word has any
    other character, that whole word unchanged (the tokenizer lower-cases too,
    but not inside its special tokens).
    """
    import pyarrow as pa

    low = _LOWER[raw]
    kind = _KIND[low]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[_LATIN[raw[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = _LOWER_LATIN[low[lead + 1]]
    # A word begins after white space and where a text begins; a unit also where the kind changes.
    new = np.ones(len(raw) + 1, bool)
    np.equal(kind[:-1], 0, out=new[1:-1])
    new[edges] = True
    if (kind == _OTHER).any():
        word = np.cumsum(new[:-1], dtype=np.int32)
        odd = np.zeros(int(word[-1]) + 1, bool)
        odd[word[kind == _OTHER]] = True
        odd = odd[word] & (kind != 0)
        kind[odd] = _OTHER
        low[odd] = raw[odd]
    new[1:-1] |= kind[1:] != kind[:-1]
    inside = kind != 0
    begin = np.flatnonzero(new[:-1] & inside)
    # Without the white space, each unit ends where the next begins.
    before = np.cumsum(inside, dtype=np.int32)
    offsets = np.empty(len(begin) + 1, np.int32)
    offsets[:-1] = before[begin] - 1
    offsets[-1] = before[-1] if len(before) else 0
    units = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    return units, np.searchsorted(begin, edges)


_ENCODERS: dict[str, TextEncoder] = {}
KEPT.append(_ENCODERS.clear)


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for this file (kept between tasks of a reused worker)."""
    if path not in _ENCODERS:
        release()  # the memo is the largest thing a worker holds; nothing of earlier stages stays beside it
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def texts_of(column) -> list:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def batches_of(batch, rows: int = 256):
    """Slices of an Arrow batch, so that Python objects of a few hundred texts exist at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
