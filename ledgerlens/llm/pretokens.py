"""Pre-tokens of byte-level BPE, and tables of their ids; used inside Python workers."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

#: Highest code point of the fast pattern; beyond it, and for the separators U+001C to U+001F, the full pattern runs.
_TOP = 0x24F
_letters = "".join(re.escape(chr(c)) for c in range(_TOP + 1) if unicodedata.category(chr(c))[0] == "L")
_numbers = "".join(re.escape(chr(c)) for c in range(_TOP + 1) if unicodedata.category(chr(c))[0] == "N")
_rare = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
_compiled: dict[str, tuple] = {}


def splitter(pattern: str):
    """Function text -> list of pre-tokens by ``pattern`` (regex syntax with Unicode properties).

    Texts of Latin letters go through an equal pattern with plain character
    classes, which is about twice as fast.
    """
    if pattern not in _compiled:
        import regex

        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_letters}{_numbers}]").replace(r"\p{L}", f"[{_letters}]").replace(r"\p{N}", f"[{_numbers}]")
        quick = re.compile(plain).findall if r"\p" not in plain else None
        _compiled[pattern] = (regex.compile(pattern).findall, quick)
    full, quick = _compiled[pattern]
    if quick is None:
        return full
    return lambda text: full(text) if _rare.search(text) else quick(text)


class Codes(dict):
    """Numbers words by first sight; ``new`` lists those not yet handled."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        code = self[word] = len(self)
        self.new.append(word)
        return code


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], .., starts[0]+lengths[0]-1, starts[1], .. in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class IdTable:
    """Ids of each numbered word: ``take(codes)`` gives all ids in order and the number per code."""

    def __init__(self):
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.counts = np.empty(1 << 14, np.int64)
        self.words = 0

    def put(self, words: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Ids of the numbered ``words``: their runs in ``flat``, of ``counts`` ids each."""
        top = int(words.max()) + 1 if len(words) else 0
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while top > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.empty_like(self.counts)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[words] = self.used + np.cumsum(counts) - counts
        self.counts[words] = counts
        self.used += len(flat)
        self.words = max(self.words, top)

    def add(self, lists) -> None:
        """Ids of the words after those that the table has."""
        lists = list(lists)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.put(np.arange(self.words, self.words + len(lists)), np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum())), counts)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[codes]
        return self.ids[ragged(self.starts[codes], counts)], counts


def coded(words: list, codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


class WordIds:
    """Ids of words by a tokenizer file, kept by a Python worker from task to task.

    The word None stands for the end of a document, and a word of type bytes
    for one of the file's added tokens, which the library looks for in the text
    before anything else.
    """

    _kept: dict = {}

    @classmethod
    def of(cls, model_text: str, end_id: int) -> WordIds:
        key = (hash(model_text), len(model_text), end_id)
        if key not in cls._kept:
            cls._kept = {key: cls(model_text, end_id)}
        return cls._kept[key]

    def __init__(self, model_text: str, end_id: int):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model_text)
        self.end_id = end_id
        added = self.model.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in neighbouring characters are not supported")
        self.added = {t.content.encode(): i for i, t in added.items()}
        longest = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.top = max(self.model.get_vocab_size() - 1, end_id)
        # Byte-level vocabularies spell each byte as one character, so a token's length is its number of bytes.
        vocabulary = self.model.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.codes, self.table = Codes(), IdTable()

    def splitter(self, pattern: str):
        """Function text -> its words: added tokens as bytes, and the pre-tokens of what stands between them."""
        split, marks = splitter(pattern), self.marks
        if marks is None:
            return split

        def words(text):
            if not marks.search(text):
                return split(text)
            out = []
            for k, part in enumerate(marks.split(text)):
                out += [part.encode()] if k % 2 else split(part)
            return out

        return words

    def forget_beyond(self, words: int) -> None:
        if len(self.codes) > words:
            self.codes, self.table = Codes(), IdTable()

    def learn(self) -> None:
        """Encode the new words. Those of a space and letters are joined, as they fall apart again before the merges."""
        new, self.codes.new = self.codes.new, []
        first = len(self.codes) - len(new)
        alone, joined = [], []
        for i, w in enumerate(new):
            if w is None:
                self.table.put(np.array([first + i]), np.array([self.end_id], np.uint32), np.array([1]))
            elif isinstance(w, bytes):
                self.table.put(np.array([first + i]), np.array([self.added[w]], np.uint32), np.array([1]))
            else:
                (joined if w[0] == " " and w[1:].isalpha() and not _rare.search(w) else alone).append(i)
        for lo in range(0, len(joined), 1000):
            rows = joined[lo : lo + 1000]
            words = [new[i] for i in rows]
            ids = np.array(self.model.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
            self.table.put(np.array(rows) + first, ids, np.diff(ends, prepend=0))
        for lo in range(0, len(alone), 10_000):
            rows = alone[lo : lo + 10_000]
            lists = [x.ids for x in self.model.encode_batch_fast([new[i] for i in rows], add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            self.table.put(np.array(rows) + first, np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum())), counts)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 in as few bytes each as the largest needs, the bytes of a rank together."""
    top = int(values.max()) if len(values) else 0
    unit = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    body = values.astype(f"<u{unit}").view(np.uint8).reshape(-1, unit).T.tobytes()
    return bytes([unit]) + len(values).to_bytes(8, "little") + body


def unpack_ints(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers that start at ``at``, and where they end."""
    unit, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
    end = at + 9 + unit * n
    planes = np.frombuffer(data, np.uint8, unit * n, at + 9).reshape(unit, n)
    return planes.T.copy().view(f"<u{unit}").ravel().astype(np.int64), end


#: First codes that take two, three and five bytes; a code's first byte tells which.
_TWO, _THREE, _FIVE = 192, 192 + 56 * 256, 192 + 56 * 256 + 7 * 65536


def pack_codes(codes: np.ndarray) -> bytes:
    """Word codes of which small ones are common: one byte for the first 192, and so on; first bytes first, then the rest by length."""
    two, three, five = (codes >= _TWO) & (codes < _THREE), (codes >= _THREE) & (codes < _FIVE), codes >= _FIVE
    first = np.where(codes < _TWO, codes, 255).astype(np.uint8)
    b, c = codes[two] - _TWO, codes[three] - _THREE
    first[two] = 192 + (b >> 8)
    first[three] = 248 + (c >> 16)
    return b"".join([len(codes).to_bytes(8, "little"), first.tobytes(), (b & 255).astype(np.uint8).tobytes(), (c & 65535).astype("<u2").tobytes(), codes[five].astype("<u4").tobytes()])


def unpack_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    first = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    two, three, five = (first >= 192) & (first < 248), (first >= 248) & (first < 255), first == 255
    at, out = 8 + n, first.copy()
    out[two] = _TWO + ((first[two] - 192) << 8) + np.frombuffer(data, np.uint8, int(two.sum()), at)
    at += int(two.sum())
    out[three] = _THREE + ((first[three] - 248) << 16) + np.frombuffer(data, "<u2", int(three.sum()), at)
    at += 2 * int(three.sum())
    out[five] = np.frombuffer(data, "<u4", int(five.sum()), at)
    return out


assert sys.byteorder == "little"
