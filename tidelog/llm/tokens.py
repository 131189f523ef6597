"""Tokenizer access for executors.

An :class:`Encoder` returns exactly what the tokenizer library returns for a whole
text. For the two pre-tokenizers recognised below the library never merges across a
pre-token, so the ids of a text are the concatenated ids of its pre-tokens; each
distinct pre-token is given to the library once and remembered (bounded memory).
Texts with any character outside a range whose classes are certain, or holding an
added-token string, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

#: Printable ASCII, tab, newline, carriage return and Latin letters that both the
#: library's and Python's regular expressions class as letters and lower-case alike.
_OTHER = re.compile("[^\\x20-\\x7e\\t\\n\\r\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u014a-\\u017e]")
#: Classes of the bytes of such texts in UTF-8; 0 stands between texts.
_LETTER, _DIGIT, _SIGN, _SPACE, _BREAK = 1, 2, 3, 4, 5
_CLASSES = bytes(
    0 if not b else _LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if b == 32 else _BREAK if b in b"\t\n\r" else _SIGN for b in range(256)
)


def _starts(before: int, this: int, after: int, lower: bool) -> bool:
    """Whether a pre-token (or what stands between two) starts at a byte, from the classes around it. Byte level:
    `` ?letters| ?digits| ?signs|white space before white space or the end|white space``; word level:
    ``letters|one digit|signs``."""
    if lower:
        return this != before or this in (0, _DIGIT)
    if this >= _SPACE:  # the last of some white space goes with what follows, or stands alone
        return before < _SPACE or 0 < after < _SPACE
    return not this or this != before and before != _SPACE


#: By 36 x class before + 6 x class + class after.
_BYTE_LEVEL, _WORD_LEVEL = (bytes(n < 216 and _starts(n // 36, n // 6 % 6, n % 6, lower) for n in range(256)) for lower in (False, True))
#: Bytes of text worked on at once.
GROUP = 1 << 20
_JOINT = re.compile("[^ \\t\\n\\r][ \\t\\n\\r](?=[^ \\t\\n\\r])")

#: Pre-tokens remembered by a worker for a tokenizer, at most.
MEMO = 400_000


class _Memo:
    """The ids of words: those of at most 16 bytes in a table by their bytes themselves, as two
    integers, so that many are looked up at once; longer ones in a dictionary. Numbers are given in
    the order of arrival; 0 is no word."""

    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    _LOW, _HIGH = _MASK[np.minimum(np.arange(17), 8)], _MASK[np.maximum(np.arange(17) - 8, 0)]

    def __init__(self):
        self.count, self.filled, self.long = 1, 0, {}
        self.slots = np.zeros(1 << 12, np.int32)
        self.low, self.high = np.zeros((2, 1 << 10), np.uint64)
        self.at, self.n = np.zeros((2, 1 << 10), np.int64)
        self.again = np.zeros(1 << 10, bool)  # met after the group it was learned in
        self.ids = np.zeros(1 << 12, np.uint32)

    def __len__(self) -> int:
        return self.count - 1

    @classmethod
    def keys(cls, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of words (no zero among them) that begin in some data; of longer words the first 16."""
        whole = np.frombuffer(data + bytes(24 - len(data) % 8), "<u8")
        at, by = starts >> 3, (starts & 7).astype(np.uint64) << np.uint64(3)
        a, b, c = whole[at], whole[at + 1], whole[np.minimum(at + 2, len(whole) - 1)]
        back, kept = np.uint64(64) - by, np.minimum(sizes, 16)
        at_once = by > 0
        return (a >> by | np.where(at_once, b << back, 0)) & cls._LOW[kept], (b >> by | np.where(at_once, c << back, 0)) & cls._HIGH[kept]

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ high * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word of at most 16 bytes, 0 where it is not known."""
        slot = self._first(low, high)
        found = self.slots[slot]
        left = np.flatnonzero((self.low[found] != low) | (self.high[found] != high))
        while len(left := left[found[left] > 0]):
            slot[left] = next_slot = (slot[left] + 1) & len(self.slots) - 1
            found[left] = number = self.slots[next_slot]
            left = left[(self.low[number] != low[left]) | (self.high[number] != high[left])]
        return found

    def _enter(self, numbers: np.ndarray) -> None:
        slot = self._first(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            slot, numbers = (slot[left] + 1) & len(self.slots) - 1, numbers[left]

    def add(self, words: list[bytes], ids: list[bytes]) -> None:
        """Distinct words that are not known, and the ids of each."""
        sizes, n = np.array(list(map(len, words))), np.array(list(map(len, ids))) // 4
        joined = np.frombuffer(b"".join(ids), np.uint32)
        self._append(*self.keys(b"".join(words), np.cumsum(sizes) - sizes, sizes), n, joined)
        numbers = np.arange(self.count - len(words), self.count)
        self.long.update((words[i], int(numbers[i])) for i in np.flatnonzero(sizes > 16).tolist())
        self._place(numbers[sizes <= 16])

    def _append(self, low, high, n, ids) -> None:
        end, full = self.count + len(n), self.filled + len(ids)
        if end > len(self.low):
            more = 2 * end - len(self.low)
            self.low, self.high, self.at, self.n, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.low, self.high, self.at, self.n, self.again))
        if full > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(2 * full - len(self.ids), np.uint32)])
        new = slice(self.count, end)
        self.low[new], self.high[new], self.n[new] = low, high, n
        self.at[new] = self.filled + np.cumsum(n) - n
        self.ids[self.filled : full] = ids
        self.count, self.filled = end, full

    def _place(self, numbers: np.ndarray) -> None:
        if 2 * self.count > len(self.slots):
            self.slots = np.zeros(4 << self.count.bit_length(), np.int32)
            every = np.ones(self.count, bool)
            every[[0, *self.long.values()]] = False
            numbers = np.flatnonzero(every)
        self._enter(numbers)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words one after the other, and where each word's begin, and the end."""
        n = self.n[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.at[numbers] - ends + n, n) + np.arange(total)], np.concatenate([[0], ends])

    def kept(self, most: int) -> _Memo:
        """A memory of the words that came again, if they are not too many."""
        numbers, new = np.flatnonzero(self.again[: self.count]), _Memo()
        if 0 < len(numbers) <= most:
            new._append(self.low[numbers], self.high[numbers], self.n[numbers], self.gather(numbers)[0])
            number = dict(zip(numbers.tolist(), range(1, new.count)))
            new.long = {w: number[i] for w, i in self.long.items() if i in number}
            long = np.zeros(new.count, bool)
            long[[0, *new.long.values()]] = True
            new._place(np.flatnonzero(~long))
        return new


class Encoder:
    """Whole-text encoding with one tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.memo = path, memo
        self.library = Tokenizer.from_file(path)
        self.vocab = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._split, self._lower = self._splitter(spec)
        if self._split:
            self.library.model._resize_cache(0)  # words that come again are remembered here
        names = sorted(self.library.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        #: For cutting the ids of joined words: bytes of each token, or whether it ends a word.
        self._measure = np.zeros(self.vocab, np.int64)
        for name, i in names if self._split else []:
            self._measure[i] = name.endswith("</w>") if self._lower else len(name)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self._known = _Memo()

    @staticmethod
    def _splitter(spec: dict):
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            return _BYTE_LEVEL, False
        kinds = [p.get("type") for p in pre.get("pretokenizers", [])]
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if kinds == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+|[\\p{N}]|" in str(pre["pretokenizers"][0]["pattern"].get("Regex")):
            return _WORD_LEVEL, True
        return None, False

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some pre-tokens that fall apart when joined, by encoding runs of them."""
        runs = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        out: list[bytes] = []
        for run, ids in zip(runs, self._whole([(b" " if self._lower else b"").join(run).decode() for run in runs])):
            n = np.frombuffer(ids, np.uint32)
            if self._lower:
                cut = np.flatnonzero(self._measure[n]) + 1
            else:
                upto, ends = np.cumsum(self._measure[n]), np.cumsum(list(map(len, run)))
                cut = np.searchsorted(upto, ends) + 1
                cut = cut if len(upto) and cut[-1] == len(n) and (upto[cut - 1] == ends).all() else cut[:0]
            if len(cut) == len(run) and cut[-1] == len(n):
                cut = (cut * 4).tolist()
                out += [ids[a:b] for a, b in zip([0, *cut], cut)]
            else:  # the runs did not fall apart as expected: one at a time
                out += self._whole([w.decode() for w in run])
        return out

    def _learn(self, unseen: set[bytes]) -> None:
        if self._lower:
            joined = [w for w in unseen if _CLASSES[w[0]] == _LETTER]
        else:  # a pre-token that begins with its space ends where the next one's space stands
            joined = [w for w in unseen if w[0] == 32 and w[1:] and _CLASSES[w[1]] < _SPACE]
        alone = list(unseen.difference(joined))
        self._known.add([*joined, *alone], [*self._words(joined), *self._whole([w.decode() for w in alone])])

    def _pretokens(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of texts with a zero byte before and after each begin, and their sizes."""
        kind = np.frombuffer(data.translate(_CLASSES), np.uint8)
        around = (kind[:-2] * 6 + kind[1:-1]) * 6 + kind[2:]
        start = np.frombuffer(b"\1" + around.tobytes().translate(self._split) + b"\1", np.uint8).copy()
        text = np.frombuffer(data, np.uint8)
        quote = np.flatnonzero(text == 39)  # 's 't 're 've 'm 'll 'd where signs begin
        before = kind[quote - 1]
        quote = quote[(before != _SIGN) & (self._lower or before != _SPACE)]
        one, two = text[quote + 1], text[np.minimum(quote + 2, len(text) - 1)]
        is_two = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = quote[(one == 115) | (one == 116) | (one == 109) | (one == 100)]
        long = quote[is_two]
        start[short + 1] = start[long + 1] = 0
        start[short + 2] = start[long + 3] = 1
        starts = np.flatnonzero(start)
        sizes, first = np.diff(starts, append=len(data)), kind[starts]
        kept = (first > 0) & (first < _SPACE) if self._lower else first > 0
        return starts[kept], sizes[kept]

    def _group(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts of certain characters."""
        joined = "\0".join(texts)
        data = b"\0" + (joined.lower() if self._lower else joined).encode() + b"\0"
        starts, sizes = self._pretokens(data)
        known = self._known
        low, high = known.keys(data, starts, sizes)
        found = known.find(low, high)
        long = np.flatnonzero(sizes > 16)
        words = [data[a:z] for a, z in zip(starts[long].tolist(), (starts + sizes)[long].tolist())]
        found[long] = [known.long.get(w, 0) for w in words]
        known.again[found] = True
        known.again[0] = False
        new = np.flatnonzero(found == 0)
        if len(new):
            self._learn({data[a:z] for a, z in zip(starts[new].tolist(), (starts + sizes)[new].tolist())})
            found[new] = known.find(low[new], high[new])
            found[long] = [known.long[w] for w in words]
        ids, upto = known.gather(found)
        text = np.frombuffer(data, np.uint8)
        ends = (4 * upto[np.searchsorted(starts, np.flatnonzero(text == 0))]).tolist()
        if len(known) > self.memo:
            self._known = known.kept(self.memo // 2)
        ids = ids.tobytes()
        return [ids[a:z] for a, z in zip(ends, ends[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0

        def work():
            nonlocal size
            for (i, _), ids in zip(group, self._group([t for _, t in group]) if group else []):
                out[i].append(ids)
            group.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self._split is None or _OTHER.search(text) or (self._added and self._added.search(text)):
                out[i] = self._whole([text])
                continue
            at = 0
            while at < len(text):  # a longer text is cut before a single space or break
                joint = _JOINT.search(text, at + GROUP) if len(text) - at > GROUP else None
                end = joint.start() + 1 if joint else len(text)
                group.append((i, text[at:end]))
                size += end - at
                at = end
                if size >= GROUP:
                    work()
        work()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Gives back what encoders remember in this worker; other operators' tasks begin with it."""
    _ENCODERS.clear()
    trim()


def trim() -> None:
    """Returns freed memory to the system, where the C library can: a worker lives for many tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def freeing(run):
    """A function of batches after which its worker holds nothing more: workers take turns, and idle ones stay."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return freed


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: Iterable[str | None], rows: int = 256, chars: int = 4_000_000):
    """Groups of consecutive texts, of bounded rows and characters (one longer text stands alone)."""
    group, size = [], 0
    for t in texts:
        n = len(t or "")
        if group and (len(group) >= rows or size + n > chars):
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group
