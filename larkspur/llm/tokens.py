"""Token ids by the ``tokenizers`` library, fast enough for corpora.

Texts are cut, a portion at a time, into words and what stands between them, at places where
no pre-tokenizer known here has a token across. Each different piece is given to the library once; by the hash of its
bytes its ids are looked up from then on. The ids equal those of encoding whole texts.

Cutting is for texts of ASCII, Latin-1 letters and general punctuation. A word is a run of letters (an
apostrophe before a letter counts as one) with the one blank before it. Other texts, texts with an apostrophe
between a letter and something else than a letter or a blank, texts that hold an added token (such as
``<|endoftext|>``, which the library gives one id), and tokenizers of another form are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from larkspur.llm.arrays import U, Prefix, spans
from larkspur.llm.arrays import portions as byte_portions


def tokenizer_path(name: str) -> str:
    """A path, or the name of a file of the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """Ids by the 64-bit hash of a piece: an open-addressed table of rows, rows of ids on end. Row 0 has no ids."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.keys, self.row_of = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends, self.count = np.zeros(1 << 16, np.int64), 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys (none of them 0); -1 where a key isn't known."""
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left, mask = np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.row_of[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & mask
        return out

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        at, mask = (keys >> U(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one slot, one gets it
            got = free & (self.keys[at] == keys)
            self.row_of[at[got]] = rows[got]
            keys, rows, at = keys[~got], rows[~got], (at[~got] + 1) & mask

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Different keys that aren't known, their ids on end, and how many each has."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(keys) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[self.count : self.count + len(keys)] = self.used + np.cumsum(sizes)
        self._place(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.used, self.count = self.used + len(ids), self.count + len(keys)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows on end, and how many each row has."""
        first = self.ends[np.maximum(rows - 1, 0)]
        n = self.ends[rows] - first
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return self.flat[at], n


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ONE = np.uint64(1)
#: Pieces that are looked up, and learnt, at once: with the limit of what is remembered they fill the store to two thirds at most.
PIECES = 400_000


class Encoder:
    """``limit``: pieces to remember; past it the memory starts anew, within a text as well."""

    def __init__(self, name: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm == "null"
        self.lowered = pre.get("type") == "Sequence" and '"invert": true' in json.dumps(pre) and '"Lowercase"' in norm and "s+" in norm
        added = [t for t in spec.get("added_tokens") or [] if t["content"]]
        if any((t.get("normalized") and norm != "null") or all(c.isalnum() or c.isspace() or c == "|" for c in t["content"]) for t in added):
            self.spaced = self.lowered = False  # found in other forms too, or across words that are encoded together
        self.added = [t["content"].encode() for t in added]
        #: Stands between words that are encoded together, and has one id of its own.
        self.between = "\n" if self.spaced else " | "
        mark = self._whole([self.between.strip(" ")])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.limit, self.store = limit, Store()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str], plain: np.ndarray) -> None:
        """plain: letters only, but for a leading space; these go to the library many in one text."""
        together, alone = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        for i in range(0, len(together), 4000):
            some = together[i : i + 4000]
            ids = np.array(self._whole([self.between.join([pieces[k] for k in some])])[0], np.uint32) if self.mark is not None else np.zeros(0)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(some) - 1:
                alone += some
                continue
            sizes = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
            self.store.add(keys[some], np.delete(ids, marks), sizes)
        if alone:
            found = self._whole([pieces[k] for k in alone])
            sizes = np.array([len(x) for x in found])
            self.store.add(keys[alone], np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        """Pieces [a, b), whether each is letters only but for a space, pieces before each offset, and documents not to cut."""
        n, docs = len(data), len(offsets) - 1
        high = data >= 0x80
        letter = _LETTER[data]
        bad = high.copy()
        if high.any():
            at = np.flatnonzero(data[:-1] == 0xC3)
            bad[at] = bad[at + 1] = False
            at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
            letter[at] = letter[at + 1] = True
            at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x90) & (data[2:] <= 0xA7))
            bad[at] = bad[at + 1] = bad[at + 2] = False
        blank, word = _BLANK[data], letter
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        apostrophes = np.flatnonzero(data == 39)
        if len(apostrophes):
            word = letter.copy()
            led = apostrophes[(apostrophes + 1 < n)]
            led = led[letter[led + 1] & ~begins[led + 1]]
            word[led] = True
            inner = led[~begins[led]]
            bad[inner[~(letter[inner - 1] | blank[inner - 1])]] = True
        starts, ends, _ = spans(word, offsets)
        plain = np.ones(len(starts), bool)
        if len(apostrophes):
            sums = np.concatenate(([0], np.cumsum(data == 39)))
            plain = sums[ends] == sums[starts]
        led = np.flatnonzero(~begins[starts])
        led = led[blank[starts[led] - 1]]
        starts = starts.copy()
        starts[led] -= 1
        plain[led] &= data[starts[led]] == 32
        marks = begins
        marks[starts] = marks[ends] = True
        cuts = np.flatnonzero(marks)
        letters = np.zeros(n + 1, bool)
        letters[starts] = plain
        slow = np.zeros(docs, bool)
        at = np.flatnonzero(bad)
        slow[np.searchsorted(offsets, at, "right") - 1] = True
        return cuts[:-1], cuts[1:], letters[cuts[:-1]], np.searchsorted(cuts, offsets), slow

    def _ids(self, raw: bytes, keys, use, a, b, plain) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end of the pieces raw[a:b], and how many each has; none for those not in use."""
        rows = np.zeros(len(a), np.int32)
        rows[use] = self.store.get(keys[use])
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            pieces = [raw[x:y].decode() for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]
            self._learn(fresh, pieces, plain[at])
            rows[new] = self.store.get(keys[new])
        return self.store.take(rows)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end (uint32), and how many each document has."""
        docs = len(offsets) - 1
        whole = lambda d: data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "surrogatepass")
        if not (self.spaced or self.lowered):
            found = self._whole([whole(d) for d in range(docs)])
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        a, b, plain, by_doc, slow = self._cut(data, offsets)
        raw = data.tobytes()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                slow[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(content, at + 1)
        if self.lowered:
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            data = np.where(upper, data + np.uint8(32), data)
        keys = np.maximum(Prefix(data).hashes(a, b), _ONE)
        use = np.repeat(~slow, np.diff(by_doc)) if slow.any() else np.ones(len(a), bool)
        raw, parts = data.tobytes(), [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for i in range(0, len(a), PIECES):
            z = slice(i, i + PIECES)
            if self.store.count > self.limit:
                self.store = Store()
            parts.append(self._ids(raw, keys[z], use[z], a[z], b[z], plain[z]))
        ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.concatenate(([0], np.cumsum(n)))[by_doc]
        n = np.diff(ends)
        if slow.any():
            at = np.flatnonzero(slow).tolist()
            rest = dict(zip(at, self._whole([whole(d) for d in at]), strict=True))
            split = [np.array(rest[d], np.uint32) if d in rest else ids[ends[d] : ends[d + 1]] for d in range(docs)]
            return np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, n

    def encode_ended(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_bytes(), with the id ``end`` after each document."""
        ids, n = self.encode_bytes(data, offsets)
        out = np.full(len(ids) + len(n), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode_bytes(data, offsets) for _, data, offsets in byte_portions(pa.array(texts, pa.large_string()))]
        return (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One a worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
