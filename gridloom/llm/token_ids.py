"""Ids of a public tokenizer, with caches for what texts repeat.

The tokenizer splits a text into pieces by a pattern and encodes each by itself. Where a
text holds only characters on which Python's classes agree with the pattern's, its pieces
are found here, looked up in a cache of two generations, so memory is bounded, and only the
unseen ones go to the tokenizer. Where words stand between single spaces, words with the
space or line end before them, cut where letters, digits and other marks meet, are looked up first,
by a hash of 63 bits in a table of NumPy arrays (a new word meets an entry's hash by chance
once in 10^13), all words of a batch at once. Other texts are first cut at single spaces
flanked by characters that aren't white space, over which no piece reaches, and a chunk with
any other character goes to the tokenizer whole. So does a text that holds the string of a
special token, which the tokenizer makes that token's id unless ``special`` is false; then it is
ordinary text. Tests hold all this against the tokenizer's plain call on whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate, chain

import numpy as np

from . import words as W

_BY_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of the byte-level pattern, for text in the range where Python's classes agree with it.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_DOUBLE = ("  ", " \t", "\t ", " \n", "\n ", " \r", "\r ")
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
#: Kinds of bytes between which pieces end: letters 1, digits 2, other marks 3; at the rest, 0, nothing is certain.
_KIND = np.array([1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3 if 32 < i < 127 and i != 39 else 0 for i in range(128)] + [1] * 128, np.uint8)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte of text in the plain range, where characters from U+00C0 are letters but for
    two signs, and those below aren't sorted here."""
    out = _KIND[data]
    lead = np.flatnonzero(data == 0xC2)
    out[lead] = out[lead + 1] = 0
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]
    out[lead] = out[lead + 1] = 0
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _regular(t: str) -> bool:
    """Whether every space stands between characters that aren't white space, all in the plain range."""
    return not (t[:1] == " " or t[-1:] == " " or any(x in t for x in _DOUBLE)) and bool(_PLAIN.fullmatch(t))


class Cache:
    """Two generations: what the old one still answers moves to the young one."""

    def __init__(self, most: int) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def split(self, keys: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known of ``keys``, and the rest."""
        young, old = self.young, self.old
        known = {k: young[k] for k in keys if k in young}
        back = {k: old[k] for k in keys if k not in known and k in old}
        self.add(back)
        known |= back
        return known, [k for k in keys if k not in known]

    def add(self, found: dict[str, bytes]) -> None:
        if len(self.young) + len(found) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in found.items() if len(k) <= 64)


class Table:
    """Ids by hash in open addressing: at most ``most`` entries and ``PER`` ids for each on average.

    Hash 0 marks a free slot, so hashes are odd. When full, entries met since the last time
    stay, half of the table at most.
    """

    PER = 6

    def __init__(self, most: int) -> None:
        self.most, self.slots = most, 1 << (3 * most // 2).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.start, self.size = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.met = np.zeros(self.slots, bool)
        self.n, self.used, self.pool = 0, 0, np.zeros(1 << 16, "<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        mask = np.uint64(self.slots - 1)
        at = ((h >> np.uint64(1)) & mask).astype(np.int64)
        got = self.key[at]
        out = np.where(got == h, at, -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            got = self.key[at[left]]
            same = got == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same & (got != 0)]
        self.met[out[out >= 0]] = True
        return out

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New distinct hashes with the counts of their ids, and these."""
        if self.n + len(h) > self.most or self.used + len(ids) > self.most * self.PER:
            self._sweep()
        if len(h) > self.most // 2 or len(ids) > self.most * self.PER // 2:
            return
        at = ((h >> np.uint64(1)) & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            p = at[left]
            free = self.key[p] == 0
            self.key[p[free]] = h[left[free]]
            left = left[self.key[p] != h[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.start[at], self.size[at] = self.append(ids) + np.cumsum(size) - size, size
        self.n += len(h)

    def append(self, ids: np.ndarray) -> int:
        """Put ids at the pool's end; returns where they begin."""
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, self.used - len(self.pool)), "<u4")])
        self.pool[begin : self.used] = ids
        return begin

    def _sweep(self) -> None:
        at = np.flatnonzero(self.met & (self.key != 0))[: self.most // 2]
        key, size, start, pool = self.key[at], self.size[at].astype(np.int64), self.start[at], self.pool
        end = np.cumsum(size)
        fits = end <= self.most * self.PER // 2
        key, size, start, end = key[fits], size[fits], start[fits], end[fits]
        source = np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)
        self._clear()
        if len(key):
            self.add(key, size, pool[source])


class Encoder:
    def __init__(self, path: str, words: int = 700_000, parts: int = 40_000, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = not special
        self.marks = [x.content for x in self.t.get_added_tokens_decoder().values()] if special else []
        self.parts, self.words = Cache(parts), Table(words)
        self.opens = np.zeros(self.t.get_vocab_size(), bool)
        for token, i in self.t.get_vocab().items():
            self.opens[i] = token[0] in "\u0120\u010a"  # as which the byte-level vocabulary writes a space and a line end

    def whole(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids, straight from the tokenizer."""
        out: list[bytes] = []
        for a in range(0, len(texts), 5000):
            ids = [e.ids for e in self.t.encode_batch_fast(texts[a : a + 5000], add_special_tokens=False)]
            raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            end = list(accumulate(4 * len(x) for x in ids))
            out += [raw[i:j] for i, j in zip([0, *end], end, strict=False)]
        return out

    def _kind(self, t: str) -> int:
        return 2 if any(m in t for m in self.marks) else 0 if _regular(t) else 1

    def encode(self, texts: list[str]) -> list[bytes]:
        out, kinds = [b""] * len(texts), list(map(self._kind, texts))
        for kind, encode in enumerate((self._words, self._parts, self.whole)):
            at = [i for i, x in enumerate(kinds) if x == kind]
            for i, ids in zip(at, encode([texts[i] for i in at]), strict=True):
                out[i] = ids
        return out

    def _words(self, texts: list[str]) -> list[bytes]:
        """Of regular texts: words are looked up by hash, then ids gathered for all at once.

        A word begins at a space, or at a line end after a character that isn't white space, and
        keeps it, but for a text's first; and where letters, digits and other marks meet.
        """
        if not texts:
            return []
        coded = [t.encode() for t in texts]
        raw = b" " + b" ".join(coded)
        data = np.frombuffer(raw, np.uint8)
        heads = np.cumsum([0, *(len(t) + 1 for t in coded[:-1])])
        cut, kind = data == 32, _kinds(data)
        cut[1:] |= (data[1:] == 10) & ~_WHITE[data[:-1]]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(data))
        first = np.searchsorted(start, heads)
        start[first] += 1
        h = W.hashes(data, start, stop, W.EXACT) | np.uint64(1)
        slot = self.words.find(h)
        new = np.flatnonzero(slot < 0)
        kept = self.words.used
        begin, size = self.words.start[slot], self.words.size[slot]
        if len(new):
            fresh, one, of = np.unique(h[new], return_index=True, return_inverse=True)
            made = self._made([raw[a:b].decode() for a, b in zip(start[new[one]].tolist(), stop[new[one]].tolist(), strict=True)])
            n = np.fromiter(map(len, made), np.int64, len(made)) // 4
            at = self.words.append(np.frombuffer(b"".join(made), "<u4"))
            begin[new], size[new] = (at + np.cumsum(n) - n)[of], n[of]
        pool, n = self.words.pool, size.astype(np.int64)
        end = np.cumsum(n)
        source = np.repeat((begin - end + n).astype(np.int32) if end[-1] < 1 << 30 else begin - end + n, n)
        source += np.arange(len(source), dtype=source.dtype)
        out = pool[source]
        if len(new):
            self.words.used = kept
            short = [i for i, x in enumerate(made) if len(x) <= 128]
            self.words.add(fresh[short], np.array([len(made[i]) // 4 for i in short], np.int64), np.frombuffer(b"".join([made[i] for i in short]), "<u4"))
        out_bytes = out.tobytes()
        edge = (4 * end[np.append(first[1:], len(end)) - 1]).tolist()
        return [out_bytes[i:j] for i, j in zip([0, *edge], edge, strict=False)]

    def _made(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, with the space or line end before them if there is one."""
        letters = [i for i, k in enumerate(words) if k[:1] in (" ", "\n") and k[1:].isalpha()]
        out: list[bytes | None] = [None] * len(words)
        for i, x in zip(letters, self._letters([words[i] for i in letters]), strict=True):
            out[i] = x
        mixed = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(mixed, self._known([_PIECE.findall(words[i]) for i in mixed], set()), strict=True):
            out[i] = x
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space or line end before it: they are encoded in a
        row, and as a word is one piece, its ids begin where an id's bytes begin with those."""
        if not words:
            return []
        rows = ["".join(words[a : a + 2000]) for a in range(0, len(words), 2000)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.t.encode_batch_fast(rows, add_special_tokens=False)), "<u4")
        start = (4 * np.flatnonzero(self.opens[ids])).tolist()
        if len(start) != len(words):
            return self.whole(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(start, [*start[1:], len(raw)], strict=True)]

    def _parts(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str]] = []
        odd: set[str] = set()
        for t in texts:
            if _PLAIN.fullmatch(t):
                cut.append(_PIECE.findall(t))
                continue
            chunks = _BY_SPACE.split(t)
            parts: list[str] = []
            for c in [*chunks[:1], *(" " + c for c in chunks[1:])]:
                if _PLAIN.fullmatch(c):
                    parts += _PIECE.findall(c)
                else:
                    parts.append(c)
                    odd.add(c)
            cut.append(parts)
        return self._known(cut, odd)

    def _known(self, cut: list[list[str]], odd: set[str]) -> list[bytes]:
        """Ids of each list of parts; those in ``odd`` aren't kept."""
        known, new = self.parts.split(set().union(*cut) - odd)
        made = dict(zip(new, self.whole(new), strict=True))
        self.parts.add(made)
        known |= made
        rare = list(odd)
        known.update(zip(rare, self.whole(rare), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
