"""Exact and fast use of the public BPE tokenizers inside Spark tasks.

Byte-pair merges never cross the borders that a tokenizer's split pattern draws, so a text's ids are
those of its parts, one after the other. Parts are found for a whole batch at once with numpy, by
character class; each distinct part is encoded once by the tokenizers library and remembered, under its
text, by its task's worker. Within a batch, parts count as equal if two independent 64-bit hashes agree;
where only the first does, the batch is told apart by text. Tests hold this against the library on whole
texts.

With ``specials``, strings of special tokens in a text stand for their ids, as the library has it by
default; without, they are ordinary text, for files in which the end id must be a separator.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from emberlake.llm.hashing import span_hash_pairs
from emberlake.llm.workers import held

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
CHUNK = 1 << 20  # code points handled at once
KNOWN = 200_000  # distinct parts that a worker remembers


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


@lru_cache(1)
def _unassigned() -> np.ndarray:
    """Code points that Python's character table does not know: newer ones, whose class and case the library may see otherwise."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


@lru_cache(1)
def _visible() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


def _pieces(text: str, most: int = 4 * CHUNK):
    """A very long text in pieces that begin at a space after a non-space, where no part crosses."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most // 2)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut <= 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct part each part is, and where each distinct part stands first."""
    import pandas as pd

    high = int(cp.max())
    keys, check = span_hash_pairs(cp.astype(np.uint8 if high < 1 << 8 else np.uint16 if high < 1 << 16 else np.uint32), starts, ends)

    def told(keys):
        codes, unique = pd.factorize(keys)
        at = np.zeros(len(unique), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, at

    codes, at = told(keys)
    if (check == check[at][codes]).all():
        return codes, at
    return told(np.array([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object))


class Encoder:
    """``joins_space``: a space belongs to the part after it (byte-level); else white space is dropped,
    case is folded by the tokenizer, and digits stand alone (word-level). ``specials``: strings of
    special tokens become their ids."""

    def __init__(self, path: str, joins_space: bool, end: int = 0, specials: bool = False):
        from tokenizers import Tokenizer

        self.joins_space, self.end = joins_space, end
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        found = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special] if specials else []
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for _, t in found):
            raise ValueError("special tokens must match as they are written")
        self.special = {t.content: i for i, t in found}
        self.border = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 1
        self.ids[0] = self.end
        self.offsets, self.sizes, self.n_rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1
        self.sizes[0] = 1  # row 0 is the end id

    def _learn(self, parts: list[str]) -> None:
        tokenize, visible = self.model.tokenize, _visible()
        keys = parts
        if not self.joins_space:
            parts = [x.lower() if "Σ" not in x else "".join(c.lower() for c in x) for x in parts]
        found = [[t.id for t in tokenize(x.encode().decode("latin-1").translate(visible))] for x in parts]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_rows + len(found) > len(self.offsets):
            self.offsets, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.sizes))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        rows = slice(self.n_rows, self.n_rows + len(found))
        self.offsets[rows] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.known.update(zip(keys, range(self.n_rows, self.n_rows + len(found))))
        self.n_ids += len(flat)
        self.n_rows += len(found)

    def _starts(self, cp: np.ndarray, cls: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Where parts begin, as a mask; ``new`` marks the first code point of each text."""
        n = len(cp)
        b = new.copy()
        b[1:] |= cls[1:] != cls[:-1]
        same = np.zeros(n + 3, bool)  # the code point before it is of the same text
        same[1:n] = ~new[1:]
        space = cls == SPACE
        if self.joins_space:
            last = np.flatnonzero(space[:-1] & ~space[1:] & same[1:n])
            b[last] = True
            b[last[cp[last] == 32] + 1] = False
        else:
            b |= cls == NUMBER
        quote = np.flatnonzero((cp == 39) & b)
        quote = quote[(quote + 1 < n)]
        quote = quote[(cls[quote + 1] == LETTER) & same[quote + 1]]
        if len(quote):
            low = np.concatenate([cp, np.zeros(3, cp.dtype)])
            if not self.joins_space:
                low = np.where((low >= 65) & (low <= 90), low + 32, low)
            one = quote[np.isin(low[quote + 1], [ord(c) for c in "stmd"])]
            pair = low[quote + 1].astype(np.uint64) << np.uint64(21) | low[quote + 2]
            two = quote[np.isin(pair, [ord(a) << 21 | ord(c) for a, c in ("re", "ve", "ll")]) & same[quote + 2]]
            for at, size in ((one, 2), (two, 3)):
                b[at + 1] = False
                after = at + size
                b[after[after < n]] = True
        return b

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens) - lens
        n, passing = len(joined), None
        if n:
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            cls = _classes()[cp]
            new = np.zeros(n, bool)
            new[first[lens > 0]] = True
            starts = np.flatnonzero(self._starts(cp, cls, new))
            ends = np.append(starts[1:], n)
            if not self.joins_space:
                keep = cls[starts] != SPACE
                starts, ends = starts[keep], ends[keep]
            codes, at = _distinct(cp, starts, ends, joined)
            names = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            lacking = [x for x in names if x not in self.known]
            if len(self.known) + len(lacking) > KNOWN:
                passing = (lacking, self.n_ids, self.n_rows)
            if lacking:
                self._learn(lacking)
            rows = np.array([self.known[k] for k in names], np.int64)[codes]
        else:
            starts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the end id, row 0, after each text's last part
        after = np.searchsorted(starts, first + lens)
        rows = np.insert(rows, after, 0)
        sizes = self.sizes[rows]
        before = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.offsets[rows] - before, sizes) + np.arange(int(sizes.sum()))]
        if passing:  # the table is full of earlier parts, common ones among them: these go again
            for x in passing[0]:
                del self.known[x]
            self.n_ids, self.n_rows = passing[1:]
        upto = np.append(before, sizes.sum())[after + np.arange(1, len(texts) + 1)]
        return flat, np.diff(upto, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each text."""
        if not any(x in t for x in self.special for t in texts):
            return self._ordinary(texts)
        parts: list[str] = []
        owner: list[int] = []
        last: list[int] = []  # the id that ends each part: a special token's or the end id
        for i, t in enumerate(texts):
            cut = self.border.split(t)
            parts += cut[0::2]
            owner += [i] * len(cut[0::2])
            last += [*(self.special[x] for x in cut[1::2]), self.end]
        flat, n = self._ordinary(parts)
        flat = flat.copy()
        flat[np.cumsum(n) - 1] = last
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.array(owner), n)
        return flat, counts

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, counts = [], np.zeros(len(texts), np.int64)
        chunk: list[str] = []
        owner: list[int] = []
        odd: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            nonlocal chunk, owner, size
            if chunk:
                flat, n = self._chunk(chunk)
                # pieces of one text, if it was cut, lose all end ids but the last
                own = np.array(owner)
                inner = np.flatnonzero(own[:-1] == own[1:])
                if len(inner):
                    flat = np.delete(flat, np.cumsum(n)[inner] - 1)
                    n[inner] -= 1
                flats.append(flat)
                np.add.at(counts, own, n)
            chunk, owner, size = [], [], 0

        for i, t in enumerate(texts):
            if not self.joins_space and not t.isascii():
                newer = _unassigned()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any()
                if not newer and not unicodedata.is_normalized("NFC", t):
                    t = unicodedata.normalize("NFC", t)
                # the lower case of the dotted capital has a mark of another class: such texts are left to the library
                if newer or "İ" in t:
                    flush()
                    odd[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids + [self.end], np.uint32)
                    flats.append(odd[i])
                    counts[i] = len(odd[i])
                    continue
            if len(t) > 4 * CHUNK:
                flush()
                for p in _pieces(t):
                    chunk.append(p)
                    owner.append(i)
                flush()
                continue
            chunk.append(t)
            owner.append(i)
            size += len(t)
            if size >= CHUNK:
                flush()
        flush()
        return np.concatenate(flats) if flats else np.zeros(0, np.uint32), counts


def encoder(path: str, joins_space: bool, end: int = 0, specials: bool = False) -> Encoder:
    """The worker's own encoder: what it has learnt serves its later tasks too."""
    made = (path, joins_space, end, specials)
    return held(made, lambda: Encoder(*made))


def id_type(path: str) -> str:
    """The narrowest unsigned type that holds all ids of a tokenizer: uint16 or uint32."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
