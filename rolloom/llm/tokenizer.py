"""Encoding of texts with a byte-level BPE vocabulary.

Pre-tokenisation is vectorised: all texts of a batch become one array of code points, a table maps them to character classes, and a
finite automaton over the classes marks the piece boundaries. The automaton isn't stepped character by character: each class is a
function from states to states, the functions generated by the classes form a small set closed under composition, and since composition
is associative the state before every character comes from a two-level scan over table look-ups. The pieces then go through pair merging,
whose results are cached by piece.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Character classes. SINGLE, VOWEL, PAIR, ELL: letters that contractions need ('s 't 'm 'd, 're 've, 'll).
LETTER, SINGLE, RV, ELL, E, NUMBER, BLANK, SPACE, QUOTE, OTHER, END = range(11)
# States: what the current piece is. FRESH: an apostrophe that began a piece; FRESH_RV, FRESH_ELL: one letter later; CLOSED: a contraction ended.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, AT_BLANK, AT_SPACE, FRESH, FRESH_RV, FRESH_ELL, CLOSED = range(10)
#: White space by the Unicode property, which str.isspace() exceeds by four control characters. Fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
HERE, BEFORE_LAST = 1, 2  # boundary before this character, boundary before the previous one


def _class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE] = SPACE
    table[0x20] = BLANK
    for letters, kind in (("stmd", SINGLE), ("rv", RV), ("l", ELL), ("e", E), ("'", QUOTE)):
        table[[ord(c) for c in letters]] = kind
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for (state, class)."""
    step, mark = np.zeros((10, 11), dtype=np.uint8), np.zeros((10, 11), dtype=np.uint8)
    letters = (LETTER, SINGLE, RV, ELL, E)
    for state in range(10):
        for kind in range(11):
            late = BEFORE_LAST if state in (FRESH_RV, FRESH_ELL) else 0  # no contraction after all: the letter was a piece's first
            base = IN_LETTERS if late else state
            if state == FRESH and kind == SINGLE or state == FRESH_RV and kind == E or state == FRESH_ELL and kind == ELL:
                step[state, kind], mark[state, kind] = CLOSED, 0
            elif state == FRESH and kind in (RV, ELL):
                step[state, kind], mark[state, kind] = (FRESH_RV if kind == RV else FRESH_ELL), 0
            elif kind == END:
                step[state, kind], mark[state, kind] = START, late
            elif kind in (BLANK, SPACE):
                step[state, kind] = AT_BLANK if kind == BLANK else AT_SPACE
                mark[state, kind] = late | (0 if base in (AT_BLANK, AT_SPACE) else HERE)
            else:
                target = IN_LETTERS if kind in letters else IN_NUMBER if kind == NUMBER else IN_OTHER
                same = base == target or base == FRESH and target == IN_OTHER
                if kind == QUOTE and base not in (IN_OTHER, FRESH, AT_BLANK):
                    target = FRESH
                step[state, kind] = target
                # after white space its last character is parted; a blank then leads the piece, another space stands alone
                mark[state, kind] = late | (BEFORE_LAST if base == AT_BLANK else BEFORE_LAST | HERE if base == AT_SPACE else 0 if same else HERE)
    return step, mark


class Scanner:
    """Piece boundaries of many texts at once."""

    BLOCK = 64

    def __init__(self) -> None:
        self.classes = _class_table()
        step, mark = _automaton()
        self.mark = mark.ravel()
        # the set of functions that the classes generate, and their composition table
        known = {tuple(range(10)): 0}
        functions = [tuple(range(10))]
        self.of_class = np.zeros(11, dtype=np.uint8)
        generators = []
        for kind in range(11):
            f = tuple(int(x) for x in step[:, kind])
            if f not in known:
                known[f] = len(functions)
                functions.append(f)
            self.of_class[kind] = known[f]
            generators.append(f)
        at = 0
        while at < len(functions):
            for g in generators:
                f = tuple(g[x] for x in functions[at])
                if f not in known:
                    known[f] = len(functions)
                    functions.append(f)
            at += 1
        if len(functions) > 256:
            raise AssertionError("composition table too large")
        n = len(functions)
        self.compose = np.zeros((n, n), dtype=np.uint8)  # compose[f, g]: f, then g
        for i, f in enumerate(functions):
            for j, g in enumerate(functions):
                self.compose[i, j] = known.setdefault(tuple(g[x] for x in f), 0)
        self.width = n
        self.from_start = np.array([f[START] for f in functions], dtype=np.uint8)
        self.flat = self.compose.ravel()

    def prefixes(self, fs: np.ndarray) -> np.ndarray:
        """Composition of all functions before each position: blocks side by side, then the blocks' totals, by the same scan."""
        n = len(fs)
        if n <= self.BLOCK:
            out, acc = np.zeros(n, dtype=np.uint8), 0
            for i in range(n):
                out[i] = acc
                acc = self.compose[acc, fs[i]]
            return out
        rows = -(-n // self.BLOCK)
        grid = np.zeros((self.BLOCK, rows), dtype=np.uint8)
        padded = np.zeros(rows * self.BLOCK, dtype=np.uint8)
        padded[:n] = fs
        grid[:] = padded.reshape(rows, self.BLOCK).T
        before = np.empty_like(grid)
        acc = np.zeros(rows, dtype=np.uint8)
        for i in range(self.BLOCK):
            before[i] = acc
            acc = self.flat[acc.astype(np.uint16) * self.width + grid[i]]
        lead = self.prefixes(acc)
        whole = self.flat[lead.astype(np.uint16)[None, :] * self.width + before]
        return whole.T.reshape(-1)[:n]

    def bounds(self, text: str) -> np.ndarray:
        """Starts of the pieces of `text`, in which texts end with the code point 0x10FFFF (a piece of its own)."""
        codes = _codes(text)
        kinds = self.classes[codes]
        stop = codes == 0x10FFFF
        kinds[stop] = END
        states = self.from_start[self.prefixes(self.of_class[kinds])]
        marks = self.mark[states.astype(np.uint8) * np.uint8(11) + kinds]
        starts = (marks & HERE).astype(bool)
        starts[:-1] |= (marks[1:] & BEFORE_LAST).astype(bool)
        starts |= stop
        starts[1:] |= stop[:-1]
        if len(starts):
            starts[0] = True
        return np.flatnonzero(starts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each piece: its characters as a polynomial, from sums over the whole text."""
    n = len(codes)
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 21, 2 * n)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    h = (sums[starts + sizes] - sums[starts]) * _powers[1][starts]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + sizes.astype(np.uint64)


@lru_cache(maxsize=2)
def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file, by the format's rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file; no special tokens, whose writings are ordinary text."""

    END_MARK = "\U0010ffff"

    def __init__(self, path: str = VOCABULARY, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        self.ids = ids
        self.bytes_of = {i: t for t, i in ids.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(back[c] for c in a), bytes(back[c] for c in b)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.cache: dict[str, tuple[int, ...]] = {}
        self.most = most
        self.scanner = Scanner()

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece: pairs merged by rank, the leftmost first among equals, in n log n steps."""
        at = [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(at)
        if n == 1:
            return tuple(at)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(m[0], i, at[i], at[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((at[i], at[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = right[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue
            at[i], at[j] = joined, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((joined, at[k])):
                    heapq.heappush(heap, (m[0], i, joined, at[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges.get((at[h], joined))):
                heapq.heappush(heap, (m[0], h, at[h], joined, m[1]))
        return tuple(x for x in at if x >= 0)

    def _known(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The cache, filled with these pieces; emptied first when it is full."""
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        for p in set(pieces).difference(cache):
            cache[p] = self.piece(p)
        return cache

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids. Null and empty texts have none."""
        given = ["" if t is None else t for t in texts]
        marked = [i for i, t in enumerate(given) if self.END_MARK in t]
        if marked:  # texts that hold the end mark themselves go by their parts
            return self._with_marked(given, marked)
        if not given:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        whole = self.END_MARK.join(given) + self.END_MARK
        starts, codes = self.scanner.bounds(whole), _codes(whole)
        sizes = np.diff(starts, append=len(codes))
        # equal pieces get one number; `first` is where each stands first
        _, first, number = np.unique(_hashes(codes, starts, sizes), return_index=True, return_inverse=True)
        gap = np.repeat(starts[first][number] - starts, sizes)
        same = codes == codes[np.arange(len(codes)) + gap] if np.array_equal(sizes, sizes[first][number]) else None
        if same is None or not same.all():  # two pieces share a hash
            return self._one_by_one(given)
        pieces = [whole[a:b] for a, b in zip(starts[first].tolist(), (starts + sizes)[first].tolist())]
        cache = self._known(pieces)
        cache[self.END_MARK] = ()
        found = [cache[p] for p in pieces]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pool = np.fromiter((x for f in found for x in f), dtype=np.int32)
        pool_at = np.cumsum(lengths) - lengths
        each = lengths[number]
        after = np.cumsum(each)
        flat = pool[np.repeat(pool_at[number] - (after - each), each) + np.arange(after[-1])]
        offsets = np.zeros(len(given) + 1, dtype=np.int64)
        offsets[1:] = after[codes[starts] == 0x10FFFF]
        return flat, offsets

    def _with_marked(self, texts: list[str], marked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        held = set(marked)
        rest, at = self.encode(["" if i in held else t for i, t in enumerate(texts)])
        own, own_at = self._one_by_one([texts[i] for i in marked])
        place = {i: k for k, i in enumerate(marked)}
        parts = [own[own_at[place[i]] : own_at[place[i] + 1]] if i in held else rest[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)], dtype=np.int64)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        for t in texts:
            # U+10FFFF is of class OTHER; a private character of the same class takes its place for the scan only
            codes = t.replace(self.END_MARK, "\U0010fffe")
            cuts = [int(x) for x in self.scanner.bounds(codes)] if t else []
            pieces = [t[a:b] for a, b in zip(cuts, [*cuts[1:], len(t)])]
            known = self._known(p for p in pieces if p != self.END_MARK)
            parts.append(np.array([x for p in pieces for x in (self.piece(p) if p == self.END_MARK else known[p])], dtype=np.int32))
        offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each id in the text's UTF-8 bytes."""
        ids, _ = self.encode([text])
        sizes = np.cumsum([0, *(len(self.bytes_of[int(i)]) for i in ids)])
        return list(zip(sizes[:-1].tolist(), sizes[1:].tolist()))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker process: read once, not for every task."""
    return Encoder(path)


def encode_table(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY, batch_chars: int = 1 << 20) -> DataFrame:
    """(id, ids ARRAY<INT>) for each row: the ids of its text by the vocabulary file `path`, which every executor must find there.

    Null and empty texts give an empty list; repeated rows come out as often as they come in; other columns are not read. Long texts are
    encoded whole; `batch_chars` bounds how many characters are scanned together, but for one text that is longer by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= batch_chars):
                    chars += len(texts[upto] or "")
                    upto += 1
                ids, offsets = encoder.encode(texts[at:upto])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([names.slice(at, upto - at), lists], names=[id_column, "ids"])
                at = upto

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def installed(path: str = VOCABULARY) -> bool:
    return os.path.exists(path)
