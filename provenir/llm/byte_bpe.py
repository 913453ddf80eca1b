"""Byte-level BPE encoding and decoding, with pre-tokenisation on arrays instead of a regular expression.

The texts of a batch become one array of code points; a table gives each its class (letter, number,
space, other white space, other), and neighbours refine it (an apostrophe before a contraction's
letters, white space before something else). Each refined symbol is a transition function of a small
automaton. Functions compose associatively, and the few that compositions can give are numbered, so
that a scan over table look-ups finds the state at each position, and states tell where tokens start.
The slices go through a cache to the pair merger; token lengths are retained as offsets for decoding.

Defined results: a null text counts as empty and has no tokens; every UTF-8 text decodes to itself; repeated
rows give the same ids, an empty table no rows. Only `keep` and the text are read, so that other columns can't
clash. Arrays of the scan cover SCAN code points, however long a text is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, field, held

#: Pieces that a worker keeps; a full cache starts anew.
CACHE = 300_000
#: Code points that one scan covers, so that memory is bounded.
SCAN = 1 << 20
#: Code points after a symbol's own that can decide it.
AHEAD = 2
#: Scans run over columns of so many positions.
COLUMN = 64

LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
# Symbols: what a character does, seen with its neighbours.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_PREFIX, S_LAST, S_BORDER = range(9)
# States: what the token over the character before is.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, PREFIXED, ONE_MORE, TWO_MORE = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this symbol."""
    if symbol == S_LETTER:
        if state in (ONE_MORE, TWO_MORE):  # letters of a contraction
            return (CLOSED, False) if state == ONE_MORE else (ONE_MORE, False)
        return IN_LETTERS, state not in (IN_LETTERS, PREFIXED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIXED)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if symbol == S_OTHER or state in (IN_OTHERS, PREFIXED):
            return IN_OTHERS, state not in (IN_OTHERS, PREFIXED)
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (PREFIXED if symbol == S_PREFIX else CLOSED), True


class Tables(NamedTuple):
    """256-byte tables for bytes.translate; two small numbers share a byte as high * 16 + low."""

    function: bytes  # of a symbol
    compose: bytes  # of the first function and the second
    state: bytes  # of a function, applied to CLOSED
    start: bytes  # 1 where a token starts: of the state before and the symbol


@cache
def tables() -> Tables:
    states, symbols = range(8), range(9)
    numbered = {tuple(states): 0}  # the identity is number 0
    own = [numbered.setdefault(tuple(step(q, s)[0] for q in states), len(numbered)) for s in symbols]
    todo = list(numbered)
    while todo:
        f = todo.pop()
        for g in list(numbered):
            for h in (tuple(g[q] for q in f), tuple(f[q] for q in g)):
                if h not in numbered:
                    numbered[h] = len(numbered)
                    todo.append(h)
    functions = list(numbered)
    assert len(functions) <= 16

    def packed(of, high, low) -> bytes:
        out = bytearray(256)
        for a, x in enumerate(high):
            for b, y in enumerate(low):
                out[a * 16 + b] = of(x, y)
        return bytes(out)

    return Tables(
        bytes(own).ljust(256, b"\0"),
        packed(lambda f, g: numbered[tuple(g[q] for q in f)], functions, functions),
        bytes(f[CLOSED] for f in functions).ljust(256, b"\0"),
        packed(lambda q, s: step(q, s)[1], states, symbols),
    )


def look_up(numbers: np.ndarray, table: bytes) -> np.ndarray:
    """table[numbers] for an array of bytes."""
    return np.frombuffer(numbers.tobytes().translate(table), np.uint8).reshape(numbers.shape)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), np.uint32)] = kind
    out[32] = SPACE
    return out


def scan(elements: np.ndarray) -> np.ndarray:
    """The composition of all elements before each one (exclusive scan over function numbers)."""
    compose = tables().compose
    n = len(elements)
    if n <= COLUMN:
        out, f = np.empty(n, np.uint8), 0
        for k, e in enumerate(elements.tolist()):
            out[k] = f
            f = compose[f << 4 | e]
        return out
    rows = -(-n // COLUMN)
    grid = np.zeros(rows * COLUMN, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, COLUMN).T)
    before = np.empty_like(grid)
    f = np.zeros(rows, np.uint8)
    for k in range(COLUMN):
        before[k] = f
        f = look_up(f << 4 | grid[k], compose)
    return look_up((scan(f) << 4)[None, :] | before, compose).T.reshape(-1)[:n]


def token_starts(points: np.ndarray, borders: np.ndarray, n: int, carry: int) -> tuple[np.ndarray, int]:
    """Where tokens start in the first n of an array of code points, and the function of all up to there.

    borders: places of separators, each alone between texts; carry: the function of what is before; what
    follows the first n (AHEAD, or nothing at the end) is only looked at.
    """
    table = tables()
    kind = classes()[points]
    symbol = look_up(kind, bytes([S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER]).ljust(256, b"\0")).copy()
    spaces = np.flatnonzero((kind == SPACE) | (kind == WHITE))
    solid = np.ones(len(points) + 1, bool)
    solid[spaces] = solid[borders] = solid[-1] = False
    spaces = spaces[solid[spaces + 1]]
    symbol[spaces] = np.where(kind[spaces] == SPACE, S_PREFIX, S_LAST)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        p1, p2 = (np.where(marks + k < len(points), points[np.minimum(marks + k, len(points) - 1)], 0) for k in (1, 2))
        symbol[marks[np.isin(p1, [ord(c) for c in "stmd"])]] = S_SHORT
        e_or_l = ((p1 == ord("r")) | (p1 == ord("v"))) & (p2 == ord("e")) | (p1 == ord("l")) & (p2 == ord("l"))
        symbol[marks[e_or_l]] = S_LONG
    symbol[borders] = S_BORDER
    symbol = symbol[:n]
    function = look_up(symbol, table.function)
    before = look_up(scan(function) | carry << 4, table.compose)
    if len(before):
        carry = table.compose[int(before[-1]) << 4 | int(function[-1])]
    return np.flatnonzero(look_up(look_up(before, table.state) << 4 | symbol, table.start)), carry


def all_starts(line: str, borders: np.ndarray) -> np.ndarray:
    """Where tokens start in a line of any length, SCAN code points at a time; the composition of all functions before is carried on."""
    out, carry = [], 0
    for k in range(0, len(line), SCAN):
        points = np.frombuffer(line[k : k + SCAN + AHEAD].encode("utf-32-le"), np.uint32)
        own = borders[np.searchsorted(borders, k) : np.searchsorted(borders, k + len(points))] - k
        at, carry = token_starts(points, own, min(SCAN, len(line) - k), carry)
        out.append(at + k)
    return np.concatenate(out)


def pre_tokenize(batch: Sequence[str]) -> list[list[str]]:
    """The pieces of each text."""
    out: list[list[str]] = []
    k = 0
    while k < len(batch):
        j, size = k, 0
        while j < len(batch) and (j == k or size + len(batch[j]) < SCAN):
            size += len(batch[j]) + 1
            j += 1
        line = "\n".join(batch[k:j]) + "\n"
        lengths = np.fromiter(map(len, batch[k:j]), np.int64, j - k)
        borders = np.cumsum(lengths + 1) - 1
        at = all_starts(line, borders)
        bounds = at.tolist()
        pieces = [line[a:b] for a, b in zip(bounds, bounds[1:])]
        places = np.searchsorted(at, borders).tolist()  # a border is a token of its own
        first = 0
        for p in places:
            out.append(pieces[first:p])
            first = p + 1
        k = j
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the adjacent pair of the lowest rank is merged first, the leftmost of equals. Long pieces keep their pairs in a heap."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 48:
        cuts = list(range(n + 1))
        far = len(ranks) + 1
        pair = [ranks.get(piece[k : k + 2], far) for k in range(n - 1)]
        while pair and (low := min(pair)) < far:
            k = pair.index(low)
            del cuts[k + 1], pair[k]
            if k < len(pair):
                pair[k] = ranks.get(piece[cuts[k] : cuts[k + 2]], far)
            if k:
                pair[k - 1] = ranks.get(piece[cuts[k - 1] : cuts[k + 1]], far)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]
    after, before = list(range(1, n + 2)), list(range(-1, n))  # ends of the parts that start at k, starts of those before
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, k, end = heapq.heappop(heap)
        if not alive[k] or after[k] >= n or after[after[k]] != end:
            continue
        alive[after[k]] = False
        after[k] = end
        if end < n:
            before[end] = k
            if (r := ranks.get(piece[k : after[end]])) is not None:
                heapq.heappush(heap, (r, k, after[end]))
        if k and (r := ranks.get(piece[before[k] : end])) is not None:
            heapq.heappush(heap, (r, before[k], end))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : after[k]]])
        k = after[k]
    return out


class Pieces(dict):
    """From a piece to its ids, packed as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        packed = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pieces = Pieces(self.ranks)
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, k in self.ranks.items():
            self.tokens[k] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int32)

    def encode(self, batch: Sequence[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        get = self.pieces.__getitem__
        return [b"".join(map(get, pieces)) for pieces in pre_tokenize(batch)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the decoded bytes."""
        ends = np.cumsum(self.lengths[ids], dtype=np.int64)
        return np.concatenate(([0], ends[:-1])) if len(ids) else ends

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode_span(self, packed: bytes, start: int, end: int) -> bytes:
        """Bytes start to end of the decoded text, from the tokens that hold them alone."""
        ids = np.frombuffer(packed, "<u4")
        at = self.offsets(ids)
        a, b = max(0, int(np.searchsorted(at, start, "right")) - 1), int(np.searchsorted(at, end, "left"))
        return self.decode(ids[a:b].tobytes())[start - int(at[a]) :][: end - start] if a < b else b""


def codec(path: str) -> Codec:
    """One for each worker process."""
    return held(("byte_bpe", path), lambda: Codec(path))


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), ids: bool = True, offsets: bool = False) -> DataFrame:
    """`keep`, `n_tokens`, `ids_sha256` (of the packed ids), `decoded_sha256` and `exact` (the decoded bytes are the text's).

    With ids, `ids` holds the packed little-endian 32-bit ids; with offsets, `offsets` the byte at
    which each token starts. path: a tiktoken rank file that executors can read.
    """
    fields = [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()), field("decoded_sha256", T.StringType()), field("exact", T.BooleanType())]
    fields += [field("ids", T.BinaryType())] * ids + [field("offsets", T.ArrayType(T.LongType()))] * offsets

    def start():
        own = codec(path)

        def compute(column: pa.Array) -> list[pa.Array]:
            batch = [x or "" for x in column.to_pylist()]
            packed = own.encode(batch)
            n, sha, back_sha, exact = [], [], [], []
            for text, p in zip(batch, packed, strict=True):
                back = own.decode(p)
                n.append(len(p) // 4)
                sha.append(hashlib.sha256(p).hexdigest())
                back_sha.append(hashlib.sha256(back).hexdigest())
                exact.append(back == text.encode())
            out = [pa.array(n, pa.int64()), pa.array(sha), pa.array(back_sha), pa.array(exact)]
            if ids:
                out.append(pa.array(packed, pa.binary()))
            if offsets:
                out.append(pa.array([own.offsets(np.frombuffer(p, "<u4")) for p in packed], pa.list_(pa.int64())))
            return out

        return compute

    return append_columns(docs, [text_col], list(keep), fields, start)
