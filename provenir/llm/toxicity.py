"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

A character language model (trigrams of letters and word borders) is counted over all documents. A
text is a lattice: a look-alike sign may stand for its letters, a run of one sign for one or two of
it, a joint inside a word or a space inside a run of short pieces for a word border or for nothing, and a
sign at a word's end for nothing. All these are places of one lattice, which is cut at the spaces that
can only be borders. The Viterbi paths of the highest probability under channel and language model
(PATHS of them, since a sign like 1 or * leaves several good readings) restore each part; a part without an
alternative is its own path. Restored words and their beginnings
are looked up among markers learned from labelled rows, and a logistic layer over a document's markers
gives the score.

Learning reads a bounded sample of the labelled rows (TRAIN_ROWS, the rows whose id hashes lowest);
language-model counts and scores cover every row and whole texts, in time that is linear in their length.
Sums don't depend on any order, so that the same tables give the same scores.

Defined results: a null text counts as empty, and a text without markers gets the layer's score for
none; repeated rows are scored alike, an empty table gives no rows, and without labelled rows every
score is 0.5; ids, labels, lang and source are never features. Only `keep` and the text are read, so that
other columns can't clash; a column in keep must not be called as `out`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, field, held, labelled_sample

TRAIN_ROWS = 6000
#: Words that a worker keeps; a full cache starts anew.
CACHE = 300_000
#: Likeliest readings of a part that count.
PATHS = 6
#: Lengths of word beginnings that can be markers.
BEGINNINGS = (4, 5, 6, 7)
#: A marker's least number of toxic rows, least share of them among its rows, and least G statistic.
LEAST_ROWS, LEAST_SHARE, LEAST_G = 4, 0.75, 18.0
HASHED = 1 << 22

#: What a sign may stand for: fixed values of the channel.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "µ": "u",
    "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BORDER, REST = 26, 27  # word border, any other letter
SIZE = 28
SIGNS = re.escape("".join(LOOKALIKES))
#: What surrounds a word and never stands for a letter.
AROUND = ".,;:?\"')[]}>`´’“”«»¿¡…_~-=/\\"
#: Look-alike signs that often are punctuation or joints instead.
OUTSIDE = frozenset("!|+({<*#%&")
#: Costs in the channel: one of two readings of a repeated sign, a sign instead of a letter, a joint or gap, a sign at a word's end that is none or that is a digit, a star between letters.
REPEATED, INSTEAD, JOINT, OUTER, OUTER_DIGIT, STAR = 0.7, 0.5, 0.3, 0.5, 1.5, 1.2
#: What gives a part more than one path.
ODD = re.compile(rf"[{SIGNS}]|([^\W\d_])\1|[^\W\d_][._*~-]+[^\W\d_]")
#: A lattice's places: a repeated letter, look-alike signs, joints and spaces, other letters.
PLACE = re.compile(rf"(?P<twice>([^\W\d_])\2+)|(?P<sign>([{SIGNS}])\4*)|(?P<plain>(?:(?![{SIGNS}])([^\W\d_])(?!\6))+)|(?P<joint>(?:(?![{SIGNS}])[\W\d_])+)", re.S)
#: Short pieces with spaces between them: at least three, of one or two signs.
PIECE = rf"(?:[^\W\d_]|[{SIGNS}]){{1,2}}"
PIECES = re.compile(rf"(?<!\S)(?:{PIECE}[ \t\n]++){{2,}}{PIECE}(?!\S)")
SINGLE = re.compile(r"(?<!\S)\S(?!\S)")


@cache
def letter_classes() -> np.ndarray:
    out = np.full(0x110000, BORDER, np.uint8)
    for k in range(0x110000):
        if not 0xD800 <= k < 0xE000 and chr(k).isalpha():
            out[k] = REST
    for k, c in enumerate(LETTERS):
        out[ord(c)] = out[ord(c.upper())] = k
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each three letter classes follow each other in all texts: SIZE ** 3 numbers, summed on the executors."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            line = " \n".join(x or "" for x in b.column(0).to_pylist())
            for k in range(0, len(line), 1 << 21):
                x = letter_classes()[np.frombuffer(f" {line[max(0, k - 2) : k + (1 << 21)]}".encode("utf-32-le"), np.uint32)].astype(np.int32)
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["cell", "n"])

    counts = np.zeros(SIZE**3, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    return counts


class Speller:
    """Restores a part of a text by Viterbi decoding over its lattice."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        low = c.sum(0)  # pairs back up what triples haven't seen
        pair = (low + 0.05) / (low.sum(1, keepdims=True) + 0.05 * SIZE)
        self.cost = (-np.log((c + 4.0 * pair[None]) / (c.sum(2, keepdims=True) + 4.0))).reshape(-1).tolist()

    def lattice(self, part: str, joined: str = "") -> Iterator[list[tuple[str, float]]]:
        """The places of a lower-case part, each with what it may stand for and the cost of that in the channel; a space is a border.

        joined: "all" leaves no border inside, "singles" one at each space but those between single signs.
        """
        n = len(part)
        for m in PLACE.finditer(part):
            if m["plain"]:
                yield [(m[0], 0.0)]
            elif m["joint"]:
                a, b = m.span()
                alone = (a < 2 or part[a - 2] == " ") and (b > n - 2 or part[b + 1] == " ")
                if not 0 < a or b == n or joined == "all" or joined == "singles" and (alone or m[0] != " "):
                    yield [("", JOINT)]
                else:
                    yield [("", JOINT), (" ", JOINT)] if not joined else [(" ", JOINT)]
            elif m["twice"]:
                yield [(m[0][0], REPEATED), (m[0][0] * 2, REPEATED)]
            else:
                sign, stands = m[0][0], LOOKALIKES[m[0][0]]
                own = math.log(len(stands)) + INSTEAD
                out = [(x, own) for x in stands] if len(m[0]) == 1 else [(x * k, own + REPEATED) for x in stands for k in (1, 2)]
                if m.start() == 0 or m.end() == n or part[m.start() - 1] == " " or part[m.end()] == " ":
                    out.append(("", OUTER if sign in OUTSIDE else OUTER_DIGIT))
                elif sign == "*":
                    out.append(("", STAR))
                yield out

    def decode(self, places: Iterator[list[tuple[str, float]]]) -> list[str]:
        """The PATHS likeliest paths, the likeliest first. A state keeps as many, so that time and memory are linear."""
        cost = self.cost
        best: dict[int, list[tuple[float, tuple | None]]] = {BORDER * SIZE + BORDER: [(0.0, None)]}  # by the last two signs: costs and paths back
        for place in places:
            now: dict[int, list[tuple[float, tuple | None]]] = {}
            for state, known in best.items():
                for letters, channel in place:
                    step, at = channel, state
                    for c in letters[:2] if len(place) == 1 else letters:  # where there is no choice, more signs change nothing
                        k = BORDER if c == " " else ord(c) - 97 if "a" <= c <= "z" else REST
                        step += cost[at * SIZE + k]
                        at = at % SIZE * SIZE + k
                    if len(place) == 1 and len(letters) > 2:
                        p, q = (BORDER if c == " " else ord(c) - 97 if "a" <= c <= "z" else REST for c in letters[-2:])
                        at = p * SIZE + q
                    own = now.setdefault(at, [])
                    own += [(before + step, (path, letters) if letters else path) for before, path in known]
            for own in now.values():
                if len(own) > 1:
                    own.sort(key=COST)  # stable, so that equal costs stay in one order
                    del own[PATHS:]
            best = now
        ended = [(total + cost[at * SIZE + BORDER], path) for at, own in best.items() for total, path in own]
        return list(dict.fromkeys(unwound(path) for _, path in sorted(ended, key=COST)[:PATHS]))

    def readings(self, part: str) -> list[str]:
        """The words of a lower-case part: of its likeliest paths, of the likeliest ones that join single signs and nothing else, and of the likeliest ones without borders."""
        if part.isalpha() and not ODD.search(part):
            return [part]
        core = part.strip(AROUND)  # no sign that may stand for a letter
        if not any(map(str.isalpha, core)):
            return [core] if core else []
        if not ODD.search(core) and " " not in core:
            return [core]
        found = self.decode(self.lattice(core))
        if any(" " in x for x in found):
            found += self.decode(self.lattice(core, "singles")) + self.decode(self.lattice(core, "all"))
        return list(dict.fromkeys(w for x in found for w in x.split()))


COST = itemgetter(0)


def unwound(path: tuple | None) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def parts(text: str) -> Iterator[str]:
    """The distinct parts that a text's lattice is cut to: its words, and its runs of short pieces that spaces part."""
    low = text.lower()
    yield from dict.fromkeys(low.split())
    yield from dict.fromkeys(" ".join(m[0].split()) for m in PIECES.finditer(low) if SINGLE.search(m[0]))


def beginnings(word: str) -> list[str]:
    """The features of a word: itself, and its first letters."""
    return [word] + [word[:n] + "+" for n in BEGINNINGS if len(word) > n]


#: What parts may hold inside that can be a border, and the letters that a part starts with.
JOINED = re.compile(rf"(?![{SIGNS}])[\W\d_]")
LEAD = re.compile(rf"(?:(?![{SIGNS}])[^\W\d_])*")
#: Letters of a skeleton that are compared.
SKELETON = 3


def skeleton(letters: str) -> str:
    """The first letters, each run of one letter as one."""
    out = ""
    for c in letters:
        if not out or out[-1] != c:
            out += c
            if len(out) == SKELETON:
                break
    return out


class Detector(NamedTuple):
    counts: np.ndarray  # of the language model
    markers: dict[str, float]
    layer: tuple[float, ...]

    def weight(self, word: str) -> float:
        return max((self.markers.get(f, 0.0) for f in beginnings(word)), default=0.0)


class Weights(dict):
    """From a part as written to the highest marker weight of its readings."""

    def __init__(self, own: Detector):
        self.own, self.speller = own, Speller(own.counts)
        self.starts = {x[:n] for m in own.markers for x in [skeleton(m.rstrip("+"))] for n in range(1, len(x) + 1)}
        self.short = {x for m in own.markers for x in [skeleton(m.rstrip("+"))] if len(x) < SKELETON}

    def may_hold(self, part: str) -> bool:
        """False if no reading can be a marker or begin with one: readings repeat letters or don't, and keep those that a part starts with."""
        core = part.strip(AROUND)
        if not core or JOINED.search(core):
            return bool(core)
        lead = skeleton(LEAD.match(core)[0])
        return not lead or lead in self.starts or any(lead.startswith(x) for x in self.short)

    def __missing__(self, part: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        out = max(map(self.own.weight, self.speller.readings(part)), default=0.0) if self.may_hold(part) else 0.0
        if len(part) <= 64:
            self[part] = out
        return out


def evidence(text: str, weights: Weights) -> tuple[float, float]:
    """(highest marker weight, logarithm of 1 + sum of the weights) of a text's parts."""
    found = [w for w in map(weights.__getitem__, parts(text)) if w > 0]
    return (max(found), math.log1p(math.fsum(found))) if found else (0.0, 0.0)


def learn_markers(texts: Sequence[str], labels: Sequence[int], speller: Speller, known: dict[str, list[str]]) -> dict[str, float]:
    """Features of toxic rows with their log-odds. Counts are hashed first, so that memory is bounded. known: readings so far."""
    cells = np.zeros((2, HASHED), np.int32)

    def spell(part: str) -> list[str]:
        if part not in known:
            if len(known) >= CACHE:
                known.clear()
            known[part] = speller.readings(part)
        return known[part]

    def features(text: str) -> dict[str, None]:
        """In an order that is the same in every run."""
        return dict.fromkeys(f for p in parts(text) for w in spell(p) for f in beginnings(w))

    rows = [sum(1 for y in labels if y == k) for k in (0, 1)]
    for text, y in zip(texts, labels, strict=True):
        ids = np.fromiter({zlib.crc32(f.encode()) % HASHED for f in features(text)}, np.int64)
        cells[y, ids] += 1
    out: dict[str, float] = {}
    for text, y in zip(texts, labels, strict=True):
        if y:
            for f in features(text):
                if f not in out:
                    n0, n1 = (int(cells[k, zlib.crc32(f.encode()) % HASHED]) for k in (0, 1))
                    if n1 >= LEAST_ROWS and n1 >= LEAST_SHARE * (n0 + n1):
                        p, p1, p0 = (n0 + n1) / sum(rows), (n1 + 0.5) / (rows[1] + 1), (n0 + 0.5) / (rows[0] + 1)
                        g = 2 * (n1 * math.log(n1 / (rows[1] * p)) + (n0 * math.log(n0 / (rows[0] * p)) if n0 else 0))
                        if g >= LEAST_G:
                            out[f] = math.log(p1 / p0)
    return out


def train(texts: Sequence[str], labels: Sequence[int], counts: np.ndarray) -> Detector:
    """Markers of all rows; the layer is fitted on every fourth row, with markers of the others."""
    speller, known = Speller(counts), {}
    held = [k for k in range(len(texts)) if k % 4 == 0]
    rest = [k for k in range(len(texts)) if k % 4]
    part = Detector(counts, learn_markers([texts[k] for k in rest], [labels[k] for k in rest], speller, known), (0.0, 0.0, 0.0))
    weigh = Weights(part)
    x = np.array([(1.0, *evidence(texts[k], weigh)) for k in held]).reshape(-1, 3)
    y = np.array([labels[k] for k in held], float)
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([0.01, 0.05, 0.05])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return Detector(counts, learn_markers(texts, labels, speller, known), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Detector:
    """Language model of all docs; markers and layer of at most `rows` labelled rows."""
    return train(*labelled_sample(docs, labels, id_col, text_col, label_col, rows), trigram_counts(docs, text_col))


def score_texts(docs: DataFrame, detector: Detector, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """`keep` and the probability of label 1 for each row."""
    sent = docs.sparkSession.sparkContext.broadcast((detector.counts.tobytes(), tuple(sorted(detector.markers.items())), detector.layer))  # bounded by SIZE ** 3 and the sample's markers

    def start():
        raw, markers, layer = sent.value
        known = held(("toxicity", sent.value), lambda: Weights(Detector(np.frombuffer(raw, np.int64), dict(markers), layer)))
        b, *w = known.own.layer

        def compute(column: pa.Array) -> list[pa.Array]:
            z = (b + sum(p * q for p, q in zip(w, evidence(x or "", known), strict=True)) for x in column.to_pylist())
            return [pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())]

        return compute

    return append_columns(docs, [text_col], list(keep), [field(out, T.DoubleType())], start)
