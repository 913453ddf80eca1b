"""Token-id files: Simple-8b words, blocks with offsets, vectorised decoding.

A 64-bit word has a selector in its 4 high bits and as many ids as the selector's width lets in below
(60 of one bit down to 1 of 60 bits). Selector 0 is an escape: the word after it holds one raw 64-bit
number. A file is a magic string, the blocks' words, then an index: for each block the place of its
first word and of its first id, for each document its id and its number of ids, in ascending order of
the documents. Blocks hold whole documents, so that a document is read from its own block.

Defined results: a null text counts as empty and holds the end id alone; repeated rows and ids are
written each; rows without an id come first, and the file counts them; rows of equal ids are ordered by their
texts' hashes, so that many of them are dealt to several files; a table without rows writes no ids. Ids are
numbers of 64 bits at most: others raise. Only the id and the text are read, so that other columns can't clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, file_system, shared_dir

MAGIC = b"S8BTOK02"
#: Ids that one word holds and bits of each, by selector; selector 0 is the escape, 15 isn't used.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
#: Ids after which a block ends.
BLOCK_IDS = 1 << 16
#: Words' ids that a worker keeps; a full cache starts anew.
CACHE = 500_000


def pack(values: np.ndarray) -> np.ndarray:
    """values (unsigned 64-bit) as Simple-8b words; each word takes the most values that fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # near 2**60 one too high at most: then an escape
    widest = {1: bits}  # the bits of the widest of the next k values
    for k in sorted({int(c) for c in COUNTS if c}):
        if k > n:
            break
        if k not in widest:
            half = max(c for c in widest if c < k and k - c in widest)
            widest[k] = np.maximum(widest[half][: n - k + 1], widest[k - half][half : half + n - k + 1])
    selector = np.zeros(n, np.uint8)
    for s in range(14, 0, -1):  # the selector with most values is set last
        if (k := int(COUNTS[s])) <= n:
            fits = widest[k] <= WIDTHS[s]
            if fits.any():
                np.putmask(selector[: n - k + 1], fits, s)
    taken = selector.tobytes().translate(bytes([1, *COUNTS[1:15].tolist()]).ljust(256, b"\0"))
    heads, k = [], 0
    while k < n:
        heads.append(k)
        k += taken[k]
    at = np.array(heads)
    chosen = selector[at]
    escapes = chosen == 0
    spot = np.arange(len(at)) + np.concatenate(([0], np.cumsum(escapes)[:-1]))
    words = np.zeros(len(at) + int(escapes.sum()), np.uint64)
    words[spot] = chosen.astype(np.uint64) << np.uint64(60)
    words[spot[escapes] + 1] = values[at[escapes]]
    for s in range(1, 15):
        own = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s] if len(own) else 0):
            words[spot[own]] |= values[at[own] + j] << np.uint64(j * WIDTHS[s])
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words."""
    chosen = (words >> np.uint64(60)).astype(np.intp)
    if (chosen == 0).any() or (chosen == 15).any():  # a raw word may look like anything: walk from escape to escape
        raw, k = np.zeros(len(words), bool), 0
        zeros = np.flatnonzero(chosen == 0).tolist()
        for z in zeros:
            if z >= k:
                raw[z + 1] = True
                k = z + 2
        heads = ~raw
        escaped = np.flatnonzero(raw)
        words, chosen = words.copy(), chosen.copy()
        counts = np.where(raw, 1, COUNTS[chosen])
        if (chosen[heads] == 15).any():
            raise ValueError("not Simple-8b words")
    else:
        escaped, counts = np.empty(0, np.intp), COUNTS[chosen]
        heads = None
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero((chosen == s) & heads) if heads is not None else np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s] if len(own) else 0):
            out[starts[own] + j] = words[own] >> np.uint64(j * WIDTHS[s]) & mask
    out[starts[escaped]] = words[escaped]
    return out


#: The pieces of a word and the byte-level alphabet: fixed values of the tokenizer's file format.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Words(dict):
    """From a word between white space to its packed ids. Words tokenise apart: the tokenizer drops white space.

    Words of code points below 0x250 have one normal form and one lower case, so that their pieces go
    straight to the library's BPE model; all others, and those that may hold a special token, go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            line = piece if piece.isascii() else piece.encode().decode("latin-1").translate(ALPHABET)
            out = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(line)]).tobytes()
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if not word.isascii() and max(word) >= "\u0250" or "<|" in word:
            out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            low = word.lower()
            if low.isalpha():
                out = self.piece(low)
            elif low[-1] in ".," and low[:-1].isalpha():
                out = self.piece(low[:-1]) + self.piece(low[-1])
            else:
                out = b"".join(map(self.piece, PIECES.findall(low)))
        if len(word) <= 64:
            self[word] = out
        return out


@cache
def word_cache(path: str) -> Words:
    """One for each worker process."""
    return Words(path)


#: Python's str.split() cuts at these, which aren't white space everywhere.
CUTS = re.compile("[\x1c-\x1f]")


def encode_words(batch: Sequence[str], known: Words) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers, word by word through the cache."""
    get, whole = known.__getitem__, known.tokenizer.encode
    return [array("I", whole(text, add_special_tokens=False).ids).tobytes() if CUTS.search(text) else b"".join(map(get, text.split())) for text in batch]


class Writer:
    """One file, written block by block to a name of its own and then given its final name."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.final = f"{base}/_{name}.{attempt}", f"{base}/{name}"
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.docs: list[int] = []
        self.unnamed = 0  # documents without an id: the first ones
        self.sizes: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []  # first word, first id, first document
        self.words = self.ids = self.held = 0
        self.pending: list[bytes] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.unnamed += doc is None
        self.docs.append(doc or 0)
        self.sizes.append(len(ids) // 4)
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            self.blocks.append((self.words, self.ids, len(self.docs) - len(self.pending)))
            words = pack(np.frombuffer(b"".join(self.pending), "<u4"))
            self.out.write(words.astype("<u8").tobytes())
            self.words += len(words)
            self.ids += self.held
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.out.write(struct.pack("<QQQQ8s", len(self.blocks), len(self.docs), self.unnamed, self.words, MAGIC))
        self.out.close()
        self.fs.move(self.path, self.final)


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, whether they have one, numbers of ids, ids) of each block."""
    fs, base = file_system(path)
    with fs.open_input_file(base) as f:
        size = f.size()
        f.seek(size - 40)
        n_blocks, n_docs, unnamed, n_words, magic = struct.unpack("<QQQQ8s", f.read(40))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        f.seek(8 + 8 * n_words)
        blocks = np.frombuffer(f.read(24 * n_blocks), "<i8").reshape(-1, 3)
        docs = np.frombuffer(f.read(8 * n_docs), "<i8")
        sizes = np.frombuffer(f.read(8 * n_docs), "<i8")
        ends = np.append(blocks[1:, 0], n_words), np.append(blocks[1:, 2], n_docs)
        f.seek(8)
        for (word, _, doc), last_word, last_doc in zip(blocks.tolist(), *(x.tolist() for x in ends), strict=True):
            words = np.frombuffer(f.read(8 * (last_word - word)), "<u8")
            yield docs[doc:last_doc], np.arange(doc, last_doc) >= unnamed, sizes[doc:last_doc], unpack(words)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending order of id_col (null ids first; equal ids by the text's hash).

    One file for each range of ids. Returns a row for each file: `file`, `path`, `ids`, `docs`; the ids of
    file k come before those of file k + 1. A task that runs again replaces its own file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer, known, end = None, word_cache(tokenizer), struct.pack("<I", end_id)
        for b in batches:
            writer = writer or Writer(folder, f"tokens-{task.partitionId():06d}.s8b", task.taskAttemptId())
            texts = [x or "" for x in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encode_words(texts, known), strict=True):
                writer.add(doc, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": task.partitionId(), "path": f"{folder}/tokens-{task.partitionId():06d}.s8b", "ids": writer.ids, "docs": len(writer.docs)}])

    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    ordered = base.repartitionByRange("__id", "__hash").sortWithinPartitions("__id", "__hash", "__text").select("__id", "__text")
    return checkpointed(ordered.mapInArrow(write, "file long, path string, ids long, docs long"))


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each document in the files: id_col, `start` (ids of all documents before it), `n_tokens`, `ids_crc32` (unsigned, over little-endian 32-bit ids).

    files: what write_token_files returned; its rows (one for each file) are summed on the driver.
    """
    spark = files.sparkSession
    before, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.file):
        rows.append((r.path, before))
        before += r.ids
    if not rows:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, named, sizes, ids in read_file(path):
                    raw, cuts = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
                    crc = [zlib.crc32(raw[a:z]) for a, z in zip([0, *cuts], cuts)]
                    starts = at + np.cumsum(sizes) - sizes
                    at += len(ids)
                    own = pa.array(docs, pa.int64(), mask=~named)
                    yield pa.RecordBatch.from_arrays([own, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, before long").repartition(len(rows))
    return listed.mapInArrow(read, T.StructType([T.StructField(x, T.LongType()) for x in (id_col, "start", "n_tokens", "ids_crc32")]))


def token_folder(spark) -> str:
    return shared_dir(spark, "tokens")


