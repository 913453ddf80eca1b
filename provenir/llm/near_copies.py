"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash (see simhash): fingerprints of the same shingles are dealt by vantage points and searched
by trees, and texts whose fingerprints differ by at most RADIUS bits are compared by their exact sets.
Texts of a similarity of 0.8 can differ by more bits (by 13 at sf0.1), so that a further path follows for
what the fingerprints leave apart: texts that agree in one of BANDS bands of ROWS minima under
permutations; a pair of similarity 0.8 meets in none with a probability of (1 - 0.8 ** ROWS) ** BANDS,
3e-7. Each candidate is compared by its exact sets there too. Texts of equal sets are one node from the
start. A band whose members are in one component already is left out; each other band's members are
first compared with one of them, the one that meets most others over all bands (of a group of changed
copies, what they were made of), so that a large group becomes one component without all of its pairs.
Where a band's members are still in several components, its sets are compared in blocks of bounded size, each
pair of blocks in one task; only links that connect components come out of a block, never all pairs.

Defined results: texts without words are copies of each other, null ones among them; a text of fewer
words than a shingle is one shingle. Words are as for SimHash. Repeated rows and ids come out as often as
they went in, an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, checkpointed, field, fits, sized, split_join
from .decontaminate import bitmap
from .simhash import RADIUS, SEED, components, fingerprint, shard_links

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 50, 6
CHUNK = 2048
#: Bytes of sets that one block of a band holds.
BLOCK_BYTES = 16 << 20


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    pieces = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def bands(own: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each band's minima, the band's number among them."""
    if not len(own):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), CHUNK):
        np.minimum(low, ((own[None, k : k + CHUNK] ^ drawn[1]) * drawn[0]).min(1), out=low)
    digest = (xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS)))
    return np.fromiter(digest, np.uint64, BANDS).view(np.int64)


def sketches(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """`keep`, `s` (a hash of the shingle set), `n` (its size), `fp` (the fingerprint) and `bands` for each row."""

    def start():
        drawn = permutations()

        def compute(column: pa.Array) -> list[pa.Array]:
            sets = [shingle_set(x or "") for x in column.to_pylist()]
            s = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            fps = np.array([fingerprint(x or "", SHINGLE) for x in column.to_pylist()], np.uint64).view(np.int64)
            return [pa.array(s), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), pa.array([bands(x, drawn) for x in sets], pa.list_(pa.int64()))]

        return compute

    return append_columns(docs, [text_col], keep, [field("s", T.LongType()), field("n", T.IntegerType()), field("fp", T.LongType()), field("bands", T.ArrayType(T.LongType()))], start)


def shingle_sets(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """`keep` and `own`, the shingle set, for each row."""

    def start():
        return lambda column: [pa.array([shingle_set(x or "").view(np.int64) for x in column.to_pylist()], pa.list_(pa.int64()))]

    return append_columns(docs, [text_col], keep, [field("own", T.ArrayType(T.LongType()))], start)


def alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def sets_of(wanted: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """`s` and `own` (the shingle set) for each of the wanted `s`. texts: `h` and `t`; named: `s` and the `h` of one text that has its set."""
    known = checkpointed(wanted.select("s").distinct().join(named.select("s", "h"), "s"))
    found = texts.join(F.broadcast(known), "h") if fits(known) else texts.where(bitmap(known)).join(known, "h")
    return checkpointed(shingle_sets(found.dropDuplicates(["s"]), ["s"], "t"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """Those of the pairs (`a`, `b`) that are similar."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("s")), texts, named)
    joined = pairs.join(sets.select(F.col("s").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("own").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - F.col("i")
    return checkpointed(joined.withColumn("i", both).where(F.col("i") * SIMILAR[1] >= whole * SIMILAR[0]).select("a", "b"))


def fingerprint_links(named: DataFrame, texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`a`, `b`: similar sets whose texts' fingerprints differ by `radius` bits at most. named: `s`, `n`, `fp` and `h`.

    One set of each fingerprint stands for it in the search; the others of the same fingerprint are compared with that one.
    """
    lead = checkpointed(named.groupBy("fp").agg(F.max(F.struct("n", "s")).alias("l"), F.count("*").alias("c")).select("fp", F.col("l.s").alias("s2"), F.col("l.n").alias("n2"), "c"))
    same = split_join(named.select("fp", "s", "n"), lead.where("c > 1"), "fp", "c", named.count()).where("s <> s2").select("s", "n", "s2", "n2")
    found = checkpointed(shard_links(lead.select("fp"), radius, via=True))
    total = found.count()

    def ends(end: str, s: str, n: str) -> DataFrame:
        """What stands for the fingerprints at one end; one of them may have found many."""
        own = lead.select(F.col("fp").alias(end), F.col("s2").alias(s), F.col("n2").alias(n))
        return checkpointed(found.groupBy(end).agg(F.count("*").alias("c")).join(own, end))

    across = split_join(split_join(found, ends("a", "s", "n"), "a", "c", total), ends("b", "s2", "n2"), "b", "c", total).select("s", "n", "s2", "n2")
    near = same.union(across).where(alike(F.col("n"), F.col("n2")))
    return similar_pairs(checkpointed(near.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()), texts, named)


def apart_bands(entries: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """`band`, `s`, `n`, `root` and `met` (members of the band): the entries of bands whose members are in several components."""
    now = checkpointed(entries.select("band", "s", "n").join(roots, "s", "left").select("band", "s", "n", F.coalesce("root", "s").alias("root")))
    several = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("band", "c", F.col("c").alias("met"))
    return checkpointed(split_join(now, checkpointed(several), "band", "c", total))


def block_links(nodes: np.ndarray, roots: np.ndarray, blocks: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of pairs that are similar and connect the components that roots tell; of two blocks, pairs between them alone."""
    _, label = np.unique(roots, return_inverse=True)
    _, ranks = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(flat) + 1, bool)
    across = blocks.min() != blocks.max()
    largest = np.bincount(label).argmax()
    for k in np.flatnonzero(label != largest).tolist():
        other = label != label[k]
        if across:
            other &= blocks != blocks[k]
        other &= (np.minimum(sizes, sizes[k]) * SIMILAR[1] >= np.maximum(sizes, sizes[k]) * SIMILAR[0])
        if not other.any():
            continue
        own = ranks[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        both = np.add.reduceat(mark[ranks], starts, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(other & (both * SIMILAR[1] >= (sizes + sizes[k] - both) * SIMILAR[0])).tolist():
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
                yield k, j


def search_bands(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """`a`, `b`: links of bands whose members (`band`, `s`, `n`, `root`) are in several components. sets: `s` and `own`.

    A band of more than BLOCK_BYTES is cut into blocks by s; each member goes to all pairs of its block
    with another. Shingles count by 32 bits of their hashes here, so that links are still to be verified.
    """
    bounded_batches(apart.sparkSession)
    size = checkpointed(apart.groupBy("band").agg(F.ceil(F.sum(F.col("n") * 4) / BLOCK_BYTES).cast("int").alias("k"), F.count("*").alias("c")))
    placed = split_join(apart, size, "band", "c", apart.count()).withColumn("block", F.pmod(F.xxhash64("s"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi")))
    dealt = placed.select("band", "s", "root", "block", F.explode(others).alias("pair")).select("s", "root", "block", F.xxhash64("band", "pair.lo", "pair.hi").alias("key"))
    short = sets.select("s", F.transform("own", lambda x: F.shiftrightunsigned(x, 33).cast("int")).alias("own"))
    rows = dealt.join(sized(short), "s").select("key", "s", "root", "block", "own").repartition("key").sortWithinPartitions("key")

    def links(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(own).combine_chunks()
        s, lists = t["s"].to_numpy(), pa.concat_arrays(t["own"].chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        pairs = list(block_links(s, t["root"].to_numpy(), t["block"].to_numpy(), lists.flatten().to_numpy(), sizes))
        if pairs:
            k, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(s[k]), pa.array(s[j])], names=["x", "y"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come sorted by key; a key's rows are gathered, two blocks at most."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and held[0].column("key")[0].as_py() != keys[a]:
                        yield from links(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from links(held)

    found = rows.mapInArrow(search, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, `h` (XXH64 of the text, null as empty) and `root` (the same number for all rows of a component), for each row."""
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = checkpointed(sketches(texts, [id_col, "h"], "t"))
    texts = texts.select("h", "t")
    named = checkpointed(rows.groupBy("s").agg(F.min(F.struct("h", "n", "fp")).alias("l"), F.count("*").alias("c")).select("s", "l.h", "l.n", "l.fp", "c"))
    close = fingerprint_links(named, texts)
    roots = components(close).withColumnRenamed("node", "s")
    dealt = checkpointed(rows.select("s", "n", "bands").dropDuplicates(["s"])).select("s", "n", F.explode("bands").alias("band"))
    crowded = checkpointed(dealt.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    entries = checkpointed(split_join(dealt, crowded, "band", "c", BANDS * named.count()))
    total = entries.count()
    left = apart_bands(entries, roots, total)
    busy = left.groupBy("s").agg(F.sum("met").alias("score"))
    scored = checkpointed(left.join(busy, "s").select("band", "s", "n", "root", "score"))
    lead = scored.groupBy("band").agg(F.max(F.struct("score", "s", "n", "root")).alias("l"), F.count("*").alias("c")).select("band", F.col("l.s").alias("s2"), F.col("l.n").alias("n2"), F.col("l.root").alias("root2"), "c")
    met = split_join(scored, lead, "band", "c", total).where((F.col("root") != F.col("root2")) & alike(F.col("n"), F.col("n2")))
    links = close.union(similar_pairs(checkpointed(met.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()), texts, named))
    roots = components(links).withColumnRenamed("node", "s")
    apart = apart_bands(left, roots, total).drop("met")
    if not apart.isEmpty():
        more = checkpointed(search_bands(apart, sets_of(apart, texts, named)))
        links = links.union(similar_pairs(more, texts, named))
        roots = components(links).withColumnRenamed("node", "s")
    counted = checkpointed(named.select("s", "c").join(roots, "s", "left").select("s", "c", F.coalesce("root", "s").alias("root")))
    return split_join(rows.select(id_col, "h", "s"), counted, "s", "c", rows.count()).select(id_col, "h", "root")
