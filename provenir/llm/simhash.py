"""SimHash near-duplicate components, with vantage-point trees for the exact pairs.

A fingerprint has 64 bits, one for each bit position that is set in over half of the XXH64 hashes of
a text's word shingles. Two fingerprints link if at most `radius` bits differ.

Pairs: fingerprints are partitioned in two steps. Distances of unrelated 64-bit fingerprints crowd around
32, so that a border between distances to one vantage point has most of the query balls on it (README
has the replication). They are therefore first dealt by their distances to vantage points of
projections: the 64 bits are cut into m > radius blocks, and the vantage points of a projection to
m - radius of them are its unit vectors, whose distances tell its bits. Two fingerprints within `radius`
are at distance 0 in one of these projections at least, so that no ball has a border there and
they meet in a shard; m grows with the number of fingerprints, so that shards stay small. A shard of more than
SHARD_MOST fingerprints (many agree in a projection) is cut further by Hamming distances to vantage
points of its own, each with the border that fewest balls overlap: a fingerprint goes to the side it is on, and
to the other one too if its ball overlaps the border. A vantage point whose border most balls overlap isn't used.
(Hashed shard names may merge two shards; the distances decide.)

Within a shard, a vantage-point tree over whole fingerprints finds every link: subtrees that the triangle
bound excludes aren't visited, those that the query ball's border overlaps are. A shard reports a spanning
set of its links (each fingerprint with the root of its component in the shard), never all pairs of a group.

Joins that a large group of copies or a hub could fill are split: hot keys are broadcast, of which there
can be no more than a fixed number (common.split_join).

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; repeated rows and equal ids come out as often as they went in; an empty table gives no rows; only
the id and the text are read, so that other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, checkpointed, field, sized, split_join

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A subtree of at most so many fingerprints is scanned at once.
LEAF = 16
#: Fingerprints of a shard that one task searches; larger shards are cut by VANTAGE points at most, whose border at most OVERLAP of the balls overlap, and with no more than a share of MOST_ON_A_SIDE on either side.
SHARD_MOST, VANTAGE, OVERLAP, MOST_ON_A_SIDE = 16384, 12, 0.4, 0.9


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's 64-bit fingerprint."""
    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1))
        pieces = [line[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, seed) for p in pieces), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id_col and `fp`, the fingerprint as a signed 64-bit integer."""

    def start():
        def compute(column: pa.Array) -> list[pa.Array]:
            fps = np.array([fingerprint(x or "", shingle, seed) for x in column.to_pylist()], np.uint64)
            return [pa.array(fps.view(np.int64))]

        return compute

    return append_columns(docs, [text_col], [id_col], [field("fp", T.LongType())], start)


class VantagePointTree:
    """Over an array of distinct 64-bit fingerprints, by Hamming distance. Points can be taken out."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.visited = 0  # points whose distance to a query was taken, vantage points not counted
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, own: np.ndarray, leaf: int):
        stack, done = [(own, None, 0)], None
        while stack:
            ids, parent, side = stack.pop()
            node = [ids, None, None, None, None]  # ids of a leaf | vantage, radius of the border, near, far
            if parent is None:
                done = node
            else:
                parent[3 + side] = node
            if len(ids) <= leaf:
                continue
            vantage = self.points[ids[0]]
            d = np.bitwise_count(self.points[ids] ^ vantage)
            border = int(np.median(d))
            near = d <= border
            if near.all():  # many at one distance: cut just below it
                border -= 1
                near = d <= border
            node[0], node[1], node[2] = None, vantage, border
            stack += [(ids[near], node, 0), (ids[~near], node, 1)]
        return done

    def take(self, query: np.uint64, radius: int) -> np.ndarray:
        """The ids of the points within radius of the query that are left; they are taken out."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is not None:
                ids = node[0]
                self.visited += len(ids)
                if len(ids):
                    hit = np.bitwise_count(self.points[ids] ^ query) <= radius
                    if hit.any():
                        out.append(ids[hit])
                        node[0] = ids[~hit]
                continue
            d = int(np.bitwise_count(node[1] ^ query))
            if d - radius <= node[2]:
                stack.append(node[3])
            if d + radius > node[2]:
                stack.append(node[4])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def links_within(points: np.ndarray, radius: int, via: bool = False) -> Iterator[tuple[int, int]]:
    """(place, place of its component's first point) for each of the distinct points that has a link; with via, the place of the point that found it, which is within radius.

    Each search takes what it finds out of the tree, so that a group of near copies costs a search
    for each member over what is left, not all of its pairs.
    """
    n = len(points)
    if n < 2:
        return
    if n <= 256:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        if np.count_nonzero(near) == n:
            return
    tree = VantagePointTree(points)
    seen = np.zeros(n, bool)
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        todo = [first]
        while todo:
            asked = todo.pop()
            found = tree.take(points[asked], radius)
            new = found[~seen[found]]
            seen[new] = True
            todo += new.tolist()
            for x in new.tolist():
                yield x, asked if via else first


def block_count(n: int, radius: int = RADIUS, mean: int = 4096) -> int:
    """The fewest blocks whose shards hold `mean` of n fingerprints on average at most."""
    blocks = radius + 1
    while n > mean << (64 * (blocks - radius) // blocks) and blocks < 2 * radius:
        blocks += 1
    return blocks


def cut_shards(dealt: DataFrame, radius: int, most: int = SHARD_MOST) -> DataFrame:
    """dealt (`fp`, `shard`) with each shard of more than `most` rows cut by distances to its own vantage points, overlaps on both sides.

    Large shards are fewer than rows / most; what is gathered of each is its count, VANTAGE points and as
    many borders.
    """
    sizes = checkpointed(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if sizes.isEmpty():
        return dealt
    points = dealt.join(sized(sizes), "shard").groupBy("shard", "n").agg(*(F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"v{k}") for k in range(VANTAGE)))
    large = checkpointed(points)
    distance = lambda v: F.bit_count(F.col("fp").bitwiseXOR(v)).cast("int")
    rows = dealt.join(sized(large), "shard").select("shard", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v"), distance(F.col(f"v{k}")).alias("d")) for k in range(VANTAGE)))).alias("x")).select("shard", "x.*")
    spread = rows.groupBy("shard", "k", "v", "d").agg(F.count("*").alias("n"))  # 65 distances at most for each vantage point
    borders = checkpointed(spread.groupBy("shard", "k", "v").agg(F.collect_list(F.struct("d", "n")).alias("at")))
    amount = lambda cond: F.aggregate(F.filter("at", cond), F.lit(0).cast("long"), lambda acc, x: acc + x.n)
    tried = borders.select("shard", "k", "v", amount(lambda x: x.d >= 0).alias("all"), "at", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    tried = tried.select("shard", "k", "v", "b", "all", amount(lambda x: x.d - radius <= F.col("b")).alias("near"), amount(lambda x: x.d + radius > F.col("b")).alias("far"))
    best = tried.withColumn("larger", F.greatest("near", "far") / F.col("all")).withColumn("o", (F.col("near") + F.col("far") - F.col("all")) / F.col("all")).where(F.col("larger") <= MOST_ON_A_SIDE).groupBy("shard", "k").agg(F.min(F.struct("o", "k", "v", "b")).alias("cut"))
    known = large.select("shard", "n").join(best.groupBy("shard").agg(F.collect_list("cut").alias("all")), "shard")
    ranked = F.array_sort(F.filter("all", lambda x: x.o <= OVERLAP))
    plan = checkpointed(known.select("shard", F.slice(ranked, 1, F.ceil(2 * F.log2(F.col("n") / most)).cast("int")).alias("cuts")))
    sides = F.aggregate(
        "cuts",
        F.array(F.lit(0)),
        lambda acc, c: F.flatten(F.transform(acc, lambda code: F.filter(F.array(F.when(F.bit_count(F.col("fp").bitwiseXOR(c.v)) - radius <= c.b, code * 2), F.when(F.bit_count(F.col("fp").bitwiseXOR(c.v)) + radius > c.b, code * 2 + 1)), lambda x: x.isNotNull()))),
    )  # the codes of all cells that the ball overlaps
    cut = dealt.join(sized(plan), "shard").select("fp", "shard", F.explode(sides).alias("side"))
    whole = dealt.join(sized(plan.select("shard")), "shard", "left_anti").select("fp", "shard")
    return whole.union(cut.select("fp", F.xxhash64("shard", "side").alias("shard")))


def shard_links(fps: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST, via: bool = False) -> DataFrame:
    """Links between distinct fingerprints: `a` < `b` as signed integers, a spanning set for each shard; with via, of pairs within radius only.

    fps: distinct values in column fp. The shards of a block are its values; a shard's rows are
    numbers only, and copies are counted once.
    """
    bounded_batches(fps.sparkSession)
    blocks = block_count(fps.count(), radius)
    cuts = [64 * k // blocks for k in range(blocks + 1)]

    def bits(k: int):
        return F.shiftrightunsigned(F.col("fp"), cuts[k]).bitwiseAND((1 << cuts[k + 1] - cuts[k]) - 1)

    def shard(n: int, chosen: tuple[int, ...]):
        return F.xxhash64(F.lit(n), *(bits(k) for k in chosen)) if len(chosen) > 1 else F.lit(n << 32) + bits(chosen[0])

    keys = F.array(*(shard(n, chosen) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))))
    dealt = cut_shards(fps.select("fp", F.explode(keys).alias("shard")), radius, most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come sorted by shard."""
        rest: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in _with_end(batches):
            if batch is None:
                keys_, values = rest
                cut = len(keys_)
            else:
                keys_ = np.concatenate((rest[0], np.asarray(batch.column("shard"))))
                values = np.concatenate((rest[1], np.asarray(batch.column("fp"))))
                cut = int(np.searchsorted(keys_, keys_[-1], "left")) if len(keys_) else 0
            rest = keys_[cut:], values[cut:]
            keys_, values = keys_[:cut], values[:cut]
            if not len(keys_):
                continue
            a, b = [], []
            edges = np.flatnonzero(np.diff(keys_)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys_)], strict=True):
                if hi - lo > 1:
                    points = values[lo:hi].view(np.uint64)
                    for x, y in links_within(points, radius, via):
                        a.append(int(values[lo + x]))
                        b.append(int(values[lo + y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    sharded = dealt.repartition("shard").sortWithinPartitions("shard")
    found = sharded.mapInArrow(search, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def least_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`node`, `root` of all the edges (u, v) in the batches: labels fall to the least of their neighbours' and jump to those labels' own, until none falls."""
    read = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    ends = np.concatenate([np.concatenate(x) for x in zip(*read)]) if read else np.empty(0, np.int64)
    nodes, place = np.unique(ends, return_inverse=True)
    u, v = np.concatenate([place[: len(place) // 2], place[len(place) // 2 :]]), np.concatenate([place[len(place) // 2 :], place[: len(place) // 2]])
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, label[u], label[v])
        while not np.array_equal(low, jumped := low[low]):
            low = jumped
        if np.array_equal(low, label):
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


#: Edges (two numbers each) that one task may hold: as many bytes as may be broadcast.
FEW_EDGES = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """`node` and `root`, the smallest node that links reach from it, for each node of the edges.

    At most `few` edges are solved in one task. More are in rounds, each of two steps on stars (large:
    neighbours above a node go to its smallest neighbour; small: those below it do) until nothing changes.
    Each step is a grouped minimum and a join whose hubs are broadcast, its rows are at most the edges, and
    each round is written to the checkpoint folder.
    """
    now = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, total = None, now.count()
    if total <= few:
        bounded_batches(now.sparkSession)
        return checkpointed(now.coalesce(1).mapInArrow(least_reached, "node long, root long"))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = checkpointed(split_join(both, least, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = split_join(large, low, "u", "n", 2 * total)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v")
        now = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before, total = mark, mark[0]
    up = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return up.union(up.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id_col, `fp` and `component`, the smallest id that links of at most radius bits reach, for each row.

    Rows with a null id have a component only through others; alone it is null.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    own = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("__least"), F.count("*").alias("__n")))
    roots = checkpointed(components(shard_links(own.select("fp"), radius)).withColumnRenamed("node", "fp").withColumnRenamed("root", "__root"))
    linked = checkpointed(own.join(roots, "fp"))
    groups = linked.groupBy("__root").agg(F.min("__least").alias("component"), F.count("*").alias("__size"))
    found = split_join(linked, groups, "__root", "__size", linked.count()).select("fp", "component", "__n")
    alone = own.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("__least").alias("component"), "__n")
    named = checkpointed(found.union(alone))
    return split_join(fps, named, "fp", "__n", fps.count()).select(id_col, "fp", "component")
