"""What the text operators share: column appending over Arrow, shared folders, checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch may hold, so that a worker's memory doesn't follow the longest texts.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that workers find it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="provenir-source-")) / "provenir_source.zip"  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts differ in length by four orders of magnitude. Called before Python runs on executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def append_columns(
    df: DataFrame, read: Sequence[str], keep: Sequence[str], fields: Sequence[T.StructField], start: Callable[[], Callable[..., list[pa.Array]]]
) -> DataFrame:
    """`keep` of df followed by `fields`, which ``start()(*read columns)`` makes batch by batch.

    start runs once in each task (load what the task needs there); its result gets Arrow arrays and
    returns one Arrow array per field. Columns in neither list aren't read, so their names can't clash.
    """
    bounded_batches(df.sparkSession)
    cols = list(dict.fromkeys([*keep, *read]))
    base = df.select(*cols)
    schema = T.StructType([base.schema[c] for c in keep] + list(fields))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in batches:
            if b.num_rows:
                made = compute(*(b.column(c) for c in read))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=names)

    return base.mapInArrow(run, schema)


_held: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make gives, kept in this process until something is held under another key: workers outlive stages, and one operator's tables would lie beside the next one's."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset."""
    base = checkpoint_root(spark)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def checkpoint_root(spark: SparkSession) -> str:
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if existing := spark.sparkContext.getCheckpointDir():
        return existing
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="provenir-")  # driver and executors are one process
    spark.sparkContext.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def fits(table: DataFrame) -> bool:
    """Whether table may be broadcast: its rows hold BROADCAST_BYTES at most, 16 bytes a value and what terms and arrays hold."""
    wide = sum((F.coalesce(F.octet_length(c) if kind == "string" else F.size(c) * 16, F.lit(0)) for c, kind in table.dtypes if kind == "string" or kind.startswith("array")), F.lit(16 * len(table.columns)))
    return table.agg(F.coalesce(F.sum(wide), F.lit(0)).alias("b")).first().b <= BROADCAST_BYTES


def sized(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it fits."""
    return F.broadcast(table) if fits(table) else table


#: A key is hot if it has more than this part of the rows: there are fewer of them than its inverse, whatever the input.
HOT = 100_000


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table on key. Hot keys (table's column `weight` counts their rows of `total`) are broadcast, HOT of them at most; all others are shuffled.

    rows should be cheap to read twice; table has each key once. `weight` isn't returned. With fewer than
    HOT rows every key is hot: one join does, and the driver plans and runs no shuffles of nothing.
    """
    if total < HOT:
        return rows.join(F.broadcast(table.drop(weight)), key, how)
    hot = F.broadcast(table.where(F.col(weight) * HOT > total).drop(weight))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(weight) * HOT <= total).drop(weight), key, how), allowMissingColumns=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) of at most `rows` labelled rows, the same for the same tables.

    The labels whose ids hash lowest are chosen before the texts are looked up, so that the join
    broadcasts at most `rows` of them and no text is shuffled but theirs.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.xxhash64(F.col(id_col)).alias("h"), F.col(label_col).cast("int").alias("y")).orderBy("h", "i", "y").limit(rows)
    found = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    texts, marks = [], []
    for r in found.orderBy("h", "i", "t", "y").limit(rows).select("t", "y").toLocalIterator():
        texts.append(r.t)
        marks.append(r.y)
    return texts, marks


#: Elements of a fold's block.
BLOCK = 64


def gathered(parts: Column, state: list[Column], kind: str, step) -> Column:
    """The arrays that step(state, part) makes from each of the parts, one after another.

    step gives (new state, elements); kind is the elements' type. What is gathered lies in blocks of BLOCK
    steps: a fold that appends to one array would copy it for each part.
    """
    names = [f"s{k}" for k in range(len(state))]
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    zero = F.struct(*(x.alias(n) for x, n in zip(state, names, strict=True)), no_blocks.alias("blocks"), none.alias("last"))

    def merge(acc: Column, part: Column) -> Column:
        new, made = step([acc[n] for n in names], part)
        full = F.size(acc["last"]) >= BLOCK
        return F.struct(
            *(x.alias(n) for x, n in zip(new, names, strict=True)),
            F.when(full, F.concat(acc["blocks"], F.array(acc["last"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(full, made).otherwise(F.concat(acc["last"], made)).alias("last"),
        )

    return F.aggregate(parts, zero, merge, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["last"]))))


def file_system(path: str):
    """pyarrow's file system for path, and the path within it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def fold(column, parts: int, held: int):
    """Whether crc32 of the id as text leaves the remainder of the held-out fold; a null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string")) % parts == held, F.lit(False))


def fold_of(value: object, parts: int) -> int:
    return zlib.crc32(str(value).encode()) % parts


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
