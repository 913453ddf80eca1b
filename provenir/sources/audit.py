"""Audit trails as text: one token a line, comma separated, a record from its header to its trailer.

Lines need their order. `numbered` gives it: files are read in splits, a line's place is its split's first
byte and its number in it. Records are counted within splits, and splits within a file, so that no window
holds more than a split's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit_graph import kind_of

#: Token numbers: fixed values of the audit format.
HEADERS, SUBJECTS, RETURNS, PATH, TRAILER = (20, 21, 116, 121), (36, 122, 117, 124), (39, 114), 35, 19


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, split, seq, line: seq rises along a file, split is the first byte of what was read at once (a gzip file is one split). Blank lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"))
    first = F.min("row").over(Window.partitionBy("file", "split"))  # a split has more bytes than lines
    return lines.withColumn("seq", F.col("split") + F.col("row") - first).where("trim(line) <> ''").select("file", "split", "seq", "line")


def _field(n: int) -> Column:
    return F.trim(F.get(F.col("t"), n))


def records(lines: DataFrame) -> DataFrame:
    """file, record, seq (of the header), event_id, sec, frac, pid, uid, gid, euid, egid, machine_id, return_value, paths, exec_path.

    Records without a trailer are left out, and so are lines before the first header. The last subject
    and return count; paths keep their order.
    """
    split = F.col("split") if "split" in lines.columns else F.lit(0)
    tokens = lines.select("file", split.alias("split"), "seq", F.split("line", ",").alias("t")).withColumn("id", F.get("t", 0).try_cast("int"))
    opens = F.coalesce(F.col("id").isin(*HEADERS), F.lit(False)).cast("long")
    inside_split = F.sum(opens).over(Window.partitionBy("file", "split").orderBy("seq"))
    heads = tokens.groupBy("file", "split").agg(F.sum(opens).alias("n"))
    past = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered_ = tokens.withColumn("own", inside_split).join(heads.select("file", "split", past.alias("past")), ["file", "split"]).withColumn("record", F.col("own") + F.col("past")).where("record > 0").drop("own", "past")
    ended = F.min(F.when(F.col("id") == TRAILER, F.col("seq"))).over(Window.partitionBy("file", "record"))
    inside = numbered_.withColumn("__end", ended).where("seq <= __end")
    is_ = lambda ids: F.col("id").isin(*ids)
    last = lambda ids, n, name: F.max_by(_field(n), F.when(is_(ids), F.col("seq"))).alias(name)
    paths = F.transform(F.array_sort(F.collect_list(F.when(F.col("id") == PATH, F.struct("seq", _field(1).alias("path"))))), lambda x: x["path"])
    grouped = inside.groupBy("file", "record").agg(
        F.min("seq").alias("seq"),
        last(HEADERS, 3, "event_id"), last(HEADERS, 5, "sec"), last(HEADERS, 6, "frac"),
        last(SUBJECTS, 2, "euid"), last(SUBJECTS, 3, "egid"), last(SUBJECTS, 4, "uid"), last(SUBJECTS, 5, "gid"), last(SUBJECTS, 6, "pid"), last(SUBJECTS, 9, "machine_id"),
        last(RETURNS, 2, "return_value"), paths.alias("paths"),
    )
    return grouped.withColumn("event_id", F.col("event_id").try_cast("int")).withColumn("sec", F.col("sec").try_cast("long"))


def compat_seconds(sec: Column, frac: Column) -> Column:
    """Seconds as the joined digits of both, without the last nine: right if the fraction has nine digits."""
    joined = F.concat(sec.cast("string"), frac)
    return F.floor(joined.cast("decimal(38,0)") / 1000000000).cast("long")


def events(found: DataFrame) -> DataFrame:
    """The event table of audit_graph.build(). Records without a pid, and of other kinds, only prove that the process was there."""
    kind = kind_of(F.col("event_id"))
    renamed = kind == "rename"
    return found.where("pid is not null").select(
        F.struct("file", "seq").alias("seq"),
        F.coalesce(kind, F.lit("other")).alias("kind"),
        "pid",
        F.when(kind == "fork", F.col("return_value")).alias("child"),
        F.when(renamed, F.get("paths", 1)).when(kind == "exec", F.element_at(F.when(F.size("paths") > 0, F.col("paths")), -1)).otherwise(F.get("paths", 0)).alias("path"),
        F.when(renamed, F.get("paths", 2)).when(kind.isin("read", "write"), F.get("paths", 1)).alias("path2"),
        F.col("sec").alias("time"),
    )


def cleaned(lines: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """lines without the patterns of noise, and without lines that are blank then."""
    text = F.col("line")
    for pattern in noise:
        text = F.regexp_replace(text, pattern, "")
    return lines.withColumn("line", text).where("trim(line) <> ''")
