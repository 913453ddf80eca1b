"""Names of processes at a time: from audit text and from process listings. Both give batch, end_ts, pid, ppid, cmd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where listings have the pid and the command (from 1). A pid of more digits runs on and moves what follows.
PID_AT, PID_WIDTH, CMD_AT = 11, 4, 62
#: Lines shorter than this are dates.
SHORT = 50
FAR = 2**62


def _time(text: Column, pattern: str) -> Column:
    """Seconds of a date whose weekday isn't read."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w+\s+", ""), r"\s+", " "), F.lit(pattern)))


def from_audit(lines: DataFrame, size: int = 100) -> DataFrame:
    """Execs of text audit (file, seq, line), in batches of `size`: the last path of a record is the command, the subject's fields 6 and 7 are pid and ppid. The last, unfilled batch holds for good."""
    t = F.split("line", ",")
    order = Window.partitionBy("file").orderBy("seq")
    rows = lines.select("file", "seq", t.alias("t"), F.trim(F.get(t, 0)).alias("k")).withColumn("record", F.sum((F.col("k") == "header").cast("int")).over(order))
    last = lambda k, n, name: F.max_by(F.trim(F.get("t", n)), F.when(F.col("k") == k, F.col("seq"))).alias(name)
    records = rows.groupBy("file", "record").agg(F.min("seq").alias("seq"), F.max(F.when(F.col("k") == "header", F.concat_ws(",", "t"))).alias("header"), F.max(F.when(F.col("k") == "header", F.get("t", F.size("t") - 2))).alias("at"), last("path", 1, "cmd"), last("subject", 6, "pid"), last("subject", 7, "ppid"), F.count_if(F.col("k") == "trailer").alias("ends"))
    execs = records.where("header like '%execve(2)%' and ends > 0 and pid is not null").withColumn("ts", _time(F.col("at"), "MMM d HH:mm:ss yyyy"))
    n = F.row_number().over(order) - 1
    batched = execs.withColumn("batch", F.floor(n / size).cast("int"))
    whole = batched.groupBy("file", "batch").agg(F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    found = batched.groupBy("file", "batch", "pid").agg(F.max_by("ppid", "seq").alias("ppid"), F.max_by("cmd", "seq").alias("cmd"))
    return found.join(whole, ["file", "batch"]).select("file", "batch", F.when(F.col("n") < size, F.lit(FAR)).otherwise(F.col("end_ts")).alias("end_ts"), "pid", "ppid", "cmd")


def from_listing(lines: DataFrame) -> DataFrame:
    """Process listings (file, seq, line): a short line is a date that opens a snapshot, its listing follows; the command is the first word from its column."""
    order = Window.partitionBy("file").orderBy("seq")
    dated = F.length("line") < SHORT
    rows = lines.withColumn("batch", F.sum(dated.cast("int")).over(order).cast("int"))
    zone = F.regexp_replace("line", r"\s[A-Z]{2,5}\s(?=\d{4}\s*$)", " ")
    ends = rows.where(dated).select("file", "batch", _time(zone, "MMM d HH:mm:ss yyyy").alias("end_ts"))
    more = F.regexp_extract(F.substring("line", PID_AT + PID_WIDTH - 1, 100000), r"^[0-9]([0-9]+)", 1)  # of the pid, beyond its columns
    listed = rows.where(~dated).withColumn("more", more)
    pid = F.trim(F.concat(F.substring("line", PID_AT, PID_WIDTH), "more"))
    command = F.trim(F.substring(F.col("line"), F.length("more") + CMD_AT, F.lit(100000)))
    own = listed.select("file", "batch", pid.alias("pid"), F.lit(None).cast("string").alias("ppid"), F.get(F.split(command, r"\s+"), 0).alias("cmd"))
    return own.where("pid rlike '^[0-9]+$'").join(ends, ["file", "batch"]).select("file", "batch", "end_ts", "pid", "ppid", "cmd")
