"""Lists of labelled sessions, and the classes of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of attack names: fixed values of the label lists.
CLASSES = {
    "back": "dos", "dict": "r2l", "eject": "u2r", "ffb": "u2r", "ffb_clear": "u2r", "format": "u2r", "format_clear": "u2r", "ftp-write": "r2l", "guest": "r2l", "imap": "r2l",
    "ipsweep": "probe", "land": "dos", "loadmodule": "u2r", "multihop": "r2l", "neptune": "dos", "nmap": "probe", "perlmagic": "u2r", "phf": "r2l", "pod": "dos", "portsweep": "probe",
    "rootkit": "u2r", "satan": "probe", "smurf": "dos", "spy": "r2l", "syslog": "dos", "teardrop": "dos", "warez": "r2l", "warezclient": "r2l", "warezmaster": "r2l", "-": "none",
}


def classify(name: Column, classes: dict[str, str] = CLASSES) -> Column:
    """The class of the exact name, else the first class (in order) of an entry that the name starts with, else 'unknown'."""
    exact = F.try_element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), name)
    entries = F.array(*(F.struct(F.lit(v).alias("cls"), F.lit(k).alias("start")) for k, v in classes.items()))
    prefix = F.array_min(F.transform(F.filter(entries, lambda e: name.startswith(e["start"])), lambda e: e["cls"]))
    return F.coalesce(exact, prefix, F.lit("unknown"))


def parse(lines: DataFrame) -> DataFrame:
    """id, ts, name, type of label lines (column value): fields 0, 1 and 2 (MM/dd/yyyy HH:mm:ss in the session's time zone) and 10. Blank lines are left out."""
    row = F.split(F.trim("value"), r"\s+")
    at = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.get(row, 1), F.get(row, 2)), F.lit("MM/dd/yyyy HH:mm:ss")))
    return lines.where("trim(value) <> ''").select(F.get(row, 0).alias("id"), at.alias("ts"), F.get(row, 10).alias("name"), classify(F.get(row, 10)).alias("type"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
