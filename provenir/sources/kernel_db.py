"""Kernel provenance databases as key and value bytes: decoders in Spark expressions.

Extracts are tables of binary k and v. Integers are little-endian; a node key is an unsigned 64-bit
object number and an unsigned 32-bit version. Object numbers of 2 ** 63 and above don't fit and decode to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import ProvGraph
from ..operators import construct

#: Names of packed attribute codes, and the decoder of each attribute: fixed values of the format.
CODES = ("INVALID", "TYPE", "NAME", "INODE", "PATH", "ARGV", "ENV", "FREEZETIME", "INPUT")
DECODERS = {
    "TYPE": "string", "NAME": "string", "PATH": "string", "CREAT": "string", "UNLINK": "string", "INODE": "int", "PID": "int",
    "ARGV": "tokens", "ENV": "tokens", "FREEZETIME": "time", "EXECTIME": "time", "FORKPARENT": "node", "INPUT": "node",
}
PACKED, ANCESTRY = 2, 4


def turned(h: Column) -> Column:
    """Hexadecimal digits with their bytes in the opposite order."""
    return F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"), 1)), "")


def unsigned(b: Column, at: int | Column, size: int) -> Column:
    """The little-endian unsigned integer of `size` bytes after `at` bytes; NULL if it doesn't fit 63 bits or the bytes end before."""
    h = F.hex(F.substring(b, F.lit(at) + 1, F.lit(size)))
    return F.when(F.length(h) == 2 * size, F.try_to_number(F.conv(turned(h), 16, 10), F.lit("9" * 20)).cast("decimal(20,0)")).try_cast("long")


def signed32(b: Column, at: int | Column) -> Column:
    n = unsigned(b, at, 4)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def text(b: Column) -> Column:
    """The bytes as UTF-8, up to a closing zero byte."""
    return F.regexp_replace(F.decode(b, "UTF-8"), "\\x00+$", "")


def node_key(b: Column, prefix: str = "") -> list[Column]:
    return [unsigned(b, 0, 8).alias(f"{prefix}pnode"), unsigned(b, 8, 4).alias(f"{prefix}version")]


def ancestry(parent_db: DataFrame) -> DataFrame:
    """parent_pnode, parent_version, child_pnode, child_version of the child-to-parent database."""
    return parent_db.select(*node_key(F.col("v"), "parent_"), *node_key(F.col("k"), "child_"))


def token_map(tokens: DataFrame) -> DataFrame:
    """tok, str of the record-number database (k: 4-byte number, v: string)."""
    return tokens.select(unsigned(F.col("k"), 0, 4).alias("tok"), text(F.col("v")).alias("str"))


def records(prov_db: DataFrame) -> DataFrame:
    """pnode, version, attr, payload, ancestry, seq. Headers: flags, value type, code or name's length, value's length; unpacked records hold the name before the value."""
    flags, code, size = unsigned(F.col("v"), 0, 1), unsigned(F.col("v"), 2, 2).cast("int"), unsigned(F.col("v"), 4, 4).cast("int")
    packed = flags.bitwiseAND(PACKED) != 0
    attr = F.when(packed, F.get(F.array(*map(F.lit, CODES)), code)).otherwise(F.decode(F.substring(F.col("v"), F.lit(9), code), "UTF-8"))
    payload = F.substring(F.col("v"), F.when(packed, 9).otherwise(F.lit(9) + code), size)
    return prov_db.select(*node_key(F.col("k")), attr.alias("attr"), payload.alias("payload"), (flags.bitwiseAND(ANCESTRY) != 0).alias("ancestry"), "seq")


def decoded(raw: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """pnode, version, attr, value (string), ref_pnode, ref_version, items (of token arrays), ancestry, seq.

    Times are written as seconds, a point and nanoseconds. Attributes without a decoder raise.
    """
    kinds = F.create_map(*(F.lit(x) for pair in DECODERS.items() for x in pair))
    kind = F.coalesce(F.try_element_at(kinds, F.col("attr")), F.raise_error(F.concat(F.lit("no decoder for attribute "), F.coalesce("attr", F.lit("?")))).cast("string"))
    b = F.col("payload")
    value = F.when(F.col("kind") == "string", text(b)).when(F.col("kind") == "int", signed32(b, 0).cast("string")).when(F.col("kind") == "time", F.concat_ws(".", signed32(b, 0).cast("string"), signed32(b, 4).cast("string")))
    node = F.col("kind") == "node"
    out = raw.withColumn("kind", kind).select("pnode", "version", "attr", value.alias("value"), F.when(node, unsigned(b, 0, 8)).alias("ref_pnode"), F.when(node, unsigned(b, 8, 4)).alias("ref_version"), "kind", "payload", "ancestry", "seq")
    if tokens is None:
        return out.withColumn("items", F.lit(None).cast("array<string>")).drop("kind", "payload")
    lists = out.where("kind = 'tokens'").select("pnode", "version", "attr", "seq", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("payload") / 4).cast("int") - 1), lambda i: unsigned(F.col("payload"), i * 4, 4))).alias("i", "tok"))
    read = lists.join(tokens, "tok").groupBy("pnode", "version", "attr", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "str"))), lambda x: x["str"]).alias("items"))
    return out.join(read, ["pnode", "version", "attr", "seq"], "left").drop("kind", "payload")


def make_graph(parent_db: DataFrame, prov_db: DataFrame, tokens: DataFrame | None = None, strict: bool = False) -> ProvGraph:
    """The whole way from database extracts to the graph. strict: raise if an input or fork edge has no ancestry."""
    return construct.make_graph(ancestry(parent_db), decoded(records(prov_db), token_map(tokens) if tokens is not None else None), strict)


def dump(db: DataFrame, mode: str) -> DataFrame:
    """Keys and values as hexadecimal text: 's' both, 'kx' keys, 'vx' values."""
    columns = {"s": ["k", "v"], "kx": ["k"], "vx": ["v"]}[mode]
    return db.select(*(F.lower(F.hex(c)).alias(c) for c in columns))


def encode_key(pnode: int, version: int) -> bytes:
    """For fixtures and writers: the key of a node."""
    import struct

    return struct.pack("<QI", pnode, version)
