"""Column functions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def process_id(pid: Column, incarnation: Column) -> Column:
    return F.concat(F.lit("p"), pid.cast("string"), F.lit("#"), incarnation.cast("string"))


def file_id(path: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("f"), path, F.lit("#"), ordinal.cast("string"))


def normal_path(path: Column) -> Column:
    """One pass over doubled slashes, from the left."""
    return F.replace(path, F.lit("//"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, "/"), -1))


def gaussian(x: Column, mean: Column, sigma: Column) -> Column:
    """The normal density."""
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * F.pow(sigma, F.lit(2.0)))) / (math.sqrt(2 * math.pi) * sigma)


def node_id(pnode: Column, version: Column) -> Column:
    return F.concat_ws(".", pnode.cast("string"), version.cast("string"))


def display_name(name: Column, pnode: Column, version: Column) -> Column:
    """A node's name; unnamed nodes show as pipes with their key."""
    return F.coalesce(name, F.format_string("PIPE-(%s, %s)", pnode.cast("string"), version.cast("string")))
