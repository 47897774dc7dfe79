"""Regular-expression matches with their offsets in code points, from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.llm.common import bound, indices

CHUNK = 256


def _running(parts: Column, width, give, kind: str) -> Column:
    """struct(pos: sum of widths, out: give(position before, part) for each part)."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(parts, start, lambda acc, x: F.struct((acc["pos"] + width(x)).alias("pos"), F.concat(acc["out"], F.array(give(acc["pos"], x))).alias("out")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, which must not be empty.

    The text between matches gives their offsets. Offsets are summed in chunks, so that a text with very many matches does
    not copy its list once for each of them."""
    one = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))
    gaps = F.split(text, pattern, -1)
    pairs = lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value"), F.length(v).alias("n")))
    chunked = lambda parts: F.transform(indices(F.ceil(F.size(parts) / CHUNK).cast("int")), lambda k: _running(F.slice(parts, k * CHUNK + 1, CHUNK), lambda x: x["gap"] + x["n"], one, "struct<start:int,end:int,value:string>"))
    moved = lambda c, b: F.transform(c["out"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"), s["value"].alias("value")))
    placed = lambda chunks: F.flatten(F.zip_with(chunks, _running(chunks, lambda c: c["pos"], lambda pos, c: pos, "int")["out"], moved))
    return bound(bound(bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs), chunked), placed)
