"""Detector and probe logs to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def _all(text: str, pattern: str, group: int = 1) -> F.Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def paired(df: DataFrame, kind: str, prefix: str = "black", text: str = "log", key: str = "v") -> DataFrame:
    """``<prefix>_start:X <prefix>_end:Y`` pairs of a log, as regions of ``kind``."""
    pattern = rf"{prefix}_start:\s*{NUMBER}\s+{prefix}_end:\s*{NUMBER}"
    each = df.select(key, F.posexplode(F.arrays_zip(_all(text, pattern, 1).alias("s"), _all(text, pattern, 2).alias("e"))).alias("ord", "p"))
    return each.select(key, F.col("ord").cast("long"), F.expr("try_cast(p.s as double)").alias("start"), F.expr("try_cast(p.e as double)").alias("end"), F.lit(kind).alias("kind"))


def alternating(df: DataFrame, kind: str, text: str = "log", key: str = "v", duration: str = "duration") -> DataFrame:
    """``<kind>_start`` and ``<kind>_end`` events in turn; one that never ends lasts to the duration; starts are 0 at least."""
    pattern = rf"{kind}_(start|end):\s*{NUMBER}"
    zipped = F.arrays_zip(_all(text, pattern, 1).alias("what"), _all(text, pattern, 2).alias("at"))
    starts = F.filter(F.transform(zipped, lambda x, i: F.struct(x["what"].alias("what"), x["at"].alias("at"), F.get(zipped, i + 1)["at"].alias("to"), F.get(zipped, i + 1)["what"].alias("then"))), lambda x: x["what"] == "start")
    each = df.select(key, duration, F.posexplode(starts).alias("ord", "p"))
    end = F.when(F.col("p.then") == "end", F.expr("try_cast(p.to as double)")).otherwise(F.col(duration))
    return each.select(key, F.col("ord").cast("long"), F.greatest(F.lit(0.0), F.expr("try_cast(p.at as double)")).alias("start"), end.alias("end"), F.lit(kind).alias("kind"))


def probe_log(df: DataFrame, text: str = "log", key: str = "v") -> DataFrame:
    """A saved probe log's duration and ``[s -> e] kind`` rows: v, duration, ord, start, end, kind."""
    pattern = rf"\[\s*{NUMBER}\s*->\s*{NUMBER}\]\s+(black|white|freeze|silence|bars|snow)"
    duration = F.expr(f"try_cast(regexp_extract(`{text}`, r'\\(duration ([0-9.]+)s\\)', 1) as double)")
    zipped = F.arrays_zip(*(_all(text, pattern, g).alias(n) for g, n in ((1, "s"), (2, "e"), (3, "k"))))
    each = df.select(key, duration.alias("duration"), F.posexplode(zipped).alias("ord", "p"))
    return each.select(key, "duration", F.col("ord").cast("long"), F.expr("try_cast(p.s as double)").alias("start"), F.expr("try_cast(p.e as double)").alias("end"), F.col("p.k").alias("kind"))


def union_sources(*sources: DataFrame | None) -> DataFrame | None:
    """All enabled detectors' regions; a source that failed is None and left out."""
    out = None
    for s in sources:
        if s is not None:
            out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
