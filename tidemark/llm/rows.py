"""Names for rows of a table, from doc_id in whatever type it has, and text.

A whole-number doc_id names its row almost alone and stays as it is, which compresses well; 32 bits of the text
tell rows apart that share it. Other rows have 96 bits of doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_keys(documents: DataFrame) -> tuple[Column, Column]:
    """Two numbers that name a row: rows that agree in both are the same row repeated. A null text is not an empty one."""
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))
    own = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    hashed, short = F.xxhash64(F.lit(1), own, text), F.hash(F.lit(2), text, own).cast("long")
    if isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), hashed), short
    return hashed, short


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (a null one empty), k1 and k2."""
    k1, k2 = row_keys(documents)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
