"""Token counts by the public WordPunct pattern."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import spread

WORD_PUNCT = re.compile(r"\w+|[^\w\s]+")


def token_counts(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the named columns and n_tokens, one row per doc_id; null texts have no tokens, null doc_ids are left out."""
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", *columns, "text")

    def run(batches):
        for b in batches:
            sizes = [len(WORD_PUNCT.findall(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *columns)) + ", n_tokens long"
    return spread(docs).mapInArrow(run, schema).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in (*columns, "n_tokens")))


def ranked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with rank: from 0, in the order of the 64-bit column order within equal keys.

    A group is ranked in 64 parts by the leading bits of order, so one that holds a third of all rows is no single task;
    the parts' sizes are added up over at most 64 rows a group.
    """
    from pyspark.sql import Window

    parts = rows.withColumn("_part", F.shiftright(order, 58))
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_part").orderBy(order, "doc_id")
    numbered = parts.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(sizes, [*keys, "_part"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
