"""Connected components, and whole groups of sorted rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import drop_stored, store


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``edges(u, v)``; a component's name is its smallest node.

    Alternating large and small stars: every round hangs a node's neighbours on the smallest of them, until nothing
    changes, after about log(nodes) rounds. A hot node is a partial minimum and a join Spark may split. Each round
    is written to the shared folder, so that lost executors repeat one round at most.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, state = store(e, "stars"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, e, state = e, store(small.select("e.*").filter("u <> v").distinct(), "stars"), now
        drop_stored(old)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v").distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows made of whole groups, and where each group begins; rows come sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < rows:
            continue
        cuts = _starts(held, keys)
        if len(cuts) > 1:
            yield held.slice(0, int(cuts[-1])), cuts[:-1]
            held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= np.asarray(pa.compute.not_equal(c[1:], c[:-1]))
    return np.flatnonzero(new)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` points under the pairs ``a, b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
