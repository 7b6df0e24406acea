"""Near-duplicate clusters by MinHash bands.

Every text becomes the set of its word shingles, the set a sketch, the sketch a
few band hashes. Texts that share a band are candidates. The members of a band
are compared with leaders, by their exact sets; those that end up in one cluster
are done, and only members of different clusters go on to the next leaders
(``links``). Texts with one set are one member throughout.

With b bands of r values a pair of similarity s is a candidate with probability
``1 - (1 - s**r)**b``: 0.999998 for the 32 bands of 5 at 0.8.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import minhash, rolling
from corpuslab.operators.components import components
from corpuslab.operators.links import resolved_links
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

for module in (minhash, rolling, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


def sketches(
    df: DataFrame,
    words: int = 5,
    bands: int = 32,
    rows: int = 5,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_shingles, one, two, shingles, bands)`` of every text; the set and two digests of it."""
    names = [key, "n_shingles", "one", "two", "shingles", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [minhash.word_shingles(value.as_py(), words) for value in part.column(1)]
                named = [minhash.digests(found) for found in sets]
                hashed = [
                    minhash.band_hashes(minhash.sketch(found, bands * rows, seed), rows) if len(found) else None
                    for found in sets
                ]
                columns = [
                    part.column(0),
                    pa.array([len(found) for found in sets], pa.int64()),
                    pa.array([name[0] for name in named], pa.int64()),
                    pa.array([name[1] for name in named], pa.int64()),
                    pa.array([found.view(np.int64) for found in sets], pa.list_(pa.int64())),
                    pa.array(hashed, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_shingles bigint, one bigint, two bigint, shingles array<bigint>, bands array<bigint>"
    return df.select(key, text).mapInArrow(run, schema)


def near_duplicates(
    df: DataFrame,
    percent: int = 80,
    words: int = 5,
    bands: int = 32,
    rows: int = 5,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_shingles, near_dup, cluster_id, cluster_size)`` of every document.

    A cluster is what links of a Jaccard similarity of ``percent`` or more connect, named by
    its smallest key; ``near_dup`` says that it holds another document. Texts
    without words and rows without a key are alone.
    """
    made = materialize(sketches(df, words, bands, rows, 0, key, text))
    usable = made.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    same = ["one", "two", "n_shingles"]
    sets = materialize(usable.groupBy(*same).agg(F.min(key).alias("node"), F.count("*").alias("fan_in")))
    member = usable.select(F.col(key).alias("node"), *same, "shingles", "bands").join(sets, [*same, "node"], "left_semi")
    # Rows that repeat with their key are one member.
    member = materialize(member.dropDuplicates(["node"]))
    links = _links(member, percent)
    named = sets.select(*same, "node", "fan_in").join(components(links), "node", "left")
    named = named.select(*same, "fan_in", F.coalesce("component", "node").alias("cluster_id"))
    found = join_counted(usable.select(key, *same), materialize(named), same, "fan_in").select(key, "n_shingles", "cluster_id")
    found = materialize(found)
    sizes = materialize(found.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).withColumn("fan_in", F.col("cluster_size")))
    clustered = join_counted(found, sizes, "cluster_id", "fan_in").select(key, "n_shingles", "cluster_id", "cluster_size")
    single = made.filter(F.col(key).isNull() | (F.col("n_shingles") == 0)).select(
        key, "n_shingles", F.col(key).alias("cluster_id"), F.lit(1).cast("bigint").alias("cluster_size")
    )
    return clustered.unionByName(single).withColumn("near_dup", F.col("cluster_size") > 1)


def _links(member: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that connect the same members as all links among candidates do."""
    n = F.col("n_shingles").alias("n")
    spread = member.select(F.explode("bands").alias("signature"), "node", n, n.alias("shared"))
    return resolved_links(spread, member.select("node", n, "shingles"), percent)
