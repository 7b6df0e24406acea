"""Exact duplicated substrings and the annotations built on them.

A position is duplicated when it lies in a window of ``length`` units that
occurs at least twice in the corpus. How the windows are compared:

1. Each text is cut into runs of windows that share an anchoring gram (the
   smallest gram hash inside the window). Equal windows have equal anchors, so
   a window can only repeat if its anchor does.
2. Anchors are counted. A map of fixed size tells which may occur several
   times; the runs of all others stay where they are. Of anchors of at most
   ``CROWD`` runs every run goes to a bucket once, as the units it covers, next
   to the other runs of its task, and the task that holds the bucket compares
   its windows. Neither windows nor runs are rows, however many anchors repeat
   by chance.
3. Runs of crowded anchors (boilerplate) are counted by content, and opened
   into windows only where they differ. Their groups are held by no task.

No pairs are formed, so boilerplate found in a third of the corpus costs one
counter plus its own output rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ranges import merge_ranges
from corpuslab.operators.skew import join_counted, possible
from corpuslab.operators.windows import (
    crowded_runs,
    raw,
    repeated_anchors,
    repeated_in_buckets,
    run_anchors,
    run_units,
    text_size,
    unit_width,
    windows_of_runs,
)
from corpuslab.session import materialize

# Runs of one anchor that a single task compares.
CROWD = 1 << 16


def duplicate_windows(
    df: DataFrame, length: int = 50, unit: str = "bytes", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Runs of duplicated windows as ``(key, first, last)`` window starts."""
    repeated = repeated_anchors(run_anchors(df, length, unit, text), CROWD)
    found = repeated_in_buckets(run_units(df, length, repeated, unit, key, text), length, unit, key)
    if not len(repeated[1]):
        return found
    crowded = materialize(crowded_runs(df, length, repeated, unit, key, text))
    return found.unionByName(_crowded_windows(df, crowded, length, unit, key, text))


def _crowded_windows(df: DataFrame, runs: DataFrame, length: int, unit: str, key: str, text: str) -> DataFrame:
    """The duplicated windows in the ``runs`` of crowded anchors, found without a task that holds a bucket.

    A run whose content as a whole repeats is duplicated as a whole. Only runs
    that share an anchor but differ in content are opened into single windows,
    and of equal runs only one. These are counted by content.
    """
    differs = [F.min(span) != F.max(span) for span in ("span1", "span2")]
    anchors = materialize(
        runs.groupBy("anchor")
        .agg(
            F.count("*").alias("occurrences"),
            (differs[0] | differs[1]).alias("is_mixed"),
        )
        .filter("occurrences > 1")
    )
    repeated = materialize(join_counted(runs, anchors, "anchor", "occurrences"))

    whole = repeated.filter(~F.col("is_mixed")).select(key, "first", "last")

    mixed = repeated.filter("is_mixed")
    contents = materialize(
        mixed.groupBy("anchor", "span1", "span2").agg(
            F.count("*").alias("copies"),
            F.min(F.struct(key, "first", "last")).alias("sample"),
        )
    )
    copied = join_counted(
        mixed.select(key, "first", "last", "anchor", "span1", "span2"),
        contents.filter("copies > 1").drop("sample"),
        ["anchor", "span1", "span2"],
        "copies",
    ).select(key, "first", "last")

    samples = contents.select("sample.*", (F.col("copies") == 1).alias("is_single"))
    opened = materialize(windows_of_runs(df, samples, length, unit, key, text))
    counts = materialize(
        opened.groupBy("hash1", "hash2").agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    )
    single = (
        join_counted(opened, counts, ["hash1", "hash2"], "occurrences")
        .select(key, F.col("pos").alias("first"), F.col("pos").alias("last"))
    )
    return whole.unionByName(copied).unionByName(single)


def duplicate_ranges(
    df: DataFrame, length: int = 50, unit: str = "bytes", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Maximal duplicated ranges ``(key, start, end)`` of every document."""
    found = duplicate_windows(df, length, unit, key, text)
    spans = found.select(
        key, F.col("first").alias("start"), (F.col("last") + F.lit(length)).alias("end")
    )
    return merge_ranges(spans, [key])


def _cut(content: Column, pair: Column, trim: int, width: int) -> Column:
    """The units of one range, with ``trim`` units taken off at each side."""
    size = pair["end"] - pair["start"] - F.lit(2 * trim)
    piece = F.substring(
        content,
        ((pair["start"] + F.lit(trim)) * width + 1).cast("int"),
        (size * width).cast("int"),
    )
    if trim == 0:
        return piece
    return F.when(size > 0, piece).otherwise(F.raise_error(F.lit("the offset empties a range")))


def dup_info(
    df: DataFrame,
    ranges: DataFrame,
    unit: str = "bytes",
    trim: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: ``pairs``, ``repetitions`` (their content) and ``dup_len``.

    Only documents with at least one range. The ranges of a document are
    gathered once and cut out of the text inside the row.
    """
    width = unit_width(unit)
    pairs = materialize(
        ranges.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("pairs"),
            F.sum(F.col("end") - F.col("start")).alias("dup_len"),
        )
    )
    content = raw(text, unit)
    cuts = F.transform("pairs", lambda pair: _cut(F.col("raw"), pair, trim, width))
    if unit == "chars":
        cuts = F.transform(cuts, lambda piece: F.encode(F.decode(piece, "UTF-32"), "UTF-8"))
    return (
        possible(df.select(key, text), pairs, key)
        .select(key, content.alias("raw"))
        .join(pairs, key)
        .select(key, "pairs", cuts.alias("repetitions"), "dup_len")
    )


def range_bytes(
    df: DataFrame,
    ranges: DataFrame,
    unit: str = "bytes",
    trim: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Content of every range: ``(key, start, end, repetition)``."""
    info = dup_info(df, ranges, unit, trim, key, text)
    both = F.explode(F.arrays_zip("pairs", "repetitions")).alias("range")
    return info.select(key, both).select(key, "range.pairs.start", "range.pairs.end", F.col("range.repetitions").alias("repetition"))


def decode_repetition(column: str, charset: str = "UTF-8") -> Column:
    """Bytes as text; byte sequences that are no characters become U+FFFD."""
    if charset.upper() in ("LATIN-1", "ISO-8859-1"):
        return F.decode(F.col(column), "ISO-8859-1")
    return F.make_valid_utf8(F.col(column).cast("string"))


def repetitions_table(contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every distinct range content with how often and where widely it occurs.

    ``contents`` comes from ``range_bytes``. Contents are named by digest, so
    the shuffles carry 32 bytes per range. ``num_docs`` counts documents,
    ``num_ranges`` counts with multiplicity.
    """
    named = contents.select(key, F.sha2("repetition", 256).alias("repetition_id"), F.octet_length("repetition").alias("num_bytes"))
    per_document = named.groupBy("repetition_id", "num_bytes", key).agg(F.count("*").alias("here"))
    return per_document.groupBy("repetition_id", "num_bytes").agg(
        F.count("*").alias("num_docs"), F.sum("here").alias("num_ranges")
    )


def repetition_text(contents: DataFrame, repetitions: DataFrame) -> DataFrame:
    """Attach the content itself to chosen rows of the repetitions table."""
    chosen = contents.withColumn("repetition_id", F.sha2("repetition", 256)).join(
        repetitions.select("repetition_id"), "repetition_id", "left_semi"
    )
    one_each = chosen.groupBy("repetition_id").agg(F.first("repetition").alias("repetition"))
    return repetitions.join(one_each, "repetition_id")


def memberships(contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The relation behind clusters: ``(repetition_id, key)``, distinct.

    The cluster of a document is the set of documents that share one of its
    repetitions. It is kept as this relation: written out as id sets, a
    repetition found in n documents would need n sets of n ids.
    """
    return contents.select(F.sha2("repetition", 256).alias("repetition_id"), key).distinct()


def clusters_by_repetition(
    members: DataFrame, key: str = "doc_id", max_ids: int = 1000
) -> DataFrame:
    """Sorted id lists per repetition, in numbered chunks of about ``max_ids``.

    Every id is listed; a repetition with more documents than ``max_ids``
    spreads over several rows instead of one unbounded array.
    """
    members = materialize(members)
    sizes = materialize(members.groupBy("repetition_id").agg(F.count("*").alias("num_docs")))
    chunks = F.ceil(F.col("num_docs") / F.lit(max_ids))
    counted = sizes.withColumn("fan_in", F.col("num_docs"))
    return (
        join_counted(members, counted, "repetition_id", "fan_in")
        .withColumn("chunk", F.pmod(F.xxhash64(key), chunks))
        .groupBy("repetition_id", "num_docs", "chunk")
        .agg(F.array_sort(F.collect_list(key)).alias("ids"))
    )


def document_clusters(members: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cluster members of the ``chosen`` documents: ``(key, member)``, distinct.

    For inspection of a handful of documents; the output has one row per
    member.
    """
    links = chosen.select(key).join(members, key)
    return links.join(
        members.withColumnRenamed(key, "member"), "repetition_id"
    ).select(key, "member").distinct()


def cluster_members(
    members: DataFrame, repetitions: DataFrame, documents: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Texts (and whatever else ``documents`` holds) behind chosen repetitions."""
    chosen = members.join(repetitions.select("repetition_id"), "repetition_id")
    return chosen.join(documents, key)


def annotate_duplicates(
    df: DataFrame,
    length: int = 50,
    unit: str = "bytes",
    ratio_unit: str | None = None,
    included: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The corpus with all duplicate columns; documents without any get zeros.

    ``included`` selects the documents that take part (all by default), as when
    ranges are computed on a sample. ``dup_ratio`` divides by the size of the
    text in ``ratio_unit``: the same unit as the ranges by default, or
    ``'chars'`` under byte ranges, in which case it may exceed 1.
    """
    takes_part = F.lit(True) if included is None else included
    sample = df.filter(takes_part)
    ranges = duplicate_ranges(sample, length, unit, key, text)
    info = dup_info(sample, ranges, unit, 0, key, text)
    # Sizes are taken before the join, so that texts go through it only if they are asked for.
    return (
        df.withColumn("included_in_dedup", takes_part)
        .withColumn("text_length", F.length(text).cast("bigint"))
        .withColumn("__size", text_size(text, ratio_unit or unit))
        .join(info, key, "left")
        .withColumn("dup_len", F.coalesce("dup_len", F.lit(0).cast("bigint")))
        .withColumn("pairs", F.coalesce("pairs", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
        .withColumn("repetitions", F.coalesce("repetitions", F.expr("cast(array() as array<binary>)")))
        .withColumn("dup_ratio", dup_ratio(F.col("dup_len"), F.col("__size")))
        .withColumn("dup_pct", dup_percent(F.col("dup_ratio")))
        .drop("__size")
    )


def dup_ratio(dup_len: Column, size: Column) -> Column:
    """Duplicated share of a text as a fraction; 0 for an empty text."""
    return F.coalesce(F.try_divide(dup_len.cast("double"), size.cast("double")), F.lit(0.0))


def dup_percent(ratio: Column) -> Column:
    """The share in hundredths of the fraction, rounded down."""
    return F.floor(ratio * F.lit(100.0)).cast("bigint")


def dedup_summary(ranges: DataFrame, contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents with duplicates, with a single range, distinct contents."""
    per_document = ranges.groupBy(key).agg(F.count("*").alias("ranges"))
    left = per_document.agg(
        F.count("*").alias("docs_with_dups"),
        F.count_if(F.col("ranges") == 1).alias("singleton_docs"),
        F.sum("ranges").alias("num_ranges"),
    )
    digests = contents.select(F.sha2("repetition", 256).alias("repetition_id"))
    right = digests.distinct().agg(F.count("*").alias("num_repetitions"))
    return left.withColumn("num_repetitions", right.scalar())


def drop_with_repetitions(df: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without any duplicated range."""
    return df.join(ranges.select(key).distinct(), key, "left_anti")


def dedup_filter(df: DataFrame, has_dup: str = "has_dup") -> DataFrame:
    """Two-tier filter on annotated documents.

    A document that took part stays if nothing of it is duplicated; one that
    did not stays if the lookup found nothing. Unknown counts as not found.
    """
    inside = F.coalesce(F.col("included_in_dedup"), F.lit(False))
    clean = F.coalesce(F.col("dup_ratio") == 0.0, F.lit(False))
    return df.filter((inside & clean) | (~inside & ~F.coalesce(F.col(has_dup), F.lit(False))))


def dup_subset(df: DataFrame, kind: str, column: str = "dup_ratio") -> DataFrame:
    """``dirty`` (> 0), ``clean`` (= 0) or ``above_one`` (> 1) documents."""
    tests = {
        "dirty": F.col(column) > 0,
        "clean": F.col(column) == 0,
        "above_one": F.col(column) > 1,
    }
    return df.filter(tests[kind])


def near_only(df: DataFrame) -> DataFrame:
    """Documents flagged as near duplicates in which no exact range was found."""
    return df.filter(F.col("near_dup") & (F.col("dup_ratio") == 0))


def near_cluster_size(df: DataFrame) -> DataFrame:
    """Total size of the clusters of the near-duplicate-only documents."""
    return near_only(df).agg(F.sum(F.size("near_dup_cluster")).alias("cluster_size"))


def dup_by_group(df: DataFrame, group: str, column: str = "dup_ratio") -> DataFrame:
    """Duplicate and clean documents per domain or source."""
    return df.groupBy(group).agg(
        F.count_if(F.col(column) > 0).alias("dup_docs"),
        F.count_if(F.col(column) == 0).alias("clean_docs"),
        F.avg(F.col(column)).alias("mean_dup_ratio"),
    )
