"""SpotSigs: fingerprints of chains of content words that follow common words.

Every common word (anchor) of a text starts a chain with the next content
words, common words between them skipped. The distinct chains are the text's
fingerprint. Sets are partitioned by length such that only sets of one or two
neighbouring partitions can be similar, and compared by a Jaccard that is
pruned by length and prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.components import components
from corpuslab.operators.links import resolved_links
from corpuslab.operators.order import row_ranks
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that for it was on are with as be this have from or by not "
    "der die das und ist von zu den mit sich auf für dem ein eine im nicht "
    "le la les des et est un une du dans que pour qui pas au sur "
    "el los las y en del se por con no para su al lo"
).split()

# Everything in ASCII but letters and digits parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, one branch per first letter."""
    letters = sorted({word[0] for word in words})
    rests = {letter: sorted({word[1:] for word in words if word[0] == letter}) for letter in letters}
    return "(?:" + "|".join(f"{letter}(?:{'|'.join(rests[letter])})" for letter in letters) + ")"


def spots(text: Column, anchors: list[str] = ANCHORS, length: int = 2) -> Column:
    """The sorted distinct chains of a text as 32-bit hashes.

    A chain is an anchor and the ``length`` content words after it; common
    words between them are left out. A text without a chain has the pairs of
    neighbouring words (a lone word by itself) instead, one without a word the
    hash of the text, an empty one none.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), BETWEEN, " ")), F.lit(" "))

    def hashed(found: Column) -> Column:
        return F.array_sort(F.array_distinct(found))

    def chains(segments: Column) -> Column:
        # A segment is a content word, a tab and the anchors after it; the first has anchors only.
        count = F.greatest(F.size(segments) - length, F.lit(0))
        shifted = [F.slice(segments, at + 1, count).alias(f"s{at}") for at in range(length + 1)]
        followed = F.filter(F.arrays_zip(*shifted), lambda x: (x["s0"] != "") & ~x["s0"].endswith("\t"))

        def of_segment(x: Column) -> Column:
            words = [F.substring_index(x[f"s{at}"], "\t", 1) for at in range(1, length + 1)]
            return F.transform(F.split(F.trim(F.substring_index(x["s0"], "\t", -1)), " "), lambda a: F.hash(a, *words))

        return F.flatten(F.transform(followed, of_segment))

    def of(body: Column) -> Column:
        cut = F.split(F.regexp_replace(body, f" (?!{any_of(anchors)} )([^ ]++)(?= )", "\n$1\t"), "\n")
        pairs = F.regexp_extract_all(body, F.lit(" (?=([^ ]++(?: [^ ]++)?) )"), F.lit(1))
        found = F.get(F.transform(F.array(cut), chains), 0)
        either = lambda x: F.when(F.size(x) > 0, hashed(x)).otherwise(hashed(F.transform(pairs, lambda p: F.hash(p))))
        return F.get(F.transform(F.array(found), either), 0)

    # Lambda variables keep the long strings from being made more than once.
    found = F.get(F.transform(F.array(plain), of), 0)
    lone = F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, s).otherwise(lone)), 0)


def fingerprint(spot_set: Column) -> Column:
    """Eight hexadecimal digits per chain."""
    return F.array_join(F.transform(spot_set, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))), 8, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard of two sets of chains; 1 for two empty ones."""
    common = F.size(F.array_intersect(one, other))
    union = F.size(one) + F.size(other) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.col(key).cast("bigint")
    return docs.select(own.alias("id"), body.alias("body"), F.xxhash64(own, body).alias("one"), F.hash(body, own).alias("two"))


def spot_signatures(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``fingerprint_edits`` of all texts, with the ``component_id`` of ``near_documents`` next to each."""
    near = _linked(docs, percent, key, text).groupBy("one", "two").agg(F.min("component_id").alias("component_id"))
    return _edited(docs, key, text, materialize(near))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by
    the first as many (or all) of the next document by descending key; the one
    after the last is the first. Returns ``key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, next_id``.

    A null text is empty. Null keys come last, equal keys in the order of a
    hash of the text; rows that agree in both are one document in that order,
    and each of them is returned. A lone document is followed by itself.
    """
    return _edited(docs, key, text)


def _edited(docs: DataFrame, key: str, text: str, near: DataFrame | None = None) -> DataFrame:
    """``fingerprint_edits``, with the further columns of ``near(one, two, ...)``, which has a row per document."""
    rows = _keyed(docs, key, text).select("id", "body", "one", "two", spots(F.col("body")).alias("spots"))
    heads = _keyed(docs, key, text).select("id", "one", "two", F.length("body").cast("bigint").alias("n")).distinct()
    heads = heads.withColumn("last", F.col("id").isNull()).withColumn("down", -F.coalesce(F.col("id"), F.lit(0)))
    ranks = materialize(row_ranks(heads, ["last", "down", "one", "two"], ["n"]))
    total = ranks.agg(F.count("*")).scalar()
    # A document gives its beginning to the one before it in that order.
    giver = ranks.select("one", "two", F.when(F.col("rank") == 1, total).otherwise(F.col("rank") - 1).alias("rank"))
    taker = ranks.select("rank", F.col("one").alias("to_one"), F.col("two").alias("to_two"), F.floor(F.col("n") / 2).alias("half"))
    plan = giver.join(taker, "rank").drop("rank")
    given = (
        rows.join(plan.hint("merge"), ["one", "two"])
        .groupBy(F.col("to_one").alias("one"), F.col("to_two").alias("two"))
        .agg(
            F.min(F.substring("body", F.lit(1), F.col("half").cast("int"))).alias("part"),
            F.min("spots").alias("next_spots"),
            # Read here too, so that both sides need the same columns and share one shuffle of the texts.
            F.min("id").alias("next_id"),
        )
    )
    size = F.length("body").cast("bigint")
    kept = F.substring("body", F.lit(1), (size - F.floor(size / 2)).cast("int"))
    both, more = rows.join(given, ["one", "two"]), []
    if near is not None:
        both, more = both.join(near, ["one", "two"], "left"), near.drop("one", "two").columns
    both = both.select(
        "id", "next_id", size.alias("n_chars"), "spots", "next_spots", F.concat(kept, "part").alias("edited"), *more
    )
    both = both.select(
        "id", "next_id", "n_chars", "spots", "next_spots", F.sha2("edited", 256).alias("sha"),
        spots(F.col("edited")).alias("edited_spots"), *more,
    )
    return both.select(
        F.col("id").alias(key),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        "next_id",
        *more,
    )


def near_documents(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose sets of chains have ``100 * Jaccard >= percent``.

    Returns ``key, n_spots, component_id`` (the smallest key reachable) per
    row. Equal sets are one node. Texts without a chain set (empty) are alone,
    null keys have a null component.
    """
    return _linked(docs, percent, key, text).select(F.col("id").alias(key), "n_spots", "component_id")


def _linked(docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """``id, one, two, n_spots, component_id`` per row; ``one`` and ``two`` as in ``_keyed``."""
    rows = _keyed(docs, key, text).select("id", "one", "two", spots(F.col("body")).alias("spots"))
    rows = materialize(
        rows.select("id", "one", "two", "spots", F.xxhash64("spots").alias("set_one"), F.hash("spots").alias("set_two"))
    )
    sets = materialize(
        rows.filter("size(spots) > 0 and id is not null")
        .groupBy("set_one", "set_two")
        .agg(F.min("id").alias("least_id"), F.first("spots").alias("shingles"), F.count("*").alias("copies"))
        .withColumn("n", F.size("shingles").cast("bigint"))
        # A number of its own: rows that share an id can hold several sets.
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Partition p holds the lengths from base**p on; a set is compared in its own and the next.
    base = 100 / percent
    partition = F.floor(F.log(F.col("n").cast("double")) / math.log(base) + 1e-9).cast("int")
    # Prefixes take the chains of one half first, chosen by hash: the lone ones, then those
    # of few sets; the others follow in their own order and need no count.
    sampled = lambda x: x.bitwiseAND(1) == 0
    known = sets.select("node", F.explode(F.filter("shingles", sampled)).alias("spot"))
    held = materialize(known.groupBy("spot").agg(F.count("*").alias("df")).filter("df > 1").withColumn("fan_in", F.col("df")))
    met = join_counted(known, held, "spot", "fan_in").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("order")
    )
    heads = sets.select(
        "node", "n", F.size(F.filter("shingles", sampled)).alias("sampled"), F.filter("shingles", lambda x: ~sampled(x)).alias("rest")
    )
    ordered = heads.join(met, "node", "left").withColumn("found", F.coalesce(F.col("order.spot"), F.array().cast("array<int>")))
    lone = F.col("sampled") - F.size("found")
    length = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - lone).cast("int")
    # All but lone chains bound what sets share.
    signatures = ordered.select(
        "node",
        "n",
        (F.col("n") - lone).alias("shared"),
        F.explode(F.array(partition, partition + 1)).alias("partition"),
        F.slice(F.concat("found", "rest"), 1, F.greatest(length, F.lit(0))).alias("prefix"),
    ).select("node", "n", "shared", "partition", F.explode("prefix").alias("spot"))
    signatures = signatures.select(F.xxhash64("partition", "spot").alias("signature"), "node", "n", "shared")
    reached = components(resolved_links(signatures, sets, percent))
    placed = sets.join(reached, "node", "left").select(
        "set_one", "set_two", "copies", "least_id", F.coalesce("component", "node").alias("component")
    )
    placed = materialize(placed)
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("fan_in"))
    named = join_counted(placed.drop("least_id"), materialize(least), "component", "fan_in").drop("component")
    return join_counted(rows, materialize(named), ["set_one", "set_two"], "copies", "left").select(
        "id",
        "one",
        "two",
        F.size("spots").cast("bigint").alias("n_spots"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
