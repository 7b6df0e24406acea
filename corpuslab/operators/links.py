"""Links between similar sets that share a signature, enough of them to know all components.

Who meets whom is decided by signatures (rare elements, bands); here the sets
that share one are compared, without making all pairs of a group. Most pairs
that are not similar enough are told by counts and by a map of bits of each set
before they become rows; all others are verified on the whole sets.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.components import components
from corpuslab.operators.skew import join_counted, possible
from corpuslab.session import materialize

# Leaders of a group in one round, and pairs of one set that a task is given.
SLOTS, MANY = 4096, 4096
# A group with more than this share of the rows is compared by several tasks.
SPLITS = 512
# Words of 64 bits in the map of a set.
WORDS = 8


def resolved_links(signatures: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)``: they connect the same sets as all links between sets that share a signature.

    ``signatures`` has ``(signature, node, n, shared)``, ``whole`` the sets
    ``(node, n, shingles)``; two sets link when ``100 * intersection >=
    percent * union``. Each round picks leaders in every signature group: of
    each of ``slots`` slots, dealt anew each round, the set with the fewest
    shingles of its own that has not led yet, which most others were copied from. All sets of
    the group are compared with the leaders they are not yet connected to, no
    pair twice. Components found so far are kept as labels and only joined by
    new links. Groups that still hold several components go on, with more
    slots, until all sets have led but those of the largest component, which
    the others have then been compared with.

    A set has at most its shared shingles in common with another one, so its
    own shingles bound the size of a partner (``most``). A set that no size in
    its group suits leaves the group.
    """
    n, shared = F.col("n"), F.col("shared")
    rows = _distinct_groups(materialize(signatures.distinct())).select(
        "signature", "node", "n", "shared", (F.floor(shared * 100 / F.lit(percent)) + shared - n).alias("most"),
        F.col("node").alias("label"), F.lit(False).alias("led"),
    )
    found, compared, slots, turn = None, None, 1, 0
    while True:
        by_label = rows.groupBy("signature", "label").agg(
            F.min("n").alias("least"), F.max("most").alias("largest"), F.count("*").alias("members")
        )
        groups = materialize(
            by_label.groupBy("signature")
            .agg(
                F.max_by("label", F.struct("members", "label")).alias("major"),
                F.min("least").alias("least"),
                F.max("largest").alias("largest"),
                F.sum("members").alias("fan_in"),
                F.count("*").alias("labels"),
            )
            .filter("labels > 1")
            .drop("labels")
        )
        suited = join_counted(rows, groups, "signature", "fan_in").filter("most >= least and n <= largest")
        suited = suited.select(*rows.columns, "major")
        if "parity" not in rows.columns:
            suited = suited.join(_parities(whole), "node", "left")
        active = materialize(suited)
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots).cast("bigint"))
        lone = (F.col("n") - F.col("shared")).alias("lone")
        able = active.filter(~F.col("led") & (F.col("label") != F.col("major")))
        leaders = able.groupBy("signature", slot.alias("slot")).agg(
            F.min(F.struct(lone, "node", "n", "shared", "label", "parity")).alias("lead")
        )
        leaders = materialize(leaders.select("signature", "lead.*"))
        if leaders.isEmpty():
            return found if found is not None else _no_links(rows)
        fan = active.groupBy("signature").agg(F.count("*").alias("fan_in"))
        open_groups = materialize(leaders.select("signature").distinct().join(fan, "signature"))
        pairs = _candidates(active, leaders, open_groups, percent)
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        compared = pairs if compared is None else materialize(compared.unionByName(pairs))
        links = materialize(_verified(pairs, whole, percent))
        found = links if found is None else materialize(found.unionByName(links))
        # A group without a leader is done.
        active = join_counted(active.drop("major"), open_groups, "signature", "fan_in")
        rows = active.join(leaders.select("signature", "node", F.lit(True).alias("leads")), ["signature", "node"], "left")
        rows = rows.withColumn("led", F.col("led") | F.coalesce("leads", F.lit(False))).drop("leads")
        if not links.isEmpty():
            rows = _relabelled(rows, active, links)
        rows = materialize(rows)
        slots, turn = min(slots * 8, SLOTS), turn + 1


def _candidates(active: DataFrame, leaders: DataFrame, open_groups: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of a set and a leader of its group that may link; a large group is dealt to several tasks."""
    total = open_groups.agg(F.sum("fan_in")).scalar()
    salts = F.ceil(F.col("fan_in") * F.lit(float(SPLITS)) / total).cast("int")
    hot = materialize(open_groups.select("signature", salts.alias("salts")).filter("salts > 1"))
    dealt = F.coalesce("salts", F.lit(1))
    members = active.join(F.broadcast(hot), "signature", "left").select(
        "signature", F.pmod(F.xxhash64("node"), dealt.cast("bigint")).cast("int").alias("salt"),
        "node", "n", "shared", "label", "parity",
    )
    heads = leaders.join(F.broadcast(hot), "signature", "left").select(
        F.col("signature").alias("of"), F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"),
        *[F.col(name).alias(f"lead_{name}") for name in ("node", "n", "shared", "label", "parity")],
    )
    meet = (F.col("signature") == F.col("of")) & (F.col("salt") == F.col("part")) & (F.col("label") != F.col("lead_label"))
    both = F.col("n") + F.col("lead_n")

    def enough(common: Column) -> Column:
        return common * (100 + percent) >= both * percent

    # Every bit in which the maps differ stands for a shingle that only one of the sets has.
    bits = [F.bit_count(F.col("parity")[at].bitwiseXOR(F.col("lead_parity")[at])) for at in range(WORDS)]
    differing = F.coalesce(reduce(add, bits), F.lit(0))
    suits = enough(F.least("shared", "lead_shared", "n", "lead_n")) & enough(F.shiftright(both - differing, 1))
    met = members.join(heads, meet & suits)
    return met.select(F.greatest("node", "lead_node").alias("a"), F.least("node", "lead_node").alias("b")).distinct()


def _parities(whole: DataFrame) -> DataFrame:
    """``(node, parity)``: for each of 512 places whether an odd number of the set's shingles fall there.

    Null where the rows of a node do not hold one set once.
    """
    placed = whole.select("node", "n", F.explode("shingles").alias("shingle")).select(
        "node", "n", F.expr(f"shiftright(shingle, 6) & {WORDS - 1}").alias("word"),
        F.expr("shiftleft(1L, cast(shingle & 63 as int))").alias("bit"),
    )
    words = [F.bit_xor(F.when(F.col("word") == at, F.col("bit")).otherwise(F.lit(0).cast("bigint"))) for at in range(WORDS)]
    made = placed.groupBy("node").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("held"), *[w.alias(f"p{i}") for i, w in enumerate(words)]
    )
    parity = F.when(F.expr("least = held and most = held"), F.array(*[f"p{at}" for at in range(WORDS)]))
    return made.select("node", parity.alias("parity"))


def _distinct_groups(signatures: DataFrame) -> DataFrame:
    """Signatures of several sets, one of those that have the same sets: a shared passage gives many of these."""
    groups = signatures.groupBy("signature").agg(
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.sum(F.hash("node").cast("bigint")).alias("two"),
        F.count("*").alias("fan_in"),
    )
    kept = groups.filter("fan_in > 1").groupBy("one", "two", "fan_in").agg(F.min("signature").alias("signature"))
    return materialize(join_counted(signatures, materialize(kept.select("signature", "fan_in")), "signature", "fan_in"))


def _no_links(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def _relabelled(rows: DataFrame, active: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the labels that the new links join made one."""
    label = active.select("node", "label").distinct()
    ends = links.join(label.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
    ends = ends.join(label.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    joined = components(ends.select("x", "y").distinct(), "x", "y")
    joined = joined.withColumnsRenamed({"node": "label", "component": "joined"})
    fan = rows.groupBy("label").agg(F.count("*").alias("fan_in"))
    counted = materialize(joined.join(fan, "label"))
    moved = join_counted(rows, counted, "label", "fan_in", "left")
    return moved.withColumn("label", F.coalesce("joined", "label")).select(*rows.columns)


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough; a set in very many pairs is sent to several tasks, one in none stays."""
    sets = whole.select("node", "n", "shingles")

    def with_set(df: DataFrame, side: str) -> DataFrame:
        asked = df.groupBy(side).agg(F.count("*").alias("fan_in"))
        own = sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"set_{side}"))
        own = possible(own, df, side)
        hot = materialize(asked.filter(F.col("fan_in") > MANY))
        split = F.ceil(F.coalesce("fan_in", F.lit(1)) / MANY).cast("int")
        salts = F.sequence(F.lit(0), F.greatest(split, F.lit(1)) - 1)
        offered = own.join(hot, side, "left").withColumn("salt", F.explode(salts)).drop("fan_in")
        salt = F.pmod(F.xxhash64("a", "b"), F.greatest(split, F.lit(1)).cast("bigint")).cast("int")
        placed = df.join(hot, side, "left").withColumn("salt", salt).drop("fan_in")
        return placed.join(offered, [side, "salt"]).drop("salt")

    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        with_set(with_set(pairs, "a"), "b")
        .select("a", "b", "n_a", "n_b", common.alias("common"))
        .filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent)
        .select("a", "b")
    )
