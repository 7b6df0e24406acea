"""Collocations from a weighted de Bruijn graph of words.

Of every piece only the longest grams are counted: the gram that starts at each
word, which is shorter near the end of its piece. Longest grams are edges
between the overlapping grams of one word less (nodes); the shorter ones are
the ends of pieces. A node occurs as often as its edges and its piece ends say,
and so do its own beginnings: all shorter counts follow from the flow of the
nodes and the piece ends, without another look at the texts. Nodes that follow
one another without a branch (unary paths) are compacted to one passage.

Grams below the minimum are in no candidate and in no part of one, so the gram
at a word goes only as far as every shorter gram in it may be frequent. That is
known from a map for each size, of a fixed number of bits, in which every
frequent gram has one: what is frequent is never cut short, whatever the size of
the tables. Sizes are counted one after the other, each only where the maps of
the sizes before leave a chance.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.shingles import mix, powers
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

MAP_BITS = 22
BLOCK = 1 << 22
# Distinct grams a task holds before it sends their counts.
HELD = 1 << 18
SALTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = powers(np.uint64(0xD6E8FEB86659FD93), 64)
# Pieces end at . , ; : ! ? and line breaks; words at spaces and tabs.
_FOLD = bytes(
    10 if chr(byte) in ".,;:!?\n\v\f\r" else 32 if byte == 9 else byte + 32 if 0x41 <= byte <= 0x5A else byte
    for byte in range(256)
)


def mine_phrases(
    docs: DataFrame,
    minimum: int = 100,
    longest: int = 5,
    top: int = 2000,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language.

    ``lang, rank, phrase, a, l, r, n, score``: a phrase with at least
    ``minimum`` occurrences ``a``, cut in two parts with ``l`` and ``r``, among
    ``n`` words; ``score`` is the least ``floor(1000 a n / (l r))`` of all cuts
    (the shortest first part in a tie). Phrases inside a longer one that occurs
    as often are left out. A null language is ``und``; null and empty texts
    have no words; repeated rows count as often as they occur. Arithmetic is
    done on whole numbers of any size.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
    )
    maps: list[np.ndarray] = []
    for _ in range(1, longest):
        maps.append(_bits(_codes(rows, list(maps)), minimum))
    counted = rows.mapInArrow(_edges(maps, longest), "lang string, gram string, size int, n bigint")
    edges = materialize(counted.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n")))
    totals = materialize(edges.filter("size = 0").select("lang", F.col("n").alias("total")))
    frequent = materialize(_frequent(edges.filter("size > 0"), minimum, longest))
    return _ranked(_scored(frequent, totals), top)


def _begin(gram: str = "gram", size: str = "size") -> Column:
    """All words but the last."""
    return F.expr(f"substring_index({gram}, ' ', {size} - 1)")


def _rest(gram: str = "gram") -> Column:
    """All words but the first."""
    return F.expr(f"substring({gram}, instr({gram}, ' ') + 1)")


def _frequent(edges: DataFrame, minimum: int, longest: int) -> DataFrame:
    """``(lang, gram, size, n)`` of all grams of ``minimum`` occurrences or more."""
    whole = edges.filter(F.col("size") == longest)
    kept = [whole.filter(F.col("n") >= minimum)]
    nodes = materialize(_flow(whole, edges, longest - 1))
    if longest > 2:
        passages = materialize(compact(kept[0], nodes.filter(F.col("n") >= minimum)))
        # Nodes of a passage are its windows; all have its count.
        size = longest - 1
        windows = F.expr(f"transform(sequence(1, size(words) - {size - 1}), i -> array_join(slice(words, i, {size}), ' '))")
        words = passages.select("lang", F.split("passage", " ").alias("words"), "n")
        inside = words.select("lang", F.explode(windows).alias("gram"), F.lit(size).alias("size"), "n")
        kept.append(inside)
        level = inside.unionByName(nodes.filter(F.col("n") < minimum))
        for size in range(longest - 2, 0, -1):
            level = materialize(_flow(level, edges, size))
            kept.append(level.filter(F.col("n") >= minimum))
    else:
        kept.append(nodes.filter(F.col("n") >= minimum))
    found = kept[0]
    for part in kept[1:]:
        found = found.unionByName(part)
    return found


def _flow(longer: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Counts of grams of ``size``: what goes out of them, and the pieces that end with them."""
    out = longer.select("lang", _begin().alias("gram"), "n")
    ends = edges.filter(F.col("size") == size).select("lang", "gram", "n")
    return out.unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", "gram", F.lit(size).alias("size"), "n")


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unary paths ``(lang, passage, n)``; every node lies on exactly one, if only its own.

    Two nodes follow one another on a path if their edge is all that leaves the
    one and all that enters the other. Nodes find the head of their path by
    doubling: each asks the node it points at where that one points. No such
    path is a ring, since the first occurrence in a text is entered by no edge.
    """
    start, end = nodes.select("lang", F.col("gram").alias("one"), "n"), nodes.select("lang", F.col("gram").alias("two"), "n")
    links = edges.select("lang", _begin().alias("one"), _rest().alias("two"), "n")
    links = links.join(start, ["lang", "one", "n"]).join(end, ["lang", "two", "n"]).select("lang", "one", "two")
    state = nodes.join(links.withColumnRenamed("two", "gram"), ["lang", "gram"], "left").select(
        "lang", "gram", "n", F.coalesce("one", "gram").alias("head"), F.col("one").isNotNull().cast("bigint").alias("steps")
    )
    state = materialize(state)
    moved = -1
    while True:
        total = state.agg(F.sum("steps")).first()[0] or 0
        if total == moved:
            break
        moved = total
        ahead = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        ahead = ahead.filter("more > 0")
        state = state.join(ahead, ["lang", "head"], "left").select(
            "lang", "gram", "n", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        )
        state = materialize(state)
    # As long as one text at most.
    order = F.array_sort(F.collect_list(F.struct("steps", F.substring_index("gram", " ", -1).alias("word"))))
    paths = state.groupBy("lang", "head").agg(order.alias("line"), F.max("n").alias("n"))
    tail = F.expr("array_join(transform(slice(line, 2, size(line)), x -> x.word), ' ')")
    return paths.select("lang", F.when(F.size("line") > 1, F.concat_ws(" ", "head", tail)).otherwise(F.col("head")).alias("passage"), "n")


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the cut of the lowest score."""
    candidates = frequent.filter("size > 1")
    # What holds a phrase and is as frequent holds it with one word more, as frequent too.
    longer = candidates.filter("size > 2")
    inside = longer.select("lang", _begin().alias("gram"), "n").unionByName(longer.select("lang", _rest().alias("gram"), "n"))
    inside = inside.groupBy("lang", "gram").agg(F.max("n").alias("most"))
    left = candidates.join(inside, ["lang", "gram"], "left").filter("most is null or 100 * most < 100 * n")
    parts = F.expr(
        """flatten(transform(sequence(1, size - 1), k -> array(
            named_struct('cut', k, 'first', true, 'part', substring_index(gram, ' ', k)),
            named_struct('cut', k, 'first', false, 'part', substring_index(gram, ' ', k - size)))))"""
    )
    asked = materialize(left.select("lang", "gram", F.col("n").alias("a"), F.inline(parts)))
    wanted = asked.groupBy("lang", "part").agg(F.count("*").alias("fan_in"))
    counts = frequent.select("lang", F.col("gram").alias("part"), F.col("n").alias("f")).join(wanted, ["lang", "part"])
    answered = join_counted(asked, materialize(counts), ["lang", "part"], "fan_in")
    cuts = materialize(
        answered.groupBy("lang", "gram", "a").agg(F.collect_list(F.struct("cut", "first", "f")).alias("cuts"))
    )
    sizes = cuts.groupBy("lang").agg(F.count("*").alias("fan_in")).join(totals, "lang")
    both = join_counted(cuts, materialize(sizes), "lang", "fan_in")
    schema = "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    return both.select("lang", "gram", "a", "cuts", "total").mapInArrow(_lowest_cuts, schema)


def _lowest_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "phrase", "a", "l", "r", "n", "score"]
    for batch in batches:
        out = []
        for lang, gram, a, cuts, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            counts = {(cut["cut"], cut["first"]): cut["f"] for cut in cuts}
            scores = [
                (1000 * a * n // (counts[k, True] * counts[k, False]), k) for k in range(1, len(counts) // 2 + 1)
            ]
            score, k = min(scores)
            out.append((lang, gram, a, counts[k, True], counts[k, False], n, score))
        columns = zip(*out, strict=True) if out else [()] * len(names)
        types = [pa.string(), pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first of each language: of each of a fixed number of shares, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = Window.partitionBy("lang", "share").orderBy(*order)
    kept = shares.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).drop("share", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


class _Words:
    """The words of a block of texts: where they are, their piece, and a hash of word and language."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        joined = (b"\n".join(texts) + b"\n").translate(_FOLD)
        self.data = joined
        data = np.frombuffer(joined, np.uint8)
        stop = data == 10
        gap = stop | (data == 32)
        before = np.concatenate(([True], gap[:-1]))
        self.starts, self.ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        self.piece = np.cumsum(stop)[self.starts]
        self.owner = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), self.starts, side="right")
        codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(_STEP, len(data)), out=total[1:])
        unshift = powers(_BACK, len(data))[self.starts]
        plain = mix((total[self.ends] - total[self.starts]) * unshift + (self.ends - self.starts).astype(np.uint64))
        known: dict[str, int] = {}
        self.lang = np.array([known.setdefault(lang, len(known)) for lang in langs], np.int64)[self.owner]
        self.langs = list(known)
        seeds = np.array([int.from_bytes(_digest(lang), "little") for lang in known], np.uint64)
        self.code = mix(plain + seeds[self.lang]) if len(plain) else plain

    def gram_codes(self, size: int) -> np.ndarray:
        """A hash of the gram of ``size`` words at every word that has as many after it."""
        count = max(0, len(self.code) - size + 1)
        if size == 1:
            return self.code
        total = np.zeros(count, np.uint64)
        for offset in range(size):
            total += self.code[offset : offset + count] * _ODD[offset + size]
        return mix(total)

    def possible(self, maps: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For sizes 1, 2, ... whether the gram at each word may be frequent; the last size is not in the maps."""
        inside = self.piece[:-1] == self.piece[1:]
        able = np.ones(len(self.code), bool)
        for size, bits in enumerate([*maps, None], 1):
            if size > 1:
                # Both grams of one word less, in one piece.
                able = able[:-1] & able[1:] & inside[: len(able) - 1] if len(able) > 1 else able[:0]
            if bits is not None:
                able = able & _has(bits, self.gram_codes(size)[: len(able)])
            yield able


def _digest(lang: str) -> bytes:
    return hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of some texts at a time; batches are gathered, so that fewer counts are sent."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
            langs.append(lang)
            texts.append(body.as_py().encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= BLOCK:
                yield _Words(langs, texts)
                langs, texts, size = [], [], 0
    if texts:
        yield _Words(langs, texts)


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = (codes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _codes(rows: DataFrame, maps: list[np.ndarray]) -> DataFrame:
    """``(code, n)`` of the grams one word longer than the maps tell of; counts of single blocks.

    Codes have 32 bits: grams that share one are only taken for more frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            *_, able = block.possible(maps)
            codes = block.gram_codes(len(maps) + 1)[: len(able)][able].astype(np.uint32)
            values, counts = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int32)), pa.array(counts)], ["code", "n"])

    return rows.mapInArrow(run, "code int, n bigint")


def _bits(codes: DataFrame, minimum: int) -> np.ndarray:
    """A map of ``2 ** MAP_BITS`` bits with one for each code of ``minimum`` occurrences or more."""
    frequent = codes.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= minimum)
    set_bits = frequent.select(F.expr(f"code & {(1 << MAP_BITS) - 1}").alias("bit")).distinct().toPandas()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[set_bits["bit"].to_numpy()] = True
    return np.packbits(bits)


def _edges(maps: list[np.ndarray], longest: int):
    names = ["lang", "gram", "size", "n"]

    def merged(parts: list[tuple]) -> tuple:
        """Grams of several blocks, each once."""
        codes, counts = (np.concatenate([part[at] for part in parts]) for at in (0, 1))
        codes, first, group = np.unique(codes, return_index=True, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, group, counts)
        columns = [pa.concat_arrays([part[at] for part in parts]).take(pa.array(first)) for at in (2, 3, 4)]
        return codes, total, *columns

    def sent(part: tuple) -> pa.RecordBatch:
        _, counts, langs, grams, sizes = part
        return pa.RecordBatch.from_arrays([langs, grams, sizes, pa.array(counts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words: Counter = Counter()
        for block in _blocks(batches):
            words.update(dict(zip(block.langs, np.bincount(block.lang, minlength=len(block.langs)).tolist(), strict=True)))
            reach = np.zeros(len(block.code), np.int64)
            for size, able in enumerate(block.possible(maps), 1):
                reach[: len(able)][able] = size
            places = np.flatnonzero(reach)
            if not len(places):
                continue
            size = reach[places]
            code = mix(size.astype(np.uint64))
            for offset in range(longest):
                here = size > offset
                code[here] += block.code[places[here] + offset] * _ODD[offset + 3]
            codes, first, counts = np.unique(code, return_index=True, return_counts=True)
            places, size = places[first], size[first]
            last = places + size - 1
            begin, end = block.starts[places], block.ends[last]
            lengths = np.concatenate(([0], np.cumsum(block.ends - block.starts)))
            plain = end - begin == lengths[last + 1] - lengths[places] + size - 1
            grams = [block.data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            for at in np.flatnonzero(~plain):  # more than one space between words
                grams[at] = b" ".join(gram for gram in grams[at].split(b" ") if gram)
            langs = pa.array(block.langs, pa.string()).take(pa.array(block.lang[places]))
            held.append((codes, counts, langs, pa.array(grams, pa.binary()).cast(pa.string()), pa.array(size.astype(np.int32))))
            if sum(len(part[0]) for part in held) >= 2 * HELD:
                held = [merged(held)]
                if len(held[0][0]) >= HELD:
                    yield sent(held.pop())
        if held:
            yield sent(merged(held))
        # Of size 0: all words of a language.
        totals = [list(words), [None] * len(words), [0] * len(words), list(words.values())]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(totals, kinds, strict=True)], names)

    return run
