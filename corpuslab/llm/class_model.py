"""Brown class-based n-gram model: exchange clustering, transitions and emissions.

Every word belongs to a class, and a text scores
``P(class | class before) * P(word | class)`` per token. Clustering moves units
between classes to raise the likelihood of the class bigrams. It is done twice: first
for the most frequent words and, as one unit each, the endings of all others;
then every other known word leaves the class of its ending for the one its own
neighbours call for, groups of words at the same time. Only words not known from training, and those rarer than a
fixed share of the tokens, stay with their ending, so the clustered vocabulary
grows with the evidence for its words. Counts cover all words of the corpus.

Words are named by 64-bit hashes throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shingles import blocks, mix, powers
from corpuslab.session import materialize

# Maps A-Z to a-z and ASCII white space to a space.
FOLD = bytes(
    32 if byte == 0x20 or 0x09 <= byte <= 0x0D else byte + 32 if 0x41 <= byte <= 0x5A else byte for byte in range(256)
)
# The end of a text, a number like that of a word, and characters of an ending.
END, ENDING = 1, 3
# Known words that are exchanged in turn by one task, about.
GROUP = 8000
# Bytes of texts that are counted together before their counts are sent.
BLOCK = 1 << 20
# Groups of units in the first rounds.
EARLY = 8

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, length: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < length:
        known = _powers[int(base)] = powers(base, max(length, BLOCK + (1 << 18)))
    return known[:length]


class Lines:
    """Hashes of all tokens of some texts (``words``), and the text each is in (``owner``).

    A text is its words and then an end. With ``lead`` an end stands before
    them all, as one stands before every text.
    """

    def __init__(self, texts: list[bytes], lead: bool = False) -> None:
        data = np.frombuffer((b"\n".join(texts) + b"\n").translate(FOLD), np.uint8)
        ends_of_texts = np.cumsum([len(text) + 1 for text in texts])
        gap = data == 32
        before = np.concatenate(([True], gap[:-1]))
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        owner = np.searchsorted(ends_of_texts, starts, side="right")
        codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self._data, self._total = data, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _power(_STEP, len(data)), out=self._total[1:])
        place = np.arange(len(starts)) + owner + lead
        size = len(starts) + len(texts) + lead
        self.words, self.owner = np.full(size, END, np.uint64), np.zeros(size, np.int64)
        self._starts, self._ends = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self._starts[place], self._ends[place] = starts, ends
        self.words[place], self.owner[place] = self._hashed(starts, ends), owner
        last = np.cumsum(np.bincount(owner, minlength=len(texts))) + np.arange(len(texts)) + lead
        self.owner[last] = np.arange(len(texts))
        self._characters: np.ndarray | None = None

    def _hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        unshift = _power(_BACK, len(self._total))[starts]
        return mix((self._total[ends] - self._total[starts]) * unshift + (ends - starts).astype(np.uint64))

    def endings(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the last characters of the tokens at some places; characters may be several bytes long."""
        if self._characters is None:
            begins = (self._data & 0xC0) != 0x80
            self._characters = np.flatnonzero(begins)
            self._before = np.concatenate(([0], np.cumsum(begins)))
        starts, ends = self._starts[at], self._ends[at]
        late = np.maximum(self._before[ends] - ENDING, self._before[starts])
        tail = np.where(ends > starts, self._characters[np.minimum(late, len(self._characters) - 1)], starts)
        out = self._hashed(tail, ends)
        out[self.words[at] == END] = END
        return out


class Named:
    """Words that are known by their hashes and those of their endings."""

    def __init__(self, words: np.ndarray, endings: np.ndarray) -> None:
        self.words, self._endings = words, endings

    def endings(self, at: np.ndarray) -> np.ndarray:
        return self._endings[at]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[Lines]:
    """Tokens of the first column, some texts at a time; an end stands before them all."""
    for batch in batches:
        texts = [(value.as_py() or "").encode("utf-8", "surrogatepass") for value in batch.column(0)]
        for low, high in blocks(texts, BLOCK):
            yield Lines(texts[low:high], lead=True)


def _numbers(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)) for _, values in columns]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in columns])


def count_tokens(texts: DataFrame) -> DataFrame:
    """Count of every token of all texts (first column): ``(word, ending, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _lines(batches):
            found, first, counts = np.unique(tokens.words[1:], return_index=True, return_counts=True)
            yield _numbers(("word", found), ("ending", tokens.endings(first + 1)), ("n", counts))

    counted = texts.mapInArrow(run, "word bigint, ending bigint, n bigint")
    return counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in a sorted table, and which of them are in it."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return at, (table[at] == values) if len(table) else np.zeros(len(values), bool)


class Units:
    """The unit a word is clustered as at first: itself, its ending, or the unit of all others."""

    def __init__(self, own: np.ndarray, endings: np.ndarray) -> None:
        self.own, self.endings = np.sort(own), np.sort(endings)
        self.size = len(own) + len(endings) + 1

    def of(self, tokens: Lines | Named) -> np.ndarray:
        out, here = _found(self.own, tokens.words)
        others = np.flatnonzero(~here)
        out[others] = self.of_endings(tokens.endings(others))
        return out

    def of_endings(self, endings: np.ndarray) -> np.ndarray:
        at, here = _found(self.endings, endings)
        return np.where(here, at + len(self.own), self.size - 1)


class Classes:
    """The class of every word: its own, if the word is known, or that of its ending."""

    def __init__(self, units: Units, of_unit: np.ndarray, known: np.ndarray, of_known: np.ndarray) -> None:
        self.units, self.of_unit, self.known, self.of_known = units, of_unit, known, of_known

    def of(self, tokens: Lines | Named) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, places among the known words, and which are known (as all units of their own are)."""
        at, here = _found(self.known, tokens.words)
        out = self.of_known[at] if len(self.known) else np.zeros(len(at), np.int64)
        others = np.flatnonzero(~here)
        out[others] = self.of_unit[self.units.of_endings(tokens.endings(others))]
        return out, at, here


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toPandas()[name].to_numpy(np.int64).view(np.uint64)


def choose_units(vocabulary: DataFrame, total: int, parts: int) -> Units:
    """Words, and endings of the other words, with at least 1/``parts`` of all tokens."""
    frequent = (F.col("n") * parts >= total) | (F.col("word") == END)
    endings = vocabulary.filter(~frequent).groupBy("ending").agg(F.sum("n").alias("n")).filter(F.col("n") * parts >= total)
    return Units(_column(vocabulary.filter(frequent), "word"), _column(endings, "ending"))


def count_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """Counts of neighbouring units; a text follows an end and is followed by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _lines(batches):
            line = units.of(tokens)
            codes, counts = np.unique(line[:-1] * units.size + line[1:], return_counts=True)
            yield _numbers(("one", codes // units.size), ("two", codes % units.size), ("n", counts))

    pairs = texts.mapInArrow(run, "one bigint, two bigint, n bigint")
    return pairs.groupBy("one", "two").agg(F.sum("n").alias("n"))


def class_bigrams(bigrams: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    """The bigrams of units added up to a matrix of classes."""
    pairs = _with_class(_with_class(bigrams, classes, "one"), classes, "two")
    return _matrix(pairs.groupBy(F.col("one_class").alias("one"), F.col("two_class").alias("two")).agg(F.sum("n").alias("n")), count)


def _matrix(pairs: DataFrame, count: int) -> np.ndarray:
    matrix = np.zeros((count, count))
    for row in pairs.collect():
        matrix[row["one"], row["two"]] = row["n"]
    return matrix


def class_matrix(texts: DataFrame, classes: Classes, count: int) -> np.ndarray:
    """Counts of neighbouring classes in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count * count, np.int64)
        for tokens in _lines(batches):
            total += _neighbours(classes.of(tokens)[0], count)
        yield _numbers(("unit", np.full(count * count, -1)), ("slot", np.arange(count * count)), ("n", total))

    pairs = texts.mapInArrow(run, "unit bigint, slot bigint, n bigint")
    return _square(pairs.groupBy("slot").agg(F.sum("n").alias("n")).toPandas(), count)


def _neighbours(line: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(line[:-1] * count + line[1:], minlength=count * count)


def _square(counted: pd.DataFrame, count: int) -> np.ndarray:
    matrix = np.zeros(count * count)
    matrix[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(float)
    return matrix.reshape(count, count)


def _with_class(bigrams: DataFrame, classes: np.ndarray, unit: str) -> DataFrame:
    """Add the class of a unit; the map has one row per unit, a bounded number."""
    table = pd.DataFrame({unit: np.arange(len(classes)), f"{unit}_class": classes})
    return bigrams.join(F.broadcast(bigrams.sparkSession.createDataFrame(table)), unit)


def _likelihood(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1.0))


def best_moves(
    units: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray, classes: np.ndarray, matrix: np.ndarray
) -> np.ndarray:
    """Exchange steps for some units one after the other; returns their new classes.

    ``into[u, c]`` counts a class before the unit, ``out[u, c]`` after it,
    ``own[u]`` the unit after itself. The likelihood of class bigrams is
    ``sum f(N(a, b)) - sum f(N(a, .)) - sum f(N(., b))`` with ``f(x) = x log x``.
    """
    matrix, moved = matrix.copy(), classes[units].copy()
    for at, unit in enumerate(units):
        home, before, after, loop = moved[at], into[at].copy(), out[at].copy(), own[at]
        # The unit is taken out of its class; bigrams with itself move with it.
        before[home] -= loop
        after[home] -= loop
        matrix[:, home] -= before
        matrix[home, :] -= after
        matrix[home, home] -= loop
        # What stands before and after the unit counts in the totals whatever its class.
        rows, columns = matrix.sum(1) + before, matrix.sum(0) + after
        gain = (_likelihood(matrix + before[:, None]) - _likelihood(matrix)).sum(0)
        gain += (_likelihood(matrix + after[None, :]) - _likelihood(matrix)).sum(1)
        corner = np.diagonal(matrix)
        gain += _likelihood(corner + before + after + loop) + _likelihood(corner)
        gain -= _likelihood(corner + before) + _likelihood(corner + after)
        gain -= _likelihood(rows + after.sum() + loop) - _likelihood(rows)
        gain -= _likelihood(columns + before.sum() + loop) - _likelihood(columns)
        best = int(np.argmax(gain))
        best = best if gain[best] > gain[home] + 1e-6 else home
        moved[at] = best
        matrix[:, best] += before
        matrix[best, :] += after
        matrix[best, best] += loop
    return moved


def exchange(bigrams: DataFrame, units: int, count: int, rounds: int) -> np.ndarray:
    """Classes of all units, a bounded number.

    In the first half of the rounds groups of units move at the same time, each
    by the counts all had before, which tells apart units that look alike at
    the start; in the second half one task exchanges all units in turn.
    """
    sizes = np.zeros(units)
    for row in bigrams.groupBy("two").agg(F.sum("n").alias("n")).collect():
        sizes[row.two] = row.n
    classes = np.zeros(units, np.int64)
    classes[np.argsort(-sizes, kind="stable")] = np.arange(units) % count
    for turn in range(rounds):
        matrix = class_bigrams(bigrams, classes, count)
        after = _with_class(bigrams, classes, "two").groupBy(F.col("one").alias("unit"), F.col("two_class").alias("class"))
        before = _with_class(bigrams, classes, "one").groupBy(F.col("two").alias("unit"), F.col("one_class").alias("class"))
        loops = bigrams.filter("one = two").select(F.col("one").alias("unit"), F.lit(0).alias("class"), "n", F.lit(2).alias("side"))
        near = (
            after.agg(F.sum("n").alias("n")).withColumn("side", F.lit(1))
            .unionByName(before.agg(F.sum("n").alias("n")).withColumn("side", F.lit(0)))
            .unionByName(loops)
        )

        groups = EARLY if 2 * turn < rounds else 1
        group = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(groups)).alias("group")
        moved = near.select("*", group).groupBy("group").applyInPandas(_mover(classes, matrix), "unit bigint, class bigint")
        changed = classes.copy()
        for row in moved.collect():
            changed[row["unit"]] = row["class"]
        if np.array_equal(changed, classes) and groups == 1:
            break
        classes = changed
    return classes


def _mover(classes: np.ndarray, matrix: np.ndarray):
    def move(rows: pd.DataFrame) -> pd.DataFrame:
        own_units, at = np.unique(rows["unit"], return_inverse=True)
        sides = np.zeros((3, len(own_units), len(matrix)))
        np.add.at(sides, (rows["side"].to_numpy(), at, rows["class"].to_numpy()), rows["n"].to_numpy())
        moved = best_moves(own_units, sides[0], sides[1], sides[2][:, 0], classes, matrix)
        return pd.DataFrame({"unit": own_units, "class": moved})

    return move


def refine(texts: DataFrame, classes: Classes, movable: np.ndarray, count: int) -> Classes:
    """One exchange step for every known word that is ``movable``, by the classes next to it in all texts.

    A task sends counts of a word's neighbouring classes, and of all classes
    next to each other; groups of about ``GROUP`` words move at the same time,
    each against the counts of all.
    """
    known, start = classes.known, classes.of_known
    width = 2 * count + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count * count, np.int64)
        for tokens in _lines(batches):
            words, (line, at, here) = tokens.words, classes.of(tokens)
            total += _neighbours(line, count)
            here &= movable[at]
            after, before = np.flatnonzero(here[1:]) + 1, np.flatnonzero(here[:-1])
            loops = before[words[before] == words[before + 1]]
            codes = np.concatenate(
                (at[after] * width + line[after - 1], at[before] * width + count + line[before + 1], at[loops] * width + 2 * count)
            )
            found, counts = np.unique(codes, return_counts=True)
            yield _numbers(("unit", found // width), ("slot", found % width), ("n", counts))
        yield _numbers(("unit", np.full(count * count, -1)), ("slot", np.arange(count * count)), ("n", total))

    near = texts.mapInArrow(run, "unit bigint, slot bigint, n bigint").groupBy("unit", "slot").agg(F.sum("n").alias("n"))
    near = materialize(near)
    matrix = _square(near.filter("unit = -1").toPandas(), count)
    groups = max(1, -(-int(movable.sum()) // GROUP))

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        own, at = np.unique(rows["unit"].to_numpy(), return_inverse=True)
        sides = np.zeros((len(own), width))
        np.add.at(sides, (at, rows["slot"].to_numpy()), rows["n"].to_numpy())
        moved = best_moves(own, sides[:, :count], sides[:, count : 2 * count], sides[:, 2 * count], start, matrix)
        return pd.DataFrame({"unit": own, "class": moved})

    group = F.pmod(F.xxhash64("unit"), F.lit(groups)).alias("group")
    moved = near.filter("unit >= 0").select("*", group).groupBy("group").applyInPandas(move, "unit bigint, class bigint").toPandas()
    of_known = start.copy()
    of_known[moved["unit"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
    return Classes(classes.units, classes.of_unit, known, of_known)


def score_texts(
    docs: DataFrame,
    folds: int = 5,
    held: int = 1,
    classes: int = 48,
    parts: int = 4_000,
    known_parts: int = 1_000_000,
    rounds: int = 6,
    refinements: int = 2,
    smoothing: float = 50.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Log10 probability of all texts under a unigram and a class bigram model.

    Both learn from the rows outside the held-out fold (``crc32(key as text) %
    folds = held``; a null key is not held out). Tokens are words (A-Z lowered,
    cut at ASCII white space) and one end per text. Returns ``key, held_out,
    n_tokens, n_known, train_tokens, base_score, score`` and ``perplexity``,
    that of the class model per token.

    A token counted c times of N, V distinct, has ``(c + 0.5) / (N + 0.5 * (V +
    1))`` in the unigram model; within its class the same with the class's N
    and V. A transition is smoothed with ``smoothing`` tokens of the class's
    own share. Null and empty texts are an end alone. Repeated rows are scored
    each; an empty table, or one held out as a whole, has N = 0.

    Words with 1/``parts`` of all tokens are exchanged in ``rounds`` rounds with
    the endings, all known words, those with 1/``known_parts``, in
    ``refinements`` more. Known words are sent to the tasks, as numbers; the
    counts of all others are looked up by a join.
    """
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(
        F.col(text).cast("string").alias("body"),
        F.col(key).alias("id"),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
    )
    training = rows.filter(~F.col("held_out")).select("body")
    vocabulary = materialize(count_tokens(training))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    units = choose_units(vocabulary, total, parts)
    bigrams = materialize(count_bigrams(training, units))
    count = max(1, min(classes, units.size))
    of_unit = exchange(bigrams, units.size, count, rounds)
    matrix = class_bigrams(bigrams, of_unit, count)

    # Units of their own are known, whatever is asked for.
    is_known = (F.col("n") * max(known_parts, parts) >= total) | (F.col("word") == END)
    known = vocabulary.filter(is_known).toPandas()
    known = known.assign(word=known["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
    names, endings = known["word"].to_numpy(), known["ending"].to_numpy(np.int64).view(np.uint64)
    first = units.of(Named(names, endings))
    model = Classes(units, of_unit, names, of_unit[first])
    # Words that were units by themselves have had their rounds.
    movable = first >= len(units.own)
    if movable.any() and refinements:
        for _ in range(refinements):
            model = refine(training, model, movable, count)
        matrix = class_matrix(training, model, count)

    kinds = words_of_classes(vocabulary, model, count)
    # Probabilities of classes, of transitions, and the denominator of words.
    own = (matrix.sum(0) + 1) / (matrix.sum() + count)
    step = np.log10((matrix + smoothing * own) / (matrix.sum(1, keepdims=True) + smoothing))
    below = np.log10(matrix.sum(0) + 0.5 * (kinds + 1))

    logs = np.log10(known["n"].to_numpy(np.int64) + 0.5)
    scanned = materialize(_scan(rows, model, logs, step - below[None, :]))
    rare = scanned.select("row", F.explode("rare").alias("word")).select("row", "word.*")
    looked_up = vocabulary.filter(~is_known).select("word", F.col("n").alias("c"))
    seen = F.coalesce("c", F.lit(0))
    added = rare.join(looked_up, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("more"),
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("found"),
    )
    log_counts = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    bottom = F.log10(F.lit(total + 0.5 * (distinct + 1)))
    return (
        scanned.drop("rare")
        .join(added, "row", "left")
        .select(
            F.col("id").alias(key),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            (log_counts - F.col("n_tokens") * bottom).alias("base_score"),
            (log_counts + F.col("steps")).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )


def words_of_classes(vocabulary: DataFrame, classes: Classes, count: int) -> np.ndarray:
    """Distinct words of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.zeros(count, np.int64)
        for batch in batches:
            words, endings = (batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64) for at in (0, 1))
            kinds += np.bincount(classes.of(Named(words, endings))[0], minlength=count)
        yield _numbers(("class", np.arange(count)), ("n", kinds))

    kinds = np.zeros(count)
    counted = vocabulary.select("word", "ending").mapInArrow(run, "class bigint, n bigint")
    for row in counted.groupBy("class").agg(F.sum("n").alias("n")).collect():
        kinds[row["class"]] = row["n"]
    return kinds


def _scan(rows: DataFrame, classes: Classes, logs: np.ndarray, step: np.ndarray) -> DataFrame:
    """Per text what needs no lookup, and its rare words with their number."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "row", "n_tokens", "n_known", "log_counts", "steps", "rare"]

    def scored(texts: list[bytes]) -> list[pa.Array]:
        tokens = Lines(texts)
        words, owner, (line, at, here) = tokens.words, tokens.owner, classes.of(tokens)
        end = np.array([END], np.uint64)
        before = np.concatenate((classes.of(Named(end, end))[0], line[:-1]))
        count = len(texts)
        # Rare words of a text, each once with how often it occurs.
        order = np.lexsort((words[~here], owner[~here]))
        rare, own = words[~here][order], owner[~here][order]
        opens = np.concatenate(([True], (rare[1:] != rare[:-1]) | (own[1:] != own[:-1])))[: len(rare)]
        starts = np.flatnonzero(opens)
        times = np.diff(np.append(starts, len(rare)))
        offsets = np.searchsorted(own[starts], np.arange(count + 1)).astype(np.int32)
        fields = [pa.array(rare[starts].view(np.int64)), pa.array(times.astype(np.int64))]
        held = pa.StructArray.from_arrays(fields, ["word", "times"])
        return [
            pa.array(np.bincount(owner, minlength=count)),
            pa.array(np.bincount(owner[here], minlength=count)),
            pa.array(np.bincount(owner[here], weights=logs[at[here]], minlength=count)),
            pa.array(np.bincount(owner, weights=step[before, line], minlength=count)),
            pa.ListArray.from_arrays(pa.array(offsets), held),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [(value.as_py() or "").encode("utf-8", "surrogatepass") for value in batch.column("body")]
            for low, high in blocks(texts):
                part = batch.slice(low, high - low)
                numbers = pa.array(np.arange(first, first + high - low))
                first += high - low
                columns = [part.column("id"), part.column("held_out"), numbers, *scored(texts[low:high])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(
        run,
        f"id {id_type}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, log_counts double, "
        "steps double, rare array<struct<word: bigint, times: bigint>>",
    )
