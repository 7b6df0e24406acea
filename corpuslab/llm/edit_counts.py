"""Token counts that follow edits.

A document keeps a segment tree: its leaves are runs of pre-tokens, every node
holds the characters and tokens below it. An edit re-encodes the leaves it
touches and the leaf before them (an edit can change where the pre-token before
it ends), goes on to the next border of a leaf that is a border of pre-tokens
again, and updates the sums on the paths to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.tokens import Encoder, vocabulary_path

EDIT = "struct<start: bigint, deleted: bigint, inserted: string>"
TREE = "struct<leaves: bigint, chars: array<bigint>, tokens: array<bigint>>"
_TREE = pa.struct(
    [("leaves", pa.int64()), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]
)
PRE_TOKENS = 24
# Distinct pre-tokens whose number of tokens a task remembers.
REMEMBERED = 500_000
# A document that holds this is split there before anything else.
SPECIAL = "<|endoftext|>"


class Counter:
    """Cuts texts at pre-token borders and counts the tokens of pre-tokens."""

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import public_tokenizers

        self.encoder = Encoder(tokenizer, ranks)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        number = self.known.get(pre_token)
        if number is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            number = self.known[pre_token] = len(self.encoder.ids(pre_token))
        return number

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; the special string is one of its own."""
        found = []
        for at, part in enumerate(text.split(SPECIAL)):
            found += [SPECIAL] * (at > 0) + self.pattern.findall(part)
        return found

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a text."""
        chars, tokens = [], []
        size = number = held = 0
        for pre_token in self.pre_tokens(text):
            size, number, held = size + len(pre_token), number + self.count(pre_token), held + 1
            if held == PRE_TOKENS:
                chars.append(size)
                tokens.append(number)
                size = number = held = 0
        if held:
            chars.append(size)
            tokens.append(number)
        return chars, tokens


class Tree:
    """Sums over leaves in an array: node i has the children 2 i and 2 i + 1."""

    def __init__(self, leaves: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves, self.chars, self.tokens = leaves, chars, tokens

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1
        while width < max(1, len(chars)):
            width *= 2
        sums = []
        for values in (chars, tokens):
            nodes = np.zeros(2 * width, np.int64)
            nodes[width : width + len(values)] = values
            level = width
            while level > 1:
                nodes[level // 2 : level] = nodes[level : 2 * level : 2] + nodes[level + 1 : 2 * level : 2]
                level //= 2
            sums.append(nodes)
        return cls(max(1, len(chars)), *sums)

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts; the last one for the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1] > 0:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more = (chars - int(self.chars[node]), tokens - int(self.tokens[node]))
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2


def apply_edit(counter: Counter, tree: Tree, text: str, start: int, deleted: int, inserted: str) -> tuple[str, Tree, int]:
    """The text and tree after an edit, and how many characters were encoded for it."""
    start = min(max(start, 0), len(text))
    deleted = min(max(deleted, 0), len(text) - start)
    edited = text[:start] + inserted + text[start + deleted :]
    if SPECIAL in text or SPECIAL in edited:
        # The special string is found before anything else, so any leaf may change.
        return edited, Tree.build(*counter.leaves(edited)), len(edited)
    leaf, begin = tree.find(max(0, start - 1))
    while leaf and begin > start - 3:
        leaf -= 1
        begin -= int(tree.chars[tree.width + leaf])
    if leaf:
        leaf -= 1
        begin -= int(tree.chars[tree.width + leaf])
    shift = len(inserted) - deleted
    # Borders of leaves behind the edit, as places in the edited text.
    last, border = leaf, begin
    while last < tree.leaves and border < start + deleted:
        border += int(tree.chars[tree.width + last])
        last += 1
    sizes, numbers, place, goal = [], [], begin, border + shift
    for found in counter.pattern.finditer(edited, begin):
        while place > goal and last < tree.leaves:
            goal += int(tree.chars[tree.width + last])
            last += 1
        if place == goal and place >= start + len(inserted) and last > leaf:
            break
        sizes.append(len(found[0]))
        numbers.append(counter.count(found[0]))
        place = found.end()
    else:
        last = tree.leaves
    room = max(1, last - leaf)
    if len(sizes) > 4 * PRE_TOKENS * room:
        return edited, Tree.build(*counter.leaves(edited)), len(edited)
    cuts = [len(sizes) * step // room for step in range(room + 1)]
    for step in range(room):
        part = slice(cuts[step], cuts[step + 1])
        tree.put(leaf + step, sum(sizes[part]), sum(numbers[part]))
    return edited, tree, place - begin


def count_tokens(
    docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, text: str = "text"
) -> DataFrame:
    """Add ``n_tokens`` and the segment ``tree`` of every text (null: empty) to the rows."""
    names = [name for name in docs.columns if name not in ("n_tokens", "tree")]
    tokenizer = tokenizer or vocabulary_path("byte_bpe_50k.json")
    ranks = ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, ranks)
        for batch in batches:
            trees = [Tree.build(*counter.leaves(value.as_py() or "")) for value in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [pa.array([int(tree.tokens[1]) for tree in trees], pa.int64()), _pack(trees)],
                [*names, "n_tokens", "tree"],
            )

    return docs.select(*names).mapInArrow(run, f"{_schema(docs, names)}, n_tokens bigint, tree {TREE}")


def recount(
    counted: DataFrame,
    edits: str = "edits",
    tokenizer: str | None = None,
    ranks: str | None = None,
    text: str = "text",
) -> DataFrame:
    """Apply the edits of each row, in order, to its text and tree.

    ``edits`` is an array of ``(start, deleted, inserted)`` in characters of
    the text as the edits before left it; ranges are cut to the text, null
    edits and null parts change nothing. The text, ``n_tokens`` and ``tree``
    become those of the edited text; ``encoded_chars`` says how many characters
    were encoded again. Null texts are empty, repeated rows are counted each,
    other columns are kept.
    """
    names = [name for name in counted.columns if name not in (edits, text, "n_tokens", "tree", "encoded_chars")]
    tokenizer = tokenizer or vocabulary_path("byte_bpe_50k.json")
    ranks = ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, ranks)
        for batch in batches:
            texts, trees, encoded = [], [], []
            for value, stored, steps in zip(batch.column(text), batch.column("tree"), batch.column(edits), strict=True):
                body, tree, chars = value.as_py() or "", _unpack(stored), 0
                for edit in steps.as_py() or []:
                    if edit is not None:
                        start, deleted = edit["start"] or 0, edit["deleted"] or 0
                        body, tree, more = apply_edit(counter, tree, body, start, deleted, edit["inserted"] or "")
                        chars += more
                texts.append(body)
                trees.append(tree)
                encoded.append(chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [
                    pa.array(texts, pa.string()),
                    pa.array([int(tree.tokens[1]) for tree in trees], pa.int64()),
                    _pack(trees),
                    pa.array(encoded, pa.int64()),
                ],
                [*names, text, "n_tokens", "tree", "encoded_chars"],
            )

    schema = f"{_schema(counted, names)}, `{text}` string, n_tokens bigint, tree {TREE}, encoded_chars bigint"
    ready = counted.withColumn(edits, F.col(edits).cast(f"array<{EDIT}>"))
    return ready.mapInArrow(run, schema.removeprefix(", "))


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)


def _pack(trees: list[Tree]) -> pa.Array:
    return pa.array([{"leaves": t.leaves, "chars": t.chars, "tokens": t.tokens} for t in trees], _TREE)


def _unpack(stored: pa.StructScalar) -> Tree:
    return Tree(
        stored["leaves"].as_py(),
        stored["chars"].values.to_numpy().copy(),
        stored["tokens"].values.to_numpy().copy(),
    )
