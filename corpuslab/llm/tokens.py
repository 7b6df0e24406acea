"""Encoding texts with a public byte-level vocabulary inside tasks."""

from __future__ import annotations

import base64
import re

import numpy as np

# Texts of these characters only are split alike by both tokenizer libraries.
PLAIN = re.compile("[\t\n\r\x20-;=-~À-ɏ]*")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as ``tokenizers`` gives them, without added special tokens.

    Plain texts are encoded by the rank table of the same vocabulary, which is
    several times as fast; all other texts by the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.whole = Tokenizer.from_file(tokenizer)

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
