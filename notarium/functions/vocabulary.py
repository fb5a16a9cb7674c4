"""Token counts by a public byte-level vocabulary, for operators that take a counter."""

from __future__ import annotations

import base64
from collections.abc import Callable

#: The fixed word pattern of byte-level vocabularies of this family.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def token_counter(ranks: dict[bytes, int], pattern: str = WORDS) -> Callable[[], Callable[[str], int]]:
    """A factory for use in tasks: it makes a function that counts the tokens of a text. The ranks travel with it."""

    def make() -> Callable[[str], int]:
        import tiktoken

        coder = tiktoken.Encoding(name="counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))

    return make
