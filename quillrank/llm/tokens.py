"""Token ids of a public byte-level vocabulary, the same ids by either of two libraries.

``tokenizers`` defines the ids.  ``tiktoken`` gives the same ones several times faster for texts
of common letters, so such texts take it; texts with any other character, or with the special
token's own string, take ``tokenizers``.  A test holds the two against each other.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Characters that both libraries' patterns class alike.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*")
SPECIAL = "<|endoftext|>"


def vocabulary_paths() -> tuple[str, str]:
    """Where the vocabulary is: (tokenizers file, ranks file)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pattern() -> str:
    """The pattern that cuts a text into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def is_common(text: str) -> bool:
    return COMMON.fullmatch(text) is not None and SPECIAL not in text


def encode(text: str, paths: tuple[str, str] | None = None) -> np.ndarray:
    """Ids of a whole text without special tokens around it."""
    json_path, ranks_path = paths or vocabulary_paths()
    if is_common(text):
        return _fast(ranks_path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, "<u4")
