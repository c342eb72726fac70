"""The public byte-level BPE vocabulary: pre-tokens, ids and bytes, in plain Python."""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

#: Where the vocabulary lies on every machine; pass another path for another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoder of a rank file; made once in each Python worker. It has no special tokens: their strings are plain text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pieces():
    import regex

    return regex.compile(PATTERN)


def _certain(before: str, after: str) -> bool:
    """Whether a pre-token begins between two characters whatever stands around them: a run of letters or of digits ends there."""
    kind = unicodedata.category(after)
    return kind != "Cn" and (before.isalpha() and kind[0] != "L" or unicodedata.category(before)[0] == "N" and kind[0] != "N")


def safe_boundaries(text: str, start: int, begin: int, end: int) -> list[int]:
    """Places (counted from ``start``) in [begin, end] where a pre-token of ``text`` begins behind a run of letters or digits.

    A text cut at such a place splits into the same pre-tokens as the whole: the pattern's tokens hold one kind of
    character each, white space only before them. So it holds wherever the scan began, also within a pre-token.
    """
    out = []
    for m in _pieces().finditer(text):
        at = m.start()
        if start + at > end:
            break
        if at and start + at >= begin and _certain(text[at - 1], text[at]):
            out.append(start + at)
    return out


def encode_batch(texts: list[str | None], path: str = VOCABULARY):
    """Ids of each text as (offsets, flat values) in NumPy arrays; null and empty texts have none."""
    import numpy as np

    enc = encoding(path)
    ids = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return offsets, (np.concatenate(ids) if ids else np.empty(0)).astype(np.int32)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes in a row, read as UTF-8 once they are all together."""
    enc = encoding(path)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")
