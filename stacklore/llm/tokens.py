"""Ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

END = "<|endoftext|>"
#: the one alternative of the public pattern that looks ahead, for which the whole pattern is matched by backtracking, in twice the time
AHEAD = r"\s+(?!\S)|"
#: white space as the pattern means it
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WHITE = np.zeros(1 << 16, bool)
_WHITE[[ord(x) for x in SPACE]] = True
_LAST_OF_RUN = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")


@lru_cache(1)
def _loaded(model: str, ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN.replace(AHEAD, ""), mergeable_ranks=known, special_tokens={})


@lru_cache(1)
def _reference(model: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


@lru_cache(1)
def paths() -> tuple[str, str]:
    """The vocabulary as the tokenizers library reads it, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(text: str) -> list[str]:
    """The text, cut before the last white character of each run of two or more with more text behind it.

    There the pattern ends a token by looking ahead. In the parts, it finds the same tokens without that.
    """
    white = _WHITE[np.frombuffer(text.encode("utf-16-le", "replace"), "<u2")]
    return _LAST_OF_RUN.split(text) if (white[1:] & white[:-1]).any() else [text]


def encode(text: str, model: str | None = None, ranks: str | None = None) -> np.ndarray:
    """Ids of a whole text, as ``tokenizers`` gives them without special tokens added.

    The same vocabulary as ranks gives the same ids in less than a fifth of the time; texts that
    hold the name of the special token, or a run so long that the fast way would take
    quadratic time, go to ``tokenizers`` itself.
    """
    model, ranks = model or paths()[0], ranks or paths()[1]
    if END in text or (len(text) > 20_000 and max(map(len, text.split(" "))) > 20_000):
        return np.array(_reference(model).encode(text, add_special_tokens=False).ids, np.uint32)
    encoder = _loaded(model, ranks)
    first, *rest = map(encoder.encode_ordinary, parts(text))
    for more in rest:
        first += more
    return np.array(first, np.uint32)
