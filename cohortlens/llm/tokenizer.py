"""What the two tokenizer operators need to know about a byte-level BPE file."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

#: Pieces in which the pre-tokenizer of this family cuts a text (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_AFTER_GAP = re.compile(r"\s ")
_SPACE = re.compile(r"(?<=\S) ")


def space_cuts(text: str) -> list[str]:
    """The text cut before every space that follows a visible character; that space is left out.

    No piece of PIECES has a space behind its first character unless it is all white space, so each such place is
    a border of pieces whatever stands after it, and each part can be encoded on its own: the first as it is, the
    others with one space before them.
    """
    return _SPACE.split(text) if _AFTER_GAP.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def read(path: str) -> dict:
    """The tokenizer file; refused if it is not byte-level BPE of the plain kind."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and spec["normalizer"] is None and spec["post_processor"] is None
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    )
    if not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    return spec


@lru_cache(maxsize=4)
def library(path: str):
    """The installed library's tokenizer, one thread, whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
