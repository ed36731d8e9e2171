"""Encoding of whole texts with the public byte-level BPE vocabulary.

The `tokenizers` file defines the ids. Where its rank file lies beside it, ordinary text is encoded by tiktoken with the
same vocabulary, which gives the same ids several times faster; a text that holds a special token's string is always
encoded by `tokenizers` itself. Very long texts are encoded in parts that are cut between two words: the vocabulary's
pattern always ends a piece where a letter is followed by a space and a letter, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Strings that the tokenizers file takes for special tokens.
SPECIAL = ("<|endoftext|>",)
#: A text is encoded at once up to about this many characters.
PART_CHARS = 1 << 20
CUT = re.compile("(?<=[a-z])(?= [a-z])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its list of ids, without special tokens added. Cached in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return exact.encode(text, add_special_tokens=False).ids
        if len(text) <= PART_CHARS:
            return fast.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + PART_CHARS) if at + PART_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            out += fast.encode_ordinary(text[at:end])
            at = end
        return out

    return encode
