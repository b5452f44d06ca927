"""Byte-level BPE ids of a public vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str, plain: bool = False):
    """A function from a text to its ids. A rank file beside the JSON file holds the same vocabulary and encodes
    several times faster; without it the JSON file is used. The strings of special tokens give these tokens' ids, or
    with plain those of ordinary text, so that no text holds a special id."""
    with open(path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", []) if t.get("special")}
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)
        if plain or not special:
            return own.encode_ordinary
        names = frozenset(special)
        return lambda text: own.encode(text, allowed_special=names) if any(n in text for n in names) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return lambda text: t.encode(text, add_special_tokens=False).ids
