"""Public tokenizer files. Their folder is a parameter of every operator that uses one; none is copied here."""

from __future__ import annotations

import base64
import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tokenizer(path: str):
    """The tokenizers library's object for a .json file, without truncation or padding, once a process."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def byte_encoder(path: str, pattern: str):
    """The tiktoken library's encoding for a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
