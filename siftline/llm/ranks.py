"""Vocabularies stored as ranks (base64 of the bytes, a space, the rank, one a line)."""

from __future__ import annotations

import base64


def read_ranks(path: str | None = None) -> bytes:
    """The file's bytes (by default the public byte-level vocabulary), read once on the driver and sent with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def parse(payload: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, payload.splitlines())}


def ranks_encoding(payload: bytes, pattern: str | None = None):
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse(payload), special_tokens={})
