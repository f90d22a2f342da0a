"""Token ids of whole texts by a public byte-level tokenizer.

The vocabulary is read twice: as ranks, which encode fast, and as the full tokenizer file
for the few texts that contain the spelling of a special token. Both give the same ids.
"""

from __future__ import annotations

import base64
from array import array

# The special token of the vocabulary, and the bytes of a stored id.
SPECIAL = "<|endoftext|>"
ID_BYTES = 4


def default_tokenizer() -> tuple[str, str]:
    """Places of the tokenizer file and of the same vocabulary as ranks."""
    import public_tokenizers

    return tuple(public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


class Encoder:
    def __init__(self, tokenizer: str, ranks: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self._encode = plain.encode_ordinary
        self._path = tokenizer
        self._full = None

    def ids(self, text: str | None) -> array:
        """Unsigned 32-bit ids of a text; null counts as empty."""
        if not text:
            return array("I")
        if SPECIAL not in text:
            return array("I", self._encode(text))
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._path)
        return array("I", self._full.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: tuple[str, str]) -> Encoder:
    """One encoder per worker and pair of files."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(*tokenizer)
    return _ENCODERS[tokenizer]
