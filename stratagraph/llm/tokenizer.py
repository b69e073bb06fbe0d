"""Token ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import base64

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of ordinary text; the file has no special tokens, so their strings in a text are text."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1  # the id after the vocabulary ends a document
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), self.dtype)


_loaded: dict[str, Tokenizer] = {}


def load(vocabulary: str = VOCABULARY) -> Tokenizer:
    """One tokenizer for each vocabulary and Python process."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Tokenizer(vocabulary)
    return _loaded[vocabulary]
