"""Byte-level BPE token ids with the public tokenizer files, given by path."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Characters that every regex engine classes alike; other texts take the reference tokenizer.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as uint32 arrays.

    ``tokenizers`` defines the ids. Where the same vocabulary lies beside the file as ranks, texts made of
    plain Latin characters are encoded by ``tiktoken``, several times as fast and with equal ids.
    Strings of special tokens are ordinary text; a null text has no ids.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.vocab_size = self.slow.get_vocab_size()
        self.fast = None
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None and not _PLAIN.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
