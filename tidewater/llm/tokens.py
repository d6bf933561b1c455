"""Token ids of a public byte-level BPE. The vocabulary's path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
import threading
from functools import lru_cache

import numpy as np

_LOCK = threading.Lock()


class Encoder:
    """Ids as the tokenizers library gives them for vocabulary (a .json file).

    ranks, a rank file of the same vocabulary, lets tiktoken encode most texts several times faster; a
    text that holds one of the vocabulary's special strings, or that tiktoken gives up on, goes to the
    tokenizers library. Null texts count as empty.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
            except BaseException as e:  # its panics derive from BaseException
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(vocabulary, ranks, pattern)


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each process and vocabulary."""
    with _LOCK:
        return _encoder(vocabulary, ranks, pattern)


def public_vocabulary() -> tuple[str, str, str]:
    """The vocabulary of the registered queries: the arguments of encoder()."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
