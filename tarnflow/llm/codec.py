"""Token ids of whole texts inside a task: the byte-level vocabulary, and one object of a kind for a worker."""

from __future__ import annotations

import array
import base64
from collections.abc import Callable

_made: dict[tuple, object] = {}

#: White space besides the space and the line feed.
_OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_RUN_END = r"\s+(?!\S)|"


def once(make: Callable, *args):
    """One object of a kind for a worker process, whichever tasks it runs."""
    key = (make.__qualname__, *args)
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]


class ByteBpe:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes; the ids of the ``tokenizers`` file with the same vocabulary.

    The pattern's look-ahead, which only tells apart runs of two or more white-space characters, keeps its matcher off
    the fast path. Texts without such runs, most of them, give the same parts without it.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = [tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (pattern, pattern.replace(_RUN_END, ""))]
        self.plain, self.without_runs = made

    def ids(self, text: str) -> list[int]:
        runs = "  " in text or "\n\n" in text or "\n " in text or " \n" in text or any(c in text for c in _OTHER_SPACES)
        return self.plain(text) if runs else self.without_runs(text)

    def encode(self, text: str) -> bytes:
        return array.array("I", self.ids(text)).tobytes()
