"""Words of very long texts, a block at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(raw: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words (runs without ASCII white space) of a text, in lists of about ``size`` bytes."""
    start = 0
    while start < len(raw):
        cut = _BLANK.search(raw, min(start + size, len(raw)))
        end = cut.start() if cut else len(raw)
        yield raw[start:end].split()
        start = end
