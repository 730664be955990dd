"""What the text operators share: whole texts inside a task, and words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time; a null text is empty.

    What the batches before have left unused goes back to the system first: workers live long.
    """
    pa.default_memory_pool().release_unused()
    # the same bytes under another type: nothing is copied
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called so (case aside)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


class WordIds(dict):
    """Numbers for words, handed out as they come.

    ``bytes.split()`` cuts at the ASCII white space 0x09-0x0D and 0x20 and nowhere else, which
    is what the operators call a word. ``clear_if_full`` keeps a long-lived worker small and the
    numbers below 2**21, so that three of them fit one 64-bit integer.
    """

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
