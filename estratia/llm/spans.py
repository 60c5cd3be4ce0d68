"""Words of whole texts as byte spans, many texts at a time.

Separators of the word rules here are ASCII, so words can be cut in UTF-8 bytes and are lower-cased
there (A-Z only). Texts are handled in runs of about ``RUN_BYTES``, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from estratia.llm.common import ship

ship(__name__)

RUN_BYTES = 1 << 20


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_bytes(breaks: bytes) -> np.ndarray:
    """Whether each lower-cased byte belongs to a word."""
    table = np.ones(256, bool)
    table[list(breaks)] = False
    return table


#: Words of anything but the six blanks; words of ASCII digits and letters and all characters beyond ASCII.
BLANKS = word_bytes(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = word_bytes(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Words:
    """Words of some texts, joined by one space: word i is data[start[i]:end[i]] and of text ``text[i]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    n_texts: int

    def bounds(self) -> np.ndarray:
        """Words of text t are bounds[t] to bounds[t + 1]."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def cut_words(texts: pa.Array, table: np.ndarray) -> Words:
    """The words of these texts; null texts have none. The line break between texts must separate words."""
    texts = pc.fill_null(texts, "")
    raw = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    begin = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    low = LOWER[raw]
    inside = table[low]
    after = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & ~after)
    size = np.flatnonzero(after & ~inside) - first
    low[~inside] = 0x20
    end = np.cumsum(size + 1) - 1
    return Words(low[inside | after], end - size, end, np.searchsorted(begin, first, side="right") - 1, len(texts))


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``most`` bytes together, as (first, after the last)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *edges], [*edges, len(size)]) if len(size) else ()
