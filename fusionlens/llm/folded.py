"""Words of ASCII-folded text: A-Z lower-cased, words are runs of ASCII letters, digits and bytes beyond ASCII.

On bytes this is the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the folded text: every byte of a
multi-byte character is at or above 0x80.
"""

from __future__ import annotations

import numpy as np

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # fixed value: the words of the contract

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x41:0x5B] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, and how many words come before each row (rows begin at ``at``)."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _INSIDE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)  # a row's border separates words
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, at)


def sql_words(text: str) -> str:
    """DuckDB list of the words of a text; NULL has none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '{WORD}')"
