"""Counts of one text that are taken block by block, so that a very long text needs no list of all its words.

Words are what lies between blanks (space, tab, line feed, vertical tab, form feed, carriage return). Of each word, window and
line a 64-bit hash is held, 8 bytes, in arrays; the blocks' words and lines are gone when the next block is read.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: Bytes of a block.
BLOCK = 1 << 20
_BLANK, _FEED = re.compile(rb"[\x20\x09-\x0d]"), re.compile(rb"\n")
#: Odd factors that part the three words of a window.
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def blocks(data: bytes, end: re.Pattern = _BLANK, size: int = BLOCK):
    """Parts of ``data``, cut before a blank (or another ``end``) behind ``size`` bytes."""
    at = 0
    while at < len(data):
        m = end.search(data, at + size) if at + size < len(data) else None
        to = m.start() if m else len(data)
        yield data[at:to] if at or m else data
        at = to


def byte_counts(data: bytes, size: int = BLOCK) -> np.ndarray:
    whole = np.frombuffer(data, np.uint8)
    return sum((np.bincount(whole[k : k + size], minlength=256) for k in range(0, len(whole), size)), np.zeros(256, np.int64))


def shingle_hashes(data: bytes, words: int, seed: int, size: int = BLOCK):
    """XXH64 of the text's shingles with repeats, as arrays, block by block: A-Z lower-cased, ``words`` words each; of a shorter text all its words as one; none without words."""
    import xxhash

    def hashed(tokens, n):
        return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(tokens[k:] for k in range(words)))), repeat(seed)), np.uint64, n)

    held: list[bytes] = []
    some = False
    for block in blocks(data, size=size):
        held += block.lower().split()
        n = len(held) - words + 1
        if n > 0:
            some = True
            yield hashed(held, n)
            del held[:n]
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def word_hashes(data: bytes, size: int = BLOCK) -> np.ndarray:
    """A hash of each word, the same for the same words of one process."""
    found = []
    for block in blocks(data, size=size):
        words = block.split()
        found.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint64)


def _classes(hashes: np.ndarray):
    """The hashes in sorted parts of different top bits, so that no second copy of a long text's stands in memory."""
    if len(hashes) < BLOCK:
        yield np.sort(hashes)
        return
    for top in range(8):
        part = np.concatenate([x[x >> np.uint64(61) == top] for x in (hashes[k : k + BLOCK] for k in range(0, len(hashes), BLOCK))])
        part.sort()
        yield part


def different(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    parts = [x[np.append(True, x[1:] != x[:-1])] if len(x) else x for x in _classes(hashes)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def distinct(hashes: np.ndarray) -> int:
    return sum(int((x[1:] != x[:-1]).sum()) + 1 for x in _classes(hashes) if len(x))


def words_in_repeats(hashes: np.ndarray) -> int:
    """Words that stand in a window of three words that the text has twice or more."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    keys = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        part = hashes[at : min(at + BLOCK, n)] * _FACTORS[0]
        for k in (1, 2):
            part ^= part >> np.uint64(29)
            part += hashes[at + k : at + k + len(part)] * _FACTORS[k]
        keys[at : at + BLOCK] = part
    again = np.concatenate([x[1:][x[1:] == x[:-1]] for x in _classes(keys)])
    if not len(again):
        return 0
    again = different(again)
    hit = np.zeros(n + 2, bool)
    for k in range(0, n, BLOCK):
        part = keys[k : k + BLOCK]
        twice = again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part
        for j in range(3):
            hit[k + j : k + j + len(part)] |= twice
    return int(hit.sum())


def line_counts(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    if b"\n" not in data:
        return (1 if data.strip() else 0), 0
    found = []
    for block in blocks(data, _FEED):
        lines = [hash(x) for x in block.split(b"\n") if x and not x.isspace()]
        found.append(np.array(lines, np.int64))
    hashes = np.concatenate(found) if found else np.empty(0, np.int64)
    return len(hashes), len(hashes) - distinct(hashes.view(np.uint64))


def plain_counts(data: bytes, hashes: np.ndarray | None = None, each: np.ndarray | None = None, lines: tuple[int, int] | None = None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words inside repeated 3-word windows, of a UTF-8 text."""
    hashes = word_hashes(data) if hashes is None else hashes
    each = byte_counts(data) if each is None else each
    lines = line_counts(data) if lines is None else lines
    points = int(each.sum() - each[0x80:0xC0].sum() - each[list(BLANKS)].sum())
    return len(hashes), points, int(each[list(SYMBOLS)].sum()), lines[1], words_in_repeats(hashes)
