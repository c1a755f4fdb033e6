"""Vectorised word splitting and hashing over UTF-8 bytes.

Word classes of the operators are all defined on ASCII code points, and every
byte of a multi-byte UTF-8 sequence is >= 0x80, so words can be found on bytes.
Hashes are polynomial hashes modulo 2**64 with an odd base, taken from one
prefix sum over a block, and then mixed; they depend on the words alone and
are the same in every process.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _tables(is_word: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    symbol = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    if fold:
        symbol[65:91] = symbol[97:123]
    symbol[~is_word] = 0
    return is_word, symbol


def whitespace_words(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tables for words ``[^\\x20\\x09-\\x0D]+``; ``fold`` lower-cases A-Z."""
    is_word = np.ones(256, bool)
    is_word[list(SPACES)] = False
    return _tables(is_word, fold)


def alnum_words() -> tuple[np.ndarray, np.ndarray]:
    """Tables for words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    is_word = np.ones(256, bool)
    is_word[:0x80] = False
    is_word[0x30:0x3A] = True
    is_word[0x61:0x7B] = True
    is_word[0x41:0x5B] = True
    return _tables(is_word, True)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, _U), np.full(size, _INV, _U)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        if size > 2 * _BLOCK:
            return made
        _powers[size] = made
    return _powers[size]


def _block_words(block: bytes, tables: tuple[np.ndarray, np.ndarray], lengths: tuple = ()) -> tuple:
    raw = np.frombuffer(block, np.uint8)
    inside = tables[0][raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(tables[1][raw] * up[: len(raw)], out=total[1:])
    heads = np.zeros((len(starts), len(lengths)), _U)
    for j, n in enumerate(lengths):
        long = ends - starts >= n
        heads[long, j] = mix((total[starts[long] + n] - total[starts[long]]) * down[starts[long]] + _U(n))
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends, heads


def words(texts: list[bytes], tables: tuple[np.ndarray, np.ndarray], spans: bool = False, lengths: tuple = ()):
    """Hashes of all words of ``texts`` and, for each text, where its words begin.

    Returns ``(hashes, offsets)`` with ``len(texts) + 1`` offsets; with ``spans`` also
    the byte start and end of each word within its own text; with ``lengths`` a last array with
    the hash of each word's first so many bytes, a column for each length, 0 for shorter words.  Works block by block,
    so that memory beyond the result is bounded whatever the length of a text.
    """
    counts = np.zeros(len(texts), np.int64)
    parts, firsts, lasts, tops = [], [], [], []
    group: list[tuple[int, bytes, int]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        joined = b"\n".join(piece for _, piece, _ in group)
        hashes, starts, ends, heads = _block_words(joined, tables, lengths)
        bounds = np.cumsum([0] + [len(piece) + 1 for _, piece, _ in group])
        at = np.searchsorted(bounds, starts, "right") - 1
        np.add.at(counts, np.array([i for i, _, _ in group])[at], 1) if len(at) else None
        parts.append(hashes)
        tops.append(heads)
        if spans:
            shift = np.array([base for _, _, base in group], np.int64)[at] - bounds[at] if len(at) else np.zeros(0, np.int64)
            firsts.append(starts + shift)
            lasts.append(ends + shift)
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) <= _BLOCK:
            group.append((i, text, 0))
            held += len(text) + 1
        else:
            at = 0
            while at < len(text):
                end = min(len(text), at + _BLOCK)
                while end < len(text) and tables[0][text[end]]:
                    end += 1
                group.append((i, text[at:end], at))
                at = end
                flush()
        if held >= _BLOCK:
            flush()
    flush()
    none = np.zeros(0, np.int64)
    out = (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(counts)])
    if spans:
        out = *out, np.concatenate(firsts) if firsts else none, np.concatenate(lasts) if lasts else none
    return (*out, np.concatenate(tops) if tops else np.zeros((0, len(lengths)), _U)) if lengths else out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (none if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.zeros(count, _U)
    for j in range(n):
        out = out * _U(_NGRAM_BASE) + hashes[j : j + count]
    return mix(out + _U(n))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
