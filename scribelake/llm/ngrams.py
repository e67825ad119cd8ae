"""Hashed character n-grams of whole texts, a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def portions(texts: list[str], longest: int, chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points in portions of about ``chars``: (codes, owner, context).

    ``owner`` is the number of the text of each code point.  A text that is cut goes on
    in the next portion, where its last ``longest - 1`` characters come again, marked as
    context, so that no n-gram is lost or counted twice.
    """
    pieces, owners, contexts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), chars):
            begin = max(0, at - longest + 1)
            piece = text[begin : at + chars]
            pieces.append(piece)
            owners.append(np.full(len(piece), k, dtype=np.int32))
            context = np.zeros(len(piece), dtype=bool)
            context[: at - begin] = True
            contexts.append(context)
            size += len(piece)
            if size >= chars:
                yield _joined(pieces, owners, contexts)
                pieces, owners, contexts, size = [], [], [], 0
    if pieces:
        yield _joined(pieces, owners, contexts)


def _joined(pieces: list[str], owners: list[np.ndarray], contexts: list[np.ndarray]):
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate(owners), np.concatenate(contexts)


def buckets(codes: np.ndarray, owner: np.ndarray, context: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place the bucket of the n-gram that ends there, or ``2**bits`` for none."""
    hashed = np.full(len(codes), np.uint32(0x9E3779B9 * n & 0xFFFFFFFF))
    for back in range(n):
        hashed[back:] += codes[: len(codes) - back] * np.uint32(_FACTORS[back])
        hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    found = (hashed >> np.uint32(32 - bits)).astype(np.int64)
    none = context.copy()
    none[: n - 1] = True
    if n > 1:
        none[n - 1 :] |= owner[n - 1 :] != owner[: len(owner) - n + 1]
    found[none] = 1 << bits
    return found
