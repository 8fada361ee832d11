"""64-bit hashes of many spans of one array at once, for numpy inside tasks."""

from __future__ import annotations

import numpy as np


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(units, starts, ends):
    """A hash (uint64) of ``units[a:b]`` for each span of an array of unsigned integers."""
    return span_hash_pairs(units, starts, ends)[0]


def span_hash_pairs(units, starts, ends):
    """Two hashes of each span.

    Eight bytes at a time are mixed with their place in the span and added up. Mixing is not linear, so
    no two families of texts agree by construction, as they can under a polynomial modulo 2 ** 64.
    """
    step = 8 // units.itemsize
    size = ends - starts
    padded = np.concatenate([units, np.zeros(step, units.dtype)])
    eights = np.ndarray(len(units) + 1, np.uint64, padded, strides=(units.itemsize,))
    blocks = np.maximum(1, -(-size // step))
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + place * step
    left = np.minimum(np.repeat(ends, blocks) - at, step)
    masks = np.array([(1 << (8 * units.itemsize * k)) - 1 for k in range(step + 1)], np.uint64)
    salt = mix((np.arange(1, int(blocks.max(initial=0)) + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    mixed = mix((eights[at] & masks[left]) ^ salt[place])
    again = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    add = lambda x: mix((np.add.reduceat(x, first) if len(first) else x) + size.astype(np.uint64))
    return add(mixed), add(again)
