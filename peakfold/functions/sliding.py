"""Extrema over neighbourhoods of arrays, in time that doesn't depend on their width."""

from __future__ import annotations

import numpy as np


def sliding(x: np.ndarray, before: int, after: int, axis: int = -1, largest: bool = True) -> np.ndarray:
    """The largest (or least) of x[i - before : i + after + 1] for each i along the axis; ends are clamped.

    The axis is cut into blocks as long as a window. A window is the end of one block and the start of
    the next, so running extrema from both ends of each block give it: three passes whatever its width.
    """
    best, fill = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    x = np.moveaxis(np.asarray(x, np.float64), axis, -1)
    n, width = x.shape[-1], before + after + 1
    if not n:
        return np.moveaxis(x, -1, axis)
    room = -(-(n + before + after) // width) * width
    y = np.full((*x.shape[:-1], room), fill)
    y[..., before : before + n] = x
    blocks = y.reshape(*x.shape[:-1], room // width, width)
    from_start = best.accumulate(blocks, axis=-1).reshape(y.shape)
    from_end = best.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(y.shape)
    return np.moveaxis(best(from_end[..., :n], from_start[..., width - 1 : width - 1 + n]), -1, axis)


def over_ranges(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest of x[..., first[k] : last[k]] for each k; NaN where that is empty.

    A table of the maxima of 1, 2, 4, ... neighbours; two of its entries that may overlap make up a range.
    """
    x = np.asarray(x, np.float64)
    n, size = x.shape[-1], np.minimum(last, x.shape[-1]) - first
    out = np.full((*x.shape[:-1], len(first)), np.nan)
    level, table = 1, x
    while level <= n and (size >= level).any():
        mine = np.flatnonzero((size >= level) & (size < 2 * level))
        out[..., mine] = np.maximum(table[..., first[mine]], table[..., first[mine] + size[mine] - level])
        if 2 * level <= n:
            table = np.maximum(table[..., : n - 2 * level + 1], table[..., level : n - level + 1])
        level *= 2
    return out
