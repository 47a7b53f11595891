"""Boxes as rows of arrays, for functions that run in a task: what suppression keeps, tiles of an image."""

from __future__ import annotations

import numpy as np


def kept_boxes(corners: np.ndarray, most: float = 0.3) -> list[int]:
    """Places of the boxes [n, 4] (x0, y0, x1, y1), best first, that overlap no kept one before them more than most."""
    area = np.maximum(0, corners[:, 2] - corners[:, 0]) * np.maximum(0, corners[:, 3] - corners[:, 1])
    open_, kept = np.ones(len(corners), bool), []
    for i in range(len(corners)):
        if not open_[i]:
            continue
        kept.append(i)
        low, high = np.maximum(corners[i, :2], corners[:, :2]), np.minimum(corners[i, 2:], corners[:, 2:])
        both = np.prod(np.maximum(0, high - low), axis=1)
        open_ &= both / np.maximum(area[i] + area - both, 1e-6) <= most
    return kept


def tile_corners(width: float, height: float, side: float, step: float) -> np.ndarray:
    """Tiles [n, 4] row by row, as shares of the sides: one at least each way, and another for every whole step that fits, cut at the border."""
    at = lambda length: np.arange(max(0, int((length - side) // step)) + 1) * step
    y, x = (a.reshape(-1) for a in np.meshgrid(at(height), at(width), indexing="ij"))
    return np.minimum(1.0, np.stack([x / width, y / height, (x + side) / width, (y + side) / height], 1))
