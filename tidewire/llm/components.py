"""Connected components of a link table, and their short form inside one task."""

from __future__ import annotations

import numpy as np

from tidewire.operators.graph import components

__all__ = ["components", "stars"]


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member to the first member of its component: as connected as the pairs, at most n of them."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]
