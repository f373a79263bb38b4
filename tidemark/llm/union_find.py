"""Connected classes of links between array places, in numpy."""

from __future__ import annotations

import numpy as np


def classes(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The classes `of` (each place's least place) after also joining places a[k] and b[k]."""
    of = of.copy()
    while True:
        a, b = of[a], of[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return of
        np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := of[of], of):
            of = up
