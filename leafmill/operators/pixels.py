"""Raster operators on numpy pages, for use inside Arrow UDFs; a page comes as rows of pixels."""

from __future__ import annotations

import numpy as np

FLAT_SHARE, FLAT_NEAR, FLAT_LEAST = 0.8, 8, 32
COVER_WHOLE, FLAT_WHOLE = 0.05, 0.9


def grow(mask: np.ndarray, by: int = 1) -> np.ndarray:
    """The mask and everything within ``by`` steps of it, in eight directions."""
    out = mask.copy()
    for _ in range(by):
        wide = np.pad(out, 1)
        out = np.zeros_like(mask)
        for dy in range(3):
            for dx in range(3):
                out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def flat_colour(values: np.ndarray):
    """The median if most values are near it, rounded half to even; None if they are few or spread."""
    if values.size < FLAT_LEAST:
        return None
    middle = float(np.median(values))
    return int(np.rint(middle)) if (np.abs(values - middle) <= FLAT_NEAR).mean() >= FLAT_SHARE else None


def erase_mask(page: np.ndarray, glyphs: np.ndarray, part: tuple[int, int, int, int], by: int = 1) -> np.ndarray:
    """What to erase of a part: all of it if few glyph pixels cover it or it is flat, else its glyph pixels, grown."""
    y0, x0, y1, x1 = part
    inside = np.zeros(page.shape, bool)
    inside[y0:y1, x0:x1] = True
    cover = glyphs[y0:y1, x0:x1].mean() if inside.any() else 0.0
    values = page[y0:y1, x0:x1]
    flat = values.size and (np.abs(values - np.median(values)) <= FLAT_NEAR).mean() >= FLAT_WHOLE
    return inside if cover < COVER_WHOLE or flat else grow(glyphs & grow(inside, by), by)


def fill(page: np.ndarray, mask: np.ndarray, structure: np.ndarray, reach: int = 6) -> np.ndarray:
    """Fill the mask with its surroundings' flat colour, but for structure in it that goes on more than ``reach`` outside."""
    ring = grow(mask, 2) & ~mask
    colour = flat_colour(page[ring])
    if colour is None:
        return page
    outside = structure & ~grow(mask, reach)
    spread = outside
    while True:
        more = grow(spread) & structure
        if (more == spread).all():
            break
        spread = more
    out = page.copy()
    out[mask & ~spread] = colour
    return out


def crops(boxes: list[tuple[int, int, int, int]], size: int = 512) -> list[int]:
    """For each box the crop it rides in: largest first, a box inside an earlier crop needs none of its own."""
    order = sorted(range(len(boxes)), key=lambda i: (-(boxes[i][2] - boxes[i][0]) * (boxes[i][3] - boxes[i][1]), i))
    made: list[tuple[int, tuple]] = []
    out = [-1] * len(boxes)
    for i in order:
        x0, y0, x1, y1 = boxes[i]
        for k, (a, b, c, d) in made:
            if a <= x0 and b <= y0 and x1 <= c and y1 <= d:
                out[i] = k
                break
        else:
            cx, cy = (x0 + x1) // 2, (y0 + y1) // 2
            made.append((i, (cx - size // 2, cy - size // 2, cx + size // 2, cy + size // 2)))
            out[i] = i
    return out


def flood(page: np.ndarray, seed: tuple[int, int], near: int = 12) -> np.ndarray:
    """Pixels reached from a seed over values near the seed's."""
    same = np.abs(page.astype(int) - int(page[seed])) <= near
    out = np.zeros(page.shape, bool)
    out[seed] = True
    while True:
        more = np.zeros_like(out)
        more[1:] |= out[:-1]
        more[:-1] |= out[1:]
        more[:, 1:] |= out[:, :-1]
        more[:, :-1] |= out[:, 1:]
        more = (more | out) & same
        if (more == out).all():
            return out
        out = more
