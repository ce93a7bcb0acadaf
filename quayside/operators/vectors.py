"""Nearest members among the vectors that one task holds: by a matrix product, and in a ball tree."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Pairs whose distance is computed by differences at a time.
PAIRS = 1 << 16
ROWS = 512
LEAF = 256


def nearest_of(visitors: np.ndarray, visitor_ids: np.ndarray, members: np.ndarray, member_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square of the distance to, and id of, the nearest member other than itself, infinite and -1 if there is none.

    A matrix product finds what may be nearest within its rounding error; only that is computed by differences,
    dimension by dimension. Of equal distances the lowest id counts.
    """
    squares, names = np.full(len(visitors), np.inf), np.full(len(visitors), -1, np.int64)
    if not len(members) or not len(visitors):
        return squares, names
    middle = members.mean(axis=0)
    a, b = visitors - middle, members - middle
    norm_a, norm_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 8 * (members.shape[1] + 8) * np.finfo(float).eps * (norm_a + norm_b.max())
    for start in range(0, len(a), ROWS):
        part = slice(start, start + ROWS)
        rough = norm_a[part, None] + norm_b[None, :] - 2 * (a[part] @ b.T)
        rough[visitor_ids[part, None] == member_ids[None, :]] = np.inf
        limit = rough.min(axis=1) + error[part]
        # a visitor without any other member has none at all
        row, at = np.nonzero((rough <= limit[:, None]) & np.isfinite(limit)[:, None])
        for first in range(0, len(row), PAIRS):
            i, j = row[first : first + PAIRS] + start, at[first : first + PAIRS]
            total = np.zeros(len(i))
            for axis in range(members.shape[1]):
                step = visitors[i, axis] - members[j, axis]
                total += step * step
            order = np.lexsort((member_ids[j], total, i))
            lead = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
            better(squares, names, i[lead], total[lead], member_ids[j[lead]])
    return squares, names


def nearest_between(
    one: np.ndarray, ids: np.ndarray, asks: np.ndarray, known: np.ndarray, other: np.ndarray, other_ids: np.ndarray, other_asks: np.ndarray, other_known: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, neighbour, square of the rows on either side that ask and have a member on the other side as near as ``known``.

    Each product of two rows serves both sides; as in ``nearest_of`` it only finds what may be nearest, rows of one id
    are no neighbours, and ties go to the lowest id.
    """
    # a row that does not ask on one side is needed only if the other side asks
    left = np.arange(len(one)) if other_asks.any() else np.flatnonzero(asks)
    right = np.arange(len(other)) if asks.any() else np.flatnonzero(other_asks)
    best = [np.full(len(one), np.inf), np.full(len(other), np.inf)]
    names = [np.full(len(one), -1, np.int64), np.full(len(other), -1, np.int64)]
    if len(left) and len(right):
        middle = other.mean(axis=0)
        a, b = one[left] - middle, other[right] - middle
        norm_a, norm_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        error = 8 * (one.shape[1] + 8) * np.finfo(float).eps * (norm_a.max() + norm_b.max())
        a_limit = np.where(asks, known, -np.inf)[left] + error
        b_limit = np.where(other_asks, other_known, -np.inf)[right] + error
        common = np.isin(ids[left], other_ids[right]).any()
        for start in range(0, len(a), ROWS):
            part = slice(start, start + ROWS)
            rough = a[part] @ (-2 * b.T)
            rough += norm_b[None, :]
            rough += norm_a[part, None]
            if common:
                rough[ids[left[part], None] == other_ids[right][None, :]] = np.inf
            # what does not ask has no limit to come below
            np.minimum(b_limit, rough.min(axis=0) + error, out=b_limit, where=b_limit > -np.inf)
            np.minimum(a_limit[part], rough.min(axis=1) + error, out=a_limit[part], where=a_limit[part] > -np.inf)
            near = ((rough <= a_limit[part, None]) | (rough <= b_limit[None, :])) & np.isfinite(rough)
            row, at = np.nonzero(near)
            for first in range(0, len(row), PAIRS):
                i, j = left[row[first : first + PAIRS] + start], right[at[first : first + PAIRS]]
                total = np.zeros(len(i))
                for axis in range(one.shape[1]):
                    step = one[i, axis] - other[j, axis]
                    total += step * step
                for side, (mine, theirs) in enumerate(((i, other_ids[j]), (j, ids[i]))):
                    order = np.lexsort((theirs, total, mine))
                    lead = order[np.concatenate([[True], mine[order][1:] != mine[order][:-1]])]
                    better(best[side], names[side], mine[lead], total[lead], theirs[lead])
    ok = [ask & (name >= 0) & (square <= limit) for ask, name, square, limit in zip((asks, other_asks), names, best, (known, other_known), strict=True)]
    return tuple(np.concatenate([x[ok[0]], y[ok[1]]]) for x, y in ((ids, other_ids), names, best))


def better(squares: np.ndarray, names: np.ndarray, at: np.ndarray, new_squares: np.ndarray, new_names: np.ndarray) -> None:
    """Keep what is nearer, or equally near with a lower id; ``at`` has no place twice."""
    nearer = (new_squares < squares[at]) | ((new_squares == squares[at]) & (new_names < names[at]) & (new_names >= 0))
    squares[at[nearer]], names[at[nearer]] = new_squares[nearer], new_names[nearer]


class Leaf(NamedTuple):
    rows: np.ndarray
    centre: np.ndarray
    radius: float


def leaves(points: np.ndarray, size: int = LEAF) -> list[Leaf]:
    """The leaves of a ball tree: halves along the axis of widest spread until they hold ``size`` rows."""
    out: list[Leaf] = []
    open_parts = [np.arange(len(points))]
    while open_parts:
        rows = open_parts.pop()
        own = points[rows]
        if len(rows) > size:
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            open_parts += [rows[order[:half]], rows[order[half:]]]
        elif len(rows):
            centre = own.mean(axis=0)
            out.append(Leaf(rows, centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))))
    return out


def all_nearest(points: np.ndarray, ids: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """``nearest_of`` every point among all others: a row looks into its own ball, then into those that may hold something nearer."""
    squares, names = np.full(len(points), np.inf), np.full(len(points), -1, np.int64)
    balls = leaves(points, size)
    for ball in balls:
        better(squares, names, ball.rows, *nearest_of(points[ball.rows], ids[ball.rows], points[ball.rows], ids[ball.rows]))
    if len(balls) < 2:
        return squares, names
    centres, radii = np.array([b.centre for b in balls]), np.array([b.radius for b in balls])
    for own, ball in enumerate(balls):
        apart = np.sqrt(((centres - ball.centre) ** 2).sum(axis=1))
        for other in np.argsort(apart - radii, kind="stable"):
            if other == own:
                continue
            guests = balls[other]
            # rows of another ball whose best so far reaches into this one
            reach = np.sqrt(squares[guests.rows]) * (1 + 1e-9) + 1e-12 * (1 + radii.max() + apart.max())
            distance = np.sqrt(((points[guests.rows] - ball.centre) ** 2).sum(axis=1))
            asking = guests.rows[distance - ball.radius <= reach]
            if len(asking):
                better(squares, names, asking, *nearest_of(points[asking], ids[asking], points[ball.rows], ids[ball.rows]))
    return squares, names


def windows(size: int, block: int) -> Iterator[slice]:
    """Blocks of ``block`` consecutive places, each beginning in the middle of the one before."""
    for start in range(0, max(1, size - block // 2), max(1, block // 2)):
        yield slice(start, min(size, start + block))
