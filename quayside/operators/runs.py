"""Rows of one key after the other, as tasks read them from a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def runs(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Every stretch of equal keys within a frame, and whether it begins a key that is not that of the stretch before; null equals null."""
    last: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        both = frame[list(keys)] if last is None else pd.concat([last, frame[list(keys)]], ignore_index=True)
        changed = np.zeros(len(both), bool)
        for key in keys:
            code = pd.factorize(both[key], use_na_sentinel=False)[0]
            changed[1:] |= code[1:] != code[:-1]
        if last is None:
            changed[0] = True
        else:
            changed = changed[1:]
        cuts = [0, *(np.flatnonzero(changed[1:]) + 1).tolist(), len(frame)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield bool(changed[start]), frame.iloc[start:stop]
        last = frame[list(keys)].iloc[-1:]


def whole_runs(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """All rows of each key together; for keys of bounded size."""
    held: list[pd.DataFrame] = []
    for new, part in runs(frames, keys):
        if new and held:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)
