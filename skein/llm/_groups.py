"""Walking over sorted partitions group by group, in large batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by `key`, in frames that never cut a group."""
    rest: list[pd.DataFrame] = []
    for t in batches:
        if not len(t):
            continue
        keys = t[key].to_numpy()
        rest.append(t)
        if keys[0] == keys[-1]:
            continue
        whole = pd.concat(rest, ignore_index=True) if len(rest) > 1 else t
        done = int(np.searchsorted(whole[key].to_numpy(), keys[-1]))
        rest = [whole.iloc[done:]]
        if done:
            yield whole.iloc[:done]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys with at least two rows."""
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])
    many = ends - starts > 1
    return starts[many], ends[many]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(bucket: int, id_: int, blocks: int) -> tuple[int, np.ndarray]:
    """A row's block of a split bucket, and the keys of the pairs of blocks that it takes part in."""
    own = int(mix(np.array([id_], dtype=np.int64).view(np.uint64))[0] % np.uint64(blocks))
    other = np.arange(blocks, dtype=np.uint64)
    low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
    return own, mix(np.array([bucket], dtype=np.int64).view(np.uint64) + mix(low * np.uint64(blocks) + high + np.uint64(1))).view(np.int64)
