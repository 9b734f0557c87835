"""Anchors of rate-limit windows as a scan over functions.

An address's windows form a chain: the first arrival later than `anchor + ttl` is the next anchor. For a stretch of an
address's sorted arrivals, the anchor it ends with is a function of the anchor it begins with. That function is a step
function that never falls: it is the identity while the begun window covers the whole stretch, and otherwise depends
only on which arrival comes first after that window. Functions of neighbouring stretches compose, and composing is
associative, so they can be combined in a tree in any grouping. `StretchMap` is such a function.

The rest are generators over sorted batches, which run inside tasks; Spark does the partitioning and sorting.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Stands for "no anchor yet"; far enough in the past to lie outside every window.
NEVER = -(2**62)


@dataclass(frozen=True)
class StretchMap:
    """From the anchor before a stretch to the anchor after it, for anchors before `first`.

    The first of `entries` later than `anchor + ttl` names the chain's first anchor in the stretch, and `exits` holds
    where the chain then ends; without such an entry the anchor stays. Of entries with the same exit the latest stands
    for all. A window from before the stretch ends within `ttl` of `first`, which bounds the entries.
    """

    first: int
    last: int
    entries: np.ndarray
    exits: np.ndarray

    @classmethod
    def of(cls, arrivals: np.ndarray, ttl: int) -> StretchMap:
        """The map of distinct arrivals in rising order."""
        n = len(arrivals)
        following = np.searchsorted(arrivals, arrivals + ttl, side="right")
        end = np.where(following < n, following, np.arange(n))
        # Each round doubles the number of windows that `end` skips.
        while not np.array_equal(further := end[end], end):
            end = further
        count = int(np.searchsorted(arrivals, arrivals[0] - 1 + ttl, side="right")) + 1
        return cls(int(arrivals[0]), int(arrivals[-1]), *_distinct(arrivals[:count], arrivals[end[:count]]))

    def __call__(self, anchors: np.ndarray, ttl: int) -> np.ndarray:
        at = np.searchsorted(self.entries, anchors + ttl, side="right")
        found = at < len(self.entries)
        return np.where(found, self.exits[np.where(found, at, 0)], anchors)

    def then(self, later: StretchMap, ttl: int) -> StretchMap:
        """The map of this stretch and the one after it."""
        entries, exits = self.entries, later(self.exits, ttl)
        latest = self.first - 1 + ttl
        if self.last <= latest:
            # Windows that cover this stretch go on into the later one.
            count = int(np.searchsorted(later.entries, latest, side="right")) + 1
            entries = np.concatenate([entries, later.entries[:count]])
            exits = np.concatenate([exits, later.exits[:count]])
        return StretchMap(self.first, later.last, *_distinct(entries, exits))


def _distinct(entries: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(entries), dtype=bool)
    keep[:-1] = exits[1:] != exits[:-1]
    return entries[keep], exits[keep]


def _runs(frame: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    """(ip, start, end) of each address in a sorted batch."""
    ip = frame["ip"].to_numpy()
    starts = np.flatnonzero(np.r_[True, ip[1:] != ip[:-1]])
    yield from zip(ip[starts], starts.tolist(), [*starts[1:].tolist(), len(ip)], strict=True)


def boundary_maps(ttl: int):
    """The maps of a partition's first and last address: only those can go on in another partition.

    A long stretch is composed batch by batch, so a task holds one batch and one map.
    """

    def row(part: int, ip: str, stretch: StretchMap) -> dict:
        return {"ip": ip, "node": part} | vars(stretch)

    def summarise(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = part = None
        for frame in frames:
            if frame.empty:
                continue
            part, arrivals = int(frame["part"].iat[0]), frame["arrival"].to_numpy()
            runs = list(_runs(frame))
            for ip, start, end in runs[:1] + runs[1:][-1:]:
                stretch = StretchMap.of(arrivals[start:end], ttl)
                if last is not None and last[0] == ip:
                    stretch = last[1].then(stretch, ttl)
                elif last is not None and first is None:
                    first = last
                last = (ip, stretch)
        found = [x for x in (first, last) if x is not None]
        if found:
            yield pd.DataFrame([row(part, *x) for x in found])

    return summarise


def _maps(rows: pd.DataFrame) -> Iterator[StretchMap]:
    for row in rows.itertuples():
        yield StretchMap(row.first, row.last, np.asarray(row.entries), np.asarray(row.exits))


def composed(ttl: int):
    """One map of an address's neighbouring nodes, for the node above them."""

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for stretch in _maps(rows.sort_values("node")):
            whole = stretch if whole is None else whole.then(stretch, ttl)
        return pd.DataFrame([{"ip": key[0], "node": key[1]} | vars(whole)])

    return compose


def handed_down(ttl: int):
    """The anchor that each of an address's neighbouring nodes begins with, given the one the first begins with."""

    def hand_down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        anchor, incoming = np.array([rows["incoming"].iat[0]]), []
        for stretch in _maps(rows):
            incoming.append(int(anchor[0]))
            anchor = stretch(anchor, ttl)
        return pd.DataFrame({"ip": key[0], "node": rows["node"].to_numpy(), "incoming": incoming})

    return hand_down


def placed(ttl: int, incoming: dict[int, int]):
    """Adds the anchor of each arrival's window. `incoming` has the anchor that a partition's first address begins with."""

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, NEVER
        for frame in frames:
            if frame.empty:
                continue
            arrivals = frame["arrival"].to_numpy()
            anchors = np.empty(len(frame), dtype=np.int64)
            for ip, start, end in _runs(frame):
                if ip != current:
                    anchor = NEVER if current is not None else incoming.get(int(frame["part"].iat[0]), NEVER)
                    current = ip
                own = arrivals[start:end]
                following = np.searchsorted(own, own + ttl, side="right").tolist()
                opened, at = [], int(np.searchsorted(own, anchor + ttl, side="right"))
                while at < len(own):
                    opened.append(at)
                    at = following[at]
                begins = np.array([anchor, *own[opened].tolist()])
                anchors[start:end] = begins[np.searchsorted(np.array(opened, np.int64), np.arange(len(own)), side="right")]
                anchor = int(begins[-1])
            yield frame[["ip", "arrival", "n", "carried"]].assign(anchor=anchors)

    return place


# Executors get these functions with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
