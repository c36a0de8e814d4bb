"""Maps of units on a grid: the helper of the tasks that hold the units' foci.

The grid is padded by the kernel's reach and flat, so an offset of the kernel is one
number and a place outside the grid is padding that is cut off at the end. A unit's
map has, at each voxel, the largest value that a focus of it has there. Foci whose
kernels meet no other focus of their unit are only counted by place, and the counts
are spread once for a whole map; two that meet each other alone are counted as well,
and what they share is taken off once; the rest are spread one by one. Units of more than
LIMIT foci are spread LANES at a time, as the bits of a whole number at each place; a
focus that is there twice changes nothing, so units of unlike sizes are filled up.
"""

from __future__ import annotations

import math

import numpy as np

#: Foci of a unit up to which they are compared in pairs.
LIMIT = 64
#: Offsets of a kernel up to which its overlaps are listed.
LISTED = 1500
#: Foci that a task takes at once, and units of more than LIMIT foci.
DRAWN, TOGETHER = 50_000, 16
#: Units of more than LIMIT foci whose maps are made side by side, and their foci.
LANES, BESIDE = 64, 1_000_000


class Kernel:
    """Offsets of a ball, in classes of equal distance whose ``values`` fall. ``shape``
    is the grid's; ``offsets`` are rows (di, dj, dk, d2)."""

    def __init__(self, shape: list[int], offsets: list[tuple], values):
        ball = np.array(sorted(offsets, key=lambda r: r[3]), float)
        reach = int(np.abs(ball[:, :3]).max())
        self.shape, size = shape, [s + 2 * reach for s in shape]
        self.reach, self.stride, self.places = reach, np.array([size[1] * size[2], size[2], 1]), math.prod(size)
        d2, of = np.unique(ball[:, 3], return_inverse=True)
        values = np.asarray(values(d2), float)
        if (values == values[0]).all():
            of, values = np.zeros_like(of), values[:1]
        self.values, self.of, self.offsets = values, of, (ball[:, :3].astype(np.int64) * self.stride).sum(1)
        self.cells = self.place(*(x.ravel() for x in np.indices(shape)))
        self.inside = np.zeros(self.places, bool)
        self.inside[self.cells] = True
        # a ball of one value as runs along k: half a run's length for each (di, dj)
        self.runs = {int(o): int(h) for h, o in sorted((h, o) for *ij, h in ball[:, :3].tolist() for o in [ij @ self.stride[:2]])} if len(self.values) == 1 else {}
        self.limit = LIMIT if len(ball) <= LISTED else 1
        if self.limit > 1:
            self._overlaps()

    def place(self, *ijk: np.ndarray) -> np.ndarray:
        return sum((np.asarray(x, np.int64) + self.reach) * s for x, s in zip(ijk, self.stride.tolist()))

    def _overlaps(self) -> None:
        """For each distance of two places whose balls meet: what they share, seen from
        the lesser place, with the class of the lower value. Two places of the grid have
        such a distance only if their balls meet, since the padding is as wide as that."""
        apart = self.offsets[:, None] - self.offsets[None, :]
        a, b = np.nonzero(apart >= 0)
        order = np.argsort(apart[a, b], kind="stable")
        a, b = a[order], b[order]
        which, first, n = np.unique(apart[a, b], return_index=True, return_counts=True)
        self.widest = int(which[-1])
        self.number = np.full(self.widest + 1, -1, np.int32)
        self.number[which] = np.arange(len(which))
        self.first, self.shared = first, n
        self.shared_at, self.shared_of = self.offsets[a], np.maximum(self.of[a], self.of[b])

    def pieces(self, at: np.ndarray):
        """Of units with n foci each, ``at`` (n, units): a mask of the foci that are
        counted by place; (focus, place, class) of what is counted twice by that; and
        (unit, place, class) of the voxels of all other foci."""
        n, units = at.shape
        flat, none = at.ravel(), np.zeros(0, np.int64)
        if n > self.limit:
            best = [self._union(at[:, u]) for u in range(units)]
            unit = np.repeat(np.arange(units), [len(p) for p, _ in best])
            return np.zeros(len(flat), bool), (none, none, none), (unit, *(np.concatenate(x) for x in zip(*best)))
        one, two, far = [none], [none], [none]
        for s in range(1, n):
            d = np.abs(at[s:] - at[:-s]).ravel()
            near = np.flatnonzero(d <= self.widest)
            number = self.number[d[near]]
            near, number = near[number >= 0], number[number >= 0]
            one.append(near), two.append(near + s * units), far.append(number)
        one, two, far = (np.concatenate(x) for x in (one, two, far))
        met = np.bincount(one, minlength=len(flat)) + np.bincount(two, minlength=len(flat))
        alone = (met[one] == 1) & (met[two] == 1)
        others = met > 0
        others[one[alone]] = others[two[alone]] = False
        one, two, far = one[alone], two[alone], far[alone]
        many = self.shared[far]
        row = np.repeat(self.first[far] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(far) else none
        twice = np.repeat(one, many), np.repeat(np.minimum(flat[one], flat[two]), many) + self.shared_at[row], self.shared_of[row]
        rest = np.flatnonzero(others)
        return ~others, twice, self._spread(rest % units, flat[rest])

    def _spread(self, unit: np.ndarray, place: np.ndarray):
        """(unit, place, class) of the voxels of few foci, by sorting."""
        classes = len(self.values)
        key = np.sort((((unit * self.places + place)[:, None] + self.offsets) * classes + self.of).ravel())
        spot, of = np.divmod(key, classes)
        lead = np.r_[True, spot[1:] != spot[:-1]] if len(spot) else np.zeros(0, bool)
        unit, place = np.divmod(spot[lead], self.places)
        return unit, place, of[lead]

    def _union(self, place: np.ndarray):
        """(place, class) of the voxels of one unit with many foci."""
        best = np.full(self.places, len(self.values), np.int32)
        for o in range(len(self.offsets) - 1, -1, -1):
            best[place + self.offsets[o]] = self.of[o]
        found = np.flatnonzero(best < len(self.values))
        return found, best[found]

    def spread_counts(self, counts: np.ndarray) -> np.ndarray:
        """Every place's count times the value, summed around it."""
        made = np.zeros(self.places)
        used = np.flatnonzero(counts)
        if not len(used):
            return made
        a, b = int(used[0]), int(used[-1]) + 1
        for c, value in enumerate(self.values):
            own = counts[a:b] * value
            for o in self.offsets[self.of == c].tolist():
                made[a + o : b + o] += own
        return made


class Map:
    """The sum of units' maps."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.counts, self.more = np.zeros(kernel.places), np.zeros(kernel.places)

    def count(self, places: np.ndarray) -> None:
        self.counts += np.bincount(places, minlength=len(self.counts))

    def add(self, at: np.ndarray) -> None:
        """Units of (n, units) foci."""
        k = self.kernel
        n, units = at.shape
        if n <= k.limit:
            return self._pieces(at)
        # nanoseconds: an offset over all places, against a focus spread and a unit's places read
        beside = 1.5 * len(k.runs or k.offsets) * k.places < min(units, LANES) * (15 * len(k.offsets) * n + 5 * k.places)
        each = LANES if beside else TOGETHER
        for x in range(0, units, each):
            (self._beside if beside else self._pieces)(at[:, x : x + each])

    def _pieces(self, at: np.ndarray) -> None:
        self.put(at, self.kernel.pieces(at))

    def put(self, at: np.ndarray, pieces: tuple) -> None:
        """Units of (n, units) foci, by the pieces of a kernel of the same offsets."""
        k = self.kernel
        alone, (_, shared, low), (_, place, of) = pieces
        self.count(at.ravel()[alone])
        if len(shared):
            self.more -= np.bincount(shared, k.values[low], k.places)
        if len(place):
            self.more += np.bincount(place, k.values[of], k.places)

    def _beside(self, at: np.ndarray) -> None:
        """Units of many foci, LANES at most: a bit a unit at every place."""
        k = self.kernel
        foci, near = np.zeros(k.places, np.uint64), np.zeros(k.places, np.uint64)
        for u in range(at.shape[1]):
            foci[at[:, u]] |= np.uint64(1 << u)
        used = np.flatnonzero(foci)
        a, b = int(used[0]), int(used[-1]) + 1
        if k.runs:
            most = max(k.runs.values())
            wide = [foci]
            for h in range(1, most + 1):
                wide.append(wide[-1].copy())
                wide[-1][a + h : b + h] |= foci[a:b]
                wide[-1][a - h : b - h] |= foci[a:b]
            for o, h in k.runs.items():
                near[a - h + o : b + h + o] |= wide[h][a - h : b + h]
            self.more += k.values[0] * np.bitwise_count(near)
            return
        before = np.zeros(k.places, np.uint8)
        for c, value in enumerate(k.values):
            for o in k.offsets[k.of == c].tolist():
                near[a + o : b + o] |= foci[a:b]
            now = np.bitwise_count(near)
            self.more += value * (now - before)
            before = now

    def total(self) -> np.ndarray:
        """The values of the grid, flat."""
        return (self.kernel.spread_counts(self.counts) + self.more)[self.kernel.cells]


def by_size(first: np.ndarray, sizes: np.ndarray, limit: int, together: int = TOGETHER):
    """Units of equal size at a time: their numbers and the rows of their foci, (n,
    units). ``first`` has the first row of each unit. Units of more than ``limit`` foci
    come ``together``, with their last row repeated up to the largest's size."""
    for n in np.unique(sizes[sizes <= limit]).tolist():
        own = np.flatnonzero(sizes == n)
        each = max(1, DRAWN // n)
        for x in range(0, len(own), each):
            yield own[x : x + each], first[own[x : x + each]] + np.arange(n)[:, None]
    large = np.flatnonzero(sizes > limit)
    large = large[np.argsort(sizes[large], kind="stable")]
    while len(large):
        each = min(together, len(large))
        while each > 1 and sizes[large[each - 1]] * each > BESIDE:
            each -= 1
        own, large = large[:each], large[each:]
        yield own, first[own] + np.minimum(np.arange(sizes[own[-1]])[:, None], sizes[own] - 1)


def side_by_side(parts: list[np.ndarray]) -> np.ndarray:
    """Units of unlike numbers of foci as one table, filled up with their last focus."""
    most = max(len(p) for p in parts)
    return np.concatenate([p[np.minimum(np.arange(most), len(p) - 1)] for p in parts], 1)
