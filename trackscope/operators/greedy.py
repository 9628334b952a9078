"""The greedy assignments of frames, in arrays.

Overlaps are computed for blocks of truths against the predictions near them and never kept for more than ``PAIRS`` pairs
of a frame. The first pass goes by predictions, which find a truth among the first that are left; those left are bits of
whole numbers. The second pass holds for each prediction the thresholds at which it is still free as bits of one number, so that a truth chooses at
all thresholds in one step, and takes many frames side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Predictions of the first pass that go together, and truths in which they look first.
CHUNK, WINDOW = 64, 128
#: Pairs of a frame that are looked at at once, truths of a part (at most) and of a block (at least), pairs of a block up to which nothing is left out,
#: thresholds of one number of bits, frames that go side by side and boxes of these (of one frame at least), and candidates of a truth that are ordered before the rest.
PAIRS, PART, BLOCK, CELLS, BITS, SIDE, BOXES, FIRST = 1 << 22, 256, 64, 1 << 16, 64, 256, 1 << 16, 20


@dataclass(frozen=True)
class Boxes:
    """Boxes of a frame by ``ord``. ``scored`` tells scores that are not null; NaN is above every number, as in SQL."""

    ord: np.ndarray
    corners: np.ndarray
    mask: np.ndarray
    score: np.ndarray
    scored: np.ndarray

    @classmethod
    def of(cls, ords, corners, mask, score=None, scored=None) -> Boxes:
        score = np.zeros(len(ords)) if score is None else score
        order = np.argsort(ords, kind="stable")
        if (np.diff(ords[order]) == 0).any():
            order = np.lexsort((*corners[::-1], score, ords))
        return cls(ords[order], corners[:, order], mask[order], score[order], (np.ones(len(ords), bool) if scored is None else scored)[order])

    @property
    def rated(self) -> np.ndarray:
        """Scores as they compare with thresholds."""
        return np.where(np.isnan(self.score), np.inf, self.score)


def _real(boxes: Boxes) -> np.ndarray:
    return np.flatnonzero((boxes.corners[2] > boxes.corners[0]) & (boxes.corners[3] > boxes.corners[1]))


def _area(c: np.ndarray) -> np.ndarray:
    return (c[2] - c[0]) * (c[3] - c[1])


def _shared_and_whole(t: np.ndarray, p: np.ndarray, of_truth: np.ndarray, of_found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas of intersection (0 or below where there is none) and union of real boxes; the arrays are broadcast."""
    shared = np.minimum(t[2], p[2])
    shared -= np.maximum(t[0], p[0])
    np.maximum(shared, 0, out=shared)
    high = np.minimum(t[3], p[3])
    high -= np.maximum(t[1], p[1])
    shared *= high
    whole = np.add(of_truth, of_found, out=high)
    whole -= shared
    return shared, whole


def _overlap(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    shared, whole = _shared_and_whole(t, p, _area(t), _area(p))
    return shared / whole


def _whole_numbers(*corners: np.ndarray) -> bool:
    """Whether all areas, and sums of two, are exact in single precision."""
    return all(bool((np.abs(c) <= 1024).all() and (c == np.rint(c)).all()) for c in corners)


def _blocks(t: np.ndarray, p: np.ndarray, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, pairs of each, columns of the pairs, overlaps) above ``at_least`` of the corners of real boxes; each row once at most.

    The corners may have single precision if their areas are exact in it; overlaps are quotients in double precision anyway.
    """
    of_truth, of_found = _area(t), _area(p)
    # A little is left for rounding; the quotient decides.
    nearly = t.dtype.type(at_least * 0.999)
    many = max(BLOCK, CELLS // max(len(of_found), 1))
    by_place = np.lexsort((of_truth, t[0] // 16)) if many < len(of_truth) else np.arange(len(of_truth))
    for first in range(0, len(by_place), many):
        rows, columns, close, sizes = by_place[first : first + many], np.arange(len(of_found)), p, of_found
        own, areas = t[:, rows], of_truth[rows]
        if many < len(by_place):
            # No overlap exceeds the smaller area over the larger one.
            (x1, y1), (x2, y2) = own[:2].min(axis=1), own[2:].max(axis=1)
            columns = np.flatnonzero((p[0] < x2) & (p[2] > x1) & (p[1] < y2) & (p[3] > y1) & (of_found > areas.min() * nearly) & (of_found * nearly < areas.max()))
            close, sizes = p[:, columns], of_found[columns]
        if not len(columns):
            continue
        shared, whole = _shared_and_whole(own[:, :, None], close, areas[:, None], sizes)
        flat = np.flatnonzero(shared > whole * nearly)
        overlap = shared.ravel()[flat].astype(float) / whole.ravel()[flat].astype(float)
        if not (sure := overlap > at_least).all():
            flat, overlap = flat[sure], overlap[sure]
        starts = np.arange(0, len(rows) * len(columns), len(columns))
        sizes = np.searchsorted(flat, starts + len(columns))
        sizes[1:] -= sizes[:-1].copy()
        flat -= np.repeat(starts, sizes)
        yield rows, sizes, columns[flat], overlap


def pairs(truth: Boxes, found: Boxes, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of truths, places of predictions, overlaps) of all pairs above ``at_least``, in parts."""
    kind = np.float32 if _whole_numbers(truth.corners, found.corners) else float
    truths, near = _real(truth), _real(found)
    for left in range(0, len(near), PAIRS // BLOCK):
        columns = near[left : left + PAIRS // BLOCK]
        p = found.corners[:, columns].astype(kind)
        for rows, sizes, own, overlap in _blocks(truth.corners[:, truths].astype(kind), p, at_least) if len(truths) else ():
            yield truths[np.repeat(rows, sizes)], columns[own], overlap


def _equals(found: Boxes) -> np.ndarray | None:
    """The number of each prediction among the different ``ord``, or None where all differ: what is used goes by ``ord``."""
    if not (np.diff(found.ord) == 0).any():
        return None
    return np.unique(found.ord, return_inverse=True)[1]


def take_last(truth: Boxes, found: Boxes, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """First pass: each truth takes the last unused prediction with a score above 0; the places of both.

    All truths want the last prediction, so the same pairs come about if each prediction, from the last on, takes the first
    truth that is left. It finds one among the first of them mostly, so that few overlaps are looked at.
    """
    if _equals(found) is not None:
        return _take_last_of_equals(truth, found, at_least)
    near = _real(found)
    near, left = near[(found.scored & (found.rated > 0))[near]][::-1], _real(truth)
    kind = np.float32 if _whole_numbers(truth.corners, found.corners) else float
    t, p = truth.corners.astype(kind), found.corners.astype(kind)
    of_truth, of_found = _area(t), _area(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(near) and len(left):
        some = near[start : start + max(CHUNK, WINDOW * CHUNK // len(left))]
        start += len(some)
        first, gone = 0, np.zeros(len(left), bool)
        while first < len(left) and len(some):
            # The fewer predictions have found none, the more truths are looked at.
            at = slice(first, first + max(WINDOW * CHUNK // len(some), WINDOW))
            rows = left[at]
            shared, whole = _shared_and_whole(p[:, some, None], t[:, rows], of_found[some, None], of_truth[rows])
            above = shared > whole * kind(at_least * 0.999)
            flat = np.flatnonzero(above)
            low = shared.ravel()[flat].astype(float) / whole.ravel()[flat].astype(float) <= at_least
            above.ravel()[flat[low]] = False
            packed = np.packbits(above, axis=1, bitorder="little")
            width, bits, open_ = packed.shape[1], packed.tobytes(), (1 << len(rows)) - 1
            got, none = [], []
            for row in range(len(some)):
                if free := int.from_bytes(bits[row * width : (row + 1) * width], "little") & open_:
                    free &= -free
                    open_ ^= free
                    got.append((row, free.bit_length() - 1))
                else:
                    none.append(row)
            if got:
                row, taken = np.array(got).T
                pairs.append((rows[taken], some[row]))
                gone[first + taken] = True
            some = some[none]
            first += len(rows)
        left = left[~gone]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    truths, places = map(np.concatenate, zip(*pairs))
    order = np.argsort(truths)
    return truths[order], places[order]


def _take_last_of_equals(truth: Boxes, found: Boxes, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """``take_last`` truth by truth, where predictions with the same ``ord`` are used together."""
    free, number, pairs = found.scored & (found.rated > 0), _equals(found), []
    kind = np.float32 if _whole_numbers(truth.corners, found.corners) else float
    t, p = truth.corners.astype(kind), found.corners.astype(kind)
    truths, near = _real(truth), _real(found)
    start = 0
    while start < len(truths):
        near = near[free[near]]
        if not len(near):
            break
        part = truths[start : start + max(min(PAIRS // len(near), PART), 1)]
        start += len(part)
        above = np.zeros((len(part), len(near)), bool)
        for rows, sizes, columns, _ in _blocks(t[:, part], p[:, near], at_least):
            above.ravel()[np.repeat(rows * len(near), sizes) + columns] = True
        packed = np.packbits(above, axis=1, bitorder="little")
        width, bits, left = packed.shape[1], packed.tobytes(), (1 << len(near)) - 1
        same = None
        if number is not None:
            of_number: dict[int, int] = {}
            for i, k in enumerate(number[near].tolist()):
                of_number[k] = of_number.get(k, 0) | 1 << i
            same = [of_number[k] for k in number[near].tolist()]
        got = []
        for row in range(len(part)):
            if some := int.from_bytes(bits[row * width : (row + 1) * width], "little") & left:
                last = some.bit_length() - 1
                left &= ~(1 << last if same is None else same[last])
                got.append((row, last))
        if got:
            at = np.array(got, np.int64)
            pairs.append(np.stack([part[at[:, 0]], near[at[:, 1]]]))
            free[near] = np.unpackbits(np.frombuffer(left.to_bytes(width, "little"), np.uint8), bitorder="little")[: len(near)] != 0
    both = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    return both[0], both[1]


def _below(bits: np.ndarray) -> np.ndarray:
    """Numbers whose lowest ``bits`` bits are set."""
    bits = bits.astype(np.uint64)
    return np.where(bits >= BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(BITS - 1))) - np.uint64(1))


def _per_bit(numbers: np.ndarray) -> np.ndarray:
    return np.unpackbits(numbers.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if len(numbers) else np.zeros(BITS, np.int64)


def take_best(frames: list[tuple[Boxes, Boxes, dict[int, np.ndarray]]], at_least: float) -> list[dict[int, np.ndarray]]:
    """Second pass of each (truth, found, thresholds): (true, false, missed) at each of the rising thresholds, at most ``BITS``, of each bit of the masks.

    A truth takes the unused prediction with the largest overlap, one with flag 1 only if there is no other. Frames go
    together, one truth of each in a step.
    """
    out: list[dict[int, np.ndarray]] = []
    some: list[tuple[Boxes, Boxes, dict[int, np.ndarray]]] = []
    boxes = 0
    for frame in frames:
        size = max(len(frame[0].ord), len(frame[1].ord))
        if some and (len(some) == SIDE or boxes + size > BOXES):
            out += _together(some, at_least)
            some, boxes = [], 0
        some.append(frame)
        boxes += size
    return out + _together(some, at_least)


def _together(frames: list[tuple[Boxes, Boxes, dict[int, np.ndarray]]], at_least: float) -> list[dict[int, np.ndarray]]:
    """The predictions of all frames lie one after the other in ``free``, a row for each bit of the masks, and a last one that is never free."""
    levels = sorted({bit for *_, thresholds in frames for bit in thresholds})
    if not levels:
        return [{} for _ in frames]
    begin = np.cumsum([0, *(len(found.ord) for _, found, _ in frames)])
    nobody = int(begin[-1])
    owner = np.repeat(np.arange(len(frames)), np.diff(begin))
    corners = np.concatenate([found.corners for _, found, _ in frames], axis=1)
    above, flagged = np.zeros((len(levels), nobody + 1), np.int64), np.zeros((len(levels), nobody + 1), bool)
    for k, (_, found, thresholds) in enumerate(frames):
        for level, bit in enumerate(levels):
            if bit in thresholds:
                rising = np.where(np.isnan(th := thresholds[bit]), np.inf, th)
                above[level, begin[k] : begin[k + 1]] = np.where(found.scored, np.searchsorted(rising, found.rated, "right"), 0)
            flagged[level, begin[k] : begin[k + 1]] = found.mask & bit != 0
    free = _below(above)
    plain = np.where(flagged, np.uint64(0), ~np.uint64(0))
    equals = {k: number for k, (_, found, _) in enumerate(frames) if (number := _equals(found)) is not None}
    truths, real = [_real(truth) for truth, *_ in frames], [_real(found) for _, found, _ in frames]
    hits, plains = ([np.zeros((len(levels), len(truth.ord)), np.uint64) for truth, *_ in frames] for _ in range(2))
    # A candidate is a number: its overlap from the largest, and its place.
    for_place = (nobody + 1).bit_length()
    for_overlap = min(61 - for_place - max(len(levels) * len(frames), PART).bit_length(), 40)
    low, scale, shift = (1 << for_place) - 1, float((1 << for_overlap) - 1), for_place + for_overlap
    exactly = lambda t, p: _overlap(t, corners[:, p])
    whole = _whole_numbers(corners, *(truth.corners for truth, *_ in frames))
    kind = np.float32 if whole else float
    # Quotients of whole numbers differ by as much as their divisors allow, so that no two look alike.
    most = max([0.0, *(np.abs(_area(c)).max(initial=0) for c in (corners, *(truth.corners for truth, *_ in frames)))])
    distinct = whole and (2 * most) ** 2 * 4 < scale
    corners_of, near_of = [truth.corners.astype(kind) for truth, *_ in frames], corners.astype(kind)

    def ordered(keys: np.ndarray, truth_at: Callable[[np.ndarray], np.ndarray], flags: bool = False) -> np.ndarray:
        """``keys`` (with a group above ``shift``) sorted; overlaps that they can't tell apart are computed again. ``truth_at``: corners of the truths of groups; ``flags``: odd groups go by place alone."""
        keys.sort()
        if distinct:
            return keys
        high = keys >> for_place
        like = np.flatnonzero(high[1:] == high[:-1])
        if flags:
            like = like[keys[like] >> shift & 1 == 0]
        if len(like):
            t = truth_at(keys[like] >> shift)
            if (exactly(t, keys[like + 1] & low) > exactly(t, keys[like] & low)).any():
                group, at = keys >> shift, keys & low
                overlap = exactly(truth_at(group), at)
                return keys[np.lexsort((at, np.where(group & 1, 0.0, -overlap) if flags else -overlap, group))]
        return keys

    def used(at: np.ndarray, level: np.ndarray, taken: np.ndarray) -> None:
        """Predictions with the same ``ord`` are used together."""
        for place, row, bits in zip(at.tolist(), level.tolist(), taken):
            if (number := equals.get(int(owner[place]))) is not None:
                first = begin[owner[place]]
                free[row, first + np.flatnonzero(number == number[place - first])] &= ~bits

    step_of = np.arange(PART)
    for start in range(0, max(map(len, truths)), PART):
        steps = min(max(map(len, truths)) - start, PART)
        counts = np.zeros((steps, len(frames)), np.int64)
        top = np.full((steps, len(frames), FIRST), nobody, np.int64)
        pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (truth, found, _) in enumerate(frames):
            part = truths[k][start : start + PART]
            near = real[k] = real[k][np.bitwise_or.reduce(free[:, begin[k] + real[k]], axis=0) != 0]
            if not len(part) or not len(near):
                continue
            t, own = truth.corners[:, part], []
            for rows, sizes, columns, overlap in _blocks(corners_of[k][:, part], near_of[:, begin[k] + near], at_least):
                keys = ((1.0 - overlap) * scale).astype(np.int64)
                keys <<= for_place
                keys |= (begin[k] + near)[columns]
                counts[rows, k] = sizes
                own.append((rows, sizes, keys))
            if not own:
                continue
            pieces += [(k, *piece) for piece in own]
            total = sum(len(keys) for *_, keys in own)
            # The largest overlaps, about so many of each truth; where the cut is matters for speed alone.
            cut = 1 << shift
            if total > 2 * FIRST * len(part):
                some = np.concatenate([keys[::8] for *_, keys in own])
                cut = np.partition(some, at := FIRST * len(part) * len(some) // total)[at] >> for_place << for_place
            first = ordered(np.concatenate([(np.repeat(rows, sizes)[inside := np.flatnonzero(keys < cut)] << shift) | keys[inside] for rows, sizes, keys in own]), lambda rows: t[:, rows])
            if not len(first):
                continue
            row = first >> shift
            place = np.arange(len(first))
            place -= np.searchsorted(row, step_of[: len(part)])[row]
            inside = np.flatnonzero(place < FIRST)
            top[row[inside], k, place[inside]] = first[inside] & low
        ends = np.cumsum(counts.ravel()).reshape(counts.shape)
        keys = np.empty(ends[-1, -1], np.int64)
        for k, rows, sizes, own in pieces:
            keys[np.repeat(ends[rows, k] - np.cumsum(sizes), sizes) + np.arange(len(own))] = own
        pieces.clear()
        steps_end = [0, *ends[:, -1].tolist()]
        served_at, plain_at = np.zeros((2, steps, len(levels), len(frames)), np.uint64)
        for step in range(steps):
            if steps_end[step] == steps_end[step + 1]:
                continue
            # The unflagged candidates with the largest overlaps.
            open_ = free.take(top[step], axis=1)
            open_ &= plain.take(top[step], axis=1)
            upto = np.bitwise_or.accumulate(open_, axis=2)
            open_[:, :, 1:] &= ~upto[:, :, :-1]
            served = upto[:, :, -1].copy()
            chosen = np.flatnonzero(open_)
            if len(chosen):
                level, at = chosen // top[step].size, top[step].ravel()[chosen % top[step].size]
                taken = open_.ravel()[chosen]
                free[level, at] ^= taken
                if equals:
                    used(at, level, taken)
            # All others, at thresholds not yet served.
            own = keys[steps_end[step] : steps_end[step + 1]]
            at = own & low
            by_flag = np.zeros_like(served)
            open_ = free.take(at, axis=1)
            open_ &= np.repeat(~served, counts[step], axis=1)
            left = np.flatnonzero(open_)
            if len(left):
                level, i = left // len(own), left % len(own)
                at, own = at[i], own[i]
                last = flagged[level, at]
                own = np.where(last, 1 << shift | at, own) | (level * len(frames) + owner[at]) << shift + 1
                lanes = lambda lane: np.stack([frames[k][0].corners[:, truths[k][start + step]] for k in ((lane >> 1) % len(frames)).tolist()], axis=1)  # noqa: E731, B023
                own = ordered(own, lanes, True)
                lane, at = own >> shift + 1, own & low
                level = lane // len(frames)
                starts = np.concatenate(([0], (lane[1:] != lane[:-1]).nonzero()[0] + 1))
                sizes = np.diff(starts, append=len(lane))
                cell = np.arange(len(lane)) + np.repeat(np.arange(len(starts)) * sizes.max() - starts, sizes)
                open_ = np.zeros((len(starts), sizes.max()), np.uint64)
                open_.ravel()[cell] = free[level, at] & ~served.ravel()[lane]
                upto = np.bitwise_or.accumulate(open_, axis=1)
                open_[:, 1:] &= ~upto[:, :-1]
                taken = open_.ravel()[cell]
                chosen = taken.nonzero()[0]
                at, level, lane, taken = at[chosen], level[chosen], lane[chosen], taken[chosen]
                free[level, at] ^= taken
                if equals:
                    used(at, level, taken)
                served.ravel()[own[starts] >> shift + 1] |= upto[:, -1]
                last = flagged[level, at]
                np.bitwise_or.at(by_flag.ravel(), lane[last], taken[last])
            served_at[step], plain_at[step] = served, served & ~by_flag
        for k, own in enumerate(truths):
            part = own[start : start + PART]
            hits[k][:, part], plains[k][:, part] = served_at[: len(part), :, k].T, plain_at[: len(part), :, k].T
    out: list[dict[int, np.ndarray]] = []
    for k, (truth, _, thresholds) in enumerate(frames):
        out.append({})
        for level, bit in enumerate(levels):
            if bit not in thresholds:
                continue
            steps, own = len(thresholds[bit]), slice(begin[k], begin[k + 1])
            counts = truth.mask & bit == 0
            scores = np.bincount(above[level, own][~flagged[level, own] & (above[level, own] > 0)], minlength=steps + 1)[1:][::-1].cumsum()[::-1]
            true, used_ = _per_bit(plains[k][level][counts])[:steps], _per_bit(plains[k][level])[:steps]
            out[k][bit] = np.stack([true, scores - used_, counts.sum() - _per_bit(hits[k][level][counts])[:steps]])
    return out
