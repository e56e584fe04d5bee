"""Ordered tracking of detections, one independent fold for each video and epoch.

A frame is taken in this order: predict all tracks, match, return of frozen
sources, freezing around what vanished, update of matched tracks, births from
what is left, pruning, countdown of freezes, removal of dead tracks. No state
crosses an epoch, so epochs run in parallel; a stream keeps one state a video.

Edge cases: in a table with vectors a pair in which one is missing costs 0.5 or
more in appearance and is rejected, likewise keypoints in pose; a table without
the column is matched without that gate. A row without a coverage has
the coverage 0, a table without the column has it 1 throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trailmark.functions.geometry import SWAPS
from trailmark.functions.pose import BONES, CORE, ROOTS

STATES = "video string, epoch_id bigint, frame_idx bigint, local_track_id bigint, det_id bigint, is_matched boolean, confirmed boolean, hits bigint, age bigint, time_since_update bigint, center_x double, center_y double"


@dataclass(frozen=True)
class Params:
    """Shipped values."""

    dt: float = 1 / 30
    process: float = 1e7
    measure: float = 5000.0
    p0: float = 1000.0
    chi2: float = 9.21
    motion: float = 0.09
    pose: float = 0.4
    appearance: float = 0.12
    greedy: float = 4.1
    weights: tuple[float, float, float] = (3.0, 1.0, 2.0)
    ratio: tuple[float, float, float] = (3.0, 3.0, 3.0)
    boost: float = 4.0
    missing: float = 0.08
    update_motion: float = 0.08
    update_pose: float = 0.25
    update_appearance: float = 0.06
    #: Share of a detection's place in the motion update of an overlapped track.
    overlap_motion: float = 0.25
    #: Overlap that is risky, by the pair's scaled distance, for two stable tracks; else the last.
    overlap_near: tuple[float, float] = (0.55, 0.003)
    overlap_mid: tuple[float, float] = (0.85, 0.005)
    overlap_far: tuple[float, float] = (1.20, 0.007)
    overlap_default: float = 0.008
    #: Vectors too far for an update are kept and, if several agree, move the track's a little.
    buffer_upper: float = 0.12
    buffer_hard: float = 0.18
    buffer_relax: float = 8.0
    buffer_size: int = 3
    buffer_motion: float = 0.08
    buffer_pose: float = 0.25
    buffer_coverage: float = 0.70
    buffer_ema: float = 0.97
    ema: float = 0.9
    relax_full: float = 20.0
    relax_strength: float = 2.0
    min_conf: float = 0.05
    max_age: int = 10
    max_confirmed_age: int = 30
    min_hits: int = 30
    min_hits_sub: int = 4
    max_unconfirmed: int = 3
    freeze: int = 13
    easy_births: int = 4
    easy_hits: int = 1
    normal_hits: int = 2
    near_hits: int = 4
    blocked_hits: int = 6
    close: float = 0.04
    near: float = 0.15
    birth_chi2: float = 9.4877
    birth_motion: float = 0.60
    birth_age: int = 4
    birth_misses: int = 2
    #: 0 is no gate: the configured 0.45 is never read there.
    birth_score: float = 0.0
    birth_pose_missing: float = 0.05
    birth_pose_bad: float = 0.18
    birth_pose_limit: float = 0.8
    birth_joints: int = 3
    birth_appearance_missing: float = 0.03
    birth_appearance_bad: float = 0.12
    birth_appearance_limit: float = 0.35
    birth_near_existing: float = 0.03
    joints_update: int = 5
    joints_create: int = 7


@dataclass
class Motion:
    """Two axes with one covariance (a, b, c); see the fold in ``functions.vectors``."""

    x: float
    y: float
    vx: float = 0.0
    vy: float = 0.0
    a: float = 0.0
    b: float = 0.0
    c: float = 0.0

    def predict(self, p: Params) -> None:
        dt = p.dt
        self.x, self.y = self.x + dt * self.vx, self.y + dt * self.vy
        self.a += 2 * dt * self.b + dt * dt * self.c + p.process * dt**4 / 4
        self.b += dt * self.c + p.process * dt**3 / 2
        self.c += p.process * dt * dt

    def distance(self, x: float, y: float, p: Params) -> float:
        dx, dy = x - self.x, y - self.y
        return (dx * dx + dy * dy) / (self.a + p.measure)

    def update(self, x: float, y: float, p: Params) -> None:
        s = self.a + p.measure
        dx, dy, g, h = x - self.x, y - self.y, self.a / s, self.b / s
        self.x, self.y, self.vx, self.vy = self.x + g * dx, self.y + g * dy, self.vx + h * dx, self.vy + h * dy
        self.c -= self.b * h
        self.a, self.b = self.a * p.measure / s, self.b * p.measure / s


@dataclass
class Seen:
    """A detection."""

    det_id: int
    x: float
    y: float
    points: np.ndarray | None = None
    conf: np.ndarray | None = None
    vector: np.ndarray | None = None
    coverage: float = 1.0
    overlap: float = 0.0
    risky: tuple[int, ...] = ()
    #: (detection, overlap, scaled distance) of each overlap, where the table has them; else ``risky`` is taken.
    overlaps: tuple[tuple[int, float, float], ...] | None = None
    mask: np.ndarray | None = None
    #: Whether the table has keypoints and vectors at all; only then is a missing one rejected.
    posed: bool = False
    dressed: bool = False


@dataclass
class Track:
    id: int
    motion: Motion
    points: np.ndarray | None = None
    conf: np.ndarray | None = None
    vector: np.ndarray | None = None
    hits: int = 0
    age: int = 1
    missed: int = 0
    confirmed: bool = False
    sub: bool = False
    frozen: dict[int, int] = field(default_factory=dict)  # source -> frames left
    group: tuple[int, ...] = ()
    center: tuple[float, float] = (0.0, 0.0)
    #: Unit vectors kept for a recovery, and matched frames since the last update of the vector.
    buffer: list[np.ndarray] = field(default_factory=list)
    stale: int = 0

    @property
    def stable(self) -> bool:
        return self.confirmed or self.sub


@dataclass
class Pending:
    motion: Motion
    kind: str
    need: int
    seen: Seen
    vector: np.ndarray | None = None
    hits: int = 1
    age: int = 1
    misses: int = 0


def pose_similarity(a: np.ndarray | None, ca, b: np.ndarray | None, cb, least: float) -> float:
    """The larger cosine of bone directions, as given and with sides swapped; 0 without shared joints."""
    if a is None or b is None or len(a) < 25 or len(b) < 25:
        return 0.0

    def directions(points, ok):
        out = []
        for i, j in BONES:
            v = points[j] - points[i]
            out.append(v / (np.linalg.norm(v) + 1e-9) if ok[i] and ok[j] else np.zeros(2))
        return np.concatenate(out)

    swapped = np.arange(25)
    for i, j in SWAPS:
        swapped[[i, j]] = j, i
    good = lambda p, c: np.isfinite(p).all(axis=1) & (np.ones(25) >= least if c is None else np.asarray(c)[:25] >= least) & np.isin(np.arange(25), CORE)
    best, ga, gb = 0.0, good(a[:25], ca), good(b[:25], cb)
    for order in (np.arange(25), swapped):
        shared = ga & gb[order]
        if not any(shared[r] for r in ROOTS):
            continue
        u, v = directions(a[:25], shared), directions(b[:25][order], shared)
        n = np.linalg.norm(u) * np.linalg.norm(v)
        best = max(best, float(u @ v / n) if n > 1e-8 else 0.0)
    return best


def joints(s: Seen) -> int:
    """Core joints with finite coordinates, whatever their confidence."""
    if s.points is None or s.points.ndim != 2:
        return 0
    core = [i for i in CORE if i < len(s.points)]
    return int(np.isfinite(s.points[core, :2]).all(axis=1).sum())


def _cosine(a, b, mask=None) -> float:
    """Over the valid components; over all where the mask fits neither or is empty."""
    if a is None or b is None or len(a) != len(b):
        return 0.0
    if mask is not None and len(mask) == len(a) and mask.any():
        a, b = a[mask], b[mask]
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 1e-8 else 0.0


def pose_penalty(a: Seen, b: Seen, p: Params) -> float:
    """Mean distance of shared core joints against their spread: penalty where too large or too few are shared."""
    if a.points is None or b.points is None or len(a.points) != len(b.points):
        return p.birth_pose_missing
    n = len(a.points)
    ca, cb = (np.ones(n) if s.conf is None else np.asarray(s.conf, dtype=float) for s in (a, b))
    if len(ca) != n or len(cb) != n:
        return p.birth_pose_missing
    core = np.array([i for i in CORE if i < n], dtype=int)
    u, v = a.points[core, :2], b.points[core, :2]
    shared = np.isfinite(u).all(axis=1) & np.isfinite(v).all(axis=1) & (ca[core] >= p.min_conf) & (cb[core] >= p.min_conf)
    if shared.sum() < p.birth_joints:
        return p.birth_pose_missing
    u, v = u[shared], v[shared]
    away = np.linalg.norm(u - v, axis=1).mean() / (u.std() + v.std() + 1e-6)
    return 0.0 if away <= p.birth_pose_limit else p.birth_pose_bad


def risky_overlaps(s: Seen, track: Track | None, holder: dict[int, Track], p: Params) -> tuple[int, ...]:
    """Detections whose overlap with ``s`` exceeds the threshold of the pair: graded
    by distance where both tracks are stable, the default otherwise."""
    if s.overlaps is None:
        return s.risky
    found = []
    for other, overlap, away in s.overlaps:
        limit, held = p.overlap_default, holder.get(other)
        if track is not None and track.stable and held is not None and held.stable:
            limit = next((x for reach, x in (p.overlap_near, p.overlap_mid, p.overlap_far) if away <= reach), limit)
        if overlap > limit:
            found.append(other)
    return tuple(found)


def decide_appearance(t: Track, s: Seen, motion: float, pose: float, appearance: float, overlapped: bool, p: Params) -> str:
    """How a matched detection may change its track's vector: ``strict``, ``buffer``,
    ``recovery`` or the reason of a rejection. Buffers, and applies a recovery.

    The reach of the buffer grows with the matched frames since the last update.
    """
    frozen = bool(t.frozen)
    if appearance <= p.update_appearance and not overlapped and not frozen and s.vector is not None:
        return "strict"
    reach = min(p.buffer_hard, p.buffer_upper + (p.buffer_hard - p.buffer_upper) * (1 - math.exp(-t.stale / max(p.buffer_relax, 1e-6))))
    safe = motion <= p.buffer_motion and pose <= p.buffer_pose and s.coverage >= p.buffer_coverage
    if s.vector is not None and p.update_appearance < appearance <= reach and safe and not overlapped and not frozen:
        n = float(np.linalg.norm(s.vector))
        t.buffer.append(s.vector / n if n > 1e-8 else s.vector)
        if len(t.buffer) < max(1, p.buffer_size) or t.vector is None:
            return "buffer"
        batch = np.mean(t.buffer, axis=0)
        moved = p.buffer_ema * t.vector + (1 - p.buffer_ema) * batch / max(float(np.linalg.norm(batch)), 1e-8)
        t.vector = moved / max(float(np.linalg.norm(moved)), 1e-8)
        t.stale, t.buffer = 0, []
        return "recovery"
    hard = appearance > p.buffer_hard
    if overlapped or frozen or hard or not safe:
        t.buffer = []
    if overlapped:
        return "overlap"
    if frozen:
        return "freeze"
    if s.vector is None:
        return "missing"
    return "hard" if hard else "unsafe" if not safe else "above"


def penalties(values: np.ndarray, active: np.ndarray, k: float) -> np.ndarray:
    """Log ratio to the best active value, 0 to 1; 1 where not active."""
    if not active.any():
        return np.ones(len(values))
    best = values[active].min()
    out = np.clip(np.log((values + 1e-6) / (best + 1e-6)) / math.log(max(k, 1.000001)), 0, 1)
    return np.where(active, out, 1.0)


def deferred_match(row_cost: np.ndarray, valid: np.ndarray, conflict, greedy: float) -> dict[int, int]:
    """Tracks propose in the order of their costs; a detection keeps the best of
    its proposers by conflict cost, own cost and position; losers go on."""
    order = [np.argsort(row, kind="stable") for row in row_cost]
    wishes = {t: o[valid[t, o] & (row_cost[t, o] <= greedy)] for t, o in enumerate(order)}

    def contested(d: np.ndarray, t: np.ndarray, _: np.ndarray) -> np.ndarray:
        groups = np.split(t, np.flatnonzero(np.diff(d)) + 1)
        return np.concatenate([conflict(int(e), g.tolist()) if len(g) > 1 else [0.0] for e, g in zip(np.unique(d), groups, strict=True)])

    return {t: int(wishes[t][k]) for t, k in _proposals(wishes, {t: row_cost[t, w] for t, w in wishes.items()}, contested).items()}


def _proposals(wishes: dict[int, np.ndarray], costs: dict[int, np.ndarray], conflict) -> dict[int, int]:
    """The same from each track's wishes, first to last, with their costs: the place
    in its wishes of what a track holds. All that propose in a round do so at once.

    ``conflict(d, t, place)`` gives the cost of each proposal of a round, sorted by
    detection and track; places run over the wishes of all tracks.
    """
    if not any(len(w) for w in wishes.values()):
        return {}
    tracks = np.array(list(wishes), dtype=np.int64)
    flat, row = np.concatenate(list(wishes.values())).astype(np.int64), np.concatenate(list(costs.values()))
    count, start = np.zeros((2, tracks.max() + 1), dtype=np.int64)
    count[tracks] = [len(w) for w in wishes.values()]
    start[tracks] = np.cumsum(count[tracks]) - count[tracks]
    at, owner = np.full(len(count), -1), np.full(flat.max() + 1, -1)
    free = tracks[count[tracks] > 0]
    while len(free):
        at[free] += 1
        held = owner[np.unique(flat[start[free] + at[free]])]
        t = np.sort(np.concatenate([free, held[held >= 0]]))
        place = start[t] + at[t]
        order = np.argsort(flat[place], kind="stable")
        t, place = t[order], place[order]
        d = flat[place]
        order = np.lexsort((t, row[place], conflict(d, t, place), d))
        t, d = t[order], d[order]
        first = np.r_[True, d[1:] != d[:-1]]
        owner[d[first]] = t[first]
        free = t[~first]
        free = free[at[free] + 1 < count[free]]
    return {t: int(at[t]) for t in owner[owner >= 0].tolist()}


def ascending_pairs(left: list[list[int]], right: list[list[int]], i: np.ndarray, j: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs, those of the lowest score first, then of the lowest members.

    ``i, j, score`` are pairs of kinds: all members of ``left[i]`` and ``right[j]``
    (ascending) score alike. Members that are taken are taken out of the lists.
    """
    out: list[tuple[int, int]] = []
    a, b = [0] * len(left), [0] * len(right)
    order = np.argsort(score, kind="stable")
    i, j, score = i[order], j[order], score[order]
    edges = np.flatnonzero(np.diff(score)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(score)], strict=True):
        some = [(u, v) for u, v in zip(i[low:high].tolist(), j[low:high].tolist(), strict=True) if a[u] < len(left[u]) and b[v] < len(right[v])]
        if len(some) == 1:
            u, v = some[0]
            n = min(len(left[u]) - a[u], len(right[v]) - b[v])
            out += zip(left[u][a[u] : a[u] + n], right[v][b[v] : b[v] + n], strict=True)
            a[u], b[v] = a[u] + n, b[v] + n
        elif some:
            near: dict[int, list[int]] = {}
            for u, v in some:
                near.setdefault(u, []).append(v)
            for m, u in sorted((m, u) for u in near for m in left[u][a[u] :]):
                open_ = [v for v in near[u] if b[v] < len(right[v])]
                if open_:
                    v = min(open_, key=lambda v: right[v][b[v]])
                    out.append((m, right[v][b[v]]))
                    a[u], b[v] = a[u] + 1, b[v] + 1
    for lists, taken in ((left, a), (right, b)):
        for k, n in enumerate(taken):
            del lists[k][:n]
    return out


#: So many pairs of kinds are compared at once where a frame has more.
AT_ONCE = 1 << 18


def _within(xs: np.ndarray, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``x`` moved by ``reach`` begins and ends in the ascending ``xs``."""
    reach = reach * (1 + 1e-9) + 1e-9 * (1 + np.abs(x))
    return np.searchsorted(xs, x - reach, "left"), np.searchsorted(xs, x + reach, "right")


class Tracker:
    """The state of one video within one epoch."""

    def __init__(self, params: Params | None = None):
        self.p = params or Params()
        self.tracks: list[Track] = []
        self.pending: list[Pending] = []
        self.next_id, self.easy, self.before = 1, 0, set()
        self.log: list[tuple] | None = None  # a list takes one row a matched pair

    def _wishes(self, seen: list[Seen]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each track the detections that pass all gates, with their motion, pose
        and appearance costs. Only detections within reach are looked at."""
        p = self.p
        x, y, coverage = (np.array([getattr(s, c) for s in seen], dtype=float) for c in ("x", "y", "coverage"))
        posed, dressed = (np.array([getattr(s, c) for s in seen], dtype=bool) for c in ("posed", "dressed"))
        points, vectors = (np.array([getattr(s, c) is not None for s in seen], dtype=bool) for c in ("points", "vector"))
        order = np.argsort(x, kind="stable")
        relax = np.array([1 + p.relax_strength * (min(1.0, t.missed / p.relax_full) if t.confirmed else 0.0) for t in self.tracks])
        spread = np.array([t.motion.a + p.measure for t in self.tracks])
        low, high = _within(x[order], np.array([t.motion.x for t in self.tracks]), np.sqrt(p.chi2 * np.minimum(1.0, p.motion * relax) * spread))
        for i, t in enumerate(self.tracks):
            at = order[low[i] : high[i]]
            dx, dy = x[at] - t.motion.x, y[at] - t.motion.y
            d = (dx * dx + dy * dy) / spread[i]
            motion = np.minimum(1.0, d / p.chi2)
            keep = (d <= p.chi2) & (motion <= p.motion * relax[i])
            at, motion = at[keep], motion[keep]
            pose = np.full(len(at), 0.5)
            if t.points is not None:
                for k in np.flatnonzero(points[at]):
                    s = seen[at[k]]
                    pose[k] = (1 - pose_similarity(t.points, t.conf, s.points, s.conf, p.min_conf)) / 2
            keep = (pose <= p.pose * relax[i]) | ~posed[at]
            at, motion, pose = at[keep], motion[keep], pose[keep]
            look = np.full(len(at), 0.5)
            if t.vector is not None:
                for k in np.flatnonzero(vectors[at]):
                    s = seen[at[k]]
                    look[k] = (1 - _cosine(t.vector, s.vector, s.mask)) / 2
            look = np.minimum(1.0, np.maximum(0.0, look + p.missing * (1 - coverage[at])))
            keep = (look <= p.appearance) | ~dressed[at]
            if keep.any():
                yield i, at[keep], np.stack([motion, pose, look])[:, keep]

    def _match(self, seen: list[Seen]) -> tuple[dict[int, int], dict[int, np.ndarray]]:
        """The detection of each matched track, and the pair's three costs."""
        p = self.p

        def total(parts: np.ndarray, over: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """Log ratios to the best of each run of columns, weighted."""
            n = np.diff(np.r_[starts, len(over)])
            best = np.repeat(np.minimum.reduceat(parts, starts, axis=1), n, axis=1)
            away = [np.clip(np.log((v + 1e-6) / (b + 1e-6)) / math.log(max(k, 1.000001)), 0, 1) for v, b, k in zip(parts, best, p.ratio, strict=True)]
            w = p.weights
            return w[0] * away[0] + w[1] * away[1] + np.where(over, w[2] * p.boost, w[2]) * away[2]

        over = np.array([s.overlap > 0 for s in seen], dtype=bool)
        wishes: dict[int, np.ndarray] = {}
        costs: dict[int, np.ndarray] = {}
        parts: dict[int, np.ndarray] = {}
        for i, at, found in self._wishes(seen):
            row = total(found, over[at], np.zeros(1, dtype=int))
            order = np.lexsort((at, row))
            order = order[row[order] <= p.greedy]
            wishes[i], costs[i], parts[i] = at[order], row[order], found[:, order]
        if not wishes:
            return {}, {}
        every = np.concatenate(list(parts.values()), axis=1)

        def conflict(d: np.ndarray, t: np.ndarray, place: np.ndarray) -> np.ndarray:
            return total(every[:, place], over[d], np.r_[0, np.flatnonzero(np.diff(d)) + 1])

        held = _proposals(wishes, costs, conflict)
        return {i: int(wishes[i][k]) for i, k in held.items()}, {i: parts[i][:, k] for i, k in held.items()}

    def step(self, seen: list[Seen]) -> list[tuple]:
        """One frame: state rows of the tracks that live after it."""
        p = self.p
        for t in self.tracks:
            t.motion.predict(p)
            t.age += 1
            t.missed += 1
        matches, cost = self._match(seen) if self.tracks and seen else ({}, {})
        now = {self.tracks[i].id for i in matches}
        for t in self.tracks:
            t.frozen = {s: n for s, n in t.frozen.items() if s not in now}
        fresh = self.before - now
        for t in self.tracks:
            for source in fresh:
                if t.id == source or source in t.group:
                    t.frozen[source] = max(p.freeze, t.frozen.get(source, 0))
        holder = {seen[j].det_id: self.tracks[i] for i, j in matches.items()}
        for i, j in matches.items():
            t, s = self.tracks[i], seen[j]
            risky = risky_overlaps(s, t, holder, p)
            decision = decide_appearance(t, s, *cost[i], bool(risky), p)
            moved = cost[i][0] <= p.update_motion
            if self.log is not None:
                total = float(np.dot(p.weights, cost[i]))
                self.log.append((t.id, s.det_id, *(float(c) for c in cost[i]), total, moved, decision, list(risky), sorted(t.frozen)))
            if moved:
                # Under an overlap the place is trusted a little, pose and vector not at all.
                share = p.overlap_motion if risky else 1.0
                t.motion.update(t.motion.x + share * (s.x - t.motion.x), t.motion.y + share * (s.y - t.motion.y), p)
                t.hits += 1
                t.missed = 0
                t.confirmed |= t.hits >= p.min_hits
                t.sub |= t.hits >= p.min_hits_sub
                t.center = (s.x, s.y)
                if not risky and s.points is not None and cost[i][1] <= p.update_pose and joints(s) >= p.joints_update:
                    t.points, t.conf = s.points, s.conf
            if decision == "strict" and moved:
                t.vector = s.vector if t.vector is None else p.ema * t.vector + (1 - p.ema) * s.vector
                t.buffer, t.stale = [], 0
            elif decision != "recovery":
                t.stale += 1
            t.group = tuple(sorted(holder[o].id for o in risky if o in holder))
        taken = set(matches.values())
        self._births([s for j, s in enumerate(seen) if j not in taken])
        loose = sorted((t for t in self.tracks if not t.confirmed and not t.sub and t.age > 1), key=lambda t: (-t.hits, t.missed, t.age))
        gone = {t.id for t in loose[p.max_unconfirmed :]}
        for t in self.tracks:
            t.frozen = {s: n - (s not in fresh) for s, n in t.frozen.items() if n - (s not in fresh) > 0}
        self.before = now
        dets = {self.tracks[i].id: seen[j].det_id for i, j in matches.items()}
        self.tracks = [t for t in self.tracks if t.id not in gone and t.missed <= (p.max_confirmed_age if t.confirmed else p.max_age)]
        return [(t.id, dets.get(t.id, -1), t.id in dets, t.confirmed, t.hits, t.age, t.missed, *t.center) for t in self.tracks]

    def _nearest(self, seen: list[Seen], tracks: list[Track]) -> list[float]:
        """The scaled distance of each detection to the nearest of the tracks."""
        p, out = self.p, np.full(len(seen), math.inf)
        x, y = (np.array([getattr(s, c) for s in seen], dtype=float) for c in "xy")
        for t in tracks:
            dx, dy = x - t.motion.x, y - t.motion.y
            out = np.fmin(out, (dx * dx + dy * dy) / (t.motion.a + p.measure) / p.birth_chi2)
        return out.tolist()

    def _continued(self, rest: list[Seen]) -> list[tuple[int, int]]:
        """Which pending candidate goes on by which detection, the lowest scores first.

        Candidates alike in all that is scored are scored once, likewise detections.
        In a large frame near pairs are settled before farther ones are looked at.
        """
        p = self.p
        kinds: dict[tuple, list[int]] = {}
        for i, c in enumerate(self.pending):
            m, own = c.motion, c.seen.points is not None or c.vector is not None
            kinds.setdefault((m.x, m.y, m.a, c.kind == "near", i if own else -1), []).append(i)
        places: dict[tuple, list[int]] = {}
        for j, s in enumerate(rest):
            places.setdefault((s.x, s.y, j if s.points is not None or s.vector is not None else -1), []).append(j)
        left, right = list(kinds.values()), [places[k] for k in sorted(places)]
        if not left or not right:
            return []
        x, y, a = (np.array([k[c] for k in kinds], dtype=float) for c in range(3))
        extra = np.array([p.birth_near_existing if k[3] else 0.0 for k in kinds])
        xs, ys = (np.array([k[c] for k in sorted(places)], dtype=float) for c in range(2))
        # The least that is added to the distance.
        points, vectors = (any(v is not None for v in (getattr(c, n) for c in some)) for n, some in (("points", rest), ("vector", rest)))
        base = (0.0 if points else p.birth_pose_missing, 0.0 if vectors else p.birth_appearance_missing)
        out: list[tuple[int, int]] = []
        reaches = [p.birth_motion / 4**k for k in range(12, -1, -1)]
        while reaches:
            u, v = (np.array([k for k, some in enumerate(lists) if some], dtype=int) for lists in (left, right))
            if not len(u) or not len(v):
                break

            def windows(reach: float) -> tuple[np.ndarray, np.ndarray]:
                return _within(xs[v], x[u], np.sqrt(reach * p.birth_chi2 * (a[u] + p.measure)))  # noqa: B023

            reach = reaches.pop(0)
            low, high = windows(reach)
            while reaches:
                more = windows(reaches[0])
                if (more[1] - more[0]).sum() > AT_ONCE:
                    break
                reach, (low, high) = reaches.pop(0), more
            n = high - low
            i = np.repeat(u, n)
            j = v[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            dx, dy = xs[j] - x[i], ys[j] - y[i]
            motion = (dx * dx + dy * dy) / (a[i] + p.measure) / p.birth_chi2
            keep = motion <= reach
            i, j, motion = i[keep], j[keep], motion[keep]
            pose, look = np.full(len(i), p.birth_pose_missing), np.full(len(i), p.birth_appearance_missing)
            if points or vectors:
                for k, (c, s) in enumerate((self.pending[left[g][0]], rest[right[h][0]]) for g, h in zip(i.tolist(), j.tolist(), strict=True)):
                    pose[k] = pose_penalty(c.seen, s, p)
                    if c.vector is not None and s.vector is not None:
                        look[k] = p.birth_appearance_bad if (1 - _cosine(c.vector, s.vector)) / 2 > p.birth_appearance_limit else 0.0
            score = motion + pose + look + extra[i]
            # Pairs out of reach score no less than this.
            keep = score < (reach + base[0]) + base[1] if reaches else np.ones(len(i), dtype=bool)
            if p.birth_score > 0:
                keep &= score <= p.birth_score
            out += ascending_pairs(left, right, i[keep], j[keep], score[keep])
        return out

    def _births(self, rest: list[Seen]) -> None:
        p = self.p
        stable = [t for t in self.tracks if t.stable]
        for c in self.pending:
            c.motion.predict(p)
            c.age += 1
        used_c: set[int] = set()
        used_s: set[int] = set()
        for i, j in self._continued(rest):
            used_c.add(i)
            used_s.add(j)
            c = self.pending[i]
            c.motion.update(rest[j].x, rest[j].y, p)
            c.seen, c.hits, c.misses = rest[j], c.hits + 1, 0
            if rest[j].vector is not None:
                c.vector = rest[j].vector if c.vector is None else p.ema * c.vector + (1 - p.ema) * rest[j].vector
        ready = []
        blocked = [c for c in self.pending if c.kind == "blocked"]
        distance = {id(c): away for c, away in zip(blocked, self._nearest([c.seen for c in blocked], stable), strict=True)}
        for i, c in enumerate(self.pending):
            c.misses += i not in used_c
            if c.kind == "blocked":  # set free of what it stood too close to; the hits it needs stay
                away = distance[id(c)]
                c.kind = c.kind if away <= p.close else "near" if away <= p.near else "normal"
            if i in used_c and c.hits >= c.need:
                ready.append(c)
        born = {id(c) for c in ready}
        self.pending = [c for c in self.pending if id(c) not in born and c.age <= p.birth_age and c.misses <= p.birth_misses]
        for j, (s, nearest) in enumerate(zip(rest, self._nearest(rest, stable), strict=True)):
            if j in used_s:
                continue
            if self.easy < p.easy_births:
                kind, need = "easy_start", p.easy_hits
                self.easy += 1
            elif nearest <= p.close:
                kind, need = "blocked", p.blocked_hits
            elif nearest <= p.near:
                kind, need = "near", p.near_hits
            else:
                kind, need = "normal", p.normal_hits
            c = Pending(Motion(s.x, s.y, a=p.p0, c=p.p0), kind, need, s, s.vector)
            (ready if c.hits >= need else self.pending).append(c)
        for c in sorted(ready, key=lambda c: c.seen.det_id):
            s = c.seen
            easy, risky = c.kind == "easy_start", risky_overlaps(s, None, {}, p)
            points, conf = (s.points, s.conf) if easy or not risky else (None, None)
            vector = s.vector if easy or (joints(s) >= p.joints_create and not risky) else None
            t = Track(self.next_id, Motion(s.x, s.y, a=p.p0, c=p.p0), points, conf, vector, hits=1, center=(s.x, s.y))
            t.motion.update(s.x, s.y, p)
            self.tracks.append(t)
            self.next_id += 1


def _array(value) -> np.ndarray | None:
    return None if value is None else np.array([list(v) if isinstance(v, list | np.ndarray) else v for v in value], dtype=float)


def _mask(value) -> np.ndarray | None:
    return None if value is None else np.array([bool(v) for v in value], dtype=bool)


def _overlaps(value) -> tuple[tuple[int, float, float], ...] | None:
    return None if value is None else tuple((int(v["det_idx"]), float(v["iou"]), float(v["center_dist_norm"])) for v in value)


def _coverage(value) -> float:
    """1 where the table has none, 0 where a row has none."""
    return 0.0 if value is None or math.isnan(value) else min(1.0, max(0.0, float(value)))


def _frame(rows: pd.DataFrame) -> list[Seen]:
    out, posed, dressed = [], "keypoints" in rows, "e_app" in rows
    for r in rows.sort_values("det_id").to_dict("records"):
        if pd.isna(r["det_id"]) or pd.isna(r["center_x"]) or pd.isna(r["center_y"]):
            continue  # a frame without detections, or a detection without a place
        out.append(Seen(int(r["det_id"]), float(r["center_x"]), float(r["center_y"]), _array(r.get("keypoints")), _array(r.get("kp_conf")), _array(r.get("e_app")), _coverage(r.get("e_app_coverage", 1.0)), float(r.get("max_overlap_iou") or 0.0), tuple(r["risky"]) if r.get("risky") is not None else (), _overlaps(r.get("overlap_relations")), _mask(r.get("e_app_valid_mask")), posed, dressed))
    return out


def fold(tracker: Tracker, rows: pd.DataFrame) -> Iterator[tuple]:
    """Frames in order; a frame of the table without detections is a frame of misses."""
    for frame, part in rows.groupby("frame_idx", sort=True):
        for state in tracker.step(_frame(part)):
            yield (int(frame), *state)


LOG = "video string, epoch_id bigint, frame_idx bigint, local_track_id bigint, det_id bigint, d_motion double, d_pose double, d_app double, update_cost double, update_motion boolean, app_mode string, risky array<bigint>, frozen_by array<bigint>"


def track_log(detections: DataFrame, params: Params | None = None) -> DataFrame:
    """One row a matched pair of the same fold: its costs, what it was allowed to
    change and why not."""
    columns = [f.split()[0] for f in LOG.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        video, epoch, tracker, out = rows["video"].iloc[0], rows["epoch_id"].iloc[0], Tracker(params), []
        for frame, part in rows.groupby("frame_idx", sort=True):
            tracker.log = []
            tracker.step(_frame(part))
            out += [(video, epoch, int(frame), *entry) for entry in tracker.log]
        return pd.DataFrame(out, columns=columns)

    return detections.groupBy("video", "epoch_id").applyInPandas(run, LOG)


def track(detections: DataFrame, params: Params | None = None) -> DataFrame:
    """Track states of ``detections`` (``video, epoch_id, frame_idx, det_id,
    center_x, center_y`` and, where there, keypoints, vectors and overlaps: either
    ``overlap_relations``, structs of ``det_idx, iou, center_dist_norm``, or the
    detections that are ``risky`` whatever the tracks)."""
    columns = [f.split()[0] for f in STATES.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        video, epoch = rows["video"].iloc[0], rows["epoch_id"].iloc[0]
        return pd.DataFrame([(video, epoch, *s) for s in fold(Tracker(params), rows)], columns=columns)

    return detections.groupBy("video", "epoch_id").applyInPandas(run, STATES)
