"""Keyframe selection: protected events, bounded gaps, importance with novelty, duplicates; and greedy suppression.

A selection works on one video's candidates. Suppression cuts a long video wherever nothing can reach across.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.sequences import kept_captions, suppressed, typed

SLACK = 1e-12
#: Weights of importance and novelty, and what makes two candidates duplicates.
IMPORTANCE_SHARE, NOVELTY_SHARE, SAME_COSINE, SAME_SECONDS, EXACT_LIMIT = 0.65, 0.35, 0.92, 12.0, 18
#: Candidates whose scores are brought up to date at once, and vectors that are multiplied at once.
REFRESHED, VECTORS = 256, 1024


@dataclass
class Candidate:
    id: str
    ts: float
    frame: int
    importance: float = 0.0
    group: str | None = None
    unit: np.ndarray | None = None


@dataclass
class Event:
    id: str
    candidates: set[str]
    priority: float = 0.0


@dataclass
class Selection:
    chosen: list[Candidate] = field(default_factory=list)
    status: str = "satisfied"
    reasons: list[str] = field(default_factory=list)


def gaps_of(times: Sequence[float], duration: float) -> list[float]:
    """Gaps from 0 over the distinct times to the duration."""
    marks = [0.0, *sorted(set(times)), duration]
    return [b - a for a, b in zip(marks, marks[1:], strict=False)]


class Selector:
    """Chooses keyframes of one video.

    Protected events come first, each needing one of its candidates; then no gap may exceed ``max_gap``; then the target
    number is filled by importance and novelty. ``hard_max`` bounds the number. With ``dedupe`` duplicates of a filled
    selection are removed before gaps are repaired.
    """

    def __init__(self, candidates: list[Candidate], events: list[Event], duration: float, max_gap: float = 2.0, density: float | None = None, hard_max: int | None = None, dedupe: bool = False):
        self.pool = sorted(candidates, key=lambda c: (c.ts, c.frame, c.id))
        known = {c.id for c in self.pool}
        self.events = [Event(e.id, e.candidates & known, e.priority) for e in events]
        self.covers = {c.id: [e for e in self.events if c.id in e.candidates] for c in self.pool}
        self.duration, self.max_gap, self.dedupe = duration, max_gap, dedupe
        self.most = hard_max if hard_max is not None else len(self.pool)
        self.target = min(self.most, math.ceil(duration * density)) if density else 0

    def missing(self, chosen: list[Candidate]) -> list[Event]:
        have = {c.id for c in chosen}
        return [e for e in self.events if not e.candidates & have]

    def wide(self, chosen: list[Candidate]) -> bool:
        return max(gaps_of([c.ts for c in chosen], self.duration)) > self.max_gap + SLACK

    def holds(self, chosen: list[Candidate]) -> bool:
        return not self.missing(chosen) and not self.wide(chosen)

    def cover(self, chosen: list[Candidate]) -> bool:
        """Add candidates until all events that can be covered are; False if the bound stopped it."""
        while open_events := {e.id: e for e in self.missing(chosen) if e.candidates}:
            if len(chosen) >= self.most:
                return False

            def worth(c: Candidate):
                new = [e for e in self.covers[c.id] if e.id in open_events]
                return (-sum(e.priority + 1 for e in new), -len(new), max(gaps_of([x.ts for x in chosen] + [c.ts], self.duration)), -c.importance, c.ts, c.frame, c.id)

            chosen.append(min((c for c in self.pool if any(e.id in open_events for e in self.covers[c.id])), key=worth))
        return True

    def repair(self, chosen: list[Candidate]) -> bool:
        """Bridge wide gaps with the farthest reachable candidates; False if the bound stopped it."""
        best: dict[float, Candidate] = {}
        for c in self.pool:
            if c.ts not in best or (-c.importance, c.frame, c.id) < (-best[c.ts].importance, best[c.ts].frame, best[c.ts].id):
                best[c.ts] = c
        times = sorted(best)
        for low, high in itertools.pairwise([0.0, *sorted({c.ts for c in chosen}), self.duration]):
            at = low
            while high - at > self.max_gap + SLACK:
                k = bisect_right(times, at + self.max_gap + SLACK) - 1
                # nothing in reach: step to the next candidate, so that the rest of the gap is still bridged
                if k < 0 or times[k] <= at:
                    k += 1
                if k >= len(times) or times[k] >= high:
                    break
                if len(chosen) >= self.most:
                    return False
                chosen.append(best[times[k]])
                at = times[k]
        return True

    def fill(self, chosen: list[Candidate]) -> None:
        """Add by importance and novelty up to the target.

        Novelty only falls as more is chosen, so scores known from before are bounds from above: the best of them are brought
        up to date, ``REFRESHED`` at once and against what was chosen since, until the first is.
        """
        if len(chosen) >= self.target:
            return
        pool, n = self.pool, len(self.pool)
        free = np.ones(n, bool)
        same_id: dict[str, list[int]] = {}
        group_of: dict[str, list[int]] = {}
        for i, c in enumerate(pool):
            same_id.setdefault(c.id, []).append(i)
            if c.group is not None:
                group_of.setdefault(c.group, []).append(i)
        sized = next((len(c.unit) for c in [*pool, *chosen] if c.unit is not None), 0)
        units = np.zeros((n, sized))
        plain = np.array([c.unit is None for c in pool], bool)
        for i, c in enumerate(pool):
            if c.unit is not None:
                units[i] = c.unit
        least = IMPORTANCE_SHARE * np.array([c.importance for c in pool], float)
        # the largest cosine so far, how many vectors it is known for, and the scores as known
        most, seen = np.full(n, -np.inf), np.zeros(n, int)
        vectors, count = np.zeros((max(1, len(chosen) + self.target), sized)), 0
        bound = np.where(plain, least, least + NOVELTY_SHARE)

        def add(c: Candidate) -> None:
            nonlocal count
            for i in same_id.get(c.id, ()):
                free[i], bound[i] = False, -np.inf
            for i in group_of.pop(c.group, ()):
                plain[i], bound[i] = True, least[i] if free[i] else -np.inf
            if c.unit is not None:
                vectors[count], count = c.unit, count + 1

        for c in chosen:
            add(c)
        while len(chosen) < self.target:
            at = int(np.argmax(bound)) if n else 0  # the first of equals: the pool is in the order that settles ties
            if not n or bound[at] == -np.inf:
                return
            if not plain[at] and seen[at] < count:
                top = np.argpartition(-bound, REFRESHED)[:REFRESHED] if n > REFRESHED else np.arange(n)
                old = np.r_[at, top[free[top] & ~plain[top] & (seen[top] < count) & (top != at)]]
                for since in np.unique(seen[old]):  # those known for equally many go together
                    some = old[seen[old] == since]
                    for start in range(since, count, VECTORS):
                        most[some] = np.maximum(most[some], (units[some] @ vectors[start : min(count, start + VECTORS)].T).max(1))
                seen[old] = count
                bound[old] = least[old] + NOVELTY_SHARE * np.clip((1.0 - most[old]) / 2.0, 0.0, 1.0)
                continue
            chosen.append(pool[at])
            add(pool[at])

    def alike(self, chosen: list[Candidate]) -> list[int]:
        """The number of each candidate's cluster of duplicates: same group, or alike within ``SAME_SECONDS``."""
        root = list(range(len(chosen)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        first: dict[str, int] = {}
        for i, c in enumerate(chosen):
            if c.group is not None:
                root[find(i)] = find(first.setdefault(c.group, i))
        order = sorted((i for i, c in enumerate(chosen) if c.unit is not None), key=lambda i: chosen[i].ts)
        if order:
            units, times = np.stack([chosen[i].unit for i in order]), np.array([chosen[i].ts for i in order])
            start = 0
            while start < len(order):  # a stretch of rows meets those up to SAME_SECONDS later
                stop = min(len(order), start + VECTORS)
                ends = np.array([bisect_right(times, SAME_SECONDS, lo=k, key=lambda t, k=k: t - times[k]) for k in range(start, stop)])
                for other in range(start, int(ends.max()), VECTORS):
                    later = np.arange(other, min(len(order), other + VECTORS))
                    near = (units[start:stop] @ units[other : other + VECTORS].T >= SAME_COSINE) & (later > np.arange(start, stop)[:, None]) & (later < ends[:, None])
                    for k, m in zip(*np.nonzero(near), strict=True):
                        root[find(order[start + k])] = find(order[other + m])
                start = stop
        return [find(i) for i in range(len(chosen))]

    def without_duplicates(self, chosen: list[Candidate]) -> list[Candidate]:
        """The best of each cluster of duplicates, and one more for every event that only its cluster covers."""
        clusters: dict[int, list[Candidate]] = {}
        for root, c in zip(self.alike(chosen), chosen, strict=True):
            clusters.setdefault(root, []).append(c)
        ids = {c.id for c in chosen}
        held = [len(e.candidates & ids) for e in self.events]
        out: list[Candidate] = []
        for members in clusters.values():
            middle = float(np.median([c.ts for c in members]))
            order = sorted(members, key=lambda c: (-len(self.covers[c.id]), -c.importance, abs(c.ts - middle), c.ts, c.frame, c.id))
            keep, mine = [order[0]], {c.id for c in members}
            for e, n in zip(self.events, held, strict=True):
                if n == len(e.candidates & mine) and not any(c.id in e.candidates for c in keep):
                    keep += [c for c in order if c.id in e.candidates][:1]
            out += keep
        return out

    def exact(self) -> list[Candidate] | None:
        """The smallest subset within the bound that meets all constraints, for at most 18 candidates."""
        if len(self.pool) > EXACT_LIMIT:
            return None
        for n in range(self.most + 1):
            found = [list(s) for s in itertools.combinations(self.pool, n) if self.holds(list(s))]
            if found:
                return min(found, key=lambda s: (-sum(c.importance for c in s), [c.ts for c in s], [c.id for c in s]))
        return None

    def run(self) -> Selection:
        chosen: list[Candidate] = []
        free = self.cover(chosen)
        if self.dedupe:
            self.fill(chosen)
            chosen = self.without_duplicates(chosen)
        free = self.repair(chosen) and free
        if not free and not self.holds(chosen) and (better := self.exact()) is not None:
            chosen = better
        if not self.dedupe and self.holds(chosen):
            self.fill(chosen)
        reasons = [r for r, bad in (("events_without_candidate", any(not e.candidates for e in self.events)), ("events_uncovered", bool(self.missing(chosen))), ("gap_over_limit", self.wide(chosen)), ("below_target", len(chosen) < self.target), ("hard_max_reached", not free and not self.holds(chosen))) if bad]
        return Selection(sorted(chosen, key=lambda c: (c.ts, c.frame, c.id)), "satisfied" if self.holds(chosen) else "partial", reasons)


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    v = np.asarray(v, float)
    top = np.abs(v).max() if v.size else 0.0
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.linalg.norm(v)


def select_keyframes(candidates: DataFrame, max_gap: float = 2.0, density: float | None = None, hard_max: int | None = None, dedupe: bool = False) -> DataFrame:
    """(video_id, candidate_id, ts, position, status) of the chosen candidates of each video.

    candidates: (video_id, candidate_id, ts, frame, importance, duplicate_group, embedding, event_ids array<string>,
    duration). A video's candidates are few (they are sampled by shot) and are chosen in one task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = [Candidate(r.candidate_id, float(r.ts), int(r.frame), float(r.importance), None if pd.isna(r.duplicate_group) else r.duplicate_group, _unit(r.embedding)) for r in pdf.itertuples()]
        members: dict[str, set[str]] = {}
        for r in pdf.itertuples():
            for e in r.event_ids if r.event_ids is not None else ():
                members.setdefault(e, set()).add(r.candidate_id)
        got = Selector(pool, [Event(e, ids) for e, ids in sorted(members.items())], float(pdf["duration"].max()), max_gap, density, hard_max, dedupe).run()
        return typed({"video_id": [pdf["video_id"].iloc[0]] * len(got.chosen), "candidate_id": [c.id for c in got.chosen], "ts": [c.ts for c in got.chosen], "position": range(1, len(got.chosen) + 1), "status": [got.status] * len(got.chosen)}, video_id="object", candidate_id="object", ts="float64", position="int32", status="object")

    return candidates.groupBy("video_id").applyInPandas(one, "video_id string, candidate_id string, ts double, position int, status string")


def blocks(rows: DataFrame, reach: float, keys: tuple[str, ...] = ("video_id",), size: int = 256) -> DataFrame:
    """Append block: cuts each video where two neighbours in time are more than ``reach`` apart, ``size`` such stretches a block.

    Suppression within ``reach`` never crosses a cut, so blocks are independent and their number bounds the Python calls.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "frame_id")
    rows = rows.withColumn("_new", F.when(F.col("ts") - F.lag("ts").over(w) <= reach, 0).otherwise(1))
    return rows.withColumn("block", F.floor(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) / size)).drop("_new")


def strongest(rows: DataFrame, radius: float = 1.0) -> DataFrame:
    """Rows of (video_id, frame_id, ts, strength) left by greedy suppression: strongest first, none within the radius of a kept one."""
    schema = "video_id string, frame_id long, ts double, strength double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "frame_id"])
        return pdf.iloc[suppressed(pdf["strength"].tolist(), pdf["ts"].tolist(), radius)][["video_id", "frame_id", "ts", "strength"]]

    flat = rows.select(F.col("video_id").cast("string"), F.col("frame_id").cast("long"), F.col("ts").cast("double"), F.col("strength").cast("double"))
    return blocks(flat, radius).groupBy("video_id", "block").applyInPandas(one, schema)


def distinct_frames(rows: DataFrame, window: float = 12.0, bits: int = 6) -> DataFrame:
    """Rows of (video_id, frame_id, ts, hash) in order of time, less those whose hash differs in at most ``bits`` bits from a
    kept row at most ``window`` seconds before. A dropped row drops no others."""
    schema = "video_id string, frame_id long, ts double, hash long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "frame_id"])
        kept: list[tuple[float, int]] = []
        at = []
        for i, (t, h) in enumerate(zip(pdf["ts"], pdf["hash"], strict=True)):
            kept = [k for k in kept if t - k[0] <= window]
            if not any(((int(h) ^ k) & (2**64 - 1)).bit_count() <= bits for _, k in kept):
                kept.append((t, int(h)))
                at.append(i)
        return pdf.iloc[at][["video_id", "frame_id", "ts", "hash"]]

    flat = rows.select(F.col("video_id").cast("string"), F.col("frame_id").cast("long"), F.col("ts").cast("double"), F.col("hash").cast("long"))
    return blocks(flat, window).groupBy("video_id", "block").applyInPandas(one, schema)


def vector_repeats(rows: DataFrame, window: float, least: float) -> DataFrame:
    """(video_id, frame_id, repeat_of, similarity) of rows (video_id, frame_id, ts, embedding of unit length): each row, in order of
    time, with the most similar kept row at most ``window`` seconds before it, if that is at least ``least`` alike; such a row isn't
    kept (the earlier of equals). Others are kept, and have null there. Runs without a pause over the window go to tasks of their own."""
    schema = "video_id string, frame_id long, repeat_of long, similarity double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "frame_id"])
        kept: list[tuple[float, int, np.ndarray]] = []
        told: list[tuple[int | None, float | None]] = []
        for t, f, e in zip(pdf["ts"], pdf["frame_id"], pdf["embedding"], strict=True):
            kept = [k for k in kept if t - k[0] <= window]
            e = np.asarray(e, float)
            alike = [float(np.dot(k[2], e)) for k in kept]
            best = int(np.argmax(alike)) if alike else -1
            if best >= 0 and alike[best] >= least:
                told.append((kept[best][1], round(alike[best], 6)))
            else:
                told.append((None, None))
                kept.append((t, int(f), e))
        return pd.DataFrame({"video_id": pdf["video_id"].to_numpy(), "frame_id": pdf["frame_id"].to_numpy(), "repeat_of": pd.array([r for r, _ in told], dtype="Int64"), "similarity": pd.Series([s for _, s in told], dtype="float64")})

    flat = rows.select(F.col("video_id").cast("string"), F.col("frame_id").cast("long"), F.col("ts").cast("double"), "embedding")
    out = blocks(flat, window).groupBy("video_id", "block").applyInPandas(one, schema)
    return out.withColumn("similarity", F.when(F.col("repeat_of").isNotNull(), F.col("similarity")))


def captions_without_near_repeats(rows: DataFrame, ratio: float = 0.92) -> DataFrame:
    """(video_id, shot_id, caption, kept, seen): captions of a shot in order of time, less those similar to any kept one before."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        video, shot = pdf["video_id"].iloc[0], pdf["shot_id"].iloc[0]
        texts = pdf.dropna(subset=["caption"]).sort_values(["ts", "frame_id"])["caption"].tolist()
        kept = kept_captions([" ".join(t.casefold().split()) for t in texts], ratio)
        return pd.DataFrame([(video, shot, " ".join(texts[i] for i in kept), len(kept), len(texts))], columns=["video_id", "shot_id", "caption", "kept", "seen"])

    flat = rows.select(F.col("video_id").cast("string"), F.col("shot_id").cast("string"), "frame_id", "ts", "caption")
    return flat.groupBy("video_id", "shot_id").applyInPandas(one, "video_id string, shot_id string, caption string, kept long, seen long")
