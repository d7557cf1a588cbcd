"""End-to-end search: known items, diverse items, ordered events and evidence for questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import fusion as U
from lumenframe.operators import lexical as L
from lumenframe.operators import planned as P
from lumenframe.operators import rerank as K
from lumenframe.operators import sequences as S
from lumenframe.operators import vectors as Q
from lumenframe.plans import parse
from lumenframe.plans.deadlines import DEADLINE, Outcome
from lumenframe.sources import textindex
from lumenframe.sources.files import settled

POOL, CLIPS, MOST, CAPS = 200, 50, 200, {"qa": 100, "trake": 100}
DEFAULTS = {"kis": 20, "avs": 20, "qa": 20, "trake": 100}


@dataclass
class Engine:
    """Searches frames (video_id, frame_id, frame_index, ts, shot_id, caption) and, if given, vectors (row = frame_id, embedding).

    ``index`` is the path of a stored text index of the same frames (textindex.publish); without it captions are stemmed at each search.
    Each retrieval cuts its list to a pool on the executors before anything is fused.
    """

    frames: DataFrame
    vectors: DataFrame | None = None
    pool: int = POOL
    index: str | None = None

    def terms(self, query: str) -> list[str]:
        """Distinct content stems of a query, all stems where none is left."""
        words = self.frames.sparkSession.range(1).select(X.stems_of(F.lit(query), content=True).alias("c"), X.stems_of(F.lit(query)).alias("a")).first()
        return list(dict.fromkeys(words.c or words.a))

    def lexical(self, query: str) -> DataFrame:
        """(modality, rank, frame_id, video_id, ts, shot_id, score) of the best matching captions."""
        terms = self.terms(query)
        if not terms:
            return self._listed(self.frames.select("frame_id").limit(0).withColumn("score", F.lit(0.0)), "caption")
        found = L.search(self.frames, terms) if self.index is None else textindex.search(self.frames.sparkSession, self.index, terms)
        hits = found.orderBy(F.desc("bm25"), F.desc("frame_id")).limit(self.pool)
        scored = L.with_quality(hits, self.frames, terms)
        return self._listed(scored.select("frame_id", F.col("quality").alias("score")), "caption")

    def event_hits(self, texts: list[str]) -> DataFrame:
        """(event, frame_id, score, rank) of all events of a query in one job: their stems' postings are read once."""
        spark = self.frames.sparkSession
        plan = spark.createDataFrame([(i, "caption", P.ORIGINAL, 1.0, True, t) for i, t in enumerate(texts)], "query_id int, modality string, variant string, weight double, in_scope boolean, text string")
        told, _ = P.branches(plan, ["caption"])
        terms = sorted({s for r in told.select("stems").collect() for s in r.stems})  # the words of one query
        if self.index is None:
            postings, sizes = L.sought(self.frames, terms or [""]), L.stats(self.frames)
        else:
            postings, sizes = textindex.postings(spark, self.index, terms), textindex.sizes(spark, self.index)
        hits = P.text_hits(told, postings, sizes, self.frames.select("frame_id", F.col("caption").alias("text")), self.pool)
        return hits.select(F.col("query_id").alias("event"), "frame_id", "score", "rank")

    def visual(self, vector: list[float]) -> DataFrame:
        """The same columns for the nearest vectors."""
        one = self.frames.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query array<double>")
        found = Q.search(self.vectors, one, self.pool)
        return self._listed(found.select(F.col("row").alias("frame_id"), "score"), "visual")

    def _listed(self, hits: DataFrame, modality: str) -> DataFrame:
        rows = L.top(hits, self.pool, F.desc("score"), "frame_id")
        return rows.join(self.frames.select("frame_id", "video_id", "ts", "shot_id"), "frame_id").select(F.lit(modality).alias("modality"), "rank", "frame_id", "video_id", "ts", "shot_id", "score")

    def fused(self, query: str, vector: list[float] | None) -> DataFrame:
        """Fused and reranked candidates (frame_id, video_id, shot_id, ts, score)."""
        hits = self.lexical(query)
        if vector is not None and self.vectors is not None:
            hits = hits.unionByName(self.visual(vector))
        best = lambda m: F.max(F.when(F.col("modality") == m, F.col("score")))
        # a frame is in each list once, so one aggregation fuses ranks and scores
        part = U.weight_of(F.col("modality"), U.RRF_WEIGHTS) / (U.RRF_K + F.col("rank"))
        rows = hits.groupBy("frame_id").agg(best("visual").alias("_v"), best("caption").alias("_c"), F.round(F.sum(part), 10).alias("rrf"), *[F.first(c).alias(c) for c in ("video_id", "shot_id", "ts")])
        score = U.hybrid_score(F.coalesce("_v", F.lit(-1.0)), {"caption": (F.coalesce("_c", F.lit(0.0)), 0.2)}, F.lit(1.0), 0.55, 0.05)
        return rows.select("frame_id", "video_id", "shot_id", "ts", "rrf", F.round(score, 6).alias("score"))

    def search(self, query: str, task: str = "kis", top_k: int | None = None, vector: list[float] | None = None, constraints: dict[str, list[str]] | None = None) -> DataFrame:
        """Ranked answers. kis: frames; avs: one frame a shot, best clips first; qa: evidence rows; trake: frame sequences."""
        if task not in DEFAULTS:
            raise ValueError(f"unknown task: {task}")
        k = max(1, min(top_k or DEFAULTS[task], CAPS.get(task, MOST)))
        if task == "trake":
            return self.sequences(query, k)
        rows = self.fused(query, vector)
        if task == "avs":
            best = U.clips(rows.select("video_id", "shot_id", "frame_id", "ts", F.col("rrf").alias("score")), CLIPS).select("video_id", "shot_id", F.col("score").alias("clip"))
            rows = U.first_in(rows.join(best, ["video_id", "shot_id"]), ["video_id", "shot_id"], F.desc("score"), "ts", "frame_id").drop("clip")
        if task == "qa" and constraints:
            texts = rows.join(self.frames.select("frame_id", "caption"), "frame_id")
            rows = K.constrained(texts.withColumn("constraint", K.constraint_signal(constraints, {c: [F.col("caption")] for c in constraints})).drop("caption")).drop("constraint")
        ranked = L.top(rows, k, F.desc("score"), F.desc("rrf"), "video_id", "ts", "frame_id")
        if task == "qa":
            return ranked.select(F.format_string("E%03d", "rank").alias("evidence_id"), "rank", "video_id", "shot_id", "frame_id", "ts", "score")
        return ranked.select("rank", "video_id", "shot_id", "frame_id", "ts", "score")

    def sequences(self, query: str, k: int) -> DataFrame:
        """(video_id, path_id, frames, score, rank): sequences of frames, one for each event of the query, in videos that
        have all events."""
        plan = parse.parse_sequence(query)
        if not plan.events:
            raise ValueError("the query has no event")
        ranked = self._event_ranks(plan)
        return self._aligned(ranked, self._supporting(ranked, len(plan.events)), len(plan.events), k)

    def _event_ranks(self, plan: parse.Sequence) -> DataFrame:
        rows = self.event_hits([e.text for e in plan.events]).join(self.frames.select("frame_id", "video_id", "shot_id"), "frame_id")
        if not plan.complete:  # a slot that says nothing is supported by nothing, so no video has all events
            rows = rows.where("false")
        # read twice, by the gate and by the alignment
        return settled(S.diversified(S.normalized_rank(rows, F.desc("score"), "frame_id")))

    def _supporting(self, ranked: DataFrame, events: int) -> DataFrame:
        return S.gated(ranked.withColumn("quality", F.col("normalized")), events, least=0.05, complete=True).select("video_id", F.col("total").alias("video_score"))

    def _aligned(self, ranked: DataFrame, videos: DataFrame, events: int, k: int) -> DataFrame:
        frames = self.frames.select("frame_id", F.col("frame_index").cast("long").alias("frame"))
        pool = ranked.join(F.broadcast(videos), "video_id").join(frames, "frame_id")  # 30 videos
        paths = S.kbest(pool.select("video_id", "event", "frame", F.col("normalized").alias("score"), "shot_id", "video_score"), events, k)
        return K.ranked_sequences(paths.select("video_id", F.col("rank").cast("string").alias("path_id"), "frames", "score"), events, k)

    def sequence_search(self, query: str, k: int = DEFAULTS["trake"], deadline: float = DEADLINE) -> Outcome:
        """sequences() in stages, each of which has ``deadline`` seconds, with how it ended: retrieval of all events, videos that
        support them all, alignment. Nothing is returned in place of what didn't end or isn't supported."""
        spark, out = self.frames.sparkSession, Outcome()
        plan = parse.parse_sequence(query)
        out.warnings += plan.warnings
        if not plan.events:
            out.status, out.stage = "invalid_query", "parse"
            return out
        ranked = out.run(spark, deadline, "retrieval", lambda: self._event_ranks(plan))
        if ranked is None:
            return out
        videos = out.run(spark, deadline, "gating", lambda: settled(self._supporting(ranked, len(plan.events))))
        if videos is None:
            return out
        if videos.isEmpty():
            out.status = "insufficient_support"
            out.warnings += ["no_video_supports_all_events", *([] if plan.complete else ["empty_event_marker"])]
            return out
        rows = out.run(spark, deadline, "alignment", lambda: settled(self._aligned(ranked, videos, len(plan.events), k)))
        if rows is not None:
            out.rows = rows
            if rows.isEmpty():
                out.status = "insufficient_support"
                out.warnings.append("no_ordered_sequence")
        return out
