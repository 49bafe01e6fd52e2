"""Detection metrics: temporal segments, boxes in frames, tubes.

Matching is greedy by falling score, and a truth can be used once. It only
looks at one video (or frame) of a class, so it runs as a grouped Arrow map on
(class, video), not on the class; curves over all of a class come from
operators.curves, which spread a class over buckets of its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import curves

TIOU_GRID = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Classes that are never evaluated.
UNSCORED = ("aerobic kick jump", "aerobic off axis jump", "aerobic butterfly jump", "aerobic balance turn", "basketball save", "basketball jump ball")


def segment_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len a, len b) half-open temporal IoU of rows [start, end]."""
    inter = np.clip(np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    union = (a[:, 1] - a[:, 0])[:, None] + (b[:, 1] - b[:, 0])[None] - inter
    return np.divide(inter, union, out=np.zeros_like(inter, dtype=float), where=union > 0)


def first_free(iou: np.ndarray, threshold: float, order: np.ndarray | None = None) -> np.ndarray:
    """Hits of detections (rows, by falling score): each takes the best overlapping truth that is still free.

    order: the truths of each row by falling overlap, where it is known already.
    """
    order = np.argsort(iou, axis=1, kind="stable")[:, ::-1] if order is None else order
    free = np.ones(iou.shape[1], dtype=bool)
    hit = np.zeros(len(iou), dtype=bool)
    for i in np.flatnonzero((iou >= threshold).any(axis=1)):
        for j in order[i]:
            if iou[i, j] < threshold:
                break
            if free[j]:
                free[j], hit[i] = False, True
                break
    return hit


def by_threshold(g: pd.DataFrame, thresholds: tuple[float, ...], hits: list[np.ndarray]) -> pd.DataFrame:
    """The detections g once for each threshold, with their hits."""
    n, k = len(g), len(thresholds)
    tiled = {c: np.tile(g[c].to_numpy(), k) for c in ("label", "video", "score")}
    return pd.DataFrame({**tiled, "ord": np.tile(np.arange(n), k), "threshold": np.repeat(thresholds, n), "hit": np.concatenate(hits) if hits else np.zeros(0, dtype=bool)})


def best_only(iou: np.ndarray, threshold: float) -> np.ndarray:
    """Hits where only the best truth of each detection counts, and only the first time."""
    free = np.ones(iou.shape[1], dtype=bool)
    hit = np.zeros(len(iou), dtype=bool)
    if iou.shape[1]:
        for i, j in enumerate(iou.argmax(axis=1)):
            if iou[i, j] >= threshold and free[j]:
                free[j], hit[i] = False, True
    return hit


def by_score(g: pd.DataFrame, ties: list[str]) -> pd.DataFrame:
    """Rows by falling score; of equal ones the smaller place first."""
    return g.sort_values(["score", *ties], ascending=[False] + [True] * len(ties), kind="stable")


def matched_segments(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...] = TIOU_GRID) -> DataFrame:
    """(label, video, score, ord, threshold, hit) of guesses (label, video, s, e, score); truth: (label, video, s, e)."""
    kinds = dict(guess.dtypes)

    def match(key, g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        g, t = by_score(g, ["s", "e"]), t.sort_values(["s", "e"])
        iou = segment_iou(g[["s", "e"]].to_numpy(float), t[["s", "e"]].to_numpy(float))
        order = np.argsort(iou, axis=1, kind="stable")[:, ::-1]
        return by_threshold(g, thresholds, [first_free(iou, th, order) for th in thresholds])

    cols = ["label", "video"]
    schema = f"label {kinds['label']}, video {kinds['video']}, score double, ord long, threshold double, hit boolean"
    g = guess.select("label", "video", F.col("s").cast("double"), F.col("e").cast("double"), F.col("score").cast("double"))
    return g.groupBy(*cols).cogroup(_fresh(truth.select("label", "video", F.col("s").cast("double"), F.col("e").cast("double"))).groupBy(*cols)).applyInPandas(match, schema)


def segment_average_precision(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...] = TIOU_GRID) -> DataFrame:
    """(label, threshold, ap) for each class with a truth."""
    m = matched_segments(truth, guess, thresholds)
    grid = _grid(truth.sparkSession, thresholds)
    totals = truth.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(grid))  # ten rows
    return curves.interpolated_average_precision(m, ["label", "threshold"], "score", "hit", totals, "n", ["video", "ord"])


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under ids of their own, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _grid(spark: SparkSession, thresholds) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")


def proposal_recall(truth: DataFrame, proposals: DataFrame, max_avg: float | None = 100.0, thresholds: tuple[float, ...] = TIOU_GRID) -> DataFrame:
    """(threshold, step, per_video, recall): recall of the best proposals at 100 growing budgets.

    truth: (video, s, e); proposals: (video, s, e, score). A video's budget is in
    proportion to its own number of proposals. Videos without proposals count with
    their truths; videos without truths aren't looked at.
    """
    videos = truth.select("video").distinct()
    own = proposals.join(videos, "video", "left_semi")
    n_videos, n_all = videos.count(), proposals.count()
    if not n_videos or not n_all:
        return truth.sparkSession.createDataFrame([], "threshold double, step int, per_video double, recall double")
    avg = max_avg or n_all / n_videos
    ratio = avg * n_videos / n_all
    sizes = own.groupBy("video").agg(F.count("*").alias("n"))
    kept = int(sizes.agg(F.sum(F.least(F.floor(F.col("n") * ratio), F.col("n")))).collect()[0][0] or 0)
    if not kept:
        return truth.sparkSession.createDataFrame([], "threshold double, step int, per_video double, recall double")
    steps = np.arange(1, 101) / 100.0 * (avg * n_videos / kept)

    def count(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = by_score(p, ["s", "e"])[: min(int(len(p) * ratio), len(p))]
        iou = segment_iou(t[["s", "e"]].to_numpy(float), p[["s", "e"]].to_numpy(float)) if len(p) else np.zeros((len(t), 1))
        upto = np.minimum((iou.shape[1] * steps).astype(int), iou.shape[1])
        top = np.maximum.accumulate(iou, axis=1) if iou.shape[1] else iou
        rows = []
        for th in thresholds:
            found = [int((top[:, k - 1] >= th).sum()) if k else 0 for k in upto]
            rows += [(th, i + 1, f, len(t)) for i, f in enumerate(found)]
        return pd.DataFrame(rows, columns=["threshold", "step", "found", "truths"])

    d = lambda x, *more: x.select("video", F.col("s").cast("double"), F.col("e").cast("double"), *more)
    per = _fresh(d(truth)).groupBy("video").cogroup(_fresh(d(own, F.col("score").cast("double"))).groupBy("video")).applyInPandas(count, "threshold double, step int, found long, truths long").where("truths > 0")
    out = per.groupBy("threshold", "step").agg((F.sum("found") / F.sum("truths")).alias("recall"))
    scale = avg * n_videos / kept * kept / n_videos / 100.0
    return out.select("threshold", "step", (F.col("step") * scale).alias("per_video"), "recall")


def proposal_summary(r: DataFrame) -> DataFrame:
    """AR@1, 5, 10 and 100 and the area under average recall, as a percentage of the largest budget."""
    avg = r.groupBy("step", "per_video").agg(F.avg("recall").alias("ar"))
    w = Window.orderBy("step")  # a hundred rows
    area = avg.withColumn("part", (F.col("ar") + F.lag("ar").over(w)) / 2 * (F.col("per_video") - F.lag("per_video").over(w)))
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("ar"))).alias(f"AR@{k}")
    return area.agg(at(1), at(5), at(10), at(100), (F.sum("part") / F.max("per_video") * 100).alias("auc"))


def matched_boxes(truth: DataFrame, guess: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, video, frame, score, ord, hit): only the best truth of a detection counts, and for one detection.

    Boxes are x1, y1, x2, y2.
    Both sides are dealt by frame once; ranks, the join and the groups follow that.
    """
    cols, xy = ["label", "video", "frame"], ["x1", "y1", "x2", "y2"]
    num = [F.col(c).cast("double").alias(c) for c in xy]
    frame = Window.partitionBy(*cols)
    g = guess.select(*cols, *num, F.col("score").cast("double").alias("score")).withColumn("ord", F.row_number().over(frame.orderBy(F.desc("score"), *xy)).cast("long") - 1)
    t = _fresh(truth).select(*cols, *[c.alias(f"t{n}") for c, n in zip(num, xy)])
    t = t.withColumn("j", F.row_number().over(frame.orderBy(*[f"t{c}" for c in xy])))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(hi, f"t{hi}") - F.greatest(lo, f"t{lo}"))
    inter = side("x1", "x2") * side("y1", "y2")
    area = lambda t: (F.col(f"{t}x2") - F.col(f"{t}x1")) * (F.col(f"{t}y2") - F.col(f"{t}y1"))
    union = area("") + area("t") - inter
    pairs = g.join(t, cols).select(*cols, "ord", "j", F.when(union > 0, inter / union).otherwise(0.0).alias("iou"))
    best = pairs.groupBy(*cols, "ord").agg(F.max(F.struct("iou", (-F.col("j")).alias("place"))).alias("b")).select(*cols, "ord", F.col("b.iou").alias("iou"), F.col("b.place").alias("j"))
    won = best.where(F.col("iou") >= threshold).groupBy(*cols, "j").agg(F.min("ord").alias("ord")).select(*cols, "ord", F.lit(True).alias("hit"))
    return g.select(*cols, "score", "ord").join(won, [*cols, "ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def frame_average_precision(truth: DataFrame, guess: DataFrame, threshold: float = 0.5, unscored: tuple = UNSCORED) -> DataFrame:
    """(label, ap) over all frames; classes without a truth are left out."""
    t, g = truth.where(~F.col("label").cast("string").isin(*unscored)), guess.where(~F.col("label").cast("string").isin(*unscored))
    totals = t.groupBy("label").agg(F.count("*").alias("n"))
    m = matched_boxes(t, g, threshold)
    return curves.interpolated_average_precision(m, ["label"], "score", "hit", totals, "n", ["video", "frame", "ord"])


def evaluate_actions(truth: DataFrame, guess: DataFrame, labels: DataFrame, exclude: DataFrame | None = None, ignore_empty: bool = True) -> DataFrame:
    """(group, map): overall and by ranges of the class number (to 14, 15 to 63, from 64) over classes with detections.

    labels: (label, name), the classes that count; exclude: (video, frame) pairs
    that don't. With ignore_empty, frames without a truth aren't looked at.
    """
    keys = ["video", "frame"]
    t, g = (x.join(F.broadcast(labels.select("label")), "label", "left_semi") for x in (truth, guess))
    totals = t.groupBy("label").agg(F.count("*").alias("n"))  # before exclusion, as truths are counted once
    if exclude is not None:
        t, g = t.join(exclude, keys, "left_anti"), g.join(exclude, keys, "left_anti")
    if ignore_empty:
        g = g.join(t.select(*keys).distinct(), keys, "left_semi")
    seen = g.select("label").distinct()
    ap = curves.interpolated_average_precision(matched_boxes(t, g), ["label"], "score", "hit", seen.join(totals, "label", "left").withColumn("n", F.coalesce("n", F.lit(0))), "n", ["video", "frame", "ord"])
    part = F.when(F.col("label") <= 14, "person_movement").when(F.col("label") < 64, "object_manipulation").otherwise("person_interaction")
    return ap.withColumn("group", F.explode(F.array(F.lit("overall"), part))).groupBy("group").agg(F.avg("ap").alias("map"))


# ---- tubes --------------------------------------------------------------------------------------------


def tube_iou(a: np.ndarray, b: np.ndarray, spatial: bool = True, temporal: bool = True) -> float:
    """Rows of frame, x1, y1, x2, y2 without gaps. The shared part of the frames times the mean box IoU there."""
    lo, hi = max(a[0, 0], b[0, 0]), min(a[-1, 0], b[-1, 0])
    if hi < lo:
        return 0.0
    whole = max(a[-1, 0], b[-1, 0]) - min(a[0, 0], b[0, 0])
    t = (hi - lo) / whole if whole else 1.0
    if not spatial:
        return float(t)
    x, y = (r[(r[:, 0] >= lo) & (r[:, 0] <= hi)][:, 1:5] for r in (a, b))
    s = float(paired_iou(x, y).mean())
    return s * float(t) if temporal else s


def paired_iou(a: np.ndarray, b: np.ndarray, plus: float = 0.0) -> np.ndarray:
    """IoU of boxes (.., 4) that stand at the same place of two arrays, broadcast; plus 1 if right and bottom pixels belong to a box."""
    size = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]) + plus, 0).prod(axis=-1)
    whole = (a[..., 2:] - a[..., :2] + plus).prod(axis=-1) + (b[..., 2:] - b[..., :2] + plus).prod(axis=-1) - size
    return np.divide(size, whole, out=np.zeros(np.shape(whole)), where=whole > 0)


def suppress(rows: np.ndarray, threshold: float = 0.3, top: int | None = None) -> np.ndarray:
    """Greedy suppression of tubelets (4 K numbers and a score), pixels included: a suppressed score is cut by the overlap.

    All overlaps, summed over the K boxes, are one matrix; heads come by falling
    score, and what a head overlaps by more than the threshold is settled.
    """
    boxes = rows[:, :-1].reshape(len(rows), (rows.shape[1] - 1) // 4, 4)
    total = paired_iou(boxes[:, None], boxes[None], 1.0).sum(axis=2)
    weight, waiting = np.ones(len(rows)), np.ones(len(rows), dtype=bool)
    for head in np.argsort(rows[:, -1], kind="stable")[::-1]:
        if waiting[head]:
            waiting[head] = False
            hit = waiting & (total[head] > threshold * boxes.shape[1])
            weight[hit] = 1 - total[head, hit]
            waiting &= ~hit
    score = rows[:, -1] * weight
    order = np.argsort(score, kind="stable")[::-1][:top]
    return np.column_stack([rows[order, :-1], score[order]])


class Chain:
    """A growing tube: first frames, boxes (K, 4) and scores of its tubelets."""

    def __init__(self, frame: int, boxes: np.ndarray, score: float) -> None:
        self.frames, self.boxes, self.scores = [frame], [boxes], [score]

    def add(self, frame: int, boxes: np.ndarray, score: float) -> None:
        self.frames.append(frame)
        self.boxes.append(boxes)
        self.scores.append(score)

    @property
    def score(self) -> float:
        return float(np.mean(self.scores))

    def fit(self, frame: int, boxes: np.ndarray) -> np.ndarray:
        """Mean overlap of tubelets (n, K, 4) that begin at a frame with the chain's last one, over the frames that both cover; without such frames, of first and last box."""
        last, shift = self.boxes[-1], frame - self.frames[-1]
        if shift < len(last):
            return paired_iou(boxes[:, : len(last) - shift], last[None, shift:]).mean(axis=1)
        return paired_iou(boxes[:, 0], last[None, -1])

    def tube(self) -> np.ndarray:
        """Rows of frame, box and score, each the mean of the tubelets that cover the frame."""
        k = len(self.boxes[0])
        at = (np.array(self.frames)[:, None] + np.arange(k)).ravel() - self.frames[0]
        values = np.column_stack([np.concatenate(self.boxes), np.repeat(self.scores, k)])
        total, count = np.zeros((at[-1] + 1, 5)), np.bincount(at, minlength=at[-1] + 1)
        np.add.at(total, at, values)
        return np.column_stack([self.frames[0] + np.arange(len(total)), total / np.maximum(count, 1)[:, None]])


def linked(frames: dict[int, np.ndarray], last: int, k: int = 1, least: int = 15) -> list[tuple[float, np.ndarray]]:
    """Tubes of one class of one video: (score, rows of frame, box, score), from tubelets by frame 1..last.

    Chains choose in order of their mean score: the best-scored tubelet with an
    overlap of at least a half that no other has taken. What nobody takes begins a
    chain; a chain that has found nothing for k frames is done.
    """
    live: list[Chain] = []
    every: list[Chain] = []
    for f in range(1, last + 2 - k):
        new = suppress(frames.get(f, np.zeros((0, 4 * k + 1))), 0.6, 10)
        boxes, scores = new[:, :-1].reshape(len(new), k, 4), new[:, -1]
        free = np.ones(len(new), dtype=bool)
        for chain in sorted(live, key=lambda c: -c.score):
            can = np.flatnonzero(free & (chain.fit(f, boxes) >= 0.5)) if len(new) else []
            if len(can):
                best = can[scores[can].argmax()]
                free[best] = False
                chain.add(f, boxes[best], float(scores[best]))
        born = [Chain(f, boxes[i], float(scores[i])) for i in np.flatnonzero(free)]
        every += born
        live = [c for c in live if f - c.frames[-1] < k] + born
    tubes = [(c.score, c.tube()) for c in every]
    return [(s, t) for s, t in tubes if s >= 0.005 and len(t) >= least]


TUBE = "array<struct<frame: bigint, x1: double, y1: double, x2: double, y2: double>>"


def link_tubes(detections: DataFrame, videos: DataFrame, k: int = 1, least: int = 15) -> DataFrame:
    """(label, video, score, tube) from detections (label, video, frame, box array of 4 k numbers, score); videos: (video, n_frames)."""
    kinds = dict(detections.dtypes)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        by = {int(f): np.column_stack([np.vstack(x["box"].to_numpy()), x["score"].to_numpy(float)]) for f, x in d.groupby("frame")}
        rows = [(key[0], key[1], s, [dict(zip(("frame", "x1", "y1", "x2", "y2"), [int(r[0]), *map(float, r[1:5])])) for r in t]) for s, t in linked(by, int(d["n_frames"].iloc[0]), k, least)]
        return pd.DataFrame(rows, columns=["label", "video", "score", "tube"])

    j = detections.join(videos.select("video", "n_frames"), "video").select("label", "video", "frame", F.col("box").cast("array<double>").alias("box"), F.col("score").cast("double"), "n_frames")
    return j.groupBy("label", "video").applyInPandas(run, f"label {kinds['label']}, video {kinds['video']}, score double, tube {TUBE}")


def _rows(tube) -> np.ndarray:
    return np.array([[r["frame"], r["x1"], r["y1"], r["x2"], r["y2"]] for r in tube], dtype=float)


def matched_tubes(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(label, video, score, ord, threshold, hit): only the best truth of a tube counts. Columns: label, video, (score,) tube."""
    m = _tube_hits(truth, guess, thresholds).select("label", "video", "score", "ord", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "at")
    return m.withColumn("hit", F.array_contains("at", F.col("threshold"))).drop("at")


def _tubes(t: pa.ListArray) -> list[np.ndarray]:
    """Rows of frame and box of each tube."""
    v, off = t.flatten(), t.offsets.to_numpy() - t.offsets[0].as_py()
    rows = np.column_stack([v.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("frame", "x1", "y1", "x2", "y2")])
    return np.split(rows, off[1:-1]) if len(t) else []


def _tube_hits(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(label, video, score, ord, at): the thresholds at which a guess is the first to take its best truth, a row for each guess.

    A (class, video) is one row on either side. A guess hits above the best
    overlap of those before it with the same truth, up to its own.
    """
    kinds = dict(guess.dtypes)
    grid = np.array(thresholds, dtype=float)
    names = ["label", "video", "score", "ord", "at"]
    schema = f"label {kinds['label']}, video {kinds['video']}, score double, ord long, at array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                g, t = (batch.column(c)[n].values for c in ("g", "t"))
                score = g.field("score").to_numpy(zero_copy_only=False)
                own, other = _ends(g.field("tube")), _ends(t.field("tube")) if t is not None and len(t) else None
                order = np.lexsort((own[1], own[0], -score))
                hits = [[] for _ in order]
                if other is not None:
                    theirs = np.lexsort((other[1], other[0]))
                    mine, truths = _tubes(g.field("tube")), _tubes(t.field("tube"))
                    taken = np.full(len(theirs), -np.inf)
                    starts, stops = other[0][theirs], (other[0] + other[1])[theirs] - 1
                    for k, i in enumerate(order):
                        # one shared frame of several is no overlap, as tubes are told by first and last frame
                        lo, hi = np.maximum(starts, own[0][i]), np.minimum(stops, own[0][i] + own[1][i] - 1)
                        meet = (hi > lo) | (hi == lo) & (starts == stops) & (own[1][i] == 1)
                        iou = np.zeros(len(theirs))
                        for m in np.flatnonzero(meet):
                            iou[m] = tube_iou(truths[theirs[m]], mine[i])
                        j = int(np.argmax(iou))
                        hits[k] = grid[(grid <= iou[j]) & (grid > taken[j])].tolist()
                        taken[j] = max(taken[j], iou[j])
                one = batch.slice(n, 1)
                cols = [pa.array([one.column(c)[0].as_py()] * len(order), one.schema.field(c).type) for c in ("label", "video")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score[order]), pa.array(np.arange(len(order))), pa.array(hits, pa.list_(pa.float64()))], names=names)

    g = guess.groupBy("label", "video").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), "tube")).alias("g"))
    t = _fresh(truth.groupBy("label", "video").agg(F.collect_list(F.struct("tube")).alias("t")))
    both = g.join(t, (g["label"].eqNullSafe(t["label"])) & (g["video"].eqNullSafe(t["video"])), "left")
    return both.select(g["label"], g["video"], "g", "t").mapInArrow(run, schema)


def _ends(t: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First frame and number of rows of each tube."""
    off = t.offsets.to_numpy() - t.offsets[0].as_py()
    return t.flatten().field("frame").to_numpy(zero_copy_only=False)[off[:-1]], np.diff(off)


def video_average_precision(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...] = (0.5,), unscored: tuple = UNSCORED) -> DataFrame:
    """(label, threshold, ap) of tubes; classes without a truth are left out."""
    t, g = truth.where(~F.col("label").cast("string").isin(*unscored)), guess.where(~F.col("label").cast("string").isin(*unscored))
    totals = t.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(_grid(truth.sparkSession, thresholds)))  # a row for each threshold
    return curves.interpolated_average_precision_grid(_tube_hits(t, g, thresholds), ["label"], "score", "at", totals, "n", ["video", "ord"])


def video_average_precision_grid(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """(range, map): percentages over three grids of thresholds, to four decimals."""
    grids = {"0.50:0.95": [round(0.5 + 0.05 * i, 2) for i in range(10)], "0.05:0.45": [round(0.05 + 0.05 * i, 2) for i in range(9)], "0.10:0.90": [round(0.1 + 0.1 * i, 1) for i in range(9)]}
    every = tuple(sorted({t for g in grids.values() for t in g}))
    ap = video_average_precision(truth, guess, every).groupBy("threshold").agg((F.avg("ap") * 100).alias("m"))
    names = F.array(*[F.when(F.col("threshold").isin(*g), n) for n, g in grids.items()])
    return ap.withColumn("range", F.explode(names)).where("range is not null").groupBy("range").agg(F.round(F.avg("m"), 4).alias("map"))


ERRORS = ("repeat", "extra", "place", "class", "time", "class_time", "class_place", "time_place", "all_three")


def tube_errors(truth: DataFrame, guess: DataFrame, threshold: float) -> DataFrame:
    """(label, video, score, ord, hit, error): why a tube isn't a hit.

    repeat: its truth was taken; class: a truth of another class fits; extra:
    nothing overlaps; else what is below the root of the threshold in time and
    place with the nearest truth, with its class if that differs.
    """
    kinds = dict(guess.dtypes)
    root = threshold**0.5

    def judge(key, g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("score", ascending=False, kind="stable")
        own = [(lab, _rows(x)) for lab, x in zip(t["label"], t["tube"])]
        taken: set[int] = set()
        hits, errors = [], []
        for lab, x in zip(g["label"], g["tube"]):
            tube = _rows(x)
            iou = [tube_iou(b, tube) for _, b in own]
            mine = [i for i, (k, _) in enumerate(own) if k == lab]
            others = [i for i, (k, _) in enumerate(own) if k != lab]
            best = max(mine, key=lambda i: iou[i], default=None)
            hit, why = False, None
            if best is not None and iou[best] >= threshold:
                hit, why = best not in taken, None if best not in taken else "repeat"
                taken.add(best)
            elif others and max(iou[i] for i in others) >= threshold:
                why = "class"
            else:
                near = max(range(len(own)), key=lambda i: iou[i], default=None)
                if near is None or iou[near] <= 0:
                    why = "extra"
                else:
                    in_time = tube_iou(own[near][1], tube, spatial=False) >= root
                    in_place = tube_iou(own[near][1], tube, temporal=False) >= root
                    same = own[near][0] == lab
                    why = ("place" if same else "class_place") if in_time else ("time" if same else "class_time") if in_place else ("time_place" if same else "all_three")
            hits.append(hit)
            errors.append(why)
        return pd.DataFrame({"label": g["label"], "video": g["video"], "score": g["score"], "ord": np.arange(len(g)), "hit": hits, "error": errors})

    # all classes of a video meet in one group: its tubes are few
    schema = f"label {kinds['label']}, video {kinds['video']}, score double, ord long, hit boolean, error string"
    return guess.select("label", "video", F.col("score").cast("double"), "tube").groupBy("video").cogroup(_fresh(truth.select("label", "video", "tube")).groupBy("video")).applyInPandas(judge, schema)


def error_summary(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, ap, share of each error among detections, missed truths), in percent."""
    totals = truth.groupBy("label").agg(F.count("*").alias("n"))
    ap = curves.interpolated_average_precision(judged, ["label"], "score", "hit", totals, "n", ["video", "ord"])
    each = judged.groupBy("label").agg(*[(F.avg(F.coalesce((F.col("error") == e).cast("double"), F.lit(0.0))) * 100).alias(e) for e in ERRORS], F.sum(F.col("hit").cast("int")).alias("found"))
    out = ap.join(each, "label", "left").join(totals, "label")
    return out.select("label", (F.col("ap") * 100).alias("ap"), *[F.coalesce(e, F.lit(0.0)).alias(e) for e in ERRORS], (100 - 100 * F.coalesce("found", F.lit(0)) / F.col("n")).alias("missed"))
