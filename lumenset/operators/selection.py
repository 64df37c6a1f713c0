"""Quotas, box suppression, pairing."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Media with up to so many boxes are gone through together.
FEW = 64


def quotas(size: int, weights: dict[str, float]) -> dict[str, int]:
    """``size`` shared by weight, whole numbers by largest remainder; ties go to the one declared first."""
    live = {k: Fraction(str(w)) for k, w in weights.items() if w and w > 0}
    if not live or size <= 0:
        return {}
    exact = {k: size * w / sum(live.values()) for k, w in live.items()}
    out = {k: int(x) for k, x in exact.items()}
    places = {k: i for i, k in enumerate(live)}
    for k in sorted(live, key=lambda k: (out[k] - exact[k], places[k]))[: size - sum(out.values())]:
        out[k] += 1
    return out


def iou(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """Intersection over union of two boxes (x, y, w, h), and the share of the first inside the second."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inner, own, other = w * h, a["w"] * a["h"], b["w"] * b["h"]
    return inner / (own + other - inner), inner / own


def suppress(boxes: DataFrame, iou_most: float = 0.5, inside_most: float = 0.6) -> DataFrame:
    """Greedy non-maximum suppression of each medium's boxes: the best score first, what overlaps a kept box goes.

    Media are dealt out by id and sorted, best box first, so a task goes through many media's boxes in one stream; it
    holds a batch and one image's detections at a time, and media of a batch with as many boxes are compared in one array.
    """

    def over(x: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Whether a box x overlaps a box o too much; sides along the last axis."""
        iw = np.clip(np.minimum(x[..., 0] + x[..., 2], o[..., 0] + o[..., 2]) - np.maximum(x[..., 0], o[..., 0]), 0, None)
        ih = np.clip(np.minimum(x[..., 1] + x[..., 3], o[..., 1] + o[..., 3]) - np.maximum(x[..., 1], o[..., 1]), 0, None)
        inner, own = iw * ih, x[..., 2] * x[..., 3]
        return (inner / (own + o[..., 2] * o[..., 3] - inner) > iou_most) | (inner / own > inside_most)

    def kept(x: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in range(len(x)):
            if not over(x[i], x[out]).any():
                out.append(i)
        return np.array(out, dtype=np.int64)

    def chosen(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The rows that stay, of media that begin at ``start`` (the end comes last): those with few boxes all at once, place by place."""
        size, rows = np.diff(start), [np.zeros(0, dtype=np.int64)]
        rows += [start[k] + kept(x[start[k] : start[k + 1]]) for k in np.flatnonzero(size > FEW)]
        for n in np.unique(size[size <= FEW]):
            first = start[:-1][size == n]
            box, stays = x[first[:, None] + np.arange(n)], np.ones((len(first), n), dtype=bool)
            for i in range(1, n):
                stays[:, i] = ~(over(box[:, i, None], box[:, :i]) & stays[:, :i]).any(axis=1)
            k, i = np.nonzero(stays)
            rows.append(first[k] + i)
        return np.sort(np.concatenate(rows))

    def run(batches):
        held, names = None, ["media_id", "box_no", "score"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            ids = t["media_id"].to_numpy()
            start = np.concatenate([[0], 1 + np.flatnonzero(ids[1:] != ids[:-1])])
            x = np.stack([t[c].to_numpy().astype(float) for c in "xywh"], axis=1)
            yield from t.select(names).take(pa.array(chosen(x, start))).to_batches()
            held = t.slice(start[-1])  # the last medium may go on in the next batch
        if held is not None:
            x = np.stack([held[c].to_numpy().astype(float) for c in "xywh"], axis=1)
            yield from held.select(names).take(pa.array(chosen(x, np.array([0, len(x)])))).to_batches()

    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boxes.select("media_id", "box_no", "score", *"xywh").repartition(n, "media_id")
    dealt = dealt.sortWithinPartitions("media_id", F.col("score").desc(), "box_no")
    return dealt.mapInArrow(run, "media_id long, box_no long, score double")


def upgrade_pairs(members: DataFrame, incoming: DataFrame) -> DataFrame:
    """The weakest members beside the best newcomers, rank by rank, where the newcomer scores more."""
    from lumenset.operators.scores import global_place

    out = global_place(members.select(F.col("id").alias("out_id"), F.col("score").alias("out_score")), [F.col("out_score").asc_nulls_first(), F.col("out_id").asc()])
    new = global_place(incoming.select(F.col("id").alias("in_id"), F.col("score").alias("in_score")), [F.col("in_score").desc_nulls_last(), F.col("in_id").asc()])
    return out.join(new, "place").filter(F.col("out_score").isNull() | (F.col("in_score") > F.col("out_score"))).select("place", "out_id", "in_id")


def ranked_issues(issues: DataFrame, most: int = 40) -> DataFrame:
    """The ``most`` issues of each kind by impact, then key; those of all kinds in the same order."""
    own = W.partitionBy("kind").orderBy(F.col("impact").desc(), "key")
    return issues.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most).drop("n").orderBy(F.col("impact").desc(), "key")


def reconciled(resolutions: DataFrame, issues: DataFrame) -> DataFrame:
    """Resolutions whose issue still exists with the same fingerprint."""
    return resolutions.join(issues.select("key", "fingerprint"), ["key", "fingerprint"], "left_semi")
