"""A selection's signals, flags and zones; bands and calibrated scores; keyed rewrites of tables.

Nulls count as stated in each docstring; an empty table gives an empty result; equal rows stay as often as they occur, but
for the rewrites, which keep one row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.operators.filters import normalized_tag
from lumenset.operators.vectors import GRID, SIZE, best_reference, cell, cosine_pairs

#: Weights, thresholds and words of the selection and its flags.
PICK_QUALITY, PICK_SHARPNESS = 0.7, 0.3
RESKIN_DEPTH, RESKIN_APPEARANCE = 0.90, 0.92
SIMILAR = 0.80
REBALANCE_WEIGHT, REBALANCE_SHARE, REBALANCE_PICKS = 0.85, 0.22, 4
SUBJECT_GATE, SUBJECT_MARGIN, QUALITY_MARGIN = 0.24, 0.12, 8
ZONE_LEAST = 3
ZONE_REASONS = {"quality": "under the quality floor", "blur": "excluded as blurry", "subject": "off-subject"}
ZONE_OPEN = "eligible but not picked — raise the target size"
COSINE_WINDOWS = {"clip": (0.15, 0.32), "blip": (0.25, 0.55)}
CALIBRATION_SLOPE, CALIBRATION_QUANTILE = 90.0, 0.9
SAFE_KINDS = ("det", "integrity")


# scores of one row


def stats_of(sharpness: Column, clipping: Column, cleanliness: Column) -> Column:
    """A medium's statistics; null where it was never analysed, and 0 for a part that is missing."""
    parts = [sharpness.alias("sharpness"), F.coalesce(clipping, F.lit(0.0)).alias("clipping"), F.coalesce(cleanliness, F.lit(0.0)).alias("cleanliness")]
    return F.when(sharpness.isNotNull(), F.struct(*parts))


def rescaled(cosine: Column, kind: str) -> Column:
    """A cosine on 0 to 100 within its encoder's window."""
    lo, hi = COSINE_WINDOWS[kind]
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (cosine - lo) / (hi - lo) * 100))


def rebalance_penalty(near: Column, picked: Column) -> Column:
    """What a candidate loses (0 or less) when more than the allowed share of the picks is near to it; 0 while picks are few."""
    allowed = F.least(F.lit(0.0), REBALANCE_SHARE - near / picked)
    return F.when(picked >= REBALANCE_PICKS, REBALANCE_WEIGHT * allowed).otherwise(0.0)


def subject_match(*signals: Column) -> Column:
    """The mean of the ranking signals that are known; 0 without any."""
    known = F.filter(F.array(*signals), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)


def borderline(decided: Column, near_dup: Column, subject: Column | None, score: Column, min_score: float) -> Column:
    """Why a pick is to be looked at: near_dup, subject or quality, the first that holds; null for none, or where a person decided.

    ``subject`` is None where the recipe has no ranking signal.
    """
    weak = F.lit(False) if subject is None else subject < SUBJECT_GATE + SUBJECT_MARGIN
    low = F.lit(min_score > 0) & score.isNotNull() & (score < min_score + QUALITY_MARGIN)
    return F.when(~decided, F.when(near_dup, "near_dup").when(weak, "subject").when(low, "quality"))


def reason_chips(forced: Column, favorite: Column, gain: Column, locked: Column, score: Column) -> Column:
    """The reasons shown with a pick, in order: manual, favorite, diversity, locked, and the score as a whole number."""
    chips = [
        F.when(forced, "manual"),
        F.when(favorite, "favorite"),
        F.when(gain >= 0.5, "diversity"),
        F.when(locked > 0, "locked"),
        F.bround(score, 0).cast("long").cast("string"),
    ]
    return F.filter(F.array(*chips), lambda x: x.isNotNull())


def frame_count(fps: Column, seconds: Column) -> Column:
    """Frames of a video sampled at ``fps``, the first and the last included; halves round to even."""
    return F.greatest(F.lit(1).cast("long"), F.bround(fps * seconds, 0).cast("long") + 1)


def clean_extensions(value: Column, media: list[str]) -> Column:
    """The extensions that a text with commas or line breaks lists: lower case, without dots, once each, in order, none of ``media``."""
    items = F.transform(F.split(value, "[,\n]"), lambda x: F.lower(F.regexp_replace(F.trim(x), "^[.]+", "")))
    return F.array_distinct(F.filter(items, lambda x: x.rlike("^[a-z0-9_]+$") & ~x.isin(*media)))


def badges(scores: DataFrame, metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """media_id, metric_id, label (per cent of the metric's range) and band: the last of (metric_id, least, band) at or under the clamped score.

    Metrics and bands are the fixed lists of the scorers, a few rows.
    """
    own = bands.groupBy("metric_id").agg(F.array_sort(F.collect_list(F.struct("least", "band"))).alias("bands"))
    x = F.greatest("lo", F.least("hi", "score"))
    under = F.filter("bands", lambda b: b["least"] <= x)
    band = F.coalesce(F.element_at(F.when(F.size(under) > 0, under), -1)["band"], F.col("bands")[0]["band"])
    label = F.concat(F.bround((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100, 0).cast("long").cast("string"), F.lit("%"))
    listed = F.broadcast(metrics.join(own, "metric_id"))
    return scores.join(listed, "metric_id").select("media_id", "metric_id", label.alias("label"), band.alias("band"))


def calibrated(claims: DataFrame, negatives: DataFrame) -> DataFrame:
    """Claims (media_id, cosine) with a score of 0 to 100 against the 0.9 quantile of their medium's negatives (media_id, cosine).

    A medium without negatives has no score.
    """
    bar = negatives.groupBy("media_id").agg(F.percentile("cosine", F.lit(CALIBRATION_QUANTILE)).alias("bar"))
    return claims.join(bar, "media_id", "left").withColumn("score", 100 / (1 + F.exp(-CALIBRATION_SLOPE * (F.col("cosine") - F.col("bar"))))).drop("bar")


# vectors


def reskins(appearance: DataFrame, depth: DataFrame) -> DataFrame:
    """(a, b): same framing, other style: depth vectors alike, appearance vectors not; only media with both."""
    both = depth.filter("vector is not null").join(appearance.filter("vector is not null").select("id"), "id", "left_semi")
    near = cosine_pairs(both, RESKIN_DEPTH).select("a", "b")
    return near.join(cosine_pairs(appearance, RESKIN_APPEARANCE).select("a", "b"), ["a", "b"], "left_anti")


def similar_to_selection(vectors: DataFrame, picked: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Ids of vectors with a cosine of ``least`` to a pick, itself apart."""
    return best_reference(vectors, picked).filter(F.col("cosine") >= least).select("id")


def seed_proximity(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, proximity): the greatest cosine to a seed, within 0 and 1; a seed is its own, so it has 1."""
    near = best_reference(vectors, seeds).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))).alias("p"))
    own = seeds.filter("vector is not null").select("id", F.lit(1.0).alias("own")).distinct()
    return near.join(own, "id", "full").select("id", F.coalesce("own", "p").alias("proximity"))


# groups


def winners(groups: DataFrame) -> DataFrame:
    """The medium to keep of each group (group_id, id, score, sharpness, area): by quality and sharpness, then area, then least id."""
    value = PICK_QUALITY * F.coalesce("score", F.lit(0.0)) + PICK_SHARPNESS * F.coalesce("sharpness", F.lit(0.0))
    return groups.groupBy("group_id").agg(F.max_by("id", F.struct(F.round(value, 9), F.coalesce("area", F.lit(0).cast("long")), -F.col("id"))).alias("id"), F.count("*").alias("members"))


def uncovered_zones(points: DataFrame, picks: DataFrame) -> DataFrame:
    """Cells of the map with three or more candidates and no pick: x, y (the middle), n, and why.

    ``points``: id, x, y, excluded (a reason, empty or null for none); ``picks``: id. A point without a place has no cell.
    ``why`` counts the reasons, by name.
    """
    cx, cy = cell(F.col("x"), F.col("y"))
    own = points.filter("x is not null and y is not null").select("id", F.coalesce("excluded", F.lit("")).alias("excluded"), cx.alias("cx"), cy.alias("cy"))
    own = own.join(picks.select("id").distinct().withColumn("picked", F.lit(1)), "id", "left")
    by = own.groupBy("cx", "cy", "excluded").agg(F.count("*").alias("n"), F.count("picked").alias("picked"))  # at most 24 cells times the reasons
    reason = F.coalesce(F.create_map(*[F.lit(x) for pair in ZONE_REASONS.items() for x in pair])[F.col("excluded")], F.col("excluded"))
    part = F.when(F.col("excluded") != "", F.struct("excluded", F.concat(F.col("n").cast("string"), F.lit(" "), reason).alias("text")))
    cells = by.groupBy("cx", "cy").agg(F.sum("n").alias("n"), F.sum("picked").alias("picked"), F.array_sort(F.collect_list(part)).alias("parts"))
    why = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda p: p["text"]), " · ")).otherwise(ZONE_OPEN)
    middle = lambda c, i: F.round((F.col(c) + 0.5) * (SIZE[i] / GRID[i]), 2)
    return cells.filter((F.col("n") >= ZONE_LEAST) & (F.col("picked") == 0)).select(middle("cx", 0).alias("x"), middle("cy", 1).alias("y"), "n", why.alias("why"))


# listings


def stale_tag_scores(stored: DataFrame, media_tag: DataFrame, model_id: str) -> DataFrame:
    """media_id and stale for stored scores (media_id, model_id, scored_text): the model or the medium's tags, joined by commas, changed."""
    now = media_tag.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    own = stored.join(now, "media_id", "left")
    return own.select("media_id", (~(F.col("model_id").eqNullSafe(model_id) & F.coalesce("scored_text", F.lit("")).eqNullSafe(F.coalesce("text", F.lit(""))))).alias("stale"))


def without_patched_tags(media_tag: DataFrame, zones: DataFrame, names: list[str]) -> DataFrame:
    """The links (media_id, name, source) but for those of ``names``, in any spelling, on media whose zones are all patched."""
    done = zones.groupBy("media_id").agg(F.bool_and(F.coalesce(F.col("status"), F.lit("")) != "detected").alias("all_done")).filter("all_done").select("media_id", F.lit(True).alias("done"))
    spelled = normalized_tag(F.col("name")).isin(*[normalized_tag(F.lit(n)) for n in names])
    return media_tag.join(done, "media_id", "left").filter(~(spelled & F.coalesce("done", F.lit(False)))).drop("done")


def grounded(captions: DataFrame, groundings: DataFrame, model_id: str) -> DataFrame:
    """Captions whose text in force (caption_id, revision_id) has a grounding by this model."""
    own = groundings.filter(F.col("model_id") == model_id).select("caption_id", "revision_id")
    return captions.join(own, ["caption_id", "revision_id"], "left_semi").select("caption_id", "revision_id")


def tag_panel(media_tag: DataFrame, tag_scores: DataFrame, model_id: str, attached_only: bool = False) -> DataFrame:
    """Each tag of a medium with its score, null where there is none; scores of detached tags don't show. ``attached_only``: scored ones alone."""
    own = tag_scores.filter(F.col("model_id") == model_id).select("media_id", "name", "score")
    return media_tag.select("media_id", "name").join(own, ["media_id", "name"], "inner" if attached_only else "left")


def with_datasets(crops: DataFrame, dataset_media: DataFrame) -> DataFrame:
    """Crops (id, media_id) with the ids of the datasets they are in, ascending; an empty list for none."""
    sets = dataset_media.groupBy("media_id").agg(F.array_sort(F.collect_set("dataset_id")).alias("dataset_ids"))
    return crops.join(sets, "media_id", "left").withColumn("dataset_ids", F.coalesce("dataset_ids", F.array().cast("array<long>")))


def safe_pending(findings: DataFrame, dataset_id: int | None = None, rule_id: int | None = None) -> DataFrame:
    """Pending findings that need no judgement, or those of one rule; of one dataset if asked."""
    own = findings.filter(F.col("status") == "pending")
    own = own.filter(F.col("dataset_id") == dataset_id) if dataset_id is not None else own
    return own.filter(F.col("rule_id") == rule_id) if rule_id is not None else own.filter(F.col("kind").isin(*SAFE_KINDS))


# rewrites by key


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """``rows`` with those of ``changes`` in place of the same keys; of several changes of a key the one greatest in ``latest`` (else any) stays."""
    if latest:
        newest = W.partitionBy(*keys).orderBy(F.col(latest).desc_nulls_last())
        changes = changes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    else:
        changes = changes.dropDuplicates(keys)
    return rows.join(changes.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(changes.select(*rows.columns))


def replaced(rows: DataFrame, new: DataFrame, scope: list[str], scopes: DataFrame | None = None) -> DataFrame:
    """``rows`` whose scope is rewritten: all of a scope's rows go, and the new ones come. ``scopes``: those rewritten to nothing, too."""
    gone = new.select(*scope) if scopes is None else new.select(*scope).union(scopes.select(*scope))
    return rows.join(gone.distinct(), scope, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def missing_rows(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys that ``rows`` lacks, once each: what a get-or-create makes."""
    return wanted.select(*keys).distinct().join(rows.select(*keys), keys, "left_anti")


def library_tags_added(media: DataFrame, media_tag: DataFrame, library_id: int, names: list[str], source: str = "library") -> DataFrame:
    """The links that giving a library's media these tags adds; links that exist stay as they are."""
    wanted = media.filter(F.col("library_id") == library_id).select(F.col("id").alias("media_id"), F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(names)])).alias("name"))
    return missing_rows(wanted, media_tag, ["media_id", "name"]).withColumn("source", F.lit(source))


def library_tags_removed(media: DataFrame, media_tag: DataFrame, library_id: int, names: list[str]) -> DataFrame:
    """The links that stay when a library's media lose these tags."""
    own = media.filter(F.col("library_id") == library_id).select(F.col("id").alias("media_id"), F.lit(True).alias("own"))
    return media_tag.join(own, "media_id", "left").filter(~(F.coalesce("own", F.lit(False)) & F.col("name").isin(*names))).drop("own")
