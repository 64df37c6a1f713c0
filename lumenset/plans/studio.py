"""Queries of the catalog: a selection's signals and flags, calibrated scores, keyed rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenset.operators import captions as C
from lumenset.operators import filters, scores, studio
from lumenset.plans.catalog import AB, AVG, query, r6


@query("SELECT id, CASE WHEN sharpness IS NOT NULL THEN sharpness END AS sharpness, CASE WHEN sharpness IS NOT NULL THEN coalesce(CAST(width AS DOUBLE), 0) END AS clipping, CASE WHEN sharpness IS NOT NULL THEN 0.0 END AS cleanliness FROM {media}")
def stats_projection(v):
    return v("media").select("id", studio.stats_of(F.col("sharpness"), F.col("width").cast("double"), F.lit(None).cast("double")).alias("s")).select("id", "s.*")


@query(f"""SELECT m.id, m.name, coalesce(f.path, '') AS path, f.path IS NULL AS missing, a.score FROM {{media}} AS m
    LEFT JOIN (SELECT media_id, arg_min(path, file_id) AS path FROM {{media_file}} WHERE present GROUP BY media_id) AS f ON f.media_id = m.id LEFT JOIN ({AVG}) AS a ON a.media_id = m.id""")
def media_rows(v):
    own = v("media").select(F.col("id").alias("media_id"), "name").join(filters.effective_file(v("media_file")), "media_id", "left")
    own = own.join(scores.average_scores(v("score"), v("metric")), "media_id", "left")
    return own.select(F.col("media_id").alias("id"), "name", F.coalesce("path", F.lit("")).alias("path"), F.col("path").isNull().alias("missing"), r6("score"))


@query("SELECT media_id, claim_no, round(greatest(0, least(100, (score / 100 - 0.15) / (0.32 - 0.15) * 100)), 6) AS clip, round(greatest(0, least(100, (score / 100 - 0.25) / (0.55 - 0.25) * 100)), 6) AS blip FROM {claim}")
def cosine_rescale(v):
    c = F.col("score") / 100
    return v("claim").select("media_id", "claim_no", F.round(studio.rescaled(c, "clip"), 6).alias("clip"), F.round(studio.rescaled(c, "blip"), 6).alias("blip"))


@query("""WITH b AS (SELECT media_id, quantile_cont(score / 100, 0.9) AS bar FROM {claim} GROUP BY media_id)
    SELECT c.media_id, kind, round(100 / (1 + exp(-90 * (score / 100 - bar))), 6) AS score FROM {caption_score} AS c LEFT JOIN b ON b.media_id = c.media_id""")
def calibrated_scores(v):
    cosine = (F.col("score") / 100).alias("cosine")
    return studio.calibrated(v("caption_score").select("media_id", "kind", cosine), v("claim").select("media_id", cosine)).select("media_id", "kind", r6("score"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, round(CASE WHEN l_quantity >= 4 THEN 0.85 * least(0, 0.22 - l_linenumber / l_quantity) ELSE 0 END, 6) AS penalty FROM lineitem""")
def rebalance_penalty(v):
    p = studio.rebalance_penalty(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"))
    return v("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.round(p, 6).alias("penalty"))


#: A candidate's score and subject signals, out of its average and its statistics.
SIGNALS = f"""SELECT m.id, m.favorite, m.library_id, a.score, m.sharpness / 100 AS seed, CASE WHEN m.id % 3 = 0 THEN a.score / 100 END AS semantic FROM {{media}} AS m LEFT JOIN ({AVG}) AS a ON a.media_id = m.id"""
MATCH = "CASE WHEN seed IS NULL AND semantic IS NULL THEN 0 ELSE (coalesce(seed, 0) + coalesce(semantic, 0)) / ((seed IS NOT NULL)::INT + (semantic IS NOT NULL)::INT) END"


def _signals(v):
    own = v("media").join(scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score")), "id", "left")
    return own.select("id", "favorite", "library_id", "score", (F.col("sharpness") / 100).alias("seed"), F.when(F.col("id") % 3 == 0, F.col("score") / 100).alias("semantic"))


@query(f"WITH s AS ({SIGNALS}) SELECT id, round({MATCH}, 10) AS subject FROM s")
def subject_matches(v):
    return _signals(v).select("id", F.round(studio.subject_match(F.col("seed"), F.col("semantic")), 10).alias("subject"))


@query(f"""WITH s AS ({SIGNALS}) SELECT id, CASE WHEN favorite THEN NULL WHEN library_id = 3 THEN 'near_dup' WHEN round({MATCH}, 10) < 0.36 THEN 'subject' WHEN score < 58 THEN 'quality' END AS flag FROM s""")
def borderline_flags(v):
    subject = F.round(studio.subject_match(F.col("seed"), F.col("semantic")), 10)
    return _signals(v).select("id", studio.borderline(F.col("favorite"), F.col("library_id") == 3, subject, F.col("score"), 50).alias("flag"))


@query(f"""WITH s AS ({SIGNALS}) SELECT id, concat_ws(',', CASE WHEN library_id = 5 THEN 'manual' END, CASE WHEN favorite THEN 'favorite' END, CASE WHEN seed >= 0.5 THEN 'diversity' END,
    CASE WHEN semantic > 0 THEN 'locked' END, CAST(CAST(round_even(score, 0) AS BIGINT) AS VARCHAR(20))) AS chips FROM s""")
def reason_chips(v):
    chips = studio.reason_chips(F.col("library_id") == 5, F.col("favorite"), F.col("seed"), F.col("semantic"), F.col("score"))
    return _signals(v).select("id", F.array_join(chips, ",").alias("chips"))


@query("SELECT event_id AS id, greatest(1, CAST(round_even((event_id % 7) * 0.5 * (user_id % 40), 0) AS BIGINT) + 1) AS frames FROM events")
def video_frames(v):
    return v("events").select(F.col("event_id").alias("id"), studio.frame_count((F.col("event_id") % 7) * F.lit(0.5), F.col("user_id") % 40).alias("frames"))


@query("""SELECT p_partkey AS id, coalesce(list_aggregate(list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' .TXT txt .png', ' '), lambda x: lower(ltrim(trim(x), '.'))),
    lambda x: regexp_full_match(x, '[a-z0-9_]+') AND x NOT IN ('png', 'mp4')))), 'string_agg', ','), '') AS extensions FROM part""")
def caption_extensions(v):
    value = F.regexp_replace(F.concat("p_name", F.lit(" .TXT txt .png")), " ", ",")
    return v("part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(studio.clean_extensions(value, ["png", "mp4"])), ",").alias("extensions"))


BANDS = """SELECT 'musiq' AS metric_id, CAST(0 AS DOUBLE) AS least, 'low' AS band UNION ALL SELECT 'musiq', 60, 'fair' UNION ALL SELECT 'musiq', 75, 'good' UNION ALL SELECT 'musiq', 90, 'excellent'
    UNION ALL SELECT 'topiq_nr', 0, 'low' UNION ALL SELECT 'topiq_nr', 0.6, 'fair' UNION ALL SELECT 'topiq_nr', 0.8, 'good' UNION ALL SELECT 'topiq_nr', 0.95, 'excellent'"""


@query(f"""WITH b AS ({BANDS}), x AS (SELECT media_id, s.metric_id, lo, hi, greatest(lo, least(hi, score)) AS score FROM {{score}} AS s JOIN {{metric}} AS m ON m.metric_id = s.metric_id)
    SELECT media_id, x.metric_id, CAST(CAST(round_even((score - lo) / (hi - lo) * 100, 0) AS BIGINT) AS VARCHAR(20)) || '%' AS label, arg_max(band, least) AS band
    FROM x JOIN b ON b.metric_id = x.metric_id AND least <= score GROUP BY media_id, x.metric_id, score, lo, hi""")
def badge_bands(v):
    return studio.badges(v("score"), v("metric"), v.spark.sql(BANDS))


# vectors


def _first(x: str) -> str:
    """The cosine of the first eight parts of two vectors."""
    return f"list_cosine_similarity(list_transform({x}a.vector[1:8], lambda e: CAST(e AS DOUBLE)), list_transform({x}b.vector[1:8], lambda e: CAST(e AS DOUBLE)))"


@query(f"SELECT a.id AS a, b.id AS b FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id WHERE {_first('')} >= 0.90 AND {AB} < 0.92")
def reskin_pairs(v):
    return studio.reskins(v("vector"), v("vector").withColumn("vector", F.slice("vector", 1, 8)))


BEST = f"SELECT a.id, max({AB}) AS cosine FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id AND b.label = 2 GROUP BY a.id"


@query(f"SELECT id FROM ({BEST}) AS t WHERE cosine >= 0.4")
def similar_to_selection(v):
    return studio.similar_to_selection(v("vector"), v("vector").filter("label = 2"), 0.4)


@query(f"SELECT v.id, round(CASE WHEN label = 2 THEN 1 ELSE greatest(0, least(1, cosine)) END, 4) AS proximity FROM {{vector}} AS v JOIN ({BEST}) AS t ON t.id = v.id")
def seed_proximity(v):
    return studio.seed_proximity(v("vector"), v("vector").filter("label = 2")).select("id", F.round("proximity", 4).alias("proximity"))


# groups


@query(f"""WITH x AS (SELECT sha256, m.id, round(0.7 * coalesce(score, 0) + 0.3 * coalesce(sharpness, 0), 9) AS value, coalesce(width * height, 0) AS area FROM {{media}} AS m LEFT JOIN ({AVG}) AS a ON a.media_id = m.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY value DESC, area DESC, id) AS n, count(*) OVER (PARTITION BY sha256) AS members FROM x) SELECT sha256 AS group_id, id, members FROM r WHERE n = 1""")
def near_duplicate_winners(v):
    own = v("media").join(scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score")), "id", "left")
    return studio.winners(own.select(F.col("sha256").alias("group_id"), "id", "score", "sharpness", (F.col("width") * F.col("height")).alias("area")))


POINT = "SELECT id, CAST((id * 37) % 101 AS DOUBLE) AS x, CAST((id * 53) % 75 AS DOUBLE) AS y, CASE WHEN sharpness < 30 THEN 'blur' WHEN hidden THEN 'subject' WHEN discarded THEN 'quality' ELSE '' END AS excluded FROM {media}"


@query(f"""WITH p AS ({POINT}), c AS (SELECT *, least(5, CAST(floor(x / 100.0 * 6) AS INT)) AS cx, least(3, CAST(floor(y / 74.0 * 4) AS INT)) AS cy FROM p),
    n AS (SELECT cx, cy, excluded, count(*) AS n, count(*) FILTER (WHERE x < 50 AND y > 20) AS picked FROM c GROUP BY cx, cy, excluded)
    SELECT round((cx + 0.5) * (100.0 / 6), 2) AS x, round((cy + 0.5) * (74.0 / 4), 2) AS y, CAST(sum(n) AS BIGINT) AS n,
    coalesce(string_agg(CAST(n AS VARCHAR(20)) || CASE excluded WHEN 'blur' THEN ' excluded as blurry' WHEN 'subject' THEN ' off-subject' ELSE ' under the quality floor' END, ' · ' ORDER BY excluded) FILTER (WHERE excluded <> ''),
    'eligible but not picked — raise the target size') AS why FROM n GROUP BY cx, cy HAVING sum(n) >= 3 AND sum(picked) = 0""")
def uncovered_zones(v):
    points = v.spark.sql(POINT, media=v("media"))
    return studio.uncovered_zones(points, points.filter("x < 50 and y > 20"))


# listings


@query("""WITH t AS (SELECT media_id, string_agg(name, ', ' ORDER BY name) AS text FROM {media_tag} GROUP BY media_id),
    s AS (SELECT media_id, CASE WHEN media_id % 7 = 0 THEN 'old' ELSE 'clip' END AS model_id, CASE WHEN media_id % 5 = 0 THEN 'gone' ELSE text END AS scored_text FROM t)
    SELECT s.media_id, NOT (model_id = 'clip' AND scored_text = text) AS stale FROM s JOIN t ON t.media_id = s.media_id""")
def stale_tag_scores(v):
    text = v("media_tag").groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    model, scored = F.when(F.col("media_id") % 7 == 0, "old").otherwise("clip"), F.when(F.col("media_id") % 5 == 0, "gone").otherwise(F.col("text"))
    return studio.stale_tag_scores(text.select("media_id", model.alias("model_id"), scored.alias("scored_text")), v("media_tag"), "clip")


@query("""SELECT media_id, name, source FROM {media_tag} WHERE NOT (lower(name) IN ('brand#11', 'brand#12') AND media_id IN (SELECT media_id FROM {zone} GROUP BY media_id HAVING bool_and(status <> 'detected')))""")
def tags_after_patch(v):
    return studio.without_patched_tags(v("media_tag"), v("zone"), ["Brand#11", "BRAND#12"]).select("media_id", "name", "source")


@query("""SELECT c.caption_id, CASE WHEN p.mode = 'pinned' THEN coalesce(p.revision_id, c.head) ELSE c.head END AS revision_id FROM {caption} AS c LEFT JOIN {pin} AS p ON p.caption_id = c.caption_id
    WHERE (c.caption_id, CASE WHEN p.mode = 'pinned' THEN coalesce(p.revision_id, c.head) ELSE c.head END) IN (SELECT (caption_id, revision_id) FROM {review} WHERE status = 'ok')""")
def grounded_captions(v):
    found = v("review").select("caption_id", "revision_id", F.when(F.col("status") == "ok", "siglip").otherwise("other").alias("model_id"))
    return studio.grounded(C.effective(v("caption"), v("pin"), v("revision")), found, "siglip")


TAG_SCORE = "SELECT media_id, name, 'siglip' AS model_id, CAST(length(name) AS DOUBLE) AS score FROM {media_tag} WHERE source IS NULL UNION ALL SELECT media_id, 'detached', 'siglip', 1.0 FROM {media_tag} WHERE source = 'library'"


@query(f"WITH s AS ({TAG_SCORE}) SELECT t.media_id, t.name, s.score FROM {{media_tag}} AS t LEFT JOIN s ON s.media_id = t.media_id AND s.name = t.name")
def tag_panel(v):
    return studio.tag_panel(v("media_tag"), v.spark.sql(TAG_SCORE, media_tag=v("media_tag")), "siglip")


@query(f"WITH s AS ({TAG_SCORE}) SELECT t.media_id, t.name, s.score FROM {{media_tag}} AS t JOIN s ON s.media_id = t.media_id AND s.name = t.name")
def tag_scores_visible(v):
    return studio.tag_panel(v("media_tag"), v.spark.sql(TAG_SCORE, media_tag=v("media_tag")), "siglip", attached_only=True)


@query("""SELECT zone_id, z.media_id, coalesce(sets, '') AS sets FROM {zone} AS z
    LEFT JOIN (SELECT media_id, string_agg(DISTINCT CAST(dataset_id AS VARCHAR(20)), ',' ORDER BY CAST(dataset_id AS VARCHAR(20))) AS sets FROM {dataset_media} GROUP BY media_id) AS d ON d.media_id = z.media_id""")
def crops_with_datasets(v):
    text = F.array_sort(F.transform("dataset_ids", lambda x: x.cast("string")))
    return studio.with_datasets(v("zone"), v("dataset_media")).select("zone_id", "media_id", F.array_join(text, ",").alias("sets"))


KIND = "CASE finding_id % 3 WHEN 0 THEN 'det' WHEN 1 THEN 'integrity' ELSE 'model' END"


def _findings(v):
    return v("finding").withColumn("kind", F.expr(KIND)).withColumn("rule_id", F.col("finding_id") % 6)


@query(f"SELECT finding_id FROM {{finding}} WHERE status = 'pending' AND {KIND} IN ('det', 'integrity')")
def safe_findings(v):
    return studio.safe_pending(_findings(v)).select("finding_id")


@query("SELECT finding_id, dataset_id FROM {finding} WHERE status = 'pending' AND finding_id % 6 = 2")
def rule_findings(v):
    return studio.safe_pending(_findings(v), rule_id=2).select("finding_id", "dataset_id")


@query("SELECT media_id, caption FROM {caption_text} WHERE trim(caption) <> ''")
def review_targets(v):
    return v("caption_text").filter(C.has_text(F.col("caption"))).select("media_id", "caption")


def _fixes(v):
    """Fixes out of a caption's revisions: each text, its next one as it is now, and the one after as the fix."""
    at = lambda n, name: v("revision").select("caption_id", (F.col("revision_id") - n).alias("revision_id"), F.col("content").alias(name))
    return at(0, "before").join(at(1, "current"), ["caption_id", "revision_id"]).join(at(2, "after"), ["caption_id", "revision_id"]).withColumn("status", F.lit("pending"))


@query()
def findings_resolved(v):
    return C.resolved_findings(_fixes(v)).select("caption_id", "revision_id", "shown", "conflict", "stale")


@query()
def rewrite_ratios(v):
    return _fixes(v).select("caption_id", "revision_id", F.round(C.rewrite_ratio("before", "current"), 6).alias("ratio"))


#: Findings whose caption hasn't moved since they were made.
FIX = """SELECT a.caption_id * 100 + a.revision_id AS finding_id, CASE (a.caption_id + a.revision_id) % 3 WHEN 0 THEN 'accepted' ELSE 'pending' END AS status, a.content AS before, b.content AS after,
    CASE (a.caption_id + a.revision_id) % 3 WHEN 0 THEN b.content ELSE a.content END AS current, CASE (a.caption_id + a.revision_id) % 3 WHEN 0 THEN b.content END AS applied,
    CASE (a.caption_id + a.revision_id) % 3 WHEN 0 THEN 'kept ' || a.content END AS undo, CASE (a.caption_id + a.revision_id) % 3 WHEN 0 THEN 'undo' WHEN 1 THEN 'accept' ELSE 'reject' END AS action
    FROM {revision} AS a JOIN {revision} AS b ON b.caption_id = a.caption_id AND b.revision_id = a.revision_id + 1"""


@query(f"""WITH f AS ({FIX}) SELECT finding_id, CASE action WHEN 'accept' THEN 'accepted' WHEN 'undo' THEN 'pending' ELSE 'rejected' END AS status,
    CASE action WHEN 'accept' THEN after WHEN 'undo' THEN undo ELSE current END AS current, CASE action WHEN 'accept' THEN after END AS applied, CASE action WHEN 'accept' THEN before END AS undo FROM f""")
def findings_decided(v):
    own = v.spark.sql(FIX, revision=v("revision"))
    decisions = own.select("finding_id", "action", F.lit(None).cast("string").alias("text"))
    return C.decided(own.drop("action"), decisions).select("finding_id", "status", "current", "applied", "undo")


# rewrites by key


@query("""WITH c AS (SELECT l_partkey AS media_id, max(l_orderkey) AS made FROM lineitem GROUP BY l_partkey)
    SELECT media_id, metric_id, score FROM {score} WHERE NOT (metric_id = 'musiq' AND media_id IN (SELECT media_id FROM c))
    UNION ALL SELECT CAST(media_id AS BIGINT), 'musiq', CAST(made % 100 AS DOUBLE) FROM c""")
def scores_upserted(v):
    changes = v("lineitem").select(F.col("l_partkey").cast("long").alias("media_id"), F.lit("musiq").alias("metric_id"), (F.col("l_orderkey") % 100).cast("double").alias("score"), F.col("l_orderkey").alias("at"))
    return studio.upserted(v("score"), changes, ["media_id", "metric_id"], "at").select("media_id", "metric_id", "score")


@query("""SELECT media_id, claim_no, score, rejected FROM {claim} WHERE media_id NOT IN (SELECT media_id FROM {caption_score} WHERE kind = 'full')
    UNION ALL SELECT media_id, 0, score, false FROM {caption_score} WHERE kind = 'full'""")
def claims_replaced(v):
    new = v("caption_score").filter("kind = 'full'").select("media_id", F.lit(0).alias("claim_no"), "score", F.lit(False).alias("rejected"))
    return studio.replaced(v("claim"), new, ["media_id"]).select("media_id", "claim_no", "score", "rejected")


@query("SELECT finding_id, dataset_id, status FROM {finding} WHERE dataset_id NOT IN (3, 4) UNION ALL SELECT CAST(o_orderkey AS BIGINT), 3, 'pending' FROM orders WHERE o_orderstatus = 'F'")
def findings_of_new_run(v):
    new = v("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("long").alias("finding_id"), F.lit(3).cast("long").alias("dataset_id"), F.lit("pending").alias("status"))
    whole = v("finding").filter("dataset_id in (3, 4)").select("dataset_id").distinct()
    return studio.replaced(v("finding"), new, ["dataset_id"], whole)


@query("SELECT id AS media_id FROM {media} WHERE id NOT IN (SELECT media_id FROM {caption_text})")
def captions_created(v):
    return studio.missing_rows(v("media").select(F.col("id").alias("media_id")), v("caption_text"), ["media_id"])


@query("""SELECT id AS media_id, name, 'library' AS source FROM {media}, (SELECT 'Brand#11' AS name UNION ALL SELECT 'set') AS n WHERE library_id = 4
    EXCEPT SELECT media_id, name, 'library' FROM {media_tag}""".replace("FROM {media},", "FROM (SELECT id, library_id FROM {media}) AS m,"))
def library_tags_added(v):
    return studio.library_tags_added(v("media"), v("media_tag"), 4, ["Brand#11", "set"])


@query("SELECT media_id, name FROM {media_tag} WHERE NOT (name IN ('Brand#11', 'Brand#22') AND media_id IN (SELECT id FROM {media} WHERE library_id = 4))")
def library_tags_removed(v):
    return studio.library_tags_removed(v("media"), v("media_tag"), 4, ["Brand#11", "Brand#22"]).select("media_id", "name")
