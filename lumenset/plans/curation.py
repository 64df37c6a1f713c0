"""More queries of the catalog: zones and crops, candidates, coverage, listings, reviews, rewrites of link tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.operators import captions as C
from lumenset.operators import filters, library, scores, zones
from lumenset.plans.catalog import AVG, HYGIENE, ISSUES, RULES, _issues, _rules, query, r6

# zones and crops


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {zone} WHERE status = 'detected')")
def watermark_tab(v):
    return zones.watermark_tab(filters.live_scope(v("media")), v("zone"), "watermarked").select("id")


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {zone}) AND id NOT IN (SELECT media_id FROM {zone} WHERE status = 'detected')")
def patched_tab(v):
    return zones.watermark_tab(filters.live_scope(v("media")), v("zone"), "patched").select("id")


@query("SELECT media_id, CASE WHEN count(*) FILTER (WHERE status = 'detected') > 0 THEN 'detected' ELSE 'patched' END AS status FROM {zone} GROUP BY media_id")
def zone_status(v):
    return zones.statuses(v("zone"))


CLAMPED = """SELECT zone_id, media_id, dilate_px, status, patch_sha, least(greatest(0, x), 1 - w1) AS x, least(greatest(0, y), 1 - h1) AS y, w1 AS w, h1 AS h
    FROM (SELECT *, least(1, greatest(0.005, w)) AS w1, least(1, greatest(0.005, h)) AS h1 FROM {zone}) AS z"""


@query(f"WITH k AS ({CLAMPED}) SELECT zone_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM k")
def zone_clamped(v):
    return v("zone").select("zone_id", *[F.round(c, 6).alias(k) for k, c in zones.clamped().items()])


@query(f"""WITH k AS ({CLAMPED}), p AS (SELECT zone_id, width, height, CAST(round_even(x * width, 0) AS BIGINT) - dilate_px AS x0, CAST(round_even(y * height, 0) AS BIGINT) - dilate_px AS y0,
      CAST(round_even((x + w) * width, 0) AS BIGINT) + dilate_px AS x1, CAST(round_even((y + h) * height, 0) AS BIGINT) + dilate_px AS y1 FROM k JOIN {{media}} ON id = media_id WHERE width IS NOT NULL),
    q AS (SELECT *, greatest(0, least(x0, width - 1)) AS l, greatest(0, least(y0, height - 1)) AS t FROM p)
    SELECT zone_id, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(greatest(l + 1, least(x1, width)) AS BIGINT) AS "right", CAST(greatest(t + 1, least(y1, height)) AS BIGINT) AS bottom FROM q""")
def dilated_box(v):
    own = v("zone").select("zone_id", "media_id", "dilate_px", *[c.alias(k) for k, c in zones.clamped().items()])
    sized = own.join(v("media").filter("width is not null").select(F.col("id").alias("media_id"), "width", "height"), "media_id")
    return sized.select("zone_id", *[c.cast("long").alias(k) for k, c in zones.pixel_box().items()])


@query("""WITH p AS (SELECT media_id, string_agg(CAST(zone_id AS VARCHAR) || ':' || printf('%.5f', x) || ':' || printf('%.5f', y) || ':' || printf('%.5f', w) || ':' || printf('%.5f', h) || ':' || CAST(dilate_px AS VARCHAR) || ':' || patch_sha, '|'
      ORDER BY zone_id, CAST(zone_id AS VARCHAR) || ':' || printf('%.5f', x) || ':' || printf('%.5f', y)) AS parts FROM (SELECT zone_id, media_id, dilate_px, patch_sha, x, y, round(w, 2) AS w, h FROM {zone} WHERE status = 'patched') AS z GROUP BY media_id)
    SELECT id, sha256('compose:' || sha256 || '|' || parts) AS sha FROM {media} JOIN p ON id = media_id""")
def composite_sha(v):
    return zones.composite_sha(v("media"), v("zone").withColumn("w", F.round("w", 2)))


@query("""SELECT zone_id, sha256('crop:' || sha256 || '|x=' || printf('%.4f', least(greatest(0, 100 * x), 100 - w1)) || '|y=' || printf('%.4f', least(greatest(0, 100 * y), 100 - h1)) || '|w=' || printf('%.4f', w1) || '|h=' || printf('%.4f', h1)) AS sha
    FROM (SELECT zone_id, media_id, x, y, least(100, greatest(1, 100 * w)) AS w1, least(100, greatest(1, 100 * h)) AS h1 FROM {zone}) AS z JOIN {media} ON id = media_id""")
def crop_sha(v):
    rect = v("zone").select("zone_id", F.col("media_id").alias("id"), *[(100 * F.col(k)).alias(k) for k in "xywh"])
    both = rect.join(v("media").select("id", "sha256"), "id")
    return both.select("zone_id", zones.crop_sha(F.col("sha256"), zones.clamped(100.0, zones.LEAST_CROP_SIDE)).alias("sha"))


# candidates


@query("SELECT id, sharpness IS NOT NULL AND (sharpness < 35 OR (id * 13) % 100 < 45) AS flagged FROM {media}")
def stats_flagged(v):
    return v("media").select("id", library.flagged(F.col("sharpness"), ((F.col("id") * 13) % 100).cast("double")).alias("flagged"))


@query(f"""WITH q AS ({AVG}) SELECT id FROM {{live_media}} LEFT JOIN q ON id = media_id WHERE (q.score IS NULL OR q.score >= 50)
    AND (width IS NULL OR greatest(width, height) >= 1024) AND (sharpness IS NULL OR sharpness >= 35)""")
def static_filters(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    rows = filters.live_scope(v("media")).join(q, "id", "left")
    return rows.filter(library.passes_static(F.col("score"), 50, F.when(F.col("width").isNotNull(), F.greatest("width", "height")), 1024, F.col("sharpness"))).select("id")


@query(f"""WITH q AS ({AVG}) SELECT id, CASE WHEN q.score < 50 THEN 'quality' WHEN sharpness < 35 THEN 'blur' WHEN (id * 17) % 100 < 24 THEN 'subject' ELSE '' END AS reason FROM {{live_media}} LEFT JOIN q ON id = media_id""")
def excluded_reason(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    rows = filters.live_scope(v("media")).join(q, "id", "left")
    return rows.select("id", library.exclusion(F.col("score"), 50, F.col("sharpness"), (F.col("id") * 17) % 100, 24).alias("reason"))


@query("""WITH t AS (SELECT media_id, regexp_replace(lower(trim(name)), '[ ]+', '_', 'g') AS name FROM {media_tag})
    SELECT media_id FROM t GROUP BY media_id HAVING count(DISTINCT name) FILTER (WHERE name IN ('brand#11')) = 1 AND count(*) FILTER (WHERE name IN ('standard_anodized_tin', 'promo_brass')) = 0""")
def required_tags(v):
    return library.with_tag_sets(v("media_tag"), ["brand#11"], ["standard_anodized_tin", "promo_brass"])


@query("SELECT DISTINCT split_part(p_type, ' ', 2) AS name FROM {part} WHERE split_part(p_type, ' ', 2) NOT IN (SELECT name FROM {tag})")
def stale_recipe_tags(v):
    wanted = v("part").select(F.split_part("p_type", F.lit(" "), F.lit(2)).alias("name")).distinct()
    return wanted.join(v("tag").select("name"), "name", "left_anti")


# coverage and listings


@query("""SELECT count(*) AS media, count(*) FILTER (WHERE id IN (SELECT id FROM {vector})) AS embedded, count(*) FILTER (WHERE id IN (SELECT media_id FROM {media_tag} WHERE source IS NULL)) AS tagged FROM {live_media}""")
def index_coverage(v):
    steps = {"embedded": v("vector").select(F.col("id").alias("media_id")), "tagged": v("media_tag").filter("source is null").select("media_id")}
    rows = library.step_counts(filters.live_scope(v("media")), steps).filter("library_id is null")
    return rows.agg(F.max("total").alias("media"), *[F.max(F.when(F.col("step") == s, F.col("done"))).alias(s) for s in steps])


@query("""WITH m AS (SELECT library_id, id IN (SELECT id FROM {vector}) AS e, id IN (SELECT media_id FROM {score}) AS q FROM {live_media}),
    r AS (SELECT library_id, 'embedded' AS step, e AS hit FROM m UNION ALL SELECT library_id, 'scored', q FROM m UNION ALL SELECT NULL, 'embedded', e FROM m UNION ALL SELECT NULL, 'scored', q FROM m)
    SELECT library_id, step, count(*) AS total, count(*) FILTER (WHERE hit) AS done FROM r GROUP BY library_id, step""")
def index_steps(v):
    steps = {"embedded": v("vector").select(F.col("id").alias("media_id")), "scored": v("score").select("media_id")}
    return library.step_counts(filters.live_scope(v("media")), steps)


@query("SELECT s.metric_id, round(avg(100 * (greatest(lo, least(hi, score)) - lo) / (hi - lo)), 6) AS mean, count(*) AS n FROM {score} AS s JOIN {metric} AS m ON s.metric_id = m.metric_id GROUP BY s.metric_id")
def scorer_means(v):
    both = v("score").join(F.broadcast(v("metric")), "metric_id")  # three rows
    own = scores.normalized(F.col("score"), F.col("lo"), F.col("hi"))
    return both.groupBy("metric_id").agg(F.round(F.avg(own), 6).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH q AS ({AVG}), h AS ({HYGIENE}), a AS (SELECT avg(score) AS quality FROM q WHERE score >= 40), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 40) AS k FROM q)
    SELECT CASE WHEN n.k > 0 AND n.k < n.n THEN round((0.35 * quality + 0.20 * (coverage + unique_share + resolution) / 3) / 0.55, 4) END AS projected FROM h, a, n""")
def projected_score(v):
    h = scores.hygiene(filters.live_scope(v("media")), v("caption_text")).select("hygiene")
    q = scores.average_scores(v("score"), v("metric")).select(r6("score"))
    a = q.agg(F.avg(F.when(F.col("score") >= 40, F.col("score"))).alias("quality"), F.count("score").alias("n"), F.count_if(F.col("score") >= 40).alias("k"))
    both = h.join(F.broadcast(a), F.lit(True))  # one row each
    pruned = scores.overall({"quality": F.col("quality"), "hygiene": F.col("hygiene")})
    return both.select(F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.round(pruned, 4)).alias("projected"))


@query("SELECT media_id, string_agg(name, ', ' ORDER BY source IS NULL, name) AS tags FROM (SELECT DISTINCT media_id, name, source FROM {media_tag}) AS t GROUP BY media_id")
def tag_listing(v):
    return library.tag_listing(v("media_tag"))


@query("SELECT media_id, name, max(source) AS source FROM {media_tag} GROUP BY media_id, name")
def tag_provenance(v):
    return library.provenance(v("media_tag"))


@query("SELECT name, count(DISTINCT media_id) AS n, round(100.0 * count(DISTINCT media_id) / (SELECT count(DISTINCT media_id) FROM {media_tag}), 6) AS share FROM {media_tag} GROUP BY name ORDER BY n DESC, name LIMIT 12")
def top_tags(v):
    return library.top_tags(v("media_tag"))


@query(RULES + " SELECT count(*) AS rules, count(*) FILTER (WHERE h = 1) AS excluded, count(*) FILTER (WHERE h = 2) AS sublibraries FROM r")
def folder_mapping_stats(v):
    return _rules(v).agg(F.count("*").alias("rules"), F.count_if(F.col("mode") == "exclude").alias("excluded"), F.count_if(F.col("mode") == "sublib").alias("sublibraries"))


@query("""WITH p AS (SELECT rel_path, string_split(rel_path, '/') AS parts FROM {folder}), l AS (SELECT * FROM p WHERE len(parts) > 1 AND len(list_filter(parts, lambda x: x LIKE '.%')) = 0),
    r AS (SELECT rel_path, parts, unnest(range(1, len(parts))) AS k FROM l), f AS (SELECT rel_path, array_to_string(parts[1:k], '/') AS folder, k = len(parts) - 1 AS own FROM r),
    s AS (SELECT folder, rel_path, row_number() OVER (PARTITION BY folder ORDER BY rel_path) AS n FROM (SELECT DISTINCT folder, rel_path FROM f WHERE own) AS d),
    g AS (SELECT folder, string_agg(rel_path, ',' ORDER BY rel_path) AS samples FROM s WHERE n <= 3 GROUP BY folder), t AS (SELECT folder, count(*) FILTER (WHERE own) AS own, count(*) AS total FROM f GROUP BY folder)
    SELECT t.folder, own, total, samples FROM t LEFT JOIN g ON t.folder = g.folder""")
def folder_tree(v):
    return library.folder_tree(v("folder"))


@query("""SELECT id, sha256 || '.' || CASE WHEN file_extension <> 'mp4' THEN 'png' ELSE file_extension END AS file FROM {live_media}""")
def deployed_names(v):
    ext = F.when(~F.lower("file_extension").isin(*filters.VIDEO), "png").otherwise(F.col("file_extension"))
    return filters.live_scope(v("media")).select("id", F.concat("sha256", F.lit("."), ext).alias("file"))


# reviews and revisions


@query("""WITH e AS (SELECT c.caption_id, coalesce(CASE WHEN p.mode = 'pinned' THEN p.revision_id END, c.head) AS revision_id FROM {caption} AS c LEFT JOIN {pin} AS p ON c.caption_id = p.caption_id)
    SELECT DISTINCT e.caption_id FROM e JOIN {review} AS r ON e.caption_id = r.caption_id AND e.revision_id = r.revision_id WHERE r.status IN ('integrity')""")
def flagged_for_review(v):
    own = C.effective(v("caption"), v("pin"), v("revision")).select("caption_id", "revision_id")
    return own.join(v("review").filter(F.col("status").isin("integrity")), ["caption_id", "revision_id"], "left_semi").select("caption_id").distinct()


@query("""SELECT d.dataset_id, s.status, count(f.finding_id) AS n FROM (SELECT DISTINCT dataset_id FROM {finding}) AS d CROSS JOIN (SELECT unnest(['pending', 'accepted', 'rejected']) AS status) AS s
    LEFT JOIN {finding} AS f ON f.dataset_id = d.dataset_id AND f.status = s.status GROUP BY d.dataset_id, s.status""")
def findings_counts(v):
    names = ["pending", "accepted", "rejected"]
    return v("finding").groupBy("dataset_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names]).unpivot("dataset_id", names, "status", "n")


@query("SELECT caption_id, revision_id, row_number() OVER (PARTITION BY caption_id ORDER BY revision_id DESC) AS number FROM (SELECT DISTINCT caption_id, revision_id FROM {revision}) AS r")
def revision_numbers(v):
    own = v("revision").select("caption_id", "revision_id").distinct()
    return own.withColumn("number", F.row_number().over(W.partitionBy("caption_id").orderBy(F.col("revision_id").desc())).cast("long"))


@query(r"""SELECT media_id, 'det' AS kind FROM {caption_text} WHERE trim(caption) <> '' AND NOT regexp_matches(' ' || lower(caption) || ' ', '[^a-z0-9_]the[^a-z0-9_]')
    UNION ALL SELECT media_id, 'short' FROM {caption_text} WHERE trim(caption) <> '' AND length(caption) < 200""")
def review_run(v):
    own = v("caption_text").filter(F.trim("caption") != "")
    missing, _ = C.trigger_rule(F.col("caption"), "the")
    broken = F.array_compact(F.array(F.when(missing, "det"), F.when(F.length("caption") < 200, "short")))
    return own.select("media_id", F.explode(broken).alias("kind"))


@query(f"""SELECT "key", left(sha1("key" || '|' || kind), 12) AS digest FROM ({ISSUES}) AS i""")
def issue_digests(v):
    return _issues(v).select("key", F.left(F.sha1(F.concat_ws("|", "key", "kind").cast("binary")), F.lit(12)).alias("digest"))


@query("""WITH h AS (SELECT r.caption_id AS media_id, max(trim(r.content)) AS was FROM {revision} AS r JOIN {caption} AS c ON r.caption_id = c.caption_id AND r.revision_id = c.head GROUP BY r.caption_id)
    SELECT t.media_id, trim(caption) AS text FROM {caption_text} AS t LEFT JOIN h ON t.media_id = h.media_id WHERE trim(caption) <> '' AND (was IS NULL OR was <> trim(caption))""")
def sidecar_import(v):
    heads = v("revision").join(v("caption").withColumnRenamed("head", "revision_id"), ["caption_id", "revision_id"]).groupBy(F.col("caption_id").alias("media_id")).agg(F.max(F.trim("content")).alias("content"))
    return library.new_sidecars(heads, v("caption_text").select("media_id", F.col("caption").alias("text")))


# rewrites of link tables


@query("""WITH g AS (SELECT id AS media_id FROM {media} WHERE deleted) SELECT 'score' AS name, count(*) AS n FROM {score} WHERE media_id NOT IN (SELECT media_id FROM g)
    UNION ALL SELECT 'tag', count(*) FROM {media_tag} WHERE media_id NOT IN (SELECT media_id FROM g) UNION ALL SELECT 'zone', count(*) FROM {zone} WHERE media_id NOT IN (SELECT media_id FROM g)""")
def purge_cascade(v):
    gone = v("media").filter("deleted").select(F.col("id").alias("media_id"))
    left = library.purge(gone, {"score": v("score"), "tag": v("media_tag"), "zone": v("zone")})
    a, b, c = (t.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, t in left.items())
    return a.unionByName(b).unionByName(c)


@query("""WITH s AS (SELECT file_id, 'lib' || CAST(file_id % 97 AS VARCHAR) AS stem FROM {media_file}), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY file_id) AS n FROM s)
    SELECT file_id, CASE WHEN n = 1 THEN stem ELSE stem || '_' || CAST(n AS VARCHAR) END AS stem FROM n""")
def merged_names(v):
    return library.merged_names(v("media_file").select("file_id", F.concat(F.lit("lib"), (F.col("file_id") % 97).cast("string")).alias("stem")))


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 2) OR id IN (SELECT media_id FROM {media_file} WHERE present)")
def library_scopes(v):
    return library.in_any(filters.live_scope(v("media")), [v("dataset_media").filter("dataset_id = 2"), v("media_file").filter("present")]).select("id")
