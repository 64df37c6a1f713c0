"""Queries of the catalog: caption versions, states and rewrites, duplicates of a set."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenset.operators import filters, hashes, records, scores, versions
from lumenset.operators import vectors as V
from lumenset.plans.catalog import AB, AVG, HASH, query, r6

# caption versions

EDITS = "SELECT caption_id, CASE WHEN caption_id % 2 = 0 THEN 'dataset' ELSE 'type' END AS scope, 'edited ' || CAST(caption_id AS VARCHAR(20)) AS content FROM {caption}"
SAVED = f"""e AS ({EDITS}), s AS (SELECT e.*, c.head, p.mode AS was, p.revision_id AS pin, (SELECT max(revision_id) FROM {{revision}} AS r WHERE r.caption_id = e.caption_id) + 1 AS revision_id
    FROM e JOIN {{caption}} AS c ON c.caption_id = e.caption_id LEFT JOIN {{pin}} AS p ON p.caption_id = e.caption_id)"""


def _saved(v):
    edits = v("caption").select(
        "caption_id", F.when(F.col("caption_id") % 2 == 0, "dataset").otherwise("type").alias("scope"), F.concat(F.lit("edited "), F.col("caption_id").cast("string")).alias("content")
    )
    return edits, versions.saved(edits, v("caption"), v("pin"), v("revision"))


@query(f"WITH {SAVED} SELECT caption_id, revision_id, CASE WHEN scope = 'dataset' AND was = 'pinned' THEN coalesce(pin, head) ELSE head END AS parent, content FROM s")
def caption_saved(v):
    return _saved(v)[1][0]


@query(f"WITH {SAVED} SELECT caption_id, CASE WHEN scope = 'type' THEN revision_id ELSE head END AS head FROM s")
def caption_heads_after_save(v):
    return _saved(v)[1][1]


@query(f"""WITH {SAVED} SELECT caption_id, CASE WHEN scope = 'dataset' THEN 'pinned' ELSE coalesce(was, 'follow') END AS mode,
    CASE WHEN scope = 'dataset' THEN revision_id ELSE pin END AS revision_id FROM s""")
def caption_pins_after_save(v):
    return _saved(v)[1][2]


@query(f"""WITH e AS ({EDITS}), f AS (SELECT c.caption_id, CASE WHEN p.mode = 'pinned' THEN coalesce(p.revision_id, c.head) ELSE c.head END AS revision_id FROM {{caption}} AS c LEFT JOIN {{pin}} AS p ON c.caption_id = p.caption_id)
    SELECT r.caption_id, r.revision_id, CASE WHEN f.caption_id IS NOT NULL THEN e.content ELSE r.content END AS content
    FROM {{revision}} AS r LEFT JOIN f ON r.caption_id = f.caption_id AND r.revision_id = f.revision_id LEFT JOIN e ON e.caption_id = r.caption_id""")
def caption_amended(v):
    return versions.amended(_saved(v)[0], v("caption"), v("pin"), v("revision")).select("caption_id", "revision_id", "content")


@query("""WITH c AS (SELECT caption_id, 'follow' AS mode, CAST(NULL AS BIGINT) AS revision_id FROM {caption} WHERE head >= 3)
    SELECT * FROM c UNION ALL SELECT caption_id, mode, revision_id FROM {pin} WHERE caption_id NOT IN (SELECT caption_id FROM c)""")
def caption_follow(v):
    changes = v("caption").filter("head >= 3").select("caption_id", F.lit("follow").alias("mode"), F.lit(None).cast("long").alias("revision_id"))
    return versions.assigned(changes, v("pin"))


@query("""WITH u AS (SELECT caption_id, head AS revision_id FROM {caption} UNION SELECT caption_id, revision_id FROM {pin})
    SELECT r.caption_id, r.revision_id, p.revision_id AS parent FROM {revision} AS r JOIN u ON r.caption_id = u.caption_id AND r.revision_id = u.revision_id
    LEFT JOIN u AS p ON p.caption_id = r.caption_id AND p.revision_id = r.revision_id - 1""")
def caption_pruned(v):
    revisions = v("revision").withColumn("parent", F.when(F.col("revision_id") > 0, F.col("revision_id") - 1))
    return versions.pruned(v("caption"), v("pin"), revisions).select("caption_id", "revision_id", "parent")


# listings and states


@query("SELECT id, name FROM {media} WHERE discarded AND NOT deleted")
def discarded_media(v):
    return records.discarded(v("media")).select("id", "name")


@query("""SELECT m.id, CASE WHEN m.file_extension = 'mp4' THEN 'video' WHEN NOT coalesce(f.present, false) THEN 'missing' WHEN trim(coalesce(c.caption, '')) = '' THEN 'empty' ELSE 'ok' END AS target
    FROM {media} AS m LEFT JOIN (SELECT media_id, bool_or(present) AS present FROM {media_file} GROUP BY media_id) AS f ON f.media_id = m.id LEFT JOIN {caption_text} AS c ON c.media_id = m.id""")
def caption_targets(v):
    files = v("media_file").groupBy("media_id").agg(F.bool_or("present").alias("present"))
    own = v("media").select(F.col("id").alias("media_id"), "file_extension").join(files, "media_id", "left").join(v("caption_text"), "media_id", "left")
    return own.select(F.col("media_id").alias("id"), records.caption_target(F.col("file_extension"), F.col("present"), F.col("caption")).alias("target"))


@query("SELECT media_id, count(*) AS n, string_agg(CAST(zone_id AS VARCHAR(20)), ',' ORDER BY zone_id) AS zones FROM {zone} GROUP BY media_id")
def zones_bulk(v):
    return records.zones_of(v("zone")).select("media_id", "n", F.array_join(F.transform("zone_ids", lambda x: x.cast("string")), ",").alias("zones"))


@query("""WITH c AS (SELECT name, count(DISTINCT media_id) AS n FROM {media_tag} GROUP BY name)
    SELECT name, n, round_even(100.0 * n / (SELECT count(DISTINCT media_id) FROM {media_tag}), 4) AS share FROM c ORDER BY n DESC, name LIMIT 1""")
def dominant_tag(v):
    return records.dominant_tag(v("media_tag"))




def _placed_by(order: str) -> str:
    return f"SELECT m.id, row_number() OVER (ORDER BY {order}) AS place FROM {{live_media}} AS m LEFT JOIN ({AVG}) AS a ON a.media_id = m.id"


def _ranked(v, order):
    own = filters.live_scope(v("media")).select("id", "name").join(scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score")), "id", "left")
    return scores.global_place(own, order).select("id", (F.col("place") + 1).alias("place"))


@query(_placed_by("coalesce(round(a.score, 6), -1) DESC, lower(m.name), m.id"))
def candidates_by_score(v):
    return _ranked(v, records.candidate_order("score"))


@query(_placed_by("lower(m.name), m.id"))
def candidates_by_name(v):
    return _ranked(v, records.candidate_order("name"))


@query(_placed_by("round(a.score, 6) NULLS FIRST, m.id"))
def members_worst_first(v):
    return _ranked(v, records.worst_first())


@query("SELECT c_nationkey AS dataset_id, string_agg(c_name || '. ', '' ORDER BY c_custkey) AS prefix FROM customer GROUP BY c_nationkey")
def trigger_prefix(v):
    return records.trigger_prefix(v("customer").select(F.col("c_nationkey").alias("dataset_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("word")))


@query("SELECT media_id, claim_no, score, CASE WHEN score < 20 THEN NOT rejected ELSE rejected END AS rejected FROM {claim}")
def claims_rejected(v):
    changes = v("claim").filter("score < 20").select("media_id", "claim_no", (~F.col("rejected")).alias("rejected"))
    return records.rejected(changes, v("claim")).select("media_id", "claim_no", "score", "rejected")


@query("SELECT id, CASE WHEN id IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 3) THEN true ELSE favorite END AS favorite FROM {media}")
def favorites_set(v):
    changes = v("dataset_media").filter("dataset_id = 3").select(F.col("media_id").alias("id"), F.lit(True).alias("value")).distinct()
    return records.flagged(changes, v("media"), "favorite").select("id", "favorite")


@query("SELECT media_id, metric_id FROM {score} WHERE NOT (metric_id IN ('musiq', 'laion_aes') AND media_id IN (SELECT id FROM {media} WHERE library_id = 4))")
def scores_deleted(v):
    return records.without_scores(v("score"), ["musiq", "laion_aes"], v("media").filter("library_id = 4")).select("media_id", "metric_id")


@query("SELECT DISTINCT sha256 FROM {live_media} WHERE library_id = 2")
def live_hashes(v):
    return filters.live_scope(v("media"), library_id=2).select("sha256").distinct()


@query("""WITH n AS (SELECT DISTINCT name AS old, split_part(name, '#', 1) AS new FROM {media_tag} WHERE name LIKE '%#%')
    SELECT media_id, coalesce(new, name) AS name, min(source) AS source FROM {media_tag} LEFT JOIN n ON name = old GROUP BY 1, 2""")
def tags_merged(v):
    names = v("media_tag").filter("name like '%#%'").select(F.col("name").alias("old"), F.split_part("name", F.lit("#"), F.lit(1)).alias("new")).distinct()
    return records.merged_tags(v("media_tag"), names)


@query("""SELECT f.finding_id, f.status, o_orderstatus AS run_status, n_name AS rule FROM {finding} AS f JOIN orders AS o ON o.o_orderkey = f.finding_id LEFT JOIN nation ON n_nationkey = f.dataset_id""")
def findings_enriched(v):
    found = v("finding").select("finding_id", "status", F.col("finding_id").alias("run_id"), F.col("dataset_id").alias("rule_id"))
    runs = v("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("run_status"))
    rules = v("nation").select(F.col("n_nationkey").cast("long").alias("rule_id"), F.col("n_name").alias("rule"))
    return records.enriched_findings(found, runs, rules).select("finding_id", "status", "run_status", "rule")


@query("""SELECT 'media' AS entity, count(*) AS n FROM {media} UNION ALL SELECT 'tag', count(*) FROM {tag} UNION ALL SELECT 'caption', count(*) FROM {caption}
    UNION ALL SELECT 'dataset', count(DISTINCT dataset_id) FROM {dataset_media}""")
def database_counters(v):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
    return one("media", v("media")).unionByName(one("tag", v("tag"))).unionByName(one("caption", v("caption"))).unionByName(one("dataset", v("dataset_media").select("dataset_id").distinct()))


# duplicates of a set

GROUPS = HASH.removeprefix("WITH ") + """, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
    r AS (SELECT x AS id, x AS seen FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.seen), g AS (SELECT id, min(seen) AS group_id FROM r GROUP BY id)"""


SIMILARITY = "greatest(0, least(100, 100 - 3 * greatest(p_dist, d_dist)))"


@query(f"""WITH RECURSIVE {GROUPS}, m AS (SELECT group_id, count(*) AS members FROM g GROUP BY group_id),
    w AS (SELECT a.id, CAST(sum(CASE WHEN a.p <> c.p THEN 1 ELSE 0 END) AS BIGINT) AS p_dist, CAST(sum(CASE WHEN a.d <> c.d THEN 1 ELSE 0 END) AS BIGINT) AS d_dist FROM g JOIN b AS a ON a.id = g.id JOIN b AS c ON c.id = g.group_id AND c.i = a.i GROUP BY a.id)
    SELECT g.group_id, g.id, g.group_id AS representative, CAST({SIMILARITY} AS BIGINT) AS similarity, members FROM g JOIN m ON m.group_id = g.group_id JOIN w ON w.id = g.id""")
def lookalike_groups(v):
    return hashes.lookalike_groups(hashes.sign_hashes(v("vector")), 20)


@query(f"WITH RECURSIVE {GROUPS} SELECT id, group_id FROM g WHERE id <> group_id")
def keep_best(v):
    return hashes.keep_best(hashes.lookalike_groups(hashes.sign_hashes(v("vector")), 20))


@query(f"""WITH RECURSIVE {GROUPS}, q AS ({AVG}), k AS (SELECT g.id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(m.favorite, false) DESC, coalesce(q.score, -1) DESC, coalesce(width * height, 0) DESC, g.id) AS n
    FROM g LEFT JOIN {{media}} AS m ON m.id = g.id LEFT JOIN q ON q.media_id = g.id) SELECT id, group_id, first_value(id) OVER (PARTITION BY group_id ORDER BY n) AS representative FROM k""")
def ranked_groups(v):
    """Groups of lookalikes with the medium to keep: a favourite, else the best."""
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    rank = v("media").select("id", "favorite", (F.col("width") * F.col("height")).alias("area")).join(q, "id", "left")
    return hashes.lookalike_groups(hashes.sign_hashes(v("vector")), 20, rank).select("id", "group_id", "representative")


@query(f"WITH RECURSIVE {GROUPS} SELECT round(100.0 * (1 - (SELECT count(*) - count(DISTINCT group_id) FROM g) / (SELECT count(*) FROM {{vector}})), 6) AS uniqueness")
def perceptual_uniqueness(v):
    own = hashes.sign_hashes(v("vector"))
    return hashes.uniqueness(hashes.lookalike_groups(own, 20), own).select(F.round("uniqueness", 6).alias("uniqueness"))


@query(f"""WITH RECURSIVE {GROUPS}, c AS (SELECT a.id, b.id AS other, {AB} AS cosine FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id AND b.label IN (3, 4)),
    t AS (SELECT x.id, min(y.id) AS twin FROM g AS x JOIN g AS y ON x.group_id = y.group_id AND x.id <> y.id JOIN {{vector}} AS w ON w.id = y.id AND w.label IN (3, 4) GROUP BY x.id),
    n AS (SELECT id, max(cosine) AS cosine, arg_max(other, cosine) AS other FROM c GROUP BY id)
    SELECT n.id, coalesce(twin, n.other) AS other, CASE WHEN twin IS NULL THEN 'cosine' ELSE 'hash' END AS kind FROM n LEFT JOIN t ON t.id = n.id WHERE twin IS NOT NULL OR n.cosine >= 0.4""")
def near_duplicate_alert(v):
    own, refs = v("vector"), v("vector").filter("label in (3, 4)")
    return V.near_duplicates(own, refs, hashes.lookalike_groups(hashes.sign_hashes(own), 20), 0.4)
