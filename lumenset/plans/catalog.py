"""Queries over the media views, each beside the SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.functions.rounding import rounded
from lumenset.operators import captions as C
from lumenset.operators import deploy, filters, greedy, hashes, rules, scores, selection
from lumenset.operators import vectors as V
from lumenset.sources import console
from lumenset.sources.views import Views, with_views
from lumenset.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):
    """Registers a function of the views under its name. ``parts`` stand in the SQL as <name>."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            whole = with_views(sql)
            for name, part in parts.items():
                whole = whole.replace(f"<{name}>", part)
            ORACLES[f.__name__] = whole
        return f

    return add


def r6(name: str, alias: str | None = None):
    return rounded(F.col(name), 6).alias(alias or name)


# filters, joins, orders


@query("SELECT id, name, library_id FROM {live_media} WHERE file_extension <> 'mp4'")
def live_scope(v):
    return filters.live_scope(v("media"), images_only=True).select("id", "name", "library_id")


@query("SELECT library_id, count(*) AS n FROM {live_media} GROUP BY library_id")
def live_count_by_library(v):
    return filters.live_scope(v("media")).groupBy("library_id").agg(F.count("*").alias("n"))


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {media_tag} WHERE name IN ('Brand#11', 'Brand#12', 'Brand#13', 'BRAND#1', 'Brand#1')) ")
def tag_filter_any(v):
    return filters.tagged(filters.live_scope(v("media")), v("media_tag"), ["Brand#11", "Brand#12", "Brand#13", "BRAND#1", "Brand#1"]).select("id")


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {media_tag} WHERE name LIKE '%a%' GROUP BY media_id HAVING count(DISTINCT name) >= 2)")
def tag_filter_all(v):
    hits = v("media_tag").filter(F.col("name").like("%a%")).groupBy("media_id").agg(F.countDistinct("name").alias("n")).filter("n >= 2")
    return filters.within(filters.live_scope(v("media")), hits).select("id")


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {media_tag} WHERE source = 'library' AND name LIKE '%1')")
def tag_exclude(v):
    gone = v("media_tag").filter((F.col("source") == "library") & F.col("name").like("%1"))
    return filters.within(filters.live_scope(v("media")), gone, inside=False).select("id")


@query("SELECT id FROM {live_media} WHERE id IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 3 AND NOT hidden)")
def in_dataset(v):
    return filters.within(filters.live_scope(v("media")), v("dataset_media").filter("dataset_id = 3 and not hidden")).select("id")


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 3)")
def not_in_dataset(v):
    return filters.within(filters.live_scope(v("media")), v("dataset_media").filter("dataset_id = 3"), inside=False).select("id")


AVG = """SELECT media_id, round(avg(100 * (score - coalesce(lo, 0)) / (coalesce(hi, 100) - coalesce(lo, 0))), 6) AS score
    FROM {score} AS s LEFT JOIN {metric} AS m ON s.metric_id = m.metric_id GROUP BY media_id"""


@query(AVG)
def quality_average(v):
    return scores.average_scores(v("score"), v("metric")).select("media_id", r6("score"))


@query(f"WITH q AS ({AVG}) SELECT id, q.score FROM {{live_media}} LEFT JOIN q ON id = media_id ORDER BY q.score IS NULL, q.score DESC, id DESC LIMIT 60 OFFSET 60")
def live_media_page(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    rows = filters.live_scope(v("media")).select("id").join(q, "id", "left")
    return filters.page(rows, filters.order_by("quality_desc"), 60, 60)


@query("SELECT id, width * height AS area FROM {live_media} ORDER BY width * height IS NULL, width * height, id DESC LIMIT 100")
def dimension_page(v):
    rows = filters.live_scope(v("media")).select("id", (F.col("width") * F.col("height")).alias("area"))
    return filters.page(rows, filters.order_by("dimension_asc"), 0, 100)


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {score} WHERE metric_id = 'musiq')")
def pending_score(v):
    return filters.pending(filters.live_scope(v("media")), v("score").filter("metric_id = 'musiq'")).select("id")


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT id FROM {vector})")
def pending_embedding(v):
    return filters.pending(filters.live_scope(v("media")), v("vector").select(F.col("id").alias("media_id"))).select("id")


@query("SELECT metric_id, count(*) AS n FROM {score} GROUP BY metric_id")
def metric_counts(v):
    return v("score").groupBy("metric_id").agg(F.count("*").alias("n"))


@query("SELECT media_id FROM {score} WHERE metric_id IN ('musiq', 'topiq_nr') GROUP BY media_id HAVING count(DISTINCT metric_id) = 2")
def all_metrics_scored(v):
    return scores.all_scored(v("score"), ["musiq", "topiq_nr"])


@query("SELECT media_id, arg_min(path, file_id) AS path FROM {media_file} WHERE present GROUP BY media_id")
def effective_file(v):
    return filters.effective_file(v("media_file"))


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {media_file} WHERE present)")
def missing_on_disk(v):
    return filters.within(filters.live_scope(v("media")), v("media_file").filter("present"), inside=False).select("id")


@query("SELECT id FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {media_file}) AND id NOT IN (SELECT media_id FROM {dataset_media} WHERE dataset_id < 2)")
def orphan_media(v):
    return filters.orphans(v("media"), v("media_file"), v("dataset_media").filter("dataset_id < 2")).select("id")


# tags


@query("SELECT name, usage FROM {tag}")
def tag_usage(v):
    return v("media_tag").groupBy("name").agg(F.count("*").alias("usage"))


@query("""SELECT name, usage, CAST(CASE WHEN lower(name) = 'st' THEN 0 WHEN lower(name) LIKE 'st%' THEN 1 WHEN lower(name) LIKE '%st' THEN 2 ELSE 3 END AS BIGINT) AS relevance
    FROM {tag} WHERE name ILIKE '%st%' ORDER BY relevance, usage DESC, length(name), name LIMIT 50""")
def tag_search(v):
    return filters.search_tags(v("tag"), "st").select("name", "usage", F.col("relevance").cast("long").alias("relevance"))


@query("""WITH k AS (SELECT DISTINCT regexp_replace(lower(trim(name)), '[ ]+', '_', 'g') AS "key", name, coalesce(source = 'library', false) AS reserved FROM {media_tag})
    SELECT "key", arg_min(name, (CASE WHEN reserved THEN '1' ELSE '0' END) || name) AS canonical, count(DISTINCT name) AS spellings FROM k GROUP BY "key" """)
def tag_dedupe(v):
    tags = v("media_tag").select("name", F.coalesce("source", F.lit("")).alias("source")).distinct()
    return filters.canonical_tags(tags)


@query("""SELECT media_id, max(CASE WHEN name LIKE 'STANDARD%' THEN 3 WHEN name LIKE 'SMALL%' THEN 2 WHEN name LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS bucket FROM {media_tag} GROUP BY media_id""")
def framing_classify(v):
    order = F.when(F.col("name").startswith("STANDARD"), 3).when(F.col("name").startswith("SMALL"), 2).when(F.col("name").startswith("Brand#1"), 1).otherwise(0)
    return v("media_tag").groupBy("media_id").agg(F.max(order).alias("bucket"))


@query("""WITH f AS (SELECT media_id, max(CASE WHEN name LIKE 'STANDARD%' THEN 3 WHEN name LIKE 'SMALL%' THEN 2 WHEN name LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS bucket FROM {media_tag} GROUP BY media_id)
    SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY bucket""")
def framing_distribution(v):
    f = framing_classify(v)
    n = f.agg(F.count("*").alias("all"))
    rows = f.groupBy("bucket").agg(F.count("*").alias("n")).join(F.broadcast(n), F.lit(True))
    return rows.select("bucket", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH a AS (SELECT name, count(*) AS n FROM {media_tag} GROUP BY name), t AS (SELECT count(DISTINCT media_id) AS m FROM {media_tag}),
    b AS (SELECT name, count(*) AS n FROM {media_tag} WHERE media_id IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 1) GROUP BY name),
    u AS (SELECT count(DISTINCT media_id) AS m FROM {media_tag} WHERE media_id IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 1))
    SELECT a.name, round(coalesce(b.n, 0) * 1.0 / u.m - a.n * 1.0 / t.m, 6) AS lift FROM a LEFT JOIN b ON a.name = b.name, t, u ORDER BY lift DESC, a.name LIMIT 12""")
def tag_lift(v):
    tags = v("media_tag")
    own = tags.join(v("dataset_media").filter("dataset_id = 1").select("media_id").distinct(), "media_id", "left_semi")
    a, b = tags.groupBy("name").agg(F.count("*").alias("n")), own.groupBy("name").agg(F.count("*").alias("k"))
    totals = tags.agg(F.countDistinct("media_id").alias("m")).join(own.agg(F.countDistinct("media_id").alias("j")), F.lit(True))
    rows = a.join(b, "name", "left").join(F.broadcast(totals), F.lit(True))
    lift = F.round(F.coalesce("k", F.lit(0)) / F.col("j") - F.col("n") / F.col("m"), 6)
    return rows.select("name", lift.alias("lift")).orderBy(F.col("lift").desc(), "name").limit(12)


# captions


@query("""SELECT c.caption_id, coalesce(CASE WHEN p.mode = 'pinned' THEN p.revision_id END, c.head) AS revision_id, r.content FROM {caption} AS c LEFT JOIN {pin} AS p ON c.caption_id = p.caption_id
    LEFT JOIN {revision} AS r ON r.caption_id = c.caption_id AND r.revision_id = coalesce(CASE WHEN p.mode = 'pinned' THEN p.revision_id END, c.head)""")
def effective_caption(v):
    return C.effective(v("caption"), v("pin"), v("revision"))


@query("""SELECT r.caption_id, r.revision_id FROM {revision} AS r LEFT JOIN {caption} AS c ON r.caption_id = c.caption_id AND r.revision_id = c.head
    LEFT JOIN {pin} AS p ON r.caption_id = p.caption_id AND r.revision_id = p.revision_id WHERE c.caption_id IS NULL AND p.caption_id IS NULL""")
def unused_revisions(v):
    return C.unused_revisions(v("caption"), v("pin"), v("revision")).select("caption_id", "revision_id")


@query("SELECT count(*) AS revisions, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT caption_id) AS captions FROM {revision}")
def revision_weight(v):
    return v("revision").agg(F.count("*").alias("revisions"), F.sum(F.length("content")).alias("chars"), F.countDistinct("caption_id").alias("captions"))


@query(r"SELECT media_id FROM {caption_text} WHERE length(regexp_replace(regexp_replace(caption, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) < 3")
def integrity_empty(v):
    return v("caption_text").filter(C.is_empty(F.col("caption"))).select("media_id")


@query(r"""WITH t AS (SELECT media_id, regexp_replace(regexp_replace(regexp_replace(caption, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '[\x20\t\r\n"'')\]}}»”’]+$', '') AS core FROM {caption_text})
    SELECT media_id FROM t WHERE length(core) >= 3 AND right(core, 1) NOT IN ('.', '!', '?', '…')""".replace("}}", "}"))
def integrity_truncated(v):
    return v("caption_text").filter(C.is_truncated(F.col("caption"))).select("media_id")


@query(r"""WITH w AS (SELECT media_id, list_filter(regexp_split_to_array(lower(caption), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {caption_text}),
    g AS (SELECT media_id, w, unnest(range(1, len(w) - 1)) AS pos FROM w WHERE len(w) >= 3),
    c AS (SELECT media_id, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS phrase, count(*) AS times, min(pos) AS pos FROM g GROUP BY ALL HAVING count(*) >= 3)
    SELECT media_id, phrase, times FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY times DESC, pos) AS n FROM
      (SELECT media_id, phrase, CAST(sum(times) AS BIGINT) AS times, min(pos) AS pos FROM c GROUP BY media_id, phrase) AS d) AS e WHERE n = 1""".replace(
    "count(*) AS times, min(pos) AS pos FROM g GROUP BY ALL HAVING count(*) >= 3", "count(*) AS times, min(pos) AS pos FROM g GROUP BY media_id, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] HAVING count(*) >= 3"
))
def integrity_repetition(v):
    return C.repeated_phrases(v("caption_text"), "media_id", "caption")


PHRASES = ORACLES["integrity_repetition"]


@query(r"""WITH t AS (SELECT media_id, caption, regexp_replace(regexp_replace(caption, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s,
      regexp_replace(regexp_replace(caption, '^[<blank>]+', ''), '[<blank>]+$', '') AS g FROM {caption_text}),
    x AS (SELECT *, regexp_replace(s, '[\x20\t\r\n"'')\]<close>»”’]+$', '') AS core, length(g) - length(regexp_replace(g, '[<unreadable>]', '', 'g')) AS bad FROM t),
    c AS (SELECT media_id, concat_ws(',', CASE WHEN length(s) < 3 THEN 'empty' END, CASE WHEN length(core) >= 3 AND right(core, 1) NOT IN ('.', '!', '?', '…') THEN 'truncated' END,
      CASE WHEN media_id IN (SELECT media_id FROM (<phrases>) AS p) THEN 'repetition' END, CASE WHEN g <> '' AND bad >= 0.15 * length(g) THEN 'garbage' END,
      CASE WHEN regexp_matches(caption, '<residue>') THEN 'residue' END) AS issues FROM x) SELECT media_id, issues FROM c WHERE issues <> ''""", phrases=PHRASES, close="}", blank=C.BLANK, unreadable=C.UNREADABLE, residue=C.RESIDUE)
def integrity_codes(v):
    return C.integrity(v("caption_text"), "media_id", "caption").filter(F.size("issues") > 0).select("media_id", F.array_join("issues", ",").alias("issues"))


@query(r"""SELECT media_id, CASE WHEN trim(caption) <> '' THEN 'the, ' || caption ELSE 'the' END AS fixed FROM {caption_text}
    WHERE NOT regexp_matches(' ' || lower(caption) || ' ', '[^a-z0-9_]the[^a-z0-9_]')""")
def det_rule(v):
    missing, fixed = C.trigger_rule(F.col("caption"), "the")
    return v("caption_text").filter(missing).select("media_id", fixed.alias("fixed"))


@query("""SELECT media_id, round(avg(score), 1) AS score, count(*) AS n FROM {caption_score} WHERE model_id = 'siglip' GROUP BY media_id""")
def caption_score_report(v):
    return scores.caption_report(v("caption_score"), ["siglip"])


@query("SELECT DISTINCT media_id FROM {claim} WHERE NOT rejected AND score < 30")
def weak_grounding(v):
    return C.weak_claims(v("claim"), 30)


@query("""SELECT media_id, count(*) AS total, count(*) FILTER (WHERE score >= 50) AS validated, count(*) FILTER (WHERE score < 50) AS flagged FROM {claim} WHERE NOT rejected GROUP BY media_id""")
def grounding_summary(v):
    return C.grounding_summary(v("claim"), 50).drop("coverage")


@query("""SELECT count(*) - count(DISTINCT caption) AS duplicates FROM {caption_text} WHERE caption <> ''""")
def exact_duplicate_texts(v):
    return v("caption_text").filter("caption <> ''").groupBy(F.sha2("caption", 256)).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("duplicates"))


# scores and reports


@query(f"""WITH q AS ({AVG}), b AS (SELECT CASE WHEN score >= 0 AND score < 20 THEN 0 WHEN score < 40 THEN 1 WHEN score < 60 THEN 2 WHEN score < 80 THEN 3 WHEN score < 100.01 THEN 4 END AS bucket FROM q WHERE score >= 0)
    SELECT CAST(k AS BIGINT) AS bucket, count(b.bucket) AS n FROM (SELECT unnest(range(5)) AS k) AS every LEFT JOIN b ON k = b.bucket GROUP BY k""")
def quality_histogram(v):
    return scores.histogram(scores.average_scores(v("score"), v("metric")).select("media_id", r6("score")))


@query(f"""WITH q AS ({AVG}) SELECT media_id, CASE WHEN score >= 90 THEN 'A' WHEN score >= 83 THEN 'B+' WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C' ELSE 'D' END AS grade,
    CASE WHEN score >= 80 THEN 'ready' WHEN score >= 65 THEN 'usable' ELSE 'needs work' END AS verdict FROM q""")
def quality_grades(v):
    q = scores.average_scores(v("score"), v("metric")).select("media_id", r6("score"))
    return q.select("media_id", scores.grade(F.col("score")).alias("grade"), scores.verdict(F.col("score")).alias("verdict"))


HYGIENE = """SELECT count(*) AS n, round(100.0 * count(c.media_id) / count(*), 6) AS coverage, round(100.0 * count(DISTINCT sha256) / count(*), 6) AS unique_share,
    round(100.0 * count(*) FILTER (WHERE least(width, height) >= 1024 AND width IS NOT NULL) / count(width), 6) AS resolution
    FROM {live_media} LEFT JOIN (SELECT DISTINCT media_id FROM {caption_text} WHERE trim(caption) <> '') AS c ON id = c.media_id"""


@query(HYGIENE)
def hygiene_pillar(v):
    row = scores.hygiene(filters.live_scope(v("media")), v("caption_text"))
    return row.select("n", r6("coverage"), r6("unique_share"), r6("resolution"))


@query(f"""WITH q AS ({AVG}), h AS ({HYGIENE}), a AS (SELECT avg(score) AS quality FROM q)
    SELECT round((0.35 * quality + 0.20 * (coverage + unique_share + resolution) / 3) / 0.55, 4) AS overall FROM h, a""")
def overall_grade(v):
    h = scores.hygiene(filters.live_scope(v("media")), v("caption_text"))
    a = scores.average_scores(v("score"), v("metric")).agg(F.avg("score").alias("quality"))
    both = h.join(F.broadcast(a), F.lit(True))
    return both.select(F.round(scores.overall({"quality": F.col("quality"), "hygiene": F.col("hygiene")}), 4).alias("overall"))


@query(f"""WITH q AS ({AVG}) SELECT media_id, round((row_number() OVER (ORDER BY score, media_id) - 1) * 1.0 / (SELECT count(*) - 1 FROM q), 9) AS "rank" FROM q""")
def rank_normalize(v):
    q = scores.average_scores(v("score"), v("metric")).select("media_id", r6("score"))
    return scores.rank_normalized(q, "score", "media_id").select("media_id", F.round("rank", 9).alias("rank"))


ISSUES = f"""SELECT 'lowq:' || CAST(media_id AS VARCHAR(20)) AS "key", 'lowq' AS kind, round(70 + (70 - score) / 10, 6) AS impact FROM ({AVG}) AS q WHERE score < 45
    UNION ALL SELECT 'cap:' || CAST(media_id AS VARCHAR(20)), 'cap', 40 FROM {{caption_text}} WHERE length(caption) < 200"""


@query(f"""WITH i AS ({ISSUES}) SELECT "key", kind, impact FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY impact DESC, "key") AS n FROM i) AS t WHERE n <= 40""")
def issues_ranked(v):
    return selection.ranked_issues(_issues(v))


def _issues(v):
    q = scores.average_scores(v("score"), v("metric")).select("media_id", r6("score")).filter("score < 45")
    low = q.select(F.concat(F.lit("lowq:"), F.col("media_id").cast("string")).alias("key"), F.lit("lowq").alias("kind"), F.round(70 + (70 - F.col("score")) / 10, 6).alias("impact"))
    cap = v("caption_text").filter(F.length("caption") < 200).select(F.concat(F.lit("cap:"), F.col("media_id").cast("string")), F.lit("cap"), F.lit(40.0))
    return low.union(cap)


@query(f"""WITH i AS ({ISSUES}) SELECT count(*) AS n FROM i WHERE kind = 'lowq' AND round(impact) = floor(impact)""")
def reconcile_resolutions(v):
    now = _issues(v).withColumn("fingerprint", F.round("impact").cast("long"))
    before = _issues(v).filter("kind = 'lowq'").select("key", F.floor("impact").alias("fingerprint"))
    return selection.reconciled(before, now).agg(F.count("*").alias("n"))


# hashes, vectors, groups

HASH = """WITH s AS (SELECT id, vector FROM {vector}),
  b AS (SELECT id, i, CASE WHEN vector[i + 1] > 0 THEN 1 ELSE 0 END AS p, CASE WHEN i < 63 AND vector[i + 2] > vector[i + 1] THEN 1 ELSE 0 END AS d FROM s, (SELECT unnest(range(64)) AS i) AS r),
  pairs AS (SELECT a.id AS a, c.id AS b, CAST(sum(CASE WHEN a.p <> c.p THEN 1 ELSE 0 END) AS INTEGER) AS p_dist, CAST(sum(CASE WHEN a.d <> c.d THEN 1 ELSE 0 END) AS INTEGER) AS d_dist
    FROM b AS a JOIN b AS c ON a.i = c.i AND a.id < c.id GROUP BY a.id, c.id HAVING sum(CASE WHEN a.p <> c.p THEN 1 ELSE 0 END) <= 20 AND sum(CASE WHEN a.d <> c.d THEN 1 ELSE 0 END) <= 20)"""


@query(HASH + " SELECT a, b, p_dist, d_dist FROM pairs")
def hamming_pairs(v):
    return hashes.lookalike_pairs(hashes.sign_hashes(v("vector")), 20)


@query("SELECT m.id, f.first FROM {media} AS m JOIN (SELECT sha256, min(id) AS first FROM {media} GROUP BY sha256) AS f ON m.sha256 = f.sha256 WHERE m.id <> f.first")
def exact_duplicates(v):
    return hashes.exact_duplicates(v("media"))


DOT = "list_dot_product(list_transform({0}.vector, lambda x: CAST(x AS DOUBLE)), list_transform({1}.vector, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform({0}.vector, lambda x: CAST(x AS DOUBLE)), list_transform({0}.vector, lambda x: CAST(x AS DOUBLE))) * list_dot_product(list_transform({1}.vector, lambda x: CAST(x AS DOUBLE)), list_transform({1}.vector, lambda x: CAST(x AS DOUBLE))))"
AB = DOT.format("a", "b")


@query(f"SELECT a.id AS a, b.id AS b, round({AB}, 4) AS cosine FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id WHERE {AB} >= 0.3")
def cosine_pairs(v):
    return V.cosine_pairs(v("vector"), 0.3).select("a", "b", F.round("cosine", 4).alias("cosine"))


NEAR = f"""SELECT a.id, b.id AS other, {AB} AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY {AB} DESC, b.id) AS k FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id"""


@query(f"WITH n AS ({NEAR}) SELECT id, other, round(cosine, 4) AS cosine, k AS \"rank\" FROM n WHERE k <= 3")
def knn(v):
    return V.neighbours(v("vector")).select("id", "other", F.round("cosine", 4).alias("cosine"), "rank")


@query(f"""WITH n AS ({NEAR}), d AS (SELECT id, 1 - avg(cosine) AS distance FROM n WHERE k <= 3 GROUP BY id)
    SELECT id, round(distance, 4) AS distance FROM d WHERE distance > (SELECT avg(distance) + 2.5 * stddev_pop(distance) FROM d)""")
def knn_outliers(v):
    return V.outliers(v("vector")).select("id", F.round("distance", 4).alias("distance"))


@query(f"""WITH p AS (SELECT 1 - avg({AB}) AS d FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id)
    SELECT (SELECT count(*) FROM {{vector}}) AS n, round(d, 4) AS mean_distance, round(greatest(0, least(100, 100 * (d - 0.10) / 0.45)), 4) AS spread FROM p""")
def spread_score(v):
    return V.spread(v("vector")).select("n", F.round("mean_distance", 4).alias("mean_distance"), F.round("spread", 4).alias("spread"))


@query(f"SELECT a.id, round(greatest(0, least(1, (1 - max({AB})) / 0.55)), 4) AS gain FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id WHERE b.label = 3 GROUP BY a.id")
def diversity_gain(v):
    return V.diversity_gain(v("vector"), v("vector").filter("label = 3")).select("id", F.round("gain", 4).alias("gain"))


@query(f"""SELECT query, id, cosine FROM (SELECT b.id AS query, a.id, round({AB}, 4) AS cosine, row_number() OVER (PARTITION BY b.id ORDER BY {AB} DESC, a.id) AS n
    FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id AND b.id % 50 = 0) AS t WHERE n <= 25""")
def semantic_topk(v):
    found = V.nearest(v("vector").filter("id % 50 = 0"), v("vector"), 25)
    return found.select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 4).alias("cosine"))


@query(f"""WITH c AS (SELECT a.id, max({AB}) AS cosine FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id AND b.id % 50 = 0 GROUP BY a.id)
    SELECT id, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) AS n FROM c) AS t WHERE n <= greatest(1, ceil(0.15 * (SELECT count(*) FROM c) - 1e-9))""")
def semantic_keep(v):
    own = V.best_reference(v("vector"), v("vector").filter("id % 50 = 0"))
    return V.top_share(own).select("id", F.round("cosine", 4).alias("cosine"))


@query(f"""WITH p AS (SELECT a.id AS a, b.id AS b, {AB} AS c FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id) SELECT a, b, round(c, 3) AS proximity FROM p WHERE c >= 0.35""")
def proximity_edges(v):
    return V.proximity_edges(v("vector"), v("vector"), 0.35)


@query()
def pick_clusters(v):
    return V.kmeans(v("vector"), 6)


@query()
def zones_empty(v):
    points = V.project(v("vector"))
    return V.empty_zones(points, points.join(v("vector").filter("label in (1, 2)"), "id", "left_semi"))


# selection


def _candidates(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    own = filters.live_scope(v("media")).join(v("vector").select("id", "vector", "label"), "id").join(q, "id", "left")
    return own.select("id", F.concat(F.lit("b"), (F.col("label") % 3).cast("string")).alias("bucket"), "favorite", "score", "vector")


POOL = f"""SELECT m.id, m.favorite, m.sha256, coalesce(m.width, 0) * coalesce(m.height, 0) AS area, a.score, 'b' || CAST(v.label % 3 AS VARCHAR(20)) AS bucket
    FROM {{live_media}} AS m JOIN {{vector}} AS v ON v.id = m.id LEFT JOIN ({AVG}) AS a ON a.media_id = m.id"""


@query(f"""WITH p AS ({POOL}), k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY favorite DESC, score DESC, area DESC, id) AS n FROM p WHERE score >= 20)
    SELECT id, favorite, score, bucket FROM k WHERE n = 1""")
def builder_candidates(v):
    own = _candidates(v)
    media = own.drop("bucket").join(v("media").select("id", "width", "height"), "id")
    pool, _ = greedy.prepared(media, v("media").select(F.xxhash64("sha256").alias("group_id"), "id"), own.select("id", "bucket"), 20.0)
    return pool.select("id", "favorite", "score", "bucket")


@query(f"""WITH p AS ({POOL}), k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY favorite DESC, score DESC, area DESC, id) AS n FROM p WHERE score >= 20)
    SELECT count(*) FILTER (WHERE n = 1) AS pool_size, (SELECT count(*) FROM p WHERE score < 20) AS quality_dropped, (SELECT count(*) FROM p WHERE score IS NULL) AS unscored_dropped,
    count(*) FILTER (WHERE n > 1) AS duplicates_dropped, count(*) FILTER (WHERE n = 1 AND bucket = 'unknown') AS unknown_count FROM k""")
def builder_counters(v):
    own = _candidates(v)
    media = own.drop("bucket").join(v("media").select("id", "width", "height"), "id")
    return greedy.prepared(media, v("media").select(F.xxhash64("sha256").alias("group_id"), "id"), own.select("id", "bucket"), 20.0)[1]


@query()
def builder_select(v):
    own = _candidates(v)
    media = own.drop("bucket").join(v("media").select("id", "width", "height"), "id")
    pool, _ = greedy.prepared(media, v("media").select(F.xxhash64("sha256").alias("group_id"), "id"), own.select("id", "bucket"), 20.0)
    return greedy.pick_diverse(pool, 12, {"b0": 40, "b1": 35, "b2": 25})


@query()
def studio_select(v):
    own = _candidates(v).join(v("media").select("id", "sharpness", F.xxhash64("sha256").alias("group_id")), "id")
    passes = (F.coalesce("score", F.lit(50.0)) >= 20) & F.coalesce(F.col("sharpness") >= 35, F.lit(True))
    return greedy.studio_select(own.withColumn("eligible", passes), 60, {"b0": 40, "b1": 35, "b2": 25}, forced=[4, 8], dropped=[12])


@query("""WITH w AS (SELECT o_orderpriority AS bucket, count(*) AS weight FROM orders GROUP BY 1), s AS (SELECT bucket, 100.0 * weight / sum(weight) OVER () AS share FROM w),
    f AS (SELECT bucket, floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, bucket) AS n FROM s)
    SELECT bucket, CAST(base + CASE WHEN n <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def quotas(v):
    rows = v("orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("weight")).orderBy("bucket").collect()  # one row for each priority
    found = selection.quotas(100, {r.bucket: r.weight for r in rows})
    return v.spark.createDataFrame(list(found.items()), "bucket string, quota long")


@query(f"""WITH q AS ({AVG}), o AS (SELECT media_id AS out_id, score AS out_score, row_number() OVER (ORDER BY score, media_id) - 1 AS place FROM q WHERE media_id IN (SELECT media_id FROM {{dataset_media}} WHERE dataset_id = 5)),
    n AS (SELECT media_id AS in_id, score AS in_score, row_number() OVER (ORDER BY score DESC, media_id) - 1 AS place FROM q WHERE media_id NOT IN (SELECT media_id FROM {{dataset_media}} WHERE dataset_id = 5))
    SELECT o.place, out_id, in_id FROM o JOIN n ON o.place = n.place WHERE in_score > out_score""")
def upgrade_pairs(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    links = v("dataset_media").filter("dataset_id = 5")
    return selection.upgrade_pairs(filters.within(q, links), filters.within(q, links, inside=False))


@query()
def nms_boxes(v):
    return selection.suppress(v("box"))


# folders, deploy, jobs, console


def _rules(v):
    own = v("folder").select(rules.folder_of(F.col("rel_path")).alias("rel_path")).distinct()
    h = F.pmod(F.length("rel_path"), F.lit(7))
    mode = F.when(h == 1, "exclude").when(h == 2, "sublib").otherwise("inherit")
    tags = F.array(rules.slug(F.element_at(F.split("rel_path", "/"), -1)), F.lit("web"))
    return own.select("rel_path", mode.alias("mode"), F.length("rel_path").cast("long").alias("sub_id"), tags.alias("tags"), F.when(h == 3, F.array(F.lit("web"))).alias("removed"))


RULES = r"""WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(rel_path, '[^/]*$', ''), '/$', '') AS folder FROM {folder}),
    r AS (SELECT folder AS rel_path, length(folder) % 7 AS h, length(folder) AS sub_id FROM f),
    l AS (SELECT folder, string_split(folder, '/') AS parts FROM f), a AS (SELECT folder, array_to_string(parts[1:k], '/') AS rel_path, k FROM (SELECT folder, parts, unnest(range(1, len(parts) + 1)) AS k FROM l) AS x)"""


@query(RULES + " SELECT a.folder, bool_or(coalesce(h = 1, false)) AS excluded FROM a LEFT JOIN r ON a.rel_path = r.rel_path GROUP BY a.folder")
def folder_excluded(v):
    return rules.resolved(v("folder").select(rules.folder_of(F.col("rel_path")).alias("folder")), _rules(v)).select("folder", "excluded")


@query(RULES + """, e AS (SELECT a.folder, bool_or(coalesce(h = 1, false)) AS excluded, arg_max(r.sub_id, k) FILTER (WHERE h = 2) AS owner FROM a LEFT JOIN r ON a.rel_path = r.rel_path GROUP BY a.folder)
    SELECT folder, CAST(CASE WHEN NOT excluded THEN owner END AS BIGINT) AS owner FROM e""")
def folder_owner(v):
    return rules.resolved(v("folder").select(rules.folder_of(F.col("rel_path")).alias("folder")), _rules(v)).select("folder", "owner")


@query()
def folder_effective_tags(v):
    out = rules.resolved(v("folder").select(rules.folder_of(F.col("rel_path")).alias("folder")), _rules(v), auto_depth=1)
    return out.select("folder", F.array_join("tags", ",").alias("tags"))


def _items(v):
    m = v("media")
    return m.select(F.col("id").alias("media_id"), "sha256", "file_extension", "hidden", (F.col("id") % 41 == 0).alias("missing"), (1 + F.col("id") % 3).alias("repeats"), F.col("name").alias("caption"))


WANTED = """SELECT min(media_id) AS media_id, file, min_by(caption, media_id) AS caption FROM
    (SELECT id AS media_id, sha256 || CASE WHEN i > 0 THEN '_' || CAST(i AS VARCHAR(20)) ELSE '' END || '.' || file_extension AS file, name AS caption
    FROM {media}, (SELECT unnest(range(3)) AS i) AS r WHERE NOT hidden AND id % 41 <> 0 AND i < 1 + id % 3) AS f GROUP BY file"""
PRESENT = "SELECT file, CASE WHEN media_id % 5 = 0 THEN '' ELSE caption END AS p FROM w WHERE caption NOT LIKE '%a%'"


def _present(wanted):
    return wanted.filter("caption not like '%a%'").select("file", F.when(F.col("media_id") % 5 == 0, "").otherwise(F.col("caption")).alias("caption"))


@query(f"WITH w AS ({WANTED}), p AS ({PRESENT}) SELECT w.file, CASE WHEN p.file IS NULL THEN 'write' ELSE 'rewrite' END AS action FROM w LEFT JOIN p ON w.file = p.file WHERE p.file IS NULL OR p.p <> w.caption")
def deploy_manifest_diff(v):
    wanted = deploy.manifest(_items(v))
    return deploy.difference(wanted, _present(wanted))


@query(f"""WITH w AS ({WANTED}), p AS ({PRESENT}), b AS (SELECT w.media_id, p.file IS NOT NULL AS there, coalesce(p.p = w.caption, false) AS fine FROM w LEFT JOIN p ON w.file = p.file)
    SELECT media_id, CASE WHEN bool_and(fine) THEN 'GREEN' WHEN bool_or(there) THEN 'ORANGE' ELSE 'RED' END AS status FROM b GROUP BY media_id""")
def deploy_status(v):
    wanted = deploy.manifest(_items(v))
    return deploy.status(wanted, _present(wanted))


@query("""SELECT id, CAST(greatest(1, round_even(width * s, 0)) AS BIGINT) AS w, CAST(greatest(1, round_even(height * s, 0)) AS BIGINT) AS h
    FROM (SELECT *, least(1.0, CAST(1000 AS DOUBLE) / least(width, height)) AS s FROM {media} WHERE width IS NOT NULL) AS t""")
def target_size(v):
    w, h = deploy.target_size(F.col("width"), F.col("height"), 1000)
    return v("media").filter("width is not null").select("id", w.alias("w"), h.alias("h"))


@query("""WITH r AS (SELECT *, first_value(done) OVER s AS d0, first_value(t) OVER s AS t0 FROM {job_sample} WINDOW s AS (PARTITION BY job_id ORDER BY t, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT job_id, event_id, round(CASE WHEN t > t0 AND done > d0 THEN (1000 - done) / ((done - d0) / (t - t0)) END, 4) AS eta FROM r""")
def job_eta(v):
    return jobs.eta(v("job_sample"), 1000).select("job_id", "event_id", F.round("eta", 4).alias("eta"))


@query("""SELECT date_trunc('hour', ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(v):
    return jobs.windowed_counts(v("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def console_sql(v):
    console.register(v.spark, v.sf_dir, ["customer", "nation"])
    return console.run_query(v.spark, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
