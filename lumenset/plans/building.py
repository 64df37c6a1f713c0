"""Queries of the catalog: composing a set, applying folder mappings, sweeps, replays, issues and swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenset.functions.storage import materialize
from lumenset.operators import captions as C
from lumenset.operators import compose, filters, issues, lifecycles, report, rules, scores, snapshots, swaps, sweeps
from lumenset.operators import vectors as V
from lumenset.plans.catalog import AB, AVG, NEAR, ORACLES, query, r6

# the composer's preview

#: What the other sets propose to the first one: their members come, hidden ones that it has go.
PROPOSALS = """SELECT DISTINCT d.dataset_id AS proposal_id, d.media_id AS id, CASE WHEN b.media_id IS NULL THEN 1 ELSE -1 END AS sign FROM {dataset_media} AS d
    LEFT JOIN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 0) AS b ON b.media_id = d.media_id WHERE d.dataset_id > 0 AND (b.media_id IS NULL OR d.hidden)"""
COMPOSED = f"""p AS ({PROPOSALS}), base AS (SELECT media_id AS id FROM {{dataset_media}} WHERE dataset_id = 0), ids AS (SELECT DISTINCT proposal_id FROM p),
    info AS (SELECT m.id, m.sha256, a.score, v.vector IS NOT NULL AS has FROM {{media}} AS m LEFT JOIN ({AVG}) AS a ON a.media_id = m.id LEFT JOIN {{vector}} AS v ON v.id = m.id),
    refs AS (SELECT i.proposal_id, b.id, 0 AS sign FROM ids AS i JOIN base AS b ON TRUE LEFT JOIN p ON p.proposal_id = i.proposal_id AND p.id = b.id WHERE p.id IS NULL UNION ALL SELECT proposal_id, id, 1 FROM p WHERE sign = 1
      UNION ALL SELECT NULL, id, 0 FROM base),
    unit AS (SELECT id, unnest(range(1, len(vector) + 1)) AS i, unnest(list_transform(vector, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform(vector, lambda x: CAST(x AS DOUBLE)), list_transform(vector, lambda x: CAST(x AS DOUBLE)))) AS x FROM {{vector}}),
    axes AS (SELECT proposal_id, i, sum(x) AS s FROM refs JOIN unit ON unit.id = refs.id GROUP BY proposal_id, i), len AS (SELECT proposal_id, sum(s * s) AS ss FROM axes GROUP BY proposal_id),
    near AS (SELECT a.id AS a, b.id AS b FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id <> b.id WHERE {AB} >= 0.35),
    dup AS (SELECT proposal_id, count(*) AS n FROM (SELECT DISTINCT r.proposal_id, r.id FROM refs AS r JOIN info AS x ON x.id = r.id JOIN info AS y ON y.sha256 = x.sha256 AND y.id <> x.id JOIN refs AS o ON o.proposal_id = r.proposal_id AND o.id = y.id WHERE r.sign = 1
      UNION SELECT r.proposal_id, r.id FROM refs AS r JOIN near ON near.a = r.id JOIN refs AS o ON o.proposal_id = r.proposal_id AND o.id = near.b WHERE r.sign = 1) AS t GROUP BY proposal_id),
    sums AS (SELECT r.proposal_id, avg(score) AS quality, count(*) FILTER (WHERE has) AS nv, count(*) AS total, count(*) FILTER (WHERE sign = 1) AS comes, count(*) FILTER (WHERE sign = 1 AND coalesce(score, 0) < 70) AS low FROM refs AS r JOIN info ON info.id = r.id GROUP BY r.proposal_id),
    pil AS (SELECT s.*, CASE WHEN nv > 1 THEN greatest(0, least(100, 100 * (1 - (ss - nv) / (nv * (nv - 1)) - 0.10) / 0.45)) END AS diversity, greatest(0, 100 - 22.0 * coalesce(d.n, 0)) AS hygiene, coalesce(d.n, 0) AS duplicates
      FROM sums AS s LEFT JOIN len AS l ON l.proposal_id IS NOT DISTINCT FROM s.proposal_id LEFT JOIN dup AS d ON d.proposal_id = s.proposal_id),
    graded AS (SELECT *, (0.35 * coalesce(quality, 0) + 0.30 * coalesce(diversity, 0) + 0.20 * hygiene) / (CASE WHEN quality IS NULL THEN 0 ELSE 0.35 END + CASE WHEN diversity IS NULL THEN 0 ELSE 0.30 END + 0.20) AS score FROM pil)"""


def _composed(v):
    base = v("dataset_media").filter("dataset_id = 0").select(F.col("media_id").alias("id"))
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    media = v("media").select("id").join(q, "id", "left").join(v("vector").select("id", "vector"), "id", "left")
    return media, base, v.spark.sql(PROPOSALS, dataset_media=v("dataset_media"))


@query(f"""WITH {COMPOSED} SELECT g.proposal_id, round(g.quality, 4) AS quality, round(g.diversity, 4) AS diversity, g.hygiene, CAST(g.duplicates AS BIGINT) AS duplicates, round(b.quality, 4) AS base_quality, round(b.diversity, 4) AS base_diversity,
    round(g.score, 4) AS score, round(b.score, 4) AS base_score, round(g.score - b.score, 4) AS delta, CASE WHEN g.score >= 90 THEN 'A' WHEN g.score >= 83 THEN 'B+' WHEN g.score >= 75 THEN 'B' WHEN g.score >= 65 THEN 'C' ELSE 'D' END AS grade,
    b.total AS base, g.comes, b.total + g.comes - g.total AS goes, g.total, g.total > 150 AS over, least(100, 100.0 * g.total / 160) AS percent, g.low AS low_quality
    FROM graded AS g JOIN graded AS b ON b.proposal_id IS NULL WHERE g.proposal_id IS NOT NULL""")
def compose_preview(v):
    media, base, proposals = _composed(v)
    groups = v("media").select("id", F.xxhash64("sha256").alias("group_id"))
    named = base.select("id").union(proposals.select("id")).distinct()  # a pair counts only if both are in the set or in a proposal
    near = V.cosine_pairs(v("vector").join(named, "id", "left_semi"), 0.35).select("a", "b")
    out = compose.preview(media, base, proposals, groups, near)
    rounded = ("quality", "diversity", "base_quality", "base_diversity", "score", "base_score", "delta")
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else c for c in out.columns])


@query(f"""WITH p AS ({PROPOSALS}), base AS (SELECT media_id AS id FROM {{dataset_media}} WHERE dataset_id = 0), k AS (SELECT id, 'f' || CAST(label AS VARCHAR(20)) AS bucket FROM {{vector}}),
    rows_ AS (SELECT i.proposal_id, coalesce(k.bucket, 'unknown') AS bucket, 1 AS base, 0 AS added FROM (SELECT DISTINCT proposal_id FROM p) AS i JOIN base ON TRUE LEFT JOIN k ON k.id = base.id
      UNION ALL SELECT p.proposal_id, coalesce(k.bucket, 'unknown'), 0, sign FROM p LEFT JOIN k ON k.id = p.id),
    s AS (SELECT proposal_id, bucket, CAST(sum(base) AS BIGINT) AS base, CAST(sum(added) AS BIGINT) AS added FROM rows_ GROUP BY proposal_id, bucket)
    SELECT *, base + added AS total, round(100.0 * (base + added) / sum(base + added) OVER (PARTITION BY proposal_id), 4) AS share, 100.0 * (base + added) / sum(base + added) OVER (PARTITION BY proposal_id) < 10 AS under FROM s""")
def compose_framing(v):
    media, base, proposals = _composed(v)
    buckets = v("vector").select("id", F.concat(F.lit("f"), F.col("label").cast("string")).alias("bucket"))
    return compose.framing(media, base, proposals, buckets).withColumn("share", F.round("share", 4))


# folder mappings

FOLDERS = r"SELECT regexp_replace(regexp_replace(rel_path, '[^/]*$', ''), '/$', '') AS folder FROM {folder}"
#: The rules before and after a mapping is applied: what a folder's name and its number of files make of it.
MAPPED = rf"""files AS ({FOLDERS}), sizes AS (SELECT folder, count(*) AS n FROM files GROUP BY folder),
    climb AS (SELECT folder AS descendant, folder AS ancestor FROM sizes UNION SELECT descendant, CASE WHEN contains(ancestor, '/') THEN regexp_replace(ancestor, '/[^/]*$', '') ELSE '' END FROM climb WHERE ancestor <> ''),
    tree AS (SELECT descendant, ancestor, CASE WHEN ancestor = '' THEN 0 ELSE 1 + length(ancestor) - length(replace(ancestor, '/', '')) END AS depth FROM climb),
    node AS (SELECT DISTINCT ancestor AS rel_path FROM tree WHERE ancestor <> ''),
    before_ AS (SELECT rel_path, CASE WHEN contains(rel_path, '.example.net') THEN 'sublib' WHEN contains(rel_path, '.example.org/de') THEN 'exclude' ELSE 'keep' END AS mode FROM node),
    after_ AS (SELECT rel_path, CASE WHEN contains(rel_path, '.example.net/') OR ends_with(rel_path, '.example.com') THEN 'sublib' WHEN ends_with(rel_path, '/fr') THEN 'exclude' ELSE 'keep' END AS mode FROM node),
    o1 AS (SELECT descendant AS folder, arg_max(ancestor, depth) FILTER (WHERE mode = 'sublib') AS owner, coalesce(bool_or(mode = 'exclude'), false) AS excluded FROM tree LEFT JOIN before_ ON rel_path = ancestor GROUP BY descendant),
    o2 AS (SELECT descendant AS folder, arg_max(ancestor, depth) FILTER (WHERE mode = 'sublib') AS owner, coalesce(bool_or(mode = 'exclude'), false) AS excluded FROM tree LEFT JOIN after_ ON rel_path = ancestor GROUP BY descendant)"""


def _mapping(v):
    files = v("folder").select(rules.folder_of(F.col("rel_path")).alias("folder"))
    node = rules.closure(files).select(F.col("ancestor").alias("rel_path")).filter("rel_path <> ''").distinct()
    p = F.col("rel_path")
    before = F.when(p.contains(".example.net"), "sublib").when(p.contains(".example.org/de"), "exclude").otherwise("keep")
    after = F.when(p.contains(".example.net/") | p.endswith(".example.com"), "sublib").when(p.endswith("/fr"), "exclude").otherwise("keep")
    return files, node.select("rel_path", before.alias("mode")), node.select("rel_path", after.alias("mode"))


@query(f"WITH RECURSIVE {MAPPED} SELECT ancestor, descendant, depth FROM tree")
def folder_closure(v):
    return rules.closure(_mapping(v)[0]).select("ancestor", "descendant", "depth")


@query(f"""WITH RECURSIVE {MAPPED}, h1 AS (SELECT owner, CAST(sum(n) AS BIGINT) AS n FROM o1 JOIN sizes ON sizes.folder = o1.folder WHERE NOT excluded GROUP BY owner), h2 AS (SELECT owner, CAST(sum(n) AS BIGINT) AS n FROM o2 JOIN sizes ON sizes.folder = o2.folder WHERE NOT excluded GROUP BY owner),
    s AS (SELECT rel_path, b.mode = 'sublib' AS was, a.mode = 'sublib' AS now FROM before_ AS b JOIN after_ AS a USING (rel_path))
    SELECT rel_path, CASE WHEN NOT was THEN 'create' WHEN NOT now THEN 'prune' ELSE 'keep' END AS action, coalesce(h1.n, 0) AS files_before, coalesce(h2.n, 0) AS files_after FROM s LEFT JOIN h1 ON h1.owner = rel_path LEFT JOIN h2 ON h2.owner = rel_path WHERE was OR now""")
def mapping_applied(v):
    return rules.applied_mapping(*_mapping(v))


@query(f"""WITH RECURSIVE {MAPPED} SELECT o1.folder, CASE WHEN NOT o1.excluded THEN o1.owner END AS was, CASE WHEN NOT o2.excluded THEN o2.owner END AS now, o1.excluded AS was_excluded, o2.excluded AS now_excluded FROM o1 JOIN o2 ON o1.folder = o2.folder
    WHERE CASE WHEN NOT o1.excluded THEN o1.owner END IS DISTINCT FROM CASE WHEN NOT o2.excluded THEN o2.owner END OR o1.excluded <> o2.excluded""")
def mapping_rerouted(v):
    files, before, after = _mapping(v)
    return rules.rerouted(files, before, after)


# sweeps

CLEANED = """t AS (SELECT caption_id AS media_id, revision_id, coalesce(content, '') AS content FROM {revision}), m AS (SELECT id FROM {media} UNION SELECT DISTINCT caption_id FROM {revision}),
    gone AS (SELECT 'media' AS category, id AS a, 0 AS b, 0 AS bytes FROM m WHERE id NOT IN (SELECT media_id FROM {media_file}) AND id NOT IN (SELECT media_id FROM {dataset_media})
      UNION ALL SELECT 'dataset_captions', media_id, 0, sum(octet_length(encode(content))) FROM t WHERE media_id NOT IN (SELECT media_id FROM {dataset_media}) GROUP BY media_id
      UNION ALL SELECT 'captions', media_id, revision_id, octet_length(encode(content)) FROM t WHERE (media_id, revision_id) NOT IN (SELECT caption_id, head FROM {caption} UNION SELECT caption_id, revision_id FROM {pin}))"""


def _marks(v):
    revisions = v("revision").select(F.col("caption_id").alias("media_id"), "revision_id", F.coalesce("content", F.lit("")).alias("content"))
    media = v("media").select("id").union(revisions.select("media_id")).distinct()
    heads = v("caption").select(F.col("caption_id").alias("media_id"), F.col("head").alias("revision_id"))
    return sweeps.marked(media, v("media_file"), v("dataset_media"), revisions, heads, v("pin").select(F.col("caption_id").alias("media_id"), "revision_id"))


@query(f"""WITH {CLEANED}, w AS (SELECT 'quality' AS category, count(*) AS n, 8 * count(*) AS bytes FROM {{score}} UNION ALL SELECT 'embeddings', count(*), sum(4 * len(vector)) FROM {{vector}} UNION ALL SELECT 'claims', count(*), 8 * count(*) FROM {{claim}}),
    s AS (SELECT c.category, count(a) AS n, coalesce(sum(bytes), 0) AS bytes FROM (SELECT unnest(['media', 'captions', 'dataset_captions']) AS category) AS c LEFT JOIN gone AS g ON g.category = c.category GROUP BY c.category)
    SELECT category, CAST(n AS BIGINT) AS n, CAST(bytes AS BIGINT) AS bytes, true AS vacuumed FROM (SELECT * FROM s UNION ALL SELECT * FROM w) AS x""")
def cleanup_report(v):
    whole = {"quality": (v("score"), F.lit(8)), "embeddings": (v("vector"), 4 * F.size("vector")), "claims": (v("claim"), F.lit(8))}
    return sweeps.cleanup_report(_marks(v), whole)


@query(f"""WITH {CLEANED} SELECT media_id, revision_id, content FROM t WHERE (media_id, revision_id) NOT IN (SELECT a, b FROM gone WHERE category = 'captions') AND media_id NOT IN (SELECT a FROM gone WHERE category = 'dataset_captions')""")
def cleanup_purge(v):
    gone = sweeps.swept(_marks(v))
    revisions = v("revision").select(F.col("caption_id").alias("media_id"), "revision_id", F.coalesce("content", F.lit("")).alias("content"))
    return sweeps.purged(sweeps.purged(revisions, gone, "captions", b="revision_id"), gone, "dataset_captions")


# replays

#: The library as it was before the last days, and now: each part's lines.
LINES = "SELECT CAST(l_partkey AS BIGINT) AS id, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
REPLAYED = """SELECT i.id, p_brand AS bucket, i.n, round(i.score, 4) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY i.score DESC, i.id) AS place
    FROM (SELECT CAST(l_partkey AS BIGINT) AS id, count(*) AS n, 2 * avg(l_quantity) AS score FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_shipdate >= '2001-10-28') GROUP BY l_partkey) AS i JOIN part ON p_partkey = i.id"""


@query(f"SELECT id, bucket, n, score, place FROM ({REPLAYED}) AS r WHERE place <= 5")
def recipe_replay(v):
    """The five best parts of each brand after lines came and went: only changed parts are scored anew, and only their brands picked anew."""
    line = v("lineitem").select(F.col("l_partkey").cast("long").alias("id"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("2001-10-28").cast("timestamp_ntz")
    old, new = line.filter(~late | (F.col("l_returnflag") == "R")), line.filter(~(late & (F.col("l_returnflag") == "R")))
    brands = v("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("bucket"))
    scored = lambda lines: lines.groupBy("id").agg(F.count("*").alias("n"), (2 * F.avg("l_quantity")).alias("score"))
    best = lambda index: scores.best_of(index.join(brands, "id"), "bucket", 5).select("id", "bucket", "n", "score", "place")
    index = materialize(scored(old), "index")
    picks = materialize(best(index), "picks")
    changed = materialize(snapshots.difference(old, new, ["id"]), "changed")
    index = snapshots.refreshed(index, changed, ["id"], lambda keys: scored(new.join(keys, "id", "left_semi")), "index")
    touched = snapshots.dependants(changed, brands, ["id"], ["bucket"])
    again = lambda keys: best(index.join(brands.join(keys, "bucket", "left_semi").select("id"), "id", "left_semi"))
    return snapshots.refreshed(picks, touched, ["bucket"], again, "picks").select("id", "bucket", "n", F.round("score", 4).alias("score"), "place")


# issues

ISSUES = f"""SELECT 'dup:' || CAST(p.a AS VARCHAR(20)) || ':' || CAST(p.b AS VARCHAR(20)) AS key, p.c AS value, 90 + greatest(0, (c - 0.35) * 100) AS impact, p.a, p.b
    FROM (SELECT a.id AS a, b.id AS b, {AB} AS c FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id) AS p WHERE c >= 0.35"""


def _pair_issues(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    known = v("vector").select("id").join(q, "id", "left").withColumn("area", F.lit(None).cast("long"))
    none = v.spark.createDataFrame([], "id long, representative long, similarity long")
    return issues.near_duplicate_issues(V.cosine_pairs(v("vector"), 0.35), none, known, 0.35)


@query(f"""WITH i AS ({ISSUES}), q AS ({AVG}) SELECT key, round(value, 4) AS value, round(impact, 3) AS impact, CASE WHEN coalesce(x.score, -1) >= coalesce(y.score, -1) THEN a ELSE b END AS keep FROM i LEFT JOIN q AS x ON x.media_id = a LEFT JOIN q AS y ON y.media_id = b""")
def pair_issues(v):
    return _pair_issues(v).select("key", F.round("value", 4).alias("value"), F.round("impact", 3).alias("impact"), F.col("ids")[0].alias("keep"))


@query(f"""WITH n AS ({NEAR}), d AS (SELECT id, 1 - avg(cosine) AS distance, string_agg(CAST(other AS VARCHAR(20)), ',' ORDER BY k) AS nearest FROM n WHERE k <= 3 GROUP BY id), l AS (SELECT avg(distance) + 1.5 * stddev_pop(distance) AS bar FROM d)
    SELECT 'out:' || CAST(id AS VARCHAR(20)) AS key, round(distance, 4) AS value, round(40 + least(20, (distance - bar) * 20), 3) AS impact, nearest FROM d, l WHERE distance > bar""".replace("FROM d, l WHERE distance > bar", "FROM d JOIN l ON distance > bar"))
def outlier_issues(v):
    out = issues.outlier_issues(v("vector"), 1.5)
    return out.select("key", F.round("value", 4).alias("value"), F.round("impact", 3).alias("impact"), F.array_join("nearest", ",").alias("nearest"))


#: What people decided in the course of time, as events tell: of a user's pair of numbers, by a digit of the value.
DECIDED = """SELECT 'u' || CAST(user_id AS VARCHAR(20)) AS key, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR(20)) AS fingerprint, CASE event_type WHEN 'click' THEN NULL ELSE event_type END AS resolution, CAST(event_id AS BIGINT) AS version FROM {events}"""
REPORTED = """SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR(20)) AS key, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR(20)) AS fingerprint, CAST(event_id AS BIGINT) + 200 AS report FROM {events}"""


@query(f"""WITH r AS ({DECIDED}), i AS ({REPORTED}), l AS (SELECT i.key, i.fingerprint, report, max(version) AS version FROM i LEFT JOIN r ON r.key = i.key AND version <= report GROUP BY i.key, i.fingerprint, report)
    SELECT l.key, l.fingerprint, report, CASE WHEN r.resolution IS NULL THEN 'open' WHEN r.fingerprint IS NOT DISTINCT FROM l.fingerprint THEN 'resolved' ELSE 'changed' END AS state,
    CASE WHEN r.fingerprint IS NOT DISTINCT FROM l.fingerprint THEN r.resolution END AS resolution, CASE WHEN r.resolution IS NOT NULL THEN l.version END AS version FROM l LEFT JOIN r ON r.key = l.key AND r.version = l.version""")
def resolutions_in_force(v):
    return issues.in_force(v.spark.sql(REPORTED, events=v("events")), v.spark.sql(DECIDED, events=v("events")))


# swaps

#: Members of the first set whose place is asked for, some with a search; newcomers are in no set's first place.
ASKED = "SELECT DISTINCT d.media_id AS id, CASE WHEN m.favorite THEN m.name END AS q FROM {dataset_media} AS d JOIN {media} AS m ON m.id = d.media_id JOIN {vector} AS v ON v.id = d.media_id WHERE d.dataset_id = 1"
NEWCOMERS = "SELECT id, name FROM {live_media} WHERE id NOT IN (SELECT media_id FROM {dataset_media} WHERE dataset_id = 1)"


@query()
def swap_candidates(v):
    asked = v.spark.sql(ASKED, dataset_media=v("dataset_media"), media=v("media"), vector=v("vector"))
    new = filters.within(filters.live_scope(v("media")), v("dataset_media").filter("dataset_id = 1"), inside=False).select("id", "name")
    out = swaps.assigned(swaps.swap_lists(asked, new, v("media_tag"), v("vector")))
    return out.select("id", "other", "points", F.round("cosine", 6).alias("cosine"), "why")


@query(f"""WITH a AS ({ASKED}), n AS ({NEWCOMERS}), t AS (SELECT DISTINCT id, unnest(string_split_regex(lower(q), '[^a-z0-9_]+')) AS token FROM a WHERE q IS NOT NULL),
    g AS (SELECT t.id, n.id AS other, count(DISTINCT token) AS k FROM t JOIN {{media_tag}} AS m ON contains(lower(m.name), token) JOIN n ON n.id = m.media_id WHERE token <> '' GROUP BY t.id, n.id),
    w AS (SELECT DISTINCT t.id, n.id AS other FROM t JOIN n ON contains(lower(n.name), token) WHERE token <> '')
    SELECT coalesce(g.id, w.id) AS id, coalesce(g.other, w.other) AS other, CAST(2 * coalesce(k, 0) + CASE WHEN w.id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS points FROM g FULL JOIN w ON w.id = g.id AND w.other = g.other WHERE coalesce(g.id, w.id) <> coalesce(g.other, w.other)""")
def swap_searches(v):
    asked = v.spark.sql(ASKED, dataset_media=v("dataset_media"), media=v("media"), vector=v("vector"))
    new = filters.within(filters.live_scope(v("media")), v("dataset_media").filter("dataset_id = 1"), inside=False).select("id", "name")
    return swaps.searched(asked.filter("q is not null"), new, v("media_tag")).select("id", "other", F.col("points").cast("int").alias("points"))


# lifecycles

#: A user's events as those of a zone: its box and patch follow from the value.
ZONE_LOG = """SELECT CAST(user_id AS BIGINT) AS zone_id, CAST(user_id AS BIGINT) AS media_id, CAST(event_id AS BIGINT) AS seq, CASE event_type WHEN 'signup' THEN 'detect' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'patch' WHEN 'error' THEN 'delete' ELSE 'restore' END AS kind,
    value / 400 AS x, value / 500 AS y, value / 300 AS w, 0.25 AS h, 'p' || CAST(event_id AS VARCHAR(20)) AS patch_sha FROM {events}"""


@query(f"""WITH e AS ({ZONE_LOG}), f AS (SELECT zone_id, max(seq) FILTER (WHERE kind IN ('detect', 'move')) AS box, max(seq) FILTER (WHERE kind = 'detect') AS made, coalesce(max(seq) FILTER (WHERE kind = 'patch'), -1) AS patch, coalesce(max(seq) FILTER (WHERE kind = 'restore'), -1) AS restored,
      coalesce(max(seq) FILTER (WHERE kind = 'delete'), -1) AS deleted, arg_max(x, seq) FILTER (WHERE kind IN ('detect', 'move')) AS x, arg_max(y, seq) FILTER (WHERE kind IN ('detect', 'move')) AS y, arg_max(w, seq) FILTER (WHERE kind IN ('detect', 'move')) AS w, arg_max(patch_sha, seq) FILTER (WHERE kind = 'patch') AS sha FROM e GROUP BY zone_id),
    s AS (SELECT *, patch > box AND patch > restored AND patch > deleted AS patched, least(1, greatest(0.005, w)) AS w2 FROM f WHERE made > deleted)
    SELECT zone_id, zone_id AS media_id, round(least(greatest(0, x), 1 - w2), 6) AS x, round(least(greatest(0, y), 0.75), 6) AS y, round(w2, 6) AS w, CAST(0.25 AS DOUBLE) AS h, CASE WHEN patched THEN 'patched' ELSE 'detected' END AS status, CASE WHEN patched THEN sha END AS patch_sha FROM s""")
def zone_states(v):
    log = v.spark.sql(ZONE_LOG, events=v("events")).withColumn("h", F.lit(0.25))
    out = lifecycles.zone_states(lifecycles.zone_facts(log))
    return out.select("zone_id", "media_id", *[F.round(c, 6).alias(c) for c in "xyw"], "h", "status", "patch_sha")


#: Judges' answers: a verdict on each caption's text, in prose and fences.
ANSWERED = "SELECT caption_id, revision_id, content, length(content) % 3 = 0 AS violates FROM {revision}"


@query(f"SELECT caption_id, revision_id, violates, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS note, CASE WHEN violates THEN trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS corrected_caption FROM ({ANSWERED}) AS a")
def judgements(v):
    a = v.spark.sql(ANSWERED, revision=v("revision"))
    verdict = F.to_json(F.struct("violates", F.col("content").alias("note"), F.when(F.col("violates"), F.col("content")).alias("corrected_caption")), {"ignoreNullFields": "false"})
    raw = F.concat(F.lit("Here it is:\n```json\n"), verdict, F.lit("\n```\nas {asked}."))
    return a.select("caption_id", "revision_id", C.judgement(raw).alias("j")).select("caption_id", "revision_id", "j.*")


# the quality report

SECOND = "list_transform(vector[1:8], lambda x: CAST(x AS DOUBLE))"
REPORT = f"""mem AS (SELECT DISTINCT dataset_id, media_id AS id FROM {{dataset_media}}), cap AS (SELECT media_id AS id, caption FROM {{caption_text}}), bad AS (SELECT media_id AS id FROM (<codes>) AS c WHERE issues <> 'empty'),
    own AS (SELECT mem.dataset_id, m.id, m.sha256, m.width, m.height, q.score, coalesce(trim(c.caption) <> '', false) AS captioned, coalesce(trim(c.caption) <> '', false) AND b.id IS NOT NULL AS bad
      FROM mem JOIN {{media}} AS m ON m.id = mem.id LEFT JOIN ({AVG}) AS q ON q.media_id = m.id LEFT JOIN cap AS c ON c.id = m.id LEFT JOIN bad AS b ON b.id = m.id),
    base AS (SELECT dataset_id, count(*) AS images, avg(score) AS quality, avg(score) FILTER (WHERE score >= 70) AS kept, count(*) FILTER (WHERE score < 70) AS low_quality, count(*) FILTER (WHERE captioned) AS captioned, count(*) FILTER (WHERE bad) AS degenerate,
      count(sha256) - count(DISTINCT sha256) AS copies, count(DISTINCT sha256) AS kinds, count(*) FILTER (WHERE width IS NOT NULL AND height IS NOT NULL) AS sized, count(*) FILTER (WHERE greatest(width, height) >= 1024 AND width IS NOT NULL AND height IS NOT NULL) AS large FROM own GROUP BY dataset_id),
    u AS (SELECT id, unnest(range(64)) AS i, unnest(list_transform(vector, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform(vector, lambda x: CAST(x AS DOUBLE)), list_transform(vector, lambda x: CAST(x AS DOUBLE)))) AS x FROM {{vector}}),
    w AS (SELECT id, unnest(range(8)) AS i, unnest({SECOND}) / sqrt(list_dot_product({SECOND}, {SECOND})) AS x FROM {{vector}}),
    far AS (SELECT dataset_id, 1 - (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) AS far FROM (SELECT dataset_id, i, sum(x) AS s, count(*) AS n FROM own JOIN u ON u.id = own.id GROUP BY dataset_id, i) AS a GROUP BY dataset_id HAVING max(n) > 1),
    deep AS (SELECT dataset_id, 1 - (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) AS deep FROM (SELECT dataset_id, i, sum(x) AS s, count(*) AS n FROM own JOIN w ON w.id = own.id GROUP BY dataset_id, i) AS a GROUP BY dataset_id HAVING max(n) > 1),
    near AS (SELECT x.dataset_id, count(*) AS near_pairs FROM (SELECT a.id AS a, b.id AS b FROM {{vector}} AS a JOIN {{vector}} AS b ON a.id < b.id WHERE {AB} >= 0.45) AS p JOIN own AS x ON x.id = p.a JOIN own AS y ON y.id = p.b AND y.dataset_id = x.dataset_id GROUP BY x.dataset_id),
    pil AS (SELECT b.*, coalesce(near_pairs, 0) AS near_pairs, greatest(0, least(100, 100 * (far - 0.10) / 0.45)) AS spread, CASE WHEN images > 1 THEN 100.0 * kinds / images END AS uniq, greatest(0, least(100, 100 * (deep - 0.05) / 0.40)) AS composition,
      (100.0 * captioned / images + 100 - 100.0 * degenerate / images + 100 - 100.0 * copies / images + CASE WHEN sized > 0 THEN 100.0 * large / sized ELSE 0 END) / CASE WHEN sized > 0 THEN 4 ELSE 3 END AS hygiene
      FROM base AS b LEFT JOIN far USING (dataset_id) LEFT JOIN deep USING (dataset_id) LEFT JOIN near USING (dataset_id)),
    rep AS (SELECT *, 0.75 * spread + 0.25 * uniq AS diversity, (0.35 * quality + 0.30 * (0.75 * spread + 0.25 * uniq) + 0.15 * composition + 0.20 * hygiene) AS overall,
      CASE WHEN low_quality > 0 AND kept IS NOT NULL THEN 0.35 * kept + 0.30 * (0.75 * spread + 0.25 * uniq) + 0.15 * composition + 0.20 * hygiene END AS projected FROM pil)"""
RATIOS = {"f0": 20.0, "f1": 30.0, "f2": 10.0, "any": 5.0}


def _report(v):
    q = scores.average_scores(v("score"), v("metric")).select(F.col("media_id").alias("id"), r6("score"))
    media = v("media").select("id", "sha256", "width", "height").join(q, "id", "left")
    members = materialize(v("dataset_media").select("dataset_id", F.col("media_id").alias("id")).distinct(), "members")
    groups = v("media").select("id", F.xxhash64("sha256").alias("group_id"))
    captions = v("caption_text").select(F.col("media_id").alias("id"), "caption")
    depth = v("vector").select("id", F.slice("vector", 1, 8).alias("vector"))
    found = report.pillars(members, media, v("vector"), depth, groups, captions, 0.45)
    buckets = v("vector").select("id", F.concat(F.lit("f"), F.col("label").cast("string")).alias("bucket"))
    return found, report.framings(members.join(v("media").select("id"), "id", "left_semi"), buckets, RATIOS)


@query(f"""WITH {REPORT} SELECT dataset_id, images, round(quality, 4) AS quality, round(spread, 4) AS spread, round(uniq, 4) AS "unique", round(diversity, 4) AS diversity, round(composition, 4) AS composition, round(hygiene, 4) AS hygiene, round(overall, 4) AS overall,
    CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 83 THEN 'B+' WHEN overall >= 75 THEN 'B' WHEN overall >= 65 THEN 'C' ELSE 'D' END AS grade, CASE WHEN overall >= 80 THEN 'ready' WHEN overall >= 65 THEN 'usable' ELSE 'needs work' END AS verdict, round(projected, 4) AS projected,
    low_quality, images - captioned AS uncaptioned, degenerate, copies, near_pairs FROM rep""", codes=ORACLES["integrity_codes"])
def quality_report(v):
    rounded = ("quality", "spread", "unique", "diversity", "composition", "hygiene", "overall", "projected")
    found = _report(v)[0]
    return found.select(*[F.round(c, 4).alias(c) if c in rounded else c for c in found.columns])


@query(f"""WITH {REPORT}, t AS (SELECT 'f0' AS bucket, 20.0 / 60 * 100 AS target UNION ALL SELECT 'f1', 50.0 UNION ALL SELECT 'f2', 10.0 / 60 * 100), k AS (SELECT own.dataset_id, coalesce('f' || CAST(v.label AS VARCHAR(20)), 'unknown') AS bucket, count(*) AS n FROM own LEFT JOIN {{vector}} AS v ON v.id = own.id GROUP BY 1, 2),
    d AS (SELECT b.dataset_id, t.bucket, coalesce(k.n, 0) AS n, 100.0 * coalesce(k.n, 0) / images AS share, target FROM base AS b JOIN t ON TRUE LEFT JOIN k ON k.dataset_id = b.dataset_id AND k.bucket = t.bucket),
    o AS (SELECT dataset_id, bucket, n, share > target AS over_, row_number() OVER (PARTITION BY dataset_id ORDER BY abs(share - target) DESC, bucket DESC) AS r FROM d WHERE abs(share - target) > 12),
    c AS (SELECT dataset_id, 0 AS p, 'Break near-dup pairs' AS head, near_pairs AS n, NULL AS detail FROM rep WHERE near_pairs > 0 UNION ALL SELECT dataset_id, 1, 'Prune the floor', low_quality, CAST(CAST(round(projected) AS BIGINT) AS VARCHAR(20)) FROM rep WHERE low_quality > 0
      UNION ALL SELECT dataset_id, 2, 'Fill the caption gaps', images - captioned + degenerate, NULL FROM rep WHERE images - captioned + degenerate > 0 UNION ALL SELECT dataset_id, 3, 'Rebalance framing', n, bucket || CASE WHEN over_ THEN ' over' ELSE ' under' END FROM o WHERE r = 1
      UNION ALL SELECT dataset_id, 4, CASE WHEN images < 20 THEN 'Grow the set' ELSE 'Curation beats volume' END, images, NULL FROM rep WHERE images < 20 OR images > 150)
    SELECT dataset_id, CAST(place AS INT) AS place, head, n, detail FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY p) - 1 AS place FROM c) AS x WHERE place < 5""", codes=ORACLES["integrity_codes"])
def report_recommendations(v):
    return report.recommendations(*_report(v))
