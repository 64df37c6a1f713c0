"""Media tables read out of the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.functions.rounding import rounded, steady_avg

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {name} stands for a table or another view.
VIEWS = {
    "media": """SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CASE WHEN p_partkey % 10 = 0 THEN 'mp4' ELSE 'png' END AS file_extension,
        CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(512 + (p_partkey * 37) % 2048 AS BIGINT) END AS width,
        CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(512 + (p_partkey * 53) % 2048 AS BIGINT) END AS height,
        p_partkey % 7 = 0 AS favorite, p_partkey % 11 = 0 AS hidden, p_partkey % 13 = 0 AS deleted, p_partkey % 17 = 0 AS discarded,
        CAST(p_partkey % 19 AS BIGINT) AS library_id, 'sha' || CAST(CASE WHEN p_partkey % 29 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR(20)) AS sha256,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 100 AS DOUBLE) END AS sharpness FROM {part}""",
    "live_media": "SELECT * FROM {media} WHERE NOT hidden AND NOT deleted AND NOT discarded",
    "score": """SELECT CAST(l_partkey AS BIGINT) AS media_id, 'musiq' AS metric_id, round(2 * avg(l_quantity), 6) AS score FROM {lineitem} GROUP BY l_partkey HAVING min(l_quantity) <= 3
        UNION ALL SELECT CAST(l_partkey AS BIGINT), 'topiq_nr', round(10 * avg(l_discount), 6) FROM {lineitem} GROUP BY l_partkey HAVING max(l_quantity) >= 48
        UNION ALL SELECT CAST(l_partkey AS BIGINT), 'laion_aes', round(1 + 9 * avg(l_tax) / 0.08, 6) FROM {lineitem} GROUP BY l_partkey HAVING count(*) >= 27""",
    "metric": """SELECT 'musiq' AS metric_id, CAST(0 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi UNION ALL SELECT 'topiq_nr', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
        UNION ALL SELECT 'laion_aes', CAST(1 AS DOUBLE), CAST(10 AS DOUBLE)""",
    "media_tag": """SELECT DISTINCT media_id, name, source FROM (SELECT CAST(p_partkey AS BIGINT) AS media_id, p_brand AS name, 'library' AS source FROM {part}
        UNION ALL SELECT CAST(p_partkey AS BIGINT), p_type, CAST(NULL AS VARCHAR(20)) FROM {part}
        UNION ALL SELECT CAST(p_partkey AS BIGINT), split_part(p_name, ' ', 1), CAST(NULL AS VARCHAR(20)) FROM {part}) AS t WHERE name <> ''""",
    "tag": "SELECT name, CAST(count(*) AS BIGINT) AS usage FROM {media_tag} GROUP BY name",
    "dataset_media": "SELECT DISTINCT CAST(o_custkey % 20 AS BIGINT) AS dataset_id, CAST(l_partkey AS BIGINT) AS media_id, l_partkey % 31 = 0 AS hidden FROM {orders} AS o JOIN {lineitem} AS l ON o_orderkey = l_orderkey WHERE l_linenumber = 1",
    "media_file": """SELECT CAST(p_partkey * 10 + k AS BIGINT) AS file_id, CAST(p_partkey AS BIGINT) AS media_id, 'lib' || CAST(p_partkey % 19 AS VARCHAR(20)) || '/d' || CAST(k AS VARCHAR(20)) || '/' || CAST(p_partkey AS VARCHAR(20)) || '.png' AS path,
        (p_partkey + k) % 3 <> 0 AS present FROM {part} AS p JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS n ON p_size <> 37""",
    "revision": "SELECT CAST(conv_id AS BIGINT) AS caption_id, CAST(turn AS BIGINT) AS revision_id, text AS content FROM {conversations}",
    "caption": "SELECT caption_id, max(revision_id) AS head FROM {revision} GROUP BY caption_id",
    "pin": "SELECT caption_id, CASE WHEN caption_id % 6 = 0 THEN 'pinned' ELSE 'follow' END AS mode, min(revision_id) AS revision_id FROM {revision} GROUP BY caption_id HAVING count(*) >= 7",
    "caption_text": "SELECT CAST(doc_id AS BIGINT) AS media_id, coalesce(text, '') AS caption FROM {documents}",
    "caption_score": """SELECT CAST(d.doc_id AS BIGINT) AS media_id, CASE WHEN d.doc_id % 2 = 0 THEN 'full' ELSE 'tags' END AS kind, CAST((d.doc_id * 31 + quality * 17) % 100 AS DOUBLE) AS score,
        CASE WHEN d.doc_id % 9 = 0 THEN 'old' ELSE 'siglip' END AS model_id FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id""",
    "claim": """SELECT CAST(doc_id AS BIGINT) AS media_id, k AS claim_no, CAST((doc_id * 13 + k * 41) % 100 AS DOUBLE) AS score, (doc_id + k) % 8 = 0 AS rejected FROM {labels}
        JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS n ON quality = 1 OR k < 2""",
    "vector": "SELECT CAST(vec_id AS BIGINT) AS id, embedding AS vector, label FROM {embeddings}",
    "folder": """SELECT CAST(page_id AS BIGINT) AS file_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?].*$', '') AS rel_path FROM {pages}""",
    "job_sample": "SELECT CAST(user_id AS BIGINT) AS job_id, CAST(event_id AS BIGINT) AS event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) * (1 + event_id % 3) AS DOUBLE) AS done, CAST(event_id AS DOUBLE) AS t FROM {events}",
    "box": """SELECT CAST(l_orderkey AS BIGINT) AS media_id, CAST(l_linenumber AS BIGINT) AS box_no, CAST((l_partkey * 7) % 60 AS DOUBLE) AS x, CAST((l_suppkey * 11) % 60 AS DOUBLE) AS y,
        CAST(10 + l_quantity AS DOUBLE) AS w, CAST(10 + l_quantity AS DOUBLE) AS h, CAST(l_discount * 1000 + l_linenumber AS DOUBLE) AS score FROM {lineitem}""",
    "zone": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS zone_id, CAST(l_partkey AS BIGINT) AS media_id, CAST((l_partkey * 7) % 100 AS DOUBLE) / 100 AS x, CAST((l_suppkey * 11) % 100 AS DOUBLE) / 100 AS y,
        CAST((l_orderkey * 3) % 64 AS DOUBLE) / 64 AS w, CAST(l_linenumber AS DOUBLE) / 8 AS h, CASE WHEN l_orderkey % 3 = 0 THEN 'detected' ELSE 'patched' END AS status,
        CAST(4 + l_linenumber AS BIGINT) AS dilate_px, 'patch' || CAST(l_orderkey AS VARCHAR(20)) AS patch_sha FROM {lineitem}""",
    "review": "SELECT caption_id, revision_id, CASE WHEN (caption_id + revision_id) % 4 = 0 THEN 'integrity' ELSE 'ok' END AS status FROM {revision} WHERE length(content) > 100",
    "finding": "SELECT CAST(event_id AS BIGINT) AS finding_id, CAST(user_id % 50 AS BIGINT) AS dataset_id, CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM {events}",
}


def score(lineitem: DataFrame) -> DataFrame:
    """The view ``score`` in one pass over its lines, rounded as DuckDB rounds. Means don't depend on the order of lines (DuckDB's do, in the last bit)."""
    parts = lineitem.groupBy(F.col("l_partkey").cast("long").alias("media_id")).agg(
        *[steady_avg(F.col(c)).alias(k) for c, k in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"))], F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count("*").alias("n")
    )
    metrics = [
        (F.col("least") <= 3, "musiq", 2 * F.col("q")),
        (F.col("most") >= 48, "topiq_nr", 10 * F.col("d")),
        (F.col("n") >= 27, "laion_aes", 1 + 9 * F.col("t") / 0.08),
    ]
    found = F.array(*[F.when(has, F.struct(F.lit(name).alias("metric_id"), rounded(x, 6).alias("score"))) for has, name, x in metrics])
    return parts.select("media_id", F.explode(F.array_compact(found)).alias("s")).select("media_id", "s.*")


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "score":
            return score(self("lineitem"))
        sql = VIEWS[name]
        return self.spark.sql(sql, **{x: self(x) for x in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})


def with_views(sql: str) -> str:
    """``sql`` after common table expressions for the views that it names as {view}."""
    found: dict[str, str] = {}

    def visit(text: str) -> str:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in found:
                body = visit(VIEWS[name])
                found[name] = body
        return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"v_{m[1]}", text)

    main = visit(sql)
    parts = [f"v_{k} AS ({v})" for k, v in found.items()]
    if not parts:
        return main
    head = "WITH RECURSIVE " if main.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^\s*WITH( RECURSIVE)?\s", ", ", main, flags=re.I) if re.match(r"\s*WITH\s", main, re.I) else " " + main
    return head + ", ".join(parts) + rest
