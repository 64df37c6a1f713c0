"""Lifecycles, swaps, judgements and quarantine against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.functions import quarantine
from lumenset.operators import captions, lifecycles, swaps

LOG = "zone_id long, media_id long, seq long, kind string, x double, y double, w double, h double, patch_sha string"


def zone_log(seed, n=300):
    rng = random.Random(seed)
    kinds = ["detect", "move", "patch", "restore", "delete", "unheard"]
    return [(rng.randrange(20), 7, i, rng.choice(kinds), rng.random(), rng.random(), rng.random(), rng.random(), f"p{i}") for i in range(n)]


def folded(log):
    """Each zone's state, by going through the log in order."""
    out = {}
    for zone, _, _, kind, x, y, w, h, sha in sorted(set(log), key=lambda e: e[2]):
        z = out.get(zone)
        if kind == "detect":
            out[zone] = {"box": (x, y, w, h), "patch": None, "alive": True}
        elif z is None:
            out[zone] = {"box": (x, y, w, h) if kind == "move" else None, "patch": None, "alive": False}
        elif kind == "move":
            z["box"], z["patch"] = (x, y, w, h), None
        elif kind == "patch" and z["alive"]:
            z["patch"] = sha
        elif kind == "restore":
            z["patch"] = None
        elif kind == "delete":
            z["alive"], z["patch"] = False, None
    return {k: (z["patch"], round(min(1, max(0.005, z["box"][2])), 9)) for k, z in out.items() if z["alive"]}


def states(facts):
    return {r.zone_id: (r.patch_sha, round(r.w, 9)) for r in lifecycles.zone_states(facts).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_zones_follow_their_log_in_any_order(spark, seed):
    log = zone_log(seed)
    mixed = log + log[::7]
    random.Random(seed).shuffle(mixed)
    assert states(lifecycles.zone_facts(spark.createDataFrame(mixed, LOG))) == folded(log)
    assert lifecycles.zone_states(lifecycles.zone_facts(spark.createDataFrame([], LOG))).count() == 0


def test_a_stream_of_late_and_repeated_events_agrees_with_the_table(spark, tmp_path):
    log = zone_log(9)
    late = log[200:] + log[:50] + log[40:220] + log[-5:]
    for k in range(0, len(late), 60):
        spark.createDataFrame(late[k : k + 60], LOG).coalesce(1).write.parquet(f"{tmp_path}/log/{k:04d}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    run = lifecycles.zone_facts(stream).writeStream.outputMode("complete").format("memory").queryName("zone_facts").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    assert states(spark.table("zone_facts")) == folded(log) and len(run.recentProgress) > 3


def test_crops_change_with_their_frame_and_their_parent(spark):
    events = [(10, 1, 1, "create", 0.0, 0.0, 50.0, 50.0), (11, 1, 2, "create", 0.0, 0.0, 50.0, 50.0), (12, 1, 3, "create", 5.0, 0.0, 50.0, 50.0), (13, 2, 4, "create", 0.0, 0.0, 9.0, 9.0), (13, 2, 6, "delete", None, None, None, None), (14, 99, 1, "create", 0.0, 0.0, 9.0, 9.0)]
    facts = lambda more=(): lifecycles.crop_facts(spark.createDataFrame(events + list(more), "crop_id long, parent_id long, seq long, kind string, x double, y double, w double, h double"))
    parents = lambda sha: spark.createDataFrame([(1, sha), (2, "s2")], "id long, sha256 string")
    first = {r.crop_id: r for r in lifecycles.crop_states(facts(), parents("s1")).collect()}
    assert set(first) == {10, 11, 12} and first[11].same_as == 10 and first[12].same_as == 12
    measures = spark.createDataFrame([(c, first[c].sha256, c / 2) for c in first], "media_id long, sha256 string, score double")
    moved = lifecycles.crop_states(facts([(10, 1, 9, "frame", 1.0, 1.0, 50.0, 50.0)]), parents("s1"))
    assert sorted(r.media_id for r in lifecycles.live_measures(measures, moved).collect()) == [11, 12]
    assert lifecycles.live_measures(measures, lifecycles.crop_states(facts(), parents("other"))).count() == 0


def test_crops_in_sets(spark):
    links = spark.createDataFrame([(1, 5, True, 3), (1, 6, False, 1), (2, 6, False, 2)], "dataset_id long, media_id long, hidden boolean, repeats int")
    crops = spark.createDataFrame([(50, 5), (60, 6)], "crop_id long, parent_id long")
    wanted = spark.createDataFrame([(1, 50, "replace"), (2, 50, "replace"), (2, 60, "beside"), (3, 60, "beside"), (1, 77, "beside")], "dataset_id long, crop_id long, mode string")
    out = lifecycles.placed(links, wanted, crops)
    rows = sorted(map(tuple, out.collect()))
    assert rows == [(1, 6, False, 1), (1, 50, True, 3), (2, 6, False, 2), (2, 60, False, 1), (3, 60, False, 1)]
    assert sorted(map(tuple, lifecycles.placed(out, wanted, crops).collect())) == rows
    assert sorted(map(tuple, lifecycles.removed(out, crops).collect())) == [(1, 5, False, 1), (1, 6, False, 1), (2, 6, False, 2), (3, 6, False, 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_swaps_equal_a_plain_pass(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), int(rng.integers(0, 3)), float(rng.integers(0, 4)) / 4, "") for a, b in zip(rng.integers(0, 25, 160), rng.integers(100, 120, 160))]
    seen, want = set(), {}
    rows = list({(a, b): r for a, b, *r in rows}.items())
    rows = [(a, b, *r) for (a, b), r in rows]
    for a, b, p, c, _ in sorted(rows, key=lambda r: (-r[2], -r[3], r[0], r[1])):
        if a not in seen and b not in seen:
            seen |= {a, b}
            want[a] = b
    out = swaps.assigned(spark.createDataFrame(rows, "id long, other long, points int, cosine double, why string")).collect()
    assert {r.id: r.other for r in out} == want and len(out) == len({r.other for r in out})


def test_swap_lists_rank_tags_names_and_cosines(spark):
    requests = spark.createDataFrame([(1, "Red car!"), (2, None), (3, " ?? ")], "id long, q string")
    media = spark.createDataFrame([(10, "a red one"), (11, "x"), (12, "y"), (13, "z")], "id long, name string")
    tags = spark.createDataFrame([(10, "old_car"), (11, "redcar"), (12, "tree"), (1, "red")], "media_id long, name string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (10, [0.6, 0.8]), (11, [0.0, 1.0]), (13, [1.0, 1.0])], "id long, vector array<double>")
    out = {(r.id, r.other): (r.points, round(r.cosine, 6), r.why) for r in swaps.swap_lists(requests, media, tags, vectors).collect()}
    assert out == {(1, 10): (3, 0.6, "#car"), (1, 11): (4, 0.0, "#car #red"), (2, 11): (0, 1.0, "visual neighbour"), (2, 10): (0, 0.8, "visual neighbour"), (2, 13): (0, 0.707107, "visual neighbour")}
    assert swaps.assigned(swaps.swap_lists(requests.limit(0), media, tags, vectors)).count() == 0


def plain_judgement(raw):
    start = (raw or "").find("{")
    if start < 0:
        return None
    try:
        data, _ = json.JSONDecoder().raw_decode(raw[start:])
    except ValueError:
        return None
    fixed = data.get("corrected_caption")
    return bool(data.get("violates")), str(data.get("note") or "").strip(), fixed.strip() if isinstance(fixed, str) else None


def test_judgements_match_plain_python(spark):
    texts = [None, "", "no json", '{"violates": true, "note": " bad ", "corrected_caption": " ok "}', 'Sure!\n```json\n{"violates": false, "note": "a } in { text", "corrected_caption": null}\n```\nbye {x}']
    texts += ['{"violates": "yes"}', '{"violates": ""}', '{"violates": 0}', '{"violates": 2, "note": 7}', '{"violates": [], "corrected_caption": 5}', '{"violates": {"a": {"b": 1}}, "note": "quote \\" and \\u00e9"}', '{"violates": null}', '{}']
    texts += ['{"violates": true, "note": "cut', "{broken} {\"violates\": true}", '{"violates": true} }', '{"violates": 0.0, "note": 0}', "text } before { not json"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: None if r.j is None else tuple(r.j) for r in df.select("id", captions.judgement(F.col("t")).alias("j")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_judgement(t), t


def test_one_bad_row_among_many_goes_to_quarantine(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 97 == 13, "x").otherwise(F.col("id").cast("string")).alias("t")).repartition(3)
    calls = []

    def step(frame):
        calls.append(len(frame))
        return frame.assign(n=frame["t"].astype(int) * 2)[["id", "n"]]

    good, bad = quarantine.isolated(rows, "id", step, "id long, n long")
    fails = {i for i in range(500) if i % 97 == 13}
    assert {tuple(r) for r in good.collect()} == {(i, 2 * i) for i in range(500) if i not in fails}
    assert {(r.id, r.attempts) for r in bad.collect()} == {(i, 1) for i in fails} and all("ValueError" in r.reason for r in bad.collect())
    mended = rows.withColumn("t", F.when(F.col("id") == 13, "5").otherwise(F.col("t"))).filter("id <> 110")
    good2, bad2 = quarantine.retried(mended, "id", bad, step, "id long, n long", most=2)
    assert [tuple(r) for r in good2.collect()] == [(13, 10)] and {(r.id, r.attempts) for r in bad2.collect()} == {(i, 2) for i in fails - {13, 110}}
    good3, bad3 = quarantine.retried(mended, "id", bad2, step, "id long, n long", most=2)
    assert good3.count() == 0 and {(r.id, r.attempts) for r in bad3.collect()} == {(i, 2) for i in fails - {13, 110}}
    none, nobody = quarantine.isolated(rows.limit(0), "id", step, "id long, n long")
    assert none.count() == 0 and nobody.count() == 0
