"""Structure repair, hard negatives and the permutation index against plain Python, with null, empty, tied and repeated rows and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.llm import negatives, permutation, queries, repair
from lumenset.llm.blocks import usable

# op11


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_repair(rows):
    """The counts, cost, audit and repaired rows of one conversation, by a table of the best of each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip("\x20\t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def put(best, state, entry):
        if state not in best or entry[:2] < best[state][:2]:
            best[state] = entry

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (c, a, out) in list(best.items()):
                for r in after[state]:
                    if r != "s":
                        put(best, r, (c + 5, a + "I", [*out, (names[r], "", "I")]))
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (c, a, out) in inserted(best).items():
            put(new, state, (c + 2, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for r in after[state]:
                if role[:1] == r:
                    put(new, r, (c + more, a + "K", [*out, (role, text, "K")]))
                if r != "s":
                    put(new, r, (c + 1 + more, a + "R", [*out, (names[r], text, "R")]))
        best = new
    best = inserted(best)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    n = Counter(faults)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit), out


def talk(seed, n=120):
    rng, rows = np.random.default_rng(seed), []
    for conv in range(n):
        turn = 0
        for _ in range(int(rng.integers(0, 14))):
            turn += int(rng.integers(1, 3))
            role = rng.choice(["user", "assistant", "system", "tool", "user", "assistant"])
            text = rng.choice(["Hello there.", "So be it!", "no end", " \t", "", "Why?  ", f"line {turn}.", "cut, here\n"])
            rows.append((conv, turn, str(role), str(text)))
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_match_plain_python(spark, seed):
    rows = talk(seed) + [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "system", "Be brief."), (900, None, "user", "Q?"), (901, 4, "", "A."), (902, 1, "user", "x." * 30_000)]
    rows += [(903, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(700)] + [(904, 2, "system", "Only me.")]
    frame = spark.createDataFrame(rows, CONV).withColumns({"n": F.lit(7), "audit": F.lit("x"), "h1": F.lit(1)})
    by = defaultdict(list)
    for conv, *rest in plain_damage(rows):
        by[conv].append(tuple(rest))
    got = repair.report(repair.damaged(frame)).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        want, out = plain_repair(by[r.conv_id])
        assert tuple(r[:6]) [1:] + (r.cost, r.audit) == want, r.conv_id
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in out).encode()).hexdigest()
        if not by[r.conv_id]:
            assert (r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_have_the_pattern(spark):
    rows = talk(3, 60) + [(7, 1, "user", "Hello there."), (7, 1, "user", "Hello there.")]
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    got = defaultdict(list)
    for r in repair.repaired(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "place").collect():
        assert r.place == len(got[r.conv_id])
        got[r.conv_id].append((r.role, r.text, r.edit))
    for conv, own in by.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] for r in got[conv]))
        if conv != 7:  # equal turns come by role and hash
            assert got[conv] == plain_repair(own)[1]


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONV)
    assert repair.report(repair.damaged(none)).count() == 0 and repair.repaired(none).count() == 0


def test_ropes_order_as_their_texts():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("KRDI"), int(rng.integers(0, 40)))) for _ in range(60)]
    ropes = []
    for t in texts:
        cut = sorted(int(x) for x in rng.integers(0, len(t) + 1, 3))
        parts = [repair.Rope(t[a:b]) for a, b in zip([0, *cut], [*cut, len(t)])]
        ropes.append((parts[0] + parts[1]) + (parts[2] + parts[3]))
    assert [str(r) for r in ropes] == texts
    assert all((a < b) == (str(a) < str(b)) for a in ropes for b in ropes)


def test_rules_solve_long_sequences_as_their_parts_do():
    rng = np.random.default_rng(6)
    plain, grammar = repair.Grammar([]), repair.Grammar(["ua", chr(repair.FIRST) * 2, "aD", "Uu"])
    for n in (0, 1, 5, 300):
        s = "".join(rng.choice(list("uauauasDxUA"), n))
        assert plain.solve(s) == grammar.solve(s)
    assert grammar.solve("ua" * 50_000) == (0, "K" * 100_000)


# op12


def plain_negatives(rows):
    out, own = [], [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    for i, (a, label, v) in own:
        if a % 50:
            continue
        scored = sorted(((int(np.dot(v, w)), b, j, m) for j, (b, m, w) in own if j != i), key=lambda x: (-x[0], x[1], x[2]))
        for p, b, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a, b, k + 1, x[1], p, x[0]) for k, x in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize("shape", ["spread", "common", "ties"])
def test_hard_negatives_match_all_products(spark, shape):
    rng = np.random.default_rng(7)
    v = rng.integers(-9, 10, (900, 6)).astype(float)
    if shape == "common":  # a third is one vector, and one label has most rows
        v[::3] = v[0]
    elif shape == "ties":
        v = rng.integers(-1, 2, (900, 6)).astype(float)
    label = [0 if shape == "common" and i % 10 else int(rng.integers(0, 4)) for i in range(900)]
    rows = [(i, label[i], v[i].tolist()) for i in range(900)]
    rows += [(1000, None, [1.0] * 6), (1050, 1, None), (1100, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, 1, [float("nan")] * 6), (None, 1, [1.0] * 6), (1200, 9, [3.0] * 6), (1250, 1, [0.0] * 6), rows[50], rows[51]]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({"uid": F.lit(1), "grp": F.lit(1), "id": F.lit(2)})
    for group, block in ((1024, 32_768), (4, 100)):
        got = negatives.mine(frame.drop("id"), F.col("id") % 50 == 0, group=group, block=block).collect()
        assert Counter(map(tuple, got)) == plain_negatives(rows)
    assert negatives.mine(frame.limit(0), F.col("id") % 50 == 0).count() == 0


def test_bounds_hold_and_end_walks():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3000, 8)) + 4 * np.eye(8)[rng.integers(0, 8, 3000)]
    members = rows[:40] + rng.normal(size=(40, 8)) * 0.05
    order, bound = negatives.shared_list(members[:1], rows, members[0] / np.linalg.norm(members[0]))
    assert (np.linalg.norm(members[0]) * bound + 1e-6 >= rows[order] @ members[0]).all() and (np.diff(bound) <= 0).all()
    seen = []
    negatives._walk(members[:1], rows, members[0] / np.linalg.norm(members[0]), lambda: np.array([np.sort(rows @ members[0])[-5]]), lambda a, part, s: seen.append(len(part)))
    assert sum(seen) < len(rows) / 2


# op13


def test_neighbours_match_brute_force(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in frame.collect()]
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got, hit, n = defaultdict(list), 0, 0
    for r in queries.op13_permutation_index(spark, data).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        near = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[ids == i][0], abs=1e-12) for i, s in got[q])
        hit, n = hit + len({i for i, _ in got[q]} & set(near)), n + 10
    assert hit >= 0.9 * n and set(got) == set(ids[ids % 100 == 0])


@pytest.mark.parametrize("block", [32_768, 300])
def test_recall_over_many_blocks(spark, block):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[0] + rng.normal(size=(1000, 24)) * 1e-3  # a third lies in one place
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    index = permutation.build_index(frame)
    assert index.count() == 3000
    got = defaultdict(list)
    for r in permutation.search(index, F.col("id") % 100 == 0, block=block).collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 3000, 100):
        near = [int(i) for i in np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable") if i != q][:10]
        hit += len(set(near) & set(got[q]))
    assert hit >= 0.9 * 300


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"places": F.lit("x"), "uid": F.lit(0)})
    assert frame.filter(usable("embedding")).count() == 7
    got = permutation.search(permutation.build_index(frame), F.col("id") % 100 == 0, k=3).collect()
    want = [(0, 1, 6, 0.0), (0, 2, 100, 0.0), (0, 3, 100, 0.0)] + [(100, 1, 0, 0.0), (100, 2, 6, 0.0), (100, 3, 100, 0.0)] * 2
    assert Counter(map(tuple, got)) == Counter(want)
    assert permutation.search(permutation.build_index(frame.limit(0)), F.col("id") % 100 == 0).count() == 0


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(10)
    places = np.stack([rng.permutation(12)[:5] for _ in range(40)]).astype("<u2")
    query = places[3]
    plain = [sum(abs(list(p).index(x) - k) if x in p else 5 for k, x in enumerate(query)) for p in places]
    assert permutation.InvertedFiles(places).footrule(query).tolist() == plain
