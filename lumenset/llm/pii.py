"""Personal data: spans of fixed patterns, and more spans by bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import discard, materialize

KINDS = ("email", "ip", "card", "phone")
#: Quantifiers give nothing back (``++``) where what follows can't match what they took, so that long runs of letters or
#: digits need neither deep recursion nor a second look; for the same reason a match begins at the end of the one before
#: (``\G``) or where no character of its first run stands in front.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
SPACE = r"[\x20\x09-\x0D]"
#: What contexts may find: a word with a digit or an at sign and something else; and numbers, digits in groups with what
#: stands between and before them.
WORDS = {
    "word": r"(?<![^\x20\x09-\x0D])(?![^\x20\x09-\x0D0-9A-Za-z@]*+[0-9][0-9().+-]*+[^\x20\x09-\x0D0-9A-Za-z@]*+(?:[\x20\x09-\x0D]|\z))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
    "run": r"(?:\G|(?<![A-Za-z0-9().+-]))[+(]*+[0-9][0-9 ().-]*+",
}
CORE = {"word": r"[A-Za-z0-9@+(](?:.*[A-Za-z0-9])?", "run": r"[+(]*[0-9](?:.*[0-9])?"}
#: What an instance of each kind may look like when its context, not its form, tells the kind.
LOOKS = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]+(?:[.:_-][0-9]+){3,}(?:[:/][0-9]+)?$",
    "card": r"^(?:[0-9][ .-]?){12,19}$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+(]{0,2}[0-9](?:[ ().-]{0,3}[0-9])*$",
}
#: So many characters on either side are looked at for the two words of a context, as far as the next match of the same kind.
NEAR = 64
#: Running values are computed within chunks of so many, and then over the chunks, so that work grows with the array.
CHUNK = 256
#: Code points of a block of text, from which parts are cut.
BLOCK = 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the kind's pattern counts."""

    def check(x: Column) -> Column:
        m, d = x["text"], _digits(x["text"])
        return {
            "email": F.lit(True),
            "ip": m.rlike(IP_PARTS),
            "card": F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)),
            "phone": F.length(d).between(8, 15),
        }[kind]

    return check


def _is_kind(i: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == i


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (non-negative longs), ``op`` over all before it, from 0 on. ``op`` is associative, with 0 as its zero."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))

    start = F.struct(zero.alias("at"), none.alias("seen"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int")),
        lambda c: F.aggregate(F.slice(values, c * CHUNK + 1, CHUNK), start, step),
    )
    bases = F.aggregate(chunks, start, lambda acc, c: step(acc, c["at"]), lambda acc: acc["seen"])
    return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(c["seen"], lambda v: op(base, v))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _placed(matches: Column, pieces: Column) -> Column:
    """The matches with their places, in code points, and what stands beside them, from the pieces of text between them."""
    sizes = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.length(m).cast("long") + F.length(p))
    rows = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), F.slice(pieces, 2, F.size(matches)).alias("q"), _running(sizes, _plus).alias("at"))

    def row(x: Column) -> Column:
        start = (x["at"] + F.length(x["p"])).cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), F.right(x["p"], F.lit(NEAR)).alias("left"), F.left(x["q"], F.lit(NEAR)).alias("right"))

    return F.transform(rows, row)


def _scan(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``into``: for each kind, and for what contexts may find, spans and the patterns of words beside them.

    ``kind`` is -1 for what is no base span and has none in it.
    """
    digit, at, plus = F.col(text).rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    guard = {"email": at, "ip": digit, "card": digit, "phone": plus & digit, "word": digit | at, "run": digit}
    patterns = PATTERNS | WORDS
    m, p, s = (f"{into}_{x}" for x in "mps")
    none_m = F.array().cast("array<string>")
    df = docs.withColumns({f"{m}_{k}": F.when(guard[k], F.regexp_extract_all(text, F.lit(x), F.lit(0))).otherwise(none_m) for k, x in patterns.items()})
    df = df.withColumns({f"{p}_{k}": F.when(F.size(f"{m}_{k}") > 0, F.split(text, x, -1)).otherwise(none_m) for k, x in patterns.items()})
    df = df.withColumns({f"{s}_{k}": _placed(F.col(f"{m}_{k}"), F.col(f"{p}_{k}")) for k in patterns})
    df = df.withColumns({f"{s}_{k}": F.filter(f"{s}_{k}", _valid(k)) for k in KINDS})

    def core(k: str) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            inner = F.regexp_extract(x["text"], CORE[k], 0)
            before = F.instr(x["text"], inner) - 1
            start, after = x["start"] + before, F.substr(x["text"], before + F.length(inner) + 1)
            left, right = F.concat(x["left"], F.left(x["text"], before)), F.concat(after, x["right"])
            return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"), inner.alias("text"), left.alias("left"), right.alias("right"))

        return run

    def other(x: Column) -> Column:
        """What may be personal data by its looks or tell that a pattern isn't of a kind, and has no base span in it."""
        digits = F.length(_digits(x["text"]))
        base = x["text"].rlike(PATTERNS["email"]) | x["text"].rlike(IP_PARTS)
        card = digits.between(16, 19) & x["text"].rlike("^[0-9](?:[ -]?[0-9])*$")
        phone = digits.between(8, 15) & x["text"].rlike(r"^\+[0-9]")
        return (F.length(x["text"]) > 0) & ~base & ~phone & ~(card & F.when(card, _luhn(_digits(x["text"]))).otherwise(F.lit(False)))

    words = F.filter(F.transform(f"{s}_word", core("word")), other)
    runs = F.filter(F.transform(f"{s}_run", core("run")), other)

    def found(kind: int) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            left = F.filter(F.split(F.lower(x["left"]), SPACE + "+"), lambda w: w != "")
            right = F.filter(F.split(F.lower(x["right"]), SPACE + "+"), lambda w: w != "")
            beside = F.array(
                F.concat(F.lit("< "), F.get(left, F.size(left) - 1)), F.concat(F.lit("< "), F.get(left, F.size(left) - 2), F.lit(" "), F.get(left, F.size(left) - 1)),
                F.concat(F.lit("> "), F.get(right, F.lit(0))), F.concat(F.lit("> "), F.get(right, F.lit(0)), F.lit(" "), F.get(right, F.lit(1))),
            )
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.filter(beside, lambda w: w.isNotNull()).alias("patterns"))

        return run

    every = F.concat(*[F.transform(f"{s}_{k}", found(i)) for i, k in enumerate(KINDS)], F.transform(words, found(-1)), F.transform(runs, found(-1)))
    return df.select(*docs.columns, every.alias(into))


def _learned(scan: DataFrame, rounds: int, support: int, trust: float, doubt: float) -> DataFrame:
    """Spans that confident contexts find: key, hash, kind, start, end, for a written table (key, hash, found).

    An instance is a distinct string; a pattern is the one or two words left of it, or right of it (lower-cased). A
    pattern's confidence in a kind is the mean score of its distinct instances: 1 for seeds of the kind, 0 for what
    neither is one nor looks like it, for others the noisy-or of the confident patterns' confidences that they have. It
    is confident from ``trust`` on, if its scores come to ``support`` times ``trust``. Scores and confidences are
    computed in turn, ``rounds`` times. A pattern with too few instances that ever could score is left out at once.
    """
    every = scan.filter(F.size("found") > 0).select("key", "hash", F.explode("found").alias("x")).select("key", "hash", "x.*")
    seen = every.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = materialize(seen.select("pattern", "text", "kind").distinct(), "pii-edges")
    looks = [F.when((F.col("kind") == i) | (F.col("kind") == -1) & F.col("text").rlike(LOOKS[k]), F.lit(i)) for i, k in enumerate(KINDS)]
    able = edges.select("pattern", "text", (F.col("kind") >= 0).alias("seed"), F.explode(F.filter(F.array(*looks), lambda k: k.isNotNull())).alias("kind"))
    size = edges.groupBy("pattern").agg(F.countDistinct("text").alias("n"))
    strong = able.groupBy("pattern", "kind").agg(F.countDistinct("text").alias("most"), F.max("seed").alias("seed")).join(size, "pattern")
    strong = strong.filter((F.col("most") >= support * trust) & (F.col("most") >= trust * F.col("n"))).select("pattern", "kind", "most", "n")
    graph = materialize(able.groupBy("pattern", "kind", "text").agg(F.max("seed").alias("seed")).join(strong, ["pattern", "kind"]), "pii-graph")
    seeds = graph.filter("seed").select("kind", "text").distinct().withColumn("score", F.lit(1.0))
    scores, good, old = seeds, None, []
    for _ in range(rounds):
        weight = F.max("n") - (1 - doubt) * (F.max("most") - F.count("*"))
        conf = graph.join(scores, ["kind", "text"]).groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), (F.sum("score") / weight).alias("conf"))
        good = materialize(conf.filter((F.col("conf") >= trust) & (F.col("sum") >= support * trust)).drop("sum"), "pii-patterns")
        own = graph.filter("not seed").join(seeds.drop("score"), ["kind", "text"], "left_anti")
        new = own.join(good, ["pattern", "kind"]).groupBy("kind", "text").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(1 - 1e-9)))))).alias("score"))
        scores = materialize(seeds.unionByName(new), "pii-scores")
        old += [good, scores]
    kept = seen.filter("kind = -1").drop("kind").join(good, "pattern")
    kept = kept.filter(reduce(lambda c, i: c.when(F.col("kind") == i, F.col("text").rlike(LOOKS[KINDS[i]])), range(len(KINDS)), F.when(F.lit(False), False)))
    best = kept.groupBy("key", "hash", "start", "end").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
    best = best.select(F.col("key").alias("k"), F.col("hash").alias("h"), F.struct((-F.col("b.k")).alias("kind"), "start", "end").alias("span"))
    more = materialize(best.groupBy("k", "h").agg(F.collect_list("span").alias("more")), "pii-more")
    discard(edges, graph, *old)
    return more


def _strings(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, trust: float = 0.8, doubt: float = 0.2, keep: bool = False) -> DataFrame:
    """Personal data in each row's whole text: ``key`` (the id), ``base`` and ``spans`` (arrays of kind number, start, end).

    ``base`` has what the fixed patterns find; ``spans`` has those and what contexts learned from them find. Offsets are
    code points, ends exclusive. A null text has no spans. Repeated rows get the same spans. With ``keep`` the columns of
    ``docs`` come too, as struct ``row``; else none but the two is read. The rows go to a written table once, and what
    contexts find is joined to it by id and a hash of the text; the patterns' graph has only words with a digit or an at
    sign, aggregated before each shuffle.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    own = docs.select(F.col(id_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("words"), *([row] if keep else []))
    own = own.withColumn("hash", F.xxhash64("words"))
    scan = materialize(_scan(own, "words", "found").drop("words"), "pii-scan")
    more = _learned(scan.select("key", "hash", "found"), rounds, support, trust, doubt)
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = scan.withColumn("base", base).join(more, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    apart = F.filter("more", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    none = F.filter("base", lambda x: x["kind"] < 0)
    return out.select("key", *(["row"] if keep else []), "base", F.concat("base", F.coalesce(apart, none)).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256 and spans, as text, for each row."""
    found = find(docs, **options)
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    more = (F.size("spans") - F.size("base")).cast("long").alias("n_learned")
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(_strings(F.col("base")), 256).alias("base_sha256"), _strings(F.col("spans")).alias("spans"), more)


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced once, by the first's kind.

    Other columns stay as they are; a null text stays null.
    """
    found = find(docs, text_col=text_col, keep=True, **options)
    text = F.col(f"row.{text_col}")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    reached = _running(F.transform(ordered, lambda x: (-x["back"]).cast("long")), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    first = lambda at: F.floor(at / BLOCK).cast("int")

    def cut(at: Column, to: Column) -> Column:
        own = F.array_join(F.slice("_blocks", first(at) + 1, first(F.greatest(to - 1, at)) - first(at) + 1), "")
        return F.substr(own, (at - first(at) * BLOCK + 1).cast("int"), (to - at).cast("int"))

    def part(x: Column) -> Column:
        start = x["x"]["start"]
        return F.when(start < x["at"], F.lit("")).otherwise(F.concat(cut(x["at"], start), F.element_at(tags, x["x"]["kind"] + 1)))

    found = found.withColumns({"_blocks": F.when(F.size("spans") > 0, blocks), "_spans": F.arrays_zip(ordered.alias("x"), reached.alias("at")), "_end": F.array_max(F.transform("spans", lambda x: x["end"]))})
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("_spans", part), ""), cut(F.col("_end"), F.length(text)))).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
