"""Quality rules: base statistics of each text and a decision list learned from labelled ones."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import free_name, release, utf8

SYMBOLS = b"#*$%&|<>"
UPPER, DIGIT, STOP = bytes(range(65, 91)), bytes(range(48, 58)), b".!?"
BLANK = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_bangs", "longest")
STRUCT = ", ".join(f"{c}: bigint" for c in COUNTS)


def counts(text: bytes) -> tuple[int, ...]:
    """The statistics of one whole text. A repeated window is one of three words found twice or more."""
    words = text.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        hit = np.fromiter((w in twice for w in windows), dtype=bool, count=len(windows))
        inside = np.zeros(n, dtype=bool)
        for i in range(3):
            inside[i : i + len(windows)] |= hit
        repeated = int(inside.sum())
    del seen
    lines = [line for line in text.split(b"\n") if line.strip(BLANK)]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        n, len(b"".join(words).decode()), without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)),
        without(UPPER), without(DIGIT), without(STOP), without(b"!"), max(map(len, words), default=0),
    )


def statistics(text_col: str = "text") -> Column:
    """The counts of the column's whole text, as a struct; null: those of an empty text."""

    @F.pandas_udf(f"struct<{STRUCT}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS))
        release()
        return out

    return run.asNondeterministic()(utf8(text_col))  # else a filter on the counts computes them twice


def features(s: str) -> dict[str, Column]:
    """What rules look at, from the struct of counts: sizes and shares, never null."""
    c = lambda name: F.col(f"{s}.{name}")
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "words": c("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_a_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "stops_a_word": share("n_stops", "n_words"),
        "bangs_a_word": share("n_bangs", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
        "longest": c("longest").cast("double"),
    }


def base_failed(s: str) -> Column:
    """Under 50 words, or more than half of them in repeated windows."""
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


@dataclass
class Rule:
    """Rejects what meets all conditions (feature, at least?, threshold)."""

    conditions: list[tuple[str, bool, float]]
    caught: int = 0
    wrong: int = 0

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, least, t in self.conditions:
            out &= (x[name] >= t) if least else (x[name] <= t)
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, t in self.conditions:
            out = out & ((columns[name] >= F.lit(t)) if least else (columns[name] <= F.lit(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if least else '<='} {t:g}" for n, least, t in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and what none holds for is kept."""

    rules: list[Rule] = field(default_factory=list)

    def number(self, s: str) -> Column:
        """The number (from 1) of the first rule that holds, 0 if none does."""
        columns, out = features(s), None
        for k, rule in enumerate(self.rules, 1):
            test = rule.column(columns)
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, steps: int) -> Rule:
    """Adds the condition with the most information gained, until no good row is left or no condition gains."""
    rule, inside = Rule([]), np.ones(len(bad), dtype=bool)
    while len(rule.conditions) < most and (n0 := int((inside & ~bad).sum())):
        p0, best = int((inside & bad).sum()), (0.0, None)
        for name, v in x.items():
            own, own_bad = v[inside], bad[inside]
            for t in np.unique(np.quantile(own, np.linspace(0, 1, steps))) if len(own) else ():
                for least in (True, False):
                    hit = own >= t if least else own <= t
                    p, n = int((hit & own_bad).sum()), int((hit & ~own_bad).sum())
                    g = float(_gain(p0, n0, np.float64(p), np.float64(n)))
                    if g > best[0] + 1e-9:
                        best = (g, (name, least, float(t)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= rule.of(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops last conditions as long as (caught - wrong) / (caught + wrong) on the rows held back doesn't fall."""

    def worth(r: Rule) -> float:
        hit = r.of(x)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

    while len(rule.conditions) > 1 and worth(short := Rule(rule.conditions[:-1])) >= worth(rule):
        rule = short
    return rule


def fit(frame: pd.DataFrame, *, precision: float = 0.9, support: int = 5, max_rules: int = 16, max_conditions: int = 3, steps: int = 48) -> DecisionList:
    """Sequential covering over a labelled frame (``bad``, ``part`` in [0, 1) and the features).

    A third of the rows is held back for pruning and for judging: a rule stays if, there and over all rows not yet
    covered, at least ``precision`` of what it catches is bad, and it catches ``support`` bad rows. The first rule that
    doesn't ends the list.
    """
    out, left = DecisionList(), frame.reset_index(drop=True)
    names = [c for c in frame.columns if c not in ("bad", "part")]
    while len(out.rules) < max_rules and left["bad"].sum() >= support:
        grow, hold = left[left["part"] >= 1 / 3], left[left["part"] < 1 / 3]
        arrays = lambda f: {n: f[n].to_numpy(float) for n in names}
        if not grow["bad"].sum():
            break
        rule = _grow(arrays(grow), grow["bad"].to_numpy(bool), max_conditions, steps)
        if not rule.conditions:
            break
        rule = _prune(rule, arrays(hold), hold["bad"].to_numpy(bool)) if len(hold) else rule
        hit, held = rule.of(arrays(left)), rule.of(arrays(hold)) if len(hold) else np.zeros(0, dtype=bool)
        bad = left["bad"].to_numpy(bool)
        rule.caught, rule.wrong = int((hit & bad).sum()), int((hit & ~bad).sum())
        held_wrong = int((held & ~hold["bad"].to_numpy(bool)).sum())
        if rule.caught < support or rule.caught < precision * hit.sum() or held_wrong > (1 - precision) * max(1, held.sum()):
            break
        out.rules.append(rule)
        left = left[~hit]
    return out


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> DecisionList:
    """Fits the list on at most ``sample`` labelled rows, those with the least hash of their id, that pass the base rules.

    ``labels`` has doc_id and quality (0: bad); null labels and ids don't count, of several labels the least does, and of
    several texts with one id that with the least hash. Only the sample's statistics come to the driver; its ids, ``sample`` at most, are broadcast. No labels give an empty list, which keeps all.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("s", statistics())
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) / 1000
    row = F.struct(F.xxhash64("doc_id", "text").alias("h"), (F.col("quality") == 0).alias("bad"), part.alias("part"), *[v.alias(k) for k, v in features("s").items()])
    rows = own.filter(~base_failed("s")).groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")  # one of an id's texts
    frame = rows.toPandas().sort_values("h", kind="stable").drop(columns="h")  # the same order, so the same list, each time
    return fit(frame, **options) if len(frame) else DecisionList()


def judged(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with a struct ``quality``: the counts, base_failed, rule (the number of the rule that rejects), kept.

    Null and empty texts have no words, so they fail. Repeated rows get the same verdict.
    """
    rules = learn(docs.select("doc_id", F.col(text_col).alias("text")), labels, **options)
    name, s = free_name(docs, "quality"), free_name(docs, "s")
    own = docs.withColumn(s, statistics(text_col))
    failed, rule = base_failed(s), rules.number(s)
    fields = [*[F.col(f"{s}.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")]
    return own.select(*docs.columns, F.struct(*fields).alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    own = judged(docs, labels, **options)
    return own.filter(F.col(f"{own.columns[-1]}.kept")).select(*docs.columns)
