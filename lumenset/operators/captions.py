"""Captions: effective revisions, integrity, rules, edits."""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenset.functions.layout import spread

#: Fixed values of the integrity checks.
MIN_CHARS, NGRAM, TIMES, GARBAGE = 3, 3, 3, 0.15
SPACE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\v\f\r"
WRAPPERS = " \t\r\n\"')]}»”’"
#: A text of Latin letters, digits, marks and white space alone, in which nothing is unreadable.
PLAIN = r"\A[\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-\u024F]*+\z"
#: White space, and what is neither printable nor white space (but for unassigned code points).
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0" + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNREADABLE = r"\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F" + "\ufffd" + r"\p{Cf}\p{Co}"
RESIDUE = r"(?i)(</?think>|<\|?\s*channel\s*\|?>|<\|?\s*(?:start|end|return|message|assistant|user|system)\s*\|?>)"


def effective(captions: DataFrame, pins: DataFrame, revisions: DataFrame) -> DataFrame:
    """The text in force of each caption: the pinned revision where the mode says so, else the head."""
    chosen = captions.join(pins.select("caption_id", "mode", F.col("revision_id").alias("pinned")), "caption_id", "left")
    chosen = chosen.select("caption_id", F.coalesce(F.when(F.col("mode") == "pinned", F.col("pinned")), F.col("head")).alias("revision_id"))
    return chosen.join(revisions, ["caption_id", "revision_id"], "left")


def unused_revisions(captions: DataFrame, pins: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revisions that are neither a head nor pinned."""
    used = captions.select("caption_id", F.col("head").alias("revision_id")).unionByName(pins.select("caption_id", "revision_id"))
    return revisions.join(used, ["caption_id", "revision_id"], "left_anti")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_empty(text: Column) -> Column:
    return F.length(stripped(text)) < MIN_CHARS


def has_text(text: Column) -> Column:
    """Whether a text holds more than blanks (Unicode's space separators); line breaks and tabs count, and so do one or two letters."""
    return F.coalesce(text.rlike(r"\P{Zs}"), F.lit(False))


def is_truncated(text: Column) -> Column:
    """Long enough, and no full stop before the closing quotes and brackets."""
    core = F.rtrim(stripped(text), F.lit(WRAPPERS))
    return (F.length(core) >= MIN_CHARS) & ~F.substring(core, -1, 1).isin(".", "!", "?", "…")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def repeated_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """The phrase of three words that is most frequent in a text, where it occurs three times or more; ties: the first.

    Nothing is shuffled: a text's words are zipped with themselves, and hashes tell whether a phrase may occur three times.
    If so, the phrases are sorted and counted as runs in one fold, so the work is n log n in its words. Null and empty texts have none.
    """
    w = F.split(stripped(F.lower(F.col(text))), SPACE)
    later = lambda n: F.slice("w", n, F.size("w"))
    joined = lambda x, y: F.concat(x, F.lit(" "), y)  # noqa: E731  null past the end
    grams = F.filter(F.zip_with(F.zip_with("w", later(2), joined), later(3), joined), lambda g: g.isNotNull())
    order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("phrase"), i.cast("long").alias("pos"))))

    def step(a: Column, x: Column) -> Column:
        same = a["phrase"].eqNullSafe(x["phrase"])
        times, first = F.when(same, a["times"] + 1).otherwise(F.lit(1).cast("long")), F.when(same, a["first"]).otherwise(x["pos"])
        ahead = (times > a["best"]["times"]) | ((times == a["best"]["times"]) & (first < a["best"]["first"]))
        best = F.when(ahead, F.struct(x["phrase"].alias("phrase"), times.alias("times"), first.alias("first"))).otherwise(a["best"])
        return F.struct(x["phrase"].alias("phrase"), times.alias("times"), first.alias("first"), best.alias("best"))

    none = [F.lit(None).cast("string").alias("phrase"), F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("first")]
    best = F.aggregate(order, F.struct(*none, F.struct(*none).alias("best")), step)["best"]
    own = spread(df.filter(F.col(text).isNotNull()).select(key, text)).select(key, w.alias("w"))
    hashes = F.transform(F.arrays_zip(F.col("w"), later(2).alias("x"), later(3).alias("y")), lambda z: F.xxhash64(z))
    thrice = lambda s: F.exists(F.arrays_zip(s.alias("a"), F.slice(s, TIMES, F.size(s)).alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    repeats = (F.size(hashes) - F.size(F.array_distinct(hashes)) >= TIMES - 1) & F.exists(F.array(F.sort_array(hashes)), thrice)
    found = own.select(key, F.explode_outer(F.when(repeats, F.filter(F.array(best), lambda b: b["times"] >= TIMES))).alias("b"))  # a filter on the phrases would be pushed under w
    return found.filter(F.col("b").isNotNull()).select(key, "b.phrase", "b.times")


def has_residue(text: Column) -> Column:
    return text.contains("<") & text.rlike(RESIDUE)  # all of it begins so


def is_garbage(text: Column) -> Column:
    """At least 15 % of the characters are replacement characters, or neither printable nor white space; the white space around the text doesn't count."""
    unreadable = rf"[{UNREADABLE}\p{{Cs}}\p{{Cn}}]"
    core = F.regexp_replace(F.regexp_replace(text, rf"^[{BLANK}]+", ""), rf"[{BLANK}]+$", "")
    bad = F.length(core) - F.length(F.regexp_replace(core, unreadable, ""))
    return F.when(~text.rlike(PLAIN) & text.rlike(unreadable), bad >= GARBAGE * F.length(core)).otherwise(False)


def _loops(text: bytes) -> bool:
    """Whether a phrase of three words occurs ``TIMES`` times or more: hashes tell whether one may, and if so, phrases are counted."""
    w = text.split()  # bytes are split at ASCII's white space
    h, odd = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    h = np.sort((h[:-2] * odd + h[1:-1]) * odd + h[2:])
    return bool((h[TIMES - 1 :] == h[: 1 - TIMES]).any()) and max(Counter(zip(w, w[1:], w[2:])).values()) >= TIMES


def checked(df: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """``key``, what is wrong with the text as booleans (empty, truncated, repetition, garbage, residue), and ``more``.

    A text is read once, and is neither joined nor sorted; lower-cased it goes to a task's Python, for repeated phrases alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flags = {"empty": is_empty(t), "truncated": is_truncated(t), "garbage": is_garbage(t), "residue": has_residue(t)} | more
    own = spread(df).select(key, *[c.alias(n) for n, c in flags.items()], F.lower(t).cast("binary").alias("repetition"))

    def found(batches):
        for b in batches:
            loops = pa.array([_loops(x.as_py()) for x in b.column("repetition")], pa.bool_())
            yield b.set_column(b.num_columns - 1, "repetition", loops)

    schema = T.StructType([f if f.name != "repetition" else T.StructField(f.name, T.BooleanType()) for f in own.schema])
    return own.mapInArrow(found, schema)


def integrity(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the ordered codes of what is wrong with the text."""
    codes = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in ("empty", "truncated", "repetition", "garbage", "residue")]), lambda x: x.isNotNull())
    return checked(df.select(key, text), key, text).select(key, codes.alias("issues"))


def trigger_rule(text: Column, word: str) -> tuple[Column, Column]:
    """Whether the trigger word is missing as a whole word, and the text with it in front."""
    missing = ~text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")
    return missing, F.when(F.trim(text) != "", F.concat(F.lit(word + ", "), text)).otherwise(F.lit(word))


def strip_reasoning(text: Column) -> Column:
    """Without think blocks and channel markers; of several channels, what follows the last final one."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    final = F.regexp_extract(out, r"(?is).*<\|?\s*channel\s*\|?>\s*final\s*(?:<\|?\s*message\s*\|?>)?(.*)$", 1)
    return stripped(F.regexp_replace(F.when(final != "", final).otherwise(out), RESIDUE, ""))


def judgement(raw: Column) -> Column:
    """A judge's verdict out of free text: a struct of violates, note and corrected_caption; null where no JSON object begins at the first brace.

    What comes before the object, fences and what follows it don't count; braces in strings don't either. ``violates`` is true for all that
    isn't false, null, zero or empty; ``note`` is trimmed; a correction that isn't a text is null.
    """
    whole = F.get_json_object(F.when(F.instr(raw, "{") > 0, F.substring(raw, F.instr(raw, "{"), F.length(raw))), "$")  # ends with the object
    own = F.try_parse_json(whole)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(own, path, "variant"))
    text = lambda path: F.try_variant_get(own, path, "string")
    said = text("$.violates")
    empty = F.when(kind("$.violates") == "BOOLEAN", said == "false").when(kind("$.violates") == "VOID", True).otherwise(said.isin("", "[]", "{}") | (said.try_cast("double") == 0).eqNullSafe(True) & (kind("$.violates") != "STRING"))
    note = F.when(kind("$.note").isin("VOID") | text("$.note").isin("false", "0", "[]", "{}") & (kind("$.note") != "STRING"), "").otherwise(stripped(text("$.note")))
    fields = [
        (said.isNotNull() & ~F.coalesce(empty, F.lit(True))).alias("violates"), F.coalesce(note, F.lit("")).alias("note"),
        F.when(kind("$.corrected_caption") == "STRING", stripped(text("$.corrected_caption"))).alias("corrected_caption"),
    ]
    return F.when(own.isNotNull(), F.struct(*fields))


def _claims(raw: str | None) -> list[dict]:
    """A JSON array of claims where there is one, else lines; a claim needs a letter."""
    raw = raw or ""
    a, b = raw.find("["), raw.rfind("]")
    found: list = []
    if 0 <= a < b:
        try:
            found = [x if isinstance(x, dict) else {"text": x} for x in json.loads(raw[a : b + 1])]
        except ValueError:
            found = []
    if not found:
        found = [{"text": re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line)} for line in raw.splitlines()]
    rows = [{"text": str(x.get("text") or "").strip(), "kind": str(x.get("kind") or "object")} for x in found]
    return [r for r in rows if any(c.isalpha() for c in r["text"])]


@F.pandas_udf(T.ArrayType(T.StructType().add("text", "string").add("kind", "string")))
def parse_claims(raw: pd.Series) -> pd.Series:
    return raw.map(_claims)


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.split(), b.split()).ratio()


@F.pandas_udf(T.DoubleType())
def rewrite_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    """How much of the words a rewrite keeps, from 0 to 1."""
    return pd.Series([_ratio(a or "", b or "") for a, b in zip(before, after, strict=True)])


#: The marks that end a sentence, a clause or a tag.
SEGMENT_MARKS = (".", "!", "?", ";", ",")


def merged(base: str, current: str, incoming: str) -> tuple[str, bool]:
    """A fix (base to incoming) on a text that went from base to current, and whether the two collide.

    Both sides' edits are kept where they don't meet. A segment (sentence, clause, tag) in which they meet is taken as the fix
    has it, whole. White space stays as it is. A fix that changes nothing leaves the current text.
    """
    if incoming == base:
        return current, False
    if current in (base, incoming):
        return incoming, False
    split = lambda text: re.findall(r"\S+|\s+", text)
    old = split(base)

    def edits(text: str) -> list[tuple[int, int, str]]:
        new = split(text)
        return [(i, j, "".join(new[k:m])) for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new).get_opcodes() if tag != "equal"]

    ours, theirs = edits(current), edits(incoming)
    ends = [i + 1 for i, word in enumerate(old) if word.endswith(SEGMENT_MARKS)]
    cuts = {min(len(old), i + 1) if i < len(old) and old[i].isspace() else i for i in ends} | {0, len(old)}
    for i, j, _ in ours + theirs:
        cuts -= set(range(i + 1, j))  # what one edit spans is one segment
    edges, out, conflict = sorted(cuts), [], False
    for lo, hi in zip(edges, edges[1:] or edges, strict=False):
        own = lambda side: [e for e in side if lo <= e[0] < hi or e[0] == hi == len(old)]  # noqa: B023, E731
        a, b = own(ours), own(theirs)
        meet = any(x[:2] == y[:2] or x[0] < y[1] and y[0] < x[1] for x in a for y in b)
        conflict |= meet
        at = lo
        for i, j, text in sorted(b if meet else a + b, key=lambda e: e[:2]):
            out += [*old[at:i], text]
            at = j
        out += old[at:hi]
    return "".join(out), conflict


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("conflict", T.BooleanType())]))
def three_way_merge(base: pd.Series, current: pd.Series, incoming: pd.Series) -> pd.DataFrame:
    """(text, conflict) of ``merged``; null texts count as empty."""
    rows = [merged(x or "", y or "", z or "") for x, y, z in zip(base, current, incoming, strict=True)]
    return pd.DataFrame(rows, columns=["text", "conflict"])


def resolved_findings(findings: DataFrame) -> DataFrame:
    """Findings (status, before, after, current) with what a decision would write.

    ``shown``: for pending ones the fix merged into the current text, else the fix as it was; ``conflict``: the current text
    collides with it; ``stale``: nothing is left to apply. Both are false where it isn't pending. Null texts count as empty.
    """
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    text, now = F.col("_m.text"), F.coalesce("current", F.lit(""))
    return findings.withColumn("_m", three_way_merge("before", "current", "after")).select(
        *findings.columns,
        F.when(pending, text).otherwise(F.col("after")).alias("shown"),
        (pending & F.col("_m.conflict")).alias("conflict"),
        (pending & (stripped(text) == stripped(now))).alias("stale"),
    )


def decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings after decisions (finding_id, action, and text or null): accept, reject or undo; those without one stay as they are.

    ``findings``: finding_id, status, before, after, current, applied, undo. Accepting writes the given text or the merged
    fix, and keeps the current one for undoing; undoing an accepted one restores that (else the text before). ``current`` is
    the caption's text afterwards. A finding has one decision at most.
    """
    cols = findings.columns
    own = resolved_findings(findings).join(decisions.select("finding_id", "action", F.col("text").alias("_text")), "finding_id", "left")
    accept, undo = F.col("action") == "accept", F.col("action") == "undo"
    back = undo & (F.col("status") == "accepted")
    new = {
        "status": F.when(accept, "accepted").when(F.col("action") == "reject", "rejected").when(undo, "pending").otherwise(F.col("status")),
        "applied": F.when(accept, F.coalesce("_text", "shown")).when(undo, F.lit(None)).otherwise(F.col("applied")),
        "undo": F.when(accept, F.col("current")).when(undo, F.lit(None)).otherwise(F.col("undo")),
        "current": F.when(accept, F.coalesce("_text", "shown")).when(back, F.coalesce("undo", "before")).otherwise(F.col("current")),
    }
    return own.select(*[new[c].alias(c) if c in new else F.col(c) for c in cols])


def weak_claims(claims: DataFrame, threshold: float) -> DataFrame:
    """Media with a claim, not rejected, that scores under the threshold."""
    return claims.filter(~F.col("rejected") & (F.col("score") < threshold)).select("media_id").distinct()


def grounding_summary(claims: DataFrame, threshold: float) -> DataFrame:
    kept = claims.filter(~F.col("rejected")).groupBy("media_id")
    out = kept.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= threshold).alias("validated"))
    return out.select("media_id", "total", "validated", (F.col("total") - F.col("validated")).alias("flagged"), F.bround(100.0 * F.col("validated") / F.col("total")).cast("long").alias("coverage"))
