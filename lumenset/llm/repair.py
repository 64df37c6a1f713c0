"""Repair of a conversation's structure: the cheapest edits that give roles ``(s?(ua)+)?``, found by a grammar-compressed DP.

Each row is a symbol of its role and fault. Re-Pair replaces the commonest pairs of symbols, over all conversations, by rules;
a rule has one transfer matrix over the states of the wanted pattern in the (min, plus) algebra, each entry with the
audit of its cheapest edits as a rope, put together once from the matrices of its two parts. A conversation is the product
of what its sequence comes to under the rules.

States: 0 nothing yet, 1 a system turn, 2 after a user turn, 3 after an assistant turn. Every row gives one letter
(K keep, R rerole, D delete) after the letters of what is inserted before it (I), so of two audits of equal cost over the
same rows none is the beginning of the other, and the least letter sequence is made of least parts.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.llm.common import materialize

#: Costs of the edits, and what a truncated row costs that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES, USER, ASSISTANT = range(4), 2, 3
#: Rules that a round adds, and rounds: what the grammar may grow to, whatever the number of conversations.
RULES, ROUNDS = 32, 4
#: Pieces in which pairs of symbols are counted, the first code point of the rules' symbols, and solved sequences that a task remembers.
PIECE, FIRST, REMEMBERED = 4096, 0xE000, 20_000
BLANK, DUPLICATE, CUT = 1, 2, 3


class Rope:
    """A text as a tree of its parts, which are shared; with its length and a hash that tells equal texts."""

    __slots__ = ("left", "right", "leaf", "size", "hash")
    PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right
        if left is None:
            self.size, self.hash = len(leaf), 0
            for c in leaf:
                self.hash = (self.hash * self.BASE + ord(c)) % self.PRIME
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.PRIME) + right.hash) % self.PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        return Rope(self.leaf + other.leaf) if self.left is other.left is None and self.size + other.size <= 16 else Rope(left=self, right=other)

    def __lt__(self, other: Rope) -> bool:
        """By the first letter that differs; parts that are equal are passed over whole."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.left is not None and (x.size >= y.size or y.left is None):
                a += [x.right, x.left]
                b.append(y)
            elif y.left is not None:
                a.append(x)
                b += [y.right, y.left]
            elif (n := min(x.size, y.size)) and x.leaf[:n] != y.leaf[:n]:
                return x.leaf[:n] < y.leaf[:n]
            else:
                if x.size > n:
                    a.append(Rope(x.leaf[n:]))
                if y.size > n:
                    b.append(Rope(y.leaf[n:]))
        return bool(b) and not a

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.leaf)
            else:
                todo += [x.right, x.left]
        return "".join(out)


Entry = tuple[int, Rope]
Matrix = dict[tuple[int, int], Entry]


def _least(out: Matrix, at: tuple[int, int], entry: Entry) -> None:
    if (old := out.get(at)) is None or entry[0] < old[0] or entry[0] == old[0] and entry[1] < old[1]:
        out[at] = entry


def product(a: Matrix, b: Matrix) -> Matrix:
    """Of two transfer matrices: the least sum of costs over the states between, ties by the least letters."""
    out: Matrix = {}
    for (i, k), (c, r) in a.items():
        for (k2, j), (d, s) in b.items():
            if k == k2 and ((old := out.get((i, j))) is None or c + d <= old[0]):
                _least(out, (i, j), (c + d, r + s))
    return out


def _inserted() -> Matrix:
    """What may be inserted in one place: nothing, one row or two; more are never cheapest."""
    one = {(0, USER): (INSERT, Rope("I")), (1, USER): (INSERT, Rope("I")), (USER, ASSISTANT): (INSERT, Rope("I")), (ASSISTANT, USER): (INSERT, Rope("I"))}
    out: Matrix = {(i, i): (0, Rope()) for i in STATES}
    for m in (one, product(one, one)):
        for at, entry in m.items():
            _least(out, at, entry)
    return out


GAP = _inserted()


def terminal(role: str, fault: int) -> Matrix:
    """The matrix of one row (initial of its role, fault), with what may be inserted before it."""
    step: Matrix = {(i, i): (DELETE, Rope("D")) for i in STATES}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED * (fault == CUT)
        for as_role, to, before in (("u", USER, (0, 1, ASSISTANT)), ("a", ASSISTANT, (USER,)), ("s", 1, (0,))):
            for i in before:
                if role == as_role:
                    _least(step, (i, to), (more, Rope("K")))
                elif as_role != "s":
                    _least(step, (i, to), (REROLE + more, Rope("R")))
    return product(GAP, step)


#: The symbols of rows: must be deleted, or a role's initial, lower case if whole, upper case if truncated; x: any other role.
TERMINALS = {"D": terminal("x", BLANK)} | {c: terminal(c, 0) for c in "suax"} | {c.upper(): terminal(c, CUT) for c in "suax"}


class Grammar:
    """Rules in the order in which they were made, each with the matrix of what it stands for."""

    def __init__(self, pairs: list[str]):
        self.pairs = [(p, chr(FIRST + n)) for n, p in enumerate(pairs)]
        self.matrices = dict(TERMINALS)
        for (a, b), name in self.pairs:  # bottom-up: parts come before what they are parts of
            self.matrices[name] = product(self.matrices[a], self.matrices[b])
        self.known: OrderedDict[str, Entry] = OrderedDict()

    def solve(self, symbols: str) -> tuple[int, str]:
        """The least cost of a sequence and its audit."""
        short = symbols
        for pair, name in self.pairs:
            short = short.replace(pair, name)
        if (found := self.known.get(short)) is None:
            row: Matrix = {(0, 0): (0, Rope())}
            for name in short:
                row = product(row, self.matrices[name])
            row = product(row, GAP)
            ends: Matrix = {}
            for at in ((0, 0), (0, ASSISTANT)):
                if at in row:
                    _least(ends, (0, 0), row[at])
            found = self.known[short] = (ends[0, 0][0], str(ends[0, 0][1]))
            if len(self.known) > REMEMBERED:
                self.known.popitem(last=False)
        return found


# damage


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows with the damage that a checksum of conversation and turn picks; ``n`` is how often
    a row stands there, 0 where it was dropped. Nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    n = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), n.cast("long").alias("n"))


# sequences


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with 128 bits of role and text, by which they are compared; ``n`` is 1 where it is missing."""
    n = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n"))
    return own.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


def _order() -> list[Column]:
    """By turn, nulls first; ties by role and text's hash."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h1").asc(), F.col("h2").asc()]


def _dealt(rows: DataFrame, *first: Column) -> DataFrame:
    """Each conversation's rows together and in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, *_order())


def _fault(text: Column) -> Column:
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, symbols: a row for each conversation of ``rows`` (conv_id, turn, role, text, n).

    A row's first fault counts: blank; the role and text of an earlier row; no full stop at its end. Texts aren't shuffled here, but
    their hashes. A conversation's rows pass through one task in order, which keeps one letter of each, as its result does.
    """
    light = _keyed(rows).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "h1", "h2", "n", _fault(F.col("text")).alias("fault"))
    light = light.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    seen = F.lag("h1").over(W.partitionBy("conv_id", "h1", "h2", F.col("n") > 0).orderBy(*_order())).isNotNull()
    light = light.withColumn("seen", seen & (F.col("n") > 0)).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, have, out = None, None, []

        def closed() -> tuple:
            counts, turns, least, most, distinct, parts = have
            gaps = most - least + 1 - distinct if turns else 0
            return at[0], gaps, counts[BLANK], counts[DUPLICATE], counts[CUT], counts[4], "".join(parts)

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "n", "fault", "seen")]
            for conv, turn, initial, n, fault, seen in zip(*cols, strict=True):
                if at is None or at[0] != conv:
                    if at is not None:
                        out.append(closed())
                    at, have, before, last = (conv,), [[0] * 5, 0, 0, 0, 0, []], None, None
                if not n:
                    continue
                counts = have[0]
                if turn is not None:
                    have[2] = turn if not have[1] else min(have[2], turn)
                    have[3] = turn if not have[1] else max(have[3], turn)
                    have[4] += not have[1] or turn != last
                    have[1], last = have[1] + 1, turn
                role = initial if initial in ("s", "u", "a") else "x"
                first = fault if fault == BLANK else DUPLICATE if seen else fault
                again = BLANK if fault == BLANK else DUPLICATE
                counts[first] += 1
                counts[again] += n - 1
                counts[4] += before is not None and before + role not in ("su", "ua", "au")
                counts[4] += n - 1  # no role may follow itself
                before = role
                have[5].append(("D" if first in (BLANK, DUPLICATE) else role.upper() if first == CUT else role) + "D" * (n - 1))
            if len(out) >= 1000:
                yield made(out)
                out = []
        if at is not None:
            out.append(closed())
        yield made(out)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "symbols"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 6 + [pa.string()]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"
    return light.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")).mapInArrow(run, schema)


def learn_grammar(found: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over the symbols of all conversations, ``rules`` pairs a round: only the commonest pairs come to the driver."""
    pieces = found.select(F.explode(F.regexp_extract_all("symbols", F.lit(f".{{1,{PIECE}}}"), F.lit(0))).alias("s"))
    now, pairs = materialize(pieces.groupBy("s").agg(F.count("*").alias("n")), "symbols"), []
    for _ in range(rounds):
        each = now.filter(F.length("s") > 1).select("s", "n", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
        counts = each.groupBy(F.substring(F.col("s"), F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n")).filter("n > 1")
        new = [r.pair for r in counts.orderBy(F.col("n").desc(), "pair").limit(rules).collect()]
        if not new:
            break
        short = F.col("s")
        for p in new:
            short = F.replace(short, F.lit(p), F.lit(chr(FIRST + len(pairs))))
            pairs.append(p)
        now = materialize(now.select(short.alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n")), "symbols")
    return Grammar(pairs)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of ``sequences``, cost and audit: the cheapest edits of each conversation. A written table."""
    found = materialize(sequences(rows), "sequences")
    pairs = [p for p, _ in learn_grammar(found).pairs]

    def run(batches):
        grammar = Grammar(pairs)
        for batch in batches:
            solved = [grammar.solve(s) for s in batch["symbols"].to_pylist()]
            cols = [batch[c] for c in batch.schema.names[:-1]] + [pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "cost", "audit"])

    schema = ", ".join(f"{c} long" for c in found.columns[:-1]) + ", cost long, audit string"
    return materialize(found.mapInArrow(run, schema), "plans")


# repaired rows


def _follow(batches, each):
    """Calls ``each(conv_id, edit, role, text)`` for all that stays, in order, and with no edit where a conversation begins and ends."""
    audit, at, to, open_ = "", 0, 0, False

    def inserted(conv):
        nonlocal at, to
        while at < len(audit) and audit[at] == "I":
            at, to = at + 1, ASSISTANT if to == USER else USER
            each(conv, "I", "assistant" if to == ASSISTANT else "user", "")

    last = None
    for batch in batches:
        for conv, plan, role, text, n in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text", "n")), strict=True):
            if plan is not None:
                if open_:
                    inserted(last)
                    each(last, None, None, None)
                audit, at, to, open_, last = plan, 0, 0, True, conv
                continue
            for _ in range(n):
                inserted(conv)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                to = 1 if edit == "K" and role[:1] == "s" else ASSISTANT if to == USER else USER
                each(conv, edit, role if edit == "K" else "assistant" if to == ASSISTANT else "user", text)
        yield
    if open_:
        inserted(last)
        each(last, None, None, None)
        yield


def _with_plans(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in order."""
    own = _keyed(rows).filter("n > 0").withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
    return _dealt(own.unionByName(plan.select("conv_id", "audit"), allowMissingColumns=True), F.col("audit").asc_nulls_last())


def repaired(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, role, text, edit): the conversations after the cheapest edits; ``place`` counts from 0, ``edit`` is K, R or I.

    ``rows``: conv_id and turn (whole numbers), role, text; null roles and texts count as one space, and those without a
    conversation are one. Rows come by turn, nulls first, then role and text's hash. Equal rows are copies, of which one
    stays. Other columns are not read. An empty table gives no rows.
    """
    plan = plans(rows) if plan is None else plan

    def run(batches):
        out, place = [], 0

        def each(conv, edit, role, text):
            nonlocal place
            if edit:
                out.append((conv, place, role, text, edit))
            place = place + 1 if edit else 0

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for _ in _follow(batches, each):
            cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "place", "role", "text", "edit"])
            out.clear()

    return _with_plans(rows, plan).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of each conversation; a conversation without a row has zeros and empty texts.

    The hash is of ``role:text``, joined by line ends; it is taken as the rows pass, so no conversation is held.
    """
    plan = plans(rows)

    def run(batches):
        out, digest, first = [], hashlib.sha256(), True

        def each(conv, edit, role, text):
            nonlocal digest, first
            if edit:
                digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            else:
                out.append((conv, digest.hexdigest()))
                digest, first = hashlib.sha256(), True

        for _ in _follow(batches, each):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])
                out.clear()

    digests = _with_plans(rows, plan).mapInArrow(run, "conv long, repaired_sha256 string")
    return plan.join(digests, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
