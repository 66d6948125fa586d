"""Repair of damaged conversations at least cost, over a suffix-shared automaton.

A row counts only by its signature: whether it must go, else the initial of its role and whether it
is truncated. What the rest of a conversation costs depends on the signatures still to come alone, so
conversations share a node for every common end. The different signature strings are sorted from their
ends and cut into ranges; each task walks its range along one stack of nodes, minimised from the end: a
node is made once for all strings that end alike, and holds, for each state of the grammar, the cost
to go and the first letter of the best audit suffix. Every letter leads to one state, so letters spell
the suffix, and ties are settled by letters alone.

Grammar of role initials: ``(s?(ua)+)?``, with the states START, SYSTEM (after s), USER (after u) and
ASSISTANT (after a). Rows of a conversation go by turn, nulls first; rows of one turn by role, then by
the MD5 of the text. Rows that are equal stand together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import SPACES, stored

DROP, EMPTY, UNSTOP, REPEAT, AS_USER, OF = 0, 1, 2, 3, 4, 20
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the user or assistant inserted or reroled in a state leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: What a kept initial leads to, by state; anything else is illegal there.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: A symbol of a signature: ``x`` must go; small letters are whole, capitals are truncated; ``o`` is any other role.
GONE = "x"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
#: Rows of one Arrow batch of answers.
ROWS_AT_ONCE = 4096

Node = tuple[tuple[int, ...], tuple[str, ...]]


# ---- automaton -----------------------------------------------------------------------------


def _with_inserts(costs: list[float], letters: list[str]) -> Node:
    """The same node after its best inserts; three more at most pass through every state."""
    for _ in range(4):
        for state in range(4):
            cost = INSERT_COST + costs[NEXT[state]]
            if (cost, "I") < (costs[state], letters[state]):
                costs[state], letters[state] = cost, "I"
    return tuple(costs), tuple(letters)


#: The end of every conversation: nothing, or a last assistant, is legal.
END: Node = _with_inserts([0, float("inf"), float("inf"), 0], ["", "~", "~", ""])


def node_before(symbol: str, after: Node) -> Node:
    """The node that reads ``symbol`` and goes on to ``after``: cost to go and letter by state."""
    role, costs, letters = symbol.lower(), [], []
    fine = TRUNCATED_COST if symbol.isupper() else 0
    for state in range(4):
        best = (DELETE_COST + after[0][state], "D")
        if role != GONE:
            if role in KEPT[state]:
                best = min(best, (KEEP_COST + fine + after[0][KEPT[state][role]], "K"))
            best = min(best, (REROLE_COST + fine + after[0][NEXT[state]], "R"))
        costs.append(best[0])
        letters.append(best[1])
    return _with_inserts(costs, letters)


def audit_of(signature: str, nodes: list[Node]) -> str:
    """Letters of the cheapest repair; ``nodes[k]`` has the last ``k`` symbols still to read."""
    state, out, left = START, [], len(signature)
    while True:
        letter = nodes[left][1][state]
        if not letter:
            return "".join(out)
        out.append(letter)
        if letter == "I":
            state = NEXT[state]
            continue
        role = signature[-left].lower()
        left -= 1
        if letter != "D":
            state = KEPT[state][role] if letter == "K" else NEXT[state]


def best_repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, cost, audit) of signatures that come sorted by their ends: the stack keeps the
    nodes of the current end, and what it shares with the next one is not made again."""
    stack, before = [END], ""
    for batch in batches:
        signatures = batch.column("signature").to_pylist()
        costs, audits = [], []
        for signature in signatures:
            shared, most = 0, min(len(before), len(signature))
            while shared < most and before[-1 - shared] == signature[-1 - shared]:
                shared += 1
            del stack[shared + 1 :]
            for k in range(shared, len(signature)):
                stack.append(node_before(signature[-1 - k], stack[-1]))
            before = signature
            costs.append(stack[-1][0][START])
            audits.append(audit_of(signature, stack))
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"]
        )


# ---- rows ----------------------------------------------------------------------------------


def damage_kind(conv_id: Column, turn: Column) -> Column:
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.pmod(F.crc32(F.encode(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)), "UTF-8")), F.lit(OF))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the different rows after damage and how often each stands;
    0 times for dropped rows, which keep the ids of their conversations."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), damage_kind(F.col("conv_id"), F.col("turn")).alias("kind"))
    kind = F.col("kind")
    hurt = (
        F.when(kind.isin(DROP, EMPTY), F.lit(""))
        .when(kind == UNSTOP, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(kind == DROP, F.lit("")).when(kind == AS_USER, F.lit("user")).otherwise(F.col("role"))
    times = F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1)
    after = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), hurt.alias("text"), times.alias("times"))
    return after.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def judged(rows: DataFrame) -> DataFrame:
    """The rows with their digest, fault and symbol. The first of equal rows may be whole, the others
    are duplicates, so ``symbol`` is for the first and ``times - 1`` more must go."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = stored(rows.withColumns({"digest": F.md5("text"), "last": last}))
    # The turn a role and text stand in first, null before all others.
    seen = rows.where("times > 0").groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("first"), (F.count("*") > F.count("turn")).alias("unnumbered"), F.count("*").alias("turns")
    )
    seen = stored(seen.where("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", "unnumbered"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first"))), F.lit(False))
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(*ENDS), "truncated").otherwise("")
    joined = rows.join(seen, same, "left").withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    small = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.upper(small)).otherwise(small)
    return joined.select("conv_id", "turn", "role", "text", "digest", "times", "fault", symbol.alias("symbol"))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Every conversation in one partition, its rows in order."""
    keys = [F.col("conv_id").asc_nulls_first(), *(F.col(c) for c in first), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


class Facts:
    """Counts of one conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.signature, self.before = conv_id, [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = None

    def add(self, turn, initial: str, times: int, fault: str, symbol: str) -> None:
        if not times:
            return
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        self.blank += times if fault == "blank" else 0
        self.duplicate += times if fault == "duplicate" else 0 if fault == "blank" else times - 1
        self.truncated += fault == "truncated"
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + (times - 1 if initial + initial not in LEGAL else 0)
        self.before = initial
        self.signature.append(symbol + GONE * (times - 1))

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.signature)


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def signatures(kind: pa.DataType):
    """One row for each conversation of sorted rows: its counts and its signature, a character a row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *FACTS, "signature"]
            )

        for batch in batches:
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "times", "fault", "symbol")), strict=True):
                if open_ is None or conv_id != open_.conv_id:
                    done += [open_.row()] if open_ else []
                    open_ = Facts(conv_id)
                open_.add(*row)
            if len(done) >= ROWS_AT_ONCE:
                yield batch_of(done)
                done = []
        done += [open_.row()] if open_ else []
        if done:
            yield batch_of(done)

    return gather


# ---- repaired text ---------------------------------------------------------------------------


class Repaired:
    """Digest of one repaired conversation while its rows pass."""

    def __init__(self, known: tuple, audit: str):
        self.known, self.audit, self.at, self.state = known, audit, 0, START
        self.digest, self.begun = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def _next(self) -> str:
        """The role that the grammar wants now; its state is entered."""
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(self._next(), "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][role[:1]]
            self._write(role, text)
        elif letter == "R":
            self._write(self._next(), text)

    def row(self) -> tuple:
        self.inserts()
        return *self.known, self.audit, self.digest.hexdigest()


def rebuilt(kind: pa.DataType):
    """The result rows: sorted rows stream through one digest a conversation, led by a row with the
    conversation's counts and its audit."""
    names = ["conv_id", *FACTS, "cost"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * (len(FACTS) + 1), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "audit", "repaired_sha256"]
            )

        for batch in batches:
            lead = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            lines = zip(*(batch.column(c).to_pylist() for c in ("audit", "role", "text", "times")), strict=True)
            for known, (audit, role, text, times) in zip(lead, lines, strict=True):
                if audit is not None:
                    done += [open_.row()] if open_ else []
                    open_ = Repaired(known, audit)
                    continue
                for _ in range(times):
                    open_.add(role, text)
            if len(done) >= ROWS_AT_ONCE:
                yield batch_of(done)
                done = []
        done += [open_.row()] if open_ else []
        if done:
            yield batch_of(done)

    return stream


def repairs(signatures_: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the different signatures, each made in the range of its end."""
    unique = stored(signatures_.select("signature").distinct().withColumn("end", F.reverse("signature")))
    ranges = unique.repartitionByRange("end").sortWithinPartitions("end").select("signature")
    return ranges.mapInArrow(best_repairs, "signature string, cost long, audit string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id (null is one): gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256 after damage and the cheapest repair.

    Null roles and texts are one space, a null turn stands before all others. Equal rows stand
    together and all but the first are duplicates. A role whose initial is not s, u or a can only be
    reroled or deleted. A conversation that loses all rows, or is empty after repair, has the digest of
    the empty string. An empty table gives no rows; other columns are ignored.

    A digest of a whole conversation reads its rows one after another, so a conversation passes through
    one task as a stream; nothing but its signature, a character a row, is held.
    """
    own = dict(conversations.dtypes)["conv_id"]
    kind, arrow = ("long", pa.int64()) if own in ("bigint", "int", "smallint", "tinyint") else ("string", pa.string())
    rows = stored(judged(damaged(conversations.withColumn("conv_id", F.col("conv_id").cast(kind)))))
    counts = ", ".join(f"{c} long" for c in FACTS)

    slim = in_order(rows.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "times", "fault", "symbol"))
    slim = slim.select("conv_id", "turn", "initial", "times", "fault", "symbol")
    facts = stored(slim.mapInArrow(signatures(arrow), f"conv_id {kind}, {counts}, signature string"))
    best = stored(repairs(facts))

    known = facts.join(best, "signature").select("conv_id", *FACTS, "cost", "audit", F.lit(0).alias("part"), F.lit("").alias("digest"))
    lines = rows.where("times > 0").select("conv_id", "turn", "role", "digest", "text", "times", F.lit(1).alias("part"))
    whole = in_order(known.unionByName(lines, allowMissingColumns=True), "part")
    whole = whole.select("conv_id", *FACTS, "cost", "audit", "role", "text", "times")
    out = whole.mapInArrow(rebuilt(arrow), f"conv_id {kind}, {counts}, cost long, audit string, repaired_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(own))
