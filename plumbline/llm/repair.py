"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Turns are kept, reroled or deleted
and empty turns inserted. The dynamic program runs over the retained turns alone: a retained turn follows
an earlier one, all between are deleted and the pair of their roles tells which turns are inserted. Prefix
sums of deletions make the price of a gap a difference, so a running minimum for each last role replaces the
search for the turn before. Equal costs are settled by the text of the audit. A conversation is streamed in
the order of its turns: what is held of it is four roles' states and two bytes a turn for each.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import text as T

#: Prices of edits and faults. Fixed values.
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Last role of what is retained so far: nothing, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Roles of the turns inserted between two retained ones (last role, next role); other pairs can't follow each other.
BRIDGE = {(NONE, SYSTEM): (), (NONE, USER): (), (NONE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
#: Roles inserted after the last retained turn.
CLOSE = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_SPACE = r"\x20\x09-\x0D"
FIRST = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Repair:
    """The dynamic program of one conversation, fed turn by turn."""

    def __init__(self) -> None:
        self.deleted = 0  # prefix sum of deletions
        self.best: list[int | None] = [0, None, None, None]  # cost less deletions up to there, of each last role
        self.rank = [0, 9, 9, 9]  # order of the audits so far
        self.hash = [hashlib.sha256(), None, None, None]
        self.back = bytearray()  # four bytes a turn: role before, what was done (0 deleted, 1 kept, 2 reroled)

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        own = None if must_go else FIRST.get(role[:1])
        targets = [] if must_go else [(t, 1, 0) if t == own else (t, 2, RETAG) for t in (USER, ASSISTANT)] + ([(SYSTEM, 1, 0)] if own == SYSTEM else [])
        # (cost, audit's order, what is appended to it, last role before, what is done): for each last role after
        options = [[] if b is None else [(b + self.deleted + DELETE, r, "D", q, 0)] for q, (b, r) in enumerate(zip(self.best, self.rank, strict=True))]
        for to, done, price in targets:
            for q, b in enumerate(self.best):
                if b is not None and (q, to) in BRIDGE:
                    bridge = BRIDGE[q, to]
                    cost = b + self.deleted + INSERT * len(bridge) + price + TRUNCATED * truncated
                    options[to].append((cost, self.rank[q], "I" * len(bridge) + "_KR"[done], q, done))
        self.deleted += DELETE
        # Audits of one number of turns end in K, R or D and none begins another: their order stays for good.
        chosen = [min(o) if o else None for o in options]
        order = sorted((c[1], c[2]) for c in chosen if c)
        hashes = list(self.hash)
        for to, c in enumerate(chosen):
            self.back.append(c[3] * 4 + c[4] if c else 0)
            if c:
                self.best[to], self.rank[to] = c[0] - self.deleted, order.index((c[1], c[2]))
                if c[4]:
                    hashes[to] = self._said(c[3], [ROLE[r] + ":" for r in BRIDGE[c[3], to]] + [f"{role if c[4] == 1 else ROLE[to]}:{text}"])
        self.hash = hashes

    def _said(self, last: int, lines: list[str]):
        found = self.hash[last].copy()
        if lines:
            found.update((("" if last == NONE else "\n") + "\n".join(lines)).encode())
        return found

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of what is said)."""
        ends = [(b + self.deleted + INSERT * len(CLOSE[q]), self._audit(q) + "I" * len(CLOSE[q]), q) for q, b in enumerate(self.best) if b is not None]
        least = min(ends)
        return least[0], least[1], self._said(least[2], [ROLE[r] + ":" for r in CLOSE[least[2]]]).hexdigest()

    def _audit(self, last: int) -> str:
        out = []
        for at in range(len(self.back) - 4, -1, -4):
            before, done = divmod(self.back[at + last], 4)
            out.append("DKR"[done])
            out.append("I" * len(BRIDGE[before, last]) if done else "")
            last = before
        return "".join(reversed(out))


def damaged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone) of each turn after damage drawn by the checksum of its name; a dropped one is ``gone``."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("damage"))
    text = F.when(F.col("damage") <= 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("damage") == 0).alias("gone"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with their first fault (``blank``, ``duplicate``, ``truncated`` or null), dealt by conversation."""
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "mark").orderBy(F.col("turn").asc_nulls_first()))
    mark = F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))
    rows = rows.repartition("conv").withColumn("mark", mark).withColumn("seen", seen)
    fault: Column = F.when(F.col("gone"), None).when(~F.col("text").rlike(rf"[^{_SPACE}]"), "blank").when(F.col("seen") > 1, "duplicate")
    return rows.withColumn("fault", fault.when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "truncated")).drop("mark")


def repair_conversations(turns: DataFrame, *, damage: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    With ``damage`` the turns are first damaged by the checksum of their names. Turns are ordered by
    ``turn_col`` (nulls first), then role and text; null roles and texts count as one space; null ids are
    one conversation. A role counts by its first character: an empty or other one can be reroled or deleted,
    never kept. Repeated rows are duplicates. A conversation of which nothing is left has zeros, an empty
    audit and the hash of no text; an empty table gives an empty result; other columns are ignored.

    One shuffle, by conversation; a long conversation is sorted outside memory and streamed, as the hash of
    its repaired text needs every turn in order. Its audit is one value of the result, by contract.
    """
    T.prepare(turns.sparkSession)
    kind = turns.select(conv_col).schema[0].dataType.simpleString()
    if damage:
        rows = damaged(turns, conv_col, turn_col, role_col, text_col)
    else:
        rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), F.lit(False).alias("gone"))
    ordered = faults(rows).withColumn("turn", F.col("turn").cast("long")).sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    schema = f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"

    def run(batches):
        open_ = _Conversation(None)
        done: list[_Conversation] = []

        def batch_of(kind):
            columns = list(zip(*(c.row() for c in done), strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv", *COUNTS, "audit", "repaired_sha256"])

        began, typ = False, None
        for batch in batches:
            typ = batch.column(0).type
            for conv, turn, role, text, gone, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not began or conv != open_.name:
                    if began:
                        done.append(open_)
                    open_, began = _Conversation(conv), True
                if not gone:
                    open_.take(turn, role, text, fault)
            if len(done) >= 1000:
                yield batch_of(typ)
        if began:
            done.append(open_)
            yield batch_of(typ)

    return ordered.select("conv", "turn", "role", "text", "gone", "fault").mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


class _Conversation:
    """Figures and repair of one conversation while its turns pass."""

    def __init__(self, name) -> None:
        self.name, self.repair = name, Repair()
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.last: str | None = None
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def take(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = (turn if self.low is None else self.low), turn, self.turns + 1
        if self.last is not None and self.last[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role
        if fault:
            self.count[fault] += 1
        self.repair.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, said = self.repair.result()
        return (self.name, gaps, *self.count.values(), self.illegal, cost, audit, said)
