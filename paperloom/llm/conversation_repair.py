"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is well formed if its roles' initials read (s?(ua)+)?: an optional system
turn, then user and assistant in turn; or nothing. Edits: Keep (free), Rerole to user or
assistant, Delete (required for blank and duplicate turns), Insert an empty user or
assistant turn anywhere; an undeleted truncated turn costs more. Of all cheapest edits
those are taken whose initials read least in ASCII.

The weighted automaton of these edits has four states (start, after s, after u, after a).
It is determinised lazily, read from the last turn to the first: a vector of the four
costs to the end, less its least, is a state of the determinised automaton. Vectors are
numbered as they turn up and the moves (state, turn's symbol) -> (state, cost) are cached
in a transition table. There are few of either, as inserts bound the differences. A scan
of a conversation's symbols through the table gives its cost; the trace goes back over the
scan, from the first turn to the last, along tight arcs (those whose cost is the difference
of the vectors' entries). One prefix of edits leads to one state, so the least tight
label at each step gives the least audit. These steps are cached in the same way.

On Spark: turns are met by (conversation, role, text) to find duplicates, then dealt by
conversation and sorted, each turn twice: first its symbol, then its text. A task holds a
few bytes a turn of one conversation (as its audit does) and streams the texts, which it
hashes and writes out. The hash of a repaired conversation reads its text in order, so one
conversation is one task's work; duplicates, blanks and damage are found before, where a
long conversation is spread.

Defined cases: a null role or text is one space; a null turn comes first and is no part of
the gaps; rows of a null conversation are one conversation; rows of one turn go by role,
then text (its first HEAD characters, then its MD5); equal rows are duplicates but for the
first; a role's initial is its first character (an empty or other role must be changed or
deleted); conversations without rows have zeros, an empty audit and the hash of nothing;
an empty table gives an empty result; other columns are not read. Texts of any length are
streamed.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads from each state, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
#: Faults as they count: the first that holds.
FINE, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"
#: Symbols of so many turns are solved once each in a task.
MEMO_TURNS, MEMO = 64, 65_536
HEAD = 64
NO_WORD = r"\A[\x20\x09-\x0D]*\z"
UNENDED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows damaged by crc32 of `conv:turn` modulo 20; copies is 0 for dropped rows, 2 for repeated ones."""
    part = lambda c: F.coalesce(F.col(_name(c)).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")), F.lit(20))
    after = F.when(how == 1, "").when(how == 2, F.translate(part(text), ".!?", "")).otherwise(part(text))
    return rows.select(
        F.col(_name(conv)).alias("conv"), F.col(_name(turn)).cast("bigint").alias("turn"),
        F.when(how == 4, "user").otherwise(part(role)).alias("role"), after.alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def as_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows as they are."""
    part = lambda c: F.coalesce(F.col(_name(c)).cast("string"), F.lit(" "))
    return rows.select(F.col(_name(conv)).alias("conv"), F.col(_name(turn)).cast("bigint").alias("turn"), part(role).alias("role"), part(text).alias("text"), F.lit(1).alias("copies"))


def fault(text: Column, seen: Column) -> Column:
    """A turn's first fault as a number."""
    return F.when(text.rlike(NO_WORD), BLANK).when(seen, DUPLICATE).when(text.rlike(UNENDED), CUT).otherwise(FINE)


class Lazy:
    """The determinised automaton, as far as it has been asked for.

    A symbol is 4 * role's class (s, u, a, other) + fault.
    """

    def __init__(self):
        self.vectors: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._state(self._closed([0, 9, 9, 0]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        vector = tuple(c - low for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], low

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """costs with inserts allowed; two in a row reach every state that inserts reach."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    @staticmethod
    def arcs(symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(label, cost, next state) of the edits that use up a turn, by label."""
        kind, wrong = divmod(symbol, 4)
        if wrong in (BLANK, DUPLICATE):
            return [("D", DELETE, q)]
        more = TRUNCATED if wrong == CUT else 0
        out = [("D", DELETE, q)]
        if (kind == 0 and q == START) or (kind == 1 and NEXT[q] == USER) or (kind == 2 and NEXT[q] == ASSISTANT):
            out.append(("K", KEEP + more, SYSTEM if kind == 0 else NEXT[q]))
        return [*out, ("R", REROLE + more, NEXT[q])]

    def move(self, after: int, symbol: int) -> tuple[int, int]:
        """(state before the turn, cost added), from the state after it."""
        found = self.moves.get((after, symbol))
        if found is None:
            v = self.vectors[after]
            found = self._state(self._closed([min(w + v[t] for _, w, t in self.arcs(symbol, q)) for q in range(4)]))
            self.moves[after, symbol] = found
        return found

    def step(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """(edits up to the one that uses up the turn, next state): least labels on tight arcs."""
        found = self.steps.get((after, symbol, q))
        if found is None:
            before, added = self.move(after, symbol)
            here, there, edits, p = self.vectors[before], self.vectors[after], "", q
            while True:
                tight = [(label, t) for label, w, t in self.arcs(symbol, p) if w + there[t] == added + here[p]]
                insert = [("I", NEXT[p])] if INSERT + here[NEXT[p]] == here[p] else []
                label, t = min(tight + insert)
                edits, p = edits + label, t
                if label != "I":
                    break
            found = self.steps[after, symbol, q] = edits, p
        return found

    def solve(self, symbols: bytes) -> tuple[int, list[str], str]:
        """(cost, edits of each turn, edits after the last)."""
        at, cost, path = self.end, self.end_cost, array("H")
        for symbol in reversed(symbols):
            path.append(at)
            at, added = self.move(at, symbol)
            cost += added
        cost += self.vectors[at][START]
        q, edits = START, []
        for i, symbol in enumerate(symbols):
            one, q = self.step(path[len(symbols) - 1 - i], symbol, q)
            edits.append(one)
        return cost, edits, "I" * (self.vectors[self.end][q] // INSERT)


class _Conversation:
    """One conversation in a task's stream: symbols first, then texts."""

    def __init__(self, conv, solve, sink):
        self.conv, self.solve, self.sink = conv, solve, sink
        self.symbols, self.low, self.high, self.distinct = bytearray(), None, None, 0
        self.plan = None

    def symbol(self, turn, symbol):
        self.symbols.append(symbol)
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1

    def prepare(self):
        self.cost, edits, tail = self.solve(bytes(self.symbols))
        self.audit = "".join(edits) + tail
        waiting, self.plan = "", []
        for symbol, one in zip(self.symbols, edits):  # deleted turns send no text; what is inserted before them waits
            if symbol % 4 in (BLANK, DUPLICATE):
                waiting += one[:-1]
            else:
                self.plan.append(waiting + one)
                waiting = ""
        self.plan.append(waiting + tail)
        self.at, self.q, self.place, self.hash = 0, START, 0, hashlib.sha256()

    def text(self, role, text):
        if self.plan is None:
            self.prepare()
        for edit in self.plan[self.at]:
            if edit == "K":
                self.write(edit, role, text)
                self.q = SYSTEM if self.q == START and role[:1] == "s" else NEXT[self.q]
            elif edit != "D":
                self.write(edit, ROLES[self.q], text if edit == "R" else "")
                self.q = NEXT[self.q]
        self.at += 1

    def write(self, edit, role, text):
        self.hash.update((("\n" if self.place else "") + role + ":" + text).encode())
        if self.sink.turns:
            self.sink.add(kind="turn", conv=self.conv, place=self.place, edit=edit, role=role, text=text)
        self.place += 1

    def close(self):
        if self.plan is None:
            self.prepare()
        self.text("", "")
        counts = [0] * 4
        for symbol in self.symbols:
            counts[symbol % 4] += 1
        kinds = bytes(s // 4 for s in self.symbols)
        legal = sum(kinds[i : i + 2] in (b"\0\1", b"\1\2", b"\2\1") for i in range(len(kinds) - 1))
        self.sink.add(
            kind="report", conv=self.conv, gaps=0 if self.low is None else self.high - self.low + 1 - self.distinct, blank=counts[BLANK], duplicate=counts[DUPLICATE], truncated=counts[CUT],
            illegal=max(0, len(kinds) - 1 - legal), cost=self.cost, audit=self.audit, repaired_sha256=self.hash.hexdigest(), turns=self.place,
        )


class _Sink:
    """Rows for the output, given out in batches of bounded size."""

    def __init__(self, schema: pa.Schema, turns: bool):
        self.schema, self.turns = schema, turns
        self.clear()

    def clear(self):
        self.columns, self.n, self.bytes = {f.name: [] for f in self.schema}, 0, 0

    def add(self, **row):
        for k, column in self.columns.items():
            column.append(row.get(k))
        self.n += 1
        self.bytes += 100 + len(row.get("text") or "") + len(row.get("audit") or "")

    def batch(self):
        out = pa.RecordBatch.from_pydict({f.name: pa.array(self.columns[f.name], f.type) for f in self.schema}, schema=self.schema)
        self.clear()
        return out


def _mapper(turns: bool):
    def mapper(batches):
        lazy, sink, now, last = Lazy(), None, None, object()
        short = lru_cache(MEMO)(lazy.solve)
        solve = lambda s: short(s) if len(s) <= MEMO_TURNS else lazy.solve(s)
        for batch in batches:
            if sink is None:
                kinds = {"kind": pa.string(), "conv": batch.schema.field("conv").type, "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
                kinds |= {c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": pa.string(), "repaired_sha256": pa.string(), "turns": pa.int64()}
                sink = _Sink(pa.schema(list(kinds.items())), turns)
            for conv, part, turn, symbol, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "turn", "symbol", "role", "text"))):
                if now is None or conv != last:
                    if now is not None:
                        now.close()
                    now, last = _Conversation(conv, solve, sink), conv
                if part == 0:
                    now.symbol(turn, symbol)
                elif part == 1:
                    now.text(role, text)
                if sink.n >= 10_000 or sink.bytes >= 1 << 24:
                    yield sink.batch()
        if now is not None:
            now.close()
            yield sink.batch()

    return mapper


def repair(turns: DataFrame, with_turns: bool = True) -> DataFrame:
    """Repaired conversations from turns (conv, turn, role, text, copies), as of as_turns or damage.

    Rows of kind `turn` are the repaired turns (conv, place from 0, edit, role, text), left
    out unless with_turns; one row of kind `report` for each conversation has gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256 and turns, how many are left.
    """
    there = F.col("copies") > 0
    same = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    # A row that is not there has no role and text, and only tells of its conversation.
    met = turns.select("conv", "turn", F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).alias("text"), "copies").withColumn("rank", F.row_number().over(same))
    kind = F.when(F.col("role").isNull(), 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.col("role").substr(1, 1)), F.lit(0)) - 1, F.lit(3)))
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    first = kind * 4 + fault(F.col("text"), F.col("rank") > 1)
    again = kind * 4 + fault(F.col("text"), F.lit(True))
    marked = met.select("*", F.when(there, first).cast("int").alias("first"), F.when(there, again).cast("int").alias("again"))

    def row(part: int, symbol: str, copy: int, with_text: bool):
        value = lambda c: (F.col(c) if with_text else F.lit(None).cast("string")).alias(c)
        return F.struct(F.lit(part).alias("part"), F.col(symbol).alias("symbol"), F.lit(copy).alias("copy"), value("role"), value("text"))

    light = F.when(~there, F.array(row(-1, "first", 0, False))).when(F.col("copies") > 1, F.array(row(0, "first", 0, False), row(0, "again", 1, False))).otherwise(F.array(row(0, "first", 0, False)))
    whole = F.array(row(1, "first", 0, True))
    heavy = F.when(there & (F.col("first") % 4).isin(FINE, CUT), whole).otherwise(F.slice(whole, 1, 0))
    flat = marked.select("conv", "turn", "rank", F.col("role").alias("o_role"), F.substring("text", 1, HEAD).alias("o_head"), F.md5("text").alias("o_md5"), F.explode(F.concat(light, heavy)).alias("r"))
    flat = flat.select("conv", "turn", "rank", "o_role", "o_head", "o_md5", "r.part", "r.symbol", "r.copy", "r.role", "r.text")
    dealt = flat.repartition("conv").sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "o_role", "o_head", "o_md5", "rank", "copy")
    kind_of = turns.schema["conv"].dataType.simpleString()
    schema = f"kind string, conv {kind_of}, place bigint, edit string, role string, text string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, turns bigint"
    return dealt.select("conv", "part", "turn", "symbol", "role", "text").mapInArrow(_mapper(with_turns), schema)
