"""Conversation structure repair (operator 13): cheapest edits by lazy weighted determinisation.

Edits turn a conversation's rows into one whose role initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and
duplicate rows), Insert an empty user or assistant row (3); a truncated row that isn't deleted costs 3 more. The grammar has four states: nothing yet, after s, after u,
after a. A cost vector says what the rest of the conversation costs from each state. Less its least entry, it is a state of the determinised automaton; such states are made when first
met, and their moves by kinds of rows are kept in a table. Scanning a conversation from its last row to its first is one look-up a row and gives the cost. The trace goes the
other way along tight arcs, the ASCII-least edit first, and gives the audit; its steps are kept in a table too.

How it scales. Rows are dealt by ranges of (conv_id, turn), so a conversation that holds a third of all rows is spread over many tasks. A task finishes the conversations that begin and end
inside its range. Of those at its edges (two at most) the rows go on: their duplicates are found by a grouping, each range's part becomes a matrix of costs from state to
state, and the matrices of a conversation, one a range, give the vector behind each part. What follows is a stream through the parts in order, since a SHA-256 can't be computed
in pieces; it holds one part at a time, and the audit. Texts are shuffled once, and those at edges twice more.

Cases. Null role or text: one space. Null conv_id: a conversation of its own. Null turns come first; rows of one turn are ordered by role, then by the MD5 of the text. Repeated rows: all but the first
are duplicates. Roles other than system, user and assistant go by their first letter; an empty role has none. Empty table: no rows. Other columns are ignored. Very long texts: a row is handled whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_call, materialize, shuffle_parts

SPACE = " \t\n\v\f\r"
INF = float("inf")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: State after a user or assistant row is added in each state, and after a row with a given initial is kept.
ADDED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
END = (0, 6, 3, 0)  # from each state, what inserting the missing rows costs
ROLE = {2: "user", 3: "assistant"}


class Automaton:
    """Normalised cost vectors as states, made when first met. A kind of row is (initial, truncated), or None for one to be deleted."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[tuple, tuple[int, float]] = {}
        self.traces: dict[tuple, tuple[str, int]] = {}

    def state(self, vector) -> tuple[int, float]:
        """Number of the vector's state, and the least entry it is normalised by."""
        least = min(vector)
        normal = tuple(x - least for x in vector)
        if normal not in self.number:
            self.number[normal] = len(self.vectors)
            self.vectors.append(normal)
        return self.number[normal], least

    def before(self, after: int, kind) -> tuple[int, float]:
        """State before a row of that kind, and what the least entry grew by; ``after``: state behind the row."""
        move = self.moves.get((after, kind))
        if move is None:
            v = self.vectors[after]
            out = [min(cost + v[to] for _, cost, to in self.edits(q, kind)) for q in range(4)]
            for _ in range(3):  # inserts before the row
                out = [min(out[q], INSERT + out[ADDED[q]]) for q in range(4)]
            move = self.moves[after, kind] = self.state(out)
        return move

    @staticmethod
    def edits(q: int, kind) -> list[tuple[str, float, int]]:
        found = [("D", DELETE, q)]
        if kind is not None:
            initial, truncated = kind
            more = TRUNCATED if truncated else 0
            to = KEPT[initial][q] if initial in KEPT else None
            if to is not None:
                found.append(("K", KEEP + more, to))
            found.append(("R", REROLE + more, ADDED[q]))
        return found

    def trace(self, after: int, kind, q: int) -> tuple[str, int]:
        """Edits from state q of the grammar over one row, with inserts before it, and the state behind it: the least letters among tight arcs."""
        found = self.traces.get((after, kind, q))
        if found is None:
            number, grew = self.before(after, kind)
            here, v, letters, at = self.vectors[number], self.vectors[after], "", q
            while True:
                tight = [(e, to) for e, cost, to in self.edits(at, kind) if cost + v[to] == grew + here[at]]
                tight += [("I", ADDED[at])] if INSERT + here[ADDED[at]] == here[at] else []
                letter, at = min(tight)
                letters += letter
                if letter != "I":
                    break
            found = self.traces[after, kind, q] = letters, at
        return found

    def scan(self, kinds: list, vector) -> tuple[list[int], float]:
        """States before each row and behind the last one, and the sum of what normalising took off."""
        state, total = self.state(vector)
        states = [state]
        for kind in reversed(kinds):
            state, grew = self.before(state, kind)
            total += grew
            states.append(state)
        states.reverse()
        return states, total

    def matrix(self, kinds: list) -> list[list[float]]:
        """Cost of passing the rows, from each state to each state."""
        out = [[INF] * 4 for _ in range(4)]
        for to in range(4):
            states, total = self.scan(kinds, tuple(0 if q == to else INF for q in range(4)))
            for q in range(4):
                out[q][to] = total + self.vectors[states[0]][q]
        return out


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1] not in ".!?"


class Conversation:
    """Rows of one conversation in order, in one or several parts."""

    def __init__(self, machine: Automaton):
        self.machine, self.q, self.cost = machine, 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0
        self.rows: list[tuple[str, str]] = []

    def add(self, rows: list, vector=END, keep_rows: bool = False) -> None:
        """rows: (turn, role, text, duplicate); vector: costs behind them."""
        kinds = []
        for turn, role, text, again in rows:
            initial = role[:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            if turn is not None:
                if turn != self.most:
                    self.turns += 1
                self.least = turn if self.least is None else self.least
                self.most = turn
            if is_blank(text):
                self.blank += 1
                kinds.append(None)
            elif again:
                self.duplicate += 1
                kinds.append(None)
            else:
                cut = is_truncated(text)
                self.truncated += cut
                kinds.append((initial, cut))
        states, total = self.machine.scan(kinds, vector)
        if self.cost is None:
            self.cost = total + self.machine.vectors[states[0]][0]
        for k, (kind, (_, role, text, _)) in enumerate(zip(kinds, rows, strict=True)):
            q = self.q
            letters, self.q = self.machine.trace(states[k + 1], kind, q)
            self.audit.append(letters)
            for letter in letters:
                if letter == "K":
                    self.line(role, text, keep_rows)
                elif letter == "R":
                    self.line(ROLE[ADDED[q]], text, keep_rows)
                elif letter == "I":
                    q = ADDED[q]
                    self.line(ROLE[q], "", keep_rows)

    def line(self, role: str, text: str, keep: bool) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        if keep:
            self.rows.append((role, text))

    def close(self, keep_rows: bool = False) -> dict:
        """Inserts what is missing at the end; the conversation's figures."""
        while self.q in (1, 2):
            self.q = ADDED[self.q]
            self.audit.append("I")
            self.line(ROLE[self.q], "", keep_rows)
        gaps = self.most - self.least + 1 - self.turns if self.most is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": int(self.cost or 0), "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FIGURES = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
REPAIRED = "repaired array<struct<role: string, text: string>>"
_FIGURE_TYPES = {c: pa.int64() for c in COUNTS} | {"audit": pa.string(), "repaired_sha256": pa.string(), "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}


class _Out:
    """Result rows of a task, given out in batches."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 1 << 24):
        self.schema, self.most, self.rows, self.bytes = schema, most_bytes, [], 0

    def put(self, row: dict, size: int) -> bool:
        self.rows.append(row)
        self.bytes += 200 + size
        return self.bytes > self.most

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.bytes = [], 0
        return out


def _fields(batch: pa.RecordBatch, keep_rows: bool, *more) -> pa.Schema:
    return pa.schema([("conv_id", batch.schema.field("conv_id").type), *[x for x in _FIGURE_TYPES.items() if keep_rows or x[0] != "repaired"], *more])


def _finished(key, conversation: Conversation, keep_rows: bool) -> dict:
    row = {"conv_id": key} | conversation.close(keep_rows)
    return row | {"repaired": [{"role": r, "text": t} for r, t in conversation.rows]} if keep_rows else row


def _flags(rows):
    seen = set()
    for turn, role, text in rows:
        yield turn, role, text, (role, text) in seen
        seen.add((role, text))


def _ranges(batches, keep_rows: bool):
    """Finished conversations of a sorted range, and the rows of its first and its last one."""
    out, machine, part, at, key, run, edge = None, Automaton(), TaskContext.get().partitionId(), 0, None, [], True
    for batch in batches:
        out = out or _Out(_fields(batch, keep_rows, ("part", pa.int32()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))
        for k, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
            if at and k != key:
                if not edge:
                    done = Conversation(machine)
                    done.add(list(_flags(run)), keep_rows=keep_rows)
                    if out.put(row := _finished(key, done, keep_rows), len(row["audit"]) + sum(len(x[2]) for x in run) * keep_rows):
                        yield out.take()
                run, edge = [], False
            key = k
            at += 1
            if not edge:
                run.append((turn, role, text))
            elif out.put({"conv_id": k, "part": part, "at": at, "turn": turn, "role": role, "text": text}, len(text)):
                yield out.take()
    for n, (turn, role, text) in enumerate(run):
        if out.put({"conv_id": key, "part": part, "at": at - len(run) + n, "turn": turn, "role": role, "text": text}, len(text)):
            yield out.take()
    if out and out.rows:
        yield out.take()


def _matrix(table: pa.Table, machine: Automaton) -> pa.Table:
    """One row: the cost matrix of a part, row by row; infinite where there is no way."""
    rows = sorted(zip(table.column("at").to_pylist(), table.column("kind").to_pylist(), strict=True))
    kinds = [None if kind == "D" else (kind[1:], kind[0] == "T") for _, kind in rows]
    m = machine.matrix(kinds)
    return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "part": table.column("part").slice(0, 1), "matrix": pa.array([[float(x) for row in m for x in row]], pa.list_(pa.float64()))})


def _behind(table: pa.Table) -> pa.Table:
    """Cost vectors behind each part of a conversation, from its parts' matrices."""
    order = sorted(range(table.num_rows), key=table.column("part").to_pylist().__getitem__, reverse=True)
    matrices, vector, out = table.column("matrix").to_pylist(), [float(x) for x in END], [None] * table.num_rows
    for i in order:
        out[i] = vector
        m = matrices[i]
        vector = [min(m[4 * q + to] + vector[to] for to in range(4)) for q in range(4)]
    return pa.table({"of": table.column("conv_id"), "of_part": table.column("part"), "vector": pa.array(out, pa.list_(pa.float64()))})


def _through(batches, keep_rows: bool):
    """Conversations in several parts: a part's rows are held, then the next one's."""
    out, machine, now, held, vector, conversation = None, Automaton(), None, [], None, None
    for batch in batches:
        out = out or _Out(_fields(batch, keep_rows))
        for k, part, turn, role, text, again, v in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "again", "vector")], strict=True):
            if now is not None and now != (k, part):
                conversation.add(held, vector, keep_rows)
                held = []
                if now[0] != k:
                    if out.put(row := _finished(now[0], conversation, keep_rows), len(row["audit"])):
                        yield out.take()
                    conversation = None
            conversation = conversation or Conversation(machine)
            now, vector = (k, part), tuple(v)
            held.append((turn, role, text, again))
    if now is not None:
        conversation.add(held, vector, keep_rows)
        out.put(_finished(now[0], conversation, keep_rows), 0)
        yield out.take()


def repair(conversations: DataFrame, rows: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations(conv_id, turn, role, text); with rows, the repaired rows as an array too."""
    kind = dict(conversations.dtypes)["conv_id"]
    none = F.lit(" ")
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    given = given.withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("read_at", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("tie"), F.col("read_at")]
    dealt = given.repartitionByRange(shuffle_parts(conversations.sparkSession), *keys).sortWithinPartitions(*keys).drop("tie", "read_at")
    figures = FIGURES + (f", {REPAIRED}" if rows else "")
    passed = materialize(dealt.mapInArrow(lambda it: lean(_ranges(it, rows)), f"conv_id {kind}, {figures}, part int, at long, turn long, role string, text string"), "conversations")
    done = passed.filter("part IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256", *["repaired"] * rows)

    edges = passed.filter("part IS NOT NULL").select("conv_id", "part", "at", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("tie"))
    first = edges.groupBy("conv_id", "role", "tie").agg(F.min(F.struct("part", "at")).alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tie").alias("t"), "first")
    met = edges.conv_id.eqNullSafe(first.c) & (edges.role == first.r) & (edges.tie == first.t)
    flagged = materialize(edges.join(first, met).select("conv_id", "part", "at", "turn", "role", "text", (F.struct("part", "at") > F.col("first")).alias("again")), "edges")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    row_kind = F.when(F.col("again") | (last == ""), "D").otherwise(F.concat(F.when(last.isin(".", "!", "?"), "-").otherwise("T"), F.left("role", F.lit(1))))
    kinds = flagged.select("conv_id", "part", "at", row_kind.alias("kind"))
    matrices = kinds.groupBy("conv_id", "part").applyInArrow(lambda t: lean_call(_matrix, t, Automaton()), f"conv_id {kind}, part int, matrix array<double>")
    behind = matrices.groupBy("conv_id").applyInArrow(lambda t: _behind(t), f"of {kind}, of_part int, vector array<double>")
    streamed = flagged.join(behind, flagged.conv_id.eqNullSafe(behind.of) & (flagged.part == behind.of_part)).drop("of", "of_part")
    streamed = streamed.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "at")
    through = streamed.mapInArrow(lambda it: lean(_through(it, rows)), f"conv_id {kind}, {figures}")
    return done.unionByName(through)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults by crc32(conv_id:turn) modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user. Nulls: one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(conversations: DataFrame) -> DataFrame:
    """Figures of every conv_id of conversations(conv_id, turn, role, text), damaged, then repaired; those that lost all rows have zeros, an empty audit and the empty string's hash."""
    ids = conversations.select("conv_id").distinct()
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "of")
    joined = ids.join(found, ids.conv_id.eqNullSafe(found.of), "left")
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
