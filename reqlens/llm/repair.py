"""Conversation structure repair by depth-first branch and bound.

A conversation is repaired by edits of its rows: Keep (0), Rerole to user or assistant (1), Delete (2, the
only edit of a blank or duplicate row) and Insert (5, an empty turn anywhere); a truncated row that is
not deleted adds 5. The roles' initials must read ``(s?(ua)+)?`` afterwards. Of the cheapest repairs the
one whose edits' initials are least in ASCII is taken.

The search keeps an explicit stack of prefixes. A node is (rows read, role state): its dominance table entry
is the best (cost, audit) that reached it, and worse prefixes end there. A prefix also ends where its cost and
the suffix's lower bound pass the incumbent. The bound solves a relaxation of the suffix: the conversation may
end after any role. The incumbent is optimal when the stack is empty.

Rows come sorted from a shuffle by conversation and are read as a stream. A conversation of more than ``BLOCK``
rows is searched block by block: the dominance entries at the end of a block, one for each role state, are
the roots of the next search, and each carries its own running hash. So a very long conversation costs
memory for one block, its audit and 16 bytes for each different row, not for its texts.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BLOCK = 512  # rows searched at once
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
# Role states: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
EXPECTED = ("u", "u", "a", "u")  # the role that an edit gives in each state
ROLE_NAMES = {"u": "user", "a": "assistant"}
# From the best state at a block's end every other state's future can be had for two inserts more.
BETWEEN_BLOCKS = 2 * INSERT_COST
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Label = tuple[int, str]  # cost, audit


def row_code(initial: str, fault: str) -> str:
    """One sign for what the search needs of a row: ``x`` must go, else the role's initial (``-`` for
    any other role), as a capital where the text is truncated (``_`` for any other role)."""
    if fault in ("blank", "duplicate"):
        return "x"
    known = initial if initial in ("s", "u", "a") else "-"
    return (known.upper() if known != "-" else "_") if fault == "truncated" else known


def suffix_bounds(codes: str) -> list[tuple[int, int, int]]:
    """Least cost of each suffix where nothing is said yet, a user turn is due, an assistant turn is due.

    Relaxed: the conversation may end in any state.
    """
    nothing = user = assistant = 0
    bounds = [(0, 0, 0)]
    for code in reversed(codes):
        if code == "x":
            nothing, user, assistant = nothing + DELETE_COST, user + DELETE_COST, assistant + DELETE_COST
        else:
            extra = TRUNCATED_COST if code.isupper() or code == "_" else 0
            role = code.lower()
            said_user = assistant + extra + (0 if role == "u" else REROLE_COST)
            said_assistant = user + extra + (0 if role == "a" else REROLE_COST)
            said_system = user + extra if role == "s" else said_user
            nothing, user, assistant = (min(nothing + DELETE_COST, said_user, said_system), min(user + DELETE_COST, said_user),
                                        min(assistant + DELETE_COST, said_assistant))
        due_user, due_assistant = user, assistant
        user, assistant = min(user, due_assistant + INSERT_COST), min(assistant, due_user + INSERT_COST)
        nothing = min(nothing, due_assistant + INSERT_COST)
        bounds.append((nothing, user, assistant))
    return bounds[::-1]


def search(codes: str, roots: dict[int, Label], last: bool) -> dict[int, tuple[Label, int]]:
    """Best label of each role state after the rows, with the state of the root it began at.

    Behind the last row (``last``) only the state of the best repair is returned.
    """
    rows, bounds = len(codes), suffix_bounds(codes)
    phase = (0, 1, 2, 1)
    slack = 0 if last else BETWEEN_BLOCKS
    table: dict[tuple[int, int], Label] = {}
    incumbent: tuple[int, str, int, int] | None = None
    exits: dict[int, tuple[Label, int]] = {}
    stack: list[tuple[int, str, int, int, int]] = []

    def offer(children: list[tuple[int, str, int, int, int]]) -> None:
        """Push the children that no table entry dominates, the most promising one on top."""
        children.sort(key=lambda c: (c[0] + bounds[c[2]][phase[c[3]]], c[1]), reverse=True)
        for child in children:
            cost, audit, row, state, _ = child
            known = table.get((row, state))
            if known is None or (cost, audit) < known:
                table[row, state] = (cost, audit)
                stack.append(child)

    offer([(cost, audit, 0, state, state) for state, (cost, audit) in roots.items()])
    while stack:
        cost, audit, row, state, root = stack.pop()
        if table[row, state] != (cost, audit):
            continue  # a better prefix has reached this node
        if incumbent is not None:
            least = cost + bounds[row][phase[state]]
            if least > incumbent[0] + slack or last and least == incumbent[0] and audit > incumbent[1][:len(audit)]:
                continue
        children = []
        if row == rows:
            if not last:
                exits[state] = ((cost, audit), root)
                if incumbent is None or cost < incumbent[0]:
                    incumbent = (cost, audit, state, root)
                continue
            if state in (NOTHING, ASSISTANT) and (incumbent is None or (cost, audit) < incumbent[:2]):
                incumbent = (cost, audit, state, root)
        else:
            code = codes[row]
            children.append((cost + DELETE_COST, audit + DELETE, row + 1, state, root))
            if code != "x":
                extra = TRUNCATED_COST if code.isupper() or code == "_" else 0
                kept = AFTER[state].get(code.lower())
                if kept is not None:
                    children.append((cost + extra, audit + KEEP, row + 1, kept, root))
                children.append((cost + extra + REROLE_COST, audit + REROLE, row + 1, AFTER[state][EXPECTED[state]], root))
        children.append((cost + INSERT_COST, audit + INSERT, row, AFTER[state][EXPECTED[state]], root))
        offer(children)
    return {incumbent[2]: (incumbent[:2], incumbent[3])} if last else exits


@functools.lru_cache(maxsize=200_000)
def repair_codes(codes: str) -> Label:
    """Cost and audit of the best repair of a conversation of up to ``BLOCK`` rows."""
    (label, _), = search(codes, {NOTHING: (0, "")}, last=True).values()
    return label


def apply_edits(audit: str, turns: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """The repaired turns: edits applied to ``role, text`` from a role state on."""
    rows = iter(turns)
    for edit in audit:
        role, text = next(rows) if edit != INSERT else ("", "")
        if edit == DELETE:
            continue
        if edit != KEEP:
            role = ROLE_NAMES[EXPECTED[state]]
        state = AFTER[state][role[0]]
        yield role, text


class Trail:
    """A running hash of repaired turns."""

    def __init__(self, hashed=None, empty: bool = True):
        self.hashed, self.empty = hashed or hashlib.sha256(), empty

    def onward(self, turns: Iterator[tuple[str, str]]) -> Trail:
        after = Trail(self.hashed.copy(), self.empty)
        for role, text in turns:
            after.hashed.update((f"{role}:{text}" if after.empty else f"\n{role}:{text}").encode())
            after.empty = False
        return after


class Conversation:
    """The rows of one conversation in order, read one by one."""

    def __init__(self, block: int = BLOCK):
        self.block, self.counts = block, dict.fromkeys(COUNTS, 0)
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.codes: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.settled: list[str] = []  # what the audits of all roots begin with
        self.roots: dict[int, tuple[Label, Trail]] = {NOTHING: ((0, ""), Trail())}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        said = text.rstrip(SPACE)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not said else "duplicate" if digest in self.seen else "" if said.endswith(ENDS) else "truncated"
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        if len(self.codes) == self.block:
            self._search_block()
        self.codes.append(row_code(initial, fault))
        self.rows.append((role, text))

    def _search_block(self) -> None:
        found = search("".join(self.codes), {state: label for state, (label, _) in self.roots.items()}, last=False)
        self.roots = self._onward(found)
        common = len(os.path.commonprefix([audit for (_, audit), _ in self.roots.values()]))
        if common:
            self.settled.append(next(iter(self.roots.values()))[0][1][:common])
            self.roots = {state: ((cost, audit[common:]), trail) for state, ((cost, audit), trail) in self.roots.items()}
        self.codes, self.rows = [], []

    def _onward(self, found: dict[int, tuple[Label, int]]) -> dict[int, tuple[Label, Trail]]:
        after = {}
        for state, (label, root) in found.items():
            (_, begun), trail = self.roots[root]
            after[state] = (label, trail.onward(apply_edits(label[1][len(begun):], self.rows, root)))
        return after

    def finish(self) -> tuple:
        """Counts, audit and hash of the repaired turns."""
        codes = "".join(self.codes)
        if self.settled or len(self.roots) > 1 or NOTHING not in self.roots or self.roots[NOTHING][0] != (0, ""):
            found = search(codes, {state: label for state, (label, _) in self.roots.items()}, last=True)
        else:
            found = {NOTHING: (repair_codes(codes), NOTHING)}
        ((cost, audit), trail), = self._onward(found).values()
        self.counts["cost"] = cost
        if self.first_turn is not None:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return (*(self.counts[name] for name in COUNTS), "".join(self.settled) + audit, trail.hashed.hexdigest())


def ordered_rows(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, present``, nulls in role and text as one space."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"), here.alias("present"))


def repair(conversations: DataFrame, present: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each ``conv_id``: its faults, the cheapest repair's cost and audit, and the hash of the repaired turns.

    Reads ``conv_id, turn, role, text`` only. Rows are taken by turn, nulls first, ties by role and text. Null
    roles and texts count as one space, null ids are one conversation. A row's first fault counts: ``blank``
    (no sign but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (last sign that is
    no white space is not ``.!?``). ``illegal`` counts neighbours whose roles' initials are not su, ua or au;
    a role without a sign, or with another initial, fits nowhere and is reroled or deleted. ``gaps`` are the missing
    turn numbers between the first and the last. Where ``present`` is false the row only names its
    conversation; one without rows gives zeros, an empty audit and the hash of nothing. Repeated rows are
    duplicates. An empty table gives an empty result. Very long texts are hashed in a stream of rows. One
    conversation is one task's work: its order is sequential, its memory is bounded (see above).
    """
    rows = ordered_rows(conversations, present)
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType),
                           *(T.StructField(name, T.LongType()) for name in COUNTS),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conversation, done, kind = None, None, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-2]),
                      *(pa.array(c, pa.string()) for c in columns[-2:])]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for frame in batches:
            kind = frame.schema.field("conv_id").type
            for conv_id, turn, role, text, here in zip(*(frame.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "present"))):
                if conversation is None or conv_id != current:
                    if conversation is not None:
                        done.append((current, *conversation.finish()))
                    current, conversation = conv_id, Conversation(block)
                if here:
                    conversation.add(turn, role, text)
            if len(done) > 5000:
                yield batch()
        if conversation is not None:
            done.append((current, *conversation.finish()))
        if done:
            yield batch()

    return placed.mapInArrow(run, schema)


def repaired_turns(conversations: DataFrame, repaired: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired turns, from ``repair`` of the same rows.

    Edits are joined to rows by conversation and place, so a long conversation is no single group here.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (ordered_rows(conversations, present).filter("present").withColumn("source", F.row_number().over(order))
            .select(F.col("conv_id").alias("row_conv"), "source", "role", "text"))
    # Places in the audit: of all edits, of those that read a row, of those that leave a turn.
    upto = Window.partitionBy("conv_id").orderBy("step")
    edits = repaired.select("conv_id", F.posexplode(F.split("audit", "")).alias("step", "edit")).filter("edit <> ''")
    edits = edits.withColumns({"source": F.sum((F.col("edit") != INSERT).cast("int")).over(upto),
                               "place": F.sum((F.col("edit") != DELETE).cast("int")).over(upto)}).filter(F.col("edit") != DELETE)
    mine = edits.withColumn("source", F.when(F.col("edit") != INSERT, F.col("source")))
    joined = mine.join(rows, mine["conv_id"].eqNullSafe(rows["row_conv"]) & (mine["source"] == rows["source"]), "left")
    # A system turn can only come first; behind it user and assistant turns take turns.
    system = F.max(F.when((F.col("place") == 1) & (F.col("edit") == KEEP) & F.col("role").startswith("s"), 1).otherwise(0)).over(
        Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    due = F.when((F.col("place") - F.col("first_is_system")) % 2 == 1, "user").otherwise("assistant")
    return joined.withColumn("first_is_system", system).select(
        mine["conv_id"], "place", "edit", F.when(F.col("edit") == KEEP, F.col("role")).otherwise(due).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 drops, 1 empties, 2 loses its ends, 3 repeats, 4 becomes a user's.

    Nulls count as one space. A dropped row stays with ``present`` false, without role and text.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", ""))
            .otherwise(spaced("text")))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return (conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"))
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy"))
            .drop("copy"))
