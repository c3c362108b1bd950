"""Repair of the order of speakers in saved conversations.

The project keeps no conversations of its own (prompts are sent, not stored), so this job is
general: a turn has ``conversation``, ``turn``, ``role`` and ``content``, the fields of a chat message.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A conversation is empty, or exchanges of user and assistant behind at most one system turn.
GRAMMAR = (("Conversation", ()), ("Conversation", ("Exchanges",)), ("Conversation", ("s", "Exchanges")), ("Exchanges", ("u", "a")), ("Exchanges", ("Exchanges", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}  # the roles a turn can be given
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs; an unfinished turn that stays adds the last
_SETTLE = 64  # turns after which the edits all readings share are settled

Reading = tuple[int, str]  # (cost, initials of the edits)


class Automaton:
    """LR(0) states of a grammar, with the moves of whole stacks.

    A stack is a pair (state, stack below); equal stacks are equal pairs, so the stacks of all
    readings share their lower parts. A move shifts one symbol and then does any number of
    reductions; where the table allows several, it gives several stacks.
    """

    def __init__(self, grammar: Sequence[tuple[str, tuple[str, ...]]]):
        self.grammar = grammar
        self.heads = {head for head, _ in grammar}
        self.start = grammar[0][0]
        self.kernels: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._state(frozenset((i, 0) for i, (head, _) in enumerate(grammar) if head == self.start))
        self.bottom = (0, None)
        self.move = lru_cache(maxsize=4096)(self._move)
        self.accepts = lru_cache(maxsize=4096)(self._accepts)

    def _closed(self, kernel: frozenset) -> set:
        """A kernel with the rules that may begin where its dots stand."""
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            body = self.grammar[rule][1]
            for i, (head, _) in enumerate(self.grammar):
                if dot < len(body) and head == body[dot] and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return items

    def _state(self, kernel: frozenset) -> int:
        if kernel in self.kernels:
            return self.kernels.index(kernel)
        number = len(self.kernels)
        self.kernels.append(kernel)
        items = self._closed(kernel)
        for symbol in sorted({self.grammar[r][1][d] for r, d in items if d < len(self.grammar[r][1])}):
            self.goto[number, symbol] = self._state(frozenset((r, d + 1) for r, d in items if self.grammar[r][1][d : d + 1] == (symbol,)))
        return number

    def _reduced(self, stack: tuple) -> list[tuple]:
        """``stack`` and all that reductions make of it."""
        out = [stack]
        for rule, dot in self._closed(self.kernels[stack[0]]):
            head, body = self.grammar[rule]
            if dot == len(body) and head != self.start:
                below = stack
                for _ in body:
                    below = below[1]
                out += self._reduced((self.goto[below[0], head], below))
        return out

    def _move(self, stack: tuple, symbol: str) -> tuple[tuple, ...]:
        """Stacks after reading ``symbol``: those that can read on or end the conversation."""
        state = self.goto.get((stack[0], symbol)) if symbol not in self.heads else None
        return tuple(dict.fromkeys(self._reduced((state, stack)))) if state is not None else ()

    def _accepts(self, stack: tuple) -> bool:
        """Whether the conversation may end here: some rule of the start symbol is complete on this stack."""
        return any(dot == len(self.grammar[rule][1]) and self.grammar[rule][0] == self.start for rule, dot in self._closed(self.kernels[stack[0]]))


class Repair:
    """All readings of one conversation, turn by turn, as a stack graph.

    The tops of the graph are stacks with the cheapest reading that leads there, ties to the
    initials first in ASCII order. Two readings that reach one stack go on alike, and neither's
    initials begin with the other's, so only the better one is kept. What all readings have in common is settled as
    it goes, so memory holds the open part of a conversation only.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.tops: dict[tuple, Reading] = {automaton.bottom: (0, "")}

    @staticmethod
    def _offer(tops: dict, stack: tuple, reading: Reading) -> bool:
        if stack not in tops or reading < tops[stack]:
            tops[stack] = reading
            return True
        return False

    def _insert(self) -> None:
        """Adds the stacks that inserted turns reach; every insertion costs, so this ends."""
        todo = list(self.tops)
        while todo:
            stack = todo.pop()
            cost, edits = self.tops[stack]
            for symbol in ROLES:
                todo += [after for after in self.automaton.move(stack, symbol) if self._offer(self.tops, after, (cost + INSERT, edits + "I"))]

    def read(self, initial: str, delete_only: bool, unfinished: bool) -> None:
        """One turn, by the initial of its role."""
        self._insert()
        tops: dict[tuple, Reading] = {}
        stay = UNFINISHED if unfinished else 0
        for stack, (cost, edits) in self.tops.items():
            self._offer(tops, stack, (cost + DELETE, edits + "D"))
            if not delete_only:
                for after in self.automaton.move(stack, initial):
                    self._offer(tops, after, (cost + KEEP + stay, edits + "K"))
                for symbol in ROLES:
                    for after in self.automaton.move(stack, symbol):
                        self._offer(tops, after, (cost + REROLE + stay, edits + "R"))
        self.tops = tops

    def settle(self) -> Reading:
        """(cost, edits) that all readings share; they leave the readings."""
        edits = os.path.commonprefix([e for _, e in self.tops.values()])
        cost = min(c for c, _ in self.tops.values())
        self.tops = {s: (c - cost, e[len(edits) :]) for s, (c, e) in self.tops.items()}
        return cost, edits

    def end(self) -> Reading:
        """The best reading of the whole conversation; the rest of it, where parts are settled."""
        self._insert()
        return min(r for s, r in self.tops.items() if self.automaton.accepts(s))


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(GRAMMAR)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = ("su", "ua", "au")
_STOPS = ".!?"
_BLANKS = " \t\n\x0b\x0c\r"


class _Conversation:
    """One conversation while its turns are read."""

    def __init__(self, name):
        self.name, self.repair = name, Repair(automaton())
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.pending: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.first = self.last = self.previous = self.role = None
        self.turns = 0
        self.expected, self.place = None, 0

    def read(self, turn: int | None, role: str, content: str, again: bool) -> list[tuple]:
        """One turn; the repaired turns that are settled by now."""
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        again = again or (turn, role, content) == self.previous
        self.previous = turn, role, content
        words = content.rstrip(_BLANKS)
        fault = "blank" if not words else "duplicate" if again else "truncated" if words[-1] not in _STOPS else None
        if fault:
            self.counts[fault] += 1
        if self.role is not None and self.role + role[:1] not in _LEGAL:
            self.counts["illegal"] += 1
        self.role = role[:1]
        self.repair.read(role[:1], fault in ("blank", "duplicate"), bool(words) and words[-1] not in _STOPS)
        self.pending.append((role, content))
        return self._settled(self.repair.settle()) if len(self.pending) % _SETTLE == 0 else []

    def _settled(self, part: Reading) -> list[tuple]:
        """The repaired turns of some more edits."""
        cost, edits = part
        self.counts["cost"] += cost
        self.audit.append(edits)
        out, at = [], 0
        for edit in edits:
            role, content = ("", "") if edit == "I" else self.pending[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = ROLES[self.expected or "u"]  # users and assistants take turns: the edits so far leave one role
            self.expected = "a" if role[:1] == "u" else "u"
            out.append((self.place, edit, role, content))
            self.place += 1
        del self.pending[:at]
        return out

    def end(self) -> tuple[list[tuple], dict]:
        """The remaining turns and the summary."""
        out = self._settled(self.repair.end())
        if self.turns:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        return out, {**self.counts, "audit": "".join(self.audit)}


_SUMMARY = T.StructType([*(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("audit", T.StringType())])
_CALLS = 2_000  # rows of a batch that a task gives back


def repair_conversations(
    turns: DataFrame, *, conversation: str = "conversation", turn: str = "turn", role: str = "role", content: str = "content"
) -> DataFrame:
    """(conversation, place, edit, role, content, summary): the repaired turns of every conversation, then its summary.

    Turns are read by number, nulls first; turns of one number by role and the MD5 of the content.
    Null roles and contents count as one space; an empty role is nobody's and never kept. A turn is *blank* (nothing but white space), a
    *duplicate* (role and content were there before) or *truncated* (does not end in a full stop,
    exclamation or question mark); the first that holds counts. Edits: Keep, Rerole to user or
    assistant, Delete, Insert of an empty turn; blank turns and duplicates are always deleted. The
    cheapest edits that make the roles a sentence of ``GRAMMAR`` are taken, ties by their initials
    in ASCII order.

    A row with ``place`` is a repaired turn; the row without it stands behind them and has the
    ``summary``: gaps in the numbers, faults, neighbours whose roles must not meet, cost, initials
    of the edits. The rows of a conversation stand together and in order within a partition, so a
    following ``mapInArrow`` can read on without a shuffle (:func:`digest_conversations`).

    Earlier turns are found by a shuffle of digests over (conversation, digest), which also spreads
    a long conversation; then one shuffle brings the turns to their conversation, where they are
    read as a sorted stream: a task holds the open readings and their turns, never a conversation,
    and a null conversation is one of its own. Repeated rows are duplicates; extra columns are left
    behind; an empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), text(role).alias("role"), text(content).alias("content"))
    keyed = rows.withColumn("digest", F.unhex(F.md5("content")))
    marks = _later_turns(keyed).select("conversation", "turn", "role", F.lit(None).cast("string").alias("content"), "digest")
    # markers sort before the turn they speak of
    united = keyed.unionByName(marks)
    ordered = united.repartition(F.xxhash64("conversation")).sortWithinPartitions("conversation", F.asc_nulls_first("turn"), "role", "digest", F.asc_nulls_first("content"))
    return _repaired(ordered.drop("digest"))


def _later_turns(keyed: DataFrame) -> DataFrame:
    """(conversation, role, digest, turn) of the turns whose role and content a turn of a smaller number has."""
    key = ["conversation", "role", "digest"]
    met = keyed.select(*key, "turn").distinct()
    numbered = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"))
    first = met.groupBy(*key).agg(F.min(numbered)["turn"].alias("first"), F.count("*").alias("times")).where("times > 1")
    a, b = met.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    later = ~F.col("a.turn").eqNullSafe(F.col("b.first"))
    return a.join(b, same[0] & same[1] & same[2]).where(later).select("a.*")


def _repaired(ordered: DataFrame) -> DataFrame:
    """The sorted turns, read conversation by conversation."""
    kind = ordered.schema["conversation"].dataType
    fields = [("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("content", T.StringType()), ("summary", _SUMMARY)]
    schema = T.StructType([T.StructField("conversation", kind), *(T.StructField(n, t) for n, t in fields)])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        open_: _Conversation | None = None
        mark, done = None, []

        def close(c: _Conversation) -> None:
            more, summary = c.end()
            done.extend((c.name, *t, None) for t in more)
            done.append((c.name, None, None, None, None, summary))

        for batch in batches:
            arrow = batch.schema.field("conversation").type
            for name, turn, role, content in zip(*(batch.column(n).to_pylist() for n in ("conversation", "turn", "role", "content")), strict=True):
                if content is None:
                    mark = name, turn, role
                    continue
                if open_ is None or name != open_.name:
                    if open_ is not None:
                        close(open_)
                    open_ = _Conversation(name)
                done.extend((name, *t, None) for t in open_.read(turn, role, content, mark == (name, turn, role)))
                mark = None
            if len(done) >= _CALLS:
                yield _batch(done, arrow)
                done.clear()
        if open_ is not None:
            close(open_)
            yield _batch(done, arrow)

    return ordered.mapInArrow(repair, schema)


_ARROW_SUMMARY = pa.struct([*((n, pa.int64()) for n in _COUNTS), ("audit", pa.string())])


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), _ARROW_SUMMARY]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names=["conversation", "place", "edit", "role", "content", "summary"])


def summaries(repaired: DataFrame) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit) of :func:`repair_conversations`."""
    return repaired.where(F.col("place").isNull()).select("conversation", "summary.*")


def digest_conversations(repaired: DataFrame) -> DataFrame:
    """The summaries with ``sha256`` of the repaired turns, ``role:content`` joined by line ends.

    Reads the rows of :func:`repair_conversations` as they stand, in the same stage. A hash can
    only be taken in order, which is why a conversation is read by one task; nothing of it is kept.
    """
    kind = repaired.schema["conversation"].dataType
    schema = T.StructType([T.StructField("conversation", kind), *_SUMMARY.fields, T.StructField("sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, between = hashlib.sha256(), b""
        for batch in batches:
            digests, rows = [], []
            for i, (place, role, content) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("place", "role", "content")), strict=True)):
                if place is not None:
                    state.update(between + f"{role}:{content}".encode())
                    between = b"\n"
                    continue
                digests.append(state.hexdigest())
                rows.append(i)
                state, between = hashlib.sha256(), b""
            if rows:
                kept = batch.take(pa.array(rows))
                summary = kept.column("summary")
                columns = [kept.column("conversation"), *summary.flatten(), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return repaired.mapInArrow(digest, schema)
