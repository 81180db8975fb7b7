"""Repair of a conversation's structure at the least cost, with an audit of the edits.

Rows of a conversation are kept (0), given another role (3) or deleted (4), and empty turns are
inserted (3), so that the roles read: a system turn or none, then user and assistant in turn. Of
all cheapest ways the one whose audit (the edits' initials) comes first in ASCII order is taken.

States are what the last turn written was: nothing, system, user, assistant. A conversation's
nodes are its places between rows, in each state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plotweave.llm.common import staged

KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 0, 3, 4, 3, 3
LETTERS = np.array(["", "D", "I", "K", "R"])
ROLES = {2: "user", 3: "assistant"}
#: Rows, and characters of their texts, that are repaired in one piece; longer conversations go
#: in several, whose costs are combined.
PIECE_ROWS = 20_000
PIECE_CHARS = 8_000_000

_BATCH_ROWS = 4_000
_NEVER = 1 << 50
_BLANKS = " \t\n\x0b\x0c\r"
_NEXT = np.array([2, 2, 3, 2])  # the state after the only turn that may follow
_END = (0, _NEVER, _NEVER, 0)


# --- One piece ---------------------------------------------------------------------------------


@dataclass
class Piece:
    """Consecutive rows of a conversation. A symbol is a row that may stay, or a run of rows that
    have to go (their number in ``gone``, else 0)."""

    key: tuple
    initial: list[int] = field(default_factory=list)  # state that keeping the row leads to, or 0
    cut: list[bool] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    rows: int = 0
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        """``copies`` equal rows, the first of which is the first of its role and text or not."""
        initial, bare = role[:1], text.strip(_BLANKS)
        if self.rows and (self.last_initial or "") + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1
        if not self.rows:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.rows += 1
        if not bare:
            self.blank += copies
            self._drop(copies)
            return
        if not first:
            self.duplicate += copies
            self._drop(copies)
            return
        ends = bare[-1] in ".!?"
        self.truncated += not ends
        self.duplicate += copies - 1
        self._put({"s": 1, "u": 2, "a": 3}.get(initial, 0), not ends, 0, role, text)
        self.chars += len(text)
        if copies > 1:
            self._drop(copies - 1)

    def _drop(self, rows: int) -> None:
        if self.gone and self.gone[-1]:
            self.gone[-1] += rows
        else:
            self._put(0, False, rows, "", "")

    def _put(self, initial: int, cut: bool, gone: int, role: str, text: str) -> None:
        self.initial.append(initial)
        self.cut.append(cut)
        self.gone.append(gone)
        self.role.append(role)
        self.text.append(text)


class Nodes:
    """Costs, arcs and least paths of several pieces at once.

    A piece of n symbols has n + 1 places, each in four states. The costs are found from the last
    place to the first, all pieces in step.
    """

    def __init__(self, pieces: list[Piece]):
        self.size = np.array([len(p.gone) for p in pieces], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size + 1)))
        places = int(self.first[-1])
        self.last = self.first[1:] - 1
        inner = np.ones(places, bool)
        inner[self.last] = False
        self.inner = inner
        self.initial = np.zeros(places, np.int64)
        self.extra = np.zeros(places, np.int64)
        gone = np.zeros(places, np.int64)
        if places > len(pieces):
            self.initial[inner] = np.concatenate([p.initial for p in pieces])
            self.extra[inner] = CUT_COST * np.concatenate([p.cut for p in pieces])
            gone[inner] = np.concatenate([p.gone for p in pieces])
        self.stays = inner & (gone == 0)
        self.delete = DELETE_COST * np.where(gone > 0, gone, 1)

    def costs(self, ends: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Least cost from each place and state to the end of its piece, where the states cost
        ``ends``. Turns may be inserted at the end of a piece that is ``closed``, the last of its
        conversation; elsewhere the next piece's first place stands for it."""
        best = np.full((int(self.first[-1]), 4), _NEVER, np.int64)
        best[self.last] = np.where(closed[:, None], _with_inserts(ends), ends)
        order = np.argsort(-self.size, kind="stable")
        size, last = self.size[order], self.last[order]
        for back in range(1, int(size[0]) + 1 if len(size) else 1):
            at = last[:np.searchsorted(-size, -back, side="right")] - back
            after = best[at + 1]
            follow = after[:, _NEXT]
            extra = self.extra[at][:, None]
            keep = np.where(self._fits(at), extra + follow, _NEVER)
            keep[:, 0] = np.where(self.initial[at] == 1, self.extra[at] + after[:, 1], keep[:, 0])
            change = ROLE_COST + extra + follow
            stay = np.where(self.stays[at][:, None], np.minimum(keep, change), _NEVER)
            best[at] = _with_inserts(np.minimum(stay, self.delete[at][:, None] + after))
        return np.minimum(best, _NEVER)

    def _fits(self, at: np.ndarray) -> np.ndarray:
        return self.initial[at][:, None] == _NEXT[None, :]

    def arcs(self, best: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node and letter (D, I, K, R): whether that edit is on a cheapest way, and the
        node it leads to. A letter leads from a node to one node only."""
        places = len(best)
        at = np.arange(places)
        open_end = np.zeros(places, bool)
        open_end[self.last] = ~closed
        after = np.where(self.inner, at + 1, at)
        state = np.arange(4)[None, :]
        to = np.empty((places, 4, 4), np.int64)
        to[:, :, 0] = 4 * after[:, None] + state
        to[:, :, 1] = 4 * at[:, None] + _NEXT[None, :]
        to[:, :, 2] = to[:, :, 3] = 4 * after[:, None] + _NEXT[None, :]
        system = self.initial == 1
        to[system, 0, 2] = 4 * after[system] + 1
        cost = np.empty_like(to)
        cost[:, :, 0] = np.where(self.inner, self.delete, _NEVER)[:, None]
        cost[:, :, 1] = np.where(open_end, _NEVER, INSERT_COST)[:, None]
        fits = self._fits(at)
        fits[system, 0] = True
        cost[:, :, 2] = np.where(fits & self.stays[:, None], self.extra[:, None], _NEVER)
        cost[:, :, 3] = np.where(self.stays, ROLE_COST + self.extra, _NEVER)[:, None]
        known = best < _NEVER
        on = (cost + best.reshape(-1)[to] == best[:, :, None]) & known[:, :, None] & (
            cost < _NEVER)
        return on.reshape(-1, 4), to.reshape(-1, 4)


def _with_inserts(raw: np.ndarray) -> np.ndarray:
    """Costs of the states at a place once empty turns may be inserted there."""
    out = raw.copy()
    out[..., 2] = np.minimum(raw[..., 2], raw[..., 3] + INSERT_COST)
    out[..., 3] = np.minimum(raw[..., 3], raw[..., 2] + INSERT_COST)
    for state in (0, 1):
        out[..., state] = np.minimum(raw[..., state], out[..., 2] + INSERT_COST)
    return out


def least_paths(on: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The letter of each node's first edit on its least audit (0 at an end), pointers over 1, 2,
    4, ... edits of it, and the number of its edits.

    Nodes are ranked by the least audits of length 1, then 2, 4 and so on: the rank for twice a
    length is that of the pair (own rank, rank of the node behind that many edits). Arcs that a
    rank shows to lead to a later audit are dropped on the way.
    """
    none = len(LETTERS)
    alive = on.copy()
    letters = np.where(alive, np.arange(1, none)[None, :], none)
    letter = letters.min(axis=1)
    letter[letter == none] = 0
    alive &= letters == letter[:, None]
    own = np.arange(len(on))

    def followed() -> np.ndarray:
        return np.where(letter > 0, to[own, alive.argmax(axis=1)], own)

    rank, pointer = letter, followed()
    while (letter[pointer] > 0).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1]
        behind = np.where(alive, rank[to], len(on))
        alive &= behind == behind.min(axis=1)[:, None]
        pointer = pointer[pointer]
    steps = (letter > 0).astype(np.int64)
    pointers = [followed()]
    while (letter[pointers[-1]] > 0).any():
        steps = steps + steps[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    return letter, pointers, steps


def path_nodes(starts: np.ndarray, pointers: list[np.ndarray], steps: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the paths from ``starts`` one after the other (their ends left out), and the path
    each is on: the node after d edits is met by the pointers of d's binary digits."""
    count = steps[starts]
    path = np.repeat(np.arange(len(starts)), count)
    ahead = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
    nodes = starts[path]
    for k, pointer in enumerate(pointers):
        move = (ahead >> k) & 1 > 0
        nodes[move] = pointer[nodes[move]]
    return nodes, path


def repaired(pieces: list[Piece], ends: np.ndarray, closed: np.ndarray, entry: np.ndarray
             ) -> list[tuple[int, str, list[dict]]]:
    """Cost from the entry state on, audit and repaired turns of each piece."""
    nodes = Nodes(pieces)
    best = nodes.costs(ends, closed)
    on, to = nodes.arcs(best, closed)
    letter, pointers, steps = least_paths(on, to)
    starts = 4 * nodes.first[:-1] + entry
    met, path = path_nodes(starts, pointers, steps)
    edits, place, then = letter[met], met // 4, pointers[0][met] % 4
    out = []
    bounds = np.searchsorted(path, np.arange(len(pieces) + 1))
    for i, piece in enumerate(pieces):
        audit, turns = [], []
        part = slice(bounds[i], bounds[i + 1])
        for edit, symbol, state in zip(edits[part].tolist(),
                                       (place[part] - nodes.first[i]).tolist(),
                                       then[part].tolist()):
            audit.append(str(LETTERS[edit]) * (max(1, piece.gone[symbol]) if edit == 1 else 1))
            if edit == 2:
                turns.append({"role": ROLES[state], "text": ""})
            elif edit > 2:
                turns.append({"role": piece.role[symbol] if edit == 3 else ROLES[state],
                              "text": piece.text[symbol]})
        out.append((int(best[nodes.first[i], entry[i]]), "".join(audit), turns))
    return out


def transfer_costs(pieces: list[Piece]) -> np.ndarray:
    """Least cost from each state before each piece to each state behind it."""
    nodes = Nodes(pieces)
    closed = np.zeros(len(pieces), bool)
    out = np.empty((len(pieces), 4, 4), np.int64)
    for state in range(4):
        ends = np.full((len(pieces), 4), _NEVER, np.int64)
        ends[:, state] = 0
        out[:, :, state] = nodes.costs(ends, closed)[nodes.first[:-1]]
    return out


def exit_states(pieces: list[Piece], ends: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """The state behind each piece on the least path from each state before it."""
    nodes = Nodes(pieces)
    on, to = nodes.arcs(nodes.costs(ends, closed), closed)
    letter, pointers, _ = least_paths(on, to)
    starts = (4 * nodes.first[:-1, None] + np.arange(4)[None, :]).reshape(-1)
    return (pointers[-1][starts] % 4).reshape(-1, 4)


# --- Tables ------------------------------------------------------------------------------------

_KEY = ["known", "conv"]
_ORDER = ["turn_known", "turn", "role", "digest"]
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
_TURNS = "array<struct<role:string,text:string>>"
_SYMBOLS = "array<struct<initial:int,cut:boolean,gone:bigint,role:string,text:string>>"
_PIECES = ("known boolean, conv string, part int, piece int, whole boolean, "
           + "".join(f"{c} bigint, " for c in _COUNTS)
           + "first_initial string, last_initial string, transfer array<bigint>, "
           f"symbols {_SYMBOLS}, cost bigint, audit string, repaired {_TURNS}")


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """Turns with faults by the CRC-32 of ``conversation:turn`` modulo 20: 0 is dropped, 1 loses
    its text, 2 its sentence marks, 3 is repeated, 4 becomes a user's. Nulls in it, and null roles
    and texts, are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conversation}`").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`"), space)
    return turns.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(f"`{role}`"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(
            said).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(
            kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _conversation_key(turns: DataFrame, conversation: str) -> list[Column]:
    own = F.col(f"`{conversation}`")
    return [own.isNotNull().alias("known"), F.coalesce(own.cast("string"), F.lit("")).alias("conv")]


def _ordered_rows(turns: DataFrame, conversation: str, turn: str, role: str, text: str
                  ) -> DataFrame:
    """Different rows of each conversation with their number and whether no earlier row has their
    role and text, sorted, over partitions that may split a conversation.

    Equal rows are counted before the shuffle, so repeats cannot crowd a partition, and both sides
    of the join have one row per key.
    """
    number, space = F.col(f"`{turn}`").cast("bigint"), F.lit(" ")
    plain = turns.select(
        *_conversation_key(turns, conversation), number.isNotNull().cast("int").alias("turn_known"),
        F.coalesce(number, F.lit(0).cast("bigint")).alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`"), space).alias("text")).withColumn(
        "digest", F.sha2("text", 256))
    rows = plain.groupBy(*_KEY, *_ORDER).agg(
        F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    seen = plain.groupBy(*_KEY, "role", "digest").agg(
        F.min(F.struct("turn_known", "turn")).alias("f")).select(
        *_KEY, "f.*", "role", "digest", F.lit(True).alias("first"))
    return rows.join(seen, [*_KEY, *_ORDER], "left").select(
        *_KEY, *_ORDER, "text", "copies", F.coalesce("first", F.lit(False)).alias("first"),
    ).repartitionByRange(*_KEY, *_ORDER).sortWithinPartitions(*_KEY, *_ORDER)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    """For the driver: reading a schema takes a session."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _facts(piece: Piece, number: int, part: int, whole: bool) -> dict:
    return {"known": piece.key[0], "conv": piece.key[1], "part": part, "piece": number,
            "whole": whole, "first_initial": piece.first_initial,
            "last_initial": piece.last_initial, **{c: getattr(piece, c) for c in _COUNTS}}


def _cut_pieces(piece_rows: int, piece_chars: int):
    """Sorted rows to pieces: a conversation that lies whole in its partition is repaired at once,
    many in one go; the first and the last of a partition, which may go on in another, and very
    long ones become pieces that say what each way through them costs."""

    schema = _arrow_schema(_PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, number, sure = None, 0, False
        done: list[tuple[Piece, int]] = []

        def finished() -> pa.RecordBatch:
            pieces = [p for p, _ in done]
            every = len(pieces)
            results = repaired(pieces, np.tile(np.array(_END), (every, 1)),
                               np.ones(every, bool), np.zeros(every, np.int64))
            rows = [{**_facts(p, n, part, True), "cost": cost, "audit": audit, "repaired": turns}
                    for (p, n), (cost, audit, turns) in zip(done, results)]
            done.clear()
            return _table(rows, schema)

        def opened(piece: Piece) -> pa.RecordBatch:
            symbols = [dict(zip(("initial", "cut", "gone", "role", "text"), x)) for x in zip(
                piece.initial, piece.cut, piece.gone, piece.role, piece.text)]
            return _table([{**_facts(piece, number, part, False), "symbols": symbols,
                            "transfer": transfer_costs([piece])[0].reshape(-1).tolist()}], schema)

        waiting = chars = 0
        for batch in batches:
            for known, conv, turn_known, turn, role, _, text, copies, first in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != (known, conv):
                    if now is not None:
                        if sure and number == 0:
                            done.append((now, 0))
                            waiting, chars = waiting + now.rows, chars + now.chars
                        else:
                            yield opened(now)
                        sure = True
                    now, number = Piece((known, conv)), 0
                elif now.rows >= piece_rows or now.chars >= piece_chars:
                    yield opened(now)
                    now, number = Piece((known, conv)), number + 1
                now.add(turn if turn_known else None, role, text, copies, first)
                if waiting >= _BATCH_ROWS or chars >= piece_chars:
                    yield finished()
                    waiting = chars = 0
        if done:
            yield finished()
        if now is not None:
            yield opened(now)

    return cut


def _read_piece(symbols: list[dict]) -> Piece:
    return Piece((), *([x[c] for x in symbols]
                       for c in ("initial", "cut", "gone", "role", "text")))


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _combine(pieces: list[dict]) -> dict:
    """Totals of a conversation from its pieces in order, and the costs behind each of them."""
    total = {c: sum(p[c] for p in pieces) for c in (*_COUNTS[:4], "turns")}
    first = next((p["first_turn"] for p in pieces if p["first_turn"] is not None), None)
    last = None
    for before, after in zip(pieces, pieces[1:]):
        total["turns"] -= before["last_turn"] is not None and (
            before["last_turn"] == after["first_turn"])
        total["illegal"] += before["last_initial"] + after["first_initial"] not in (
            "su", "ua", "au")
    last = next((p["last_turn"] for p in reversed(pieces) if p["last_turn"] is not None), None)
    total["gaps"] = 0 if first is None else last - first + 1 - total["turns"]
    ends, behind = [], np.array(_END, np.int64)
    for p in reversed(pieces):
        ends.append({"part": p["part"], "piece": p["piece"], "ends": behind.tolist(),
                     "closed": not ends})
        own = _with_inserts(behind) if len(ends) == 1 else behind
        behind = np.minimum(
            (np.array(p["transfer"]).reshape(4, 4) + own[None, :]).min(axis=1), _NEVER)
    return {**total, "cost": int(behind[0]), "ends": ends[::-1]}


def _by_conversation(pieces: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` on the list of each conversation's pieces in order (a few numbers each)."""
    gathered = pieces.groupBy(*_KEY).agg(F.sort_array(F.collect_list(
        F.struct("part", "piece", *columns))).alias("pieces"))

    made = _arrow_schema(f"known boolean, conv string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([{"known": k, "conv": c, **work(p)} for k, c, p in zip(
                *(x.to_pylist() for x in batch.columns))], made)

    return gathered.mapInArrow(run, f"known boolean, conv string, {schema}")


def _each_piece(pieces: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` on each piece: its symbols and the given columns, to a dictionary."""
    keys = [*_KEY, "part", "piece"]
    kind = f"known boolean, conv string, part int, piece int, {schema}"
    made = _arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _table([{**{k: row[k] for k in keys}, **work(
                    _read_piece(row["symbols"]), *(row[c] for c in columns))}], made)

    return pieces.select(*keys, "symbols", *columns).mapInArrow(run, kind)


def _entries(pieces: list[dict]) -> dict:
    """The state before each piece on the least path: nothing before the first, then what the
    piece before leads to."""
    state, out = 0, []
    for p in pieces:
        out.append({"part": p["part"], "piece": p["piece"], "entry": state})
        state = p["exits"][state]
    return {"entries": out}


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS,
           piece_chars: int = PIECE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Totals and repaired turns of every conversation that has rows.

    The first table has known, conv (the id as text; a null id, not known, is a conversation of
    its own), gaps, blank, duplicate, truncated, illegal and cost. The second has known, conv,
    part, piece, audit and repaired: conversations in pieces in that order, most in one.

    Rows are ordered by turn (nulls first), role and the digest of the text; null roles and texts
    are one space; repeated rows are repeated turns, all but the first of them duplicates. An
    empty table gives two empty ones. Other columns take no part.

    No conversation need fit in a task: rows are sorted over partitions, cut into pieces of
    bounded size, and the costs of the ways through the pieces are combined (four by four numbers
    each). From the costs behind it and the state before it a piece finds its own part of the
    least path.
    """
    staged_pieces, _ = staged(
        _ordered_rows(turns, conversation, turn, role, text).mapInArrow(
            _cut_pieces(piece_rows, piece_chars), _PIECES), "turn-pieces")
    whole = staged_pieces.where("whole")
    part = staged_pieces.where("not whole")
    span = F.when(F.col("first_turn").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))

    summed, _ = staged(_by_conversation(
        part, [*_COUNTS, "first_initial", "last_initial", "transfer"], _combine,
        ", ".join(f"{c} bigint" for c in _NUMBERS)
        + ", ends array<struct<part:int,piece:int,ends:array<bigint>,closed:boolean>>",
    ), "turn-totals")
    keys = [*_KEY, "part", "piece"]
    ends = summed.select(*_KEY, F.explode("ends").alias("e")).select(*_KEY, "e.*")
    open_pieces = part.join(ends, keys)

    def exits(piece: Piece, ends: list[int], closed: bool) -> dict:
        return {"exits": exit_states([piece], np.array([ends]), np.array([closed]))[0].tolist()}

    entries = _by_conversation(
        _each_piece(open_pieces, ["ends", "closed"], exits, "exits array<int>"), ["exits"],
        _entries, "entries array<struct<part:int,piece:int,entry:int>>").select(
        *_KEY, F.explode("entries").alias("e")).select(*_KEY, "e.*")

    def write(piece: Piece, ends: list[int], closed: bool, entry: int) -> dict:
        _, audit, made = repaired(
            [piece], np.array([ends]), np.array([closed]), np.array([entry]))[0]
        return {"audit": audit, "repaired": made}

    written = _each_piece(open_pieces.join(entries, keys), ["ends", "closed", "entry"], write,
                          f"audit string, repaired {_TURNS}")
    return (whole.withColumn("gaps", span).select(*_KEY, *_NUMBERS).unionByName(
                summed.select(*_KEY, *_NUMBERS)),
            whole.select(*keys, "audit", "repaired").unionByName(written))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns and its audit from its pieces in order: a piece at a
    time passes through the hash, so a conversation need not be one value."""
    key, made, audit, empty = None, None, [], True
    for batch in batches:
        for known, conv, edits, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (known, conv) != key:
                if key is not None:
                    yield _digest_row(key, audit, made)
                key, made, audit, empty = (known, conv), hashlib.sha256(), [], True
            audit.append(edits)
            for t in piece:
                made.update((("" if empty else "\n") + f"{t['role']}:{t['text']}").encode())
                empty = False
    if key is not None:
        yield _digest_row(key, audit, made)


def _digest_row(key, audit, made) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "known": [key[0]], "conv": [key[1]], "audit": ["".join(audit)],
        "repaired_sha256": [made.hexdigest()]})


def repair_digests(turns: DataFrame, originals: DataFrame, conversation: str = "conv_id",
                   **options) -> DataFrame:
    """One row per conversation of ``originals``: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 (of the lines ``role:text``) of its ``turns``; zeros,
    an empty audit and the digest of nothing where it has none. Options are those of
    :func:`repair`."""
    totals, texts = repair(turns, conversation, **options)
    kind = originals.schema[conversation].dataType
    digests = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "piece").select(
        *_KEY, "audit", "repaired").mapInArrow(
        _stream_digests, "known boolean, conv string, audit string, repaired_sha256 string")
    every = originals.select(*_conversation_key(originals, conversation)).distinct()
    found = every.join(totals, _KEY, "left").join(digests, _KEY, "left")
    return found.select(
        F.when(F.col("known"), F.col("conv")).cast(kind).alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
