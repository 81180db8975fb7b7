"""Repair of conversations: pieces and tables against a plain dynamic programme."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from plotweave.llm import queries, turn_repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def follows(state, initial):
    if initial == "s":
        return "s" if state == "" else None
    if initial == "u":
        return "u" if state in ("", "s", "a") else None
    return "a" if initial == "a" and state == "u" else None


def plain_repair(rows):
    """Cost, audit and turns, cheapest first and then least, one row after the other."""
    def inserted(now):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, out) in list(now.items()):
                for role in ("user", "assistant"):
                    to = follows(state, role[0])
                    new = (cost + 3, audit + "I", [*out, (role, "")])
                    if to is not None and (to not in now or new[:2] < now[to][:2]):
                        now[to], changed = new, True
        return now

    now, seen = inserted({"": (0, "", [])}), set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        must = not bare or (role, text) in seen
        extra = 0 if must or bare[-1] in ".!?" else 3
        seen.add((role, text))
        new = {}

        def put(state, way):
            if state is not None and (state not in new or way[:2] < new[state][:2]):
                new[state] = way

        for state, (cost, audit, out) in now.items():
            put(state, (cost + 4, audit + "D", out))
            if not must:
                put(follows(state, role[:1]), (cost + extra, audit + "K", [*out, (role, text)]))
                for other in ("user", "assistant"):
                    put(follows(state, other[0]),
                        (cost + 3 + extra, audit + "R", [*out, (other, text)]))
        now = inserted(new)
    return min((now[s] for s in ("", "a") if s in now), key=lambda way: way[:2])


def some_conversations(seed, count, longest):
    rng = random.Random(seed)
    return [[(i, rng.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]),
              rng.choice(["a.", "b.", "c", "", "d!", "e.", "f?"]))
             for i in range(rng.randrange(1, longest))] for _ in range(count)]


def pieces_of(rows, size):
    seen, out = set(), []
    for turn, role, text in rows:
        if not out or out[-1].rows >= size:
            out.append(R.Piece((True, "1")))
        out[-1].add(turn, role, text, 1, (role, text) not in seen)
        seen.add((role, text))
    return out


@pytest.mark.parametrize("size", [100, 1, 2, 5])
def test_pieces_give_the_least_of_the_cheapest(size):
    for rows in some_conversations(size, 250, 14):
        pieces = pieces_of(rows, size)
        ways = R.transfer_costs(pieces)
        total = R._combine([{**R._facts(p, i, 0, False), "transfer": ways[i].reshape(-1).tolist()}
                            for i, p in enumerate(pieces)])
        ends = np.array([e["ends"] for e in total["ends"]])
        closed = np.array([e["closed"] for e in total["ends"]])
        exits = R.exit_states(pieces, ends, closed)
        entries = R._entries([{"part": 0, "piece": i, "exits": x.tolist()}
                              for i, x in enumerate(exits)])["entries"]
        parts = R.repaired(pieces, ends, closed, np.array([e["entry"] for e in entries]))
        turns = [(t["role"], t["text"]) for _, _, made in parts for t in made]
        assert (total["cost"], "".join(a for _, a, _ in parts), turns) == plain_repair(rows)
        assert parts[0][0] == total["cost"]


def test_ranks_of_doubled_lengths_order_the_audits():
    pieces = [p for rows in some_conversations(3, 40, 12) for p in pieces_of(rows, 99)]
    nodes, closed = R.Nodes(pieces), np.ones(len(pieces), bool)
    on, to = nodes.arcs(nodes.costs(np.tile(np.array(R._END), (len(pieces), 1)), closed), closed)
    letter, pointers, steps = R.least_paths(on, to)
    for start in range(len(letter)):
        nodes_met, _ = R.path_nodes(np.array([start]), pointers, steps)
        at, walked = start, []
        while letter[at]:
            walked.append(at)
            at = int(to[at, letter[at] - 1])
        assert nodes_met.tolist() == walked


def plain_row(conv, rows):
    """The contract's row of a conversation after damage, its rows in order."""
    known = [t for t, _, _ in rows if t is not None]
    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        kind = ("blank" if not bare else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?" else None)
        if kind:
            counts[kind] += 1
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, turns = plain_repair(rows) if rows else (0, "", [])
    said = "\n".join(f"{role}:{text}" for role, text in turns)
    return {"conv_id": conv, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            **counts, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(said.encode()).hexdigest()}


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                       hashlib.sha256(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("limits", [{}, {"piece_rows": 2}, {"piece_chars": 3}])
def test_tables(spark, limits):
    rng = random.Random(5)
    table = [(conv, *row) for conv, rows in enumerate(some_conversations(11, 30, 12))
             for row in rows]
    table += [(None, t, r, x) for t, r, x in some_conversations(12, 1, 40)[0]]
    table += [(70, None, "user", "a."), (70, None, "user", "a."), (70, 4, None, None),
              (71, None, None, None), (72, 0, "user", "x. " * 40_000)] + [(73, 1, "user", "q.")] * 50
    table += [(74, i, rng.choice(["user", "assistant"]), f"{i}.") for i in range(60)]
    made = R.repair_digests(spark.createDataFrame(table, SCHEMA).repartition(7),
                            spark.createDataFrame([*table, (99, 1, "user", "gone")], SCHEMA), **limits)
    got = {r["conv_id"]: r.asDict() for r in made.collect()}
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, []).append((turn, " " if role is None else role,
                                           " " if text is None else text))
    expected = {conv: plain_row(conv, ordered(rows)) for conv, rows in convs.items()}
    expected[99] = plain_row(99, [])
    assert got == expected


def test_totals_and_turns_of_the_general_form(spark):
    rows = spark.createDataFrame([("x", 1, "assistant", "hi.", 9)],
                                 "chat string, no int, who string, said string, known int")
    totals, texts = R.repair(rows, "chat", "no", "who", "said")
    assert [(r["conv"], r["cost"], r["illegal"]) for r in totals.collect()] == [("x", 3, 0)]
    found = texts.collect()
    assert [(r["audit"], [tuple(t) for t in r["repaired"]]) for r in found] == [
        ("IK", [("user", ""), ("assistant", "hi.")])]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair_digests(R.damaged(none), none).count() == 0


def test_damage_follows_the_checksum(spark):
    table = [(c, t, "assistant", "Yes. No!") for c in range(20) for t in range(5)] + [
        (None, None, None, None), (3, None, None, "x.")]
    got = sorted(map(repr, (tuple(r) for r in R.damaged(
        spark.createDataFrame(table, SCHEMA)).collect())))
    expected = []
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        row = (conv, turn, "user" if kind == 4 else role, text)
        expected += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(map(repr, expected))


def test_query_with_nulls_and_ties_equals_its_sql(spark, tmp_path):
    rng = random.Random(8)
    table = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]),
              rng.choice([None, "user", "assistant", "system", "robot"]),
              rng.choice([None, "", " \t", "a.", "b", "c!", "d. "])) for _ in range(300)]
    frame = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as copies", "2 as digest")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_turn_repair"](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as con:
        con.execute(f"create view conversations as "
                    f"select * from '{tmp_path}/conversations.parquet/*.parquet'")
        expected = con.execute(queries.ORACLES["op13_turn_repair"]).df()[list(got.columns)]

    def plain(df):
        return sorted(map(repr, df.astype({"conv_id": "Int64"}).astype(str).values.tolist()))

    assert plain(got) == plain(expected)
