"""Conversation repair: Hirschberg against a plain table, the frame against plain Python."""

import hashlib
import heapq
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marketflow.llm import queries, turns
from marketflow.llm.queries import table

from .test_pipeline_operators import empty

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")
GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = "\x20\t\n\x0b\x0c\r"


def by_search(rows):
    """(cost, audit, lines) by uniform-cost search over (row, initials so far), without the four states.

    ``rows``: (role, text, fault).  Initials are kept as a whole; only their
    last two letters and emptiness matter for what may follow."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, said, lines = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch(said):
            return cost, audit, list(lines)
        if (i, said[-2:], len(said) < 2) in done:
            continue
        done.add((i, said[-2:], len(said) < 2))

        def go(step, edit, to, role, line):
            new = said + role
            if any(GRAMMAR.fullmatch(new + x) for x in ("", "a", "ua")):
                heapq.heappush(queue, (cost + step, audit + edit, to, new, lines + ((line,) if line is not None else ())))
        if i < len(rows):
            role, text, fault = rows[i]
            late = 5 if fault == "truncated" else 0
            go(2, "D", i + 1, "", None)
            if fault not in ("blank", "duplicate"):
                if role:
                    go(late, "K", i + 1, role[0], f"{role}:{text}")
                for other in ("user", "assistant"):
                    go(1 + late, "R", i + 1, other[0], f"{other}:{text}")
        for other in ("user", "assistant"):
            go(5, "I", i, other[0], f"{other}:")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def plain_version(rows):
    """The contract's row of one conversation, by the search above."""
    rows = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64]))
    seen, marked = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
        seen.add((role, text))
        marked.append((role, text, fault))
    turn = {r[1] for r in rows if r[1] is not None}
    cost, audit, lines = by_search(marked)
    count = {k: sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")}
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    return {"gaps": max(turn) - min(turn) + 1 - len(turn) if turn else 0, **count, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


SYMBOLS = "suaoSUAOx"


def test_every_short_conversation_equals_the_search():
    texts = {"x": "blank", **{c: "truncated" for c in "SUAO"}}
    for n in range(6):
        for symbols in itertools.product(SYMBOLS, repeat=n) if n < 5 else (random.Random(1).choices(SYMBOLS, k=5) for _ in range(3_000)):
            rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "t", texts.get(c, "none")) for c in symbols]
            cost, audit, _ = by_search(rows)
            codes, got = turns.repaired_whole("".join(symbols))
            assert (got, "".join(codes).translate(str.maketrans("uaUA", "IIRR"))) == (cost, audit), symbols
            if n == 0:
                assert codes == ()


def test_empty_conversation():
    assert turns.repaired_whole("") == ((), 0)


def test_pieces_and_products_equal_the_whole():
    r = random.Random(4)
    for _ in range(400):
        symbols = "".join(r.choices(SYMBOLS, k=r.randint(2, 60)))
        cuts = sorted(r.sample(range(1, len(symbols)), r.randint(1, min(6, len(symbols) - 1))))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        tables = [turns.transfer(p) for p in parts]
        whole = tables[0]
        for t in tables[1:]:
            whole = turns.product(whole, t)
        assert whole == turns.transfer(symbols)
        assert turns.unpacked_table(turns.packed_table(whole)) == whole
        end = turns.last_state(whole[turns.START])
        codes, cost = [], 0
        for p, (a, b) in zip(parts, turns.crossings(tables, turns.START, end)):
            got, c, state = turns.coded(p, a, turns.hirschberg(p, a, b))
            assert state == b
            codes, cost = codes + got, cost + c
        assert (tuple(turns.closed(codes, cost, end)[0]), turns.closed(codes, cost, end)[1]) == turns.repaired_whole(symbols)


def test_long_conversation_takes_linear_space():
    import tracemalloc
    symbols = "".join(random.Random(2).choices(SYMBOLS, k=20_000))
    tracemalloc.start()
    codes, _ = turns.repaired_whole(symbols)
    assert len(codes) == 20_000 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def conversations(r):
    out = []
    for conv in [*range(60), None]:
        for i in range(r.choice([1, 2, 3, 5, 8, 13])):
            turn = None if r.random() < 0.03 else i + (i > 3) * r.choice([0, 2])
            role = r.choice(["user", "assistant", "user" if i % 2 == 0 else "assistant", "system" if i == 0 else "user", "tool", "", None, "ulf"])
            out.append((conv, turn, role, r.choice(["Yes.", "No", f"Text {i}!\n", "", " \t", None, "ok?", f"ü{i}"])))
    out += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Row {t}." if t % 7 else "cut") for t in range(300)]
    out += [(1001, 3, "user", "Same."), (1001, 3, "user", "Same."), (1002, None, None, None), (1002, None, "user", "x"), (1003, 1, "user", "y" * 300_000)]
    out += [(1004, t, "user", "Hm.") for t in range(120)] + [(c, 0, "user", "Hi.") for c in range(2000, 2060)]
    return out


@pytest.mark.parametrize("piece, partitions", [(turns.PIECE, 4), (7, 5), (3, 300)])
def test_frame_equals_plain_python(spark, monkeypatch, piece, partitions):
    rows = conversations(random.Random(9))
    random.Random(1).shuffle(rows)
    schema = "conv_id long, turn long, role string, text string, key string, seq string"
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).repartition(3)
    old = turns.repair_conversations
    monkeypatch.setattr(turns, "repair_conversations", lambda t: old(t, partitions, piece))
    monkeypatch.setattr(queries, "table", lambda *a: df)
    got = {r.conv_id: r.asDict() for r in queries.QUERIES["op13_repaired_conversations"](spark, "").collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, mine in by.items():
        assert got[conv] == {"conv_id": conv, **plain_version(mine)}, mine
    if partitions == 4:
        assert any(not damaged(v) for v in by.values())           # a conversation without rows
        monkeypatch.setattr(queries, "table", lambda *a: empty(df))
        assert queries.QUERIES["op13_repaired_conversations"](spark, "").count() == 0


def test_repaired_rows_read_as_they_should(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 5, "tool", "C."), (2, 0, "system", "S.")]
    repair = turns.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = repaired = turns.repaired_turns(repair).orderBy("part", "seq", "step").collect()
    assert [(r.key, r.turn, r.role, r.text, r.edit) for r in got] == [("=1", 1, "user", "B.", "K"), ("=1", 5, "assistant", "C.", "R")] and repaired
    assert {r.key: (r.cost, r.audit, r.gaps) for r in repair.summary.collect()} == {"=1": (3, "DKR", 3), "=2": (2, "D", 0)}


@needs_data
def test_query_on_the_given_table(spark):
    got = {r.conv_id: r.asDict() for r in queries.QUERIES["op13_repaired_conversations"](spark, SF).collect()}
    by = {}
    for r in table(spark, SF, "conversations").collect():
        by.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    assert set(got) == set(by)
    for conv, mine in by.items():
        assert got[conv] == {"conv_id": conv, **plain_version(mine)}
