"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows in order are repaired by the cheapest edits after which
the role initials read ``(s?(ua)+)?``.  That grammar has four states, and a
row is one of four symbols (``s``, ``u``, ``a`` or other, plus whether it must
go and whether it is truncated), so the best way over a stretch of rows is a
4 x 4 table.  Two cost vectors, forward from the start and backward from the
end, meet in the middle; the crossing with the least sum is fixed and both
halves are repaired by themselves.  No table over all rows is ever kept.

Ties between equally cheap edits go to the ASCII-least audit string.  The
forward vector therefore carries a rank beside each cost: the order of the four
best audits so far.  A crossing lies right after a row's own edit, insertions
come before the next row's, so no audit up to a crossing is the beginning of
another one and their order doesn't depend on what follows.

The rows of all conversations are range-partitioned and cut into pieces of at
most ``PIECE`` rows, written once.  A conversation of one piece is repaired at
once.  Tables of the pieces of longer ones are multiplied by partition, then by
256, 65,536, ... partitions, and the crossings are handed down the same way, so
a conversation that holds a third of all rows is repaired by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import WHITE
from marketflow.session import materialize, ship_package

PIECE = 4096
FAN = 8                      # bits: tables of 2**FAN groups are multiplied in one task
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States: nothing yet, after s, after u, after a.  A conversation may end in 0 or 3.
START, ENDS = 0, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {2: "user", 3: "assistant"}          # what an inserted or re-roled row is, by the state it leads to
FREE = (2, 2, 3, 2)                          # the state after an inserted or re-roled row

# A row's symbol: its initial (``o``: any other), upper case if truncated; ``x`` if it must be deleted.
Vector = list          # per state (cost, rank) or None if out of reach
_steps: dict[str, list] = {}


def steps(symbol: str) -> list[list[tuple[int, str, int]]]:
    """Per state the ways over a row: (cost, edits, next state), insertions first."""
    if symbol not in _steps:
        late = TRUNCATED if symbol.isupper() else 0
        out = []
        for state in range(4):
            best: dict[int, tuple[int, str]] = {}
            cost, edits, at = 0, "", state
            for _ in range(3):                  # two insertions reach all that any number does
                ways = [(DELETE, "D", at)]
                if symbol != "x":
                    ways.append((REROLE + late, "R", FREE[at]))
                    if symbol.lower() in NEXT[at]:
                        ways.append((KEEP + late, "K", NEXT[at][symbol.lower()]))
                for c, e, to in ways:
                    best[to] = min(best.get(to, (cost + c, edits + e)), (cost + c, edits + e))
                cost, edits, at = cost + INSERT, edits + "I", FREE[at]
            out.append([(c, e, to) for to, (c, e) in best.items()])
        _steps[symbol] = out
    return _steps[symbol]


def ranked(best: dict[int, tuple]) -> Vector:
    """Costs with the ranks of their audits' order keys."""
    order = {to: i for i, to in enumerate(sorted(best, key=lambda t: best[t][1:]))}
    return [(best[t][0], order[t]) if t in best else None for t in range(4)]


def forward(vector: Vector, symbols: str) -> Vector:
    """The vector after further rows, each ending with that row's own edit."""
    for s in symbols:
        way, best = steps(s), {}
        for state, held in enumerate(vector):
            if held:
                for c, e, to in way[state]:
                    got = (held[0] + c, held[1], e)
                    if to not in best or got < best[to]:
                        best[to] = got
        vector = ranked(best)
    return vector


def backward(costs: list, symbols: str) -> list:
    """Cost from each state over the rows to an end with the given costs."""
    for s in reversed(symbols):
        costs = [min(c + costs[to] for c, _, to in ways) for ways in steps(s)]
    return costs


def ending(state: int) -> tuple[int, str]:
    """The cheapest insertions after the last row."""
    edits = ""
    while state not in ENDS:
        state, edits = FREE[state], edits + "I"
    return INSERT * len(edits), edits


OVER = float("inf")
CLOSE = [ending(s)[0] for s in range(4)]       # cost from each state after the last row


def only(state: int) -> Vector:
    return [(0, 0) if s == state else None for s in range(4)]


def goal(state: int) -> list:
    return [0 if s == state else OVER for s in range(4)]


def crossing(vector: Vector, costs: list) -> int:
    """The state with the least sum of both vectors, at a tie the one of the least audit."""
    return min((s for s in range(4) if vector[s]), key=lambda s: (vector[s][0] + costs[s], vector[s][1]))


def hirschberg(symbols: str, start: int, end: int) -> list[str]:
    """The edits of each row (insertions before it, then its own) on the best
    way from a state to a state; linear space."""
    if not symbols:
        return []
    if len(symbols) == 1:
        return [next(e for _, e, to in steps(symbols)[start] if to == end)]
    half = len(symbols) // 2
    at = crossing(forward(only(start), symbols[:half]), backward(goal(end), symbols[half:]))
    return hirschberg(symbols[:half], start, at) + hirschberg(symbols[half:], at, end)


def transfer(symbols: str) -> list[Vector]:
    """The 4 x 4 table of a stretch of rows: the forward vector from each state."""
    return [forward(only(s), symbols) for s in range(4)]


def through(vector: Vector, matrix: list[Vector]) -> Vector:
    """The forward vector after a stretch with the given table."""
    best: dict[int, tuple] = {}
    for state, held in enumerate(vector):
        if held:
            for to, way in enumerate(matrix[state]):
                if way:
                    got = (held[0] + way[0], held[1], way[1])
                    if to not in best or got < best[to]:
                        best[to] = got
    return ranked(best)


def back_through(matrix: list[Vector], costs: list) -> list:
    return [min((way[0] + costs[to] for to, way in enumerate(row) if way), default=OVER) for row in matrix]


def product(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [through(row, b) for row in a]


def crossings(tables: list[list[Vector]], start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) state of each of a row of stretches, halving the row as ``hirschberg`` does."""
    if len(tables) < 2:
        return [(start, end)] * len(tables)
    half = len(tables) // 2
    at = crossing(reduce(through, tables[:half], only(start)),
                  reduce(lambda costs, m: back_through(m, costs), reversed(tables[half:]), goal(end)))
    return crossings(tables[:half], start, at) + crossings(tables[half:], at, end)


def last_state(vector: Vector) -> int:
    """Where a whole conversation's rows end on its best way."""
    return crossing(vector, CLOSE)


LEGAL = ("su", "ua", "au")


def illegal_pairs(letters: str) -> int:
    return sum(letters[i:i + 2] not in LEGAL for i in range(len(letters) - 1))


def coded(symbols: str, start: int, edits: list[str]) -> tuple[list[str], int, int]:
    """(codes, cost, state) of a stretch.  A row's code says what becomes of it
    and what is inserted before it: ``u``/``a`` an inserted user or assistant
    row, ``K`` kept, ``D`` deleted, ``U``/``A`` re-roled to user or assistant."""
    out, cost, state = [], 0, start
    for symbol, edit in zip(symbols, edits):
        code = ""
        for e in edit[:-1]:
            state = FREE[state]
            code += ROLES[state][0]
            cost += INSERT
        if edit[-1] == "D":
            cost += DELETE
        else:
            keep = edit[-1] == "K"
            state = NEXT[state][symbol.lower()] if keep else FREE[state]
            cost += (KEEP if keep else REROLE) + (TRUNCATED if symbol.isupper() else 0)
        out.append(code + (edit[-1] if edit[-1] != "R" else ROLES[state][0].upper()))
    return out, cost, state


def closed(codes: list[str], cost: int, state: int) -> tuple[list[str], int]:
    """With the insertions that follow a conversation's last row behind its code."""
    more, edits = ending(state)
    for _ in edits:
        state = FREE[state]
        codes = [*codes[:-1], codes[-1] + ROLES[state][0]]
    return codes, cost + more


@lru_cache(maxsize=1 << 14)
def _whole(symbols: str) -> tuple[tuple[str, ...], int]:
    end = last_state(forward(only(START), symbols))
    codes, cost = closed(*coded(symbols, START, hirschberg(symbols, START, end)))
    return tuple(codes), cost


def repaired_whole(symbols: str) -> tuple[tuple[str, ...], int]:
    """(codes, cost) of a whole conversation; short ones are remembered."""
    return (_whole if len(symbols) <= 32 else _whole.__wrapped__)(symbols)


# ----------------------------------------------------- rows, faults and pieces --

def damage(turns: DataFrame, faults: int = 20) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` (nulls:
    one space, as everywhere): 0 drops a row, 1 empties it, 2 takes its
    ``.!?``, 3 repeats it, 4 makes it the user's."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                        F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(faults)).alias("fault"))
    rows = rows.filter("fault <> 0").withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", ""))
                                                .otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), "text",
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("one")).drop("one")


def conversation_key(conv_id: Column) -> Column:
    """A text that is never null; the null conversation is one of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def stored_turns(turns: DataFrame, partitions: int | None = None, piece: int = PIECE) -> DataFrame:
    """All rows in order, written once: ``key``, ``turn``, ``role``, ``text``,
    ``part`` (a range of the order), ``seq`` (place in it), ``piece`` and what
    is wrong with the row by itself (``blank``, ``truncated``)."""
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(conversation_key(F.col("conv_id")).alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = ["key", "turn", "role", "head", "at"]
    rows = rows.withColumn("head", F.substring("text", 1, 64)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    last = F.substring(F.rtrim(F.translate("text", WHITE, " " * len(WHITE))), -1, 1)
    rows = rows.select("key", "turn", "role", "text", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
                       F.monotonically_increasing_id().alias("id"))       # partition and place in it
    rows = rows.withColumn("part", F.shiftright("id", 33).cast("int")).withColumn("seq", F.col("id").bitwiseAND((1 << 33) - 1))
    return materialize(rows.drop("id").withColumn("piece", F.floor(F.col("seq") / piece).cast("int")), "turns", partitions=None)


def with_faults(stored: DataFrame) -> DataFrame:
    """Narrow rows (no text) with ``fault``: none, blank, duplicate or truncated, the first that holds.

    First occurrences come from a partial aggregate over (conversation, role,
    hash of the text) and are joined back on the row's own place."""
    first = (stored.filter("NOT blank").groupBy("key", "role", F.sha2("text", 256)).agg(F.min(F.struct("part", "seq")).alias("f"))
             .select(F.col("f.part").alias("part"), F.col("f.seq").alias("seq"), F.lit(True).alias("first")))
    rows = stored.select("key", "part", "seq", "piece", "role", "blank", "truncated").join(first, ["part", "seq"], "left")
    return rows.select("key", "part", "seq", "piece", "role",
                       F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
                       .when(F.col("truncated"), "truncated").otherwise("none").alias("fault"))


def pieces_of(faults: DataFrame) -> DataFrame:
    """One row per (key, part, piece): ``seq`` of its first row, ``symbols`` and
    ``letters`` (one character a row, at most a piece's rows) and fault counts."""
    letter = F.substring("role", 1, 1)
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    counts = [F.sum((F.col("fault") == k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")]
    got = faults.groupBy("key", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("seq", symbol.alias("s"), letter.alias("l")))).alias("rows"), *counts)
    return got.select("key", "part", "piece", F.col("rows")[0]["seq"].alias("seq"), F.array_join("rows.s", "").alias("symbols"),
                      F.array_join("rows.l", "").alias("letters"), "blank", "duplicate", "truncated")


def packed_table(matrix: list[Vector]) -> list[int]:
    return [x for row in matrix for way in row for x in (way or (-1, -1))]


def unpacked_table(flat) -> list[Vector]:
    ways = [(int(flat[i]), int(flat[i + 1])) if flat[i] >= 0 else None for i in range(0, 32, 2)]
    return [ways[i:i + 4] for i in range(0, 16, 4)]


_NODE = "key string, node long, ord long, matrix array<long>, first string, last string, illegal long"
_WAY = "key string, node long, ord long, start int, end int"


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Piece rows to their tables; ``illegal`` counts the pairs between pieces only."""
    for p in batches:
        yield pd.DataFrame({"key": p["key"], "node": p["part"], "ord": p["piece"], "matrix": [packed_table(transfer(s)) for s in p["symbols"]],
                            "first": p["letters"].str[0], "last": p["letters"].str[-1], "illegal": 0})


def _multiplied(group: pd.DataFrame) -> pd.DataFrame:
    """Consecutive stretches of one conversation to one."""
    g = group.sort_values("ord")
    whole = reduce(product, map(unpacked_table, g["matrix"]))
    between = sum(a + b not in LEGAL for a, b in zip(g["last"], g["first"][1:]))
    return pd.DataFrame({"key": [g["key"].iloc[0]], "node": [int(g["node"].iloc[0]) >> FAN], "ord": [int(g["node"].iloc[0])],
                         "matrix": [packed_table(whole)], "first": [g["first"].iloc[0]], "last": [g["last"].iloc[-1]],
                         "illegal": [int(g["illegal"].sum()) + between]})


def _handed_down(group: pd.DataFrame) -> pd.DataFrame:
    """Crossings between consecutive stretches whose first start and last end are known."""
    g = group.sort_values("ord")
    ways = crossings([unpacked_table(m) for m in g["matrix"]], int(g["start"].iloc[0]), int(g["end"].iloc[0]))
    return pd.DataFrame({"key": g["key"], "node": g["node"], "ord": g["ord"], "start": [a for a, _ in ways], "end": [b for _, b in ways]})


def _cut_conversations(pieces: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """For the pieces of conversations of several: (start and end state of
    each piece, one row per conversation with the pairs between its pieces)."""
    levels = [materialize(pieces.mapInPandas(_tables, _NODE), "turn-tables-0", partitions=None)]
    reach = 1
    while True:                                   # partitions, then 2**FAN, 2**(2 FAN), ... of them
        levels.append(materialize(levels[-1].groupBy("key", "node").applyInPandas(_multiplied, _NODE), f"turn-tables-{len(levels)}", partitions=None))
        if reach >= partitions:
            break
        reach <<= FAN
    top = levels.pop()                            # one row a conversation

    def ends(batches):
        for t in batches:
            vectors = [unpacked_table(m)[START] for m in t["matrix"]]
            yield pd.DataFrame({"key": t["key"], "node": t["node"], "ord": t["ord"], "start": START, "end": [last_state(v) for v in vectors]})
    ways = top.mapInPandas(ends, _WAY)
    for level in reversed(levels):                # a node's rows are the node its parent's row was numbered by
        above = ways.select("key", F.col("ord").alias("node"), "start", "end")
        ways = level.join(above, ["key", "node"]).groupBy("key", "node").applyInPandas(_handed_down, _WAY)
    return ways, top


_CODED = "key string, part int, piece int, seq long, codes array<string>, cost long, illegal long"


def _repaired_wholes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        got = [repaired_whole(s) for s in p["symbols"]]
        yield pd.DataFrame({"key": p["key"], "part": p["part"], "piece": p["piece"], "seq": p["seq"], "codes": [list(c) for c, _ in got],
                            "cost": [c for _, c in got], "illegal": p["letters"].map(illegal_pairs)})


def _repaired_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for symbols, start, end, final in zip(p["symbols"], p["start"], p["end"], p["final"]):
            codes, cost, state = coded(symbols, int(start), hirschberg(symbols, int(start), int(end)))
            out.append(closed(codes, cost, state) if final else (codes, cost))
        yield pd.DataFrame({"key": p["key"], "part": p["part"], "piece": p["piece"], "seq": p["seq"], "codes": [c for c, _ in out],
                            "cost": [c for _, c in out], "illegal": p["letters"].map(illegal_pairs)})


@dataclass(frozen=True)
class Repair:
    """``stored``: all rows in order.  ``plan``: (key, part, seq, code) of every
    row.  ``summary``: one row per conversation that has rows."""
    stored: DataFrame
    plan: DataFrame
    summary: DataFrame


def repair_conversations(turns: DataFrame, partitions: int | None = None, piece: int = PIECE) -> Repair:
    """The cheapest repair of every conversation in ``turns`` (``conv_id``,
    ``turn``, ``role``, ``text``; other columns are not read).

    Rows stand in the order of their turn (nulls first), ties by role, the
    first 64 characters of the text and their place in the table.  A null role
    or text is one space; the null conversation is one like any other; a role
    that starts with none of s, u, a can't be kept; repeated rows are
    duplicates of their first.  Very long texts only travel with their rows.
    An empty table has no conversations.

    ``summary``: ``key``, ``blank``, ``duplicate``, ``truncated``, ``illegal``
    (neighbours in wrong order before the repair), ``cost``, ``audit``, ``gaps``.
    """
    ship_package(turns.sparkSession)
    stored = stored_turns(turns, partitions, piece)
    pieces = materialize(pieces_of(with_faults(stored)), "turn-pieces", partitions=None)
    several = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("part", "piece")).alias("last")).filter("n > 1")
    several = materialize(several.select("key", "last"), "turn-cut", partitions=None)
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = pieces.join(several, "key")
    ways, top = _cut_conversations(cut, n)
    cut = cut.join(ways.select("key", F.col("node").cast("int").alias("part"), F.col("ord").cast("int").alias("piece"), "start", "end"), ["key", "part", "piece"])
    cut = cut.withColumn("final", F.col("last") == F.struct("part", "piece")).select("key", "part", "piece", "seq", "symbols", "letters", "start", "end", "final")
    coded_pieces = pieces.join(several, "key", "left_anti").mapInPandas(_repaired_wholes, _CODED).unionByName(cut.mapInPandas(_repaired_pieces, _CODED))
    coded_pieces = materialize(coded_pieces, "turn-codes", partitions=None)
    plan = (coded_pieces.select("key", "part", "seq", F.posexplode("codes").alias("i", "code"))
            .select("key", "part", (F.col("seq") + F.col("i")).alias("seq"), "code"))
    counts = pieces.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audit = F.translate(F.array_join("codes", ""), "uaUA", "IIRR")
    result = (coded_pieces.select("key", "cost", "illegal", F.struct("part", "piece", audit.alias("audit")).alias("a"))
              .unionByName(top.select("key", F.lit(0).cast("long").alias("cost"), "illegal"), allowMissingColumns=True)
              .groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
                                  F.array_join(F.transform(F.sort_array(F.collect_list("a")), lambda x: x["audit"]), "").alias("audit")))
    gaps = (stored.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
    return Repair(stored, plan, result.join(counts, "key").join(gaps, "key"))


_LINE = "key string, part int, seq long, step int, turn string, role string, text string, edit string"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row follows its code; out come the rows that the code leaves or inserts."""
    code = ""
    for batch in batches:
        out = []
        for key, part, seq, kind, made, turn, role, text in zip(*(batch[c] for c in ("key", "part", "seq", "kind", "code", "turn", "role", "text"))):
            if not kind:
                code = made
                continue
            for step, c in enumerate(code):
                if c in "ua":
                    out.append((key, part, seq, step, None, "user" if c == "u" else "assistant", "", "I"))
                elif c != "D":
                    own = {"U": "user", "A": "assistant"}.get(c, role)
                    out.append((key, part, seq, step, turn, own, text, "K" if c == "K" else "R"))
        yield pd.DataFrame(out, columns=["key", "part", "seq", "step", "turn", "role", "text", "edit"])


def repaired_turns(repair: Repair, by: str = "part") -> DataFrame:
    """The repaired rows: ``key``, then ``part``, ``seq``, ``step`` (their
    order), ``turn`` (null if inserted), ``role``, ``text``, ``edit`` (K, R or I).

    Rows and their codes are dealt out together and read once in order: ``by``
    range, or by ``key`` for a reader that needs a conversation in one stream."""
    rows = (repair.plan.select("key", "part", "seq", F.lit(0).alias("kind"), "code")
            .unionByName(repair.stored.select("key", "part", "seq", F.lit(1).alias("kind"), F.col("turn").cast("string").alias("turn"), "role", "text"),
                         allowMissingColumns=True))
    rows = rows.repartition(by).sortWithinPartitions(*dict.fromkeys([by, "part", "seq", "kind"]))
    return rows.mapInPandas(_lines, _LINE).withColumn("turn", F.col("turn").cast(repair.stored.schema["turn"].dataType))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest = None, None
    for batch in batches:
        done = []
        for k, role, text in zip(batch["key"], batch["role"], batch["text"]):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pd.DataFrame(done, columns=["key", "sha256"])
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha256"])


def digests(repair: Repair) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text`` lines (``key``,
    ``sha256``); a conversation without any has no row.  The hash runs over the
    lines as a stream, so a conversation of any length takes one line's memory."""
    return repaired_turns(repair, by="key").select("key", "role", "text").mapInPandas(_digests, "key string, sha256 string")
