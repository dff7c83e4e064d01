"""Repair of conversations by the cheapest edits, found by iterative-deepening A* over blocks of their rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import in_order, materialise, small_batches

#: Rows searched at once, and results of blocks that a worker remembers.
BLOCK, REMEMBERED = 64, 200_000
#: What edits cost, a row that stays though its text breaks off, and what separates words.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_STAYS = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Faults of a row, and the classes of a role by its initial.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"s": 0, "u": 1, "a": 2}
#: States: nothing yet, after the system's row, after a user's, after an assistant's. A conversation ends in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
Found = dict[tuple[int, int], tuple[int, str]]


def _kept(state: int, role: int) -> int | None:
    """The state after a row that stays as it is."""
    if role == 0:
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if NEXT[state] == role + 1 else None


class Search:
    """Cheapest edits of a block of rows by iterative deepening: depth first in the order of the edits' letters (D, I, K, R)
    below a bound on the cost, which grows to the least cost that exceeded it, so that the first path that is accepted is
    the cheapest and of those the least by its letters.

    Rows are codes, 4 * fault + role (3: another). The bound on what is left adds up each row's own cheapest edit, which is
    Delete for all but a system's row where neither a user nor an assistant may follow. The
    transposition table holds, for each place and state that failed, the least cost that it may still take; it
    stays from one bound to the next, so a state is entered again only with more to spend. ``entered`` counts.
    """

    def __init__(self, rows: bytes):
        self.rows, self.entered = rows, 0
        self.least = [0] * (len(rows) + 1)
        for k in range(len(rows) - 1, -1, -1):
            fault, role = divmod(rows[k], 4)
            stays = DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED_STAYS * (fault == TRUNCATED) + REROLE * (role == 3)
            self.least[k] = self.least[k + 1] + min(DELETE, stays)

    def run(self, entry: int, leave: int) -> tuple[int, str] | None:
        """The cost and the letters of the cheapest edits from a state to a state; None if there are none."""
        if leave < USER and entry != leave and (entry != NOTHING or not any(r % 4 == 0 and r // 4 in (FINE, TRUNCATED) for r in self.rows)):
            return None  # no way back, nor to the system's row without one that may stay
        self.leave, self.needs = leave, {}
        bound = self._ahead(0, entry)
        while True:
            path, needed = self._enter(0, entry, bound)
            if path is not None:
                return bound, path
            bound = needed

    def _ahead(self, at: int, state: int) -> int:
        if self.leave >= USER:
            return self.least[at]
        return NEVER if state >= USER else max(0, DELETE * (len(self.rows) - at - (state != self.leave)))

    def _enter(self, at: int, state: int, left: int) -> tuple[str | None, int]:
        """The letters from here within ``left``, or None and the least cost that may do."""
        self.entered += 1
        if at == len(self.rows) and state == self.leave:
            return "", 0
        needed = NEVER
        for letter, cost, to_at, to in self._edits(at, state):
            ahead = max(self._ahead(to_at, to), self.needs.get((to_at, to), 0))
            if cost + ahead <= left:
                path, ahead = self._enter(to_at, to, left - cost)
                if path is not None:
                    return letter + path, 0
            needed = min(needed, cost + ahead)
        self.needs[at, state] = needed
        return None, needed

    def _edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if at < len(self.rows):
            yield "D", DELETE, at + 1, state
        yield "I", INSERT, at, NEXT[state]
        if at < len(self.rows):
            fault, role = divmod(self.rows[at], 4)
            if fault not in (BLANK, DUPLICATE):
                stays = TRUNCATED_STAYS * (fault == TRUNCATED)
                if (to := _kept(state, role)) is not None:
                    yield "K", KEEP + stays, at + 1, to
                yield "R", REROLE + stays, at + 1, NEXT[state]


_remembered: dict[tuple[bytes, bool], Found] = {}


def block(rows: bytes, starts: bool) -> Found:
    """By (entry, leave), the cheapest edits of a block; from nothing alone, if a conversation starts there."""
    if (key := (rows, starts)) not in _remembered:
        if len(_remembered) >= REMEMBERED:
            _remembered.clear()
        search = Search(rows)
        found = {(x, y): search.run(x, y) for x, y in product([NOTHING] if starts else range(4), range(4))}
        _remembered[key] = {k: v for k, v in found.items() if v}
    return _remembered[key]


def joined(a: Found, b: Found) -> Found:
    """The cheapest edits of two stretches on end. Of one cost, from one state to one state, no letters begin with others, as
    what would follow costs something; so the least by letters stays the least whatever comes after."""
    out: Found = {}
    for (x, m), (cost, path) in a.items():
        for y in range(4):
            if (m, y) in b:
                new = (cost + b[m, y][0], path + b[m, y][1])
                out[x, y] = min(out[x, y], new) if (x, y) in out else new
    return out


class Stretch:
    """Rows of a conversation on end: counts of faults and turns, and edits of whole blocks joined in pairs of equal
    length, so that letters are copied a logarithmic number of times."""

    def __init__(self, starts: bool):
        self.starts, self.rows, self.done = starts, bytearray(), []
        self.n, self.faults, self.illegal, self.turns = 0, [0] * 4, 0, 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = self.low = None

    def add(self, fault: int, role: int, turn: int | None) -> None:
        if not self.n:
            self.first_role, self.first_turn = role, turn
        else:
            self.illegal += not _legal(self.last_role, role)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
        self.n, self.last_role, self.last_turn = self.n + 1, role, turn
        self.faults[fault] += 1
        self.rows.append(4 * fault + role)
        if len(self.rows) == BLOCK:
            self._close()

    def _close(self) -> None:
        found, size = block(bytes(self.rows), self.starts and not self.done), 1
        self.rows.clear()
        while self.done and self.done[-1][0] == size:
            found, size = joined(self.done.pop()[1], found), 2 * size
        self.done.append((size, found))

    def edits(self) -> Found:
        if self.rows or not self.done:
            self._close()
        out = self.done[-1][1]
        for _, found in self.done[-2::-1]:
            out = joined(found, out)
        return out


def _legal(a: int, b: int) -> bool:
    """Whether a row of one role may follow another's: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


_PIECE = "piece int, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_role int, last_role int, first_turn long, last_turn long, low long, ways array<struct<x:int,y:int,cost:long,path:string>>"
_TOTAL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted range of rows. Only the first may have begun in the range before."""
    now, held, last, of_id = None, None, None, None
    for batch in batches:
        of_id = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "digest", "piece")]
        out = []
        for conv, turn, role, fault, digest, piece in zip(*columns):
            if held is None or conv != now:
                if held is not None:
                    out.append(_piece(now, last[2], held))
                held, last = Stretch(starts=held is not None or piece == 0), None
            if last and last[:2] == (turn, digest) and fault != BLANK:
                fault = DUPLICATE
            held.add(fault, ROLES.get(role, 3), turn)
            now, last = conv, (turn, digest, piece)
        if out:
            yield _batch(out, of_id)
    if held is not None:
        yield _batch([_piece(now, last[2], held)], of_id)


def _piece(conv, piece: int, s: Stretch) -> dict:
    ways = [{"x": x, "y": y, "cost": cost, "path": path} for (x, y), (cost, path) in s.edits().items()]
    return {"conv_id": conv, "piece": piece, "n": s.n, "blank": s.faults[BLANK], "duplicate": s.faults[DUPLICATE], "truncated": s.faults[TRUNCATED], "illegal": s.illegal, "turns": s.turns, "first_role": s.first_role, "last_role": s.last_role, "first_turn": s.first_turn, "last_turn": s.last_turn, "low": s.low, "ways": ways}


_WAYS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("cost", pa.int64()), ("path", pa.string())]))


def _batch(rows: list[dict], of_id: pa.DataType) -> pa.RecordBatch:
    types = {"conv_id": of_id, "piece": pa.int32(), "first_role": pa.int32(), "last_role": pa.int32(), "ways": _WAYS, "audit": pa.string()}
    return pa.record_batch({k: pa.array([r[k] for r in rows], types.get(k, pa.int64())) for k in rows[0]})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its pieces, sorted."""
    held: list[dict] = []
    of_id = None
    for batch in batches:
        of_id, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                out.append(_total(held))
                held = []
            held.append(row)
        if out:
            yield _batch(out, of_id)
    if held:
        yield _batch([_total(held)], of_id)


def _total(pieces: list[dict]) -> dict:
    out = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
    stack: list[tuple[int, Found]] = []
    for k, p in enumerate(pieces):
        found, size = {(w["x"], w["y"]): (w["cost"], w["path"]) for w in p["ways"] if k or w["x"] == NOTHING}, 1
        while stack and stack[-1][0] == size:
            found, size = joined(stack.pop()[1], found), 2 * size
        stack.append((size, found))
    found = stack[-1][1]
    for _, before in stack[-2::-1]:
        found = joined(before, found)
    cost, audit = min(found[NOTHING, y] for y in (NOTHING, ASSISTANT) if (NOTHING, y) in found)
    turns = sum(p["turns"] for p in pieces)
    for a, b in zip(pieces, pieces[1:]):
        out["illegal"] += not _legal(a["last_role"], b["first_role"])
        turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low, high = next((p["low"] for p in pieces if p["low"] is not None), None), pieces[-1]["last_turn"]
    return {"conv_id": pieces[0]["conv_id"], "gaps": 0 if low is None else high - low + 1 - turns} | out | {"cost": cost, "audit": audit}


def _plain(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def edits(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are in the order of turn, null first; of one turn, in that of a digest of role and text, so equal rows lie side by
    side. Nulls in role and text count as one space. Each row's first fault counts: blank (no character but white
    space), duplicate (role and text seen earlier), truncated (the last such character is none of ``.!?``). A
    role is known by its first character, case as it is; an empty one is none of them. audit holds the cheapest edits
    that leave the roles ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and
    duplicate rows), Insert an empty row 3, and 3 for each truncated row that stays; ties go to the least in ASCII
    order. gaps are missing turns, illegal are neighbours other than su, ua, au.

    Rows without their texts are dealt in ranges of (conversation, turn), so a conversation with a third of all rows is as
    many tasks. A task searches blocks of 64 rows (``Search``), each from any state to any state, and joins them; the
    pieces of a conversation, one a range, are joined last. Only letters meet there, of which the result has
    one a row anyway. Null ids are one conversation. Other columns aren't read. An empty table gives none.
    """
    small_batches(rows.sparkSession)
    plain = _plain(rows, id_col, turn_col, role_col, text_col)
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    narrow = materialise(plain.select("conv_id", "turn", F.substring("role", 1, 1).alias("role"), fault.alias("fault"), "digest"), "turns")
    again = narrow.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("turn").alias("_turn"), F.count("*").alias("_n"), F.count("turn").alias("_known")).filter("_n > 1")
    of = narrow.conv_id.eqNullSafe(again._conv) & (narrow.digest == again._digest)
    later = F.col("_n").isNotNull() & F.col("turn").isNotNull() & ((F.col("_known") < F.col("_n")) | (F.col("turn") > F.col("_turn")))
    marked = narrow.join(again, of, "left").select("conv_id", "turn", "role", F.when(later & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault"), "digest")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    kind = narrow.schema["conv_id"].dataType.simpleString()
    pieces = materialise(_sorted_pieces(marked, order, kind), "pieces")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_totals, f"conv_id {kind}, {_TOTAL}").withColumnsRenamed({"conv_id": id_col})


def _sorted_pieces(marked: DataFrame, order: list, kind: str) -> DataFrame:
    placed = materialise(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("piece", F.spark_partition_id()).mapInArrow(_pieces, f"conv_id {kind}, {_PIECE}")


def repaired(rows: DataFrame, found: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: id, at (from 1), edit, role, text, for every row that isn't deleted; ``found`` is of
    ``edits`` over the same rows. The rows of a conversation lie in one partition, in order.

    Rows follow their conversation's letters in one sorted partition and are edited one by one; nothing is held but
    the letters. Conversations without letters are left out; the rest is as in ``edits``.
    """
    plain = _plain(rows, id_col, turn_col, role_col, text_col)
    letters = found.select(F.col(id_col).alias("conv_id"), F.lit(0).alias("is_row"), F.col("audit").alias("text"))
    both = plain.withColumn("is_row", F.lit(1)).unionByName(letters, allowMissingColumns=True)
    kind = plain.schema["conv_id"].dataType.simpleString()
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "is_row", "role", "text")
    return placed.mapInArrow(_repaired, f"conv_id {kind}, at long, edit string, role string, text string").withColumnsRenamed({"conv_id": id_col})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, place, at, state = "", 0, 0, NOTHING
    for batch in batches:
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal at
            at += 1
            out.append((conv, at, edit, role, text))

        for conv, is_row, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text"))):
            if not is_row:
                audit, place, at, state = text, 0, 0, NOTHING
            else:
                edit = audit[place]
                place += 1
                if edit == "K":
                    state = _kept(state, ROLES[role[:1]])
                    put(edit, role, text)
                elif edit == "R":
                    state = NEXT[state]
                    put(edit, "user" if state == USER else "assistant", text)
            while place < len(audit) and audit[place] == "I":
                state = NEXT[state]
                put("I", "user" if state == USER else "assistant", "")
                place += 1
        if out:
            columns = list(zip(*out))
            yield pa.record_batch([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["conv_id", "at", "edit", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's ``role:text`` lines, from its rows in order."""
    now, held = None, None
    for batch in batches:
        of_id, out = batch.schema.field("conv_id").type, []
        for conv, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text"))):
            if at == 1:
                if held:
                    out.append((now, held.hexdigest()))
                now, held = conv, hashlib.sha256()
            held.update(f"{'' if at == 1 else '\n'}{role}:{text}".encode())
        if out:
            yield pa.record_batch([pa.array([x for x, _ in out], of_id), pa.array([x for _, x in out], pa.string())], ["conv_id", "repaired_sha256"])
    if held:
        yield pa.record_batch([pa.array([now], of_id), pa.array([held.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text), damaged by crc32 of ``conv_id:turn`` modulo 20, nulls as one space: 0 drops a row,
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with the cheapest edits that repair it."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    found = materialise(edits(rows), "edits")
    hashes = repaired(rows, found).mapInArrow(_digests, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct()
    found, hashes = found.withColumnRenamed("conv_id", "_found"), hashes.withColumnRenamed("conv_id", "_hashed")
    out = ids.join(found, ids.conv_id.eqNullSafe(found._found), "left").join(hashes, ids.conv_id.eqNullSafe(hashes._hashed), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 of a text's bytes: a table by the rule of the polynomial, then byte by byte.
CRC32 = """
    crc_table AS (
        SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
    )
"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for crc32 of an ASCII text, with the rows of crc_table joined."""
    return f"xor(4294967295, list_reduce(list_transform(range(1, len({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT))"


def _repair_sql() -> str:

    def best(*ways: str) -> str:
        """The least (cost, path, rest) of structs that may be null."""
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    def step(way: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {way} IS NULL THEN NULL ELSE {{'c': {way}.c + {cost}, 'p': '{letter}' || {way}.p, 'l': {line} || {way}.l}} END"

    stays = "(CASE WHEN x.f = 'truncated' THEN 3 ELSE 0 END)"
    forced = "x.f IN ('blank', 'duplicate')"
    states = {"n": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def row(state: str) -> str:
        to, name = states[state]
        kept = f"CASE WHEN {forced} THEN NULL WHEN x.r = '{to}' THEN {step(f'v.{to}', stays, 'K', '[x.line]')}" + (f" WHEN x.r = 's' THEN {step('v.s', stays, 'K', '[x.line]')}" if state == "n" else "") + " END"
        rerole = f"CASE WHEN {forced} THEN NULL ELSE {step(f'v.{to}', f'3 + {stays}', 'R', f'''['{name}:' || x.body]''')} END"
        return best(step(f"v.{state}", "4", "D", "[]::VARCHAR[]"), kept, rerole)

    def inserted(state: str) -> str:
        to, name = states[state]
        return best(f"v.{state}", step(f"v.{to}", "3", "I", f"['{name}:']"))

    kind = "STRUCT(c BIGINT, p VARCHAR, l VARCHAR[])"
    relaxed, stepped = (", ".join(f"'{s}': {way(s)}" for s in states) for way in (inserted, row))
    done = f"{{'c': 0, 'p': '', 'l': []::VARCHAR[]}}::{kind}"
    return rf"""
        WITH RECURSIVE {CRC32}, d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
            FROM conversations, crc_table
        ), e AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS body
            FROM d, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || body)) AS k,
                   count(*) OVER (PARTITION BY conv_id) AS n, rtrim(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM e
        ), f AS (
            SELECT conv_id, turn, k, n, role || ':' || body AS line, body, substr(role, 1, 1) AS r,
                   CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY k) > 1 THEN 'duplicate'
                        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS f,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
            FROM o
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
                   count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
                   count(*) FILTER (k > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id
        ), search AS (
            SELECT conv_id, n AS k, {{'n': {done}, 's': NULL::{kind}, 'u': {{'c': 3, 'p': 'I', 'l': ['assistant:']}}::{kind}, 'a': {done}}} AS v,
                   TRUE AS is_end FROM (SELECT DISTINCT conv_id, n FROM f)
            UNION ALL
            SELECT conv_id, k, {{{relaxed}}} AS v, FALSE
            FROM (SELECT conv_id, k, {{{relaxed}}} AS v
                  FROM (SELECT s.conv_id, s.k - 1 AS k, {{{stepped}}} AS v
                        FROM (SELECT conv_id, k, CASE WHEN is_end THEN {{'n': v.n, 's': {{'c': 6, 'p': 'II', 'l': ['user:', 'assistant:']}}::{kind}, 'u': v.u, 'a': v.a}} ELSE v END AS v FROM search) s
                        JOIN f x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.k = s.k))
        ), found AS (SELECT conv_id, v.n AS w FROM search WHERE k = 0)
        SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
               coalesce(w.p, '') AS audit, sha256(coalesce(array_to_string(w.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN found g ON g.conv_id IS NOT DISTINCT FROM i.conv_id
    """


SQL = {"op12_conversation_repair": _repair_sql()}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
