"""Mixing, conversation repair and the prefix trie against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from murmur.llm import _shared, mixing, prefix_trie, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"


def with_clashes(df):
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["id", "key", "size", "cell", "conv", "piece", "nth", "digest", "at", "block", "d", "fault", "pos", "_key", "_conv", "target", "n"])))


# 11: mixing.


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Weights dealt again and again until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, bounded = {s: weights[k % 3] for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left, open_ = total - sum(most * sizes[s] for s in bounded), sum(weight[s] for s in order if s not in bounded)
        found = {s: most * sizes[s] if s in bounded else weight[s] * left / open_ for s in order}
        more = {s for s in order if found[s] > most * sizes[s]}
        if not more - bounded:
            return found
        bounded |= more


def mixed_by_brute_force(rows):
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(rows)}
    of = defaultdict(list)
    for k, (i, t, s) in enumerate(rows):
        named = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        of[s].append((int(hashlib.md5(f"mix:{named}".encode()).hexdigest()[:15], 16), (i is not None, i or 0), size[k], k))
    sizes = {s: sum(x[2] for x in v) for s, v in of.items()}
    targets, out = targets_by_rounds(sizes), []
    for s, v in of.items():
        epochs, rest = divmod(int(targets[s]), max(1, sizes[s]))
        for _, _, n, k in sorted(v):
            part = max(0, min(n, rest))
            rest -= n
            out.append((rows[k][0], s, n, sizes[s], targets[s], epochs, part, epochs * n + part))
    return out


@pytest.mark.parametrize("cell_rows", [3, 100_000])
def test_mix_by_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(_shared, "COPIES", 3)
    r = random.Random(11)
    rows = [(k if r.random() < 0.9 else None, r.choice([None, "", " \t", "a b c", "x\x0by z", "é \x1c w", "w " * r.randrange(1, 90)]), r.choice(["a", "a", "a", "b", "B", "", None, f"s{k % 9}", "é", "🙂"])) for k in range(400)]
    rows += [(7, "one two three", "a")] * 10 + [(7, "one two", "a")] * 2 + [(None, "same text", None)] * 8
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(docs, cell_rows=cell_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(mixed_by_brute_force(rows), key=str)
    taken = defaultdict(int)
    for x in got:
        taken[x["source"]] += x["taken"]
        assert x["taken"] <= 3 * x["size"]
    assert all(taken[x["source"]] == int(x["target"]) for x in got)
    assert sum(taken.values()) > 0.99 * sum(x["size"] for x in got)


def test_mix_of_nothing_and_of_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted((x["doc_id"], x["size"], x["target"], x["taken"]) for x in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_ranks_are_gapless(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = sorted((x["x"], x["rank"]) for x in _shared.ranked(rows, [F.col("x")], "x").collect())
    assert [k for _, k in got] == list(range(5000))
    assert _shared.ranked(rows.limit(0), [F.col("x")], "x").count() == 0


# 12: repair.


def cheapest(codes, entry, leaves):
    """(cost, letters) of the cheapest edits, by dynamic programming from the end."""
    pick = lambda ways: min((w for w in ways if w), default=None)

    def relaxed(v):
        for _ in range(4):
            v = [pick([v[s], v[t] and (v[t][0] + 3, "I" + v[t][1])]) for s, t in enumerate(repair.NEXT)]
        return v

    v = relaxed([(0, "") if s in leaves else None for s in range(4)])
    for code in reversed(codes):
        fault, role = divmod(code, 4)
        more, now = 3 * (fault == repair.TRUNCATED), []
        for s, t in enumerate(repair.NEXT):
            ways = [v[s] and (v[s][0] + 4, "D" + v[s][1])]
            if fault in (repair.FINE, repair.TRUNCATED):
                to = {0: 1 if s == 0 else None, 1: 2 if s != 2 else None, 2: 3 if s == 2 else None}.get(role)
                ways += [to and v[to] and (v[to][0] + more, "K" + v[to][1]), v[t] and (v[t][0] + 3 + more, "R" + v[t][1])]
            now.append(pick(ways))
        v = relaxed(now)
    return v[entry]


def test_searches_by_brute_force():
    r = random.Random(12)
    for _ in range(300):
        codes = bytes(4 * r.choice([0, 0, 0, 1, 2, 3]) + r.choice([0, 1, 2, 3, 1, 2]) for _ in range(r.randrange(14)))
        for x in range(4):
            for y in range(4):
                assert repair.Search(codes).run(x, y) == cheapest(codes, x, {y})


@pytest.mark.parametrize("row", [1, 2, 3, 0, 13, 4 * repair.BLANK + 1])
def test_a_search_enters_few_states(row):
    search = repair.Search(bytes([row] * 64))
    assert search.run(0, 3) == cheapest(bytes([row] * 64), 0, {3})
    assert search.entered < 30_000


def repaired_by_brute_force(rows):
    """Summaries and repaired lines by conversation."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        of[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], turn, role, text))
    out = {}
    for c, held in of.items():
        held.sort()
        seen, codes, faults = set(), [], [0] * 4
        for *_, role, text in held:
            words = WORD.findall(text)
            fault = repair.BLANK if not words else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if words[-1][-1] not in ".!?" else repair.FINE
            seen.add((role, text))
            faults[fault] += 1
            codes.append(4 * fault + repair.ROLES.get(role[:1], 3))
        cost, audit = cheapest(codes, 0, {0, 3})
        turns = [x[2] for x in held if x[2] is not None]
        pairs = list(zip([x[3][:1] for x in held], [x[3][:1] for x in held][1:]))
        lines, at, state = [], 0, 0
        for letter in audit:
            role, text = held[at][3:] if letter != "I" else ("", "")
            if letter in "RI":
                state = repair.NEXT[state]
                role = ("user", "assistant")[state == 3]
            elif letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            at += letter != "I"
            if letter != "D":
                lines.append(f"{role}:{text}")
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults[1:], sum(f"{a}{b}" not in ("su", "ua", "au") for a, b in pairs), cost, audit, lines)
    return out


def conversations(seed, n=120):
    r, rows = random.Random(seed), []
    for c in [*range(n), None]:
        for k in range(r.randrange(0, 14)):
            turn = r.choice([k, k, k, 2 * k, None, 1])
            rows.append((c, turn, r.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "User"]), r.choice(["Yes.", "No!", None, "", " \n", "cut off", "Why?  ", f"Word {k}.", "🙂", "!"])))
    rows += [(500, k, ("user", "assistant")[k % 2] if r.random() < 0.9 else "user", f"Text {k}{r.choice(['.', '.', '.', ''])}" if r.random() < 0.9 else "Again.") for k in range(1500)]
    return rows


def test_edits_and_repairs_by_brute_force(spark):
    rows = conversations(3)
    df = with_clashes(spark.createDataFrame(rows, CONV).repartition(7))
    expected = repaired_by_brute_force(rows)
    found = repair.edits(df).cache()
    got = {x["conv_id"]: tuple(x)[1:] for x in found.collect()}
    assert got == {c: v[:-1] for c, v in expected.items()}
    lines = defaultdict(list)
    for x in repair.repaired(df, found).orderBy("at").collect():
        lines[x["conv_id"]].append(f"{x['role']}:{x['text']}")
    assert dict(lines) == {c: v[-1] for c, v in expected.items() if v[-1]}


def test_pieces_of_a_conversation_join(monkeypatch):
    r = random.Random(5)
    for size in (1, 3, 64):
        monkeypatch.setattr(repair, "BLOCK", size)
        codes = bytes(4 * r.choice([0, 0, 0, 1, 2, 3]) + r.choice([0, 1, 2, 1, 2, 3]) for _ in range(150))
        s = repair.Stretch(starts=True)
        for code in codes:
            s.add(*divmod(code, 4), 0)
        found = s.edits()
        assert min(found[0, y] for y in (0, 3) if (0, y) in found) == cheapest(codes, 0, {0, 3})


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.edits(empty).count() == 0
    assert repair.repaired(empty, repair.edits(empty)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(60) for t in [None, 0, 1]] + [(None, None, None, None)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, CONV)).collect()), key=str)
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            expected += [new] * (2 if kind == 3 else 1)
    assert got == sorted(expected, key=str)


def test_repair_query_keeps_every_conversation(spark, tmp_path):
    rows = [(c, 0, "user", "Hello there.") for c in range(80)] + [(None, None, "user", "Hi.")]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: x for x in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in rows}
    lost = [c for c in range(80) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost and all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost)


# 13: the trie of prefixes.


def trie_by_brute_force(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            of[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_by_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(_shared, "COPIES", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    r, rows = random.Random(width), []
    for c in [*range(40), 100, 103, 104, 205, -1, -100, -103, -7, *range(300, 330), None]:
        for k in range(r.choice([1, 1, 2, 4, 9])):
            same = 300 <= (c or 0) < 320
            rows.append((c, k if same else r.choice([k, k, None, 0]), r.choice(["user", None, ""]) if not same else "user", r.choice(["a", "bb", None, "", "🙂é"]) if not same else f"turn {k}"))
    rows += [(330 + j, k, "user", f"long {k}") for j in range(3) for k in range(30)] + [(400, k, "user", f"alone {k}") for k in range(40)]
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(with_clashes(spark.createDataFrame(rows, CONV)))), width).collect()
    assert sorted(map(tuple, got), key=str) == sorted(trie_by_brute_force(rows), key=str)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1, "user", "x")], CONV)
    for df in (empty, empty.limit(0)):
        assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).count() == 0
