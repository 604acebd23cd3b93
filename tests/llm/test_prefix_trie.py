"""The prefix trie against a plain one, built turn by turn."""

import hashlib
import random
import re
import zlib

from quillon.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, class string, pos int"


def plain_paths(rows):
    own = {}
    for c, t, r, x in sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None), key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode())):
        own.setdefault(c, []).append((r, x))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_nodes(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        gain = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += gain
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(node))))
        above = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), above, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = [tuple(r) for r in prefix_trie.conversation_nodes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_nodes(plain_paths(rows))))


def test_conversations_of_all_kinds(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        if c % 20 == 0 and c > 60:
            continue  # an absent first of its twenty
        copy_of = rng.choice([1, 2, 3, 4]) if rng.random() < 0.4 else None
        for t in range(rng.choice([1, 1, 2, 3, 9])):
            said = f"{t} of {copy_of}" if copy_of else f"{c} says\t{rng.randrange(3)}"
            rows.append((c, t, rng.choice(["user", None]) if not copy_of else "user", said if rng.random() < 0.95 else None, "clash", 1))
    rows += [(3, None, "system", "first of all", "x", 1), (3, None, "system", "first of all", "x", 1), (5, 1, "a", "tie", "x", 1), (None, 1, "user", "nobody", "x", 1)]
    check(spark, rows)


def test_long_shared_runs_take_few_rounds(spark, monkeypatch):
    rounds, split = [], prefix_trie._split
    monkeypatch.setattr(prefix_trie, "_split", lambda *a: rounds.append(1) or split(*a))
    monkeypatch.setattr(prefix_trie, "BLOCK", 1 << 16)
    long = [(t, "user", f"turn {t}") for t in range(90)]
    rows = [(c, *turn, "x", 1) for c in (1000, 2001) for turn in long] + [(3002, *turn, "x", 1) for turn in long[:70]] + [(5, 0, "user", "other", "x", 1)]
    check(spark, rows)
    assert len(rounds) <= 24


def test_many_copies_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(c, t, "user", f"hello {t}", "x", 1) for c in range(0, 1200, 2) for t in range(2)] + [(-40, 0, "user", "hello 0", "x", 1)]
    check(spark, rows)


def test_empty_and_single(spark):
    assert prefix_trie.conversation_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(20, 0, "user", "alone", "x", 1), (20, 1, "user", "still", "x", 1)])
    check(spark, [(21, 0, "user", "h turns of nothing", "x", 1)])
