"""Near-duplicates by odd sketches against all pairs."""

import random
import re
import time

import numpy as np
import pytest

from quillon.llm import odd_sketch

SCHEMA = "doc_id long, text string, set string, row int, component string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


def check(spark, rows):
    got = [tuple(r) for r in odd_sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("chunk", [odd_sketch.CHUNK, 3])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(odd_sketch, "CHUNK", chunk)
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 60, 200, 400]))]
        for _ in range(rng.randrange(1, 9)):
            words = edited(rng, base, rng.choice([0, 1, 2, 5, 9]) if len(base) > 30 else rng.choice([0, 0, 1]))
            texts.append(rng.choice([" ", "\t", "\n "]).join(words))
    chain = [f"c{i}" for i in range(300)]
    for k in range(6):  # each linked with the next alone
        texts.append(" ".join(chain[20 * k : 20 * k + 200]))
    # 17 of 20 shingles of the union are the threshold itself, 16 of 19 are under it
    texts += [" ".join(f"t{i}" for i in range(20)), " ".join(f"t{i}" for i in range(19)), " ".join(f"t{i}" for i in range(22)), " ".join(f"t{i}" for i in range(1, 23)), " ".join(f"t{i}" for i in range(18)), " ".join(f"t{i}" for i in range(21))]
    texts += [None, "", " \n", "One", "ONE", "one two", "Two one", "a a a a a", "a a a", "very long " + "x y z " * 70000]
    rows = [(i, t, "clash", 1, "c") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "x", 1, "c"), (None, "nobody has this text at all", "x", 1, "c"), (3, texts[3], "x", 1, "c"), (3, "another text of the same id", "x", 1, "c")]
    check(spark, rows)


def test_estimates_are_precise_near_the_threshold():
    rng = np.random.default_rng(3)
    seen = []
    for n in (20, 60, 400, 3000):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, round(n * 0.85), dtype=np.uint64)
            more = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)
            half = len(more) // 2
            a, b = np.unique(np.concatenate([both, more[:half]])), np.unique(np.concatenate([both, more[half:]]))
            low = [odd_sketch.sample(x) for x in (a, b)]
            odd = int(np.bitwise_count(np.frombuffer(bytes(odd_sketch.folded(low[0])), np.uint8) ^ np.frombuffer(bytes(odd_sketch.folded(low[1])), np.uint8)).sum())
            assert odd <= odd_sketch.ODD_BITS
            assert (odd_sketch.band_keys(low[0]) == odd_sketch.band_keys(low[1])).any()
            seen.append(float(odd_sketch.estimate(np.array(odd))))
    assert abs(np.mean(seen) - 0.85) < 0.01 and np.std(seen) < 0.04


def test_unlike_sets_are_dropped_by_their_sketches():
    rng = np.random.default_rng(4)
    lows = [odd_sketch.sample(np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))) for _ in range(40)]
    bits = np.array([odd_sketch.folded(x) for x in lows]).view(np.uint64)
    odd = odd_sketch._odd_bits(bits, bits)
    assert (odd[~np.eye(40, dtype=bool)] > odd_sketch.ODD_BITS).all()


def test_empty_table(spark):
    assert odd_sketch.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_connected_group_is_not_dealt_against_itself(spark):
    posts = spark.range(3000).selectExpr("7L as key", "cast(id as string) as set", "if(id % 100 = 0, id, -1) as component", "-1L as main", "2970L as n_main", "30L as n_rest")
    cells = odd_sketch._mixed_cells(posts, ["set", "component"]).collect()
    met = {(a["set"], b["set"]) for c in cells for a in c.left for b in c.right or c.left}
    met |= {(b, a) for a, b in met}
    assert sum(len(c.left) + len(c.right) for c in cells) <= 3000 + 30 * 12
    assert all(((str(i), str(j)) in met) for i in range(0, 3000, 100) for j in range(3000) if i != j)


def test_no_shuffle_files_are_left_by_the_rounds(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = lambda found: [found.apply(i).getName() for i in range(found.size())]
    shuffled = lambda: {f for f in listed(files.getAllFiles()) if f.startswith("shuffle_")}
    before = shuffled()
    rows = [(i, " ".join(f"w{(i // 3 + k) % 40}" for k in range(30 + i % 2)), "x", 1, "c") for i in range(60)]
    odd_sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    for _ in range(50):  # files are removed in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
