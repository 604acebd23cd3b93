"""The two classifiers: held-out accuracy on made-up labels, gradients, and odd rows."""

import random

import numpy as np

from quillon.llm import quality_cnn, toxicity

SCHEMA = "doc_id long, text string, lang string, score string, predicted int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 200))]
        junk, toxic = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["blarg", "snorf", "quibzel", "grumpfo"]) + rng.choice(["", "", "s", "en"])
        docs.append((i, (" | " if junk else " ").join(words), "en", "clash", None))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus()
    odd = [(None, "no id", None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (9003, "the on " * 40000, None, None, None), (3, docs[3][1], None, None, None)]
    frame, known = spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (2, labels[2][1], 0)], LABELS)
    got = quality_cnn.classify(frame, known).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    import zlib

    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = quality_cnn.keep_good(frame, known)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)
    clash = frame.withColumnsRenamed({'score': '_score', 'predicted': 'score'})
    assert quality_cnn.keep_good(clash, known).columns == clash.columns
    assert quality_cnn.classify(frame.limit(0), known).count() == 0
    assert {r.score for r in quality_cnn.classify(frame.limit(5), known.limit(0)).collect()} == {0.5}


def plain_score(net, text):
    """The network's probability by loops over positions, chunks and filters."""
    n = max(1, -(-(len(text) + quality_cnn.WIDTH - 1) // quality_cnn.HOP))
    data = bytes(quality_cnn.WIDTH - 1) + text
    data += bytes(n * quality_cnn.HOP + quality_cnn.WIDTH - len(data))
    answer = lambda at, f: sum(float(net.tables[j, data[at + j], f]) for j in range(quality_cnn.WIDTH))
    chunks = [range(k * quality_cnn.HOP, min(k + 2, n) * quality_cnn.HOP) for k in range(max(1, n - 1))]
    logit = net.prior
    for f in range(quality_cnn.FILTERS):
        pooled = [max(0.0, max(answer(at, f) for at in chunk) + float(net.bias[f])) for chunk in chunks]
        logit += sum(pooled) / len(pooled) * float(net.out[f]) + max(pooled) * float(net.out[quality_cnn.FILTERS + f])
    return 1 / (1 + np.exp(-logit))


def some_network(seed=5):
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.3, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS))
    return quality_cnn.Network(tables, rng.normal(0, 0.1, quality_cnn.FILTERS), rng.normal(0, 0.3, 2 * quality_cnn.FILTERS), 0.2)


def test_network_against_loops():
    rng = np.random.default_rng(4)
    net = some_network()
    texts = [bytes(rng.integers(0, 256, size=n).astype(np.uint8)) for n in (0, 1, 123, 124, 300, 900)]
    assert np.allclose(quality_cnn.scores(net, texts), [plain_score(net, t) for t in texts], atol=1e-9)


def test_gradient_against_differences():
    rng = np.random.default_rng(6)
    net, labels = some_network(), np.array([0.0, 1.0, 1.0])
    texts = [bytes(rng.integers(97, 105, size=n).astype(np.uint8)) for n in (40, 300, 700)]
    weigh = quality_cnn.LOW_WEIGHT + (1 - quality_cnn.LOW_WEIGHT) * labels

    def loss():
        p = quality_cnn.scores(net, texts)
        return -float((weigh * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weigh.sum())

    grad = quality_cnn.gradient(net, texts, labels)
    for name, x in (("tables", net.tables), ("bias", net.bias), ("out", net.out)):
        strong = np.argsort(-np.abs(grad[name]).ravel())[:12]
        for at in [*strong, *rng.integers(0, x.size, 5)]:
            place = np.unravel_index(at, x.shape)
            held, h = x[place], 1e-6
            x[place] = held + h
            up = loss()
            x[place] = held - h
            down = loss()
            x[place] = held
            assert abs((up - down) / (2 * h) - grad[name][place]) < 1e-5, (name, place)


def test_fit_reads_whole_texts_and_repeated_ids(spark):
    rows = [(i, "the on re " * 6000 + ("### $$$ " * 40 if i % 2 else "an in he " * 40), "en", "clash", None) for i in range(60)]
    rows += [(1, "zz", "en", "clash", None)] * 200 + [(None, "the", None, None, None)]
    known = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], LABELS)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = quality_cnn.sampled(frame, known.selectExpr("doc_id", "quality as label"), "doc_id", "text")
    assert len(found) == 60 and all(len(t) > 60000 for i, t, _ in found if i != 1)  # what tells them apart stands at the very end
    got = {r.doc_id: r.predicted for r in quality_cnn.classify(frame.where("text <> 'zz'"), known).collect()}
    assert np.mean([got[i] == 1 - i % 2 for i in range(60)]) > 0.9


def test_families_part_markers_by_the_rows_that_hold_them():
    holds = np.zeros((60, 6))
    for k in range(3):
        holds[20 * k : 20 * k + 20, [2 * k, 2 * k + 1]] = 1
    family = toxicity.families(holds)
    assert [family[2 * k] == family[2 * k + 1] for k in range(3)] == [True] * 3 and len(set(family.tolist())) == 3
    assert toxicity.families(np.zeros((0, 2))).tolist() == [0, 1]


def test_network_grouping():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, size=n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 700, 5000)]
    net = quality_cnn.fit(texts * 4, np.array([0, 1, 0, 1, 0, 1, 0, 1] * 4, dtype=np.float32))
    together = quality_cnn.scores(net, texts)
    assert np.allclose(together, [quality_cnn.scores(net, [t])[0] for t in texts], atol=1e-6)
    again = quality_cnn.fit(texts * 4, np.array([0, 1, 0, 1, 0, 1, 0, 1] * 4, dtype=np.float32))
    assert (again.tables == net.tables).all()
    late = bytearray(b"a" * 5000)  # what stands at the very end still counts
    base = quality_cnn.scores(net, [bytes(late)])[0]
    late[-40:] = texts[6][:40]
    assert quality_cnn.scores(net, [bytes(late)])[0] != base


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(600, 2)
    odd = [(None, "blarg", None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (9003, "the on " * 40000 + "blarg", None, None, None), (3, docs[3][1], None, None, None)]
    frame, known = spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], LABELS)
    got = toxicity.classify(frame, known).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= x <= 1 for r in got for x in (r.p_family_1, r.p_family_2, r.p_family_3, r.score))
    truth = {i: t for i, _, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert toxicity.classify(frame.limit(0), known).count() == 0
    assert {round(r.score, 6) for r in toxicity.classify(frame.limit(5), known.limit(0)).collect()} == {0.0}


def test_chain_feeds_earlier_probabilities():
    texts = ["aaa bbb", "aaa", "bbb", "ccc"] * 20
    first, second = np.array([1, 1, 0, 0] * 20), np.array([1, 0, 0, 0] * 20)
    chain = toxicity.fit_chain(texts, {"x": first.astype(float), "y": second.astype(float)}, {"aaa": 0, "bbb": 1, "ccc": 2}, np.ones(80), np.arange(80) % 5)
    p = chain.predict(np.stack([chain.features(t) for t in texts[:4]]))
    assert (np.round(p[:, 0]) == first[:4]).all() and p[0, 1] > p[1:, 1].max()
    assert len(chain.models[1]) == len(chain.models[0]) + 1


def test_chain_against_loops():
    docs, labels = corpus(200, 7)
    rows = [(d[1], t) for d, (_, _, t) in zip(docs, labels, strict=True)]
    chain = toxicity.fit(rows)
    names = list(chain.vocabulary)
    for text, _ in rows[:12]:
        words = [w for w in __import__("re").findall(r"[^\W\d_]+", text.lower())]
        x = []
        for measure in ("held", "rate"):
            for name in names:
                n = sum(w == name or (name.endswith("-") and len(w) > len(name) - 1 and w.startswith(name[:-1])) for w in words)
                x.append(float(n > 0) if measure == "held" else np.log1p(100 * n / max(len(words), 1)))
        for model in chain.models:
            x.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, model[:-1], strict=True)) + model[-1]))))
        assert np.allclose(chain.predict(np.stack([chain.features(text)]))[0], x[-len(chain.models) :], atol=1e-4)
