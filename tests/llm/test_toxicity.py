import random

import numpy as np

from lodestone.llm import toxicity as tx


def test_pairs_and_held_out(spark):
    """An insult counts only beside a group's name: no sum of single weights can tell."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(3000)}" for _ in range(30)] + ["Insultword"] * insult + ["groupname"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(insult and group), "clash"))
    rows += [(5000, None, ""), (5001, "", ""), (5002, "INSULTWORD groupname. " * 30_000, ""), (5003, "groupname", ""), (5003, "groupname", "")]
    labels += [(None, 1, ""), (1, None, ""), (9999, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = tx.learn_and_score(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, y, _ in labels[:1600]}
    out = [i for i in truth if by[i].held_out]
    assert np.mean([by[i].predicted == truth[i] for i in out]) > 0.97
    assert by[5000].score == by[5001].score and by[5002].predicted == 1 and by[5003].predicted == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = tx.Machine(0.1, rng.normal(size=5), rng.normal(size=(5, 3)), np.array([0, 1, -1, 2, 3, 4]))
    f = [0, 1, 2, 4]
    z = 0.1 + sum(m.weight[i] for i in f) + sum(m.vector[i] @ m.vector[j] for i in f for j in f if i < j)
    assert abs(m.score(np.array([0, 1, 2, 3, 5])) - 1 / (1 + np.exp(-z))) < 1e-12


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.learn_and_score(docs, labels).count() == 0
    one = tx.learn_and_score(spark.createDataFrame([(None, "x")], "doc_id long, text string"), labels).collect()
    assert one[0].predicted == 0 and not one[0].held_out


def test_gradient():
    """Against differences of the loss, term by term."""
    rng = np.random.default_rng(3)
    x = (rng.random((12, 5)) < 0.5).astype(np.float64)
    label, cost = (rng.random(12) < 0.5).astype(float), rng.random(12) / 12
    theta = {"b": np.array([0.2]), "w": rng.normal(size=5), "v": rng.normal(size=(5, 3))}

    def loss(t):
        z = [t["b"][0] + t["w"][f].sum() + sum(t["v"][i] @ t["v"][j] for i in f for j in f if i < j) for f in (np.flatnonzero(r) for r in x)]
        fit = sum(c * np.log1p(np.exp(-q if y else q)) for c, q, y in zip(cost, z, label))
        return fit + tx.SMALL_W / 2 * (t["w"] ** 2).sum() + tx.SMALL_V / 2 * (t["v"] ** 2).sum()

    got = tx.gradient(theta, x, label, cost)
    for k, t in theta.items():
        for at in np.ndindex(t.shape):
            up, down = ({**theta, k: t.copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - got[k][at]) < 1e-6


def test_copies_of_a_sampled_id(spark):
    """Features against plain counts; an id that thousands of rows repeat teaches once."""
    rng = random.Random(2)
    rows = [(i, f"{'vile' if i % 2 else 'kind'} w{rng.randrange(50)}") for i in range(400)] + [(1, "vile w1")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, toxic int")
    m = tx.fit(docs, labels)
    terms, total, pos = tx.Terms(), {}, {}
    for i, t in rows[:400]:
        for b in terms.of((t if i != 1 else "vile w1").encode()).tolist():
            total[b] = total.get(b, 0) + 1
            pos[b] = pos.get(b, 0) + i % 2
    z = {b: abs(pos[b] - n / 2) / np.sqrt(max(n / 4 * (1 - n / 400), 1e-9) + 1) for b, n in total.items() if n >= 4}
    assert abs(sum(x > 3 for x in z.values()) - (m.number >= 0).sum()) <= 2
    assert m.score(terms.of(b"vile")) > 0.9 and m.score(terms.of(b"kind")) < 0.1
