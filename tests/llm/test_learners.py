"""The learners against plain Python versions of their updates, and held-out accuracy."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import quality, queries, toxicity


def test_leader_follows_the_plain_update():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), float(rng.integers(2))) for _ in range(300)]
    model = quality.Leader()
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for i, x, y in rows:
        model.learn(i, x, y)
        w = [weight(k) for k in i]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for k, a, b in zip(i.tolist(), x.tolist(), w):
            g = (p - y) * a
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
            z[k] += g - sigma * b
            n[k] += g * g
    assert np.allclose(model.z[:40], z) and np.allclose(model.n[:40], n) and np.allclose(model.weights(slice(0, 40)), [weight(k) for k in range(40)])


def test_a_quality_score_is_a_sparse_dot_product():
    texts = ["a good text of words", "a a a a", "", "x y, z"]
    table = pa.table({"text": texts, "y": pa.array([1, 0, 0, 1], pa.int32())})
    model = quality.learn(table)
    w = dict(zip(model["at"].tolist(), model["w"].tolist()))
    from brindle.llm.kernels import slices

    for a, b, buf, off in slices(pa.array(texts)):
        got = quality.scorer(model)(buf, off)
        f, first = quality.features(buf, off)
        for k in range(b - a):
            i = [j for j in f[:, first[k] : first[k + 1]].ravel().tolist() if j != 1 << quality.HASH_BITS]
            words = max(1, first[k + 1] - first[k])
            x = w.get(1 << quality.HASH_BITS, 0.0) + quality.SCALE / words * sum(w.get(j, 0.0) for j in i)
            assert abs(got[k] - 1 / (1 + math.exp(-x))) < 1e-5


def plain_toxicity(rows, steps):
    """Embeddings and class vectors moved together, one number at a time."""
    rng = np.random.default_rng(11)
    size, dim = (1 << toxicity.BUCKETS_BITS) + 1, toxicity.DIM
    start, out = rng.normal(0, 0.1, (size, dim)), rng.normal(0, 0.5, (2, dim)).tolist()
    vectors: dict = {}
    vec = lambda b: vectors.setdefault(b, [0.0] * dim if b == size - 1 else start[b].tolist())
    bias, seen, seen_out, seen_bias = [0.0, 0.0], {}, 1e-3, 1e-3
    share = [sum(r[3] == y for r in rows) for y in (0, 1)]
    epochs = max(toxicity.EPOCHS, -(-steps // max(1, len(rows))))
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            seq, flat, sizes, y = rows[k]
            grams, at = [], 0
            for s in sizes.tolist():
                grams.append(flat[at : at + s].tolist())
                at += s
            number = [sum(sum(a * (o1 - o0) for a, o0, o1 in zip(vec(b), *out)) for b in g) / len(g) for g in grams]
            passage = seq.tolist()
            if epoch >= epochs // 3:
                w = min(toxicity.PASSAGE, len(passage))
                means = [sum(number[i] for i in passage[j : j + w]) / w for j in range(len(passage) - w + 1)]
                best = max(range(len(means)), key=lambda j: means[j])
                passage = passage[best : best + toxicity.PASSAGE]
            bag = [(b, passage.count(word) / (len(passage) * len(grams[word]))) for word in sorted(set(passage)) for b in grams[word]]
            x = [sum(p * vec(b)[q] for b, p in bag) for q in range(dim)]
            logit = [sum(a * b for a, b in zip(out[c], x)) + bias[c] for c in (0, 1)]
            e = [math.exp(v - max(logit)) for v in logit]
            weight = sum(share) / max(1, 2 * share[y])
            d = [(e[c] / sum(e) - (c == y)) * weight for c in (0, 1)]
            move = [d[0] * out[0][q] + d[1] * out[1][q] for q in range(dim)]
            grad = [[d[c] * x[q] for q in range(dim)] for c in (0, 1)]
            energy = sum(m * m for m in move) / dim
            for b, p in bag:
                seen[b] = seen.get(b, 0.0) + p * p * energy
            steps_of = [(b, 0.0 if b == size - 1 else toxicity.RATE * p / math.sqrt(seen[b] + 1e-10)) for b, p in bag]
            for b, s in steps_of:
                vectors[b] = [v - s * m for v, m in zip(vec(b), move)]
            seen_out += sum(g * g for row in grad for g in row) / (2 * dim)
            out = [[o - 0.05 * g / math.sqrt(seen_out) for o, g in zip(out[c], grad[c])] for c in (0, 1)]
            seen_bias += (d[0] ** 2 + d[1] ** 2) / 2
            bias = [bias[c] - 0.1 * d[c] / math.sqrt(seen_bias) for c in (0, 1)]
    return {b: sum(v * (o1 - o0) for v, o0, o1 in zip(vectors[b], *out)) for b in seen if b != size - 1}, bias[1] - bias[0]


def test_toxicity_follows_the_plain_update(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 120)
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    bad, good = "you are a vile stupid idiot", "the harvest was plentiful this year and all were glad"
    texts = [good, bad, good + " " + bad + " " + good, "a short one", good[:30], bad + " again and again"]
    table = pa.table({"text": texts, "y": pa.array([0, 1, 1, 0, 0, 1], pa.int32())})
    model = toxicity.learn(table)
    number, bias = plain_toxicity(toxicity._sample(table), 120)
    got = dict(zip(model["at"].tolist(), model["number"].tolist()))
    assert set(got) == {b for b, v in number.items() if v} and abs(float(model["bias"][0]) - bias) < 1e-6
    assert all(abs(got[b] - number[b]) < 1e-4 for b in got)


def test_unseen_misspellings_share_their_grams(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 3000)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(80)]
    plain = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    table = pa.table({"text": plain + [p + " scoundrel wretched" for p in plain[:30]], "y": pa.array([0] * 60 + [1] * 30, pa.int32())})
    score = toxicity.scorer(toxicity.learn(table))
    from brindle.llm.kernels import slices

    (_, _, buf, off), = slices(pa.array([plain[40] + " scoundrell wretchedd", plain[40]]))
    got = score(buf, off)
    assert got[0] > 0.5 > got[1]


@pytest.mark.parametrize("name, label, sf, least", [("op5_quality", "quality", "sf0.01", 0.9), ("op7_toxicity", "toxic", "sf0.1", 0.95)])
def test_held_out_accuracy(spark, name, label, sf, least):
    """Area under the curve and decisions on rows that taught nothing, at a scale that has enough labels."""
    folder = f"/root/testdata/{sf}"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].score, got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    right = np.mean([p == y for _, p, y in held])
    assert auc >= least and right >= 0.85, (auc, right, len(pos), len(neg))
