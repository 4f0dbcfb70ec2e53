"""The pairwise ranker against a plain version: loss on feature differences, step by step, and its threshold."""

import math
import random

import numpy as np

from webgauge.llm.quality import CUT, SHAPES, features, fit_pairs, rank_quality


def plain_ranker(texts, labels, steps=800, batch=128, seed=11):
    """Scores of texts by gradient steps on the Bradley-Terry loss of drawn pairs, in plain numbers."""
    raw = [[float(v) for v in row] for row in features(texts)]
    n, width = len(raw), len(raw[0])
    means = [sum(r[k] for r in raw) / n for k in range(SHAPES)]
    spreads = [math.sqrt(sum((r[k] - means[k]) ** 2 for r in raw) / n) + 1e-6 for k in range(SHAPES)]
    rows = []
    for r in raw:
        row = {k: max(-6.0, min(6.0, (r[k] - means[k]) / spreads[k])) for k in range(SHAPES)}
        row |= {k: 20 * r[k] for k in range(SHAPES, width) if r[k]}
        rows.append(row)
    good, bad = [i for i, y in enumerate(labels) if y > 0.5], [i for i, y in enumerate(labels) if y <= 0.5]
    rng = np.random.default_rng(seed)
    w, seen, total = [0.0] * width, [1e-3] * width, [0.0] * width
    for step in range(steps):
        better, worse = rng.choice(good, batch), rng.choice(bad, batch)
        gradient = [1e-4 * v for v in w]
        for a, b in zip(better.tolist(), worse.tolist()):
            apart = {k: rows[a].get(k, 0.0) - rows[b].get(k, 0.0) for k in rows[a].keys() | rows[b].keys()}
            margin = max(-30.0, min(30.0, sum(v * w[k] for k, v in apart.items())))
            pull = 1 / (1 + math.exp(margin))  # of -log(sigmoid(margin))
            for k, v in apart.items():
                gradient[k] -= pull * v / batch
        for k, g in enumerate(gradient):
            if g:
                seen[k] += g * g
                w[k] -= 0.1 * g / math.sqrt(seen[k])
        if step >= steps // 2:
            total = [t + v for t, v in zip(total, w)]
    mean_w = [t / (steps - steps // 2) for t in total]
    s = [sum(v * mean_w[k] for k, v in row.items()) for row in rows]
    order = sorted(range(n), key=lambda i: s[i])
    errors = [0]
    for i in order:
        errors.append(errors[-1] + (2 if labels[i] > 0.5 else -1))
    best = [i for i, e in enumerate(errors) if e == min(errors)]
    q = int(sum(best) / len(best))
    cut = s[order[0]] - 1 if q == 0 else s[order[-1]] + 1 if q == n else (s[order[q - 1]] + s[order[q]]) / 2
    spread = abs(sum(s[i] for i in good) / len(good) - sum(s[i] for i in bad) / len(bad)) or 1.0
    return [1 / (1 + math.exp(-max(-30, min(30, 8 / spread * (x - cut) + math.log(CUT / (1 - CUT)))))) for x in s]


def sample(n, seed=3):
    """Texts of two kinds that overlap, with labels of which some are wrong."""
    rng = random.Random(seed)
    prose, junk = [f"word{k}" for k in range(60)], [f"BUY{k}!!" for k in range(15)] + ["$$$", "click"]
    texts, labels = [], []
    for _ in range(n):
        y = rng.random() < 0.5
        share = rng.uniform(0.55, 1) if y else rng.uniform(0, 0.5)
        texts.append(" ".join(rng.choice(prose) if rng.random() < share else rng.choice(junk) for _ in range(rng.randint(8, 60))) + ("." if y else ""))
        labels.append(float(y if rng.random() < 0.95 else not y))
    return texts, labels


def test_scores_are_those_of_plain_steps():
    texts, labels = sample(200)
    ranker = fit_pairs(np.array(features(texts), np.float32), np.array(labels))
    got, want = ranker.score(texts), plain_ranker(texts, labels)
    assert max(abs(a - b) for a, b in zip(got, want)) < 0.02
    assert all((a >= CUT) == (b >= CUT) for a, b in zip(got, want) if abs(b - CUT) > 0.02)
    assert sum((a >= CUT) == (y > 0.5) for a, y in zip(got, labels)) > 170


def test_the_query_scores_all_and_learns_of_rows_not_held_out(spark):
    """The whole path equals fitting on those rows directly."""
    import zlib

    texts, labels = sample(300, seed=4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rank_quality(docs, marks).collect()}
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)]
    assert [got[i].held_out for i in range(300)] == held
    learned = [i for i in range(300) if not held[i]]
    ranker = fit_pairs(np.array(features([texts[i] for i in learned]), np.float32), np.array([labels[i] for i in learned]))
    want = ranker.score(texts)
    assert max(abs(got[i].score - want[i]) for i in range(300)) < 1e-3
    assert all(got[i].predicted == (got[i].score >= CUT) for i in range(300))
