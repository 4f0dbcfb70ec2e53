"""Line dedup of texts that repeat themselves, and hot keys of the n-gram join."""

import random
import time

import numpy as np
import xxhash

from webgauge.llm import line_dedup
from webgauge.llm.jaccard_join import jaccard_join
from webgauge.llm.line_dedup import _cut, around, dedup_lines, extend, extensions, fingerprints, line_hashes, matches_to_look_beyond, runs_beyond


def test_lengths_found_by_halving_are_those_of_comparing(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(line_dedup, "DIRECT", -1)
    for trial in range(300):
        n, m = rng.integers(1, 60, 2)
        source, own = rng.integers(0, 3, m) * (2**61), rng.integers(0, 3, n) * (2**61) - 5
        if trial % 3 == 0:
            own, n = source.copy(), m
        k = rng.integers(1, 20)
        at, source_at = np.sort(rng.integers(0, n, k)), rng.integers(0, m, k)
        lo, hi = extensions(own, source, at, source_at)
        assert list(zip(lo.tolist(), hi.tolist())) == [extend(own, source, a, b) for a, b in zip(at.tolist(), source_at.tolist())]


def test_matches_left_out_tell_nothing_new():
    rng = random.Random(4)
    less = 0
    for _ in range(60):
        pool = [rng.randrange(2**62) for _ in range(rng.randint(1, 5))]
        own = np.array((pool * 90)[: rng.randint(100, 300)] + [rng.choice(pool) for _ in range(40)], np.int64)
        before = np.concatenate([[0], np.cumsum([rng.randint(1, 30) if len(pool) > 3 else 9] * len(own))])
        at = np.array(sorted(rng.sample(range(1, len(own) - 30), 90)))
        lo, hi = extensions(own, own, at, np.zeros_like(at))
        cut = np.zeros(len(own), bool)
        for a, b in zip(lo, hi):
            cut[a:b] = True

        def told(matches):
            runs = {r for i in matches for r in runs_beyond(before, int(at[i]), int(lo[i]), int(hi[i]))}
            first = {}
            for a, b in sorted(runs):
                first.setdefault(xxhash.xxh3_64_intdigest(own[a:b].tobytes()), a)
            return first, {k for a, b in runs for k in range(a, b) if not cut[k]}

        chosen = matches_to_look_beyond(own, before, cut, at, lo, hi)
        assert told(chosen.tolist()) == told(range(len(at)))
        less += len(chosen) < len(at) / 2
        begin, end = around(before, at)
        assert all(not runs_beyond(before, int(a), int(b), int(c)) for a, b, c in zip(at, begin, end))
    assert less > 20


def plain(rows):
    """Every match and every run beyond it, one by one."""
    places, texts = {}, {}
    for i, t in rows:
        h, w, _ = line_hashes(t)
        texts[i] = (np.array(h, np.int64), np.concatenate([[0], np.cumsum(w)]).astype(np.int64), fingerprints(h, w))
        for x, k in texts[i][2]:
            places.setdefault(x, (i, k))
    gone, runs = {i: set() for i, _ in rows}, {}
    for i, _ in rows:
        own, before, marks = texts[i]
        for x, k in marks:
            source, at = places[x]
            if (source, at) == (i, k):
                continue
            lo, hi = extend(own, texts[source][0], k, at)
            gone[i].update(range(lo, hi))
            for a, b in runs_beyond(before, k, lo, hi):
                runs.setdefault(own[a:b].tobytes(), set()).add((i, a, b))
    for same in runs.values():
        for i, a, b in sorted(same)[1:]:
            gone[i].update(range(a, b))
    return {i: _cut(t, sorted(gone[i])) for i, t in rows}


def test_texts_that_repeat_themselves_against_a_plain_version(spark, make_docs):
    rng = random.Random(6)
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(3 + k % 9 * 4))
    rows = []
    for i in range(25):
        period = [line(rng.randrange(12)) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join((period * 150)[: rng.randint(100, 260)] + [line(rng.randrange(12)) for _ in range(rng.randint(0, 40))] + period * 3)))
    got = {r.doc_id: r.text for r in dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_many_equal_lines_take_time_in_proportion(spark, make_docs):
    line = "one line of ten words that says the same again"

    def seconds(n):
        begun = time.time()
        got = dedup_lines(make_docs([(1, "\n".join([line] * n)), (2, "other\ntext")])).collect()
        assert {r.doc_id: len(r.text.split("\n")) for r in got}[1] < 8
        return time.time() - begun

    seconds(100)
    few = seconds(50_000)
    assert seconds(200_000) < 6 * max(few, 1)


def test_a_digest_of_many_rows(spark, make_docs):
    """A text copied 200,000 times, and near copies of it, don't meet in one task."""
    base = " ".join(f"w{j}" for j in range(120))
    near = " ".join(f"w{j}" if j != 60 else "changed" for j in range(120))
    docs = spark.range(200_000).selectExpr("id AS doc_id", f"'{base}' AS text").unionByName(make_docs([(300_000, near), (300_001, "all alone here with other words")]).select("doc_id", "text"))
    got = jaccard_join(docs).groupBy("class_id", "n_links").count().collect()
    assert {tuple(r) for r in got} == {(0, 200_000, 200_001), (300_001, 0, 1)}
