"""Exact, near, line and embedding deduplication, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from webgauge.llm.components import connected_components
from webgauge.llm.embedding_dedup import cells_of, join_label, near_duplicates
from webgauge.llm.exact_dedup import exact_dedup
from webgauge.llm.jaccard_join import _block_tasks, jaccard_join, keep_one_of_each, least_matches, surviving, verify
from webgauge.llm.line_dedup import dedup_lines, fingerprints, line_hashes


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), x in zip(rows, norm):
        group = [(len(t or ""), j is not None, -(j or 0), j) for (j, t), y in zip(rows, norm) if x == y]
        out.append((i, max(group)[3], len(group)))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, make_docs, odd_rows, tmp_path, weak):
    rows = odd_rows + [(20, "a b"), (21, "ab  "), (22, "a\x0bb"), (23, "a\xa0b"), (24, "abc"), (25, "ABC")]
    path = str(tmp_path / "docs.parquet")
    make_docs(rows).repartition(3).write.parquet(path)
    # a digest that many texts share shows that bytes decide
    got = exact_dedup(spark, path, (lambda n: F.substring(F.md5(n), 1, 1)) if weak else None, files_per_trigger=1).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == sorted((a or -1, b or -1, c) for a, b, c in expected_exact(rows))
    groups = {r.text_sha256 for r in got}
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_a_hot_group(spark, make_docs, tmp_path):
    """Most rows of one text, in a folder whose name is a pattern."""
    path = str(tmp_path / "a[1]{b}*" / "docs")
    make_docs([(k, "hot text " * 9) for k in range(3000)] + [(5000 + k, f"own {k}") for k in range(50)]).repartition(4).write.parquet(path)
    got = exact_dedup(spark, path).toPandas()
    assert len(got) == 3050 and got.group_size.max() == 3000 and (got.keep_id[got.group_size > 1] == 0).all() and got.kept.sum() == 51
    weak = exact_dedup(spark, path, lambda n: F.substring(F.md5(n), 1, 0)).toPandas()  # all texts share a digest
    assert sorted(weak.group_size.value_counts().items()) == [(1, 50), (3000, 3000)]


def test_exact_dedup_of_nothing_and_of_one_file(spark, make_docs, tmp_path):
    import pyarrow.parquet as pq

    empty = str(tmp_path / "none.parquet")
    make_docs([]).write.parquet(empty)
    assert exact_dedup(spark, empty).count() == 0
    one = str(tmp_path / "one.parquet")
    pq.write_table(make_docs([(1, "x"), (2, "x ")]).toArrow(), one)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(spark, one).collect()} == {(1, 2, False), (2, 2, True)}


def expected_jaccard(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    comp = components(len(rows), pairs)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if comp[k] == comp[i] and rows[k][0] is not None]
        out.append((d or -1, min(ids) if ids else -1, sum(i in p for p in pairs)))
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [3, 1500])
def test_jaccard_join(spark, make_docs, odd_rows, prose, cell_rows):
    rows = list(odd_rows)
    for k in range(8):  # near copies with changes that lie on both sides of the threshold
        w = prose(200, 50).split(" ")
        for c in range(k):
            w[9 + 23 * c] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, prose(80, 900 + k)) for k in range(20)]
    got = jaccard_join(make_docs(rows), cell_rows=cell_rows).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == expected_jaccard(rows)


def test_jaccard_join_keeps_one(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert keep_one_of_each(make_docs([])).count() == 0 and jaccard_join(make_docs([])).count() == 0


def test_pruning_keeps_similar_pairs():
    least = least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(least, least[1:])) and least[-1] > 60
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, (500, 128), dtype=np.uint32)
    near, far = base.copy(), base.copy()
    near[rng.random(near.shape) > 0.8] += 1
    far[rng.random(far.shape) > 0.3] += 1
    sig = np.concatenate([base, near, far])
    i = np.arange(500)
    assert surviving(sig, i, i + 500, 0.8, 1e-6).all() and not surviving(sig, i, i + 1000, 0.8, 1e-6).any()


def bucket_of(near, apart, seed=0):
    """Signatures that share a band: near copies of one another, and others that share nothing else."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, 128, dtype=np.uint32)
    sig = np.tile(base, (near + apart, 1))
    change = rng.random(sig.shape) < 0.05
    change[near:] = True
    change[:, :4] = False
    sig[change] = rng.integers(0, 2**32, int(change.sum()), dtype=np.uint32)
    order = rng.permutation(len(sig))
    return sig[order], np.argsort(order)[:near]


@pytest.mark.parametrize("near, apart, block_rows", [(60, 40, 7), (0, 50, 8), (50, 0, 10), (97_000, 3_000, 2_000)])
def test_one_bucket_of_many(spark, near, apart, block_rows):
    sig, group = bucket_of(near, apart)
    if apart == 40:  # two that only meet each other, in blocks of their own
        rest = np.setdiff1d(np.arange(len(sig)), group)
        sig[rest[-1]] = sig[rest[0]]
        sig[rest[-1], 100] += 1
    import pandas as pd

    reps = spark.createDataFrame(pd.DataFrame({"rep": np.arange(len(sig)), "sig": [r.tobytes() for r in sig]}), "rep long, sig binary")
    from webgauge.llm.jaccard_join import _candidate_edges

    edges = [(r.a, r.b) for r in _candidate_edges(reps, 0.8, 1e-6, block_rows).collect()]
    found = components(len(sig), edges)
    assert len({found[i] for i in group}) == min(1, near)
    assert len(set(found)) == min(1, near) + apart - (apart == 40)
    assert len(edges) < 8 * len(sig)


def test_blocks_compare_every_pair_once(spark):
    rows = [(1, r, 0 if r < 25 else r) for r in range(60)] + [(2, r, r % 2) for r in range(100, 104)]
    tasks = _block_tasks(spark.createDataFrame(rows, "band long, rep long, root long"), 10).collect()
    by = {}
    for t in tasks:
        by.setdefault((t.band, t.task), []).append(t)
    seen = {}
    for (band, _), members in by.items():
        assert len(members) < 45  # two blocks by hash
        sides = {m.side for m in members}
        for a in members:
            for b in members:
                if a.rep < b.rep and a.root != b.root and (len(sides) == 1 or a.side != b.side):
                    seen[band, a.rep, b.rep] = seen.get((band, a.rep, b.rep), 0) + 1
    root = {(b, r): x for b, r, x in rows}
    want = {(b, r, q) for b, r, x in rows for c, q, y in rows if b == c and r < q and x != y}
    assert set(seen) == want and root


def test_verification_counts_exactly():
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.95], rng.integers(1000, 1004, 3).astype(np.uint64)])) for _ in range(40)] + [np.arange(5000, 5010, dtype=np.uint64)]
    weight = rng.integers(1, 4, 41)
    links, root = verify(sets, weight, 0.8)
    hit = np.array([[a is not b and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert links.tolist() == (hit @ weight).tolist() and root[40] == 40
    left = rng.random(41) < 0.5
    links, _ = verify(sets, weight, 0.8, left, ~left)
    assert links.tolist() == ((hit & (left[:, None] != left[None, :])) @ weight).tolist()


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = centers[i % 12] + rng.normal(size=16) * (0.06 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in np.float32(v)], [0, 0, 0, 1, None][i % 5]))
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0)]
    rows += [(n + 7 + k, rows[0][1], 0) for k in range(30)] + [(3, rows[3][1], 1)]
    return rows


@pytest.mark.parametrize("cell_rows", [15, 2000])
def test_embedding_join(spark, cell_rows):
    rows = vectors(1)
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    pairs = []
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if good[i] and good[j] and x == y and x is not None and len(a) == len(b):
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / np.sqrt((a_ @ a_) * (b_ @ b_)) >= 0.98:
                    pairs.append((i, j))
    comp = components(len(rows), pairs)
    want = sorted((r[0], sum(i in p for p in pairs), min(rows[k][0] for k in range(len(rows)) if comp[k] == comp[i])) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("home", F.lit(2))
    got = near_duplicates(df, cell_rows=cell_rows).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


def test_replication_covers_every_link():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1)[:, None]
    all_ = np.concatenate([x, y])
    home, who, where = cells_of(all_, x[:9], np.sqrt(2 - 2 * 0.98))
    to = set(zip(who.tolist(), where.tolist()))
    hit = all_ @ all_.T >= 0.98
    for i, j in zip(*np.nonzero(hit)):
        assert home[i] == home[j] or (i, home[j]) in to and (j, home[i]) in to
    links, root = join_label(all_, np.ones(600, np.int64), 0.98)
    assert links.tolist() == (hit.sum(axis=1) - 1).tolist()
    assert root.tolist() == components(600, [(i, j) for i, j in zip(*np.nonzero(hit)) if i < j])
    assert len(who) < 0.5 * 9 * 600  # cells are smaller than the whole


def test_one_label_of_100_000_vectors(spark):
    """A label of any size has its own pivots, and no task gets all of it."""
    import pandas as pd

    rng = np.random.default_rng(9)
    n = 50_000
    x = rng.normal(size=(n, 8))
    y = x + rng.normal(size=x.shape) * 0.002  # each has one near copy
    frame = pd.DataFrame({"vec_id": np.arange(2 * n), "embedding": np.concatenate([x, y]).tolist(), "label": 1})
    got = near_duplicates(spark.createDataFrame(frame, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    units = np.concatenate([x, y])
    units /= np.linalg.norm(units, axis=1)[:, None]
    for lo in range(0, 2 * n, 10_000):  # whole links of every 10,000th block's first 50
        rows = slice(lo, lo + 50)
        hit = units[rows] @ units.T >= 0.98
        assert got.n_links.to_numpy()[rows].tolist() == (hit.sum(axis=1) - 1).tolist()
        for k, i in enumerate(range(lo, lo + 50)):
            assert set(got.component_id.to_numpy()[hit[k]]) == {got.component_id.to_numpy()[i]}


def text_of(result):
    return {r.doc_id: r.text for r in result.collect()}


def test_line_runs_are_removed_once(spark, make_docs, prose):
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(9))  # 81 words on nine lines
    long_line = " ".join(f"z{j}" for j in range(60))
    clean = [prose(90, s) for s in (1, 2, 3, 4)]
    rows = [(1, clean[0] + "\n" + passage), (2, "before\n" + passage + "\nafter\n" + clean[1]), (3, clean[2] + "\n" + long_line), (4, long_line + "\n" + clean[3]), (5, "short\nline"), (6, "short\nline"), (7, passage + "\n\n" + passage)]
    out = text_of(dedup_lines(make_docs(rows)))
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert out[2] == "before\nafter\n" + clean[1] and out[4] == clean[3]
    assert out[5] == out[6] == "short\nline"
    assert out[7].strip() == ""


def test_line_dedup_against_brute_force(spark, make_docs, prose):
    """Deleted lines have an earlier copy of the run; shared runs of two stretches lose all their later lines."""
    import random

    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice([3, 8, 30]))) for k in range(25)]
    rows = []
    for i in range(60):
        at = rng.randrange(20)
        rows.append((i, "\n".join([prose(8, 1000 + i), *pool[at : at + rng.randint(1, 6)], prose(8, 5000 + i)])))
    out = text_of(dedup_lines(make_docs(rows)))
    seen = set()
    for i, t in rows:
        left = out[i].split("\n") if out[i] else []
        for line in t.split("\n"):
            if line not in left:
                assert line in seen
            seen.add(line)
    copies = {}
    for i, _ in rows:
        for line in out[i].split("\n"):
            if len(line.split()) >= 25:
                copies[line] = copies.get(line, 0) + 1
    assert copies and max(copies.values()) == 1


def test_line_dedup_of_runs_beyond_the_first_holder(spark, make_docs):
    """Runs with a hot line that later documents share with each other, against every pair of positions."""
    import random

    word = lambda k, n: " ".join(f"h{k}w{j}" for j in range(n))
    x, y, z = word("x", 25), word("y", 24), word("z", 24)
    rows = [(1, x + "\nown a"), (2, f"{x}\n{y}\n{z}\nown b"), (3, f"{x}\n{y}\n{z}\nother c")]
    out = text_of(dedup_lines(make_docs(rows)))
    assert out[1] == rows[0][1] and out[2] == f"{y}\n{z}\nown b" and out[3] == "other c"

    rng = random.Random(21)
    hot = [word(f"hot{k}", rng.choice([25, 26, 60])) for k in range(2)]
    pool = [word(f"p{k}", rng.choice([1, 4, 9, 14, 24, 70])) for k in range(14)]
    rows = []
    for i in range(150):
        lines = [rng.choice(hot)]
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(12)
            lines += pool[k : k + rng.randint(1, 5)] + ([rng.choice(hot)] if rng.random() < 0.7 else [])
        rows.append((i, "\n".join(lines)))
    docs = [t.split("\n") for _, t in rows]
    marks = [{k: h for h, k in fingerprints(*line_hashes(t)[:2])} for _, t in rows]
    words = lambda lines: sum(len(line.split()) for line in lines)
    want = {}
    for d, own in enumerate(docs):
        cut = set()
        for e in range(d + 1):
            other = docs[e]
            for i in range(len(own)):
                for j in range(len(other) if e < d else i):
                    if own[i] != other[j] or i and j and own[i - 1] == other[j - 1]:
                        continue  # maximal runs only
                    n = next((n for n in range(min(len(own) - i, len(other) - j)) if own[i + n] != other[j + n]), min(len(own) - i, len(other) - j))
                    if any(k + i in marks[d] and marks[d][k + i] == marks[e].get(k + j) for k in range(n)):
                        cut.update(range(i, i + n))
                    else:
                        assert words(own[i : i + n]) < 50
        want[d] = "\n".join(line for k, line in enumerate(own) if k not in cut)
    assert text_of(dedup_lines(make_docs(rows))) == want


def test_every_later_shared_run_of_two_stretches_goes(spark, make_docs):
    """A = X, B = P X Q, C = P X Q and other mixes of shared parts; each case has words of its own."""
    import random

    rng = random.Random(4)

    def part(case, name, words):
        out, k = [], 0
        while k < words:
            n = min(words - k, rng.randint(1, 14))
            out.append(" ".join(f"c{case}{name}{j}" for j in range(k, k + n)))
            k += n
        return out

    rows, cases = [], []
    for case in range(500):
        x, p, q = (part(case, name, n) for name, n in (("x", 80), ("p", 4), ("q", 4)))
        if case % 2:
            docs = [x, p + x + q, p + x + q]
        else:
            parts = [part(case, f"s{k}", rng.choice([4, 12, 30, 55, 80])) for k in range(5)]
            docs = [sum(rng.choices(parts, k=rng.randint(1, 5)), []) + part(case, f"own{d}", rng.randint(1, 30)) for d in range(4)]
        cases.append([(len(rows) + d, lines) for d, lines in enumerate(docs)])
        rows += [(i, "\n".join(lines)) for i, lines in cases[-1]]
    out = text_of(dedup_lines(make_docs(rows)))
    words = lambda lines: sum(len(line.split()) for line in lines)
    missed = 0
    for docs in cases:
        for d, (i, own) in enumerate(docs):
            must = [False] * len(own)
            for e in range(d + 1):
                other = docs[e][1]
                for a in range(len(own)):
                    for b in range(len(other) if e < d else a):
                        n = 0
                        while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                            n += 1
                        if n and words(own[a : a + n]) >= 50:
                            must[a : a + n] = [True] * n
            left = out[i].split("\n")
            # what has to go is gone: what is left is a subsequence of the other lines
            rest = iter(line for line, gone in zip(own, must) if not gone)
            missed += not all(any(line == r for r in rest) for line in left if line)
    assert missed == 0


def test_line_dedup_of_a_hot_line(spark, make_docs):
    hot = " ".join(f"hot{j}" for j in range(30))
    rows = [(k, f"{hot}\nown {k}\n{hot}") for k in range(3000)]
    out = text_of(dedup_lines(make_docs(rows)))
    assert out[0] == f"{hot}\nown 0\n" or out[0] == f"{hot}\nown 0"
    assert all(out[k].strip() == f"own {k}" for k in range(1, 3000))
    assert dedup_lines(make_docs([])).count() == 0


def test_fingerprints_guarantee():
    shared = "\n".join(" ".join(f"s{k}q{j}" for j in range(5)) for k in range(10))  # two stretches of 25 words
    a = fingerprints(*line_hashes("one two three\n" + shared + "\nend of a")[:2])
    b = fingerprints(*line_hashes(shared + "\nother end\nwords here")[:2])
    assert {h for h, _ in a} & {h for h, _ in b}


def test_line_dedup_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_removed"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    by = {(r.doc_id, r.text) for r in rows}
    assert (1, None) in by and (2, "") in by and (None, "no id") in by and (10, "one two three") in by
    assert sum(bool(r.text) for r in rows if r.doc_id in (4, 5)) == 1
    assert dedup_lines(make_docs([])).count() == 0
