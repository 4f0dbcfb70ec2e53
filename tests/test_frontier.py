"""Crawls of many sites at once against a queue for each, their rounds, time budgets and progress."""

import random
from collections import deque

import pytest

from webgauge.operators import frontier

LINKS, SITEMAP, ENDS = "site_key string, src string, dst string, pos int", "site_key string, pos int, url string", "site_key string, url string, identity string"


def plain(links, sitemap, ends, depth, budget, ms=None, limit=None):
    """(claims, progress after each, time): the queue of one site, seeded with p0."""
    seen, pending, queue, out, progress, clock = set(), deque(sitemap), deque(), [], [], 0
    met = set()

    def enqueue(url, d, source):
        final = ends.get(url, url)
        if url in seen or final in seen:
            return False
        seen.update((url, final))
        met.add(final)
        queue.append((url, d, source))
        return True

    enqueue("p0", 0, "seed")
    while len(out) < budget and not (limit is not None and clock > limit):
        while not queue and pending:
            enqueue(pending.popleft(), None, "sitemap")
        if not queue:
            break
        url, d, source = queue.popleft()
        clock += ms[url] if ms else 0
        out.append((url, d, source, clock))
        below = 1 if d is None else d + 1
        if below <= depth:
            for v in links.get(ends.get(url, url), ()):
                enqueue(v, below, "link")
        progress.append((len(out), len(met) + len(pending), len(queue)))
    return out, progress, clock


def sites(seed, n=200, pages=40, links=60):
    rng = random.Random(seed)
    out = {}
    for s in range(n):
        ends = {f"p{k}": f"p{rng.randrange(1, pages)}" for k in rng.sample(range(1, pages), rng.randrange(0, 6))}
        ends = {a: b for a, b in ends.items() if b not in ends}
        graph = {}
        for _ in range(rng.randrange(links)):
            a, b = f"p{rng.randrange(pages)}", f"p{rng.randrange(pages)}"
            if a != b and a not in ends and b not in graph.get(a, ()):
                graph.setdefault(a, []).append(b)
        sitemap = list(dict.fromkeys(f"p{rng.randrange(pages)}" for _ in range(rng.randrange(25))))
        out[f"s{s}"] = (graph, sitemap, ends)
    return out


def frames(spark, given):
    links = [(s, a, b, k) for s, (graph, _, _) in given.items() for a, bs in graph.items() for k, b in enumerate(bs)]
    listed = [(s, k, u) for s, (_, sitemap, _) in given.items() for k, u in enumerate(sitemap)]
    ends = [(s, a, b) for s, (_, _, e) in given.items() for a, b in e.items()]
    seeds = spark.createDataFrame([(s, "p0") for s in given], "site_key string, url string")
    return seeds, spark.createDataFrame(links, LINKS), spark.createDataFrame(listed, SITEMAP), spark.createDataFrame(ends, ENDS)


def by_site(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.site_key, r.place)):
        out.setdefault(r.site_key, []).append((r.url, r.depth, r.source))
    return out


@pytest.mark.parametrize("depth, budget", [(4, 25), (2, 7), (1, 60), (0, 5)])
def test_200_sites_are_crawled_as_by_their_queues(spark, depth, budget):
    given = sites(depth)
    seeds, links, listed, ends = frames(spark, given)
    rounds = []
    got = by_site(frontier.crawl_frontier(seeds, links, depth, budget, listed, ends, on_progress=rounds.append).collect())
    assert got == {s: [x[:3] for x in plain(*site, depth, budget)[0]] for s, site in given.items()}
    assert len(rounds) <= 2 * depth + 4 and [r["round"] for r in rounds] == list(range(1, len(rounds) + 1))
    last = rounds[-1]
    assert (last["sites"], last["claimed"], last["open"]) == (len(given), sum(map(len, got.values())), 0)


def test_budgets_beyond_a_queue_give_the_same_claims(spark):
    given = sites(9, n=6, pages=15, links=30)
    seeds, links, listed, ends = frames(spark, given)
    got = by_site(frontier.crawl_frontier(seeds, links, 3, frontier.QUEUE_PAGES + 1, listed, ends).collect())
    assert got == {s: [x[:3] for x in plain(*site, 3, 10**9)[0]] for s, site in given.items()}


def test_a_crawl_stops_when_its_time_is_over(spark):
    given = sites(5, n=40)
    seeds, links, listed, ends = frames(spark, given)
    ms = {(s, f"p{k}"): float((int(s[1:]) * 7 + k * 13) % 50) for s in given for k in range(40)}
    durations = spark.createDataFrame([(s, u, t) for (s, u), t in ms.items()], "site_key string, url string, ms double")
    rows = frontier.crawl_frontier(seeds, links, 4, 25, listed, ends, durations, 200.0).collect()
    times = {}
    for r in sorted(rows, key=lambda r: (r.site_key, r.place)):
        times.setdefault(r.site_key, []).append((r.url, r.elapsed_ms))
    stopped = 0
    for s, site in given.items():
        claims, _, clock = plain(*site, 4, 25, {u: t for (x, u), t in ms.items() if x == s}, 200.0)
        assert times[s] == [(u, t) for u, _, _, t in claims]
        stopped += clock > 200
    assert stopped > 5


def test_progress_counts_what_the_queue_counts(spark):
    given = sites(3, n=60)
    seeds, links, listed, ends = frames(spark, given)
    claimed = frontier.crawl_frontier(seeds, links, 3, 12, listed, ends)
    rows = frontier.crawl_progress(claimed, links, 3, 12, listed, ends).collect()
    got = {s: sorted((r.crawled, r.discovered, r.queued) for r in rows if r.site_key == s) for s in given}
    assert got == {s: plain(*site, 3, 12)[1] for s, site in given.items()} and {r.target for r in rows} == {12}


def test_a_page_of_very_many_links(spark):
    links = spark.range(50_000).selectExpr("'s' AS site_key", "'p0' AS src", "concat('q', id) AS dst", "cast(id AS int) AS pos")
    seeds = spark.createDataFrame([("s", "p0")], "site_key string, url string")
    claimed = frontier.crawl_frontier(seeds, links, 4, 10)
    assert [r.url for r in claimed.orderBy("place").collect()] == ["p0", *(f"q{k}" for k in range(9))]
    assert frontier.crawl_progress(claimed, links, 4, 10).orderBy("crawled").first()[1:] == (1, 50_001, 50_000, 10)


@pytest.mark.parametrize("seed", [11, 12])
def test_crawls_without_limits_are_those_of_the_queues(spark, seed):
    given = sites(seed, n=60, pages=60, links=90)
    seeds, links, listed, ends = frames(spark, given)
    got = by_site(frontier.crawl_frontier(seeds, links, None, None, listed, ends).collect())
    assert got == {s: [x[:3] for x in plain(*site, 10**9, 10**9)[0]] for s, site in given.items()}
    assert max(d or 0 for x in got.values() for _, d, _ in x) > 4 and max(map(len, got.values())) > 25


def test_crawls_without_limits_but_of_time(spark):
    given = sites(13, n=30)
    seeds, links, listed, ends = frames(spark, given)
    ms = {(s, f"p{k}"): float((int(s[1:]) * 7 + k * 13) % 50) for s in given for k in range(40)}
    durations = spark.createDataFrame([(s, u, t) for (s, u), t in ms.items()], "site_key string, url string, ms double")
    times = {}
    for r in sorted(frontier.crawl_frontier(seeds, links, None, None, listed, ends, durations, 200.0).collect(), key=lambda r: (r.site_key, r.place)):
        times.setdefault(r.site_key, []).append((r.url, r.elapsed_ms))
    assert times == {s: [(u, t) for u, _, _, t in plain(*site, 10**9, 10**9, {u: t for (x, u), t in ms.items() if x == s}, 200.0)[0]] for s, site in given.items()}
