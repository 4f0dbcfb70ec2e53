"""Robots, addresses, field metrics, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.constants import AI_CRAWLERS, AUDIT_QUOTA, AUDIT_WINDOW_S, VITALS
from webgauge.functions import net
from webgauge.operators import admission, robots, vitals
from webgauge.plans import views
from webgauge.queries.registry import ORACLE, dealt, long, query, sql_values, table
from webgauge.runtime import scratch_path
from webgauge.sources import probes
from webgauge.streaming.admission import stream_admissions

# -- robots.txt made of nations, paths made of parts ------------------------------------------------------------------------

ROBOTS = [
    "# everyone\nUser-agent: *\nDisallow: /p1\nAllow: /p11\nCrawl-delay: 5\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow:\nSitemap: https://example.org/s.xml\n",
    "Disallow: /lost\nUser-agent: googlebot-image\nDisallow: /*5$\nAllow: /p15\nUser-agent: *\nDisallow: /p2*7\n",
    "user-agent: oai-searchbot\ndisallow: /p\nallow: /p*9\nuser-agent: *\nallow: /\n",
    "nothing here\n",
]


def robots_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, ROBOTS))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("origin"), F.element_at(texts, F.expr("n_nationkey % 5 + 1").cast("int")).alias("text"))


def paths_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("origin"))
    p = table(spark, sf_dir, "part").select(F.expr("cast(p_partkey % 25 as int)").alias("k"), F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("path"))
    return p.join(F.broadcast(n), "k").select("origin", "path").distinct()


RULES = rf"""t AS (SELECT n_name AS origin, {[r for r in ROBOTS]!r}[n_nationkey % 5 + 1] AS text FROM nation),
    ln AS (SELECT origin, unnest(string_split(replace(text, '\n', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '\n', chr(10)), chr(10)), 1) - 1 AS pos FROM t),
    fl AS (SELECT origin, pos, lower(trim(split_part(trim(regexp_replace(line, '#.*$', '')), ':', 1))) AS field, trim(regexp_replace(trim(regexp_replace(line, '#.*$', '')), '^[^:]*:', '')) AS value FROM ln WHERE contains(regexp_replace(line, '#.*$', ''), ':')),
    kp AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY origin ORDER BY pos) <> 'user-agent', TRUE) THEN 1 ELSE 0 END AS begins FROM fl WHERE field IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
    ru AS (SELECT origin, CAST(sum(begins) OVER (PARTITION BY origin ORDER BY pos) AS BIGINT) AS grp, CASE WHEN field = 'user-agent' THEN 'agent' ELSE field END AS kind, CASE WHEN field = 'user-agent' THEN lower(value) ELSE value END AS value, pos FROM kp)"""
#: The group of each (origin, agent), and the rule that decides for each (origin, group, path).
VERDICT = r"""ag AS (SELECT q.origin, q.agent, ru.grp, ru.value AS name FROM (SELECT DISTINCT origin, agent FROM rq) q JOIN ru ON ru.origin = q.origin AND ru.kind = 'agent' AND ru.grp > 0
        WHERE ru.value = '*' OR (ru.value <> '' AND (starts_with(lower(q.agent), ru.value) OR starts_with(ru.value, lower(q.agent))))
        QUALIFY row_number() OVER (PARTITION BY q.origin, q.agent ORDER BY ru.value = '*', length(ru.value) DESC, ru.grp) = 1),
    pt AS (SELECT *, '^' || replace(regexp_replace(CASE WHEN ends_with(value, '$') THEN left(value, length(value) - 1) ELSE value END, '([\\.+?^$(){}\[\]|])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END AS pattern
        FROM ru WHERE kind IN ('allow', 'disallow') AND value <> '' AND grp > 0),
    dp AS (SELECT g.origin, g.grp, pa.path, pt.kind, pt.value AS rule FROM (SELECT DISTINCT origin, grp FROM ag) g JOIN pt ON pt.origin = g.origin AND pt.grp = g.grp JOIN pa ON pa.origin = g.origin
        WHERE regexp_matches(pa.path, pt.pattern) QUALIFY row_number() OVER (PARTITION BY g.origin, g.grp, pa.path ORDER BY length(replace(pt.value, '*', '')) DESC, pt.kind = 'disallow', pt.pos) = 1),
    hit AS (SELECT rq.*, dp.kind, dp.rule, ag.name FROM rq LEFT JOIN ag ON ag.origin = rq.origin AND ag.agent = rq.agent LEFT JOIN dp ON dp.origin = rq.origin AND dp.grp = ag.grp AND dp.path = rq.path)"""
PATHS = "pa AS (SELECT DISTINCT n_name AS origin, '/p' || p_partkey AS path FROM part JOIN nation ON n_nationkey = p_partkey % 25)"


@query(f"WITH {RULES} SELECT origin, grp, kind, value, pos FROM ru WHERE grp > 0")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_rules(robots_of_nations(spark, sf_dir)).withColumn("pos", long("pos"))


@query(
    f"""WITH {RULES}, {PATHS}, bots AS (SELECT * FROM {sql_values([(i, *r) for i, r in enumerate(AI_CRAWLERS)])} AS b(bot_pos, agent, vendor, surface, role)), rq AS (SELECT * FROM pa CROSS JOIN bots), {VERDICT}
    SELECT origin, path, agent, role, coalesce(kind = 'allow', TRUE) AS allowed, rule, coalesce(name <> '*', FALSE) AS specific FROM hit"""
)
def robots_crawler_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = robots.crawler_access(robots.robots_rules(robots_of_nations(spark, sf_dir)), paths_of_parts(spark, sf_dir))
    return a.select("origin", "path", "agent", "role", "allowed", "rule", "specific")


@query(
    f"""WITH {RULES}, {PATHS}, bots AS (SELECT * FROM {sql_values([(i, *r) for i, r in enumerate(AI_CRAWLERS)])} AS b(bot_pos, agent, vendor, surface, role)), rq AS (SELECT * FROM pa CROSS JOIN bots), {VERDICT}
    SELECT origin, path, role, coalesce(string_agg(agent, ' ' ORDER BY agent) FILTER (coalesce(kind = 'allow', TRUE)), '') AS allowed, coalesce(string_agg(agent, ' ' ORDER BY agent) FILTER (kind = 'disallow'), '') AS blocked
    FROM hit GROUP BY 1, 2, 3"""
)
def robots_crawler_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = views.crawler_grid(robots_crawler_access(spark, sf_dir))
    return grid.select("origin", "path", "role", F.array_join("allowed", " ").alias("allowed"), F.array_join("blocked", " ").alias("blocked"))


@query(
    f"""WITH {RULES}, {PATHS}, rq AS (SELECT origin, path, agent FROM pa CROSS JOIN (VALUES ('googlebot'), ('*')) AS a(agent)), {VERDICT}
    SELECT pa.origin, pa.path, arg_min(hit.rule, hit.agent <> 'googlebot') AS blocking_rule FROM pa LEFT JOIN hit ON hit.origin = pa.origin AND hit.path = pa.path AND hit.kind = 'disallow' GROUP BY 1, 2"""
)
def robots_search_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.search_blocked(robots.robots_rules(robots_of_nations(spark, sf_dir)), paths_of_parts(spark, sf_dir))

# -- addresses --------------------------------------------------------------------------------------------------------------

OCTETS = ["event_id * 7 % 256", "(event_id * 13 + user_id) % 256", "event_id % 120", "event_id % 300"]
CUTS = [
    ("a = 0", 0), ("a = 10", 1), ("a = 127", 2), ("a = 169 AND b = 254", 3), ("a = 172 AND b BETWEEN 16 AND 31", 4), ("a = 192 AND b = 168", 5), ("a = 100 AND b BETWEEN 64 AND 127", 6),
    ("a = 192 AND b = 0 AND c = 0", 7), ("a = 198 AND b IN (18, 19)", 8), ("a = 192 AND b = 0 AND c = 2", 9), ("a = 198 AND b = 51 AND c = 100", 10), ("a = 203 AND b = 0 AND c = 113", 11), ("a BETWEEN 224 AND 239", 12), ("a >= 240", 13),
]


@query(
    f"""WITH o AS (SELECT event_id, {", ".join(f"{e} AS {n}" for e, n in zip(OCTETS, "abcd"))} FROM events)
    SELECT event_id, a || '.' || b || '.' || c || '.' || d AS ip, CASE WHEN d > 255 THEN 'not a valid IPv4 address' {" ".join(f"WHEN {test} THEN '{net.IPV4_REFUSED[i][2]}'" for test, i in CUTS)} END AS reason FROM o"""
)
def address_guard_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", *[F.expr(o).cast("string") for o in OCTETS]).alias("ip"))
    return e.withColumn("reason", net.ipv4_reason(F.col("ip")))


@query(
    """WITH a AS (SELECT event_id, event_id % 6 AS k, user_id % 200 AS n FROM events)
    SELECT event_id, ['::ffff:10.0.0.', 'fe80::', '2002:7f00:1::', '2001:0:', '2606:4700::', '64:ff9b::8.8.8.'][k + 1] || n AS ip, CASE k WHEN 0 THEN 'an IPv4-mapped address for 10.0.0.' || n || ', which is a private 10.0.0.0/8 address'
    WHEN 1 THEN 'a link-local address' WHEN 2 THEN 'a 6to4 address for 127.0.0.1, which is a loopback address' WHEN 3 THEN 'not a valid IPv6 address' END AS reason FROM a"""
)
def address_guard_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of six forms; tests hold the function against cases of every range."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.element_at(F.array(*map(F.lit, ["::ffff:10.0.0.", "fe80::", "2002:7f00:1::", "2001:0:", "2606:4700::", "64:ff9b::8.8.8."])), F.expr("cast(event_id % 6 + 1 as int)")), F.expr("user_id % 200").cast("string")).alias("ip"))
    return e.withColumn("reason", net.address_reason(F.col("ip")))


ASKED = ["e.event_id * 7 % 256", "(e.event_id * 13 + e.user_id) % 256", "e.event_id % 120", "e.event_id % 256"]
PUBLIC = "93.184.216.34"
#: Fixed value: captured answers that a task reads at most.
ANSWERS_A_PART = 100_000
ADDRESSES = ["ftp://h{n}.example/", "https://h{n}.example:22/x", "https://h{n}.example/", "http://H{n}.example:8080/?q", "https://10.0.0.{o}/", "https://user@[2606:4700::{o}]:443/"]


@query(
    f"""WITH o AS (SELECT event_id, {", ".join(f"{e.replace('e.', '')} AS {n}" for e, n in zip(ASKED, "abcd"))}, event_id % 6 AS k FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT *, CASE {" ".join(f"WHEN {test} THEN '{net.IPV4_REFUSED[i][2]}'" for test, i in CUTS)} END AS reason FROM o)
    SELECT event_id, CASE WHEN k = 0 THEN 'only http and https are fetched' WHEN k = 1 THEN 'a reserved port' WHEN k = 4 THEN 'a private 10.0.0.0/8 address' WHEN k = 5 THEN NULL WHEN event_id % 11 = 0 THEN 'the host has no address' ELSE reason END AS refusal FROM r"""
)
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses judged by captured name answers: two addresses of a host by way of another name, one of them public."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    n = F.col("event_id").cast("string")
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    label = lambda c: F.concat(F.lpad(F.hex(F.length(c).cast("long")), 2, "0"), F.hex(c))
    host = F.concat(F.lit("h"), n)
    asked = F.concat(label(host), F.lit("07" + "example".encode().hex() + "00"))
    octets = F.concat(*[F.lpad(F.hex(F.expr(x)), 2, "0") for x in ASKED])
    public = "".join(f"{int(x):02x}" for x in PUBLIC.split("."))
    none = F.expr("event_id % 11 = 0")
    # the name at byte 12 stands for "www" before it, whose two addresses follow
    to = F.concat(F.lit("c00c000500010000003c0006"), F.lit("03777777c00c"))
    at = two((F.lit(0xC000) + 12 + F.length(asked) / 2 + 4 + 12).cast("long"))
    records = F.concat(to, at, F.lit(f"000100010000003c0004{public}"), at, F.lit("000100010000003c0004"), octets)
    message = F.concat(F.lit("00018180"), F.lit("0001"), F.when(none, "0000").otherwise("0003"), F.lit("00000000"), asked, F.lit("00010001"), F.when(none, "").otherwise(records))
    # a task holds the different addresses of what it reads, so that its memory follows its rows
    answers = dealt(e.select("event_id", "user_id"), ANSWERS_A_PART).alias("e").select(F.unhex(message).alias("message"))
    forms = F.get(F.array(*map(F.lit, ADDRESSES)), (F.col("event_id") % 6).cast("int"))
    url = F.replace(F.replace(forms, F.lit("{n}"), n), F.lit("{o}"), F.expr("event_id % 200 + 1").cast("string"))
    return probes.guarded(e.select("event_id", url.alias("url")), probes.host_addresses(answers)).select("event_id", "refusal")


# -- field metrics: values of events ------------------------------------------------------------------------------------------

METRICS = list(VITALS)
SCALE = {"lcp": 500.0, "inp": 50.0, "cls": 0.02, "fcp": 300.0, "ttfb": 200.0}
V = f"""v AS (SELECT user_id AS target, event_id, m.metric, value * m.scale AS p75, m.* EXCLUDE (metric, scale) FROM events JOIN {sql_values([(i, k, SCALE[k], g, p, u, str(c).lower() == "true") for i, (k, (g, p, u, _, c)) in enumerate(VITALS.items())])} AS m(i, metric, scale, good, poor, unit, core) ON m.i = event_id % 5),
    r AS (SELECT *, CASE WHEN p75 IS NULL THEN NULL WHEN p75 <= good THEN 'good' WHEN p75 <= poor THEN 'needs-improvement' ELSE 'poor' END AS rating FROM v)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    metric = F.element_at(F.array(*map(F.lit, METRICS)), F.expr("cast(event_id % 5 + 1 as int)"))
    scale = F.element_at(F.array(*[F.lit(SCALE[m]) for m in METRICS]), F.expr("cast(event_id % 5 + 1 as int)"))
    return e.select(F.col("user_id").alias("target"), "event_id", metric.alias("metric"), (F.col("value") * scale).alias("p75"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("density"))


@query(f"WITH {V} SELECT event_id, metric, rating, core FROM r")
def vitals_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vitals.rated(_metrics(spark, sf_dir)).select("event_id", "metric", "rating", "core")


@query(f"WITH {V} SELECT target, bool_and(NOT core OR coalesce(rating, 'good') = 'good') AS passes FROM r GROUP BY target")
def vitals_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vitals.passes(vitals.rated(_metrics(spark, sf_dir)))


@query(
    """WITH p AS (SELECT c_custkey AS url, c_nationkey AS origin FROM customer),
    own AS (SELECT c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN 'no-data' WHEN c_custkey % 7 = 0 THEN 'quota' END AS reason, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 'u' || c_custkey END AS data FROM customer WHERE c_custkey % 5 <> 0),
    site AS (SELECT n_nationkey AS origin, 'o' || n_nationkey AS data FROM nation WHERE n_nationkey % 4 <> 0),
    j AS (SELECT p.*, own.data AS own, coalesce(own.reason, CASE WHEN own.data IS NULL THEN 'no-data' END) AS why, site.data AS site FROM p LEFT JOIN own USING (url) LEFT JOIN site USING (origin))
    SELECT url, origin, CASE WHEN coalesce(why = 'no-data', FALSE) AND site IS NOT NULL THEN site ELSE own END AS data, coalesce(why = 'no-data', FALSE) AND site IS NOT NULL AS fell_back_from_url, CASE WHEN coalesce(why = 'no-data', FALSE) AND site IS NOT NULL THEN NULL ELSE why END AS reason FROM j"""
)
def vitals_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    pages = c.select(F.col("c_custkey").alias("url"), F.col("c_nationkey").alias("origin"))
    k = F.col("c_custkey")
    own = c.where(k % 5 != 0).select(k.alias("target"), F.lit("url").alias("scope"), F.when(k % 3 == 0, "no-data").when(k % 7 == 0, "quota").alias("reason"), F.when((k % 3 != 0) & (k % 7 != 0), F.concat(F.lit("u"), k.cast("string"))).alias("data"))
    site = n.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("long").alias("target"), F.lit("origin").alias("scope"), F.lit(None).cast("string").alias("reason"), F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("data"))
    return vitals.with_fallback(pages, own.unionByName(site))


ANSWERS = [
    (404, '{"error":{"code":404,"message":"none"}}'), (403, '{"error":{"code":403,"message":"key"}}'), (429, "{}"), (500, "{}"), (200, "{broken"), (200, '{"record":{"key":{"url":"u"}}}'),
    (200, '{"record":{"key":{"formFactor":"PHONE"},"metrics":{"largest_contentful_paint":{"histogram":[{"start":0,"end":2500,"density":0.5},{"density":0.3},{"density":0.2}],"percentiles":{"p75":@}},'
          '"cumulative_layout_shift":{"percentiles":{"p75":"0.05"}},"other_metric":{"percentiles":{"p75":1}}},"collectionPeriod":{"firstDate":{"year":2024,"month":3,"day":5},"lastDate":{"year":2024,"month":4,"day":1}}}}'),
    (None, None), (200, '{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":"fast"}},"interaction_to_next_paint":{"histogram":[],"percentiles":{"p75":@}}}}}'), (200, '{"record":{"metrics":{"other":{"percentiles":{"p75":1}}}}}'),
]


@query(
    """WITH c AS (SELECT c_custkey AS target, c_custkey % 10 AS k, CAST(c_custkey * 7 % 6000 AS DOUBLE) AS v FROM customer)
    SELECT target, ['no-data', 'forbidden', 'quota', 'error', 'bad-response', 'no-data', NULL, 'network', NULL, 'no-data'][k + 1] AS reason, CASE WHEN k = 6 THEN v END AS lcp, CASE WHEN k = 8 THEN v END AS inp, CASE WHEN k = 6 THEN 0.05::DOUBLE END AS cls,
    CASE WHEN k = 6 THEN '0.5,0.3,0.2' END AS shares, CASE WHEN k = 6 THEN 'PHONE' END AS form_factor, CASE WHEN k = 6 THEN '2024-03-05 2024-04-01' END AS period, CAST(CASE k WHEN 6 THEN 2 WHEN 8 THEN 1 END AS BIGINT) AS metrics FROM c"""
)
def field_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the field-data service in ten forms, broken and refused ones among them."""
    k = (F.col("c_custkey") % 10).cast("int")
    body = F.replace(F.get(F.array(*[F.lit(b) for _, b in ANSWERS]), k), F.lit("@"), (F.col("c_custkey") * 7 % 6000).cast("string"))
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.lit("url").alias("scope"), F.get(F.array(*[F.lit(s) for s, _ in ANSWERS]), k).alias("status"), body.alias("body"))
    r = vitals.field_data(answers)
    value = lambda m: F.try_element_at("data", F.lit(m))
    shares = F.array_join(F.transform(F.try_element_at("density", F.lit("lcp")), lambda x: x.cast("string")), ",")
    return r.select("target", "reason", value("lcp").alias("lcp"), value("inp").alias("inp"), value("cls").alias("cls"), shares.alias("shares"), "form_factor", F.concat_ws(" ", "period.first", "period.last").alias("period"), long(F.size("data")).alias("metrics")).withColumn("period", F.nullif("period", F.lit("")))


# -- admission: events of users ------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")


def _admissions_sql(quota: int, window_s: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    s(user_id, event_id, n, start, used, admitted) AS (
        SELECT user_id, event_id, n, ts, 1, TRUE FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= s.start + INTERVAL {window_s} SECOND THEN e.ts ELSE s.start END,
            CASE WHEN e.ts >= s.start + INTERVAL {window_s} SECOND THEN 1 WHEN s.used < {quota} THEN s.used + 1 ELSE s.used END, e.ts >= s.start + INTERVAL {window_s} SECOND OR s.used < {quota}
        FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
    )
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, admitted FROM s"""


@query(_admissions_sql(AUDIT_QUOTA, AUDIT_WINDOW_S))
def admission_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admissions(_requests(spark, sf_dir)).select("key", "event_id", "admitted")


@query(_admissions_sql(2, 86400 * 3))
def admission_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota that events of a user do exhaust."""
    return admission.admissions(_requests(spark, sf_dir), 2, 86400 * 3).select("key", "event_id", "admitted")


@query(_admissions_sql(2, 86400 * 3))
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the events file, its keyed state carried through the batches."""
    source = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "admissions")
    source.select(F.col("user_id").alias("key"), "event_id", "ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key long, event_id long, ts timestamp").parquet(f"{folder}/in")
    out = stream_admissions(stream, 2, 86400 * 3)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("key", "event_id", "admitted")


@query("SELECT event_id, user_id AS key, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END DESC, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM events")
def admission_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _requests(spark, sf_dir).withColumn("delta", F.expr("if(event_id % 2 = 0, 1, -1)"))
    return admission.in_flight(e).select("event_id", "key", "active")


@query("SELECT o_custkey AS owner, count(*) AS running FROM orders WHERE o_orderstatus = 'O' GROUP BY ROLLUP (o_custkey)")
def jobs_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return admission.active_jobs(o)


@query(
    """WITH a AS (SELECT count(*) FILTER (event_id % 3 <> 0) AS admitted, count(*) FILTER (event_id % 3 = 0) AS rejected FROM events),
    b AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS errors FROM orders)
    SELECT * FROM a CROSS JOIN b"""
)
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.expr("event_id % 3 <> 0").alias("admitted"))
    s = F.col("o_orderstatus")
    jobs = table(spark, sf_dir, "orders").select(F.when(s == "O", "running").when(s == "F", "done").otherwise("error").alias("status"))
    return views.health(requests, jobs)
