"""A rule catalog as data: checks of findings, each a column expression that gives ok, warn, fail, info or null."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.constants import CATEGORIES

FINDING = "array<struct<cat_pos:int,category:string,check_pos:int,check:string,importance:string,find_pos:int,status:string,text:string,todo:string>>"
FIELDS = tuple(f.split(":")[0] for f in FINDING.removeprefix("array<struct<").split(","))


@dataclasses.dataclass
class Finding:
    status: Column  # ok, warn, fail, info, or null where the finding doesn't apply
    text: Column | str
    todo: Column | str | None = None  # given with warn and fail


@dataclasses.dataclass
class Check:
    category: str
    name: str
    importance: str
    findings: list[Finding]


def holds(condition: Column, text: str, todo: str | Column | None = None, otherwise: str | Column = "warn", where: Column | None = None) -> Finding:
    """ok where the condition holds, else ``otherwise``; only where ``where`` holds.  An unknown condition doesn't hold."""
    bad = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    status = F.when(F.coalesce(condition, F.lit(False)), F.lit("ok")).otherwise(bad)
    return Finding(status if where is None else F.when(where, status), text, todo)


def cases(steps: list[tuple[Column, str]], last: str | None, text: str | Column, todo: str | Column | None = None, where: Column | None = None) -> Finding:
    """The status of the first step that holds, else ``last`` (null: no finding)."""
    out = F.when(steps[0][0], steps[0][1])
    for condition, status in steps[1:]:
        out = out.when(condition, status)
    out = out.otherwise(F.lit(last).cast("string"))
    return Finding(out if where is None else F.when(where, out), text, todo)


def info(text: str | Column, where: Column | None = None) -> Finding:
    return Finding(F.lit("info") if where is None else F.when(where, F.lit("info")), text)


def _lit(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def findings_column(mode: str, checks: list[Check], fields: tuple[str, ...] | None = None) -> Column:
    """All findings of a row in catalog order, as one array expression; those that don't apply have no status.  ``fields``:
    what is wanted of each, if not all."""
    order = {key: i for i, (key, _, _) in enumerate(CATEGORIES[mode])}
    position = dict.fromkeys(order, 0)
    out = []
    for c in checks:
        for k, f in enumerate(c.findings):
            bad = f.status.isin("warn", "fail")
            columns = [
                F.lit(order[c.category]).alias("cat_pos"), F.lit(c.category).alias("category"), F.lit(position[c.category]).alias("check_pos"), F.lit(c.name).alias("check"),
                F.lit(c.importance).alias("importance"), F.lit(k).alias("find_pos"), f.status.alias("status"), _lit(f.text).alias("text"), F.when(bad, _lit(f.todo)).alias("todo"),
            ]
            out.append(F.struct(*[c for name, c in zip(FIELDS, columns) if fields is None or name in fields]))
        position[c.category] += 1
    return F.array(*out)


def explode_findings(pages: DataFrame, findings: Column, id_column: str = "page_id") -> DataFrame:
    """A row for each finding of each page that applies.

    The list is a column of its own, and no lambda goes over it, so that it is compiled.  Before an ``explode``, but not before
    an ``explode_outer``, Spark would put a filter on its size that works it out a second time."""
    listed = pages.select(F.col(id_column).alias("page_id"), findings.alias("f"))
    return listed.select("page_id", F.explode_outer("f").alias("f")).where("f.status IS NOT NULL").select("page_id", "f.*")


#: What a capture may carry beside url and html, and what is assumed where it doesn't.
CAPTURE = {
    "status": ("int", 200),
    "status_message": ("string", None),
    "http_version": ("string", None),
    "headers": ("map<string,string>", None),
    "transfer_bytes": ("bigint", None),
    "ttfb_ms": ("double", None),
    "total_ms": ("double", None),
    "redirect_chain": ("array<struct<url:string,status:int,location:string>>", None),
    "requested_url": ("string", None),
    "favicon_ok": ("boolean", True),
    "robots_found": ("boolean", None),
    "robots_text": ("string", None),
    "has_sitemap_line": ("boolean", None),
    "blocks_all": ("boolean", None),
    "sitemap_found": ("boolean", None),
    "variant_tested": ("boolean", None),
    "variant_reachable": ("boolean", None),
    "variant_canonical": ("boolean", None),
    "https_upgrade": ("boolean", None),
    "protocol": ("string", None),
    "tls_version": ("string", None),
    "cert_valid_to": ("timestamp", None),
    "llms_found": ("boolean", None),
    "blocking_rule": ("string", None),
    "blocked_retrieval": ("int", 0),
    "blocked_user_triggered": ("int", 0),
    "vitals": ("map<string,double>", None),
    "vitals_reason": ("string", None),
    "as_of": ("timestamp", None),
}


def complete(captures: DataFrame) -> DataFrame:
    """Captures with every column of ``CAPTURE``; absent ones get the assumed value."""
    have = set(captures.columns)
    for name, (kind, value) in CAPTURE.items():
        if name not in have:
            default = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")) if name == "headers" else F.array().cast(kind) if kind.startswith("array") else F.lit(value).cast(kind)
            captures = captures.withColumn(name, default)
    return captures

