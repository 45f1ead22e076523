"""URL allow and block rules by a sorted sweep over reversed hosts.

The canonical key of a host is its labels in reverse, each with '/' after it (which no host holds): a rule's host and all its
subdomains are then one interval of keys, those that begin with the rule's key, and intervals nest or are apart. Rules and
pages are sorted together; the sweep keeps a stack of the rules whose interval holds the current key. On the stack the rule
wins whose path begins the page's path and whose host and path together are longest (then the longer host, then the order of
its text); the default verdict holds where none does.

Ranges of (key, path, salt) deal the pages, so a host or one URL with a large share of all rows spreads over several tasks.
Range bounds come from a bounded sample of keys and steer only the dealing; each rule goes to every range that its interval
meets, so no range needs what another one saw, and rules may be a table of any size.

Null URLs and URLs without '://' have an empty host and path and get the default. A rule with an empty or null host fits no
page. The first of rules with equal host and path by (verdict) ascending counts. Repeated page ids are judged row by row, URLs of
any length whole. An empty table of pages gives an empty one, one of rules the default. Other columns of pages are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import ship
from .linededup import _LOWER, _UPPER

#: Keys that the driver sees to place range bounds, for each range and at least.
SAMPLE, LEAST_SAMPLE = 20, 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/")))


class _Stack:
    """Rules whose interval holds the current key, the widest first: (key, {path: (rule, verdict)}, path lengths)."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def at(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.at(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, paths, lengths = self.open[-1]
        if path not in paths:
            paths[path] = (rule, verdict)
            if len(path) not in lengths:
                lengths.append(len(path))
                lengths.sort(reverse=True)

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        self.at(key)
        found, most = None, (-1, -1)
        for host, paths, lengths in self.open:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if (size := (len(host) + n, len(host))) > most:
                        found, most = hit, size
                    break
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page. rules: host, path, verdict."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "__url").alias("salt"))
    pages = pages.select(host_key(F.col("host")).alias("key"), "path", "salt", "page_id", "host")
    rules = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = pages.count()
    wanted = max(LEAST_SAMPLE, SAMPLE * parts)
    share = min(1.0, wanted / max(total, 1))
    seen = sorted((r["key"], r["path"], r["salt"]) for r in pages.where(F.abs(F.xxhash64("salt")) / F.lit(2.0**63) <= share).select("key", "path", "salt").limit(2 * wanted).collect())
    bounds = [seen[len(seen) * k // parts] for k in range(1, parts)] if seen else []
    schema = "part int, key string, path string, salt long, is_page boolean, page_id {0}, host string, rule string, verdict string".format(pages.schema["page_id"].dataType.simpleString())

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            none = pa.nulls(len(keys), pa.string())
            part = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns[:3], pa.array([True] * len(keys)), batch.column(3), batch.column(4), none, none], names=["part", "key", "path", "salt", "is_page", "page_id", "host", "rule", "verdict"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        for batch in batches:
            for row in batch.to_pylist():
                key = row["key"]
                first = bisect_left(bounds, (key,))
                last = bisect_left(bounds, (key + "\U0010ffff",))
                n = last - first + 1
                same = lambda v, n=n: pa.array([v] * n, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(range(first, last + 1), pa.int32()), same(key), same(row["path"]), pa.nulls(n, pa.int64()), pa.array([False] * n), pa.nulls(n, page_kind), pa.nulls(n, pa.string()), same(row["rule"]), same(row["verdict"])], names=["part", "key", "path", "salt", "is_page", "page_id", "host", "rule", "verdict"])

    from pyspark.sql.pandas.types import to_arrow_type

    page_kind = to_arrow_type(pages.schema["page_id"].dataType)
    rows = pages.mapInArrow(place_pages, schema).unionByName(rules.mapInArrow(place_rules, schema))
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "is_page", "path", "salt")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, here = _Stack(), None
        for batch in batches:
            page = [i for i, x in enumerate(batch.column(4).to_pylist()) if x]
            found: list[tuple[str | None, str]] = []
            for part, key, path, is_page, rule, verdict in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 7, 8)), strict=True):
                if part != here:
                    stack, here = _Stack(), part
                if is_page:
                    found.append(stack.best(key, path) or (None, default))
                else:
                    stack.push(key, path, rule, verdict)
            take = pa.array(page, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(5).take(take), batch.column(6).take(take), batch.column(2).take(take), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(sweep, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
