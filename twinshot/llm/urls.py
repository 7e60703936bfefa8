"""URL filters: a broadcast trie over reversed host labels, then path segments.

A rule is a host with a path after it, ``example.com/en/``. Its host labels, last first, lead from the
root of the trie to the host's node, its path segments from there on. A url walks the labels of its
own host; every node on the way that carries paths is tried with the url's path, and the longest rule
that fits decides, whatever it says. The trie is built from blocks of at most ``BLOCK_RULES`` rules:
what is sent to the tasks has a fixed size, and longer lists take one pass over the url's columns for
each block, the longest match of all blocks being kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_RULES = 200_000
ALLOW, BLOCK = "allow", "block"

#: Words that name unwanted sites when they are a label of the host, or part of one
#: between hyphens. They judge urls that no rule fits.
UNWANTED_LABELS = ["adult", "ads", "bet", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "spam", "xxx"]


class Trie:
    """Rules by reversed host labels and path segments; ``find`` gives the longest that fits."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        """``rules``: (verdict, host/path). Of equal rules with two verdicts the blocking one counts."""
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            # Empty strings are no labels or segments that lead on, so they can hold the next level.
            node = node.setdefault("", {})
            segments = (slash + path).split("/")
            for segment in segments[:-1]:
                node = node.setdefault(segment, {})
            # What follows the last slash is a prefix of the url's next segment.
            ends = node.setdefault("/", {})
            if ends.get(segments[-1], (ALLOW, ""))[0] != BLOCK:
                ends[segments[-1]] = (verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule for the host and its parents that the path begins with."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            for found in self._paths(node.get(""), segments):
                if best is None or (len(found[1]), found[0] == BLOCK) > (len(best[1]), best[0] == BLOCK):
                    best = found
        return best

    @staticmethod
    def _paths(node: dict | None, segments: list[str]) -> Iterator[tuple[str, str]]:
        for i, segment in enumerate(segments):
            if node is None:
                return
            for end, found in node.get("/", {}).items():
                if segment.startswith(end):
                    yield found
            # A segment leads on only if a slash follows it in the path.
            node = node.get(segment) if i + 1 < len(segments) else None


def url_verdicts(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]],
    url: str = "url",
    page_id: str = "page_id",
    unwanted: Iterable[str] = (),
    default: str = ALLOW,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up
    to ``?``, ``#`` or the end; both empty for a null url or one without ``://``. ``rules`` are
    (allow | block, host/path); a rule fits its host and all subdomains of it if the path begins with
    its path, and the longest rule that fits gives ``rule`` and ``verdict``. Where none fits ``rule`` is
    null, and the verdict is block for a host with an unwanted label, else ``default``. Rows stay one to
    one; other columns are not read.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    out = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    words = frozenset(unwanted)
    spark = pages.sparkSession
    source = iter(rules)
    while block := list(islice(source, BLOCK_RULES)):
        shared = spark.sparkContext.broadcast(Trie(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for batch in batches:
                host, path, rule, verdict = (batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict"))
                for i, (h, p) in enumerate(zip(host, path)):
                    found = trie.find(h, p)
                    if found and (rule[i] is None or (len(found[1]), found[0] == BLOCK) > (len(rule[i]), verdict[i] == BLOCK)):
                        verdict[i], rule[i] = found
                columns = [batch.column("page_id"), batch.column("host"), batch.column("path")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"]
                )

        out = out.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
    if words:
        parts = F.split("host", "[.-]")
        bad = F.arrays_overlap(parts, F.array(*map(F.lit, sorted(words))))
        judged = F.when(bad, BLOCK).otherwise(default)
    else:
        judged = F.lit(default)
    return out.withColumn("verdict", F.coalesce("verdict", judged))
