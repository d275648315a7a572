"""URL allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

#: (verdict, rule), a rule being a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END = re.compile("[/?#]")
_TAIL = re.compile("[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first :// on, A-Z lower-cased; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = _END.search(rest)
    cut = m.start() if m else len(rest)
    path = rest[cut:]
    t = _TAIL.search(path)
    return rest[:cut].translate(_LOWER), path[: t.start()] if t else path


class Trie:
    """Rules by host labels from the last to the first, then by path segments, the last of which may be partial.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of fitting rules the one with
    more host labels wins, then the one with the longer path; of equal rules the one given last.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {"labels": {}, "paths": None}
        for verdict, rule in rules:
            host, _, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            segments = (("/" + rest) if "/" in rule else "").split("/")
            node["paths"] = node["paths"] or {"next": {}, "ends": []}
            at = node["paths"]
            for s in segments[:-1]:
                at = at["next"].setdefault(s, {"next": {}, "ends": []})
            at["ends"] = sorted([e for e in at["ends"] if e[0] != segments[-1]] + [(segments[-1], rule, verdict)], key=lambda e: -len(e[0]))

    @staticmethod
    def _path(node: dict | None, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, s in enumerate(segments):
            if node is None:
                break
            best = next(((rule, verdict) for start, rule, verdict in node["ends"] if s.startswith(start)), best)
            node = node["next"].get(s) if i < len(segments) - 1 else None
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, best = self.root, self._path(self.root["paths"], path)
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            best = self._path(node["paths"], path) or best
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", id_column: str = "page_id", url_column: str = "url", most_bytes: int = 16 << 20) -> DataFrame:
    """(id, host, path, rule, verdict: string) for every row, where no rule fits with a null rule and the default verdict.

    The trie is sent to every executor, so the rules' size is checked: more than `most_bytes` of hosts and paths is a
    ValueError (a trie takes some ten times that in memory). A null url, or one
    without ://, has an empty host and path. Rows are judged one by one: repeated rows and ties do not matter, no
    other column is read and an empty table gives none.
    """
    rules = list(rules)
    size = sum(len(rule.encode()) for _, rule in rules)
    if size > most_bytes:
        raise ValueError(f"rules of {size} bytes are too many to broadcast: at most {most_bytes}")
    ship(pages.sparkSession)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            found = [match(h, p) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [f and f[0] for f in found], [f[1] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url")).mapInArrow(lean(run), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_column)
