"""URL filters: a trie over reversed host labels and path segments.

A rule is ``host/path``. It fits a url if the url's host is the rule's host or a subdomain of it, and the
url's path starts with the rule's path. Of the fitting rules the longest one (characters of host and path
together, then of the host) decides; of an allow and a block entry for the same place, allow.

The trie is broadcast. Its size is bounded: a rule list longer than ``slice_rules`` is cut into slices, each
a trie of its own that the rows pass in turn, keeping the longest match so far. The list itself is the caller's, in
the driver's memory; all slices together are as large.

Defined results: a null url, one without ``://`` and an empty one have an empty host and an empty path, so
that only rules without a path and host could fit them; no rule fits: the default verdict. Other columns of
the table are not read. An empty table gives an empty result. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_RULES = 200_000

#: The rules of the contract.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "#?":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


class UrlTrie:
    """Host labels from the right, then path segments from the left; a rule's last segment is a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            node = node.setdefault("paths", {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            tails = node.setdefault("tails", {})
            if tails.get(last, (None, "block"))[1] != "allow":
                tails[last] = (rule, verdict)
            node["longest"] = max(node.get("longest", 0), len(last))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best, found = (-1, -1), None
        node, used = self.root, 0
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            used += len(label) + (used > 0)
            at = node.get("paths")
            for segment in segments:
                if at is None:
                    break
                tails = at.get("tails")
                if tails:
                    for n in range(min(len(segment), at["longest"]), -1, -1):
                        hit = tails.get(segment[:n])
                        if hit:
                            if (len(hit[0]), used) > best:
                                best, found = (len(hit[0]), used), hit
                            break
                at = at.get(("path", segment))
        return found


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", slice_rules: int = SLICE_RULES) -> DataFrame:
    """page id, host, path, the deciding rule or null, and the verdict of each row."""
    rules = list(rules) or [("allow", "\0")]
    sc = pages.sparkSession.sparkContext
    out = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", "CAST(NULL AS STRING) AS rule", "CAST(NULL AS STRING) AS verdict")
    for at in range(0, len(rules), slice_rules):
        trie = sc.broadcast(UrlTrie(rules[at : at + slice_rules]))
        last = at + slice_rules >= len(rules)

        def weight(rule: str, verdict: str) -> tuple[int, int, bool]:
            return len(rule), len(rule.partition("/")[0]), verdict == "allow"

        def judge(batches: Iterator[pa.RecordBatch], trie=trie, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                split = [split_url(u) for u in b.column("url").to_pylist()]
                verdicts, kept = [], []
                for (host, path), rule, verdict in zip(split, b.column("rule").to_pylist(), b.column("verdict").to_pylist()):
                    hit = trie.value.match(host, path)
                    # an earlier slice's rule stays unless this one is longer, or allows the same place
                    if hit and (rule is None or weight(*hit) > weight(rule, verdict)):
                        rule, verdict = hit
                    kept.append(rule)
                    verdicts.append(verdict or (default if last else None))
                cols = [b.column("page_id")]
                names = ["page_id"]
                if last:
                    cols += [pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string())]
                    names += ["host", "path"]
                else:
                    cols.append(b.column("url"))
                    names.append("url")
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(verdicts, pa.string())], names=[*names, "rule", "verdict"])

        id_type = out.schema["page_id"].dataType.simpleString()
        out = out.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string" if last else f"page_id {id_type}, url string, rule string, verdict string")
    return out
