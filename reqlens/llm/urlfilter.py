"""URL filter: a trie over reversed host labels, then path segments; the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_RULES = 1_000_000  # the trie is broadcast, so its size has a bound


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """``rules``: (verdict, ``host/path``). A node holds child labels, and the paths that start there.

    Paths form a second trie whose edges are whole segments; its last edge may be the beginning of a
    segment, kept apart in ``starts``. Of equal rules, block wins.
    """
    root: dict = {"labels": {}, "paths": None}
    for count, (verdict, rule) in enumerate(rules):
        if count >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"segments": {}, "starts": {}}
        at = node["paths"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["segments"].setdefault(segment, {"segments": {}, "starts": {}})
        known = at["starts"].get(last)
        if known is None or verdict == "block":
            at["starts"][last] = (f"{host}{path}", verdict)
    return root


def longest_path(paths: dict, path: str) -> tuple[str, str] | None:
    at, best = paths, None
    for segment in path.split("/"):
        longest = max(map(len, at["starts"]), default=-1)
        fits = [segment[:n] for n in range(min(len(segment), longest) + 1) if segment[:n] in at["starts"]]
        if fits:
            best = at["starts"][fits[-1]]  # deeper segments mean longer rules
        at = at["segments"].get(segment)
        if at is None:
            break
    return best


def longest_rule(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule (host and path counted together) that fits; block wins a tie."""
    node, found = trie, []
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        if node["paths"] is not None and (rule := longest_path(node["paths"], path)):
            found.append(rule)
    return max(found, key=lambda rule: (len(rule[0]), rule[1] == "block"), default=None)


def url_parts(url: str = "url") -> tuple:
    """Host and path of a url as columns; null or without ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules``: (``allow`` or ``block``, ``host/path``). A rule fits its host and all subdomains when the
    path starts with the rule's path; of the fitting ones the longest decides. Without a fitting rule the
    rule is null and the verdict is ``default``. Null urls and urls without ``://`` have an empty host and
    path. Repeated rows are judged each; an empty table gives an empty result; only ``page_id`` and
    ``url`` are read, so other columns cannot clash. One narrow projection, no shuffle.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(build_trie(rules))
    host, path = url_parts()

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [longest_rule(trie.value, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": pd.Series([f and f[0] for f in found], dtype=object),
                                "verdict": pd.Series([f[1] if f else default for f in found], dtype=object)})

    judged = F.pandas_udf(judge, "rule string, verdict string")
    return (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("found", judged("host", "path"))
            .select("page_id", "host", "path", "found.rule", "found.verdict"))
