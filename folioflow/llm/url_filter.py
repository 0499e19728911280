"""Glob rules over canonical URLs by one bit-parallel automaton for all patterns.

Each rule is a glob over host + path: ``*`` matches any run without ``/``,
``**`` any run, every other character itself; a rule matches whole URLs. The
patterns' positions are the bits of one mask of several 64-bit words. For each
byte of a URL a Shift-And step moves every pattern at once, for all URLs of a
batch together; a wildcard is a position that keeps itself alive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: URL bytes stepped through per block of rows at most, which bounds memory for very long URLs.
BLOCK_BYTES = 1 << 22


def host_rule(host: str, path: str) -> tuple[str, str]:
    """The two globs of a rule for a host with its subdomains and all paths that start with path."""
    return f"{host}{path}**", f"*.{host}{path}**"


class GlobAutomaton:
    """All globs compiled to masks; match() tells for each URL which globs match it."""

    def __init__(self, globs: Sequence[str]):
        symbols: list[tuple[str | int, bool]] = []
        self.starts, self.ends = [], []
        for glob in globs:
            parts, i = [], 0
            while i < len(glob):
                if glob.startswith("**", i):
                    parts.append("**")
                    i += 2
                elif glob[i] == "*":
                    parts.append("*")
                    i += 1
                else:
                    parts += list(glob[i].encode())
                    i += 1
            # State k of a pattern: its first k bytes matched. Wildcards after byte k keep state k alive.
            self.starts.append(len(symbols))
            symbols.append(("", False))
            loops = [""]
            for part in parts:
                if isinstance(part, str):
                    loops[-1] = max(loops[-1], part)
                else:
                    symbols.append((part, False))
                    loops.append("")
            for k, loop in enumerate(loops):
                at = self.starts[-1] + k
                symbols[at] = (symbols[at][0], loop)
            self.ends.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.step = np.zeros((256, self.words), _U)
        self.stay = np.zeros((256, self.words), _U)
        self.initial = np.zeros(self.words, _U)
        for at in self.starts:
            self.initial[at // 64] |= _U(1) << _U(at % 64)
        for at, (symbol, loop) in enumerate(symbols):
            bit = _U(1) << _U(at % 64)
            if symbol != "":
                self.step[symbol, at // 64] |= bit
            if loop:
                self.stay[:, at // 64] |= bit
                if loop == "*":
                    self.stay[ord("/"), at // 64] &= ~bit

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix (URL, glob) for URLs given as bytes and offsets."""
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), len(self.ends)), bool)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, int(lengths[order[at]]))
            rows = order[at : at + max(1, BLOCK_BYTES // longest)]
            at += len(rows)
            out[rows] = self._run(data, offsets[rows], lengths[rows])
        return out

    def _run(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        state = np.tile(self.initial, (len(lengths), 1))
        # Lengths fall, so the rows that still have a byte at place i are the first ones.
        alive = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        for i, n in enumerate(alive):
            byte = data[begin[:n] + i]
            now = state[:n]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[:n] = moved & self.step[byte] | now & self.stay[byte]
        ends = np.array(self.ends)
        return (state[:, ends // 64] >> (ends % 64).astype(_U)) & _U(1) == 1


def canonical(url: str) -> tuple[F.Column, F.Column]:
    """(host, path) columns: host from the first :// up to /, ? or #, A-Z lower-cased; path from there up to ? or #."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], globs: Sequence[tuple[str, str]] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    rules: (verdict, host, path), of which the longest that fits wins; rule is
    host + path then. Where none fits, rule is null and the first of globs
    (verdict, glob) that matches decides, else default. A null URL and one
    without :// have empty host and path; repeated rows are judged each; an
    empty table gives no rows. Other columns are not read.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    automaton = GlobAutomaton([g for _, host, path in ranked for g in host_rule(host, path)] + [g for _, g in globs])
    names = np.array([host + path for _, host, path in ranked] + [None], object)
    verdicts = np.array([v for v, _, _ in ranked] + [v for v, _ in globs] + [default], object)
    n = len(ranked)

    @F.pandas_udf("rule string, verdict string")
    def judge(url: pd.Series) -> pd.DataFrame:
        encoded = [x.encode() for x in url]
        offsets = np.cumsum([0, *map(len, encoded)])
        hit = automaton.match(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        by_rule = np.concatenate([hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2], hit[:, 2 * n :], np.ones((len(hit), 1), bool)], axis=1)
        first = by_rule.argmax(axis=1)
        return pd.DataFrame({"rule": names[np.minimum(first, n)], "verdict": verdicts[first]})

    host, path = canonical(url_col)
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("_judged", judge(F.concat("host", "path")))
    return out.select(id_col, "host", "path", "_judged.rule", "_judged.verdict")
