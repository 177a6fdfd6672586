"""URL filters: all host/path glob rules run at once over each canonical URL as a multiword Shift-And automaton.

A rule's bits lie side by side in 64-bit words: a start bit, then one bit for each literal character. A wildcard is a
self-loop on the bit before it: ``*`` in a host loops on all but ``/``, ``*`` in a path on everything. One step over
all URLs of a batch is a shift with carry between words, an AND with the character's mask, and an OR with the loops.

Null urls and urls without ``://`` have an empty host and path and fit no rule; a rule's path must start the url's
path, so a url without a path fits none either. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U1 = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """A glob on host and path; fits the host with its subdomains and all paths that begin as the rule's path does."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


class ShiftAnd:
    """The automaton; rules are ordered longest first, so the first accepting bit is the verdict's."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
        steps: list[tuple[str, str]] = []  # of each bit: the character that enters it ("" for a start bit), and its loop
        starts, ends = [], []
        for rule in self.rules:
            starts.append(len(steps))
            steps.append(("", "host"))
            for part, kind in ((f".{rule.host}", "host"), (rule.path, "any")):
                for c in part:
                    if c == "*":
                        steps[-1] = (steps[-1][0], kind if steps[-1][1] != "any" else "any")
                    else:
                        steps.append((c, ""))
            steps[-1] = (steps[-1][0], "any")
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        alphabet = sorted({c for c, _ in steps if c} | {"/"})
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        self.enter = np.zeros((len(alphabet) + 1, self.words), np.uint64)  # the last row: every other character
        self.loop = np.zeros_like(self.enter)
        for i, (c, kind) in enumerate(steps):
            w, bit = divmod(i, 64)
            if c:
                self.enter[alphabet.index(c), w] |= U1 << np.uint64(bit)
            for k in range(len(alphabet) + 1):
                if kind == "any" or kind == "host" and (k == len(alphabet) or alphabet[k] != "/"):
                    self.loop[k, w] |= U1 << np.uint64(bit)
        self.start, self.final = (self._mask(x) for x in (starts, ends))
        self.rule_at = np.full(self.words * 64, -1)
        self.rule_at[ends] = np.arange(len(ends))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= U1 << np.uint64(i % 64)
        return out

    def match(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The index in self.rules of the longest fitting rule of each url, -1 if none fits."""
        texts = ["." + h + p for h, p in zip(hosts, paths, strict=True)]
        out = np.full(len(texts), -1)
        order = np.argsort([len(t) for t in texts], kind="stable")
        step = max(1, (1 << 21) // self.words)
        at = 0
        while at < len(order):
            n, used = 0, 0
            while at + n < len(order) and n < step and used <= 1 << 22:
                n += 1
                used = n * len(texts[order[at + n - 1]])
            rows = order[at : at + n]
            out[rows] = self._scan([texts[i] for i in rows])
            at += n
        return out

    def _scan(self, texts: list[str]) -> np.ndarray:
        """texts are ordered by length."""
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[found] == flat, found, len(self.alphabet))
        begin = np.cumsum(sizes) - sizes
        state = np.tile(self.start, (len(texts), 1))
        live = np.arange(len(texts))
        for i in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > i]
            if not i & 15:  # nothing changes any more where only accepting bits are left
                live = live[(state[live] & ~self.final).any(axis=1)]
            if not len(live):
                break
            code, now = codes[begin[live] + i], state[live]
            moved = now << U1
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (moved & self.enter[code]) | (now & self.loop[code])
        hit, best = state & self.final, np.full(len(texts), -1)
        for w in range(self.words):
            rows = np.flatnonzero((best < 0) & (hit[:, w] != 0))
            low = hit[rows, w] & (~hit[rows, w] + U1)
            best[rows] = self.rule_at[w * 64 + np.log2(low.astype(np.float64)).astype(int)]
        return best


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = _rest(url)
    tail = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest))
    return F.regexp_extract(tail, r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Rule] = RULES, default: str = "allow") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of each row; where no rule fits, the default's."""
    automaton = ShiftAnd(rules)
    parts = df.select(F.col(id_col).alias("i"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def judge(batches):
        names = [*(r.name for r in automaton.rules), None]
        verdicts = [*(r.verdict for r in automaton.rules), default]
        for b in batches:
            best = automaton.match(b["host"].to_pylist(), b["path"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["i"], b["host"], b["path"], pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())],
                ["i", "host", "path", "rule", "verdict"],
            )

    if id_col.lower() in ("host", "path", "rule", "verdict"):
        raise ValueError(f"the id column may not be named {id_col}: the result has a column of that name")
    kind = dict(df.dtypes)[id_col]
    return parts.mapInArrow(judge, f"i {kind}, host string, path string, rule string, verdict string").withColumnRenamed("i", id_col)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = {
    "op2_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path,
        CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d""",
}
