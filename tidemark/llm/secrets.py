"""Secret scans: base patterns, and a character convolutional network in numpy over every other candidate.

Base kinds, leftmost and non-overlapping each: ``assign``, ``access`` and ``hex`` (see the patterns below). A candidate is
a run of ``[A-Za-z0-9+/_=-]`` of 16 or more characters with a letter that base spans do not cover completely. The network
reads the candidate with its surrounding context as one-hot characters, a long one in overlapping windows over all of it
of which the highest score counts: convolution, maximum over positions, logistic output. It is trained on labelled
findings written by rule with a fixed seed (secrets of many shapes, with and without digits; look-alikes such as uuids,
paths, versions, identifiers and long words), calibrated by Platt scaling on held-out findings, and cut where precision is
best among the thresholds that keep ``RECALL`` of the held-out secrets (the lowest of equals). Its spans are added as kind
``cnn``; base spans always stay, also those within them.

Spans are code points of the whole text, end exclusive. Null and empty texts have no spans; repeated rows each get a
row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_BYTES, per_batch, text_bytes
from tidemark.sources.shared import spread

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
LETTER = re.compile(rb"[A-Za-z]")
HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
RUN = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits + "+/_=-").encode(), np.uint8))

#: Characters the network tells apart, its window (context before, candidate, context after) and its size.
CHARS = string.ascii_lowercase + string.ascii_uppercase + string.digits + " +/_=-.:\"'<>?&#@,;()"
CODE = np.full(256, len(CHARS), np.uint8)
CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
BEFORE, INSIDE, AFTER = 20, 48, 8
#: Windows of a long candidate begin so many characters apart: any part of INSIDE - STEP characters is in one whole.
STEP = 16
WIDE, FILTERS, KERNEL = BEFORE + INSIDE + AFTER, 24, 5
RECALL = 0.95


def _positions(data: bytes, part: bytes) -> list[int]:
    out, at = [], data.find(part)
    while at >= 0:
        out.append(at)
        at = data.find(part, at + 1)
    return out


def _runs(ok: np.ndarray, seeds: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of ok of at least ``least`` that hold a seed position."""
    out: list[tuple[int, int]] = []
    for i in seeds.tolist():
        if out and i < out[-1][1]:
            continue
        a, b = i, i + 1
        while a and ok[a - 1]:
            a -= 1
        while b < len(ok) and ok[b]:
            b += 1
        out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in byte offsets, by start, then kind as listed."""
    out = []
    lower = data.translate(LOWER_BYTES)
    end = 0
    for at in sorted({i for k in KEYS for i in _positions(lower, k)}):
        if at >= end and (m := ASSIGN.match(data, at)):
            end = m.end()
            if len(m[2]) >= 12:
                out.append((at, end, "assign"))
    if b"AKIA" in data:
        out += [(*m.span(), "access") for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    if len(data) >= 16:
        ok = HEX[np.frombuffer(data, np.uint8)]
        seeds = np.arange(15, len(data), 16)  # any run of 16 holds one of these
        for step in (-2, 2, -5, 5, -8, 8):  # and reaches 8 to one side of it
            seeds = seeds[ok[seeds]]
            near = np.clip(seeds + step, 0, len(ok) - 1)
            other = np.clip(seeds - step, 0, len(ok) - 1)
            seeds = seeds[ok[near] | ok[other]]
        out += [(a, b, "hex") for a, b in _runs(ok, seeds, 16)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(data: bytes, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs that the network judges: all with a letter that base spans, sorted by start, do not cover together."""
    ok = RUN[np.frombuffer(data, np.uint8)]
    seeds = np.arange(15, len(data), 16)  # any run of 16 holds one of these
    seeds = seeds[ok[seeds]]
    seeds = seeds[ok[np.maximum(seeds - 8, 0)] | ok[np.minimum(seeds + 8, len(data) - 1)]]
    whole: list[list[int]] = []  # stretches that base spans cover
    for a, b, _ in taken:
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    out, at = [], 0
    for a, b in _runs(ok, seeds, 16):
        while at < len(whole) and whole[at][1] < b:
            at += 1
        covered = at < len(whole) and whole[at][0] <= a
        if not covered and LETTER.search(data, a, b):
            out.append((a, b))
    return out


def windows(data: bytes, a: int, b: int) -> Iterator[np.ndarray]:
    """Character codes of a candidate and its context, at fixed places; of a longer run than INSIDE, overlapping windows
    over all of it, the last at its end."""
    for at in chain(range(a, b - INSIDE, STEP), [max(a, b - INSIDE)]):
        end = min(b, at + INSIDE)
        row = np.full(WIDE, len(CHARS), np.uint8)
        left, mid, right = (CODE[np.frombuffer(x, np.uint8)] for x in (data[max(0, at - BEFORE) : at], data[at:end], data[end : end + AFTER]))
        row[BEFORE - len(left) : BEFORE] = left
        row[BEFORE : BEFORE + len(mid)] = mid
        row[BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = right
        yield row


class CharNet:
    """One-hot characters, one convolution, ReLU, maximum over positions, logistic output; Adam; Platt calibration."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {"k": rng.normal(0, 0.15, (KERNEL, len(CHARS) + 1, FILTERS)), "c": np.zeros(FILTERS), "o": rng.normal(0, 0.2, FILTERS), "b": np.zeros(1)}
        self.platt, self.threshold = (1.0, 0.0), 0.5

    def _forward(self, x: np.ndarray):
        steps = x.shape[1] - KERNEL + 1
        z = self.w["c"] + sum(self.w["k"][j][x[:, j : j + steps]] for j in range(KERNEL))
        at = z.argmax(axis=1)
        top = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0)
        return top @ self.w["o"] + self.w["b"][0], top, at

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                rows = order[at : at + 64]
                s, top, pos = self._forward(x[rows])
                d = (1 / (1 + np.exp(-s)) - y[rows]) / len(rows)
                back = d[:, None] * self.w["o"] * (top > 0)
                grad = {"o": top.T @ d, "b": np.array([d.sum()]), "c": back.sum(0), "k": np.zeros_like(self.w["k"])}
                for j in range(KERNEL):
                    np.add.at(grad["k"][j], (x[rows[:, None], pos + j], np.arange(FILTERS)[None, :]), back)
                t += 1
                for k, g in grad.items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.w[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: list[list[np.ndarray]], y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall. x: the windows of each finding."""
        s = self._tops(x, lambda rows: self._forward(rows)[0])
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * s).sum() + 1e-2 * (a - 1), (p - y).sum()])
            h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.platt = (float(a), float(b))
        p = self.score_runs(x)
        yes, no = np.sort(p[y == 1]), p[y == 0]
        able = yes[: int(len(yes) * (1 - recall)) + 1]
        precision = [(len(yes) - i) / (len(yes) - i + (no >= t).sum()) for i, t in enumerate(able)]
        self.threshold = float(able[int(np.argmax(precision))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        a, b = self.platt
        return np.concatenate([1 / (1 + np.exp(-(a * self._forward(x[i : i + 512])[0] + b))) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def score_runs(self, x: list[list[np.ndarray]]) -> np.ndarray:
        """The highest probability among the windows of each run."""
        return self._tops(x, self.score)

    @staticmethod
    def _tops(x: list[list[np.ndarray]], score) -> np.ndarray:
        sizes = np.array([len(rows) for rows in x])
        return np.maximum.reduceat(score(np.array([row for rows in x for row in rows])), np.cumsum(sizes) - sizes) if len(x) else np.zeros(0)


def findings(n: int, seed: int, long: bool = False) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Windows and labels (1: a secret) of findings written by rule; half of them secrets. long puts half of either behind
    a harmless path of 50 to 160 characters in the same run."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("etaoinshrdlu"), k))
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    spoken = lambda k: "".join(rng.choice(list("bcdfghklmnprstvwz")) + rng.choice(list("aeiou")) + rng.choice(["", "", "n", "r", "st", "ng", "ch", "tz", "ll"]) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    secret = (
        lambda: draw(alnum + "+/", int(rng.integers(24, 64))) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["gh_", "pk_live_", "sk_test_", "key-", "xo-"]) + draw(alnum, int(rng.integers(20, 40))),
        lambda: draw(string.ascii_uppercase + string.digits, int(rng.integers(20, 32))),
        lambda: draw("0123456789ABCDEF", 32),
        lambda: draw(alnum + "-_", int(rng.integers(32, 60))),
        lambda: draw(string.ascii_letters, int(rng.integers(24, 48))),
    )
    plain = (
        lambda: f"{word(6)}-{word(7)}-{rng.integers(1, 2030)}",
        lambda: f"/{word(4)}/{word(6)}/{word(7)}/{rng.integers(1, 99999)}",
        lambda: f"{word(8)}_{word(9)}_{rng.integers(0, 99)}",
        lambda: f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}",
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-00-00Z",
        lambda: f"{word(12)}{rng.integers(0, 9)}{word(8)}",
        lambda: f"{word(5)}={rng.integers(0, 10**9)}&{word(4)}",
        lambda: "-" * int(rng.integers(14, 30)) + f"v{rng.integers(0, 9)}",
        lambda: word(int(rng.integers(16, 34))),
        lambda: spoken(int(rng.integers(6, 12))),
        lambda: spoken(int(rng.integers(6, 9))).capitalize(),
        lambda: spoken(int(rng.integers(6, 9))).upper(),
        lambda: word(5).capitalize() + word(6).capitalize() + word(7).capitalize(),
        lambda: f"{word(5)}-{word(6)}-{word(7)}",
        lambda: f"/{word(5)}/{word(6)}/{word(7)}",
        lambda: f"{word(7)}_{word(5)}_{word(6)}".upper(),
    )
    cues = ("key: ", "auth=", "credential ", "Bearer ", "export KEY=", "pwd ", "use ")
    rows, labels = [], []
    for i in range(n):
        y = i % 2
        body = (secret if y else plain)[int(rng.integers(len(secret if y else plain)))]()
        if long and i % 4 > 1:
            path, size = "", int(rng.integers(50, 160))
            while len(path) < size:
                path += f"/{word(int(rng.integers(3, 10)))}" + str(rng.choice(["", "_v2", f"-{rng.integers(1, 2030)}"]))
            body = f"{path}/key={body}"
        lead = f"{word(5)} {word(3)} " + (str(rng.choice(cues)) if rng.random() < (0.6 if y else 0.2) else str(rng.choice(["", "see ", "http", "id "])))
        data = f"{lead}{body}{rng.choice([' ', '.', chr(10), chr(34), ''])}{word(6)}".encode()
        found = CANDIDATE.search(data, len(lead.encode()))
        if found:
            rows.append(list(windows(data, *found.span())))
            labels.append(y)
    return rows, np.array(labels, float)


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each finding, and its label."""
    rows, labels = findings(n, seed)
    return np.array([r[0] for r in rows]), labels


@lru_cache(maxsize=1)
def trained() -> CharNet:
    """The production network; a few seconds on the driver."""
    net = CharNet()
    net.fit(*labelled_findings(2400, 1))
    net.calibrate(*findings(1200, 2, long=True))
    return net


def secret_spans(data: bytes, net: CharNet) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of one text in code points."""
    return _spans([data], net)[0]


def _spans(texts: list[bytes], net: CharNet) -> list[list[tuple[int, int, str]]]:
    base = [base_spans(t) for t in texts]
    found = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
    rows: list[np.ndarray] = []
    who: list[int] = []
    flagged: set[int] = set()

    def judge():
        flagged.update(k for k, s in zip(who, net.score(np.array(rows)), strict=True) if s >= net.threshold)
        rows.clear()
        who.clear()

    for k, (i, a, b) in enumerate(found):
        for row in windows(texts[i], a, b):
            rows.append(row)
            who.append(k)
            if len(rows) == 4096:
                judge()
    judge()
    for k in sorted(flagged):
        i, a, b = found[k]
        base[i].append((a, b, "cnn"))
    out = []
    for t, spans in zip(texts, base, strict=True):
        if spans and not t.isascii():
            chars = np.append(0, np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80))
            spans = [(int(chars[a]), int(chars[b]), k) for a, b, k in spans]
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of kind, start, end) of each text."""
    net = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = _spans(list(text_bytes(batch["t"])), net)
        return pa.RecordBatch.from_arrays([batch["i"], pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], kind)], ["i", "spans"])

    doc = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    return per_batch(doc, scan, f"i {dict(df.dtypes)[id_col]}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("i", id_col)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by a mark; all rows and columns stay. Overlapping spans are one."""
    net = trained()
    at = df.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        spans = _spans([(t or "").encode() for t in texts], net)
        for i, found in enumerate(spans):
            if found:
                out, end = [], 0
                for a, b, _ in found:
                    if a >= end:
                        out += [texts[i][end:a], mark]
                    end = max(end, b)
                texts[i] = "".join([*out, texts[i][end:]])
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return per_batch(spread(df), clean, df.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ORACLE: dict[str, str] = {}


def digest(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of a text's spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "cnn").encode()).hexdigest()
