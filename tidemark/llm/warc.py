"""WARC: reading and writing records, and not-modified revisit resolution.

``resolve_revisits`` joins each server-not-modified revisit as of its time to the latest earlier full response of the
same canonical url, checks validators and merges headers: the 304's permitted headers replace the response's, all others
stay. Only ids, times, validators and headers move; payloads stay where they are and are referred to by record id.

The as-of join is two-level, so that a url with a third of all rows is no hot task: time is dealt into ``buckets`` spans
of about as many rows each (by quantiles, so an outlier does not stretch them); the last response of each url and span is
aggregated (partial sums first), carried over spans by a window of at most ``buckets`` rows a url, and joined back on
(url, span); within a span a window finds later ones.

Outcomes: ``resolved`` (an entity tag or modification date agrees), ``mismatch`` (it does not), ``unverified`` (nothing
to compare), ``missing`` (no earlier response, or a null url or time), ``other_profile`` (the record has a ``profile``
that is not server-not-modified, such as identical-payload-digest: it keeps its own headers and refers to the record that
it names, if any). Times are whole numbers, timestamps or ISO strings; one that cannot be read is null. Responses at a
revisit's very time count as earlier if their record id is smaller; a null record id comes first. Repeated rows each get
a row; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.records import filesystem
from tidemark.llm.urls import host_of, path_of

#: Headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
RECORD = "record_id string, url string, ts string, record_type string, profile string, refers_to string, headers map<string,string>, payload binary"
#: The end of the profile of a revisit that is a 304 answer.
NOT_MODIFIED = "server-not-modified"


def canonical_url(url: Column) -> Column:
    """Host in lower case, path without trailing slashes and query without utm_ parameters; no scheme and no fragment."""
    query = F.regexp_extract(F.regexp_extract(url, r"^[^#]*", 0), r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    whole = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.isNotNull(), whole)


def _instant(ts: Column, kind: str) -> Column:
    """A time as a whole number: itself, or microseconds of a timestamp or an ISO string."""
    if kind in ("timestamp", "string"):
        return F.unix_micros(F.try_to_timestamp(ts) if kind == "string" else ts)
    return F.unix_micros(ts.cast("timestamp")) if kind in ("timestamp_ntz", "date") else ts.cast("long")


def resolve_revisits(records: DataFrame, buckets: int = 64) -> DataFrame:
    """record_id, url (canonical), ts, referred_id, outcome and merged headers of each revisit.

    records: record_id, url, ts, record_type (response or revisit), headers map<string,string> with lower-case names, and
    (read_warc gives them) profile and refers_to; without them every revisit is a 304. Further columns are not read.
    """
    own = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    r = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").alias("given"), _instant(F.col("ts"), dict(records.dtypes)["ts"]).alias("ts"), "record_type", "headers", own("profile").alias("profile"), own("refers_to").alias("refers_to"))
    r = r.withColumn("other", (F.col("record_type") == "revisit") & F.coalesce(~F.col("profile").endswith(NOT_MODIFIED), F.lit(False)))
    bounds = sorted(set(r.agg(F.percentile_approx("ts", [k / buckets for k in range(1, buckets)], 1000)).first()[0] or [])) if buckets > 1 else []
    full = (F.col("record_type") == "response") & F.col("url").isNotNull() & F.col("ts").isNotNull()
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    r = r.withColumn("slot", F.size(F.filter(edges, lambda b: b <= F.col("ts")))).withColumn("full", F.when(full, F.struct("ts", "record_id", "headers")))
    at = F.struct("ts", F.col("record_id"))
    last = r.where(full).groupBy("url", "slot").agg(F.max_by("full", at).alias("full"))
    carried = last.select("url", (F.col("slot") + 1).alias("slot"), F.col("full").alias("before"), F.lit(False).alias("asked"))
    slots = r.where("record_type = 'revisit' AND NOT other AND url IS NOT NULL AND ts IS NOT NULL").select("url", "slot").distinct()
    marks = slots.select("url", "slot", F.lit(None).cast(carried.schema["before"].dataType).alias("before"), F.lit(True).alias("asked"))
    marks = marks.unionByName(carried)
    upto = Window.partitionBy("url").orderBy("slot", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = marks.withColumn("before", F.last("before", ignorenulls=True).over(upto)).where("asked").drop("asked")
    inside = Window.partitionBy("url", "slot").orderBy("ts", F.col("record_id").asc_nulls_first(), F.col("record_type")).rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("record_type = 'revisit'").drop("full", "record_type")
    found = near.join(earlier, ["url", "slot"], "left").withColumn("to", F.coalesce("near", "before"))
    mine, theirs = F.col("headers"), F.col("to.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    same_tag, same_date = tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"]
    outcome = F.when(F.col("to").isNull() | F.col("url").isNull() | F.col("ts").isNull(), "missing").when(F.coalesce(same_tag, same_date).isNull(), "unverified").when(F.coalesce(same_tag, same_date), "resolved").otherwise("mismatch")
    empty = F.create_map().cast("map<string,string>")
    names = F.array(*map(F.lit, PERMITTED))
    updates = F.map_filter(F.coalesce(mine, empty), lambda k, v: F.array_contains(names, k))
    rest = F.map_filter(F.coalesce(theirs, empty), lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    out = found.withColumn("outcome", F.when(F.col("other"), "other_profile").otherwise(outcome))
    hit = F.col("outcome").isin("resolved", "unverified")
    named = F.col("refers_to").cast(records.schema["record_id"].dataType) if dict(records.dtypes)["record_id"] == "string" else F.col("refers_to").try_cast(records.schema["record_id"].dataType)
    referred = F.when(F.col("other"), named).when(F.col("outcome") != "missing", F.col("to.record_id"))
    return out.select("record_id", "url", F.col("given").alias("ts"), referred.alias("referred_id"), "outcome", F.when(hit, F.map_concat(rest, updates)).otherwise(F.coalesce(mine, empty)).alias("headers"))


def write_warc(rows: Iterator[dict], out) -> None:
    """Writes records as gzip members to a binary file object."""
    for r in rows:
        http = "".join(f"{k}: {v}\r\n" for k, v in (r.get("headers") or {}).items())
        body = f"HTTP/1.1 {304 if r['record_type'] == 'revisit' else 200} -\r\n{http}\r\n".encode() + (r.get("payload") or b"")
        more = "".join(f"{name}: {r[key]}\r\n" for name, key in (("WARC-Profile", "profile"), ("WARC-Refers-To", "refers_to")) if r.get(key))
        head = f"WARC/1.1\r\nWARC-Type: {r['record_type']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {r['ts']}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        out.write(gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0))


def _lines(f) -> dict[str, str]:
    out = {}
    while line := f.readline().strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Members(io.RawIOBase):
    """The gzip members of a stream, decompressed; a cut or damaged member ends it where its readable bytes end."""

    def __init__(self, raw):
        self.raw, self.z, self.tail = raw, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.z is None or self.z.eof:
                self.tail = (self.z.unused_data if self.z else b"") or self.raw.read(1 << 16)
                self.z = zlib.decompressobj(31)
            elif not self.tail:
                self.tail = self.raw.read(1 << 16)
            if not self.tail:
                return 0
            try:
                data = self.z.decompress(self.tail, len(out))
            except zlib.error:
                return 0
            self.tail = self.z.unconsumed_tail
            if data:
                out[: len(data)] = data
                return len(data)


class _Body:
    """The next ``size`` bytes of a stream, read a piece at a time."""

    def __init__(self, f, size: int):
        self.f, self.left = f, size

    def read(self, n: int) -> bytes:
        data = self.f.read(min(n, self.left))
        self.left -= len(data)
        return data

    def readline(self) -> bytes:
        data = self.f.readline(self.left) if self.left else b""
        self.left -= len(data)
        return data


def parse_warc(f, payloads: bool = True) -> Iterator[dict]:
    """Records of an uncompressed stream, one at a time. Without ``payloads`` bodies are passed over in pieces and never
    held. A body that is shorter than it says (a cut file) ends the records before it; a record without a
    readable length is left out, and reading goes on at the next one."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _lines(f)
        length = head.get("content-length", "0")
        if not length.isascii() or not length.isdigit():
            continue
        body = _Body(f, int(length))
        first = body.readline()
        http = first.startswith(b"HTTP/")
        headers = _lines(body) if http else {}
        held = [] if http or not payloads else [first]
        while body.left and (piece := body.read(1 << 20)):
            if payloads:
                held.append(piece)
        if body.left:
            return
        named = {"record_id": "warc-record-id", "url": "warc-target-uri", "ts": "warc-date", "record_type": "warc-type", "profile": "warc-profile", "refers_to": "warc-refers-to"}
        yield {k: head.get(v) for k, v in named.items()} | {"headers": headers, "payload": b"".join(held) if payloads else None}


def read_warc(spark: SparkSession, path: str, rows_at_once: int = 200, payloads: bool = True) -> DataFrame:
    """The records of all .warc and .warc.gz files under path; a task streams its files, a few records at a time. Where
    pyarrow does not know the path's scheme, Spark reads the files (each then whole in memory)."""
    try:
        filesystem(path)
        columns = ["path"]
    except ValueError:
        columns = ["path", "content"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path).select(*columns)
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    kind = pa.schema([("record_id", text), ("url", text), ("ts", text), ("record_type", text), ("profile", text), ("refers_to", text), ("headers", pairs), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch["path"].to_pylist()):
                if len(columns) > 1:
                    raw = io.BytesIO(batch["content"][i].as_py())
                else:
                    fs, at = filesystem(name)
                    raw = fs.open_input_stream(at, compression=None)
                with raw:
                    f = io.BufferedReader(_Members(raw) if name.endswith(".gz") else raw)
                    block: list[dict] = []
                    size = 0
                    for record in parse_warc(f, payloads):
                        block.append(record | {"headers": list(record["headers"].items())})
                        size += len(record["payload"] or b"")
                        if len(block) == rows_at_once or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(block, kind)
                            block, size = [], 0
                    if block:
                        yield pa.RecordBatch.from_pylist(block, kind)

    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, RECORD)


def capture_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl that saw each page: a full response at 10 * page_id (not for every seventh), and a revisit 5
    later with an entity tag (of another version for every fifth), only a date (every eleventh) or no validator (every
    thirteenth). A null page_id gives records without a time."""
    n, body = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag, date = F.substring(F.md5(body), 1, 16), F.concat(F.lit("day "), F.pmod(n, F.lit(28)).cast("string"))
    pairs = lambda *kv: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]), lambda k, v: v.isNotNull())
    response = F.struct((n * 2).alias("record_id"), (n * 10).alias("ts"), F.lit("response").alias("record_type"), pairs("etag", tag, "last-modified", date, "content-type", "text/html", "content-length", F.length(body).cast("string")).alias("headers"))
    sent = F.when((n % 11 == 0) | (n % 13 == 0), None).when(n % 5 == 0, F.concat(F.lit("W/x"), tag)).otherwise(tag)
    revisit = F.struct((n * 2 + 1).alias("record_id"), (n * 10 + 5).alias("ts"), F.lit("revisit").alias("record_type"), pairs("etag", sent, "last-modified", F.when(n % 13 != 0, date), "date", (n * 10 + 5).cast("string"), "content-length", "0").alias("headers"))
    both = pages.select("url", F.explode(F.when(n % 7 == 0, F.array(revisit)).otherwise(F.array(response, revisit))).alias("r"))
    return both.select("r.record_id", "url", "r.ts", "r.record_type", "r.headers")


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    done = resolve_revisits(capture_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    line = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k))), "; ")
    return done.withColumn("headers", line)


ORACLE = {
    "op9_warc_revisits": r"""
WITH a AS (SELECT page_id AS n, url, coalesce(html, '') AS body, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw, list_filter(string_split(regexp_extract(regexp_extract(url, '^[^#]*'), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')) AS kept FROM a),
c AS (SELECT n, body, CASE WHEN url IS NOT NULL THEN translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url, substr(md5(body), 1, 16) AS tag, 'day ' || (n % 28) AS day FROM b),
resp AS (SELECT n * 2 AS record_id, url, n * 10 AS ts, tag, day, length(body) AS size FROM c WHERE n % 7 <> 0),
rev AS (SELECT n * 2 + 1 AS record_id, url, n * 10 + 5 AS ts, CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN NULL WHEN n % 5 = 0 THEN 'W/x' || tag ELSE tag END AS tag, CASE WHEN n % 13 <> 0 THEN day END AS day FROM c),
j AS (SELECT v.record_id, v.url, v.ts, v.tag, v.day, r.record_id AS rid, r.tag AS rtag, r.day AS rday, r.size FROM rev v ASOF LEFT JOIN resp r ON v.url = r.url AND v.ts >= r.ts),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = rtag THEN 'resolved' ELSE 'mismatch' END
        WHEN day IS NOT NULL THEN CASE WHEN day = rday THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM j)
SELECT record_id, url, ts, rid AS referred_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN 'content-length: ' || size || '; content-type: text/html; date: ' || ts || '; etag: ' || coalesce(tag, rtag) || '; last-modified: ' || coalesce(day, rday)
       ELSE concat_ws('; ', 'content-length: 0', 'date: ' || ts, 'etag: ' || tag, 'last-modified: ' || day) END AS headers FROM o""",
}
