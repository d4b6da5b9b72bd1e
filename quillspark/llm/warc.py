"""WARC archives of captures in global order of URL key and time.

Each input run sorts its captures by URL key (host reversed, then path), time and page, and
cuts the run at shared range bounds. A range holds about ``RANGE_BYTES`` of payload, more only
where there would be over ``MAX_RANGES`` bounds to send. For each range the sorted runs meet in
one k-way loser-tree merge, which reads them as streams of small packed frames and writes the
range's archive records in order: gzip members, one a record. Ranges are dealt to tasks in
order, and a task's files are numbered, so archives in order of name give every URL's capture
history. A hot host is cut by path, time and page like any other keys. The pages have no
time of their own; a page's id stands for the seconds since ``EPOCH``.

Of captures with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page is the response and the others are revisits of it; smaller payloads are all responses.

Defined cases: null html: empty payload. Null or malformed URL: kept as it is, with the key
it gives. A null page id: the row is left out. Rows that repeat an id: the smallest
(url, html) stays. Empty table: no archives, empty result. Other input columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import marshal
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.blobs import read_blobs, write_blobs
from quillspark.llm.merging import LoserTree

MIN_REVISIT = 100
#: A range's archive is cut into pieces of about this many bytes; payload of a range, bounds at
#: most; payload of a run, and bytes of one of its frames.
PIECE, RANGE_BYTES, MAX_RANGES = 8 << 20, 16 << 20, 1 << 18
RUN_BYTES, FRAME = 8 << 20, 128 << 10
#: What a record has besides its payload, about.
HEAD = 512
EPOCH = datetime.datetime(2024, 1, 1)
ROW = ["urlkey", "ts", "page_id", "url", "html", "digest"]


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then ``)`` and the lower-cased rest."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r":\d+$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ","), F.lit(")"), rest)


def captures(pages: DataFrame) -> DataFrame:
    """Pages with URL key, time, payload digest, and for revisits the response's page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.struct(F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).alias("x"))
    p = scratch.one_row_per_id(p, "page_id").select("page_id", "x.url", "x.html")
    return p.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), url_key(F.col("url")).alias("urlkey"), F.col("page_id").alias("ts"))


def responses(index: DataFrame) -> DataFrame:
    """(digest, original): the smallest page of each payload that comes again, from (page_id,
    digest, size)."""
    big = index.filter(F.col("size") >= MIN_REVISIT)
    return big.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")


def _bounds(size: int):
    """First keys of stretches of about ``size`` bytes of a sorted partition."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = size
        for pdf in batches:
            out = []
            for key in zip(pdf["urlkey"].tolist(), pdf["ts"].tolist(), pdf["page_id"].tolist(), pdf["size"].tolist()):
                if held >= size:
                    out.append(key[:3])
                    held = 0
                held += key[3] + HEAD
            yield pd.DataFrame(out, columns=["urlkey", "ts", "page_id"])

    return f


def range_bounds(index: DataFrame) -> list[tuple]:
    """Keys at which ranges begin, but for the first range; at most about MAX_RANGES of them."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum(F.col("size") + HEAD), F.lit(0))).first()[0]
    key = ["urlkey", "ts", "page_id"]
    some = index.select(*key, "size").repartitionByRange(scratch.parts(spark), *key).sortWithinPartitions(*key)
    firsts = some.mapInPandas(_bounds(max(RANGE_BYTES, total // MAX_RANGES)), "urlkey string, ts long, page_id long")
    return sorted((r.urlkey, r.ts, r.page_id) for r in firsts.collect())[1:]  # bounded by MAX_RANGES


def _packed(rows: list[tuple]) -> bytes:
    """Rows in frames of about FRAME bytes, each packed by itself."""
    out, held, size = [], [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 32
        if size >= FRAME:
            out.append(zlib.compress(marshal.dumps(held), 1))
            held, size = [], 0
    if held:
        out.append(zlib.compress(marshal.dumps(held), 1))
    return b"".join(len(x).to_bytes(4, "little") + x for x in out)


def _unpacked(run: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(run):
        n = int.from_bytes(run[at : at + 4], "little")
        yield from marshal.loads(zlib.decompress(run[at + 4 : at + 4 + n]))
        at += 4 + n


def _runs(bounds, tasks: int, kind: int, columns: list[str]):
    """Sorted runs of ``columns`` (among them the key), cut at the broadcast bounds."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = bounds.value

        def cut(held: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(held).sort_values(["urlkey", "ts", "page_id"], ignore_index=True)
            keys = zip(pdf["urlkey"].tolist(), pdf["ts"].tolist(), pdf["page_id"].tolist())
            pdf.insert(0, "range_id", [bisect.bisect_right(cuts, k) for k in keys])
            out = []
            for r, block in pdf.groupby("range_id", sort=True):
                out.append((r * tasks // (len(cuts) + 1), r, kind, _packed(list(zip(*(block[c].tolist() for c in columns))))))
            return pd.DataFrame(out, columns=["task", "range_id", "kind", "run"])

        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += int(pdf["html"].str.len().sum()) if "html" in pdf else 32 * len(pdf)
            if size >= RUN_BYTES:
                yield cut(held)
                held, size = [], 0
        if sum(map(len, held)):
            yield cut(held)

    return f


def record(page_id: int, url: str | None, ts: int, payload: bytes, digest: str, original: int | None) -> bytes:
    when = (EPOCH + datetime.timedelta(seconds=ts % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = original is not None and original != page_id
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {when}",
            f"WARC-Target-URI: {'' if url is None else quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


#: Kinds of runs: which pages are revisits of which, and captures.
REVISITS, CAPTURES = 0, 1


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range, each a sorted run. One range's runs are merged at a time."""

    def merged(original: dict[int, int], runs: list[bytes]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for _, ts, page, url, html, digest in LoserTree(map(_unpacked, runs)):
            out.append(record(page, url, ts, html.encode("utf-8", "surrogatepass"), digest, original.get(page)))
            size += len(out[-1])
            if size >= PIECE:
                yield pd.DataFrame({"blob": [b"".join(out)]})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"blob": [b"".join(out)]})

    now, original, held = None, {}, []
    for pdf in batches:
        for r, kind, run in zip(pdf["range_id"].tolist(), pdf["kind"].tolist(), pdf["run"]):
            if now is not None and r != now:
                yield from merged(original, held)
                original, held = {}, []
            now = r
            if kind == REVISITS:
                original.update((page, first) for *_, page, first in _unpacked(run))
            else:
                held.append(run)
    if held:
        yield from merged(original, held)


def write_archives(pages: DataFrame, out: str) -> None:
    """Archives of ``pages`` in files under ``out``; in order of name they are in global order."""
    spark = pages.sparkSession
    scratch.small_batches(spark)
    caps = captures(pages)
    # bounds, and who revisits whom, are settled on the index alone; payloads cross once
    index = scratch.stage(caps.select("urlkey", "ts", "page_id", "digest", F.octet_length("html").cast("long").alias("size")), "index")
    cuts = range_bounds(index)
    bounds, tasks = spark.sparkContext.broadcast(cuts), max(1, min(len(cuts) + 1, 4 * scratch.parts(spark, pages)))
    again = index.filter(F.col("size") >= MIN_REVISIT).join(scratch.stage(responses(index), "responses"), "digest").filter("page_id <> original").select("urlkey", "ts", "page_id", "original")
    schema = "task int, range_id int, kind int, run binary"
    runs = caps.select(*ROW).mapInPandas(_runs(bounds, tasks, CAPTURES, ROW), schema).unionByName(again.mapInPandas(_runs(bounds, tasks, REVISITS, ["page_id", "original"]), schema))
    blobs = runs.repartitionById(tasks, "task").sortWithinPartitions("range_id", "kind").mapInPandas(_merge, "blob binary")
    write_blobs(blobs, "blob", out)


def records(content: bytes, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the gzip members of an archive file."""
    at = 0
    while at < len(content):
        if content[at] == 0x0A:  # after a piece
            at += 1
            continue
        d, data = zlib.decompressobj(31), []
        while not d.eof and at < len(content):
            chunk = content[at : at + step]
            data.append(d.decompress(chunk))
            at += len(chunk) - len(d.unused_data)
        if not d.eof:
            raise ValueError("an archive record is cut off")
        head, _, body = b"".join(data).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "position", "page_id", "url", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            for k, (f, body) in enumerate(records(content)):
                page, digest = int(f["WARC-Record-ID"][10:-1]), f["WARC-Payload-Digest"][7:]
                if f["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f["X-Payload-Length"])):
                    raise ValueError(f"the payload of page {page} is not what its record says")
                refers = f.get("WARC-Refers-To")
                out.append((path, k, page, unquote(f["WARC-Target-URI"]), f["WARC-Date"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], int(refers[10:-1]) if refers else None, body if not refers else None))
                if len(out) >= 500:
                    yield _frame(out, names)
                    out = []
            yield _frame(out, names)


def _frame(out: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=names).astype({"refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record, in the order (path, position); a revisit's html is null."""
    return read_blobs(spark, path).mapInPandas(_read, "path string, position long, page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    out = scratch.new_dir(spark, "warc")
    write_archives(scratch.table(spark, sf_dir, "pages"), out)
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM m"""
