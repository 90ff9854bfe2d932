"""WARC archives: one record a page, and a reader that trusts only records chained from the start of a file.

A payload may hold whole WARC records of its own, so the magic line alone proves nothing.  The reader cuts files at
every magic line in parallel, whatever their size; each cut is a candidate that names its successor by its length;
tasks shorten the chains inside a block of a file to where they leave it, pointer jumping joins the blocks, and what
the start of the file does not reach is payload.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.llm.common import read, shared_dir, stage

#: No proper prefix of the magic line ends it, so cuts never overlap.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are stored each time.
SHARED_BYTES = 1000
#: Shared payloads (a digest and an id each, some 60 bytes) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:page:"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def _one_line(url: Column) -> Column:
    """A url that cannot end its header line, nor end it like the magic line."""
    cut = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(cut, "0$", "%30")


def shared_payloads(pages: DataFrame, least: int = SHARED_BYTES) -> DataFrame:
    """digest, refers_to: payloads of at least ``least`` bytes that stand under several ids, with the largest id."""
    body = _payload(F.col("html"))
    same = pages.where(F.octet_length(body) >= least).groupBy(F.sha1(body).alias("digest"))
    known = same.agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.max(F.isnull("page_id")).alias("unnamed"))
    return known.where("refers_to <> least or refers_to is not null and unnamed").select("digest", "refers_to")


def warc_records(pages: DataFrame, least: int = SHARED_BYTES, date: str = DATE) -> DataFrame:
    """One column, ``value``: the record of each page without the two line ends that close it.

    Of pages with equal payloads of at least ``least`` bytes the one of the largest page_id is a response, as are rows
    repeated under that id; the others, null ids too, are revisits without payload.  Payloads stay where they are read
    while the shared ones are few; hot payloads are dealt by salt otherwise.
    """
    body = _payload(F.col("html"))
    shared = stage(shared_payloads(pages, least), "shared")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest"))
    if shared.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared), "digest", "left")
    else:
        shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "salt"], "left")
    revisit = F.col("refers_to").isNotNull() & (F.octet_length("body") >= least) & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return rows.select(F.concat(F.lit(MAGIC), head, F.lit(END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, least: int = SHARED_BYTES) -> None:
    """Write an archive file a task to ``path``; a task that is run again writes its file anew."""
    warc_records(pages, least).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, size, block, k, value: what lies between magic lines, in the order of ``k`` inside a block; blocks are Spark's own splits."""
    cuts = spark.read.option("lineSep", MAGIC).text(path)
    return cuts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("k"),
        F.col("value"),
    )


def _placed(cuts: DataFrame) -> DataFrame:
    """``cuts`` with ``at``, the first byte of a segment in its file: what its block holds before it, and the blocks before.

    Windows hold one block of a file, or one row for each block.
    """
    cuts = cuts.withColumn("taken", F.lit(len(MAGIC)) + F.col("bytes"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cuts.groupBy("file", "block").agg(F.sum("taken").alias("held"))
    blocks = blocks.select("file", "block", ahead("held", Window.partitionBy("file").orderBy("block")).alias("before"))
    inside = cuts.withColumn("inside", ahead("taken", Window.partitionBy("file", "block").orderBy("k")))
    return inside.join(blocks, ["file", "block"]).withColumn("at", F.col("before") + F.col("inside")).drop("before", "inside", "taken")


def _field(head: Column, name: str, what: str = "([^\\r\\n]*)") -> Column:
    found = F.regexp_extract(head, f"(?im)^{name}:[ \\t]*{what}[ \\t]*\\r?$", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> list[Column]:
    """What a segment says if a record starts with it."""
    head = F.when(F.contains(value, F.lit(END)), F.substring_index(value, END, 1))
    return [
        (F.octet_length(head) + len(END)).cast("long").alias("head_bytes"),
        F.try_to_number(F.substring(_field(head, "Content-Length", "([0-9]+)"), 1, 19), F.lit("9" * 19)).cast("long").alias("block_bytes"),
        F.lower(_field(head, "WARC-Type")).alias("record_type"),
        _field(head, "WARC-Record-ID", f"<{_URN}(-?[0-9]+)>").cast("long").alias("page_id"),
        _field(head, "WARC-Refers-To", f"<{_URN}(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.lower(_field(head, "WARC-Payload-Digest", "sha1:([0-9A-Fa-f]{40})")).alias("stated"),
    ]


def _body(block: Column) -> list[Column]:
    """Of an HTTP block: the length that its head states, its payload's length and digest."""
    text = block.cast("string")
    head = F.substring_index(text, END, 1)
    payload = F.substr(block, (F.octet_length(head) + len(END) + 1).cast("int"))
    return [
        _field(head, "Content-Length", "([0-9]+)").cast("long").alias("http_bytes"),
        F.octet_length(payload).cast("long").alias("body_bytes"),
        F.sha1(payload).alias("digest"),
    ]


_EXITS = "file string, block long, at long, next long, exit long"


def _contracted(b: pa.Table) -> pa.Table:
    """For the candidates of a block: the first successor beyond the block, by pointer jumping; null where the chain breaks off."""
    at, order = np.array(b.column("at")), np.argsort(np.array(b.column("at")))
    at = at[order]
    exits = np.array(b.column("next").fill_null(-1))[order]
    last = at[-1]
    for _ in range(len(at).bit_length() + 1):
        inside = (exits >= 0) & (exits <= last)
        if not inside.any():
            break
        to = np.searchsorted(at, exits[inside])
        exits[inside] = np.where(at[to] == exits[inside], exits[to], -1)
    nulls = exits < 0
    b = b.take(pa.array(order))
    return pa.table([b.column("file"), b.column("block"), b.column("at"), b.column("next"), pa.array(exits, mask=nulls)], ["file", "block", "at", "next", "exit"])


_WALKED = "file string, at long"


def _walked(b: pa.Table) -> pa.Table:
    """The candidates of a block that its entry reaches."""
    at = np.array(b.column("at"))
    to = dict(zip(at.tolist(), b.column("next").to_pylist(), strict=True))
    here, found = b.column("entry")[0].as_py(), []
    while here in to:
        found.append(here)
        here = to[here]
    return pa.table([pa.array([b.column("file")[0].as_py()] * len(found), pa.string()), pa.array(found, pa.int64())], ["file", "at"])


def reachable(links: DataFrame) -> DataFrame:
    """file, at: the candidates (file, block, at, next) that a record at the first byte of their file reaches.

    Inside a block chains are shortened in one task; from block to block pointers double, so a file of n blocks takes about
    log2(n) rounds of joins.  A block has one entry at most.
    """
    marked = stage(links.groupBy("file", "block").applyInArrow(_contracted, _EXITS), "exits")
    jumps = marked.where("exit is not null").select("file", "at", F.col("exit").alias("to"))
    reached = stage(marked.where(F.col("at") == len(MAGIC)).select("file", "at"), "entries")
    known = -1
    while (now := reached.count()) != known:
        if known >= 0:
            onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
            jumps = stage(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "jumps")
        known = now
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stage(reached.unionByName(more).distinct(), "entries")
    entries = marked.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    return marked.join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(_walked, _WALKED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed archives under ``path``: file, at, record_type, page_id, refers_to, stated, http_bytes, body_bytes, digest, last.

    ``at`` is the first byte after the record's magic line, ``last`` tells whether the record ends with its file; a file
    whose chain breaks off has records up to there and none that is last.  A record whose payload holds magic lines is put
    together again from its segments, which are read a second time, so memory holds one record.  A file that does not
    begin with the magic line has no records; an empty folder gives an empty result.
    """
    cuts = _segments(spark, path)
    length = F.octet_length("value").cast("long")
    cuts = cuts.select("file", "size", "block", "k", length.alias("bytes"), "value", *_parsed(F.col("value")))
    whole = F.col("bytes") == F.col("head_bytes") + F.col("block_bytes") + len(END)
    block = F.substring(F.col("value").cast("binary"), F.col("head_bytes").cast("int") + 1, F.col("block_bytes").cast("int"))
    cuts = cuts.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("http", F.when(F.col("whole"), block))
    heads = stage(_placed(cuts.select("*", *_body(F.col("http"))).drop("value", "http")), "segments")
    after = F.col("at") + F.col("head_bytes") + F.col("block_bytes") + len(END) + len(MAGIC)
    links = heads.where("head_bytes is not null and block_bytes is not null and at > 0").select("file", "block", "at", after.alias("next"))
    records = stage(heads.join(reachable(links), ["file", "at"]), "records")
    out = records.withColumn("last", after - len(MAGIC) == F.col("size"))
    columns = ["file", "at", "record_type", "page_id", "refers_to", "stated", "http_bytes", "body_bytes", "digest", "last"]
    cut = out.where("not whole").drop("http_bytes", "body_bytes", "digest", "bytes")
    if cut.isEmpty():
        return out.select(columns)
    return out.where("whole").select(columns).unionByName(_rebuilt(spark, path, heads, records, cut).select(columns))


def _rebuilt(spark: SparkSession, path: str, heads: DataFrame, records: DataFrame, cut: DataFrame) -> DataFrame:
    """``cut`` with its bodies: a segment belongs to the last record that starts at or before it; the window holds one file."""
    torn = heads.select("file", "block", "k", "bytes", "at").join(cut.select("file").distinct(), "file", "left_semi")
    marked = torn.join(records.select("file", "at", F.col("at").alias("start")), ["file", "at"], "left")
    owner = F.last("start", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    wanted = marked.withColumn("start", owner).join(cut.select("file", F.col("at").alias("start")), ["file", "start"], "left_semi")
    again = _segments(spark, path).withColumn("bytes", F.octet_length("value").cast("long")).drop("size")
    pieces = again.join(stage(wanted, "pieces"), ["file", "block", "k", "bytes"])
    texts = pieces.groupBy("file", F.col("start").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("held"))
    text = F.array_join(F.transform("held", lambda h: h["value"]), MAGIC).cast("binary")
    block = F.substring(text, F.col("head_bytes").cast("int") + 1, F.col("block_bytes").cast("int"))
    return texts.join(cut, ["file", "at"]).withColumn("http", block).select("*", *_body(F.col("http")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the archives written from all pages, their html as payload.

    A null html is an empty payload; null urls have no target line, null ids an empty one, and other columns are ignored; of
    equal payloads of 1000 bytes or more the largest id's is the response, rows repeated under it too, null ids never unless
    all are null; payloads may hold records and magic lines and are read whole; an empty table gives an empty result.
    """
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(read(spark, sf_dir, "pages"), path)
    revisit = F.col("record_type") == "revisit"
    return read_warc(spark, path).select(
        "page_id",
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::bigint AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
