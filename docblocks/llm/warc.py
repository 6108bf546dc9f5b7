"""Op 13: WARC archives, written from pages and read back as assembled transactions.

Every page becomes three records: a request, a response (or a revisit, which refers to the response
of an equal payload and holds its HTTP headers only) and a metadata record with the page's id. The
request and the metadata name the response as concurrent. Spark's text source writes the records with
the blank lines that end each of them between, so an archive has Spark's commit protocol: a task
that runs again leaves no second copy. With ``compression`` a file is one gzip stream.

Archives of any writer are read by the same source, cut at ``WARC/1.``, which never overlaps itself;
plain files are split like any text, compressed ones are streams, and a row is a record. A payload
may hold that mark: where a record's length says that it goes on, the pieces of its file are measured
in order (lengths only) and those that belong together are joined.

``captures`` resolves links between records, by concurrent-to identifiers in either direction and over one
record between, to the response, revisit or resource they lead to, and gives one nested row for each
capture. A capture without such a record is named by its least id.

Which page of equal payloads is the response is decided by a pre-aggregated count of digests. Pages
meet that table by digest; digests and identifiers that many rows share are broadcast, and there are
at most ``tables.HOT`` of them whatever the input (``tables.lookup``).

Results for odd inputs: a null payload is empty; a null id is written as none and comes last among
equals; rows that repeat id, address and payload are one capture, written as often and given as often;
a null address is about:blank, control characters and spaces in it are encoded; an empty table gives an
archive without records; further columns are not looked at. Records without a valid head are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lookup, shared_folder, stored

#: Payloads below this many bytes are always written whole.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
MARK, END = "WARC/1.", "\r\n\r\n"
PRIMARY = ("response", "revisit", "resource", "conversion")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def urn(*parts: Column) -> Column:
    """A record identifier that these parts decide."""
    h = F.md5(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("\1")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, name: Column, uri: Column, block: Column, content_type: str, date: str, extra: list[tuple[str, Column]]) -> Column:
    """A whole record but for the two line ends behind it; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *extra, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")), F.lit("")) for n, v in fields]
    return F.concat(F.lit(f"{MARK}0\r\n"), *lines, F.lit("\r\n"), block)


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, n, first): every page with the (id, url) of the response of its payload, null where it is alone."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.nullif(F.col(url_col).cast("string"), F.lit("")), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "n": F.octet_length("payload").cast("long")})
    spark = pages.sparkSession
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "url")
    equal = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return lookup(rows, stored(equal, shared_folder(spark), "equal"), "digest", "copies")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str = DATE, compression: str = "gzip", records_per_file: int = 0) -> None:
    """Write the archive of ``pages`` into the folder ``path``."""
    rows = decided(pages, id_col, url_col, payload_col, least)
    response = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("url") == F.col("first.url")))
    rows = rows.withColumns(
        {
            "name": urn(F.lit("capture"), F.col("id"), F.col("url"), F.col("digest")),
            "response": response,
            "origin": F.when(~response, urn(F.lit("capture"), F.col("first.id"), F.col("first.url"), F.col("digest"))),
            "host": F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1),
            "target": F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*(/[^#]*)", 1),
        }
    )
    name, uri = F.col("name"), F.col("url")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    get = F.concat(F.lit("GET "), F.when(F.col("target") == "", "/").otherwise(F.col("target")), F.lit(" HTTP/1.1\r\nHost: "), F.col("host"), F.lit(END))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.url_encode(F.col("id").cast("string")), F.lit("\r\n")), F.lit(""))
    with_response = ("WARC-Concurrent-To", name)
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    block = F.when(F.col("response"), F.concat(http, F.col("payload"))).otherwise(http)
    profile = ("WARC-Profile", F.when(~F.col("response"), F.lit(PROFILE)))
    records = F.array(
        _record("request", urn(F.lit("request"), name), uri, get, "application/http; msgtype=request", date, [with_response]),
        _record(kind, name, uri, block, "application/http; msgtype=response", date, [digest, ("WARC-Refers-To", F.col("origin")), profile]),
        _record("metadata", urn(F.lit("metadata"), name), uri, about, "application/warc-fields", date, [with_response]),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.mode("overwrite").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(pieces: DataFrame) -> DataFrame:
    """``pieces`` (value binary) with ``head`` (null if it has no valid one), ``at`` where its block begins and ``length`` of the block."""
    head = F.substring_index(F.col("value").cast("string"), END, 1)
    rows = pieces.withColumn("head", head)
    length = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    valid = F.col("head").rlike(r"^\d\r\n") & (length != "")
    return rows.select(*pieces.columns, F.when(valid, F.col("head")).alias("head"), (F.octet_length("head") + 4).cast("long").alias("at"), F.when(valid, length.cast("long")).alias("length"))


def _owners(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one file's pieces in order: which record each belongs to, by lengths alone."""
    rows = rows.sort_values(["start", "row"])
    owners, owner, left = [], None, 0
    for row, size, needs in zip(rows["row"], rows["size"], rows["needs"], strict=True):
        if left > 0:
            left -= size + len(MARK)
        else:
            owner, left = row, (0 if pd.isna(needs) else needs - size)
        owners.append(owner)
    return pd.DataFrame({"path": rows["path"].values, "row": rows["row"].values, "owner": pd.Series(owners, dtype="int64").values})


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, concurrent_to, refers_to, uri, date, payload_digest, http, payload): the records of the archives under ``path``.

    ``http`` is the head of an HTTP block, ``payload`` what follows it, or the whole block where there is none.
    """
    raw = spark.read.option("lineSep", MARK).text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    found = _parsed(pieces)
    size = F.octet_length("value").cast("long")
    folder = shared_folder(spark)
    cut = stored(found.where(F.col("at") + F.col("length") > size).select("path").distinct(), folder, "cut")
    if not cut.isEmpty():
        # all pieces of the files in which a record goes on behind a mark, each with the record that it belongs to
        some = stored(pieces.join(cut, "path", "left_semi"), folder, "pieces")
        sizes = _parsed(some).select("path", "start", "row", size.alias("size"), (F.col("at") + F.col("length")).alias("needs"))
        owners = stored(sizes.groupBy("path").applyInPandas(_owners, "path string, row long, owner long"), folder, "owners")
        parts = some.join(owners, ["path", "row"]).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "row", F.col("value").cast("string").alias("text")))).alias("x"))
        whole = parts.select(F.array_join("x.text", MARK).cast("binary").alias("value"))
        found = _parsed(pieces.join(cut, "path", "left_anti").select("value").union(whole))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    block = F.substring(F.col("value"), F.col("at").cast("int") + 1, F.col("length").cast("int"))
    rows = found.where(F.col("head").isNotNull()).select("head", block.alias("block"))
    is_http = F.coalesce(field("Content-Type").startswith("application/http"), F.lit(False))
    http = F.when(is_http, F.substring_index(F.col("block").cast("string"), END, 1))
    rows = rows.select("head", "block", http.alias("http"))
    rest = F.substring(F.col("block"), F.coalesce(F.octet_length("http") + 4, F.lit(0)).cast("int") + 1, F.octet_length("block"))
    links = F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*(\S+)[ \t]*\r?$"), F.lit(1))
    named = [("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("payload_digest", "WARC-Payload-Digest")]
    return rows.select(*[field(n).alias(c) for c, n in named], F.lower(field("WARC-Type")).alias("kind"), links.alias("concurrent_to"), "http", rest.alias("payload"))


def anchors(heads: DataFrame) -> DataFrame:
    """(record_id, capture): the primary record that every record leads to, directly or over one other record, else its group's least id."""
    kept = heads.select("record_id", F.col("kind").isin(*PRIMARY).alias("primary"), "concurrent_to").distinct()
    links = kept.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = links.union(links.select("b", "a")).distinct()
    main = kept.where("primary").select(F.col("record_id").alias("m"))
    others = kept.where(~F.col("primary")).select(F.col("record_id").alias("a"))
    near = links.join(main, F.col("b") == F.col("m")).join(others, "a", "left_semi").groupBy("a").agg(F.min("m").alias("capture"))
    left = others.join(near, "a", "left_anti")
    over = left.join(links, "a").join(near.select(F.col("a").alias("n"), "capture"), F.col("b") == F.col("n")).groupBy("a").agg(F.min("capture").alias("capture"))
    alone = left.join(over, "a", "left_anti").join(links, "a", "left").groupBy("a").agg(F.least(F.col("a"), F.coalesce(F.min("b"), F.col("a"))).alias("capture"))
    return main.select("m", "m").union(near).union(over).union(alone).toDF("record_id", "capture")


def captures(heads: DataFrame) -> DataFrame:
    """(capture, copies, response, request, metadata): one nested row for each capture of a table of records.

    Every column of ``heads`` but the links is a field of its record. A record is never multiplied: the groups are aggregated, not joined.
    """
    fields = F.struct(*[c for c in heads.columns if c != "concurrent_to"])
    found = heads.join(anchors(heads).withColumnsRenamed({"record_id": "r"}), F.col("record_id") == F.col("r"))
    part = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), fields))
    return found.groupBy("capture").agg(
        F.greatest(F.count_if(F.col("kind").isin(*PRIMARY)), F.lit(1)).alias("copies"), part(*PRIMARY).alias("response"), part("request").alias("request"), part("metadata").alias("metadata")
    )


def pages_of(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, payload_bytes, payload_digest, kind, refers_to): one row for each page of the archives under ``path``.

    A response is measured by its own payload; a revisit says its length and digest, and its reference is resolved to the response's page.
    """
    folder = shared_folder(spark)
    whole = F.col("kind") != "revisit"
    said = F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    id_text = F.when(F.col("kind") == "metadata", F.nullif(F.regexp_extract(F.col("payload").cast("string"), r"(?m)^page-id: (.*?)\r?$", 1), F.lit("")))
    narrow = records(spark, path).select(
        "record_id", "kind", "concurrent_to", "refers_to",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.nullif(said, F.lit("")).cast("long")).alias("n_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("digest"),
        F.url_decode(id_text).cast(id_type).alias("id"),
    )
    found = captures(stored(narrow, folder, "heads")).where(F.col("response").isNotNull())
    found = found.select("capture", "copies", F.col("metadata.id").alias("id"), F.col("response.n_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("kind"), F.col("response.refers_to").alias("origin"))
    found = stored(found, folder, "captures")
    asked = found.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.sum("copies").alias("times"))
    origins = stored(found.select(F.col("capture").alias("origin"), F.col("id").alias("refers_to")).join(asked, "origin"), folder, "origins")
    linked = lookup(found, origins, "origin", "times")
    return linked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("id", "payload_bytes", "payload_digest", "kind", "refers_to")
