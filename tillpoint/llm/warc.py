"""WARC archives: written with Spark's text writer, read by boundary-chain verification.

*Writing.*  One record per row; a record whose payload equals that of a smaller id is a
``revisit`` of it and holds no payload.  The text writer puts ``\\r\\n\\r\\n`` behind each
row, which is a record's end, so each part file is a plain WARC file and is committed
as any Spark output.

*Reading.*  The text reader cuts the files at the magic ``WARC/1.1\\r\\n``, so large files
are read by many tasks.  Every piece is a candidate record: its header's Content-Length
says where its successor must start.  A payload may hold the magic, so a candidate may
be false.  Within each split the candidates are laid out by byte offset and joined to
runs, in which each candidate's successor is the next one; the links between runs are
followed by pointer jumping from the start of each file, in a number of rounds that
grows with the logarithm of the runs.  Only records that are reached count; pieces in
between belong to the payload of the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillpoint.llm.io import drop, stash

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Bytes of a file in one bin of the range join.
BIN = 1 << 16
#: Digits of base 32 as ``conv`` writes them, and as RFC 4648 does.
_CONV32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits (10 hex digits, 8 of base 32) at a time."""
    digest = F.sha1(c)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _CONV32, _RFC32)


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html",
            min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload`` with the record's type, digest, size and, for revisits,
    the id that it refers to.  Payloads are equal when size and SHA-1 are.  A null
    payload is empty.  Rows without an id are responses."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = (pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
           .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
           .withColumn("payload_digest", sha1_base32(F.col("payload"))))
    digests = own.select("page_id", "payload_bytes", "payload_digest")
    first = (digests.where(f"page_id is not null and payload_bytes >= {min_revisit_bytes}")
             .groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    # repeated ids may have different payloads, so a revisit is known by all three;
    # only ids travel for the digests; written, so that its size is known and Spark does
    # not shuffle the payloads to meet a small table
    revisit, _ = stash(digests.join(first, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to")
               .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"),
                       "refers_to").distinct(), "revisits")
    same = ((own["page_id"] == revisit["_id"]) & (own["payload_digest"] == revisit["_digest"])
            & (own["payload_bytes"] == revisit["_bytes"]))
    return (own.join(revisit, same, "left").drop("_id", "_digest", "_bytes")
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **columns) -> None:
    """Write the archives under ``path``; arguments as for ``records``."""
    r = records(pages, **columns)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    text = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), optional("WARC-Target-URI", text(F.col("url"))),
        line("WARC-Date", F.lit(date)), optional("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        optional("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    r.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", GAP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between two magics, with its file, split, order and size in bytes."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("seq")))


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Per piece: where it starts, where its successor must, and its header's fields.
    The payload is digested where it is read and stays there."""
    end = F.instr(F.col("value"), GAP)
    size = F.col("length").try_cast("long")
    one = _pieces(spark, path).select(
        "file", "split", "seq", F.octet_length("value").cast("long").alias("bytes"), "value",
        F.when(end > 0, F.substring_index("value", GAP, 1)).alias("head"))
    two = one.select("*", F.octet_length("head").alias("head_bytes"), F.regexp_extract(
        "head", r"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$", 1).alias("length"))
    body = F.expr("substring(cast(value as binary), cast(head_bytes + 5 as int), try_cast(size as int))")
    three = two.withColumn("size", size)
    return three.select(
        "file", "split", "seq", "bytes", "head", "head_bytes", "size",
        # a body within its piece is digested here; one that holds the magic, later
        F.when(F.col("size") <= F.col("bytes") - F.col("head_bytes") - len(GAP), sha1_base32(body)).alias("digest"))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Byte offsets of the candidates.  Each split knows the sizes of its own pieces; the
    splits of a file follow one another.  A file's first piece is what stands before its
    first magic (nothing, in a sound file)."""
    step = len(MAGIC)
    inside = Window.partitionBy("file", "split").orderBy("seq")
    rows = rows.withColumn("within", F.sum(F.col("bytes") + step).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    whole = rows.groupBy("file", "split").agg(F.sum(F.col("bytes") + step).alias("span"))
    before = whole.select("file", "split", F.coalesce(
        F.sum("span").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("base"))
    # a piece begins behind its magic; the record begins with the magic itself
    return (rows.join(before, ["file", "split"])
            .withColumn("start", F.col("base") + F.coalesce("within", F.lit(0)) - step)
            .withColumn("next", F.try_add(F.col("start") + step + F.col("head_bytes") + 2 * len(GAP), F.col("size")))
            .drop("base", "within"))


def reachable(candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates(file, split, start, next)`` that the chain of successors
    reaches from the start of their file (offset 0)."""
    inside = Window.partitionBy("file", "split").orderBy("start")
    broken = F.coalesce((F.lag("next").over(inside) != F.col("start")).cast("int"), F.lit(1))
    runs = candidates.withColumn("broken", broken).withColumn(
        "run", F.struct("split", F.sum("broken").over(inside).alias("k")))
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "start").alias("next"))
    # where a run leads to: a run, and the offset at which it is entered
    heads = runs.select("file", F.col("run").alias("to"), F.col("start").alias("next"))
    jump = ends.join(heads, ["file", "next"]).select("file", "run", "to", F.col("next").alias("entry"))
    spark = candidates.sparkSession
    jump, jump_at = stash(jump, "jump")
    reach = runs.where("start = 0").select("file", F.col("run").alias("to"), F.col("start").alias("entry"))
    reach, reach_at = stash(reach, "reach")
    count = 0
    while True:
        far = (reach.select("file", F.col("to").alias("run")).join(jump, ["file", "run"]).select("file", "to", "entry"))
        # a run may be entered at several places only by false candidates' links; the
        # chain from the file's start enters it once
        new, new_at = stash(reach.union(far).distinct(), "reach")
        now = new.count()
        drop(spark, reach_at)
        reach, reach_at = new, new_at
        if now == count:
            break
        count = now
        over = jump.select("file", F.col("to").alias("run"), F.col("run").alias("from"))
        twice, twice_at = stash(over.join(jump, ["file", "run"]).select("file", F.col("from").alias("run"), "to", "entry"), "jump")
        drop(spark, jump_at)
        jump, jump_at = twice, twice_at
    return (runs.join(reach.select("file", F.col("to").alias("run"), "entry"), ["file", "run"])
            .where("start >= entry").drop("broken", "run", "entry"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file, offset, record_type, target_uri, record_id, refers_to,
    payload_digest, payload_length, block_bytes, block_digest``.

    ``block_digest`` is computed from the bytes read.  A file without a record, or whose
    start is damaged, gives no rows; a chain ends at the first record without a valid
    Content-Length."""
    all_rows, _ = stash(_laid_out(_candidates(spark, path)), "candidates")
    chain, _ = stash(reachable(all_rows.where("next is not null")), "chain")
    # records whose payload holds the magic lie over several pieces
    long = chain.where("digest is null").select("file", F.col("start").alias("rec"), F.col("next").alias("end"), "head_bytes", "size")
    # range join over bins of the file, so that a file is not one group
    bins = long.select("file", "rec", "end", F.explode(F.expr(f"sequence(rec div {BIN}, end div {BIN})")).alias("bin"))
    spots, _ = stash(all_rows.select("file", "split", "seq", "start", F.expr(f"start div {BIN}").alias("bin"))
             .join(bins, ["file", "bin"]).where("start >= rec and start < end").drop("bin", "end"), "spots")
    blocks = (_pieces(spark, path).join(spots, ["file", "split", "seq"])
              .groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
              .join(long, ["file", "rec"])
              .select("file", F.col("rec").alias("start"), sha1_base32(F.expr(
                  f"substring(cast(array_join(transform(parts, p -> p.value), '{MAGIC}') as binary), "
                  "cast(head_bytes + 5 as int), try_cast(size as int))")).alias("long_digest")))
    head = F.col("head")
    return (chain.join(blocks, ["file", "start"], "left").select(
        "file", F.col("start").alias("offset"), _field(head, "WARC-Type").alias("record_type"),
        _field(head, "WARC-Target-URI").alias("target_uri"), _field(head, "WARC-Record-ID").alias("record_id"),
        _field(head, "WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field(head, "X-Payload-Length").cast("long").alias("payload_length"),
        F.col("size").alias("block_bytes"), F.coalesce("digest", "long_digest").alias("block_digest")))


def round_trip(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and read them back, one row per page.

    Payload size and digest of a response come from the bytes read back; a revisit has
    those that its record names.  Null payloads are empty.  Rows without an id come back
    without one, as responses.  Empty input gives no rows."""
    kind = pages.schema[columns.get("id", "page_id")].dataType
    write_warc(pages, path, **columns)
    spark = pages.sparkSession
    if not spark.read.text(path, wholetext=False).limit(1).count():
        return spark.createDataFrame([], f"page_id {kind.simpleString()}, payload_bytes bigint, payload_digest string, "
                                         f"record_type string, refers_to {kind.simpleString()}")
    own = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        F.when(F.col("record_id").isNotNull(), own("record_id")).cast(kind).alias("page_id"),
        F.when(response, F.col("block_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("block_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), own("refers_to")).cast(kind).alias("refers_to"))
