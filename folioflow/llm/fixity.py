"""Fixity audit of WARC replicas by Merkle trees over records and ordered ranges of offsets.

A record's digest is the SHA-256 of its bytes. Records whose offset lies in one range of RANGE_BYTES make a node of level 1, FAN
neighbouring nodes one of the next level, up to one root for each archive; a node's digest is that of its children's numbers and
digests in order. Two replicas' roots are compared first, and from each level only the children of nodes that differ are looked at,
down to the records. Record bytes are read once and never shuffled: only digests are.

Cases: a null payload is an empty record, a null archive the archive -1, a null offset the offset -1; records repeated at one place make one leaf with their number,
and differ from one copy of it; an archive or a range that one replica lacks is followed to its records; two empty replicas have
no differences; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

RANGE_BYTES, FAN = 1 << 16, 16
#: Records of one archive file, as of web crawls: about a gigabyte of pages.
ARCHIVE_RECORDS = 1024
#: Parts that the digests of one id are cut into, and deals of equal records of one id.
PARTS, DEALS = 4096, 64


@dataclass
class Tree:
    """levels[0]: leaves (archive, no = offset, digest, length); levels[k]: nodes (archive, no, digest)."""

    levels: list[DataFrame]


def leaves(records: DataFrame) -> DataFrame:
    """records (archive, offset, length, digest) as leaves; records at one place make one leaf, in the order of their digests."""
    keyed = records.select(F.coalesce(F.col("archive").cast("long"), F.lit(-1)).alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("no"), "digest", F.col("length").cast("long").alias("length"))
    once = keyed.groupBy("archive", "no", "digest").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    whole = F.when((F.count("*") == 1) & (F.max("n") == 1), F.min("digest")).otherwise(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "digest", "n"))), ","), 256))
    return once.groupBy("archive", "no").agg(whole.alias("digest"), F.max("length").alias("length"))


def above(nodes: DataFrame, width: int) -> DataFrame:
    """The nodes over runs of `width` numbers."""
    children = F.sort_array(F.collect_list(F.struct("no", "digest")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["no"], c["digest"])), ",")
    return nodes.groupBy("archive", F.expr(f"no div {width}").alias("parent")).agg(F.sha2(text, 256).alias("digest")).withColumnRenamed("parent", "no")


def build(records: DataFrame, depth: int, scratch: Scratch) -> Tree:
    """The tree of records (archive, offset, length, digest) with `depth` levels over the leaves."""
    levels = [scratch.keep(leaves(records))]
    for k in range(depth):
        levels.append(scratch.keep(above(levels[-1], FAN if k else RANGE_BYTES)))
    return Tree(levels)


def depth_of(*records: DataFrame) -> int:
    """Levels that bring the largest offset of all replicas down to one root."""
    largest = max(r.agg(F.max("offset")).first()[0] or 0 for r in records)
    depth, top = 1, largest // RANGE_BYTES
    while top:
        depth, top = depth + 1, top // FAN
    return depth


def differences(one: Tree, other: Tree) -> DataFrame:
    """Leaves that differ: (archive, offset, length, damage, digest, replica_digest), by descending from the roots."""
    down: DataFrame | None = None
    for level in range(len(one.levels) - 1, -1, -1):
        sides = []
        for tree in (one, other):
            nodes = tree.levels[level]
            if down is not None:
                width = FAN if level else RANGE_BYTES
                nodes = nodes.withColumn("parent", F.expr(f"no div {width}")).join(down, ["archive", "parent"], "left_semi").drop("parent")
            sides.append(nodes)
        left, right = sides[0], sides[1].withColumnsRenamed({"digest": "replica_digest", "length": "replica_length"})
        unlike = left.join(right, ["archive", "no"], "full").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
        if level:
            down = unlike.select("archive", F.col("no").alias("parent"))
    damage = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return unlike.select("archive", F.col("no").alias("offset"), F.coalesce("length", "replica_length").alias("length"), damage.alias("damage"), "digest", "replica_digest")


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Differences between two replicas given as records (archive, offset, length, digest)."""
    scratch = Scratch(records.sparkSession, "fixity")
    # Digests are written once; the trees and the descent read them from there.
    stored = [scratch.keep(r.select("archive", "offset", "length", "digest")) for r in (records, replica)]
    depth = depth_of(*stored)
    return differences(*(build(r, depth, scratch) for r in stored))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Each page with its WARC record's bytes as text: (page_id, archive, record). ARCHIVE_RECORDS ids share an archive."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    archive = F.coalesce(F.expr(f"cast(floor(`{id_col}` / {ARCHIVE_RECORDS}) as bigint)"), F.lit(-1).cast("long"))
    return pages.select(F.col(id_col).alias("page_id"), archive.alias("archive"), F.concat(head, payload, F.lit("\r\n\r\n")).alias("record"))


def with_offsets(records: DataFrame) -> DataFrame:
    """records (archive, page_id, digest, length, __row, ...), a stored table, with offset: the bytes before it in its archive by id, then digest.

    An id that is null or repeated without end would be one long window. So the bytes before a record are those of the ids and PARTS parts of
    digests before it, of the digests in its part, and of equal records: each is a sum of sums over a group of its own.
    """
    id_ = [F.col("page_id").isNull().alias("__null"), F.coalesce("page_id", F.lit(0)).alias("__id")]
    part, deal = F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") * PARTS / 65536).cast("int"), F.pmod(F.xxhash64("__row"), F.lit(DEALS)).cast("int")
    keyed = records.select("*", *id_, part.alias("__part"), deal.alias("__deal"))
    ids = ["archive", "__null", "__id", "__part"]
    before = lambda value, keys, *order: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = keyed.groupBy(*ids, "digest", "__deal").agg(F.count("*").alias("n"), F.min("length").alias("size"))
    digests = equal.groupBy(*ids, "digest").agg((F.sum("n") * F.min("size")).alias("bytes"))
    parts = digests.groupBy(*ids).agg(F.sum("bytes").alias("bytes"))
    starts = (
        equal.select(*ids, "digest", "__deal", (before("n", [*ids, "digest"], "__deal") * F.col("size")).alias("__a"))
        .join(digests.select(*ids, "digest", before("bytes", ids, "digest").alias("__b")), [*ids, "digest"])
        .join(parts.select(*ids, before("bytes", ["archive"], F.desc("__null"), "__id", "__part").alias("__c")), ids)
        .select(*ids, "digest", "__deal", (F.col("__a") + F.col("__b") + F.col("__c")).alias("__start"))
    )
    nth = F.row_number().over(Window.partitionBy(*ids, "digest", "__deal").orderBy("__row")) - 1
    placed = keyed.withColumn("__nth", nth).join(starts, [*ids, "digest", "__deal"])
    return placed.select(*(F.col(c) for c in records.columns), (F.col("__start") + F.col("__nth") * F.col("length")).alias("offset"))


def drill(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of pages, and of a replica with known damage, as a drill of the audit: by a rule on the id, a byte is changed, a
    record cut short, or lost. Offsets are those of the archive's index, so what is lost or cut leaves a gap.
    """
    rule = F.col("page_id") * 7919
    damaged = F.when(rule % 97 == 0, F.concat(F.lit("X"), F.expr("substring(record, 2)"))).when(rule % 89 == 0, F.expr("substring(record, 1, cast(floor(char_length(record) / 2) as int))"))
    record = warc_records(pages)
    digests = record.select(
        "page_id",
        "archive",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
        F.sha2(F.coalesce(damaged, "record"), 256).alias("replica_digest"),
        F.octet_length(F.coalesce(damaged, "record")).cast("long").alias("replica_length"),
        F.coalesce(rule % 83 == 0, F.lit(False)).alias("lost"),
    )
    scratch = Scratch(pages.sparkSession, "drill")
    stored = scratch.keep(digests.withColumn("__row", F.monotonically_increasing_id()))
    placed = scratch.keep(with_offsets(stored).drop("__row"))
    return placed, placed.where("not lost").select("archive", "offset", F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest"))


def op1_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    return audit(*drill(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLES = {
    "op1_merkle_fixity": f"""
with records as (
  select page_id, coalesce(cast(floor(page_id / {ARCHIVE_RECORDS}.0) as bigint), -1) as archive,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages
), placed as (
  select *, strlen(record) as length, sha256(record) as digest,
    coalesce(sum(strlen(record)) over (partition by archive order by page_id, sha256(record) rows between unbounded preceding and 1 preceding), 0) as place
  from records
), replica as (
  select *, page_id * 7919 % 83 = 0 as lost,
    sha256(case when page_id * 7919 % 97 = 0 then 'X' || substring(record, 2)
                when page_id * 7919 % 89 = 0 then substring(record, 1, length(record) // 2) else record end) as replica_digest
  from placed
)
select archive, cast(place as bigint) as "offset", cast(strlen(record) as bigint) as length, case when lost then 'missing' else 'changed' end as damage,
  digest, case when not lost then replica_digest end as replica_digest
from replica where lost or digest <> replica_digest
"""
}
QUERIES = {"op1_merkle_fixity": op1_merkle_fixity}
