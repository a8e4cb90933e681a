"""WARC: a Merkle fixity audit.

Every record is hashed. A volume's records, in the order of their offsets,
make leaves of a tree by ranges of offsets, and each node hashes its children
in order. Two replicas are compared at the roots of their trees; only below
nodes that differ are children compared, down to ranges, and there records.

Hashes are made once for each record; what is shuffled are digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed

#: Bytes of a range of offsets, children of a node, and levels above the ranges.
SPAN = 1 << 16
FANOUT = 16
LEVELS = 4
#: Ids of one volume, and the records after which it is divided.
VOLUME_IDS = 1024
VOLUME_RECORDS = 4096


def record(url: Column, body: Column) -> Column:
    """A WARC response record as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, content: Column, stored: Column | None = None, *, id_col: str = "page_id") -> DataFrame:
    """Lay records out in volumes: volume, offset, length, copies, digest, stored_digest, record_id.

    ``content`` is the text of a row's record, and ``stored`` what another
    store holds of it, null where that is lost. Ids in a row share a volume;
    one with very many records is divided by their digests. Equal rows are
    one entry with ``copies``.
    """
    stored = content if stored is None else stored
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), content.alias("c"), stored.alias("s")).select(
        "record_id",
        F.sha2("c", 256).alias("digest"),
        F.octet_length("c").cast("long").alias("length"),
        F.sha2("s", 256).alias("stored_digest"),
    )
    keys = ["record_id", "digest", "length", "stored_digest"]
    entries = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    entries = checkpointed(entries.withColumn("shelf", F.coalesce(F.expr(f"record_id div {VOLUME_IDS}"), F.lit(-1))))
    shelves = entries.groupBy("shelf").agg(F.expr(f"(count(*) + {VOLUME_RECORDS - 1}) div {VOLUME_RECORDS}").alias("parts"))
    number = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long")
    placed = entries.join(shelves, "shelf").withColumn("part", F.pmod(number, "parts"))
    order = Window.partitionBy("shelf", "part").orderBy("record_id", "digest", "stored_digest")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    volume = F.concat_ws("-", F.col("shelf").cast("string"), F.col("part").cast("string"))
    return placed.select(
        volume.alias("volume"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "copies", *keys[:2], "stored_digest"
    )


def trees(replicas: list[DataFrame], *, span: int = SPAN, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (volume, place, hash_0, hash_1, ...) of each level, from the ranges up to the roots, of all replicas side by side.

    A replica has volume, offset, length, copies and digest; its hash is null
    where it has nothing. A volume that outgrows the levels has several roots.
    A range holds at most as many records as it has bytes, and a node
    ``fanout`` children. Each level is written, so the next one, and whoever
    compares it, starts from rows and not from the plans of all below.
    """

    def hashed(part: str) -> Column:
        parts = F.collect_list(F.when(F.col(part).isNotNull(), F.struct("at", F.col(part).alias("text"))))
        text = F.array_join(F.transform(F.sort_array(parts), lambda x: x["text"]), "\n")
        return F.when(F.size(parts) > 0, F.sha2(text, 256))

    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("offset", "length", "copies")], "digest")
    sides = range(len(replicas))
    nodes = reduce(
        DataFrame.unionByName,
        [
            x.select(
                "volume",
                F.expr(f"offset div {span}").alias("place"),
                F.col("offset").alias("at"),
                *[(text if i == own else F.lit(None).cast("string")).alias(f"part_{i}") for i in sides],
            )
            for own, x in enumerate(replicas)
        ],
    )
    out: list[DataFrame] = []
    for _ in range(levels + 1):
        out.append(checkpointed(nodes.groupBy("volume", "place").agg(*[hashed(f"part_{i}").alias(f"hash_{i}") for i in sides])))
        place = F.col("place").cast("string")
        nodes = out[-1].select(
            "volume",
            F.expr(f"place div {fanout}").alias("place"),
            F.col("place").alias("at"),
            *[F.when(F.col(f"hash_{i}").isNotNull(), F.concat_ws(" ", place, f"hash_{i}")).alias(f"part_{i}") for i in sides],
        )
    return out


def tree(records: DataFrame, **shape: int) -> list[DataFrame]:
    """Nodes (volume, place, hash) of each level of one replica; see :func:`trees`."""
    return [x.withColumnRenamed("hash_0", "hash") for x in trees([records], **shape)]


def audit(a: DataFrame, b: DataFrame, *, span: int = SPAN, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The records in which two replicas differ: volume, offset, length, kind, digest, replica_digest, root, replica_root.

    Replicas have volume, offset, length, copies and digest, an offset once in
    a volume. ``kind`` is ``missing`` for what only ``a`` has, ``extra`` for
    what only ``b`` has, and otherwise ``changed``. ``root`` is the hash of
    the volume's first root. Equal replicas, and empty ones, give no rows; a
    whole volume may be missing. Rows with a null volume are a volume.
    """
    a, b = (x.withColumn("volume", F.coalesce("volume", F.lit("(none)"))) for x in (a, b))
    made = trees([a, b], span=span, fanout=fanout, levels=levels)
    differ = ~F.col("hash_0").eqNullSafe(F.col("hash_1"))
    bad = checkpointed(made[-1].where(differ).select("volume", "place"))
    for level in made[-2::-1]:
        above = bad.select("volume", F.col("place").alias("above"))
        below = level.where(differ).withColumn("above", F.expr(f"place div {fanout}"))
        bad = checkpointed(below.join(above, ["volume", "above"], "left_semi").select("volume", "place"))
    inside = [
        x.withColumn("place", F.expr(f"offset div {span}"))
        .join(bad, ["volume", "place"], "left_semi")
        .select("volume", "offset", F.struct("length", "copies", "digest").alias(name))
        for x, name in ((a, "x"), (b, "y"))
    ]
    found = inside[0].join(inside[1], ["volume", "offset"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    roots = made[-1].where("place = 0").select("volume", F.col("hash_0").alias("root"), F.col("hash_1").alias("replica_root"))
    return (
        found.join(roots, "volume", "left")
        .select(
            "volume",
            "offset",
            F.coalesce("x.length", "y.length").alias("length"),
            kind.alias("kind"),
            F.col("x.digest").alias("digest"),
            F.col("y.digest").alias("replica_digest"),
            "root",
            "replica_root",
        )
    )


def volume_files(records: DataFrame) -> DataFrame:
    """(volume, content) of records (volume, offset, content as binary): each volume's bytes in the order of offsets.

    For volumes of bounded size, as files are: one volume is one row. Null
    contents count as empty; records at one offset stand in the order of their
    bytes, repeated ones each. A null volume is a volume; an empty table gives
    no rows.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    parts = F.sort_array(F.collect_list(F.struct("offset", content.alias("content"))))
    content = F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.content))")
    return records.groupBy("volume").agg(parts.alias("parts")).select("volume", content.alias("content"))


def parse(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of a volume; what can't be read is left in the last one's bytes."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = None
        for line in data[at : max(head, at)].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        end = len(data) if head < 0 or size is None else min(len(data), head + 4 + size + 4)
        yield at, data[at:end]
        at = end


def read_records(volumes: DataFrame) -> DataFrame:
    """(volume, offset, content) of the records in volumes (volume, content).

    Null and empty contents have no records. Repeated volumes each give their
    records; a null volume stays null. What can't be read is the end of the
    record before it, or one record of the whole. Other columns are not
    looked at.
    """
    schema = pa.schema([("volume", pa.string()), ("offset", pa.int64()), ("content", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for volume, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := [(volume, offset, content) for offset, content in parse(data or b"")]:
                    columns = zip(zip(*rows, strict=True), schema, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

    return volumes.select(F.col("volume").cast("string").alias("volume"), F.col("content").cast("binary").alias("content")).mapInArrow(
        run, "volume string, offset long, content binary"
    )
