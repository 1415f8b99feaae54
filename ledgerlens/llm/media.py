"""Content-addressed media payloads in tar shards.

Every distinct payload is stored once over all shards, under its SHA-256, and
rows carry digest, shard, offset and length. Digests are computed and grouped
first; of the rows of a digest the one of the least id stores it, into a tar
shard that its task writes to the shared folder. Metadata columns come from
range reads of the headers alone; whole payloads are read back by offset, never
by unpacking a shard, and each stored payload is read once, however many rows
share it.

The stored form is an 8-bit greyscale PNG 64 samples wide, whose pixels are the
payload's bytes: lossless, compressed and readable by any image library.

Scale: what is grouped and joined by digest is ids and digests, never payloads.
Digests of very many rows (at most ``HOT_DIGESTS`` of them can have more than
that share of the rows) get their places by broadcast, so no key is one task.
A retried task writes a new shard under its own attempt's name; rows only ever
point to shards of tasks that were committed, and shards that nothing points to
are deleted once the index is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, new_folder, portions, shape, width

WIDTH = 64
#: Bytes of the PNG signature and the header chunk that hold width, height and depth.
HEADER = 33
#: A shard is closed once it holds this many bytes.
SHARD_BYTES = 512 << 20
#: Digests that more than one row has are broadcast to the writing tasks up to this many, and joined beyond.
MOST_SHARED = 200_000
#: A digest is hot if it has more than this share of all rows, so there are at most this many of them.
HOT_DIGESTS = 20_000
#: Stored bytes that one task reads back, about.
READ_BYTES = 32 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_png(payload: bytes) -> bytes:
    import struct
    import zlib

    import numpy as np

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter type 0 before each line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first ``HEADER`` bytes."""
    import struct

    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as ``to_png`` writes it, checksums verified."""
    import struct
    import zlib

    import numpy as np

    png_header(data[:HEADER])
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the file system that Spark itself would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open_folder(uri: str):
    """(pyarrow file system, path) of a qualified URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def payload(text: Column) -> Column:
    """``payload_of`` as a column."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(raw) / WIDTH) * WIDTH) - F.octet_length(raw)
    return F.concat(raw, F.substring(F.lit(bytes(WIDTH)), F.lit(1), size.cast("int")))


def _write(rows: DataFrame, home: str) -> DataFrame:
    """Store the payloads of (digest, text) rows, each once per task: digest, shard, offset, length."""
    schema = "digest string, shard string, offset bigint, length bigint"

    def run(batches):
        import tarfile
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        files, root = _open_folder(home)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        shard, out, at, known = None, None, 0, set()

        def close():
            out.write(bytes(2 * 512))
            out.close()

        try:
            for batch in portions(batches):
                found = []
                for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if digest in known:
                        continue
                    known.add(digest)
                    if out is not None and at > SHARD_BYTES:
                        close()
                        out = None
                    if out is None:
                        shard, at = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tar", 0
                        out = files.open_output_stream(f"{root}/{shard}")
                    data = to_png(payload_of(text))
                    head = tarfile.TarInfo(f"{digest}.png")
                    head.size = len(data)
                    head = head.tobuf(tarfile.PAX_FORMAT)
                    out.write(head)
                    out.write(data)
                    out.write(bytes(-len(data) % 512))
                    found.append((digest, shard, at + len(head), len(data)))
                    at += len(head) + len(data) + -len(data) % 512
                yield pa.RecordBatch.from_pylist([dict(zip(("digest", "shard", "offset", "length"), x, strict=True)) for x in found], pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                close()

    return rows.mapInArrow(run, schema)


def _tidy(spark: SparkSession, home: str, places: DataFrame) -> None:
    """Delete shards that no place points to, which stopped attempts of tasks leave behind."""
    kept = {r["shard"] for r in places.select("shard").distinct().collect()}  # one name per writing task
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        for status in files.listStatus(path):
            if status.getPath().getName().endswith(".tar") and status.getPath().getName() not in kept:
                files.delete(status.getPath(), False)


def at_digest(rows: DataFrame, values: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per digest); ``counts`` (digest, rows) says which digests are hot and go by broadcast."""
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("rows") > max(1000, total // HOT_DIGESTS)).select("digest"))
    many = rows.join(hot, "digest", "left_semi").join(F.broadcast(values.join(hot, "digest", "left_semi")), "digest")
    return rows.join(hot, "digest", "left_anti").join(values, "digest").unionByName(many)


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write every distinct payload once; returns (rows, places).

    rows: ``id_col``, n_bytes and digest of every row of ``docs``. places:
    digest, folder, shard, offset, length and rows (how many share it), one row
    per digest. Both are written tables, so later steps never store again.
    ``folder`` must be new or empty and defaults to one in the shared folder.

    Nulls: a null text is empty (one line of zeros); a null id is kept. Repeated
    rows point to one stored payload; rows equal in id and text that lie in
    different tasks may each write it, and one copy of it has a place. An empty
    table writes nothing. A payload of any length is one member. Other columns
    are left out.
    """
    spark = docs.sparkSession
    home = qualified(spark, folder or new_folder(spark, "media"))
    line = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    digest = F.sha2(payload(F.col("_text")), 256).alias("digest")
    rows = materialise(line.select("_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), digest), "media-rows")
    counts = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("_id").isNull().alias("null"), "_id")).alias("_first")), "media-counts")
    shared = counts.filter("rows > 1").select("digest", "_first")
    named = line.select("_id", "_text", digest)
    few = shared.count() <= MOST_SHARED
    named = named.join(F.broadcast(shared) if few else shared, "digest", "left")
    mine = F.col("_first").isNull() | F.col("_first._id").eqNullSafe(F.col("_id"))
    written = materialise(_write(named.filter(mine).select("digest", "_text"), home), "media-written")
    _tidy(spark, home, written)
    place = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_p"))
    places = materialise(place.join(counts, "digest").select("digest", F.lit(home).alias("folder"), "_p.shard", "_p.offset", "_p.length", "rows"), "media-places")
    return rows.withColumnRenamed("_id", id_col), places


def _read(places: DataFrame, columns: dict[str, str], read) -> DataFrame:
    """``places`` with columns that ``read(open file, offset, length)`` gives; tasks take runs of a shard of about READ_BYTES stored bytes, in offset order."""
    kept = [c for c in places.columns if c not in columns]
    schema = shape(places.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in columns.items()]))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        opened, shard = None, None
        for batch in batches:
            out = []
            for where in zip(*(batch.column(schema.names.index(c)).to_pylist() for c in ("folder", "shard", "offset", "length")), strict=True):
                if where[:2] != shard:
                    if opened:
                        opened.close()
                    files, root = _open_folder(where[0])
                    opened, shard = files.open_input_file(f"{root}/{where[1]}"), where[:2]
                out.append(read(opened, where[2], where[3]))
            found = [pa.array([row[k] for row in out], to_arrow_type(schema[c].dataType)) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)
        if opened:
            opened.close()

    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = places.select(*kept).withColumn("_run", F.floor(F.col("offset") / READ_BYTES)).repartition(max(width(places.sparkSession), 2 * total // READ_BYTES), "shard", "_run")
    return dealt.sortWithinPartitions("shard", "offset").drop("_run").mapInArrow(run, schema)


def with_headers(places: DataFrame) -> DataFrame:
    """Metadata columns width, height and depth by range reads of the header bytes only."""

    def read(f, offset, length):
        return png_header(f.read_at(min(HEADER, length), offset))

    return _read(places, {"width": "int", "height": "int", "depth": "int"}, read)


def with_features(places: DataFrame) -> DataFrame:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes read back.

    The feature is the image's size, its mean and deviation, and a 64-bit hash
    of which cells of an 8 by 8 grid are brighter than the mean.
    """

    def read(f, offset, length):
        import hashlib
        import zlib

        import numpy as np

        media = f.read_at(length, offset)
        payload = from_png(media)
        rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
        mean = rows.mean()
        cuts = np.arange(8) * len(rows) // 8
        cells = np.array([rows[lo : max(hi, lo + 1)].reshape(-1, 8, 8).mean((0, 2)) for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True)])
        bits = np.packbits((cells > mean).ravel()).tobytes().hex()
        feature = f"{WIDTH}x{len(rows)}:{mean:.3f}:{rows.std():.3f}:{bits}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    kinds = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    return _read(places, kinds, read)
