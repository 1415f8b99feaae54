"""Byte-level BPE by a shuffle of distinct words.

Texts are split into pre-tokens, each with its position. Positions stay with
their block (a run of whole documents of about ``block_bytes``); what travels
is every block's distinct words, dealt by word to buckets, so that each
distinct word of the corpus meets in one task and is encoded once. The ids go
back to the blocks, join the positions there and give each text's ids in order.

Words travel packed, one row per block and bucket, as do positions, so the
shuffle is a fraction of the text and a very frequent word is one entry per
block, however often it occurs. A task holds one block's words or one bucket's:
both are dealt by number, not by hash, so none meets another in a task.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, portions, shape, width

#: Most words in one packed run of positions, unless a single document has more.
RUN_WORDS = 32_000
#: Bytes of text for which one bucket of words is made, and the most buckets there are.
BUCKET_BYTES, MOST_BUCKETS = 1 << 30, 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 bytes and id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _blocks(docs: DataFrame, pattern: str, buckets: int, block_bytes: int, schema) -> DataFrame:
    """Rows of kind 0 (words of a bucket) and 1 (positions of some documents) of each block.

    A word's code is its rank in its bucket (by frequency in the block) times
    the number of buckets plus the bucket, so frequent words have small codes
    and the ids that come back by bucket need no other map.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        from .pretokens import Codes, coded, pack_codes, pack_ints, splitter

        split, pack = splitter(pattern), zstandard.ZstdCompressor(level=3).compress
        part, number = TaskContext.get().partitionId(), 0
        codes, held, runs = Codes(), 0, []
        none = None

        def row(kind, bucket, payload, counts, ids):
            cols = [pa.array([f"{part}-{number}"]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary()), pa.array([counts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, ids], names=schema.names)

        def flush():
            words = [w.encode() for w in codes.new]
            seen = np.zeros(len(words), np.int64)
            for _, _, found in runs:
                seen += np.bincount(found, minlength=len(words))
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) % buckets
            order = np.lexsort((-seen, bucket))
            sizes = np.bincount(bucket, minlength=buckets)
            starts = np.cumsum(sizes) - sizes
            code = np.empty(len(words), np.int64)
            code[order] = (np.arange(len(words)) - np.repeat(starts, sizes)) * buckets + bucket[order]
            for b in np.flatnonzero(sizes).tolist():
                own = [words[i] for i in order[starts[b] : starts[b] + sizes[b]]]
                yield row(0, b, pack(pack_ints(np.fromiter(map(len, own), np.int64, len(own))) + b"".join(own)), [len(own)], none)
            while runs:
                ids, counts, found = runs.pop()
                yield row(1, 0, pack(pack_codes(code[found])), counts, pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), ids))

        for batch in portions(batches):
            ids = batch.column(0)
            none = pa.array([[]], pa.list_(ids.type))
            start, words, counts = 0, [], []
            texts = batch.column(1).to_pylist()
            for at, text in enumerate(texts):
                found = split(text or "")
                words += found
                counts.append(len(found))
                held += len(text or "")
                if len(words) >= RUN_WORDS or at + 1 == len(texts):
                    runs.append((ids.slice(start, len(counts)), counts, coded(words, codes).astype(np.int32)))
                    start, words, counts = at + 1, [], []
                if held >= block_bytes and not words:
                    yield from flush()
                    codes, held, number = Codes(), 0, number + 1
        if runs:
            yield from flush()

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """Token ids of every whole text: ``id_col`` and ids (binary, little-endian unsigned 32-bit).

    Nulls: a null or empty text has no ids; a null id is kept. Repeated rows
    each give a row, in no fixed order. An empty table gives an empty result.
    A document is never split over blocks, whatever its length. Other columns
    are left out.

    Buckets follow the bytes of text and tasks the number of blocks, one block
    to a task unless partitions hold very unequal numbers of blocks, so a task
    reads about as much whatever the table's size.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(read_ranks(ranks))  # the vocabulary file, of fixed size
    line = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    size = line.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(16, min(width(spark), MOST_BUCKETS), min(size // BUCKET_BYTES, MOST_BUCKETS))
    schema = shape(line.select(F.lit("").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(b"").alias("payload"), F.array(F.lit(0).cast("long")).alias("counts"), F.array("_id").alias("ids")))
    blocks = materialise(_blocks(line, pattern, buckets, block_bytes, schema), "blocks")

    def words(batches):
        import numpy as np
        import pyarrow as pa
        import tiktoken
        import zstandard

        from .pretokens import Codes, IdTable, coded, pack_ints, unpack_ints

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})._core_bpe.encode_single_piece
        codes, ids = Codes(), IdTable()
        for batch in portions(batches, 3):
            out = []
            for raw in batch.column(3).to_pylist():
                data = unpack(raw)
                lengths, at = unpack_ints(data)
                ends = np.cumsum(lengths) + at
                found = [data[lo:hi] for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                numbers = coded(found, codes)
                ids.add(map(piece, codes.new))
                codes.new = []
                flat, counts = ids.take(numbers)
                out.append(pack(pack_ints(counts) + pack_ints(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary()), *batch.columns[4:]], names=batch.schema.names)

    met = blocks.filter("kind = 0").repartitionById(buckets, F.col("bucket")).mapInArrow(words, schema)
    result = shape(line.select("_id", F.lit(b"").alias("ids")))

    def reassemble(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        from .pretokens import IdTable, unpack_codes, unpack_ints

        unpack = zstandard.ZstdDecompressor().decompress
        block, parts, table = None, {}, None

        def joined():
            """Ids by code: those of bucket b are at b, b + buckets, b + 2 * buckets and so on."""
            found = IdTable()
            top = max(len(c) for c, _ in parts.values())
            found.starts, found.counts = np.zeros(top * buckets, np.int64), np.zeros(top * buckets, np.int64)
            found.ids = np.concatenate([f for _, f in parts.values()]).astype(np.uint32)
            at = 0
            for b, (counts, flat) in parts.items():
                own = slice(b, b + len(counts) * buckets, buckets)
                found.counts[own], found.starts[own] = counts, at + np.cumsum(counts) - counts
                at += len(flat)
            return found

        for batch in batches:
            for at in range(batch.num_rows):
                name, kind, bucket, raw, many = (batch.column(i)[at].as_py() for i in range(5))
                if name != block:
                    block, parts, table = name, {}, None
                data = unpack(raw)
                if kind == 0:
                    counts, end = unpack_ints(data)
                    parts[bucket] = counts, unpack_ints(data, end)[0]
                    continue
                if table is None:
                    table, parts = joined() if parts else IdTable(), {}
                found, per_word = table.take(unpack_codes(data))
                ends = 4 * np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(many)]
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(found)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(5)[at].values, texts], names=result.names)

    # A block's name is the partition that made it and its number there; the numbers run over all partitions in turn.
    part, number = (F.split_part("block", F.lit("-"), F.lit(k)).cast("long") for k in (1, 2))
    many, parts, numbers = blocks.select("block").distinct().agg(F.count(F.lit(1)), F.max(part) + 1, F.max(number) + 1).first()
    tasks = max(1, min(2 * many, (parts or 0) * (numbers or 0)))
    turn = (number * (parts or 0) + part) % tasks
    home = met.unionByName(blocks.filter("kind = 1")).repartitionById(tasks, turn.cast("int")).sortWithinPartitions("block", "kind", "bucket")
    return home.mapInArrow(reassemble, result).withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of its ids joined from the token-byte table in the column ``out`` (null ids: null).

    A broadcast join by array position: the table is every token's place in one
    run of bytes, has one entry per token of the vocabulary file, and gives all
    bytes of a batch's ids in one gather. An id that the table lacks raises an
    error.
    """
    import numpy as np

    known = sorted((i, b) for b, i in read_ranks(ranks).items())
    lengths = np.full(known[-1][0] + 1 if known else 0, -1, np.int64)
    lengths[[i for i, _ in known]] = [len(b) for _, b in known]
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    table = tokens.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(b for _, b in known), np.uint8), starts, lengths))
    rest = [c for c in tokens.columns if c.lower() != out.lower()]
    at = rest.index(ids_col)
    schema = shape(tokens.select(*rest, F.lit(b"").alias(out)))

    def run(batches):
        import pyarrow as pa

        from .pretokens import ragged

        data, starts, lengths = table.value
        for batch in portions(batches, at):
            lists = batch.column(at).to_pylist()
            ids = np.frombuffer(b"".join(x for x in lists if x), "<u4").astype(np.int64)
            if len(ids) and (int(ids.max()) >= len(lengths) or (lengths[ids] < 0).any()):
                raise ValueError("an id that the vocabulary lacks")
            per_id = lengths[ids]
            found = data[ragged(starts[ids], per_id)].tobytes()
            ends = np.concatenate([[0], np.cumsum(per_id)])[np.cumsum([len(x or b"") // 4 for x in lists])]
            texts = [None if x is None else found[lo:hi] for x, lo, hi in zip(lists, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return tokens.select(*rest).mapInArrow(run, schema)
