"""Concatenate and cut: all documents in one token line, cut into windows of fixed length.

Pass 1 encodes each input partition and notes, per document, the tokens before
it in its partition; the token totals of the partitions give each partition's
place in the line by a prefix sum. Pass 2 needs no shuffle: a document's place
is its partition's place plus its own, and its pieces are the cuts of that
range at multiples of the window. A window that spans two partitions gets its
pieces (the boundary records) from both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, portions, shape

#: Words whose ids a worker remembers, over its tasks, before it starts afresh (about 200 bytes each).
REMEMBERED = 800_000


def encoded(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text by the tokenizer file, then ``end_id``.

    The file is read on the driver and broadcast; its size is that of the vocabulary.

    Returns part (int), ``id_col``, before (tokens ahead of it in its part),
    doc_tokens and ids (little-endian unsigned, two bytes each, or four if the
    vocabulary needs them). Distinct words are encoded once per worker and the
    ids gathered, which equals encoding the text since the file's added tokens
    and then ``pattern`` split it first. A null text is encoded as empty.
    """
    schema = shape(docs.select(F.lit(0).alias("part"), F.col(id_col), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("doc_tokens"), F.lit(b"").alias("ids")))

    with open(tokenizer) as f:
        model_text = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .pretokens import WordIds, coded

        part, before = TaskContext.get().partitionId(), 0
        known = WordIds.of(model_text.value, end_id)
        unit = np.uint16 if known.top < 1 << 16 else np.uint32
        size = np.dtype(unit).itemsize
        split = known.splitter(pattern)
        for batch in portions(batches):
            known.forget_beyond(REMEMBERED)
            words, counts = [], []
            for text in batch.column(1).to_pylist():
                found = split(text or "")
                words += found
                words.append(None)
                counts.append(len(found) + 1)
            numbers = coded(words, known.codes)
            known.learn()
            ids, per_word = known.table.take(numbers)
            ends = np.cumsum(per_word)[np.cumsum(counts) - 1]
            lengths = np.diff(ends, prepend=0)
            offsets = pa.py_buffer(np.concatenate([[0], ends * size]).astype(np.int64))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(ids.astype(unit))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), part, np.int32)), batch.column(0), pa.array(before + ends - lengths), pa.array(lengths), data],
                names=schema.names,
            )
            before += int(ends[-1])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pieces(tokens: DataFrame, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Cut the token line of an ``encoded`` table (a written one: it is read twice) into windows.

    Returns one row per piece: ``id_col``, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and ids (four bytes each).
    """
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # One row of twelve bytes per input partition, so the window and the broadcast are bounded by the number of tasks.
    places = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("place"))
    rows = tokens.join(F.broadcast(places), "part").select(F.col(id_col), (F.col("place") + F.col("before")).alias("place"), "doc_tokens", "ids")
    zero = F.lit(0).cast("long")
    schema = shape(rows.select(F.col(id_col), zero.alias("start"), zero.alias("length"), zero.alias("ids_crc32"), zero.alias("doc_tokens"), zero.alias("sequence_id"), zero.alias("offset"), F.lit(b"").alias("ids")))

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in portions(batches, 3):
            ids, place, total, packed = batch.columns
            owner, cols = [], [[] for _ in range(7)]
            for row, (at, n, raw) in enumerate(zip(place.to_pylist(), total.to_pylist(), packed.to_pylist(), strict=True)):
                line = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4").tobytes()
                start = 0
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    piece = line[4 * start : 4 * (start + length)]
                    owner.append(row)
                    for c, v in zip(cols, (start, length, zlib.crc32(piece), n, (at + start) // window, (at + start) % window, piece), strict=True):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens; only the last is short.

    Nulls: a null text is empty and packs its end id alone; a null id is kept.
    Repeated rows are packed once each. An empty table gives no pieces. Very
    long texts are cut over as many sequences as they need. Other columns,
    whatever their names, are left out.
    """
    line = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tokens = materialise(encoded(line, tokenizer, pattern, end_id, "_id", "_text"), "tokens")
    return pieces(tokens, window, "_id").withColumnRenamed("_id", id_col)


def sequences(cut: DataFrame) -> DataFrame:
    """The token sequences of ``pieces``: sequence_id, n_tokens, ids; a group holds one window at most."""
    part = F.struct("offset", "ids")
    return cut.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("_p")).select(
        "sequence_id", "n_tokens", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
