"""Near-duplicate documents by chosen-path set similarity join over word shingles.

1. Every text becomes its set of distinct word shingles, and the set a digest
   (its class: texts with equal sets), ``COORDS`` minwise values and the nodes
   of the first level of ``trees`` independent trees. At a node each coordinate
   is selected with probability 1 / (similarity * COORDS), the same for all,
   and a class goes to one child per selected coordinate, named by its minwise
   token there; two sets at the wanted similarity then share one child or more
   in expectation, at every level.
2. Nodes of more than ``NODE_ROWS`` classes are branched on by Spark, again by
   selected tokens, until all are small; in these all sketches are compared.
   Members of a large node that look like its pivot are tied to the pivot and
   leave the node, so a big group of near copies does not branch for ever. What
   tokens do not part in ``MAX_DEPTH`` levels is compared as pairs of blocks.
3. These ties only say which classes belong in one room: connected components
   of the ties. Rooms are checked on the full sets, blocks of a room pair by
   pair, and exact links give the final components.

Scale: one row per class and node is shuffled, with a 64-byte sketch; full sets
are read only for classes that have a tie. Copies collapse into their class
before any join. A node's task compares at most NODE_ROWS rows at a time, and a
room larger than ``ROOM_ROWS`` is dealt as pairs of blocks, so no task holds
more than a fixed number of rows. A room of m members costs (m / ROOM_ROWS)
copies of its sets. Recall: a pair is missed if in no tree it shares a path, or
if 64 coordinates estimate it 0.2 too low; with 12 trees that is below one in a
thousand for pairs at the threshold and far below for closer ones. Where a
pair's nodes are all large, each level of branching keeps it in about two of
three trees: with the 15 first nodes of 12 trees one in a hundred thousand is
missed after one level and one in a hundred after four. Links are only needed
to connect a group, not between all of its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_rows, materialise, portions, shape, unused

COORDS = 64
NODE_ROWS = 4_000
#: Classes, and bytes of their sets, in one block of a room.
ROOM_ROWS, ROOM_BYTES = 1_000, 16 << 20
#: Shared shingles that are counted at a time when blocks of a room are compared.
COLUMNS = 4_096
MAX_DEPTH = 30
#: Links in one file of the tables that components are found from.
FILE_ROWS = 50_000
FIRST_TREES = 3
_SEED = 20_240_501


def shingle_sets(texts: list, shingle: int, cache: dict) -> list:
    """Sorted distinct 64-bit shingle hashes of each text (null: none).

    A-Z are lower-cased and words are runs without ASCII white space. A text
    of fewer words than ``shingle`` counts as one shingle, its whole sequence.
    """
    import numpy as np

    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        size = min(shingle, len(h))
        mixed = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


class WordHashes(dict):
    """64-bit hash of each word, remembered; starts afresh when full."""

    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def set_digest(found) -> bytes | None:
    from hashlib import blake2b

    return blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _selected(similarity: float, trees: int) -> list[tuple[int, int]]:
    """(tree, coordinate) of the first level."""
    import numpy as np

    rng = np.random.default_rng(_SEED)
    out = []
    for tree in range(trees):
        hits = np.flatnonzero(rng.random(COORDS) < 1 / (similarity * COORDS))
        out += [(tree, int(i)) for i in (hits if len(hits) else [rng.integers(COORDS)])]
    return out


def signatures(docs: DataFrame, shingle: int, similarity: float, trees: int) -> DataFrame:
    """id, n_shingles, class, sketch (one byte per coordinate) and first-level nodes of every row of (id, text)."""
    id_col, text_col = docs.columns
    chosen = _selected(similarity, trees)
    schema = shape(docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(b"").alias("class"), F.lit(b"").alias("sketch"), F.array(F.lit(0).cast("long")).alias("nodes")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(_SEED + 1)
        scale = rng.integers(1, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, COORDS, np.uint64)
        tags = rng.integers(1, 1 << 63, (256, COORDS), np.uint64) * np.uint64(2) + np.uint64(1)
        cache = WordHashes()
        for batch in portions(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), shingle, cache)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            digests, sketches, nodes = [set_digest(s) for s in sets], [None] * len(sets), [None] * len(sets)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(sizes[full]) - sizes[full]
                least = np.stack([np.minimum.reduceat(flat * scale[c] + shift[c], starts) for c in range(COORDS)], axis=1)
                mixed = least * np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                byte = (mixed >> np.uint64(56)).astype(np.uint8)
                keys = np.stack([(mixed[:, c] ^ np.uint64(c)) * tags[t, c] for t, c in chosen], axis=1).view(np.int64)
                for row, i in enumerate(full.tolist()):
                    sketches[i], nodes[i] = byte[row].tobytes(), keys[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "class", "sketch", "nodes"],
            )

    return docs.mapInArrow(run, schema)


def _groups(batches, keys: tuple):
    """Tables of whole runs of rows of one key, from batches sorted by the key columns, with the first row of each run and the number of rows."""
    import numpy as np
    import pyarrow as pa

    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        if kept.num_rows:
            cuts = _cuts(kept, keys)
            if len(cuts):
                yield kept.slice(0, int(cuts[-1])).combine_chunks(), np.concatenate([[0], cuts])
                kept = kept.slice(int(cuts[-1]))
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks(), np.array([0, kept.num_rows])


def _cuts(table, keys: tuple):
    """Rows whose key differs from that of the row before."""
    import numpy as np

    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def _equal(a, b):
    """Number of equal coordinates of every sketch of ``a`` with every one of ``b``."""
    import numpy as np

    same = np.zeros((len(a), len(b)), np.uint8)
    for c in range(COORDS):
        same += a[:, c, None] == b[None, :, c]
    return same


class _Forest:
    """Groups of rows by label; ``tie`` joins a row's group with those of others and lists one pair for each that is new."""

    def __init__(self, label):
        self.group, self.left, self.right = label.copy(), [], []

    def tie(self, row: int, others) -> None:
        import numpy as np

        others = others[self.group[others] != self.group[row]]
        if len(others):
            found, first = np.unique(self.group[others], return_index=True)
            self.left += [row] * len(first)
            self.right += others[first].tolist()
            self.group[np.isin(self.group, found)] = self.group[row]


def _pairs(names, found: list):
    """Arrow batch of (a, b) from forests of a table's rows: (first row, forest)."""
    import numpy as np
    import pyarrow as pa

    a = np.array([lo + x for lo, f in found for x in f.left], np.int64)
    b = np.array([lo + x for lo, f in found for x in f.right], np.int64)
    return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])


def _ties(wanted: int):
    """mapInArrow function: (node, i, j, side, class, sketch, label) sorted by node, i, j -> ties of classes with at least ``wanted`` equal coordinates, enough to connect those that have any."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for table, starts in _groups(batches, ("node", "i", "j")):
            names = table.column("class").chunk(0)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
            label = pc.dictionary_encode(table.column("label").chunk(0)).indices.to_numpy()
            cross, side = table.column("i").to_numpy() != table.column("j").to_numpy(), table.column("side").to_numpy()
            forests = []
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            keep = (label[twos] != label[twos + 1]) & (~cross[twos] | (side[twos] != side[twos + 1])) & ((sketch[twos] == sketch[twos + 1]).sum(1) >= wanted)
            for lo in twos[keep].tolist():
                forests.append((lo, _Forest(label[lo : lo + 2])))
                forests[-1][1].tie(0, np.array([1]))
            for lo, hi in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist(), strict=True):
                if (label[lo:hi] == label[lo]).all():
                    continue
                forest, mine = _Forest(label[lo:hi]), sketch[lo:hi]
                first = np.flatnonzero(~side[lo:hi]) if cross[lo] else np.arange(hi - lo)
                for at in range(0, len(first), 512):
                    rows = first[at : at + 512]
                    others = np.flatnonzero(side[lo:hi]) if cross[lo] else np.arange(at, hi - lo)
                    near = _equal(mine[rows], mine[others]) >= wanted
                    if not cross[lo]:
                        near &= others[None, :] > rows[:, None]
                    for k in np.flatnonzero(near.any(1)).tolist():
                        forest.tie(int(rows[k]), others[near[k]])
                if forest.left:
                    forests.append((lo, forest))
            if forests:
                yield _pairs(names, forests)

    return run


def dealt_in_blocks(rows: DataFrame, key: str, name: str, most: int, weight: Column | None = None, most_weight: int = 1) -> DataFrame:
    """``rows`` with i, j and side: keys of at most ``most`` rows (and ``most_weight``) whole as (0, 0), larger ones as all pairs of blocks of about that size."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(weight) / most_weight) if weight is not None else F.count(F.lit(1)) / most)
    sizes = rows.groupBy(key).agg(parts.cast("int").alias("blocks")).filter("blocks > 1")
    seats = rows.join(sizes, key, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"), F.lit(0)))
    pairs = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return pairs.select(*rows.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side"))


def ties(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes of different labels that some tree brought together and whose sketches look alike.

    Rows are (class, sketch, nodes, label); classes of one label are known to
    be connected and are not tied again.
    """
    wanted = int((similarity - 0.2) * COORDS)
    level = classes.select("class", "sketch", "label", F.explode("nodes").alias("node"))
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("side")]
    small, found, depth = [], [], 0
    # Pivots differ from node to node, so what one pivot's star cuts off from its members another's does not.
    pivot = F.min(F.struct(F.xxhash64("node", "class").alias("h"), "class", "sketch")).alias("pivot")
    while True:
        heavy = materialise(level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), pivot).filter(F.col("n") > NODE_ROWS), "heavy")
        if heavy.isEmpty():
            small.append(level.select("node", "class", "sketch", "label", *whole))
            break
        if depth == MAX_DEPTH:
            small.append(dealt_in_blocks(level.select("node", "class", "sketch", "label"), "node", "class", NODE_ROWS))
            break
        big = level.join(heavy.drop("n"), "node")
        alike = F.aggregate(F.sequence(F.lit(1), F.lit(COORDS)), F.lit(0), lambda n, i: n + (F.substring("sketch", i, F.lit(1)) == F.substring(F.col("pivot")["sketch"], i, F.lit(1))).cast("int"))
        big = big.withColumn("near", alike >= wanted)
        found.append(materialise(big.filter("near").select(F.col("class").alias("a"), F.col("pivot")["class"].alias("b")).filter("a != b"), "pivots"))
        chance = 1 / (similarity * COORDS)
        coord = F.filter(F.sequence(F.lit(1), F.lit(COORDS)), lambda i: F.pmod(F.xxhash64("node", i), F.lit(1 << 20)) < int(chance * (1 << 20)))
        coord = F.when(F.size(coord) > 0, coord).otherwise(F.array((F.pmod(F.xxhash64("node", F.lit(0)), F.lit(COORDS)) + 1).cast("int")))
        deeper = big.filter(~F.col("near")).select("class", "sketch", "label", "node", F.explode(coord).alias("c"))
        small.append(level.join(heavy, "node", "left_anti").select("node", "class", "sketch", "label", *whole))
        level = materialise(deeper.select("class", "sketch", "label", F.xxhash64("node", "c", F.substring("sketch", F.col("c"), F.lit(1))).alias("node")), "level")
        depth += 1
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    out = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(_ties(wanted), "a binary, b binary")
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def _rooms(classes: DataFrame, similarity: float, trees: int) -> DataFrame:
    """class and room of every class that is tied to another.

    The first trees connect nearly all of a large group of near copies; the
    rest then look only for ties between what is still apart.
    """
    first = sum(tree < FIRST_TREES for tree, _ in _selected(similarity, trees))
    start = classes.select("class", "sketch", F.slice("nodes", 1, first).alias("nodes"), F.col("class").alias("label"))
    files = -(-classes.count() // FILE_ROWS) or 1
    known = components(ties(start, similarity), files=files).select(F.col("node").alias("class"), F.col("component").alias("label"))
    rest = classes.select("class", "sketch", F.slice("nodes", first + 1, 10_000).alias("nodes")).join(known, "class", "left").withColumn("label", F.coalesce("label", "class"))
    late = ties(rest, similarity)
    joined = late.unionByName(known.select(F.col("class").alias("a"), F.col("label").alias("b")))
    return materialise(components(joined, files=files).withColumnsRenamed({"node": "class", "component": "room"}), "rooms")


def _shared(sets: list, first, second):
    """Size of the intersection of each set of rows ``first`` with each of ``second``: products of 0/1 columns, COLUMNS shingles at a time."""
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    often = np.bincount(number) > 1  # a shingle of one set alone is in no intersection
    keep = often[number]
    owner, number = owner[keep], (np.cumsum(often) - 1)[number[keep]]
    total = np.zeros((len(first), len(second)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, int(often.sum()) - lo)), np.float32)
        table[owner[a:b], number[a:b] - lo] = 1
        total += table[first] @ table[second].T
    return total


def _links(share: int):
    """mapInArrow function: sets of a pair of blocks of a room, sorted by room, i, j -> exact links that connect what is connected."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table, starts in _groups(batches, ("room", "i", "j")):
            names, raw = table.column("class").chunk(0), table.column("found").chunk(0)
            cross, side = table.column("i").to_numpy() != table.column("j").to_numpy(), table.column("side").to_numpy()
            forests = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here = np.arange(hi - lo)
                first, second = (here[~side[lo:hi]], here[side[lo:hi]]) if cross[lo] else (here, here)
                if hi - lo < 2 or not len(first) or not len(second):
                    continue
                sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(lo, hi)]
                sizes = np.array([len(x) for x in sets])
                both = _shared(sets, first, second)
                near = 100 * both.astype(np.float64) >= share * (sizes[first][:, None] + sizes[second][None, :] - both)
                if not cross[lo]:
                    near &= second[None, :] > first[:, None]
                forest = _Forest(here)
                for k in np.flatnonzero(near.any(1)).tolist():
                    forest.tie(int(first[k]), second[near[k]])
                if forest.left:
                    forests.append((lo, forest))
            if forests:
                yield _pairs(names, forests)

    return run


def _sets(shingle: int):
    def run(batches):
        import pyarrow as pa

        cache = WordHashes()
        for batch in portions(batches, 0):
            sets = shingle_sets(batch.column(0).to_pylist(), shingle, cache)
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "found"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, trees: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept and set_digest.

    Documents are linked if 100 * |intersection| >= share * |union| of their
    shingle sets, with share = 100 * similarity; component_id is the least id
    reachable over links, and kept says that it is the row's own.

    Nulls: a null, empty or blank text has no shingles and is linked with
    nothing; a null id never names a component unless all its members are
    null, and is kept only then. Equal texts and repeated rows share a
    component; a repeated id is kept each time. An empty table gives an empty
    result. Very long texts enter whole. Other columns are left out.
    """
    spark = docs.sparkSession
    share = round(100 * similarity)
    line = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    signed = materialise(signatures(line, shingle, similarity, trees), "signatures")
    classes = materialise(
        signed.filter("class is not null").groupBy("class").agg(F.min("id").alias("least_id"), F.min(F.struct("n_shingles", "sketch", "nodes")).alias("s")).select("class", "least_id", "s.n_shingles", "s.sketch", "s.nodes"),
        "classes",
    )
    rooms = _rooms(classes, similarity, trees)
    # Full sets of the classes that share a room with another, from one document of each.
    picked = classes.join(rooms, "class", "left_semi").select(F.col("least_id").alias("_id")).distinct()
    texts = line.join(picked, line["_id"].eqNullSafe(picked["_id"]), "left_semi").select("_text")
    sets = texts.mapInArrow(_sets(shingle), "class binary, found binary").dropDuplicates(["class"])
    seats = dealt_in_blocks(rooms.join(classes.select("class", "n_shingles"), "class"), "room", "class", ROOM_ROWS, 8 * F.col("n_shingles"), ROOM_BYTES)
    dealt = sets.join(seats, "class").select("room", "i", "j", "side", "class", "found").repartition("room", "i", "j").sortWithinPartitions("room", "i", "j")
    exact = components(dealt.mapInArrow(_links(share), "a binary, b binary"), files=-(-classes.count() // FILE_ROWS) or 1)
    joined = exact.join(classes.select(F.col("class").alias("node"), "least_id"), "node")
    least = joined.groupBy("component").agg(F.min("least_id").alias("least"))
    named = classes.join(exact.join(least, "component").select(F.col("node").alias("class"), "least"), "class", "left").select("class", F.coalesce("least", "least_id").alias("component_id"))
    own = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        signed.select("id", "n_shingles", "class").join(named, "class", "left")
        .select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), F.lower(F.hex("class")).alias("set_digest"))
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, all columns as they are.

    Rows are told apart by id and text, so a repeated id with another text is
    another document; of repeated rows with words one stays. Nulls as in
    ``near_duplicates``: a row without words is nobody's copy and stays.
    """
    row = unused(docs.columns, "_row")
    marked = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")))
    pairs = marked.select(F.col(row).alias("_row"), F.col(text_col).alias("_text"))
    found = materialise(near_duplicates(pairs, shingle, similarity, id_col="_row", text_col="_text"), "near-duplicates")
    left = drop_rows(marked, found.filter(~F.col("kept")).select(F.col("_row").alias(row)).distinct(), row)
    repeated = found.filter("kept and n_shingles > 0").groupBy("_row").count().filter("count > 1").select(F.col("_row").alias(row))
    if not repeated.isEmpty():
        again = left.join(repeated, row, "left_semi").dropDuplicates([row])
        left = drop_rows(left, repeated, row).unionByName(again)
    return left.select(*docs.columns)
