"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces.

Sections and paragraphs end at blank lines and line ends. Pieces are cut by
content: about one word in five (in scripts without spaces, one character in
eight) starts a piece, by where its first code point stands in the code tables,
whatever the language, and a piece has at most MOST_WORDS words of at most
LONGEST characters. An edit so changes the pieces that it touches and hardly
any others. All cuts have no width, so the
pieces of a text always join to the text itself and equal roots mean equal
texts (up to SHA-256 collisions). A fingerprint is one string::

    root|section>paragraph=leaf,leaf/paragraph=leaf;section>...

with the root in full and all other nodes by 12 hex digits, so two fingerprints
alone tell equality, likeness and which branch differs. Two unlike texts of
200,000 pieces each share a leaf by chance in one case in 7,000. All of it is
column expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, steps

#: A section ends after a blank line, a paragraph after a line end.
SECTION, PARAGRAPH = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
#: From here on (Thai, kana, Chinese, Hangul, symbols) every character counts as a word, as most of these scripts set no spaces.
WIDE = r"\x{E00}-\x{10FFFF}"
#: Most characters of a word and of the space after it, and most words of a piece.
LONGEST, MOST_WORDS = 48, 8


def _rows(low: int, high: int, row: int) -> str:
    """Character class body: the first eighth of every ``row`` code points from ``low`` up to ``high``."""
    return "".join(rf"\x{{{c:X}}}-\x{{{c + row // 8 - 1:X}}}" for c in range(low, high, row))


_word = rf"(?:[^\s{WIDE}]{{1,{LONGEST}}}+|[{WIDE}])\s{{0,{LONGEST}}}+"
_start = rf"[{_rows(0x40, 0x100, 32)}]|(?=[\x{{100}}-\x{{10FFFF}}])[{_rows(0x100, 0x3000, 32)}{_rows(0x3000, 0x10000, 256)}{_rows(0x20000, 0x31400, 1024)}]"
#: A word starts a piece if its first code point is in the first eighth of its row of the code tables. One pattern for all pieces of a paragraph, which Spark keeps compiled.
PIECE = rf"{_word}(?:(?!{_start}){_word}){{0,{MOST_WORDS - 1}}}+|\s{{1,{LONGEST}}}+"
#: Bytes of text that one task takes, about.
TASK_BYTES = 8 << 20

#: Most groups of neighbours whose first keys (eight bytes each) are broadcast.
BROADCAST_GROUPS = 200_000


def fingerprint(text: Column) -> Column:
    """Fingerprint string of a text; a null text counts as empty.

    Chained ``transform`` steps bind each level's hashes once before the level
    above uses them.
    """
    cut = lambda s, rule: F.filter(F.split(s, rule, -1), lambda x: F.length(x) > 0)
    short = lambda h: F.substring(h, 1, 12)
    pieces = lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))
    node = lambda tag, hashes: F.sha2(F.concat(F.lit(tag), F.array_join(hashes, "")), 256)
    pair = lambda h, shown: F.struct(h.alias("h"), shown.alias("s"))

    def paragraphs(section: Column) -> Column:
        leaves = F.transform(cut(section, PARAGRAPH), lambda p: F.transform(pieces(p), lambda x: F.sha2(F.concat(F.lit("L"), x), 256)))
        hashed = F.transform(leaves, lambda x: pair(node("P", x), F.array_join(F.transform(x, short), ",")))
        return F.transform(hashed, lambda x: pair(x["h"], F.concat(short(x["h"]), F.lit("="), x["s"])))

    body = F.coalesce(text, F.lit(""))
    parts = F.transform(cut(body, SECTION), paragraphs)
    hashed = F.transform(parts, lambda x: pair(node("S", F.transform(x, lambda y: y["h"])), F.array_join(F.transform(x, lambda y: y["s"]), "/")))
    shown = F.transform(hashed, lambda x: pair(x["h"], F.concat(short(x["h"]), F.lit(">"), x["s"])))
    root = lambda x: F.concat(node("R", F.transform(x, lambda y: y["h"])), F.lit("|"), F.array_join(F.transform(x, lambda y: y["s"]), ";"))
    return F.element_at(F.transform(F.array(shown), root), 1)


def leaves(print_: Column) -> Column:
    """The leaf digests of a fingerprint, in order."""
    return F.regexp_extract_all(print_, F.lit("(?<=[=,])[0-9a-f]{12}"), F.lit(0))


def _numbered(digests: Column) -> Column:
    """Digests with the number of each occurrence, so that sets of them are multisets of digests."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.array_sort(digests), ","), F.lit(",")), F.lit(r"([0-9a-f]{12},)\1*"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / 13).cast("int")), lambda k: F.concat(F.substring(r, 1, 12), k.cast("string")))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of leaves in common: twice those that both have, by those of each, repeats counted (0 to 1, below 1)."""
    root = lambda p: F.substring_index(p, "|", 1)
    return _alike(_numbered(leaves(a)), _numbered(leaves(b)), root(a) == root(b))


def _alike(x: Column, y: Column, same: Column) -> Column:
    sizes = lambda z: F.struct(F.size(F.array_intersect(z["x"], z["y"])).alias("both"), (F.size(z["x"]) + F.size(z["y"])).alias("all"))
    part = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), sizes)[0]
    return F.when(same, F.lit(1.0)).otherwise(F.transform(F.array(part), lambda s: F.when(s["all"] == 0, F.lit(0.0)).otherwise(F.least(2 * s["both"] / s["all"], F.lit(1 - 1e-9))))[0])


def branches(print_: Column) -> Column:
    """Array of (section, paragraph, node) for every paragraph node, from 0."""
    sections = F.split(F.substring_index(print_, "|", -1), ";")
    listed = F.transform(sections, lambda s, i: F.transform(F.split(F.substring_index(s, ">", -1), "/"), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("node"))))
    return F.filter(F.flatten(listed), lambda x: x["node"] != "")


def edits(a: Column, b: Column) -> Column:
    """Paragraph nodes of ``b`` that ``a`` has nowhere: where an edit of ``a`` into ``b`` took place."""
    known = F.transform(branches(a), lambda x: x["node"])
    return F.transform(F.filter(branches(b), lambda x: ~F.array_contains(known, x["node"])), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out``; a column of that name is replaced, all others are kept."""
    return docs.withColumn(out, fingerprint(F.col(text_col)))


def next_documents(docs: DataFrame, id_col: str, order: str, carried: list[str], derived: dict[str, Column], group_rows: int = 2_000) -> DataFrame:
    """``docs`` and the ``derived`` columns, with ``next_<c>`` of the next row by (``id_col``, ``order``) for each carried column; the first row follows the last.

    The id range is cut into groups of about ``group_rows`` neighbours, by
    quantiles and then evenly within each, so no window holds the table. A copy
    of the first row of the group after it stands at each group's end as a
    guest. Rows are shuffled once, before ``derived`` columns are computed, and
    groups are dealt by number, not by hash, as many to each task as their
    bytes of ``order`` call for.
    """
    low = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(low))
    light = docs.select(key.alias("_key"))
    n, start, size = docs.agg(F.count(F.lit(1)), F.min(key), F.sum(F.octet_length(order))).first()
    groups = max(1, -(-n // group_rows), min(96, n // 400))
    coarse = min(groups, 1024)
    bounds = sorted(set(light.agg(F.percentile_approx("_key", [k / coarse for k in range(1, coarse)], 100_000).alias("q")).first()["q"] or [])) if coarse > 1 else []
    fine = -(-groups // coarse)
    block = steps(F.col("_key"), bounds).cast("long")
    if fine > 1:  # even cuts between two neighbouring quantiles
        ends = F.array(*[F.lit(b) for b in [bounds[0], *bounds, bounds[-1] + 1]])
        lo, hi = F.element_at(ends, (block + 1).cast("int")), F.element_at(ends, (block + 2).cast("int"))
        share = F.when(hi > lo, (F.col("_key") - lo) / (hi - lo)).otherwise(F.lit(0.0))
        block = block * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share * fine))).cast("long")
    # The first key of each group, and of the group after it. Groups meet in windows of 1,024 by their number, then of one row per window.
    firsts = light.select("_key", block.alias("_block")).groupBy("_block").agg(F.min("_key").alias("_first")).withColumn("_bin", F.floor(F.col("_block") / 1024))
    bins = firsts.groupBy("_bin").agg(F.min("_first").alias("_first")).select("_bin", F.lead("_first").over(Window.orderBy("_bin")).alias("_after"))
    after = (
        firsts.withColumn("_then", F.lead("_first").over(Window.partitionBy("_bin").orderBy("_block")))
        .join(bins, "_bin")
        .select("_block", F.coalesce("_then", "_after", F.lit(start).cast("long")).alias("_head"))
    )
    spots = after.select(F.col("_head").alias("_key")).distinct()
    head = (
        docs.withColumn("_key", key).join(F.broadcast(spots) if groups <= BROADCAST_GROUPS else spots, "_key", "left_semi")
        .groupBy("_key").agg(F.min(F.struct(order, *[c for c in docs.columns if c != order])).alias("_v"))
        .withColumnRenamed("_key", "_head")
    )
    guests = after.join(head, "_head").select(*[F.col("_v")[c].alias(c) for c in docs.columns], F.col("_head").alias("_key"), "_block", F.lit(True).alias("_guest"))
    guests = materialise(guests, "guests")  # one row per group
    each = max(1, round(groups * TASK_BYTES / max(size or 0, TASK_BYTES)))  # groups to a task
    tasks = -(-groups // each)
    rows = docs.withColumns({"_key": key, "_block": block, "_guest": F.lit(False)}).unionByName(guests)
    rows = rows.withColumn("_task", F.pmod(F.col("_block"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("_task"))
    w = Window.partitionBy("_task", "_block").orderBy("_guest", "_key", order)
    early, late = ([c for c in carried if (c in derived) == told] for told in (False, True))
    led = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in early}).withColumns(derived).withColumns({f"next_{c}": F.lead(c).over(w) for c in late})
    return led.filter(~F.col("_guest")).select(*docs.columns, *derived, *[f"next_{c}" for c in carried])


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, and the text with its last quarter replaced by the start of the next document.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and edited_parts (where the two differ).

    Nulls: a null text is empty; null ids sort first. Rows of one id follow
    each other by text, and repeated rows each give a row. A lone row is its
    own next document. An empty table gives an empty result. Very long texts
    stay whole; extra columns are left out.
    """
    mine = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    led = next_documents(mine, "id", "body", ["body", "print"], {"print": fingerprint(F.col("body"))})
    n = F.char_length("body")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(body, 1, char_length(body) - cast(floor(char_length(body) / 4) as int))"), F.substring("next_body", F.lit(1), k))
    root = lambda c: F.substring_index(c, "|", 1)
    return (
        led.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
        .withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
        .withColumns({"_x": _numbered(leaves(F.col("print"))), "_y": _numbered(leaves(F.col("edited_fingerprint"))), "_z": _numbered(leaves(F.col("next_print")))})
        .select(
            F.col("id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
            F.col("print").alias("fingerprint"), "edited_fingerprint",
            _alike(F.col("_x"), F.col("_y"), root("print") == root("edited_fingerprint")).alias("near_edited"),
            _alike(F.col("_x"), F.col("_z"), root("print") == root("next_print")).alias("near_next"),
            edits(F.col("print"), F.col("edited_fingerprint")).alias("edited_parts"),
        )
    )
