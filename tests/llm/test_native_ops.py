"""Hilbert shards and Merkle prints against plain Python."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.hilbert_shards import hilbert_index, hilbert_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, SIZE string"


def docs(spark, rows):
    """Rows of (id, text); further columns clash with those of the result."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, f"src{(i or 0) % 5}", len(t or ""), 1, "x", "y") for i, t in rows], DOCS)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"c{k}" for k in range(dims)])
    rows = cells.select("*", hilbert_index([F.col(f"c{k}").cast("int") for k in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in itertools.pairwise(rows))


def check_shards(rows, got, shards=24):
    import zlib

    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {r["law"] for r in got} <= {"rows"} and all(r["grown_shard"] is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None), (None, None), (3, ""), (3, "")], [(i, "é" * (i % 17)) for i in range(500)] + [(7, "same")] * 60 + [(None, "long " * 20000)]])
def test_shards(spark, rows):
    check_shards(rows, hilbert_shards(docs(spark, rows), cell_rows=20).collect())


def test_shards_prune(spark):
    """A value of a dimension lies in few shards, also for dimensions of few values."""
    from ledgerlens.llm.hilbert_shards import shard_ranges

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hilbert_shards(rows).select("doc_id", "shard").join(rows, "doc_id")
    per = {d: got.groupBy(d).agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).first()[0] for d in ("source", "lang")}
    assert per["source"] <= 12 and per["lang"] <= 14
    ranges = shard_ranges(got).collect()
    assert len(ranges) == 24 and sum(r["n_rows"] for r in ranges) == rows.count() and all(r["min_lang"] <= r["max_lang"] for r in ranges)


def test_shards_follow_the_curve(spark):
    got = hilbert_shards(docs(spark, [(i, "x" * (i % 90)) for i in range(600)])).orderBy("shard", "slot").collect()
    assert [r["curve_index"] for r in got] == sorted(r["curve_index"] for r in got)


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["fingerprint"] for r in merkle.with_fingerprint(df).orderBy("doc_id").collect()]


def brute_pieces(paragraph):
    """Words with their space; one starts a piece by its first code point, or after MOST_WORDS words."""
    out, words = [], 0
    wide = lambda c: ord(c) >= 0xE00
    row = lambda c: 32 if c < 0x3000 else 256 if c < 0x10000 else 1024 if 0x20000 <= c < 0x31400 else 0
    at = 0
    while at < len(paragraph):
        end = at
        if paragraph[at] in " \t\n\x0b\f\r":  # space that follows no word, or a long one's rest
            while end < min(len(paragraph), at + merkle.LONGEST) and paragraph[end] in " \t\n\x0b\f\r":
                end += 1
            out.append(paragraph[at:end])
            at, words = end, 0
            continue
        if wide(paragraph[at]):
            end = at + 1
        while end < min(len(paragraph), at + merkle.LONGEST) and paragraph[end] not in " \t\n\x0b\f\r" and not wide(paragraph[end]) and not wide(paragraph[at]):
            end += 1
        spaces = end
        while spaces < min(len(paragraph), end + merkle.LONGEST) and paragraph[spaces] in " \t\n\x0b\f\r":
            spaces += 1
        c = ord(paragraph[at])
        starts = c >= 0x40 and row(c) and c % row(c) < row(c) // 8
        if not words or starts or words == merkle.MOST_WORDS:
            out.append("")
            words = 0
        out[-1] += paragraph[at:spaces]
        at, words = spaces, words + 1
    return out


def brute_print(text):
    import re

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cut = lambda s, rule: [x for x in re.split(rule, s) if x]
    sections = []
    for s in cut(text or "", merkle.SECTION):
        paragraphs = []
        for p in cut(s, merkle.PARAGRAPH):
            assert "".join(brute_pieces(p)) == p
            leaves = [h("L" + x) for x in brute_pieces(p)]
            node = h("P" + "".join(leaves))
            paragraphs.append((node, f"{node[:12]}={','.join(x[:12] for x in leaves)}"))
        node = h("S" + "".join(n for n, _ in paragraphs))
        sections.append((node, f"{node[:12]}>{'/'.join(t for _, t in paragraphs)}"))
    return h("R" + "".join(n for n, _ in sections)) + "|" + ";".join(t for _, t in sections)


def brute_likeness(a, b):
    """Twice the leaves in common, repeats counted, by all leaves."""
    import re
    from collections import Counter

    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (Counter(re.findall("(?<=[=,])[0-9a-f]{12}", p)) for p in (a, b))
    return 2 * (x & y).total() / max(1, x.total() + y.total())


TEXTS = ["", None, "one", "One, two. Three\nfour five, six.\n\nNew section. It is.\n\n\nLast", "One, two. Three\nfour five, six.\n\nNew section. It was.\n\n\nLast", "\n\n", "a\n", "a\n\n", " ", "é ü. ß\r\nx", "w. " * 3000, "x" * 500 + " " * 200 + "y z", "".join(chr(0x4E00 + i * 37 % 5000) for i in range(900)), "日本語 テキスト、です。and Latin עברית кириллица слово " * 5, "  lead\u3000wide 🙂🙂🙂"]


def test_fingerprints_against_brute_force(spark):
    assert prints(spark, TEXTS) == [brute_print(t) for t in TEXTS]


def test_roots_and_branches(spark):
    a, b = prints(spark, TEXTS[3:5])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.likeness(F.col("a"), F.col("a")).alias("same"), merkle.edits(F.col("a"), F.col("b")).alias("where")).first()
    assert row["same"] == 1.0 and 0.3 < row["near"] < 1 and [tuple(x) for x in row["where"]] == [(1, 0)]
    p = prints(spark, ["a b", "a  b", "a b ", None, ""])
    assert len(set(p[:3])) == 3 and p[3] == p[4]


@pytest.mark.parametrize("group_rows", [3, 7, 1000])
def test_next_document(spark, group_rows):
    rows = [(i * 7 % 90 if i % 11 else None, f"t{i % 13}") for i in range(60)] + [(5, "t5"), (5, "t5"), (10**12, "far"), (-4, None)]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("body", F.coalesce("body", F.lit("")))
    got = merkle.next_documents(df, "id", "body", ["body", "up"], {"up": F.upper("body")}, group_rows).collect()
    want = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in rows))
    pairs = sorted((a, b, c[1], c[1].upper()) for (a, b), c in zip(want, want[1:] + want[:1], strict=True))
    assert sorted((r["id"] if r["id"] is not None else -(1 << 63), r["body"], r["next_body"], r["next_up"]) for r in got) == pairs


def test_three_quarters_unchanged_look_alike(spark):
    """Texts of 200 characters or more, of four languages and junk: likeness to the edited text is half at least, and 0.6 for 95 in 100."""
    got = merkle.edited_prints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("n_chars >= 200").select("near_edited", "near_next").collect()
    near = sorted(r["near_edited"] for r in got)
    assert near[0] >= 0.5 and near[len(near) // 20] >= 0.6 and sorted(r["near_next"] for r in got)[len(got) * 19 // 20] < 0.1


def test_edited_prints(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in merkle.edited_prints(docs(spark, rows)).collect()}
    for i, t in rows:
        t, nxt = t or "", (rows[(i + 1) % len(rows)][1] or "")
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["edited_fingerprint"] == brute_print(edited) and got[i]["fingerprint"] == brute_print(t)
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(brute_print(t), brute_print(edited))) and got[i]["near_next"] == pytest.approx(brute_likeness(brute_print(t), brute_print(nxt)))
    assert merkle.edited_prints(docs(spark, [])).count() == 0
    assert merkle.edited_prints(docs(spark, [(1, "abcdefgh")])).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
