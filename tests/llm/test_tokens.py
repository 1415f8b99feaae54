"""Packing and distinct-word BPE against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerlens.llm import packing, pretokens, word_bpe  # noqa: E402

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    "", None, " ", "\n\n  x", "It's 42 o'clock, don't!!  \t\nÀ l'été: 3½ x²", "日本語 テキスト ١٢٣ ǅ ẞ \x1c \x1f  \u0085a", "<|endoftext|> \0 end", "a" * 5000, "word " * 4000,
    "''s 'sabc  we'll\r\n\r\n", "🙂🙂 é ​", " lead and trail   ", "tab\tsep\x0b\x0c!",
]


def plain():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=word_bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1.5, b"q", 3) for i, t in rows], "doc_id long, text string, part string, ids double, _id binary, before int").repartition(3)


def rows_of(texts):
    return [(i if i % 4 else None, t) for i, t in enumerate(texts, 1)] + [(2, texts[1])] * 2


def test_pretokens_equal_the_full_pattern():
    import regex

    full = regex.compile(PATTERN)
    rng = random.Random(4)
    letters = "abz ÀÿŁƀɏɐß'’stre mdl019²½¼_-.!\t\n\r\x0b\x1c\x85\xa0\xad 日٣"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        assert pretokens.splitter(PATTERN)(t) == full.findall(t)


def test_packed_integers_and_codes():
    rng = np.random.default_rng(1)
    for top in (1, 200, 300, 70_000, 1 << 31):
        v = rng.integers(0, top, 999)
        assert (pretokens.unpack_ints(pretokens.pack_ints(v))[0] == v).all()
        assert (pretokens.unpack_codes(pretokens.pack_codes(v)) == v).all()
    edges = np.array([0, 191, 192, 14527, 14528, 473279, 473280, 2**31])
    assert (pretokens.unpack_codes(pretokens.pack_codes(edges)) == edges).all()


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 25])
def test_encode_and_decode(spark, block_bytes):
    rows = rows_of(TEXTS)
    got = word_bpe.decode(word_bpe.encode(docs(spark, rows), RANKS, PATTERN, block_bytes=block_bytes), RANKS).collect()
    enc = plain()
    want = sorted((i is None, i or 0, np.array(enc(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_empty_tables(spark):
    none = docs(spark, [])
    assert word_bpe.encode(none, RANKS, PATTERN).count() == 0 and packing.packed(none, JSON, PATTERN).count() == 0


def test_decode_clash_and_nulls(spark):
    df = spark.createDataFrame([(None, "x"), (np.array([0], "<u4").tobytes(), "y")], "ids binary, DECODED string")
    got = word_bpe.decode(df, RANKS)
    with pytest.raises(Exception, match="vocabulary lacks"):
        word_bpe.decode(spark.createDataFrame([(np.array([50_256], "<u4").tobytes(),)], "ids binary"), RANKS).collect()
    assert got.columns == ["ids", "decoded"] and sorted(str(r["decoded"] and bytes(r["decoded"])) for r in got.collect()) == ["None", "b'!'"]


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(spark, window):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON)
    marks = ["<|endoftext|>", "<|endoftext|> after", "before <|endoftext|>", "in<|endoftext|>side", "twice <|endoftext|><|endoftext|> and <|endoftext|>", "<|endoftext |> <|endoftext|", " <|endoftext|>\n"]
    rows = [(i, t) for i, t in enumerate(TEXTS + marks)]
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    cut = packing.packed(docs(spark, rows), JSON, PATTERN, window)
    parts, seen = {}, {}
    for r in cut.collect():
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and bytes(r["ids"]) == np.array(piece, "<u4").tobytes()
        parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert sorted(parts) == list(range(len(parts)))
    for k, found in list(parts.items()) + list(seen.items()):
        at = 0
        for o, n in sorted(found):
            assert o == at
            at += n
    assert all(sum(n for _, n in v) == window for k, v in parts.items() if k < len(parts) - 1)
    assert all(sum(n for _, n in v) == len(want[i]) for i, v in seen.items()) and len(seen) == len(rows)
    whole = {r["sequence_id"]: r for r in packing.sequences(cut).collect()}
    assert sum(len(r["ids"]) // 4 for r in whole.values()) == sum(map(len, want.values()))


def test_repeated_rows_are_packed_each(spark):
    got = packing.packed(docs(spark, [(None, "x"), (None, "x"), (3, None)]), JSON, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got) == [("3", 1), ("None", 2), ("None", 2)]


def test_digest_of_a_file_is_the_vocabulary():
    assert len(word_bpe.read_ranks(RANKS)) == 50_256 and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
