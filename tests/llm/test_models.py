"""Language identification, the toxicity chain and the pipeline, on held-out rows and planted cases."""

import math
import random
import re
from collections import Counter
from itertools import islice, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def languages(documents):
    return language_id.train(documents.filter("doc_id % 2 = 0"), max_rows=2000)


def test_language_of_held_out_texts(documents, languages):
    held = documents.filter("doc_id % 2 = 1")
    got = language_id.identify_documents(held, languages, declared_col=None, host_col=None).withColumnRenamed("lang", "got").join(held.select("doc_id", "lang"), "doc_id")
    total, right, kept = got.agg(F.count(F.lit(1)), F.count_if(F.col("got") == F.col("lang")), F.count_if("accepted")).first()
    assert right >= 0.98 * total and kept >= 0.99 * total


def test_unknown_text_is_rejected_and_evidence_counts(spark, documents, languages):
    known = documents.filter("lang = 'de' and n_chars > 400").first()["text"]
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("qxzwvkj") for _ in range(9)) for _ in range(60))
    html = lambda body, lang="": f"<html{' lang=' + lang if lang else ''}><body><script>var le la les = 1</script>{body}</body></html>"
    rows = [(1, "http://a.example.com/x", html(known)), (2, "http://a.example.com/y", html(noise)), (3, None, None), (4, "http://w.shop.fr/", html("")), (5, "http://w.b.org/", html("", "es-MX")), (6, "%%%", "<html lang=de>")] + [(7, "http://a.example.com/x", html(known))] * 2
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "page_id long, url string, html string, posterior double, host string")
    got = {r["page_id"]: r for r in language_id.identify_pages(df, languages).collect()}
    assert got[1]["lang"] == "de" and got[1]["accepted"] and not got[2]["accepted"] and got[2]["lang"] == "und"
    assert got[4]["lang"] == "fr" and got[5]["lang"] == "es" and got[5]["declared"] == "es" and got[6]["lang"] == "de" and got[3]["n_trigrams"] == 0
    assert abs(sum(got[1]["posterior"].values()) - 1) < 1e-9
    assert language_id.identify_pages(df.filter("false"), languages).count() == 0
    with pytest.raises(ValueError):
        language_id.train(documents.filter("false"))


def test_every_declared_language_is_kept(spark):
    """Forty languages with alphabets of their own, some rare and one spelled in several ways: all are learned and none leaves."""
    rng = random.Random(7)
    rows = []
    for k in range(40):
        letters = [chr(0x400 + 6 * k + i) for i in range(6)]
        for i in range(4 if k >= 36 else 12):
            text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60))
            lang = f"l{k}" if k or i % 3 else ("L0", "l0-ab")[i % 2]
            rows.append((len(rows), text, lang, f"src{k % 3}"))
    rows.append((len(rows), rows[0][1] * 400, "l0", "src0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(docs.unionByName(docs.limit(3).withColumn("lang", F.lit(""))).unionByName(docs.limit(3).withColumn("lang", F.lit("und"))))
    assert model.languages == [*sorted(f"l{k}" for k in range(40)), "und"]
    kept = language_id.keep_known(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(rows)))
    got = language_id.identify_documents(docs, model, declared_col=None).withColumnRenamed("lang", "got").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("got != split(lower(lang), '-')[0]").count() == 0


def test_host_prior_against_brute_force(spark, languages):
    """Smoothed host, domain, suffix and corpus counts without the page's own share."""
    names, k = languages.languages, 8.0
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        host = ["a.x.com", "b.x.com", "y.org", ""][i % 4] if i else "lone.net"
        parts = host.split(".")
        p = rng.dirichlet(np.ones(len(names)))
        rows.append((i, host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else "", None, 5, [float(x) for x in p]))
    df = spark.createDataFrame(rows, "id long, host string, domain string, suffix string, declared string, n long, base array<double>")
    got = {r["id"]: r for r in language_id.fuse(df, names).collect()}
    base = np.array([r[6] for r in rows])

    def level(key, above):
        sums, n = {}, Counter(key)
        for x, b in zip(key, base, strict=True):
            sums[x] = sums.get(x, 0) + b
        return sums, n, [(sums[x] + k * a) / (n[x] + k) for x, a in zip(key, above, strict=True)]

    top = (base.sum(0) + 1 / len(names)) / (len(rows) + 1)
    _, _, by_suffix = level([r[3] for r in rows], [top] * len(rows))
    _, _, by_domain = level([(r[2], r[3]) for r in rows], by_suffix)
    sums, n, _ = level([r[1] for r in rows], by_domain)
    for r, b, above in zip(rows, base, by_domain, strict=True):
        w = (np.maximum(sums[r[1]] - b, 0) + k * above) / (n[r[1]] - 1 + k) * b
        w /= w.sum()
        assert got[r[0]]["lang"] == names[int(w.argmax())] and got[r[0]]["confidence"] == pytest.approx(w.max())


def labelled(spark, n=1200, seed=5):
    """Texts of a small vocabulary; toxic ones have a few words of a toxic family, long and short."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        toxic = rng.random() < 0.2
        for _ in range(rng.choice([1, 2, 6]) if toxic else 0):
            w.insert(rng.randrange(len(w)), "krul" + "".join(rng.choice("aeiou") for _ in range(2)) if rng.random() < 0.5 else "zwomp")
        low = rng.random() < 0.2
        docs.append((i, (" %%% " if low else " ").join(w), "lang"))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, strongest string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id")
    hit, miss, wrong, clean = got.agg(F.count_if(F.expr("toxic and y = 1")), F.count_if(F.expr("not toxic and y = 1")), F.count_if(F.expr("toxic and y = 0")), F.count_if(F.expr("not toxic and y = 0"))).first()
    assert hit >= 0.97 * (hit + miss) and wrong <= 0.01 * clean
    low = got.agg(F.avg(F.when(F.col("quality") == 0, F.col("p_low_quality"))), F.avg(F.when(F.col("quality") == 1, F.col("p_low_quality")))).first()
    assert low[0] > 0.9 > 0.1 > low[1]
    assert got.filter("p_toxic_low_quality > p_toxic + 0.05").count() == 0
    assert [len(w) for w in model.weights] == [8, 9, 10]
    same = toxicity.keep_clean(docs, model)
    assert same.columns == docs.columns and same.count() == toxicity.score(docs, model).filter("not toxic").count()


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark, 600)
    model = toxicity.train(docs, labels)
    rows = [(None, None, "s"), (1, "", "s"), (2, "zwomp krulaa", "s"), (2, "zwomp krulaa", "s"), (3, "a b " * 100_000, "s"), (4, "a b " * 50_000 + "zwomp krulei zwomp krulou", "s")]
    odd = spark.createDataFrame(rows, docs.schema)
    got = toxicity.score(odd, model).collect()
    assert sorted(str((r["doc_id"], r["toxic"])) for r in got) == sorted(map(str, [(None, False), (1, False), (2, True), (2, True), (3, False), (4, True)]))
    assert all((r["strongest"] or "").startswith(("zwomp", "krul")) == r["toxic"] for r in got)
    assert toxicity.score(odd.filter("false"), model).count() == 0 and toxicity.keep_clean(odd.filter("false"), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.train(docs, labels.filter("toxic = 0"))


def test_rare_evidence_beside_many_common_patterns(spark):
    """A word of three toxic texts counts, although 60,000 patterns are in more of them."""
    common = " ".join(map("".join, islice(product("abcdefghijklmnopqrst", repeat=4), 30_000)))
    texts = [(f"{common} {i}", 1) for i in range(4)] + [(f"zwomp tail {i}", 1) for i in range(3)] + [(f"krul tail {i}", 1) for i in range(100)] + [(f"{'tail ' * 5}{i}", 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.evidence["zwomp"] > toxicity.LEAST and model.evidence["krul"] > model.evidence["zwomp"] and "tail" not in model.evidence


def test_categories_of_other_labels(spark):
    """Any label columns make a chain: a later category learns from the log-odds of an earlier one."""
    docs, labels = labelled(spark)
    labels = labels.select("doc_id", (F.col("toxic") * 3).alias("grade"))
    model = toxicity.train(docs, labels, categories={"toxic": "grade > 0", "strong": "grade > 2"})
    got = toxicity.score(docs, model).join(labels, "doc_id")
    assert model.categories == ("toxic", "strong") and [len(w) for w in model.weights] == [8, 9]
    assert got.filter("p_strong > 0.5 and grade = 0 or p_strong < 0.5 and grade = 3").count() <= 0.03 * got.count()


def brute_evidence(texts, toxic):
    """Cautious log-odds of words and their beginnings, from sets of patterns."""
    sets = [{p for w in re.findall(r"[^\W\d_]+", t.lower()) for p in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)]} for t in texts]
    t_all, out = sum(toxic), {}
    for p in set().union(*sets):
        a, b = (sum(p in s for s, y in zip(sets, toxic, strict=True) if y == k) for k in (1, 0))
        odds = math.log((a + 0.5) / (t_all + 1)) - math.log((b + 0.5) / (len(texts) - t_all + 1)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 2))
        if a >= 3 and odds > toxicity.LEAST:
            out[p] = odds
    return out


def test_evidence_and_scores_against_brute_force(spark):
    docs, labels = labelled(spark, 500, 9)
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    want = brute_evidence(list(rows.values()), [marks[i] for i in rows])
    assert model.evidence == pytest.approx(want)
    for r in toxicity.score(docs, model).orderBy("doc_id").limit(40).collect():
        text = rows[r["doc_id"]]
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        found = sorted((e for w in words if (e := max([want.get(p, 0) for p in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)]]))), reverse=True)
        d = [*(found + [0] * 3)[:3], math.log1p(sum(found[:10])), min(len(found), 20) / 20, sum(c in "%$#&*" for c in text) / max(1, len(text)), math.log(max(1, len(text)))]
        x = [1.0, *((np.array(d) - model.centre) / model.spread)]
        for name, w in zip(model.categories, model.weights, strict=True):
            p = 1 / (1 + math.exp(-min(max(float(np.dot(x, w)), -30), 30)))
            assert r[f"p_{name}"] == pytest.approx(p)
            q = min(max(p, 1e-6), 1 - 1e-6)
            x.append(math.log(q / (1 - q)))


def test_three_languages_of_one_repeated_text_each(spark):
    """Rows are drawn by id and text, so a language whose rows all repeat one text is learned; so is one of repeated rows, by its least hash."""
    text = {"fr": "le chat est sur la grande table rouge et il dort", "de": "der hund schläft auf dem großen roten tisch heute", "es": "el perro duerme sobre la mesa grande y roja ahora", "it": "il gatto dorme sul tavolo rosso della cucina grande"}
    rows = [(i, f"the cat sleeps on the large red table number {i} of today", "en", "s") for i in range(200)]
    rows += [(1000 + i, text[lang], lang, "s") for i, lang in enumerate(["fr", "de", "es"] * 3000)] + [(5, text["it"], "it", "s")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(docs, max_rows=300)
    assert model.languages == ["de", "en", "es", "fr", "it", "und"]
    assert language_id.keep_known(docs, model).count() == len(rows)


def test_rows_and_columns_of_other_names_stay_as_they_are(spark, languages):
    """Extra columns named like the operators' own keep their values; rows of one id and text are judged by their own host and language."""
    import corpus_pipeline

    noise = "qxz wvk jqx zzw kvj qqx " * 30
    known = "und der hund schläft auf dem großen tisch " * 8
    rows = [(1, known, "de", "h", "a", "b", 1, 2), (1, known, "de", "h", "a", "b", 1, 2), (2, noise, "und", "h", "c", "d", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row string, _text string, _id int, toxic int")
    kept = language_id.keep_known(docs, languages)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == rows[:2]
    clean = toxicity.keep_clean(docs, toxicity.blank())
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(rows)
    apart = corpus_pipeline.one_of_each(spark, docs, "")
    assert apart.columns == docs.columns and sorted(map(tuple, apart.collect())) == sorted(rows[1:])


@pytest.mark.parametrize("case", ["no documents", "no labels", "no toxic labels", "no languages"])
def test_queries_on_tables_without_rows(spark, tmp_path, case):
    import corpus_pipeline

    from ledgerlens.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    changed = {"no documents": ("documents", "false"), "no labels": ("labels", "false"), "no toxic labels": ("labels", "toxic = 0"), "no languages": ("documents", "true")}
    for name in ("documents", "labels", "pages"):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        rows = rows.filter(changed[case][1]) if changed[case][0] == name else rows
        (rows.withColumn("lang", F.lit(None).cast("string")) if case == "no languages" and name == "documents" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    n = docs.count()
    scored = QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()
    assert len(scored) == n and (case == "no languages" or not any(r["toxic"] for r in scored))
    pages = QUERIES["op4_language_id"](spark, str(tmp_path)).collect()
    assert len(pages) == spark.read.parquet(f"{small}/pages.parquet").count()
    if case in ("no documents", "no languages"):
        assert {r["lang"] for r in pages} == {"und"} and not any(r["accepted"] for r in pages)
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert bool(kept) == bool(n)
    if case == "no documents":
        for name in ("op2_hilbert_shards", "op3_merkle", "op5_packing", "op6_media", "op7_chosen_path", "op10_word_bpe"):
            assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_more_likely_toxic_than_not_is_toxic(spark):
    """A text with one toxic word and a probability of 0.6 is toxic, one of 0.4 is not."""
    even = [np.zeros(8), np.zeros(9), np.zeros(10)]
    even[1][:2] = [-5.0, 1.0]
    model = toxicity.ToxicityModel({"awful": 5.0 + np.log(0.6 / 0.4), "poor": 5.0 - np.log(0.6 / 0.4)}, even, np.zeros(7), np.ones(7))
    docs = spark.createDataFrame([(1, "an awful day"), (2, "a poor day"), (3, "a day")], "doc_id long, text string")
    got = {r["doc_id"]: (round(r["p_toxic"], 3), r["toxic"], r["strongest"]) for r in toxicity.score(docs, model).collect()}
    assert got == {1: (0.6, True, "awful"), 2: (0.4, False, None), 3: (0.007, False, None)}
    assert [r["doc_id"] for r in toxicity.keep_clean(docs, model).orderBy("doc_id").collect()] == [2, 3]


def test_pipeline(spark, tmp_path):
    """Every stage on what the one before kept: a planted toxic text, copies and noise go, the rest stays."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter("lang = 'en' and n_chars between 600 and 3000").orderBy("doc_id").limit(6).collect()
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzwvkj") for _ in range(8)) for _ in range(200))
    long = clean[0]["text"]
    planted = [(90_001, noise), (90_002, long), (90_003, long + " idiot moron stupid worthless scum"), (90_004, long + " tail")]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in planted], docs.schema)
    docs.unionByName(extra).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    kept, at = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        kept.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert 90_001 not in kept[0] and len(kept[0]) >= 1000 and kept[0] >= kept[1] >= kept[2]
    assert 90_003 not in kept[1] and {90_002, 90_004} <= kept[1] and not {90_002, 90_004} & kept[2]
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert ids == kept[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
