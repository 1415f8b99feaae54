"""Language identification by Bayesian fusion of text, markup, address and host.

posterior(language) is proportional to

* the likelihood of the text's letter trigrams, tempered so that a long text
  counts as ``TEMPER`` trigrams at most,
* the chance that markup declares what it declares, given the language,
* the chance of the address suffix, given the language, and
* the host's prior: soft counts of the other pages of the host, smoothed by
  those of its domain, these by the suffix's, and these by the whole corpus.

Host counts come from one grouped sum over hosts (combined before the shuffle,
so a host with a third of all pages is one row per task) and two more over its
small result. Pages join their host's row, which adaptive execution broadcasts
or splits. Models hold a fixed number of trigram slots for every declared language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_rows, materialise, portions, shape, unused

SLOTS = 1 << 15
TEMPER = 60
#: Every language learns from about this many rows, if it has them, however many languages share ``max_rows``.
LEAST_ROWS = 200
#: A text whose best language explains its trigrams by this many nats each less than that language's own texts is of no known language.
MARGIN = 3.0
UNKNOWN = "und"
#: Languages that a country suffix speaks for.
SUFFIX_LANGUAGES = {
    "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "uk": "en", "us": "en",
    "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv",
}


@dataclass
class LanguageModel:
    """Log-probabilities of trigram slots by language; ``floor`` is the unknown class's log-probability per trigram."""

    languages: list[str]
    logs: object
    floor: float
    trust: dict[str, float] = field(default_factory=lambda: {"declared": 0.9, "suffix": 0.7})


def slots(text: str):
    """Slot numbers of the trigrams of a text's letters; everything else counts as one space."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(c):
        return np.empty(0, np.int64)
    letter = (c >= 97) & (c <= 122) | (c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ((c < 0x2000) | (c > 0x206F))
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep].astype(np.uint64)
    if not letter.any() or len(c) < 3:
        c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)] * 2]).astype(np.uint64) if letter.any() else c[:0]
        if not len(c):
            return np.empty(0, np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    return (mixed >> np.uint64(49)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 6000, id_col: str = "doc_id", strict: bool = True) -> LanguageModel:
    """Fit trigram models of all labelled languages on about ``max_rows`` rows, or ``LEAST_ROWS`` a language if that is more.

    Rows are chosen by a hash of id and text, within each language, and every
    language keeps its row of the least hash, so none is lost however often its
    texts repeat. A label counts up to its first hyphen (en-US is en), as
    declared languages do. Only slot counts reach the driver: ``SLOTS`` numbers
    per language at most. Rows with a null text, or a null, empty or unknown
    (``UNKNOWN``) label, are not used. Without any labelled row a ValueError
    says so, or, unless ``strict``, the model knows no language.
    """
    import numpy as np

    named = labelled.select(
        F.col(text_col).cast("string").alias("text"), F.substring_index(F.lower(F.col(lang_col)), "-", 1).alias("lang"),
        (F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) / float(1 << 40)).alias("draw"),
    ).filter(F.col("text").isNotNull() & ~F.col("lang").isin("", UNKNOWN))
    by = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not by and strict:
        raise ValueError("no labelled rows to learn languages from")
    if not by:
        floor = float(-np.log(SLOTS))
        return LanguageModel([UNKNOWN], np.empty((0, SLOTS)), floor)
    share = {r["lang"]: max(r["least"], max(max_rows / len(by), min(max_rows, LEAST_ROWS)) / r["n"]) for r in by}
    cut = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = named.filter(F.col("draw") <= cut[F.col("lang")]).drop("draw")

    def run(batches):
        import pyarrow as pa

        counts: dict = {}
        for batch in portions(batches, 0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                mine += np.bincount(slots(text), minlength=SLOTS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "slot", "n"])

    found = sample.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: k for k, lang in enumerate(sorted(found["lang"].unique().to_pylist()))}
    languages = list(place)
    counts = np.zeros((len(languages), SLOTS))
    for batch in found.to_batches():
        counts[[place[x] for x in batch.column(0).to_pylist()], batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    logs = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * SLOTS))
    mean = (counts * logs).sum(1) / np.maximum(counts.sum(1), 1)
    floor = float(mean.min() - MARGIN)
    # A tenth of every language is noise, so keys, numbers and names in a text do not outweigh its words.
    return LanguageModel([*languages, UNKNOWN], np.log(0.9 * np.exp(logs) + 0.1 * np.exp(floor)), floor)


def _evidence(rows: DataFrame, model: LanguageModel, markup: bool) -> DataFrame:
    """(id, body, declared, address) -> id, host, domain, suffix, declared, n and base (posterior before hosts)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = shape(rows.select("id", *[F.lit("").alias(c) for c in ("host", "domain", "suffix", "declared")], F.lit(0).cast("long").alias("n"), F.array(F.lit(0.0)).alias("base")))

    def run(batches):
        import html
        import re

        import numpy as np
        import pyarrow as pa

        m = shared.value
        place = {lang: i for i, lang in enumerate(m.languages[:-1])}
        count = len(m.languages)
        tag = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
        root = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
        address = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)")

        def said(lang, trust):
            out = np.full(count, (1 - trust) / max(1, count - 1))
            if lang not in place:
                return np.zeros(count)
            out[place[lang]] = trust
            return np.log(out)

        for batch in portions(batches):
            hosts, domains, suffixes, declared, sizes, base = [], [], [], [], [], []
            for body, lang, url in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                body = body or ""
                if markup:
                    hit = root.search(body)
                    lang = hit[1] if hit else None
                    body = html.unescape(tag.sub(" ", body))
                lang = (lang or "").lower().split("-")[0]
                hit = address.match((url or "").strip())
                host = hit[1].lower().rstrip(".") if hit else ""
                labels = host.split(".")
                suffix = labels[-1] if len(labels) > 1 else ""
                at = slots(body)
                logs = np.empty(count)
                # Long texts by slot rather than by trigram: with many languages the looked-up numbers would not fit.
                logs[:-1] = m.logs[:, at].sum(1) if len(at) <= SLOTS else m.logs @ np.bincount(at, minlength=SLOTS)
                logs[-1] = m.floor * len(at)
                logs *= min(1.0, TEMPER / max(1, len(at)))
                if not len(at):
                    logs[:-1] -= 1.0
                logs += said(lang, m.trust["declared"]) + said(SUFFIX_LANGUAGES.get(suffix), m.trust["suffix"])
                p = np.exp(logs - logs.max())
                hosts.append(host)
                domains.append(".".join(labels[-2:]))
                suffixes.append(suffix)
                declared.append(lang or None)
                sizes.append(len(at))
                base.append(p / p.sum())
            cols = [pa.array(c, pa.string()) for c in (hosts, domains, suffixes, declared)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(sizes, pa.int64()), pa.array(base, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def fuse(evidence: DataFrame, languages: list[str], strength: float = 8.0) -> DataFrame:
    """Add each row's host prior, without the row's own share, and decide.

    Returns id, lang, confidence, accepted, declared, host, n_trigrams and
    posterior (map by language). A level's prior counts as ``strength`` rows
    of the level below it.
    """
    count = len(languages)
    sums = [F.sum(F.col("base")[i]).alias(f"c{i}") for i in range(count)]
    again = [F.sum(f"c{i}").alias(f"c{i}") for i in range(count)]
    pack = lambda name: [F.array(*[F.col(f"c{i}") for i in range(count)]).alias(name)]
    hosts = materialise(evidence.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    level = lambda keys, name: hosts.groupBy(*keys).agg(F.sum("n").alias(f"{name}_n"), *again).select(*keys, f"{name}_n", *pack(name))
    total = hosts.agg(F.sum("n").alias("n"), *again).first()  # one number per language
    # Rates of a level: its counts and ``strength`` rows dealt by the rates above it.
    mix = lambda counts, n, above: F.transform(counts, lambda c, i: (c + F.lit(strength) * F.element_at(above, i + 1)) / (n + F.lit(strength)))
    top = F.array(*[F.lit(((total[f"c{i}"] or 0.0) + 1.0 / count) / ((total["n"] or 0) + 1.0)) for i in range(count)])
    priors = (
        hosts.select("host", "domain", "suffix", "n", *pack("counts"))
        .join(level(["domain", "suffix"], "d"), ["domain", "suffix"]).join(level(["suffix"], "s"), "suffix")
        .withColumn("top", top).withColumn("of_suffix", mix(F.col("s"), F.col("s_n"), F.col("top")))
        .withColumn("above", mix(F.col("d"), F.col("d_n"), F.col("of_suffix")))
        .select("host", F.col("n").alias("host_n"), "counts", "above")
    )
    own = lambda c, i: F.greatest(c - F.element_at(F.col("base"), i + 1), F.lit(0.0)) + F.lit(strength) * F.element_at(F.col("above"), i + 1)
    weight = F.transform("counts", lambda c, i: own(c, i) / (F.col("host_n") - 1 + F.lit(strength)) * F.element_at(F.col("base"), i + 1))
    return (
        evidence.withColumnRenamed("n", "n_trigrams").join(priors, "host").withColumn("w", weight)
        .withColumn("all", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        .withColumn("p", F.transform("w", lambda x: x / F.col("all")))
        .withColumn("best", F.array_max("p"))
        .withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("p", F.col("best")).cast("int")))
        .select(
            "id", "lang", F.col("best").alias("confidence"), ((F.col("lang") != UNKNOWN) & (F.col("best") >= 0.5)).alias("accepted"), "declared", "host", "n_trigrams",
            F.map_from_arrays(F.array(*[F.lit(x) for x in languages]), "p").alias("posterior"),
        )
    )


def identify_pages(pages: DataFrame, model: LanguageModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Language of every web page by all four kinds of evidence; see ``fuse`` for the columns, with ``id_col`` for id.

    Nulls: a null page has no text evidence and leans on its host; a null or
    odd address belongs to the host ''; a null id is kept. Repeated rows each
    give a row. An empty table gives an empty result. Pages of any length are
    read whole. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("body"), F.lit(None).cast("string").alias("declared"), F.col(url_col).cast("string").alias("address"))
    evidence = materialise(_evidence(rows, model, True), "language-evidence")
    return fuse(evidence, model.languages).withColumnRenamed("id", id_col)


def identify_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source") -> DataFrame:
    """Language of plain texts: the declared column stands for markup and the source for the host. Nulls and repeats as in ``identify_pages``."""
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"),
        (F.col(declared_col).cast("string") if declared_col else none).alias("declared"), (F.col(host_col).cast("string") if host_col else none).alias("address"),
    )
    evidence = materialise(_evidence(rows, model, False), "language-evidence")
    return fuse(evidence, model.languages).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source") -> DataFrame:
    """The rows of ``docs`` in a language of the model, all columns as they are.

    Rows are told apart by id, text, declared language and host, which is all
    that a decision depends on. A model without languages has nothing to hold
    against any row and keeps all. Nulls and repeats as in ``identify_pages``.
    """
    if model.languages == [UNKNOWN]:
        return docs
    row = unused(docs.columns, "_row")
    parts = [F.col(c).cast("string").alias(n) for c, n in ((declared_col, "declared"), (host_col, "host")) if c]
    marked = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), *parts))
    found = identify_documents(marked, model, row, text_col, declared_col, host_col)
    return drop_rows(marked, found.filter(~F.col("accepted")).select(row).distinct(), row).select(*docs.columns)
