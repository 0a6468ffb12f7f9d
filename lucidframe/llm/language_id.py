"""Language of a text by Bayesian fusion of evidence.

Four sources of evidence are added as logarithms:

* the text: likelihoods of its byte trigrams under one model for each language and a uniform model of noise, over the
  whole text, tempered to `EVIDENCE` trigrams at most, as neighbouring trigrams aren't independent;
* the declared markup language, right with probability `DECLARED`;
* the address suffix, whose usual language is right with probability `SUFFIX`;
* a prior for the host: the languages of its documents, summed by a grouped aggregation of the other evidence's posteriors
  and smoothed towards the address suffix's languages, which are smoothed towards the whole table's.

The trigram models start from the short word lists below and are fitted on a bounded sample of labelled rows: each row
whose shuffled place falls below SAMPLE / labelled rows, so about `SAMPLE` rows whatever the table's size. The labels must not be
the declarations that are fused: documents are identified by models of pages, labelled by their markup (`sample_pages`), and pages by
models of documents. All else (host counts, decisions) covers every row and whole texts. Only the models (languages x 65,536
numbers) and the host priors, if they are few, are broadcast.

A text is rejected if it holds no letter, if noise explains it best, or if no language reaches `SURE`.

Defined results: a null or empty text is rejected, language null and confidence 0; a null declaration or host is no
evidence; a declaration outside the languages is none either; of languages that are equally likely the first stands; rows without any
label leave the word lists as the models; repeated rows each get a result; an empty table gives an empty result. Columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import bounded_broadcast, empty_text, has_columns, materialize, shuffled_unit, small_batches
from lucidframe.llm.html_extract import blocks, candidates, host_of, main_text
from lucidframe.shipping import ship

LANGUAGES = ("de", "en", "es", "fr")
#: About so many labelled rows fit the trigram models.
SAMPLE = 4000
EVIDENCE, DECLARED, SUFFIX, SURE = 200.0, 0.9, 0.7, 0.5
#: Pseudo-documents by which a host leans on its suffix, and a suffix on the whole table.
LEAN = 20.0
#: Trigrams are told apart up to a hash of so many values; each has PSEUDO counts from the start.
CELLS, PSEUDO = 1 << 16, 0.05
SLICE = 1 << 18

# Frequent words, and address suffixes by their usual language.
SEEDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais avec ou son ses comme on tout nous sa fait été aussi leur bien peut ces y deux à même cette être elle entre encore dont sans ils était lui où après très si leurs faire sous",
}
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}


def cells(raw: np.ndarray) -> np.ndarray:
    """The cell of the trigram that starts at each byte but the last two."""
    x = raw.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def likelihoods(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Mean log likelihood of each text's trigrams under each column of the model, and its number of trigrams."""
    raw, offsets = _texts(texts)
    sums, counts = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts))
    for i in range(len(texts)):
        lo, hi = offsets[i], offsets[i + 1]
        counts[i] = max(0, hi - lo - 2)
        for at in range(lo, hi - 2, SLICE):
            found = np.bincount(cells(raw[at : min(at + SLICE + 2, hi)]), minlength=CELLS) if hi - lo > 20_000 else None
            sums[i] += found @ model if found is not None else model[cells(raw[at : min(at + SLICE + 2, hi)])].sum(axis=0)
    return np.column_stack((sums / np.maximum(counts, 1)[:, None], counts))


def prepared(text: Column) -> Column:
    """Lower case, with marks and digits as single spaces: noise stays apart by its letters."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(empty_text(text)), r"[\s\d\p{Punct}]+", " "), F.lit(" "))


def plain_language(declared: Column) -> Column:
    """The language of a declaration such as es-MX."""
    return F.lower(F.substring_index(F.substring_index(F.trim(declared.cast("string")), "-", 1), "_", 1))


def markup_language(html: Column) -> Column:
    """What the html element of a page declares, or null."""
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3}(?:[-_][a-z0-9]+)*)""", 1)
    return F.when(found != "", found)


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """(id, text, label) of about `sample` pages: the candidates for their main text and the language that their markup declares."""
    has_columns(pages, id_col, html_col)
    ship(pages.sparkSession)
    html = F.col(f"`{html_col}`")
    labelled = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), html.alias("html"), plain_language(markup_language(html)).alias("label")).where(F.col("label").isin(*languages))
    rows = labelled.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(w for words in candidates(blocks(x))[1] for w in words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["id", "text", "label"])

    chosen = labelled.where(shuffled_unit("pages", F.col("id")) < sample / max(rows, 1))
    return materialize(chosen.mapInArrow(read, "id string, text string, label string"), "labelled")


def fit_model(df: DataFrame | None, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities by cell, a column for each language and the last for noise, from about `sample` of (id, text, label) rows; from the word lists alone without any."""
    if df is None:
        return _log_model(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), languages)
    labelled = df.select("id", "text", plain_language(F.col("label")).alias("label")).where(F.col("label").isin(*languages))
    rows = labelled.count()
    chosen = labelled.where(shuffled_unit("language", F.col("id")) < sample / max(rows, 1)).select("label", prepared(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = _texts(batch.column(1))
            for i, label in enumerate(batch.column(0).to_pylist()):
                for at in range(offsets[i], offsets[i + 1] - 2, SLICE):
                    held.setdefault(label, np.zeros(CELLS, np.int64))
                    held[label] += np.bincount(cells(raw[at : min(at + SLICE + 2, offsets[i + 1])]), minlength=CELLS)
        for label, counts in held.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(cell), pa.string()), pa.array(cell, pa.int64()), pa.array(counts[cell], pa.int64())], ["label", "cell", "n"])

    # At most languages x CELLS rows reach the driver.
    counted = chosen.mapInArrow(count, "label string, cell bigint, n bigint").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    place = {x: k for k, x in enumerate(languages)}
    label = np.array([place[x] for x in counted.column("label").to_pylist()], np.int64)
    return _log_model(counted.column("cell").to_numpy(), label, counted.column("n").to_numpy(), languages)


def _log_model(cell: np.ndarray, label: np.ndarray, n: np.ndarray, languages: Sequence[str]) -> np.ndarray:
    model = np.full((CELLS, len(languages) + 1), PSEUDO)
    for k, x in enumerate(languages):
        words = f" {SEEDS.get(x, '')} ".encode()
        model[:, k] += np.bincount(cells(np.frombuffer(words, np.uint8)), minlength=CELLS) if len(words) > 2 else 0
    np.add.at(model, (cell, label), n)
    model[:, -1] = 1.0
    return np.log(model / model.sum(axis=0))


def _log_text(df: DataFrame, text_col: str, model: np.ndarray) -> Column:
    """Tempered log likelihoods of the text, an array of doubles: the languages and noise; null for texts without letters."""
    held = df.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        found = likelihoods(texts, held.value)
        evidence = np.minimum(found[:, -1:], EVIDENCE) * found[:, :-1]
        return pa.array(list(evidence), pa.list_(pa.float64()))

    return F.when(F.col(text_col).rlike(r"\p{L}"), score(prepared(F.col(text_col))))


def address_suffix(host: Column) -> Column:
    suffix = F.lower(F.regexp_extract(host.cast("string"), r"\.([A-Za-z]{2,})\.?$", 1))
    return F.when(suffix != "", suffix)


def _with_evidence(df: DataFrame, model: np.ndarray, languages: Sequence[str]) -> DataFrame:
    """(row, said, text, host) rows as (row, said, host, suffix, log): the log evidence without the host's prior."""
    k = len(languages)
    said = plain_language(F.col("said"))
    df = df.select("row", "said", "host", address_suffix(F.col("host")).alias("suffix"), _log_text(df, "text", model).alias("text"), F.when(said.isin(*languages), said).alias("declared"))
    usual = {s: x for s, x in SUFFIXES.items() if x in languages}
    df = df.withColumn("meant", F.create_map(*[F.lit(v) for s, x in usual.items() for v in (s, x)])[F.col("suffix")] if usual else F.lit(None).cast("string"))

    def hint(column: str, trust: float, language: str) -> Column:
        other = np.log((1 - trust) / max(1, k - 1))
        return F.when(F.col(column).isNull(), 0.0).when(F.col(column) == language, float(np.log(trust))).otherwise(float(other))

    parts = [F.col("text")[i] + hint("declared", DECLARED, x) + hint("meant", SUFFIX, x) for i, x in enumerate(languages)]
    noise = F.col("text")[k] + float(np.log(1 / k)) * (F.col("declared").isNotNull().cast("int") + F.col("meant").isNotNull().cast("int"))
    return df.select("row", "said", "host", "suffix", F.when(F.col("text").isNotNull(), F.array(*parts, noise)).alias("log"))


def _posterior(log: Column) -> Column:
    top = F.array_max(log)
    weights = F.transform(log, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def host_priors(evidence: DataFrame, languages: Sequence[str] = LANGUAGES) -> tuple[DataFrame, list[float]]:
    """(name, prior: log probabilities by language) for (host, suffix, log) rows, and the table's own prior."""
    k = len(languages)
    known = evidence.where("log IS NOT NULL").withColumn("p", _posterior(F.col("log")))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)]
    hosts = materialize(known.groupBy("host", "suffix").agg(*sums), "host-counts")
    total = [x or 0.0 for x in hosts.agg(*[F.sum(f"n{i}") for i in range(k)]).first()]
    table = [(x + LEAN / k) / (sum(total) + LEAN) for x in total]
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(k)]).withColumnRenamed("suffix", "of")
    all_s = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    # A host without a suffix leans on the whole table.
    leans = suffixes.select("of", *[F.when(F.col("of").isNull(), table[i]).otherwise((F.col(f"s{i}") + LEAN * table[i]) / (all_s + LEAN)).alias(f"q{i}") for i in range(k)])
    joined = hosts.join(leans, F.col("suffix").eqNullSafe(F.col("of"))).where("host IS NOT NULL")
    all_n = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    prior = F.array(*[F.log((F.col(f"n{i}") + LEAN * F.col(f"q{i}")) / (all_n + LEAN)) for i in range(k)])
    return materialize(joined.select(F.col("host").alias("name"), prior.alias("prior")), "host-priors"), [float(np.log(x)) for x in table]


def _decide(evidence: DataFrame, priors: DataFrame, table: list[float], languages: Sequence[str]) -> DataFrame:
    """(row, said, language: null if rejected, sure)."""
    k = len(languages)
    joined = evidence.join(bounded_broadcast(priors), F.col("host") == F.col("name"), "left")
    prior = F.coalesce("prior", F.array(*[F.lit(x) for x in table]))
    noise = F.col("log")[k] + float(np.log(1 / k))
    joined = joined.select("row", "said", _posterior(F.array(*[F.col("log")[i] + prior[i] for i in range(k)], noise)).alias("p"))
    best = F.array_max("p")
    named = F.element_at(F.array(*[F.lit(x) for x in languages], F.lit(None).cast("string")), F.array_position("p", best).cast("int"))
    return joined.select("row", "said", F.when(best >= SURE, named).alias("language"), F.coalesce(best, F.lit(0.0)).alias("sure"))


def _rows(df: DataFrame, row: Column, text_col: str, declared: Column | None, host: Column | None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    text = F.col(f"`{text_col}`")
    return df.select(row.alias("row"), text.alias("text"), (nothing if declared is None else declared.cast("string")).alias("said"), (nothing if host is None else host.cast("string")).alias("host"))


def _labels(df: DataFrame, id_col: str, text_col: str, label_col: str | None, labelled: DataFrame | None) -> DataFrame | None:
    return labelled if label_col is None else df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, labelled: DataFrame | None = None, label_col: str | None = None, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: id, declared, language (null if rejected), confidence, kept.

    declared: the declared language; host: the host or source; labelled: (id, text, label) rows that fit the models, or label_col: a
    column of df that does, which then must not be the declared one.
    """
    has_columns(df, id_col, text_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    model = fit_model(_labels(df, id_col, text_col, label_col, labelled), languages, sample)
    evidence = materialize(_with_evidence(_rows(df, F.col(f"`{id_col}`"), text_col, declared, host), model, languages), "evidence")
    found = _decide(evidence, *host_priors(evidence, languages), languages)
    return found.select(F.col("row").alias(id_col), F.col("said").alias("declared"), "language", F.round("sure", 6).alias("confidence"), F.col("language").isNotNull().alias("kept"))


def drop_unidentified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, labelled: DataFrame | None = None, label_col: str | None = None, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """The rows whose language is found, with all their columns. Texts are read twice rather than shuffled."""
    has_columns(df, id_col, text_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    model = fit_model(_labels(df, id_col, text_col, label_col, labelled), languages, sample)
    evidence = _with_evidence(_rows(df, F.struct(*[F.col(f"`{c}`") for c in df.columns]), text_col, declared, host), model, languages)
    narrow = materialize(evidence.select("host", "suffix", "log"), "evidence")
    return _decide(evidence, *host_priors(narrow, languages), languages).where("language IS NOT NULL").select("row.*")


def identify_pages(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """One row for each page, by its main text, the language that its markup declares, its address's suffix and its host. labelled: (id, text, label) rows that fit the models."""
    has_columns(pages, id_col, url_col, html_col)
    markup = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    declared = markup.select("page_id", markup_language(F.col("html")).alias("said")).dropDuplicates(["page_id"])
    texts = main_text(markup).join(declared, "page_id")
    found = identify(texts, "page_id", "text", F.col("said"), host_of(F.col("url")), labelled, None, languages, sample)
    return found.withColumnRenamed("page_id", id_col)
