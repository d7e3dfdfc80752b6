"""Reading level of English prose by smoothed unigram language models, one for each level.

A text is read as five streams of unigram events: its words, the syllables of each word, the letters
of each word, and the length of each sentence (once for each sentence, and once for each of its words), the
quantities that readability formulas are made of. For each stream and level a unigram model is trained on
labelled texts and smoothed towards the stream's overall distribution (Dirichlet prior). A text gets the level of
highest posterior likelihood: the prior of the level times the likelihood of all events.

Whether a text is English prose is told by models of letter trigrams, one for each language that the corpus's own
labels name: no other may be likelier, and English must be likely enough (formulas, sequences and listings of symbols are not).
All rated texts and all texts with a language label are counted. The counts are added up in Spark, and the driver gets one row
for each event; the bound on what is likely enough is the exact median of all texts labelled English.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laserloom.functions.stats import exact_hazen
from laserloom.llm.bpe import spare
from laserloom.session import materialise

LEVELS = (1, 2, 3, 4)
#: Weight of the overall distribution in each stream's models, in events.
SMOOTHING = {"word": 300.0, "syllables": 5.0, "letters": 5.0, "sentence": 3.0, "sentence_words": 5.0}
STREAMS = tuple(SMOOTHING)
#: Words between white space that a prose text has at least.
LEAST_WORDS = 60
#: Rated ids that are broadcast at most; more are joined by a shuffle.
FEW = 1_000_000
#: Distinct words, by language, that a task holds before it passes their counts on.
HELD = 100_000
#: By how much, in the mean log likelihood of a trigram, another language must be likelier than English.
MARGIN = 0.5
#: How far that mean may lie below the usual one of English texts: each trigram a third as likely. (At sf0.1 prose lies
#: within 0.25 of it, scan errors and machine translations included, and no formula or sequence within 2.2.)
PROSE = 1.1

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?;:]+(?=\s|$)|\n\s*\n")
_BREAK = re.compile(r"-\r?\n|\xad")
_VOWELS = re.compile(r"[aeiouy]+")
#: Common English function words: their share tells English prose where the corpus has no language labels.
FUNCTION_WORDS = frozenset(
    "the a an of is are was be been being and or to in on at by for with from as that which this it its can may must not no has have into one all each such when where while if than so but they we you there near more".split()
)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower-cased; words broken at a line's end are joined."""
    t = _BREAK.sub("", text.lower()).replace("\r\n", "\n")
    return [w for w in map(_WORD.findall, _SENTENCE.split(t)) if w]


def is_english_prose(text: str | None, sents: list[list[str]], least_words: int = LEAST_WORDS, share: float = 0.25) -> bool:
    """At least `least_words` words between white space, and English function words make up `share` of them."""
    if not text or len(text.split()) < least_words:
        return False
    n = sum(map(len, sents))
    return n > 0 and sum(w in FUNCTION_WORDS for s in sents for w in s) >= share * n


def _events(word: str) -> tuple[int, int]:
    return min(max(1, len(_VOWELS.findall(word))), 9), min(len(word), 20)


def _length_class(n: int) -> int:
    return min(int(math.log2(n) * 3), 30)


def stream_counts(sents: list[list[str]]) -> dict[str, Counter]:
    words = Counter(w for s in sents for w in s)
    syllables, letters = Counter(), Counter()
    for w, n in words.items():
        a, b = _events(w)
        syllables[a] += n
        letters[b] += n
    once = Counter(_length_class(len(s)) for s in sents)
    each: Counter = Counter()
    for s in sents:
        each[_length_class(len(s))] += len(s)
    return dict(zip(STREAMS, (words, syllables, letters, once, each)))


def smoothed(total: dict, alpha: float) -> dict:
    """Event -> smoothed log probability under each level, from event -> weighted counts by level."""
    size = sum(total.values(), np.zeros(len(LEVELS)))
    whole = max(size.sum(), 1e-9)
    return {e: np.log((v + alpha * v.sum() / whole) / (size + alpha)) for e, v in total.items() if v.sum() > 0}


def score_stream(model: dict, counts: Counter) -> np.ndarray:
    """Log likelihood of the known events under each level."""
    s = np.zeros(len(LEVELS))
    for e, k in counts.items():
        p = model.get(e)
        if p is not None:
            s += k * p
    return s


def trigrams(word: str) -> list[str]:
    p = f"^{word}$"
    return [p[i : i + 3] for i in range(len(p) - 2)]


@dataclass
class LanguageModel:
    """Letter trigrams by language. least: mean log likelihood of a trigram that English prose reaches."""

    languages: list[str]
    logp: dict[str, np.ndarray]
    unknown: np.ndarray
    least: float = -np.inf

    @classmethod
    def of(cls, counts: dict[str, Counter], alpha: float = 0.5) -> LanguageModel | None:
        """counts: trigrams of each language; None without English or without any other language."""
        names = sorted(k for k, c in counts.items() if c)
        if "en" not in names or len(names) < 2:
            return None
        known = set().union(*(counts[k] for k in names))
        size = np.array([sum(counts[k].values()) for k in names]) + alpha * (len(known) + 1)
        return cls(names, {g: np.log((np.array([counts[k].get(g, 0) for k in names]) + alpha) / size) for g in known}, np.log(alpha / size))

    def word(self, w: str) -> np.ndarray:
        """Log likelihood of a word's trigrams under each language, and their number."""
        g = trigrams(w)
        return np.append(sum((self.logp.get(x, self.unknown) for x in g), np.zeros(len(self.languages))), len(g))

    def english(self, sums: np.ndarray) -> float:
        """Mean log likelihood of a trigram in English; -inf if another language is likelier by more than `MARGIN`, which
        a model made of English texts with wrong labels never is. sums: of word()."""
        mean = sums[:-1] / max(sums[-1], 1.0)
        en = mean[self.languages.index("en")]
        return en if sums[-1] and en >= mean.max() - MARGIN else -np.inf


@dataclass
class ReadingModel:
    """Unigram models by stream, log priors of the levels, and what tells English prose."""

    streams: dict[str, dict]
    prior: np.ndarray
    language: LanguageModel | None = None

    def best(self, likelihood: np.ndarray) -> int:
        return LEVELS[int((likelihood + self.prior).argmax())]

    def level(self, sents: list[list[str]]) -> int:
        c = stream_counts(sents)
        return self.best(sum(score_stream(self.streams[k], c[k]) for k in STREAMS))


#: Counts by level of each event: stream -> event -> counts, each text's weighted by its ratings.
Totals = dict[str, dict]


def new_totals() -> Totals:
    return {k: {} for k in STREAMS}


def add_counts(totals: Totals, counts: dict[str, Counter], weights: np.ndarray) -> None:
    for k in STREAMS:
        of = totals[k]
        for e, n in counts[k].items():
            of[e] = of.get(e, 0.0) + n * weights


def model_of(totals: Totals, weights: np.ndarray) -> ReadingModel:
    """weights: how many labelled texts have each level."""
    with np.errstate(divide="ignore"):
        return ReadingModel({k: smoothed(totals[k], SMOOTHING[k]) for k in STREAMS}, np.log(weights / weights.sum()))


def fit(counts: list[dict[str, Counter]], weights: np.ndarray) -> ReadingModel:
    """counts: streams of each labelled text; weights: texts x levels, each row adding up to 1. In memory."""
    totals = new_totals()
    for c, w in zip(counts, weights):
        add_counts(totals, c, w)
    return model_of(totals, weights.sum(0))


def language_code(lang: Column) -> Column:
    """Two letters of an untidy language label; null for none or an undetermined one."""
    k = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1))
    return F.when(k != "", k)


def _with_language(documents: DataFrame, per_language: int | None) -> DataFrame:
    """doc_id, text, lang (null: of no known language, or left out by `per_language`) of the texts that aren't null."""
    lang = language_code(F.col("lang")) if "lang" in documents.columns else F.lit(None).cast("string")
    known = documents.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).where("text is not null")
    if per_language is None:
        return known
    # ranks up to a small limit are cut map-side, so the commonest language gathers no ids
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    some = known.where("doc_id is not null and lang is not null").select("doc_id", "lang").withColumn("k", F.row_number().over(by_hash))
    some = some.where(F.col("k") <= per_language).select("doc_id", F.lit(True).alias("some")).distinct()
    return known.join(F.broadcast(some), "doc_id", "left").select("doc_id", "text", F.when(F.col("some"), F.col("lang")).alias("lang"))


def _is_few(ids: DataFrame, few: int) -> bool:
    return ids.limit(few + 1).count() <= few


def _trained(known: DataFrame, labels: DataFrame, most: int | None, few: int) -> ReadingModel | None:
    """The models, without a bound on prose. known: of _with_language()."""
    names = [f"w{n}" for n in LEVELS]
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("level").isin(*LEVELS))
    rated = ok.groupBy("doc_id").agg(*[F.avg((F.col("level") == n).cast("double")).alias(f"w{n}") for n in LEVELS])
    if most is not None:
        rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = known.join(F.broadcast(rated) if _is_few(rated, few) else rated, "doc_id", "left").where("w1 is not null or lang is not null").select("text", *names, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, words, weights = new_totals(), defaultdict(Counter), np.zeros(len(LEVELS))

        def counted() -> pa.RecordBatch:
            rows = [("rated", "", *weights)] + [(k, str(e), *v) for k, es in totals.items() for e, v in es.items()]
            for x, c in words.items():
                grams: Counter = Counter()
                for w, n in c.items():
                    for g in trigrams(w):
                        grams[g] += n
                rows += [(f"lang {x}", g, float(n), 0.0, 0.0, 0.0) for g, n in grams.items()]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*rows))], names=["kind", "event", *names])

        for b in batches:
            for t, *w, lang in zip(*(c.to_pylist() for c in b.columns)):
                sents = sentences(t)
                if w[0] is not None:
                    add_counts(totals, stream_counts(sents), np.array(w))
                    weights += w
                if lang is not None:
                    for s in sents:
                        words[lang].update(s)
                if len(totals["word"]) + sum(map(len, words.values())) > HELD:
                    yield counted()
                    totals, words, weights = new_totals(), defaultdict(Counter), np.zeros(len(LEVELS))
        yield counted()

    got = texts.mapInArrow(count, "kind string, event string, " + ", ".join(f"{n} double" for n in names))
    totals, grams, weights = new_totals(), defaultdict(Counter), np.zeros(len(LEVELS))
    for kind, event, *w in sorted(tuple(r) for r in got.groupBy("kind", "event").agg(*[F.sum(n).alias(n) for n in names]).collect()):
        if kind == "rated":
            weights = np.array(w)
        elif kind in totals:
            totals[kind][event if kind == "word" else int(event)] = np.array(w)
        else:
            grams[kind[5:]][event] = w[0]
    if not weights.any():
        return None
    m = model_of(totals, weights)
    m.language = LanguageModel.of(grams)
    return m


def train_reading_model(documents: DataFrame, labels: DataFrame, most: int | None = None, per_language: int | None = None, few: int = FEW) -> ReadingModel | None:
    """Fit on all labelled texts, and the test of language on all texts with a language label; if wanted, on at most `most`
    labelled texts and `per_language` texts of each language (those of least hash of doc_id).

    Ratings of one text that differ share its weight; ratings outside 1 to 4, of unknown texts or of null ids are
    passed over; None if none is left. At most `few` rated ids are broadcast with their ratings. The events are counted and
    added up in Spark, so the driver gets a row for each event; then the English ones are scored for the bound on prose."""
    known = _with_language(documents, per_language)
    m = _trained(known, labels, most, few)
    if m and m.language:
        bounded(m.language, materialise(_read(known.where("lang = 'en'"), m, []), "reading"))
    return m


def bounded(language: LanguageModel, read: DataFrame) -> LanguageModel:
    """The model with the least likelihood of English prose: the median of the texts labelled English, which wrong labels
    do not move, less `PROSE`. read: column english of all these texts."""
    (en,) = exact_hazen(read.where(F.col("english") > F.lit(-math.inf)), "english", [0.5])
    if en is not None:
        language.least = en - PROSE
    return language


class Scorer:
    """Levels of texts; what a word adds to its streams and to each language is worked out once per worker."""

    def __init__(self, model: ReadingModel, keep: int = 500_000):
        self.m, self.keep = model, keep
        self.extra = len(model.language.languages) + 1 if model.language else 0
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LEVELS) + self.extra))

    def _row(self, w: str) -> int:
        k = self.rows.get(w)
        if k is None:
            a, b = _events(w)
            k = self.rows[w] = len(self.rows)
            if k == len(self.table):  # twice as large: a word costs the same however many there are
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            s = self.m.streams
            for p in (s["word"].get(w), s["syllables"].get(a), s["letters"].get(b)):
                if p is not None:
                    self.table[k, : len(LEVELS)] += p
            if self.extra:
                self.table[k, len(LEVELS) :] = self.m.language.word(w)
        return k

    def __call__(self, text: str | None) -> int | None:
        if not text or len(text.split()) < LEAST_WORDS:
            return None
        level, english = self.read(text)
        return None if self.extra and english < self.m.language.least else level

    def read(self, text: str | None) -> tuple[int | None, float]:
        """Level of a text that has words enough, whatever the bound on prose, and its mean log likelihood in English (-inf
        without language models, where the function words decide)."""
        if not text:
            return None, -math.inf
        sents = sentences(text)
        if not self.extra and not is_english_prose(text, sents):
            return None, -math.inf
        if len(self.rows) > self.keep:
            self.clear()
        words = Counter(w for s in sents for w in s)
        if not words:
            return None, -math.inf
        idx = [self._row(w) for w in words]
        sums = np.fromiter(words.values(), float, len(words)) @ self.table[idx]
        english = float(self.m.language.english(sums[len(LEVELS) :])) if self.extra else -math.inf
        if len(text.split()) < LEAST_WORDS:
            return None, english
        once = Counter(_length_class(len(s)) for s in sents)
        each: Counter = Counter()
        for s in sents:
            each[_length_class(len(s))] += len(s)
        of = self.m.streams
        return self.m.best(sums[: len(LEVELS)] + score_stream(of["sentence"], once) + score_stream(of["sentence_words"], each)), english


def reading_levels(documents: DataFrame, model: ReadingModel | None, *, text: str = "text", out: str = "level", keep: list[str] | None = None) -> DataFrame:
    """Add `out` (LONG): the level of each text, null where it isn't English prose of at least 60 words.

    Null, empty and blank texts, other languages, formulas and listings get null; without a model all do.
    A column that already bears the name `out` is replaced. One narrow pass over whole texts."""
    cols = [c for c in (documents.columns if keep is None else keep) if c != out]
    src = documents.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("string").alias(spare("__text", cols)))
    schema = T.StructType([*documents.select(*[F.col(f"`{c}`") for c in cols]).schema.fields, T.StructField(out, T.LongType())])
    k = len(cols)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value) if held.value else lambda _: None
        for b in batches:
            got = [score(t) for t in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(got, pa.int64())], names=[*cols, out])

    return src.mapInArrow(run, schema)


def _read(known: DataFrame, model: ReadingModel, keep: list[str]) -> DataFrame:
    """Columns `keep`, level and english of each text, as Scorer.read() gives them."""
    k = len(keep)
    schema = T.StructType([*known.select(*keep).schema.fields, T.StructField("level", T.LongType()), T.StructField("english", T.DoubleType())])
    held = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for b in batches:
            got = [score.read(t) for t in b.column(k).to_pylist()]
            level, english = pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], level, english], names=[*keep, "level", "english"])

    return known.select(*keep, "text").mapInArrow(run, schema)


def unlabelled_levels(documents: DataFrame, labels: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, level of the English prose texts that nobody has rated.

    Two passes over all texts: one counts, one scores. The scores (a few numbers for each text) are written to the shared folder,
    as the bound on prose is the median of all English ones. At most `few` rated ids (counted first) are broadcast;
    more are joined by a shuffle."""
    known = _with_language(documents, None)
    model = _trained(known, labels, None, few)
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("long").alias("level")).limit(0)
    read = materialise(_read(known.withColumn("en", F.col("lang").eqNullSafe("en")), model, ["doc_id", "en"]), "reading")
    got = read.where("level is not null")
    if model.language:
        got = got.where(F.col("english") >= F.lit(bounded(model.language, read.where("en")).least))
    rated = labels.select("doc_id").where("doc_id is not null").distinct()
    return got.select("doc_id", "level").join(F.broadcast(rated) if _is_few(rated, few) else rated, "doc_id", "left_anti")
