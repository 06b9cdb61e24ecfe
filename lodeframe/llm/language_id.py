"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 a language. A text is folded to lower-case letters; everything else separates words. A model predicts
each letter, and the end of each word, from up to three characters before it in the same word, so a word's context is the
word alone and documents never meet. Counting is a distributed aggregation over all training texts. The finished tables are
arrays sorted by the hash of the gram, with one column of log-probabilities a language, in which backing off to shorter
grams is already worked out for every gram that any language has seen.

A text goes to the language of the lowest cross-entropy per predicted character. It is rejected where even that is nearer to
the cross-entropy of random letters than to the language's own entropy, beyond what chance does to a text of its length. How
much that is, is calibrated: all training texts tell for each language how many standard errors the limit must leave for all
but one in 10,000 of its own texts to pass, one at least.

Size: models of up to ``max_grams`` grams go to every executor. Where training yields more, all are kept in written tables, and
the grams of the texts are joined with these, to the same results but for rounding. Letters beyond the 16-bit plane share codes with others of their kind.

Defined results: a null text, an empty one and one without letters get ``und`` with score 0 and are rejected; ties go to the
first language in alphabetical order; repeated rows are each predicted; null ``lang`` rows don't train; without any
training rows every text is ``und``; an empty table gives an empty result; other columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lodeframe.llm.common import mix, written

#: Pairs of a language and a gram up to which models are broadcast; they are under 100 MB then.
MAX_GRAMS = 3_000_000
#: Grams of a language that a counting worker holds.
HELD_GRAMS = 1_000_000
#: The share of a language's labelled texts that may be rejected; standard errors without any.
REJECTED = 1e-4
CHANCE = 4.0
SPACE = 32
UNDETERMINED = "und"
_CACHE_BITS = 20

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point: its lower-case letter in 16 bits, or the space."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, SPACE, np.uint16)
        for point in range(0x110000):
            if (letter := chr(point)).isalpha():
                low = ord(letter.lower()[0])
                table[point] = low if low < 0xE000 else 0xE000 + low % 0x1F00
        _fold = table
    return _fold


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of all texts, four 16-bit codes in 64 bits with the predicted one lowest, and the n + 1 bounds of the texts among them."""
    texts = [x or "" for x in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # A space stands before each text and after the last.
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = fold_table()[points]
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    keep[0] = False
    rank = np.concatenate([[0], np.cumsum(keep)])
    codes = codes[keep].astype(np.uint64)
    # The space that ends a text's last word is its own: it stands at the start of the next text less one.
    bounds = rank[np.minimum(starts, len(points))]
    space = np.uint64(SPACE)
    before = np.concatenate([np.full(3, space), codes])
    one = before[2:-1]
    two = np.where(one == space, space, before[1:-2])
    three = np.where(two == space, space, before[:-3])
    return three << np.uint64(48) | two << np.uint64(32) | one << np.uint64(16) | codes, bounds


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts, len(found))


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows(lang):
        keys, counts = held[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    for batch in source:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = list(texts[langs == lang])
            for lo in range(0, len(own), 512):
                keys, counts = np.unique(grams(own[lo : lo + 512])[0], return_counts=True)
                if lang in held:
                    keys, counts = _sums(np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], counts]))
                held[lang] = (keys, counts)
            if len(held[lang][0]) > HELD_GRAMS:  # bounds the worker's memory; Spark adds up the parts
                yield rows(lang)
                del held[lang]
    for lang in sorted(held):
        yield rows(lang)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all texts of ``(text, lang)``."""
    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Tables by order; ``keys[k]`` are sorted hashes of (k+1)-grams, ``logs[k]`` their log-probabilities by language, ``contexts``
    and ``backs`` the weights of contexts; ``floor`` is the log-probability of an unseen character; ``chance`` is what rejection leaves."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray
    entropy: np.ndarray
    spread: np.ndarray
    random: np.ndarray
    chance: np.ndarray

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of 4-grams, a column a language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        live = np.arange(len(grams))
        for order in range(4, 0, -1):
            own = grams[live] & _mask(order)
            at, hit = _find(self.keys[order - 1], own)
            out[live[hit]] += self.logs[order - 1][at[hit]]
            live, own = live[~hit], own[~hit]
            if order == 1:
                out[live] += self.floor
            else:
                at, hit = _find(self.contexts[order - 2], own >> np.uint64(16))
                out[live[hit]] += self.backs[order - 2][at[hit]]
        return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a table of sorted hashes, and which are there."""
    hashes = mix(keys)
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def fit_counts(langs: list[str], by_lang: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models of the languages' 4-gram counts."""
    n = len(langs)
    grams_of: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{}, {}, {}, {}]
    for lang in langs:
        keys, counts = by_lang[lang]
        grams_of[3][lang] = (keys, counts.astype(np.float64))
        for order in range(3, 0, -1):  # how many different characters a shorter gram follows
            keys = np.unique(grams_of[order][lang][0])
            grams_of[order - 1][lang] = _sums(keys & _mask(order), np.ones(len(keys)))
    tables = [np.unique(np.concatenate([grams_of[k][x][0] for x in langs])) for k in range(4)]
    order_by = [np.argsort(mix(x)) for x in tables]
    model = Model(langs, [mix(x)[o] for x, o in zip(tables, order_by, strict=True)], [], [], [], np.zeros(n, np.float32), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, CHANCE))
    letters = max(2, len(tables[0]) + 1)
    lower: np.ndarray | None = None
    by_order: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, table in enumerate(tables):
        probs = np.zeros((len(table), n))
        contexts = np.unique(table >> np.uint64(16)) if k else np.zeros(1, np.uint64)
        backs = np.ones((len(contexts), n))
        if k:
            below = np.searchsorted(tables[k - 1], table & _mask(k))
        for j, lang in enumerate(langs):
            keys, counts = grams_of[k][lang]
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(contexts, keys >> np.uint64(16)) if k else np.zeros(len(keys), np.int64)
            total = np.bincount(at, counts, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            backs[seen, j] = discount * kinds[seen] / total[seen]
            base = lower[below, j] if k else np.full(len(table), 1 / letters)
            where = np.searchsorted(contexts, table >> np.uint64(16)) if k else np.zeros(len(table), np.int64)
            probs[:, j] = backs[where, j] * base
            probs[np.searchsorted(table, keys), j] += (counts - discount) / total[at]
        lower = probs
        by_order.append((probs, contexts, backs))
        model.logs.append(np.log(probs[order_by[k]]).astype(np.float32))
        if k:
            o = np.argsort(mix(contexts))
            model.contexts.append(mix(contexts)[o])
            model.backs.append(np.log(backs[o]).astype(np.float32))
        else:
            model.floor = np.log(backs[0] / letters).astype(np.float32)
    # Random letters, the mean over all runs of four letters: backing off for every run, then what seen grams have instead.
    v, mean = len(tables[0]), np.zeros(n)
    for k, (table, (probs, contexts, backs)) in enumerate(zip(tables, by_order, strict=True)):
        logs = np.log(probs)
        if k:
            mean += np.log(backs).sum(axis=0) / v**k
            at = np.searchsorted(contexts, table >> np.uint64(16))
            logs -= np.log(backs[at]) + np.log(by_order[k - 1][0][np.searchsorted(tables[k - 1], table & _mask(k))])
        mean += logs.sum(axis=0) / v ** (k + 1)
    model.random = -mean
    # A language's own entropy and spread by its counts.
    for j, lang in enumerate(langs):
        keys, counts = grams_of[3][lang]
        logs = model.score(keys)[:, j].astype(np.float64)
        model.entropy[j] = -(counts @ logs) / counts.sum()
        model.spread[j] = np.sqrt(max(0.0, counts @ (logs + model.entropy[j]) ** 2 / counts.sum()))
    return model


@dataclass
class Limits:
    """What a decision needs of the models besides a text's scores."""

    langs: list[str]
    entropy: np.ndarray
    spread: np.ndarray
    random: np.ndarray
    chance: np.ndarray


@dataclass
class Tables:
    """The models as tables by order: ``own[k]`` is ``(key, mass)``, what counts alone give a (k+1)-gram, ``backs[k]`` is ``(context, back)``;
    both values are arrays by language."""

    limits: Limits
    letters: int
    own: list[DataFrame]
    backs: list[DataFrame]

    def probabilities(self, grams: DataFrame, orders: int = 4) -> DataFrame:
        """``grams`` with ``p0`` up to the highest order's ``p`` and its ``back``, arrays by language."""
        n = range(len(self.limits.langs))
        rows = grams.withColumn("p0", F.array(*[F.lit(1 / self.letters) for _ in n]))
        for k in range(orders):
            key = F.col("gram") if k == 3 else F.col("gram").bitwiseAND(F.lit(int(_mask(k + 1))))
            rows = rows.drop("back").withColumn("key", key).withColumn("context", F.shiftrightunsigned("key", 16))
            backs = F.broadcast(self.backs[k]) if k == 0 else self.backs[k]
            rows = rows.join(self.own[k], "key", "left").join(backs, "context", "left").drop("key", "context")
            back = F.coalesce("back", F.array(*[F.lit(1.0) for _ in n]))
            mass = F.coalesce("mass", F.array(*[F.lit(0.0) for _ in n]))
            rows = rows.withColumn("back", back).withColumn("mass", mass)
            rows = rows.withColumn(f"p{k + 1}", F.array(*[F.col("mass")[i] + F.col("back")[i] * F.col(f"p{k}")[i] for i in n])).drop("mass")
        return rows


def fit_tables(counts: DataFrame) -> Tables:
    """The models of ``fit_counts`` from ``(lang, gram, n)``, without gathering grams anywhere."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    n = len(langs)

    def by_lang(rows: DataFrame, key: str, value: str, default: float) -> DataFrame:
        every = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col(value))), F.lit(default)) for x in langs]
        return rows.groupBy(key).agg(F.array(*every).alias(value))

    own, backs = [], []
    rows = counts.select("lang", F.col("gram").alias("key"), F.col("n").cast("double").alias("n"))
    for k in range(3, -1, -1):
        if k < 3:  # how many different characters a shorter gram follows
            rows = written(rows.groupBy("lang", F.col("key").bitwiseAND(F.lit(int(_mask(k + 1)))).alias("key")).agg(F.count("*").cast("double").alias("n")), "lid-counts")
        few = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
        discounts = {r.lang: r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5 for r in few}
        discount = F.coalesce(*[F.when(F.col("lang") == x, F.lit(float(d))) for x, d in discounts.items()])
        at = rows.withColumn("context", F.shiftrightunsigned("key", 16))
        totals = at.groupBy("lang", "context").agg(F.sum("n").alias("total"), (discount * F.count("*") / F.sum("n")).alias("back"))
        totals = written(totals, "lid-totals")
        if k == 0:  # one context a language
            totals = F.broadcast(totals)
        mass = at.join(totals.select("lang", "context", "total"), ["lang", "context"]).withColumn("mass", (F.col("n") - discount) / F.col("total"))
        own.insert(0, written(by_lang(mass, "key", "mass", 0.0), "lid-own"))
        backs.insert(0, written(by_lang(totals, "context", "back", 1.0), "lid-backs"))
    v = own[0].count()
    limits = Limits(langs, np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, CHANCE))
    tables = Tables(limits, max(2, v + 1), own, backs)
    logs = tables.probabilities(own[3].select(F.col("key").alias("gram"))).select("gram", "p4")
    log = F.log(F.coalesce(*[F.when(F.col("lang") == x, F.col("p4")[j]) for j, x in enumerate(langs)]))
    for r in counts.join(logs, "gram").withColumn("log", log).groupBy("lang").agg(F.sum("n"), F.sum(F.col("n") * F.col("log")), F.sum(F.col("n") * F.col("log") * F.col("log"))).collect():
        j = langs.index(r[0])
        limits.entropy[j] = -r[2] / r[1]
        limits.spread[j] = np.sqrt(max(0.0, r[3] / r[1] - limits.entropy[j] ** 2))
    # Random letters, the mean over all runs of four letters: backing off for every run, then what seen grams have instead.
    mean = np.zeros(n)
    for k in range(4):
        found = tables.probabilities(own[k].select(F.col("key").alias("gram")), k + 1)
        logs = [F.log(F.col(f"p{k + 1}")[j]) for j in range(n)]
        if k:
            mean += np.array(backs[k].agg(*[F.sum(F.log(F.col("back")[j])) for j in range(n)]).first(), float) / float(v) ** k
            logs = [x - F.log(F.col("back")[j]) - F.log(F.col(f"p{k}")[j]) for j, x in enumerate(logs)]
        mean += np.array(found.agg(*[F.sum(x) for x in logs]).first(), float) / float(v) ** (k + 1)
    limits.random = -mean
    return tables


def fit(labelled: DataFrame, max_grams: int = MAX_GRAMS) -> Model | Tables | None:
    """Models of all languages of ``(text, lang)``; None if there are no letters to learn from."""
    counts = written(gram_counts(labelled), "gram-counts")
    if counts.count() > max_grams:
        model = fit_tables(counts)
    else:
        rows = counts.toArrow()
        lang_of = np.array(rows.column("lang").to_pylist(), object)
        keys, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        by_lang = {}
        for lang in sorted(set(lang_of)):
            own = lang_of == lang
            order = np.argsort(keys[own])
            by_lang[lang] = (keys[own][order], n[own][order])
        if not by_lang:
            return None
        model = fit_counts(sorted(by_lang), by_lang)
    calibrate(model, labelled)
    return model


def calibrate(model: Model | Tables, labelled: DataFrame) -> None:
    """Set ``chance`` by how far all labelled texts lie above the middle between their own language and random letters."""
    limits = model.limits if isinstance(model, Tables) else model
    texts = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    summed = _summed(texts, model, "text")
    own = F.array_position(F.array(*map(F.lit, limits.langs)), F.col("lang")).cast("int")

    def of_own(values: np.ndarray) -> Column:
        return F.element_at(F.array(*(F.lit(float(x)) for x in values)), own)

    entropy = -F.element_at("_lid_sums", own) / F.col("_lid_size")
    above = (entropy - of_own((limits.entropy + limits.random) / 2)) * F.sqrt("_lid_size") / of_own(np.maximum(limits.spread, 1e-9))
    measured = written(summed.where("_lid_size > 0").select("lang", above.alias("above")), "lid-above")
    # The limit is the value that as many are above as may be rejected. A sketch finds a value below it, the few from there on are ranked.
    low = measured.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("above", 1 - 2 * REJECTED, 100_000).alias("low"))
    few = measured.join(F.broadcast(low), "lang").where("above >= low")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("above"))))
    for row in ranked.where(F.col("rank") == F.floor(F.col("n") * REJECTED) + 1).collect():  # one row a language
        # A hair more, as the limit is worked out in another order.
        limits.chance[limits.langs.index(row.lang)] = max(1.0, row.above + 1e-9)


class Scorer:
    """A model with a direct-mapped cache in front of its tables."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(1 << _CACHE_BITS, np.uint64)  # no gram is 0
        self.values = np.zeros((1 << _CACHE_BITS, len(model.langs)), np.float32)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities of each text by language, and its number of predicted characters."""
        keys, bounds = grams(texts)
        sizes = np.diff(bounds)
        sums = np.zeros((len(texts), len(self.model.langs)))
        if len(keys):
            with np.errstate(over="ignore"):
                slots = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)
            missing = np.flatnonzero(self.keys[slots] != keys)
            values = self.values[slots]
            if len(missing):
                own, where = np.unique(keys[missing], return_inverse=True)
                scores = self.model.score(own)
                values[missing] = scores[where]
                self.keys[slots[missing]] = keys[missing]
                self.values[slots[missing]] = values[missing]
            full = sizes > 0
            sums[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
        return sums, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        return decided(self.model, *self.totals(texts))


def decided(m: Model | Limits, sums: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of texts by their summed log-probabilities and sizes."""
    some = sizes > 0
    entropy = -sums / np.maximum(sizes, 1)[:, None]
    best = entropy.argmin(axis=1)
    weights = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(sizes, 1))[:, None])
    score = np.where(some, (weights / weights.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
    lowest = entropy[np.arange(len(sizes)), best]
    limit = m.entropy[best] + (m.random[best] - m.entropy[best]) / 2 + m.chance[best] * m.spread[best] / np.sqrt(np.maximum(sizes, 1))
    langs = [m.langs[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
    return langs, score, np.where(some, lowest, np.nan), ~some | (lowest > limit)


def _gram_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of each text, with how often each is there."""
    for batch in source:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, counts = np.unique(grams([text])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row, np.int64)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["_lid_row", "gram", "n"])


def _summed(df: DataFrame, tables: Model | Tables, text: str) -> DataFrame:
    """``df`` with ``_lid_sums`` and ``_lid_size``, each text's summed log-probabilities by language and its number of predicted characters."""
    if isinstance(tables, Model):
        shared = df.sparkSession.sparkContext.broadcast(tables)
        fields = [StructField("_lid_sums", ArrayType(DoubleType())), StructField("_lid_size", LongType())]

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _scorer(shared)
            for batch in source:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    sums, sizes = scorer.totals(part.column(text).to_pylist())
                    columns = [*part.columns, pa.array(list(sums), pa.list_(pa.float64())), pa.array(sizes.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "_lid_sums", "_lid_size"])

        return df.mapInArrow(batches, StructType([*df.schema.fields, *fields]))
    rows = written(df.withColumn("_lid_row", F.monotonically_increasing_id()), "lid-rows")
    held = rows.select("_lid_row", F.col(text).cast("string")).mapInArrow(_gram_rows, "_lid_row long, gram long, n long")
    logs = tables.probabilities(held.select("gram").distinct()).select("gram", "p4")
    sums = [F.sum(F.col("n") * F.log(F.col("p4")[j])) for j in range(len(tables.limits.langs))]
    found = held.join(logs, "gram").groupBy("_lid_row").agg(F.array(*sums).alias("_lid_sums"), F.sum("n").alias("_lid_size"))
    return rows.join(found, "_lid_row", "left").drop("_lid_row")


#: By broadcast model; a scorer goes when its worker gets a task without that model.
_scorers: WeakKeyDictionary = WeakKeyDictionary()


def _scorer(shared) -> Scorer:
    """The scorer of a broadcast model, made once in a worker."""
    if shared not in _scorers:
        _scorers.clear()
        _scorers[shared] = Scorer(shared.value)
    return _scorers[shared]


def predict(df: DataFrame, model: Model | Tables | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred, score, cross_entropy, rejected`` after its own columns; nothing but the text is an input.

    Input columns of these names are replaced."""
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    kept = df.drop(*names)
    if model is None:
        return kept.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())])
    if isinstance(model, Tables):
        limits = model.limits

        def joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                own = batch.drop_columns(["_lid_sums", "_lid_size"])
                none = [0.0] * len(limits.langs)
                sums = np.array([x or none for x in batch.column("_lid_sums").to_pylist()]).reshape(-1, len(limits.langs))
                langs, score, entropy, rejected = decided(limits, sums, np.array([x or 0 for x in batch.column("_lid_size").to_pylist()], np.int64))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], [*own.schema.names, *names])

        return _summed(kept, model, text).mapInArrow(joined, schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                langs, score, entropy, rejected = scorer.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], [*part.schema.names, *names])

    return kept.mapInArrow(batches, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that doesn't train: crc32 of the id as text, modulo 4, is 2. A null id trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
