"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, runs of anything else become one space. Each language's model has
orders 1 to 4: counts of 4-grams, continuation counts (distinct left neighbours) below, one absolute
discount per order and language, down to a uniform distribution. A text goes to the
language of the lowest cross-entropy per character. Its score, from 0 to 1, is the product of two chances: a logistic
function of the margin to the second language, scaled by the root of the length, and one of how far the text's own cross-entropy
lies beyond what texts of that language have. A score below ``REJECT`` marks the text as rejected: a language that was not
learned is far from all models, however clear its margin. Both are calibrated on training texts that are held back from the
counts: of a tenth of the ids, those with the ``CALIBRATION`` smallest hashes.

Counting covers every letter of every other training text: tasks count, and Spark adds the counts by
language and 4-gram, which is named by its own 64 bits: letters are UTF-16 units, so one beyond 16 bits counts as two. While 4-grams times languages stay within ``SENT``, the model is
arrays in the order of a hash, which travel to the tasks; 4-grams of one hash stand side by side and are told apart by
their bits. A larger model stays in stored tables (``TableModels``): its lower orders are counted in Spark, and the texts meet
the distinct 4-grams of their piece by joins. Both forms do the same arithmetic.

Defined results: a text that is null or has no letter gets ``und`` and score 0. A document with a
null lang or text, or a null doc_id, is not learned from; a null doc_id counts as held out. A language whose texts
are all held back is not learned. With no training text at all, everything is ``und``; an empty table gives an empty one. Rows that repeat a doc_id each count. Equal scores go to the
language that is first by name. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import pieces, worker_state
from termlens.sources.workspace import materialize

ORDER = 4
#: Least bits of the hash that the arrays are looked up by; more 4-grams take more.
HASH_BITS = 21
#: Largest model, in 4-grams times languages, that is fitted on the driver and sent to the tasks.
SENT = 4_000_000
#: Training texts held back to calibrate scores on, at most, and the share of ids they are taken from.
CALIBRATION = 4_000
HELD_BACK = 10
REJECT = 0.5
#: The excess that this share of a language's texts stays below is widened by ``SLACK`` of itself to make the limit.
WITHIN, SLACK = 0.995, 0.5
#: How fast the score falls around the limit, and letters at which a text's excess counts 0.7.
STEEPNESS, SHORT = 10.0, 100
#: Least excess, in nats a letter, that a limit is made from.
LEAST_LIMIT = 0.5
UNKNOWN = "und"
#: Distinct 4-grams that a task holds before it hands its counts on.
HELD = 2_000_000


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = ord(chr(code).lower()[0])
    return table


def _units(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as UTF-16 units, with the owner of each."""
    wide = symbols > 0xFFFF
    if wide.any():
        times = 1 + wide
        second = np.cumsum(times)[wide] - 1
        rest = symbols[wide] - 0x10000
        symbols, owner = np.repeat(symbols, times), np.repeat(owner, times)
        symbols[second - 1], symbols[second] = 0xD800 + (rest >> 10), 0xDC00 + (rest & 0x3FF)
    return symbols.astype(np.uint64), owner


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every 4-gram of the texts and the number of the text that it ends in.

    The letter that it ends with is in the lowest 16 bits, the one before in the next.
    """
    table = worker_state("letters", _letters)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    symbols = table[codes]
    before = np.r_[np.uint32(0), symbols[:-1]]
    kept = (symbols != 0) | (before != 0)
    symbols, owner = _units(symbols[kept], owner[kept])
    packed = symbols.copy()
    for back in range(1, ORDER):
        same = owner[back:] == owner[:-back]
        packed[back:] |= np.where(same, symbols[:-back], np.uint64(0)) << np.uint64(16 * back)
    return packed, owner


def hashed(packed: np.ndarray, bits: int = HASH_BITS) -> np.ndarray:
    mixed = (packed ^ (packed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _bits(rows: int) -> int:
    return max(HASH_BITS, rows.bit_length() + 1)


def _suffix(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << (16 * order)) - 1)


@dataclass
class Level:
    """One order: sorted n-grams with log probabilities, sorted contexts with log back-off weights."""

    keys: np.ndarray
    chances: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


#: Languages, scores, margins, lowest cross-entropies and lengths of texts.
Judged = tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Calibration:
    """How sure a result is: the line of the margin, and for each language the usual cross-entropy and the least unusual one."""

    line: tuple[float, float] = (0.0, 1.0)
    usual: list[float] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)


@dataclass
class CharacterModels:
    languages: list[str]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    levels: list[Level] = field(default_factory=list)
    calibration: Calibration = field(default_factory=Calibration)

    def index(self) -> np.ndarray:
        """First row of the top level for each hash; its rows end where those of the next hash begin."""
        counts = np.bincount(self.hashes, minlength=1 << _bits(len(self.hashes)))
        return np.r_[0, np.cumsum(counts)].astype(np.int32)

    def _rows(self, packed: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Row of the top level for each 4-gram, -1 where it has none."""
        places, keys = hashed(packed, _bits(len(self.hashes))), self.levels[-1].keys
        rows, ends = index[places], index[places + 1]
        found = np.full(len(packed), -1, np.int32)
        left = np.flatnonzero(rows < ends)
        while len(left):
            same = keys[rows[left]] == packed[left]
            found[left[same]] = rows[left[same]]
            left = left[~same]
            rows[left] += 1
            left = left[rows[left] < ends[left]]
        return found

    def _lower(self, packed: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities under the orders up to ``order``, for n-grams by their own letters."""
        out = np.empty((len(packed), len(self.languages)), np.float32)
        level, keys = self.levels[order - 1], _suffix(packed, order)
        place = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
        known = level.keys[place] == keys
        out[known] = level.chances[place[known]]
        if not known.all():
            out[~known] = self._back_off(packed[~known], order)
        return out

    def _back_off(self, packed: np.ndarray, order: int) -> np.ndarray:
        """For n-grams that the order does not know: its context's weight and the order below."""
        level = self.levels[order - 1]
        contexts = _suffix(packed, order) >> np.uint64(16)
        place = np.minimum(np.searchsorted(level.contexts, contexts), len(level.contexts) - 1)
        known = level.contexts[place] == contexts
        weights = np.where(known[:, None], level.weights[place], np.float32(0))
        if order == 1:
            return weights + np.float32(-np.log(65_536.0))
        return weights + self._lower(packed, order - 1)

    def entropies(self, texts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for text and language, and the characters of each text."""
        packed, owner = grams(texts)
        rows = self._rows(packed, index)
        missing = np.flatnonzero(rows < 0)
        chances = self.levels[-1].chances[rows]
        if len(missing):
            chances[missing] = self._back_off(packed[missing], ORDER)
        return _means(chances, owner, len(texts))

    def predict(self, texts: list[str | None], index: np.ndarray) -> Judged:
        """Language, score, margin, lowest cross-entropy and length of each text."""
        if not self.languages:
            nothing = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), nothing, nothing, nothing, np.zeros(len(texts), np.int64)
        entropy, lengths = self.entropies([t or "" for t in texts], index)
        return _judged(self.languages, self.calibration, entropy, lengths)


@dataclass
class TableModels:
    """Models too large to send: the orders 1 to 4 as stored tables.

    ``grams`` hold gram and its counts by language (an array), ``contexts`` gram and the total and the types of what follows it.
    """

    languages: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    discounts: list[list[float]]
    letters: list[float]
    calibration: Calibration = field(default_factory=Calibration)

    def chances(self, queries: DataFrame, order: int = ORDER) -> DataFrame:
        """gram and its log probabilities by language, for the distinct n-grams ``gram`` of ``queries``.

        A join key has at most 2**16 rows: the letters before or after it.
        """
        return self._chances(queries, order).select("gram", F.col("log").alias("chances"))

    def _chances(self, queries: DataFrame, order: int) -> DataFrame:
        """gram, p (of n-grams that the order knows) and log, by language.

        As in the arrays, a known n-gram has the logarithm of its chance, and another one that of its context's
        weight, added to what the order below has, in 32 bits.
        """
        wanted = queries.select("gram", _shorter(order - 1).alias("short"), F.shiftrightunsigned("gram", 16).alias("context"))
        joined = wanted.join(self.grams[order - 1], "gram", "left")
        joined = joined.join(self.contexts[order - 1].withColumnRenamed("gram", "context"), "context", "left")
        if order > 1:
            lower = self._chances(wanted.select(F.col("short").alias("gram")).distinct(), order - 1)
            lower = lower.select(F.col("gram").alias("short"), F.col("p").alias("p_below"), F.col("log").alias("log_below"))
            joined = joined.join(lower, "short")
        is_known = F.col("held").isNotNull()
        chances, logs = [], []
        for number, discount in enumerate(self.discounts[order - 1]):
            held, total, types = (F.coalesce(F.col(c)[number], F.lit(0.0)) for c in ("held", "total", "types"))
            weight = F.when(total > 0, F.lit(discount) * types / total).otherwise(1.0)
            base = F.col("p_below")[number] if order > 1 else F.lit(1 / (self.letters[number] + 1))
            own = F.when(total > 0, F.greatest(held - discount, F.lit(0.0)) / total).otherwise(0.0)
            chances.append(own + weight * base)
            below = F.col("log_below")[number] if order > 1 else F.lit(-np.log(65_536.0)).cast("float")
            logs.append(F.when(is_known, F.log(own + weight * base).cast("float")).otherwise(F.log(weight).cast("float") + below))
        return joined.select("gram", F.array(*chances).alias("p"), F.array(*logs).alias("log"))


def _means(chances: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((texts, chances.shape[1]))
    for number in range(chances.shape[1]):
        sums[:, number] = np.bincount(owner, chances[:, number], texts)
    lengths = np.bincount(owner, minlength=texts)
    return -sums / np.maximum(lengths, 1)[:, None], lengths


def _judged(languages: list[str], calibration: Calibration, entropy: np.ndarray, lengths: np.ndarray) -> Judged:
    """Language, score, margin, lowest cross-entropy and length from the cross-entropies by text and language."""
    texts = np.arange(len(lengths))
    best = entropy.argmin(axis=1)
    lowest = entropy[texts, best].copy()
    entropy[texts, best] = np.inf
    margin = (entropy.min(axis=1) - lowest) * np.sqrt(lengths) if len(languages) > 1 else np.full(len(texts), 10.0)
    margin = np.where(lengths > 0, margin, 0.0)
    offset, slope = calibration.line
    score = 1 / (1 + np.exp(-np.clip(offset + slope * margin, -50, 50)))
    if calibration.limit:
        usual, limit = (np.array(values)[best] for values in (calibration.usual, calibration.limit))
        # one half at the limit, next to one where the cross-entropy is the usual one
        beyond = (_excess(lowest, usual, lengths) - limit) / limit
        score = score / (1 + np.exp(np.clip(STEEPNESS * beyond, -50, 50)))
    score = np.where(lengths > 0, score, 0.0)
    return [languages[b] if n else UNKNOWN for b, n in zip(best, lengths)], score, margin, lowest, lengths


def _excess(entropy: np.ndarray, usual: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How far a text's cross-entropy is above the usual one; that of few letters varies more, and counts less."""
    return (entropy - usual) * np.sqrt(lengths / (lengths + SHORT))


def _discount(counts: np.ndarray) -> np.ndarray:
    once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
    return np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1.0), 0.5)


def kneser_ney(packed: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels from distinct 4-grams and their counts by language."""
    tables = [(packed, counts)]
    for order in range(ORDER - 1, 0, -1):
        upper, held = tables[0]
        keys, place = np.unique(_suffix(upper, order), return_inverse=True)
        below = np.zeros((len(keys), counts.shape[1]))
        np.add.at(below, place, (held > 0).astype(float))
        tables.insert(0, (keys, below))
    letters = np.maximum((tables[0][1] > 0).sum(axis=0), 1)
    levels, lower = [], None
    for order, (keys, held) in enumerate(tables, 1):
        contexts, place = np.unique(_suffix(keys, order) >> np.uint64(16), return_inverse=True)
        total, types = np.zeros((len(contexts), held.shape[1])), np.zeros((len(contexts), held.shape[1]))
        np.add.at(total, place, held)
        np.add.at(types, place, (held > 0).astype(float))
        discount = _discount(held)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        base = 1.0 / (letters + 1) if lower is None else lower[np.searchsorted(levels[-1].keys, _suffix(keys, order - 1))]
        chance = np.where(total[place] > 0, np.maximum(held - discount, 0) / np.maximum(total[place], 1), 0) + weight[place] * base
        lower = chance
        levels.append(Level(keys, np.log(chance).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
    return levels


def count_grams(documents: DataFrame) -> DataFrame:
    """lang, gram, count over the whole texts of ``documents`` (lang, text)."""
    source = documents.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, (keys, numbers) in held.items():
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(numbers)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "count"])
            held.clear()

        for piece in pieces(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                keys, numbers = np.unique(grams(texts)[0], return_counts=True)
                if lang in held:
                    keys, place = np.unique(np.r_[held[lang][0], keys], return_inverse=True)
                    numbers = np.bincount(place, np.r_[held[lang][1], numbers]).astype(np.int64)
                held[lang] = keys, numbers.astype(np.int64)
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from hand_on()
        yield from hand_on()

    counted = source.mapInArrow(count, "lang string, gram bigint, count bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _shorter(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1))


def _array_model(counted: DataFrame, languages: list[str]) -> CharacterModels:
    table = counted.toArrow()
    packed, row = np.unique(table.column("gram").to_numpy().view(np.uint64), return_inverse=True)
    places = hashed(packed, _bits(len(packed)))
    order = np.argsort(places, kind="stable")
    lang = np.searchsorted(languages, np.array(table.column("lang").to_pylist()))
    counts = np.zeros((len(packed), len(languages)))
    counts[row, lang] = table.column("count").to_numpy()
    return CharacterModels(languages, places[order], kneser_ney(packed[order], counts[order]))


def _table_model(counted: DataFrame, languages: list[str]) -> TableModels:
    """The levels of ``kneser_ney`` as stored tables; every order is counted in Spark."""
    size = range(len(languages))

    def added(value: Callable[[int], Column]) -> Column:
        return F.array(*[F.sum(value(n)).cast("double") for n in size])

    def any_of(n: int) -> Column:
        return (F.col("held")[n] > 0).cast("int")

    held = added(lambda n: F.when(F.col("lang") == languages[n], F.col("count")).otherwise(0))
    grams = [materialize(counted.groupBy("gram").agg(held.alias("held")).repartitionByRange("gram"), "grams")]
    for order in range(ORDER - 1, 0, -1):
        below = grams[0].groupBy(_shorter(order).alias("gram")).agg(added(any_of).alias("held"))
        grams.insert(0, materialize(below.repartitionByRange("gram"), "grams"))
    contexts, discounts = [], []
    for table in grams:
        totals = [added(lambda n: F.col("held")[n]).alias("total"), added(any_of).alias("types")]
        contexts.append(materialize(table.groupBy(F.shiftrightunsigned("gram", 16).alias("gram")).agg(*totals), "contexts"))
        often = [added(lambda n, times=times: (F.col("held")[n] == times).cast("int")) for times in (1, 2)]
        once, twice = table.agg(*often).first()
        discounts.append([a / (a + 2 * b) if a else 0.5 for a, b in zip(once, twice)])
    letters = [max(n, 1.0) for n in grams[0].agg(added(any_of)).first()[0]]
    return TableModels(languages, grams, contexts, discounts, letters)


def _order() -> Column:
    return F.xxhash64(F.lit("calibration"), "doc_id")


def _held_back(documents: DataFrame, most: int) -> Column:
    """Whether a training document is held back: of a tenth of the ids, those of the ``most`` smallest hashes."""
    tenth = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_BACK)) == 0
    ids = documents.where(tenth).select(_order().alias("order")).distinct()
    last = ids.orderBy("order").limit(most).agg(F.max("order")).first()[0]
    return tenth & (_order() <= F.lit(last)) if last is not None else F.lit(False)


def train(documents: DataFrame, calibration: int = CALIBRATION, sent: int = SENT) -> CharacterModels | TableModels:
    """Models of all languages of ``documents`` (doc_id, lang, text)."""
    known = documents.where("lang is not null and text is not null and doc_id is not null")
    back = _held_back(known, calibration)
    counted = materialize(count_grams(known.where(~back)), "counted-grams")
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return CharacterModels([])
    size = counted.select("gram").distinct().count() * len(languages)
    model = _array_model(counted, languages) if size <= sent else _table_model(counted, languages)
    judged = identify(known.where(back), model, ["doc_id", "lang"], True).where(F.col("lang_pred") != UNKNOWN)
    columns = ["lang", "lang_pred", "margin", "entropy", "letters"]
    # copies of a text count once, and never more than ``calibration`` rows go to the driver
    few = judged.select("doc_id", *columns).distinct().orderBy(_order(), "doc_id", *columns).limit(calibration)
    model.calibration = _calibration(few.select(*columns).toArrow(), languages)
    return model


def _calibration(seen: pa.Table, languages: list[str]) -> Calibration:
    lang, guessed = (np.array(seen.column(c).to_pylist(), object) for c in ("lang", "lang_pred"))
    margin, entropy, lengths = (seen.column(c).to_numpy() for c in ("margin", "entropy", "letters"))
    right = lang == guessed
    usual, limit = [], []
    for language in languages:
        own = right & (lang == language)
        # a language without such texts is taken as all of them
        own = own if own.any() else right
        if not own.any():
            return Calibration(_calibrated(margin, right.astype(float)))
        middle = float(np.median(entropy[own]))
        excess = _excess(entropy[own], middle, lengths[own])
        usual.append(middle)
        limit.append(float((1 + SLACK) * max(np.quantile(excess, WITHIN), LEAST_LIMIT)))
    return Calibration(_calibrated(margin, right.astype(float)), usual, limit)


def _calibrated(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Offset and slope of P(right | margin), with one wrong guess added at margin 0 and one right at 5."""
    x, y = np.r_[margin, 0.0, 0.0, 5.0], np.r_[right, 0.0, 1.0, 1.0]
    line = np.array([0.0, 1.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(line[0] + line[1] * x, -50, 50)))
        slope = chance * (1 - chance) + 1e-9
        gradient = np.array([(y - chance).sum(), ((y - chance) * x).sum()]) - 0.01 * line
        bend = np.array([[slope.sum(), (slope * x).sum()], [(slope * x).sum(), (slope * x * x).sum()]]) + 0.01 * np.eye(2)
        line = line + np.clip(np.linalg.solve(bend, gradient), -1, 1)
    return float(line[0]), float(max(line[1], 0.0))


def identify(
    documents: DataFrame, model: CharacterModels | TableModels, keep: list[str] | None = None, with_margin: bool = False
) -> DataFrame:
    """doc_id (or the columns ``keep``), lang_pred, score, rejected."""
    kept = ["doc_id"] if keep is None else keep
    source = documents.select(*kept, F.col("text").alias("__text"))
    judged = _by_tables(source, model) if isinstance(model, TableModels) else _by_arrays(source, model)
    judged = judged.withColumn("rejected", F.col("score") < REJECT)
    return judged if with_margin else judged.drop("margin", "entropy", "letters")


def _schema(source: DataFrame) -> str:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return f"{fields}, lang_pred string, score double, margin double, entropy double, letters bigint"


_JUDGED = ["lang_pred", "score", "margin", "entropy", "letters"]


def _columns(judged: Judged) -> list[pa.Array]:
    return [pa.array(judged[0], pa.string()), *[pa.array(j, pa.float64()) for j in judged[1:4]], pa.array(judged[4], pa.int64())]


def _by_tables(source: DataFrame, model: TableModels) -> DataFrame:
    """The texts are stored in pieces; each meets the probabilities of its own distinct 4-grams, which joins find."""
    languages, calibration = model.languages, model.calibration

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(pieces(batches, "__text")):
            part = pa.array(np.full(piece.num_rows, task + number))
            yield pa.RecordBatch.from_arrays([part, *piece.columns], names=["__part", *piece.schema.names])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("__part").to_numpy()
            for piece in (batch.slice(b, e - b) for b, e in _runs(part)):
                found = np.unique(grams([t or "" for t in piece.column("__text").to_pylist()])[0]).view(np.int64)
                parts = np.full(len(found), piece.column("__part")[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(found)], names=["__part", "gram"])

    def judge(texts: pa.Table, lookup: pa.Table) -> pa.Table:
        packed, owner = grams([t or "" for t in texts.column("__text").to_pylist()])
        keys = lookup.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        lists = lookup.column("chances").combine_chunks()
        values = (pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy()
        rows = order[np.searchsorted(keys, packed, sorter=order)] if len(packed) else np.zeros(0, np.int64)
        entropy, lengths = _means(values.reshape(-1, len(languages))[rows], owner, texts.num_rows)
        columns = [texts.column(n) for n in texts.column_names if n not in ("__part", "__text")]
        columns += _columns(_judged(languages, calibration, entropy, lengths))
        return pa.table(columns, names=[*texts.column_names[1:-1], *_JUDGED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    stored = materialize(source.mapInArrow(cut, f"__part bigint, {fields}"), "pieces")
    wanted = materialize(stored.mapInArrow(needed, "__part bigint, gram bigint").distinct(), "needed-grams")
    lookup = wanted.join(model.chances(wanted.select("gram").distinct()), "gram").select("__part", "gram", "chances")
    return stored.groupBy("__part").cogroup(lookup.groupBy("__part")).applyInArrow(judge, _schema(source))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)]))


def _by_arrays(source: DataFrame, model: CharacterModels) -> DataFrame:
    levels = [(n.keys, n.chances, n.contexts, n.weights) for n in model.levels]
    known = model.calibration
    # plain values: workers need not have the package
    sent = source.sparkSession.sparkContext.broadcast((model.languages, model.hashes, levels, (known.line, known.usual, known.limit)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, hashes, levels, calibration = sent.value
        held = CharacterModels(languages, hashes, [Level(*level) for level in levels], Calibration(*calibration))
        index = held.index()
        for piece in pieces(batches, "__text"):
            columns = [piece.column(i) for i in range(piece.num_columns - 1)]
            columns += _columns(held.predict(piece.column("__text").to_pylist(), index))
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:-1], *_JUDGED])

    return source.mapInArrow(judge, _schema(source))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
