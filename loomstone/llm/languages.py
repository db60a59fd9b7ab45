"""Problem 6: the language of each document and of each part of it, with a confidence.

Sentences are sets of character n-grams of two to five characters; the kernel of two sentences is the number of
n-grams that both have, divided by the root of the product of their numbers. Landmark sentences approximate it after
Nyström, and one ridge regression a language is fitted on the landmark features. As the kernel of a sentence with all
landmarks is its presence vector times the landmarks' matrix, whitening and coefficients fold into one matrix from
n-grams to languages, and a batch is scored by one product of its sparse presence matrix with that.

The fit reads every labelled sentence. Its frame, the sentence without names and numbers, takes the label that most of
its texts have, and weighs the same in however many readings it is told. Tasks sum the regression's equations over all
sentences; to the driver go the sums and the landmarks alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage, spread
from .arrowtext import code_points, single, slices, to_strings
from .lookalike import normalise_batch
from .markup import TRIGGER, to_plain
from .residue import LOWER, padded, score_residue

LEAST_N, MOST_N, BITS = 2, 5, 15
#: Landmarks; ridge penalty.
LANDMARKS, RIDGE = 640, 0.1
#: One of so many frames is left out of a fit that only serves to calibrate the confidences.
HELD_OUT = 10
#: Parts that the readings of a frame are dealt into, so that none is one task's.
PARTS = 8
#: Factors that are tried to make confidences of scores.
FACTORS = np.geomspace(0.5, 32, 25)
#: N-grams that are multiplied at once.
ENTRIES = 1000
#: A sentence of fewer letters (of a script with spaces), or led by less, takes the language of the rest of its text.
LEAST_LETTERS, MARGIN = 12, 0.7
#: Bytes of text that are scored at once, about.
BATCH_BYTES = 400_000
SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』”]?|\s*\n\s*")
#: Words with a capital letter, which vary where a sentence is told of many things.
NAMED = re.compile(r"[A-ZÀ-Þ][A-Za-zÀ-ɏ0]*|[А-ЯЁ][а-яё]*")
NO_LABEL = ("", "und", "unknown", "null", "none")


def split_sentences(text: str) -> list[str]:
    return [s for s in SPLIT.split(text) if s and s.strip()]


def presence(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence number, n-gram slot) of each n-gram that a sentence has, once, and the letters of each sentence."""
    cps, offsets = code_points(pa.array(sentences, pa.large_string()))
    low = LOWER[np.minimum(cps, 0xFFFF)]
    kind = LETTER[np.minimum(low, 0xFFFF)]
    low = np.where(kind, low, 32).astype(np.uint32)
    raw, place, row = padded(low, offsets)
    raw[raw == 10] = 32
    letters = np.bincount(row[kind], minlength=len(sentences))
    keys = []
    h = np.zeros(len(raw), np.uint64)
    for k in range(1, MOST_N + 1):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[k - 1 :] = raw[: len(raw) - k + 1]
        h = (h * np.uint64(0x100000001B3)) ^ ((shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if k >= LEAST_N:
            slot = ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64)[place]
            blank = (raw[place] == 32) & (raw[place - 1] == 32)
            keys.append(((row << BITS) | slot)[~blank])
    both = np.sort(np.concatenate(keys))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]  # far faster than np.unique on so many keys
    return both >> BITS, both & ((1 << BITS) - 1), letters


def _letters() -> np.ndarray:
    t = np.zeros(0x10000, bool)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            t[c] = chr(c).isalpha() or 0x300 <= c < 0x370 or 0x900 <= c < 0x1000 or 0xE30 <= c < 0xE50 or 0x610 <= c < 0x660
    return t


LETTER = _letters()


class Examples(NamedTuple):
    """Sentences as sets of n-grams, in the order of their owners, and of each its frame, language, votes, weight, share of its frame."""

    owner: np.ndarray
    slot: np.ndarray
    size: np.ndarray
    frame: np.ndarray
    y: np.ndarray
    told: np.ndarray
    weight: np.ndarray
    share: np.ndarray
    apart: np.ndarray


def examples_of(sentences: list[str], *rest: np.ndarray) -> Examples:
    owner, slot, _ = presence(sentences)
    return Examples(owner, slot, np.maximum(1, np.bincount(owner, minlength=len(sentences))), *rest)


def _taken(x: Examples, some: np.ndarray) -> Examples:
    """The examples ``some``, in that order."""
    starts, ends = np.searchsorted(x.owner, some), np.searchsorted(x.owner, some, "right")
    entries = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(starts, ends))])
    return Examples(np.repeat(np.arange(len(some)), ends - starts), x.slot[entries], *(v[some] for v in x[2:]))


def _products(x: Examples, table: np.ndarray) -> np.ndarray:
    """The examples' unit vectors times ``table``; what readings of a frame that stand together share is added up once."""
    n = len(x.y)
    out = np.zeros((n, table.shape[1]), np.float32)
    border = np.append(np.flatnonzero(np.concatenate([[True], x.frame[1:] != x.frame[:-1]])), n)
    single_, shared = np.ones(len(x.owner), bool), np.zeros(1 << BITS, bool)
    for a, b in zip(border[:-1], border[1:]):
        if b - a >= 4:
            span = slice(*np.searchsorted(x.owner, [a, b]))
            shared = np.bincount(x.slot[span], minlength=1 << BITS) == b - a
            out[a:b] = table[shared].sum(0)
            single_[span] = ~shared[x.slot[span]]
    owner, slot = x.owner[single_], x.slot[single_]
    starts = np.searchsorted(owner, np.arange(n))
    ends = np.append(starts[1:], len(owner))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + ENTRIES, "right")))
        some = lo + np.flatnonzero(ends[lo:hi] > starts[lo:hi])
        if len(some):
            out[some] += np.add.reduceat(table[slot[starts[lo] : ends[hi - 1]]], starts[some] - starts[lo], axis=0)
        lo = hi
    out /= np.sqrt(x.size, dtype=np.float32)[:, None]
    return out


def _pivots(x: Examples, members: np.ndarray, most: int) -> np.ndarray:
    """Landmarks among ``members`` by pivoted Cholesky: each next one is what the former ones explain least."""
    if len(members) <= most:
        return members
    mine = _taken(x, members)
    begin = np.searchsorted(mine.owner, np.arange(len(members)))
    ends = np.append(begin[1:], len(mine.owner))
    root = np.sqrt(mine.size)
    left, chosen = np.ones(len(members)), []
    factor = np.zeros((len(members), most), np.float64)
    for t in range(most):
        p = int(left.argmax())
        if left[p] < 1e-2:
            break
        vector = np.zeros(1 << BITS, np.float32)
        vector[mine.slot[begin[p] : ends[p]]] = 1
        column = np.add.reduceat(vector[mine.slot], begin) / (root * root[p])
        factor[:, t] = (column - factor[:, :t] @ factor[p, :t]) / np.sqrt(left[p])
        left -= factor[:, t] ** 2
        chosen.append(p)
    return members[chosen]


def _landmarks(x: Examples, most: int) -> np.ndarray:
    """``most`` examples of each language: half of them the most told, the others where those leave most unexplained."""
    out = [np.zeros(0, np.int64)]
    filled = np.bincount(x.owner, minlength=len(x.y)) > 0
    for c in np.unique(x.y):
        members = np.flatnonzero((x.y == c) & filled)
        members = members[np.lexsort([x.frame[members], -x.told[members]])]
        first = members[: most // 2]
        out += [first, _pivots(x, members[most // 2 :], most - len(first))]
    return np.concatenate(out)


class Landmarks:
    """The landmarks' unit vectors, a column each."""

    def __init__(self, x: Examples):
        self.__setstate__((x.owner.astype(np.int32), x.slot.astype(np.int32), x.size))

    def __getstate__(self) -> tuple:
        """Only the n-grams are sent to the tasks: the matrix is nearly empty, and every executor would hold it on disk."""
        return self.owner, self.slot, self.size

    def __setstate__(self, state: tuple) -> None:
        self.owner, self.slot, self.size = state
        self.marks = np.zeros((1 << BITS, len(self.size)), np.float32)
        self.marks[self.slot, self.owner] = 1
        self.marks /= np.sqrt(self.size)


def _kept(x: Examples, table: np.ndarray) -> np.ndarray:
    """Whose label the first fit or more than two votes confirm."""
    return (_products(x, table).argmax(1) == x.y) | (x.told > 2)


def _equations(x: Examples, marks: np.ndarray, n_languages: int) -> np.ndarray:
    """The regression's sums over the examples: of kernels by kernels, of kernels by targets, of shares and weights."""
    kernel = _products(x, marks)
    target = np.where(x.y[:, None] == np.arange(n_languages), 1.0, -1.0).astype(np.float32)
    weighted = (kernel * x.weight[:, None].astype(np.float32)).T
    return np.concatenate([(weighted @ kernel).ravel(), (weighted @ target).ravel(), [x.share.sum(), x.weight.sum()]]).astype(np.float64)


def _solved(sums: np.ndarray, marks: np.ndarray, n_languages: int, ridge: float) -> np.ndarray:
    """The matrix from n-grams to languages."""
    m = marks.shape[1]
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    fine = values > 1e-4
    white = vectors[:, fine] / np.sqrt(values[fine])
    scale = sums[-2] / max(sums[-1], 1e-9)
    left = white.T @ sums[: m * m].reshape(m, m) @ white * scale + ridge * np.eye(white.shape[1])
    return (marks @ (white @ np.linalg.solve(left, white.T @ sums[m * m : -2].reshape(m, n_languages) * scale))).astype(np.float32)


def _likelihoods(x: Examples, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each factor the log-likelihood of the examples, if scores times it are confidences; and their shares."""
    some = _kept(x, first)
    scores, y, share = _products(x, table)[some].astype(np.float64), x.y[some], x.share[some]
    z = scores - scores.max(1, keepdims=True)
    return np.array([*(float((share * (f * z[np.arange(len(y)), y] - np.log(np.exp(f * z).sum(1)))).sum()) for f in FACTORS), share.sum()])


def _sharpness(likelihoods: np.ndarray) -> float:
    """The factor by which scores become the likeliest confidences of sentences that the model wasn't fitted on."""
    return float(FACTORS[likelihoods[:-1].argmax()]) if likelihoods[-1] > 0 else 4.0


def per_language(n_languages: int, landmarks: int = LANDMARKS) -> int:
    return max(8, landmarks // n_languages)


class LanguageModel:
    """One-versus-rest kernel ridge regression over landmark sentences."""

    def __init__(self, sentences: list[str], labels: list[str], told: list[int] | None = None, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """Fitted on sentences in memory, each a frame of its own; ``fit_languages`` does the same for a table."""
        self.languages, self.table, self.sharpness = sorted(set(labels)) or ["und"], np.zeros((1 << BITS, 1), np.float32), 1.0
        if not labels:
            return
        n, one = len(self.languages), np.ones(len(labels))
        y = np.array([self.languages.index(x) for x in labels])
        told = one if told is None else np.array(told, float)
        apart = np.arange(len(labels)) % HELD_OUT == 0 if len(labels) >= 20 * HELD_OUT else one < 0
        weight = np.sqrt(told) / np.sqrt(np.maximum(1, np.bincount(y, np.sqrt(told), minlength=n)))[y]
        x = examples_of(sentences, np.arange(len(labels)), y, told, weight, one, apart)
        marks = Landmarks(_taken(x, _landmarks(x, per_language(n, landmarks)))).marks
        main, rest = _taken(x, np.flatnonzero(~apart)), _taken(x, np.flatnonzero(apart))
        some, others = _equations(main, marks, n), _equations(rest, marks, n)
        first = _solved(some + others, marks, n, ridge)
        some, others = (sums - _equations(_taken(e, np.flatnonzero(~_kept(e, first))), marks, n) for sums, e in ((some, main), (others, rest)))
        self.sharpness = _sharpness(_likelihoods(rest, first, _solved(some, marks, n, ridge)))
        self.table = _solved(some + others, marks, n, ridge)

    def scores(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each sentence by language, letters of each sentence)."""
        out = np.zeros((len(sentences), len(self.languages)))
        if not sentences:
            return out, np.zeros(0, np.int64)
        owner, slot, letters = presence(sentences)
        rows = np.flatnonzero(np.bincount(owner, minlength=len(sentences)))
        if len(owner):
            starts = np.searchsorted(owner, rows)
            out[rows] = np.add.reduceat(self.table[slot], starts, axis=0)
            out[rows] /= np.sqrt(np.bincount(owner, minlength=len(sentences))[rows])[:, None]
        return out, letters


def readable(values: pa.Array) -> list[str | None]:
    """The texts of a string or list<string> column without look-alike characters and markup; elements are lines."""
    values = single(values)
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        inner = pc.fill_null(values.flatten(), "")
        sizes = values.value_lengths().fill_null(0).to_pylist()
        parts, out, at = readable(inner), [], 0
        for n, ok in zip(sizes, values.is_valid().to_pylist()):
            out.append("\n".join(p or "" for p in parts[at : at + n]) if ok else None)
            at += n
        return out
    out = values.to_pylist()
    odd = pc.indices_nonzero(pc.match_substring_regex(values, r"[^\x00-\x7F]").fill_null(False))
    plain = values
    if len(odd):  # ASCII has no look-alikes
        form, new, _ = normalise_batch(*code_points(values.take(odd)))
        for i, text in zip(odd.to_pylist(), to_strings(form, new).to_pylist()):
            out[i] = text
        plain = pa.array(out, pa.string())
    for i in pc.indices_nonzero(pc.match_substring_regex(plain, TRIGGER).fill_null(False)).to_pylist():
        text, _, kept = to_plain(out[i])
        for kind, body in kept:
            if kind in ("code", "formula"):
                text = text.replace(body, " ")
        out[i] = text
    return out


def _decide(texts: list[str | None], model: LanguageModel) -> list[list[tuple[str, float, int, bool]]]:
    """Of each text its sentences as (language, confidence, letters, whole sentence)."""
    cut = [split_sentences(t) if t else [] for t in texts]
    distinct = list(dict.fromkeys(s for c in cut for s in c))
    where = {s: i for i, s in enumerate(distinct)}
    scores, letters = model.scores(distinct)
    best = scores.argmax(1) if len(distinct) else np.zeros(0, int)
    ordered = np.sort(scores, 1)
    margin = ordered[:, -1] - ordered[:, -2] if scores.shape[1] > 1 else np.ones(len(distinct))
    soft = np.exp(model.sharpness * (scores - scores.max(1, keepdims=True))) if len(distinct) else scores
    sure = 1 / soft.sum(1) if len(distinct) else np.zeros(0)
    out = []
    for c in cut:
        at = [where[s] for s in c]
        at = [i for i in at if letters[i] > 0]
        if not at:
            out.append([])
            continue
        firm = [i for i in at if letters[i] >= LEAST_LETTERS and margin[i] >= MARGIN]
        if firm:
            weight = np.bincount(best[firm], weights=letters[firm], minlength=scores.shape[1])
            main = int(weight.argmax())
        else:
            main = int((scores[at] * letters[at][:, None]).sum(0).argmax())
        firm_set = set(firm)
        row = []
        for i in at:
            lang = int(best[i]) if i in firm_set else main
            whole = i in firm_set and (distinct[i].rstrip("\"'”’»)] ")[-1:] in ".!?…。！？" or letters[i] >= 20)
            confidence = float(sure[i]) if i in firm_set else float(soft[i][main] * sure[i])
            row.append((model.languages[lang], confidence, int(letters[i]), whole))
        if not any(r[3] for r in row):
            row = [(x, c, n, True) for x, c, n, _ in row]
        out.append(row)
    return out


SEGMENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.LongType()), T.StructField("whole", T.BooleanType())])
_SEGMENT = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int64()), ("whole", pa.bool_())]))


def _summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of`` over all batches; to the driver go ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["i", "x"])

    sums = df.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return out


def labelled_sentences(labelled: DataFrame) -> DataFrame:
    """(frame, s, lang, n): every sentence with letters, how often it is told under each label, in parts."""
    plain = F.array_join("text", "\n") if isinstance(labelled.schema["text"].dataType, T.ArrayType) else F.col("text")
    good = labelled.select(plain.alias("text"), F.lower(F.trim("lang")).alias("lang")).filter((F.length(F.trim("text")) > 0) & F.col("lang").rlike("^[a-z]{2,3}$") & ~F.col("lang").isin(*NO_LABEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                told: dict[tuple[str, str], int] = {}
                for text, lang in zip(readable(part.column(0)), part.column(1).to_pylist()):
                    for s in split_sentences(text or ""):
                        told[s, lang] = told.get((s, lang), 0) + 1
                told = {k: n for k, n in told.items() if any(map(str.isalpha, k[0]))}
                frames = [NAMED.sub("X", re.sub(r"\d+", "0", s)) for s, _ in told]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.string()), pa.array([s for s, _ in told], pa.string()), pa.array([x for _, x in told], pa.string()), pa.array(list(told.values()), pa.int64())], names=["frame", "s", "lang", "n"])

    return spread(good).mapInArrow(run, "frame string, s string, lang string, n bigint")


def fit_languages(labelled: DataFrame, ridge: float = RIDGE) -> LanguageModel:
    """The classifier from every (text, lang), lang perhaps wrong."""
    spark = labelled.sparkSession
    cores = spark.sparkContext.defaultParallelism
    read = cut_lineage(labelled_sentences(labelled))
    # the labels of a sentence's frame vote, so that a wrong label of one text doesn't count
    votes = read.groupBy("frame", "lang").agg(F.sum("n").alias("n")).groupBy("frame").agg(F.max(F.struct("n", "lang")).alias("x")).select("frame", "x.lang", F.col("x.n").alias("told"))
    distinct = read.select("frame", "s").distinct()
    frames = cut_lineage(votes.join(distinct.groupBy("frame").agg(F.count("s").alias("readings"), F.min("s").alias("least")), "frame"))
    sums = {r["lang"]: (r["n"], r["w"]) for r in frames.groupBy("lang").agg(F.count("frame").alias("n"), F.sum(F.sqrt("told")).alias("w")).collect()}
    model = LanguageModel([], [])
    if not sums:
        return model
    model.languages = sorted(sums)
    n = len(model.languages)
    many = sum(c for c, _ in sums.values()) >= 20 * HELD_OUT
    apart = [x for x, (c, _) in sums.items() if many and c >= 2 * HELD_OUT]
    number = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int") - 1
    # a frame weighs the same in whatever number of readings it is told
    weight = F.sqrt("told") / F.col("readings") / F.sqrt(F.greatest(F.lit(1.0), F.element_at(F.array(*(F.lit(sums[x][1]) for x in model.languages)), number + 1)))
    told = frames.select("frame", "least", number.alias("y"), "told", weight.alias("weight"), ((F.pmod(F.xxhash64("frame"), F.lit(HELD_OUT)) == 0) & F.col("lang").isin(apart)).alias("apart"), (1 / F.col("readings")).alias("share"))
    partitions = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("s"), F.lit(PARTS))
    each = distinct.join(told, "frame").repartition(partitions, "frame", part).sortWithinPartitions("frame", "s")
    each = cut_lineage(each.select(F.xxhash64("frame").alias("frame"), "y", "told", "weight", "share", "apart", (F.col("s") == F.col("least")).alias("leads"), "s"))

    def of(batch: pa.RecordBatch | pa.Table) -> Examples:
        return examples_of(batch["s"].to_pylist(), *(single(batch[c]).to_numpy(zero_copy_only=False) for c in ("frame", "y", "told", "weight", "share")), single(batch["apart"]).to_numpy(zero_copy_only=False).astype(bool))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            all_ = pa.Table.from_batches(some)
            yield from all_.take(pa.array(_landmarks(of(all_), per_language(n)))).combine_chunks().to_batches()

    # landmarks, from one reading of each frame: those of each task, and of them those of all
    leads = each.filter("leads")
    chosen = Landmarks(of(leads.mapInArrow(choose, leads.schema).repartition(n, "y").mapInArrow(choose, leads.schema).orderBy("y", "frame", "s").toArrow()))
    marks = chosen.marks
    m = marks.shape[1]
    size = m * m + m * n + 2
    shared = spark.sparkContext.broadcast(chosen)  # of a fixed size, as the tables below

    def equations(batch: pa.RecordBatch, first: Broadcast | None = None) -> np.ndarray:
        out = np.zeros(size)
        for part in slices(batch, 7, BATCH_BYTES):
            x = of(part)
            some = np.flatnonzero(~_kept(x, first.value)) if first is not None else None
            out += _equations(x if some is None else _taken(x, some), shared.value.marks, n) if some is None or len(some) else 0
        return out

    def likelihoods(batch: pa.RecordBatch) -> np.ndarray:
        return sum(_likelihoods(of(part), first.value, fitted.value) for part in slices(batch, 7, BATCH_BYTES))

    main, rest = each.filter(~F.col("apart")), each.filter("apart")
    some = _summed(main, equations, size)
    others = _summed(rest, equations, size) if apart else np.zeros(size)
    first = spark.sparkContext.broadcast(_solved(some + others, marks, n, ridge))
    # more than two votes confirm a label, so only the others are looked at again
    some -= _summed(main.filter("told <= 2"), lambda b: equations(b, first), size)
    model.sharpness = 4.0
    if apart:
        others -= _summed(rest.filter("told <= 2"), lambda b: equations(b, first), size)
        fitted = spark.sparkContext.broadcast(_solved(some, marks, n, ridge))
        model.sharpness = _sharpness(_summed(rest, likelihoods, len(FACTORS) + 1))
        fitted.destroy()
    first.destroy()
    shared.destroy()
    model.table = _solved(some + others, marks, n, ridge)
    return model


def detect_languages(df: DataFrame, model: LanguageModel, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns.., lang, confidence, segments): the main language and the stretches of sentences in one language, in order.

    Null texts and texts without letters have a null language, confidence 0 and no segment. A stretch's ``whole``
    tells that at least one whole sentence of it speaks for its language by itself. Repeated rows repeat.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES) if plain else (batch.slice(lo, 1000) for lo in range(0, batch.num_rows, 1000)):
                langs, sure, segments = [], [], []
                for row in _decide(readable(part.column(1)), m):
                    total: dict[str, list[float]] = {}
                    runs: list[dict] = []
                    for lang, c, n, whole in row:
                        t = total.setdefault(lang, [0.0, 0.0])
                        t[0] += n
                        t[1] += n * c
                        if runs and runs[-1]["lang"] == lang:
                            r = runs[-1]
                            r["confidence"] = (r["confidence"] * r["sentences"] + c) / (r["sentences"] + 1)
                            r["sentences"] += 1
                            r["whole"] |= whole
                        else:
                            runs.append({"lang": lang, "confidence": c, "sentences": 1, "whole": whole})
                    main = max(total, key=lambda x: (total[x][0], x)) if total else None
                    langs.append(main)
                    sure.append(total[main][1] / max(1.0, sum(t[0] for t in total.values())) if main else 0.0)
                    segments.append(runs)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, _SEGMENT)], names=[key, *carry, "lang", "confidence", "segments"])

    slim = df.select(key, text, *carry)
    plain = isinstance(slim.schema[text].dataType, T.StringType)
    schema = T.StructType([slim.schema[key], *[slim.schema[c] for c in carry], T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segments", T.ArrayType(SEGMENT))])
    return spread(slim).mapInArrow(run, schema)


def listing_languages(walmart: DataFrame, amazon: DataFrame, cache: DataFrame) -> DataFrame:
    """(listing, label, lang, confidence, segments) of every description of both tables, one model over both."""
    a = amazon.select(F.concat(F.lit("amazon:"), "row_id").alias("listing"), F.array_join(F.transform("description", lambda x: F.coalesce(x, F.lit(""))), "\n").alias("text"), "asin")
    w = walmart.select(F.concat(F.lit("walmart:"), "item_id").alias("listing"), F.col("description").alias("text"), F.col("lang").alias("label"))
    a = a.join(cache.select("asin", F.col("lang").alias("label")), "asin", "left").select("listing", "text", "label")
    both = a.unionByName(w)
    model = fit_languages(both.select("text", F.col("label").alias("lang")))
    return detect_languages(both, model, "listing", "text", ("label",))


def missing_or_wrong(walmart: DataFrame, amazon: DataFrame, cache: DataFrame) -> DataFrame:
    """(listing, lang): the languages of each listing whose label is missing, or names none of them, or that has two."""
    found = listing_languages(walmart, amazon, cache)
    spoken = F.array_distinct(F.transform(F.filter("segments", lambda s: s["whole"]), lambda s: s["lang"]))
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    told = found.select("listing", label.alias("label"), spoken.alias("spoken")).filter(F.size("spoken") > 0)
    wrong = told.filter(F.col("label").isin(*NO_LABEL) | ~F.array_contains("spoken", F.col("label")) | (F.size("spoken") > 1))
    residue = score_residue(walmart).filter("is_residue").select(F.concat(F.lit("walmart:"), "item_id").alias("listing"))
    return wrong.join(residue, "listing", "left_anti").select("listing", F.explode("spoken").alias("lang"))
