"""Problem 3: template residue, filler, error pages and script notices in place of real text.

Character n-gram models of natural prose, of residue (stand-in text, error messages, script notices, filler) and of
unfilled placeholders are fitted here: prose on all the texts themselves and on ordinary sentences, the others on
families of examples. What the texts tell behind good text counts as prose, as residue stands alone or before it. The
sentences are judged and their n-grams counted in tasks; the driver gets sums in tables of a fixed size. Every character gets its log-likelihood ratio. Averaged over a window it tells which stretches read as
residue; a sentence is residue if such windows cover most of it, so that a sentence that only speaks of an error page
isn't. A text is residue if it begins with such a sentence or mostly consists of them. Windows of placeholders are
confirmed by their exact form, anywhere in a text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread
from .arrowtext import code_points, single, slices
from .markup import TAGS
from .residue_examples import ordinary_texts, residue_texts

ORDER, PAD, WINDOW = 5, 5, 21
#: Bits of the slots of the k-grams, from k = 1, and where each k's slots begin.
BITS = (16, 18, 19, 20, 21)
START = np.cumsum([0, *(1 << b for b in BITS)])
#: Passes over the texts that tell prose from residue.
ROUNDS = 2
#: Share of a sentence that residue windows must cover, and nats a character that the residue model must lead by; set on
#: families of examples that were left out of the fit, each of residue and of ordinary sentences.
COVERAGE, LEAD = 0.7, 0.3
#: Share of a text in residue sentences from which it is residue even if it begins otherwise.
MOSTLY = 0.5
#: Weight of an n-gram's estimate by fewer characters against its count.
STRENGTH = 1.0

#: Names and frames of placeholders to learn from.
NAMES = "name product_name title item.title item_name brand color Color colour size price PRICE Price material Material feature feature_1 feature_2 desc short_desc description seller vendor category user first_name company date quantity weight sku url link value key text field 0 1 2".split()
FRAMES = ("{{%s}}", "{{ %s }}", "${%s}", "{%s}", "%%%%%s%%%%", "%%%s%%", "<%%= %s %%>", "<%%=%s%%>", "<%s>", "[[%s]]", "[%%%s%%]", "[INSERT %s HERE]", "[YOUR %s]", "[ENTER %s]", "#%s#", "__%s__", "@@%s@@", "$%s$", "{%%%s%%}", "[%s]", "[your %s here]", "[%s name]", "[Product %s]", "{$%s}", "{{#if %s}}")
PRINTF = ("%s", "%d", "%s, %s", "%1$s", "%(name)s", "%i", "%.2f", "{0}", "{1}", "{}", "{0} {1}")
#: Words that only a placeholder's brackets hold.
FIELD_WORDS = "your|the|a|product|item|brand|company|seller|vendor|customer|user|first|last|full|short|colou?r|material|price|size|weight|date|model|category|shop|store|title|description|feature|text|here|link|url|number|name|value|field|address|city|quantity"
_TAGS = "|".join(sorted(TAGS, key=len, reverse=True))
#: The exact forms that confirm a placeholder.
PLACEHOLDER = re.compile(
    r"\{\{[#/]?\s*[\w.\- |]+?\s*\}\}|\{\$[\w.]+\}|\$\{\s*[\w.\-]+\s*\}|(?<![\w$])\{\s*[A-Za-z_][\w.\-]+\s*\}|\{\d{0,2}\}|\{%\s*[\w. ]+\s*%\}|%%\s*[\w.\-]+\s*%%|(?<![\w%])%[A-Za-z_][\w.]+%(?!\w)|(?<!\d )(?<![\d%])%(?:\d+\$|\(\w+\))?(?:\.\d+)?[sdif]\b|<%=?\s*[\w.\-]+\s*%>"
    rf"|<(?!/?(?:{_TAGS})\b)[A-Za-z_][\w.\-]*>|\[\[\s*[\w.\-]+\s*\]\]|\[%\s*[\w.\-]+\s*%\]|\[\s*(?:INSERT|ENTER|ADD|YOUR|PUT|TYPE|REPLACE)\b[^\[\]\n]{{0,60}}\]|#[A-Za-z_][\w.\-]*#|(?<!\w)__[A-Za-z][\w.\-]*?__(?!\w)|@@[\w.\-]+@@|(?<!\w)\$[A-Za-z_][\w.]*\$(?!\w)"
    rf"|(?i:\[\s*(?:(?:{FIELD_WORDS})\s*)+\]|<\s*(?!/?(?:{_TAGS})\s*>)(?:(?:{FIELD_WORDS})\s*)+>)"
)
MARKS = np.array([ord(c) for c in "{}<>[]%$#@_"], np.uint32)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\s*\n\s*")
#: Bytes of text that are scored at once, about.
BATCH_BYTES = 400_000
ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


IS_END, IS_MARK = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
IS_END[ENDS], IS_MARK[MARKS] = True, True


def _lower_table() -> np.ndarray:
    t = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        t[c] = ord("0") if chr(c).isdigit() else ord(low) if len(low) == 1 else c
    t[[9, 0xA0, 0x3000]] = 32
    return t


LOWER = _lower_table()


def padded(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with PAD line breaks before each text, place of each original one, its text's number)."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(cps)) + PAD * (row + 1)
    out = np.full(len(cps) + PAD * len(offsets), 10, np.uint32)
    out[place] = cps
    return out, place, row


def gram_hashes(cps: np.ndarray) -> list[np.ndarray]:
    """For each k of 1 to ORDER the table slot of the k-gram that ends at each place."""
    out, h = [], np.zeros(len(cps), np.uint64)
    base = cps.astype(np.uint64) + np.uint64(1)
    for k in range(1, ORDER + 1):
        shifted = np.empty_like(base)
        shifted[: k - 1] = 0
        shifted[k - 1 :] = base[: len(base) - k + 1]
        h = (h * np.uint64(0x100000001B3)) ^ (shifted * np.uint64(0x9E3779B97F4A7C15))
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS[k - 1])).astype(np.int64))
    return out


class Grams:
    """Counts of character n-grams in hashed tables; the gram that stands before a text is counted as well."""

    def __init__(self, texts: list[str], lower: bool):
        self.counts, self.total, self.lower = np.zeros(START[-1], np.int64), 0, lower
        self.add(texts)

    def add(self, texts: list[str]) -> None:
        cps, offsets = code_points(pa.array(texts, pa.large_string()))
        cps, place, _ = padded(cps, offsets)
        told = np.zeros(len(cps), bool)
        told[place] = True
        told[:-1] |= told[1:]
        for start, g in zip(START, gram_hashes(LOWER[np.minimum(cps, 0xFFFF)] if self.lower else cps)):
            np.add.at(self.counts, start + g[told], 1)
        self.total += len(place)

    def __add__(self, other: Grams) -> Grams:
        out = Grams([], self.lower)
        out.counts, out.total = self.counts + other.counts, self.total + other.total
        return out


class Ratio:
    """Two models side by side, so that one look-up serves both."""

    def __init__(self, residue: Grams, prose: Grams):
        self.tables = [np.stack([residue.counts[a:b], prose.counts[a:b]], 1).astype(np.float32) for a, b in itertools.pairwise(START)]
        self.totals = np.maximum(1, np.array([residue.total, prose.total], np.float32))

    def __getstate__(self) -> tuple:
        """Only the slots in use are sent to the tasks."""
        used = [np.flatnonzero(t.any(1)) for t in self.tables]
        return [u.astype(np.int32) for u in used], [t[u] for t, u in zip(self.tables, used)], self.totals

    def __setstate__(self, state: tuple) -> None:
        used, counts, self.totals = state
        self.tables = [np.zeros((1 << bits, 2), np.float32) for bits in BITS]
        for table, u, c in zip(self.tables, used, counts):
            table[u] = c

    def __call__(self, cps: np.ndarray, place: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """log p(residue) - log p(prose) of each place's character; ``own`` is taken off the counts in prose."""
        p = np.full((len(cps), 2), 1 / 4000, np.float32)
        before = np.broadcast_to(self.totals, p.shape)
        for table, grams in zip(self.tables, gram_hashes(cps)):
            count = table.take(grams, 0)
            last = np.empty_like(count)  # the next round's contexts
            last[0], last[1:] = 0, count[:-1]
            context = np.maximum(before, count)
            if own is not None:
                count[place, 1] = np.maximum(count[place, 1] - own, 0)
                context[place, 1] = np.maximum(context[place, 1] - own, count[place, 1])
            context += STRENGTH
            p *= STRENGTH
            p += count
            p /= context
            before = last
        return np.log(p[place, 0] / p[place, 1])


def placeholder_examples() -> list[str]:
    return [frame % name for frame, name in itertools.product(FRAMES, NAMES)] + [x for x in PRINTF for _ in range(15)]


def kinds_of(text: str) -> list[tuple[str, str]]:
    """(kind, sentence) of each sentence; sentences that differ in case and digits alone are of one kind."""
    return [(re.sub(r"\d", "0", s.lower()), s) for s in map(str.strip, SENTENCE.split(text)) if s]


class Seeds:
    """The counts that no texts change: of residue, of placeholders, of ordinary sentences in lower case and as written."""

    def __init__(self, without: frozenset[str] = frozenset()):
        told = ordinary_texts(without=without)
        self.residue, self.marks = Grams(residue_texts(without=without), True), Grams(placeholder_examples(), False)
        self.low, self.raw = Grams(told, True), Grams(told, False)


class Sentences:
    """A batch of texts cut into sentences: behind a terminator and white space or in a script without it, and at line breaks."""

    def __init__(self, cps: np.ndarray, offsets: np.ndarray):
        self.row = row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        low = np.minimum(cps, 0xFFFF)
        end = IS_END[low]
        after = np.append(cps[1:], 10)
        space = (after == 32) | (after == 10) | (after == 9)
        stop = (end & (space | (cps > 0x2FFF) & ~np.append(end[1:], False))) | (cps == 10)
        fresh = np.ones(len(cps), bool)
        fresh[1:] = stop[:-1] | (row[1:] != row[:-1])
        self.number = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        self.last = np.append(self.first[1:], len(cps))
        self.letters = ((cps > 64) | (cps >= 48) & (cps < 58)) & (cps != 0xA0)
        self.size = np.add.reduceat(self.letters.astype(np.int64), self.first)


class Residue:
    """The models and what they say of texts."""

    def __init__(self, texts: list[str] = (), rounds: int = ROUNDS, without: frozenset[str] = frozenset(), seeds: Seeds | None = None):
        """Fitted on texts in memory; ``fit_residue`` does the same for a table."""
        seeds = seeds or Seeds(without)
        # each kind of sentence counts once, however often it is told, so that no share of the texts decides
        least: dict[str, str] = {}
        told = [kinds_of(text) for text in texts]
        for kind, s in itertools.chain.from_iterable(told):
            least[kind] = min(s, least.get(kind, s))
        number = {kind: i for i, kind in enumerate(least)}
        every, places = list(least.values()), [[number[kind] for kind, _ in x] for x in told]
        natural = np.zeros(len(every), bool)
        for i in range(rounds + 1):
            mine = [every[k] for k in np.flatnonzero(natural)]
            self.learn(seeds, Grams(mine, True), Grams(mine, False))
            if not every or i == rounds:
                break
            hit, held = self.sentence_hits(every, natural)
            natural = ~hit
            for at in places:  # residue stands alone or before good text: what follows good text is natural
                for k, follows in zip(at[1:], np.logical_and.accumulate(~hit[at])):
                    natural[k] |= follows
            natural &= ~held

    def learn(self, seeds: Seeds, low: Grams, raw: Grams) -> None:
        """The models from the seeds and the counts of natural sentences, in lower case and as written."""
        self.reads, self.holds = Ratio(seeds.residue, seeds.low + low), Ratio(seeds.marks, seeds.raw + raw)

    def sentence_hits(self, texts: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(reads as residue, has a placeholder) of single sentences, those of ``own`` without their own counts."""
        cps, offsets = code_points(pa.array(texts, pa.large_string()))
        hit, _, s = self._hits(cps, offsets, own)
        bad = np.zeros(len(texts), bool)
        np.logical_or.at(bad, s.row[s.first[hit]], True)
        return bad, self._placeholders(pa.array(texts, pa.string()), cps, offsets)

    def _hits(self, cps: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Sentences]:
        """(reads as residue, lead in nats a character) of each sentence."""
        s = Sentences(cps, offsets)
        raw, place, row = padded(cps, offsets)
        ratio = self.reads(LOWER[np.minimum(raw, 0xFFFF)], place, None if own is None else own[row].astype(np.float32))
        total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        i = np.arange(len(cps))
        lo, hi = np.maximum(i - WINDOW // 2, s.first[s.number]), np.minimum(i + WINDOW // 2 + 1, s.last[s.number])
        inside = (total[hi] - total[lo] > 0) & s.letters
        covered = np.add.reduceat(inside.astype(np.int64), s.first)
        mean = (total[s.last] - total[s.first]) / np.maximum(1, s.last - s.first)
        return (covered >= COVERAGE * s.size) & (s.size >= 3) & (mean > LEAD), mean, s

    def _placeholders(self, values: pa.Array, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with a window that reads as a placeholder and an exact form of one; others than those with a mark have none."""
        held = np.zeros(len(offsets) - 1, bool)
        odd = IS_MARK[np.minimum(cps, 0xFFFF)]
        some = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]))
        if not len(some):
            return held
        texts = values.take(pa.array(some))
        cps, offsets = code_points(texts)
        raw, place, row = padded(cps, offsets)
        total = np.concatenate([[0.0], np.cumsum(self.holds(raw, place), dtype=np.float64)])
        at = np.arange(len(cps))
        lo, hi = np.maximum(at - 1, offsets[row]), np.minimum(at + 2, offsets[row + 1])
        for r in np.unique(row[total[hi] - total[lo] > 0.5]):
            held[some[r]] = bool(PLACEHOLDER.search(texts[int(r)].as_py()))
        return held

    def score(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is residue, share of the characters in residue sentences, has a placeholder) of each text."""
        values = single(values).fill_null("")
        cps, offsets = code_points(values)
        n = len(offsets) - 1
        if not len(cps):
            return np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
        hit, _, s = self._hits(cps, offsets)
        share, letters = np.zeros(n), np.zeros(n)
        of = s.row[s.first]
        np.add.at(share, of[hit], s.size[hit])
        np.add.at(letters, of, s.size)
        share /= np.maximum(1, letters)
        some = np.flatnonzero(s.size > 0)  # a text begins with its first sentence that has letters
        begins = some[np.unique(of[some], return_index=True)[1]]
        bad = share >= MOSTLY
        bad[of[begins[hit[begins]]]] = True
        held = self._placeholders(values, cps, offsets)
        return bad | held, share, held


def natural_grams(sentences: DataFrame) -> tuple[Grams, Grams]:
    """N-gram counts of a column of sentences, in lower case and as written; to the driver go sums, one a slot in use."""
    slots = int(START[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, raw = Grams([], True), Grams([], False)
        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                texts = part.column(0).to_pylist()
                low.add(texts)
                raw.add(texts)
        counts = np.concatenate([low.counts, raw.counts, [low.total]])
        used = np.flatnonzero(counts)
        for lo in range(0, len(used), 1 << 17):
            at = used[lo : lo + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])

    sums = spread(sentences).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * slots + 1, np.int64)
    counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    low, raw = Grams([], True), Grams([], False)
    low.counts, raw.counts, low.total, raw.total = counts[:slots], counts[slots:-1], int(counts[-1]), int(counts[-1])
    return low, raw


def fit_residue(df: DataFrame, text: str, rounds: int = ROUNDS) -> Residue:
    """The models, fitted on every text."""
    seeds = Seeds()
    model = Residue(seeds=seeds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                told = [kinds_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([[x[i] for x in t] for t in told], pa.list_(pa.string())) for i in (0, 1))], names=["doc", "kinds", "told"])

    def judge(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1, BATCH_BYTES):
                    hit, held = shared.value.sentence_hits(part.column(1).to_pylist(), np.array(part.column(2).to_pylist(), bool))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hit), pa.array(held)], names=["kind", "s", "hit", "held"])

        return run

    texts = df.select(F.monotonically_increasing_id().alias("doc"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    docs = cut_lineage(spread(texts).mapInArrow(cut, "doc bigint, kinds array<string>, told array<string>").select("doc", F.transform("kinds", lambda x: F.xxhash64(x)).alias("kinds"), "told"))
    state = docs.select(F.explode(F.arrays_zip("kinds", "told")).alias("x")).groupBy(F.col("x.kinds").alias("kind")).agg(F.min("x.told").alias("s")).withColumn("natural", F.lit(False))
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
        judged = cut_lineage(spread(state).mapInArrow(judge(shared), "kind bigint, s string, hit boolean, held boolean"))
        shared.destroy()
        # the first hit of a text that doesn't begin with it follows good text
        hits = docs.select("doc", F.posexplode("kinds").alias("pos", "kind")).join(judged.filter("hit").select("kind"), "kind")
        follows = hits.groupBy("doc").agg(F.min(F.struct("pos", "kind")).alias("x")).filter("x.pos > 0").select("x.kind", F.lit(True).alias("follows")).distinct()
        natural = (~F.col("hit") | F.coalesce("follows", F.lit(False))) & ~F.col("held")
        state = cut_lineage(judged.join(follows, "kind", "left").select("kind", "s", natural.alias("natural")))
        model.learn(seeds, *natural_grams(state.filter("natural").select("s")))
    return model


def score_residue(df: DataFrame, key: str = "item_id", text: str = "description", model: Residue | None = None) -> DataFrame:
    """(key, is_residue BOOLEAN, residue_share DOUBLE, has_placeholder BOOLEAN) of every row.

    Null, empty and blank texts are no residue and have share 0. ``residue_share`` is the share of the text's
    letters in sentences that read as residue. Repeated rows repeat.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit_residue(df, text))  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                bad, share, held = models.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bad), pa.array(share), pa.array(held)], names=[key, "is_residue", "residue_share", "has_placeholder"])

    slim = df.select(key, text)
    return spread(slim).mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, is_residue boolean, residue_share double, has_placeholder boolean")


def exclude_residue(df: DataFrame, key: str = "item_id", text: str = "description") -> DataFrame:
    """The rows of ``df`` whose text is no residue; rows with a null or empty text stay."""
    return df.join(score_residue(df, key, text).filter("is_residue").select(key), key, "left_anti")
