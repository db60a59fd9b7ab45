"""Problem 1: text that looks the same, brought to one form of characters.

A batch of Arrow text becomes one array of code points. Lookup tables give each code point's replacement, which
may be nothing, one or several (expansion offsets place them); combining marks are then ordered and composed for
all texts at once, and words that mix look-alike scripts are moved into the script they mostly have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread
from .arrowtext import code_points, single, to_strings

#: Bits of the flags column.
FULL_WIDTH, MARK, INVISIBLE, SPACE, MIXED, COMPAT = 1, 2, 4, 8, 16, 32
CASES = FULL_WIDTH | MARK | INVISIBLE | SPACE | MIXED | COMPAT

#: Letters that look alike, as in the public lists of confusable characters; in each pair of strings
#: the letters at one place look alike.
CYRILLIC_AS_LATIN = ("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухԛԝһԁ", "ABESIJKMHOPCTYXYQWaesijopcyxqwhd")
GREEK_AS_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονικρυχ", "ABEZHIKMNOPTYXaovikpux")

TOP = 0x110000
LATIN, CYRILLIC, GREEK = 1, 2, 3


@cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built by rule from the Unicode database."""
    flag = np.zeros(TOP, np.uint8)
    counts = np.ones(TOP, np.int64)
    ccc = np.zeros(TOP, np.uint8)
    script = np.zeros(TOP, np.uint8)
    wordly = np.zeros(TOP, bool)
    joiner_ok = np.zeros(TOP, bool)
    cjk = np.zeros(TOP, bool)
    cjk[0x3400:0xA000] = cjk[0x20000:0x30000] = cjk[0xAC00:0xD7B0] = True
    parts: dict[int, list[int]] = {}
    pair_keys, pair_values = [], []
    for c in range(TOP):
        if 0xAC00 <= c <= 0xD7A3 or 0x3400 <= c <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0x20000 <= c <= 0xE0FFF and c not in range(0x2F800, 0x2FA20) or c >= 0xF0000 or 0xD800 <= c <= 0xF8FF:
            wordly[c] = c < 0xD800 or 0x20000 <= c < 0x30000
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        ccc[c] = unicodedata.combining(ch)
        wordly[c] = kind[0] in "LMN"
        decomposed = unicodedata.decomposition(ch)
        if kind[0] == "L":
            name = unicodedata.name(ch, "")
            script[c] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
        joiner_ok[c] = kind in ("So", "Sk") and c >= 0x2190 or c == 0xFE0F or 0x590 <= c < 0x1100
        cjk[c] = 0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0xFF61 <= c < 0xFFA0
        if kind == "Zs" and c not in (0x20, 0x3000) or kind in ("Zl", "Zp"):
            flag[c] = SPACE
            parts[c] = [0x20]
        elif c == 0x3000:
            parts[c] = [0x20]
        elif kind == "Cf" and not 0x600 <= c < 0x8E3 or kind == "Cc" and c not in (9, 10, 13) or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            flag[c] = INVISIBLE
            parts[c] = []
        elif decomposed.startswith("<wide>") or decomposed.startswith("<narrow>"):
            plain = unicodedata.normalize("NFKC", ch)
            if kind[0] in "LN":
                flag[c] = FULL_WIDTH
            if kind[0] in "LN" or decomposed.startswith("<narrow>"):
                parts[c] = [ord(x) for x in unicodedata.normalize("NFD", plain)]
        elif decomposed.startswith("<font>") or 0xFB00 <= c <= 0xFB06:
            if kind[0] in "LN":
                flag[c] = COMPAT
                parts[c] = [ord(x) for x in unicodedata.normalize("NFKD", ch)]
        elif decomposed and decomposed[0] != "<":
            whole = unicodedata.normalize("NFD", ch)
            parts[c] = [ord(x) for x in whole]
            pair = [int(x, 16) for x in decomposed.split()]
            if len(pair) == 1 and 0x2100 <= c < 0x2150 and kind[0] == "L":
                flag[c] = COMPAT  # signs that are letters, as of kelvin and ohm
            if len(pair) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pair_keys.append((pair[0] << 21) | pair[1])
                pair_values.append(c)
        if 0x300 <= c <= 0x36F or c in (0x3099, 0x309A):
            flag[c] |= MARK
    for c, p in parts.items():
        counts[c] = len(p)
    where = np.zeros(TOP, np.int64)
    where[1:] = np.cumsum(counts)[:-1]
    pool = np.zeros(int(counts.sum()), np.uint32)
    simple = np.flatnonzero(counts == 1)
    pool[where[simple]] = simple
    for c, p in parts.items():
        pool[where[c] : where[c] + len(p)] = p
    order = np.argsort(np.array(pair_keys, np.int64))
    alike = {name: np.arange(TOP, dtype=np.uint32) for name in ("latin", "cyrillic", "greek")}
    both = np.zeros(TOP, np.uint8)  # 1 where a letter has a look-alike in another script
    for (theirs, latin), name in ((CYRILLIC_AS_LATIN, "cyrillic"), (GREEK_AS_LATIN, "greek")):
        for a, b in zip(theirs, latin):
            alike["latin"][ord(a)] = ord(b)
            alike[name][ord(b)] = ord(a)
            both[ord(a)] = both[ord(b)] = 1
    return {"flag": flag, "counts": counts, "where": where, "pool": pool, "ccc": ccc, "script": script, "wordly": wordly, "joiner_ok": joiner_ok, "cjk": cjk, "pair_keys": np.array(pair_keys, np.int64)[order], "pair_values": np.array(pair_values, np.uint32)[order], "both": both, **alike}


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _signs(cps: np.ndarray, row: np.ndarray, n: int, t: dict) -> np.ndarray:
    """Full-width signs to plain ones: in texts without letters of East Asia, and else between full-width or Latin letters."""
    sign = (cps > 0xFF00) & (cps < 0xFF5F) & (t["flag"][cps] == 0)
    if not sign.any():
        return cps
    eastern = np.zeros(n, bool)
    eastern[row[t["cjk"][cps] & t["wordly"][cps]]] = True
    plain = (t["flag"][cps] & FULL_WIDTH > 0) & (cps < 0xFF5F) | (t["script"][cps] == LATIN) | (cps >= 48) & (cps < 58)
    index = np.arange(len(cps))
    before = np.maximum.accumulate(np.where(sign, -1, index))  # the nearest that is no sign, on either side
    after = np.minimum.accumulate(np.where(sign, len(cps), index)[::-1])[::-1]
    left = (before >= 0) & plain[before] & (row[before] == row)
    there = np.minimum(after, len(cps) - 1)
    right = (after < len(cps)) & plain[there] & (row[there] == row)
    fold = sign & (~eastern[row] | left & right)
    return np.where(fold, cps - np.uint32(0xFEE0), cps)


def _hangul(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of Hangul that stand by themselves, joined to syllables by arithmetic."""
    for first in (True, False):  # an initial and a vowel, then a syllable of both and a final
        if len(cps) < 2:
            break
        a, b = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        if first:
            joins, made = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176), 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
        else:
            joins, made = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3), a + b - 0x11A7
        hit = np.flatnonzero(joins & (row[1:] == row[:-1]))
        if len(hit):
            cps = cps.copy()
            cps[hit] = made[hit]
            keep = np.ones(len(cps), bool)
            keep[hit + 1] = False
            cps, row = cps[keep], row[keep]
    return cps, row


def _compose(cps: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition of each base with the marks behind it, all rows at once."""
    for _ in range(2):
        marks = t["ccc"][cps]
        swap = np.flatnonzero((marks[1:] > 0) & (marks[:-1] > marks[1:]) & (row[1:] == row[:-1]))
        if not len(swap):
            break
        start = np.maximum.accumulate(np.where(marks == 0, np.arange(len(cps)), 0))
        order = np.lexsort((np.arange(len(cps)), marks, start))
        cps, row = cps[order], row[order]
    cps, row = _hangul(cps, row)
    while len(cps) > 1:
        marks = t["ccc"][cps]
        keys = (cps[:-1].astype(np.int64) << 21) | cps[1:]
        place = np.minimum(np.searchsorted(t["pair_keys"], keys), len(t["pair_keys"]) - 1)
        joins = (t["pair_keys"][place] == keys) & (row[1:] == row[:-1])
        joins[1:] &= ~joins[:-1]  # the left one of two first; the other follows in the next round
        hit = np.flatnonzero(joins)
        if not len(hit):
            # a base may also take a mark behind another, blocked by none of the same class
            base = np.maximum.accumulate(np.where(marks == 0, np.arange(len(cps)), 0))
            gap = np.flatnonzero((marks > 0) & (np.arange(len(cps)) - base > 1) & (row == row[base]))
            gap = gap[marks[gap - 1] < marks[gap]]
            keys = (cps[base[gap]].astype(np.int64) << 21) | cps[gap]
            place = np.minimum(np.searchsorted(t["pair_keys"], keys), len(t["pair_keys"]) - 1)
            ok = t["pair_keys"][place] == keys
            gap, place = gap[ok], place[ok]
            _, first = np.unique(base[gap], return_index=True)
            gap, place = gap[first], place[first]
            if not len(gap):
                break
            cps = cps.copy()
            cps[base[gap]] = t["pair_values"][place]
            keep = np.ones(len(cps), bool)
            keep[gap] = False
            cps, row = cps[keep], row[keep]
            continue
        cps = cps.copy()
        cps[hit] = t["pair_values"][place[hit]]
        keep = np.ones(len(cps), bool)
        keep[hit + 1] = False
        cps, row = cps[keep], row[keep]
    return cps, row


def normalise_batch(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, flags of each text) of the one form."""
    if not len(cps):
        return cps, offsets, np.zeros(len(offsets) - 1, np.int64)
    t = tables()
    n, row = len(offsets) - 1, _rows(offsets)
    seen = t["flag"][cps].copy()
    joiner = np.flatnonzero((cps == 0x200C) | (cps == 0x200D))
    left, right = np.maximum(joiner - 1, 0), np.minimum(joiner + 1, len(cps) - 1)
    inside = (left < joiner) & (right > joiner) & (row[left] == row[joiner]) & (row[right] == row[joiner])
    fine = joiner[inside & t["joiner_ok"][cps[left]] & t["joiner_ok"][cps[right]]]  # joiners of emoji and of Indic and Arabic scripts
    wide = np.flatnonzero(cps == 0x3000)  # usual beside letters and signs of East Asia, else a special space
    if len(wide):
        near = [t["cjk"][cps[at]] & (row[at] == row[wide]) & (at != wide) for at in (np.maximum(wide - 1, 0), np.minimum(wide + 1, len(cps) - 1))]
        seen[wide[~(near[0] | near[1])]] = SPACE
    seen[fine] = 0
    flags = np.zeros(n, np.int64)
    for bit in (FULL_WIDTH, MARK, INVISIBLE, SPACE, COMPAT):
        flags[row[(seen & bit) > 0]] |= bit
    cps = _signs(cps, row, n, t)
    counts = t["counts"][cps].copy()
    counts[fine] = 1
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    source = np.repeat(t["where"][cps] - ends[:-1], counts) + np.arange(ends[-1])
    out = t["pool"][source]
    out[ends[fine]] = cps[fine]
    out, row = _compose(out, np.repeat(row, counts), t)

    wordly = t["wordly"][out]
    begins = wordly.copy()
    begins[1:] &= ~wordly[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(begins) - 1
    word[~wordly] = -1
    letters = np.flatnonzero(wordly & (t["script"][out] > 0))
    if len(letters):
        words = int(begins.sum())
        script, both = t["script"][out[letters]], t["both"][out[letters]]
        tally = np.zeros((words, 4), np.int64)
        own = np.zeros((words, 4), np.int64)  # letters without a look-alike
        np.add.at(tally, (word[letters], script), 1)
        np.add.at(own, (word[letters], script), (both == 0).astype(np.int64))
        mixed = (tally > 0).sum(1) > 1
        if mixed.any():
            target = np.where(own.any(1), own.argmax(1), tally.argmax(1))
            at = letters[mixed[word[letters]]]
            flags[row[at]] |= MIXED
            for script, name in ((LATIN, "latin"), (CYRILLIC, "cyrillic"), (GREEK, "greek")):
                mine = at[target[word[at]] == script]
                through = t["latin"][out[mine]] if script != LATIN else out[mine]
                out[mine] = t[name][through] if script == LATIN else np.where(t["script"][out[mine]] == script, out[mine], t[name][through])
    sizes = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    new = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=new[1:])
    return out, new, flags


def _column(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The normal form of a string or list<string> column, and each row's flags (of a list, those of all elements)."""
    values = single(values)
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        inner = values.flatten()
        form, flags = _column(inner)
        sizes = np.array(values.value_lengths().fill_null(0))
        offsets = np.zeros(len(values) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        of_row = np.zeros(len(values), np.int64)
        np.bitwise_or.at(of_row, np.repeat(np.arange(len(values)), sizes), flags)
        mask = values.is_null() if values.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), form, mask=mask), of_row
    cps, offsets = code_points(values.fill_null(""))
    out, new, flags = normalise_batch(cps, offsets)
    valid = np.array(values.is_valid()) if values.null_count else None
    return to_strings(out, new, valid), flags


def normalise_lookalikes(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with, for each of ``columns``, ``<c>_norm`` and ``<c>_flags``.

    Columns may be strings or arrays of strings. Null stays null with flags 0, empty stays empty, null elements of an
    array stay null. The flags name what was found: ``FULL_WIDTH`` letters or digits, separate accents (``MARK``),
    ``INVISIBLE`` characters, special ``SPACE``s, words of ``MIXED`` look-alike scripts, styled letters (``COMPAT``).
    """
    base = df.select(*dict.fromkeys([*(keep if keep is not None else df.columns), *columns]))
    names = base.columns
    schema = T.StructType([*base.schema.fields])
    for c in columns:
        schema = schema.add(f"{c}_norm", base.schema[c].dataType).add(f"{c}_flags", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, labels = [], []
            for c in columns:
                form, flags = _column(batch.column(names.index(c)))
                extra += [form, pa.array(flags, pa.int64())]
                labels += [f"{c}_norm", f"{c}_flags"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *labels])

    out = spread(base).mapInArrow(run, schema)
    wanted = [c for c in names if keep is None or c in keep]
    return out.select(*wanted, *[x for c in columns for x in (f"{c}_norm", f"{c}_flags")])


def found_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field): the fields that hold any of the cases, one row each."""
    marked = normalise_lookalikes(df, columns, keep=[key])
    field: Column = F.explode(F.filter(F.array(*[F.when(F.col(f"{c}_flags").bitwiseAND(CASES) != 0, F.lit(c)) for c in columns]), lambda x: x.isNotNull()))
    return marked.select(key, field.alias("field"))
