"""Problem 10: sentence boundaries across languages and scripts.

A batch of texts is one array of code points. Blank lines, and in Thai all white space, are boundaries by rule. Every
other run of terminators, with the closing marks behind it, is a candidate that a maximum-entropy model accepts or
rejects. Its features are the neighbouring tokens, their case, length, digits and script, and whether a quotation or
bracket is open; they are read off running sums, run borders and rolling hashes, so that the work grows with the length
of the texts alone. The model is fitted on reliable boundaries: a bounded sample of the documents' own candidates whose
nature is beyond doubt, and a few sentences written down here that show abbreviations, ordinals and quotations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .arrowtext import code_points, single, slices

TERMINATORS = ".!?…。．！？｡।॥؟۔։"
CLOSERS = "\"'”’»›)]}』」】〉》）］“"
ENCLOSING = "«“„「『‹《【¿¡(（\"[*•"
DASHES = "-–—"
#: What may stand between a boundary and the first letter of the next sentence.
LEADING = " «“„\"'(¿¡—–-[「『"
PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "《": "》", '"': '"', "‚": "‘"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］"}
#: Documents that the model is fitted on, at most.
FIT_DOCS = 3000
#: Code points that a batch is cut to, about; a longer text is a batch of its own.
BATCH_CHARS = 400_000

#: Abbreviations that end in a point and commonly stand before more of the sentence.
ABBREVIATIONS = frozenset((
    "approx no nos vs etc min max fig vol ed pp cf al dr mr mrs ms prof st jr sr inc ltd co corp dept est ref tel ext ca bzw nr usw evtl ggf inkl exkl zzgl str tel abb bd hrsg vgl sog etw geb jh mio mrd "
    "env ex p av bd mme mlle chap art réf núm num ej aprox pág págs sra dra ud uds vd av dto máx mín es pag sig dott ecc tel n cad pz sr sra dra exa art cap tam напр ок тыс млн млрд руб коп др пр см рис стр гл ул корп им т е д п г гг н э и in ft lb oz hr hrs mins sec u.s u.k i.e e.g a.m p.m ph.d"
).split())
#: Those of them and others that lead to a name or a number, so that no sentence ends in them.
LEADING_ABBREVIATIONS = frozenset("dr mr mrs ms mx prof rev hon gen col capt lt sgt st mt sr sra srta dr dra dott dott.ssa sig sig.ra avv ing arch mme mlle mgr fr hr frl hl dipl av avda nr no nos núm vol fig vgl bd abb chap pág стр рис им ул".split())
#: Months, before which a number with a point is an ordinal.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
#: Texts with | at each true boundary and nowhere else at a terminator, for what the corpus shows too seldom.
SEEDS = (
    "Am 3. Juni beginnt der Kurs.|Er dauert bis zum 21. August und kostet ca. 30 Euro.|Wir lieferten 2019.|Danach kam nichts mehr.",
    "Nehmen Sie z. B. Holz, d. h. Fichte o. Ä. aus Nr. 12 bzw. Bd. 3.|Das genügt.|Siehe z. B. Seite 4.|Die Fa. Huber u. a. Firmen liefern.",
    "We met Dr. Miller at 5 p.m. on Friday.|The U.S. Army, the U.K. office and Mr. Stone agreed.|See No. 5, fig. 2 and vol. 3, i.e. the rest.|It weighs approx. 3 lb.|Done!",
    "It holds 2 l.|We like it.|Measure it (min. 3 in. wide, approx. 4 ft. long) first.|(This is included.)|The rest costs extra.|Tea, oil, etc. are fine.|Ready?|Yes.",
    "“It works! It holds,” said one of them.|“Why?” was all they asked.|\"Is it so?\" someone asked.|He said: “We go now.”|Then they left.|They wrote “Good! Very good” on it.|\"We agree.\"|They nodded.",
    "« Très bien ! Rien de plus », dit-elle.|Prenez p. ex. la vis n° 3 ou env. 4 kg.|M. Dupont et Mme. Petit viennent.|Est-ce vrai ?|Oui.|Il attend... puis il part.|Il attend...|Rien ne vient.",
    "«¡Muy bien! Gracias», dijo.|Use p. ej. la pág. 4 o la pieza núm. 5.|El Sr. Pérez y la Sra. Gil vienen.|¿Es así?|¡Sí!|Pesa aprox. 3 kg.",
    "«Bene! Grazie», ha detto.|Usate per es. il pezzo n. 4 o la pag. 3.|Il sig. Rossi pesa ca. 80 kg.|“Muito bem! Certo”, disse ela.|Use p. ex. a peça n. 3.|O Sr. Silva e a Dra. Lima vêm.",
    "«Отлично! Всё верно», — сказал он.|Возьмите, напр., деталь № 4, т. е. винт, и др. части.|Вес ок. 3 кг.|Он родился в 1990 г. в городе.|Это и т. д. и т. п. тоже.|Хорошо.",
    "“很好！我喜欢。”她说。|他等了……但是没有人来。|真的吗？|是的！|“好。”他们写道。|重量是3.5公斤。|完成了。",
    "「良い。とても良い。」と書きました。|待った……でも来なかった。|本当ですか？|はい！|重さは2.5キロです。|「はい。」と言った。|終わりです。",
    "It weighs 9 lb.|It is 3 ft.|The box is 12 in.|It fits well.|We paid 20 in.|They left at 5 p.m.|We stayed.|It came at 4 a.m.|The rest came later.",
    "यह घर बड़ा है।|वह काम करता है।|हमने 3 बार देखा।|इसे साफ़ करें।|यह अच्छा है।|किताब में चित्र हैं।|वह आया।|वज़न 4 किलो है।",
    "“अच्छा! ठीक है,” उसने कहा।|वज़न 3.5 किलो है।|क्या यह सही है?|हाँ।|«جيد! ممتاز» قال الرجل.|الوزن 3.5 كغ.|هل هذا صحيح؟|نعم.",
)


END, DIGIT, UPPER, LOWER, CJK, CASELESS, OPENING, DASH, PUNCT = range(9)
POINT, DOTS, STRONG, FULL = range(4)
STRONG_MARKS = [ord(c) for c in "!?؟！？"]
GLUED, SPACED, LINE = range(3)
#: Slots of the lexical features, each word's hash being one of them; those of the others are numbered without clash.
WORD_SLOTS = 1 << 16
SLOTS = 2 * WORD_SLOTS + 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


#: Bits of the classes that a character belongs to.
SPACE, WORD, ALNUM, LETTER, TERMINATOR, CLOSER, LEADER, ANGLE, MARK, JOINER, THAI, LOOSE = (1 << i for i in range(12))


class Tables(NamedTuple):
    shape: np.ndarray
    lower: np.ndarray
    bits: np.ndarray


@cache
def tables() -> Tables:
    """Of the code points of the basic plane, and of one more for all others: shape, small letter, class bits."""
    import unicodedata

    n = 0x10000
    shape, lower = np.full(n, PUNCT, np.uint8), np.arange(n, dtype=np.uint32)
    bits = np.zeros(n, np.uint16)
    for chars, bit in ((TERMINATORS, TERMINATOR), (CLOSERS, CLOSER), (LEADING, LEADER), ("»›", ANGLE), ("«»“”„\"「」『』‹›《》‚‘()（）[]［］", MARK), (".'’", JOINER), ("\"“", LOOSE)):
        bits[[ord(c) for c in set(chars)]] |= bit
    bits[0xE00:0xE80] |= THAI
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        bits[c] |= SPACE * ch.isspace() | WORD * (kind in "LMN") | ALNUM * (kind in "LN") | LETTER * (ch.isalpha() and not ch.isdigit())
        small = ch.lower()
        lower[c] = ord(small) if len(small) == 1 else c
        if ch.isdigit():
            shape[c] = DIGIT
        elif ch.isupper():
            shape[c] = UPPER
        elif ch.islower():
            shape[c] = LOWER
        elif ch.isalpha():
            shape[c] = CJK if 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF else CASELESS
        elif ch in DASHES:
            shape[c] = DASH
        elif ch in ENCLOSING:
            shape[c] = OPENING
    bits[0xFFFF], shape[0xFFFF], lower[0xFFFF] = WORD | ALNUM | LETTER, CASELESS, 0xFFFF
    return Tables(shape, lower, bits)


class Places:
    """Where a mask holds, to be asked for the first such place from given ones on; behind the last one, the end."""

    def __init__(self, mask: np.ndarray):
        self.at = np.append(np.flatnonzero(mask), len(mask))

    def __call__(self, start: np.ndarray) -> np.ndarray:
        return self.at[np.searchsorted(self.at, np.minimum(start, self.at[-1]))]


def word_hash(word: str) -> int:
    """The hash that ``Hashes`` gives a span that reads ``word``."""
    h, p = 0, 1
    for c in word:
        h = (h + (ord(c) + 1) * p) & (2**64 - 1)
        p = p * 0x100000001B3 & (2**64 - 1)
    return h * int(MIX) & (2**64 - 1)


class Hashes:
    """Hashes of any span of an array of code points, each in constant time."""

    def __init__(self, cps: np.ndarray):
        power = np.full(len(cps) + 1, BASE, np.uint64)
        inverse = np.full(len(cps) + 1, BASE_INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.total = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start] * MIX


ABBREVIATION_HASHES = np.sort(np.array([word_hash(w) for w in ABBREVIATIONS], np.uint64))
LEADING_HASHES = np.sort(np.array([word_hash(w) for w in LEADING_ABBREVIATIONS], np.uint64))
MONTH_HASHES = np.sort(np.array([word_hash(w) for w in MONTHS], np.uint64))


def enclosed(cps: np.ndarray, bits: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is bracket) of the quotations and brackets that close again within one paragraph.

    Only the marks themselves are gone through, each being pushed and popped once.
    """
    marks = np.flatnonzero(bits & MARK)
    starts, ends, brackets = [], [], []
    stack: list[tuple[int, bool, str]] = []
    awaited: dict[str, int] = {}
    last = -1
    before = np.where(marks > 0, tables().shape[np.minimum(cps[np.maximum(marks - 1, 0)], 0xFFFF)] == DIGIT, False)
    for at, ch, p, inches in zip(marks.tolist(), map(chr, cps[marks].tolist()), part[marks].tolist(), before.tolist()):
        if p != last:
            stack, awaited, last = [], {}, p
        if awaited.get(ch):
            while True:
                start, bracket, closing = stack.pop()
                for c in closing:
                    awaited[c] -= 1
                if ch in closing:
                    break
            starts.append(start)
            ends.append(at + 1)
            brackets.append(bracket)
            continue
        closing = BRACKETS.get(ch) or PAIRS.get(ch)
        if closing and not (ch == '"' and inches):
            stack.append((at, ch in BRACKETS, closing))
            for c in closing:
                awaited[c] = awaited.get(c, 0) + 1
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(brackets, bool)


class Candidates(NamedTuple):
    """Of each candidate: the place behind it, its feature slots, and 1, 0 or -1 as it is surely one, none, or open."""

    end: np.ndarray
    features: np.ndarray
    sure: np.ndarray


def _slots(*parts: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """One number for a combination of (value, number of values), and how many there are."""
    out, n = np.zeros(len(parts[0][0]), np.int64), 1
    for value, size in parts:
        out, n = out * size + value, n * size
    return out, n


class Layout:
    """A batch of texts as code points, with its paragraphs."""

    def __init__(self, cps: np.ndarray, offsets: np.ndarray):
        t = tables()
        self.cps, self.offsets, self.n = cps, offsets, len(cps)
        self.low = np.minimum(cps, 0xFFFF)
        self.bits = t.bits[self.low]
        self.space = (self.bits & SPACE) > 0
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        self.row_end = offsets[1:]
        self.first = np.zeros(self.n, bool)
        self.first[offsets[:-1][np.diff(offsets) > 0]] = True
        # white space with two line breaks or more ends a paragraph
        begins = self.space.copy()
        begins[1:] &= ~self.space[:-1] | self.first[1:]
        ends = self.space.copy()
        ends[:-1] &= ~self.space[1:] | self.first[1:]
        self.gap_start, self.gap_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        line = np.flatnonzero((cps == 10) | (cps == 13) & (np.append(cps[1:], 0) != 10))
        self.lines_before = lambda at: np.searchsorted(line, at)
        blank = self.lines_before(self.gap_end) - self.lines_before(self.gap_start) >= 2
        self.cut = self.first.copy()
        self.cut[self.gap_start[blank]] = True
        self.part = np.cumsum(self.cut, dtype=np.int32)

    def candidates(self) -> Candidates:
        """All runs of terminators with closing marks behind, save those that end a paragraph."""
        t, cps, n, part, bits, first = tables(), self.cps, self.n, self.part, self.bits, self.first
        none = Candidates(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64))
        terminator = (bits & TERMINATOR) > 0
        begins, ends = terminator.copy(), terminator.copy()
        begins[1:] &= ~terminator[:-1] | first[1:]
        ends[:-1] &= ~terminator[1:] | first[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            return none
        stop = self.row_end[self.row[start]]
        shape_of = t.shape[self.low]
        next_text, closer_end = Places(~self.space), Places(((bits & CLOSER) == 0) | first)
        same = lambda a, b: part[np.minimum(a, n - 1)] == part[b]
        live = np.arange(len(start))
        while len(live):  # closing marks, and after a gap an angle mark that no letter follows
            e, last = end[live], stop[live]
            to = np.where(e < last, closer_end(e), e)
            far = next_text(to)
            there = (far < last) & same(far, start[live])
            far = np.minimum(far, n - 1)
            after = np.minimum(far + 1, n - 1)
            to = np.where(there & ((bits[far] & ANGLE) > 0) & ~(((bits[after] & LETTER) > 0) & (after < last) & (after > far)), far + 1, to)
            end[live] = to
            live = live[to > e]
        s, e, bracket = enclosed(cps, bits, part)
        closes = np.sort(e)
        while True:  # a mark at the end that closes nothing opens what follows
            loose = ((bits[end - 1] & LOOSE) > 0) & (end > start + 1) & ~np.isin(end, closes)
            if not loose.any():
                break
            end = end - loose
        lead_at = next_text(end)
        keep = (lead_at < stop) & same(lead_at, start)
        start, end, lead_at, stop = start[keep], end[keep], lead_at[keep], stop[keep]
        if not len(start):
            return none

        over, closed = [], []
        for kind in (False, True):
            opened, ended = np.sort(s[bracket == kind]), np.sort(e[bracket == kind])
            shut = np.searchsorted(ended, end, "right") - np.searchsorted(ended, start, "right")
            over.append(np.searchsorted(opened, start) - np.searchsorted(ended, start, "right") - shut > 0)
            closed.append(shut > 0)
        inside = over[0] + 2 * over[1].astype(np.int64)
        shut = closed[0] + 2 * closed[1].astype(np.int64)

        own, second = cps[start], cps[np.minimum(start + 1, n - 1)]
        kind = np.full(len(start), FULL, np.int64)
        kind[np.isin(own, STRONG_MARKS)] = STRONG
        kind[own == ord(".")] = POINT
        kind[(own == ord("…")) | (own == ord(".")) & (second == ord(".")) & (end > start + 1)] = DOTS
        gap = np.where(lead_at == end, GLUED, np.where(self.lines_before(lead_at) > self.lines_before(end), LINE, SPACED))
        word = (bits & WORD) > 0
        lead = shape_of[lead_at]
        letter_at = np.minimum(Places(((bits & (LEADER | SPACE)) == 0) | first)(lead_at), n - 1)
        named = word[letter_at] & same(letter_at, start) & (letter_at < stop)
        following = np.where(named, shape_of[letter_at], lead)
        # the next word, with points and apostrophes inside it
        joined = np.zeros(n, bool)
        joined[1:-1] = ((bits[1:-1] & JOINER) > 0) & word[2:] & word[:-2]
        word_end = Places(~(word | joined) | first)
        hashes = Hashes(np.where(self.low < 0xFFFF, t.lower[self.low], cps))
        next_hash = hashes.of(np.where(named, letter_at, 0), np.where(named, word_end(letter_at + 1), 0))
        # the token before: what stands without white space, from its first letter or digit on
        gaps = np.searchsorted(self.gap_end, start)  # the first gap that ends at the place or behind it
        glued = (gaps < len(self.gap_end)) & (np.append(self.gap_end, -1)[gaps] == start)
        token_end = np.where(glued, np.append(self.gap_start, 0)[gaps], start)
        previous = np.where(gaps > 0, np.append(self.gap_end, 0)[gaps - 1], 0)
        token_start = np.maximum(previous, self.offsets[self.row[start]])
        held = (token_end > token_start) & same(np.maximum(token_end - 1, 0), start)
        token_end = np.where(held, token_end, token_start)
        token_start = np.minimum(Places((bits & ALNUM) > 0)(token_start), token_end)
        length = token_end - token_start
        two = np.zeros((2, n + 1), np.int64)  # running sums, two in each
        np.cumsum(((bits & LETTER) > 0) + ((shape_of == DIGIT).astype(np.int64) << 32), out=two[0, 1:])
        np.cumsum((shape_of == LOWER) + ((cps == ord(".")).astype(np.int64) << 32), out=two[1, 1:])
        letters, smalls = two[:, token_end] - two[:, token_start]
        token_hash = hashes.of(token_start, token_end)
        final = np.where(length > 0, shape_of[np.maximum(token_end - 1, 0)], END)
        single_letter = (length == 1) & ((letters & 0xFFFFFFFF) == 1)
        digits = (length > 0) & (letters >> 32 == length)
        small = (length > 0) & ((smalls & 0xFFFFFFFF) == length)
        dotted = smalls >> 32 > 0
        known = np.where(np.isin(token_hash, LEADING_HASHES), 2, np.isin(token_hash, ABBREVIATION_HASHES).astype(np.int64)) * (length > 0)
        month = digits & named & np.isin(next_hash, MONTH_HASHES)

        point = kind == POINT
        k, g, f = (kind, 4), (gap, 3), (following, 9)
        always = [_slots(k), _slots(g), _slots(f), _slots(k, g, f), _slots((lead, 9), g, k), _slots((inside, 4)), _slots((shut, 4), f, g), _slots((np.minimum(length, 4), 5), k), _slots((final, 9), k)]
        flag = lambda x: (x.astype(np.int64), 2)
        at_point = [_slots((known, 3)), _slots((known, 3), f), _slots(flag(single_letter)), _slots(flag(single_letter), f), _slots(flag(dotted)), _slots(flag(digits), f, g), _slots(flag(final == DIGIT), f, g), _slots(flag(month))]
        columns, base = [], 1  # slot 0 stands for no feature
        for value, size in always:
            columns.append(value + base)
            base += size
        for value, size in at_point:
            columns.append(np.where(point, value + base, 0))
            base += size
        slot = lambda h, salt: ((h ^ np.uint64(salt)) * MIX >> np.uint64(48)).astype(np.int64)
        columns.append(np.where(point & (length > 0), base + slot(token_hash, 1), 0))
        columns.append(np.where(named & (point | (following != CJK)), base + WORD_SLOTS + slot(next_hash, 2), 0))

        sure = np.full(len(start), -1, np.int64)
        low = following == LOWER
        bare = shut == 0
        sure[np.isin(kind, (STRONG, FULL)) & bare & np.isin(following, (UPPER, CJK, CASELESS))] = 1
        sure[~point & low] = 0
        sure[point & small & (length >= 4) & (known == 0) & (following == UPPER) & bare] = 1
        sure[point & (gap == GLUED) & (np.isin(following, (DIGIT, LOWER, PUNCT)) | (final == DIGIT))] = 0
        sure[point & low & bare] = 0
        sure[inside > 0] = 0
        return Candidates(end, np.stack(columns, 1), sure)

    def sentences(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end) of each sentence, in code points of its text, without surrounding white space."""
        if not self.n:
            return (np.zeros(0, np.int64),) * 3
        cut = self.cut.copy()
        thai = (self.bits & THAI) > 0
        if thai.any():
            before = np.zeros(len(self.gap_start), bool)
            clear = np.ones(len(self.gap_start), bool)
            for back in range(1, 5):  # up to three other marks may stand between
                at = self.gap_start - back
                clear &= (at >= 0) & (self.row[at] == self.row[self.gap_start]) & ~self.space[at]
                before |= clear & thai[at]
            to = np.minimum(self.gap_end, self.n - 1)
            after = thai[to] & (self.row[to] == self.row[self.gap_start])
            cut[self.gap_start[before | after]] = True
        c = self.candidates()
        if len(c.end):
            cut[c.end[w[c.features].sum(1) > 0]] = True
        piece = np.cumsum(cut)
        text = np.flatnonzero(~self.space)
        if not len(text):
            return (np.zeros(0, np.int64),) * 3
        fresh = np.flatnonzero(np.diff(piece[text], prepend=-1))
        start = text[fresh]
        end = text[np.append(fresh[1:], len(text)) - 1] + 1
        row = self.row[start]
        return row, start - self.offsets[row], end - self.offsets[row]


def layout(texts: list[str | None]) -> Layout:
    return Layout(*code_points(pa.array([t or "" for t in texts], pa.large_string())))


def fit(texts: list[str], rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the maximum-entropy model by batch Adagrad on the reliable candidates and the seeds."""
    own = layout(texts).candidates()
    told = own.sure >= 0
    rows, labels = [own.features[told]], [own.sure[told]]
    weights = [np.ones(int(told.sum()))]
    seeds = max(1.0, told.sum() / 2000)
    for text in SEEDS:
        for glue in (" ", "\n") if ord(text[0]) < 0x2E80 and text[0] not in "“「" else ("",):
            pieces = text.split("|")
            cuts = np.cumsum([len(p) + len(glue) for p in pieces]) - len(glue)
            c = layout([glue.join(pieces)]).candidates()
            rows.append(c.features)
            labels.append(np.isin(c.end, cuts).astype(np.int64))
            weights.append(np.full(len(c.end), seeds))
    rows = [r for r in rows if len(r)]
    labels, weights = np.concatenate(labels), np.concatenate(weights)
    table, same = np.unique(np.column_stack([np.concatenate(rows), labels]), axis=0, return_inverse=True)
    sw, y, flat = np.bincount(same.ravel(), weights), table[:, -1].astype(float), table[:, :-1].ravel()
    used = np.unique(flat)
    small = np.searchsorted(used, flat)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(rounds):
        z = w[small].reshape(len(y), -1).sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * sw
        g = np.bincount(small, np.repeat(error, table.shape[1] - 1), len(used)) / sw.sum() + ridge / 100 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        w[used == 0] = 0
    out = np.zeros(SLOTS)
    out[used] = w
    return out


def split(text: str, w: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each sentence of one text."""
    _, start, end = layout([text]).sentences(w)
    return list(zip(start.tolist(), end.tolist()))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """(key, sent_start BIGINT, sent_end BIGINT): every sentence of every text, as code point offsets, end excluded.

    Null, empty and blank texts give no row; a text without terminators is one sentence a paragraph. A repeated row
    repeats its sentences. The model is fitted on at most ``fit_docs`` documents, those of the least hash.
    """
    sample = df.select(text).filter(F.length(F.trim(text)) > 0).orderBy(F.xxhash64(text), text).limit(fit_docs)
    w = fit([r[0] for r in sample.toLocalIterator()])
    shared = df.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # one number a slot at any size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for part in slices(batch, 1, BATCH_CHARS):
                row, start, end = Layout(*code_points(single(part.column(1)).fill_null(""))).sentences(weights)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start), pa.array(end)], names=[key, "sent_start", "sent_end"])

    slim = df.select(key, text)
    return spread(slim).mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, sent_start bigint, sent_end bigint")
