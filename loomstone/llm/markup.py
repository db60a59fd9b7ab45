"""Problem 4: markup residue, turned into plain text that keeps headings, lists, code and formulas.

Arrow's own regular expressions tell, for a whole batch, which texts hold any sign that markup begins with; only
those are parsed. The parser takes out code and formulas first, so that nothing in them is read as markup, then HTML,
wiki, LaTeX and Markdown in this order, and puts code and formulas back at the end.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread
from .arrowtext import single

HTML, MARKDOWN, WIKI, LATEX = 1, 2, 4, 8
#: The element names of HTML and its older forms.
TAGS = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure "
    "font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav nobr noframes noscript object ol optgroup option output p param "
    "picture pre progress q ref rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
BREAKS = "address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form head header hr html main nav noscript ol p section table tbody td tfoot th thead tr ul".split()
#: LaTeX commands of formulas and the sign of each.
SIGNS = {
    "times": "×", "div": "÷", "cdot": "·", "pm": "±", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "infty": "∞", "sqrt": "√", "sum": "∑", "int": "∫", "degree": "°", "circ": "°", "to": "→",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Omega": "Ω", "Sigma": "Σ",
}
#: A text without any of these holds no markup.
TRIGGER = r"""(?m)<[A-Za-z/!?]|&#?[A-Za-z0-9]+;|\\[A-Za-z(\[&%$#_{]|\[\[|\]\(|\*\*|__|~~|`|'''|^\s*={2,}|^\s{0,3}#{1,6}\s|^\s*[*+]\s|\|\s*:?-{3,}|\$[^$\n]*[\\^_=][^$\n]*\$|\$\$|\{\{|\{\||^\s*>\s"""
_I = re.IGNORECASE
_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<!\[CDATA\[|\]\]>|<\?xml[^>]*\?>", _I | re.S)
FENCE = re.compile(r"(?:^|(?<=\n)|(?<=\s))(`{3,}|~{3,})[ \t]*([\w+-]*)[ \t]*\n?(.*?)(?:\1|\Z)", re.S)
PRE = re.compile(r"<(pre|code|kbd|samp|tt)(?:\s[^<>]*)?>\s*(?:<code(?:\s[^<>]*)?>)?(.*?)(?:</code\s*>\s*)?(?:</\1\s*>|\Z)", _I | re.S)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(.*?)(?:\\end\{\1\}|\Z)", _I | re.S)
TICKS = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
FORMULA = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$(?=[^\s$])([^$\n]{0,200}?[\\^_=][^$\n]{0,200}?)(?<!\s)\$(?!\d)|\\begin\{(?:equation|align|math|displaymath)\*?\}(.+?)\\end\{(?:equation|align|math|displaymath)\*?\}|<math[^<>]*>(.*?)</math>", re.S)
DROPPED = re.compile(r"<(script|style|template|svg|iframe|noframes)(?:\s[^<>]*)?>.*?(?:</\1\s*>|\Z)", _I | re.S)
HEAD = re.compile(r"<h([1-6])(?:\s[^<>]*)?>(.*?)(?:</h[1-6]\s*>|\Z)", _I | re.S)
IMG = re.compile(r"<img\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", _I)
ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", _I)
ITEM = re.compile(r"<li(?:\s[^<>]*)?>", _I)
BREAK = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS, key=len, reverse=True))})(?:\s[^<>]*)?/?>|</(?:li|pre)\s*>", _I)
TAG = re.compile(rf"</?(?:{_NAMES})(?:\s+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?>", _I)
CUT_END = re.compile(rf"<(?:/?(?:{_NAMES})(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*|'[^'<>]*|[^\s<>\"']*)?[\"']?)?)*\s*/?|!--?[^>]*|/)\Z", _I)
CUT_START = re.compile(r"\A[^<>\n]{0,80}?[\w-]+\s*=\s*\"[^\"<>]*\"\s*/?>", _I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});", _I)
WIKI_HEAD = re.compile(r"(?:^|(?<=\n))[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*(?=\n|\Z)|(?<!=)(={2,6}) ([^=\n]{1,80}?) \3(?!=)")
WIKI_BOLD = re.compile(r"'{5}(.+?)'{5}|'''(.+?)'''|''(?=\S)(.+?)(?<=\S)''")
WIKI_FILE = re.compile(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", _I)
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}")
WIKI_TABLE = re.compile(r"(?:^|(?<=\n))[ \t]*(?:\{\||\|\}|\|-+(?=[^|\n]*(?:\n|\Z)))[^\n]*")
LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|title)\*?\{([^{}]*)\}", _I)
LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\]]*\])?[ \t]*", _I)
LATEX_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]]*\]|\{[^{}]*\})?", _I)
LATEX_LINK = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}", _I)
LATEX_ARG = re.compile(r"\\([A-Za-z]{2,})\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
LATEX_BARE = re.compile(r"\\(?:maketitle|centering|noindent|newline|linebreak|pagebreak|newpage|hline|par|small|large|bfseries|itshape|ldots|dots|quad|qquad|LaTeX|TeX)\b[ \t]*", _I)
LATEX_ESCAPE = re.compile(r"\\([&%$#_{}])")
MD_HEAD = re.compile(r"(?:^|(?<=\n))[ \t]{0,3}(#{1,6})[ \t]+([^\n]+?)[ \t]*#*[ \t]*(?=\n|\Z)")
MD_IMAGE = re.compile(r"!\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
MD_LINK = re.compile(r"\[([^\[\]]+)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
MD_STRONG = re.compile(r"(?<![*\w])(\*{2,3})(?=\S)([^*\n]+?)(?<=\S)\1(?![*\w])|(?<![_\w])(__)(?=[^\s_])([^_\n]+?)(?<=\S)__(?![_\w])|~~(?=\S)(.+?)(?<=\S)~~")
MD_EM = re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![*\w])|(?<![_\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![_\w])")
MD_ITEM = re.compile(r"(?:^|(?<=\n))[ \t]*[*+][ \t]+(?=\S)")
MD_RULE = re.compile(r"(?:^|(?<=\n))[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|[ \t]*(?=\n|\Z)|(?:^|(?<=\n))[ \t]*\|[ \t]*:?-{3,}:?[ \t]*(?=\n|\Z)")
MD_ROW = re.compile(r"(?:^|(?<=\n))[ \t]*\|([^\n]*?)\|?[ \t]*(?=\n|\Z)")
MD_QUOTE = re.compile(r"(?:^|(?<=\n))[ \t]{0,3}>[ \t]+(?=\S)")
SPACES, LINES = re.compile(r"[ \t\f\v]+"), re.compile(r"\s*\n\s*")


def _formula(body: str) -> str:
    body = re.sub(r"\\(?:frac)\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", body)
    body = re.sub(r"\\([A-Za-z]+)", lambda m: SIGNS.get(m[1], SIGNS.get(m[1].lower(), m[1])), body)
    return re.sub(r"\s+", " ", body.replace("{", "").replace("}", "")).strip()


def to_plain(text: str) -> tuple[str, int, list[tuple[str, str]]]:
    """(plain text, kinds of markup found, kept parts as (kind, text)) of one text."""
    found = 0
    kept: list[tuple[str, str]] = []
    stash: list[str] = []

    def put(kind: str, body: str, block: bool) -> str:
        kept.append((kind, body))
        stash.append(body)
        mark = f"\ue000{len(stash) - 1}\ue001"
        return f"\n{mark}\n" if block else mark

    def sub(pattern: re.Pattern, by, kind: int) -> None:
        nonlocal text, found
        text, n = pattern.subn(by, text)
        if n:
            found |= kind

    def head(m: re.Match, group: int) -> str:
        title = SPACES.sub(" ", TAG.sub("", m[group])).strip()
        if title:
            kept.append(("heading", html.unescape(title)))
        return f"\n{title}\n"

    if "<!" in text or "<?" in text or "]]>" in text:
        sub(COMMENT, " ", HTML)
    if "```" in text or "~~~" in text:
        sub(FENCE, lambda m: put("code", m[3].strip("\n"), True), MARKDOWN)
    if "<" in text:
        sub(PRE, lambda m: put("code", html.unescape(TAG.sub("", m[2])).strip("\n"), "\n" in m[2] or m[1].lower() == "pre"), HTML)
    if "\\begin" in text.lower():
        sub(VERBATIM, lambda m: put("code", m[2].strip("\n"), True), LATEX)
    if "`" in text:
        sub(TICKS, lambda m: put("code", m[1], False), MARKDOWN)
    if "$" in text or "\\" in text or "<math" in text:
        sub(FORMULA, lambda m: put("formula", _formula(next(g for g in m.groups() if g is not None)), False), LATEX)
    if "<" in text or '=\"' in text:
        sub(DROPPED, " ", HTML)
        sub(HEAD, lambda m: head(m, 2), HTML)

        def image(m: re.Match) -> str:
            alt = ALT.search(m[0])
            return next((g for g in alt.groups() if g), "") if alt else ""

        sub(IMG, image, HTML)
        sub(ITEM, "\n• ", HTML)
        sub(BREAK, "\n", HTML)
        sub(TAG, "", HTML)
        sub(CUT_END, "", HTML)
        sub(CUT_START, "", HTML)
    if "&" in text:
        entity = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else html.unescape(m[0].lower()) if m[0][1:].lower() in html.entities.html5 else m[0]
        before = text
        text = ENTITY.sub(entity, text)
        if text != before:
            found |= HTML
            text = text.replace("\xa0", " ")
    if "==" in text:
        sub(WIKI_HEAD, lambda m: head(m, 2 if m[2] else 4), WIKI)
    if "''" in text:
        sub(WIKI_BOLD, lambda m: m[1] or m[2] or m[3], WIKI)
    if "[[" in text:
        sub(WIKI_FILE, "", WIKI)
        sub(WIKI_LINK, r"\1", WIKI)
    if "{{" in text or "{|" in text:
        sub(WIKI_TEMPLATE, r"\1", WIKI)
        if "{|" in text:
            sub(WIKI_TABLE, "", WIKI)
    if "\\" in text:
        sub(LATEX_HEAD, lambda m: head(m, 1), LATEX)
        sub(LATEX_ITEM, "\n• ", LATEX)
        sub(LATEX_ENV, "\n", LATEX)
        sub(LATEX_LINK, r"\1", LATEX)
        for _ in range(8):  # nested arguments, from the innermost
            last = text
            sub(LATEX_ARG, r"\2", LATEX)
            if text == last:
                break
        sub(LATEX_BARE, "", LATEX)
        sub(LATEX_ESCAPE, r"\1", LATEX)
    if "#" in text:
        sub(MD_HEAD, lambda m: head(m, 2), MARKDOWN)
    if "](" in text:
        sub(MD_IMAGE, r"\1", MARKDOWN)
        sub(MD_LINK, r"\1", MARKDOWN)
    if "**" in text or "__" in text or "~~" in text:
        sub(MD_STRONG, lambda m: m[2] or m[4] or m[5], MARKDOWN)
    if "*" in text or "+" in text:
        sub(MD_ITEM, "• ", MARKDOWN)
    if "*" in text or "_" in text:
        if "*" in text:
            sub(MD_EM, lambda m: m[1] or m[2], MARKDOWN)
    if "---" in text and MD_RULE.search(text):
        found |= MARKDOWN
        text = MD_RULE.sub("", text)
        text = MD_ROW.sub(lambda m: "\t".join(c.strip() for c in m[1].split("|")), text)
    if ">" in text:
        text = MD_QUOTE.sub("", text) if len(MD_QUOTE.findall(text)) > 1 else text
    if not found:
        return text, 0, []
    kept += [("item", m.strip()) for m in re.findall(r"• ([^\n]+)", text)]
    text = "\n".join(SPACES.sub(" ", line).strip() for line in re.split(r"\n", text.replace("\t", "\ue002")))
    text = re.sub(r"\n{3,}", "\n\n", text).strip().replace("\ue002", "\t")
    text = re.sub("\ue000(\\d+)\ue001", lambda m: stash[int(m[1])], text)
    return text, found, kept


KEPT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))
_KEPT = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


def _column(values: pa.Array) -> tuple[pa.Array, list[int], list[list[tuple[str, str]]]]:
    values = single(values)
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        texts, kinds, kept = _column(values.flatten())
        sizes = values.value_lengths().fill_null(0).to_pylist()
        offsets, row_kinds, row_kept, at = [0], [], [], 0
        for n in sizes:
            k = 0
            for x in kinds[at : at + n]:
                k |= x
            row_kinds.append(k)
            row_kept.append([y for x in kept[at : at + n] for y in x])
            at += n
            offsets.append(at)
        mask = values.is_null() if values.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts, mask=mask), row_kinds, row_kept
    some = pc.match_substring_regex(values, TRIGGER).fill_null(False)
    some = pc.or_(some, pc.match_substring_regex(values, r'<[A-Za-z/!]|=\s*"[^"<>]*"\s*/?>').fill_null(False))
    n = len(values)
    kinds, kept = [0] * n, [[] for _ in range(n)]
    at = pc.indices_nonzero(some).to_pylist()
    if not at:
        return values, kinds, kept
    out = values.to_pylist()
    for i in at:
        out[i], kinds[i], kept[i] = to_plain(out[i])
    return pa.array(out, pa.string()), kinds, kept


def plain_text(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with, for each of ``columns``, ``<c>_text``, ``<c>_markup`` (bits) and ``<c>_kept``.

    Columns are strings or arrays of strings. Null stays null and empty stays empty, with no markup; texts without
    markup come out unchanged. ``<c>_kept`` holds the headings, list items, code and formulas in their order of kind.
    """
    base = df.select(*dict.fromkeys([*keep, *columns]))
    names = base.columns
    schema = T.StructType([*base.schema.fields])
    for c in columns:
        schema = schema.add(f"{c}_text", base.schema[c].dataType).add(f"{c}_markup", T.LongType()).add(f"{c}_kept", KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, labels = [], []
            for c in columns:
                texts, kinds, kept = _column(batch.column(names.index(c)))
                parts = pa.array([[{"kind": k, "text": t} for k, t in row] for row in kept], _KEPT)
                extra += [texts, pa.array(kinds, pa.int64()), parts]
                labels += [f"{c}_text", f"{c}_markup", f"{c}_kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *labels])

    out = spread(base).mapInArrow(run, schema)
    return out.select(*keep, *[x for c in columns for x in (f"{c}_text", f"{c}_markup", f"{c}_kept")])


def marked_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field): the fields that hold markup, one row each."""
    marked = plain_text(df, columns, [key])
    return marked.select(key, F.explode(F.filter(F.array(*[F.when(F.col(f"{c}_markup") != 0, F.lit(c)) for c in columns]), lambda x: x.isNotNull())).alias("field"))


def clean_listings(df: DataFrame, categories: DataFrame) -> DataFrame:
    """(row_id, title, description, main_cat, kept): the plain listing, with a main_cat of the list or null.

    Cleaned categories that the list doesn't hold in any case come out null. The list joins by its size.
    """
    plain = plain_text(df, ["title", "main_cat", "description"], ["row_id"])
    known = categories.select(F.lower(F.trim("main_cat")).alias("_k"), F.col("main_cat").alias("_cat")).dropDuplicates(["_k"])
    return plain.withColumn("_k", F.lower(F.trim(F.regexp_replace("main_cat_text", r"\s+", " ")))).join(known, "_k", "left").select("row_id", F.col("title_text").alias("title"), F.col("description_text").alias("description"), F.col("_cat").alias("main_cat"), F.concat("title_kept", "description_kept").alias("kept"))
