"""Text cleaning as ordered rule tables, folded into one native expression each.

A rule is ``(pattern, replacement)`` for a regular expression or ``(Literal(text), replacement)``
for plain text. Patterns follow Java; ``rx`` adds Unicode classes and line ends that are ``\\n`` only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Only:
    """Rules that change nothing in a text without any of ``marks``; such a text passes them by, undecoded."""

    marks: tuple[str, ...]
    rules: tuple


def only(*marks: str):
    return lambda *rules: Only(marks, rules)


def rx(pattern: str, flags: str = "") -> str:
    return f"(?Ud{flags}){pattern}"


def fold(column: Column, rules) -> Column:
    for rule in rules:
        if isinstance(rule, Only):
            column = once(column, _passing(rule))
            continue
        pattern, replacement = rule
        if isinstance(pattern, Literal):
            column = F.replace(column, F.lit(pattern.text), F.lit(replacement))
        else:
            column = F.regexp_replace(column, pattern, replacement)
    return column


def _passing(only: Only):
    def use(text: Column) -> Column:
        marked = reduce(or_, [F.contains(text, F.lit(m)) for m in only.marks])
        return F.when(marked, fold(text, only.rules)).otherwise(text)

    return use


def strip(column: Column) -> Column:
    return F.regexp_replace(column, rx(r"^\s+|\s+$"), "")


@F.arrow_udf(StringType())
def nfkd(texts: pa.Array) -> pa.Array:
    """Unicode decomposition, a batch at a time; the column is named once, so what stands below runs once."""
    return pc.utf8_normalize(texts, form="NFKD")


def once(column: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(column), use), 1)


# The steps of the cleaning chains, in order.
CAPTION = [
    (rx(r"\\ref\{[^}]*fig[^}]*\}"), "<Reference>"),
    (rx(r"\$.*?\$", "s"), ""),
    (rx(r"\\[a-zA-Z]+\{.*?\}"), ""),
    (rx(r"\\\w+\(.*?\)"), ""),
    (rx(r"\\\S+"), ""),
    (Literal("-\n"), " "),
    (Literal("\n"), " "),
    (Literal("-"), " "),
    (Literal("^"), ""),
    (rx(r"[`_|{}~%&$\(\)\[\]§=,+]"), " "),
    (Literal("'"), ""),
    (Literal('"'), ""),
    (Literal("!"), " ."),
    (Literal(" ?"), " ."),
    (r" {2,}", " "),
    (rx(r"fig\.\s+", "i"), ""),
]
EMBEDDING = [
    (Literal("\n"), " "),
    (Literal("\t"), " "),
    (rx(r"(\w+)-\s+(\w+)"), "$1$2"),
    (r"\\ref\{[^}]*\}|<ref>", " <reference> "),
    (r"\\cite\{[^}]*\}", " <citation> "),
    (rx(r"\$.*?\$"), " "),
    (rx(r"\b(var|de|ex|sub|multi|inter|intra|pre|pro|con|infra|non)\s+(?=\w)"), "$1"),
    (rx(r"\b(single|variable|output|limit)\s+(photon|length|key|distance|noise)\b"), "$1-$2"),
    (rx(r"\b(p|q|d|n)\s+(opt|extra|lim|if|success|flip|t)\b"), "$1_$2"),
    (r"[`_|{}~%&$\^§=,+\[\]\(\)]", " "),
    (rx(r"\b(\d+\.\d+\s*){2,}"), " "),
    (rx(r"\b([a-z]\d?|\w/\w|√\w)\b"), " "),
    (Literal("!"), "."),
    (Literal("?"), "."),
]
HONORIFICS = [only(f" {h} ")((Literal(f" {h} "), f" {h.replace('.', '')} ")) for h in ("mrs.", "ms.", "mr.", "dr.", "prof.", "dr.-ing.")]
PLACEHOLDERS = [only("http")((rx(r"http\S+"), " hrefl ")), only("@")((r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " email "))]
LINES = [only("\n")((rx(r"(?=[-\n])(-)?\n\d+\n+"), "$1 "), (Literal("\n"), " ")), only("|")((Literal("|"), " ")), only("`")((Literal("`"), " ")), only("_")((Literal(":_"), " "), (Literal("_"), " ")), *HONORIFICS]
MATH_ENVIRONMENTS = ["equation", "align", "gather", "multline", "flalign"]
LATEX_HEAD = [
    (r"[&()\[\]§=,]", ""),
    (r"[`:_]", " "),
    only("\\text")(*[(r"\\text[a-z]+\{([^{}]*)\}", "$1")] * 10),
    only("\\begin{figure}")((rx(r"\\begin\{figure\}.*?\\caption\{([^}]*)\}.*?\\end\{figure\}", "s"), "<caption_start>$1<caption_end>")),
    only("%")((rx(r"^\s*%.*$", "m"), ""), (rx(r"[^\\]%.*$", "m"), "")),
    only("bib")(
        (rx(r"\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "s"), ""),
        (r"\\bibliography\{[^}]*\}", ""),
        (r"\\bibliographystyle\{[^}]*\}", ""),
        (r"\\printbibliography(\[[^\]]*\])?", ""),
        (r"\\addbibresource\{[^}]*\}", ""),
    ),
    only("\\a")((r"\\author\{[^}]*\}", ""), (r"\\affiliation\{[^}]*\}", "")),
    only("\\begin{document}")((rx(r"^.*?\\begin\{document\}", "s"), "")),
    only("\\maketitle")((rx(r"\\maketitle\s*"), "")),
    (rx(r"^\s+|\s+$"), ""),
    only("\\begin{")(
        (rx(r"\\begin\{tabular\}.*?\\end\{tabular\}", "s"), ""),
        *[(rx(rf"\\begin\{{{e}\}}.*?\\end\{{{e}\}}", "s"), "") for e in MATH_ENVIRONMENTS],
    ),
    only("$")((rx(r"\$\$.*?\$\$", "s"), ""), (rx(r"\$.*?\$"), "")),
    only("\\(")((rx(r"\\\(.*?\\\)", "s"), "")),
    only("\\[")((rx(r"\\\[.*?\\\]", "s"), "")),
    only("ref{")((rx(r"[~\s]*+\\(ref|eqref|autoref|pageref)\{[^}]*\}"), "")),
    only("\\cite")((rx(r"[~\s]*+\\cite(t|p|author|year|alp|alt|num)?\{[^}]*\}\s*"), " ")),
    # the range is asked first, so that most letters are passed after two comparisons
    (r"[\[{[\u27E8-\u3015\u2983-\u2986&&[⟨〈⟪「『【〔⦃⦅]]]", "("),
    (r"[\]}[\u27E8-\u3015\u2983-\u2986&&[⟩〉⟫」』】〕⦄⦆]]]", ")"),
    only("((")((Literal("(("), "(")),
    only("))")((Literal("))"), ")")),
    only("\\")((Literal("\\"), "")),
    only("(")((rx(r"\(\s*\)"), "")),
]
LATEX_TAIL = [
    *LINES,
    only(".")((rx(r"(?=\.\s)(?:\.\s+)+\."), " ")),
    only("-", "–")((r"(- |[A-Za-z0-9][-–][A-Za-z0-9]| –)", "")),
    only("  ")((r" {2,}", " ")),
    *PLACEHOLDERS,
    only("~")((Literal("~"), "")),
    only('"')((Literal('"'), "")),
    only("'")((Literal("'"), "")),
]
TIMES = r"([0-2][0-9]:[0-5][0-9]([pm]|[am])*)|([0-2]*[0-9]*:*[0-5][0-9]([pm]|[am])+)|([0-9][0-9]*([pm]|[am])+)"
DATES = r"[0-3]*[0-9]/[0-9]*/[0-9]+"
# every time begins with a digit or a colon
SYMBOLS = [(r"([!.,?=-])[!.,?=-]+", " $1 "), (rf"(?=[0-9:])(?:{TIMES})", " tiform "), only("/")((DATES, " dtform "))]
# what follows the letter is asked before the letter
POINTS = [(rx(r"(?=.[.,:;!?]\s)(?<![.!?:;\s])(\w)([.,:;!?])\s+"), "$1 $2 ")]
PAGE = [
    (rx(r"\n\s*(fig(?:ure)?)[.]?\b", "i"), "<figure>"),
]
PAGE_TAIL = [
    *LINES,
    (rx(r"\[[0-9,\s\-–]+\]"), ""),
    only(".")((rx(r"(?=\.\s)(?:\.\s+)+\."), " ")),
    (r"([A-Za-z0-9])[-–]([A-Za-z0-9])", "$1$2"),
    (r"[“\"]([^“\"]+)[”\"]", "<QUOTE> $1 </QUOTE>"),
    (r"[‘']([^‘']+)[’']", "<QUOTE> $1 </QUOTE>"),
    (rx(r"(?<=\w)['’]+(?=\w)"), ""),
    (r"[\"'“”‘’]", ""),
    (r" {2,}", " "),
    *PLACEHOLDERS,
]
STAMP = rx(r"arxiv:.*?\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\b[ ,]*")
ALNUM = r"\A[\pL\pN]+\z"


def clean_caption(text: Column) -> Column:
    """Plain caption text; null stays null."""
    return strip(fold(F.lower(text), CAPTION))


def clean_for_embeddings(text: Column) -> Column:
    """Distinct sentences of alphanumeric words in lower case, joined by '. '."""
    parts = F.split(fold(text, EMBEDDING), r"[.]")
    words = lambda s: F.filter(F.split(s, rx(r"\s+")), lambda w: w.rlike(ALNUM))
    sentences = F.array_distinct(F.transform(parts, lambda s: F.lower(F.array_join(words(s), " "))))
    return strip(F.regexp_replace(F.array_join(F.filter(sentences, lambda s: F.length(s) > 5), ". "), rx(r"\s+"), " "))


def clean_many_for_embeddings(texts: Column) -> Column:
    return F.transform(texts, clean_for_embeddings)


def normalize_caption(text: Column) -> Column:
    """A caption as it is compared: no figure number, words only."""
    bare = F.regexp_replace(F.lower(text), rx(r"\b(?:fig|figure)\s+\d+\s*:?", "i"), "")
    return strip(F.regexp_replace(F.regexp_replace(bare, rx(r"[^\w\s]"), " "), rx(r"\s+"), " "))


def sentenize(text: Column) -> Column:
    """Sentences at ' .', as arrays of alphanumeric words; a sentence may end up empty."""
    marked = fold(text, [(Literal(" !"), " ."), (Literal(" ?"), " .")])
    sentences = F.filter(F.split(marked, r" \."), lambda s: s != "")
    return F.transform(sentences, lambda s: F.filter(F.split(strip(F.translate(s, "%&$()[]§=,", "")), " "), lambda w: w.rlike(ALNUM)))


def latex_text(text: Column, strip_starred: bool = False) -> Column:
    """Running text of a LaTeX source. ``strip_starred`` also drops starred mathematics."""
    head = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    if strip_starred:
        head = fold(head, [(rx(rf"\\begin\{{{e}\*\}}.*?\\end\{{{e}\*\}}", "s"), "") for e in MATH_ENVIRONMENTS])
    body = fold(fold(nfkd(fold(head, LATEX_HEAD)), LATEX_TAIL), SYMBOLS)
    return strip(fold(F.concat(F.lit(" "), body, F.lit(" ")), POINTS))


@F.pandas_udf(StringType())
def _replace_first(texts: pd.Series) -> pd.Series:
    """Symbols, times, dates and points found in one text but replaced at their first place in the growing one."""
    import re
    from collections import Counter
    from itertools import groupby

    signs, times, dates = re.compile(r"[!.,?=-][!.,?=-]+"), re.compile(TIMES), re.compile(DATES)
    # the stop is sought first, then the letter before it: what begins with a small class is found faster
    digits, points = re.compile(r"[0-9][:amp]"), re.compile(r"([.,:;!?])(?<=(?<![.!?:;\s])(\w).)(\s+)")

    def one(text):
        if text is None:
            return None
        found = [(m, f" {m[0]} ") for m in signs.findall(text)]
        if digits.search(text):  # no time without
            found += [(m.group(), " tiform ") for m in times.finditer(text)]
        if "/" in text:
            found += [(m.group(), " dtform ") for m in dates.finditer(text)]
        for m, to in found:
            text = text.replace(m, to, 1)
        text = f" {text} "
        places = points.findall(text)
        found = Counter(places)
        pairs = Counter(m[:2] for m in found)
        # equal points go at once; those that differ in their white space only may hold each other, and go in turn
        runs = [(m, n) for m, n in found.items() if pairs[m[:2]] == 1]
        if len(pairs) < len(found):
            clashing = sorted((m for m in places if pairs[m[:2]] > 1), key=lambda m: m[:2])
            runs += [(m, len(list(equal))) for m, equal in groupby(clashing)]
        for (stop, letter, space), n in runs:
            text = text.replace(letter + stop + space, f"{letter} {stop} ", n)
        return text.strip()

    return texts.map(one)


def latex_text_compat(text: Column) -> Column:
    """``latex_text`` whose last steps replace the first literal occurrence instead of the match itself."""
    return _replace_first(fold(nfkd(fold(F.lower(F.concat(F.lit(" "), text, F.lit(" "))), LATEX_HEAD)), LATEX_TAIL))


def page_text(text: Column, page_number: Column) -> Column:
    """Running text of a page; the first page loses its stamp and what stands before the abstract."""
    body = fold(nfkd(fold(F.lower(text), PAGE)), PAGE_TAIL)
    whole = lambda t: once(F.locate("abstract", F.lower(t)), lambda at: F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t))
    return once(body, lambda b: F.when(page_number == 1, once(F.regexp_replace(b, STAMP, ""), whole)).otherwise(b))


# What ends a sentence and what does not.
ABBREVIATIONS = ["fig", "figs", "eq", "eqs", "ref", "refs", "sec", "e.g", "i.e", "et al", "cf", "vs", "dr", "mr", "mrs", "ms", "prof", "no"]


BETWEEN = "(?i)(?<=[.!?])" + "".join(rf"(?<!\b{a.replace('.', r'[.]')}[.])" for a in ABBREVIATIONS) + r"\s+"


def sentences(text: Column) -> Column:
    """Sentences by rule: a stop, white space, and no abbreviation before the stop."""
    return F.filter(F.split(strip(text), BETWEEN), lambda s: s != "")


def spaced_sentences(text: Column) -> Column:
    """The same sentences, each with the white space after it, so that together they are the text."""
    gaps = F.regexp_extract_all(text, F.lit(BETWEEN), F.lit(0))
    pairs = F.arrays_zip(F.split(text, BETWEEN).alias("s"), gaps.alias("g"))
    return F.filter(F.transform(pairs, lambda p: F.concat(p["s"], F.coalesce(p["g"], F.lit("")))), lambda s: s != "")


def figure_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rx(r"(?:Figure|Fig\.?)\s*(\d+)", "i"), 1), F.lit(""))


def strip_figure_prefix(text: Column) -> Column:
    return strip(F.coalesce(F.regexp_replace(text, rx(r"^(?:Figure|Fig\.?)\s*\d+[:\.\s-]*\s*", "i"), ""), F.lit("")))


# Gates (first match of each), boosts (first hit counts) and vetoes.
GATES = [
    r"\b(cnot|cx|controlled-not)\b", r"\b(hadamard|h-gate|h gate)\b", r"\b(toffoli|ccx|ccn)\b", r"\b(pauli-x|x-gate|sigma-x)\b",
    r"\b(pauli-z|z-gate|phase-flip)\b", r"\b(rotation|r[xyz]|theta)\b", r"\b(swap|cz|controlled-z)\b", r"\b(measure|measurement)\b",
]
BOOSTS = [("quantum circuit", 0.15), ("quantum gates", 0.10), ("quantum circuits", 0.10), ("architecture", 0.05), ("circuit diagram", 0.10), ("scematic diagram", 0.10)]
VETOES = ["code", "plot", "chart", "flowchart", "block diagram", "heatmap", "curve", "graph", "performance", "bar chart", "algorithm", "pseudo-code"]


def gate_tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.regexp_extract(low, p, 1) for p in GATES]), lambda g: g != "")))


def qubit_count(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), rx(r"(\d+)\s*-?\s*qubits?"), 1), F.lit(""))


def boosted(score: Column, caption: Column, boosts=BOOSTS) -> Column:
    """A score with the boost of the first keyword that the caption holds, at most 1 if boosted."""
    low, out = F.lower(caption), None
    for word, more in boosts:
        hit, value = F.contains(low, F.lit(word)), F.least(score + F.lit(more), F.lit(1.0))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return score if out is None else out.otherwise(score)


def vetoed(text: Column, vetoes=VETOES) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in vetoes]), lambda v: F.contains(F.lower(F.coalesce(text, F.lit(""))), v))


def wanted_category(categories: Column, prefix: str = "quant-ph") -> Column:
    return F.exists(categories, lambda c: F.startswith(c, F.lit(prefix)))
