"""Markup residue: a tree of marks, boosted trees over its nodes, hierarchical decoding, and clean text."""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.llm import gbt
from docpool.llm._text import sampled, slices

FAMILIES = ("html", "wiki", "latex", "markdown")

#: The HTML elements whose tags count as residue.
TAGS = (
    "a abbr b blockquote br code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img kbd li ol p pre s small span strong sub sup "
    "table tbody td th thead tr u ul"
).split()

_FENCE = re.compile(r"^(```|~~~)[^\n]*(?:\n(?!\1)[^\n]*)*(?:\n\1[^\n]*)?", re.M)
_INLINE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")

#: What is residue, exactly; applied to text whose code is masked.
STRICT = {
    "html": re.compile(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>|<!--|&(?:[A-Za-z]{2,8}|#[0-9]+|#[xX][0-9A-Fa-f]+);", re.I),
    "wiki": re.compile(r"\[\[[^\n]+?\]\]|\{\{[^\n]+?\}\}|''[^\n]+?''|^={2,6}[^=\n](?:[^\n]*[^=\n])?={2,6}[ \t]*$|^\{\|", re.M),
    "latex": re.compile(r"\\[A-Za-z]+\*?\{|\\[(\[]|\$\$(?:[^$]|\$(?!\$))+\$\$|(?<![\w$])\$(?!\s)[^$\n]*[\\^_][^$\n]*(?<!\s)\$(?![\w$])"),
    "markdown": re.compile(r"(?<!\w)\*\*[^\n]+?\*\*(?!\w)|(?<!\w)__[^\n]+?__(?!\w)|(?<![\w*])\*(?![\s*])[^*\n]*(?<!\s)\*(?![\w*])|~~[^\n]+?~~|\[[^\n]+?\]\([^\n]+?\)|^\|[^\n]*\|[ \t]*$|^> ", re.M),
}

#: A formula within a line, as STRICT has it.
_DOLLARS = r"(?<![\w$])\$(?!\s)[^$\n]*[\\^_][^$\n]*(?<!\s)\$(?![\w$])"


def _paired(exact: str, opens: str, closes: str) -> re.Pattern:
    """Well-formed marks, and look-alikes: what opens such a mark, with what closes it if that comes before the next well-formed one."""
    return re.compile(rf"{exact}|{opens}(?:(?:(?!{exact})[^\n])*?(?!{exact}){closes})?")


#: Kinds of candidate marks: family, what a text must hold, and a pattern that lets look-alikes through.
KINDS: dict[str, tuple[str, str, re.Pattern]] = {
    "tag": ("html", "<", re.compile(r"</?\s*([A-Za-z][A-Za-z0-9]*)(?:[\s/,][^<>]*)?>")),
    "comment": ("html", "<!--", re.compile(r"<!--(?:(?!-->)[\s\S])*(?:-->)?")),
    "entity": ("html", "&", re.compile(r"&#?\w+;?")),
    "link": ("wiki", "[[", _paired(r"\[\[[^\n]+?\]\]", r"\[\[", r"\]\]")),
    "template": ("wiki", "{{", _paired(r"\{\{[^\n]+?\}\}", r"\{\{", r"\}\}")),
    "quotes": ("wiki", "''", _paired(r"''[^\n]+?''+", "''", "''+")),
    "title": ("wiki", "==", re.compile(r"^=+[^\n]*=+[ \t]*$", re.M)),
    "wikitable": ("wiki", "{|", re.compile(r"\{\|")),
    "command": ("latex", "\\", re.compile(r"\\(?:[A-Za-z]+\*?\{?|[(\[])")),
    "display": ("latex", "$$", re.compile(r"\$\$(?:[^$]|\$(?!\$))*\$\$")),
    "dollar": ("latex", "$", _paired(_DOLLARS, r"\$", r"\$")),
    "strong": ("markdown", "**", _paired(r"(?<!\w)\*\*[^\n]+?\*\*(?!\w)", r"\*\*", r"\*\*")),
    "under": ("markdown", "__", _paired(r"(?<!\w)__[^\n]+?__(?!\w)", "__", "__")),
    "star": ("markdown", "*", _paired(r"(?<![\w*])\*(?![\s*])[^*\n]*(?<!\s)\*(?![\w*])", r"(?<!\*)\*(?!\*)", r"\*")),
    "strike": ("markdown", "~~", _paired(r"~~[^\n]+?~~", "~~", "~~")),
    "mdlink": ("markdown", "](", re.compile(r"\[[^\n]+?\]\((?:[^\n]+?\)|\))")),
    "row": ("markdown", "|", re.compile(r"^[^\n|]{0,3}\|[^\n]*", re.M)),
    "quote": ("markdown", ">", re.compile(r"^>[^\n]?", re.M)),
}
_NUMBER = {kind: i for i, kind in enumerate(KINDS)}
_TAG_SET = frozenset(TAGS)
_VOID = frozenset(("br", "hr", "img"))
_CODE = frozenset(("pre", "code", "kbd"))
#: Formulas, exactly: between dollars, in brackets, and environments of mathematics.
_FORMULA = re.compile(
    r"\$\$(?:[^$]|\$(?!\$))++\$\$|" + _DOLLARS + r"|\\\((?:(?!\\[()])[\s\S])*+\\\)|\\\[(?:(?!\\[\[\]])[\s\S])*+\\\]"
    r"|\\begin\{((?:equation|align|alignat|flalign|gather|multline|eqnarray|math|displaymath)\*?)\}(?:(?!\\(?:begin|end)\{\1\})[\s\S])*+\\end\{\1\}"
)


@dataclass
class Mark:
    """A candidate mark: its span, its kind, the tag or command it names, and its place in the tree of marks.

    `close` is where the element or formula that it opens ends, else its own end; `residue` says that it is a mark, not
    a look-alike; `keeps` that its descendants stay as they are; `literal` what around it keeps it so: an "element" of
    code, a "formula" or a "comment"; or that it is "crossing" the end of one.
    """

    kind: str
    start: int
    end: int
    name: str = ""
    parent: Mark | None = None
    partner: Mark | None = None
    children: list[Mark] = field(default_factory=list)
    score: float = 0.0
    residue: bool = False
    verbatim: bool = False
    close: int = 0
    formula: bool = False
    literal: str = ""
    keeps: bool = False

    def holder(self) -> str:
        """What the mark's descendants would be kept by, if it is what it looks like."""
        if self.formula:
            return "formula"
        if self.kind == "comment":
            return "comment"
        return "element" if self.kind == "tag" and self.name in _CODE and self.close > self.end else ""


def unix_lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def code_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, fenced) of fenced code and of inline code outside it, in order."""
    if "`" not in text and "~~~" not in text:
        return []
    fenced = [(m.start(), m.end(), True) for m in _FENCE.finditer(text)]
    out, at = [], 0
    for start, end, _ in [*fenced, (len(text), len(text), True)]:
        out += [(m.start(), m.end(), False) for m in _INLINE.finditer(text, at, start)]
        if start < end:
            out.append((start, end, True))
        at = end
    return out


def masked(text: str, code: list[tuple[int, int, bool]]) -> str:
    """The text with every character of code, but for line ends, replaced by one that is neither letter nor space."""
    if not code:
        return text
    out, at = [], 0
    for start, end, _ in code:
        out += [text[at:start], re.sub(r"[^\n]", "\0", text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def _pair(text: str, found: list[Mark]) -> None:
    """Sets the partners of tags and where elements close; an element that another one's closing tag ends has no partner."""
    open_: list[Mark] = []
    places: dict[str, list[int]] = {}  # by name, where open_ has its elements
    apart = 0  # within a comment or formula no tag belongs to an element
    for m in found:
        if m.start < apart:
            continue
        if m.kind == "comment" or m.formula:
            apart = m.close
        elif m.kind == "tag" and text.startswith("</", m.start):
            if places.get(m.name):
                at = places[m.name][-1]
                for other in open_[at:]:
                    places[other.name].pop()
                other = open_[at]
                other.partner, m.partner, other.close = m, other, m.end
                del open_[at:]
        elif m.kind == "tag" and m.name not in _VOID and not text.startswith("/>", m.end - 2):
            places.setdefault(m.name, []).append(len(open_))
            open_.append(m)


def marks(text: str) -> list[Mark]:
    """All candidate marks of a masked text as a tree in document order: a mark's parent is the least mark or element around it.

    An opening tag stands for its element, up to the closing tag, which has the same parent; a mark that opens a
    formula stands for the whole of it.
    """
    found: list[Mark] = []
    for kind, (_, trigger, pattern) in KINDS.items():
        if trigger in text:
            found += [Mark(kind, m.start(), m.end(), (m[1] if kind == "tag" else m[0] if kind == "command" else "").lower(), close=m.end()) for m in pattern.finditer(text)]
    found.sort(key=lambda m: (m.start, -m.end))
    formulas = dict(m.span() for m in _FORMULA.finditer(text)) if "$" in text or "\\" in text else {}
    for m in found:
        if m.start in formulas and (m.kind == "command" or m.kind in ("display", "dollar") and m.end == formulas[m.start]):
            m.close, m.formula = formulas[m.start], True
    _pair(text, found)
    open_: list[Mark] = []
    for m in found:
        while open_ and open_[-1].close <= m.start:
            open_.pop()
        if m.partner and m.partner.start < m.start:
            m.parent = m.partner.parent
        else:
            m.parent = next((o for o in reversed(open_) if o.close >= m.close), None)
        if m.parent:
            m.parent.children.append(m)
        open_.append(m)
    return found


@functools.cache
def _class(c: str) -> int:
    return 0 if not c else 1 if c == "\n" else 2 if c == " " else 3 if c.isalnum() else 4 if c in "_*$=`" else 5 if c in "<>[]{}()|\\" else 7 if c.isspace() else 6


#: Features of a mark, in the order of their columns; those of TREE depend on the tree, not on the mark's own text.
FEATURES = (
    "kind", "code", "before", "after", "first", "last", "edge", "tail", "name", "special", "length", "share", "ends", "shape",
    "attributes", "quoted", "bare", "token",
    "depth", "parent", "partner", "children", "descendants", "tag_density", "text_density", "siblings", "same_siblings", "place", "count",
)
TREE = FEATURES[FEATURES.index("depth") :]
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")


def _tokens(m: Mark, t: str) -> tuple[int, int, int, int]:
    """What a mark carries beside its content: numbers of its attributes, of quoted ones and of bare words, and its first token's form."""
    if m.kind == "tag":
        body = t[t.lower().index(m.name) + len(m.name) : -1]
        found = _ATTRIBUTE.findall(body)
        return len(found), sum(x[2][:1] in ("'", '"') and x[2] != "" for x in found), sum(not x[1] for x in found), _class(body[:1]) + 8 * ("," in body) + 16 * ("/" in body.rstrip("/"))
    if m.kind == "entity":
        name = t.strip("&;#")
        return min(31, len(name)), name.isdigit(), name.isascii() and name.isalpha(), (t[1:2] == "#") + 2 * (t[2:3] in ("x", "X")) + 4 * all(c in "0123456789abcdefABCDEF" for c in t[3:-1]) + 8 * t.isascii()
    if m.kind == "command":
        return len(t), t.endswith("{"), "*" in t, _class(t[1:2])
    return t.count("|"), t.count("="), t.count(" "), _class(t[2:3])


def features(text: str, found: list[Mark], code: list[tuple[int, int, bool]]) -> np.ndarray:
    """Bins of the features of a masked text's marks: their tokens and context, density and size of their subtrees, depth, and siblings."""
    out = np.zeros((len(found), len(FEATURES)), np.int64)
    if not found:
        return out.astype(np.uint8)
    counts: dict[str, int] = {}
    by_name: dict[tuple[int, str], int] = {}
    for m in found:
        counts[m.kind] = counts.get(m.kind, 0) + 1
        key = (id(m.parent), m.kind + m.name)
        by_name[key] = by_name.get(key, 0) + 1
    size: dict[int, list[int]] = {id(m): [0, 0] for m in found if m.children}  # marks below, and their characters
    for m in reversed(found):
        if m.parent:
            below, chars = size.get(id(m), (0, 0))
            above = size[id(m.parent)]
            above[0] += 1 + below
            above[1] += (m.end - m.start if m.kind == "tag" else 0) + chars
    starts = [c[0] for c in code]
    depth: dict[int, int] = {}
    place: dict[int, int] = {}
    roots = sum(m.parent is None for m in found)
    for i, m in enumerate(found):
        t = text[m.start : m.end]
        inner = t.strip("*_$~='[]{}")
        k = bisect.bisect_right(starts, m.start) - 1
        inside = k >= 0 and m.start < code[k][1]
        over = k + 1 < len(code) and code[k + 1][0] < m.end
        d = depth[id(m)] = 0 if m.parent is None else depth[id(m.parent)] + 1
        n = place[id(m.parent)] = place.get(id(m.parent), 0) + 1
        edge, tail = len(t) - len(t.lstrip(t[:1])), len(t) - len(t.rstrip(t[-1:]))
        span, (below, chars) = max(1, m.close - m.start), size.get(id(m), (0, 0))
        bare = t.rstrip(" \t")
        out[i] = (
            _NUMBER[m.kind],
            1 + code[k][2] if inside else 3 * over,
            _class(text[m.start - 1 : m.start]),
            _class(text[m.end : m.end + 1]),
            _class(t[edge : edge + 1]),
            _class(t[len(t) - tail - 1 : len(t) - tail]) if tail < len(t) else 0,
            edge,
            tail,
            (1 + (m.name in _TAG_SET)) if m.kind == "tag" else (2 if t[-1] == "{" else 1) if m.kind == "command" else 0,
            ("\\" in inner) + 2 * ("^" in inner) + 4 * ("_" in inner),
            len(inner).bit_length(),
            31 * len(inner) // max(1, len(t)),
            bare.endswith(">") + 2 * bare.endswith(";") + 4 * bare.endswith(")") + 8 * bare.endswith("|") + 16 * t.endswith("$"),
            (t[:1] == t[-1:]) + 2 * ("\n" in t) + 4 * t.startswith("</") + 8 * (len(t) > 2) + 16 * (inner == ""),
            *_tokens(m, t),
            d,
            1 + _NUMBER[m.parent.kind] if m.parent else 0,
            (m.partner is not None) + 2 * (m.close > m.end) + 4 * m.formula,
            len(m.children),
            below.bit_length(),
            31 * chars // span,
            31 * (span - chars - len(t)) // span,
            len(m.parent.children) if m.parent else roots,
            by_name[id(m.parent), m.kind + m.name],
            n,
            counts[m.kind],
        )
    return np.clip(out, 0, gbt.BINS - 1).astype(np.uint8)


def labels(text: str, found: list[Mark]) -> np.ndarray:
    """Which marks of a masked text are residue by STRICT: those that overlap a match of their family."""
    spans = {f: [m.span() for m in STRICT[f].finditer(text)] for f in {KINDS[m.kind][0] for m in found}}
    ends = {f: [b for _, b in x] for f, x in spans.items()}

    def overlaps(m: Mark) -> bool:
        family = KINDS[m.kind][0]
        k = bisect.bisect_right(ends[family], m.start)  # the first match that ends after the mark's start
        return k < len(ends[family]) and spans[family][k][0] < m.end

    return np.array([overlaps(m) for m in found], np.int64)


def _joint(found: list[Mark]) -> None:
    """Sets `keeps` by the most likely choice for each tree as a whole, from the root down.

    A mark that would keep its descendants as they are (a formula, a comment, an element of code) does so if this and what
    follows for the descendants is likelier than that it is a look-alike and they are free. Within a formula, marks of
    LaTeX speak for it and those of other families against it; comments and code may hold anything.
    """
    if not any(m.holder() for m in found):
        return
    p = {id(m): min(max(m.score, 1e-3), 1 - 1e-3) for m in found}
    free, held, math_ = ({id(m): 0.0 for m in found} for _ in range(3))  # first the sums over children, then with the mark
    better: dict[int, bool] = {}
    for m in reversed(found):
        k = id(m)
        yes, no = math.log(p[k]), math.log(1 - p[k])
        closing = m.partner is not None and m.partner.start < m.start  # its opening tag decides for both
        below = math_[k] if m.formula else held[k]
        better[k] = not closing and m.holder() != "" and yes + below >= no + free[k]
        whole = yes + below if m.holder() else yes + free[k]
        free[k], held[k], math_[k] = (0.0, 0.0, 0.0) if closing else (max(whole, no + free[k]), max(yes, no) + held[k], (yes if KINDS[m.kind][0] == "latex" else no) + math_[k])
        if m.parent:
            for sums in (free, held, math_):
                sums[id(m.parent)] += sums[k]
    for m in found:
        m.keeps = better[id(m)] and m.residue and not (m.parent and (m.parent.literal or m.parent.keeps))
        m.literal = (m.parent.literal or (m.parent.holder() if m.parent.keeps else "")) if m.parent else ""


def decode(found: list[Mark], scores: np.ndarray, clear: str, code: list[tuple[int, int, bool]], threshold: float) -> None:
    """Sets `residue`, and from the root down `keeps` and `literal`: nothing within code is residue, both tags of an element
    agree, what the trees take for a mark is checked against its family's exact pattern, and descendants of a formula, a
    comment or an element of code are literal, as is a mark that begins or ends within one.
    """
    starts = [c[0] for c in code]
    for m, s in zip(found, scores, strict=True):
        m.score = float(s)
    for m in found:
        k = bisect.bisect_right(starts, m.start) - 1
        m.verbatim = k >= 0 and m.start < code[k][1]
        if m.partner and m.partner.start < m.start:
            m.score = m.partner.score = max(m.score, m.partner.score)
    taken = [m for m in found if not m.verbatim and m.score >= threshold]
    for m, right in zip(taken, labels(clear, taken), strict=True):
        m.residue = bool(right)
    _joint(found)
    kept: list[tuple[int, int]] = []  # the contents of what is literal, in order
    for m in found:
        above = m.parent
        if above and above.literal == "crossing":
            while above and above.literal == "crossing":
                above = above.parent
            m.literal = (above.literal or (above.holder() if above.keeps else "")) if above else ""
        if not m.literal and kept and m.start < kept[-1][1]:
            m.literal, m.keeps = "crossing", False
        if m.keeps:
            kept.append((m.end, m.partner.start) if m.partner else (m.start, m.close))
    begins = [a for a, _ in kept]
    for m in found:
        k = bisect.bisect_left(begins, m.end) - 1
        if not m.literal and k >= 0 and m.start < begins[k] and m.end < kept[k][1]:
            m.literal = "crossing"


def parsed(text: str) -> tuple[str, list[tuple[int, int, bool]], list[Mark]]:
    """The text masked, its code, and its marks: code holds none and hides none after it."""
    code = code_spans(text)
    clear = masked(text, code)
    return clear, code, marks(clear)


def train(texts: list[str], *, trees: int = 60, depth: int = 5) -> tuple[gbt.Trees, float]:
    """Boosted trees fitted to marks that STRICT labels, and the threshold: low enough for 9,999 of 10,000 marks of the sample."""
    xs, ys = [], []
    for raw in texts:
        clear, code, found = parsed(unix_lines(raw))
        if found:
            xs.append(features(clear, found, code))
            ys.append(labels(clear, found))
    x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES)), np.uint8)
    y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
    model = gbt.fit(x, y, trees=trees, depth=depth)
    positive = np.sort(model.scores(x)[y == 1])
    return model, float(min(0.1, 0.5 * positive[len(positive) // 10000])) if len(positive) else 0.5


def analysed(text: str, model: gbt.Trees, threshold: float) -> tuple[list[Mark], list[tuple[int, int, bool]]]:
    clear, code, found = parsed(text)
    decode(found, model.scores(features(clear, found, code)) if found else np.zeros(0), clear, code, threshold)
    return found, code


_BREAKS = {"br", "p", "div", "tr", "table", "ul", "ol", "dl", "blockquote", "hr", "thead", "tbody", "dd", "dt"}
_LATEX_TITLES = {"\\chapter": "# ", "\\section": "# ", "\\subsection": "## ", "\\subsubsection": "### ", "\\paragraph": "#### "}


def _replacement(text: str, clear: str, m: Mark) -> list[tuple[int, int, str]]:
    """What a residue mark becomes: cuts of its text, (start, end, instead); clear is the text masked, where the mark's parts are sought."""
    t, a, b = text[m.start : m.end], m.start, m.end
    if m.kind == "tag":
        closing = t.startswith("</")
        if re.fullmatch(r"h[1-6]", m.name):
            return [(a, b, "\n" if closing else "\n" + "#" * int(m.name[1]) + " ")]
        if m.name == "li":
            return [(a, b, "" if closing else "\n- ")]
        if m.name == "pre":
            return [(a, b, "\n```\n")]
        if m.name in ("code", "kbd"):
            in_pre = m.parent is not None and m.parent.kind == "tag" and m.parent.name == "pre"
            return [(a, b, "" if in_pre else "`")]
        if m.name in ("td", "th"):
            return [(a, b, " " if closing else "")]
        return [(a, b, "\n" if m.name in _BREAKS else "")]
    if m.kind == "comment":
        return [(a, b, "")]
    if m.kind == "entity":
        return [(a, b, html.unescape(t).replace("\xa0", " "))]
    if m.kind in ("link", "template"):
        at = max(clear.rfind("|", a + 2, b - 2) + 1, a + 2)
        if m.kind == "template":
            at = max(clear.rfind("=", at, b - 2) + 1, at)
        return [(a, b, text[at : b - 2])]
    if m.kind in ("quotes", "strong", "under", "star", "strike"):
        c = t[0]
        n, k = len(t) - len(t.lstrip(c)), len(t) - len(t.rstrip(c))
        return [(a, a + n, ""), (b - k, b, "")]
    if m.kind == "title":
        bare = t.strip()
        n = min(6, len(bare) - len(bare.lstrip("=")))
        return [(a, b, "#" * n + " " + bare.strip("= \t"))]
    if m.kind == "wikitable":
        return [(a, b, "")]
    if m.kind == "command":
        if m.formula or not t.endswith("{"):
            return []  # the brackets of a formula stay
        close = clear.find("}", b)
        name = m.name.rstrip("{*")
        if name in ("\\begin", "\\end", "\\cite", "\\label", "\\ref"):
            return [(a, close + 1 if close >= 0 else b, "")]
        head = _LATEX_TITLES.get(name)
        return [(a, b, head or ""), *([(close, close + 1, "")] if close >= 0 else [])]
    if m.kind == "mdlink":
        mid = clear.find("](", a) - a
        return [(a - (text[a - 1 : a] == "!"), a + 1, ""), (a + mid, b, "")]
    if m.kind == "row":
        line = t.strip()
        if re.fullmatch(r"\|[\s:|-]*\|", line):
            return [(a, min(len(text), b + 1), "")]
        at, cells = text.find(line, a) + len(line) - len(line.lstrip("|")), []
        for x in clear[at : at + len(line.strip("|"))].split("|"):
            cells.append(text[at : at + len(x)].strip())
            at += len(x) + 1
        return [(a, b, " ".join(cells))]
    if m.kind == "quote":
        return [(a, b, "")]
    return []  # formulas stay as they are


def _of_code(m: Mark) -> bool:
    """Whether a mark within an element of code belongs to how HTML writes it: the code of a pre, or a character reference."""
    return m.literal == "element" and (m.kind == "entity" or m.kind == "tag" and m.name in ("code", "kbd") and m.parent is not None and m.parent.name == "pre" and not m.parent.literal)


def clean(text: str, found: list[Mark]) -> str:
    """The text without its residue: headings, list items, code and formulas stay, in Markdown's form."""
    edits: list[tuple[int, int, str]] = []
    clear = masked(text, code_spans(text)) if found else text
    for m in found:
        if m.residue and (not m.literal or _of_code(m)):
            edits += _replacement(text, clear, m)
        elif m.name == "\\item" and not m.verbatim and not m.literal:
            edits.append((m.start, m.end + (text[m.end : m.end + 1] == " "), "- "))
    edits.sort(key=lambda e: (e[0], -e[1]))
    out, at = [], 0
    for start, end, instead in edits:
        if start >= at:
            out += [text[at:start], instead]
            at = end
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", "".join([*out, text[at:]]), flags=re.M)).strip("\n")


def markup_residue(rows: DataFrame, row_id: str, fields: list[str], *, sample_rows: int = 8000, cleaned: bool = True) -> DataFrame:
    """(row_id, field, families, clean): each field's families of markup residue, and its text without them.

    Marks of HTML, wiki, LaTeX and Markdown markup, and look-alikes, form a tree of elements; boosted trees over
    features of its nodes (FEATURES: attribute tokens, context, density of tags and text in the subtree, depth, siblings)
    tell marks from look-alikes, and the tree is decoded from the root down, so that nothing within code is residue, both
    tags of an element agree, and `clean` leaves what is within a formula, a comment, or an HTML element of code (but for
    character references) as it is; such marks count for the families all the same. A family is reported if the decoded
    tree has a mark of it; each mark that the trees find is checked against its family's exact pattern (STRICT).
    Headings, list items, code blocks and formulas are kept in `clean`, in Markdown's form.

    The trees are fitted to the marks of at most sample_rows rows (those with the smallest hash of the id), labelled
    by STRICT; every row is analysed. A null field gives no row; an empty one has no families and stays
    empty. Repeated ids are rows of their own. Other columns are not read. No rows give no rows; without marks
    in the sample the model is a constant. Rows are analysed where they lie, without a shuffle.
    """
    read = rows.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(fields)])
    model, threshold = train([t for r in sampled(read, "row_id", sample_rows) for t in r[1:] if t])

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(fields):
                for part in slices(iter([batch]), k + 1):
                    ids, families, texts = [], [], []
                    held = []
                    for i, raw in zip(part.column(0).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                        if raw is not None:
                            text = unix_lines(raw)
                            clear, code, found = parsed(text)
                            held.append((i, text, clear, code, found, features(clear, found, code) if found else None))
                    x = [p[5] for p in held if p[5] is not None]
                    scores = model.scores(np.concatenate(x)) if x else np.zeros(0)
                    at = 0
                    for i, text, clear, code, found, _ in held:
                        decode(found, scores[at : at + len(found)], clear, code, threshold)
                        at += len(found)
                        said = {KINDS[m.kind][0] for m in found if m.residue}
                        ids.append(i)
                        families.append([f for f in FAMILIES if f in said])
                        texts.append(clean(text, found) if cleaned else None)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(families, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["row_id", "field", "families", "clean"])

    return read.mapInArrow(analyse, "row_id long, field string, families array<string>, clean string")
