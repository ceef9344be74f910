import random
import re

import numpy as np
import pytest

from docpool.llm import gbt
from docpool.llm import markup as mu

ROW = "id long, text string, embed_text string, field string, clean string"
RESIDUE = {
    "html": ["a <b>bold</b> word", "x<br/>y", "<TABLE><TR><TD>c</TD></TR></TABLE>", "see &nbsp; and &#8212;", "<!-- note --> x", '<a href="u">t</a>', "<li>item", "</p>"],
    "wiki": ["[[page|name]]", "{{note|x}}", "''soft''", "== Title ==\ntext", "{| class=x\n| a\n|}"],
    "latex": ["\\section{Intro}", "\\textbf{x} y", "so \\(a+b\\) it is", "$$E = mc^2$$", "value $x_{i} \\le 2$ here", "\\begin{itemize}\n\\item one\n\\end{itemize}"],
    "markdown": ["a **bold** word", "__strong__ x", "an *accent* here", "~~gone~~", "[text](http://x)", "| a | b |\n| --- | --- |", "> quoted"],
}
PLAIN = ["Map<String, Cache> x = new Map<>()", "List<String> y", "costs $5 and $6", "a_b_c snake__case__x", "2 * 3 * 4", "a*b*c", "x & y; z", "# Title\n\n- item\n* item", "`<b>code</b>` here", "```\n<b>**x**</b> [[y]] \\section{z}\n```", "a == b", "~~~\n> quote\n~~~", "$HOME/x:$PATH", "R&D; no", "list[0](x"]


TAGS = set("a abbr b blockquote br code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img kbd li ol p pre s small span strong sub sup table tbody td th thead tr u ul".split())


def word(c):
    return c.isalnum() or c == "_"


def spans(line, mark, inner=lambda x: x != "", least=1):
    """Texts between two `mark`s of a line, with the characters outside."""
    at = [i for i in range(len(line)) if line.startswith(mark, i)]
    return [(line[:i][-1:], line[i + len(mark) : j], line[j + len(mark) :][:1]) for i in at for j in at if j >= i + len(mark) + least and inner(line[i + len(mark) : j])]


def between(line, a, b):
    i = line.find(a)
    return i >= 0 and line.find(b, i + len(a) + 1) >= 0


def has_html(text):
    for i, c in enumerate(text):
        if c == "<":
            stop = min((j for j in (text.find(">", i), text.find("<", i + 1)) if j >= 0), default=-1)
            body = text[i + 1 : stop] if stop >= 0 and text[stop] == ">" else ""
            name = body.removeprefix("/").rstrip("/").split(None, 1)[0] if body.strip("/ ") and not body.removeprefix("/")[:1].isspace() else ""
            rest = body.removeprefix("/")[len(name) :]
            if text.startswith("<!--", i) or (name.lower() in TAGS and (rest in ("", "/") or rest[0].isspace())):
                return True
        if c == "&" and (stop := text.find(";", i)) > 0:
            name = text[i + 1 : stop]
            letters = name.isascii() and name.isalpha() and 2 <= len(name) <= 8
            number = name[:1] == "#" and (name[1:].isdecimal() or name[1:2] in ("x", "X") and name[2:] != "" and all(x in "0123456789abcdefABCDEF" for x in name[2:]))
            if letters or number:
                return True
    return False


def has_wiki(line):
    bare = line.rstrip(" \t")
    title = any(bare[:n] == bare[-n:] == "=" * n and bare[n:-n].strip("=") != "" for n in (2, 3, 4, 5, 6)) and len(bare) - len(bare.lstrip("=")) <= 6 and len(bare) - len(bare.rstrip("=")) <= 6
    return between(line, "[[", "]]") or between(line, "{{", "}}") or between(line, "''", "''") or title or line.startswith("{|")


def has_latex(text):
    for i, c in enumerate(text):
        if c == "\\":
            name = text[i + 1 :]
            letters = len(name) - len(name.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
            if name[:1] in ("(", "[") or letters and name[letters:].removeprefix("*").startswith("{"):
                return True
    parts = text.split("$$")
    if any(x and not x.endswith("$") for x in parts[1:-1]):
        return True
    formula = lambda x: "$" not in x and any(c in x for c in "\\^_") and x == x.strip()
    return any(not (a and (word(a) or a == "$")) and not (b and (word(b) or b == "$")) for line in text.split("\n") for a, _, b in spans(line, "$", formula))


def has_markdown(line):
    out = lambda a, b, no="": not (a and (word(a) or a in no and no)) and not (b and (word(b) or b in no and no))
    if any(out(a, b) for mark in ("**", "__") for a, _, b in spans(line, mark)) or spans(line, "~~"):
        return True
    if any(out(a, b, "*") for a, _, b in spans(line, "*", lambda x: "*" not in x and x != "" and x == x.strip())):
        return True
    link = any(line[i : i + 2] == "](" and "[" in line[: i - 1] and line.find(")", i + 3) >= 0 for i in range(1, len(line)))
    bare = line.rstrip(" \t")
    return link or (len(bare) > 1 and bare[0] == bare[-1] == "|") or line.startswith("> ")


def truth(text):
    """The families by rule, from text without code; written apart from the operator's patterns."""
    lines, fence = [], ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = line[:3] if line[:3] in ("```", "~~~") else ""
        if fence:
            fence = "" if mark == fence else fence
        elif mark:
            fence = mark
            lines.append("\0")
        else:
            while (i := line.find("`")) >= 0 and (j := line.find("`", i + 1)) > i + 1:
                line = line[:i] + "\0" + line[j + 1 :]
            lines.append(line)
    bare = "\n".join(lines)
    tests = {"html": has_html(bare), "wiki": any(map(has_wiki, lines)), "latex": has_latex(bare), "markdown": any(map(has_markdown, lines))}
    return {f for f, found in tests.items() if found}


def corpus():
    texts = []
    for i in range(12):
        for family in RESIDUE.values():
            texts += [f"Sentence {i} before.\n\n{x}\n\nAnd after it." for x in family]
        texts += [f"Sentence {i} before.\n\n{x}\n\nAnd after it." for x in PLAIN]
    rng, every = random.Random(1), [x for family in RESIDUE.values() for x in family] + PLAIN
    for _ in range(300):  # several marks in one text
        texts.append(rng.choice([" ", "\n\n", " and "]).join(rng.sample(every, 3)))
    return texts


def test_rules():
    for family, texts in RESIDUE.items():
        for t in texts:
            assert family in truth(t), t
    for t in PLAIN[:-1]:
        assert not truth(t), t


def test_trees_on_held_out_marks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 32, (6000, 6))
    y = ((x[:, 0] > 15) ^ ((x[:, 3] < 8) & (x[:, 5] > 20))).astype(int)
    model = gbt.fit(x[:4000], y[:4000])
    assert ((model.scores(x[4000:]) > 0.5) == y[4000:]).mean() > 0.98
    assert gbt.fit(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, "clash", "clash") for i, (a, b) in enumerate(rows)], ROW)


def test_families_against_the_rules(spark):
    texts = corpus()
    got = {(r.row_id, r.field): set(r.families) for r in mu.markup_residue(frame(spark, [(t, t.replace("\n", "\r\n")) for t in texts]), "id", ["text", "embed_text"]).collect()}
    for i, t in enumerate(texts):
        assert got[i, "text"] == got[i, "embed_text"] == truth(t), t


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a <b>bold</b> &amp; <code>x</code>", "a bold & `x`"), ("<h2>Title</h2>text", "## Title\ntext"), ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"), ("== Title ==", "## Title"),
        ("[[page|name]] ''soft''", "name soft"), ("\\section{Intro}", "# Intro"), ("\\begin{itemize}\n\\item one\n\\end{itemize}", "- one"), ("$x_{i}$ and $$y^2$$", "$x_{i}$ and $$y^2$$"),
        ("**b** [t](u) ~~s~~", "b t s"), ("| a | b |\n| --- | --- |\n| c | d |", "a b\nc d"), ("> quoted", "quoted"), ("# T\n\n- i\n\n```\n<b>\n```", "# T\n\n- i\n\n```\n<b>\n```"), ("`<b>`", "`<b>`"),
    ],
)
def test_clean_text(given, wanted):
    model, threshold = mu.train(corpus())
    found, _ = mu.analysed(given, model, threshold)
    assert mu.clean(given, found).strip() == wanted


def test_null_empty_long_none(spark):
    got = {(r.row_id, r.field): (r.families, r.clean) for r in mu.markup_residue(frame(spark, [(None, ""), ("<b>x</b> " * 50_000, None), ("plain", "plain")]), "id", ["text", "embed_text"]).collect()}
    assert set(got) == {(0, "embed_text"), (1, "text"), (2, "text"), (2, "embed_text")}
    assert got[0, "embed_text"] == ([], "")
    assert got[1, "text"][0] == ["html"]
    assert mu.markup_residue(frame(spark, [("x", "y")]).limit(0), "id", ["text"]).collect() == []
    df = frame(spark, [("<b>x</b>", None)])
    assert mu.markup_residue(df.unionByName(df), "id", ["text"]).count() == 2


def test_tree_of_elements():
    text = "<div><p>a <b>c</b> d<br>e</p>" + "<i>" * 30 + "</div> <b>x"
    found = mu.marks(text)
    div, p, b, close_b, br, close_p = found[:6]
    close_div, last = found[-2:]
    assert div.partner is close_div and close_div.partner is div and p.partner is close_p and b.partner is close_b
    assert p.parent is close_p.parent is div and b.parent is close_b.parent is br.parent is p
    assert div.parent is close_div.parent is last.parent is None and last.partner is None
    assert p.children == [b, close_b, br] and all(m.partner is None and m.parent is div for m in found[6:-2])


def test_both_tags_agree():
    found = mu.marks("<b>x</b>")
    mu.decode(found, np.array([0.9, 0.0]), "<b>x</b>", [], 0.5)
    assert [m.residue for m in found] == [True, True]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("$$ \\frac{a}{b} $$ and <b>c</b>", "$$ \\frac{a}{b} $$ and c"), ("so \\(\\frac{a}{b}\\) and \\textbf{c}", "so \\(\\frac{a}{b}\\) and c"), ("for $5, $\\frac{a}{b}$ **c**", "for $5, $\\frac{a}{b}$ c"),
        ("\\begin{equation}\n\\sqrt{a}\n\\end{equation}\n**c**", "\\begin{equation}\n\\sqrt{a}\n\\end{equation}\nc"), ("costs $5 and <b>c</b> for $6", "costs $5 and c for $6"),
        ("<pre><code>**x** [[y]] \\section{z} &amp;</code></pre>**c**", "```\n**x** [[y]] \\section{z} &\n```\nc"), ("<code>**x**</code> **c**", "`**x**` c"), ("<!-- **x** <b> --> **c** </b>", "c"),
        ("<code>a **b</code> [[c]] **d** e", "`a **b` c **d** e"),
    ],
)
def test_what_is_within_formulas_and_code_stays(given, wanted):
    model, threshold = mu.train(corpus())
    found, _ = mu.analysed(given, model, threshold)
    assert mu.clean(given, found).strip() == wanted


def test_families_count_within_formulas_and_code(spark):
    texts = [*corpus(), "<pre>**x** [[y]]</pre>", "<!-- **x** [[y]] -->"]
    got = {r.row_id: set(r.families) for r in mu.markup_residue(frame(spark, [(t, None) for t in texts]), "id", ["text"]).collect()}
    assert got[len(texts) - 2] == got[len(texts) - 1] == {"html", "wiki", "markdown"}


SWALLOWED = [
    ("Index `a[0]`, see [guide](g.md)", "markdown", "Index `a[0]`, see guide"), ("use `**` for **this**", "markdown", "use `**` for this"), ("a `[[` opens [[x]]", "wiki", "a `[[` opens x"),
    ("a `{{` opens {{x}}", "wiki", "a `{{` opens x"), ("a `__` opens __x__", "markdown", "a `__` opens x"), ("a `<!--` opens\n\n<!-- x --> it", "html", "a `<!--` opens\n\n it"),
    ("a `~~` opens ~~x~~", "markdown", "a `~~` opens x"), ("a `$` opens $x_1$", "latex", "a `$` opens $x_1$"), ("see `<b>` and <b>x</b> y", "html", "see `<b>` and x y"),
    ("see [`a[0]`](g.md)", "markdown", "see `a[0]`"),
    ("see [`a](b`](g.md)", "markdown", "see `a](b`"), ("\\textbf{`a}` b} c", "latex", "`a}` b c"), ("| `a|b` | c |", "markdown", "`a|b` c"), ("[[p|`a|b` c]]", "wiki", "`a|b` c"),
]


def test_code_hides_no_mark_after_it(spark):
    texts = [t for t, _, _ in SWALLOWED]
    got = {r.row_id: (r.families, r.clean) for r in mu.markup_residue(frame(spark, [(t, None) for t in texts + corpus()]), "id", ["text"]).collect()}
    for i, (t, family, wanted) in enumerate(SWALLOWED):
        assert got[i] == ([family], wanted), t


def test_features_of_long_marks():
    for c in ("\\\\", "^", "_"):
        long, short = (f"$$ {'a ' * n}{c} b $$" for n in (2000, 20))
        x, y = (mu.features(t, [m for m in mu.marks(t) if m.kind == "display"], []) for t in (long, short))
        at = mu.FEATURES.index("special")
        assert x[0, at] == y[0, at] > 0


def parsed_rows(texts):
    rows = [mu.parsed(mu.unix_lines(t)) for t in texts]
    return np.concatenate([mu.features(clear, found, code) for clear, code, found in rows if found]), np.concatenate([mu.labels(clear, found) for clear, code, found in rows if found])


def test_the_trees_alone_decide_held_out_marks_and_need_the_tree():
    texts = corpus()
    model, _ = mu.train(texts[::2])
    x, y = parsed_rows(texts[1::2])
    right = ((model.scores(x) >= 0.5) == y).mean()
    assert right > 0.97
    flat = x.copy()
    flat[:, [mu.FEATURES.index(f) for f in mu.TREE]] = 0
    assert ((model.scores(flat) >= 0.5) == y).mean() < right


def test_densities_and_depths():
    clear, code, found = mu.parsed("<table><tr><td>a</td><td>b</td></tr></table> and <p>a long paragraph of text without a tag</p>")
    x = {(m.name, m.start): dict(zip(mu.FEATURES, row)) for m, row in zip(found, mu.features(clear, found, code))}
    table, p = (next(v for (n, _), v in sorted(x.items(), key=lambda v: v[0][1]) if n == name) for name in ("table", "p"))
    assert table["tag_density"] > p["tag_density"] and table["text_density"] < p["text_density"]
    assert [x[n, clear.index(f"<{n}>")]["depth"] for n in ("table", "tr", "td", "p")] == [0, 1, 2, 0]
    assert x["td", clear.index("<td>")]["same_siblings"] == 4
    spaced, _, marks = mu.parsed("<a href='x' class=y z>t</a> Map<String, Cache>")
    rows = [dict(zip(mu.FEATURES, row)) for row in mu.features(spaced, marks, [])]
    assert (rows[0]["attributes"], rows[0]["quoted"], rows[0]["bare"]) == (3, 1, 1) and rows[2]["token"] >= 8


def test_ancestors_and_descendants_are_decided_together():
    text = "$x_1 **b** y$"
    clear, code, found = mu.parsed(text)
    formula, strong = (next(m for m in found if m.kind == k) for k in ("dollar", "strong"))
    for scores, keeps in (((0.9, 0.2), True), ((0.6, 0.95), False)):
        mu.decode(found, np.array([scores[m is strong] for m in found]), clear, code, 0.1)
        assert formula.keeps is keeps and (strong.literal == "formula") is keeps
        assert formula.residue and strong.residue  # both families count
    clear, code, found = mu.parsed("$\\frac{a}{b}$")
    mu.decode(found, np.array([0.5, 0.95]), clear, code, 0.1)
    assert found[0].keeps and found[1].literal == "formula"
