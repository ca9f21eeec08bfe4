"""LaTeX: extraction, rewriting, repair, validity (inventory N17-N25, V1-V3)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import as_column, first_group, let, rewrite

# Symbols and their LaTeX names, as text and as repairs.
NAMED = {
    "×": "times", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "Δ": "Delta", "θ": "theta", "λ": "lambda", "μ": "mu",
    "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "varphi", "ψ": "psi", "ω": "omega", "Ω": "Omega", "ε": "varepsilon",
    "η": "eta", "ν": "nu", "±": "pm", "≠": "neq", "≤": "leq", "≥": "geq", "≈": "approx", "→": "rightarrow", "←": "leftarrow",
    "↔": "leftrightarrow", "∞": "infty", "∑": "sum", "∫": "int", "∂": "partial", "∇": "nabla", "·": "cdot",
    "𝛥": "Delta", "𝛼": "alpha", "𝛽": "beta", "𝛾": "gamma", "𝛿": "delta", "𝜀": "varepsilon", "𝜃": "theta", "𝜆": "lambda",
    "𝜇": "mu", "𝜋": "pi", "𝜌": "rho", "𝜎": "sigma", "𝜏": "tau", "𝜑": "varphi", "𝜔": "omega",
}
PLAIN = {"−": "-", "–": "-", "—": "-", "√": r"$\sqrt{}$", "°": r"$^\circ$", "′": "'", "″": "''"}
REPAIRED = {
    "×": r" \times ", "−": "-", "–": "-", "—": "-", "√": r"\sqrt", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta",
    "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ω": r"\omega", "Ω": r"\Omega", "ε": r"\varepsilon", "°": r"^{\circ}",
    "±": r"\pm", "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "→": r"\rightarrow", "∞": r"\infty", "ℎ": "h",
}
CLEANED = {"×": r"\times", "÷": r"\div", "±": r"\pm"}
GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Theta Sigma Tau Upsilon Phi Chi Psi Omega".split()
GREEK_SMALL = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma sigma tau upsilon phi chi psi omega".split()
COMMANDS = (r"\\frac\{[^}]+\}\{[^}]+\}", r"\\sqrt\{[^}]*\}", r"\\vec\{[^}]+\}", r"\\hat\{[^}]+\}", r"\\bar\{[^}]+\}", r"\\sin\b", r"\\cos\b", r"\\tan\b", r"\\log\b", r"\\ln\b", r"\\exp\b")
ESCAPES = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))

LATIN = [chr(ord("A") + i) for i in range(26)], [chr(ord("a") + i) for i in range(26)]
BOLD_UPPER, BOLD_LOWER, ITALIC_UPPER, ITALIC_LOWER, GREEK_UPPER_AT, GREEK_LOWER_AT = 0x1D400, 0x1D41A, 0x1D434, 0x1D44E, 0x1D6A8, 0x1D6C2


def math_letters(shown: Callable[[str, bool], str]) -> dict[str, str]:
    """Bold and italic mathematical letters by rule; ``shown`` gets the letter and whether it is bold."""
    out = {}
    for base, letters, bold in ((BOLD_UPPER, LATIN[0], True), (BOLD_LOWER, LATIN[1], True), (ITALIC_UPPER, LATIN[0], False), (ITALIC_LOWER, LATIN[1], False)):
        out |= {chr(base + i): shown(x, bold) for i, x in enumerate(letters)}
    return out


def math_greek() -> dict[str, str]:
    """Bold Greek, both cases (decision B16)."""
    out = {chr(GREEK_UPPER_AT + i): rf"$\{n}$" for i, n in enumerate(GREEK)}
    return out | {chr(GREEK_LOWER_AT + i): rf"$\{n}$" for i, n in enumerate(GREEK_SMALL)}


def spell(c: Column, table: dict[str, str]) -> Column:
    """Replace single characters by strings, looked up per character (one pass for any table size)."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    touched = "[" + "".join(table) + "]"

    def spelt(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(known, ch), ch)), "")

    return let(c, lambda x: F.when(x.rlike(touched), spelt(x)).otherwise(x))


def first_formula(c: str | Column) -> Column:
    """N17."""
    inner = first_group(c, r"\$([^$]+)\$")
    return F.when(inner.isNotNull(), F.concat(F.lit("$"), inner, F.lit("$")))


def to_latex(c: str | Column) -> Column:
    """Text with a dollar passes; else three rewrites, null if none fired."""
    col = as_column(c)
    done = rewrite(col, [(r"(\d+)x(\d+)", r"\$$1 \\times $2\$"), (r"(\w+)\^(\d+)", r"\$$1^{$2}\$"), (r"(\w+)/(\w+)", r"\$\\frac{$1}{$2}\$")], True)
    return F.when(F.contains(col, F.lit("$")), col).when(F.contains(done, F.lit("$")), done)


def formulas(c: str | Column, apart: bool = False) -> Column:
    """Display, then inline formulas, trimmed, none empty; with ``apart`` (N20) inline ones don't start inside display ones."""
    col = as_column(c)
    inline = r"(?<!\$)\$(?!\$)([^$]+)(?<!\$)\$(?!\$)" if apart else r"\$([^$]+)\$"
    both = F.concat(F.regexp_extract_all(col, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1)), F.regexp_extract_all(col, F.lit(inline), F.lit(1)))
    return F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != "")


def markdown_structure(c: str | Column) -> Column:
    """struct(headers, equations, sections)."""
    col = as_column(c)
    sections = F.filter(F.transform(F.split(col, r"(?m)(?=^\**Q\d+)"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.regexp_extract_all(col, F.lit(r"(?m)^#+\s+(.+)$"), F.lit(1)).alias("headers"), formulas(col, True).alias("equations"), sections.alias("sections"))


def clean_latex(c: str | Column) -> Column:
    """N22."""
    return F.trim(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), CLEANED.items(), rewrite(c, [(r"\s+", " ")])))


def fix_unicode(c: str | Column) -> Column:
    """Symbols to LaTeX, caret repair, bare powers, commands outside math wrapped in dollars."""
    col = as_column(c)
    table = {k: rf"$\{v}$" for k, v in NAMED.items()} | PLAIN
    table = math_greek() | math_letters(lambda x, bold: rf"$\mathbf{{{x}}}$" if bold else f"${x}$") | {"𝜀": r"$\varepsilon$"} | table
    out = rewrite(spell(col, table), [(r"\\textasciicircum\{\}(-?\d+)", r"\$^{$1}\$"), (r"\\textasciicircum\{\}", "^"), (r"(\d+)\^(-?\d+)(?![}])", r"\$$1^{$2}\$")])
    for command in COMMANDS:
        out = wrap_outside_math(out, command)
    return out


def wrap_outside_math(c: Column, pattern: str) -> Column:
    """Put dollars around matches that stand outside math, judged by the dollars before (escaped ones aside)."""

    def wrapped(text: Column) -> Column:
        parts = F.split(F.replace(text, F.lit(r"\$"), F.lit("\ue000")), r"\$", -1)
        out = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, f"({pattern})", r"\$$1\$")).otherwise(x))
        return F.replace(F.array_join(out, "$"), F.lit("\ue000"), F.lit(r"\$"))

    return let(c, lambda x: F.when(x.rlike(pattern), wrapped(x)).otherwise(x))


def escape_latex(c: str | Column) -> Column:
    """Light escaping where LaTeX is present, else all ten characters, in their order."""

    def escaped(x: Column) -> Column:
        light = reduce(lambda y, ch: F.replace(y, F.lit(ch), F.lit("\\" + ch)), "&%#", x)
        full = reduce(lambda y, kv: F.replace(y, F.lit(kv[0]), F.lit(kv[1])), ESCAPES, x)
        return F.when(F.contains(x, F.lit("\\")) | F.contains(x, F.lit("$")), light).otherwise(full)

    # plain text has nothing to rewrite: no symbol beyond ASCII, no command, no power
    fixed = lambda x: F.when(x.rlike(r"[^\x00-\x7F]|[\\^]"), fix_unicode(x)).otherwise(x)
    return let(let(c, fixed), escaped)


def decode_escapes(c: Column) -> Column:
    """``\\uXXXX`` to its character, for the Basic Multilingual Plane."""

    def decoded(x: Column) -> Column:
        marks = F.regexp_extract_all(x, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1))
        chars = F.concat(F.transform(marks, lambda h: F.decode(F.unhex(h), "UTF-16BE")), F.array(F.lit("")))
        parts = F.split(x, r"\\u[0-9a-fA-F]{4}", -1)
        return F.array_join(F.flatten(F.zip_with(parts, chars, lambda a, b: F.array(a, b))), "")

    return let(c, lambda x: F.when(x.rlike(r"\\u[0-9a-fA-F]{4}"), decoded(x)).otherwise(x))


#: Over the kinds of what lies between dollars (x: before the first one, e: empty, b: blank, t: other): a formula, and all that join it.
NEIGHBOURS = "[bt](?:[eb][bt])+(?=.)"


def merge_formulas(c: str | Column) -> Column:
    """Formulas with nothing but white space between them become one, however many there are: ``$a$ $b$`` is ``$a b$``.

    What lies between the dollars is named by its kind, one letter each.  Runs
    of neighbours are found in that word, and each piece comes out with what
    its place in a run asks for: its dollar, a space, or nothing.  The time is
    linear in the text.
    """
    blank = lambda p: F.ltrim(p, F.lit(" \t\n\x0b\f\r")) == ""

    def merged(parts: Column) -> Column:
        kinds = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, "x").when(p == "", "e").when(blank(p), "b").otherwise("t")), "")

        def places(word: Column) -> Column:
            """A letter for each piece: g (with its dollar), j (gone), s (after a space)."""
            runs = F.transform(F.regexp_extract_all(word, F.lit(NEIGHBOURS), F.lit(0)), lambda r: F.concat(F.lit("g"), F.repeat(F.lit("js"), ((F.length(r) - 1) / 2).cast("int"))))
            gaps = F.transform(F.split(word, NEIGHBOURS, -1), lambda g: F.repeat(F.lit("g"), F.length(g)))
            return F.split(F.array_join(F.flatten(F.zip_with(gaps, runs, lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), ""), "")

        piece = lambda p, i, at: F.when(i == 0, p).when(F.get(at, i) == "g", F.concat(F.lit("$"), p)).when(F.get(at, i) == "s", F.concat(F.lit(" "), p)).otherwise("")
        return let(let(kinds, places), lambda at: F.array_join(F.transform(parts, lambda p, i: piece(p, i, at)), ""))

    return let(c, lambda x: F.when(x.rlike(r"\$[^$]+\$\s*\$[^$]+\$"), let(F.split(x, r"\$", -1), merged)).otherwise(x))


def fix_latex(c: str | Column) -> Column:
    """Repairs of generated LaTeX; null becomes empty."""

    def fixed(x: Column) -> Column:
        out = decode_escapes(spell(x, math_letters(lambda y, _: y) | REPAIRED))
        out = rewrite(out, [(r"\\textasciicircum\{\}(-?\d+)", "^{$1}"), (r"\\textasciicircum\{\}", "^")])
        return rewrite(merge_formulas(out), [(r"\^(-?\d+)(?![}\d])", "^{$1}"), (r"_([a-zA-Z]{2,})(?![}])", "_{$1}"), (r"\$\$", r"\$"), (r"\$\s+", r"\$"), (r"\s+\$", r"\$"), (r"\\mathbb\{([A-Z])\}", "$1")])

    # plain text has nothing to repair: no symbol beyond ASCII, no command, dollar, power or index
    return let(F.coalesce(as_column(c).cast("string"), F.lit("")), lambda x: F.when(x.rlike(r"[^\x00-\x7F]|[\\$^_]"), fixed(x)).otherwise(x))


def latex_error(c: str | Column) -> Column:
    """V1: the first error, '' if there is none (null and empty are valid)."""
    return let(F.coalesce(as_column(c), F.lit("")), lambda x: F.when(x.rlike(r"[\\${}]"), error_of(x)).otherwise(""))


def error_of(col: Column) -> Column:
    depth = F.aggregate(
        F.regexp_extract_all(col, F.lit(r"[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, x: F.struct((acc.now + F.when(x == "{", 1).otherwise(-1)).alias("now"), F.least(acc.low, acc.now + F.when(x == "{", 1).otherwise(-1)).alias("low")),
    )
    return (
        F.when(F.regexp_count(col, F.lit(r"\$")) % 2 == 1, "Unbalanced $ signs")
        .when(depth.low < 0, "Unbalanced braces (extra })")
        .when(depth.now != 0, "Unbalanced braces (missing })")
        .when(F.contains(col, F.lit(r"\mathbb")), r"Contains \mathbb (broken output)")
        .when(col.rlike(r"(?:\$[^$]{1,2}\$\s*){5,}"), "Severely fragmented math")
        .otherwise("")
    )


def item_error(stem: str | Column, options: str | Column, kind: str | Column) -> Column:
    """V2: the first error of stem, option count and options."""
    opts = F.coalesce(as_column(options), F.array().cast("array<string>"))
    bad = F.filter(F.transform(opts, latex_error), lambda e: e != "")
    first = let(bad, lambda b: F.when(F.size(b) > 0, F.concat(F.lit("Option: "), F.try_element_at(b, F.lit(1)))).otherwise(""))
    rest = F.when((as_column(kind) == "mcq") & (F.size(opts) < 4), "Not enough options").otherwise(first)
    return let(latex_error(stem), lambda e: F.when(e != "", F.concat(F.lit("Question: "), e)).otherwise(rest))


def counts_balanced(c: str | Column) -> Column:
    """V3: as many closing as opening braces, an even number of dollars."""
    col = as_column(c)
    n = lambda p: F.regexp_count(col, F.lit(p))
    return (n(r"\{") == n(r"\}")) & (n(r"\$") % 2 == 0)
