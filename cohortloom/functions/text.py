"""Offset-preserving text expressions, written as Spark SQL fragments.

Patterns are always literals, so each is compiled once per task. Offsets count
code points. ``(?U)`` makes ``\\b`` and ``\\s`` Unicode-aware.
"""

from __future__ import annotations

import re

from .. import fixed_values as fixed


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and bind it to ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def word_pattern(phrase: str) -> str:
    """A phrase whose words may be separated by any run of spaces or hyphens."""
    return r"[\s\-]+".join(_escape(word) for word in phrase.split())


def phrase_pattern(phrase: str) -> str:
    return rf"\b{word_pattern(phrase)}\b"


def cue_pattern(cue: str) -> str:
    """A cue keeps a word boundary only where it starts or ends with a word character."""
    lead = r"\b" if cue[:1].isalnum() else ""
    trail = r"\b" if cue.strip()[-1:].isalnum() else ""
    return lead + word_pattern(cue) + trail


def _escape(word: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", word)


def alternatives(patterns: list[str]) -> str:
    """One group matching any pattern, in order.

    A word boundary shared by neighbours is tested once for all of them, so places
    inside a word are left after a single test.
    """
    edged = [p for p in patterns if p.startswith(r"\b")]
    if len(edged) == len(patterns):
        return r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    rest = [p for p in patterns if not p.startswith(r"\b")]
    return f"(?:{alternatives(edged)}|{'|'.join(rest)})" if edged else f"(?:{'|'.join(rest)})"


def any_of(patterns: list[str]) -> str:
    return "(?iU)" + alternatives(patterns)


def folded_key(phrase: str) -> str:
    """Lower case, hyphens and runs of spaces as one space; same fold as ``hits`` keys."""
    return " ".join(phrase.lower().replace("-", " ").split())


#: Pieces that one step of a running length goes over.
STRIDE = 256


def before(pieces: str, base: str, i: str) -> str:
    """Code points in the pieces before the i-th, with ``base`` from ``bases``: at most STRIDE steps."""
    return (f"{base}[{i} div {STRIDE}] + aggregate(slice({pieces}, ({i} div {STRIDE}) * {STRIDE} + 1, {i} % {STRIDE}), "
            "0, (acc, y) -> acc + length(y))")


def bases(pieces: str) -> str:
    """Code points before every STRIDE-th piece."""
    return (f"transform(sequence(0, greatest(0, (size({pieces}) - 1) div {STRIDE})), "
            f"b -> aggregate(slice({pieces}, 1, b * {STRIDE}), 0, (acc, y) -> acc + length(y)))")


def hits(text: str, patterns: list[str], name: str, inside: bool = False) -> str:
    """Start, end and folded key of every place one of ``patterns`` begins.

    ``\\G`` ties each piece to the end of the one before: it holds the gap and the first
    character of a hit, so overlapping phrases are all found and offsets are sums of
    piece lengths. The phrase itself is what the lookahead saw. At one start the first
    pattern that matches wins; list the longest first. ``inside``: the text is part of one
    sentence, with so few hits that every offset is summed up from its start.
    """
    chained = quoted(rf"(?isU)\G.*?(?=({alternatives(patterns)})).")
    # few nested lambdas: the analyzer needs a round for each
    pieces, seen = f"{name}.x", f"{name}.p[i]"
    start = f"aggregate(slice({pieces}, 1, i + 1), 0, (acc, y) -> acc + length(y)) - 1" if inside else \
        f"{before(pieces, f'{name}b', 'i')} + length(x) - 1"
    key = f"regexp_replace(lower(z.h), {quoted(r'(?U)[\s-]+')}, ' ')"
    placed = f"transform({pieces}, (x, i) -> named_struct('s', {start}, 'h', {seen}))"
    both = ", ".join(f"'{field}', regexp_extract_all({text}, {chained}, {group})" for field, group in (("x", 0), ("p", 1)))
    made = f"transform({placed}, z -> named_struct('s', z.s, 'e', z.s + length(z.h), 'k', {key}))"
    return let(name, f"named_struct({both})", made if inside else let(f"{name}b", bases(pieces), made))


def prefix_free(phrases: list[str]) -> list[list[str]]:
    """Split phrases into layers in which none begins with another.

    Within a layer at most one phrase can match at a given start, so a layer can be
    found with a single pattern without hiding anything.
    """
    layers: dict[int, list[str]] = {}
    keys = [folded_key(p) for p in phrases]
    for phrase, key in zip(phrases, keys):
        depth = len({k for k in keys if k != key and key.startswith(k + " ")})
        layers.setdefault(depth, []).append(phrase)
    return [layers[d] for d in sorted(layers)]


def sentences(text: str) -> str:
    """Sentences as ``array<struct<text,s,e>>``: per line, trimmed, offsets into the text.

    A piece ends with the whitespace that breaks it off, which trimming removes.
    """
    chained = quoted(rf"(?sU)\G.*?(?:\n|{fixed.SENTENCE_BREAK}|\z)")
    lead = f"length(regexp_extract(x, {quoted(r'(?U)^\s*')}, 0))"
    start = f"{before('sp', 'spb', 'i')} + {lead}"
    trimmed = f"regexp_replace(x, {quoted(r'(?U)^\s+|\s+\z')}, '')"
    placed = f"transform(sp, (x, i) -> named_struct('text', {trimmed}, 's', {start}))"
    return let("sp", f"regexp_extract_all({text}, {chained}, 0)", let("spb", bases("sp"), (
        f"filter(transform({placed}, x -> {named('x.text', 'x.s')}), x -> length(x.text) > 0)")))


def named(text: str, start: str) -> str:
    return f"named_struct('text', {text}, 's', {start}, 'e', {start} + length({text}))"


def count_words(text: str) -> str:
    """Word tokens: letters with inner apostrophes or hyphens, or numbers."""
    return f"regexp_count({text}, {quoted('(?U)' + fixed.WORD_PATTERN)})"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted('(?U)' + fixed.WORD_PATTERN)}, 0)"


def count_chunks(text: str) -> str:
    """Whitespace-separated chunks."""
    return f"regexp_count({text}, {quoted(r'(?U)\S+')})"


def fold(text: str) -> str:
    """Lower case with spelling variants folded, for comparison only."""
    out = f"lower({text})"
    for pattern, replacement in fixed.SPELLING_FOLDS:
        out = f"regexp_replace({out}, {quoted('(?U)' + pattern)}, {quoted(replacement)})"
    return out


def fold_constant(text: str) -> str:
    """``fold`` applied on the driver to a configured phrase."""
    out = text.lower()
    for pattern, replacement in fixed.SPELLING_FOLDS:
        out = re.sub(pattern, replacement, out)
    return out


def only_link_words(text: str) -> str:
    """True when nothing but connecting words stands in ``text``."""
    other = r"(?iU)(?<!\S)(?!(?:" + "|".join(fixed.LINK_WORDS) + r")(?!\S))\S"
    return f"NOT {text} RLIKE {quoted(other)}"
