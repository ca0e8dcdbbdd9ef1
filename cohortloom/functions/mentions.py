"""Modifier mentions in prose, as one expression over a text column.

A phrase hit counts when it can be tied to an event named in its sentence, or
when the text is a comment, which belongs to its record by construction. Cues in
reach decide what the text asserts. The whole reading happens inside the row:
no shuffle, no Python. Texts without any catalogue phrase leave after a single
pattern test.
"""

from __future__ import annotations

from ..config import TrialConfig
from ..schema import MENTION
from .text import (any_of, count_chunks, count_words, cue_pattern, fold, fold_constant,
                   folded_key, hits, let, only_link_words, phrase_pattern, prefix_free, quoted,
                   sentences)

NO_MENTIONS = f"cast(array() as array<{MENTION}>)"


class MentionReader:
    """Builds the reading expressions for one configuration."""

    def __init__(self, config: TrialConfig):
        self.config = config
        self.reach = int(config.assertion.get("max_distance_tokens", 12))

    # -- phrase hits --------------------------------------------------------
    def _longest_first(self, phrases: list[str]) -> list[str]:
        return sorted(phrases, key=lambda p: -len(p))

    def modifier_hits(self, text: str, modifier: str) -> str:
        """Surface forms in the text, longest form first, then by position.

        Of forms beginning at one place only the longest is kept: a shorter one lies
        inside it, and is further from any event, so it can add nothing.
        """
        forms = self.config.surface_forms(modifier)
        ordered = self._longest_first(list(forms))
        table = _table({folded_key(f): (i, None if forms[f] == "UNSPECIFIED" else forms[f])
                        for i, f in enumerate(ordered)})
        found = hits(text, [phrase_pattern(f) for f in ordered], "mh")
        return ("array_sort(transform(" + found + ", h -> " + let(
            "f", f"try_element_at({table}, h.k)",
            "named_struct('rank', f.rank, 's', h.s, 'e', h.e, 'v', f.name)") + "))")

    def any_form(self, modifier: str) -> str:
        return any_of([phrase_pattern(f) for f in self.config.surface_forms(modifier)])

    def event_hits(self, text: str, concept_id: str | None = None) -> str:
        """Event names in the text; one lying inside a longer one is dropped."""
        names = {form: cid for cid, body in self.config.concepts.items()
                 for form in body.get("lexicon") or () if concept_id in (None, cid)}
        ordered = self._longest_first(list(names))
        if not ordered:
            return "cast(array() as array<struct<s:int,e:int,c:string>>)"
        table = _table({folded_key(f): (i, names[f]) for i, f in enumerate(ordered)})
        found = hits(text, [phrase_pattern(f) for f in ordered], "eh")
        ranked = ("array_sort(transform(" + found + ", h -> " + let(
            "f", f"try_element_at({table}, h.k)",
            "named_struct('rank', f.rank, 's', h.s, 'e', h.e, 'c', f.name)") + "))")
        return (f"array_sort(aggregate({ranked}, "
                "cast(array() as array<struct<s:int,e:int,c:string>>), "
                "(acc, x) -> CASE WHEN exists(acc, k -> k.s <= x.s AND x.e <= k.e) THEN acc "
                "ELSE array_append(acc, named_struct('s', x.s, 'e', x.e, 'c', x.c)) END))")

    # -- what the text asserts ----------------------------------------------
    def _cues(self, side: str) -> dict[str, str]:
        """Cue to assertion for one side, longest cue first."""
        cues = [(cue, cls) for cls in ("absent", "uncertain")
                for cue in (self.config.assertion["cues"].get(cls) or {}).get(side) or ()]
        return dict(sorted(cues, key=lambda cc: -len(cc[0])))

    def _cue_hits(self) -> str:
        """Cue hits around the mention ``c`` in sentence ``sen`` of ``t``.

        Each hit carries its class rank, absolute range and the gap to the
        mention. ``pos`` keeps the declared order, longest cue first.
        """
        found, ranks, before = [], {"uncertain": 2, "absent": 1}, 0
        for side, window, base, gap in (
                ("pre", "bef", "sen.s", "substring(bef, h.e + 1)"),
                ("post", "aft", "c.e", "substring(aft, 1, h.s)")):
            cues = self._cues(side)
            table = _table({folded_key(c): (-(before + i), str(ranks[cls]))
                            for i, (c, cls) in enumerate(cues.items())})
            before += len(cues)
            for layer in prefix_free(list(cues)):
                found.append("transform(" + hits(window, [cue_pattern(c) for c in layer], "ch", inside=True)
                             + ", h -> " + let("f", f"try_element_at({table}, trim(h.k))",
                             "named_struct('rank', cast(f.name as int), 'len', h.e - h.s, "
                             f"'pos', f.rank, 's', {base} + h.s, 'e', {base} + h.e, "
                             f"'gap', {gap})") + ")")
        return _concat(found)

    def _any_cue(self, side: str) -> str:
        return quoted(any_of([cue_pattern(cue) for body in self.config.assertion["cues"].values()
                              for cue in body.get(side) or ()]))

    def _governs(self, hit: str) -> str:
        """In reach, not past a terminator, not part of a phrase that asserts nothing."""
        stops = self.config.assertion.get("terminators") or []
        stop = "|".join(rf"\b{w}\b" if w.isalnum() else _literal(w) for w in stops)
        pseudo = ", ".join(quoted(fold_constant(p))
                           for p in self.config.assertion.get("pseudo_cues") or [])
        chunks = count_chunks(hit + ".gap")
        near = f"{chunks} <= {self.reach}"
        if stop:
            near += (f" AND ({chunks} = 0 OR NOT {fold(hit + '.gap')} RLIKE "
                     f"{quoted('(?U)' + stop)})")
        if not pseudo:
            return near
        # the surroundings are folded only for a cue that could open such a phrase
        around = fold(f"substring(t, greatest(0, {hit}.s - 4) + 1, "
                      f"{hit}.e + 40 - greatest(0, {hit}.s - 4))")
        cue = f"trim({fold(f'substring(t, {hit}.s + 1, {hit}.e - {hit}.s)')})"
        inside = let("pw", around, "exists(pq, p -> instr(pw, p) > 0)")
        opened = let("pc", cue, f"filter(array({pseudo}), p -> startswith(p, pc))")
        asserts_nothing = let("pq", opened, f"CASE WHEN size(pq) > 0 THEN {inside} ELSE false END")
        return f"CASE WHEN {near} THEN NOT {asserts_nothing} ELSE false END"

    def _cue(self) -> str:
        """The governing cue: a hedge outranks a negation, then the longer cue wins."""
        chosen = (f"array_max(transform(filter({self._cue_hits()}, q -> {self._governs('q')}), "
                  "q -> named_struct('rank', q.rank, 'len', q.len, 'pos', q.pos, 'first', -q.s, "
                  "'s', q.s, 'e', q.e)))")
        windows = let("bef", "substring(t, sen.s + 1, c.s - sen.s)",
                      let("aft", "substring(t, c.e + 1, sen.e - c.e)",
                          f"CASE WHEN bef RLIKE {self._any_cue('pre')} "
                          f"OR aft RLIKE {self._any_cue('post')} THEN {chosen} END"))
        return windows

    # -- one mention ---------------------------------------------------------
    def _mention(self, kind: str) -> str:
        """Score the hit ``c``; null when nothing ties it to an event."""
        key = self.config.confidence
        between = ("CASE WHEN anc IS NULL THEN '' WHEN c.s >= anc.e "
                   "THEN substring(t, anc.e + 1, c.s - anc.e) "
                   "ELSE substring(t, c.e + 1, anc.s - c.e) END")
        basis = (f"CASE WHEN cue.rank = 1 THEN 'negated' WHEN cue.rank = 2 THEN 'uncertain' "
                 f"WHEN anc IS NULL THEN 'comment_record' "
                 f"WHEN {only_link_words('btw')} THEN 'direct_phrase' "
                 f"WHEN {kind} = 'comment' THEN 'comment_record' ELSE 'same_sentence' END")
        confidence = "CASE b " + " ".join(
            f"WHEN '{k}' THEN {key(k)}D" for k in ("negated", "uncertain", "comment_record",
                                                   "direct_phrase", "same_sentence")) + " END"
        default = quoted(self.config.assertion.get("default", "present"))
        low, high = "least(c.s, coalesce(cue.s, c.s))", "greatest(c.e, coalesce(cue.e, c.e))"
        built = (f"named_struct('start', {low}, 'end', {high}, 'hit_start', c.s, 'hit_end', c.e, "
                 f"'value', c.v, 'assertion', CASE cue.rank WHEN 1 THEN 'absent' "
                 f"WHEN 2 THEN 'uncertain' ELSE {default} END, 'confidence', {confidence}, "
                 f"'rule', b, 'cue', substring(t, cue.s + 1, cue.e - cue.s), "
                 f"'anchor', substring(t, anc.s + 1, anc.e - anc.s), "
                 f"'surface', substring(t, {low} + 1, {high} - {low}))")
        scored = let("cue", self._cue(), let("b", basis, built))
        tied = let("btw", between, f"CASE WHEN (anc IS NOT NULL OR {kind} = 'comment') AND "
                                   f"{count_words('btw')} <= {self.reach} THEN {scored} END")
        nearest = ("array_min(transform(filter(ev, a -> sen.s <= a.s AND a.s < sen.e), a -> "
                   "named_struct('d', abs(a.s - c.s), 's', a.s, 'e', a.e)))")
        return let("sen", "get(filter(se, x -> x.s <= c.s AND c.s < x.e), 0)",
                   f"CASE WHEN sen IS NOT NULL THEN {let('anc', nearest, tied)} END")

    # -- all mentions and the one answer -------------------------------------
    def mentions(self, text: str, modifier: str, kind: str,
                 concept_id: str | None = None) -> str:
        """Every accepted mention, in order of acceptance.

        A hit inside an already accepted mention, cue included, is dropped.
        """
        scored = (f"filter(transform({self.modifier_hits('t', modifier)}, "
                  f"c -> {self._mention(kind)}), m -> m IS NOT NULL)")
        fold_in = (f"aggregate({scored}, {NO_MENTIONS}, (acc, m) -> "
                   "CASE WHEN exists(acc, k -> k.start <= m.hit_start AND m.hit_end <= k.end) "
                   "THEN acc ELSE array_append(acc, m) END)")
        body = let("se", sentences("t"), let("ev", self.event_hits("t", concept_id), fold_in))
        return (f"CASE WHEN {text} RLIKE {quoted(self.any_form(modifier))} "
                f"THEN {let('t', text, body)} ELSE {NO_MENTIONS} END")

    def ordered(self, text: str, modifier: str, kind: str) -> str:
        """Mentions by start, the more confident first."""
        compare = ("(l, r) -> CASE WHEN l.start <> r.start THEN l.start - r.start "
                   "WHEN l.confidence > r.confidence THEN -1 "
                   "WHEN l.confidence < r.confidence THEN 1 ELSE 0 END")
        return f"array_sort({self.mentions(text, modifier, kind)}, {compare})"

    def best(self, text: str, modifier: str, kind: str, concept_id: str | None = None) -> str:
        """The mention to believe, or null: none found, or equal support that disagrees."""
        first = ("get(ms, array_min(transform(ms, (m, i) -> "
                 "named_struct('c', -m.confidence, 's', m.start, 'i', i))).i)")
        top = "filter(ms, m -> m.confidence >= bst.confidence)"
        agreed = ("CASE WHEN size(array_distinct(transform(tp, m -> m.assertion))) = 1 AND "
                  "size(array_distinct(filter(transform(tp, m -> m.value), v -> v IS NOT NULL)))"
                  " <= 1 THEN bst END")
        chosen = let("bst", first, let("tp", top, agreed))
        return let("ms", self.mentions(text, modifier, kind, concept_id),
                   f"CASE WHEN size(ms) > 0 THEN {chosen} END")


def _table(entries: dict[str, tuple[int, str | None]]) -> str:
    """A literal map from folded phrase to its place and name; folded once at planning."""
    cells = ", ".join(
        f"{quoted(k)}, named_struct('rank', {rank}, 'name', "
        f"{'cast(null as string)' if name is None else quoted(name)})"
        for k, (rank, name) in entries.items())
    return f"map({cells})"


def _concat(arrays) -> str:
    return "flatten(array(" + ", ".join(arrays) + "))"


def _literal(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)
