"""Plain SQL restatements of the training-data queries that SQL can express.

They compare plainly where the operators are indirect: every block with every template,
every order of the filters, every node of a tree, every window, every pair of texts.
"""

from __future__ import annotations

from .license_join import PHRASES, TEMPLATES, THRESHOLD, Templates, word_list

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _license_join() -> str:
    templates = ", ".join(
        f"({n}, '{label}', {block}, {_quoted(held)}, {required})"
        for n, (label, block, held, required) in enumerate(Templates(TEMPLATES, THRESHOLD).sets))
    phrases = ", ".join(f"('{label}', {_quoted(word_list(p))})" for p, label in PHRASES.items())
    return f"""
    with docs as (select row_number() over () as row, doc_id, {_FOLDED} as held from documents),
    phrases(label, wanted) as (values {phrases}),
    templates(number, label, size, wanted, required) as (values {templates}),
    places as (
        select row, label, unnest(list_filter(range(len(held)), lambda i: held[i + 1:i + len(wanted)] = wanted)) as place
        from docs, phrases),
    base as (
        select row, count(*) as n_base, min(place) as first_word, max(place) as last_word,
               list_sort(list_distinct(list(label))) as labels
        from places group by row),
    blocks as (
        select row, size, list_distinct(held[b * size + 1:b * size + 2 * size]) as own
        from (select row, size, held, unnest(range(0, (len(held) + size - 1) // size)) as b
              from docs, (select distinct size from templates))),
    matched as (
        select row, list_distinct(list(label)) as labels, max(shared / len(wanted)) as part
        from (select row, label, wanted, required, len(list_intersect(wanted, own)) as shared
              from blocks join templates using (size) where len(own) >= required)
        where shared >= required group by row)
    select doc_id, cast(len(held) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
           cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
           coalesce(array_to_string(base.labels, ','), '') as base_labels,
           coalesce(array_to_string(list_sort(list_distinct(
               coalesce(base.labels, []) || coalesce(matched.labels, []))), ','), '') as labels,
           case when n_base > 0 then 1.0 else coalesce(part, 0.0) end :: double as score
    from docs left join base using (row) left join matched using (row)"""


_DIAGRAMS = r"""
    with docs as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as held
        from documents),
    firsts as (select body, min(doc_id) as first_id from docs group by body),
    marks as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic
              from labels where doc_id is not null group by doc_id),
    fails as (
        select row_number() over () as row, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
               map {
                   'A': len(held) < 200,
                   'B': 100 * len(list_distinct(held)) < 50 * len(held),
                   'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
                   'D': regexp_matches(body, '[#$%&*|]'),
                   'E': coalesce(first_id < doc_id, false)} as fail
        from docs join firsts using (body) left join marks using (doc_id)),
    letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    orders as (
        select a.l || b.l || c.l || d.l || e.l as filter_order
        from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    counted as (
        select part, fail, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by all),
    met as (
        select part, filter_order, step, n, good, toxic, fail[filter_order[step]] as failing,
               len(list_filter(range(1, step), lambda i: fail[filter_order[i]])) > 0 as gone,
               len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: fail[l])) = 1 as alone
        from counted, orders, (select unnest(range(1, 6)) as step)),
    steps as (
        select part, filter_order, cast(step as int) as step,
               cast(coalesce(sum(n) filter (not gone and not failing), 0) as bigint) as kept,
               cast(coalesce(sum(n) filter (not gone and failing), 0) as bigint) as removed,
               cast(coalesce(sum(n) filter (gone and failing), 0) as bigint) as redundant,
               cast(coalesce(sum(n) filter (alone and failing), 0) as bigint) as unique_fails,
               cast(coalesce(sum(good) filter (not gone and failing), 0) as bigint) as good_lost,
               cast(coalesce(sum(toxic) filter (not gone and failing), 0) as bigint) as toxic_lost
        from met group by part, filter_order, step)
    select *, cast(sum(removed) over (partition by part, filter_order[step]) as bigint) as shapley from steps"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name} :: varchar) || ':' || {name} :: varchar, '-')"


def _tree(out: str, leaves: str) -> str:
    """Nodes of every level of the trees over ``leaves`` (grp, place, digest)."""
    return f"""
    {out} as (
        select 0 as level, grp, place, count(*) over (partition by grp) as n, digest from {leaves}
        union all
        select level + 1, grp, place // 2, (min(n) + 1) // 2, sha256(string_agg(digest, '' order by place))
        from {out} where n > 1 group by level, grp, place // 2)"""


def _followed(out: str, leaves: str, tree: str) -> str:
    """Every row of ``leaves`` (row, grp, place, n, digest) led up its tree, with the siblings' digests."""
    return f"""
    {out} as (
        select 0 as level, row, grp, place, n, digest, '' as proof from {leaves}
        union all
        select f.level + 1, f.row, f.grp, f.place // 2, (f.n + 1) // 2,
               sha256(case when f.place % 2 = 1 then s.digest || f.digest else f.digest || coalesce(s.digest, '') end),
               f.proof || coalesce(s.digest, '')
        from {out} f left join {tree} s on s.grp = f.grp and s.level = f.level and s.place = xor(f.place, 1)
        where f.n > 1)"""


def _crc32(text: str) -> str:
    """The checksum of a short text: its bytes enter one by one, each followed by eight steps."""
    steps = (f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: "
             f"[ord({text}[i]) :: bigint, -1, -1, -1, -1, -1, -1, -1, -1]))")
    return (f"xor(list_reduce([4294967295 :: bigint] || {steps}, lambda c, b: case when b >= 0 then xor(c, b) "
            "when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295)")


_MERKLE = f"""
    with recursive docs as (
        select row_number() over () as row, doc_id, coalesce('+' || lang, '-') as grp,
               {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))} as plain,
               {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))} as other,
               coalesce({_crc32("(doc_id :: varchar)")} % 7 = 0, false) as changed
        from documents),
    leaves as (
        select row, doc_id, grp, sha256(plain) as digest, sha256(case when changed then other else plain end) as read,
               row_number() over (partition by grp order by doc_id nulls first, sha256(plain)) - 1 as place,
               count(*) over (partition by grp) as n
        from docs),
    {_tree("nodes", "leaves")},
    ordered as (
        select grp as own, digest, 'all' as grp, row_number() over (order by grp = '-' desc, encode(grp)) - 1 as place,
               count(*) over () as n
        from nodes where n = 1),
    {_tree("crown", "ordered")},
    {_followed("inside", "(select row, grp, place, n, read as digest from leaves)", "nodes")},
    {_followed("above", """(select i.row, o.grp, o.place, o.n, i.digest from inside i
        join ordered o on o.own = i.grp where i.n = 1)""", "crown")}
    select l.doc_id, l.digest as leaf, o.digest as subroot, r.digest as root,
           sha256(i.proof || a.proof) as proof_sha256, a.digest as folded_root, a.digest = r.digest as verified
    from leaves l join ordered o on o.own = l.grp join (select digest from crown where n = 1) r on true
    join inside i on i.row = l.row and i.n = 1 join above a on a.row = l.row and a.n = 1"""

_BLANK = r"\x20\x09-\x0D"
_REPETITION = rf"""
    with recursive docs as (
        select row_number() over () as row, doc_id, coalesce(text, '') as body,
               regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') as held
        from documents),
    words as (select row, unnest(held) as word, unnest(range(len(held))) as place from docs),
    -- places whose next l words stand elsewhere too; cls tells equal runs apart
    runs as (
        select row, 1 as l, cls, place
        from (select row, place, min(place) over w as cls, count(*) over w as n from words
              window w as (partition by row, word))
        where n > 1
        union all
        select row, l + 1, cls, place
        from (select r.row, r.l, r.place, min(r.place) over w as cls, count(*) over w as n
              from runs r join words x on x.row = r.row and x.place = r.place + r.l
              window w as (partition by r.row, r.cls, x.word))
        where n > 1),
    longest as (select row, max(l) as longest from runs group by row),
    covered as (
        select row, l, count(distinct p) as n
        from (select row, l, unnest(range(place, place + l)) as p from runs where l in (3, 10)) group by row, l),
    lines as (select row, unnest(string_split(body, chr(10))) as line from docs),
    repeated as (
        select row, count(*) - count(distinct line) as n from lines
        where regexp_matches(line, '[^{_BLANK}]') group by row),
    counted as (
        select docs.row, doc_id, cast(len(held) as bigint) as n_words,
               cast(length(array_to_string(held, '')) as bigint) as word_chars,
               cast(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
               cast(coalesce(repeated.n, 0) as bigint) as n_dup_lines,
               cast(coalesce(three.n, 0) as bigint) as n_repeat_words,
               cast(coalesce(ten.n, 0) as bigint) as n_covered_words,
               cast(coalesce(longest.longest, 0) as bigint) as longest_repeat
        from docs left join repeated using (row) left join longest using (row)
        left join covered three on three.row = docs.row and three.l = 3
        left join covered ten on ten.row = docs.row and ten.l = 10)
    select * exclude (row), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
           not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_covered_words <= 0.3 :: double * n_words
           and longest_repeat <= greatest(60, 0.25 :: double * n_words) as kept
    from counted"""

_WU_MANBER = f"""
    with docs as (select row_number() over () as row, doc_id, {_FOLDED} as held from documents),
    items as (select item_id :: varchar as item, {_FOLDED} as held from benchmark),
    wanted as (
        select distinct item, least(len(held), 10) as size,
               array_to_string(held[i + 1:i + 10], ' ') as run
        from (select *, unnest(range(greatest(1, len(held) - 9))) as i from items where len(held) > 0)),
    found as (
        select row, place, size, item
        from (select row, place, size, array_to_string(held[place + 1:place + size], ' ') as run
              from (select row, held, size, unnest(range(len(held) - size + 1)) as place
                    from docs, (select distinct size from wanted) where len(held) >= size))
        join wanted using (size, run)),
    hit as (
        select row, count(distinct word) as n
        from (select row, unnest(range(place, place + size)) as word from found) group by row),
    named as (select row, list_sort(list(distinct item)) as items from found where item is not null group by row)
    select doc_id, cast(len(held) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_hit,
           cast(coalesce(len(items), 0) as bigint) as n_items,
           sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
    from docs left join hit using (row) left join named using (row)"""

_LINES = """
    with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    held as (
        select row, doc_id, i, line,
               translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from (select row, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from docs)),
    common as (
        select key, max(doc_id) as last_id from held where length(key) >= 20
        group by key having count(distinct doc_id) + max(cast(doc_id is null as int)) >= 3),
    judged as (
        select row, held.doc_id, i, line, common.key is not null and held.doc_id is distinct from last_id as lost
        from held left join common using (key))
    select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
    from judged group by row, doc_id"""

_NEAR = rf"""
    with recursive docs as (
        select row_number() over () as row, doc_id, regexp_extract_all({_LOWER}, '[^{_BLANK}]+') as held from documents),
    sets as (
        select row, doc_id, case when len(held) = 0 then [] else list_sort(list_distinct(list_transform(
            range(greatest(1, len(held) - 4)), lambda i: array_to_string(held[i + 1:i + 5], ' ')))) end as own
        from docs),
    -- texts with one set are one class
    classes as (select own, min(doc_id) as least_id, min(row) as cls, len(own) as n from sets group by own),
    members as (select cls, n, unnest(own) as shingle from classes),
    links as (
        select a.cls as one, b.cls as other
        from members a join members b on a.shingle = b.shingle and a.cls <> b.cls
        group by a.cls, b.cls, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach(one, other) as (
        select cls, cls from classes union select reach.one, links.other from reach join links on links.one = reach.other),
    least as (select reach.one as cls, min(least_id) as component_id from reach join classes on cls = reach.other group by reach.one),
    judged as (
        select doc_id, cast(n as bigint) as n_shingles, case when n = 0 then doc_id else component_id end as component_id
        from sets join classes using (own) join least using (cls))
    select *, doc_id = component_id as kept from judged"""

ORACLE: dict[str, str] = {
    "op2_suffix_repetition": _REPETITION,
    "op6_wu_manber": _WU_MANBER,
    "op8_line_runs": _LINES,
    "op10_bbit_minhash": _NEAR,
    "op11_license_join": _license_join(),
    "op12_filter_diagrams": _DIAGRAMS,
    "op13_merkle_witness": _MERKLE,
}
