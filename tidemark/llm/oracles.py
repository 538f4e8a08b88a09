"""DuckDB SQL for the queries that SQL can express."""

from . import licenses, mixing, rules, spelling
from .decontaminate import WINDOW


def quality_rules() -> str:
    """rules.judge() with its defaults: the same counts, sketches and fences."""
    stats = rules.STATISTICS
    value = {k: e.replace(" div ", " // ") for k, (e, _) in stats.items()}
    pairs = " union all ".join(f"select lang, source, '{k}' as stat, {e} as v from s where n_words > 0 and word_chars > 0 and n_lines > 0" for k, e in value.items())
    high = lambda k: f"max(q3 + {rules.REACH} * width) filter (where stat = '{k}')"
    low = lambda k: f"max(q1 - {rules.REACH} * width) filter (where stat = '{k}')"
    inside = " and ".join(f"({e} = 0 or ({e} <= {high(k)}" + (f" and {e} >= {low(k)}" if stats[k][1] else "") + "))" for k, e in value.items())
    return f"""
    with d as (select row_number() over () as row, doc_id, lang, source, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
    word as (select row, unnest(words) as x, generate_subscripts(words, 1) as i from w),
    gram as (select row, i, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as g from word window o as (partition by row order by i)),
    twice as (select row, i from gram where g is not null qualify count(*) over (partition by row, g) > 1),
    rep as (select row, count(distinct i + k) as n from twice, (select unnest(range(5)) as k) group by row),
    s as (select w.row, doc_id, lang, source, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
          (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals from w left join rep on rep.row = w.row),
    p as ({pairs}),
    b as (select lang, source, stat, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as bucket, count(*) as n from p where v > 0 group by all),
    c as (select *, sum(n) over (partition by lang, source, stat order by bucket) as seen, sum(n) over (partition by lang, source, stat) as total from b),
    q as (select lang, source, stat, min(bucket) filter (where seen * 4 >= total) as q1, min(bucket) filter (where seen * 4 >= total * 3) as q3 from c group by 1, 2, 3),
    f as (select *, greatest(q3 - q1, q3 // 16 + 1) as width from q),
    j as (select s.row, coalesce(case when any_value(n_words) > 0 and any_value(word_chars) > 0 and any_value(n_lines) > 0 then {inside} end, false) as good
          from s left join f on s.lang is not distinct from f.lang and s.source is not distinct from f.source group by s.row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
           (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and good) as kept from s join j using (row)"""


def contamination() -> str:
    """decontaminate.contamination() and decisions() with their defaults."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{licenses._UPPER}', '{licenses._LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with i as (select item_id, {words('text')} as w from benchmark),
    win as (select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(list_slice(w, k, k + least(len(w), {WINDOW}) - 1), ' ') as g
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as k from i where len(w) > 0)),
    d as (select row_number() over () as row, doc_id, {words('text')} as w from documents),
    spot as (select row, w, k from d, unnest(range(1, len(w) + 1)) u(k)),
    gram as materialized (select row, k, z.n, array_to_string(list_slice(w, k, k + z.n - 1), ' ') as g from spot, (select distinct n from win) z where k + z.n - 1 <= len(w)),
    hit as (select row, k, n, item_id from gram join win using (n, g)),
    h as (select row, count(distinct x) as n_hit from (select row, unnest(range(k, k + n)) as x from hit) group by row),
    t as (select row, list_sort(list(distinct item_id::varchar)) as items from hit group by row)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (row) left join t using (row)"""


def crc32(text: str) -> str:
    """The CRC-32 of a text of code points below 2048, by a table ``crc`` with one list ``t`` of 256 values."""
    points = f"list_transform(string_split({text}, ''), lambda c: ord(c))"
    octets = f"flatten(list_transform({points}, lambda o: case when o < 128 then [o] else [192 + (o >> 6), 128 + (o & 63)] end))"
    return f"xor(list_reduce(list_transform({octets}, lambda b: b::bigint), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda h, k: case when h & 1 = 1 then xor(h >> 1, 3988292384) else h >> 1 end, i)) as t)"


def conversations() -> str:
    """conversations.damaged_report(): costs and audits as one text, so that the least text is the cheapest, ties by letters."""
    add = lambda v, c, letters: f"lpad((left({v}, 9)::bigint + {c})::varchar, 9, '0') || substr({v}, 10) || {letters}"
    inserted = f"least(u, {add('e', 2, "'I'")}, {add('s', 2, "'I'")}, {add('a', 2, "'I'")}) as iu, least(a, {add('u', 2, "'I'")}, {add('e', 4, "'II'")}, {add('s', 4, "'II'")}) as ia"
    deleted = lambda v: add(v, "3 * n", "repeat('D', n)")
    stay = lambda v, role: f"case when not forced then {add(v, f'case when first = {chr(39)}{role}{chr(39)} then 0 else 2 end + cut', f'case when first = {chr(39)}{role}{chr(39)} then {chr(39)}K{chr(39)} else {chr(39)}R{chr(39)} end')} end"
    system = f"case when not forced and first = 's' then {add('e', 'cut', "'K'")} end"
    return f"""
    with recursive {CRC_TABLE},
    c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc),
    d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                 unnest(range(case when kind = 3 then 2 else 1 end)) as copy from c where kind != 0),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as final from d),
    f as (select *, left(role, 1) as first, lag(left(role, 1)) over (partition by conv_id order by i) as before,
                 case when final = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
    r as (select *, fault in ('blank', 'duplicate') as forced, (fault = 'truncated')::int as cut, 1 as n from f),
    walk as (
        select conv_id, 0::bigint as i, '000000000' as e, null::varchar as s, null::varchar as u, null::varchar as a from (select distinct conv_id from conversations)
        union all
        select w.conv_id, r.i, {deleted('e')}, least({deleted('s')}, {system}), least({deleted('iu')}, {stay('least(e, s, ia)', 'u')}), least({deleted('ia')}, {stay('iu', 'a')})
        from (select *, {inserted} from walk) w join r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1),
    best as (select conv_id, least(e, a, {add('u', 2, "'I'")}, {add('s', 4, "'II'")}) as v from walk qualify row_number() over (partition by conv_id order by i desc) = 1),
    l as (select conv_id, unnest(string_split(substr(v, 10), '')) as letter, generate_subscripts(string_split(substr(v, 10), ''), 1) as k from best where length(v) > 9),
    p as (select *, count(*) filter (where letter != 'I') over w as i, count(*) filter (where letter != 'D') over w as j from l window w as (partition by conv_id order by k rows unbounded preceding)),
    m as (select p.*, r.role, r.text, max((p.j = 1 and letter = 'K' and first = 's')::int) over (partition by p.conv_id) as sys from p left join r on r.conv_id is not distinct from p.conv_id and r.i = p.i),
    t as (select conv_id, string_agg(case when letter = 'K' then role when (j - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by k) as kept from m where letter != 'D' group by conv_id),
    n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
                 count(*) filter (where before || first not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
    select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, left(v, 9)::bigint as cost, substr(v, 10) as audit, sha256(coalesce(kept, '')) as repaired_sha256
    from best b left join n on n.conv_id is not distinct from b.conv_id left join t on t.conv_id is not distinct from b.conv_id"""


def spelling_variants() -> str:
    """spelling.variants(): near words share what is left without one code point."""
    least, word = spelling.LEAST_LENGTH, f"[{spelling.LETTERS}]+"
    return f"""
    with recursive {CRC_TABLE},
    x as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses._UPPER}', '{licenses._LOWER}'), '{word}')) as w from documents),
    h as (select w, {crc32("coalesce(doc_id::varchar, '') || ':' || w")} as h from x, crc where length(w) >= {least}),
    y as (select case when h % {spelling.DAMAGED} = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word from h),
    v as materialized (select word, count(*) as n from y where length(word) >= {least} group by word having count(*) >= {spelling.LEAST_COUNT}),
    d as materialized (select word, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from v)),
    near as materialized (select a.word as a, b.word as b from d a join d b on a.rest = b.rest and a.i = b.i where a.word != b.word
             union select word, rest from d where rest in (select word from v) union select rest, word from d where rest in (select word from v)),
    s as materialized (select a.word, a.n, count(b.word) as n_near, min((-b.n, b.word)) as best from v a left join near on near.a = a.word left join v b on b.word = near.b group by a.word, a.n),
    f as materialized (select word, n, n_near, case when -best[1] >= {spelling.TIMES} * n then best[2] end as form, case when -best[1] >= {spelling.TIMES} * n then -best[1] end as form_n from s),
    walk as (select word, word as root from f union all select walk.word, f.form from walk join f on f.word = walk.root where f.form is not null),
    ends as (select walk.word, root from walk join f on f.word = walk.root where f.form is null)
    select f.word, form, root, n, n_near, form_n from f join ends on ends.word = f.word"""


def mixing_plan() -> str:
    """mixing.mixed() with its defaults: sources in order of what they have a weight, of which a prefix is cut."""
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return f"""
    with d as (select doc_id, source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
    s as (select source, sum(size)::bigint as source_size, {weights}[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int] as weight from d group by source),
    k as (select *, {mixing.REPEATS} * source_size as cap, row_number() over (order by {mixing.REPEATS} * source_size / weight::double, source) as r from s),
    c as (select *, coalesce(sum(cap) over b, 0) as cut, coalesce(sum(weight) over b, 0) as gone, sum(source_size) over () as total, sum(weight) over () as whole from k window b as (order by r rows between unbounded preceding and 1 preceding)),
    z as (select coalesce(min(r), (select count(*) + 1 from c)) as r from c where cap > weight::double * (total - cut)::double / (whole - gone)::double),
    t as (select c.source, source_size, case when c.r < z.r then cap::double else weight::double * (select (total - cut)::double from c, z where c.r = z.r) / (select (whole - gone)::double from c, z where c.r = z.r) end as target from c, z),
    j as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate, ('0x' || left(md5('{mixing.SEED}:' || key), 13))::bigint / {float(1 << 52)} as draw from d join t on d.source is not distinct from t.source),
    e as (select *, floor(rate)::bigint + (draw < rate - floor(rate))::bigint as copies from j)
    select doc_id, size, source_size, target, copies, copies * size as taken from e"""


ORACLES: dict[str, str] = {"op8_licenses": licenses.oracle(), "op9_quality_rules": quality_rules(), "op10_decontaminate": contamination(), "op11_conversations": conversations(), "op12_spelling": spelling_variants(), "op13_mixing": mixing_plan()}
