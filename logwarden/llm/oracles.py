"""DuckDB SQL for the operators that SQL can express."""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# only A-Z are lowered
LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER.format(text="text")}, '{WORD}') as w
  from documents
), item as (
  select coalesce(cast(item_id as varchar), 'null') as item,
         regexp_extract_all({LOWER.format(text="text")}, '{WORD}') as w
  from benchmark
), wins as (
  select distinct item, k, list_slice(w, i, i + k - 1) as win
  from (
    select item, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
    from item where len(w) > 0
  )
), lengths as (select distinct k from wins
), places as (
  select r, i, k, list_slice(w, i, i + k - 1) as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, lengths where len(w) >= k)
), found as (
  select p.r, p.i, p.k, x.item from places p join wins x on p.k = x.k and p.win = x.win
), hit as (
  select r, count(distinct pos) as n_hit
  from (select r, unnest(range(i, i + k)) as pos from (select distinct r, i, k from found)) group by r
), items as (
  select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest
  from (select distinct r, item from found) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(digest, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (r) left join items using (r)
"""

OP12 = rf"""
with doc as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all({LOWER.format(text="text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), word as (select r, lang, source, unnest(w) as term from doc
), kept as (select lang, term, count(*) as lang_n from word group by lang, term having count(distinct r) >= 10
), size as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang
), cell as (select lang, source, term, count(*) as n from word join kept using (lang, term) group by all
), grp as (select distinct lang, source from doc
), total as (select lang, source, sum(n) as total from cell group by all
), share as (
  select lang, source, term, coalesce(n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p,
         1 + (1000000000::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
  from grp join kept using (lang) join size using (lang) left join total using (lang, source)
  left join cell using (lang, source, term)
), apart as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from share where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value,
       cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from found qualify part = 'pair' or rank <= 10
"""


def draws(names: list[str], weights: list[int]) -> str:
    """The draws of some nodes, as columns."""
    return ", ".join(
        f"-ln((('0x' || substr(md5('{n}:' || key), 1, 12))::bigint + 0.5) / 281474976710656.0) / {w}.0 as {n}"
        for n, w in zip(names, weights))


def first_of(names: list[str]) -> str:
    """Which of some columns is the smallest, from 0."""
    return "case " + " ".join(
        f"when {n} = least({', '.join(names)}) then {k}" for k, n in enumerate(names)) + " end"


def crc32_of(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, folded over them with the table of the reversed polynomial."""
    table = []
    for entry in range(256):
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        table.append(entry)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    step = f"xor(c >> 8, list_extract({table}::bigint[], (xor(c, x) & 255) + 1))"
    return f"xor(list_reduce([4294967295::bigint] || {octets}, lambda c, x: {step}), 4294967295::bigint)"


# eight shards in two regions of two racks; a ninth is a region of its own
OP5 = f"""
with d as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size, coalesce(text, '') as t,
         coalesce(cast(doc_id as varchar), '') as key
  from documents
), crc as (
  select doc_id, size, key, {crc32_of("t")} as text_crc32 from d
), drawn as (
  select *, {draws(["r0", "r1", "r2"], [4, 4, 1])}, {draws(["k0", "k1", "k2", "k3"], [2] * 4)},
         {draws([f"s{k}" for k in range(8)], [1] * 8)}
  from crc
), chosen as (
  select *, {first_of(["r0", "r1"])} as region, {first_of(["r0", "r1", "r2"])} as grown_region,
         {first_of(["k0", "k1"])} as low_rack, {first_of(["k2", "k3"])} as high_rack,
         {first_of(["s0", "s1"])} as a, {first_of(["s2", "s3"])} as b, {first_of(["s4", "s5"])} as c,
         {first_of(["s6", "s7"])} as e
  from drawn
), placed as (
  select doc_id, size, text_crc32, grown_region,
         case when region = 0 then case low_rack when 0 then a else 2 + b end
              else case high_rack when 0 then 4 + c else 6 + e end end as shard,
         case when low_rack = 0 then a else 2 + b end as in_first,
         case when high_rack = 0 then 4 + c else 6 + e end as in_second,
         substr(md5(concat_ws(':', key, text_crc32, size)), 1, 3) as part
  from chosen
)
select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by part, doc_id nulls first, text_crc32, size) - 1 as slot,
       cast(case grown_region when 0 then in_first when 1 then in_second else 8 end as integer) as grown_shard
from placed
"""

SPACED = r"[\x20\x09-\x0D]+"

OP8 = rf"""
with doc as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), wins as (
  select r, i, x[1] || ' ' || x[2] || ' ' || x[3] as win
  from (select r, unnest(list_zip(w, w[2:], w[3:])) as x, unnest(range(1, len(w) + 1)) as i from doc)
  where x[3] is not null
), again as (select r, win from wins group by r, win having count(*) > 1
), hit as (
  select r, count(distinct pos) as n
  from (select r, unnest(range(i, i + 3)) as pos from wins join again using (r, win)) group by r
), lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(t, chr(10))) as line from doc)
  where regexp_replace(line, '{SPACED}', '', 'g') <> '' group by r
), m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '{SPACED}', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from doc left join hit using (r) left join lines using (r)
), rules as (
  select *, n_words < 50 as few, 100 * n_repeat_words > 50 * n_words as repeated,
         word_chars / greatest(n_words, 1) < 3.0 as short, word_chars / greatest(n_words, 1) > 16.0 as long,
         n_symbols / greatest(n_words, 1) > 0.2 as symbols, n_dup_lines > 0.4::double * n_lines as again,
         n_words > 100000 as huge
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       few::bigint + 2 * repeated::bigint + 4 * short::bigint + 8 * long::bigint + 16 * symbols::bigint
         + 32 * again::bigint + 64 * huge::bigint as failed,
       few or repeated as base_failed,
       not (few or repeated or short or long or symbols or again) as kept
from rules
"""
