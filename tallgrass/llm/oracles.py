"""DuckDB SQL for the operators that SQL can express.

The others are tested against plain versions in tests/llm: zstandard novelty,
pseudorandom mixing, rendering, tries, byte removal, language models and the
pipeline have no SQL form.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""with recursive d as (select doc_id, regexp_extract_all({_ASCII}, '{_WORD}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 85 * (x.n + y.n - k)),
u as (select a, b from e union select b, a from e),
r(a, b) as (select a, b from u union select r.a, u.b from r join u on u.a = r.b),
c as (select a, least(a, min(b)) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""

OP6 = rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from documents),
g as (select doc_id, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) as g, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8),
t as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
c as (select doc_id, count(distinct i + j) as n from t, range(0, 8) x(j) group by 1),
m as (select d.doc_id, text, w, l, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words, length(regexp_replace(text, '\P{{L}}+', '', 'g')) as letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) as capitals
  from d left join c on c.doc_id = d.doc_id),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
  or (n_dup_lines >= 3 and 100 * n_dup_lines > 40 * len(l)) or (letters >= 40 and 10 * capitals > 5 * letters)
  or 2 * letters < word_chars or (n_words < 400 and 10 * len(list_distinct(w)) < n_words)) as kept from f"""

OP10 = f"""with i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') as w from benchmark),
x as (select distinct item_id, least(5, len(w)) as k, unnest([array_to_string(w[j:j + least(5, len(w)) - 1], ' ') for j in range(1, len(w) - least(5, len(w)) + 2)]) as g from i where len(w) > 0),
n as (select item_id, count(*) as n_item from x group by 1),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') as w from documents),
s as (select distinct doc_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) as g from d, (select distinct k from x) where len(w) >= k),
m as (select s.doc_id, x.item_id, count(*) as n_shared from s join x on x.k = s.k and x.g = s.g group by 1, 2)
select doc_id, cast(item_id as bigint) as item_id, n_shared, n_item, n_shared / n_item as containment from m join n using (item_id) where 10 * n_shared >= 8 * n_item"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_AT = f"cast(substr({_DIGITS}, length({_DIGITS}) - cast(j as integer), 1) as integer)"
_LUHN = f"""list_sum(list_transform(range(0, length({_DIGITS})), lambda j: case when j % 2 = 0 then {_AT} when {_AT} > 4 then 2 * {_AT} - 9 else 2 * {_AT} end)) % 10 = 0"""
_BARE = "replace(v, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split(concat(substr({_BARE}, 5), substr({_BARE}, 1, 4)), ''),
  lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
  lambda x, c: case when c < 10 then (x * 10 + c) % 97 else (x * 100 + c) % 97 end) = 1"""
#: (kind, pattern, test, score, context); the last two have \b for lookaround.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.8, "mail|contact|write to|reply"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda y: cast(y as hugeint) > 255)) = 0",
     0.6, r"\bip\b|address|host|server|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.7, "card|visa|master|credit|debit|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.6, r"phone|call|tel\b|mobile|fax|contact"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97, 0.7, "iban|account|bank|transfer"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "not regexp_matches(v, '^(?:000|666|9..)-|-00-|-0000$')", 0.3, "ssn|social security"),
)


def _matches(k: int) -> str:
    """Matches of a kind with their offsets: the text is cut at a mark put
    around each match, which the texts don't hold, and lengths are added up."""
    _, pattern, test, score, context = _KINDS[k]
    return f"""select doc_id, {k} as k, v, a, {score} + case when regexp_matches(substr(text, greatest(a - 40, 0) + 1, least(a, 40)), '(?i){context}') then 0.2 else 0 end as score
 from (select doc_id, text, p[i] as v, cast(coalesce(list_sum([length(y) for y in p[1:i - 1]]), 0) as bigint) as a from (select doc_id, text,
 string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) as p from d) z, lateral unnest(range(2, len(p) + 1, 2)) as t(i)) y where {test}"""


_NAMES = "[" + ", ".join(f"'{x[0]}'" for x in _KINDS) + "]"
_SPAN = f"concat({_NAMES}[k + 1], ':', a, ':', a + length(v))"
OP9 = f"""with d as (select doc_id, coalesce(text, '') as text from documents), f0 as ({" union all ".join(map(_matches, range(len(_KINDS))))}),
f as (select * from f0 where k < 4 or score >= 0.5),
g as (select doc_id, {", ".join(f"count(*) filter (k = {k}) as n_{x[0]}" for k, x in enumerate(_KINDS))},
  string_agg({_SPAN}, ',' order by a, k) filter (k < 4) as base, string_agg({_SPAN}, ',' order by a, k, a + length(v)) as spans, max(score) as top_score from f group by 1)
select d.doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) as n_{x[0]}" for x in _KINDS)}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, cast(top_score as double) as top_score from d left join g on g.doc_id = d.doc_id"""

ORACLES = {
    "op1_minhash_near_dedup": OP1,
    "op6_quality_rules": OP6,
    "op9_pii": OP9,
    "op10_benchmark_decontamination": OP10,
}
