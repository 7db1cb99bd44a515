"""The SQL of those named queries that DuckDB can express."""

from __future__ import annotations

_MASKS = ((0, 1, 2, 3, 5, 9, 10), (0, 3, 4, 7, 8, 9, 10), (0, 1, 5, 6, 7, 8, 10))


def _decontamination() -> str:
    words = "[x for x in string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> '']"

    def spots(source: str, name: str) -> str:
        masks = " union all ".join(
            f"select {name}, w, p, '{number}' || "
            + " || ".join(f"' ' || w[p + {place}]" for place in mask)
            + f" as key from {source}_at"
            for number, mask in enumerate(_MASKS)
        )
        return (
            f"{source}_at as (select {name}, w, unnest(range(1, len(w) - 9)) as p from {source}), "
            f"{source}_key as ({masks})"
        )

    stretches = ", ".join(
        "case when i + {o} >= 1 and i + {o} + 14 <= len(iw) then ".format(o=o)
        + " + ".join(
            f"coalesce((p + {o + j} >= 1 and dw[p + {o + j}] = iw[i + {o + j}])::int, 0)"
            for j in range(15)
        )
        + " end"
        for o in range(-4, 1)
    )
    short = " + ".join(
        f"coalesce((i + {j} >= 1 and p + {j} >= 1 and dw[p + {j}] = iw[i + {j}])::int, 0)"
        for j in range(-4, 15)
    )
    return f"""
with docs as (select doc_id, {words} as w from documents),
items as (select min(item_id) as item_id, w from (select item_id, {words} as w from benchmark) group by w),
{spots("docs", "doc_id")}, {spots("items", "item_id")},
hits as (
  select d.doc_id, b.item_id, d.w as dw, b.w as iw, d.p, b.p as i
  from docs_key d join items_key b using (key)
),
scored as (
  select doc_id, item_id, len(iw) as size,
    case when len(iw) < 15 then {short} else greatest({stretches}) end as matched
  from hits
)
select doc_id, item_id, max(matched) as matched from scored
where matched >= ceil(least(size, 15) * 12 / 15.0) group by doc_id, item_id
"""


_WARC = """
with p as (
  select page_id, encode(coalesce(html, '')) as body, sha256(coalesce(html, '')) as digest from pages
),
f as (
  select *, octet_length(body) as n,
    case when octet_length(body) >= 100 then min(page_id) over (partition by digest) end as first
  from p
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from f
"""

_CHAT = r"""
with recursive said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
  )
),
numbered as (
  select conv_id, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as tokens,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as no,
    14 + 2 * length(text) - length(regexp_replace(text, '[\\<#]', '', 'g'))
      + 2 * length(role) - length(regexp_replace(role, '[\\<#:\n]', '', 'g')) as chars
  from said
),
turns as (
  select *, sum(tokens) over (partition by conv_id order by no) - tokens as before from numbered
),
system as (
  select conv_id, tokens as sys_tokens, chars as sys_chars from turns
  where no = 0 and role = 'system'
),
rooms as (
  select t.*, greatest(1024 - 128 - coalesce(sys_tokens, 0), 1) as room,
    sys_chars, (sys_chars is not null)::int as has_system
  from turns t left join system s on s.conv_id is not distinct from t.conv_id
),
chosen as (
  select conv_id, no, tokens as used, true as starts from rooms where no = 0
  union all
  select r.conv_id, r.no,
    case when c.used + r.tokens > r.room or r.no % 512 = 0 then r.tokens
      else c.used + r.tokens end,
    c.used + r.tokens > r.room or r.no % 512 = 0
  from chosen c join rooms r on r.conv_id is not distinct from c.conv_id and r.no = c.no + 1
),
starts as (
  select r.* from chosen c join rooms r
    on r.conv_id is not distinct from c.conv_id and r.no = c.no
  where c.starts and c.no > 0
),
repeated as (
  select s.conv_id, sum(t.chars) as chars
  from starts s join turns t on t.conv_id is not distinct from s.conv_id
    and t.no >= greatest(s.no - 4, s.has_system) and t.no < s.no and s.before - t.before <= 128
  group by s.conv_id
),
again as (select conv_id, sum(coalesce(sys_chars, 0)) as chars from starts group by conv_id)
select n.conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by no)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by no) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(n.chars) + coalesce(any_value(r.chars), 0) + coalesce(any_value(a.chars), 0))::bigint
    as formatted_chars
from numbered n
left join repeated r on r.conv_id is not distinct from n.conv_id
left join again a on a.conv_id is not distinct from n.conv_id
group by n.conv_id
"""

_SUBSTRINGS = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
),
starts as (select r, w, unnest(range(1, len(w) - 33)) as i from d),
spans as (select r, i, array_to_string(w[i : i + 34], ' ') as span from starts),
repeated as (select span from spans group by span having count(*) > 1),
gone as (
  select distinct r, unnest(range(i, i + 35)) as i from spans join repeated using (span)
),
places as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
kept as (
  select p.r, string_agg(word, ' ' order by p.i) as text, count(*) as n
  from places p anti join gone g on g.r = p.r and g.i = p.i group by p.r
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)
"""

_NOTICES = (
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "this project is licensed under the apache license 2 0"),
    ("BSD-2-Clause", "released under the bsd 2 clause license"),
    ("BSD-3-Clause", "released under the bsd 3 clause license"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC0-1.0", "released under cc0 1 0"),
    ("GPL-2.0-only", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0-only", "this work is licensed under the gnu general public license version 3"),
    ("ISC", "released under the isc license"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MPL-2.0", "licensed under the mozilla public license version 2 0"),
)
_TEXT_DIGESTS = (
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("BSD-2-Clause", "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3-only", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0-only", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("ISC", "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("LGPL-2.0-only", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1-only", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
_SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("sub  license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("copyright  owner", "copyright  holder"),
    ("v2", "version  2"),
    ("v3", "version  3"),
)


def _licenses() -> str:
    bare = (
        r"regexp_replace(unit, '(?im)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$', ' ', 'g')"
    )
    form = (
        rf"' ' || array_to_string([x for x in string_split_regex(lower({bare}), '[^\p{{L}}\p{{N}}]+') "
        "if x <> ''], '  ') || ' '"
    )
    for spelling, meant in _SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {meant} ')"
    known = ", ".join(
        [f"('{name}', sha256('{text}'))" for name, text in _NOTICES]
        + [f"('{name}', '{digest}')" for name, digest in _TEXT_DIGESTS]
    )
    return rf"""
with docs as (select doc_id, replace(coalesce(text, ''), chr(13), '') as text from documents),
units as (
  select doc_id, true as whole, text as unit from docs
  union all
  select doc_id, false, unnest(string_split(text, chr(10))) from docs where contains(text, chr(10))
  union all
  select doc_id, false, p from (
    select doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) as p from docs
    where regexp_matches(text, '\n[ \t]*\n')
  ) where regexp_matches(p, '\S[^\n]*\n\s*\S')
),
forms as (select doc_id, whole, trim(replace({form}, '  ', ' ')) as form from units),
known(license_id, digest) as (values {known})
select doc_id, license_id, bool_or(whole) as whole, count(*) as units
from forms join known on sha256(form) = digest group by doc_id, license_id
"""


ORACLES: dict[str, str] = {
    "op6_decontamination": _decontamination(),
    "op7_warc": _WARC,
    "op8_chat": _CHAT,
    "op9_substrings": _SUBSTRINGS,
    "op10_licenses": _licenses(),
}
