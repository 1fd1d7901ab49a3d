"""The same results in DuckDB SQL, written from the definitions."""

from __future__ import annotations

from checks.queries import CLASSES, ONE_FEATURE_LAMBDA, VECTOR_SIZE
from termlens.functions import stems
from termlens.functions.stopwords import ENGLISH
from termlens.operators import models

_STOP_LIST = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH)


def _clean(value: str) -> str:
    return (
        f"regexp_replace(regexp_replace({value}, '[0-9]+', '#', 'g'), '[^a-zA-Z# ]', '', 'g')"
    )


def _split(value: str) -> str:
    body = rf"regexp_replace(lower({value}), '\s+$', '')"
    return (
        f"case when {value} is null then []::varchar[] when {value} = '' then ['']"
        rf" when regexp_replace({value}, '\s+$', '') = '' then []::varchar[]"
        rf" else string_split_regex({body}, '\s') end"
    )


def _without_stop_words(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: x not in ({_STOP_LIST}))"


def _tokens(value: str) -> str:
    return _without_stop_words(_split(_clean(value)))


def _bigrams(tokens: str) -> str:
    return (
        f"list_transform(range(1, len({tokens})),"
        f" lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    )


def _bar(tokens: str) -> str:
    return f"array_to_string({tokens}, '|')"


# --- shared table expressions -----------------------------------------------------

_PAIRS = r"""
lines as (
  select l_orderkey, l_linenumber, min(l_partkey) as product_uid, min(l_suppkey) as term_part,
         min(l_discount) as discount
  from lineitem group by l_orderkey, l_linenumber),
spoken as (
  select conv_id, string_split_regex(string_agg(text, ' ' order by turn), '[\x20\x09-\x0D]+') as words
  from conversations group by conv_id),
keyed as (
  select *, l_orderkey * 10 + l_linenumber as id, term_part % (select max(conv_id) + 1 from conversations) as conv_id
  from lines),
pairs as (
  select id, product_uid, p.p_name || ' ' || p.p_brand as product_title,
         array_to_string(words[id * 5 % greatest(len(words) - 5, 1) + 1:id * 5 % greatest(len(words) - 5, 1) + 5], ' ')
           || ' ' || o_orderpriority as search_term,
         cast(round(1 + 20 * discount, 1) as varchar) as relevance
  from keyed join orders on o_orderkey = l_orderkey
  join spoken using (conv_id) join part p on p.p_partkey = product_uid)
"""

_ATTRIBUTES = """
attribute_rows as (
  select p_partkey as product_uid, n.name,
         case n.name when 'brand' then p_brand when 'type' then p_type
                     else cast(p_size as varchar) end as value
  from part, (values ('brand'), ('type'), ('size')) n(name))
"""


def _attribute_text(line: str) -> str:
    return (
        f"{_ATTRIBUTES}, attribute_text as (select product_uid,"
        f" coalesce(string_agg({line}, ' ' order by name, value), '') as attributes"
        " from attribute_rows group by product_uid)"
    )


_VALUE_TEXT = _attribute_text("value")
_NAME_VALUE_TEXT = _attribute_text("name || ' ' || value")

_DOCUMENT_TOKENS = f"docs as (select doc_id, {_tokens('text')} as tokens from documents)"

_PAIR_TOKENS = f"""{_PAIRS},
pair_tokens as (
  select id, product_uid, try_cast(relevance as float) as relevance,
         {_tokens('product_title')} as title_tokens, {_tokens('search_term')} as sterm_tokens
  from pairs)
"""


def _share(salt: int) -> str:
    spread = f"(((id % 1000003) * 7919 + {salt}) % 1000003)"
    return f"({spread} * {spread} + {salt}) % 1000003 % 100 < 80"


_SPLIT = f"case when {_share(45)} then 'train' else 'test' end"


def _vocabulary(source: str, key: str, where: str = "", least: int = 2, size: int = 30000) -> str:
    """``source`` has columns ``key`` and tokens."""
    return f"""
tokens_of as (select {key}, unnest(tokens) as term from {source} {where}),
totals as (
  select term, count(*) as tf, count(distinct {key}) as df from tokens_of group by term),
vocabulary as (
  select term, tf, df, cast(row_number() over (order by tf desc, term) as integer) as term_id
  from totals where df >= {least} qualify term_id <= {size})
"""


_DOCUMENT_VOCABULARY = f"{_DOCUMENT_TOKENS}, {_vocabulary('docs', 'doc_id')}"

_PAIR_VOCABULARY = f"""{_PAIR_TOKENS},
joined as (select id, title_tokens || sterm_tokens as tokens from pair_tokens),
{_vocabulary('joined', 'id', f'where {_share(45)}')}
"""

_ENCODED = f"""{_PAIR_VOCABULARY},
stacked as (
  select id, 't' as field, unnest(title_tokens) as term,
         generate_subscripts(title_tokens, 1) as pos from pair_tokens
  union all
  select id, 's', unnest(sterm_tokens), generate_subscripts(sterm_tokens, 1) from pair_tokens),
looked_up as (
  select id, field, list(term_id order by pos) as ids
  from stacked join vocabulary using (term) where term <> '' group by id, field),
encoded as (
  select p.id, product_uid, relevance,
         coalesce(t.ids, []::integer[]) as int_title_tokens,
         coalesce(s.ids, []::integer[]) as int_sterm_tokens
  from pair_tokens p
  left join looked_up t on t.id = p.id and t.field = 't'
  left join looked_up s on s.id = p.id and s.field = 's')
"""


def _buckets(source: str, size: int) -> str:
    """hashed(term, bucket): Murmur3 x86-32, seed 42, of the distinct ASCII terms of ``source``."""
    mask = "4294967295::ubigint"
    rotate15 = f"((((x << 15) & {mask}) | (x >> 17)) * 461845907::ubigint) & {mask}"
    mix = f"((((xor(h, x) << 13) & {mask}) | (xor(h, x) >> 19)) * 5 + 3864292196::ubigint) & {mask}"
    return f"""
h_terms as (
  select distinct term as t, length(term) as n,
         list_transform(range(1, length(term) + 1), lambda i: ascii(substr(term, i, 1))::ubigint) as bs
  from {source}),
h_words as (
  select t, n, list_transform(range(0, (n + 3) // 4), lambda j:
           coalesce(bs[4*j+1], 0) + coalesce(bs[4*j+2], 0) * 256
           + coalesce(bs[4*j+3], 0) * 65536 + coalesce(bs[4*j+4], 0) * 16777216) as ks
  from h_terms),
h_first as (
  select t, n, list_transform(ks, lambda x: (x::ubigint * 3432918353::ubigint) & {mask}) as ks
  from h_words),
h_mixed as (select t, n, list_transform(ks, lambda x: {rotate15}) as ks from h_first),
h_body as (
  select t, n, ks, list_reduce(list_slice(ks, 1, n // 4), lambda h, x: {mix}, 42::ubigint) as h
  from h_mixed),
h_tail as (
  select t, xor(case when n % 4 > 0 then xor(h, ks[n // 4 + 1]) else h end, n::ubigint) as h
  from h_body),
h_one as (select t, (xor(h, h >> 16) * 2246822507::ubigint) & {mask} as h from h_tail),
h_two as (select t, (xor(h, h >> 13) * 3266489909::ubigint) & {mask} as h from h_one),
h_signed as (
  select t, case when xor(h, h >> 16) >= 2147483648 then xor(h, h >> 16)::bigint - 4294967296
            else xor(h, h >> 16)::bigint end as h from h_two),
hashed as (select t as term, cast(((h % {size}) + {size}) % {size} as integer) as bucket from h_signed)
"""


_DOCUMENT_BUCKETS = f"""{_DOCUMENT_TOKENS},
tokens_of as (select doc_id, unnest(tokens) as term from docs),
{_buckets('tokens_of', 16384)},
counted as (
  select doc_id, bucket, count(*) as tf from tokens_of join hashed using (term)
  group by doc_id, bucket),
bucket_df as (select bucket, count(*) as df from counted group by bucket),
size as (select count(*) as m from documents)
"""

_JOINED_BIGRAMS = f"""{_PAIR_TOKENS}, {_VALUE_TEXT},
with_attributes as (
  select id, title_tokens || sterm_tokens || {_tokens('attributes')} as tokens
  from pair_tokens join attribute_text using (product_uid))
"""

_ONE_FEATURE = f"""{_PAIR_TOKENS},
numbered as (
  select id, cast(relevance as double) as y,
         cast(len(title_tokens) + len(sterm_tokens) as double) as x, {_SPLIT} as split
  from pair_tokens),
moments as (
  select covar_pop(x, y) as cxy, var_pop(x) as vp, var_samp(x) as vs, stddev_pop(y) as sp,
         stddev_samp(y) as ss, avg(x) as ax, avg(y) as ay
  from numbered where split = 'train'),
line as (
  select cxy / (vp * (1 + {ONE_FEATURE_LAMBDA} / sp)) as slope_normal,
         cxy / (vp + vs * {ONE_FEATURE_LAMBDA} / ss) as slope_search, ax, ay from moments),
predicted as (
  select id, split, y, ay + slope_normal * (x - ax) as p from numbered, line)
"""

_TEST_METRICS = f"""with {_ONE_FEATURE}
select count(*) as n, {{}} from predicted where split = 'test'"""

_TEXT_COLUMNS = """select id, array_to_string(int_title_tokens, '|') as int_title_tokens,
  array_to_string(int_sterm_tokens, '|') as int_sterm_tokens from """

_WORD_VECTORS = f"""{_DOCUMENT_VOCABULARY},
vectors as (
  select term, term_id, embedding as vec from embeddings join vocabulary on vec_id = term_id)
"""


def _all_joined(where: str, columns: str) -> str:
    return f"""with {_PAIRS}, {_NAME_VALUE_TEXT}
select {columns}, md5(text) as product_description, attributes
from pairs join documents on doc_id = product_uid join attribute_text using (product_uid) {where}"""


_POOLED_ENTRIES = f"""{_ENCODED},
cut as (
  select id, 'title' as field, int_title_tokens[1:15] as ids from encoded
  union all select id, 'sterm', int_sterm_tokens[1:10] from encoded),
one as (select id, field, unnest(ids) as term_id from cut),
vectors as (
  select vec_id as term_id, embedding as vec from embeddings
  where vec_id in (select term_id from vocabulary)),
entries as (
  select term_id, unnest(vec) as value, generate_subscripts(vec, 1) as pos from vectors),
lengths as (select id, field, count(*) as n from one group by id, field),
per_entry as (
  select id, field, pos, sum(value::double) as total, max(value) as top, count(*) as present
  from one join entries using (term_id) group by id, field, pos),
pooled as (
  select id, field, sum(total / n * pos) as mean_sum,
         sum((case when present < n then greatest(top, 0) else top end)::double * pos) as max_sum
  from per_entry join lengths using (id, field) group by id, field)
"""

def _stems(source: str) -> str:
    """stems(term, stem) of the distinct terms of ``source``, step by step as published."""
    marks = "regexp_replace(regexp_replace(w, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    turned = "case when m <> 'y' then m when right(done, 1) = 'c' then 'v' else 'c' end"
    shape = f"list_reduce(list_prepend('', string_split({marks}, '')), lambda done, m: done || {turned})"

    def cut(text: str, count: int) -> str:
        return f"left({text}, length({text}) - {count})"

    def measure(text: str) -> str:
        return f"(length({text}) - length(replace({text}, 'vc', ''))) // 2"

    def ends(text: str, *suffixes: str) -> str:
        return "(" + " or ".join(f"suffix({text}, '{s}')" for s in suffixes) + ")"

    def short(text: str, marks: str) -> str:
        return f"(({ends(marks, 'cvc')} and not {ends(text, 'w', 'x', 'y')}) or {marks} = 'vc')"

    def repaired(text: str, marks: str) -> str:
        return f"""case when {ends(text, 'at', 'bl', 'iz')} then {text} || 'e'
          when length({text}) > 1 and right({text}, 1) = left(right({text}, 2), 1) and {ends(marks, 'c')}
            then case when {ends(text, 'l', 's', 'z')} then {text} else {cut(text, 1)} end
          when {measure(marks)} = 1 and {short(text, marks)} then {text} || 'e' else {text} end"""

    def swap(table) -> str:
        return " ".join(
            f"when {ends('w', s)} then case when {measure(cut('s', len(s)))} > 0 then {cut('w', len(s))} || '{r}' else w end"
            for s, r in table
        )

    def past(suffix: str) -> str:
        n = len(suffix)
        return f"when {ends('w', suffix)} then case when contains({cut('s', n)}, 'v') then {repaired(cut('w', n), cut('s', n))} else w end"

    ie = f"then case when length(w) = 4 then {cut('w', 1)} else {cut('w', 2)} end"
    endings = " ".join(
        f"when {ends('w', s)}" + (f" and {ends(cut('w', 3), 's', 't')}" if s == "ion" else "")
        + f" then case when {measure(cut('s', len(s)))} > 1 then {cut('w', len(s))} else w end"
        for s in stems.ENDINGS
    )
    one_less = cut("s", 1)
    steps = [
        f"when {ends('w', 'sses')} then {cut('w', 2)} when {ends('w', 'ies')} {ie} when {ends('w', 's')} and not {ends('w', 'ss')} then {cut('w', 1)}",
        f"when {ends('w', 'ied')} {ie} when {ends('w', 'eed')} then case when {measure(cut('s', 3))} > 0 then {cut('w', 1)} else w end {past('ed')} {past('ing')}",
        f"when {ends('w', 'y')} and length(w) > 2 and left(right(s, 2), 1) = 'c' then {cut('w', 1)} || 'i'",
        f"when {ends('w', 'alli')} and {measure(cut('s', 4))} > 0 then {cut('w', 2)}",
        f"when {ends('w', 'logi')} then case when {measure(cut('s', 3))} > 0 then {cut('w', 1)} else w end {swap(stems.DERIVED)}",
        swap(stems.RELATED),
        endings,
        f"when {ends('w', 'e')} and ({measure(one_less)} > 1 or ({measure(one_less)} = 1 and not {short(cut('w', 1), one_less)})) then {cut('w', 1)}",
        f"when {ends('w', 'll')} and {measure(one_less)} > 1 then {cut('w', 1)}",
    ]
    parts = [f"step0 as (select distinct term, lower(term) as w from {source})"]
    for number, step in enumerate(steps, 1):
        parts.append(f"shape{number} as materialized (select term, w, {shape} as s from step{number - 1})")
        parts.append(f"step{number} as materialized (select term, case {step} else w end as w from shape{number})")
    irregular = " ".join(f"when lower(term) = '{w}' then '{s}'" for w, s in stems.IRREGULAR.items())
    parts.append(
        f"stems as (select term, case when length(term) <= 2 then lower(term) {irregular} else w end as stem from step{len(steps)})"
    )
    return ", ".join(parts)


_STEMMED = f"""{_DOCUMENT_TOKENS},
tokens_of as (select doc_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from docs), {_stems('tokens_of')}"""

_WEIGHT = "((index * 7919 + class * 104729) % 1009 - 504) / 10000.0"

_BIGRAM_COUNTS = f"""{_JOINED_BIGRAMS},
grams as (select id, unnest({_bigrams('tokens')}) as term from with_attributes),
{_buckets('grams', 30000)},
counted as (
  select id, bucket as index, count(*)::double as tf from grams join hashed using (term) group by id, bucket),
labelled as (
  select id, relevance::double as y, {_SPLIT} as split from with_attributes join pair_tokens using (id))
"""

_FIELD_COUNTS = f"""{_PAIR_TOKENS}, {_NAME_VALUE_TEXT},
fields as (
  select 'p' as kind, id, 0 as place, unnest(title_tokens) as term from pair_tokens
  union all select 'p', id, 1, unnest(sterm_tokens) from pair_tokens
  union all select 'd', doc_id, 2, unnest({_tokens('text')}) from documents
  union all select 'd', product_uid, 3, unnest({_tokens('attributes')}) from attribute_text),
{_buckets('fields', 16384)},
parts as (
  select kind, id, place * 16384 + bucket as index, count(*)::double as tf
  from fields join hashed using (term) group by kind, id, place, bucket),
labelled as (
  select id, product_uid, relevance::double as y, {_SPLIT} as split
  from pair_tokens join documents on doc_id = product_uid join attribute_text using (product_uid)),
counted as (
  select l.id, index, tf from labelled l join parts p on kind = 'p' and p.id = l.id
  union all select l.id, index, tf from labelled l join parts p on kind = 'd' and p.id = l.product_uid)
"""


def _weighted(classes: int) -> str:
    """x: IDF-weighted entries of all rows; margins: one number per row and class, at the stated weights."""
    return f"""
train_size as (select count(*) as m from labelled where split = 'train'),
frequencies as (
  select index, count(*) as df from counted join labelled using (id) where split = 'train' group by index),
x as (
  select id, index, tf * ln((m + 1) / (coalesce(df, 0) + 1)) as v
  from counted left join frequencies using (index), train_size),
classes as (select c::integer as class from range({classes}) r(c)),
sums as (select id, class, sum(v * {_WEIGHT}) as s from x, classes group by id, class),
margins as (
  select id, split, y, class, 2.0 + class / 10 + coalesce(s, 0) as margin
  from labelled cross join classes left join sums using (id, class)),
spread as (
  select index, (sum(v * v) - sum(v) * sum(v) / m) / (m - 1) as variance
  from x join labelled using (id), train_size where split = 'train' group by index, m),
penalty as (select sum(power({_WEIGHT}, 2) * variance) / 2 as penalty from spread, classes)
"""


def _squared(counts: str, regularization: float) -> str:
    return f"""with {counts}, {_weighted(1)}
        select round(avg(power(y - margin, 2)) / 2 / var_samp(y)
            + {regularization} / stddev_samp(y) * any_value(penalty) / var_samp(y), 6) as stated, 0.0::double as gap
        from margins, penalty where split = 'train'"""


ORACLES: dict[str, str] = {
    "stem_terms": f"with {_STEMMED} select term, stem from stems",
    "stem_tokens": f"""with {_STEMMED},
        joined as (select doc_id, string_agg(stem, '|' order by pos) as stems from tokens_of join stems using (term) group by doc_id)
        select doc_id, coalesce(joined.stems, '') as stems from documents left join joined using (doc_id)""",
    "replace_digits": "select doc_id, regexp_replace(text, '[0-9]+', '#', 'g') as text from documents",
    "remove_punctuation": (
        "select doc_id, regexp_replace(text, '[^a-zA-Z# ]', '', 'g') as text from documents"
    ),
    "tokenize": f"select doc_id, {_bar(_split('text'))} as tokens from documents",
    "remove_stop_words": (
        f"select doc_id, {_bar(_without_stop_words(_split('text')))} as tokens from documents"
    ),
    "clean_tokens": f"with {_DOCUMENT_TOKENS} select doc_id, {_bar('tokens')} as tokens from docs",
    "clean_conversations": f"""
        select conv_id, turn,
          array_to_string(list_filter({_tokens('text')}, lambda x: x <> ''), '|') as tokens
        from conversations""",
    "clean_pairs": f"""with {_PAIR_TOKENS}
        select id, {_bar('title_tokens')} as title_tokens, {_bar('sterm_tokens')} as sterm_tokens,
          {_bar('title_tokens || sterm_tokens')} as tokens from pair_tokens""",
    "join_token_arrays": (
        f"with {_JOINED_BIGRAMS} select id, {_bar('tokens')} as tokens from with_attributes"
    ),
    "bigrams": (
        f"with {_JOINED_BIGRAMS} select id, {_bar(_bigrams('tokens'))} as bigrams from with_attributes"
    ),
    "document_bigrams": (
        f"with {_DOCUMENT_TOKENS} select doc_id, {_bar(_bigrams('tokens'))} as bigrams from docs"
    ),
    "project_pairs": f"""with {_PAIRS}
        select id, product_uid, regexp_replace(product_title, '[0-9]+', '#', 'g') as nodigits_title,
          regexp_replace(search_term, '[0-9]+', '#', 'g') as nodigits_sterm from pairs""",
    "cast_relevance": f"""with {_PAIRS}
        select id, try_cast(relevance as float)::double as relevance,
          try_cast(search_term as float)::double as not_a_number from pairs""",
    "relevance_class": f"""with {_PAIRS}
        select id, case when r < 1.25 then 1 when r < 1.75 then 2 when r < 2.25 then 3
          when r < 2.75 then 4 else 5 end as label
        from (select id, relevance::float as r from pairs)""",
    "class_value": f"""with {_PAIRS}
        select id, (case when r < 1.25 then 1.0 when r < 1.75 then 1.5 when r < 2.25 then 2.0
          when r < 2.75 then 2.5 else 3.0 end)::double as value
        from (select id, relevance::float as r from pairs)""",
    "attribute_text": f"with {_VALUE_TEXT} select product_uid, attributes from attribute_text",
    "attribute_name_value_text": (
        f"with {_NAME_VALUE_TEXT} select product_uid, attributes from attribute_text"
    ),
    "attribute_names_text": (
        f"with {_attribute_text('name')} select product_uid, attributes from attribute_text"
    ),
    "join_pairs_attributes": f"""with {_PAIRS}, {_VALUE_TEXT}
        select product_uid, id, product_title, search_term, relevance, attributes
        from pairs join attribute_text using (product_uid)""",
    "join_pairs_left_null_keys": f"""with {_PAIRS}, {_VALUE_TEXT},
        thinned as (select id, case when id % 10 = 1 then product_uid end as product_uid from pairs)
        select id, product_uid, attributes from thinned left join attribute_text using (product_uid)""",
    "join_pairs_all": _all_joined(
        "", "product_uid, id, product_title, search_term, relevance"
    ),
    "join_new_pairs_all": _all_joined(
        "", "product_uid, id, product_title, search_term"
    ),
    "preview_top_n": f"with {_PAIRS} select * from pairs order by id limit 20",
    "split_by_key": f"""with {_PAIRS}
        select id, {_SPLIT} as outer_split,
          case when {_share(45)} and {_share(10)} then 'train' when {_share(45)} then 'val'
          else 'test' end as inner_split from pairs""",
    "split_sizes": f"with {_PAIRS} select {_SPLIT} as split, count(*) as n from pairs group by 1",
    "tf_terms": f"""with {_DOCUMENT_TOKENS}, tokens_of as (
          select doc_id, unnest(tokens) as term from docs)
        select doc_id, term, count(*) as tf from tokens_of group by doc_id, term""",
    "idf_terms": f"""with {_DOCUMENT_TOKENS}, tokens_of as (
          select doc_id, unnest(tokens) as term from docs),
        frequency as (select term, count(distinct doc_id) as df from tokens_of group by term)
        select term, df, round(ln(((select count(*) from documents) + 1) / (df + 1)), 6) as idf
        from frequency""",
    "tfidf_terms": f"""with {_DOCUMENT_TOKENS}, tokens_of as (
          select doc_id, unnest(tokens) as term from docs),
        frequency as (select term, count(distinct doc_id) as df from tokens_of group by term),
        counts as (select doc_id, term, count(*) as tf from tokens_of group by doc_id, term)
        select doc_id, term, tf,
          round(tf * ln(((select count(*) from documents) + 1) / (df + 1)), 6) as tfidf
        from counts join frequency using (term)""",
    "build_vocabulary": f"with {_DOCUMENT_VOCABULARY} select term, tf, df, term_id from vocabulary",
    "build_pair_vocabulary": f"with {_PAIR_VOCABULARY} select term, tf, df, term_id from vocabulary",
    "build_vocabulary_limited": f"""with {_DOCUMENT_TOKENS}, {_vocabulary('docs', 'doc_id', size=500)}
        select term, tf, df, term_id from vocabulary""",
    "build_vocabulary_unlimited": f"""with {_DOCUMENT_TOKENS},
        {_vocabulary('docs', 'doc_id', least=1, size=1 << 40)}
        select term, tf, df, term_id from vocabulary""",
    "vocabulary_size": (
        f"with {_DOCUMENT_VOCABULARY} select count(*) as vocabulary_size from vocabulary"
    ),
    "vocab_roundtrip": f"with {_DOCUMENT_VOCABULARY} select term, tf, df, term_id from vocabulary",
    "encode_tokens": f"with {_ENCODED} {_TEXT_COLUMNS} encoded",
    "encode_documents": f"""with {_DOCUMENT_VOCABULARY},
        positions as (
          select doc_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from docs),
        looked_up as (
          select doc_id, string_agg(term_id, '|' order by pos) as ids
          from positions join vocabulary using (term) where term <> '' group by doc_id)
        select doc_id, coalesce(ids, '') as ids from documents left join looked_up using (doc_id)""",
    "encode_new_pairs": f"with {_ENCODED} {_TEXT_COLUMNS} encoded",
    "pad_sequences": f"""with {_ENCODED}, padded as (
          select id, list_resize(int_title_tokens, 15, 0) as int_title_tokens,
            list_resize(int_sterm_tokens, 10, 0) as int_sterm_tokens from encoded)
        {_TEXT_COLUMNS} padded""",
    "mean_sequence_length": f"""with {_ENCODED}
        select cast(floor(avg(len(int_title_tokens))) as integer) as int_title_tokens,
          cast(floor(avg(len(int_sterm_tokens))) as integer) as int_sterm_tokens
        from encoded where {_share(45)}""",
    "scan_csv_roundtrip": f"with {_PAIRS} select * from pairs",
    "scan_csv_by_name": f"with {_PAIRS} select * from pairs",
    "scan_descriptions_csv": (
        "select cast(doc_id as varchar) as product_uid, text as product_description from documents"
    ),
    "scan_quoted_csv": (
        "select cast(doc_id as varchar) as product_uid, text as product_description from documents"
    ),
    "dictionary_json_roundtrip": f"""with {_DOCUMENT_TOKENS},
        {_vocabulary('docs', 'doc_id', least=1, size=1 << 40)} select term, term_id from vocabulary""",
    "pair_by_position": f"""with {_PAIRS}
        select id, product_title, relevance::float::double as relevance from pairs""",
    "count_vectors": f"""with {_DOCUMENT_VOCABULARY}
        select doc_id, (term_id - 1)::integer as index, count(*) as value
        from tokens_of join vocabulary using (term) group by doc_id, term_id having count(*) >= 2""",
    "count_vectors_share": f"""with {_DOCUMENT_TOKENS}, {_vocabulary('docs', 'doc_id', least=1, size=1 << 40)},
        sizes as (select doc_id, len(tokens) as size from docs)
        select doc_id, (term_id - 1)::integer as index, count(*) as value
        from tokens_of join vocabulary using (term) join sizes using (doc_id)
        group by doc_id, term_id, size having count(*) >= 0.01::double * size""",
    "embedding_matrix_last_vector": f"""with {_WORD_VECTORS}
        select term_id, round(coalesce(vec[1], 0)::double, 5) as first
        from (select term_id from vocabulary where term <> '' union all select 0) left join vectors using (term_id)""",
    "document_mean_vector_join": f"""with {_DOCUMENT_VOCABULARY},
        one as (select doc_id as id, term_id from tokens_of join vocabulary using (term) where term <> ''),
        vectors as (select vec_id as term_id, embedding as vec from embeddings where vec_id in (select term_id from vocabulary)),
        entries as (select term_id, unnest(vec) as value, generate_subscripts(vec, 1) as pos from vectors),
        lengths as (select id, count(*) as n from one group by id),
        per_entry as (
          select id, pos, sum(value::double) as total, max(value) as top, count(*) as present
          from one join entries using (term_id) group by id, pos),
        pooled as (
          select id, sum(total / n * pos) as mean,
            sum((case when present < n then greatest(top, 0) else top end)::double * pos) as max
          from per_entry join lengths using (id) group by id)
        select doc_id, round(coalesce(mean, 0), 4) as mean, round(coalesce(max, 0), 4) as max
        from documents left join pooled on id = doc_id""",
    "score_raw_text": f"with {_ONE_FEATURE} select id, round(p, 6) as prediction from predicted",
    "fit_objective_bigrams": _squared(_BIGRAM_COUNTS, models.BIGRAM_FIT.reg_param),
    "fit_objective_fields": _squared(_FIELD_COUNTS, models.FIELD_FIT.reg_param),
    "class_objective": f"""with {_BIGRAM_COUNTS}, {_weighted(CLASSES)},
        losses as (
          select id, max(margin) + ln(sum(exp(margin - top))) - sum(margin) filter (class = label) as loss
          from (select *, max(margin) over (partition by id) as top, case when y::float < 1.25 then 1 when y::float < 1.75 then 2
                  when y::float < 2.25 then 3 when y::float < 2.75 then 4 else 5 end as label
                from margins where split = 'train')
          group by id)
        select round(avg(loss) + {models.CLASS_FIT.reg_param} * any_value(penalty), 6) as stated, 0.0::double as gap
        from losses, penalty""",
    "metric_predicted_class": f"""with {_BIGRAM_COUNTS}, {_weighted(CLASSES)},
        best as (select id, any_value(split) as split, any_value(y) as y, arg_max(class, margin) as class from margins group by id),
        valued as (
          select *, case class when 1 then 1.0 when 2 then 1.5 when 3 then 2.0 when 4 then 2.5 else 3.0 end::double as p from best)
        select split, count(*) as n, round(sqrt(avg(power(y - p, 2))), 6) as rmse, round(avg(abs(y - p)), 6) as mae
        from valued group by split""",
    "score_weights_bigrams": f"""with {_BIGRAM_COUNTS}
        select id, round(2.0 + coalesce(s, 0), 6) as prediction
        from labelled left join (select id, sum(tf * {_WEIGHT.replace('class', '0')}) as s from counted group by id) using (id)""",
    "scan_json_roundtrip": f"""with {_ENCODED}, as_text as ({_TEXT_COLUMNS} encoded)
        select id, int_title_tokens, int_sterm_tokens, product_uid, relevance::double as relevance
        from as_text join (select id, product_uid, relevance from encoded) using (id)""",
    "join_features_labels": f"""with {_PAIR_TOKENS}
        select id, {_bar('title_tokens')} as title, relevance::double as relevance
        from pair_tokens""",
    "word_vectors_parse": f"""with {_WORD_VECTORS}
        select term, cast(generate_subscripts(vec, 1) - 1 as integer) as pos,
          round(unnest(vec)::double, 5) as value
        from vectors where term <> ''""",
    "word_vectors_mixed_width": f"""with {_WORD_VECTORS}
        select count(*) filter (term_id % 3 <> 0) as read, count(*) filter (term_id % 3 = 0) as rejected
        from vectors where term <> ''""",
    "embedding_matrix": f"""with {_WORD_VECTORS},
        entries as (
          select term_id, unnest(vec)::double as value, generate_subscripts(vec, 1) as pos
          from vectors),
        sums as (
          select term_id, sum(value * pos) as checksum, max(value) filter (pos = 1) as first
          from entries group by term_id),
        ids as (select term_id from vocabulary union all select 0)
        select term_id, {VECTOR_SIZE} as dimensions, round(coalesce(first, 0), 5) as first,
          round(coalesce(checksum, 0), 4) as checksum
        from ids left join sums using (term_id)""",
    "sequence_mean_vector": f"""with {_POOLED_ENTRIES}
        select e.id, round(coalesce(t.mean_sum, 0), 4) as title_mean,
          round(coalesce(t.max_sum, 0), 4) as title_max,
          round(coalesce(s.mean_sum, 0), 4) as sterm_mean,
          round(coalesce(s.max_sum, 0), 4) as sterm_max
        from encoded e
        left join pooled t on t.id = e.id and t.field = 'title'
        left join pooled s on s.id = e.id and s.field = 'sterm'""",
    "hashing_tf": (
        f"with {_DOCUMENT_BUCKETS} select doc_id, bucket as index, tf::double as value from counted"
    ),
    "hashing_tf_bigrams": f"""with {_JOINED_BIGRAMS},
        grams as (select id, unnest({_bigrams('tokens')}) as term from with_attributes),
        {_buckets('grams', 30000)}
        select id, bucket as index, count(*)::double as value
        from grams join hashed using (term) group by id, bucket""",
    "idf_hashed": f"""with {_DOCUMENT_BUCKETS}
        select b::integer as bucket, coalesce(df, 0) as df,
          round(ln((m + 1) / (coalesce(df, 0) + 1)), 6) as idf
        from range(16384) r(b) left join bucket_df on bucket = b, size""",
    "tfidf_vectors": f"""with {_DOCUMENT_BUCKETS}
        select doc_id, bucket as index, round(tf * ln((m + 1) / (df + 1)), 6) as value
        from counted join bucket_df using (bucket), size""",
    "assemble_features": f"""with {_PAIR_TOKENS}, {_NAME_VALUE_TEXT},
        fields as (
          select 'p' as kind, id, 0 as place, unnest(title_tokens) as term from pair_tokens
          union all select 'p', id, 1, unnest(sterm_tokens) from pair_tokens
          union all select 'd', doc_id, 2, unnest({_tokens('text')}) from documents
          union all select 'd', product_uid, 3, unnest({_tokens('attributes')}) from attribute_text),
        {_buckets('fields', 16384)},
        counted as (
          select kind, id, place * 16384 + bucket as index, count(*) as tf
          from fields join hashed using (term) group by kind, id, place, bucket),
        sums as (
          select kind, id, count(*) as entries, sum(tf) as total, sum(index * tf) as checksum
          from counted group by kind, id)
        select p.id, 65536 as width,
          (coalesce(a.entries, 0) + coalesce(b.entries, 0))::integer as entries,
          (coalesce(a.total, 0) + coalesce(b.total, 0))::double as total,
          (coalesce(a.checksum, 0) + coalesce(b.checksum, 0))::double as checksum
        from pair_tokens p join documents on doc_id = product_uid
        join attribute_text using (product_uid)
        left join sums a on a.kind = 'p' and a.id = p.id
        left join sums b on b.kind = 'd' and b.id = product_uid""",
    "linear_regression_fit": f"""with {_ONE_FEATURE}
        select 'normal' as solver, round(slope_normal, 8) as slope,
          round(ay - slope_normal * ax, 8) as intercept from line
        union all
        select 'l-bfgs', round(slope_search, 8), round(ay - slope_search * ax, 8) from line""",
    "fit_summary": f"""with {_ONE_FEATURE}, train as (select * from predicted where split = 'train')
        select round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
          round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2,
          (select round(ay - slope_normal * ax, 6) from line) as intercept, 1 as n_features from train""",
    "fit_coefficients": f"""with {_ONE_FEATURE}
        select 0 as index, round(slope_normal, 6) as coefficient from line""",
    "score_holdout": f"""with {_ONE_FEATURE}
        select id, round(y, 6) as label, round(p, 6) as prediction from predicted where split = 'test'""",
    "model_save_load_score": f"""with {_ONE_FEATURE}
        select id, round(y, 6) as label, round(p, 6) as prediction from predicted where split = 'test'""",
    "score_new_pairs": f"with {_ONE_FEATURE} select id, round(p, 6) as prediction from predicted",
    "evaluate_holdout": _TEST_METRICS.format(
        "round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(avg(abs(y - p)), 6) as mae,"
        " round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2"
    ),
    "embedding_regression_optimum": f"select i::integer as index, 0.0::double as slope from range({4 * VECTOR_SIZE}) r(i)",
    "score_fields_additive": f"""with {_PAIRS}
        select id, 0.0::double as difference from pairs join documents on doc_id = product_uid""",
    "evaluation_report": f"""with {_ONE_FEATURE}
        select round(y, 6) as label, round(p, 6) as prediction from predicted where split = 'test'""",
    "residuals": f"""with {_ONE_FEATURE}
        select id, round(y - p, 6) as residual from predicted where split = 'train'""",
    "metric_rmse": _TEST_METRICS.format("round(sqrt(avg((y - p) * (y - p))), 6) as rmse"),
    "metric_mae": _TEST_METRICS.format("round(avg(abs(y - p)), 6) as mae"),
    "metric_r2": _TEST_METRICS.format(
        "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2"
    ),
    "metric_class_rmse": f"""with {_PAIRS},
        scored as (
          select r::double as y, case when r < 1.25 then 1.0 when r < 1.75 then 1.5
            when r < 2.25 then 2.0 when r < 2.75 then 2.5 else 3.0 end::double as p
          from (select relevance::float as r from pairs))
        select count(*) as n, round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
          round(avg(abs(y - p)), 6) as mae from scored""",
}

ORACLES["encode_tokens_join"] = ORACLES["encode_documents"]
ORACLES["sequence_mean_vector_join"] = ORACLES["sequence_mean_vector"]
ORACLES["relevance_job"] = f"select id, entries, total, 0.0::double as difference from ({ORACLES['assemble_features']})"
