"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from communa.llm.bpe import op4_bpe
from communa.llm.chat import op10_chat
from communa.llm.filters import op11_filters
from communa.llm.langid import op3_langid
from communa.llm.lines import op9_lines
from communa.llm.media import op8_media
from communa.llm.neardup import op12_embeddings
from communa.llm.packing import op6_packing
from communa.llm.phrases import op13_phrases
from communa.llm.repeats import op2_repeats
from communa.llm.secrets import op5_secrets
from communa.llm.simhash import op1_simhash
from communa.llm.vectors import op7_vectors
from communa.storage import owned


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: owned(f) for f in (op1_simhash, op2_repeats, op3_langid, op4_bpe, op5_secrets, op6_packing, op7_vectors, op8_media, op9_lines, op10_chat, op11_filters, op12_embeddings, op13_phrases)}


#: Windows of 400 bytes as hexadecimal digits; of the characters that a cut goes through, what stays of them is taken off each piece.
_REPEATS = r"""with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
    windows as (select rid, p, md5(substring(x, 2 * p + 1, 800)) as m from (select rid, x, unnest(range(length(x) // 2 - 399)) as p from d where length(x) >= 800) t),
    hits as (select rid, p, lag(p) over (partition by rid order by p) as before from windows where m in (select m from windows group by m having count(*) > 1)),
    numbered as (select rid, p, sum(case when before is null or p > before + 400 then 1 else 0 end) over (partition by rid order by p) as g from hits),
    spans as (select rid, min(p) as a, max(p) + 400 as b from numbered group by rid, g),
    ends as (select rid, a, lag(b, 1, cast(0 as bigint)) over (partition by rid order by a) as before from spans union all select d.rid, length(x) // 2, coalesce(max(b), 0) from d left join spans on spans.rid = d.rid group by all),
    pieces as (select rid, a, substring(x, 2 * before + 1, 2 * (a - before)) as piece from ends join d using (rid)),
    trimmed as (select rid, a, piece, regexp_extract(regexp_replace(piece, '^([89AB].)+', ''), '^([0-7].|[CD].[89AB].|E.([89AB].){2}|F.([89AB].){3})*') as whole from pieces),
    joined as (select rid, string_agg(piece, '' order by a) as kept, string_agg(whole, '' order by a) as whole from trimmed group by rid),
    sums as (select rid, sum(b - a) as removed, count(*) as n, string_agg(a || ':' || b, ',' order by a) as said from spans group by rid)
    select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
        sha256(unhex(kept)) as kept_sha256, decode(unhex(whole)) as text, coalesce(said, '') as spans from d join joined using (rid) left join sums using (rid)"""

_NEIGHBOURS = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null),
    sound as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    asked as (select vec_id, min(e) as e from sound where vec_id % 20 = 0 group by 1),
    scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) as score from asked q join sound c on q.vec_id <> c.vec_id),
    ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
    select * from ranked where rank <= 20"""

#: Words are lower-cased in A-Z alone; pairs of sets meet under a word of both prefixes and are verified.
_LINES = r"""with d as (select distinct doc_id, text from documents where text is not null),
    split as (select doc_id, text, string_split(text, chr(10)) as l from d),
    lines as (select doc_id, text, unnest(range(len(l))) as i, unnest(l) as line from split),
    worded as (select *, list_sort(list_distinct(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r]+'), lambda w: w <> ''))) as words from lines),
    firsts as (select words, min({'last': doc_id is null, 'doc': doc_id, 'line': i}) as first from worded where len(words) > 0 group by words),
    sets as (select words, len(words) as n, first, row_number() over (order by first) as id from firsts),
    tokens as (select id, n, unnest(words) as w from sets),
    often as (select w, count(*) as k from tokens group by w),
    placed as (select id, n, w, row_number() over (partition by id order by k, w) as place from tokens join often using (w)),
    prefix as (select id, n, w from placed where place <= n - (4 * n + 4) // 5 + 1),
    pairs as (select distinct x.id as x, y.id as y from prefix x join prefix y on x.w = y.w and y.id < x.id and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
    gone as (select distinct x from pairs join sets a on a.id = x join sets b on b.id = y where 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n)),
    judged as (select doc_id, text, i, line, len(worded.words) = 0 or (first = {'last': doc_id is null, 'doc': doc_id, 'line': i} and id not in (select x from gone)) as stays from worded left join sets on sets.words = worded.words),
    kept as (select doc_id, text, count(*) as n_lines, count(*) filter (not stays) as n_removed, coalesce(string_agg(line, chr(10) order by i) filter (stays), '') as kept from judged group by 1, 2)
    select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(kept) as kept_sha256
    from documents left join kept on documents.doc_id is not distinct from kept.doc_id and documents.text = kept.text"""


#: Masks of the filters a document fails, and every step of the 120 orders.
_FILTERS = r"""with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    firsts as (select text, min(doc_id) as first from d group by text),
    words as (select *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from d),
    failed as (select rid, doc_id, part, len(w) < 200 as "A", 100 * len(list_distinct(w)) < 50 * len(w) as "B", 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as "C",
        regexp_matches(text, '[#$%&*|]') as "D", coalesce(doc_id > first, false) as "E" from words join firsts using (text)),
    called as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
    marked as (select part, case when "A" then 'A' else '' end || case when "B" then 'B' else '' end || case when "C" then 'C' else '' end || case when "D" then 'D' else '' end || case when "E" then 'E' else '' end as mask,
        count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed left join called using (doc_id) group by 1, 2),
    names as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from names a, names b, names c, names d, names e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps as (select filter_order, step, filter_order[step:step] as filter, filter_order[1:step - 1] as before from orders, (select unnest(range(1, 6)) as step) t),
    rows as (select part, filter_order, step, filter, n, good, toxic, mask, contains(mask, filter) as fails, mask <> '' and before <> '' and len(list_intersect(string_split(mask, ''), string_split(before, ''))) > 0 as gone from marked, steps),
    told as (select part, filter_order, step, filter, sum(n) filter (not fails and not gone) as kept, sum(n) filter (fails and not gone) as removed, sum(n) filter (fails and gone) as redundant,
        sum(n) filter (mask = filter) as unique_fails, sum(good) filter (fails and not gone) as good_lost, sum(toxic) filter (fails and not gone) as toxic_lost from rows group by all)
    select part, filter_order, cast(step as integer) as step, filter, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
        cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
        cast(sum(coalesce(removed, 0)) over (partition by part, filter) as bigint) as shapley from told"""

_NEAR = """with recursive v as (select row_number() over () as rid, vec_id, cast(embedding as double[]) as e from embeddings),
    sound as (select rid, vec_id, e from v where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    links as (select a.rid as a, b.rid as b from sound a join sound b on a.rid <> b.rid and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
    reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
    least as (select a, min(vec_id) as low from reach join v on v.rid = reach.b group by 1), sums as (select a, count(*) as n from links group by 1)
    select vec_id, cast(coalesce(n, 0) as bigint) as n_links, least(vec_id, low) as component_id, vec_id is not distinct from least(vec_id, low) as kept from v left join least on least.a = rid left join sums on sums.a = rid"""

#: Lower-cased in A-Z alone; phrases are lists of words of one piece.
_PHRASES = r"""with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) as piece from d),
    split as (select row_number() over () as id, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as w from pieces),
    worded as (select * from split where len(w) > 0),
    totals as (select lang, sum(len(w)) as n from worded group by 1),
    runs as (select lang, k, w[i:i + k - 1] as p from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from worded, (select unnest(range(1, 6)) as k) t where len(w) >= k) t),
    counts as (select lang, k, p, count(*) as f from runs group by all having count(*) >= 100),
    cuts as (select c.lang, c.p, c.f as a, cut, l.f as l, r.f as r, t.n, (cast(1000 as hugeint) * c.f * t.n) // (cast(l.f as hugeint) * r.f) as score from (select *, unnest(range(1, k)) as cut from counts where k > 1) c
        join counts l on l.lang = c.lang and l.p = c.p[1:cut] join counts r on r.lang = c.lang and r.p = c.p[cut + 1:c.k] join totals t on t.lang = c.lang),
    rated as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
    longer as (select distinct a.lang, a.p from counts a join counts b on a.lang = b.lang and a.k > 1 and b.k > a.k and 100 * b.f >= 100 * a.f and list_has_any(list_transform(range(1, b.k - a.k + 2), lambda i: b.p[i:i + a.k - 1]), [a.p])),
    named as (select *, array_to_string(p, ' ') as phrase from rated where (lang, p) not in (select lang, p from longer)),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from named)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; models, tokenizers, spectra and packings are held against brute force in tests."""
    return {"op2_repeats": _REPEATS, "op7_vectors": _NEIGHBOURS, "op9_lines": _LINES, "op11_filters": _FILTERS, "op12_embeddings": _NEAR, "op13_phrases": _PHRASES}
