"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from ..sources import tables
from ..sources.tables import AS_OF_SQL
from . import queries as q


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(map(_quote, xs))


STOP = _list("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
WHITE = r"[^\s\p{Z}\x1c-\x1f\x85]+"
# Written out, so that a change of the engine's constants shows.
P = {
    "text": 12, "coverage": 25, "all_terms": 40, "phrase_title": 140, "phrase_url": 70, "phrase_description": 25, "compact_url": 90, "title_hit": 22,
    "url_hit": 16, "compact_hit": 12, "all_title": 80, "all_url": 55, "all_compact": 45, "news": 8,
}


def _terms(c: str) -> str:
    """Search terms of a text as a list."""
    return rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]{{2,}}') and t not in ({STOP}))"


WEB = f"web as (select {', '.join(tables.WEB)}, len(regexp_extract_all(text, '{WHITE}')) word_count from documents)"
NEWS = f"articles as (select {', '.join(tables.ARTICLES)} from documents)"
FEEDS = f"""f0 as (select distinct {', '.join(tables.FEEDS)} from documents)
, feeds as (select feed_url, case when k % 3 = 0 then null else 'https://' || name || '.example.org/' end home_url, name,
    case when k % 2 = 0 then null else {AS_OF_SQL} + to_minutes((k - 10) * 7) end next_fetch_at,
    case when k % 4 = 0 then null else {AS_OF_SQL} - to_hours(k) end last_fetched from f0)"""
POSTINGS = f"""p0 as (select id, unnest([1, 2, 4]) field, unnest([title, description, content]) body from web)
, postings as (select id doc_id, field, term, count(*) frequency from (select id, field, unnest({_terms('body')}) term from p0) group by all)"""
NEWS_POSTINGS = f"""news_postings as (select url article_url, term, count(*) frequency from
    (select url, unnest({_terms("concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(content, ''))")}) term from articles) group by all)"""
TOTALS = "size as (select greatest(count(*), 1) n, coalesce(avg(word_count), 0) avg_doc_len from web)"
IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
WEIGHT = "case field when 1 then 3.2::double when 2 then 1.7::double else 1.0::double end"


def _in(words) -> str:
    return f"term in ({_list(words)})"


_WORDS = ("only", "shansher", "rely", "apache", "license")
_PHRASE = "the only of shansher rely apache license"
_TOTAL = 5
_STEMMED = ("licensed", "licenses", "released", "rights")
#: Stems of that query, and the words of the given texts that have them.
_FORMS = {"licensed": "licens", "license": "licens", "licenses": "licens", "licensing": "licens", "released": "releas", "release": "releas", "releases": "releas", "releasing": "releas", "rights": "right", "right": "right", "righted": "right"}


def _candidates(limit: int, offset: int, words=_WORDS, term: str = "term", source: str = "postings") -> str:
    return f"""{WEB}, {POSTINGS}, {TOTALS}
    , hits as (select * from (select doc_id, field, {term} term, sum(frequency) frequency from {source} group by all) where {_in(words)})
    , stats as (select term, count(distinct doc_id) df from hits group by term)
    , agg as (select doc_id, sum(frequency * {IDF} * {WEIGHT}) token_score, count(distinct term) matched_terms from hits join stats using (term), size group by doc_id)
    , cand as (select title, coalesce(description, '') description, url, token_score, matched_terms from web join agg on id = doc_id where status = 'done'
        order by token_score desc, url limit {min(2000, max(offset + limit + 200, limit * 10))})"""


def _intent(phrase: str, words, total: int, news: bool = False) -> str:
    flat = "regexp_replace(lower(url), '[^a-z0-9]', '', 'g')"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    own = lambda c: f"len(list_intersect([{_list(words)}], {_all_terms(c)}))"
    compact = "(" + " + ".join(f"(case when contains({flat}, {_quote(w)}) then 1 else 0 end)" for w in words) + ")"
    n = len(words)
    on = lambda cond, pts: f"(case when {cond} then {pts} else 0 end)::double"
    return " + ".join([
        f"{P['text']}::double * ln(1 + greatest(token_score, 0))", f"{P['coverage']}::double * matched_terms / {total}::double", on(f"matched_terms = {total}", P["all_terms"]),
        on(f"contains({norm('title')}, {_quote(phrase)})", P["phrase_title"]), on(f"contains({norm('url')}, {_quote(phrase)})", P["phrase_url"]),
        on(f"contains({norm('description')}, {_quote(phrase)})", P["phrase_description"]), on(f"contains({flat}, {_quote(''.join(words))})", P["compact_url"]),
        f"{P['title_hit']} * {own('title')}", f"{P['url_hit']} * {own('url')}", f"{P['compact_hit']} * {compact}",
        on(f"{own('title')} = {n}", P["all_title"]), on(f"{own('url')} = {n}", P["all_url"]), on(f"{compact} = {n}", P["all_compact"]), str(P["news"] if news else 0),
    ])


def _all_terms(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]{{2,}}'))"


def _counts(source: str, where: str = "true") -> str:
    return f"select unnest(regexp_extract_all(lower(concat_ws(' ', title, description, content)), '[a-z]{{2,32}}')) word from {source} where {where}"


WORDS = f"{WEB}, {NEWS}, words as (select word, count(*) total_frequency from ({_counts('web')} union all {_counts('articles')}) group by word)"


def _external() -> str:
    rows = lambda xs: ", ".join(f"({_quote(x)}, {i + 1})" for i, x in enumerate(xs))
    return f"""ext as (select word, sum(score)::bigint external_frequency from (
        select lower(split_part(value, ' ', 1)) word, floor(ln(1 + replace(split_part(value, ' ', 2), ',', '')::double) * 6)::int score from (values {rows(q.COUNTED)}) t(value, rank)
          where regexp_full_match(replace(split_part(value, ' ', 2), ',', ''), '\\d+') and regexp_full_match(lower(split_part(value, ' ', 1)), '\\p{{L}}{{2,}}')
        union all select lower(value), floor(ln(1 + greatest(1, 20000 - rank + 1)::double) * 5)::int from (values {rows(q.RANKED)}) t(value, rank) where regexp_full_match(lower(value), '\\p{{L}}{{2,}}'))
      where score > 0 group by word)"""


def _dict(words: str, name: str) -> str:
    return f"""{name} as materialized (select word, 0::bigint doc_frequency, coalesce(total_frequency, 0)::bigint total_frequency, coalesce(external_frequency, 0)::bigint external_frequency,
      2 * ln(1 + coalesce(total_frequency, 0)::double) + 3 * ln(1 + coalesce(external_frequency, 0)::double) popularity_score from {words} full outer join ext using (word) where length(word) between 2 and 32)"""


DICT = f"{WORDS}, {_external()}, {_dict('words', 'dict')}"
INPUTS = f"inputs as (select unnest([{_list(q.MISSPELT)}]) input_word)"
_GRAMS = lambda w: f"list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substr('  ' || {w} || ' ', i, 3)))"


def _trigram(inputs: str = "inputs") -> str:
    near = "length(word) between greatest(2, length(input_word) - 2) and length(input_word) + 2"
    g, h = "wg", "ig"
    return f"""lx as materialized (select *, {_GRAMS('word')} wg from dict where popularity_score >= 2 and length(word) <= (select max(length(input_word)) + 2 from {inputs})), ix as (select distinct input_word, {_GRAMS('input_word')} ig from {inputs})
    , sim as (select *, len(list_intersect({g}, {h})) / len(list_distinct(list_concat({g}, {h})))::double similarity from lx join ix on {near})
    , tri as materialized (select * from sim where similarity >= 0.3 qualify row_number() over (partition by input_word order by round(similarity, 6) desc, popularity_score desc, word) <= 120)"""


def _o1(s: str, t: str) -> str:
    """0 if equal, 1 for one edit or one swap of neighbours, else 9."""
    return f"(case when {s} = {t} then 0 when levenshtein({s}, {t}) = 1 or len(list_filter(range(1, length({s})), lambda k: substr({s}, 1, k - 1) || substr({s}, k + 1, 1) || substr({s}, k, 1) || substr({s}, k + 2) = {t})) > 0 then 1 else 9 end)"


def _best(tri: str = "tri") -> str:
    s, t = "input_word", "word"
    swapped = f"""len(list_filter(range(1, greatest(length({s}), length({t}))), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 and j < length({t}) and i < length({s})
        and substr({s}, i, 1) = substr({t}, j + 1, 1) and substr({s}, i + 1, 1) = substr({t}, j, 1)
        and {_o1(f'substr({s}, 1, i - 1)', f'substr({t}, 1, j - 1)')} + {_o1(f'substr({s}, i + 2)', f'substr({t}, j + 2)')} <= 1)) > 0)) > 0"""
    return f"""near as materialized (select input_word, word, popularity_score, doc_frequency, total_frequency, levenshtein({s}, {t}) lev from {tri} where word <> input_word and levenshtein({s}, {t}) <= 4)
    , dist as materialized (select *, case when {_o1(s, t)} <= 1 then {_o1(s, t)} when lev <= 2 then 2 when {swapped} then 2 end distance from near)
    , best as (select * from dist where distance <= case when length(input_word) <= 3 then 1 else 2 end
        qualify row_number() over (partition by input_word order by distance, -popularity_score, -doc_frequency, -total_frequency, word) = 1)
    , fixed as (select b.input_word, b.word best, b.distance::int distance from best b left join dict k on k.word = b.input_word
        where b.popularity_score >= case when coalesce(k.popularity_score, 0) > 0 then k.popularity_score * case when b.distance = 1 then 1.8 else 4 end else case when b.distance = 1 then 0.5 else 2.5 end end)"""


OUTGOING = """nd as (select count(*) n from documents)
, pairs as (select doc_id, unnest([3, 7, 13]) k from documents where doc_id % 11 <> 0)
, outgoing as (select p.doc_id source_doc_id, w.url target_url from pairs p, nd, web w where w.id = (p.doc_id * k + 7) % n
    union all select doc_id, 'https://elsewhere.example.com/' || doc_id from documents where doc_id % 11 <> 0)
, edges as (select distinct source_doc_id, id target_doc_id from outgoing join web on url = target_url)
, nodes as (select id from web where status = 'done')
, kept as (select e.* from edges e where source_doc_id in (from nodes) and target_doc_id in (from nodes))"""

# The URL rules that the pages reach: fragment, tracking and blank parameters, double slashes, letter case of the host.
_HOST = "lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1))"
DOMAIN = rf"""(select case when len(l) <= 2 then h when l[-2] || '.' || l[-1] in ({_list(('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp'))}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end
  from (select regexp_replace({_HOST}, ':[0-9]*$', '') h, list_filter(string_split(h, '.'), lambda x: x <> '') l))"""
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
NORMAL = rf"""lower(regexp_extract(url, '^[A-Za-z]+')) || '://' || {_HOST} || coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), ''), '/')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '^[^=]+=.+') and lower(split_part(p, '=', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid')), '&'), ''), '')"""
# What HTML's rules make of the given pages: the article's text between its tags, and links of anchors.
_PLAIN = lambda c: f"replace(replace(replace(replace(replace({c}, '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_MAIN = _PLAIN("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')")
_LINK = "lower(regexp_extract(url, '^[A-Za-z]+')) || '://' || {host} || case when href like '/%' then href else '/' || href end"
FETCHED = f"""fetched as (select page_id, url, {_MAIN} main, case when page_id % 10 = 3 then 404 when page_id % 10 = 4 then 500 else 200 end code, page_id % 10 r, page_id % 20 r20 from pages)"""
ROUTES = f"""{FETCHED}, routed as (select page_id, url, case when code >= 400 then 'non_success_status_error' when r = 5 then 'done' when r20 = 6 then 'done' when r = 6 then 'processing_error'
    when r20 = 7 then 'processing_error' when page_id % 3 = 0 and length(regexp_replace(main, '\\s+', ' ', 'g')) >= 120 then 'done' else 'validation_error' end status from fetched)"""
QUEUE = f"queue as (select {NORMAL} url, min({DOMAIN}) domain from pages group by 1)"


FETCHED_HTML = "fh as (select page_id, url, html, page_id % 3 = 0 and page_id % 20 <> 6 own from pages)"
ANCHORS = f"""an as (select page_id, url, unnest(hs) href, generate_subscripts(hs, 1) i from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) hs from pages))
, anchors as (select page_id, min(i) first, link from (select page_id, i, {_LINK.format(host=_HOST)} link from an) group by page_id, link)"""


SIMHASH = f"""select doc_id, fingerprint from (select doc_id, coalesce(f, 0) fingerprint from documents left join (
  select doc_id, sum(case when 2 * c > n then (case when b = 63 then -9223372036854775808 else (1::hugeint << b) end) else 0 end)::bigint f from (
    select doc_id, b, sum(((h >> b) & 1)::int) c, count(*) n from (select doc_id, ('0x' || substr(md5(w), 17, 16))::ubigint h from (select doc_id, unnest(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x0B\\x1c-\\x1f\\x85]+')) w from documents)),
      (select unnest(range(64))::int b) group by all) group by doc_id) using (doc_id))"""

# Feeds made of the documents: their rows, without a parser.
FEED_ITEMS = f"""fi as (select doc_id, doc_id // 10 k, substring(split_part(text, chr(10), 1), 1, 80) title, 'author ' || doc_id % 7 author, timestamp '2024-01-01' + to_minutes((doc_id % 400000)::int) stamp from documents)
, ok as (select * from fi where k % 17 <> 3)"""
_TITLE = r"trim(regexp_replace(regexp_replace(coalesce(title, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+$|^\s+', '', 'g'))"


def _values(rows, cols: str) -> str:
    one = lambda r: "(" + ", ".join("null" if x is None else _quote(x) for x in r) + ")"
    return f"(values {', '.join(map(one, rows))}) t({cols})"


ORACLES = {
    "tokenize_terms": f"select doc_id, term, count(*) n from (select doc_id, unnest({_terms('text')}) term from documents) group by all",
    "term_freq_by_field": f"with {WEB}, {POSTINGS} select doc_id, field, term, frequency::int frequency from postings",
    "term_statistics": f"with {WEB}, {POSTINGS}, {TOTALS} select term, df doc_frequency, round({IDF}, 9) idf, round(avg_doc_len, 6) avg_doc_len from (select term, count(distinct doc_id) df from postings group by term), size",
    "web_search_candidates": f"with {_candidates(20, 0)} select title, description, url, round(token_score, 6) token_score, matched_terms from cand",
    "web_search_ranked": f"with {_candidates(20, 0)} select url, title, round({_intent(_PHRASE, _WORDS, _TOTAL)}, 6) score from cand",
    "web_search_page": f"with {_candidates(10, 10)} select url, round(score, 6) score from (select url, {_intent(_PHRASE, _WORDS, _TOTAL)} score from cand) order by score desc, url limit 10 offset 10",
    "web_search_textless": f"with {_candidates(20, 0)} select round(12 * ln(1 + token_score) + 25 * matched_terms / {_TOTAL}::double + case when matched_terms = {_TOTAL} then 40 else 0 end, 6) score from cand",
    "web_search_stemmed": f"""with forms as (from (values {", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in _FORMS.items())}) t(form, stem)), {_candidates(20, 0, ("licens", "releas", "right"), "stem", "postings join forms on form = postings.term")}
      select url, round({_intent(" ".join(_STEMMED), _STEMMED, 3)}, 6) score from cand""",
    "queue_dequeue": f"""with {QUEUE}, p as (select url from queue order by md5('{q.SEED}:' || url), url limit {q.QUEUE_N})
      select url, case when url in (from p) then 'in_progress' else 'queued' end status, (url in (from p))::int attempt_count, case when url in (from p) then {AS_OF_SQL} end last_attempt from queue""",
    "feed_shards": f"with {FEEDS} select feed_url, (('0x' || substr(md5(feed_url), 1, 8))::ubigint % 4)::bigint shard from feeds",
    "news_search": f"""with {WEB}, {NEWS}, {FEEDS}, {POSTINGS}, {NEWS_POSTINGS}, {TOTALS}
      , stats as (select term, (count(distinct doc_id)) df from (select doc_id, term from postings union all select null, term from news_postings) where {_in(_WORDS)} group by term)
      , agg as (select article_url, sum(frequency * {IDF}) token_score, count(distinct term) matched_terms from news_postings join stats using (term), size where {_in(_WORDS)} group by article_url)
      , cand as (select a.url, title, coalesce(description, '') description, author, f.feed_url, f.home_url, token_score, matched_terms from articles a join agg on url = article_url left join feeds f on f.feed_url = a.feed_url
          order by token_score desc, a.url limit 220)
      select url, title, description, author, feed_url, home_url, round(token_score, 6) token_score, matched_terms, round({_intent(_PHRASE, _WORDS, _TOTAL, True)}, 6) score from cand""",
    "news_idf_df_zero": f"""with w0 as (select {', '.join(tables.WEB)}, len(regexp_extract_all(text, '{WHITE}')) word_count from documents), web as (select * from w0 where id % 4 <> 0), {NEWS}, {POSTINGS}, {NEWS_POSTINGS}, {TOTALS}
      select term, 0::bigint doc_frequency, round(ln((n + 0.5) / 0.5 + 1), 9) idf from (select distinct term from news_postings where term not in (select term from postings)), size""",
    "spell_words": f"with {WORDS} select word, total_frequency from words",
    "spell_external_scores": f"with {_external()} from ext",
    "spell_dictionary": f"with {DICT} select * replace (round(popularity_score, 9) as popularity_score) from dict",
    "spell_meta_topn": f"with {DICT} select * replace (round(popularity_score, 9) as popularity_score) from (from dict order by popularity_score desc, word limit 120000)",
    "spell_candidates_trigram": f"with {DICT}, {INPUTS}, {_trigram()} select input_word, word, total_frequency, round(similarity, 6) similarity from tri",
    "spell_candidates_prefix": f"""with {DICT}, {INPUTS} select input_word, word, round(popularity_score, 9) popularity_score from inputs join dict on length(word) between greatest(2, length(input_word) - 2) and length(input_word) + 2 and word[1] = input_word[1]
      where popularity_score >= 2 qualify row_number() over (partition by input_word order by popularity_score desc, word) <= 120""",
    "spell_corrections": f"with {DICT}, {INPUTS}, {_trigram()}, {_best()} from fixed",
    "spell_suspects": f"with {DICT}, {INPUTS} select input_word from inputs left join dict on word = input_word where coalesce(popularity_score, 0) < 3",
    "spell_suggest": rf"""with {DICT}, qs as (select (row_number() over ())::int - 1 qid, v q from (select unnest([{_list(q.SUGGEST)}]) v))
      , asked as (select distinct lower(unnest(regexp_extract_all(q, '\b[a-zA-Z]{{2,32}}\b'))) input_word from qs), inputs as (select input_word from asked left join dict on word = input_word where input_word not in ({STOP}) and coalesce(popularity_score, 0) < 3)
      , {_trigram()}, {_best()}
      , parts as (select qid, q, unnest(regexp_extract_all(q, '[a-zA-Z]+|[^a-zA-Z]+')) part, generate_subscripts(regexp_extract_all(q, '[a-zA-Z]+|[^a-zA-Z]+'), 1) i from qs)
      , lines as (select qid, string_agg(case when best is null then part when part = upper(part) then upper(best) when part[1] = upper(part[1]) and part[2:] = lower(part[2:]) then upper(best[1]) || lower(best[2:]) else best end, '' order by i) line from parts left join fixed on input_word = lower(part) group by qid)
      select qid::int qid, q, case when line <> q then line end suggestion from qs left join lines using (qid)""",
    "spell_generate_deletes": f"""with {WORDS}, w as (select word from words), one as (select word, substr(word, 1, i - 1) || substr(word, i + 1) cut from (select word, unnest(range(1, length(word) + 1)) i from w))
      select word, cut from one union select word, substr(cut, 1, i - 1) || substr(cut, i + 1) from (select word, cut, unnest(range(1, length(cut) + 1)) i from one where length(cut) >= 2)""",
    "dictionary_sync_diff": f"""with {WEB}, {_external()}, w1 as (select word, count(*) total_frequency from ({_counts('web', 'id % 3 <> 0')}) group by word), w2 as (select word, count(*) total_frequency from ({_counts('web')}) group by word)
      , {_dict('w1', 'o0')}, {_dict('w2', 'n')}, o as (from o0 union all select 'goneword', 0, 3, 0, 1.0)
      select word, coalesce(n.total_frequency, o.total_frequency) total_frequency, case when o.doc_frequency is null then 'insert' when n.doc_frequency is null then 'delete'
        when o.total_frequency <> n.total_frequency or o.external_frequency <> n.external_frequency then 'update' else 'unchanged' end as action from o full outer join n using (word)""",
    "link_graph": f"with {WEB}, {OUTGOING} from edges",
    "inlink_counts": f"with {WEB}, {OUTGOING} select id doc_id, count(source_doc_id)::int inlink_count from nodes left join kept on target_doc_id = id group by id",
    "pagerank": f"""with recursive {WEB}, {OUTGOING}, nn as (select count(*) n from nodes), outs as (select source_doc_id, count(*) c from kept group by 1)
      , r(step, id, rank) as (select 0, id, 1.0::double / n from nodes, nn union all
          select step + 1, nodes.id, any_value(0.15::double / n) + coalesce(sum(0.85::double * rank / c), 0) from nodes cross join nn cross join (select max(step) step from r) s left join (select target_doc_id, r.rank, c from r join kept on r.id = source_doc_id join outs using (source_doc_id)) x on target_doc_id = nodes.id where step < 20 group by step, nodes.id)
      select id doc_id, round(rank, 12) pagerank from r where step = 20""",
    "simhash_fingerprints": SIMHASH,
    "url_normalize": f"select page_id, url, {NORMAL} normal from pages",
    "registrable_domain": f"select page_id, {DOMAIN} as domain from pages",
    "page_status_routing": f"with {ROUTES} select page_id, status from routed",
    "quality_freshness": f"""with {WEB}, w as (select id, word_count, case when id % 5 = 0 then null else timestamp '2024-01-01' + to_days((id % 700)::int) end u, case when id % 10 = 0 then timestamp '2025-01-01' end p, id % 50 links from web)
      select id, word_count::int word_count, round(case when word_count = 0 then 0 else greatest(0, least(1, word_count / 300.0::double) - least(0.4, links / word_count::double)) end, 9) quality,
        round(case when coalesce(u, p) is null then 0.1 else greatest(0, 1 - least(365, floor(epoch({AS_OF_SQL} - coalesce(u, p)) / 86400)) / 365.0::double) end, 9) freshness from w""",
    "queue_enqueue": f"with {QUEUE} select url, domain, 'queued' status, 0 attempt_count from queue",
    "queue_status_counts": f"""with {QUEUE}, {ROUTES}, s as (select {NORMAL} url, max(status) status from routed group by 1) select status, count(*) n, count(*) attempts from queue join s using (url) group by status""",
    "rate_limit_slots": f"""with e as (select event_id id, user_id, epoch(date_trunc('second', ts))::double "at", row_number() over w - 1 i from (select * from events) window w as (partition by user_id order by date_trunc('second', ts), event_id))
      select id, user_id, "at", i * {q.GAP} + max("at" - i * {q.GAP}) over (partition by user_id order by i) slot from e""",
    "feeds_due": f"with {FEEDS} select feed_url, next_fetch_at, last_fetched from feeds where next_fetch_at is null or next_fetch_at <= {AS_OF_SQL} order by next_fetch_at nulls first, last_fetched nulls first, feed_url limit 100",
    "shard_assignment": "select doc_id id, doc_id % 4 shard from documents",
    "upsert_documents": f"""with {WEB}, mx as (select max(id) m from web where id % 2 = 0), fresh as (select id, row_number() over (order by url) + m new_id from web, mx where id % 3 = 0 and id % 2 = 1)
      select case when id % 2 = 0 then id else new_id end id, url, url canonical_url, case when id % 3 = 0 then title else 'old ' || title end title, case when id % 6 = 0 then null else description end description, md5(content) content_md5,
        case when id % 3 <> 0 then timestamp '2024-01-01' end published_at, case when id % 3 = 0 then timestamp '2025-01-01' else timestamp '2024-01-02' end updated_at, case when id % 3 = 0 then 2 else 1 end word_count,
        case when id % 3 = 0 then 0.7 else 0.5 end::double quality_score, case when id % 3 = 0 then 0.1 else 0.5 end::double freshness_score, case when id % 3 = 0 then 'done' else status end status,
        case when id % 2 = 0 then timestamp '2023-12-31' else {AS_OF_SQL} end created_at from web left join fresh using (id) where id % 2 = 0 or id % 3 = 0""",
    "upsert_articles": f"""with {NEWS}, a as (select *, right(url, 1) r from articles)
      select url, case when r = '2' then 'other' else feed_url end feed_url, case when r in ('2', '4') then 'new ' || title else title end title, description, md5(content) content_md5, author,
        case when r = '2' then null else timestamp '2024-01-01' end published_at, case when r in ('2', '4', '6') then {AS_OF_SQL} else timestamp '2024-01-02' end updated_at from a""",
    "upsert_feeds": f"""with {FEEDS}, a as (select *, name <> 'src1' was, contains(name, '1') got from feeds)
      select feed_url, case when was and home_url is not null then home_url else 'https://home.' || name || '/' end home_url,
        case when got and name not like '%0' then name || ' news' when was then name end as name,
        case when got then 'https://l' end link, case when was then 'img' end image, 'https://page' discovered_by_url, case when got then timestamp '2025-05-05' end last_published,
        case when got then {AS_OF_SQL} when was then last_fetched end last_fetched, case when got then {AS_OF_SQL} + to_minutes(20) when was then next_fetch_at end next_fetch_at from a""",
    "backfill_content": f"""with {NEWS}, a as (select *, right(url, 1) in ('2', '6') gone, len(regexp_extract_all(content, '{WHITE}')) >= 120 long from articles)
      select url, md5(case when not gone or long then content when right(url, 1) = '2' then '' end) content_md5 from a""",
    "replace_news_tokens": f"""with {NEWS}, {NEWS_POSTINGS}, t as (select article_url, count(*) terms, sum(frequency)::bigint tokens from news_postings group by 1)
      select article_url, terms, tokens from t where not (article_url like '%4' and article_url not like '%44') union all select url, 2, 3 from articles where url like '%4' and url not like '%44'""",
    "rss_parse": f"""with {FEED_ITEMS} select 'https://f' || k || '.example.org/feed' feed_url, 'Feed ' || k as name, 'https://h' || k || '.example.org/home' link, max(stamp) over (partition by k) last_published,
        'https://f' || k || '.example.org/item/' || doc_id url, md5({_TITLE}) title_md5, 'No ' || doc_id || ' & on' description, author, stamp published_at from ok
      union all select 'https://f' || k || '.example.org/feed', '', '', null, null, null, null, null, null from (select distinct k from fi where k % 17 = 3)""",
    "rfc2822_dates": "select event_id, case when event_id % 4 < 3 then date_trunc('second', ts)::timestamp end \"at\" from events",
    "feed_times": f"with {FEEDS} select feed_url, strftime(last_fetched, '%Y-%m-%dT%H:%M:%S+00:00') last_fetched, strftime(next_fetch_at, '%Y-%m-%dT%H:%M:%S+00:00') next_fetch_at from feeds",
    "replace_web_tokens": f"""with {WEB}, {POSTINGS} select doc_id, count(*) terms, sum(frequency)::bigint tokens from postings where doc_id % 3 <> 0 group by doc_id
      union all select id, 2, 3 from web where id % 6 = 0""",
    "replace_links": f"with {WEB}, {OUTGOING} select source_doc_id, target_url from outgoing where source_doc_id % 3 <> 0 union all select id, 'https://new.example.org/' from web where id % 6 = 0",
    "authority_upsert": f"""with {WEB}, {OUTGOING}, n as (select target_doc_id, count(*) c from edges where source_doc_id % 2 = 0 and target_doc_id % 2 = 0 group by 1)
      select id doc_id, case when id % 2 = 0 then 0.25 else 0.5 end::double pagerank, case when id % 2 = 0 then coalesce(c, 0) else 7 end::int inlink_count from web left join n on target_doc_id = id""",
    "page_parse_title_links": f"""with {FETCHED_HTML}, {ANCHORS} select page_id, trim({_PLAIN("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) title, case when own then 'Page ' || page_id || ' & more' else '' end description, coalesce(n, 0)::int n_links,
        case when own then ('2024-0' || (1 + page_id % 9) || '-05 04:07:08')::timestamp end published_at, null::timestamp updated_at from fh left join (select page_id, count(*) n from anchors group by 1) using (page_id)""",
    "page_links": f"with {FETCHED_HTML}, {ANCHORS} select page_id, (row_number() over (partition by page_id order by first) - 1)::int \"at\", link from anchors",
    "page_feed_links": f"with {FETCHED_HTML} select page_id, lower(regexp_extract(url, '^[A-Za-z]+')) || '://' || {_HOST} || '/feed' || page_id || '.xml' feed_url from fh where own",
    "page_content": f"with {FETCHED_HTML} select page_id, md5(regexp_replace({_MAIN}, '\\s', '', 'g')) content_md5 from fh",
    "format_text_results": f"""with {_candidates(10, 10)}, r as (select url, title, description, round({_intent(_PHRASE, _WORDS, _TOTAL)}, 6) score, {_intent(_PHRASE, _WORDS, _TOTAL)} full_score from cand order by full_score desc, url limit 10 offset 10)
      select regexp_replace(string_agg('[' || r.url || '](' || r.title || ')' || chr(10) || r.description || chr(10) || chr(10), '' order by score desc, r.url), '^\\s+|\\s+$', '', 'g') as text from r""",
    "migration_token_backfill": f"""with {WEB}, {NEWS}, {POSTINGS}, {NEWS_POSTINGS}
      select 1 source_type, field, count(*) n, sum(frequency)::bigint tokens, count(*) with_doc from postings group by field union all select 2, 4, count(*), sum(frequency)::bigint, 0 from news_postings""",
    "migration_downgrade": f"with {NEWS}, {NEWS_POSTINGS} select article_url, count(*) terms, sum(frequency)::bigint tokens from news_postings group by 1",
    "image_base64": "select page_id, md5(case when page_id % 9 = 0 then '' else base64(encode(coalesce(html, ''))) end) image_md5 from pages",
}
ORACLES["token_statistics"] = ORACLES["term_statistics"]
