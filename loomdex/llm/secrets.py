"""Multipart credential linking, with DataFrame functions only.

Six kinds of parts are found with their code-point spans. Three are reported wherever they stand;
the weak ones (a bare 40-character key, an account name, an endpoint) only if a complementary part
lies within the same scope. The interval join of parts and scopes is a sweep: a window over a
text's parts in order carries the nearest complementary end before and start after each of them,
so work is linear in parts and no pairs are made. A weak part is reported beside a strong one only,
so one search for the shortest strong part tells which texts are looked at at all.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, written

_kw = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
_ASSIGN = "|".join(_kw(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_USER = "|".join(_kw(x) for x in ("username", "user", "login", "account", "client_?id"))
_SCHEME = "|".join(("https?", "ftp", "s3", "postgres", "mysql", "redis", "mongodb", "amqp"))

#: kind: (pattern, pattern of the head before the value or None, least characters of the value or match, most or None).
KINDS = {
    "assign": (rf"""(?:{_ASSIGN})["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]+""", rf"""^(?:{_ASSIGN})["\x27]?\x20*[:=]\x20*["\x27]?""", 6, None),
    "access": (r"AKIA[A-Z0-9]{16,}", None, 20, None),
    "hex": (r"[0-9a-f]{24,}", None, 24, None),
    "key40": (r"[A-Za-z0-9/+]{40,}", None, 40, 40),
    "user": (rf"""(?:{_USER})["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9._@-]+""", rf"""^(?:{_USER})["\x27]?\x20*[:=]\x20*["\x27]?""", 3, None),
    "endpoint": (rf"(?:{_SCHEME})://[A-Za-z0-9._~:@/?#=&%+-]+", None, 10, None),
}
STRONG = ("assign", "access", "hex")
#: What a weak part must have within its scope.
COMPLEMENT = {"key40": ("access",), "user": ("assign", "access"), "endpoint": ("assign", "access")}
#: Words of which a text with an assignment holds one, in whatever case; searched for before any pattern.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Code points between a weak part and its complement.
SCOPE = 200
#: Reported spans up to which they are sent to all executors to rewrite texts; more are joined by a shuffle.
SENT_SPANS = 500_000
MARK = "[SECRET]"
_BLOCK = 64
_CHARS = 1024


def _parts(text: Column, kind: str) -> tuple[Column, Column]:
    """Matches and the gaps around them; the gaps are only cut where there is a match."""
    pattern = KINDS[kind][0]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _spans(df: DataFrame, kind: str) -> DataFrame:
    """Adds an array of (ord, kind, start, end) as s_<kind>. Prefix sums of gap and match lengths go in blocks, so many matches stay cheap."""
    _, head, least, most = KINDS[kind]
    m, g = _parts(F.col("text"), kind)
    df = df.withColumn("_m", m)
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", KINDS[kind][0], -1)))
    df = df.withColumn("_n", F.size("_m"))
    df = df.withColumn("_t", F.expr("transform(_m, (x, i) -> cast(length(x) + length(_g[i]) as long))"))
    df = df.withColumn("_b", F.expr(f"transform(sequence(0, greatest(_n - 1, 0) div {_BLOCK}), b -> aggregate(slice(_t, cast(b * {_BLOCK} + 1 as int), {_BLOCK}), 0L, (a, x) -> a + x))"))
    df = df.withColumn("_p", F.expr("aggregate(_b, array(0L), (a, x) -> concat(a, array(a[size(a) - 1] + x)))"))
    value = f"length(regexp_replace(x, r'{head}', ''))" if head else "length(x)"
    start = f"(_p[cast(i div {_BLOCK} as int)] + aggregate(slice(_t, cast(i div {_BLOCK} * {_BLOCK} + 1 as int), i % {_BLOCK}), 0L, (a, y) -> a + y) + length(_g[i]))"
    ok = f"{value} >= {least}" + (f" and {value} <= {most}" if most else "")
    order = list(KINDS).index(kind)
    spans = f"filter(transform(_m, (x, i) -> named_struct('ok', {ok}, 'start', {start}, 'ord', {order}, 'end', {start} + length(x))), s -> s.ok)"
    return df.withColumn(f"s_{kind}", F.expr(f"case when _n > 0 then {spans} else array() end")).drop("_m", "_g", "_n", "_t", "_b", "_p")


def _with_spans(docs: DataFrame) -> DataFrame:
    for kind in KINDS:
        docs = _spans(docs, kind)
    return docs


def _keyed(df: DataFrame) -> DataFrame:
    """Adds h1 and h2, which name a row's id and text: keys from the row itself are the same however often a task runs."""
    return df.withColumns({"h1": F.xxhash64("_id", "text"), "h2": F.xxhash64("text", "_id", F.lit(1))})


def _hint(text: Column) -> Column:
    """Whether a text may hold a strong part: plain searches for most texts."""
    low = F.lower(text)
    word = reduce(or_, (low.contains(w) for w in WORDS))
    return F.coalesce((word & text.rlike(KINDS["assign"][0])) | text.contains("AKIA") | text.rlike("[0-9a-f]{24}"), F.lit(False))


def _found(rows: DataFrame) -> DataFrame:
    """(_id, h1, h2, text) of every row (_id, text), the text null where it can't hold a strong part. Written: one search through
    all texts, and what follows reads the few that are left."""
    return written(_keyed(rows).select("_id", "h1", "h2", F.when(_hint(F.col("text")), F.col("text")).alias("text")))


def _linked(found: DataFrame) -> DataFrame:
    """(h1, h2, ord, start, end, shown) of every part of the texts in found that hold a strong one; rows that repeat id and
    text count once. shown: strong, or linked and in no reported part."""
    spans = _with_spans(found.filter("text is not null").select("h1", "h2", "text").dropDuplicates(["h1", "h2"]))
    strong = " or ".join(f"size(s_{k}) > 0" for k in STRONG)  # not a filter: pushed below the spans, it would make them anew for each part
    every = F.expr(f"case when {strong} then concat({', '.join(f's_{k}' for k in KINDS)}) else array() end")
    parts = spans.select("h1", "h2", F.explode(every).alias("s")).select("h1", "h2", "s.start", "s.ord", "s.end")
    names = list(KINDS)
    order = Window.partitionBy("h1", "h2").orderBy("start", "ord")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    is_ = lambda kinds: F.col("ord").isin([names.index(k) for k in kinds])
    near = lambda kinds: (F.col("start") - F.max(F.when(is_(kinds), F.col("end"))).over(before) <= SCOPE) | (F.min(F.when(is_(kinds), F.col("start"))).over(after) - F.col("end") <= SCOPE)
    held = F.coalesce(F.max(F.when(is_(("assign", "hex")), F.col("end"))).over(before) >= F.col("end"), F.lit(False))  # inside a reported part
    shown = is_(STRONG)
    for kinds in sorted(set(COMPLEMENT.values())):
        shown = shown | (is_([k for k, v in COMPLEMENT.items() if v == kinds]) & F.coalesce(near(kinds), F.lit(False)) & ~held)
    return parts.withColumn("shown", shown)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, and all reported spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text is empty: counts 0,
    the digest of the empty string, spans ''. Repeated rows give a row each, parts that start together are ordered by
    kind, an empty table gives no rows, other columns are ignored. A text's parts are swept in one task, in time linear
    in them; texts are searched whole.
    """
    rows = _found(docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    parts = _linked(rows)
    names = list(KINDS)
    label = F.concat_ws(":", F.element_at(F.array(*map(F.lit, names)), F.col("ord") + 1), "start", "end")
    found = parts.groupBy("h1", "h2").agg(
        *(F.count(F.when(F.col("ord") == names.index(k), 1)).alias(f"n_{k}") for k in STRONG),
        F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("start", "ord", label.alias("label"))))).alias("found"),
    )
    with_parts = rows.filter("text is not null").select("_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    none = F.array().cast(found.schema["found"].dataType)
    every = with_parts.select("_id", *(f"n_{k}" for k in STRONG), "found").unionByName(rows.filter("text is null").select("_id", *(F.lit(None).cast("long").alias(f"n_{k}") for k in STRONG), none.alias("found")))
    join = lambda which: F.array_join(F.transform(which, lambda s: s["label"]), ",")
    shown = F.coalesce("found", none)
    return every.select(
        F.col("_id").alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in STRONG),
        F.sha2(join(F.filter(shown, lambda s: s["ord"] < len(STRONG))), 256).alias("base_sha256"),
        join(shown).alias("spans"),
    )


def _piece(start: str, end: str) -> str:
    """SQL of a text's code points from start to end, out of its blocks `b`: work is that of the piece and two blocks."""
    i, j = f"cast({start} div {_CHARS} as int)", f"cast({end} div {_CHARS} as int)"
    at, to = f"cast({start} % {_CHARS} as int)", f"cast({end} % {_CHARS} as int)"
    return f"""case when {i} >= size(b) then '' when {i} = {j} then substring(b[{i}], {at} + 1, {to} - {at})
        else concat(substring(b[{i}], {at} + 1), array_join(slice(b, {i} + 2, {j} - {i} - 1), ''), case when {j} < size(b) then substring(b[{j}], 1, {to}) else '' end) end"""


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every reported span (overlapping ones as one) replaced by MARK; all columns and rows stay, and n_chars, if
    there is one, follows the text.

    Texts are shuffled only where the spans are more than SENT_SPANS, and then those alone that may hold a strong part. A null text stays null, as does an empty one; repeated rows are
    rewritten alike; an empty table stays empty. Work is linear in a text's length and in its secrets.
    """
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    at = _found(rows.select("_id", "text"))
    order = Window.partitionBy("h1", "h2").orderBy("start", "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = _linked(at).filter("shown").withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    runs = parts.withColumn("run", F.sum("fresh").over(order)).groupBy("h1", "h2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = written(runs.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found")))
    drop(at)
    keyed, clean = _keyed(rows), None
    if (found.agg(F.sum(F.size("found")).alias("n")).first()["n"] or 0) <= SENT_SPANS:
        found = F.broadcast(found)
    else:
        hinted = keyed.withColumn("hint", _hint(F.col("text")))
        keyed, clean = hinted.filter("hint"), hinted.filter("not hint").select("row.*")
    both = keyed.select("row", "text", "h1", "h2").join(found, ["h1", "h2"], "left")
    both = both.withColumn("b", F.when(F.col("found").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))))
    after = "found[size(found) - 1].end"
    new = F.expr(f"""case when found is null then text else concat(array_join(transform(found, (s, i) -> concat({_piece("case when i = 0 then 0L else found[i - 1].end end", "s.start")}, '{MARK}')), ''),
        {_piece(after, f"cast(size(b) as long) * {_CHARS}")}) end""")
    both = both.withColumn("new", new)
    fresh = {text_col: F.col("new")} | ({"n_chars": F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    done = both.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in cols))
    return done if clean is None else clean.unionByName(done)


def oracle(table: str = "documents") -> str:
    """The same rows as DuckDB SQL."""
    names = list(KINDS)
    lists = []
    for o, (kind, (pattern, head, least, most)) in enumerate(KINDS.items()):
        p, h = pattern.replace("'", "''"), (head or "").replace("'", "''")
        value = f"length(regexp_replace(x, '{h}', ''))" if head else "length(x)"
        lists.append(f"""select rid, {o} ord, start, start + length(x) as "end" from (
          select rid, x, {value} v, (sum(length(g) + length(x)) over (partition by rid order by i) - length(x))::bigint start from (
            select rid, unnest(ms) x, unnest(gs[1:len(ms)]) g, generate_subscripts(ms, 1) i from (
              select rid, regexp_extract_all(text, '{p}') ms, string_split_regex(text, '{p}') gs from d) where len(ms) > 0))
          where v >= {least} {f'and v <= {most}' if most else ''}""")
    idx = lambda kinds: "(" + ", ".join(str(names.index(k)) for k in kinds) + ")"
    near = lambda kinds: f"""(start - max(case when ord in {idx(kinds)} then "end" end) over b <= {SCOPE} or min(case when ord in {idx(kinds)} then start end) over a - "end" <= {SCOPE})"""
    weak = " or ".join(f"ord in {idx([k for k, v in COMPLEMENT.items() if v == kinds])} and coalesce({near(kinds)}, false)" for kinds in sorted(set(COMPLEMENT.values())))
    return f"""
    with d as (select row_number() over () rid, doc_id, coalesce(text, '') text from {table})
    , p as ({" union all ".join(lists)})
    , s as (select *, ord in {idx(STRONG)} or (({weak}) and not coalesce(max(case when ord in {idx(("assign", "hex"))} then "end" end) over b >= "end", false)) shown from p
        window b as (partition by rid order by start, ord rows between unbounded preceding and 1 preceding), a as (partition by rid order by start, ord rows between 1 following and unbounded following))
    , l as (select rid, ord, shown, start, ([{", ".join(f"'{k}'" for k in names)}])[ord + 1] || ':' || start || ':' || "end" lab from s)
    , g as (select rid, {", ".join(f"count(*) filter (where ord = {names.index(k)}) n_{k}" for k in STRONG)},
        coalesce(string_agg(lab, ',' order by start, ord) filter (where ord < {len(STRONG)}), '') base, coalesce(string_agg(lab, ',' order by start, ord) filter (where shown), '') spans from l group by rid)
    select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g using (rid)
    """
