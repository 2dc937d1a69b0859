"""Secret scan: certain patterns, and weak candidates that count only beside their complementary parts.

Everything is a DataFrame function on the row. Each kind is looked for only in texts that pass a cheap test which every
match passes, and weak kinds only where what they'd be linked to is found. Places are running sums of the lengths of
matches and of what lies between. Identifiers, secrets and endpoints of one text are joined on their intervals by one sweep:
all interval starts and ends are sorted, and a running maximum tells for each part how far the other parts that start
before its end reach. Running sums and maxima multiply their reach in each step, so the work for n spans is n log n. A scope
never leaves its text, so nothing is shuffled and no key can be hot.

Defined results: null or empty text has no spans; repeated rows are scanned alike and all returned; an empty table gives
an empty result; other columns, whatever their names, are passed through by ``redact`` and ignored by ``scan``;
``find_spans`` replaces those that have the names of the columns it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Base patterns; ``keep`` is the test that a match has to pass (m: the match, v: the value of an assignment).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy, so asking for the least length at once finds the runs that pass it, and no others.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: an identifier, a secret and an endpoint. Alone they're ordinary text.
WEAK_ID = r"(?:client|account|tenant|user|access)_?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
#: Maximal runs; one counts if it mixes all of MIXED.
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{20,}"
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5})"
#: Most code points between two parts of one credential.
SCOPE = 200

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("ident", "secret", "endpoint")
SPAN = "array<struct<s:bigint,e:bigint>>"
NO_SPANS = f"cast(array() as {SPAN})"
#: Running sums and maxima reach over RADIX ** SCAN_STEPS (10 ** 9) spans of a text, more than a string can hold.
RADIX, SCAN_STEPS = 8, 10
#: What each match holds: keys of assignments and identifiers end in these letters; runs are long; endpoints have a colon.
ASSIGN_HINT = r"[DdTtNnYy][\"']?\x20*[:=]"
RUN_HINT = r"[A-Za-z0-9+/_=-]{20}"
ID_HINT = r"[de][\"']?\x20*[:=]"
ENDPOINT_HINT = r"://|:[0-9]{2}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str, kind: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``; kind: type of the result."""
    return f"aggregate(array({value}), cast(null as {kind}), (unused_{name}, {name}) -> {body})"


def _running(values: str, fold: str) -> str:
    """SQL for the array of the sums (fold: sum) or maxima (greatest) of all values up to here."""
    out, kind = "r", "array<bigint>"
    for k in reversed(range(SCAN_STEPS)):
        reach = RADIX**k
        before = [f"get(r, i - {reach * j})" for j in range(1, RADIX)]
        joined = " + ".join(["a", *[f"coalesce({x}, 0L)" for x in before]]) if fold == "sum" else f"greatest(a, {', '.join(before)})"
        out = _let("r", f"if(size(r) > {reach}, transform(r, (a, i) -> {joined}), r)", out, kind)
    return _let("r", values, out, kind)


def _spans(text: str, pattern: str, hint: str, group: int = 0, least: int = 0, holds: tuple[str, ...] = ()) -> str:
    """SQL for the (start, end) of each match in code points, of those whose ``group`` has ``least`` characters and all of ``holds``.

    The pieces between matches and the matches alternate, so a running sum of their lengths gives places.
    """
    p = _quoted(pattern)
    value = f"regexp_extract_all({text}, {p}, {group})" if group else "m"
    keep = "".join(f" and get(v, k) rlike '{h}'" for h in holds)
    spans = f"""filter(transform(m, (x, k) -> if(length(get(v, k)) >= {least}{keep}, named_struct('s', get(t, k) - length(x), 'e', get(t, k)), null)), x -> x is not null)"""
    total = _running(f"transform(zip_with(m, slice(split({text}, {p}, -1), 1, size(m)), (x, y) -> cast(length(x) + length(y) as bigint)), x -> x)", "sum")
    walk = _let("m", f"regexp_extract_all({text}, {p}, 0)", f"if(size(m) = 0, {NO_SPANS}, {_let('v', value, _let('t', total, spans, SPAN), SPAN)})", SPAN)
    return f"if({hint}, {walk}, {NO_SPANS})"


def _meeting(part: str, other: str, scope: int, keep: bool = True) -> str:
    """SQL for those of the spans ``part`` that lie within ``scope`` of one of ``other`` (or, not ``keep``, of none). Scope -1 asks
    for a common character.

    Sorted are the starts of ``other`` and the last place at which a start is near enough to a span of ``part``, ``other`` first;
    up to there the farthest end decides.
    """
    starts = f"transform({other}, y -> named_struct('at', y.s, 'q', 0, 's', 0L, 'e', y.e))"
    asks = f"transform({part}, x -> named_struct('at', x.e + {scope}, 'q', 1, 's', x.s, 'e', x.e))"
    far = _running("transform(ev, v -> if(v.q = 0, v.e, -9000000000000L))", "greatest")
    test = f"get(far, k) {'>=' if keep else '<'} v.s - {scope}"
    found = f"filter(transform(ev, (v, k) -> if(v.q = 1 and {test}, named_struct('s', v.s, 'e', v.e), null)), x -> x is not null)"
    swept = _let("ev", f"sort_array(concat({starts}, {asks}))", _let("far", far, found, SPAN), SPAN)
    alone = NO_SPANS if keep else part
    return f"if(size({part}) = 0 or size({other}) = 0, {alone}, {swept})"


def _tagged(columns: dict[str, str]) -> Column:
    """All spans of the columns (kind: column) as kind:start:end, by start, then kind as listed, comma-joined."""
    all_ = [F.expr(f"transform({c}, x -> named_struct('s', x.s, 'k', {i}, 't', concat('{k}:', x.s, ':', x.e)))") for i, (k, c) in enumerate(columns.items())]
    return F.array_join(F.transform(F.sort_array(F.concat(*all_)), lambda x: x["t"]), ",")


def _with_spans(docs: DataFrame, text_col: str, names: dict[str, str], scope: int) -> DataFrame:
    """``docs`` with a column of spans for each kind, under the given names, which no column of ``docs`` has."""
    t, i, k, e, c, base = scratch(docs.select("*", *[F.lit(0).alias(n) for n in names.values()]), "t", "i", "k", "e", "c", "base")
    columns = [f"`{x}`" for x in docs.columns]
    n = {kind: f"`{x}`" for kind, x in names.items()}
    rlike = lambda hint: f"`{t}` rlike {_quoted(hint)}"
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.selectExpr("*", f"{rlike(RUN_HINT)} as `{base}`")
    run = f"`{base}`"
    df = df.selectExpr(
        "*",
        f"{_spans(f'`{t}`', ASSIGN, rlike(ASSIGN_HINT), 2, 6)} as {n['assign']}",
        f"{_spans(f'`{t}`', ACCESS, f'{run} and contains(`{t}`, {chr(39)}AKIA{chr(39)})')} as {n['access']}",
        f"{_spans(f'`{t}`', HEX, run)} as {n['hex']}",
        f"{_spans(f'`{t}`', WEAK_SECRET, run, holds=MIXED)} as `{k}`",
    )
    # weak identifiers and endpoints count only beside a secret, so only texts with one are searched for them
    keyed = f"(size(`{k}`) > 0 or size({n['assign']}) > 0 or size({n['hex']}) > 0)"
    df = df.selectExpr(
        "*",
        f"concat({n['assign']}, {n['access']}, {n['hex']}) as `{c}`",
        f"{_spans(f'`{t}`', WEAK_ID, f'{keyed} and {rlike(ID_HINT)}')} as `{i}`",
        f"{_spans(f'`{t}`', ENDPOINT, f'{keyed} and {rlike(ENDPOINT_HINT)}')} as `{e}`",
    )
    free = {x: _meeting(f"`{x}`", f"`{c}`", -1, keep=False) for x in (i, e)}
    inside = f"concat(`{c}`, `{e}`)"
    df = df.selectExpr(*columns, *[n[x] for x in BASE_KINDS], f"{free[i]} as `{i}`", f"{_meeting(f'`{k}`', inside, -1, keep=False)} as `{k}`", f"{free[e]} as `{e}`")
    ids, keys = f"concat(`{i}`, {n['access']})", f"concat(`{k}`, {n['assign']}, {n['hex']})"
    df = df.selectExpr(*columns, *[n[x] for x in BASE_KINDS], f"`{i}`", f"`{k}`", f"{ids} as `{t}`", f"{keys} as `{c}`", f"{_meeting(f'`{e}`', ids, scope)} as `{e}`")
    linked = {"ident": _meeting(f"`{i}`", f"`{c}`", scope), "secret": _meeting(f"`{k}`", f"`{t}`", scope), "endpoint": _meeting(f"`{e}`", f"`{c}`", scope)}
    return df.selectExpr(*columns, *[n[x] for x in BASE_KINDS], *[f"{linked[x]} as {n[x]}" for x in WEAK_KINDS])


def find_spans(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Adds the array columns assign, access, hex (certain) and ident, secret, endpoint (weak, linked) to ``docs``.

    A weak secret is linked when an identifier (weak or an access key) lies within ``scope`` of it; a weak identifier when
    a secret (weak, assigned or hex) does; an endpoint when both do. A weak part that touches a certain span isn't a part.
    """
    kinds = (*BASE_KINDS, *WEAK_KINDS)
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in set(kinds) - {text_col.lower()}])
    return _with_spans(held, text_col, {k: k for k in kinds}, scope)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    df = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", scope)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = {k: k for k in BASE_KINDS}
    return df.select("doc_id", *counts, F.sha2(_tagged(base), 256).alias("base_sha256"), _tagged(base | {k: k for k in WEAK_KINDS}).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans are replaced as one. Null stays null."""
    kinds = (*BASE_KINDS, *WEAK_KINDS)
    *found, all_, far = scratch(docs, *kinds, "all", "far")
    df = _with_spans(docs, text_col, dict(zip(kinds, found, strict=True)), scope)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    df = df.select(*columns, F.sort_array(F.concat(*[F.col(f"`{c}`") for c in found])).alias(all_))
    df = df.select("*", F.expr(_running(f"transform(`{all_}`, x -> x.e)", "greatest")).alias(far))
    t, before = f"`{text_col}`", f"coalesce(get(`{far}`, k - 1), 0L)"
    # what lies between the spans before and one that begins behind all of them
    pieces = f"filter(transform(`{all_}`, (x, k) -> if(x.s >= {before}, substring({t}, cast({before} + 1 as int), cast(x.s - {before} as int)), null)), x -> x is not null)"
    tail = f"substring({t}, cast(get(`{far}`, size(`{far}`) - 1) + 1 as int))"
    out = F.expr(f"if(size(`{all_}`) = 0, {t}, concat(array_join({pieces}, {_quoted(mark)}), {_quoted(mark)}, {tail}))")
    return df.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars set to the new length."""
    out = redact(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _sql_spans(pattern: str, group: int = 0, least: int = 0, holds: tuple[str, ...] = ()) -> str:
    p = pattern.replace("'", "''")
    m, b = f"regexp_extract_all(t, '{p}', 0)", f"string_split_regex(t, '{p}')"
    lens = lambda x: f"list_transform({x}, lambda v: length(v))"
    at = f"list_transform(range(1, len({m}) + 1), lambda k: struct_pack(s := CAST(list_sum({lens(b)}[1:k]) + coalesce(list_sum({lens(m)}[1:k - 1]), 0) AS BIGINT), e := CAST(list_sum({lens(b)}[1:k]) + list_sum({lens(m)}[1:k]) AS BIGINT), v := regexp_extract_all(t, '{p}', {group})[k]))"
    return f"list_filter({at}, lambda x: length(x.v) >= {least}{''.join(f" AND regexp_matches(x.v, '{h}')" for h in holds)})"


def _sql_tags(kinds: tuple[str, ...]) -> str:
    all_ = " || ".join(f"list_transform({k}, lambda x: struct_pack(s := x.s, k := {i}, t := '{k}:' || x.s || ':' || x.e))" for i, k in enumerate(kinds))
    return f"coalesce(array_to_string(list_transform(list_sort({all_}), lambda x: x.t), ','), '')"


def _sql_linked(part: str, *others: str) -> str:
    near = "".join(f" AND len(list_filter({o}, lambda y: x.s - y.e <= {SCOPE} AND y.s - x.e <= {SCOPE})) > 0" for o in others)
    return f"list_filter({part}, lambda x: true{near})"


def scan_sql(docs: str) -> str:
    """DuckDB statement with the rows of ``scan`` over the relation ``docs``; its CTE ``linked`` also has the spans."""
    free = "list_filter({0}, lambda x: len(list_filter({1}, lambda y: y.s < x.e AND x.s < y.e)) = 0)"
    return f"""
WITH base AS (
  SELECT doc_id, t, {_sql_spans(ASSIGN, 2, 6)} AS assign, {_sql_spans(ACCESS)} AS access, {_sql_spans(HEX)} AS hex,
    {_sql_spans(WEAK_ID)} AS i0, {_sql_spans(WEAK_SECRET, holds=MIXED)} AS k0, {_sql_spans(ENDPOINT)} AS e0
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM {docs})
), free AS (
  SELECT *, {free.format("i0", "assign || access || hex")} AS i1, {free.format("k0", "assign || access || hex || e0")} AS k1, {free.format("e0", "assign || access || hex")} AS e1 FROM base
), linked AS (
  SELECT *, {_sql_linked("i1", "(k1 || assign || hex)")} AS ident, {_sql_linked("k1", "(i1 || access)")} AS secret,
    {_sql_linked("e1", "(i1 || access)", "(k1 || assign || hex)")} AS endpoint FROM free
)
SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex,
  sha256({_sql_tags(BASE_KINDS)}) AS base_sha256, {_sql_tags(BASE_KINDS + WEAK_KINDS)} AS spans FROM linked
"""


OP7_SQL = scan_sql("documents")
