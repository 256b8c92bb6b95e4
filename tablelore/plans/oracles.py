"""The same answers in plain SQL over the raw tables, for checking."""

from __future__ import annotations

from .star import STAR
from .workload import ENTRIES, KNOWN_KEYS, LOSS_EDGES, PHANTOMS, RUN_SQL, ZONED

# column -> (type as Spark names it, kind); the order is the table's column order
_N, _D, _T, _S = ("bigint", "numeric"), ("double", "numeric"), ("timestamp_ntz", "date"), ("string", "text")
_I = ("int", "numeric")
RAW_COLUMNS = {
    "region": {"r_regionkey": _I, "r_name": _S},
    "nation": {"n_nationkey": _I, "n_name": _S, "n_regionkey": _I},
    "customer": {"c_custkey": _N, "c_name": _S, "c_nationkey": _I, "c_acctbal": _D, "c_mktsegment": _S},
    "supplier": {"s_suppkey": _N, "s_name": _S, "s_nationkey": _I, "s_acctbal": _D},
    "part": {"p_partkey": _N, "p_name": _S, "p_brand": _S, "p_type": _S, "p_size": _I, "p_retailprice": _D},
    "orders": {"o_orderkey": _N, "o_custkey": _N, "o_orderstatus": _S, "o_totalprice": _D,
               "o_orderdate": _T, "o_orderpriority": _S},
    "lineitem": {"l_orderkey": _N, "l_partkey": _N, "l_suppkey": _N, "l_linenumber": _I, "l_quantity": _D,
                 "l_extendedprice": _D, "l_discount": _D, "l_tax": _D, "l_returnflag": _S,
                 "l_linestatus": _S, "l_shipdate": _T},
    "events": {"event_id": _N, "ts": _T, "user_id": _N, "event_type": _S, "value": _D, "props": _S},
    "documents": {"doc_id": _N, "text": _S, "lang": _S, "source": _S, "n_chars": _N},
    "embeddings": {"vec_id": _N, "embedding": ("array<float>", "other"), "label": _I},
    "pages": {"page_id": _N, "url": _S, "html": _S},
    "benchmark": {"item_id": _N, "text": _S},
    "labels": {"doc_id": _N, "quality": _I, "toxic": _I},
    "conversations": {"conv_id": _N, "turn": _N, "role": _S, "text": _S},
}
NULLS = (
    "(SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, "
    "o_orderstatus = 'O' AS is_open FROM orders)"
)
NULLS_COLUMNS = {"o_orderkey": _N, "o_orderpriority": _S, "is_open": ("boolean", "boolean")}


def _profiled():
    """(table, source, column, type, kind) of every profiled raw column."""
    for table, columns in RAW_COLUMNS.items():
        for column, (kind_type, kind) in columns.items():
            yield table, table, column, kind_type, kind
    for column, (kind_type, kind) in NULLS_COLUMNS.items():
        yield "orders_nulls", NULLS, column, kind_type, kind


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _per_column(expressions: str, keep=lambda kind: True, raw_only: bool = False) -> str:
    """One SELECT per column; ``{c}`` and ``{kind}`` stand for the column and its kind."""
    return _union(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
        + expressions.format(c=f'"{column}"', kind=kind)
        + f" FROM {source}"
        for table, source, column, _, kind in _profiled()
        if keep(kind) and not (raw_only and table == "orders_nulls")
    )


# --- naming rules ---------------------------------------------------------------


def _tokens(x: str) -> str:
    spaced = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"[lower(w) FOR w IN string_split_regex({spaced}, '[^a-zA-Z0-9]+') IF w <> '']"


def _singular(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(CASE WHEN {low} LIKE '%ies' AND length({x}) > 3 THEN left({low}, length({x}) - 3) || 'y' "
        f"WHEN {low} LIKE '%ses' AND length({x}) > 3 THEN left({low}, length({x}) - 2) "
        f"WHEN {low} LIKE '%s' AND {low} NOT LIKE '%ss' AND length({x}) > 1 THEN left({low}, length({x}) - 1) "
        f"ELSE {low} END)"
    )


def _pascal(x: str) -> str:
    return f"array_to_string([upper(t[1]) || t[2:] FOR t IN {_tokens(x)}], '')"


def _similarity(f: str, k: str, table: str) -> str:
    one = _singular(table)
    a, b = _tokens(f), _tokens(f"({table} || ' ' || {k})")
    shared = (
        f"(len(list_distinct(list_intersect({a}, {b})))::DOUBLE / "
        f"len(list_distinct(list_concat({a}, {b}))))"
    )
    return (
        f"CASE WHEN lower({f}) = {one} || '_' || lower({k}) THEN 1.0 "
        f"WHEN lower({f}) = lower({k}) AND lower({k}) <> 'id' THEN 1.0 "
        f"WHEN lower({f}) = {one} THEN 0.9 "
        f"WHEN list_contains({a}, {one}) THEN greatest({shared}, 0.7) ELSE {shared} END::DOUBLE"
    )


def _id_named(c: str) -> str:
    return f"(lower({c}) = 'id' OR lower({c}) LIKE '%\\_id' ESCAPE '\\')"


# --- discovery, written as one chain of common table expressions -------------------


def _star_cells():
    for position, view in enumerate(sorted(STAR)):
        source, names = STAR[view]
        for ordinal, (old, new) in enumerate(names.items()):
            kind_type, kind = RAW_COLUMNS[source][old]
            yield view, position, source, ordinal, old, new, kind_type, kind


def _raw_cells():
    for position, table in enumerate(sorted(RAW_COLUMNS)):
        for ordinal, (column, (kind_type, kind)) in enumerate(RAW_COLUMNS[table].items()):
            yield table, position, table, ordinal, column, column, kind_type, kind


def _transfer_cells():
    columns = {"id": _N, "from_customer_id": _N, "to_customer_id": _N, "amount": _D}
    names = STAR["customers"][1]
    for ordinal, (old, new) in enumerate(names.items()):
        yield ("customers", 0, "customer", ordinal, old, new, *RAW_COLUMNS["customer"][old])
    for ordinal, (name, (kind_type, kind)) in enumerate(columns.items()):
        yield "transfers", 1, TRANSFERS, ordinal, name, name, kind_type, kind


TRANSFERS = (
    "(SELECT o_orderkey AS id, o_custkey AS from_customer_id, "
    "(SELECT min(c_custkey) + max(c_custkey) FROM customer) - o_custkey AS to_customer_id, "
    "o_totalprice AS amount FROM orders)"
)


def _chain(cells) -> str:
    """``WITH`` prefix: cells, prof, cand, scored, accepted, best, edges."""
    body = _union(
        f"SELECT '{t}' AS t, {position} AS tp, '{new}' AS c, {ordinal} AS cp, '{kind_type}' AS ty, "
        f"'{kind}' AS k, CAST(\"{old}\" AS VARCHAR) AS v FROM {source}"
        for t, position, source, ordinal, old, new, kind_type, kind in cells
    )
    return f"""
WITH cells AS ({body}),
prof AS (
  SELECT t, tp, c, cp, ty, k, count(*) AS n, count(v) AS nn, count(DISTINCT v) AS d FROM cells
  GROUP BY t, tp, c, cp, ty, k
),
flags AS (SELECT *, n > 0 AND d = n AS uniq, n > 0 AND d = n AND nn = n AS iskey FROM prof),
pairs AS (
  SELECT f.t AS from_table, f.c AS from_column, k.t AS to_table, k.c AS to_column,
    f.ty AS fty, k.ty AS kty, f.k AS fk, k.k AS kk, f.uniq AS funiq, f.iskey AS fkey,
    row_number() OVER (ORDER BY k.tp, k.cp, f.tp, f.cp) AS seq,
    {_similarity('f.c', 'k.c', 'k.t')} AS name_similarity
  FROM flags f, flags k
  WHERE k.iskey AND f.t <> k.t
    AND (f.k = k.k OR (f.k IN ('numeric', 'text') AND k.k IN ('numeric', 'text')))
),
cand AS (
  SELECT *, CASE WHEN fty = kty THEN 1.0 WHEN fk = kk THEN 0.85 ELSE 0.4 END::DOUBLE AS type_match,
    CASE WHEN funiq THEN 0.8 ELSE 1.0 END::DOUBLE AS cardinality_shape,
    CASE WHEN funiq THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality
  FROM pairs
  WHERE name_similarity >= 0.15 AND (name_similarity >= 0.9 OR NOT fkey)
    AND (name_similarity >= 0.9 OR {_id_named('to_column')})
),
vals AS (SELECT DISTINCT t, c, v FROM cells WHERE v IS NOT NULL),
scored AS (
  SELECT *, coalesce(matched::DOUBLE / distinct_from, 0.0) AS value_overlap,
    floor((0.55 * coalesce(matched::DOUBLE / distinct_from, 0.0) + 0.25 * name_similarity
      + 0.10 * type_match + 0.10 * cardinality_shape) * 100 + 0.5)::INTEGER AS confidence
  FROM (
    SELECT cand.*, nullif(count(f.v), 0) AS distinct_from, count(g.v) AS matched
    FROM cand LEFT JOIN vals f ON f.t = from_table AND f.c = from_column
    LEFT JOIN vals g ON g.t = to_table AND g.c = to_column AND g.v = f.v
    GROUP BY ALL
  )
),
accepted AS (SELECT * FROM scored WHERE value_overlap >= 0.5 AND confidence >= 50),
best AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY from_table, from_column
        ORDER BY confidence DESC, name_similarity DESC, seq) AS place,
      min(seq) OVER (PARTITION BY from_table, from_column) AS seen
    FROM accepted) WHERE place = 1
),
edges AS ({_collapse('best')})
"""


def _collapse(source: str) -> str:
    return f"""
  SELECT * EXCLUDE (place, seen, first_seen),
    row_number() OVER (ORDER BY confidence DESC, first_seen) - 1 AS ordinal FROM (
    SELECT *, row_number() OVER (PARTITION BY ends ORDER BY confidence DESC, seen) AS place,
      min(seen) OVER (PARTITION BY ends) AS first_seen
    FROM (SELECT *, list_sort([from_table || '.' || from_column, to_table || '.' || to_column]) AS ends
          FROM {source})
  ) WHERE place = 1
"""


STAR_CHAIN = _chain(_star_cells())
RAW_CHAIN = _chain(_raw_cells())
E4 = "from_table, from_column, to_table, to_column"
KEY = "from_table || '.' || from_column || '->' || to_table || '.' || to_column"
EDGE_ROWS = (
    f"SELECT {E4}, ordinal, confidence, cardinality, round(value_overlap, 6) AS value_overlap, "
    "round(name_similarity, 6) AS name_similarity, type_match, cardinality_shape FROM edges"
)


# --- curation ----------------------------------------------------------------------

_REJECTED = ", ".join(f"'{key}'" for key in PHANTOMS)
_OVERRIDES = ", ".join(
    f"({i}, '{a}', '{b}', '{c}', '{d}')" for i, (a, b, c, d) in enumerate(KNOWN_KEYS)
)
CURATED_CHAIN = (
    RAW_CHAIN
    + f""",
overrides AS (SELECT * FROM (VALUES {_OVERRIDES}) AS o(nr, {E4})),
curated AS (
  SELECT {E4}, confidence, cardinality, row_number() OVER (ORDER BY added, nr) - 1 AS ordinal FROM (
    SELECT {E4}, confidence, cardinality, ordinal AS nr, 0 AS added FROM edges e
    WHERE {KEY} NOT IN ({_REJECTED})
      AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.from_table = e.from_table AND o.from_column = e.from_column
        AND o.to_table = e.to_table AND o.to_column = e.to_column)
    UNION ALL
    SELECT o.from_table, o.from_column, o.to_table, o.to_column, 100, 'many-to-one',
      coalesce(e.ordinal, o.nr), CASE WHEN e.ordinal IS NULL THEN 1 ELSE 0 END
    FROM overrides o LEFT JOIN edges e ON o.from_table = e.from_table AND o.from_column = e.from_column
        AND o.to_table = e.to_table AND o.to_column = e.to_column
  )
)
"""
)

_ARROW = "from_table || '.' || from_column || ' ↳ ' || to_table || '.' || to_column"

# --- semantic model ----------------------------------------------------------------


def _model(chain: str, edges: str = "edges", extra: str = "") -> str:
    """Adds names, keyc (key columns), topv, dims, meas to a discovery chain."""
    return (
        chain
        + f""",
tabs AS (SELECT DISTINCT t, tp FROM prof {extra}),
names AS (SELECT t, tp, {_pascal(_singular('t'))} AS entity FROM tabs),
keyc AS (
  SELECT from_table AS t, from_column AS c FROM {edges} UNION SELECT to_table, to_column FROM {edges}
  UNION SELECT t, c FROM prof WHERE {_id_named('c')}
),
topv AS (
  SELECT t, c, string_agg(v, '|' ORDER BY rn) AS listed FROM (
    SELECT t, c, v, row_number() OVER (PARTITION BY t, c ORDER BY count(*) DESC, v) AS rn
    FROM cells WHERE v IS NOT NULL AND k IN ('text', 'boolean') GROUP BY t, c, v) WHERE rn <= 25 GROUP BY t, c
),
free AS (SELECT p.* FROM prof p LEFT JOIN keyc USING (t, c) WHERE keyc.t IS NULL),
dims AS (
  SELECT f.t, f.tp, f.c, f.cp, f.c AS name, CASE WHEN k = 'date' THEN 'time' ELSE 'categorical' END AS kind,
    CASE WHEN k = 'date' THEN 'day' END AS grain,
    CASE WHEN k = 'boolean' OR (k <> 'date' AND d <= 25) THEN listed END AS listed
  FROM free f LEFT JOIN topv USING (t, c)
  WHERE k IN ('date', 'boolean') OR (k IN ('text', 'other') AND d <= 50 AND (n = 0 OR d <= n * 0.5))
),
rawm AS (
  SELECT t, tp, -1 AS cp, t || '_count' AS name, 'count' AS agg, NULL AS c FROM tabs
  UNION ALL SELECT t, tp, cp, 'sum_' || c, 'sum', c FROM free WHERE k = 'numeric'
),
meas AS (
  SELECT t, tp, cp, agg, c,
    CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN t || '_' || name ELSE name END AS name FROM rawm
),
linked AS (
  SELECT e.ordinal, e.cardinality, f.t AS ft, f.entity AS child, k.t AS kt, k.entity AS parent
  FROM {edges} e JOIN names f ON f.t = from_table JOIN names k ON k.t = to_table
),
parents AS (SELECT ft AS t, string_agg(parent, ', ' ORDER BY o) AS belongs_to FROM
  (SELECT ft, parent, min(ordinal) AS o FROM linked GROUP BY ft, parent) GROUP BY ft),
many AS (SELECT kt AS t, string_agg(child, ', ' ORDER BY o) AS has_many FROM
  (SELECT kt, child, min(ordinal) AS o FROM linked WHERE cardinality <> 'one-to-one' GROUP BY kt, child) GROUP BY kt),
one AS (SELECT kt AS t, string_agg(child, ', ' ORDER BY o) AS has_one FROM
  (SELECT kt, child, min(ordinal) AS o FROM linked WHERE cardinality = 'one-to-one' GROUP BY kt, child) GROUP BY kt)
"""
    )


STAR_MODEL = _model(STAR_CHAIN)
# the curated raw edges with the profile of all raw columns and the copy with nulls
RAW_MODEL = _model(
    CURATED_CHAIN.replace(
        "WITH cells AS (",
        "WITH cells AS (" + _union(
            f"SELECT 'orders_nulls' AS t, 9.5 AS tp, '{column}' AS c, {ordinal} AS cp, '{ty}' AS ty, "
            f"'{kind}' AS k, CAST(\"{column}\" AS VARCHAR) AS v FROM {NULLS}"
            for ordinal, (column, (ty, kind)) in enumerate(NULLS_COLUMNS.items())
        ) + "\nUNION ALL\n", 1,
    ).replace("FROM flags f, flags k\n  WHERE k.iskey", "FROM flags f, flags k\n  WHERE f.t <> 'orders_nulls' AND k.t <> 'orders_nulls' AND k.iskey", 1),
    "curated",
)

# --- terms -------------------------------------------------------------------------

def _terms(model: str) -> str:
    """Adds spoken (entity synonyms) and catalog (search terms) to a model chain."""
    return model + f""",
spoken AS (
  SELECT t, tp, entity, s, p FROM (
    SELECT t, tp, entity, unnest(syn) AS s, generate_subscripts(syn, 1) AS p FROM (
      SELECT t, tp, entity, list_distinct_ordered AS syn FROM (
        SELECT t, tp, entity, [x FOR x IN (CASE
            WHEN spaced IN (t, one) OR spaced = entity THEN (CASE WHEN t = one THEN [t] ELSE [t, one] END)
            ELSE (CASE WHEN t = one THEN [t, spaced] ELSE [t, one, spaced] END) END)
          IF x <> '' AND x <> entity] AS list_distinct_ordered
        FROM (SELECT t, tp, entity, {_singular('t')} AS one, array_to_string({_tokens('t')}, ' ') AS spaced FROM names))))
),
catalog AS (
  SELECT row_number() OVER (ORDER BY tp, section, item, pos) - 1 AS term_id, * FROM (
    SELECT tp, 0 AS section, -1 AS item, -1 AS pos, entity AS term, 'entity' AS kind, entity, t,
      NULL AS c, NULL AS metric, entity || ' ' || t AS text FROM names
    UNION ALL SELECT tp, 0, -1, p, s, 'synonym', entity, t, NULL, NULL, s || ' ' || entity FROM spoken
    UNION ALL SELECT d.tp, 1, d.cp, -1, d.name, 'dimension', entity, d.t, d.c, NULL,
      d.name || ' ' || d.kind || ' dimension of ' || entity FROM dims d JOIN names USING (t)
    UNION ALL SELECT m.tp, 2, m.cp, -1, m.name, 'measure', entity, m.t, NULL, m.name,
      m.name || ' ' || m.agg || ' measure of ' || entity FROM meas m JOIN names USING (t)
  )
)
"""


TERMS_CHAIN = _terms(STAR_MODEL)

PHRASES = _union(
    f"SELECT DISTINCT '{table} {column[2:] if column[1] == '_' else column}' || ' ' || {column} AS query FROM {table}"
    for table, column in (
        ("part", "p_type"), ("customer", "c_mktsegment"), ("events", "event_type"),
        ("orders", "o_orderpriority"), ("conversations", "role"), ("region", "r_name"),
        ("part", "p_name"),
    )
)


def _words(x: str) -> str:
    return f"list_distinct([{_singular('t')} FOR t IN {_tokens(x)}])"


def _lexical(chain: str, asked: str, key: str) -> str:
    """Adds asked, hits(key, term_id, score) and ranked to a terms chain."""
    return (
        chain
        + f""",
asked AS ({asked}),
qwords AS (SELECT {key}, query, len(ws) AS size, unnest(ws) AS w FROM (SELECT {key}, query, {_words('query')} AS ws FROM asked)),
twords AS (SELECT term_id, len(ws) AS size, unnest(ws) AS w FROM (SELECT term_id, {_words('term')} AS ws FROM catalog)),
equal AS (SELECT a.{key}, c.term_id FROM asked a JOIN catalog c ON lower(trim(a.query)) = lower(trim(c.term))),
shared AS (
  SELECT q.{key}, t.term_id, count(*)::DOUBLE / (any_value(q.size) + any_value(t.size) - count(*)) AS score
  FROM qwords q JOIN twords t USING (w) GROUP BY q.{key}, t.term_id
),
hits AS (
  SELECT coalesce(s.{key}, e.{key}) AS {key}, coalesce(s.term_id, e.term_id) AS term_id,
    CASE WHEN e.term_id IS NOT NULL THEN 1.0 ELSE s.score END::DOUBLE AS score
  FROM shared s FULL JOIN equal e ON s.{key} = e.{key} AND s.term_id = e.term_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, term_id) AS rank FROM hits)
"""
    )


TARGET = "coalesce(metric, t || '.' || c, t)"
PHRASE_CHAIN = _lexical(TERMS_CHAIN, f"SELECT query, query AS qkey FROM ({PHRASES})", "qkey")
PAGE_CHAIN = _lexical(
    _terms(RAW_MODEL), "SELECT page_id AS query_id, url || ' ' || html AS query FROM pages", "query_id"
)



def _letters(x: str) -> str:
    """How often each letter occurs in a text, as a list of doubles."""
    return "[" + ", ".join(f"(length(lower({x})) - length(replace(lower({x}), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


CENTROIDS = """
cent AS (
  SELECT label, list(x ORDER BY i) AS vector FROM (
    SELECT label, i, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label
)"""

# --- glossary ----------------------------------------------------------------------


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


_ENTRY_ROWS = ", ".join(
    "({}, {}, {}, [{}], {}, {}, {}, {})".format(
        i, _text(term), _text(definition), ", ".join(_text(s) for s in synonyms), _text(table), _text(column),
        confidence, "true" if accepted else "false",
    )
    for i, (term, definition, synonyms, table, column, confidence, accepted) in enumerate(ENTRIES)
)
GLOSSARY_CHAIN = (
    TERMS_CHAIN
    + f""",
entries AS (SELECT * FROM (VALUES {_ENTRY_ROWS}) AS e(nr, term, definition, synonyms, mt, mc, confidence, accepted)),
objects AS (
  SELECT t, NULL AS c, 'entity' AS kind, entity AS target, entity AS own, entity AS name,
    (SELECT list(s ORDER BY p) FROM spoken WHERE spoken.t = names.t) AS known FROM names
  UNION ALL SELECT t, c, 'dimension', t || '.' || c, c, t || '.' || name, [] FROM dims
  UNION ALL SELECT t, c, 'measure', t || '.' || c, c, t || '.' || name, [] FROM meas WHERE c IS NOT NULL
  UNION ALL SELECT t, NULL, 'count', NULL, NULL, t || '.' || name, [] FROM meas WHERE c IS NULL
),
grounded AS (
  SELECT e.*, o.kind, o.target, o.own, o.known FROM entries e JOIN objects o
    ON o.t = e.mt AND o.kind <> 'count' AND o.c IS NOT DISTINCT FROM e.mc
  WHERE e.accepted AND e.confidence >= 0.5
),
described AS (SELECT target, min(nr) AS nr, arg_min(definition, nr) AS value FROM grounded GROUP BY target),
said AS (
  SELECT target, own, known, nr, trim(unnest(synonyms)) AS s, generate_subscripts(synonyms, 1) AS p FROM grounded
),
added AS (
  SELECT target, s, nr, p FROM said WHERE s <> '' AND s <> own AND NOT list_contains(known, s)
  QUALIFY row_number() OVER (PARTITION BY target, s ORDER BY nr, p) = 1
)
"""
)

# --- scoring -----------------------------------------------------------------------

RUNS_CHAIN = """
WITH runs AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'grounded' ELSE 'plain' END AS arm,
    event_type || '-' || (user_id // 2) AS "case",
    CASE WHEN event_type = 'view' THEN 'baseline' ELSE 'probe' END AS trap,
    event_id AS run, value > 2 AS pass, value > 400 AS error,
    trunc(value % 13)::INTEGER AS steps, trunc(value % 3)::INTEGER AS corrections, value > 300 AS spent
  FROM events
),
cases AS (
  SELECT *, CASE WHEN error THEN 'error' WHEN runs_passed = runs_total THEN 'pass' ELSE 'fail' END AS outcome FROM (
    SELECT arm, "case", min(trap) AS trap, count(*) FILTER (pass) AS runs_passed, count(*) AS runs_total,
      bool_or(error) AS error, arg_max(steps, run) AS steps, arg_max(corrections, run) AS corrections,
      bool_or(spent) AS spent
    FROM runs GROUP BY arm, "case")
),
arms AS (
  SELECT arm, sum(CASE WHEN error THEN 0 ELSE runs_passed END)::BIGINT AS runs_passed,
    sum(CASE WHEN error THEN 1 ELSE runs_total END)::BIGINT AS runs_total,
    count(*) FILTER (outcome = 'pass') AS cases_passed, count(*) AS cases_total,
    avg(CASE WHEN error THEN 0 ELSE steps END) AS mean_steps,
    avg(CASE WHEN error THEN 0 ELSE corrections END) AS mean_corrections,
    count(*) FILTER (spent) AS budget_hits, count(*) FILTER (trap = 'baseline') AS controls,
    count(*) FILTER (trap = 'baseline' AND outcome <> 'pass') AS controls_failed
  FROM cases GROUP BY arm
)
"""

MONEY = "l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))"


def _requests(rows) -> str:
    return ", ".join(f"('{i}', {_text(b)}, {_text(t)}, {_text(s)})" for i, b, t, s in rows)


def _reach(rows) -> str:
    """Status of requests whose one foreign column is on a given table."""
    return (
        STAR_CHAIN
        + f""",
asked AS (SELECT * FROM (VALUES {_requests(rows)}) AS a(request_id, base, target, subject))
SELECT request_id, status, CASE WHEN status <> 'ok' THEN subject END AS subject, CASE status
    WHEN 'fan_out' THEN '"' || subject || '" would fan out "' || base || '_count": one ' || base || ' row can match many '
      || target || ' rows. Ask for a metric of ' || target || ' instead.'
    WHEN 'not_joinable' THEN '"' || subject || '" is on ' || target || ', which ' || base || ' does not reach in one join.'
    END AS reason FROM (
  SELECT request_id, base, target, subject, CASE WHEN base = target THEN 'ok'
    WHEN (SELECT count(*) FROM edges e WHERE e.from_table = base AND e.to_table = target) = 1 THEN 'ok'
    WHEN (SELECT count(*) FROM edges e WHERE e.from_table = base AND e.to_table = target) > 1 THEN 'ambiguous_join'
    WHEN (SELECT count(*) FROM edges e WHERE e.from_table = target AND e.to_table = base) > 0 THEN 'fan_out'
    ELSE 'not_joinable' END AS status FROM asked)"""
    )


_HOP_REQUESTS = (
    ("one-hop", "orders", "customers", "mktsegment", "orders_count"), ("two-hops", "lineitems", "customers", "mktsegment", "sum_quantity"),
    ("zone", "events", "nations", "zone", "events_count"), ("two-ways", "lineitems", "nations", "zone", "sum_quantity"),
    ("half-way-down", "events", "orders", "orderstatus", "events_count"), ("down", "customers", "orders", "orderstatus", "customers_count"),
)


def _zoned_cells(**sources: str):
    """Cells of the zoned tables, some of them from another source."""
    for position, (view, (source, names)) in enumerate(sorted(ZONED.items())):
        own = sources.get(view, source)
        for ordinal, (old, new) in enumerate(names.items()):
            if old == "zone":
                yield view, position, "(SELECT 'Z' || n_regionkey AS zone FROM nation)", ordinal, old, new, "string", "text"
            else:
                yield view, position, own, ordinal, old, new, *RAW_COLUMNS[source][old]


def _hops(most: int) -> str:
    """Status of requests over chains of up to three keys; a step down is told for ways of one or two steps."""
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in _HOP_REQUESTS)
    joins = "one join" if most == 1 else f"{most} joins"
    return (
        _chain(_zoned_cells())
        + f""",
asked AS (SELECT * FROM (VALUES {rows}) AS a(request_id, base, target, subject, metric)),
step AS (SELECT from_table AS b, to_table AS t, from_table || '.' || from_column AS k FROM edges),
ways AS (SELECT b, t, 1 AS n, k FROM step
  UNION ALL SELECT x.b, y.t, 2, x.k || ' -> ' || y.k FROM step x JOIN step y ON x.t = y.b WHERE y.t <> x.b
  UNION ALL SELECT x.b, z.t, 3, x.k || ' -> ' || y.k || ' -> ' || z.k FROM step x JOIN step y ON x.t = y.b JOIN step z ON y.t = z.b
    WHERE y.t <> x.b AND z.t NOT IN (x.b, x.t)),
met AS (SELECT request_id, base, target, subject, metric, count(k) FILTER (n = 1) AS direct, count(k) AS found,
    string_agg(k, ' or ' ORDER BY n, k) AS shown
  FROM asked LEFT JOIN ways ON b = base AND t = target AND n <= {most} GROUP BY ALL),
down AS (SELECT base AS db, target AS dt, base AS parent FROM asked JOIN step ON b = target AND t = base
  UNION ALL SELECT base, target, x.t FROM asked JOIN step x ON x.b = base JOIN step y ON y.b = target AND y.t = x.t WHERE {most} > 1),
told AS (SELECT *, CASE WHEN direct = 1 OR (direct = 0 AND found = 1) THEN 'ok' WHEN found > 1 THEN 'ambiguous_join'
    WHEN parent IS NOT NULL THEN 'fan_out' ELSE 'not_joinable' END AS status FROM met LEFT JOIN down ON db = base AND dt = target)
SELECT request_id, status, CASE WHEN status <> 'ok' THEN subject END AS subject, CASE status
    WHEN 'ambiguous_join' THEN '"' || subject || '" is ambiguous: ' || base || ' refers to ' || target || ' by more than one key (' || shown || ').'
    WHEN 'fan_out' THEN '"' || subject || '" would fan out "' || metric || '": one ' || parent || ' row can match many '
      || target || ' rows. Ask for a metric of ' || target || ' instead.'
    WHEN 'not_joinable' THEN '"' || subject || '" is on ' || target || ', which ' || base || ' does not reach in {joins}.'
    END AS reason FROM told"""
    )


def _loss(edge) -> str:
    a, b, c, d = edge
    return (
        f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column, "
        f"count(*) AS rows_lost FROM {a} f WHERE NOT EXISTS (SELECT 1 FROM {c} k WHERE k.{d} = f.{b})"
    )


def _format(cast: str = "") -> str:
    return (
        "SELECT o_orderstatus, count(*) AS orders, sum(o_custkey)::BIGINT AS keys, "
        "round(sum(o_totalprice), 2) AS total, sum(o_orderkey)::BIGINT AS order_keys, "
        "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last, "
        "string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus"
    )


def _overlap_sql(name: str, f: str, k: str) -> str:
    return (
        f"SELECT '{name}' AS pair, count(*) AS distinct_from, count(k.v) AS matched FROM "
        f"(SELECT DISTINCT v FROM ({f}) WHERE v IS NOT NULL) f LEFT JOIN "
        f"(SELECT DISTINCT v FROM ({k}) WHERE v IS NOT NULL) k USING (v)"
    )


def _cast(column: str, table: str) -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS v FROM {table}"


ORACLES: dict[str, str] = {
    "S1_folder_scan": _union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW_COLUMNS),
    "S2_parquet": "SELECT l_linestatus, count(*) AS lines, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY l_linestatus",
    "S2_csv": _format(), "S2_tsv": _format(), "S2_jsonl": _format(), "S2_json": _format(), "S2_json_mixed": _format(), "S2_ndjson": _format(),
    "S7_stale": "SELECT true AS changed, 2 * count(*) AS n FROM orders",
    "S5_listing": _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{kind}' AS kind, count(*) AS row_count FROM {t}"
        for t, columns in RAW_COLUMNS.items() for i, (c, (_, kind)) in enumerate(columns.items())
    ),
    "S6_sample": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50",
    "S7_upkeep": _chain(_zoned_cells(events="(SELECT * FROM events WHERE event_id % 2 = 0)"))
    + f"""SELECT {E4}, confidence, cardinality, ordinal, n AS from_rows, from_table = 'events' AS read_again
      FROM edges JOIN (SELECT DISTINCT t, n FROM prof) ON t = from_table""",
    "S7_artifacts": STAR_MODEL + "SELECT t AS table_name, name, agg FROM meas",
    "S8_export_csv": (
        "SELECT 'c_custkey,quoted,segment,c_acctbal' AS line UNION ALL "
        "SELECT c_custkey || ',' || chr(34) || ' ' || chr(34) || chr(34) || c_name || chr(34) || chr(34) || ', ' "
        "|| c_mktsegment || '  ' || chr(34) || ',' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'NULL') || ',' "
        "|| CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR "
        "ELSE c_acctbal::VARCHAR END AS line FROM customer"
    ),
    "S8_export_json": """SELECT c_custkey, ' "' || c_name || '", ' || c_mktsegment || '  ' AS quoted,
      nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer""",
    "S9_documents": """
      WITH lines AS (
        SELECT 'txt' AS extension, unnest(string_split(text, chr(10))) AS line FROM benchmark
        UNION ALL SELECT 'json', to_json({'text': text})::VARCHAR FROM benchmark)
      SELECT extension, count(*) AS items, sum(length(line))::BIGINT AS characters, max(md5(line)) AS largest_digest
      FROM lines WHERE line <> '' GROUP BY extension""",
    "S11_redact": r"""
      SELECT doc_id, md5(clean) AS digest, length(clean)::INTEGER AS characters FROM (
        SELECT doc_id, regexp_replace(regexp_replace(
          text || ' see postgres://app:' || source || '@db/' || lang || ' and PWD = ''a ' || source || ''' password=' || lang,
          '//[^/@]*@', '//', 'g'),
          '\b(password|passwd|pwd)\s*=\s*("[^"]*"|''[^'']*''|\S+)', '\1=***', 'gi') AS clean FROM documents)""",
    "P1_nulls": _per_column(
        "count(*) AS row_count, count(*) - count({c}) AS null_count, "
        "round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS null_percent"
    ),
    "P2_prefilter": _per_column("count(*) AS row_count, count(*) - count({c}) AS null_count, count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_unique"),
    "P2_distinct": _per_column("count(DISTINCT {c}) AS distinct_count"),
    "P3_numeric": _per_column(
        "min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, avg({c})::FLOAT::DOUBLE AS avg_value",
        lambda kind: kind == "numeric",
    ),
    "P4_temporal": _per_column(
        "min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value", lambda kind: kind == "date"
    ),
    "P5_top_values": _union(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, rank, value, value_count FROM (
          SELECT "{c}"::VARCHAR AS value, count(*) AS value_count,
            row_number() OVER (ORDER BY count(*) DESC, "{c}"::VARCHAR) AS rank
          FROM {source} WHERE "{c}" IS NOT NULL GROUP BY 1) WHERE rank <= 5"""
        for t, source, c, _, kind in _profiled() if kind in ("text", "boolean")
    ),
    "P6_kinds": _per_column(
        "CASE WHEN typeof(any_value({c})) LIKE '%[]' THEN 'other' "
        "WHEN regexp_matches(typeof(any_value({c})), 'INT|DOUBLE|FLOAT|DECIMAL') THEN 'numeric' "
        "WHEN regexp_matches(typeof(any_value({c})), 'TIMESTAMP|DATE') THEN 'date' "
        "WHEN typeof(any_value({c})) = 'BOOLEAN' THEN 'boolean' ELSE 'text' END AS kind"
    ),
    "P7_dataset_profile": _union(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count,
          count(*) - count("{c}") AS null_count, count(DISTINCT "{c}") AS distinct_count,
          {f'avg("{c}")::FLOAT::DOUBLE' if kind == "numeric" else "NULL::DOUBLE"} AS avg_value,
          {f'(SELECT max(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY "{c}"))' if kind == "text" else "0::BIGINT"} AS top_count
          FROM {t}"""
        for t, columns in RAW_COLUMNS.items() for c, (_, kind) in columns.items()
    ),
    "P7_table_profiles": _union(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(columns)}::BIGINT AS column_count FROM {t}"
        for t, columns in [*RAW_COLUMNS.items(), ("orders", NULLS_COLUMNS)]
    ).replace(f"SELECT 'orders' AS table_name, count(*) AS row_count, {len(NULLS_COLUMNS)}::",
              f"SELECT 'orders_nulls' AS table_name, count(*) AS row_count, {len(NULLS_COLUMNS)}::"),
    "R1_keys": _per_column(
        "count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_unique, "
        "count(*) > 0 AND count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS is_key"
    ),
    "R2_candidates": STAR_CHAIN + f"SELECT {E4} FROM cand",
    "R3_name_similarity": STAR_CHAIN + f"SELECT {E4}, round(name_similarity, 6) AS name_similarity FROM cand",
    "R4_singular": f"""
      SELECT singular, count(*) AS words, sum(uses)::BIGINT AS uses FROM (
        SELECT {_singular('word')} AS singular, uses FROM (
          SELECT word, count(*) AS uses FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word))
      GROUP BY singular""",
    "R5_id_named": _union(
        f"""SELECT '{view}' AS table_name, '{new}' AS column_name, {_id_named(f"'{new}'")} AS id_named,
          count(DISTINCT "{old}") AS distinct_count FROM {source}"""
        for view, _, source, _, old, new, _, _ in _star_cells()
    ),
    "R6_type_match": RAW_CHAIN + f"SELECT {E4}, type_match FROM cand",
    "R7_overlap": STAR_CHAIN + f"SELECT {E4}, distinct_from, matched, round(value_overlap, 6) AS value_overlap FROM scored",
    "R7_overlap_mixed_types": _union([
        _overlap_sql("orders.o_custkey->customer.code", _cast("o_custkey", "orders"), _cast("c_custkey", "customer")),
        _overlap_sql("customer.code->orders.o_orderkey", _cast("c_custkey", "customer"), _cast("o_orderkey", "orders")),
        _overlap_sql("events.value->events.user_id", _cast("value", "events"), _cast("user_id", "events")),
        _overlap_sql("documents.n_chars->orders.o_orderkey", _cast("n_chars", "documents"), _cast("o_orderkey", "orders")),
        _overlap_sql("documents.text->documents.text", _cast("text", "documents"), _cast("text", "documents")),
        _overlap_sql("events.ts->orders.o_orderdate", _cast("ts", "events"), _cast("o_orderdate", "orders")),
    ]),
    "R8_cardinality": RAW_CHAIN + f"SELECT {E4}, cardinality, cardinality_shape FROM cand",
    "R9_confidence": STAR_CHAIN + f"SELECT {E4}, confidence FROM scored",
    "R10_best_target": STAR_CHAIN + f"SELECT {E4}, confidence FROM best",
    "R11_mirrored": RAW_CHAIN + f""",
      flipped AS (
        SELECT {E4}, confidence, seen FROM best UNION ALL
        SELECT to_table, to_column, from_table, from_column,
          confidence + CASE WHEN name_similarity < 0.5 THEN 5 ELSE -5 END, seen + 1000 FROM best)
      SELECT {E4}, confidence, ordinal FROM ({_collapse('flipped')})""",
    "R12_discovery_star": STAR_CHAIN + EDGE_ROWS,
    "R12_discovery_raw": RAW_CHAIN + EDGE_ROWS,
    "R13_identity": STAR_CHAIN + f"SELECT {KEY} AS key, confidence FROM edges",
    "V1_reject": RAW_CHAIN + f"SELECT {E4}, confidence FROM edges WHERE {KEY} NOT IN ({_REJECTED})",
    "V2_upsert": CURATED_CHAIN + f"SELECT {E4}, confidence, cardinality, ordinal FROM curated",
    "S7_curated": CURATED_CHAIN + f"SELECT {E4}, confidence, cardinality, ordinal FROM curated",
    "V3_summary": CURATED_CHAIN + f"""
      SELECT (SELECT count(*) FROM edges WHERE {KEY} IN ({_REJECTED})) AS rejected,
        (SELECT count(*) FROM edges WHERE {KEY} IN (SELECT {KEY} FROM overrides)) AS overridden,
        (SELECT count(*) FROM overrides WHERE {KEY} NOT IN (SELECT {KEY} FROM edges)) AS added""",
    "X1_reasons": RAW_CHAIN + f"""
      SELECT {KEY} AS key, floor(value_overlap * 100 + 0.5)::BIGINT || '% of distinct ' || from_table || '.' || from_column
        || ' values are present in ' || to_table || '.' || to_column || ' | '
        || CASE WHEN name_similarity >= 0.9 THEN 'column name strongly matches the target'
             WHEN name_similarity >= 0.5 THEN 'column name partially matches the target' ELSE 'weak name match' END || ' | '
        || CASE WHEN type_match >= 1 THEN 'exact type match' WHEN type_match >= 0.85 THEN 'same type family'
             WHEN type_match > 0 THEN 'compatible types' ELSE 'type mismatch' END || ' | '
        || CASE WHEN cardinality = 'one-to-one' THEN 'one-to-one (both sides unique)'
             ELSE 'many-to-one (target key is unique)' END AS reasons FROM edges""",
    "X2_caveats": RAW_CHAIN + f"""
      SELECT {KEY} AS subject, {_ARROW} || ' is low-confidence (' || confidence || '%) — verify manually' AS caveat
        FROM edges WHERE confidence < 75
      UNION ALL SELECT {KEY}, {_ARROW} || ' matched mainly on data overlap with weak name evidence — possibly coincidental'
        FROM edges WHERE name_similarity < 0.5 AND value_overlap >= 0.9
      UNION ALL SELECT DISTINCT t, 'no inferred relationships' FROM prof
        WHERE t NOT IN (SELECT from_table FROM edges UNION SELECT to_table FROM edges)""",
    "M1_entities": STAR_MODEL + "SELECT t AS table_name, entity, tp AS ordinal FROM names",
    "M2_synonyms": TERMS_CHAIN + "SELECT entity, string_agg(s, ', ' ORDER BY p) AS synonyms FROM spoken GROUP BY entity",
    "M3_key_columns": STAR_MODEL + "SELECT t AS table_name, c AS column_name FROM keyc",
    "M4_dimensions": RAW_MODEL + "SELECT t AS table_name, c AS column_name, kind, grain, listed FROM dims",
    "M5_measures": RAW_MODEL + "SELECT t AS table_name, agg, c AS column_name, t AS grain FROM meas",
    "M6_measure_names": STAR_MODEL + "SELECT t AS table_name, name FROM meas",
    "M7_associations": STAR_MODEL + """
      SELECT entity, coalesce(belongs_to, '') AS belongs_to, coalesce(has_many, '') AS has_many,
        coalesce(has_one, '') AS has_one
      FROM names LEFT JOIN parents USING (t) LEFT JOIN many USING (t) LEFT JOIN one USING (t)""",
    "M8_model": STAR_MODEL + """
      SELECT entity, t AS table_name, coalesce(belongs_to, '') AS belongs_to,
        (SELECT string_agg(name, ', ' ORDER BY name) FROM dims WHERE dims.t = names.t) AS dimensions,
        (SELECT string_agg(name, ', ' ORDER BY name) FROM meas WHERE meas.t = names.t) AS measures
      FROM names LEFT JOIN parents USING (t)""",
    "M9_fan_out": STAR_MODEL + """
      SELECT m.t AS table_name, m.name AS measure, child FROM meas m
      JOIN (SELECT DISTINCT kt, child FROM linked WHERE cardinality <> 'one-to-one') ON kt = m.t""",
    "Q1_count": "SELECT count(*) AS lineitems_count FROM lineitem",
    "Q2_sum": "SELECT round(sum(l_extendedprice), 2) AS sum_extendedprice FROM lineitem",
    "Q3_own_dimension": "SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, count(*) AS orders_count FROM orders GROUP BY 1, 2",
    "Q4_parent_dimension": "SELECT c_mktsegment AS mktsegment, round(sum(o_totalprice), 2) AS sum_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "Q4_two_parents": """SELECT p_brand AS brand, o_orderstatus AS orderstatus, l_returnflag AS returnflag,
      round(sum(l_quantity), 2) AS sum_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "Q5_filters": """SELECT o_orderpriority AS orderpriority, round(sum(o_totalprice), 2) AS sum_totalprice
      FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE c_mktsegment <> 'BUILDING' AND o_totalprice > 1000 AND o_totalprice <= 400000.5 AND o_orderstatus = 'F'
        AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderpriority < '5' GROUP BY 1""",
    "Q7_unknown": STAR_MODEL + """,
      asked AS (SELECT * FROM (VALUES ('unknown-metric', 'total_revenue', 'orderstatus', NULL, '='),
        ('unknown-dimension', 'orders_count', 'colour', NULL, '='), ('unknown-filter', 'orders_count', NULL, 'colour', '='),
        ('operator', 'orders_count', 'orderstatus', 'orderpriority', '~'),
        ('first-problem', 'customers_count', 'colour', 'shade', '='), ('ok-own', 'orders_count', 'orderstatus', NULL, '='))
        AS a(request_id, metric, dim, filt, op))
      SELECT request_id, status, CASE status WHEN 'unknown_metric' THEN metric WHEN 'unknown_dimension' THEN dim
          WHEN 'ok' THEN NULL ELSE filt END AS subject,
        CASE status WHEN 'unknown_metric' THEN 'Unknown metric "' || metric || '"; known: '
            || (SELECT string_agg(name, ', ' ORDER BY tp, cp) FROM meas)
          WHEN 'unknown_dimension' THEN 'Unknown dimension "' || dim || '"; known: ' || (SELECT string_agg(name, ', ' ORDER BY tp, cp) FROM dims)
          WHEN 'unsupported_operator' THEN 'Unsupported filter operator "' || op || '".'
          WHEN 'unknown_filter_column' THEN 'Unknown filter column "' || filt || '".' END AS reason FROM (
        SELECT *, CASE WHEN metric NOT IN (SELECT name FROM meas) THEN 'unknown_metric'
          WHEN dim IS NOT NULL AND dim NOT IN (SELECT name FROM dims) THEN 'unknown_dimension'
          WHEN op NOT IN ('=', '!=', '<', '<=', '>', '>=') THEN 'unsupported_operator'
          WHEN filt IS NOT NULL AND filt NOT IN (SELECT name FROM dims UNION SELECT c FROM meas WHERE c IS NOT NULL)
            THEN 'unknown_filter_column' ELSE 'ok' END AS status FROM asked)""",
    "Q8_fan_out": _reach([
        ("fan-out", "customers", "orders", "orderstatus"),
        ("fan-out-filter", "orders", "lineitems", "returnflag"),
        ("ok-parent", "orders", "customers", "mktsegment"),
    ]),
    "Q9_ambiguous": _chain(_transfer_cells()) + """
      SELECT 'two-keys' AS request_id, CASE WHEN count(*) > 1 THEN 'ambiguous_join' WHEN count(*) = 1 THEN 'ok'
        ELSE 'not_joinable' END AS status, CASE WHEN count(*) <> 1 THEN 'mktsegment' END AS subject,
        CASE WHEN count(*) > 1 THEN '"mktsegment" is ambiguous: transfers refers to customers by more than one key ('
          || string_agg('transfers.' || from_column, ' or ' ORDER BY from_column) || ').' END AS reason
      FROM edges WHERE from_table = 'transfers' AND to_table = 'customers'
      UNION ALL SELECT 'own', 'ok', NULL, NULL""",
    "Q10_not_joinable": _reach([
        ("two-hops", "lineitems", "customers", "mktsegment"),
        ("siblings", "events", "orders", "orderstatus"),
        ("ok-filter", "lineitems", "orders", "orderstatus"),
    ]),
    "Q10_two_hops": """SELECT c_mktsegment AS mktsegment, l_returnflag AS returnflag, round(sum(l_quantity), 2) AS sum_quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
    "Q10_one_hop_by_default": _hops(1),
    "Q10_paths_of_two": _hops(2),
    "Q10_paths_of_three": _hops(3),
    "Q7_operand": """WITH typed AS (
        SELECT 'orders' AS t, 'totalprice' AS c, any_value(typeof(o_totalprice)) AS kind FROM orders
        UNION ALL SELECT 'orders', 'orderdate', any_value(typeof(o_orderdate)) FROM orders
        UNION ALL SELECT 'orders', 'orderstatus', any_value(typeof(o_orderstatus)) FROM orders
        UNION ALL SELECT 'lineitems', 'quantity', any_value(typeof(l_quantity)) FROM lineitem
        UNION ALL SELECT 'customers', 'customers.acctbal', any_value(typeof(c_acctbal)) FROM customer),
      asked AS (SELECT * FROM (VALUES ('number', 'totalprice', ' 12.5 '), ('no-number', 'totalprice', 'a lot'), ('exponent', 'quantity', '1e3'),
        ('day', 'orderdate', '1996-02-29'), ('no-day', 'orderdate', '1997-02-29'), ('no-time', 'orderdate', 'yesterday'),
        ('text', 'orderstatus', '5'), ('parent', 'customers.acctbal', 'rich'), ('none', 'orderstatus', NULL)) AS a(request_id, c, v)),
      judged AS (SELECT *, v IS NOT NULL AND CASE WHEN kind IN ('DOUBLE', 'BIGINT', 'INTEGER') OR kind LIKE 'DECIMAL%' THEN try_cast(v AS DOUBLE) IS NOT NULL
        WHEN kind IN ('DATE', 'TIMESTAMP') THEN try_cast(v AS TIMESTAMP) IS NOT NULL ELSE true END AS fits FROM asked JOIN typed USING (c))
      SELECT request_id, CASE WHEN fits THEN 'ok' ELSE 'wrong_operand' END AS status, CASE WHEN NOT fits THEN c END AS subject,
        CASE WHEN NOT fits THEN t || '.' || replace(c, t || '.', '') || ' is '
          || CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(kind) END
          || ' and cannot be compared with "' || coalesce(v, 'null') || '".' END AS reason FROM judged""",
    "L12_drill_across": """WITH o AS (SELECT c_mktsegment AS m, sum(o_totalprice) AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      e AS (SELECT c_mktsegment AS m, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1),
      l AS (SELECT c_mktsegment AS m, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT m AS mktsegment, round(o.p, 2) AS sum_totalprice, coalesce(o.n, 0) AS orders_count, coalesce(e.n, 0) AS events_count, round(l.q, 2) AS sum_quantity
      FROM o FULL JOIN e USING (m) FULL JOIN l USING (m)""",
    "Q11_join_loss": _union(_loss(edge) for edge in LOSS_EDGES),
    "T1_catalog": TERMS_CHAIN + "SELECT term_id, term, kind, entity, text FROM catalog",
    "T2_targets": TERMS_CHAIN + f"SELECT term_id, {TARGET} AS target FROM catalog",
    "T3_lexical": PHRASE_CHAIN + "SELECT qkey AS query, term_id, round(score, 6) AS score FROM hits",
    "T4_cosine": f"""WITH {CENTROIDS}
      SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS score
      FROM embeddings JOIN cent USING (label)""",
    "T5_ranks": PHRASE_CHAIN + "SELECT qkey AS query, term_id, rank::INTEGER AS rank FROM ranked",
    "T6_fusion": PHRASE_CHAIN + f""",
      qv AS (SELECT qkey, {_letters('query')} AS v FROM asked), tv AS (SELECT term_id, {_letters('term')} AS v FROM catalog),
      cosines AS (SELECT qkey, term_id, list_inner_product(q.v, t.v)
          / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(t.v, t.v))) AS score
        FROM qv q, tv t WHERE list_sum(q.v) > 0 AND list_sum(t.v) > 0),
      near AS (SELECT qkey, term_id, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, term_id) AS vrank FROM cosines WHERE score > 0),
      fused AS (SELECT coalesce(n.qkey, r.qkey) AS query, coalesce(n.term_id, r.term_id) AS term_id,
          coalesce(1.0::DOUBLE / (60 + rank), 0.0) + coalesce(1.0::DOUBLE / (60 + vrank), 0.0) AS score
        FROM near n FULL JOIN ranked r ON n.qkey = r.qkey AND n.term_id = r.term_id)
      SELECT query, position::INTEGER AS position, term_id, round(score, 9) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, term_id) AS position FROM fused) WHERE position <= 5""",
    "T7_nearest": f"""WITH {CENTROIDS}
      SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
          SELECT c.label::BIGINT AS query_id, vec_id AS item_id,
            list_cosine_similarity(embedding::DOUBLE[], vector) AS score FROM embeddings, cent c)
        WHERE score > 0) WHERE rank <= 5""",
    "T8_resolve_pages": PAGE_CHAIN + """SELECT query_id, rank::INTEGER AS position, term_id,
      round(1.0::DOUBLE / (60 + rank), 9) AS score FROM ranked WHERE rank <= 5""",
    "T8_resolve_phrases": PHRASE_CHAIN + f"""SELECT qkey AS query, rank::INTEGER AS position, {TARGET} AS target,
      round(1.0::DOUBLE / (60 + rank), 9) AS score FROM ranked JOIN catalog USING (term_id) WHERE rank <= 5""",
    "T9_vectors": TERMS_CHAIN + f"SELECT term_id, term, 256 AS width, len({_words('text')})::INTEGER AS words FROM catalog",
    "G1_parse": """
      SELECT p_partkey AS payload_id, p_name AS term, p_type AS definition, p_brand || ',' || p_type AS synonyms,
        nullif(p_type, 'PROMO') AS map_table, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS map_column,
        coalesce(nullif(p_size, 7) / 100.0::DOUBLE, 0.5) AS confidence
      FROM part WHERE p_size % 2 = 0 OR p_type <> 'SMALL'""",
    "G2_grounded": GLOSSARY_CHAIN + "SELECT term, kind, target FROM grounded",
    "G3_descriptions": GLOSSARY_CHAIN + "SELECT name, value AS description FROM objects LEFT JOIN described USING (target)",
    "G4_synonyms": GLOSSARY_CHAIN + """
      SELECT name, array_to_string(list_concat(known, coalesce((SELECT list(s ORDER BY nr, p) FROM added a
        WHERE a.target = o.target), [])), ', ') AS synonyms FROM objects o""",
    "G5_applied": GLOSSARY_CHAIN + """
      SELECT nr::BIGINT AS ordinal, target, 'description' AS field, value FROM described
      UNION ALL SELECT nr, target, 'synonyms', string_agg(s, ', ' ORDER BY p) FROM added GROUP BY nr, target""",
    "G5_resolve": GLOSSARY_CHAIN + """
      SELECT DISTINCT query, CASE kind WHEN 'measure' THEN (SELECT name FROM meas WHERE meas.t = mt AND meas.c = mc)
        WHEN 'dimension' THEN mt || '.' || mc ELSE mt END AS target
      FROM (SELECT kind, mt, mc, trim(unnest(synonyms)) AS query FROM grounded) WHERE query IN ('billings', 'industry', 'client', 'balance')""",
    "L0_run_sql": RUN_SQL,
    "L1_count": "SELECT count(*) AS n FROM lineitem",
    "L2_group_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "L3_sum_product": """SELECT round(sum(l_quantity::DECIMAL(12,2) * p_retailprice::DECIMAL(12,2))::DOUBLE, 2) AS revenue
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "L4_chain": f"""SELECT n_name, round(sum({MONEY})::DOUBLE, 2) AS revenue FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "L5_distinct": """SELECT count(DISTINCT o_custkey) AS n, 'with returns' AS what FROM orders
        JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
      UNION ALL SELECT count(DISTINCT o_custkey), 'all' FROM orders""",
    "L6_not_exists": "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "L7_exists": """SELECT c_mktsegment, count(*) AS n FROM customer
      WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) GROUP BY 1""",
    "L8_from_role": f"SELECT c_mktsegment, count(*) AS n FROM {TRANSFERS} m JOIN customer ON from_customer_id = c_custkey GROUP BY 1",
    "L8_to_role": f"SELECT c_mktsegment, count(*) AS n FROM {TRANSFERS} m JOIN customer ON to_customer_id = c_custkey GROUP BY 1",
    "L9_natural_key": """SELECT p.p_brand, count(*) AS n, max(b.top_price) AS top_price FROM part p
      JOIN (SELECT p_brand, max(p_retailprice) AS top_price FROM part GROUP BY 1) b ON p.p_brand = b.p_brand GROUP BY 1""",
    "L10_top_one": f"""SELECT p_name, round(revenue::DOUBLE, 2) AS revenue FROM (
      SELECT p_name, sum({MONEY}) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
      ORDER BY revenue DESC, p_name LIMIT 1)""",
    "L10_top_count": "SELECT count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC LIMIT 1",
    "L11_filtered": """SELECT o_orderpriority, round(sum(o_totalprice::DECIMAL(14,2))::DOUBLE, 2) AS total
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "L12_two_grains": """SELECT c_name, coalesce((SELECT round(sum(o_totalprice::DECIMAL(14,2))::DOUBLE, 2) FROM orders
        WHERE o_custkey = c_custkey), 0) AS revenue, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events
      FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
    "L13_inflation": """
      SELECT round(naive, 2) AS naive, round(correct, 2) AS correct, round(naive / correct, 6) AS ratio FROM (
        SELECT (SELECT sum(o_totalprice::DECIMAL(14,2))::DOUBLE FROM orders JOIN events ON user_id = o_custkey) AS naive,
          (SELECT sum(o_totalprice::DECIMAL(14,2))::DOUBLE FROM orders
            WHERE EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)) AS correct)""",
    "L14_left_distinct": """SELECT count(DISTINCT o_orderkey::VARCHAR) AS distinct_from,
        count(DISTINCT CASE WHEN k IS NOT NULL THEN o_orderkey::VARCHAR END) AS matched
      FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey::VARCHAR AS k FROM lineitem) ON o_orderkey::VARCHAR = k""",
    "E1_compare": """
      WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AS urgent, 10.0::DOUBLE ** (o_orderkey % 8) AS power FROM orders)
      SELECT 'renamed' AS test, NOT EXISTS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM o
        EXCEPT ALL SELECT o_orderkey::VARCHAR::BIGINT, o_orderstatus, o_totalprice FROM o) AS equal
      UNION ALL SELECT 'changed', NOT EXISTS (SELECT o_orderkey, o_totalprice FROM o
        EXCEPT ALL SELECT o_orderkey, o_totalprice + CASE WHEN urgent THEN 0.5 ELSE 0 END FROM o)
      UNION ALL SELECT 'long keys', NOT EXISTS (SELECT o_orderkey * 1000000000 FROM o
        EXCEPT ALL SELECT o_orderkey * 1000000000 + urgent::INT FROM o)
      UNION ALL SELECT 'below powers of ten', bool_and(abs(power - power * (1 - 2e-16::DOUBLE)) <= 1e-9 * power) FROM o
      UNION ALL SELECT 'swapped in a row', NOT EXISTS (SELECT o_orderkey, o_custkey FROM o
        EXCEPT ALL SELECT CASE WHEN urgent THEN o_custkey ELSE o_orderkey END, CASE WHEN urgent THEN o_orderkey ELSE o_custkey END FROM o)""",
    "E1_differences": """
      WITH e AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
      a AS (SELECT o_orderkey, o_orderstatus,
        o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0 END AS o_totalprice FROM orders)
      SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)) AS missing,
        (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)) AS extra""",
    "E1_matching": """
      WITH sides(test, side, shift) AS (VALUES ('paired crosswise', 'e', 0.0), ('paired crosswise', 'e', 1.5e-9), ('paired crosswise', 'a', 0.8e-9),
          ('paired crosswise', 'a', 0.8e-9), ('paired in a chain', 'e', 0.0), ('paired in a chain', 'e', 0.9e-9), ('paired in a chain', 'e', 1.8e-9),
          ('paired in a chain', 'a', 0.0), ('paired in a chain', 'a', 2.7e-9), ('paired in a chain', 'a', 0.9e-9),
          ('one too far', 'e', 0.0), ('one too far', 'e', 1.5e-9), ('one too far', 'a', 0.8e-9), ('one too far', 'a', 3e-9)),
      placed AS (SELECT test, side, o_orderkey AS k, v, row_number() OVER (PARTITION BY test, side, o_orderkey ORDER BY v) AS i
        FROM (SELECT *, o_totalprice * (1 + shift::DOUBLE) AS v FROM orders, sides WHERE o_totalprice > 0))
      SELECT e.test, bool_and(abs(e.v - a.v) <= 1e-9 * greatest(abs(e.v), abs(a.v))) AS equal
      FROM placed e JOIN placed a ON e.test = a.test AND e.k = a.k AND e.i = a.i AND e.side = 'e' AND a.side = 'a' GROUP BY 1""",
    "E2_ordered": """
      WITH e AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey AS k, o_totalprice AS v FROM orders),
      a AS (SELECT row_number() OVER (ORDER BY -o_orderkey) AS i, -o_orderkey AS k, o_totalprice AS v FROM orders)
      SELECT 'same order' AS test, NOT EXISTS (SELECT * FROM e EXCEPT ALL SELECT * FROM e) AS equal
      UNION ALL SELECT 'other order', NOT EXISTS (SELECT * FROM e JOIN a USING (i) WHERE e.k <> a.k OR e.v <> a.v)""",
    "E3_suite": _lexical(TERMS_CHAIN, "SELECT query, query AS qkey FROM (VALUES ('order priority'), ('billings')) AS q(query)", "qkey") + f""",
      judged(id, kind, passed) AS (
        SELECT 'edge', 'relationship', EXISTS (SELECT 1 FROM edges WHERE {KEY} = 'orders.customer_id->customers.id' AND confidence >= 90)
        UNION ALL SELECT 'edge-absent', 'relationship', NOT EXISTS (SELECT 1 FROM edges WHERE {KEY} = 'parts.id->orders.id')
        UNION ALL SELECT 'edge-missing', 'relationship', EXISTS (SELECT 1 FROM edges WHERE {KEY} = 'parts.size->orders.id')
        UNION ALL SELECT 'entity', 'entity', EXISTS (SELECT 1 FROM names WHERE entity = 'Order' AND t = 'orders')
          AND (SELECT count(*) = 2 FROM meas WHERE t = 'orders' AND name IN ('orders_count', 'sum_totalprice'))
          AND EXISTS (SELECT 1 FROM dims WHERE t = 'orders' AND name = 'orderstatus')
        UNION ALL SELECT 'entity-gap', 'entity', EXISTS (SELECT 1 FROM meas JOIN names USING (t) WHERE entity = 'Order' AND meas.name = 'sum_colour')
        UNION ALL SELECT 'metric', 'metric', (SELECT count(*) = 1 FROM meas m JOIN edges ON from_table = m.t JOIN dims d ON d.t = to_table
          WHERE m.name = 'sum_totalprice' AND d.name = 'mktsegment')
        UNION ALL SELECT 'metric-fan-out', 'metric', NOT EXISTS (SELECT 1 FROM meas m JOIN edges ON from_table = m.t JOIN dims d ON d.t = to_table
          WHERE m.name = 'customers_count' AND d.name = 'orderstatus')
        UNION ALL SELECT 'metric-unknown', 'metric', NOT EXISTS (SELECT 1 FROM meas WHERE name = 'gross_margin')
        UNION ALL SELECT 'term', 'term', EXISTS (SELECT 1 FROM ranked JOIN catalog USING (term_id) WHERE qkey = 'order priority' AND rank <= 5 AND {TARGET} = 'orders_count')
        UNION ALL SELECT 'term-unknown', 'term', EXISTS (SELECT 1 FROM ranked JOIN catalog USING (term_id) WHERE qkey = 'billings' AND rank <= 5 AND {TARGET} = 'sum_totalprice'))
      SELECT id, kind, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS outcome FROM judged""",
    "E4_tally": RUNS_CHAIN + """SELECT arm, count(*) AS total, count(*) FILTER (outcome = 'pass') AS passed,
      count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'error') AS errored,
      round(count(*) FILTER (outcome = 'pass')::DOUBLE / count(*), 6) AS score FROM cases GROUP BY arm""",
    "E5_arms": RUNS_CHAIN + """SELECT arm, runs_passed, runs_total, round(runs_passed::DOUBLE / runs_total, 6) AS run_rate,
      cases_passed, cases_total, round(mean_steps, 6) AS mean_steps, round(mean_corrections, 6) AS mean_corrections,
      budget_hits, controls, controls_failed FROM arms""",
    "E5_delta": RUNS_CHAIN + """SELECT round(a, 6) AS first_rate, round(b, 6) AS second_rate, round((a - b) * 100, 6) AS delta_points
      FROM (SELECT (SELECT runs_passed::DOUBLE / runs_total FROM arms WHERE arm = 'grounded') AS a,
        (SELECT runs_passed::DOUBLE / runs_total FROM arms WHERE arm = 'plain') AS b)""",
    "E5_cases": RUNS_CHAIN + """,
      shown AS (SELECT *, CASE WHEN outcome = 'error' THEN 'error' ELSE runs_passed || '/' || runs_total END AS tally FROM cases)
      SELECT f."case", f.trap, f.tally AS first_tally, coalesce(s.tally, '-') AS second_tally, f.steps AS first_steps,
        coalesce(s.steps, 0) AS second_steps
      FROM (SELECT * FROM shown WHERE arm = 'grounded') f LEFT JOIN (SELECT * FROM shown WHERE arm = 'plain') s
        ON f."case" = s."case" """,
    "E6_behavior": """
      WITH talks AS (SELECT conv_id AS run_id, list(DISTINCT role) AS used, count(*) AS steps FROM conversations GROUP BY 1)
      SELECT run_id, 'did not use ' || t AS violation FROM talks, (VALUES ('system'), ('user')) AS r(t) WHERE NOT list_contains(used, t)
      UNION ALL SELECT run_id, 'used ' || t FROM talks, (VALUES ('tool'), ('system')) AS r(t) WHERE list_contains(used, t)
      UNION ALL SELECT run_id, 'took ' || steps || ' steps, budget 5' FROM talks WHERE steps > 5""",
    "flagship_metric": "SELECT c_mktsegment AS mktsegment, round(sum(o_totalprice), 2) AS sum_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
}
