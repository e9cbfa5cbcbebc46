"""SQL counterparts of :mod:`checks.queries`, for DuckDB.

Iterative algorithms are unrolled into one common table expression per half step.
"""

from __future__ import annotations

DIGITS = 6
ALPHA = 0.15

ORDERS_PARTS = """
shift AS (SELECT (SELECT max(p_partkey) FROM part) - (SELECT min(o_orderkey) FROM orders) + 1 AS s),
inc AS MATERIALIZED (SELECT l_orderkey + s AS he, l_partkey AS hv FROM lineitem, shift),
hcard AS (SELECT he, count(*) AS n FROM inc GROUP BY he),
hv AS MATERIALIZED (SELECT p_partkey AS id, p_name, p_size, p_brand FROM part),
he AS MATERIALIZED (
  SELECT o_orderkey + s AS id, o_orderkey AS orig_id,
         CAST(coalesce(n, 0) AS INTEGER) AS card, CAST(1 AS INTEGER) AS weight
  FROM orders CROSS JOIN shift LEFT JOIN hcard ON he = o_orderkey + s)
"""

ORDER_SUPPLIERS = """
member AS MATERIALIZED (SELECT DISTINCT l_orderkey AS record, l_suppkey AS m FROM lineitem),
rec AS (SELECT record, list(m ORDER BY m) AS members FROM member GROUP BY record),
sets AS MATERIALIZED (
  SELECT members, CAST(len(members) AS INTEGER) AS card, CAST(count(*) AS INTEGER) AS weight,
         min(record) AS label
  FROM rec GROUP BY members),
hv AS MATERIALIZED (
  SELECT m AS name, row_number() OVER (ORDER BY m) - 1 AS id FROM (SELECT DISTINCT m FROM member)),
he AS MATERIALIZED (
  SELECT members, card, weight,
         row_number() OVER (ORDER BY label) - 1 + (SELECT max(id) FROM hv) + 1 AS id
  FROM sets),
inc AS MATERIALIZED (
  SELECT x.he, hv.id AS hv FROM (SELECT id AS he, unnest(members) AS m FROM he) x JOIN hv ON hv.name = x.m)
"""

BY_LINES = """
inc0 AS (SELECT l_orderkey AS h, l_partkey AS hv FROM lineitem),
s AS (SELECT max(hv) - min(h) + 1 AS s FROM inc0),
inc AS MATERIALIZED (SELECT h + s AS he, hv FROM inc0, s),
he AS MATERIALIZED (SELECT he AS id, CAST(count(*) AS INTEGER) AS card, CAST(1 AS INTEGER) AS weight
                    FROM inc GROUP BY he)
"""


def rnd(expression: str) -> str:
    return f"round({expression}, {DIGITS})"


def orders(body: str) -> str:
    return f"WITH {ORDERS_PARTS} {body}"


PURCHASES = """,
v AS MATERIALIZED (
  SELECT p_partkey AS id, p_size AS attr FROM part
  UNION ALL SELECT o_orderkey + s, CAST(o_custkey AS INTEGER) FROM orders, shift),
e AS MATERIALIZED (SELECT l_orderkey + s AS src, l_partkey AS dst, CAST(l_quantity AS INTEGER) AS attr
                   FROM lineitem, shift)
"""


def purchases(body: str) -> str:
    return orders(PURCHASES + body)


def suppliers(body: str) -> str:
    return f"WITH {ORDER_SUPPLIERS} {body}"


def degree_rows(hv: str = "hv", he: str = "he", inc: str = "inc") -> str:
    return f"""
SELECT id, CAST(count(i.hv) AS INTEGER) AS attr FROM {hv} v LEFT JOIN {inc} i ON i.hv = v.id GROUP BY id
UNION ALL
SELECT id, CAST(count(i.he) AS INTEGER) AS attr FROM {he} e LEFT JOIN {inc} i ON i.he = e.id GROUP BY id"""


def sub(keep_isolated: bool) -> str:
    body = """,
v1 AS (SELECT * FROM hv WHERE p_size <= 25),
e1 AS (SELECT * FROM he WHERE card BETWEEN 2 AND 4),
i1 AS MATERIALIZED (SELECT inc.* FROM inc JOIN v1 ON v1.id = hv JOIN e1 ON e1.id = he)"""
    if keep_isolated:
        return orders(body + degree_rows("v1", "e1", "i1"))
    return orders(
        body
        + """, v2 AS (SELECT * FROM v1 WHERE id IN (SELECT hv FROM i1)),
e2 AS (SELECT * FROM e1 WHERE id IN (SELECT he FROM i1))"""
        + degree_rows("v2", "e2", "i1")
    )


def cardinality(bound: str) -> str:
    return f"""WITH {BY_LINES},
e1 AS (SELECT * FROM he WHERE card {bound}),
i1 AS MATERIALIZED (SELECT inc.* FROM inc JOIN e1 ON e1.id = he)
SELECT he AS id, CAST(count(*) AS INTEGER) AS attr FROM i1 GROUP BY he
UNION ALL SELECT hv, CAST(count(*) AS INTEGER) FROM i1 GROUP BY hv"""


def heard(aggregate: str, where: str = "true", extra: str = "") -> str:
    return orders(f"""{extra},
m AS (SELECT inc.he, CAST({aggregate} AS BIGINT) AS heard FROM inc JOIN hv ON hv.id = inc.hv
      JOIN ends ON ends.v = inc.hv WHERE {where} GROUP BY inc.he)
SELECT id, coalesce(heard, -1) AS heard FROM he LEFT JOIN m ON m.he = he.id""")


ENDS = ", ends AS (SELECT hv AS v, min(he) AS first, max(he) AS last FROM inc GROUP BY hv)"

PROJECTED = """,
pairs AS MATERIALIZED (
  SELECT a.hv AS src, b.hv AS dst, he.card, he.weight
  FROM inc a JOIN inc b ON a.he = b.he JOIN he ON he.id = a.he)"""

MAX_EDGES = PROJECTED + ", e AS MATERIALIZED (SELECT src, dst, max(card) AS attr FROM pairs GROUP BY src, dst)"


def weighted_edges() -> str:
    return PROJECTED + """,
e0 AS MATERIALIZED (SELECT src, dst, sum(weight / CAST(card AS DOUBLE)) AS attr FROM pairs GROUP BY src, dst),
tot AS (SELECT src, sum(attr) AS t FROM e0 GROUP BY src),
e AS MATERIALIZED (SELECT e0.src, dst, attr / t AS attr FROM e0 JOIN tot ON tot.src = e0.src)"""


def both_roles(name: str, value: str, v: str, e: str, v_else: str, e_else: str) -> str:
    """Final rows of all nodes; nodes absent from ``v`` / ``e`` take the given default."""
    return f"""
SELECT hv.id, {value.format(f"coalesce(x.val, {v_else})")} AS {name} FROM hv LEFT JOIN {v} x ON x.id = hv.id
UNION ALL
SELECT he.id, {value.format(f"coalesce(x.val, {e_else})")} AS {name} FROM he LEFT JOIN {e} x ON x.id = he.id"""


def small_components() -> str:
    """Orders of at most two lines: many components, some long. Repeats until nothing changes."""
    return orders(""",
few AS (SELECT id FROM he WHERE card <= 2 AND card > 0),
link AS MATERIALIZED (SELECT DISTINCT inc.he, inc.hv FROM inc JOIN few ON few.id = inc.he),
edge AS MATERIALIZED (SELECT DISTINCT a.he AS a, b.he AS b FROM link a JOIN link b ON a.hv = b.hv),
reach AS (SELECT a AS root, a AS id FROM edge UNION SELECT r.root, e.b FROM reach r JOIN edge e ON e.a = r.id),
label AS (SELECT id, max(root) AS label FROM reach GROUP BY id)
SELECT id, label FROM label UNION ALL
SELECT hv, max(label) FROM link JOIN label ON label.id = link.he GROUP BY hv""").replace("WITH ", "WITH RECURSIVE ", 1)


def frontier(half_steps: int, source: int) -> str:
    """Breadth first: reached in each half step, and those reached for the first time."""
    ctes = f""",
s0 AS MATERIALIZED (SELECT id FROM hv WHERE id = {source})"""
    rows = []
    for k in range(1, half_steps + 1):
        role, other = ("he", "hv") if k % 2 else ("hv", "he")
        seen = " UNION ALL ".join(f"SELECT id FROM s{j}" for j in range(k - 2, -1, -2)) or "SELECT -1 AS id WHERE false"
        ctes += f""",
r{k} AS MATERIALIZED (SELECT DISTINCT inc.{role} AS id FROM inc JOIN s{k - 1} s ON s.id = inc.{other}),
s{k} AS MATERIALIZED (SELECT id FROM r{k} WHERE id NOT IN ({seen}))"""
        count = f"SELECT CAST({k - 1} AS INTEGER) AS half_step, (SELECT count(*) FROM r{k}) AS reached, (SELECT count(*) FROM s{k}) AS sent"
        rows.append(f"SELECT * FROM ({count}) WHERE reached > 0 OR half_step = 0")
    return orders(ctes + " " + " UNION ALL ".join(rows))


def traffic(half_steps: int, source: int, n: int, cutoff: int) -> str:
    """Copies of senders and messages combined within parts, per strategy and half step of a breadth first search."""
    hv, he = "hv", "he"
    parts = {
        "1D-src": hashed(hv, n),
        "1D-dst": hashed(he, n),
        "2D": uneven_grid(n, 4).replace("src", hv).replace("dst", he),
        "RandomVertexCut": pair(hv, he, n),
        "HybridSrc": f"CASE WHEN d > {cutoff} THEN {positive(he, n)} ELSE {positive(hv, n)} END",
    }
    ctes = f""",
busy AS MATERIALIZED (SELECT he, hv, count(*) OVER (PARTITION BY hv) AS d FROM inc),
s0 AS MATERIALIZED (SELECT id FROM hv WHERE id = {source})"""
    rows = []
    for k in range(half_steps):
        role, other = ("he", "hv") if k % 2 == 0 else ("hv", "he")
        seen = " UNION ALL ".join(f"SELECT id FROM s{j}" for j in range(k - 1, -1, -2)) or "SELECT -1 AS id WHERE false"
        ctes += f""",
l{k} AS MATERIALIZED (SELECT busy.* FROM busy JOIN s{k} s ON s.id = busy.{other}),
s{k + 1} AS MATERIALIZED (SELECT DISTINCT {role} AS id FROM l{k} WHERE {role} NOT IN ({seen}))"""
        for strategy, part in parts.items():
            rows.append(f"""SELECT '{strategy}' AS strategy, CAST({k} AS INTEGER) AS half_step,
  count(DISTINCT (part, {other})) AS copies, count(DISTINCT (part, {role})) AS messages
  FROM (SELECT he, hv, {part} AS part FROM l{k}) HAVING count(*) > 0 OR {k} = 0""")
    return orders(ctes + " " + " UNION ALL ".join(rows))


CHAINS = """
WITH runs AS (
  SELECT o_orderkey AS o, o_orderkey // 1000 AS run, o_orderkey - row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS island
  FROM orders
), shift AS (SELECT max(o) - min(o) + 1 AS s FROM runs),
labels AS (SELECT o, s, max(o) OVER (PARTITION BY run, island) + s AS label FROM runs, shift)
SELECT o AS id, label FROM labels UNION ALL SELECT o + s, label FROM labels"""

REGISTERS = """,
digest AS (SELECT id, md5(CAST(id AS VARCHAR)) AS d FROM hv),
reg AS (SELECT id, CAST('0x' || substr(d, 1, 3) AS INTEGER) AS register, CAST('0x' || substr(d, 4, 13) AS BIGINT) AS rest FROM digest),
inside AS (
  SELECT he, register, max(CASE WHEN rest = 0 THEN 53 ELSE 53 - length(bin(rest)) END) AS rank FROM inc JOIN reg ON reg.id = inc.hv GROUP BY he, register)
SELECT hv AS id, register, CAST(max(rank) AS INTEGER) AS rank FROM inc JOIN inside USING (he) GROUP BY hv, register"""

EVERYONE = ", ends AS (SELECT DISTINCT hv AS v FROM inc)"


def components(rounds: int) -> str:
    ctes = ", v0 AS MATERIALIZED (SELECT id, id AS val FROM hv)"
    for k in range(rounds):
        old = "he.id" if k == 0 else f"max(e{k - 1}.val)"
        join = "" if k == 0 else f"JOIN e{k - 1} ON e{k - 1}.id = he.id"
        ctes += f""",
e{k} AS MATERIALIZED (SELECT he.id, greatest(max(v{k}.val), {old}) AS val
  FROM inc JOIN v{k} ON v{k}.id = inc.hv JOIN he ON he.id = inc.he {join} GROUP BY he.id)"""
        if k + 1 < rounds:
            ctes += f""",
v{k + 1} AS MATERIALIZED (SELECT v{k}.id, greatest(max(e{k}.val), max(v{k}.val)) AS val
  FROM v{k} LEFT JOIN inc ON inc.hv = v{k}.id LEFT JOIN e{k} ON e{k}.id = inc.he GROUP BY v{k}.id)"""
    last = rounds - 1
    return orders(ctes + both_roles("label", "{}", f"v{last}", f"e{last}", "hv.id", "he.id"))


def mode_cte(name: str, key: str, source: str, sender: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT id, val FROM (
  SELECT inc.{key} AS id, s.val,
         row_number() OVER (PARTITION BY inc.{key} ORDER BY count(*) DESC, s.val DESC) AS r
  FROM inc JOIN {source} s ON s.id = inc.{sender} GROUP BY inc.{key}, s.val) WHERE r = 1)"""


def labels(rounds: int) -> str:
    ctes = ", v0 AS MATERIALIZED (SELECT id, id AS val FROM hv)"
    for k in range(rounds):
        ctes += ", " + mode_cte(f"e{k}", "he", f"v{k}", "hv")
        if k + 1 < rounds:
            ctes += ", " + mode_cte(f"v{k + 1}", "hv", f"e{k}", "he")
    last = rounds - 1
    return orders(ctes + both_roles("label", "{}", f"v{last}", f"e{last}", "hv.id", "0"))


def pagerank_ctes(rounds: int, entropy: bool = False) -> str:
    """v1..v{rounds-1} and e1..e{rounds-1}."""
    ctes = f""",
v1 AS MATERIALIZED (SELECT inc.hv AS id, sum(weight) AS w,
       {ALPHA} + (1.0 - {ALPHA}) * sum(1.0 / CAST(card AS DOUBLE)) AS val
  FROM inc JOIN he ON he.id = inc.he GROUP BY inc.hv)"""
    for k in range(1, rounds):
        h2 = ", log2(sum(v.val)) - sum(v.val * log2(v.val)) / sum(v.val) AS entropy" if entropy else ""
        ctes += f""",
e{k} AS MATERIALIZED (SELECT he.id, sum(v.val / v.w) * any_value(he.weight) AS val, any_value(he.card) AS card {h2}
  FROM inc JOIN v{k} v ON v.id = inc.hv JOIN he ON he.id = inc.he GROUP BY he.id)"""
        if k + 1 < rounds:
            ctes += f""",
v{k + 1} AS MATERIALIZED (SELECT inc.hv AS id, any_value(v1.w) AS w,
       {ALPHA} + (1.0 - {ALPHA}) * sum(e.val / CAST(e.card AS DOUBLE)) AS val
  FROM inc JOIN e{k} e ON e.id = inc.he JOIN v1 ON v1.id = inc.hv GROUP BY inc.hv)"""
    return ctes


def pagerank(rounds: int, base=orders) -> str:
    last = rounds - 1
    return base(
        pagerank_ctes(rounds)
        + both_roles("rank", rnd("{}"), f"v{last}", f"e{last}", "1.0", "0.0")
    )


def graph_pagerank(rounds: int, base=orders) -> str:
    ctes = weighted_edges() + ", r0 AS MATERIALIZED (SELECT id, CAST(1.0 AS DOUBLE) AS rank FROM hv)"
    for k in range(rounds):
        ctes += f""",
r{k + 1} AS MATERIALIZED (
  SELECT r{k}.id, coalesce({ALPHA} + (1.0 - {ALPHA}) * m.s, r{k}.rank) AS rank
  FROM r{k} LEFT JOIN (SELECT dst, sum(rank * attr) AS s FROM e JOIN r{k} ON r{k}.id = src GROUP BY dst) m
  ON m.dst = r{k}.id)"""
    return base(ctes + f" SELECT id, {rnd('rank')} AS rank FROM r{rounds}")


def walk(rounds: int, starts: str, restart: float, epsilon: float) -> str:
    begins = f"id IN ({starts})"
    ctes = f""", v0 AS MATERIALIZED (
  SELECT id, CASE WHEN {begins} THEN 1.0 ELSE 0.0 END AS val,
         CASE WHEN {begins} THEN 1.0 ELSE 0.0 END AS out, true AS sent FROM hv)"""
    for k in range(rounds):
        if k + 1 == rounds:
            break
        ctes += f""",
e{k} AS MATERIALIZED (SELECT he.id, any_value(weight) AS w, sum(v.out) / any_value(card) AS out
  FROM inc JOIN v{k} v ON v.id = inc.hv AND v.sent JOIN he ON he.id = inc.he GROUP BY he.id),
m{k} AS MATERIALIZED (SELECT inc.hv AS id, sum(e.w) AS w, (1.0 - {restart}) * sum(e.out) AS walked
  FROM inc JOIN e{k} e ON e.id = inc.he GROUP BY inc.hv),
v{k + 1} AS MATERIALIZED (
  SELECT v.id,
    CASE WHEN m.id IS NULL THEN v.val WHEN v.{begins} THEN {restart} + walked ELSE walked END AS val,
    walked / m.w AS out, coalesce(walked / m.w > {epsilon}, false) AS sent
  FROM v{k} v LEFT JOIN m{k} m ON m.id = v.id)"""
    return orders(
        ctes
        + f""" SELECT id, {rnd('CAST(val AS DOUBLE)')} AS value FROM v{rounds - 1}
UNION ALL SELECT id, CAST(0.0 AS DOUBLE) FROM he"""
    )


INF = "CAST('Infinity' AS DOUBLE)"


def hops(rounds: int, source: int) -> str:
    ctes = f", v0 AS MATERIALIZED (SELECT id, CASE WHEN id = {source} THEN CAST(0.0 AS DOUBLE) ELSE {INF} END AS val FROM hv)"
    for k in range(rounds):
        ctes += f""",
e{k} AS MATERIALIZED (SELECT inc.he AS id, min(v.val) + 1.0 AS val
  FROM inc JOIN v{k} v ON v.id = inc.hv GROUP BY inc.he)"""
        if k + 1 < rounds:
            ctes += f""",
v{k + 1} AS MATERIALIZED (SELECT v.id, least(min(v.val), coalesce(min(e.val), {INF})) AS val
  FROM v{k} v LEFT JOIN inc ON inc.hv = v.id LEFT JOIN e{k} e ON e.id = inc.he GROUP BY v.id)"""
    last = rounds - 1
    return orders(ctes + both_roles("distance", "{}", f"v{last}", f"e{last}", INF, INF))


def summed_hops(rounds: int, source: int) -> str:
    ctes = f""", v0 AS MATERIALIZED (
  SELECT id, CASE WHEN id = {source} THEN CAST(0.0 AS DOUBLE) ELSE {INF} END AS val, id = {source} AS sent FROM hv),
x0 AS MATERIALIZED (SELECT id, weight, {INF} AS val FROM he)"""
    for k in range(rounds):
        ctes += f""",
n{k} AS (SELECT inc.he AS id, sum(v.val + 1.0) AS msg FROM inc JOIN v{k} v ON v.id = inc.hv AND v.sent GROUP BY inc.he),
x{k + 1} AS MATERIALIZED (
  SELECT x.id, weight, CASE WHEN msg < x.val THEN msg ELSE x.val END AS val, coalesce(msg < x.val, false) AS sent
  FROM x{k} x LEFT JOIN n{k} n ON n.id = x.id)"""
        if k + 1 < rounds:
            ctes += f""",
m{k} AS (SELECT inc.hv AS id, sum(x.val) / sum(x.weight) AS msg FROM inc JOIN x{k + 1} x ON x.id = inc.he AND x.sent GROUP BY inc.hv),
v{k + 1} AS MATERIALIZED (
  SELECT v.id, CASE WHEN msg < v.val THEN msg ELSE v.val END AS val, coalesce(msg < v.val, false) AS sent
  FROM v{k} v LEFT JOIN m{k} m ON m.id = v.id)"""
    return orders(
        ctes
        + f""" SELECT id, CASE WHEN val = {INF} THEN val ELSE {rnd('val')} END AS distance FROM v{rounds - 1}
UNION ALL SELECT id, CASE WHEN val = {INF} THEN val ELSE {rnd('val')} END FROM x{rounds}"""
    )


# Fixed value: the mixing prime of the placement hash.
PRIME = "1125899906842597::HUGEINT"
TWO64 = "18446744073709551616::HUGEINT"
TWO63 = "9223372036854775808::HUGEINT"


def unsigned(x: str) -> str:
    """The product with the prime modulo 2^64, in 0..2^64-1."""
    return f"(((({x})::HUGEINT * {PRIME}) % {TWO64} + {TWO64}) % {TWO64})"


def signed(x: str) -> str:
    u = unsigned(x)
    return f"(CASE WHEN {u} >= {TWO63} THEN {u} - {TWO64} ELSE {u} END)"


def hashed(x: str, n: str | int) -> str:
    return f"(abs({signed(x)}) % ({n}))"


def positive(x: str, n: int) -> str:
    """Non-negative modulus of the product with the absolute id."""
    return f"(({signed(f'abs({x})')} % {n} + {n}) % {n})"


# Modulus and coefficients of the pair hash.
MODULUS = 2147483647
COEFFICIENTS = (1103515245, 1812433253, 1664525123, 1597334677)


def pair(first: str, second: str, n: str | int) -> str:
    low = 4294967295
    halves = [h for x in (first, second) for h in (f"(({x}) & {low})", f"((({x}) >> 32) & {low})")]
    total = " + ".join(f"({h}::HUGEINT * {c}) % {MODULUS}" for h, c in zip(halves, COEFFICIENTS))
    return f"((({total}) % {MODULUS}) % ({n}))"


def placed(part: str, source: str = "edges") -> str:
    return f"""WITH edges AS (SELECT l_partkey AS src, l_orderkey AS dst FROM lineitem)
SELECT src, dst, CAST({part} AS INTEGER) AS part FROM {source}"""


def hybrid(key: str, n: int, cutoff: int) -> str:
    other = "dst" if key == "src" else "src"
    return placed(
        f"CASE WHEN d > {cutoff} THEN {positive(other, n)} ELSE {positive(key, n)} END",
        f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS d FROM edges)",
    )


def wrapped(x: str) -> str:
    """A whole number as the signed 64-bit one that it wraps to."""
    u = f"((({x}) % {TWO64} + {TWO64}) % {TWO64})"
    return f"(CASE WHEN {u} >= {TWO63} THEN {u} - {TWO64} ELSE {u} END)"


def wide(part: str, source: str = "edges") -> str:
    """Ids spread over all 64 bits by an odd multiplier."""
    spread = wrapped("(l_orderkey::HUGEINT * 2654435761::HUGEINT * 4294967291::HUGEINT) % 18446744073709551616::HUGEINT")
    return f"""WITH edges AS (
  SELECT -(l_partkey::HUGEINT) * 4611686018427387 AS src, {spread} AS dst FROM lineitem)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST({part} AS INTEGER) AS part FROM {source}"""


def uneven_grid(n: int, side: int) -> str:
    rows = -(-n // side)
    last = n - rows * (side - 1)
    col = f"({hashed('src', n)} // {rows})"
    height = f"CASE WHEN {col} < {side - 1} THEN {rows} ELSE {last} END"
    return f"{col} * {rows} + {hashed('dst', height)}"


def greedy(key: str, n: int, rounds: int) -> str:
    """Loads after each round feed the scores of the next one."""
    other = "dst" if key == "src" else "src"
    ctes = f"""WITH edges AS (SELECT l_partkey AS src, l_orderkey AS dst FROM lineitem),
o AS MATERIALIZED (SELECT {key} AS id, {hashed(other, n)} AS bucket, count(*) AS edges FROM edges GROUP BY ALL),
nodes AS MATERIALIZED (
  SELECT id, sum(edges) AS edges, {hashed('id', n)} AS home, {pair('id', '0', rounds)} AS round FROM o GROUP BY id),
l0 AS (SELECT b AS bucket, 0.0::DOUBLE AS load FROM range({n}) r(b))"""
    for k in range(rounds):
        ctes += f""",
p{k} AS MATERIALIZED (
  SELECT id, any_value(edges) AS edges,
    CASE WHEN max(score) > max(score) FILTER (WHERE bucket = home)
         THEN min(bucket) FILTER (WHERE score = top) ELSE any_value(home) END AS part
  FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM (
    SELECT nodes.id, nodes.edges, home, l.bucket, coalesce(o.edges, 0)::DOUBLE - sqrt(l.load) AS score
    FROM nodes CROSS JOIN l{k} l LEFT JOIN o ON o.id = nodes.id AND o.bucket = l.bucket WHERE round = {k}))
  GROUP BY id),
l{k + 1} AS MATERIALIZED (
  SELECT l.bucket, load + coalesce(sum(edges), 0)::DOUBLE AS load
  FROM l{k} l LEFT JOIN p{k} ON part = l.bucket GROUP BY l.bucket, load)"""
    every = " UNION ALL ".join(f"SELECT id, part FROM p{k}" for k in range(rounds))
    return ctes + f" SELECT src, dst, CAST(part AS INTEGER) AS part FROM edges JOIN ({every}) ON id = {key}"


RECORDS = """
rec0 AS (
  SELECT format('{}-{}', l_orderkey, l_linenumber) AS title, CAST(year(l_shipdate) AS INTEGER) AS year,
         'P' || l_partkey AS a, 'S' || l_suppkey AS b
  FROM lineitem WHERE l_linenumber NOT IN (5, 6) AND year(l_shipdate) >= 1997)
"""



def build() -> dict[str, str]:
    sql = {
        "hg_summary": """SELECT (SELECT count(*) FROM part) AS num_vertices,
            (SELECT count(*) FROM orders) AS num_hyperedges, (SELECT count(*) FROM lineitem) AS num_incidences""",
        "vertex_table": "SELECT p_partkey AS id, p_name AS attr FROM part",
        "hyperedge_table": orders("SELECT id, orig_id, card, weight FROM he"),
        "all_nodes": orders("""SELECT id, 'vertex' AS role, p_name AS name FROM hv
            UNION ALL SELECT id, 'hyperedge', 'order of ' || card FROM he"""),
        "parquet_round_trip": orders("SELECT id, card, weight FROM he"),
        "csv_incidence": f"WITH {BY_LINES} SELECT id, card, weight FROM he",
        "json_records": f"WITH {RECORDS} SELECT title, year, a || '+' || b AS authors FROM rec0",
        "record_forms": """SELECT CASE l_linenumber WHEN 6 THEN 'unparsable' WHEN 5 THEN 'misshapen'
            ELSE 'record' END AS form, count(*) AS lines FROM lineitem GROUP BY form""",
        "json_hypergraph": f"""WITH {RECORDS} SELECT a AS first_author, b AS last_author,
            CAST(2 AS INTEGER) AS card, CAST(count(*) AS INTEGER) AS weight FROM rec0 GROUP BY a, b""",
        "groups_to_hypergraph": suppliers("""SELECT inc.hv AS hv_id, hv.name AS supplier, inc.he AS he_id, card, weight
            FROM inc JOIN hv ON hv.id = inc.hv JOIN he ON he.id = inc.he"""),
        "member_sets": suppliers("""SELECT label, CAST(card AS BIGINT) AS card, weight,
            CAST(list_sum(members) AS BIGINT) AS suppliers FROM sets"""),
        "max_cardinality_filter": cardinality("<= 3"),
        "min_cardinality_filter": cardinality(">= 5"),
        "id_shift": orders("SELECT orig_id, id FROM he"),
        "dense_id_table": """SELECT c_mktsegment, c_name, row_number() OVER (ORDER BY c_mktsegment, c_name) - 1 AS id
            FROM (SELECT DISTINCT c_mktsegment, c_name FROM customer)""",
        "min_id_max_id": orders("""SELECT 'vertex' AS role, min(id) AS min_id, max(id) AS max_id FROM hv
            UNION ALL SELECT 'hyperedge', min(id), max(id) FROM he"""),
        "map_vertices": orders("SELECT id, id || ':' || upper(p_name) AS attr FROM hv"),
        "map_hyperedges": orders("SELECT id, id * 10 + card AS attr FROM he"),
        "augment": orders("""SELECT id, p_name AS _1, '1.5' AS _2 FROM hv
            UNION ALL SELECT id, CAST(card AS VARCHAR), 'x' FROM he"""),
        "strip": orders("SELECT id, p_name AS attr FROM hv"),
        "update_subset": orders(""", f AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q
            FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
            SELECT id, CASE WHEN q IS NULL THEN p_name ELSE p_name || '/' || q END AS attr
            FROM hv LEFT JOIN f ON k = id"""),
        "sub_hypergraph": sub(False),
        "sub_hypergraph_keep_isolated": sub(True),
        "degrees": orders(degree_rows()),
        "dual_degrees": orders(f""", d AS ({degree_rows()})
            SELECT d.id, CASE WHEN hv.id IS NULL THEN 'vertex' ELSE 'hyperedge' END AS role, attr AS degree
            FROM d LEFT JOIN hv ON hv.id = d.id"""),
        "triplets": orders("""SELECT inc.hv AS hv_id, p_name AS hv_attr, inc.he AS he_id, card
            FROM inc JOIN hv ON hv.id = inc.hv JOIN he ON he.id = inc.he"""),
        "to_graph_sum": orders(PROJECTED + f"""
            SELECT src, dst, {rnd('sum(weight / CAST(card AS DOUBLE))')} AS attr FROM pairs GROUP BY src, dst"""),
        "to_graph_max": orders(MAX_EDGES + " SELECT src, dst, attr FROM e"),
        "to_graph_custom_fold": orders(PROJECTED + """
            SELECT src, dst, bit_or(CAST(1 << card AS INTEGER)) AS bits, max(card) AS top FROM pairs GROUP BY src, dst"""),
        "graph_degrees": purchases("""SELECT id, CAST(count(*) AS INTEGER) AS degree
            FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id"""),
        "graph_in_out_degrees": purchases("""
            SELECT dst AS id, CAST(count(*) AS INTEGER) AS degree, 'in' AS direction FROM e GROUP BY dst
            UNION ALL SELECT src, CAST(count(*) AS INTEGER), 'out' FROM e GROUP BY src"""),
        "graph_map_vertices": purchases("SELECT id, id + attr AS _1, CAST(7 AS INTEGER) AS _2 FROM v"),
        "graph_map_edges": purchases("""SELECT src, dst, a.attr * 1000 + b.attr * 10 + e.attr AS attr
            FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst"""),
        "graph_update_vertices": purchases(""", d AS (SELECT dst, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY dst)
            SELECT id, CASE WHEN n IS NULL THEN attr ELSE attr * 100 + n END AS attr FROM v LEFT JOIN d ON dst = id"""),
        "aggregate_messages": purchases("""SELECT dst AS id, CAST(sum(v.attr * e.attr) AS BIGINT) AS msg
            FROM e JOIN v ON v.id = src GROUP BY dst"""),
        "out_weights": purchases("SELECT src AS id, CAST(sum(attr) AS BIGINT) AS msg FROM e GROUP BY src"),
        "normalized_purchases": purchases(f""", t AS (SELECT src AS k, sum(attr) AS t FROM e GROUP BY src)
            SELECT src, dst, {rnd('attr / CAST(t AS DOUBLE)')} AS attr FROM e JOIN t ON k = src"""),
        "normalized_graph": suppliers(weighted_edges() + f" SELECT src, dst, {rnd('attr')} AS attr FROM e"),
        "entropy_by_group": f"""WITH s AS (SELECT l_suppkey, sum(l_quantity) AS t FROM lineitem GROUP BY l_suppkey)
            SELECT l.l_suppkey, {rnd('sum(l_quantity / t * log2(t / l_quantity))')} AS entropy
            FROM lineitem l JOIN s ON s.l_suppkey = l.l_suppkey GROUP BY l.l_suppkey""",
        "mode_label": """SELECT part, supplier FROM (
            SELECT l_partkey AS part, l_suppkey AS supplier,
                   row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey DESC) AS r
            FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE r = 1""",
        "neighbours_exact": orders(""", c AS (SELECT a.hv, count(DISTINCT b.hv) AS n
            FROM inc a JOIN inc b ON a.he = b.he GROUP BY a.hv)
            SELECT id, coalesce(n, 0) AS neighbours FROM hv LEFT JOIN c ON c.hv = id"""),
        # Sketches of up to a few hundred members count exactly.
        "neighbours_hll": orders(""", c AS (SELECT a.hv, count(DISTINCT b.hv) AS n
            FROM inc a JOIN inc b ON a.he = b.he GROUP BY a.hv),
            e AS (SELECT id, coalesce(n, 0) AS n FROM hv LEFT JOIN c ON c.hv = id)
            SELECT id, n AS estimate, CAST(floor(n - n * 0.0325::DOUBLE) AS BIGINT) AS low,
                   CAST(ceil(n + n * 0.0325::DOUBLE) AS BIGINT) AS high FROM e"""),
        "sketch_registers": orders(REGISTERS),
        "recipients_table": heard(
            "sum(inc.hv)", "(inc.hv, inc.he) IN (SELECT (l_partkey, l_orderkey + s) FROM lineitem, shift WHERE l_returnflag = 'R')", EVERYONE
        ),
        "recipients_table_except": heard("sum(inc.hv)", "inc.he NOT IN (SELECT o_orderkey + s FROM orders, shift WHERE o_orderstatus = 'F')", EVERYONE),
        "components_chain": CHAINS,
        "frontier_sizes": frontier(7, 1),
        "median_messages": orders(""", m AS (SELECT inc.he, median(p_size) AS x FROM inc JOIN hv ON hv.id = inc.hv GROUP BY inc.he),
            t AS (SELECT inc.hv, max(x) AS x FROM inc JOIN m USING (he) GROUP BY inc.hv)
            SELECT id, CAST(coalesce(x, p_size) AS DOUBLE) AS median FROM hv LEFT JOIN t ON t.hv = hv.id
            UNION ALL SELECT id, CAST(x AS DOUBLE) FROM he LEFT JOIN m ON m.he = he.id"""),
        "parquet_by_part": orders(f"""SELECT he AS he_id, inc.hv AS hv_id, CAST({hashed('inc.hv', 12)} AS INTEGER) AS part, count(*) AS copies
            FROM inc JOIN hv ON hv.id = inc.hv WHERE p_size = 50 GROUP BY ALL"""),
        "messages_by_strategy": traffic(3, 1, 12, 30),
        "pagerank_placed": pagerank(5),
        "shortest_path_placed": hops(10, 1),
        "shortest_path_prepared": f"SELECT id, a.distance AS first, b.distance AS second FROM ({hops(6, 1)}) a JOIN ({hops(6, 2)}) b USING (id)",
        "recipients_only": heard("sum(inc.hv)", "inc.he IN (first, last)", ENDS),
        "recipients_except": heard("sum(inc.hv)", "inc.he NOT IN (first, last)", ENDS),
        "message_by_destination": heard("sum(inc.he * p_size - inc.hv)", "true", ENDS),
        "multi_send": heard("sum(1 + CASE WHEN p_size > 25 THEN p_size * 100 ELSE 0 END + inc.he)", "true", ENDS),
        "conditional_send": heard("max(inc.hv)", "p_size > 40", ENDS),
        "default_combiner_map": orders("""SELECT inc.he AS id, p_brand AS brand, count(*) AS n
            FROM inc JOIN hv ON hv.id = inc.hv GROUP BY inc.he, p_brand"""),
        "folded_messages": orders(""", m AS (SELECT inc.he, max(p_size) AS top, bit_or(p_size) AS bits
            FROM inc JOIN hv ON hv.id = inc.hv GROUP BY inc.he)
            SELECT id, coalesce(top, -1) AS top, coalesce(bits, -1) AS bits FROM he LEFT JOIN m ON m.he = he.id"""),
        "connected_components_labels": components(10),
        "label_propagation_labels": labels(3),
        "pagerank_ranks": pagerank(5),
        "pagerank_weighted": pagerank(5, suppliers),
        "pagerank_entropy_values": orders(pagerank_ctes(4, entropy=True) + f"""
            SELECT he.id, {rnd('coalesce(e3.val, 0.0)')} AS rank, {rnd('coalesce(entropy, 0.0)')} AS entropy
            FROM he LEFT JOIN e3 ON e3.id = he.id"""),
        "pagerank_on_projection": graph_pagerank(3, suppliers),
        "pagerank_factored": graph_pagerank(3),
        "random_walk_values": walk(4, "1, 4", 0.15, 1e-4),
        "shortest_path_hops": hops(10, 1),
        "shortest_path_sum": summed_hops(4, 1),
        "part_1d_src": placed(hashed("src", 12)),
        "part_1d_dst": placed(hashed("dst", 12)),
        "part_2d": placed(f"{hashed('src', 4)} * 4 + {hashed('dst', 4)}"),
        "part_2d_uneven": placed(uneven_grid(12, 4)),
        "part_random": placed(pair("src", "dst", 12)),
        "part_canonical": placed(pair("least(src, dst)", "greatest(src, dst)", 12)),
        "part_default": placed(hashed("src + dst", 12)),
        "part_hybrid_src": hybrid("src", 12, 30),
        "part_hybrid_dst": hybrid("dst", 12, 4),
        "part_greedy_src": greedy("src", 12, 16),
        "part_greedy_dst": greedy("dst", 12, 16),
        "part_greedy_src_rounds": greedy("src", 12, 5),
        "part_greedy_dst_rounds": greedy("dst", 12, 40),
        "part_default_wide_ids": wide(hashed(wrapped("src + dst"), 12)),
        "part_hybrid_wide_ids": wide(
            f"CASE WHEN d > 4 THEN {positive('src', 12)} ELSE {positive('dst', 12)} END",
            "(SELECT *, count(*) OVER (PARTITION BY dst) AS d FROM edges)",
        ),
    }
    shifted = "(SELECT max(p_partkey) FROM part) - (SELECT min(o_orderkey) FROM orders) + 1"
    part = (
        f"CASE WHEN count(*) OVER (PARTITION BY dst) > 4 THEN {positive('src', 12)} ELSE {positive('dst', 12)} END"
    )
    sql["part_settled"] = f"""WITH e AS (SELECT l_partkey AS src, l_orderkey + ({shifted}) AS dst FROM lineitem)
        SELECT dst AS he_id, src AS hv_id, CAST({part} AS INTEGER) AS partition FROM e"""
    part = (
        f"CASE WHEN count(*) OVER (PARTITION BY hv) > 30 THEN {positive('he', 12)} ELSE {positive('hv', 12)} END"
    )
    sql["csv_placed"] = f"""WITH {BY_LINES}, p AS (SELECT he, CAST({part} AS INTEGER) AS part FROM inc)
        SELECT part, count(*) AS incidences FROM p JOIN he ON he.id = p.he WHERE card <= 4 GROUP BY part"""
    sql["components_of_dual"] = components(10)
    sql["components_small"] = sql["components_small_dual"] = small_components()
    sql["nested_map_messages"] = orders("""SELECT inc.he AS id, p_brand AS brand, p_size AS size, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total
        FROM inc JOIN hv ON hv.id = inc.hv GROUP BY inc.he, p_brand, p_size""")
    sql["list_messages"] = orders("""SELECT inc.he AS id, count(*) AS n, CAST(sum(inc.hv * p_size) AS BIGINT) AS total, min(inc.hv) AS low
        FROM inc JOIN hv ON hv.id = inc.hv GROUP BY inc.he""")
    sql["sketch_messages"] = sql["neighbours_wide"] = "SELECT o_orderkey AS id, true AS close FROM orders"
    sql["neighbours_exact_wide"] = """WITH lots AS (
            SELECT DISTINCT l_suppkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS he, l_orderkey AS hv FROM lineitem),
        c AS (SELECT a.hv, count(DISTINCT b.hv) AS n FROM lots a JOIN lots b ON a.he = b.he GROUP BY a.hv)
        SELECT o_orderkey AS id, coalesce(n, 0) AS neighbours FROM orders LEFT JOIN c ON c.hv = o_orderkey"""
    sql["partition_statistics"] = f"""WITH p AS ({sql['part_hybrid_src']}),
        sizes AS (SELECT part, count(*) AS n FROM p GROUP BY part),
        s AS (SELECT avg(n) AS m FROM (SELECT count(DISTINCT part) AS n FROM p GROUP BY src)),
        d AS (SELECT avg(n) AS m FROM (SELECT count(DISTINCT part) AS n FROM p GROUP BY dst))
        SELECT CAST(sum(n) AS BIGINT) AS edges, count(*) AS parts_used, max(n) AS largest_part,
               {rnd('(SELECT m FROM s)')} AS parts_per_src, {rnd('(SELECT m FROM d)')} AS parts_per_dst FROM sizes"""
    return sql
