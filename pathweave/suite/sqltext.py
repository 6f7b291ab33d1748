"""Common table expressions of the SQL side. Searches are unidirectional walks there, unlike the engine's."""

TRIPLES = """triples AS MATERIALIZED (
  SELECT 'c' || c_custkey AS s, 'P1' AS p, 'n' || c_nationkey AS o FROM customer UNION SELECT 's' || s_suppkey, 'P1', 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'P2', 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'P3', 'c' || o_custkey FROM orders
  UNION SELECT 'o' || l_orderkey, 'P4', 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 'P5', 's' || l_suppkey FROM lineitem)"""
ADJ = TRIPLES + ", adj AS MATERIALIZED (SELECT s, p, o FROM triples UNION ALL SELECT o, p || '@', s FROM triples)"
DEGREE = ADJ + ", degree AS MATERIALIZED (SELECT s AS node, count(*) AS n FROM adj GROUP BY 1)"


def walk(name: str, start: str, length: int, end: str | None = None) -> str:
    """CTEs ``name`` (node, path, nodes, len): simple walks of up to ``length`` edges, level by level."""
    out = [f"{name}0 AS (SELECT '{start}' AS node, '{start}' AS path, ['{start}'] AS nodes, 0 AS len)"]
    stop = f" AND w.node <> '{end}'" if end else ""
    for k in range(1, length + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT a.o AS node, w.path || ' ' || a.p || ' ' || a.o AS path, list_append(w.nodes, a.o) AS nodes, {k} AS len FROM {name}{k - 1} w JOIN adj a ON a.s = w.node WHERE NOT list_contains(w.nodes, a.o){stop})")
    return ", ".join(out) + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(length + 1)) + ")"


def found(pairs: list[tuple[str, str]], length: int) -> str:
    """CTE ``paths`` (pair_id, path, nodes, len) of the simple paths between each pair."""
    parts = [walk(f"w{i}_", a, length, b) for i, (a, b) in enumerate(pairs)]
    union = " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair_id, path, nodes, len FROM w{i}_ WHERE node = '{b}' AND len > 0" for i, (a, b) in enumerate(pairs))
    return ADJ + ", " + ", ".join(parts) + f", paths AS ({union})"


#: (path words and, of them, arrows with their position)
ARROWS = """, words AS (SELECT pair_id, path, len, string_split(path, ' ') AS w FROM paths),
arrows AS (SELECT pair_id, path, len, k AS pos, w[2 * k - 1] AS s, w[2 * k] AS p, w[2 * k + 1] AS o FROM (SELECT *, unnest(range(1, len + 1)) AS k FROM words))"""
#: the pattern of each path and its inner bindings
PATTERNS = ARROWS + """, pats AS (SELECT pair_id, path, len, array_to_string(list_transform(range(1, len + 1), lambda k: w[2 * k]), ' ') AS pattern FROM words),
freq AS (SELECT pattern, len AS size, count(*) AS instances FROM pats GROUP BY 1, 2),
bind AS (SELECT DISTINCT pattern, pos, o AS node FROM arrows JOIN pats USING (pair_id, path, len) WHERE pos < len),
bcount AS (SELECT pattern, pos, count(*) AS n FROM bind GROUP BY 1, 2),
supp AS (SELECT pattern, size, instances, CASE WHEN size = 1 THEN 1 ELSE m END AS min_support FROM freq LEFT JOIN (SELECT pattern, min(n) AS m FROM bcount GROUP BY 1) USING (pattern))"""
