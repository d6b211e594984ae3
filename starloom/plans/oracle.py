"""The derived views and the registry of checked queries, in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "truth": ((), """
SELECT p_partkey AS truth_id, CAST(FLOOR(p_partkey / 2e3) AS BIGINT) AS field_id,
       ((p_partkey * 7919) % 10007) / 1e2 AS x, ((p_partkey * 104729) % 10009) / 1e2 AS y,
       2e0 + ((p_partkey * 13) % 997) / 1e1 AS f0
FROM part"""),
    "det": (("truth",), """
SELECT field_id, sample_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY field_id, sample_id ORDER BY f0 DESC, x, y, truth_id, okey, lnum) - 1 AS BIGINT) AS src,
       x, y, f0, f0 * (1e0 - disc) AS f1, f0 * (1e0 + tax) * 1.1e0 AS f2
FROM (SELECT DISTINCT t.field_id, l_orderkey % 30 AS sample_id, t.truth_id, l_orderkey AS okey, l_linenumber AS lnum,
             t.x + (((l_orderkey * 31 + l_linenumber * 17) % 101) - 50) / 2e2 AS x,
             t.y + (((l_orderkey * 37 + l_linenumber * 29) % 103) - 51) / 2e2 AS y,
             t.f0 * (0.75e0 + l_quantity / 1e2) AS f0, l_discount AS disc, l_tax AS tax
      FROM lineitem JOIN truth t ON l_partkey = t.truth_id) d"""),
    "chain": ((), """
SELECT user_id % 4 AS chain_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS i, value
FROM events"""),
    "proposals": ((), """
SELECT event_id AS step, CAST(FLOOR(event_id / 1e3) AS BIGINT) AS sample, event_type AS move, ts,
       CASE WHEN value < 50 THEN 1e0 ELSE 0e0 END AS accepted,
       CASE WHEN value > 150 THEN 1e0 ELSE 0e0 END AS out_of_bounds, value AS ms
FROM events"""),
    "pix": ((), """
SELECT map_id, CAST(FLOOR(p / 3.2e1) AS BIGINT) AS row_, p % 32 AS col_, image, error, mask
FROM (SELECT CAST(FLOOR(o_orderkey / 1.024e3) AS BIGINT) AS map_id, o_orderkey % 1024 AS p,
             o_totalprice / 1e5 AS image,
             CASE WHEN o_custkey % 97 = 0 THEN 0e0 ELSE 0.1e0 + (o_custkey % 10) / 2e1 END AS error,
             CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS mask FROM orders) q"""),
    "xev": ((), """
SELECT event_id, ts, ((event_id * 7919) % 10007) / 1e2 AS x, ((event_id * 104729) % 10009) / 1e2 AS y,
       5e2 + value * 4e1 AS energy, user_id % 3 AS obsid
FROM events"""),
    "models": ((), """
SELECT CAST(l_linenumber AS BIGINT) AS sample_id, CAST(FLOOR(l_orderkey / 1.024e3) AS BIGINT) AS map_id,
       CAST(FLOOR((l_orderkey % 1024) / 3.2e1) AS BIGINT) AS row_, (l_orderkey % 1024) % 32 AS col_,
       AVG(l_extendedprice) / 3e4 AS model
FROM lineitem GROUP BY l_linenumber, l_orderkey"""),
    "coeffs": ((), """
SELECT CAST(FLOOR(event_id / 3.6e1) AS BIGINT) AS sample_id, CAST(FLOOR(event_id % 36 / 1.2e1) AS BIGINT) AS i,
       CAST(FLOOR(event_id % 36 % 12 / 4e0) AS BIGINT) AS j, event_id % 36 % 4 AS k, (value - 5e1) / 1e2 AS value
FROM events"""),
    "runs": ((), """
SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey AS started,
       'field_sim_' || LPAD(CAST(o_custkey % 300 AS VARCHAR), 3, '0') AS tail_name, o_orderstatus AS status
FROM orders"""),
    "amps": ((), """
SELECT CAST(FLOOR(event_id / 1e3) AS BIGINT) AS sample_id, user_id % 2 AS tmpl, event_id % 3 AS band, AVG(value) / 5e1 AS amp
FROM events GROUP BY 1, 2, 3"""),
    "pairs": ((), """
SELECT DISTINCT l_partkey AS cfg_id, l_orderkey % 30 AS sample_id, l_orderkey * 8 + l_linenumber AS det_id,
       (((l_orderkey * 31 + l_linenumber * 17) % 101) - 50) / 2e2 AS x,
       (((l_orderkey * 37 + l_linenumber * 29) % 103) - 51) / 2e2 AS y, 2.5e2 + l_quantity * 2e1 AS f
FROM lineitem"""),
}

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def sql(body: str, *views: str) -> str:
    """`body` under the WITH clauses of the views it uses."""
    order: list[str] = []

    def need(name):
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for view in views:
        need(view)
    body = body.strip()
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in order]
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts + [body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts + [body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def num(value: float) -> str:
    """A DOUBLE literal both engines read the same way."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def bin_case(column: str, edges, last_closed: bool = False) -> str:
    """The bin rule as one CASE, written independently of the Spark side."""
    arms = []
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        op = "<=" if last_closed and k == len(edges) - 2 else "<"
        arms.append(f"WHEN {column} >= {num(lo)} AND {column} {op} {num(hi)} THEN {k}")
    return "CAST(CASE " + " ".join(arms) + " END AS BIGINT)"


def bin_rows(edges) -> str:
    rows = ", ".join(f"({k}, {num(a)}, {num(b)})" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return f"(SELECT CAST(b AS BIGINT) AS bin, lo, hi FROM (VALUES {rows}) v(b, lo, hi))"


def nudged(expr: str, digits: int) -> str:
    """Rounding for values that are short decimals: they often end exactly on
    half a unit, where the last bit of a sum would decide. Both sides move such
    values by the same small part of a unit first."""
    return f"ROUND({expr} + 3e-{digits + 2}, {digits}) + 0e0"


def rounded(df: DataFrame, digits: int, *columns: str, nudge: bool = False) -> DataFrame:
    """Round the named columns; all DOUBLE columns when none is named."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    shift = F.lit(float(f"3e-{digits + 2}")) if nudge else F.lit(0.0)
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({n: F.round(F.col(n) + shift, digits) + F.lit(0.0) for n in names})
