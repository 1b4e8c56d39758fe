"""Named graph queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import neural
from ..operators import blocks, diffusion, grid, hubs, linalg, partition, prepare
from ..sources import graphs
from ..sources.store import store
from . import train as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PRIME = graphs.PRIME


def r6(x):
    """Six digits, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def sql_uniform(i: str, j: str, layer: int) -> str:
    a = f"(({i} * 4099 + {j} * 131 + {layer * 7919 + 1}) * 48271 % {PRIME})"
    return f"((({a} * ({a} % 65536 + 1) + {layer}) % {PRIME} * 16807 + {j}) % {PRIME} / {PRIME}.0)"


def sql_weights(rows: int, cols: int, layer: int) -> str:
    return f"SELECT i, j, {sql_uniform('i', 'j', layer)} AS v FROM (SELECT unnest(range({rows})) AS i) CROSS JOIN (SELECT unnest(range({cols})) AS j)"


GRAPH = """
n AS (SELECT count(*)::BIGINT AS n FROM embeddings),
nodes AS (SELECT vec_id AS node_id, label AS y, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM embeddings),
x AS (SELECT vec_id AS node_id, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
raw AS (SELECT l_orderkey % n AS src, l_partkey % n AS dst FROM lineitem, n),
edges AS (SELECT src, dst FROM raw WHERE src <> dst UNION SELECT dst, src FROM raw WHERE src <> dst),
loops AS (SELECT src, dst FROM edges UNION ALL SELECT node_id, node_id FROM nodes),
deg AS (SELECT src AS node_id, count(*) AS d FROM loops GROUP BY src),
adj AS (SELECT src, dst, (1 / sqrt(a.d)) * (1 / sqrt(b.d)) AS w FROM loops JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst)
"""
MX = "mx AS (SELECT dst AS node_id, f, sum(w * v) AS v FROM adj JOIN x ON node_id = src GROUP BY ALL)"


def sql_forward(k: int = 0, act: bool = True) -> str:
    """z1, h1, z2 and p of step k from w1_k and w2_k."""
    h = "greatest(v, 0)" if act else "v"
    p = (
        f"SELECT node_id, f, v - max(v) OVER w - ln(sum(e) OVER w) AS v FROM (SELECT *, exp(v - max(v) OVER (PARTITION BY node_id)) AS e FROM z2_{k}) WINDOW w AS (PARTITION BY node_id)"
        if act
        else f"SELECT * FROM z2_{k}"
    )
    return f"""
z1_{k} AS (SELECT node_id, j AS f, sum(m.v * w.v) AS v FROM mx m JOIN w1_{k} w ON f = i GROUP BY ALL),
h1_{k} AS (SELECT node_id, f, {h} AS v FROM z1_{k}),
mh_{k} AS (SELECT dst AS node_id, f, sum(w * v) AS v FROM adj JOIN h1_{k} ON node_id = src GROUP BY ALL),
z2_{k} AS (SELECT node_id, j AS f, sum(m.v * w.v) AS v FROM mh_{k} m JOIN w2_{k} w ON f = i GROUP BY ALL),
p_{k} AS ({p})"""


def sql_backward(k: int = 0) -> str:
    return f"""
g2_{k} AS (SELECT node_id, f, (exp(v) - (f = y)::INT) / (SELECT count(*) FROM nodes WHERE split = 'train') AS v FROM p_{k} JOIN nodes USING (node_id) WHERE split = 'train'),
ag_{k} AS (SELECT src AS node_id, f, sum(w * v) AS v FROM adj JOIN g2_{k} ON node_id = dst GROUP BY ALL),
dw2_{k} AS (SELECT h.f AS i, a.f AS j, sum(h.v * a.v) AS v FROM h1_{k} h JOIN ag_{k} a USING (node_id) GROUP BY ALL),
g1_{k} AS (SELECT node_id, i AS f, CASE WHEN z.v > 0 THEN sum(a.v * w.v) ELSE 0 END AS v FROM ag_{k} a JOIN w2_{k} w ON a.f = w.j JOIN z1_{k} z USING (node_id) WHERE z.f = w.i GROUP BY node_id, i, z.v),
dw1_{k} AS (SELECT m.f AS i, g.f AS j, sum(m.v * g.v) AS v FROM mx m JOIN g1_{k} g USING (node_id) GROUP BY ALL)"""


def sql_adam(k: int) -> str:
    """Weights and moments of step k + 1."""
    out = []
    for layer in (1, 2):
        m = f"0.9 * coalesce(a.m, 0) + 0.1 * g.v AS m, 0.999 * coalesce(a.q, 0) + 0.001 * g.v * g.v AS q" if k else "0.1 * g.v AS m, 0.001 * g.v * g.v AS q"
        old = f" JOIN a{layer}_{k} a USING (i, j)" if k else ""
        out.append(f"a{layer}_{k + 1} AS (SELECT i, j, {m} FROM dw{layer}_{k} g{old})")
        out.append(f"w{layer}_{k + 1} AS (SELECT i, j, w.v - 0.01 * (m / (1 - 0.9 ** {k + 1})) / (sqrt(q / (1 - 0.999 ** {k + 1})) + 1e-8) AS v FROM w{layer}_{k} w JOIN a{layer}_{k + 1} USING (i, j))")
    return ",\n".join(out)


W0 = f"w1_0 AS ({sql_weights(64, 16, 1)}), w2_0 AS ({sql_weights(16, 10, 2)})"
FORWARD = f"{MX}, {W0}, {sql_forward()}"
LINEAR = f"{MX}, {W0}, {sql_forward(act=False)}"
BACKWARD = f"{FORWARD}, {sql_backward()}"


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([GRAPH.strip(), *(p.strip() for p in parts)]) + "\n" + select


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- sources -----------------------------------------------------------------


@query(sql("SELECT src, dst FROM raw"))
def edges_scan(spark, d):
    return graphs.coo_edges(spark, d)


@query(sql("SELECT dst AS src, src AS dst FROM raw"))
def edges_reverse(spark, d):
    return prepare.transpose(graphs.coo_edges(spark, d))


@query(sql("SELECT node_id, y, split, count(*) AS width, round(sum(v), 6) + 0.0 AS x_sum FROM nodes JOIN x USING (node_id) GROUP BY ALL"))
def nodes_scan(spark, d):
    return graphs.nodes(spark, d).select("node_id", "y", "split", F.size("x").cast("long").alias("width"), r6(neural.total("x")).alias("x_sum"))


@query(sql(f"SELECT node_id, f::INT AS f, {sql_uniform('node_id', 'f', 11)} AS v FROM nodes CROSS JOIN (SELECT unnest(range(16)) AS f)"))
def synth_features(spark, d):
    return graphs.synthetic_features(graphs.nodes(spark, d), 16)


@query(sql(f"SELECT node_id, floor({sql_uniform('node_id', '0', 12)} * 23)::INT AS y FROM nodes"))
def synth_labels(spark, d):
    return graphs.synthetic_labels(graphs.nodes(spark, d), 24)


@query(sql("SELECT split, count(*) AS n FROM nodes GROUP BY split"))
def split_counts(spark, d):
    return graphs.nodes(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- preparation -------------------------------------------------------------


def _loops(spark, d):
    ids = graphs.nodes(spark, d)
    return prepare.with_self_loops(prepare.symmetric(graphs.coo_edges(spark, d)), ids), ids


@query(sql("SELECT DISTINCT src, dst FROM raw"))
def edges_distinct(spark, d):
    return prepare.distinct_edges(graphs.coo_edges(spark, d))


@query(sql("SELECT src, dst, count(*) AS w FROM raw GROUP BY ALL"))
def edges_multiplicity(spark, d):
    return prepare.summed_edges(graphs.coo_edges(spark, d))


@query(sql("SELECT src, dst FROM loops"))
def self_loops(spark, d):
    return _loops(spark, d)[0]


@query(sql("SELECT node_id, coalesce(d, 0) AS d FROM nodes LEFT JOIN (SELECT src AS node_id, count(*) AS d FROM raw GROUP BY src) USING (node_id)"))
def degree(spark, d):
    return prepare.degrees(graphs.coo_edges(spark, d), graphs.nodes(spark, d))


@query(sql("SELECT d, count(*) AS nodes FROM deg GROUP BY d"))
def degree_histogram(spark, d):
    return prepare.degrees(*_loops(spark, d)).groupBy("d").agg(F.count(F.lit(1)).alias("nodes"))


@query(sql("SELECT node_id, round(1 / sqrt(d), 6) AS r FROM deg"))
def inv_sqrt_degree(spark, d):
    return prepare.degrees(*_loops(spark, d)).select("node_id", F.round(prepare.inverse_root(F.col("d")), 6).alias("r"))


def _adj(spark, d):
    return prepare.normalised(*_loops(spark, d))


@query(sql("SELECT src, dst, round(w, 6) AS w FROM adj"))
def norm_adj(spark, d):
    return _adj(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


@query(
    sql(
        "SELECT src, dst, round(m / sqrt(a.d) / sqrt(b.d), 6) AS w FROM plus JOIN pd a ON a.node_id = src JOIN pd b ON b.node_id = dst",
        "plus AS (SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM loops UNION ALL SELECT node_id, node_id FROM nodes) GROUP BY ALL)",
        "pd AS (SELECT src AS node_id, sum(m) AS d FROM plus GROUP BY src)",
    )
)
def norm_adj_plus_i(spark, d):
    return prepare.normalised_plus_identity(*_loops(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@query(sql("SELECT dst AS src, src AS dst, round(w, 6) AS w FROM adj"))
def adj_transpose(spark, d):
    return prepare.transpose(_adj(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@query(sql("SELECT a.src, b.dst, round(sum(a.w * b.w), 6) AS w FROM adj a JOIN adj b ON a.dst = b.src GROUP BY ALL"))
def spspmm_two_hop(spark, d):
    edges, ids = _loops(spark, d)
    adj = prepare.normalised(store(edges, "edges"), ids)  # written, so that repeated edges are shuffled once
    return prepare.multiply(adj, adj).select("src", "dst", F.round("w", 6).alias("w"))


@query(sql("SELECT node_id, f::INT AS f, round(v / greatest(sum(v) OVER (PARTITION BY node_id), 1), 6) + 0.0 AS v FROM x"))
def feature_row_norm(spark, d):
    return linalg.to_long(prepare.row_normalised(graphs.nodes(spark, d))).select("node_id", "f", r6("v").alias("v"))


_STEP = "s1 AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 0.95 * w AS w FROM adj UNION ALL SELECT node_id, node_id, 0.05 FROM nodes) GROUP BY ALL)"


@query(sql("SELECT src, dst, round(w, 6) AS w FROM s1", _STEP))
def ppr_step(spark, d):
    return prepare.pagerank_step(_adj(spark, d), None, graphs.nodes(spark, d), 0.05).select("src", "dst", F.round("w", 6).alias("w"))


def _sql_inverse(doublings: int) -> str:
    """ppr: 0.05 (I - 0.95 T)^-1 as the sum of its series: each doubling adds as many terms as there are, by the power of that number. T and with it all powers are symmetric, so rows are columns, too."""
    row = "SELECT a.p AS p, list({} ORDER BY b.p) AS x FROM nodes_at a CROSS JOIN nodes_at b LEFT JOIN adj ON src = a.node_id AND dst = b.node_id GROUP BY a.p"
    out = ["nodes_at AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS p FROM nodes)"]
    out.append(f"t0 AS MATERIALIZED ({row.format('0.95 * coalesce(w, 0)')})")
    out.append(f"i0 AS MATERIALIZED ({row.format('CASE WHEN a.p = b.p THEN 0.05::DOUBLE ELSE 0 END')})")
    for k in range(doublings):
        out.append(f"i{k + 1} AS MATERIALIZED (SELECT a.p, list(list_dot_product(a.x, b.x) + b.x[a.p] ORDER BY b.p) AS x FROM t{k} a CROSS JOIN i{k} b GROUP BY a.p)")
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT a.p, list(list_dot_product(a.x, b.x) ORDER BY b.p) AS x FROM t{k} a CROSS JOIN t{k} b GROUP BY a.p)")
    out.append(f"cells AS (SELECT p, unnest(range(1, len(x) + 1)) AS q, unnest(x) AS w FROM i{doublings})")
    out.append("ppr AS (SELECT a.node_id AS src, b.node_id AS dst, w FROM cells c JOIN nodes_at a ON a.p = c.p JOIN nodes_at b ON b.p = c.q WHERE w > 0)")
    return ",\n".join(out)


@query(sql("SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) AS w FROM (SELECT * FROM ppr QUALIFY row_number() OVER (PARTITION BY dst ORDER BY round(w, 12) DESC, src) <= 128)", _sql_inverse(10)))
def ppr_topk(spark, d):
    """The 128 largest entries of each column of the whole diffusion, divided by their sum."""
    edges, ids = _loops(spark, d)
    return diffusion.pagerank_top(prepare.normalised(store(edges, "edges"), ids), ids, 0.05, 128).select("src", "dst", F.round("w", 6).alias("w"))


_EPS, _ALPHA = 2.5e-5, 0.05


def _sql_push(steps: int) -> str:
    out = ["q0 AS (SELECT node_id AS src, node_id AS dst, 0.0::DOUBLE AS p, 1.0::DOUBLE AS r FROM nodes)"]
    for k in range(steps):
        out.append(f"f{k} AS (SELECT s.src, s.dst, s.r FROM q{k} s JOIN deg a ON a.node_id = s.src JOIN deg b ON b.node_id = s.dst WHERE s.r > {_EPS} * sqrt(a.d) * sqrt(b.d))")
        stay = f"SELECT s.src, s.dst, s.p + {_ALPHA} * coalesce(f.r, 0) AS p, CASE WHEN f.r IS NULL THEN s.r ELSE 0 END AS r FROM q{k} s LEFT JOIN f{k} f USING (src, dst)"
        moved = f"SELECT a.src, f.dst, 0, sum({1 - _ALPHA} * a.w * f.r) FROM f{k} f JOIN adj a ON a.dst = f.src GROUP BY ALL"
        out.append(f"q{k + 1} AS (SELECT src, dst, sum(p) AS p, sum(r) AS r FROM ({stay} UNION ALL {moved}) GROUP BY ALL)")
    return ",\n".join(out)


def _pushed(spark, d, steps: int) -> DataFrame:
    edges, ids = _loops(spark, d)
    return prepare.push_pagerank(_adj(spark, d), ids, prepare.degrees(edges, ids), _ALPHA, _EPS, steps)


@query(sql("SELECT src, dst, round(p, 9) AS p, round(r, 9) AS r FROM q3", _sql_push(3)))
def ppr_push(spark, d):
    """Three rounds of pushing residuals above a threshold."""
    return _pushed(spark, d, 3).select("src", "dst", F.round("p", 9).alias("p"), F.round("r", 9).alias("r"))


@query(sql("SELECT src, dst, round(p / sum(p) OVER (PARTITION BY dst), 6) AS w FROM (SELECT * FROM q2 WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY round(p, 9) DESC, src) <= 128)", _sql_push(2)))
def ppr_push_topk(spark, d):
    """The 128 largest estimates of each column after two rounds, divided by their sum."""
    state = _pushed(spark, d, 2).where("p > 0").select("src", "dst", F.col("p").alias("w"))
    top = prepare.column_top(state.withColumn("_p", F.round("w", 9)), 128, "_p")
    return top.select("src", "dst", F.round("w", 6).alias("w"))


_NAMED = """
ids AS (SELECT p_partkey * 3 + 1 AS raw, dense_rank() OVER (ORDER BY p_partkey) - 1 AS node_id FROM part),
named AS (SELECT DISTINCT l_partkey * 3 + 1 AS src, l_suppkey * 3 + 1 AS dst FROM lineitem)"""


@query(f"WITH {_NAMED} SELECT a.node_id, count(*) AS d, min(b.node_id) AS first_dst FROM named JOIN ids a ON a.raw = src JOIN ids b ON b.raw = dst GROUP BY ALL")
def load_graph(spark, d):
    """Out-degrees of a graph whose ids have gaps, numbered anew when it is loaded."""
    nodes = graphs.table(spark, d, "part").select((F.col("p_partkey") * 3 + 1).alias("node_id"))
    edges = graphs.table(spark, d, "lineitem").select((F.col("l_partkey") * 3 + 1).alias("src"), (F.col("l_suppkey") * 3 + 1).alias("dst"))
    _, numbered = graphs.checked_graph(nodes, edges)
    return prepare.distinct_edges(numbered).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"), F.min("dst").alias("first_dst"))


# --- layouts -----------------------------------------------------------------


def _ceil(x: str, k: int) -> tuple[str, str]:
    b = f"ceil(n / {k}.0)::BIGINT"
    return f"({x} // {b})", f"({x} % {b})"


def _floor(x: str, k: int) -> tuple[str, str]:
    block = f"least({x} // (n // {k}), {k - 1})"
    return block, f"({x} - {block} * (n // {k}))"


@query(sql(f"SELECT src, dst, {_ceil('src', 4)[0]} AS block, {_ceil('src', 4)[1]} AS local FROM edges, n"))
def split_coo_1d(spark, d):
    block, local = partition.ceil_block(F.col("src"), graphs.node_count(spark, d), 4)
    return prepare.symmetric(graphs.coo_edges(spark, d)).select("src", "dst", block.alias("block"), local.alias("local"))


@query(sql(f"SELECT src, dst, {_floor('src', 3)[0]} AS brow, {_floor('dst', 3)[0]} AS bcol, {_floor('src', 3)[1]} AS lrow, {_floor('dst', 3)[1]} AS lcol FROM edges, n"))
def split_coo_2d(spark, d):
    n = graphs.node_count(spark, d)
    (r, lr), (c, lc) = (partition.floor_block(F.col(x), n, 3) for x in ("src", "dst"))
    return prepare.symmetric(graphs.coo_edges(spark, d)).select("src", "dst", r.alias("brow"), c.alias("bcol"), lr.alias("lrow"), lc.alias("lcol"))


@query(sql(f"SELECT {_floor('node_id', 3)[0]} AS brow, least(f // 21, 2) AS bcol, count(*) AS cells, round(sum(v), 6) + 0.0 AS total FROM x, n GROUP BY ALL"))
def feature_blocks_2d(spark, d):
    n = graphs.node_count(spark, d)
    rows = linalg.to_long(graphs.nodes(spark, d))
    brow, bcol = partition.floor_block(F.col("node_id"), n, 3)[0], partition.floor_block(F.col("f").cast("long"), 64, 3)[0]
    return rows.groupBy(brow.alias("brow"), bcol.alias("bcol")).agg(F.count(F.lit(1)).alias("cells"), r6(F.sum("v")).alias("total"))


@query(sql(f"SELECT {_ceil('src', 4)[0]} AS brow, {_ceil('dst', 4)[0]} AS bcol, count(*) AS nnz FROM loops, n GROUP BY ALL"))
def block_nnz_1d(spark, d):
    n = graphs.node_count(spark, d)
    r, c = (partition.ceil_block(F.col(x), n, 4)[0] for x in ("src", "dst"))
    return _loops(spark, d)[0].groupBy(r.alias("brow"), c.alias("bcol")).agg(F.count(F.lit(1)).alias("nnz"))


@query(sql(f"SELECT brow, bcol, least(bcol // 2, 1) AS replica, count(*) AS nnz FROM (SELECT {_ceil('src', 4)[0]} AS bcol, {_ceil('dst', 4)[0]} AS brow FROM loops, n) GROUP BY ALL"))
def block_nnz_15d(spark, d):
    """8 ranks, 2 replicas: 4 row blocks; a replica multiplies half of the source blocks."""
    n = graphs.node_count(spark, d)
    c, r = (partition.ceil_block(F.col(x), n, 4)[0] for x in ("src", "dst"))
    rows = _loops(spark, d)[0].select(r.alias("brow"), c.alias("bcol"))
    return rows.groupBy("brow", "bcol", partition.stage_owner(F.col("bcol"), 8, 2).alias("replica")).agg(F.count(F.lit(1)).alias("nnz"))


@query(sql(f"SELECT {_floor('src', 3)[0]} AS brow, {_floor('dst', 3)[0]} AS bcol, count(*) AS nnz FROM loops, n GROUP BY ALL"))
def block_nnz_2d(spark, d):
    n = graphs.node_count(spark, d)
    r, c = (partition.floor_block(F.col(x), n, 3)[0] for x in ("src", "dst"))
    return _loops(spark, d)[0].groupBy(r.alias("brow"), c.alias("bcol")).agg(F.count(F.lit(1)).alias("nnz"))


_LAYER = "least({at} // greatest((CASE WHEN {k} = 1 THEN n - n // 2 ELSE n // 2 END) // 2, 1), 1)"


@query(sql(f"SELECT brow, bcol, {_LAYER.format(at='pos', k='bcol')} AS layer, count(*) AS nnz FROM (SELECT {_floor('src', 2)[0]} AS brow, {_floor('dst', 2)[0]} AS bcol, {_floor('dst', 2)[1]} AS pos, n FROM loops, n) GROUP BY ALL"))
def block_nnz_3d(spark, d):
    """8 ranks as a cube: 2 x 2 blocks whose columns are split into 2 layers."""
    n = graphs.node_count(spark, d)
    r = partition.floor_block(F.col("src"), n, 2)[0]
    c, at = partition.floor_block(F.col("dst"), n, 2)
    rows = _loops(spark, d)[0].select(r.alias("brow"), c.alias("bcol"), at.alias("at"))
    size = F.when(F.col("bcol") == 1, n - n // 2).otherwise(n // 2)
    layer = F.least(F.floor(F.col("at") / F.greatest(F.floor(size / 2), F.lit(1))), F.lit(1))
    return rows.groupBy("brow", "bcol", layer.alias("layer")).agg(F.count(F.lit(1)).alias("nnz"))


_CELLS = {
    "1d": (_ceil("src", 4)[0], "0", 1, 4),
    "15d": (f"least({_ceil('src', 4)[0]} // 2, 1)", _ceil("dst", 4)[0], 4, 2),
    "2d": (_floor("src", 3)[0], _floor("dst", 3)[0], 3, 3),
    "3d": (f"({_floor('src', 2)[0]}) * 2 + " + _LAYER.format(at=f"({_floor('src', 2)[1]})", k=f"({_floor('src', 2)[0]})"), _floor("dst", 2)[0], 2, 4),
}
_PARTS = {"1d": 4, "15d": 8, "2d": 9, "3d": 8}


def _sql_traffic() -> str:
    out = []
    for kind, (column, row, _, columns) in _CELLS.items():
        cell = f"({row}) * {columns} + ({column})"
        out.append(f"SELECT '{kind}' AS layout, cell::INT AS cell, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS sums FROM (SELECT {cell} AS cell, src, dst FROM loops, n) GROUP BY cell")
    return " UNION ALL ".join(out)


@query(sql(_sql_traffic()))
def block_traffic(spark, d):
    """For each layout and cell: its edges, the sources whose rows it uses, and the partial sums that it sends on. What moves is sources and sums; edges stay."""
    n = graphs.node_count(spark, d)
    edges = _loops(spark, d)[0]
    parts = None
    for kind, size in _PARTS.items():
        lay = blocks.layout(kind, n, size)
        rows = edges.withColumn("cell", lay.cell(F.col("src"), F.col("dst"))).groupBy("cell")
        part = rows.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("sums")).select(F.lit(kind).alias("layout"), "cell", "edges", "sources", "sums")
        parts = part if parts is None else parts.unionByName(part)
    return parts


# --- products ----------------------------------------------------------------

_LONG = "SELECT node_id, f::INT AS f, round(v, 6) + 0.0 AS v FROM {}"


def _long(m: DataFrame) -> DataFrame:
    return linalg.to_long(m).select("node_id", "f", r6("v").alias("v"))


@query(sql(_LONG.format("mx"), MX))
def spmm(spark, d):
    return _long(linalg.spmm(_adj(spark, d), graphs.nodes(spark, d), 64))


def _blocked(spark, d, kind: str) -> DataFrame:
    n = graphs.node_count(spark, d)
    stored = blocks.store_blocks(_adj(spark, d), blocks.layout(kind, n, _PARTS[kind]), 2 * graphs.coo_edges(spark, d).count() + n)
    return _long(blocks.spmm(stored, graphs.nodes(spark, d), 64))


@query(sql(_LONG.format("mx"), MX))
def spmm_1d(spark, d):
    return _blocked(spark, d, "1d")


@query(sql(_LONG.format("mx"), MX))
def spmm_15d(spark, d):
    return _blocked(spark, d, "15d")


@query(sql(_LONG.format("mx"), MX))
def spmm_2d(spark, d):
    return _blocked(spark, d, "2d")


@query(sql(_LONG.format("mx"), MX))
def spmm_3d(spark, d):
    return _blocked(spark, d, "3d")


_TRADE = """
trade AS (SELECT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
ways AS (SELECT * FROM trade UNION ALL SELECT dst, src, w FROM trade),
things AS (SELECT DISTINCT src AS node_id FROM ways),
own AS (SELECT node_id, unnest(range(4)) AS f FROM things)"""


def _trade(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers (odd ids) and parts (even ids) that they sell, in both directions with the number of sales; four features of each node. A supplier is a hub."""
    pairs = graphs.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    one = pairs.agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = one.unionByName(prepare.transpose(one))
    ids = both.select(F.col("src").alias("node_id")).distinct()
    return both, ids.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda f: graphs.uniform(F.col("node_id"), f, 11)))


@query(f"WITH {_TRADE} SELECT dst AS node_id, f::INT AS f, round(sum(w * {sql_uniform('node_id', 'f', 11)}), 6) AS v FROM ways JOIN own ON node_id = src GROUP BY ALL")
def spmm_hubs(spark, d):
    """Sums over a graph with hubs: a node of more than 200 edges is split into parts of so many."""
    adj, x = _trade(spark, d)
    heavy = hubs.heavy_keys(adj, "src", 200)
    return linalg.to_long(hubs.spmm(hubs.with_part(adj, "src", heavy, ["dst"]), x, 4, heavy)).select("node_id", "f", F.round("v", 6).alias("v"))


_COBUY = """
bought AS (SELECT l_orderkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
sold AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL)"""


@query(f"WITH {_COBUY} SELECT a.src, b.dst, round(sum(a.w * b.w), 6) AS w FROM bought a JOIN sold b ON a.dst = b.src GROUP BY ALL")
def spspmm_hubs(spark, d):
    """Orders times suppliers by the parts between them; the products of a part are dealt over blocks of orders and of suppliers, and made where they are added."""
    lines = graphs.table(spark, d, "lineitem")
    n = lines.count()
    parts, slices = grid.blocks_of(n, 8), grid.blocks_of(n)
    # entries are put together in the tasks that write their blocks, so each side is shuffled once
    bought = grid.by_block(lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity"), "src", parts).groupBy("block", "src", "dst").agg(F.sum("l_quantity").alias("w"))
    sold = grid.by_block(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), "dst", slices).groupBy("block", "src", "dst").agg(F.count(F.lit(1)).alias("w"))
    return prepare.multiply_dealt(bought, sold, parts, slices, 1000).select("src", "dst", F.round("w", 6).alias("w"))


_IJ = "SELECT i::INT AS i, j::INT AS j, round(v, 6) + 0.0 AS v FROM {}"


def _ij(m: DataFrame) -> DataFrame:
    return m.select("i", "j", r6("v").alias("v"))


@query(sql(_IJ.format("(SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (node_id) GROUP BY ALL)")))
def dense_mm(spark, d):
    x = graphs.nodes(spark, d)
    return _ij(linalg.gram(x, x))


@query(sql("SELECT f::INT AS node_id, node_id AS f, round(v, 6) + 0.0 AS v FROM x"))
def dense_transpose(spark, d):
    return linalg.to_long(graphs.nodes(spark, d)).select(F.col("f").alias("node_id"), F.col("node_id").alias("f"), r6("v").alias("v"))


@query(sql(_LONG.format("(SELECT node_id, j AS f, sum(x.v * w.v) AS v FROM x JOIN w1_0 w ON f = i GROUP BY ALL)"), W0))
def node_transform(spark, d):
    return _long(linalg.node_transform(graphs.nodes(spark, d), graphs.weights(64, 16, 1)).select("node_id", "x"))


@query(sql(_IJ.format("(SELECT x.f AS i, m.f AS j, sum(x.v * m.v) AS v FROM x JOIN mx m USING (node_id) GROUP BY ALL)"), MX))
def grad_weight(spark, d):
    x = graphs.nodes(spark, d)
    return _ij(linalg.gram(x, linalg.spmm(_adj(spark, d), x, 64)))


# --- layers, loss, gradients -------------------------------------------------


@query(sql("SELECT node_id, f::INT AS f, round(greatest(v, 0), 6) + 0.0 AS v FROM x"))
def relu(spark, d):
    return _long(graphs.nodes(spark, d).select("node_id", neural.relu("x").alias("x")))


@query(sql("SELECT node_id, f::INT AS f, CASE WHEN x.v > 0 THEN round(m.v, 6) + 0.0 ELSE 0 END AS v FROM x JOIN mx m USING (node_id, f)", MX))
def relu_grad(spark, d):
    x = graphs.nodes(spark, d)
    g = linalg.spmm(_adj(spark, d), x, 64).withColumnRenamed("x", "g")
    return _long(x.join(g, "node_id").select("node_id", neural.relu_grad("x", "g").alias("x")))


_LSM = "SELECT node_id, f::INT AS f, round(v - max(v) OVER w - ln(sum(e) OVER w), 6) + 0.0 AS v FROM (SELECT *, exp(v - max(v) OVER (PARTITION BY node_id)) AS e FROM x) WINDOW w AS (PARTITION BY node_id)"


@query(sql(_LSM))
def log_softmax(spark, d):
    return _long(neural.log_softmax(graphs.nodes(spark, d)))


@query(sql(_LSM))
def log_softmax_blocked(spark, d):
    """Columns in 3 blocks: each block's largest score and sum, then the row's from them."""
    rows = linalg.to_long(graphs.nodes(spark, d)).withColumn("block", partition.floor_block(F.col("f"), 64, 3)[0])
    # a block's sum is taken against its own largest score, so one pass over the cells does
    part = rows.groupBy("node_id", "block").agg(F.max("v").alias("m"), F.collect_list("v").alias("vs"))
    part = part.withColumn("s", neural.total(F.transform("vs", lambda v: F.exp(v - F.col("m")))))
    top = part.groupBy("node_id").agg(F.max("m").alias("top"))
    norm = part.join(top, "node_id").groupBy("node_id", "top").agg(F.log(F.sum(F.col("s") * F.exp(F.col("m") - F.col("top")))).alias("norm"))
    return rows.join(norm, "node_id").select("node_id", "f", r6(F.col("v") - F.col("top") - F.col("norm")).alias("v"))


@query(
    sql(
        "SELECT node_id, f::INT AS f, round(m.v - exp(p.v) * sum(m.v) OVER (PARTITION BY node_id), 6) + 0.0 AS v FROM p JOIN mx m USING (node_id, f)",
        MX,
        "p AS (SELECT node_id, f, v - max(v) OVER w - ln(sum(e) OVER w) AS v FROM (SELECT *, exp(v - max(v) OVER (PARTITION BY node_id)) AS e FROM x) WINDOW w AS (PARTITION BY node_id))",
    )
)
def log_softmax_grad(spark, d):
    x = graphs.nodes(spark, d)
    g = linalg.spmm(_adj(spark, d), x, 64).withColumnRenamed("x", "g")
    rows = neural.log_softmax(x).join(g, "node_id").withColumn("t", neural.total("g"))
    return _long(rows.select("node_id", neural.log_softmax_grad("x", "g", F.col("t")).alias("x")))


@query(f"SELECT 1 AS layer, i, j, v FROM ({sql_weights(64, 16, 1)}) UNION ALL SELECT 2, i, j, v FROM ({sql_weights(16, 10, 2)})")
def weight_init(spark, d):
    parts = [spark.range(r).withColumnRenamed("id", "i").crossJoin(F.broadcast(spark.range(c).withColumnRenamed("id", "j"))).select(F.lit(k).alias("layer"), "i", "j", graphs.uniform(F.col("i"), F.col("j"), k).alias("v")) for k, r, c in ((1, 64, 16), (2, 16, 10))]
    return parts[0].unionByName(parts[1])


def _model(spark, d, **options):
    g = T.load(spark, d, T.TrainConfig(**options))
    return g, T.start(g.config)


def _nll(split: str = "train", source: str = "p_0") -> str:
    return f"(SELECT node_id, split, -v AS loss FROM {source} JOIN nodes USING (node_id) WHERE f = y AND split = '{split}')"


@query(sql(_LONG.format("h1_0"), FORWARD))
def gcn_layer1(spark, d):
    g, (w1, _) = _model(spark, d)
    return _long(T.layer1(g, w1)[1])


@query(sql(_LONG.format("p_0"), FORWARD))
def gcn_forward(spark, d):
    g, w = _model(spark, d)
    return _long(T.forward(g, *w))


@query(
    sql(
        _LONG.format("z2_0"),
        "plain AS (SELECT dst AS node_id, f, sum(v) AS v FROM loops JOIN x ON node_id = src GROUP BY ALL)",
        W0,
        "h AS (SELECT node_id, j AS f, sum(m.v * w.v) AS v FROM plain m JOIN w1_0 w ON f = i GROUP BY ALL)",
        "mh AS (SELECT dst AS node_id, f, sum(v) AS v FROM loops JOIN h ON node_id = src GROUP BY ALL)",
        "z2_0 AS (SELECT node_id, j AS f, sum(m.v * w.v) AS v FROM mh m JOIN w2_0 w ON f = i GROUP BY ALL)",
    ).replace("round(v, 6) + 0.0", "round(v, 3) + 0.0")
)
def gcn_linear(spark, d):
    """Two plain neighbour sums with weights between, no normalisation and no activation; sums are large, so 3 digits."""
    g, w = _model(spark, d, activations=False, normalise=False)
    return linalg.to_long(T.forward(g, *w)).select("node_id", "f", (F.round("v", 3) + F.lit(0.0)).alias("v"))


@query(sql("SELECT node_id, arg_max(f, v)::INT AS pred FROM p_0 GROUP BY node_id", FORWARD))
def predict(spark, d):
    g, w = _model(spark, d)
    return T.forward(g, *w).select("node_id", neural.argmax(F.col("x")).alias("pred"))


_HITS = "hits AS (SELECT node_id, split, (arg_max(f, v) = any_value(y))::INT AS hit FROM {} JOIN nodes USING (node_id) GROUP BY node_id, split)"


@query(sql("SELECT split, count(*) AS n, round(avg(hit), 6) AS accuracy FROM hits GROUP BY split", FORWARD, _HITS.format("p_0")))
def accuracy(spark, d):
    g, w = _model(spark, d)
    rows = T.losses(g, T.forward(g, *w))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))


@query(sql("SELECT block, split, coalesce(round(avg(hit), 6), -1) AS accuracy FROM (SELECT DISTINCT split FROM nodes) CROSS JOIN (SELECT unnest(range(3)) AS block) LEFT JOIN (SELECT " + _floor("node_id", 3)[0] + " AS block, split, hit FROM hits, n) USING (block, split) GROUP BY ALL", FORWARD, _HITS.format("p_0")))
def accuracy_by_block(spark, d):
    """-1 for a block without nodes of the split."""
    g, w = _model(spark, d)
    rows = T.losses(g, T.forward(g, *w)).withColumn("block", partition.floor_block(F.col("node_id"), g.n, 3)[0].cast("long"))
    grid = spark.range(3).select(F.col("id").alias("block")).crossJoin(F.broadcast(g.nodes.select("split").distinct()))  # at most three splits
    found = rows.groupBy("block", "split").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("a"))
    return grid.join(found, ["block", "split"], "left").select("block", "split", F.coalesce("a", F.lit(-1.0)).alias("accuracy"))


@query(sql(f"SELECT round(avg(loss), 6) AS loss FROM {_nll()}", FORWARD))
def nll_loss(spark, d):
    g, w = _model(spark, d)
    return T.losses(g, T.forward(g, *w)).where("split = 'train'").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(sql(f"SELECT round(sum(m), 6) AS loss FROM (SELECT {_ceil('node_id', 4)[0]} AS b, avg(loss) AS m FROM {_nll()}, n GROUP BY ALL)", FORWARD))
def nll_loss_blockmean(spark, d):
    """The sum of the means over 4 row blocks."""
    g, w = _model(spark, d)
    rows = T.losses(g, T.forward(g, *w)).where("split = 'train'")
    means = rows.groupBy(partition.ceil_block(F.col("node_id"), g.n, 4)[0].alias("b")).agg(F.avg("loss").alias("m"))
    return means.agg(F.round(F.sum("m"), 6).alias("loss"))


@query(sql(f"SELECT least(f // 3, 2) AS block, round(sum(-v) / (SELECT count(*) FROM nodes WHERE split = 'train'), 6) AS loss FROM p_0 JOIN nodes USING (node_id) WHERE f = y AND split = 'train' GROUP BY ALL", FORWARD))
def nll_loss_class_blocks(spark, d):
    """Each of 3 class blocks' share of the mean loss."""
    g, w = _model(spark, d)
    rows = T.losses(g, T.forward(g, *w)).where("split = 'train'").join(g.nodes.select("node_id", "y"), "node_id")
    n = g.nodes.where("split = 'train'").agg(F.count(F.lit(1)).alias("n"))
    parts = rows.groupBy(partition.floor_block(F.col("y").cast("long"), 10, 3)[0].alias("block")).agg(F.sum("loss").alias("s"))
    return parts.crossJoin(F.broadcast(n)).select("block", F.round(F.col("s") / F.col("n"), 6).alias("loss"))


@query(sql(_IJ.format("dw2_0"), BACKWARD))
def gcn_backward_w2(spark, d):
    g, w = _model(spark, d)
    return _ij(T.gradients(g, *w)[1])


@query(sql(_IJ.format("dw1_0"), BACKWARD))
def gcn_backward_w1(spark, d):
    g, w = _model(spark, d)
    return _ij(T.gradients(g, *w)[0])


# --- training ----------------------------------------------------------------

_STEP1 = f"{BACKWARD}, {sql_adam(0)}"
_STEP2 = f"{_STEP1}, {sql_forward(1)}, {sql_backward(1)}, {sql_adam(1)}"
_WEIGHTS = "SELECT 1 AS layer, i::INT AS i, j::INT AS j, round(v, 6) + 0.0 AS v FROM w1_{0} UNION ALL SELECT 2, i::INT, j::INT, round(v, 6) + 0.0 FROM w2_{0}"


def _weights(spark, w) -> DataFrame:
    rows = [(k + 1, i, j, x) for k, m in enumerate(w) for i, r in enumerate(m) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "layer int, i int, j int, v double").select("layer", "i", "j", r6("v").alias("v"))


@query(sql("SELECT i::INT AS i, j::INT AS j, round(v, 6) + 0.0 AS v FROM w2_1", _STEP1))
def adam_step(spark, d):
    """The second layer's weights after one Adam update, as an expression over gradient rows."""
    g, w = _model(spark, d)
    dw2 = T.gradients(g, *w)[1]
    start = _start_rows(spark, w[1])
    m, v = 0.1 * F.col("g"), 0.001 * F.col("g") * F.col("g")
    new = F.col("w") - 0.01 * (m / (1 - 0.9)) / (F.sqrt(v / (1 - 0.999)) + 1e-8)
    return start.join(dw2.withColumnRenamed("v", "g"), ["i", "j"]).select("i", "j", r6(new).alias("v"))


def _start_rows(spark, w) -> DataFrame:
    return spark.createDataFrame([(i, j, x) for i, r in enumerate(w) for j, x in enumerate(r)], "i int, j int, w double")


@query(sql(_WEIGHTS.format(1), _STEP1))
def train_step_1(spark, d):
    g, _ = _model(spark, d)
    return _weights(spark, T.train(g, 1)[-1])


@query(sql(_WEIGHTS.format(2), _STEP2))
def train_step_2(spark, d):
    g, _ = _model(spark, d)
    return _weights(spark, T.train(g, 2)[-1])


def _sql_history(steps: int) -> str:
    return " UNION ALL ".join(f"SELECT {k + 1} AS epoch, split, round(avg(loss), 6) AS loss, round(avg(hit), 6) AS accuracy FROM (SELECT node_id, split, any_value(y) AS y, -max(v) FILTER (f = y) AS loss, (arg_max(f, v) = any_value(y))::INT AS hit FROM p_{k} JOIN nodes USING (node_id) GROUP BY node_id, split) GROUP BY split" for k in range(steps))


@query(sql(_sql_history(2), _STEP2))
def train_history(spark, d):
    g, _ = _model(spark, d)
    return T.history(g, 2).select("epoch", "split", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(sql(f"SELECT epoch, val, test FROM (SELECT epoch, max(accuracy) FILTER (split = 'val') AS val, max(accuracy) FILTER (split = 'test') AS test FROM ({_sql_history(2)}) GROUP BY epoch) ORDER BY val DESC, epoch LIMIT 1", _STEP2))
def best_epoch(spark, d):
    """The first epoch of the best validation accuracy, with its test accuracy."""
    g, _ = _model(spark, d)
    rows = T.history(g, 2).groupBy("epoch").agg(*(F.max(F.when(F.col("split") == s, F.round("accuracy", 6))).alias(s) for s in ("val", "test")))
    best = F.max_by(F.struct("epoch", "val", "test"), F.struct("val", (-F.col("epoch")).alias("e")))
    return rows.agg(best.alias("b")).select("b.epoch", "b.val", "b.test")


# --- state of training ---------------------------------------------------------------

_STEP3 = f"{_STEP2}, {sql_forward(2)}, {sql_backward(2)}, {sql_adam(2)}"


def _sql_state(k: int) -> str:
    return " UNION ALL ".join(f"SELECT {layer} AS layer, i::INT AS i, j::INT AS j, round(w.v, 6) + 0.0 AS w, round(a.m, 8) + 0.0 AS m, round(a.q, 10) + 0.0 AS v, {k} AS t FROM w{layer}_{k} w JOIN a{layer}_{k} a USING (i, j)" for layer in (1, 2))


def _rounded(state: DataFrame) -> DataFrame:
    return state.select("layer", "i", "j", r6("w").alias("w"), (F.round("m", 8) + 0.0).alias("m"), (F.round("v", 10) + 0.0).alias("v"), "t")


@query(sql(_sql_state(2), _STEP2))
def adam_state(spark, d):
    """Weights and moments after two epochs, the second one of a run that went on from the first one's checkpoint."""
    g, _ = _model(spark, d)
    path = f"{g.tables.folder}/checkpoint"
    T.train(g, 1, path)
    T.train(g, 2, path)
    epoch, weights, adam = T.read_state(spark, path, g.config)
    return _rounded(spark.createDataFrame(T.state_rows(weights, adam), T.STATE))


@query(sql(_sql_state(3), _STEP3))
def adam_table(spark, d):
    """Weights and moments after three steps in which they are tables all along."""
    g, _ = _model(spark, d)
    return _rounded(T.table_steps(g, 3))


@query(sql(_IJ.format("dw2_0"), BACKWARD))
def backward_class_blocks_w2(spark, d):
    """The second layer's gradient from outputs in three blocks of classes."""
    g, w = _model(spark, d)
    return _ij(T.blocked_gradients(g, *w, 3)[1])


@query(sql(_IJ.format("dw1_0"), BACKWARD))
def backward_class_blocks_w1(spark, d):
    g, w = _model(spark, d)
    return _ij(T.blocked_gradients(g, *w, 3)[0])


# --- a directed graph ----------------------------------------------------------------

_DIRECTED = """
arcs AS (SELECT DISTINCT src, dst FROM raw WHERE src <> dst UNION ALL SELECT node_id, node_id FROM nodes),
mo AS (SELECT a.src AS node_id, f, sum(v) AS v FROM arcs a JOIN x ON x.node_id = a.dst GROUP BY ALL),
zo AS (SELECT node_id, j AS f, sum(m.v * w.v) AS v FROM mo m JOIN w1_0 w ON f = i GROUP BY ALL)"""


@query(sql("SELECT node_id, f::INT AS f, round(greatest(v, 0), 6) + 0.0 AS v FROM zo", W0, _DIRECTED))
def gcn_outward(spark, d):
    """The first layer over a directed graph, summed over out-neighbours and not normalised."""
    config = T.TrainConfig(inward=False, normalise=False)
    edges = prepare.distinct_edges(graphs.coo_edges(spark, d))
    g = T.prepared(graphs.nodes(spark, d), edges, graphs.node_count(spark, d), config)
    return _long(T.layer1(g, T.start(config)[0])[1])
