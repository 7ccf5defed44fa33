"""One query for each operator, over whole tables, each with the oracle's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank import session
from gridrank.functions import vector
from gridrank.operators import blocks, coo, cost, joins, linalg, reorder, stats
from gridrank.plans import normalize, views
from gridrank.plans.pagerank import pagerank, rank_mass
from gridrank.plans.views import with_views as w
from gridrank.sources import catalog, edge_list, matrix_market, vectors
from gridrank.streaming import iteration_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rounds of the rankings that are held against SQL.
ROUNDS = 10


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def _max_order(spark: SparkSession, d: str) -> int:
    return views.table(spark, d, "orders").agg(F.max("o_orderkey") + 1).first()[0]


# Sources


def _written(spark: SparkSession, matrix: DataFrame, n: int, m: int, symmetry: str = "general") -> str:
    path = session.new_path(spark, "matrix")
    matrix_market.write(matrix, path, n, m, symmetry=symmetry)
    return path


@query(w("SELECT 'coordinate' AS layout, 'real' AS field, 'general' AS symmetry, (SELECT n FROM nn) AS n, (SELECT n FROM nn) AS m, count(*) AS nnz FROM dag", "dag", "nn"))
def mm_header(spark, d):
    n = views.n_parts(spark, d)
    h = matrix_market.header(spark, _written(spark, views.part_dag(spark, d), n, n))
    return spark.createDataFrame([(h.layout, h.field, h.symmetry, h.n, h.m, h.nnz)], "layout string, field string, symmetry string, n bigint, m bigint, nnz bigint")


@query(w("SELECT j AS i, i AS j, CAST(1 AS DOUBLE) AS v FROM dag", "dag"))
def mm_read_pattern(spark, d):
    n = views.n_parts(spark, d)
    return matrix_market.read(spark, _written(spark, views.part_dag(spark, d), n, n), values="pattern", transpose=True)


@query(w("SELECT i, j, v FROM dag UNION ALL SELECT j, i, v FROM dag", "dag"))
def mm_read(spark, d):
    n = views.n_parts(spark, d)
    return matrix_market.read(spark, _written(spark, coo.transpose(views.part_dag(spark, d)), n, n, "symmetric"))


@query(w("SELECT j AS i, i AS j, v FROM dag UNION ALL SELECT i, j, -v FROM dag", "dag"))
def mm_read_local(spark, d):
    n = views.n_parts(spark, d)
    return matrix_market.read(spark, _written(spark, coo.transpose(views.part_dag(spark, d)), n, n, "skew-symmetric"))


@query("SELECT i, j, max(v) AS v FROM (SELECT c_nationkey AS i, CAST(0 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, CAST(1 AS BIGINT), CAST(count(*) AS DOUBLE) FROM supplier GROUP BY 1) GROUP BY i, j")
def mm_read_full(spark, d):
    """Customers and suppliers by nation as a dense file of two columns."""
    a = views.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i")).agg(F.count("*").alias("v")).withColumn("j", F.lit(0))
    b = views.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count("*").alias("v")).withColumn("j", F.lit(1))
    grid = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    n = grid.agg(F.max("i") + 1).first()[0]
    full = grid.join(a.unionByName(b), ["i", "j"], "left").fillna(0, ["v"]).select("i", "j", F.col("v").cast("string").alias("line"))
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix array real general"), (-1, 0, f"{n} 2")], "i int, j int, line string").select("i", F.lit(-1).alias("j"), "line")
    path = session.new_path(spark, "array")
    head.unionByName(full.select("i", "j", "line")).orderBy("j", "i").select("line").coalesce(1).write.text(path)
    return matrix_market.read(spark, path).select(F.col("i").cast("int"), "j", "v")


@query(w("SELECT CAST(dense_rank() OVER (ORDER BY i) - 1 AS BIGINT) AS node_index, i AS node FROM (SELECT 2 * i AS i FROM nxt UNION SELECT 2 * j FROM nxt)", "nxt"))
def edgelist_compaction(spark, d):
    """All edges; doubled ids leave the gaps."""
    edges = views.part_next(spark, d)
    _, ids = edge_list.compact(edges.select((2 * F.col("i")).alias("src"), (2 * F.col("j")).alias("dst")))
    return ids.select(F.col("k").alias("node_index"), "node")


def _edge_file(spark, d) -> str:
    edges = views.part_next(spark, d).select("i", "j", F.explode(F.array_repeat(F.lit(1), F.col("v").cast("int"))))
    n, many = views.n_parts(spark, d), edges.count()
    path = session.new_path(spark, "edges")
    head = spark.createDataFrame([("# Directed graph (each unordered pair of nodes is saved once): parts",), (f"# Nodes: {n} Edges: {many}",), ("# FromNodeId\tToNodeId",)], "line string")
    head.unionByName(edges.select(F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string")).alias("line"))).write.text(path)
    return path


@query(w("SELECT i, j, v FROM nxt", "nxt"))
def edgelist_read(spark, d):
    """All parts have edges, so that compaction keeps their numbers."""
    return edge_list.compact(edge_list.read_edges(spark, _edge_file(spark, d)))[0]


@query(w("SELECT (SELECT n FROM nn) AS n, CAST(sum(v) AS BIGINT) AS edges, true AS directed FROM nxt", "nxt", "nn"))
def edgelist_header(spark, d):
    h = edge_list.header(spark, _edge_file(spark, d))
    return spark.createDataFrame([(h.n, h.edges, h.directed)], "n bigint, edges bigint, directed boolean")


@query(w("SELECT i + 1 AS i, j + 1 AS j, CAST(1 AS DOUBLE) AS v FROM dag", "dag"))
def edgelist_text_cells(spark, d):
    path = session.new_path(spark, "cells")
    vectors.write_text(coo.offset(views.part_dag(spark, d), 1), path)
    return edge_list.read_cells(spark, path)


@query(w("SELECT i, x FROM sizes", "sizes"))
def vector_csv_read(spark, d):
    path = session.new_path(spark, "vector")
    vectors.write_csv(views.part_sizes(spark, d), path)
    return vectors.read_csv(spark, path)


@query("SELECT true AS gzip, CAST(1 AS BIGINT) AS files UNION ALL SELECT false, 1")
def gzip_sniff(spark, d):
    path = session.new_path(spark, "lines")
    lines = views.table(spark, d, "region").select("r_name").coalesce(1)
    lines.write.option("compression", "gzip").text(f"{path}/a")
    lines.write.text(f"{path}/b")
    return catalog.is_gzip(spark, f"{path}/*/part-*").groupBy("gzip").agg(F.count("*").alias("files"))


@query(w("SELECT i, j, v FROM trade", "trade"))
def dataset_catalog(spark, d):
    names = catalog.Catalog()
    names.add("trade", _written(spark, views.nation_trade(spark, d), 25, 25))
    return names.load(spark, "trade")


@query("SELECT p_partkey AS i FROM part")
def range_source(spark, d):
    return vectors.numbers(spark, views.n_parts(spark, d), 4)


@query("SELECT CAST(b * (n // 7) AS BIGINT) AS start_row, CAST(n // 7 AS BIGINT) AS size, CAST(n // 7 AS DOUBLE) / n AS total FROM (SELECT count(*) AS n FROM part), range(7) AS t(b)")
def vector_blocks_source(spark, d):
    n = views.n_parts(spark, d)
    made = vectors.constant_blocks(spark, n, 7, 1.0)
    return made.select("start_row", F.size("data").cast("bigint").alias("size"), (F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / n).alias("total"))


@query("SELECT p_partkey AS i, CAST(0.5 AS DOUBLE) AS x FROM part")
def vector_const(spark, d):
    return vectors.constant(spark, views.n_parts(spark, d), 0.5)


@query()
def matrix_random(spark, d):
    return vectors.random_matrix(spark, 200, 0.1)


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT), CAST(1 AS DOUBLE)), (1, 0, 2), (1, 5, 3)) AS t(i, j, v)")
def from_collection(spark, d):
    return vectors.from_rows(spark, [(0, 2, 1.0), (1, 0, 2.0), (1, 5, 3.0)], "i bigint, j bigint, v double")


# Sinks


@query(w("SELECT i, j, v FROM nxt", "nxt"))
def mm_write(spark, d):
    n = views.n_parts(spark, d)
    return matrix_market.read(spark, _written(spark, views.part_next(spark, d), n, n))


@query(w("SELECT 'symmetric' AS kind, i, j, v FROM dag UNION ALL SELECT 'symmetric', j, i, v FROM dag", "dag"))
def mm_write_octave(spark, d):
    n = views.n_parts(spark, d)
    both = coo.symmetrize(views.part_dag(spark, d))
    kind = matrix_market.detect_symmetry(both)
    return matrix_market.read(spark, _written(spark, both, n, n, kind)).select(F.lit(kind).alias("kind"), "i", "j", "v")


@query(w("SELECT i, j, v FROM dag", "dag"))
def text_write(spark, d):
    path = session.new_path(spark, "text")
    vectors.write_text(views.part_dag(spark, d), path)
    return spark.read.csv(path, sep=" ", schema="i bigint, j bigint, v double")


@query(w("SELECT i, j, v FROM trade", "trade"))
def collect(spark, d):
    """Through the driver: 25 x 25 cells at most."""
    return spark.createDataFrame([tuple(r) for r in views.nation_trade(spark, d).toLocalIterator()], "i bigint, j bigint, v double")


@query(w("SELECT count(*) AS cells FROM nxt", "nxt"))
def count(spark, d):
    return spark.createDataFrame([(views.part_next(spark, d).count(),)], "cells bigint")


_BINS = "CAST(floor({0} * (50.0 / (SELECT n FROM nn))) AS BIGINT)"


@query(w(f"SELECT {_BINS.format('j')} AS x, {_BINS.format('i')} AS y, count(*) AS cells FROM dag GROUP BY 1, 2", "dag", "nn"))
def heatmap_export(spark, d):
    return stats.downsample(views.part_dag(spark, d), views.n_parts(spark, d), 50)


# Projections, filters, maps


@query(w("SELECT j, v FROM op", "op"))
def project_cols(spark, d):
    return coo.column_values(views.order_part(spark, d))


@query(w("SELECT j AS i, i AS j, v FROM op", "op"))
def transpose(spark, d):
    return coo.transpose(views.order_part(spark, d))


@query(w("SELECT i - 1 AS i, j - 1 AS j, v FROM op", "op"))
def offset(spark, d):
    return coo.offset(views.order_part(spark, d), -1)


@query(w("SELECT i, j, v FROM nxt UNION ALL SELECT j, i, v FROM nxt WHERE i <> j", "nxt"))
def symmetrize(spark, d):
    return coo.symmetrize(views.part_next(spark, d))


@query(w("SELECT i, j, v FROM nxt", "nxt"))
def drop_size_line(spark, d):
    m = views.part_next(spark, d)
    n, nnz = views.n_parts(spark, d), m.count()
    return coo.drop_size_line(m.unionByName(spark.createDataFrame([(n, n, float(nnz))], "i bigint, j bigint, v double")), n, n, nnz)


_DANGLING = "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT i FROM dag)"


@query(w(_DANGLING, "dag"))
def non_null_filter(spark, d):
    m, n = views.part_dag(spark, d), views.n_parts(spark, d)
    marked = spark.range(n).select(F.col("id").alias("k")).join(m.select(F.col("i").alias("k"), F.lit(True).alias("out")).distinct(), "k", "left").select("k", F.col("out").isNull().alias("dangling"))
    return coo.present(marked, "dangling").select("k")


@query(w("SELECT i, x / 1e6 AS delta FROM sizes WHERE abs(x / 1e6) > 1e-5", "sizes"))
def convergence_filter(spark, d):
    changes = views.part_sizes(spark, d).select("i", (F.col("x") / 1e6).alias("delta"))
    return changes.where(coo.moved("delta"))


_RW = "(((SELECT n FROM nn) + 7) // 8)"


@query(w(f"SELECT i, j, CAST((i // {_RW}) * 8 + j // {_RW} AS BIGINT) AS block_key FROM dag", "dag", "nn"))
def block_key(spark, d):
    n = views.n_parts(spark, d)
    return views.part_dag(spark, d).select("i", "j", blocks.Grid(n, n, 8).key().alias("block_key"))


@query(w("SELECT i, j, CAST(i * 4294967296 + j AS BIGINT) AS sort_key FROM op", "op"))
def sort_key(spark, d):
    return views.order_part(spark, d).select("i", "j", coo.sort_key().alias("sort_key"))


# Joins


@query(w("SELECT op.i, op.j, op.v * sizes.x AS product FROM op JOIN sizes ON op.j = sizes.i", "op", "sizes"))
def join_broadcast_equi(spark, d):
    return joins.tiny_join(views.order_part(spark, d), views.part_sizes(spark, d).select(F.col("i").alias("at"), "x"), F.col("j") == F.col("at")).select("i", "j", (F.col("v") * F.col("x")).alias("product"))


@query(w(f"SELECT i AS k, x AS r FROM sizes WHERE i IN ({_DANGLING})", "dag", "sizes"))
def join_dangling(spark, d):
    ranks = views.part_sizes(spark, d).select(F.col("i").alias("k"), F.col("x").alias("r"))
    return joins.dangling_join(ranks, stats.dangling_nodes(views.part_dag(spark, d), views.n_parts(spark, d)))


@query(w("SELECT op.i, op.j, op.v * sizes.x AS product FROM op JOIN sizes ON op.j = sizes.i", "op", "sizes"))
def join_equi(spark, d):
    return joins.matrix_vector(views.order_part(spark, d), views.part_sizes(spark, d))


@query(w("SELECT s.i, abs(s.x - coalesce(t.x, 0)) AS delta FROM sizes s JOIN (SELECT j AS i, sum(v) AS x FROM dag GROUP BY 1) t ON s.i = t.i", "dag", "sizes"))
def join_delta(spark, d):
    return joins.deltas(stats.col_sums(views.part_dag(spark, d)).select(F.col("j").alias("i"), F.col("total").alias("x")), views.part_sizes(spark, d), "i", "x")


@query(w("SELECT i, j, v, (SELECT sum(v) FROM trade) AS total FROM trade", "trade"))
def cross(spark, d):
    m = views.nation_trade(spark, d)
    return joins.attach(m, stats.total(m, "v"))


@query(w("SELECT i, 2 * j AS j, v FROM trade UNION ALL SELECT CAST(a.i AS BIGINT), CAST(m.j AS BIGINT), 1.0 / 50 FROM range(50) AS a(i), (SELECT j FROM range(50) AS r(j) WHERE j NOT IN (SELECT 2 * j FROM trade)) m", "trade"))
def cogroup_outer(spark, d):
    """All cells; doubled columns leave the empty ones."""
    return joins.fill_missing_columns(views.nation_trade(spark, d).withColumn("j", 2 * F.col("j")), 50)


@query(w("SELECT dag.i, dag.v * sizes.x AS product FROM dag JOIN sizes ON dag.j = sizes.i", "dag", "sizes"))
def cogroup_rank(spark, d):
    return joins.rank_products(views.part_sizes(spark, d).select(F.col("i").alias("k"), F.col("x").alias("r")), views.part_dag(spark, d))


@query(w("SELECT t.i, t.j, t.v / s.total AS share FROM dag t JOIN (SELECT i, sum(v) AS total FROM dag GROUP BY 1) s ON t.i = s.i", "dag"))
def broadcast_var(spark, d):
    m = views.part_dag(spark, d)
    return joins.with_value(m, stats.row_sums(m), "i").select("i", "j", (F.col("v") / F.col("total")).alias("share"))


# Aggregations


@query(w("SELECT j, sum(v) AS total FROM op GROUP BY j", "op"))
def col_sums(spark, d):
    return stats.col_sums(views.order_part(spark, d))


@query(w("SELECT i, sum(v) AS total FROM op GROUP BY i", "op"))
def row_sums(spark, d):
    return stats.row_sums(views.order_part(spark, d))


@query(w("SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM nxt", "nxt"))
def row_normalize(spark, d):
    return stats.row_normalize(views.part_next(spark, d)).select("i", "j", F.round("v", 9).alias("v"))


@query(w("SELECT i, j, round(v / count(*) OVER (PARTITION BY i), 9) AS v FROM nxt", "nxt"))
def row_normalize_count(spark, d):
    return stats.row_normalize(views.part_next(spark, d), "count").select("i", "j", F.round("v", 9).alias("v"))


@query(w(_DANGLING, "dag"))
def dangling_nodes(spark, d):
    return stats.dangling_nodes(views.part_dag(spark, d), views.n_parts(spark, d))


@query(w(f"SELECT mass, round(0.85 * mass / n + 0.15 / n, 9) AS share FROM (SELECT sum(x) AS mass FROM sizes WHERE i IN ({_DANGLING})), nn", "dag", "sizes", "nn"))
def dangling_mass(spark, d):
    n = views.n_parts(spark, d)
    ranks = views.part_sizes(spark, d).select(F.col("i").alias("k"), F.col("x").alias("r"))
    return stats.dangling_mass(ranks, stats.dangling_nodes(views.part_dag(spark, d), n), 0.85, n).select("mass", F.round("share", 9).alias("share"))


_KEYS = f"SELECT (i // {_RW}) * 8 + j // {_RW} AS block_key, count(*) AS nnz FROM dag GROUP BY 1"


def _block_counts(spark, d):
    n = views.n_parts(spark, d)
    return stats.block_nnz(views.part_dag(spark, d), blocks.Grid(n, n, 8).key())


@query(w(f"SELECT CAST(block_key AS BIGINT) AS block_key, nnz FROM ({_KEYS})", "dag", "nn"))
def block_nnz(spark, d):
    return _block_counts(spark, d)


@query(w(f"SELECT count(*) AS blocks, count(*) / 64.0 AS share, min(nnz) AS least, max(nnz) AS most, round(avg(nnz), 6) AS mean, round(stddev_samp(nnz), 6) AS deviation FROM ({_KEYS})", "dag", "nn"))
def block_occupancy(spark, d):
    found = stats.block_occupancy(_block_counts(spark, d), 8)
    return found.select("blocks", "share", "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(w(f"SELECT CAST(7 - g.b // 8 AS BIGINT) AS line, CAST(g.b % 8 AS BIGINT) AS block_col, coalesce(c.nnz, 0) AS nnz FROM range(64) AS g(b) LEFT JOIN ({_KEYS}) c ON c.block_key = g.b", "dag", "nn"))
def block_heat_map(spark, d):
    return stats.heat_map(_block_counts(spark, d), 8)


@query(w("SELECT op.i, sum(op.v * sizes.x) AS x FROM op JOIN sizes ON op.j = sizes.i GROUP BY op.i", "op", "sizes"))
def kv_sum_reduce(spark, d):
    return linalg.spmv(views.order_part(spark, d), views.part_sizes(spark, d))


@query(w("SELECT CAST(i // 50 * 50 AS BIGINT) AS start_row, CAST(i % 50 AS INTEGER) AS p, 2 * x AS x FROM sizes", "sizes"))
def block_sum_reduce(spark, d):
    parts = blocks.vector_blocks(views.part_sizes(spark, d), 50, views.n_parts(spark, d))
    return linalg.add_blocks(parts.unionByName(parts)).select("start_row", F.posexplode("data").alias("p", "x"))


@query(w("SELECT sum(x) AS total FROM sizes", "sizes"))
def global_reduce(spark, d):
    return stats.total(views.part_sizes(spark, d), "x")


@query(w(f"SELECT {_BINS.format('j').replace('50.0', '1000.0')} AS x, {_BINS.format('i').replace('50.0', '1000.0')} AS y, count(*) AS cells FROM nxt GROUP BY 1, 2", "nxt", "nn"))
def downsample_2d(spark, d):
    return stats.downsample(views.part_next(spark, d), views.n_parts(spark, d))


@query("SELECT CAST(least(9, greatest(0, ceil((o_totalprice - low) / ((high - low) / 10)) - 1)) AS BIGINT) AS bin, count(*) AS members, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders, (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders) GROUP BY 1")
def empirical_bins(spark, d):
    return stats.empirical_bins(views.table(spark, d, "orders"), "o_totalprice", 10).withColumn("mean", F.round("mean", 4))


@query(w("SELECT max(n) AS most, min(n) AS least, round(avg(n), 9) AS mean, round(var_pop(n), 6) AS variance, round(stddev_pop(n), 6) AS deviation FROM (SELECT count(*) AS n FROM nxt GROUP BY i)", "nxt"))
def row_nnz_stats(spark, d):
    return stats.row_nnz_stats(views.part_next(spark, d)).select("most", "least", F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"), F.round("deviation", 6).alias("deviation"))


@query(w("SELECT CAST(floor(ln(x * (SELECT count(*) / sum(x) FROM sizes)) + 0.5) AS BIGINT) AS bucket, count(*) AS members FROM sizes GROUP BY 1", "sizes"))
def log_rank_hist(spark, d):
    return stats.log_rank_hist(views.part_sizes(spark, d).select(F.col("i").alias("k"), F.col("x").alias("r")))


@query(w("SELECT 'row' AS axis, i AS id, count(*) AS cells FROM dag GROUP BY i UNION ALL SELECT 'col', j, count(*) FROM dag GROUP BY j", "dag"))
def degree_hist(spark, d):
    a, b = stats.degree_hist(views.part_dag(spark, d))
    return a.select(F.lit("row").alias("axis"), F.col("i").alias("id"), "cells").unionByName(b.select(F.lit("col").alias("axis"), F.col("j").alias("id"), "cells"))


@query(w("SELECT 5.0 * floor(x / 5.0) AS low, count(*) AS members FROM sizes GROUP BY 1", "sizes").replace("5.0 *", "CAST(5 AS DOUBLE) *"))
def gnuplot_hist(spark, d):
    return stats.width_hist(views.part_sizes(spark, d), "x", 5.0)


@query(w("SELECT count(*) AS nnz FROM op WHERE v <> 0", "op"))
def nnz(spark, d):
    return stats.nnz(views.order_part(spark, d))


@query(w("SELECT round(count(*) * CAST(2 AS DOUBLE) / n / n, 12) AS sparsity FROM dag, nn GROUP BY n", "dag", "nn"))
def sparsity(spark, d):
    return stats.sparsity(views.part_dag(spark, d), views.n_parts(spark, d), directed=False).select(F.round("sparsity", 12).alias("sparsity"))


@query(w("SELECT round(sqrt(sum(v * v)), 6) AS norm FROM nxt", "nxt"))
def frobenius(spark, d):
    return stats.frobenius(views.part_next(spark, d)).select(F.round("norm", 6).alias("norm"))


# Sorting and reordering


@query(w("SELECT j, sum(v) AS total FROM op GROUP BY j", "op"))
def sort_partition(spark, d):
    return stats.col_sums(views.order_part(spark, d)).orderBy("total", "j")


@query(w("SELECT CAST(block_key AS BIGINT) AS block_key, CAST(p AS BIGINT) AS p, i, j, v FROM (SELECT (i // {0}) * 8 + j // {0} AS block_key, row_number() OVER (PARTITION BY (i // {0}) * 8 + j // {0} ORDER BY i, j) - 1 AS p, i, j, v FROM dag)".format(_RW), "dag", "nn"))
def sort_group(spark, d):
    """Cells in the order of their blocks' secondary sort, each with its place."""
    n = views.n_parts(spark, d)
    packed = blocks.build(views.part_dag(spark, d), blocks.Grid(n, n, 8))
    size = F.size("data") > 0
    rows = packed.where(size).select((F.col("block_row") * 8 + F.col("block_col")).alias("block_key"), "start_row", "start_col", "indices", "data", F.flatten(F.transform(F.sequence(F.lit(1), F.size("indptr") - 1), lambda r: F.array_repeat(r - 1, F.element_at("indptr", r + 1) - F.element_at("indptr", r)))).alias("rows"))
    cells = rows.select("block_key", "start_row", "start_col", F.posexplode(F.arrays_zip("rows", "indices", "data")).alias("p", "c"))
    return cells.select("block_key", F.col("p").cast("bigint").alias("p"), (F.col("start_row") + F.col("c.rows")).alias("i"), (F.col("start_col") + F.col("c.indices")).alias("j"), F.col("c.data").alias("v"))


@query(w("SELECT i, x FROM sizes ORDER BY x DESC, i LIMIT 1", "sizes"))
def first_n(spark, d):
    return views.part_sizes(spark, d).orderBy(F.desc("x"), "i").limit(1)


_ORDER = "SELECT {0} AS old, row_number() OVER (ORDER BY sum(v) DESC, {0}) - 1 AS new FROM op GROUP BY {0}"


@query(w(f"SELECT o.new AS i, op.j, op.v FROM op JOIN ({_ORDER.format('i')}) o ON op.i = o.old", "op"))
def reorder_rows_by_sum(spark, d):
    return reorder.reorder_rows_by_sum(views.order_part(spark, d))


@query(w(f"SELECT op.i, o.new AS j, op.v FROM op JOIN ({_ORDER.format('j')}) o ON op.j = o.old", "op"))
def reorder_cols_by_sum(spark, d):
    return reorder.reorder_cols_by_sum(views.order_part(spark, d))


@query(w("SELECT n - 1 - i AS i, n - 1 - j AS j, v FROM dag, nn", "dag", "nn"))
def permute(spark, d):
    n = views.n_parts(spark, d)
    back = spark.range(n).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new"))
    return reorder.permute(views.part_dag(spark, d), back, back)


@query()
def rcm_reorder(spark, d):
    return reorder.reverse_cuthill_mckee(views.nation_trade(spark, d), 25)


@query(w("SELECT max(abs(i - j)) AS bandwidth FROM dag", "dag"))
def bandwidth(spark, d):
    return reorder.bandwidth(views.part_dag(spark, d))


# Blocks


@query(w("SELECT i, j, i // {0} * {0} AS start_row, j // {0} * {0} AS start_col, least({0}, n - i // {0} * {0}) AS n_rows, least({0}, n - j // {0} * {0}) AS n_cols FROM dag, nn".format(_RW), "dag", "nn"))
def block_dims(spark, d):
    n = views.n_parts(spark, d)
    return blocks.Grid(n, n, 8).with_dims(views.part_dag(spark, d)).select("i", "j", "start_row", "start_col", "n_rows", "n_cols")


@query("SELECT CAST(b * ((n + 31) // 32) AS BIGINT) AS start, CAST(least((n + 31) // 32, n - b * ((n + 31) // 32)) AS BIGINT) AS size FROM (SELECT count(*) AS n FROM part), range(32) AS t(b) WHERE b * ((n + 31) // 32) < n")
def vector_block_sizes(spark, d):
    return blocks.vector_block_sizes(spark, views.n_parts(spark, d), 32)


@query("SELECT CAST(b AS BIGINT) AS b, CAST((n + b - 1) // b * b AS BIGINT) AS padded FROM (SELECT count(*) AS n FROM part), range(1, 33) AS t(b)")
def adjusted_n(spark, d):
    n = views.n_parts(spark, d)
    return spark.createDataFrame([(b, blocks.adjusted_n(n, b)) for b in range(1, 33)], "b bigint, padded bigint")


@query(w("SELECT CAST(i // {0} AS BIGINT) AS block_row, CAST(j // {0} AS BIGINT) AS block_col, count(*) AS cells, sum(v) AS total FROM dag GROUP BY 1, 2".format(_RW), "dag", "nn"))
def block_build(spark, d):
    n = views.n_parts(spark, d)
    packed = blocks.build(views.part_dag(spark, d), blocks.Grid(n, n, 8))
    return packed.select("block_row", "block_col", F.size("data").cast("bigint").alias("cells"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(w("SELECT i, j, v FROM dag", "dag"))
def csr_from_sorted(spark, d):
    n = views.n_parts(spark, d)
    return blocks.unpack(blocks.build(views.part_dag(spark, d), blocks.Grid(n, n, 8)))


@query(w("SELECT i, j, v FROM dag", "dag"))
def csc_from_sorted(spark, d):
    n = views.n_parts(spark, d)
    return blocks.unpack(blocks.build(views.part_dag(spark, d), blocks.Grid(n, n, 8), orientation="csc"), "csc")


@query(w("SELECT CAST(least(i // (n // 7), 6) * 7 + least(j // (n // 7), 6) AS BIGINT) AS block, count(*) AS nnz FROM dag, nn GROUP BY 1", "dag", "nn"))
def dense_block_slice(spark, d):
    n = views.n_parts(spark, d)
    return stats.block_nnz(views.part_dag(spark, d), blocks.floor_last_key(F.col("i"), F.col("j"), n, 7)).withColumnRenamed("block_key", "block")


@query("SELECT CAST(b AS BIGINT) AS bit FROM range(63, 191) AS t(b)")
def bit_window(spark, d):
    return blocks.bit_window(spark, 63, 128, 256)


@query(w(f"SELECT CAST(k // 50 * 50 AS BIGINT) AS start_row, CAST(k % 50 AS INTEGER) AS position FROM ({_DANGLING})", "dag"))
def dangling_blocks(spark, d):
    nodes = stats.dangling_nodes(views.part_dag(spark, d), views.n_parts(spark, d)).withColumn("dangling", F.lit(True))
    return blocks.dangling_blocks(nodes, 50).select("start_row", F.explode("positions").alias("position"))


# Products

_SPMV = "SELECT op.i, sum(op.v * sizes.x) AS x FROM op JOIN sizes ON op.j = sizes.i GROUP BY op.i"


@query(w(_SPMV, "op", "sizes"))
def spmv_kv(spark, d):
    return linalg.spmv(views.order_part(spark, d), views.part_sizes(spark, d))


def _grid(spark, d, b: int = 8) -> blocks.Grid:
    return blocks.Grid(_max_order(spark, d), views.n_parts(spark, d), b)


@query(w(f"SELECT i, x FROM ({_SPMV})", "op", "sizes"))
def spmv_block_join(spark, d):
    grid = _grid(spark, d)
    x = blocks.vector_blocks(views.part_sizes(spark, d), grid.width, grid.cols)
    return linalg.spmv_block_elements(blocks.build(views.order_part(spark, d), grid), x)


@query(w(_SPMV, "op", "sizes"))
def spmv_block_broadcast(spark, d):
    return linalg.spmv_broadcast(blocks.unpack(blocks.build(views.order_part(spark, d), _grid(spark, d))), views.part_sizes(spark, d))


@query(w(f"SELECT i, 0.5 * x AS x FROM ({_SPMV})", "op", "sizes"))
def spmv_broadcast_kernel(spark, d):
    return linalg.spmv_broadcast(views.order_part(spark, d), views.part_sizes(spark, d), 0.5)


@query(w(_SPMV, "op", "sizes"))
def spmv_cross_kernel(spark, d):
    return linalg.spmv_cross(views.order_part(spark, d), views.part_sizes(spark, d), views.n_parts(spark, d))


@query(w(_SPMV, "op", "sizes"))
def spmv_timing(spark, d):
    counted, _ = iteration_log.kernel_times(linalg.spmv(views.order_part(spark, d), views.part_sizes(spark, d)), f"kernel{session.uuid.uuid4().hex}")
    return counted


@query(w("SELECT d.i, sum(d.v * s.x) AS x FROM dag d JOIN sizes s ON d.j = s.i GROUP BY d.i", "dag", "sizes"))
def csr_mult(spark, d):
    return linalg.spmv(views.part_dag(spark, d), views.part_sizes(spark, d))


@query(w("SELECT i, sum(x) AS x FROM (SELECT i, x FROM sizes UNION ALL SELECT d.i, 2 * d.v * s.x FROM dag d JOIN sizes s ON d.j = s.i) GROUP BY i", "dag", "sizes"))
def csr_mult_add(spark, d):
    x = views.part_sizes(spark, d)
    return linalg.mult_add(views.part_dag(spark, d), x, x, 2.0)


@query(w("SELECT op.j AS i, sum(op.v * ones.x) AS x FROM op JOIN ones ON op.i = ones.i GROUP BY op.j", "op", "ones"))
def csr_trans_mult(spark, d):
    return linalg.trans_mult(views.order_part(spark, d), views.order_ones(spark, d))


@query(w("SELECT i, sum(x) AS x FROM (SELECT i, x FROM sizes UNION ALL SELECT op.j, 0.5 * (op.v * ones.x) FROM op JOIN ones ON op.i = ones.i) GROUP BY i", "op", "ones", "sizes"))
def csr_trans_mult_add(spark, d):
    return linalg.trans_mult_add(views.order_part(spark, d), views.order_ones(spark, d), views.part_sizes(spark, d), 0.5)


@query(w("SELECT a.i, b.j, sum(a.v * b.v) AS v FROM dag a JOIN dag b ON a.j = b.i GROUP BY a.i, b.j", "dag"))
def matmul(spark, d):
    m = views.part_dag(spark, d)
    return linalg.matmul(m, m)


@query(w("SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM emb a JOIN emb b ON a.i = b.i GROUP BY a.j, b.j", "emb"))
def matmul_dense(spark, d):
    """All embeddings: the dense product E'E of 64 x 64."""
    m = views.embeddings(spark, d)
    return linalg.matmul(coo.transpose(m), m).select("i", "j", F.round("v", 6).alias("v"))


@query(w("SELECT 2 * (d.i // 2) + r AS i, sum(CASE WHEN d.i % 2 = r THEN d.v * s.x ELSE 0 END) AS x FROM dag d JOIN sizes s ON d.j = s.i, range(2) AS t(r) GROUP BY 1", "dag", "sizes"))
def bcsr_mult(spark, d):
    return linalg.bcsr_mult(linalg.bcsr(views.part_dag(spark, d)), views.part_sizes(spark, d), n=views.n_parts(spark, d))


@query(w("SELECT CAST(i // 2 AS BIGINT) AS block_row, CAST(j // 2 AS BIGINT) AS block_col, sum(v) AS total, count(DISTINCT i * 100000000 + j) AS filled FROM dag GROUP BY 1, 2", "dag"))
def bcsr_build(spark, d):
    made = linalg.bcsr(views.part_dag(spark, d))
    return made.select("block_row", "block_col", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("data", lambda x: x != 0)).cast("bigint").alias("filled"))


@query(w(_SPMV, "op", "sizes"))
def compressed_mult(spark, d):
    """From a matrix compressed at rest: Parquet's own encodings of sorted indices."""
    path = session.new_path(spark, "compressed")
    views.order_part(spark, d).repartitionByRange("i").sortWithinPartitions("i", "j").write.option("compression", "zstd").parquet(path)
    return linalg.spmv(spark.read.schema("i bigint, j bigint, v double").parquet(path), views.part_sizes(spark, d))


@query(w("SELECT dag.i, sum(dag.v * sizes.x) AS x FROM dag JOIN sizes ON dag.j = sizes.i GROUP BY dag.i", "dag", "sizes"))
def block_mult_realigned(spark, d):
    n = views.n_parts(spark, d)
    return linalg.block_mult_realigned(blocks.build(views.part_dag(spark, d), blocks.Grid(n, n, 8)), views.part_sizes(spark, d))


@query(w("SELECT coalesce(sum(v), 0) AS v FROM trade WHERE i = 3 AND j = 5", "trade"))
def cell_get(spark, d):
    return coo.cell(views.nation_trade(spark, d), 3, 5, 25, 25)


@query(w("SELECT i, sum(x) AS x FROM (SELECT i, x FROM sizes UNION ALL SELECT i, total FROM (SELECT j AS i, sum(v) AS total FROM dag GROUP BY 1)) GROUP BY i", "sizes", "dag"))
def vec_add(spark, d):
    return vector.add(views.part_sizes(spark, d), stats.col_sums(views.part_dag(spark, d)).select(F.col("j").alias("i"), F.col("total").alias("x")))


@query(w("SELECT i, x * 0.25 AS x FROM sizes", "sizes"))
def vec_scale(spark, d):
    return vector.scale(views.part_sizes(spark, d), 0.25)


@query(w("SELECT sum(x * x) AS dot FROM sizes", "sizes"))
def vec_dot(spark, d):
    return vector.dot(views.part_sizes(spark, d), views.part_sizes(spark, d))


@query(w("SELECT sum(abs(x)) AS norm1, round(sqrt(sum(x * x)), 6) AS norm2, round(sqrt(sum(x * x)), 6) AS norm2_robust, max(abs(x)) AS norm_inf FROM sizes", "sizes"))
def vec_norms(spark, d):
    return vector.norms(views.part_sizes(spark, d)).select("norm1", F.round("norm2", 6).alias("norm2"), F.round("norm2_robust", 6).alias("norm2_robust"), "norm_inf")


@query(w("SELECT i - 10 AS i, x FROM sizes WHERE i >= 10 AND i < 110", "sizes"))
def vec_slice(spark, d):
    return vector.slice_elements(views.part_sizes(spark, d), 10, 110)


@query(w("SELECT CAST(k AS BIGINT) AS i, coalesce(x, 0) AS x FROM range(0, (SELECT 2 * n FROM nn)) AS t(k) LEFT JOIN sizes ON sizes.i + 7 = k", "sizes", "nn"))
def vec_upscale(spark, d):
    return vector.upscale(views.part_sizes(spark, d), 7, 2 * views.n_parts(spark, d))


@query(w("SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM trade", "trade"))
def diag_scale(spark, d):
    return stats.row_normalize(views.nation_trade(spark, d)).select("i", "j", F.round("v", 9).alias("v"))


@query(w("SELECT i - 5 AS i, j - 5 AS j, v FROM nxt WHERE i BETWEEN 5 AND 104 AND j BETWEEN 5 AND 104", "nxt"))
def matrix_slice(spark, d):
    return coo.slice_cells(views.part_next(spark, d), (5, 105), (5, 105))


# Iterations


def _pagerank_sql(weights: str, alpha: float) -> str:
    return w(
        f""", nodes AS (SELECT p_partkey AS k, p_partkey NOT IN (SELECT i FROM dag) AS dangling FROM part),
        outs AS (SELECT i, {weights} AS s FROM dag GROUP BY i),
        pr(it, k, r) AS (
            SELECT 0, k, 1.0::DOUBLE / (SELECT n FROM nn) FROM nodes
            UNION ALL
            SELECT c.it + 1, nodes.k, {alpha} * coalesce(s.s, 0) + {1 - alpha}::DOUBLE / (SELECT n FROM nn) + {alpha} * c.m / (SELECT n FROM nn)
            FROM nodes
            CROSS JOIN (SELECT max(it) AS it, sum(CASE WHEN dangling THEN r ELSE 0 END) AS m FROM pr JOIN nodes USING (k) HAVING max(it) < {ROUNDS}) c
            LEFT JOIN (SELECT dag.j AS k, sum(dag.v / outs.s * pr.r) AS s FROM pr JOIN dag ON dag.i = pr.k JOIN outs ON outs.i = dag.i GROUP BY 1) s ON s.k = nodes.k)
        SELECT k, round(r * (SELECT n FROM nn), 6) AS rank FROM pr WHERE it = {ROUNDS}""",
        "dag", "nn", recursive=True,
    ).replace(" , nodes AS", ", nodes AS", 1)


def _ranked(spark, d, **more):
    n = views.n_parts(spark, d)
    ranks = pagerank(views.part_dag(spark, d), n, tolerance=None, most_rounds=ROUNDS, **more).ranks
    return ranks.select("k", F.round(F.col("r") * n, 6).alias("rank"))


@query(_pagerank_sql("sum(v)", 0.85))
def pagerank_local(spark, d):
    return _ranked(spark, d)


@query(_pagerank_sql("sum(v)", 0.8))
def pagerank_block(spark, d):
    return _ranked(spark, d, alpha=0.8, b=4)


@query(_pagerank_sql("count(*)", 0.85).replace("sum(dag.v / outs.s * pr.r)", "sum(1.0::DOUBLE / outs.s * pr.r)"))
def pagerank_kv(spark, d):
    """Cells counted, not weighed: the weights are those of a pattern."""
    n = views.n_parts(spark, d)
    pattern = views.part_dag(spark, d).withColumn("v", F.lit(1.0))
    ranks = pagerank(pattern, n, tolerance=None, most_rounds=ROUNDS, normalize="count").ranks
    return ranks.select("k", F.round(F.col("r") * n, 6).alias("rank"))


@query()
def pagerank_converged(spark, d):
    n = views.n_parts(spark, d)
    return pagerank(views.part_dag(spark, d), n, tolerance=1e-5, most_rounds=50).ranks.select("k", F.round(F.col("r") * n, 4).alias("rank"))


@query(w("SELECT j AS i, 2 * i AS j, round(v / count(*) OVER (PARTITION BY i), 9) AS v FROM trade UNION ALL SELECT CAST(a.i AS BIGINT), CAST(m.j AS BIGINT), 1.0 / 50 FROM range(50) AS a(i), (SELECT j FROM range(50) AS r(j) WHERE j NOT IN (SELECT 2 * i FROM trade)) m", "trade"))
def normalize_export(spark, d):
    """All rows; doubled ones leave the empty columns."""
    path = session.new_path(spark, "normalized")
    normalize.export(views.nation_trade(spark, d).withColumn("i", 2 * F.col("i")), 50, path)
    return spark.read.csv(path, sep=" ", schema="i bigint, j bigint, v double").select("i", "j", F.round("v", 9).alias("v"))


@query("SELECT CAST(1 AS DOUBLE) AS mass")
def rank_mass_check(spark, d):
    n = views.n_parts(spark, d)
    return rank_mass(pagerank(views.part_dag(spark, d), n, tolerance=None, most_rounds=3).ranks).select(F.round("mass", 9).alias("mass"))


# Costs


def _cost_sql(b: str, select: str) -> str:
    """Costs of all blocks of the trade matrix for the block counts of table bs(b)."""
    return w(
        f""", bs AS ({b}),
        every AS (SELECT b, CAST(k AS BIGINT) AS block, CAST(CASE WHEN k // b = b - 1 THEN 25 - (25 // b) * (b - 1) ELSE 25 // b END AS BIGINT) AS r, CAST(CASE WHEN k % b = b - 1 THEN 25 - (25 // b) * (b - 1) ELSE 25 // b END AS BIGINT) AS c FROM bs, range(625) AS t(k) WHERE k < b * b),
        own AS (SELECT b, least(i // (25 // b), b - 1) AS br, least(j // (25 // b), b - 1) AS bc, i, j FROM trade, bs WHERE v <> 0),
        cells AS (SELECT b, br * b + bc AS block, i - br * (25 // b) AS i, j - bc * (25 // b) AS j FROM own),
        diag AS (SELECT b, block, j - i AS d, count(*) AS z FROM cells GROUP BY 1, 2, 3),
        sums AS (SELECT every.b, every.block, r, c, coalesce(sum(z), 0) AS z, count(d) AS n, coalesce(sum(CASE WHEN d IS NULL THEN 0 WHEN d < 0 THEN least(r + d, c) ELSE least(r, c - d) END), 0) AS s FROM every LEFT JOIN diag ON every.b = diag.b AND every.block = diag.block GROUP BY 1, 2, 3, 4),
        costs AS (SELECT b, block, 'CSR' AS format, CAST(r + 1 + 2 * z AS BIGINT) AS storage, CAST(z AS BIGINT) AS mults, CAST(4 * z AS BIGINT) AS memory FROM sums
            UNION ALL SELECT b, block, 'CSC', c + 1 + 2 * z, z, 4 * z FROM sums
            UNION ALL SELECT b, block, 'CDS', n + s, s, 3 * n + 3 * s FROM sums
            UNION ALL SELECT b, block, 'Dense', r * c, r * c, 3 * r * c FROM sums)
        {select}""",
        "trade",
    ).replace(" , bs AS", ", bs AS", 1)


@query(_cost_sql("SELECT 4 AS b", "SELECT CAST(block AS BIGINT) AS block, format, storage, mults, memory FROM costs"))
def format_cost(spark, d):
    return cost.format_cost(views.nation_trade(spark, d), 25, 4)


@query(_cost_sql("SELECT unnest([1, 5, 25]) AS b", "SELECT CAST(b AS BIGINT) AS b, format, CAST(sum(storage) AS BIGINT) AS storage, CAST(sum(mults) AS BIGINT) AS mults, CAST(sum(memory) AS BIGINT) AS memory FROM costs GROUP BY 1, 2"))
def format_cost_sweep(spark, d):
    return cost.format_cost_sweep(views.nation_trade(spark, d), 25)


@query(_cost_sql("SELECT 4 AS b", "SELECT CAST(block AS BIGINT) AS block, first(format ORDER BY memory, list_position(['CSR', 'CSC', 'CDS', 'Dense'], format)) AS format, min(memory) AS memory FROM costs GROUP BY block"))
def pick_fastest(spark, d):
    return cost.cheapest(cost.format_cost(views.nation_trade(spark, d), 25, 4))


# Instrumentation


@query("SELECT CAST(o_orderkey AS VARCHAR) AS marker, CAST((o_orderkey % 1000) * 7 AS BIGINT) AS duration_ms FROM orders")
def iteration_log_report(spark, d):
    """A log with a start and an end for each order, some of them past midnight."""
    start = (F.col("o_orderkey") * 7919) % 86_400_000
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    orders = views.table(spark, d, "orders").select("o_orderkey", start.alias("a"), ((start + (F.col("o_orderkey") % 1000) * 7) % 86_400_000).alias("b"))
    line = lambda ms, mark: F.concat(stamp(F.col(ms)), F.lit(f" INFO {mark} - "), F.col("o_orderkey").cast("string"), F.lit(" - iteration"))
    lines = orders.select(F.explode(F.array(line("a", "TIC"), line("b", "TOC"), F.lit("no such line"))).alias("value"))
    return iteration_log.report(iteration_log.parse(lines))


@query("SELECT 'kernel' AS marker, true AS found")
def tictoc(spark, d):
    clock = iteration_log.TicToc()
    clock.tic("kernel", "start")
    clock.toc("kernel", "end")
    lines = spark.createDataFrame([(x,) for x in clock.lines], "value string")
    return iteration_log.report(iteration_log.parse(lines)).select("marker", (F.col("duration_ms") < 60_000).alias("found"))


@query("SELECT true AS has_partial_sum, true AS has_join")
def explain(spark, d):
    plan = linalg.spmv(views.order_part(spark, d), views.part_sizes(spark, d))
    text = plan._jdf.queryExecution().toString()
    return spark.createDataFrame([("partial_sum" in text, "Join" in text)], "has_partial_sum boolean, has_join boolean")
