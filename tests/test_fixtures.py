"""Known matrices and graphs, and properties that hold for all."""

from __future__ import annotations

import gzip
import math

import pytest
from pyspark.sql import functions as F

from gridrank import session
from gridrank.functions import vector
from gridrank.operators import blocks, coo, cost, joins, linalg, reorder, stats
from gridrank.plans import pagerank as ranking
from gridrank.plans.pagerank import pagerank, rank_mass
from gridrank.sources import catalog, edge_list, matrix_market, vectors
from gridrank.streaming import iteration_log

SMALL = [(0, 2, 1.0), (1, 0, 2.0), (1, 5, 3.0), (2, 3, 4.0), (2, 4, 5.0), (3, 1, 6.0), (3, 6, 7.0), (6, 7, 8.0), (7, 6, 9.0)]
GOLDEN = [0.067487, 0.070146, 0.093418, 0.076795, 0.076795, 0.067487, 0.282469, 0.265403]
SIX = [(0, 1), (0, 2), (0, 5), (1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (3, 0), (3, 2), (3, 4), (3, 5), (4, 0), (5, 0), (5, 1), (5, 4)]


def matrix(spark, cells):
    return spark.createDataFrame([(c[0], c[1], float(c[2]) if len(c) > 2 else 1.0) for c in cells], "i bigint, j bigint, v double")


def dense(df, n, key="i", value="x"):
    found = {r[key]: r[value] for r in df.collect()}
    return [found.get(k, 0.0) for k in range(n)]


def cells(df):
    return sorted((r.i, r.j, r.v) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    return matrix(spark, SMALL).cache()


def write_lines(path, lines):
    path.write_text("\n".join(lines))
    return f"file://{path}"


def test_products_of_the_small_matrix(spark, small):
    ones = vectors.constant(spark, 8)
    assert dense(linalg.spmv(small, ones), 8) == [1, 5, 9, 13, 0, 0, 8, 9]
    assert dense(linalg.trans_mult(small, ones), 8) == [2, 6, 1, 4, 5, 3, 16, 8]
    assert stats.frobenius(small).first()[0] == pytest.approx(math.sqrt(285))


def test_matrix_market_file_with_an_entry_in_the_last_row(spark, tmp_path):
    lines = ["%%MatrixMarket matrix coordinate real general", "% a comment", "8 8 9", *[f"{i + 1} {j + 1}   {v}" for i, j, v in SMALL]]
    path = write_lines(tmp_path / "small.mtx", lines)
    info = matrix_market.header(spark, path)
    assert (info.n, info.m, info.nnz, info.field, info.symmetry) == (8, 8, 9, "real", "general")
    assert cells(matrix_market.read(spark, path)) == sorted(SMALL)
    assert cells(matrix_market.read(spark, path, values="pattern", transpose=True)) == sorted((j, i, 1.0) for i, j, _ in SMALL)


def test_the_size_line_is_skipped_by_place(spark, tmp_path):
    path = write_lines(tmp_path / "one.mtx", ["%%MatrixMarket matrix coordinate real general", "2 2 1", "2 2 1"])
    assert cells(matrix_market.read(spark, path)) == [(1, 1, 1.0)]


@pytest.mark.parametrize(("banner", "size"), [("%%MatrixMarket matrix coordinate complex general", "2 2 1"), ("%%MatrixMarket matrix coordinate real hermitian", "2 2 1"), ("%%MatrixMarket matrix coordinate real odd", "2 2 1"), ("%%MatrixMarket matrix coordinate real general", "2 2")])
def test_bad_headers_are_rejected(spark, tmp_path, banner, size):
    with pytest.raises(ValueError):
        matrix_market.read(spark, write_lines(tmp_path / "bad.mtx", [banner, size, "1 1 1"]))


def test_array_files(spark, tmp_path):
    path = write_lines(tmp_path / "a.mtx", ["%%MatrixMarket matrix array real symmetric", "3 3", "1", "2", "3", "4", "5", "6"])
    assert cells(matrix_market.read(spark, path)) == sorted([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 2.0), (2, 0, 3.0), (0, 2, 3.0), (1, 1, 4.0), (2, 1, 5.0), (1, 2, 5.0), (2, 2, 6.0)])


def test_edge_list(spark, tmp_path):
    path = write_lines(tmp_path / "e.txt", ["# Directed graph (each unordered pair of nodes is saved once): x.txt", "# title", "# Nodes: 685230 Edges: 7600595", "# FromNodeId\tToNodeId", "1\t2", "1\t5", "254913\t255378", "1\t2"])
    info = edge_list.header(spark, path)
    assert (info.n, info.edges, info.directed) == (685230, 7600595, True)
    edges = edge_list.read_edges(spark, path)
    assert edges.count() == 4 and {r.src for r in edges.collect()} == {1, 254913}
    found, ids = edge_list.compact(edges)
    assert sorted(map(tuple, ids.select("k", "node").collect())) == [(0, 1), (1, 2), (2, 5), (3, 254913), (4, 255378)]
    assert cells(found) == [(0, 1, 2.0), (0, 2, 1.0), (3, 4, 1.0)]
    assert cells(edge_list.compact(edges, directed=False)[0]) == [(0, 1, 2.0), (0, 2, 1.0), (1, 0, 2.0), (2, 0, 1.0), (3, 4, 1.0), (4, 3, 1.0)]


def test_compressed_lines_without_a_telling_name(spark, tmp_path):
    (tmp_path / "zipped").write_bytes(gzip.compress(b"a\nb\n"))
    (tmp_path / "plain").write_bytes(b"a\nb\n")
    for name, zipped in (("zipped", True), ("plain", False)):
        path = f"file://{tmp_path / name}"
        assert catalog.is_gzip(spark, path).first()["gzip"] is zipped
        assert [r.value for r in catalog.read_lines(spark, path).collect()] == ["a", "b"]


@pytest.mark.parametrize("b", [None, 3])
def test_pagerank_of_a_graph_with_dangling_nodes(spark, b):
    found = pagerank(matrix(spark, [(i, j) for i, j, _ in SMALL]), 8, alpha=0.8, tolerance=1e-5, b=b)
    ranks = dense(found.ranks, 8, "k", "r")
    assert found.rounds == 41 and ranks == pytest.approx(GOLDEN, abs=1e-4) and sum(ranks) == pytest.approx(1)
    assert found.report().count() == 41


def test_pagerank_without_dangling_nodes_and_with_weights(spark):
    found = pagerank(matrix(spark, SIX), 6)
    assert found.rounds == 37
    assert dense(found.ranks, 6, "k", "r") == pytest.approx([0.252127, 0.139306, 0.151306, 0.118908, 0.187046, 0.151306], abs=1e-6)
    loops = pagerank(matrix(spark, [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 1, 2)]), 4)
    assert dense(loops.ranks, 4, "k", "r") == pytest.approx([0.25, 0.4625, 0.25, 0.0375])


def test_nodes_without_links_to_them_keep_their_rank(spark):
    found = pagerank(matrix(spark, [(0, 2), (1, 2), (2, 3), (3, 2)]), 4, tolerance=None, most_rounds=30, b=2)
    assert dense(found.ranks, 4, "k", "r") == pytest.approx([0.0375, 0.0375, 0.47973, 0.44527], abs=1e-2)
    assert rank_mass(found.ranks).first()[0] == pytest.approx(1)


def test_bad_graphs_are_rejected(spark):
    with pytest.raises(ValueError):
        pagerank(matrix(spark, [(0, 1, -1)]), 2)
    with pytest.raises(ValueError):
        pagerank(matrix(spark, [(0, 1)]), 2, alpha=1.0)


def test_small_dense_blocks(spark):
    six = [(0, 0, 11), (0, 1, 12), (0, 2, 13), (0, 3, 14), (1, 1, 22), (1, 2, 23), (2, 2, 33), (2, 3, 34), (2, 4, 35), (2, 5, 36), (3, 3, 44), (3, 4, 45), (4, 5, 56), (5, 5, 66)]
    m, ones = matrix(spark, six), vectors.constant(spark, 6)
    made = linalg.bcsr(m)
    assert sorted((r.block_row, r.block_col) for r in made.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    assert dense(linalg.bcsr_mult(made, ones), 6) == [50, 45, 138, 89, 56, 66]
    assert dense(linalg.bcsr_mult(linalg.bcsr(m, 4, 5), ones, 4, 5, n=6), 6) == [50, 45, 138, 89, 56, 66]


def test_block_keys_and_sizes(spark):
    grid = blocks.Grid(8, 5, 3)
    keys = spark.range(8).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select("i", F.col("j").cast("bigint").alias("j"), grid.key().alias("key"))
    found = {(r.i, r.j): r.key for r in keys.collect()}
    rows = {0: [0, 0, 1, 1, 2], 3: [3, 3, 4, 4, 5], 6: [6, 6, 7, 7, 8]}
    assert all(found[i, j] == rows[i // 3 * 3][j] for i in range(8) for j in range(5))
    assert blocks.Grid(325729, 325729, 2).dims(325728, 162864) == (162865, 0, 162864, 162865)
    assert blocks.Grid(325729, 325729, 4).dims(11285, 11285) == (0, 0, 81433, 81433)
    with pytest.raises(ValueError):
        blocks.Grid(2, 2, 3)
    sizes = lambda n, b: sorted((r.start, r["size"]) for r in blocks.vector_block_sizes(spark, n, b).collect())
    assert sizes(11, 2) == [(0, 6), (6, 5)] and sizes(5, 4) == [(0, 2), (2, 2), (4, 1)] and len(sizes(261, 32)) == 29
    for n in range(2, 60):
        grid = blocks.Grid(n, n, 2)
        assert grid.height + (n - grid.height) == n and -(-n // grid.height) == 2


def test_block_counts_and_blockwise_products(spark, small):
    grid = blocks.Grid(8, 8, 2)
    assert {r.block_key: r.nnz for r in stats.block_nnz(coo.transpose(small), grid.key()).collect()} == {0: 4, 2: 3, 3: 2}
    ones = vectors.constant(spark, 8)
    for b in (1, 3, 8):
        grid = blocks.Grid(8, 8, b)
        packed = blocks.build(small, grid)
        assert cells(blocks.unpack(packed)) == sorted(SMALL)
        y = linalg.from_blocks(linalg.spmv_blocks(packed, blocks.vector_blocks(ones, grid.width, 8)))
        assert dense(y, 8) == [1, 5, 9, 13, 0, 0, 8, 9]
    csr = blocks.build(matrix(spark, [(0, 1, 2), (0, 2, 2), (1, 0, 2)]), blocks.Grid(3, 3, 1)).first()
    assert (csr.indptr, csr.indices) == ([0, 2, 3, 3], [1, 2, 0])


def test_costs(spark):
    four = matrix(spark, [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 2), (3, 2)])
    found = {(r.b, r.format): (r.storage, r.mults, r.memory) for r in cost.format_cost_sweep(four, 4).collect()}
    expected = {1: [(21, 8, 32), (21, 8, 32), (18, 13, 54), (16, 16, 48)], 2: [(28, 8, 32), (28, 8, 32), (17, 10, 51), (16, 16, 48)], 4: [(48, 8, 32), (48, 8, 32), (16, 8, 48), (16, 16, 48)]}
    assert found == {(b, f): c for b, own in expected.items() for f, c in zip(cost.FORMATS, own, strict=True)}


def test_bitmaps_and_reordering(spark):
    for start, length, size in ((249410, 5090, 325729), (63, 1, 128), (0, 1, 128), (63, 2, 128), (0, 128, 128)):
        assert blocks.bit_window(spark, start, length, size).count() == length
    sums = matrix(spark, [(0, 0, 1), (1, 0, 3), (2, 0, 2)])
    assert cells(reorder.reorder_rows_by_sum(sums)) == [(0, 0, 3.0), (1, 0, 2.0), (2, 0, 1.0)]
    assert cells(reorder.reorder_cols_by_sum(coo.transpose(sums))) == [(0, 0, 3.0), (0, 1, 2.0), (0, 2, 1.0)]


def test_rcm_narrows_a_shuffled_path(spark):
    order = [3, 7, 1, 9, 0, 5, 8, 2, 6, 4]
    path = matrix(spark, [(a, b) for a, b in zip(order, order[1:], strict=False)])
    new = reorder.reverse_cuthill_mckee(path, 10)
    assert sorted(r.new for r in new.collect()) == list(range(10))
    assert reorder.bandwidth(reorder.permute(path, new, new)).first()[0] == 1


def test_identities(spark, small):
    assert cells(coo.transpose(coo.transpose(small))) == sorted(SMALL)
    assert matrix_market.detect_symmetry(coo.symmetrize(small)) == "symmetric"
    assert matrix_market.detect_symmetry(coo.symmetrize(small.where("i <> j"), "skew-symmetric")) == "skew-symmetric"
    assert matrix_market.detect_symmetry(small) == "general"
    x = vectors.constant(spark, 8, 2.0)
    column = x.select("i", F.lit(0).cast("bigint").alias("j"), F.col("x").alias("v"))
    assert dense(linalg.matmul(small, column), 8, "i", "v") == dense(linalg.spmv(small, x), 8) == dense(linalg.spmv_broadcast(small, x), 8) == dense(linalg.spmv_cross(small, x, 8), 8)
    huge = spark.createDataFrame([(0, 1e200), (1, 1e200)], "i bigint, x double")
    n = vector.norms(huge).first()
    assert math.isinf(n.norm2) and n.norm2_robust == pytest.approx(math.sqrt(2) * 1e200) and n.norm_inf == 1e200
    assert cells(joins.fill_missing_columns(matrix(spark, [(0, 0), (1, 0)]), 2)) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 1.0), (1, 1, 0.5)]
    with pytest.raises(IndexError):
        coo.cell(small, 8, 0, 8, 8)


def test_log_report_past_midnight(spark):
    lines = ["23:59:59,900 INFO TIC - 7 - start", "00:00:00,150 INFO TOC - 7 - end", "10:00:00,000 INFO TIC - 8 - a", "10:00:00,500 INFO TIC - 8 - b", "10:00:02,000 INFO TOC - 8 - c", "noise"]
    found = iteration_log.report(iteration_log.parse(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert sorted(map(tuple, found.collect())) == [("7", 250), ("8", 2000)]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rcm_never_stops_short_without_an_error(spark):
    path = matrix(spark, [(k, k + 1) for k in range(2)])
    assert reorder.reverse_cuthill_mckee(path, 3).count() == 3
    with pytest.raises(RuntimeError):
        reorder.reverse_cuthill_mckee(path, 3, most_levels=1)


def test_entry_module_without_the_text_operators(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("gridrank.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "gridrank.llm", None)
    monkeypatch.delattr("gridrank.llm", raising=False)
    assert e.queries().keys() == e.core.QUERIES.keys() and e.oracle_sql().keys() == e.core.ORACLE_SQL.keys()


@pytest.mark.parametrize("entry", ["4 1 1", "0 2 1", "1 6 1", "1 0 1"])
def test_entries_outside_the_matrix_fail(spark, tmp_path, entry):
    path = tmp_path / "wide.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate real general\n% wide\n3 5 1\n{entry}\n")
    with pytest.raises(Exception, match="beyond"):
        matrix_market.read(spark, f"file://{path}").collect()


@pytest.mark.parametrize("kind", ["symmetric", "skew-symmetric"])
def test_packed_triangles(spark, tmp_path, kind):
    n, shift = 40, int(kind == "skew-symmetric")
    cells = [(i, j) for j in range(n) for i in range(j + shift, n)]
    path = tmp_path / "packed.mtx"
    path.write_text(f"%%MatrixMarket matrix array real {kind}\n{n} {n}\n" + "\n".join(str(k + 1) for k in range(len(cells))) + "\n")
    found = {(r.i, r.j): r.v for r in matrix_market.read(spark, f"file://{path}", expand=False).collect()}
    assert found == {c: k + 1 for k, c in enumerate(cells)}


def test_links_in_buckets_rank_alike_and_do_not_move(spark, monkeypatch):
    rows = [(0, k, 1.0) for k in range(1, 400)] + [(k, (k * 7 + 1) % 400, 1.0 + k % 3) for k in range(400)] + [(k, (k * 11 + 5) % 400, 2.0) for k in range(300)]
    graph = matrix(spark, rows)
    want = {r.k: r.r for r in pagerank(graph, 400, tolerance=None, most_rounds=5).ranks.collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hubs in (1000, 4):
            monkeypatch.setattr(ranking, "HUBS", hubs)
            found = {r.k: r.r for r in pagerank(graph, 400, tolerance=None, most_rounds=5, most_broadcast=0).ranks.collect()}
            assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
        links = session.Kept(graph.repartition(session.buckets(spark), "i"), "links", "i")
        ranks = session.Kept(spark.range(400).selectExpr("id as k", "0.5D as r").repartition(session.buckets(spark), "k"), "ranks", "k")
        products = joins.rank_products(ranks.df, links.df.selectExpr("j as i", "i as j", "v"))
        assert "Exchange" not in products._jdf.queryExecution().executedPlan().toString()
        links.drop()
        ranks.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
