"""Hard negatives, nearest neighbours, whitening."""

import duckdb
import numpy as np
import pytest

from querytide.errors import InvalidArgumentError
from querytide.llm import cholesky_whitening, collision_search, four_russians, vector_blocks
from querytide.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, vector array<float>, label int, id string, anchor_id int, _block int, label_2 int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """(id, vector, label) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, y, "x", 1, 2, 3) for i, v, y in rows], SCHEMA)


def odd_rows(dims):
    """Rows that take no part."""
    return [
        (None, [1.0] * dims, 1),
        (100, None, 1),
        (200, [], 1),
        (300, [None] + [1.0] * (dims - 1), 1),
        (400, [NAN] + [1.0] * (dims - 1), 1),
        (500, [-INF] + [1.0] * (dims - 1), 1),
    ]


def random_rows(n, dims, labels, seed=1, copies=0):
    draw = np.random.default_rng(seed)
    vectors = draw.standard_normal((n, dims)).astype(np.float32)
    vectors[n - copies :] = vectors[0]
    return [(i, vectors[i].tolist(), int(draw.integers(labels))) for i in range(n)]


def mined(rows, is_anchor, positives, negatives, scale=256):
    """Brute force over whole numbers of any size."""
    width = max(len(v) for _, v, _ in rows)
    whole = {i: [int(np.floor(scale * float(x))) for x in v] + [0] * (width - len(v)) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    out = []
    for a in filter(is_anchor, whole):
        score = {i: sum(x * y for x, y in zip(whole[a], v)) for i, v in whole.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a] and i != a][:positives]:
            fit = [i for i in order if label[i] != label[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def hard_negatives(df, every=10, **more):
    found = four_russians.hard_negatives(df, lambda i: i % every == 0, "vec_id", "vector", "label", **more)
    return sorted(tuple(r) for r in found.collect())


def test_planes_and_lookups_give_the_inner_products():
    draw = np.random.default_rng(3)
    for dims, most in [(1, 1), (8, 100), (13, 255), (64, 1 << 20)]:
        a, c = draw.integers(-most, most + 1, (7, dims)), draw.integers(-most, most + 1, (11, dims))
        bits = most.bit_length() + 1
        planes = four_russians.planes_of(c, bits)
        assert (four_russians.values_of(planes)[:, :dims] == c).all()
        width = -(-dims // 8) * 8
        padded = np.zeros((7, width), np.int64)
        padded[:, :dims] = a
        assert (four_russians.scores(four_russians.subset_sums(padded, np.int64), planes) == c @ a.T).all()


@pytest.mark.parametrize(("dims", "labels", "copies"), [(16, 3, 0), (5, 40, 0), (9, 2, 120), (1, 1, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims, labels, copies):
    monkeypatch.setattr(four_russians, "ROWS", 64)
    monkeypatch.setattr(four_russians, "COLUMNS", 4)
    monkeypatch.setattr(vector_blocks, "LEAST_ROWS", 50)
    monkeypatch.setattr(vector_blocks, "LEAST_ASKED", 8)
    rows = random_rows(300, dims, labels, copies=copies)
    assert hard_negatives(table(spark, rows)) == mined(rows, lambda i: i % 10 == 0, 5, 10)


def test_hard_negatives_of_odd_rows(spark):
    rows = random_rows(60, 4, 2) + [(70, [1.0, 2.0], 1), (80, [0.0] * 4, 0), (90, [-300.0, 5e4, 0.25, 1.0], 1)]
    want = mined(rows, lambda i: i % 10 == 0, 5, 10)
    more = odd_rows(4) + [(610, [1.0] * 4, None)] + rows[:20]
    assert hard_negatives(table(spark, rows + more)) == want
    assert hard_negatives(table(spark, odd_rows(4))) == []
    assert hard_negatives(table(spark, [])) == []
    assert hard_negatives(table(spark, rows), every=1000)[:1] == mined(rows, lambda i: i == 0, 5, 10)[:1]
    with pytest.raises(InvalidArgumentError):
        hard_negatives(table(spark, [(1, [1e30], 1)]))


def test_hard_negatives_equal_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    want = sorted(connection.sql(ORACLES["op11_hard_negatives"]).fetchall())
    assert want and sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, TABLES).collect()) == want


def nearest(df, every, k=20):
    found = collision_search.nearest(df, lambda i: i % every == 0, "vec_id", "vector", k).collect()
    return {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in found}}


def searched(rows, every, k=20):
    width = max(len(v) for _, v, _ in rows)
    ids = np.array([i for i, _, _ in rows])
    x = np.array([v + [0.0] * (width - len(v)) for _, v, _ in rows], np.float32).astype(np.float64)
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        scores = (x * x[n]).sum(axis=1)
        order = [m for m in np.lexsort((ids, -scores)) if m != n][:k]
        out[int(ids[n])] = [(int(ids[m]), scores[m]) for m in order]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize(("dims", "sizes"), [(64, False), (64, True), (12, True), (2, True), (1, True), (200, False)])
def test_recall_of_nearest(spark, monkeypatch, dims, sizes):
    monkeypatch.setattr(collision_search, "CHUNK", 600)
    monkeypatch.setattr(collision_search, "FIRST", 100)
    rows = random_rows(2000, dims, 1, copies=100)
    if sizes:
        draw = np.random.default_rng(2)
        rows = [(i, (np.array(v) * draw.lognormal(0, 0.5)).tolist(), y) for i, v, y in rows]
    got, want = nearest(table(spark, rows), 50), searched(rows, 50)
    assert set(got) == set(want) and all(len(found) == 20 for found in got.values())
    assert recall(got, want) >= 0.95
    for q, found in got.items():  # right scores, in order
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(score - dict(searched(rows, 50, 2000)[q])[i]) < 1e-9 for i, score in found[:2])


def test_recall_of_the_query(spark):
    got = {}
    for r in QUERIES["op12_nearest"](spark, TABLES).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    want = searched(rows, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_nearest_of_odd_rows(spark):
    rows = random_rows(30, 4, 1, copies=5)
    rows += [(31, [1.0], 1)]
    got = nearest(table(spark, rows + odd_rows(4) + [(700, [0.0, -0.0, 0.0, 0.0], 1)] + rows[:7]), 10, k=100)
    want = searched(rows, 10, 100)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert nearest(table(spark, odd_rows(4)), 10) == {} and nearest(table(spark, []), 10) == {}
    assert nearest(table(spark, [(10, [1.0, 2.0], 1)]), 10) == {}
    same = [(i, [0.5, 0.25], 1) for i in range(40)]
    assert [i for i, _ in nearest(table(spark, same), 40)[0]] == list(range(1, 21))


def test_window_share_and_directions():
    draw = np.random.default_rng(5)
    for dims in (2, 3, 9, 65):
        points = draw.standard_normal((20_000, dims))
        points /= np.linalg.norm(points, axis=1)[:, None]
        inside = (np.abs(points @ collision_search.directions(dims)) <= collision_search.HALF_WIDTH).mean()
        assert abs(inside - collision_search.share_inside(dims)) < 0.01


def check_whitening(rows, found, components):
    """Against eigenvectors of the covariance; rows are those that remain."""
    width = max(len(v) for _, v, _ in rows)
    x = np.floor(64 * np.array([v + [0.0] * (width - len(v)) for _, v, _ in rows], np.float32).astype(np.float64))
    x = x.astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    spread = n * x - sums
    values, vectors = np.linalg.eigh((spread / n).T @ (spread / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(components, int((values > values[0] * 1e-9).sum()))
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert sum(len(v) for c in got.values() for v in c.values()) == n * rank
    for k in range(rank):
        want = spread / n @ vectors[:, k] / np.sqrt(values[k])
        mine = np.array([got[i][k + 1][0]["whitened"] for i, _, _ in rows])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert got[rows[0][0]][k + 1][0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
    for (i, _, _), total in zip(rows, (spread**2).sum(axis=1), strict=True):
        assert {(r["n"], r["deviation"]) for c in got[i].values() for r in c} == {(n, total)}
    assert all(r["identity_error"] <= 1e-8 for r in found)


def whiten(df, components=32):
    return cholesky_whitening.whiten(df, "vec_id", "vector", components).collect()


def test_whitening(spark):
    rows = random_rows(400, 6, 1)
    scaled = [(i, (np.array(v) * [100, 30, 10, 3, 1, 1]).tolist(), y) for i, v, y in rows]
    check_whitening(scaled, whiten(table(spark, scaled + odd_rows(6)[1:])), 32)
    check_whitening(scaled, whiten(table(spark, scaled), 3), 3)


def test_whitening_without_full_rank(spark):
    rows = [(i, [v[0], 2.0, 50 * v[1], 0.0], y) for i, v, y in random_rows(300, 2, 1)]
    check_whitening(rows, whiten(table(spark, rows)), 32)
    few = random_rows(4, 9, 1)
    check_whitening(few, whiten(table(spark, few)), 32)
    short = [(i, v[: 3 + i % 2], y) for i, v, y in random_rows(50, 4, 1)]
    check_whitening(short, whiten(table(spark, short)), 32)
    assert whiten(table(spark, [])) == [] and whiten(table(spark, odd_rows(3)[1:])) == []
    assert whiten(table(spark, [(1, [1.0, 2.0], 1)] * 3)) == []


def test_whitening_keeps_repeated_rows(spark):
    rows = random_rows(100, 3, 1)
    found = whiten(table(spark, rows + rows + [(None, [0.5, 0.5, 0.5], 1)]))
    assert len(found) == 201 * 3 and sum(r["vec_id"] is None for r in found) == 3 and {r["n"] for r in found} == {201}


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [(-1.0) ** k * 1e7, 1.0 * k], 1) for k in range(8)]
    assert {r["deviation"] for r in whiten(table(spark, rows))} == {None}


def test_triangular_factor_of_ill_conditioned_rows():
    draw = np.random.default_rng(7)
    q, _ = np.linalg.qr(draw.standard_normal((500, 8)))
    turn, _ = np.linalg.qr(draw.standard_normal((8, 8)))
    sizes = 10.0 ** -np.arange(8) * 1e3
    x = q * sizes @ turn

    def gram(factors):
        part = cholesky_whitening.divided(x, factors)
        return part.T @ part

    found = np.linalg.svd(cholesky_whitening.triangular_factor(gram, *x.shape), compute_uv=False)
    assert np.abs(found / sizes - 1).max() < 1e-7  # the eigenvalues of x.T @ x alone would be off by a hundredth
