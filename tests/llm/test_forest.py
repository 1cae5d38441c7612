import numpy as np
import pytest

from stowage.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int"
EVERY_100 = "vec_id % 100 = 0"


def brute(rows, k=10):
    """The k nearest of every query; rows: distinct (id, vector) that take part."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    found = {}
    for q in sorted({i for i in ids if i % 100 == 0}):
        own = vectors[ids == q][0]
        score = np.sqrt(((vectors - own) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, score)) if ids[i] != q][:k]
        found[int(q)] = [(int(ids[i]), score[i]) for i in order]
    return found


def got(frame):
    found = {}
    for r in sorted(frame.collect()):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]]
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]], rtol=1e-12)


def cloud(n, d, seed, near=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if near:
        x = rng.normal(size=(max(1, n // 50), d))[rng.integers(0, max(1, n // 50), n)] + near * x
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


def recall(found, want):
    assert found.keys() == want.keys()
    return sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)


def exact_scores(found, rows):
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for q, near in found.items():
        for i, score in near:
            assert np.isclose(score, np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), rtol=1e-12)


@pytest.fixture()
def small_parts(monkeypatch):
    """Segments, blocks and parts so small that every way of cutting is taken."""
    for name, value in {"SEGMENT": 500, "QUERIES": 7, "VECTOR_BLOCK": 300, "PRODUCT_ROWS": 5, "SAMPLES": 2000}.items():
        monkeypatch.setattr(forest, name, value)


@pytest.mark.parametrize("near", [0.0, 0.3])
def test_recall_and_scores(spark, small_parts, near):
    """Scattered vectors, and clusters of about fifty."""
    rows = cloud(5000, 32, 2, near=near)
    found = got(forest.nearest(frame_of(spark, rows), EVERY_100, trees=48))
    assert recall(found, brute(rows)) >= 0.9
    exact_scores(found, rows)


def test_no_query_goes_to_the_root(spark, monkeypatch):
    """Clustered vectors are settled in small cells, scattered ones in wide cells, none by measuring everything."""
    seen = []
    measured = forest.Forest.measured

    def watched(self, asked):
        seen.append([r["depth"] for r in asked.select("depth").collect()])
        return measured(self, asked)

    monkeypatch.setattr(forest.Forest, "measured", watched)
    rows = cloud(6000, 32, 4, near=0.05)
    found = got(forest.nearest(frame_of(spark, rows), EVERY_100))
    assert recall(found, brute(rows)) >= 0.95
    first, further = seen
    assert len(first) == 60 and min(first) >= 4 and len(further) <= 6
    seen.clear()
    rows = cloud(3000, 32, 5)
    found = got(forest.nearest(frame_of(spark, rows), EVERY_100))
    assert recall(found, brute(rows)) >= 0.9
    assert min(seen[0]) > 0 and min(seen[1], default=1) > 0


def test_one_hot_prefix_is_dealt(spark, small_parts):
    """A third of all vectors begin alike in every tree: their segment is dealt over several arrays."""
    rng = np.random.default_rng(7)
    rows = cloud(2400, 16, 6)
    rows = [(i, [float(np.float32(x)) for x in 1 + 1e-4 * rng.normal(size=16)] if i % 3 == 0 else v) for i, v in rows]
    found = got(forest.nearest(frame_of(spark, rows), EVERY_100, trees=24))
    assert recall(found, brute(rows)) >= 0.9
    exact_scores(found, rows)


def test_copies_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(forest, "SOUGHT", 10**6)  # from the root: exact
    rows = cloud(300, 8, 3)
    hot = [1.0] * 8
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    odd = [
        (400, None), (500, []), (600, [0.0] * 8), (700, [1.0] * 7 + [None]), (800, [1.0] * 7 + [float("nan")]),
        (900, [1.0] * 7 + [float("inf")]), (1000, [1.0] * 5), (None, hot),
    ]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + odd + rows[:50]], SCHEMA)
    frame = frame.selectExpr("*", "label AS members", "vec_id AS query", "label AS depth", "label AS block")
    same(got(forest.nearest(frame, EVERY_100)), brute(rows))


def test_nothing_and_next_to_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert forest.nearest(empty, EVERY_100).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 0)], SCHEMA)
    assert forest.nearest(one, EVERY_100).count() == 0
    three = spark.createDataFrame([(100, [1.0], 0), (200, [2.0], 0), (3, [-2.0], 0)], SCHEMA)
    same(got(forest.nearest(three, EVERY_100)), brute([(100, [1.0]), (200, [2.0]), (3, [-2.0])]))


def test_lengths_far_apart(spark):
    rows = [(i, [float(np.float32(x * 10.0 ** (i % 9 * 6 - 24))) for x in v]) for i, v in cloud(900, 8, 8)]
    found = got(forest.nearest(frame_of(spark, rows), EVERY_100))
    assert recall(found, brute(rows)) >= 0.9


@pytest.mark.parametrize("d", [1, 2, 3, 64, 100])
def test_strings_share_what_shared_bits_says(d):
    rng = np.random.default_rng(d)
    symbols = forest.string_symbols(1000, d)
    bits = symbols * forest.symbol_width(d)
    x = rng.normal(size=(50, d))
    ((_, found),) = forest.hashed(x, symbols, 1)
    assert (found >= 0).all() and (found < 1 << bits).all()
    ((_, again),) = forest.hashed(x * 1e200, symbols, 1)
    assert (found == again).all()
    for s in found[:10]:
        for other, n in zip(found, forest.shared_bits(found, int(s), bits), strict=True):
            a, b = f"{s:0{bits}b}", f"{other:0{bits}b}"
            assert n == next((i for i in range(bits) if a[i] != b[i]), bits)


def test_cells_are_ranges_of_common_prefixes():
    rng = np.random.default_rng(1)
    held = np.sort(rng.integers(0, 1 << 12, 300))
    asked, depth = rng.integers(0, 1 << 12, 50), rng.integers(0, 13, 50)
    start, stop = forest.cells_in(held, asked, depth, 12)
    for a, d, i, j in zip(asked, depth, start, stop, strict=True):
        assert list(range(i, j)) == [p for p, h in enumerate(held) if forest.shared_bits(h, int(a), 12) >= d]


@pytest.mark.parametrize("d", [2, 16, 64])
def test_settled_depths_hold_for_other_pairs(d):
    """Of pairs at an angle, the trees together miss no more than promised, but for chance."""
    rng = np.random.default_rng(d)
    trees, symbols = 40, forest.string_symbols(1000, d)
    bits = symbols * forest.symbol_width(d)
    depths = forest.settled_depths(d, symbols, trees)
    assert depths == sorted(depths, reverse=True) and depths[0] > 8
    for step in (5, 15, 21, 27):
        angle = np.pi * step / forest.ANGLES
        x, u = rng.normal(size=(2, 400, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
        u -= (u * x).sum(axis=1)[:, None] * x
        u /= np.linalg.norm(u, axis=1)[:, None]
        both = zip(forest.hashed(x, symbols, trees), forest.hashed(np.cos(angle) * x + np.sin(angle) * u, symbols, trees))
        shared = np.stack([forest.shared_bits(a, b, bits) for (_, a), (_, b) in both])
        missed = (shared.max(axis=0) < depths[step - 1]).mean()
        assert missed <= forest.MISS + 0.05
