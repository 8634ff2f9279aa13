"""Neighbours and what is sampled by them, against all pairs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import nearest as ne
from assaymill.operators import sampling as sp


def table(spark, points, labels=None):
    """Cells (zeros absent) and samples of points by id."""
    cells = spark.createDataFrame([(s, f"f{j}", float(x)) for s, p in points.items() for j, x in enumerate(p) if x], "sample_id string, feature_id string, value double").repartition(3)
    samples = spark.createDataFrame([(s, (labels or {}).get(s)) for s in points], "sample_id string, tag string")
    return cells, samples


def all_pairs(points, base, k, labels=None, same=False, itself=False, far=False):
    out = {}
    for s, p in points.items():
        d = sorted(((-1 if far else 1) * round(float(np.sqrt(((np.array(p, float) - np.array(q, float)) ** 2).sum())), 9), t) for t, q in base.items() if (itself or t != s) and (not same or labels[s] == labels[t]))
        out[s] = [(t, abs(x)) for x, t in d[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["sample_id"], r["rank"])):
        out.setdefault(r["sample_id"], []).append((r["other"], pytest.approx(r["distance"], abs=1e-6)))
    return out


def cloud(seed, n, name="s", whole=True):
    rng = random.Random(seed)
    centres = [[rng.uniform(0, 40) for _ in range(4)] for _ in range(6)]
    points = {}
    for i in range(n):
        c = rng.choice(centres)
        points[f"{name}{i:03d}"] = [max(0, round(x + rng.gauss(0, 3))) if whole else x + rng.gauss(0, 3) for x in c]
    points[f"{name}zero"] = [0, 0, 0, 0]
    for i in range(5):  # copies: ties go by id
        points[f"{name}copy{i}"] = points[f"{name}000"]
    return points


def test_exact_neighbours(spark):
    points = cloud(1, 120)
    labels = {s: "ab"[i % 2] for i, s in enumerate(points)}
    cells, samples = table(spark, points, labels)
    assert got(ne.nearest(cells, samples, cells, samples, 4)) == all_pairs(points, points, 4)
    assert got(ne.nearest(cells, samples, cells, samples, 3, same_tag=True)) == all_pairs(points, points, 3, labels, same=True)


def test_between_tables(spark):
    points, base = cloud(2, 40, "q", whole=False), cloud(3, 60, "b", whole=False)
    points["q000"] = [1, 2, 3, 4, 9]  # a feature that the base lacks
    base = {k: [*v, 0] for k, v in base.items()}
    points = {k: [*v, 0][:5] for k, v in points.items()}
    (a, s), (b, t) = table(spark, points), table(spark, base)
    assert got(ne.nearest(a, s, b, t, 3)) == all_pairs(points, base, 3)
    assert got(ne.nearest(a, s, b, t, 2, farthest=True)) == all_pairs(points, base, 2, far=True)


def test_exact_neighbours_over_many_blocks(spark, monkeypatch):
    """Blocks of 16: copies, ties and the farthest ones lie in several; a tag may be null."""
    monkeypatch.setattr(ne, "BLOCK_CELLS", 1)
    points = cloud(4, 60)
    labels = {s: ("a", "b", None)[i % 3] for i, s in enumerate(points)}
    cells, samples = table(spark, points, labels)
    assert got(ne.nearest(cells, samples, cells, samples, 7, itself=True)) == all_pairs(points, points, 7, itself=True)
    assert got(ne.nearest(cells, samples, cells, samples, 4, same_tag=True, farthest=True)) == all_pairs(points, points, 4, labels, same=True, far=True)
    every = {s: dict(x) for s, x in all_pairs(points, points, len(points)).items()}
    near = ne.nearest(cells, samples, cells, samples, 0, radius=5.0).collect()
    assert sorted((r["sample_id"], r["other"]) for r in near) == sorted((s, t) for s, x in every.items() for t, d in x.items() if d <= 5.0)
    assert all(r["rank"] is None for r in near)


def test_first_places_with_ties():
    square = np.array([4.0, 1.0, 4.0, 4.0, 9.0, 1.0])
    assert sorted(ne._first(square, 3, False)) == [0, 1, 2, 3, 5] and sorted(ne._first(square, 1, False)) == [1]
    assert sorted(ne._first(square, 1, True)) == [4] and list(ne._first(square[:0], 2, False)) == []


@pytest.mark.parametrize("cells_of_a_block", [2_000_000, 64])
def test_probing_all_cells_is_exact(spark, monkeypatch, cells_of_a_block):
    monkeypatch.setattr(ne, "BLOCK_CELLS", cells_of_a_block)
    points = cloud(5, 70)
    cells, samples = table(spark, points)
    space = ne.space_of(cells, samples)
    assert got(ne.probed(cells, samples, cells, samples, 3, len(space.pivots), space)) == all_pairs(points, points, 3)


def test_of_nothing(spark):
    cells, samples = table(spark, {"a": [1]})
    assert ne.nearest(cells, samples, cells.limit(0), samples.limit(0), 2).collect() == []
    assert ne.nearest(cells.limit(0), samples.limit(0), cells, samples, 2).collect() == []
    assert ne.nearest(cells, samples, cells, samples, 2).collect() == []
    assert [r["other"] for r in ne.nearest(cells, samples, cells, samples, 2, itself=True).collect()] == ["a"]


def test_recall_of_candidates_on_the_registered_input(spark):
    from assaymill.operators.normalise import into_ranks
    from assaymill.plans.fixtures import Fixtures
    from assaymill.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    fx = Fixtures(spark, sf)
    ranks = into_ranks(fx.dense)
    true = {tuple(sorted((r["sample_id"], r["other"]))) for r in sp.neighbours(ranks, fx.obs, "label", 5).collect()}
    found = {(r["sample_id"], r["other"]) for r in QUERIES["near_candidates"](spark, sf).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_quotas_are_exact(spark):
    rows = [(i, "ab"[i % 2], float(i % 5), 17 if i % 2 else 4) for i in range(30)] + [(100, "c", 0.0, 5), (101, None, 1.0, 3)]
    out = sp.quotas(spark.createDataFrame(rows, "id long, g string, w double, total long"), "id", "g", "w", "total").collect()
    sums = {}
    for r in out:
        sums[r["g"]] = sums.get(r["g"], 0) + r["quota"]
        share = r["w"] * r["total"] / max(sum(w for _, g, w, _ in rows if g == r["g"]), 1e-9)
        assert abs(r["quota"] - share) < 1
    assert sums == {"a": 4, "b": 17, "c": 0, None: 3}


def balanced(points, labels, k):
    """Points after SMOTE up to the largest class, by definition."""
    size = {c: sum(v == c for v in labels.values()) for c in labels.values()}
    within = all_pairs(points, points, k, labels, same=True)
    out, tags = dict(points), dict(labels)
    for c in size:
        own, total = sorted(s for s in labels if labels[s] == c), max(size.values()) - size[c]
        for i, s in enumerate(own):
            for copy in range(1, 1 + total // len(own) + (i < total % len(own))):
                h = hashlib.md5(f"0|{s}|{copy}".encode()).hexdigest()
                other = within[s][int(int(h[:8], 16) / 2**32 * len(within[s]))][0]
                w = int(h[8:16], 16) / 2**32
                out[f"{s}+{copy}"] = [x + w * (y - x) for x, y in zip(points[s], points[other])]
                tags[f"{s}+{copy}"] = c
    return out, tags


def test_smote_then_cleaning(spark):
    points = {k: v for k, v in cloud(6, 40, whole=False).items() if "copy" not in k}
    labels = {s: "a" if i % 4 else "b" for i, s in enumerate(points)}
    cells, samples = table(spark, points, labels)
    obs = samples.withColumnRenamed("tag", "label")
    every, tags = balanced(points, labels, 3)
    near = all_pairs(every, every, 3)
    kept = {s for s in every if 2 * sum(tags[t] != tags[s] for t, _ in near[s]) <= len(near[s])}
    assert {(r["sample_id"], r["label"]) for r in sp.smote_enn(cells, obs, "label", 3).collect()} == {(s, tags[s]) for s in kept}
    one = {s: x[0][0] for s, x in all_pairs(every, every, 1).items()}
    linked = {s for s, t in one.items() if one[t] == s and tags[s] != tags[t]}
    assert {r["sample_id"] for r in sp.smote_tomek(cells, obs, "label", 3).collect()} == set(every) - linked


def test_copies_are_compared_once(spark):
    """Forty copies of each point: lists hold the copies by id, and few classes meet."""
    points = {f"{s}x{i:02d}": p for s, p in cloud(7, 12).items() for i in range(40)}
    labels = {s: "ab"[hash_of(s) % 2] for s in points}
    cells, samples = table(spark, points, labels)
    assert got(ne.nearest(cells, samples, cells, samples, 3)) == all_pairs(points, points, 3)
    assert ne.sized_classes(cells, samples)[0].count() <= 2 * 13


def hash_of(text):
    return int(hashlib.md5(text.encode()).hexdigest(), 16)


@pytest.fixture(scope="module")
def crowd(spark):
    points = cloud(8, 60, whole=False)
    labels = {s: "abc"[i % 3] for i, s in enumerate(points)}
    cells, samples = table(spark, points, labels)
    far = {(s, t): float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())) for s, p in points.items() for t, q in points.items()}
    return points, labels, cells, samples.withColumnRenamed("tag", "label"), far


def test_distances_of_classes_over_many_blocks(monkeypatch, crowd):
    from assaymill.operators import evaluation as ev
    from assaymill.operators import models as mo

    monkeypatch.setattr(ne, "BLOCK_CELLS", 1)
    points, labels, cells, obs, far = crowd
    mean = lambda s, c: np.mean([far[s, t] for t in points if t != s and labels[t] == c])
    got = {(r["x"], r["y"]): r["distance"] for r in mo.label_distance(cells, obs).collect()}
    for (x, y), d in got.items():
        assert d == pytest.approx(np.mean([far[s, t] for s in points for t in points if s != t and labels[s] == x and labels[t] == y]))
    assert sorted(got) == [(x, y) for x in "abc" for y in "abc" if x <= y]
    best = {c: min((round(mean(s, c), 9), s) for s in points if labels[s] == c)[1] for c in "abc"}
    assert {r["label"]: r["sample_id"] for r in mo.class_medoids(cells, obs).collect()} == best
    width = []
    for s in points:
        a, b = mean(s, labels[s]), min(mean(s, c) for c in "abc" if c != labels[s])
        width.append((b - a) / max(a, b))
    assert ev.silhouette(cells, obs).first()[0] == pytest.approx(np.mean(width))


def test_distances_of_all_samples_to_all_others(monkeypatch, crowd):
    """Both ways, and those of copies."""
    from assaymill.operators import evaluation as ev

    monkeypatch.setattr(ne, "BLOCK_CELLS", 1)
    points, _, cells, _, far = crowd
    held = [s for s, p in points.items() if any(p)]  # samples are those of the cells
    rows = ev.distances(cells).collect()
    assert len(rows) == len(held) * (len(held) - 1)
    assert {(r["sample_id"], r["other"]): pytest.approx(r["distance"]) for r in rows} == {(s, t): far[s, t] for s in held for t in held if s != t}


def test_prototypes_cover(monkeypatch, crowd):
    from assaymill.operators import models as mo

    monkeypatch.setattr(ne, "BLOCK_CELLS", 1)
    points, labels, cells, obs, far = crowd
    want = []
    for c in "abc":
        left = {s for s in points if labels[s] == c}
        for i in (1, 2, 3):
            gain = {s: sum(far[s, t] <= 9 for t in left) - sum(far[s, t] <= 9 and labels[t] != c for t in points) for s in points if labels[s] == c}
            top = min(gain, key=lambda s: (-gain[s], s))
            if gain[top] > 0:
                want.append((c, top, i, gain[top]))
                left -= {t for t in left if far[top, t] <= 9}
    assert sorted(tuple(r) for r in mo.prototypes(cells, obs, "label", 9.0).collect()) == sorted(want)


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_two_blocks_answer_for_both(farthest, shift):
    """From the same products, the first of each row of either block: with ties, an outlier, and far from 0."""
    rng = np.random.default_rng(9)
    x, y = (np.round(rng.normal(0, 3, (n, 5))) + shift for n in (300, 900))
    y[7] += 1e5
    ahead, back = ne._near(x, y, np.arange(300), np.arange(900), 3, farthest, True)
    for (i, j, square), a, b in ((ahead, x, y), (back, y, x)):
        far = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), 9) * (-1 if farthest else 1)
        lists = {r: [] for r in range(len(a))}
        for r, c, s in zip(i.tolist(), j.tolist(), square.tolist()):
            lists[r].append((float(np.round(np.sqrt(s), 9)) * (-1 if farthest else 1), c))
        assert all(sorted(v)[:3] == sorted(zip(far[r].tolist(), range(len(b))))[:3] for r, v in lists.items())
        assert len(i) < 20 * len(a)


def test_lower_bounds_are_lower_and_close():
    rng = np.random.default_rng(10)
    x, y = rng.normal(50, 30, (200, 25)), rng.normal(50, 30, (400, 25))
    far = ((x[:, None] - y[None]) ** 2).sum(2)
    for sign in (1, -1):
        low = ne._Lower(x, y, sign)
        bound = (low.left.astype("f8") @ low.right.T.astype("f8")) * low.unit
        assert (bound <= sign * far).all() and (sign * far - bound < 1e-4 * far.max()).all()


def test_packed_rows_hold_all():
    """Numbers, sizes, tags and cells come back; what single precision holds is short."""
    import pandas as pd

    pdf = pd.DataFrame({"_part": [0, 0, 0], "tag": ["a", None, "a"], "_n": [3, 1, 2], "size": [1, 5, 2], "at": [[0, 2], [], [1]], "x": [[1.5, 7.0], [], [0.1]]})
    out = next(ne._pack(3)(iter([pdf])))
    n, size, tags, x = ne._unpack(out, 3)
    assert list(n) == [3, 2, 1] and list(size) == [1, 2, 5] and list(tags) == ["a", "a", None]
    assert x.tolist() == [[1.5, 0, 7], [0, 0.1, 0], [0, 0, 0]]
    assert len(next(ne._pack(3)(iter([pdf[:2]])))["x"][0]) == 8


def test_each_pair_of_parts_meets_once(spark, monkeypatch):
    """A table with itself: two parts meet in one task, which answers for both."""
    import pandas as pd

    monkeypatch.setattr(ne, "BLOCK_CELLS", 1)
    points = cloud(11, 100, whole=False)
    classes, width = ne.sized_classes(*table(spark, points))
    met = ne._compared(classes, classes, width, lambda a, b, both: pd.DataFrame({"n": a[0][:1], "m": b[0][:1], "both": [both]}), "n long, m long, both boolean").collect()
    parts = len({r["n"] for r in met})
    assert len(met) == parts * (parts + 1) // 2 and sum(r["both"] for r in met) == parts * (parts - 1) // 2


def test_probing_writes_no_row_per_query_and_cell(spark, monkeypatch):
    points = cloud(12, 60)
    cells, samples = table(spark, points)
    space, wrote = ne.space_of(cells, samples), []
    true = ne.materialize
    monkeypatch.setattr(ne, "materialize", lambda df, name: (wrote.append(name), true(df, name))[1])
    every = ne.probed(cells, samples, cells, samples, 3, 2, space)
    assert every.count() <= 3 * len(points) and "visits" not in wrote


def test_nearest_of_each_tag(spark):
    """A query is one row, not one for every tag; copies and a null tag count."""
    points, base = cloud(13, 20, "q"), cloud(14, 60, "b")
    tags = {t: ("a", "b", None)[i % 3] for i, t in enumerate(base)}
    (a, s), (b, t) = table(spark, points), table(spark, base, tags)
    want = {u for c in ("a", "b", None) for near in all_pairs(points, {v: p for v, p in base.items() if tags[v] == c}, 3).values() for u, _ in near}
    assert sorted(r["other"] for r in ne.nearest_of_each_tag(a, s, b, t, 3).collect()) == sorted(want)
