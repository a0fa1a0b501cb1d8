"""The index against the exact search, on vectors in clusters and spread evenly, with very full cells and odd rows."""

import numpy as np
import pytest

from perigee.operators import similarity, similarity_index as si
from perigee.session import materialize

SCHEMA = "id long, type string, embedding array<double>"


def _vectors(kind, n=1500, width=16, seed=5):
    draw = np.random.default_rng(seed)
    if kind == "clusters":
        centres = draw.standard_normal((40, width)) * 4
        return centres[draw.integers(0, 40, n)] + draw.standard_normal((n, width)) * 0.3
    return draw.standard_normal((n, width))


@pytest.mark.parametrize("kind, most_share", [("clusters", 0.35), ("even", 1.0)])
@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_recall_against_the_exact_search(table, kind, most_share, metric):
    rows = table(SCHEMA, [(i, "incident", [float(x) for x in v]) for i, v in enumerate(_vectors(kind))])
    index = si.build_index(rows, metric=metric)
    found = si.search_index(index, rows)
    exact = similarity.similar_incidents(rows, rows, metric=metric)
    assert si.measured_recall(found, exact) >= 0.9
    assert index.sample_recall >= si.RECALL and index.share <= most_share
    got = sorted(map(tuple, found.collect()))
    assert [r[:2] for r in got] == [(i, rank) for i in range(1500) for rank in (1, 2)]
    same = {(a, c): d for a, _, c, d in map(tuple, exact.collect())}
    assert all(same.get((a, c), d) == d for a, _, c, d in got)
    assert sorted(map(tuple, si.search_index(si.build_index(rows, metric=metric), rows).collect())) == got


def test_less_work_as_documents_grow(table):
    shares = []
    for n in (500, 4000):
        vectors = _vectors("clusters", n)
        shares.append(si.build_index(table(SCHEMA, [(i, "incident", [float(x) for x in v]) for i, v in enumerate(vectors)])).share)
    assert shares[1] < shares[0]


def test_full_cells_are_cut_into_blocks(table):
    copies = [(i, "incident", [1.0, 2.0, 3.0]) for i in range(400)]
    others = [(400 + i, "incident", [float(x) for x in v]) for i, v in enumerate(_vectors("even", 800, 3))]
    rows = table(SCHEMA, copies + others)
    index = si.build_index(rows, cell_rows=16)
    small, large = (sorted(map(tuple, si.search_index(index, rows, block_values=v).collect())) for v in (60, 1_000_000))
    assert small == large
    assert [r[1:] for r in small if r[0] == 7] == [(1, 0, 0.0), (2, 1, 0.0)]


def test_odd_rows_and_small_tables(table):
    docs = table(SCHEMA, [(1, "incident", [0.0, 1.0]), (2, "incident", [5.0, 5.0]), (3, "incident", [1.0]), (4, "incident", None), (5, "note", [0.0, 0.0]),
                          (6, "incident", [float("nan"), 0.0])])
    asked = table(SCHEMA, [(10, None, [0.0, 0.0]), (11, None, None), (12, None, [1.0, 2.0, 3.0])])
    index = si.build_index(docs)
    assert (index.planes, index.count, index.share) == (0, 2, 1.0)
    assert sorted(map(tuple, si.search_index(index, asked).collect())) == [(10, 1, 1, 1.0), (10, 2, 2, 50.0)]
    none = si.build_index(docs.where("id < 0"))
    assert si.search_index(none, asked).count() == 0
    with pytest.raises(ValueError):
        si.build_index(docs, metric="nope")


def test_query_with_too_few_documents_in_its_cells_is_searched_exactly(table):
    rows = table(SCHEMA, [(i, "incident", [float(x) for x in v]) for i, v in enumerate(_vectors("clusters", 600))])
    index = si.build_index(rows, cell_rows=8)
    wide = 300
    found = si.search_index(index, rows.where("id < 5"), k=wide)
    exact = similarity.similar_incidents(rows.where("id < 5"), rows, k=wide)
    assert found.count() == 5 * wide
    assert si.measured_recall(found, exact) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_passed_cells_give_what_copied_visits_give(table, kind, monkeypatch):
    rows = table(SCHEMA, [(i, "incident", [float(x) for x in v]) for i, v in enumerate(_vectors(kind, 900, 6))])
    index = si.build_index(rows, cell_rows=16)
    assert index.planes
    both = []
    for copies in (0, 1 << 30):
        monkeypatch.setattr(si, "MOST_COPIES", copies)
        both.append([sorted(map(tuple, si.search_index(index, rows, block_values=v).collect())) for v in (120, 1_000_000)])
    assert both[0] == both[1] and both[0][0] == both[0][1]


def test_many_visits_are_not_written(table, monkeypatch):
    rows = table(SCHEMA, [(i, "incident", [float(x) for x in v]) for i, v in enumerate(_vectors("even", 900))])
    index = si.build_index(rows, cell_rows=16)
    monkeypatch.setattr(si, "MOST_COPIES", len(index.directions) * index.visits - 1)
    written = []
    monkeypatch.setattr(si, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    assert si.search_index(index, rows).count() == 1800
    assert "index-visits" not in written
