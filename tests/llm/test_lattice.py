import numpy as np
import pytest

from corpusqa.llm import lattice


def plain(rows, least=0.98):
    """rows: (vec_id, vector, label); results in the order of rows."""
    units = []
    for _, v, label in rows:
        fine = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(lattice.unit_rows([v])[0] if fine else None)
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(near[i]), component, vec_id is not None and vec_id == component))
    return sorted(out, key=repr)


def test_decoding_finds_the_nearest_lattice_point():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(400, 8)) * 3
    near = lattice.decode(points)
    doubled = np.rint(2 * near).astype(int)
    assert np.allclose(doubled, 2 * near) and ((doubled % 2 == doubled[:, :1] % 2).all()) and (near.sum(axis=1) % 2 == 0).all()
    best = ((points - near) ** 2).sum(axis=1)
    for v in lattice.NEIGHBOURS:
        assert (best <= ((points - near - v) ** 2).sum(axis=1) + 1e-9).all()
    assert lattice.NEIGHBOURS.shape == (240, 8) and best.max() <= 1 + 1e-9


def test_cells_do_not_depend_on_the_batch():
    units = lattice.unit_rows(np.random.default_rng(2).normal(size=(50, 64)))
    d = lattice.projection(64)
    assert (lattice.cells(units, d) == np.concatenate([lattice.cells(units[i : i + 1], d) for i in range(50)])).all()


def test_recall_at_the_threshold():
    draw = np.random.default_rng(3)
    a = lattice.unit_rows(draw.normal(size=(20_000, 64)))
    side = draw.normal(size=a.shape)
    side = lattice.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    d = lattice.projection(64)
    ca, cb = lattice.cells(a, d), lattice.cells(b, d)
    met = np.zeros(len(a), dtype=bool)
    for t in range(lattice.TABLES):
        met |= lattice._meet(ca[:, t], cb[:, t])
    assert met.mean() > 0.9995


def made(seed=5, n=500):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + draw.normal(size=16) * draw.choice([0.05, 0.12, 0.3])).astype(float).tolist(), int(i % 2)) for i in range(n)]
    copies = [(1000 + i, rows[i % 9][1], rows[i % 9][2]) for i in range(60)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [float("nan")] * 16, 1), (2005, [float("inf")] + [1.0] * 15, 1)]
    odd += [(2006, rows[0][1], None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [-1.0, -2.0], 1), (None, rows[0][1], 0), (None, [5.0] * 3, 0), (2010, [1e-30] * 16, 0), (2011, [1e30] * 16, 0)]
    return rows + copies + odd + [rows[3], rows[3]]


@pytest.mark.parametrize("block, bundle", [(2048, 8192), (7, 16)])
def test_against_all_pairs(spark, block, bundle):
    rows = made()
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, label int, node long, cell int")
    found = lattice.link_vectors(frame, block=block, bundle=bundle)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_no_rows_and_no_usable_rows(spark):
    frame = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert lattice.link_vectors(frame.limit(0)).count() == 0
    assert sorted(map(tuple, lattice.link_vectors(frame).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_single_numbers_and_pairs_in_several_lots(spark, monkeypatch):
    """Vectors of single numbers give the links of the same numbers in double precision, however many pairs are looked at together."""
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in made(seed=6, n=200) if i is None or i < 2010]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, lattice.link_vectors(frame).collect()), key=repr) == plain(rows)
    draw = np.random.default_rng(7)
    centre = draw.normal(size=16)
    few = lattice.pd.DataFrame({"table": 0, "node": np.arange(60), "copies": 1, "vector": list(centre + draw.normal(size=(60, 16)) * 0.05), "visits": False, "alone": True})
    few["cell"] = lattice.cells(lattice.unit_rows(few["vector"]), lattice.projection(16))[:, 0, 0]
    whole = lattice._links_of(few, lattice.projection(16), 0.98)
    monkeypatch.setattr(lattice, "WAITING", 5)
    lots = lattice._links_of(few, lattice.projection(16), 0.98)
    assert len(whole) and whole.equals(lots)


def test_very_long_vectors(spark):
    """20,000 components: near ones meet, others do not, and a prefix of a vector is another vector."""
    draw = np.random.default_rng(8)
    centre = draw.normal(size=20_000)
    near = [centre, centre + draw.normal(size=20_000) * 0.1, centre * 3 + draw.normal(size=20_000) * 0.1, draw.normal(size=20_000), centre[:19_999]]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(near)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, lattice.link_vectors(frame).collect()))
    assert found == plain(rows) and [r[1] for r in found] == [2, 2, 2, 0, 0]
