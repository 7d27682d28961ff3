"""The octree queries against a brute force round all sensors."""

from lodestone.plans import all_queries as registry
from lodestone.sources import adapters

SF = "/root/testdata/sf0.01"


def leaves(sensors):
    """{(x0, x1, y0, y1, z0, z1)} after three rounds from one cell of 512."""
    cells = {(0.0, 512.0) * 3}
    for _ in range(3):
        out = set()
        for c in cells:
            mid, size = [(c[k] + c[k + 1]) / 2 for k in (0, 2, 4)], c[1] - c[0]
            if any(sum((m - p) ** 2 for m, p in zip(mid, s, strict=True)) <= (0.75 * size) ** 2 for s in sensors):
                x, y, z = (((c[2 * k], m), (m, c[2 * k + 1])) for k, m in enumerate(mid))
                out |= {(*a, *b, *d) for a in x for b in y for d in z}
            else:
                out.add(c)
        cells = out
    return cells


def faces(cells):
    """How many pairs of cells share part of a face."""
    apart = lambda p, q, k: p[2 * k] >= q[2 * k + 1] or q[2 * k] >= p[2 * k + 1]
    return sum(p[2 * k + 1] == q[2 * k] and not any(apart(p, q, o) for o in range(3) if o != k) for p in cells for q in cells for k in range(3))


def test_octree_refines_round_every_sensor(spark):
    want = leaves({(r.x_m, r.y_m, r.z_m) for r in adapters.sensors(spark, SF).collect()})
    got = [(r.x0, r.x1, r.y0, r.y1, r.z0, r.z1) for r in registry.QUERIES["octree_split"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert registry.QUERIES["octree_edges"](spark, SF).count() == faces(want)
