"""Where the engine's tests find their tables, and how they compare results."""

import math

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(data, digits=6):
    """Rows as a sorted list, doubles rounded, so that two engines' results compare."""

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else float(f"{round(v, digits) + 0.0:.9g}")
        return v.isoformat()[:10] if hasattr(v, "isoformat") else v

    return sorted((tuple(cell(v) for v in r) for r in data), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def alike(got, want):
    """Whether two results hold the same rows, but for the last digits of doubles."""
    def sortable(r):
        return [v for v in r if not isinstance(v, float)], [f"{v:.4g}" for v in r if isinstance(v, float)]

    got, want = (sorted(rows(x, 12), key=lambda r: tuple(map(str, sortable(r)))) for x in (got, want))
    close = lambda a, b: math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6) if isinstance(a, float) and isinstance(b, float) else a == b
    return len(got) == len(want) and all(len(a) == len(b) and all(map(close, a, b)) for a, b in zip(got, want, strict=True))
