"""Operators by name, so that features and steps can be chosen as strings."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operators() -> dict[str, Callable]:
    """All public functions of the operator modules, as module.name."""
    from ..operators import features, genetic, geometry, graph, kernels, knn, labels, neighborhood, pixel, segment, stats, tables, threshold, workflow

    out = {}
    for m in (features, genetic, geometry, graph, kernels, knn, labels, neighborhood, pixel, segment, stats, tables, threshold, workflow):
        out |= {f"{m.__name__.rsplit('.', 1)[1]}.{n}": f for n, f in functions_of(m).items()}
    return out


def functions_of(module: ModuleType) -> dict[str, Callable]:
    return {n: f for n, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not n.startswith("_")}


#: Features that give one row an image, with the columns they add, by name.
FEATURES = ("page_features", "moments", "nholes", "top_bottom", "compactness", "zernike_moments")


def generate_features(px: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row an image with the columns of all named features, in the order of their names."""
    from ..operators import features

    parts = [getattr(features, n)(px) for n in sorted(names)]
    return reduce(lambda a, b: a.join(b, "image_id", "left"), parts)


def feature_columns() -> dict[str, tuple[int, Callable]]:
    """Features by name: length and a function that gives (image_id, f: array<double>) of px."""
    from ..operators import features as Q

    def flat(run: Callable, *names: str) -> Callable:
        return lambda px: run(px).select("image_id", F.array(*[F.col(n).cast("double") for n in names]).alias("f"))

    def regions(k: int) -> Callable:
        def run(px: DataFrame) -> DataFrame:
            cells = Q.region_volumes(px, k).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("region", "volume"))).alias("m"))
            return cells.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("f"))

        return run

    page = {n: (1, flat(Q.page_features, n)) for n in ("area", "aspect_ratio", "black_area", "ncols", "nrows", "volume")}
    return page | {
        "compactness": (1, flat(Q.compactness, "compactness")),
        "moments": (9, flat(Q.moments, "cx", "cy", "mu20", "mu02", "mu11", "mu30", "mu12", "mu21", "mu03")),
        "nholes": (2, flat(Q.nholes, "vertical", "horizontal")),
        "top_bottom": (2, flat(Q.top_bottom, "top", "bottom")),
        "volume16regions": (16, regions(4)),
        "volume64regions": (64, regions(8)),
    }


def get_feature_functions(names: tuple[str, ...] | None = None) -> tuple[list[tuple[str, Callable]], int]:
    """The named features (all without names) sorted by name with their functions, and the length of their vector."""
    known = feature_columns()
    unknown = sorted(set(names or ()) - set(known))
    if unknown:
        raise ValueError(f"no such features: {', '.join(unknown)}")
    own = sorted(names or known)
    return [(n, known[n][1]) for n in own], sum(known[n][0] for n in own)


def feature_vectors(px: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(image_id, features): the flat vector of the named features in the order of their names, as nearest neighbours take it."""
    found, _ = get_feature_functions(names)
    parts = [run(px).withColumnRenamed("f", f"f{i}") for i, (_, run) in enumerate(found)]
    joined = reduce(lambda a, b: a.join(b, "image_id"), parts)
    return joined.select("image_id", F.concat(*[F.col(f"f{i}") for i in range(len(found))]).alias("features"))


def process(px: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Runs named operators one after the other."""
    known = operators()
    return reduce(lambda df, s: df.transform(lambda d: known[s[0]](d, **s[1])), steps, px)
