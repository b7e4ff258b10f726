"""Genetic selection or weighting of features; a generation's candidates are scored in one Spark job."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import nearest_rows
from .knn import majority


def fitness(train: DataFrame, population: np.ndarray, k: int = 1) -> np.ndarray:
    """Leave-one-out accuracy of each candidate's weights (city block), all in one job."""
    near = nearest_rows(train.select("id", "features"), train, k, "city_block", True, [[float(x) for x in w] for w in population])
    found = majority(near, "candidate").join(train.select(F.col("id").cast("long").alias("q"), F.col("class").alias("truth")), "q")
    got = {r["candidate"]: r["f"] for r in found.groupBy("candidate").agg(F.avg((F.col("class") == F.col("truth")).cast("double")).alias("f")).collect()}
    return np.array([got.get(i, 0.0) for i in range(len(population))])


# --- selection of parents --------------------------------------------------------------------------


def roulette(f: np.ndarray, n: int, rng: np.random.Generator, scaled: bool = False) -> np.ndarray:
    w = f - (f.min() if scaled else 0) + 1e-9
    return rng.choice(len(f), n, p=w / w.sum())


def stochastic_universal(f: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    c = np.cumsum(f + 1e-9)
    return np.searchsorted(c, (np.arange(n) + rng.random()) * c[-1] / n).clip(0, len(f) - 1)


def ranked(f: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    r = np.argsort(np.argsort(f)) + 1.0
    return rng.choice(len(f), n, p=r / r.sum())


def tournament(f: np.ndarray, n: int, rng: np.random.Generator, size: int = 3) -> np.ndarray:
    groups = rng.integers(0, len(f), (n, size))
    return groups[np.arange(n), f[groups].argmax(axis=1)]


def at_random(f: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    return rng.integers(0, len(f), n)


SELECTION = {"roulette": roulette, "scaled": lambda f, n, g: roulette(f, n, g, True), "universal": stochastic_universal, "rank": ranked, "tournament": tournament, "random": at_random}

# --- recombination ---------------------------------------------------------------------------------


def n_point(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, n: int = 2) -> np.ndarray:
    cuts = np.sort(rng.choice(np.arange(1, len(a)), min(n, len(a) - 1), replace=False)) if len(a) > 1 else []
    return np.where(np.searchsorted(cuts, np.arange(len(a)), side="right") % 2 == 0, a, b)


def uniform(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.where(rng.random(len(a)) < 0.5, a, b)


def simulated_binary(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, eta: float = 2.0) -> np.ndarray:
    u = rng.random(len(a))
    beta = np.where(u <= 0.5, (2 * u) ** (1 / (eta + 1)), (1 / (2 * (1 - u))) ** (1 / (eta + 1)))
    return np.clip(0.5 * ((1 + beta) * a + (1 - beta) * b), 0, 1)


def on_segment(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return a + rng.random() * (b - a)


def in_hypercube(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return a + rng.random(len(a)) * (b - a)


CROSSOVER = {"n_point": n_point, "uniform": uniform, "sbx": simulated_binary, "segment": on_segment, "hypercube": in_hypercube}

# --- mutation --------------------------------------------------------------------------------------


def shift(a: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
    return np.roll(a, 1) if rng.random() < rate else a


def swap(a: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
    a = a.copy()
    if rng.random() < rate:
        i, j = rng.integers(0, len(a), 2)
        a[[i, j]] = a[[j, i]]
    return a


def inversion(a: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
    a = a.copy()
    if rng.random() < rate:
        i, j = np.sort(rng.integers(0, len(a) + 1, 2))
        a[i:j] = a[i:j][::-1]
    return a


def binary(a: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
    return np.where(rng.random(len(a)) < rate, 1 - np.rint(a), a)


def gauss(a: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
    return np.clip(np.where(rng.random(len(a)) < rate, a + rng.normal(0, 0.2, len(a)), a), 0, 1)


MUTATION = {"shift": shift, "swap": swap, "inversion": inversion, "binary": binary, "gauss": gauss}


@dataclass
class Settings:
    mode: str = "select"  # or "weight"
    population: int = 20
    selection: str = "tournament"
    crossover: str = "uniform"
    crossover_rate: float = 0.9
    mutation: str = "binary"
    mutation_rate: float = 0.05
    replacement: str = "generational"  # or "worst", "tournament"
    best_fitness: float = 1.0
    max_generations: int = 20
    max_evaluations: int = 10_000
    steady: int = 8  # generations without improvement
    seed: int = 1
    k: int = 1


@dataclass
class Optimization:
    """The loop; ``monitor`` gets (generation, best, mean) and may return False to stop."""

    train: DataFrame
    settings: Settings = field(default_factory=Settings)
    best: np.ndarray | None = None
    best_fitness: float = -1.0
    evaluations: int = 0

    def run(self, monitor=None) -> np.ndarray:
        s = self.settings
        rng = np.random.default_rng(s.seed)
        n = len(self.train.select("features").first()["features"])
        p = rng.integers(0, 2, (s.population, n)).astype(float) if s.mode == "select" else rng.random((s.population, n))
        p[0] = 1
        f = self.score(p)
        idle = 0
        for generation in range(s.max_generations):
            if monitor and monitor(generation, self.best_fitness, float(f.mean())) is False:
                break
            if self.best_fitness >= s.best_fitness or self.evaluations >= s.max_evaluations or idle >= s.steady:
                break
            before = self.best_fitness
            m = s.population if s.replacement == "generational" else max(2, s.population // 4)
            mothers, fathers = (SELECTION[s.selection](f, m, rng) for _ in range(2))
            children = []
            for i, j in zip(mothers, fathers, strict=True):
                c = CROSSOVER[s.crossover](p[i], p[j], rng) if rng.random() < s.crossover_rate else p[i].copy()
                c = MUTATION[s.mutation](c, rng, s.mutation_rate)
                children.append(np.rint(c) if s.mode == "select" else c)
            children = np.array(children)
            g = self.score(children)
            if s.replacement == "generational":
                worst = g.argmin()
                children[worst], g[worst] = p[f.argmax()], f.max()
                p, f = children, g
            else:
                out = np.argsort(f)[:m] if s.replacement == "worst" else tournament(-f, m, rng)
                p[out], f[out] = children, g
            idle = idle + 1 if self.best_fitness <= before else 0
        return self.best

    def score(self, p: np.ndarray) -> np.ndarray:
        f = fitness(self.train, p, self.settings.k)
        self.evaluations += len(p)
        if f.max() > self.best_fitness:
            self.best, self.best_fitness = p[f.argmax()].copy(), float(f.max())
        return f
