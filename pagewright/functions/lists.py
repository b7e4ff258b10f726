"""Functions on strings, arrays and small lists."""

from __future__ import annotations

import base64
import itertools
import math
import re
import sys
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permute_list(values: list) -> bool:
    """Turns the list into its next permutation in place; False (and sorted) after the last."""
    i = len(values) - 2
    while i >= 0 and values[i] >= values[i + 1]:
        i -= 1
    if i < 0:
        values.reverse()
        return False
    j = len(values) - 1
    while values[j] <= values[i]:
        j -= 1
    values[i], values[j] = values[j], values[i]
    values[i + 1 :] = reversed(values[i + 1 :])
    return True


def all_subsets(column: str, size: int) -> Column:
    """Array of all subsets of ``size`` of an array, in the order of their indexes; [[]] for 0."""
    out = F.array(F.array(F.lit(-1)))
    for _ in range(size):
        step = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0))), lambda i: i > F.element_at(s, -1)), lambda i: F.concat(s, F.array(i)))
        out = F.flatten(F.transform(out, step))
    return F.transform(out, lambda s: F.transform(F.slice(s, 2, F.lit(max(1, size))), lambda i: F.get(F.col(column), i)))


def median(column: str, inlist: bool = False) -> Column:
    """Median of an array: the mean of both middles when their number is even, or the upper one if ``inlist``."""
    s, n = F.array_sort(column), F.size(column)
    upper = F.get(s, F.floor(n / 2).cast("int"))
    if inlist:
        return upper
    return F.when(n % 2 == 1, upper.cast("double")).otherwise((upper + F.get(s, (F.floor(n / 2) - 1).cast("int"))) / 2)


def argmax(column: str) -> Column:
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def argmin(column: str) -> Column:
    return (F.array_position(column, F.array_min(column)) - 1).cast("int")


def kernel_density(values: DataFrame, x: str, at: list[float], bandwidth: float = 0.0, kernel: str = "gaussian") -> DataFrame:
    """(at, density). Bandwidth 0 is Silverman's 0.9 min(sd, iqr / 1.34) n^-0.2, and 1 where that is 0."""
    s = values.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.array_sort(F.array(F.expr(f"percentile({x}, 0.25)"), F.expr(f"percentile({x}, 0.75)"))).alias("q")).first()
    if not bandwidth:
        bandwidth = 0.9 * min(s["sd"] or 0.0, (s["q"][1] - s["q"][0]) / 1.34) * s["n"] ** -0.2 or 1.0
    u = (F.col("at") - F.col(x)) / bandwidth
    k = {
        "rectangular": F.when(F.abs(u) < 1, 0.5).otherwise(0.0),
        "triangular": F.when(F.abs(u) < 1, 1 - F.abs(u)).otherwise(0.0),
        "gaussian": F.exp(-u * u / 2) / math.sqrt(2 * math.pi),
    }[kernel]
    grid = values.select(x, F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("at"))
    return grid.groupBy("at").agg((F.sum(k) / (s["n"] * bandwidth)).alias("density"))


def range_of_float() -> tuple[float, float]:
    return -sys.float_info.max, sys.float_info.max


# --- names -----------------------------------------------------------------------------------------


def build_id_regex(pattern: str) -> str:
    """The wildcard language of dotted names as a regular expression: * any but dots, ? one, | or, ( ) groups."""
    out = []
    for ch in pattern:
        out.append({"*": "[^.]*", "?": "[^.]", ".": r"\."}.get(ch, ch))
    return "^(?:" + "".join(out) + ")"


def match_id_name(column: str, pattern: str) -> Column:
    return F.col(column).rlike(build_id_regex(pattern))


def string2identifier(column: str) -> Column:
    """Lower-cased, with everything but letters, digits and _ turned to _, and _ put before a leading digit."""
    s = F.regexp_replace(F.lower(column), "[^a-z0-9_]", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def replace_prefix(column: str, old: str, new: str) -> Column:
    return F.when(F.col(column).startswith(old), F.concat(F.lit(new), F.substring(column, len(old) + 1, 1 << 30))).otherwise(F.col(column))


def rangeeq(a: Column, b: Column, reach: float, modulus: float | None = None) -> Column:
    """Whether a and b differ by at most the reach, around a circle if a modulus is given."""
    d = F.abs(a - b)
    if modulus is None:
        return d <= reach
    d = F.pmod(d, F.lit(modulus))
    return F.least(d, modulus - d) <= reach


def fudge(column: str, value: float, amount: float = 3) -> Column:
    return F.col(column).between(value - amount, value + amount)


def sign(column: str) -> Column:
    return F.signum(column)


def byte_size(column: str) -> Column:
    c = F.col(column)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" bytes"))).when(c < 1024**2, F.concat(F.format_number(c / 1024, 1), F.lit(" kb"))).when(c < 1024**3, F.concat(F.format_number(c / 1024**2, 1), F.lit(" Mb"))).otherwise(F.concat(F.format_number(c / 1024**3, 1), F.lit(" Gb")))


def encode_binary(data: bytes) -> str:
    return base64.b64encode(zlib.compress(data)).decode()


def decode_binary(text: str) -> bytes:
    return zlib.decompress(base64.b64decode(text))


def group_list(column: str, n: int) -> Column:
    """An array in chunks of n."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(column) / n) - 1, F.lit(0)))
    return F.filter(F.transform(at, lambda i: F.slice(column, (i * n + 1).cast("int"), F.lit(n))), lambda s: F.size(s) > 0)


def sublists(values: list) -> list[list[list]]:
    """All cuts of every rotation of the list into consecutive parts that keep the first two together."""
    out = []
    for r in range(len(values)):
        v = values[r:] + values[:r]
        for cuts in itertools.product((0, 1), repeat=max(0, len(v) - 2)):
            parts = [v[:2]]
            for x, c in zip(v[2:], cuts, strict=True):
                parts.append([x]) if c else parts[-1].append(x)
            out.append(parts)
    return out


def combinations(columns: list[str], df: DataFrame) -> DataFrame:
    """Cartesian product of a row's arrays, a row each."""
    for c in columns:
        df = df.withColumn(c, F.explode(c))
    return df


def word_wrap(text: str, width: int = 72, indent: int = 0) -> str:
    import textwrap

    return textwrap.fill(re.sub(r"\s+", " ", text), width, initial_indent=" " * indent, subsequent_indent=" " * indent)


class SymbolTable:
    """Dotted names with completion."""

    def __init__(self, names: list[str] = ()):
        self.names = set(names)

    def add(self, name: str) -> None:
        self.names.add(name.strip())

    def remove(self, name: str) -> None:
        self.names.discard(name)

    def complete(self, prefix: str) -> list[str]:
        return sorted(n for n in self.names if n.startswith(prefix))

    def categories(self) -> list[str]:
        return sorted({".".join(n.split(".")[: k + 1]) for n in self.names for k in range(n.count(".") + 1)})
