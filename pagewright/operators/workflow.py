"""Classifying, grouping, clustering, rules and text output of glyphs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lists import build_id_regex
from . import knn, segment
from .blocks import spanning_trees
from .graph import SMALL, connected_components, optimize_partitions

Keep = Callable[[DataFrame, str], DataFrame]


def guess_glyphs(glyphs: DataFrame, train: DataFrame, k: int = 1, kind: str = "city_block") -> DataFrame:
    """(id, name, confidence) for each glyph; unknown with confidence 0 without training data."""
    near = knn.nearest(glyphs, train, k, kind)
    win = knn.majority(near)
    conf = knn.confidences(near, win, k).select("q", F.col("class").alias("name"), F.col("default").alias("confidence"))
    return glyphs.select("id").join(conf.withColumnRenamed("q", "id"), "id", "left").select("id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def classify_list_automatic(glyphs: DataFrame, train: DataFrame, k: int = 1) -> DataFrame:
    """glyphs with state and ids set, but for those classified by hand."""
    g = guess_glyphs(glyphs.where("state <> 'MANUAL'").select("id", "features"), train, k)
    out = glyphs.join(g, "id", "left")
    new = F.array(F.struct("confidence", "name"))
    return out.withColumns({"state": F.when(F.col("name").isNotNull(), "AUTOMATIC").otherwise(F.col("state")), "ids": F.when(F.col("name").isNotNull(), new).otherwise(F.col("ids"))}).drop("name", "confidence")


def classify_and_update_list_automatic(glyphs: DataFrame, train: DataFrame, k: int = 1, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The classified glyphs, with those of a class _split.* replaced by their parts.

    ``split`` gives the parts of such glyphs (the same columns, ids of their own); the parts are classified once.
    """
    done = classify_list_automatic(glyphs, train, k)
    if split is None:
        return done
    cut = F.coalesce(F.col("ids")[0]["name"].startswith("_split."), F.lit(False))
    return done.where(~cut).unionByName(classify_list_automatic(split(done.where(cut)), train, k))


def group_and_update_list_automatic(glyphs: DataFrame, covers: DataFrame, ids_from: int) -> DataFrame:
    """glyphs and one more for each group of several, whose box is their union; its parts are classed _group._part.<name>.

    covers(root, members) as ``group_list_automatic`` gives them, glyphs(id, name, box); new ids are ids_from plus the smallest member.
    """
    members = covers.where(F.size("members") > 1).select(F.array_min("members").alias("first"), F.explode("members").alias("id"))
    parts = glyphs.join(members, "id")
    box = [(F.min(c) if c.startswith("ul") else F.max(c)).alias(c) for c in segment.BOX]
    whole = parts.groupBy("first").agg(F.min_by("name", "id").alias("name"), *box).select((F.col("first") + ids_from).alias("id"), "name", *segment.BOX)
    named = glyphs.join(members, "id", "left").withColumn("name", F.when(F.col("first").isNotNull(), F.concat(F.lit("_group._part."), "name")).otherwise(F.col("name")))
    return named.select("id", "name", *segment.BOX).unionByName(whole)


def merge_from_xml(train: DataFrame, more: DataFrame) -> DataFrame:
    """train with the classified rows of ``more`` under ids behind its own; _group._part rows and unclassified ones aren't taken."""
    last = train.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    rest = more.where(F.col("class").isNotNull() & ~F.col("class").startswith("_group._part"))
    return train.unionByName(rest.crossJoin(last).withColumn("id", F.col("id") + F.col("last") + 1).select(*train.columns))  # last is one row


def generate_features_on_glyphs(px: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(id, features): the flat feature vector of each glyph's pixels."""
    from ..functions.registry import feature_vectors

    return feature_vectors(px, names).withColumnRenamed("image_id", "id")


def cc_and_cluster(px: DataFrame, keep: Keep, ratio: float = 1.0) -> DataFrame:
    """(image_id, label, cluster): the components of each image, clustered by the features of their boxes' pixels (rows, columns, black pixels)."""
    found = segment.boxes(segment.cc_analysis(px, keep)).withColumn("id", F.xxhash64("image_id", "label"))
    vectors = found.select("id", "image_id", F.array(F.col("lry") - F.col("uly") + 1, F.col("lrx") - F.col("ulx") + 1, "n").cast("array<double>").alias("features"))
    groups = cluster(vectors, keep, ratio, within="image_id")
    return found.join(groups, "id").select("image_id", "label", "cluster")


def add_to_database(train: DataFrame, more: DataFrame) -> DataFrame:
    return train.unionByName(more.join(train.select("id"), "id", "left_anti"))


def remove_from_database(train: DataFrame, gone: DataFrame) -> DataFrame:
    return train.join(gone.select("id"), "id", "left_anti")


def pregroup(glyphs: DataFrame, threshold: int, keep: Keep) -> DataFrame:
    """(image_id, id, root): glyphs whose boxes are within the threshold, joined through grid cells."""
    from .geometry import bounding_box_grouping

    pairs = segment.rect_join(glyphs, glyphs, (F.col("a_id") < F.col("b_id")) & bounding_box_grouping(threshold), pad=threshold + 2)
    node = lambda c: F.struct("image_id", F.col(c).alias("id"))
    stars = connected_components(pairs.select(node("a_id").alias("a"), node("b_id").alias("b")), keep, small=SMALL)
    own = glyphs.select("image_id", "id").withColumn("node", F.struct("image_id", "id"))
    return own.join(stars, "node", "left").select("image_id", "id", F.coalesce("root.id", "id").alias("root"))


def group_list_automatic(groups: DataFrame, score: Callable[[DataFrame], DataFrame], most_parts: int = 4, most_size: int = 16) -> DataFrame:
    """(root, members): the best cover of each pregroup. score maps (root, members) to (root, members, score)."""

    def subsets(pdf: pd.DataFrame) -> pd.DataFrame:
        from itertools import combinations

        ids = sorted(pdf["id"].tolist())
        sets = [[i] for i in ids] if len(ids) > most_size else [list(c) for n in range(1, min(most_parts, len(ids)) + 1) for c in combinations(ids, n)]
        return pd.DataFrame({"root": [pdf["root"].iloc[0]] * len(sets), "members": sets})

    return optimize_partitions(score(groups.groupBy("root").applyInPandas(subsets, "root long, members array<long>")), most_size)


def average_bb_distance(glyphs: DataFrame, reach: int = 100) -> DataFrame:
    """(image_id, d): mean over glyphs of the nearest box distance within reach."""
    pairs = segment.rect_join(glyphs, glyphs, F.col("a_id") != F.col("b_id"), pad=reach)
    return pairs.groupBy("image_id", "a_id").agg(F.min(segment.distance_bb()).alias("d")).groupBy("image_id").agg(F.avg("d").alias("d"))


# --- clustering ------------------------------------------------------------------------------------


def cluster(images: DataFrame, keep: Keep, ratio: float = 1.0, within: str | None = None, kind: str = "city_block") -> DataFrame:
    """(id, cluster): the minimum spanning tree of all distances, cut where an edge and the mean of its neighbours deviate by more than ``ratio``.

    The deviation is that of {mean of the neighbouring edges' costs, own cost}; an edge needs more than one neighbour.
    """
    tree = keep(spanning_trees(images, kind, within, keep), "tree")
    # an edge's neighbours are all edges at its ends but itself, so their sums follow from the ends'
    ends = keep(tree.select(F.explode(F.array("src", "dst")).alias("id"), "cost").groupBy("id").agg(F.sum("cost").alias("s"), F.count("*").alias("n")), "ends")
    at = lambda c: ends.select(F.col("id").alias(c), F.col("s").alias(f"{c}_s"), F.col("n").alias(f"{c}_n")).hint("merge")
    n = F.col("src_n") + F.col("dst_n") - 2
    mean = (F.col("src_s") + F.col("dst_s") - 2 * F.col("cost")) / n
    cut = tree.join(at("src"), "src").join(at("dst"), "dst").where((n > 1) & (F.abs(mean - F.col("cost")) / 2 > ratio)).select("src", "dst").hint("merge")
    kept = tree.join(cut, ["src", "dst"], "left_anti")
    stars = connected_components(kept, keep, "src", "dst", small=SMALL).withColumnRenamed("node", "id")
    return images.select("id").join(stars, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def max_distance(images: DataFrame, kind: str = "city_block") -> DataFrame:
    return knn.unique_distances(images, kind).agg(F.max("d").alias("d"))


def get_graph_stats(train: DataFrame, keep: Keep, kind: str = "city_block") -> DataFrame:
    """(class, mean): mean edge of each class's minimum spanning tree; 1 for singletons."""
    tree = spanning_trees(train, kind, "class", keep)
    of = train.select(F.col("id").alias("src"), "class")
    mean = tree.join(of, "src").groupBy("class").agg(F.avg("cost").alias("mean"))
    return train.select("class").distinct().join(mean, "class", "left").select("class", F.coalesce("mean", F.lit(1.0)).alias("mean"))


# --- rules -----------------------------------------------------------------------------------------


def rule_pairs(glyphs: DataFrame, a: str, b: str, rule: Column, grid: int = 100) -> DataFrame:
    """Pairs of glyphs whose names match the wildcards a and b, whose centres lie in neighbouring grid cells, and that meet the rule.

    glyphs(image_id, id, name, box); the rule reads a_... and b_... columns.
    """
    c = lambda axis: F.floor((F.col(f"ul{axis}") + F.col(f"lr{axis}")) / 2 / grid)
    cell = glyphs.withColumn("gx", c("x")).withColumn("gy", c("y"))
    cols = ["id", "name", "ulx", "uly", "lrx", "lry"]
    left = cell.where(F.col("name").rlike(build_id_regex(a))).select("image_id", "gx", "gy", *[F.col(x).alias(f"a_{x}") for x in cols])
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = cell.where(F.col("name").rlike(build_id_regex(b))).withColumn("d", near).select("image_id", (F.col("gx") + F.col("d.x")).alias("gx"), (F.col("gy") + F.col("d.y")).alias("gy"), *[F.col(x).alias(f"b_{x}") for x in cols])
    return left.join(right, ["image_id", "gx", "gy"]).where((F.col("a_id") != F.col("b_id")) & rule).drop("gx", "gy")


class RuleEngine:
    """Named rules over pairs of glyphs."""

    def __init__(self, grid: int = 100):
        self.grid, self.rules = grid, {}

    def add_rule(self, name: str, a: str, b: str, rule: Callable[[], Column]) -> None:
        self.rules[name] = (a, b, rule)

    def perform_rules(self, glyphs: DataFrame) -> DataFrame:
        """(rule, image_id, a_id, b_id) of all matches."""
        out = None
        for name, (a, b, rule) in self.rules.items():
            found = rule_pairs(glyphs, a, b, rule(), self.grid).select(F.lit(name).alias("rule"), "image_id", "a_id", "b_id")
            out = found if out is None else out.unionByName(found)
        return out


# --- lines and text --------------------------------------------------------------------------------


def find_sections(glyphs: DataFrame, keep: Keep) -> DataFrame:
    """(image_id, id, section): boxes grown by the page's mean glyph size, merged where they meet."""
    mean = glyphs.groupBy("image_id").agg(F.ceil(F.avg(F.col("lrx") - F.col("ulx") + 1)).cast("int").alias("ex"), F.ceil(F.avg(F.col("lry") - F.col("uly") + 1)).cast("int").alias("ey"))
    grown = glyphs.join(mean, "image_id").select("image_id", "id", (F.col("ulx") - F.col("ex")).alias("ulx"), (F.col("uly") - F.col("ey")).alias("uly"), (F.col("lrx") + F.col("ex")).alias("lrx"), (F.col("lry") + F.col("ey")).alias("lry"))
    pairs = segment.rect_join(grown, grown, (F.col("a_id") < F.col("b_id")) & segment.intersects())
    node = lambda c: F.struct("image_id", F.col(c).alias("id"))
    stars = connected_components(pairs.select(node("a_id").alias("a"), node("b_id").alias("b")), keep, small=SMALL)
    own = glyphs.select("image_id", "id").withColumn("node", F.struct("image_id", "id"))
    return own.join(stars, "node", "left").select("image_id", "id", F.coalesce("root.id", "id").alias("section"))


def find_lines(glyphs: DataFrame) -> DataFrame:
    """glyphs with line: gaps-and-islands over y, a glyph whose top lies below all earlier bottoms of its section starts a line."""
    w = Window.partitionBy("image_id", "section").orderBy("uly", "ulx", "id")
    above = F.max("lry").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return glyphs.withColumn("new", (F.col("uly") > F.coalesce(above, F.col("uly") - 1)).cast("int")).withColumn("line", F.sum("new").over(w)).drop("new")


def make_string(glyphs: DataFrame) -> DataFrame:
    """(image_id, section, line, text): glyphs' characters by x, a space where the gap is over twice the line's mean gap."""
    w = Window.partitionBy("image_id", "section", "line").orderBy("ulx", "id")
    gap = F.col("ulx") - F.lag("lrx").over(w)
    g = glyphs.withColumn("gap", gap)
    mean = F.floor(F.avg("gap").over(Window.partitionBy("image_id", "section", "line")))
    part = F.concat(F.when(F.col("gap") > 2 * mean, F.lit(" ")).otherwise(F.lit("")), "char")
    g = g.withColumn("part", part)
    return g.groupBy("image_id", "section", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ulx", "id", "part"))), lambda s: s["part"]), "").alias("text"))


#: Names of characters as the last parts of dotted classes spell them.
NAMED = {"period": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "space": " ", "exclamation": "!", "question": "?", "apostrophe": "'", "quotation": '"', "solidus": "/", "ampersand": "&"}


@F.pandas_udf(StringType())
def unicode_name(names: pd.Series) -> pd.Series:
    """The character whose Unicode name a dotted class spells (greek.small.letter.alpha), else null."""

    def find(name: str | None) -> str | None:
        try:
            return unicodedata.lookup(name.replace(".", " ").upper())
        except (AttributeError, KeyError):
            return None

    known = {n: find(n) for n in names.unique()}
    return names.map(known)


def name_lookup_unicode(name: Column) -> Column:
    """The character of a dotted class by its Unicode name; else letters by case, digits and some signs by the last part, else _."""
    last = F.element_at(F.split(name, r"\."), -1)
    upper = name.contains("capital") | name.contains("upper")
    digits = F.create_map(*[F.lit(x) for i, d in enumerate("zero one two three four five six seven eight nine".split()) for x in (d, str(i))])
    signs = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    return F.coalesce(unicode_name(name), F.when(F.length(last) == 1, F.when(upper, F.upper(last)).otherwise(last)), digits[last], signs[last], F.lit("_"))


def ocr(glyphs: DataFrame, train: DataFrame, keep: Keep) -> DataFrame:
    """(image_id, section, line, text) of a page's glyphs (image_id, id, box, features)."""
    named = glyphs.join(guess_glyphs(glyphs.select("id", "features"), train), "id")
    placed = find_lines(named.join(find_sections(named, keep), ["image_id", "id"]))
    return make_string(placed.withColumn("char", name_lookup_unicode(F.col("name"))))
