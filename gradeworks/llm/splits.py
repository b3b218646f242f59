"""Splits that keep related records together (problem 3).

Records that share a document or are variants of one sample form components.  Components are found
by star contraction on a table of links, described by a vector of label counts, and placed by
grouped iterative stratification: the component that holds the rarest outstanding label goes to the
split which still needs that label most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import forget, materialize

#: Names that stand for "no image", without directory and extension.
PLACEHOLDER_STEMS = ("", "n/a", "na", "nan", "none", "null", "missing", "placeholder", "unknown", "no_image", "no-image", "noimage", "-", "?", "tbd", "todo", "default", "blank", "empty")
#: Spellings of one split.
SPLIT_SPELLINGS = {"validation": "val", "valid": "val", "dev": "val", "training": "train", "testing": "test"}


def spelling_key(name: Column) -> Column:
    """A name without case, spaces and hyphens."""
    return F.regexp_replace(F.lower(name), r"[\s\-]+", "")


def document_key(image_path: Column, collection: Column) -> Column:
    """``collection/file`` of the document an image path names, null if it names none.

    Slashes, case, ``.`` and ``..`` segments, URL escapes, query strings, fragments, extensions and
    page marks (``_p03``, ``-page-3``, ``.p3``, ``_pg0001``) do not matter.  ``collection`` is used
    for paths without a directory.
    """
    escaped = F.regexp_replace(image_path, r"%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.lower(F.trim(F.try_url_decode(F.regexp_replace(escaped, r"\+", "%2B"))))
    plain = F.regexp_replace(plain, r"\\", "/")
    plain = F.regexp_replace(plain, r"[?#].*$", "")
    parts = F.filter(F.split(plain, "/"), lambda p: ~F.trim(p).isin("", ".", ".."))
    name = F.trim(F.element_at(parts, -1))
    stem = F.regexp_replace(name, r"\.(?:jpe?g|png|tiff?|pdf|gif|bmp|webp|jp2|djvu)$", "")
    bare = F.trim(F.regexp_replace(stem, r"[\s_.\-]+(?:p|pg|page|pag)[\s_.\-]*[0-9]+$", ""))
    folder = F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -2))).otherwise(F.lower(F.trim(collection)))
    known = F.size(parts) > 0
    named = known & ~bare.isin(*PLACEHOLDER_STEMS) & ~plain.isin(*PLACEHOLDER_STEMS) & folder.isNotNull()
    return F.when(named, F.concat_ws("/", folder, bare))


def variant_key(sample_id: Column) -> Column:
    """``source/split/number`` that a sample id names, null if it has another form."""
    plain = F.lower(F.trim(sample_id))
    form = r"^([a-z][a-z0-9]*?(?:[-_][a-z]+)*?)[-_]([a-z]+)[-_]0*([0-9]+)(?:[a-z]|[-_.]?[a-z]+[0-9]*)*$"
    split = F.regexp_extract(plain, form, 2)
    for spelling, short in SPLIT_SPELLINGS.items():
        split = F.when(split == spelling, F.lit(short)).otherwise(split)
    source = F.regexp_replace(F.regexp_extract(plain, form, 1), "[-_]", "")
    return F.when(plain.rlike(form), F.concat_ws("/", source, split, F.regexp_extract(plain, form, 3)))


def sample_links(samples: DataFrame, collections: DataFrame) -> DataFrame:
    """Distinct ``(sample_id, link)``: what each sample id is tied to.

    Rows without a sample id are left out.  Every sample id is linked at least to itself, so that
    each ends in a component.
    """
    sources = collections.select(spelling_key(F.col("source_dataset")).alias("__source"), F.col("collection_dir").alias("__collection"))
    sources = sources.where(F.col("__source").isNotNull()).groupBy("__source").agg(F.min("__collection").alias("__collection"))
    rows = samples.where(F.col("sample_id").isNotNull()).select("sample_id", "image_path", spelling_key(F.col("source_dataset")).alias("__source"))
    rows = rows.join(sources, "__source", "left")
    document = F.concat(F.lit("d:"), document_key(F.col("image_path"), F.col("__collection")))
    variant = F.concat(F.lit("v:"), variant_key(F.col("sample_id")))
    own = F.concat(F.lit("s:"), F.col("sample_id"))
    links = F.explode(F.array_compact(F.array(document, variant, own)))
    return rows.select("sample_id", links.alias("link")).distinct()


def connected_components(links: DataFrame, node: str, link: str, max_rounds: int = 50, plain: int = 1_000_000) -> DataFrame:
    """``(node, component)`` where nodes that share a link, or a chain of links, share a component.

    ``component`` is the smallest node of the component.  Nodes are numbered first, so that rounds
    move pairs of integers.  Each link becomes a star around its smallest number: a link that holds
    a third of all nodes yields one edge per node and never a pair of all with all.  The stars are
    contracted by alternating large-star and small-star rounds until nothing changes, which takes a
    number of rounds logarithmic in the longest chain.  Every round is written to the shared folder
    and the one before it deleted; no edge comes to the driver.
    """
    numbered = materialize(links.select(node).distinct().withColumn("__id", F.monotonically_increasing_id()), "nodes")
    tied = links.select(node, F.col(link).alias("__link")).join(numbered, node)
    hubs = tied.groupBy("__link").agg(F.min("__id").alias("v"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    starred = _by_heavy(tied, hubs, "__link", links.count(), plain)
    edges = materialize(starred.where("__id <> v").select(F.col("__id").alias("u"), "v").distinct(), "edges")
    size, sign = _print_of(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * size, plain).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _with_least(down, size, plain)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        forget(edges)
        edges, before = after, (size, sign)
        size, sign = _print_of(edges)
        if (size, sign) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = numbered.join(edges.groupBy(F.col("u").alias("__id")).agg(F.min("v").alias("__root")), "__id", "left")
    rooted = materialize(rooted.select(node, F.coalesce("__root", "__id").alias("__root")), "rooted")
    forget(edges, numbered)
    named = rooted.groupBy("__root").agg(F.min(node).alias("component"), F.count(F.lit(1)).alias("__n"))
    return _by_heavy(rooted, named, "__root", rooted.count(), plain).select(node, "component")


def _print_of(edges: DataFrame) -> tuple[int, object]:
    """How many edges there are and the sum of their hashes: two equal tables agree in both."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int, plain: int) -> DataFrame:
    """``edges`` with ``m``, the least ``v`` of their ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    return _by_heavy(edges, least, "u", total, plain).drop("__n")


def _by_heavy(rows: DataFrame, values: DataFrame, key: str, total: int, plain: int) -> DataFrame:
    """``rows`` joined with the one row of ``values`` per key, which has the key's count ``__n``.

    A key with more than a thousandth of all rows would bring them to one task.  There are fewer
    than 1,000 of these, so their values are broadcast.  With at most ``plain`` rows in all, none is
    too much for a task.
    """
    if total <= plain:
        return rows.join(values, key)
    heavy = values.where(F.col("__n") > F.lit(total / 1000))
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(values, key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def sample_groups(samples: DataFrame, collections: DataFrame, plain: int = 1_000_000) -> DataFrame:
    """``(sample_id, group_id, group_size)`` for every distinct sample id."""
    links = materialize(sample_links(samples, collections), "links")
    found = materialize(connected_components(links, "sample_id", "link", plain=plain), "components")
    forget(links)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    return _by_heavy(found, sizes, "component", found.count(), plain).select("sample_id", F.col("component").alias("group_id"), F.col("__n").alias("group_size"))


def place(vectors: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Grouped iterative stratification of components with label counts ``vectors`` (n, labels).

    ``want`` (splits, labels) is what each split still needs and is changed in place.  Components of
    the rarest outstanding label come first, the larger before the smaller; each goes to the split
    that needs that label most, then to the one that needs most rows, then to the first.
    """
    n = len(vectors)
    chosen = np.full(n, -1, dtype=np.int64)
    outstanding = vectors.sum(axis=0).astype(float)
    size = vectors.sum(axis=1)
    order = np.argsort(-size, kind="stable")
    members = {k: [i for i in order[::-1] if vectors[i, k] > 0] for k in range(vectors.shape[1])}
    total = want.sum(axis=1)
    while members:
        label = min(members, key=lambda k: (not members[k], outstanding[k], k))
        pool = members.pop(label)
        while pool:
            i = pool.pop()
            if chosen[i] >= 0:
                continue
            need = want[:, label]
            s = max(range(len(want)), key=lambda j: (need[j], total[j], -j))
            chosen[i] = s
            want[s] -= vectors[i]
            total[s] -= size[i]
            outstanding -= vectors[i]
    chosen[chosen < 0] = int(np.argmax(total))
    return chosen


def _matrix(vectors: list) -> tuple[list[str], np.ndarray]:
    """The labels in a list of label counts ``[(label, n), ...]``, and the counts as a matrix."""
    labels = sorted({x["label"] for v in vectors for x in v})
    at = {x: k for k, x in enumerate(labels)}
    out = np.zeros((len(vectors), len(labels)))
    for i, v in enumerate(vectors):
        for x in v:
            out[i, at[x["label"]]] = x["n"]
    return labels, out


def stratified_splits(
    samples: DataFrame,
    groups: DataFrame,
    label: str = "task_type",
    proportions: Mapping[str, float] | None = None,
    block_groups: int = 20_000,
    large_share: float = 0.001,
    plain: int = 1_000_000,
) -> DataFrame:
    """``(sample_id, group_id, split)`` with whole groups in one split and label shares near ``proportions``.

    Groups of at least ``large_share`` of all samples, of which there can be no more than
    ``1 / large_share``, are placed first, on the driver.  The others are dealt into blocks by their
    rarest label, over all rows: the groups of a rare label lie in one block and are weighed against
    its whole need, and a label of more than ``block_groups`` groups has blocks of about that many,
    each with its part of the need.  The label of a sample is that of its smallest non-null
    spelling; any number of labels may occur.
    """
    shares = dict(proportions or {"train": 0.8, "validation": 0.1, "test": 0.1})
    names = list(shares)
    ratio = np.array([shares[n] for n in names], dtype=float)
    ratio /= ratio.sum()
    spark = samples.sparkSession
    labelled = samples.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.min(F.upper(F.trim(F.col(label)))).alias("label"))
    rows = materialize(groups.select("sample_id", "group_id").join(labelled, "sample_id", "left").select("sample_id", "group_id", F.coalesce("label", F.lit("")).alias("label")), "labelled")
    total = rows.count()
    if not total:
        return rows.select("sample_id", "group_id", F.lit(None).cast("string").alias("split"))
    counts = rows.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("all"))
    by_group = counts.join(totals, "label").groupBy("group_id").agg(F.collect_list(F.struct("label", "n")).alias("vector"), F.sum("n").alias("n"), F.min(F.struct("all", "label"))["label"].alias("lead"))
    vectors = materialize(by_group, "vectors")
    cut = max(2.0, large_share * total)
    big = vectors.where(F.col("n") >= cut).orderBy(F.desc("n"), "group_id").select("group_id", "vector").collect()
    known, matrix = _matrix([r["vector"] for r in big])
    sums = {r["label"]: r["all"] for r in totals.where(F.col("label").isin(known)).collect()} if known else {}
    want = np.outer(ratio, np.array([sums[x] for x in known], dtype=float))
    picks = place(matrix, want) if big else []
    out = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("split", T.StringType())])
    placed_big = spark.createDataFrame([(r["group_id"], names[k]) for r, k in zip(big, picks, strict=True)], out)
    left = np.clip(want, 0, None)
    weight = {x: left[:, k] / left[:, k].sum() if left[:, k].sum() > 0 else ratio for k, x in enumerate(known)}

    def stratify(block: pd.DataFrame) -> pd.DataFrame:
        ordered = block.sort_values("group_id")
        labels, matrix = _matrix(ordered["vector"].tolist())
        need = np.stack([weight.get(x, ratio) * matrix[:, k].sum() for k, x in enumerate(labels)], axis=1)
        return pd.DataFrame({"group_id": ordered["group_id"].to_numpy(), "split": [names[k] for k in place(matrix, need)]})

    small = vectors.where(F.col("n") < cut)
    leads = small.groupBy("lead").agg(F.count(F.lit(1)).alias("__groups"))
    dealt = small.join(leads, "lead").withColumn("__block", F.pmod(F.xxhash64("group_id"), F.ceil(F.col("__groups") / F.lit(block_groups))))
    placed = dealt.select("group_id", "vector", "lead", "__block").groupBy("lead", "__block").applyInPandas(stratify, out).unionByName(placed_big)
    sizes = vectors.select("group_id", F.col("n").alias("__n"))
    return _by_heavy(rows.drop("label"), placed.join(sizes, "group_id"), "group_id", total, plain).select("sample_id", "group_id", "split")


def linked_samples(samples: DataFrame, collections: DataFrame) -> DataFrame:
    """``(sample_id, group_id)`` of all groups of at least two sample ids."""
    return sample_groups(samples, collections).where("group_size > 1").select("sample_id", "group_id")


LINK_COLUMNS: Sequence[str] = ("sample_id", "group_id")
