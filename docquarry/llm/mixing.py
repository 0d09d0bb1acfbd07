"""Mixing sources to target weights by hierarchical budgeting. Native Spark.

Weights go down a tree of domain, language and source. A node's capacity is the tokens below it
times ``max_epochs``, so a child that cannot use its part leaves the rest to its siblings by their
weights, and only what all of them cannot use goes back to its ancestor's siblings. Among the
children of a node the parts are found in closed form: in the order of capacity per weight, a child
is full as long as its share of what is left reaches its capacity. All sums are exact integers.

A leaf with a part of p tokens and t tokens of its own takes floor(p / t) whole epochs and, from the
next epoch in its own seeded order, the longest prefix of documents that fits in the rest. The prefix
is cut by hash buckets: sums per (leaf, bucket) decide which buckets are in, and only the rows of the
one bucket that holds the border are ordered, so a source with a third of all rows is no hot task.

Null texts and texts without words have no tokens; they cost nothing and are taken where the prefix
reaches them. Null domains, languages and sources are the nodes ``(none)``. Rows with one id stand at
one place of the order and are taken together. Extra columns are carried. Weights of zero give
nothing. Unlisted nodes have ``default_weight``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Written

NONE = "(none)"
LEVELS = ("domain", "language", "origin")

# Weights of the query and the pipeline, in parts; unlisted nodes weigh DEFAULT_WEIGHT.
DEFAULT_WEIGHT = 10
WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 50,
    ("reference",): 30,
    ("forum",): 20,
    ("web", "en"): 40,
    ("web", "de"): 20,
    ("reference", "en"): 30,
    ("reference", "fr"): 30,
}
SEED = 17


def document_domain() -> Column:
    """Domain of a document by the number that ends its source."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]{1,4})$", 1), F.lit("9999")), F.lit(0))
    return F.when(F.col("source").isNull(), F.lit(NONE)).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ("web", "reference", "forum")]), F.pmod(number, F.lit(3)).cast("int") + 1)
    )


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(columns: list[str], weights: Mapping[tuple[str, ...], int], default: int) -> Column:
    found = F.lit(None).cast("long")
    for path, value in weights.items():
        if len(path) == len(columns):
            same = F.lit(True)
            for column, part in zip(columns, path, strict=True):
                same = same & (F.col(column) == part)
            found = F.when(same, F.lit(int(value)).cast("long")).otherwise(found)
    return F.coalesce(found, F.lit(default).cast("long"))


def _share(level: DataFrame, parent: list[str]) -> DataFrame:
    """*level* ``(parent..., node..., cap, w, budget)`` with the part of every child."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    nodes = [c for c in level.columns if c not in ("cap", "w", "budget")]
    order = group.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), *nodes)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = (
        level.where("w > 0")
        .withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("still", F.sum("w").over(here))
        .withColumn(
            "full",
            F.expr(
                "cast(budget - taken as decimal(19,0)) * cast(w as decimal(10,0))"
                " >= cast(cap as decimal(19,0)) * cast(still as decimal(10,0))"
            ),
        )
    )
    return (
        wide.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(group))
        .withColumn(
            "part",
            F.expr(
                "case when full then cap else cast((cast(budget - spent as decimal(19,0))"
                " * cast(w as decimal(10,0))) div cast(open as decimal(10,0)) as bigint) end"
            ),
        )
        .select(*nodes, "cap", "part")
    )


#: Columns that a mixture adds.
ADDED = ("mix_domain", "mix_tokens", "mix_epochs")


def leaf_budgets(
    leaves: DataFrame,
    budget: int | None = None,
    *,
    share: tuple[int, int] = (1, 1),
    weights: Mapping[tuple[str, ...], int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    max_epochs: int = 1,
) -> DataFrame:
    """``(domain, language, origin, tokens, part)`` of *leaves* ``(..., tokens)``.

    The whole budget is *budget* tokens or *share* (a fraction) of all tokens.
    """
    weights = WEIGHTS if weights is None else weights
    # capacities from the leaves up; a node of weight zero can take nothing
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    levels = []
    for depth in (3, 2, 1):
        nodes = list(LEVELS[:depth])
        tree = (
            tree.groupBy(*nodes)
            .agg(F.sum("cap").alias("cap"))
            .withColumn("w", _weight(nodes, weights, default_weight))
            .withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast("long"))
        )
        levels.append(tree)
    total = leaves.agg(F.sum("tokens").alias("all_tokens"))
    whole = F.lit(budget).cast("long") if budget is not None else F.expr(
        f"cast((cast(all_tokens as decimal(19,0)) * {int(share[0])}) div {int(share[1])} as bigint)"
    )
    top = levels[2].join(total).withColumn("budget", whole).drop("all_tokens")
    parts = _share(top, [])
    for depth in (2, 3):
        parent = list(LEVELS[: depth - 1])
        above = parts.select(*parent, F.col("part").alias("budget"))
        parts = _share(levels[3 - depth].join(above, parent), parent)
    return leaves.join(parts.select(*LEVELS, "part"), list(LEVELS), "left").select(
        *LEVELS, "tokens", F.coalesce("part", F.lit(0)).alias("part")
    )


def _md5(epoch: Column, seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    *,
    share: tuple[int, int] = (1, 1),
    weights: Mapping[tuple[str, ...], int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    max_epochs: int = 1,
    seed: int = SEED,
    domain: Column | None = None,
    key: str = "doc_id",
    describe: bool = True,
) -> DataFrame:
    """All columns of *docs* with ``mix_domain``, ``mix_tokens``, ``mix_epochs`` (times it is taken).

    Documents that are not taken are left out. Columns of *docs* with one of those names give way; without
    *describe* nothing is added and all columns of *docs* stay.
    """
    domain = document_domain() if domain is None else domain
    own_names = "__"  # no column of the documents begins like ours
    while any(c.lower().startswith(own_names) for c in docs.columns):
        own_names += "_"
    own = {
        f"{own_names}domain": F.coalesce(domain, F.lit(NONE)),
        f"{own_names}language": F.coalesce(F.col("lang"), F.lit(NONE)),
        f"{own_names}origin": F.coalesce(F.col("source"), F.lit(NONE)),
        f"{own_names}tokens": word_count(),
    }
    kept = docs.select("*", *[expr.alias(name) for name, expr in own.items()])
    narrow = Written(
        kept.select(*[F.col(f"{own_names}{n}").alias(n) for n in LEVELS], F.col(f"{own_names}tokens").alias("tokens"), F.col(key).alias("k")),
        "mixrows",
    )
    rows = narrow.read()
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    parts = Written(
        leaf_budgets(
            leaves, budget, share=share, weights=weights, default_weight=default_weight, max_epochs=max_epochs
        ).select(
            *LEVELS,
            F.expr("case when tokens > 0 then part div tokens else 0 end").alias("epochs"),
            F.expr("case when tokens > 0 then part % tokens else 0 end").alias("rest"),
        ),
        "parts",
    )
    # the next epoch's order: the first 12 bits of the hash are the bucket
    def placed(df: DataFrame, level: list[str]) -> DataFrame:
        order = _md5(F.col("epochs"), seed, "k")
        return df.join(parts.read(), level).withColumn("place", order).withColumn(
            "bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
        )

    level = list(LEVELS)
    buckets = placed(rows, level).groupBy(*level, "rest", "bucket").agg(F.sum("tokens").alias("mass"))
    running = Window.partitionBy(*level).orderBy("bucket")
    # buckets that end within the rest are in; the first that does not is cut inside
    border = Written(
        buckets.withColumn("after", F.sum("mass").over(running))
        .where("after > rest")
        .groupBy(*level)
        .agg(F.min("bucket").alias("cut"), F.min_by(F.col("rest") - F.col("after") + F.col("mass"), "bucket").alias("room")),
        "borders",
    )
    inside = placed(rows, level).join(border.read(), level).where("bucket = cut")
    ordered = Window.partitionBy(*level).orderBy("place", "k")
    last = (
        inside.groupBy(*level, "room", "place", "k")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("after", F.sum("tokens").over(ordered))
        .where("after <= room")
        .groupBy(*level)
        .agg(F.max(F.struct("place", F.coalesce("k", F.lit(-(1 << 62))).alias("k"))).alias("last"))
    )
    ends = Written(
        parts.read().join(border.read().select(*level, "cut"), level, "left").join(last, level, "left"), "ends"
    )
    ends = ends.read().select(*[F.col(n).alias(f"{own_names}{n}") for n in (*LEVELS, "epochs", "cut", "last")])
    place = _md5(F.col(f"{own_names}epochs"), seed, key)
    bucket = F.conv(F.substring(f"{own_names}place", 1, 3), 16, 10).cast("int")
    at = F.struct(F.col(f"{own_names}place").alias("place"), F.coalesce(F.col(key), F.lit(-(1 << 62))).alias("k"))
    taken = F.col(f"{own_names}cut").isNull() | (F.col(f"{own_names}bucket") < F.col(f"{own_names}cut")) | (
        (F.col(f"{own_names}bucket") == F.col(f"{own_names}cut")) & F.coalesce(at <= F.col(f"{own_names}last"), F.lit(False))
    )
    times = F.col(f"{own_names}epochs") + F.when(taken & (F.col(f"{own_names}epochs") < max_epochs), 1).otherwise(0)
    return (
        kept.join(ends, [f"{own_names}{n}" for n in LEVELS])
        .withColumn(f"{own_names}place", place)
        .withColumn(f"{own_names}bucket", bucket)
        .withColumn(f"{own_names}times", times.cast("long"))
        .where(f"{own_names}times > 0")
        .select(
            *[F.col(f"`{c}`") for c in docs.columns if not describe or c.lower() not in ADDED],
            *[F.col(f"{own_names}{n}").alias(name) for n, name in zip(("domain", "tokens", "times"), ADDED, strict=True) if describe],
        )
    )
