"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

DataFrame functions only. Budgets live in a table of leaves; what documents need is their leaf's row of that table, so a
leaf of any size is split among tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_of

LEVELS = ("domain", "lang", "source")
#: Prefix of the columns that stand beside those of documents for a while.
OWN = "__mixing_"
#: Bits of a document's place in an epoch, and of the bucket that the place begins with.
PLACE_BITS, BUCKET_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo 4, or "other"."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.nullif(number, F.lit("")).cast("int") % 4).cast("string")))


def node_weights() -> dict[str, Column]:
    """The production weights of a node among its siblings, by level."""
    lang = F.when(F.col("lang") == "en", 3.0).when(F.col("lang").isin("de", "fr", "es"), 2.0).otherwise(1.0)
    return {"domain": F.lit(1.0), "lang": lang, "source": F.lit(1.0)}


def _leafed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with the leaf's columns, under OWN names (null: empty)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns({OWN + "domain": domain_of(source), OWN + "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), OWN + "source": source})


def _number(hashed: Column) -> Column:
    """60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(hashed), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _mark(text: str) -> Column:
    return _number(text_of(text))


def _place(key: Column, mark: Column, seed: int, epoch: Column) -> Column:
    """A document's place in an epoch, by a hash of seed, epoch, key and text."""
    return _number(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), mark.cast("string")))


def _counted(rows: DataFrame, levels: list[str]) -> DataFrame:
    """rows with k, which counts a leaf's rows from 0. Rows are ranged, so that a leaf of any size is cut among tasks."""
    by = [*levels, OWN + "at"]
    ranged = rows.withColumn(OWN + "at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumns({OWN + "part": F.spark_partition_id(), OWN + "row": F.monotonically_increasing_id()}))
    counts = ranged.groupBy(*levels, OWN + "part").agg(F.count("*").alias(OWN + "n"), F.min(OWN + "row").alias(OWN + "first"))
    before = F.sum(OWN + "n").over(Window.partitionBy(*levels).orderBy(OWN + "part")) - F.col(OWN + "n")
    starts = counts.select(*levels, OWN + "part", (before - F.col(OWN + "first")).alias(OWN + "start"))
    return ranged.join(starts, [*levels, OWN + "part"]).withColumn("k", F.col(OWN + "start") + F.col(OWN + "row"))


def _shared_out(nodes: DataFrame, parents: list[str], me: str, weight: str) -> DataFrame:
    """Column budget: the parent's budget by weight, where no node gets more than its cap.

    What a full node leaves goes to its siblings by their weights. Nodes in the order of cap / weight fill up first, so
    those that fill up are the first of them, and the others share the rest.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    cap = F.when(F.col(weight) > 0, F.col("cap")).otherwise(0.0)
    side = [*parents, "one"]
    by = Window.partitionBy(*side).orderBy(F.col("r").asc(), F.col(me).asc())
    nodes = nodes.withColumns({"one": F.lit(1), "w": w, "c": cap}).withColumn("r", F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(0.0)))
    before = F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumns({"before": F.coalesce(before, F.lit(0.0)), "after": after})
    nodes = nodes.withColumn("full", F.col("c") * F.col("after") <= (F.col("above") - F.col("before")) * F.col("w"))
    whole = Window.partitionBy(*side)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), F.lit(0.0))
    left = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    budget = F.when(F.col("full"), F.col("c")).otherwise((F.col("above") - used) / left * F.col("w"))
    return nodes.withColumn("budget", F.coalesce(budget, F.lit(0.0))).drop("one", "w", "c", "r", "before", "after", "full", "above")


def leaf_budgets(base: DataFrame, share: float, max_epochs: int, weights: dict[str, Column]) -> DataFrame:
    """Leaf rows (domain, lang, source, available, budget) for a table of documents (domain, lang, source, tokens).

    The total, `share` of all tokens, goes down the tree by weight. A node's cap is what its leaves hold in max_epochs
    passes: a leaf's shortage goes to its siblings first, and to its ancestors' siblings only as far as they are full.
    """
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("available")).withColumns({f"w_{k}": weights[k].cast("double") for k in LEVELS})
    total = leaves.agg(F.sum("available")).first()[0] or 0
    leaves = stored(leaves)
    above = None
    for i, level in enumerate(LEVELS):
        names = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*names).agg((F.sum("available") * F.lit(float(max_epochs))).alias("cap"), F.max(f"w_{level}").alias("w_"), F.sum("available").alias("available"))
        nodes = nodes.withColumn("above", F.lit(float(total) * share)) if above is None else nodes.join(above, names[:-1])
        nodes = _shared_out(nodes, names[:-1], level, "w_")
        above = nodes.select(*names, F.col("budget").alias("above"))
    return nodes.select(*LEVELS, "available", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mixing_plan(docs: DataFrame, share: float = 1.0, max_epochs: int = 3, seed: int = 17, weights: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' narrow table and the leaves' plan, both stored.

    Narrow table: key, mark (of the text), domain, lang, source, tokens (words of the whole text). Plan, a row for each
    leaf: epochs that take the whole leaf, rest (tokens of the next epoch), and where that epoch ends: cut_bucket,
    cut_place (of the last documents taken), cut_before (tokens before that place), cut_tokens (of each document there).
    Documents of one place are equal in key and text.
    """
    base = _leafed(docs, key, text).select(F.col(key).alias("doc_id"), _mark(text).alias("mark"), *(F.col(OWN + c).alias(c) for c in LEVELS), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("tokens"))
    base = stored(base)
    plan = leaf_budgets(base, share, max_epochs, weights or node_weights())
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
    plan = stored(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")))

    placed = base.join(plan.select(*LEVELS, "epochs", "rest"), list(LEVELS)).where("rest > 0 and tokens > 0")
    placed = placed.withColumn("place", _place(F.col("doc_id"), F.col("mark"), seed, F.col("epochs") + 1)).withColumn("bucket", F.shiftright("place", PLACE_BITS - BUCKET_BITS))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    cut = sums.withColumn("upto", run).where("upto >= rest and upto - t < rest").select(*LEVELS, F.col("bucket").alias("cut_bucket"), (F.col("upto") - F.col("t")).alias("bucket_before"))
    cut = stored(cut)
    inside = placed.join(cut, list(LEVELS)).where("bucket = cut_bucket").groupBy(*LEVELS, "place", "rest", "bucket_before").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("cut_tokens"))
    upto = F.col("bucket_before") + F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("place"))
    last = inside.withColumn("upto", upto).where("upto >= rest and upto - t < rest").select(*LEVELS, F.col("place").alias("cut_place"), (F.col("upto") - F.col("t")).alias("cut_before"), "cut_tokens")
    return base, stored(plan.join(cut.drop("bucket_before"), list(LEVELS), "left").join(last, list(LEVELS), "left"))


def mixture(docs: DataFrame, share: float = 1.0, max_epochs: int = 3, seed: int = 17, weights: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and epoch that takes it: doc_id, domain, lang, source, tokens, epoch, taken.

    Epochs count from 1; each has its own seeded order, and all but a leaf's last take the leaf whole. taken is tokens,
    less for the one document that reaches the leaf's budget. A text without words has no tokens and is in no epoch; a
    null lang or source is the leaf of the empty name; a document's place in an epoch comes from its key and text, and of
    rows equal in both any may come first. No rows give none. Other columns are not read.
    """
    base, plan = mixing_plan(docs, share, max_epochs, seed, weights, key, text)
    all_ = base.where("tokens > 0").join(plan, list(LEVELS))
    all_ = all_.withColumn("place", _place(F.col("doc_id"), F.col("mark"), seed, F.col("epochs") + 1))
    names = ["doc_id", *LEVELS, "tokens"]
    next_ = (F.col("epochs") + 1).alias("epoch")
    whole = all_.where("epochs > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"), F.col("tokens").alias("taken"))
    early = all_.where("rest > 0 and place < cut_place").select(*names, next_, F.col("tokens").alias("taken"))
    last = all_.where("rest > 0 and place = cut_place").select(*names, "epochs", (F.col("rest") - F.col("cut_before")).alias("left"))
    so_far = F.col("k") * F.col("tokens")
    late = _counted(last, list(LEVELS)).where(so_far < F.col("left")).select(*names, next_, F.least("tokens", F.col("left") - so_far).alias("taken"))
    return whole.unionByName(early).unionByName(late)


def mixed_documents(docs: DataFrame, share: float, seed: int = 17, weights: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that one epoch of the mixture takes, whole, all columns as they are: a filter by the leaf's plan.

    A leaf's rows hold its budget and less than one document more. Of rows equal in key and text, as many as are needed.
    """
    _, plan = mixing_plan(docs, share, 1, seed, weights, key, text)
    names = docs.columns
    own = plan.select(*(F.col(c).alias(OWN + c) for c in (*LEVELS, "epochs", "rest", "cut_place", "cut_before", "cut_tokens")))
    epochs, levels = F.col(OWN + "epochs"), [OWN + c for c in LEVELS]
    took = _leafed(docs, key, text).join(own, levels).withColumn(OWN + "place", _place(F.col(key), _mark(text), seed, epochs + 1))
    before = (epochs >= 1) | (F.col(OWN + "place") < F.col(OWN + "cut_place"))
    renamed = took.where((epochs < 1) & (F.col(OWN + "place") == F.col(OWN + "cut_place")))
    renamed = renamed.select(*(F.col(f"`{c}`").alias(f"{OWN}{i}_") for i, c in enumerate(names)), *levels, ((F.col(OWN + "rest") - F.col(OWN + "cut_before")) / F.col(OWN + "cut_tokens")).alias(OWN + "needed"))
    last = _counted(renamed, levels).where(F.col("k") < F.col(OWN + "needed")).select(*(F.col(f"{OWN}{i}_").alias(c) for i, c in enumerate(names)))
    return took.where(before).select(*(F.col(f"`{c}`") for c in names)).unionByName(last)
