"""Mixing sources to target weights, in tokens of a public tokenizer.

Method: hierarchical budgeting. A source's target share is spread over its leaves by their tokens and goes up a tree of
columns (``levels``: source, language by default; domain, language, source or any other order works alike); a node weighs
what its leaves do. The wanted total goes down the tree by these weights. A node that can't use its budget, even with every
document repeated as often as allowed, leaves the rest to its siblings; only what they can't take either goes to its
parent's siblings. Each leaf then gives whole seeded epochs and, of one more, the prefix of documents that its budget reaches.

By default the total is the largest at which no source falls short, so every source that occurs has its target share; the
shares of sources that don't occur are spread over the others in proportion, and reported as 0. With a larger total the
short sources are redistributed as above, and the report shows it.

A leaf's prefix is one of tokens: its last document is used up to the token that fills the budget (``tokens_used``), so the
reached shares are off by less than a token for each leaf. Documents without tokens and those of unweighted sources are left
out; rows of one document count once. Spelling of sources and languages is folded. Nothing depends on the order of rows or
partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lesewerk.llm.bpe import count_tokens
from lesewerk.llm.common import fold_lang, fold_name, small_rows
from lesewerk.session import ensure_checkpoint_dir

#: A total of all tokens of the weighted sources: short sources are redistributed.
CORPUS = "corpus"
#: Leaves and weights that the driver plans with at most; more are an error, never cut.
MOST_LEAVES = 100_000
#: Buckets of hash values in which a leaf's running token sum is kept.
BUCKETS = 1024


@dataclass
class Node:
    name: tuple
    weight: float = 0.0
    tokens: int = 0
    repeats: int = 1
    budget: float = 0.0
    children: list["Node"] = field(default_factory=list)

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else self.tokens * self.repeats


def allot(node: Node, budget: float) -> None:
    """Gives a node its budget and its children theirs; what a child can't use goes to its siblings by their weights."""
    node.budget = min(budget, node.capacity())
    open_nodes, left = [c for c in node.children if c.capacity() > 0], node.budget
    while open_nodes and left > 1e-9:
        weights = sum(c.weight for c in open_nodes)
        share = (lambda c: c.weight / weights) if weights > 0 else (lambda c: 1 / len(open_nodes))
        full = [c for c in open_nodes if c.capacity() <= left * share(c)]
        if not full:
            for c in open_nodes:
                c.budget = left * share(c)
            break
        for c in full:  # these are filled; the rest of their shares is spread again over the others
            c.budget = c.capacity()
            left -= c.budget
        open_nodes = [c for c in open_nodes if c not in full]
    for c in node.children:
        if c.children:
            allot(c, c.budget)


def plan(leaves: list[tuple], weights: dict[str, tuple[float, int]], total: float | None = None, source_at: int = 0) -> Node:
    """The tree with budgets of (*path, tokens) leaves and {source: (target share, repeats)}; ``source_at`` is the source's place in a path."""
    of_source: dict[str, int] = {}
    usable = [(p, n) for *p, n in leaves if n > 0 and weights.get(p[source_at], (0, 0))[0] > 0]
    for p, n in usable:
        of_source[p[source_at]] = of_source.get(p[source_at], 0) + n
    root = Node(())
    for p, n in sorted(usable):
        share, repeats = weights[p[source_at]]
        weight, node = share * n / of_source[p[source_at]], root
        node.weight += weight
        for k in range(len(p)):
            name = tuple(p[: k + 1])
            if not node.children or node.children[-1].name != name:  # paths are sorted
                node.children.append(Node(name))
            node = node.children[-1]
            node.weight, node.tokens = node.weight + weight, node.tokens + n
        node.repeats = repeats
    if total is None:
        total = min((n * weights[s][1] * root.weight / weights[s][0] for s, n in of_source.items()), default=0.0)
    allot(root, total)
    return root


def leaves_of(node: Node) -> list[Node]:
    return [leaf for c in node.children for leaf in leaves_of(c)] if node.children else [node] * bool(node.name)


def weight_rows(weights: DataFrame) -> dict[str, tuple[float, int]]:
    """{folded source: (target share, most repeats)}; of repeated rows the last by share holds, a null share is 0, null repeats are 1."""
    rows = small_rows(weights.select(fold_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null"), MOST_LEAVES, "source weights")
    return {r.s: (float(r.target_share or 0.0), max(1, int(r.max_repeats or 1))) for r in sorted(rows, key=lambda r: (r.s, r.target_share or 0.0))}


def counted_documents(documents: DataFrame, weights: dict[str, tuple[float, int]], levels: tuple[str, ...], ranks_path: str | None = None) -> DataFrame:
    """(doc_id, levels, n_tokens), checkpointed: the corpus is encoded once for budgets, selection and report."""
    ensure_checkpoint_dir(documents.sparkSession)
    source = fold_name(F.col("source"))
    folded = {"source": source, "lang": fold_lang(F.col("lang"))} if "lang" in levels else {"source": source}
    columns = [(folded[x] if x in folded else F.coalesce(fold_name(F.col(x)), F.lit("-"))).alias(x) for x in levels]
    docs = documents.where(source.isin(*weights) if weights else F.lit(False)).where("doc_id is not null").select("doc_id", *columns, "text")
    counted = count_tokens(docs, ranks_path=ranks_path).groupBy("doc_id").agg(F.max(F.struct("n_tokens", *levels)).alias("d"))
    return counted.select("doc_id", *[f"d.{x}" for x in levels], "d.n_tokens").where("n_tokens > 0").checkpoint()


def mix(documents: DataFrame, weights: DataFrame, total: float | str | None = None, seed: int = 17, ranks_path: str | None = None, levels: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). The mixture has a row (doc_id, levels, n_tokens, epoch, tokens_used, place) for each use of a document,
    ``place`` being its seeded place in the epoch; the report a row for each weighted source with target and reached share, and with
    the tokens that the source has and those of them that no use reaches.
    ``total`` is in tokens, or CORPUS for as many as the weighted sources have. ``levels`` are columns of ``documents``, from the root on, and hold 'source'."""
    spark = documents.sparkSession
    keys = list(levels)
    by_source = weight_rows(weights)
    counted = counted_documents(documents, by_source, levels, ranks_path)
    leaves = small_rows(counted.groupBy(*keys).agg(F.sum("n_tokens").alias("n")), MOST_LEAVES, "leaves")
    if total == CORPUS:
        total = float(sum(r.n for r in leaves if by_source[r.source][0] > 0))
    root = plan([tuple(r) for r in leaves], by_source, total, levels.index("source"))
    rows = []
    for leaf in leaves_of(root):
        epochs = min(int(leaf.budget // leaf.tokens), leaf.repeats)
        rows.append((*leaf.name, epochs, int(leaf.budget - epochs * leaf.tokens + 0.5) if epochs < leaf.repeats else 0))
    budgets = spark.createDataFrame(rows, ", ".join(f"`{x}` string" for x in keys) + ", epochs int, rest bigint")
    docs = counted.join(budgets, keys).withColumn("h", F.xxhash64(F.lit(seed), F.col("epochs") + 1, "doc_id"))
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = docs.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("here"))
    before = sums.select(*keys, "bucket", F.coalesce(F.sum("here").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("upto", F.sum("n_tokens").over(within)).join(before, [*keys, "bucket"])
    part = F.greatest(F.least(F.col("rest") - F.col("before") - F.col("upto") + F.col("n_tokens"), F.col("n_tokens")), F.lit(0))
    uses = placed.withColumn("part", part).withColumn("uses", F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).where("uses > 0")
    mixture = uses.select("doc_id", *keys, "n_tokens", F.explode(F.sequence(F.lit(1), "uses")).alias("epoch"), "epochs", "part").select(
        "doc_id", *keys, "n_tokens", "epoch", F.when(F.col("epoch") > F.col("epochs"), F.col("part")).otherwise(F.col("n_tokens")).alias("tokens_used"),
        F.xxhash64(F.lit(seed), "epoch", "doc_id").alias("place"),
    )
    targets = spark.createDataFrame([(s, w, r) for s, (w, r) in by_source.items()], "source string, target_share double, max_repeats int")
    once = F.when(F.col("epochs") > 0, F.col("n_tokens")).otherwise(F.col("part"))
    reached = uses.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("epochs") + F.col("part")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum(once).alias("once"))
    there = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = targets.join(reached, "source", "left").join(there, "source", "left").select(
        "source", "target_share", "max_repeats", zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"),
        zero("available_tokens").alias("available_tokens"), (zero("available_tokens") - zero("once")).alias("left_out_tokens"))
    share = F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0))
    return mixture, report.withColumn("reached_share", share)
