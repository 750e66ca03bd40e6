"""How filters interact: what each removes in every order in which they could be applied.

The orders of the filters form a trie. Two prefixes with the same filters leave the same
rows whatever their order, so each set of filters is one state, visited once: the walk goes
depth first, holds the survivors of the states on its way as persisted DataFrames and
releases them when it turns back. At each state one aggregation counts, by part, what every
further filter removes from the actual survivors; these edges are all that a report over
the orders needs. With n filters there are 2^n states and n * 2^(n-1) edges for n! orders.

Whether a row fails a filter is worked out once, before the walk, so that survivors are
narrow rows without texts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails the filters A to D. A null text is an empty one."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) for each row of `docs`: its language, which filters it fails, its labels.

    E fails where a smaller doc_id has the same text, told by SHA-256: of the rows with one
    text those with the smallest id are first. Only (text, smallest id) pairs are joined
    back, on both, so that a text with very many copies isn't one join key. A row without
    an id never fails E and makes no other fail, and has no labels; rows that share id and text don't fail through each
    other. Null languages are empty. Of several labels of one document any that says so counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", *(c.alias(k) for k, c in text_failures(F.col("text")).items()), F.unhex(F.sha2("text", 256)).alias("same"))
    scratch = Scratch(docs.sparkSession, "filters")
    rows = scratch.write(rows, "judged")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = rows.join(first, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select("part", *"ABCD", later.alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def edges(rows: DataFrame, filters: list[str], counted: list[str], part: str = "part") -> DataFrame:
    """(part, state, filter, kept, removed, and removed_<c> for each of `counted`): one row for each edge of the trie and part.

    `rows` holds a boolean for each filter, true where the row fails, and booleans to count.
    `state` has bit k for the k-th filter. Every part has all edges, zeros included. An
    empty table gives no rows. Nulls in a filter's column don't fail.
    """
    scratch = Scratch(rows.sparkSession, "trie")
    own = rows.select(F.col(f"`{part}`").alias("part"), *(F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c) for c in [*filters, *counted]))
    parts = scratch.write(own.select("part").distinct(), "parts")
    seen: list[DataFrame] = []
    visited: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        visited.add(state)
        left = [k for k in range(len(filters)) if not state >> k & 1]
        # the state with all filters has no edge
        ahead = [k for k in left if len(left) > 1 and state | 1 << k not in visited]
        if ahead:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        sums = [F.struct(F.count_if(filters[k]).alias("removed"), *(F.count_if(F.col(filters[k]) & F.col(c)).alias(f"removed_{c}") for c in counted)).alias(filters[k]) for k in left]
        found = survivors.groupBy("part").agg(F.count("*").alias("n"), *sums)
        edge = F.explode(F.array(*(F.struct(F.lit(filters[k]).alias("filter"), F.col(filters[k])["removed"].alias("removed"), *(F.col(filters[k])[f"removed_{c}"].alias(f"removed_{c}") for c in counted)) for k in left)))
        out = found.select("part", F.lit(state).alias("state"), "n", edge.alias("e")).select("part", "state", (F.col("n") - F.col("e.removed")).alias("kept"), "e.*")
        seen.append(scratch.write(out, f"state-{state}"))
        for k in ahead:
            # a deeper visit may have been there meanwhile
            if state | 1 << k not in visited:
                visit(state | 1 << k, survivors.filter(~F.col(filters[k])).drop(filters[k]))
        if ahead:
            survivors.unpersist()

    visit(0, own)
    found = seen[0]
    for x in seen[1:]:
        found = found.unionByName(x)
    # parts that no row survives in still have the edge, with zeros
    some = [F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s in range((1 << len(filters)) - 1) for k, f in enumerate(filters) if not s >> k & 1]
    every = parts.select("part", F.explode(F.array(*some)).alias("e")).select("part", "e.*")
    return every.join(found, ["part", "state", "filter"], "left").na.fill(0)


def report(edges: DataFrame, filters: list[str], counted: list[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, removed_<c>, shapley) for all orders of the filters.

    The orders are a table of n! * n rows by the number of filters alone, joined with the
    edges that they walk along.
    """
    spark = edges.sparkSession
    place = {f: k for k, f in enumerate(filters)}
    n, full = len(filters), (1 << len(filters)) - 1
    steps = [("".join(o), i + 1, f, sum(1 << place[x] for x in o[:i])) for o in permutations(filters) for i, f in enumerate(o)]
    walks = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    size = F.bit_count("state")
    # orders in which a filter stands right after the filters of a state
    ways = F.element_at(F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)).cast("bigint") for s in range(n))), size + 1)
    bit = F.element_at(F.create_map(*(F.lit(x) for f in filters for x in (f, 1 << place[f]))), F.col("filter"))
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("state") == F.lit(full) - bit, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    found = edges.join(by_filter, ["part", "filter"]).join(F.broadcast(walks), ["state", "filter"])
    return found.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *(f"removed_{c}" for c in counted), "shapley")
