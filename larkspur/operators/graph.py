"""Graphs of records, tags and entities as edge tables; traversals are iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.search import rounded, small, top_k
from larkspur.session import scratch_dir


def sessions(events: DataFrame, by: str, micros: str, gap_micros: int, order: list[str]) -> DataFrame:
    """events with session: numbers from 0 that rise when a gap is longer than `gap_micros`."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = F.coalesce((F.col(micros) - F.lag(micros).over(w) > gap_micros).cast("int"), F.lit(0))
    return events.withColumn("larkspur_fresh", fresh).withColumn("session", F.sum("larkspur_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("larkspur_fresh")


def chain(rows: DataFrame, by: str, order: list[str], node: str) -> DataFrame:
    """rows with prev_id and next_id inside each session."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumns({"prev_id": F.lag(node).over(w), "next_id": F.lead(node).over(w)})


def follow(rows: DataFrame, by: str, order: list[str], node: str, hops: int, forward: bool = True) -> DataFrame:
    """(by, node, hop, reached): the next (or previous) nodes up to `hops` steps."""
    w = Window.partitionBy(by).orderBy(*order)
    step = F.lead if forward else F.lag
    steps = F.array(*[F.struct(F.lit(i).alias("hop"), step(node, i).over(w).alias("reached")) for i in range(1, hops + 1)])
    return rows.select(by, node, steps.alias("s")).select(by, node, F.explode("s").alias("s")).select(by, node, "s.hop", "s.reached").where(F.col("reached").isNotNull())


def tag_pairs(sets: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """(tag_a, tag_b, n): unordered pairs of tags that occur together in rows (key, tag); `most` tags a set."""
    listed = sets.groupBy(*key).agg(F.slice(F.array_sort(F.collect_set("tag")), 1, most).alias("tags"))
    a = F.explode("tags").alias("tag_a")
    pairs = listed.select("tags", a).select("tag_a", F.explode(F.filter("tags", lambda t: t > F.col("tag_a"))).alias("tag_b"))
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


def both_ways(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(weight).alias("weight"))
    return one.unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"), F.col(weight).alias("weight")))


def associated(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight, rank): the k tags that occur most often with each tag."""
    return top_k(both_ways(pairs, "tag_a", "tag_b", "n"), k, F.desc("weight"), F.asc("dst"), by="src")


def gaps(present: DataFrame, pairs: DataFrame, depth: int = 5, most: int = 10) -> DataFrame:
    """Tags that go with present ones (tag) but aren't there; the strongest `most`."""
    near = associated(pairs, depth).join(small(present.select(F.col("tag").alias("src")).distinct()), "src")
    missing = near.join(small(present.select(F.col("tag").alias("dst")).distinct()), "dst", "left_anti")
    return missing.groupBy(F.col("dst").alias("tag")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "tag").limit(most)


def strengthen(steps: DataFrame, most: int = 20) -> DataFrame:
    """(src, dst, weight): summed steps (a, b, weight), both ways, the strongest `most` links of each node."""
    summed = both_ways(steps.where(F.col("a") != F.col("b")), "a", "b", "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return top_k(summed, most, F.desc("weight"), F.asc("dst"), by="src").drop("rank")


def decay_edges(edges: DataFrame, factor: float, least: float) -> DataFrame:
    return edges.withColumn("weight", F.col("weight") * factor).where(F.col("weight") >= least)


def spread(edges: DataFrame, seeds: DataFrame, depth: int = 2, attenuation: float = 0.5, least: float = 0.01) -> DataFrame:
    """(node, activation): the strongest path from seeds (node, activation), weakened at every step; seeds excluded."""
    level, found = seeds.select("node", "activation"), None
    attenuated = 1.0
    for _ in range(depth):
        step = level.join(edges.select(F.col("src").alias("node"), "dst", "weight"), "node").select(F.col("dst").alias("node"), (F.col("activation") * F.col("weight") * attenuated).alias("activation"))
        level = step.where(F.col("activation") > least).groupBy("node").agg(F.max("activation").alias("activation"))
        found = level if found is None else found.unionByName(level)
        attenuated = attenuation
    best = found.groupBy("node").agg(F.max("activation").alias("activation"))
    return best.join(seeds.select("node"), "node", "left_anti")


def timing_update(steps: DataFrame, tau_ms: float = 30_000.0, up: float = 0.1, down: float = 0.05) -> DataFrame:
    """(src, dst, weight) of ordered steps (at, src, dst, gap_ms): forward links grow, backward ones shrink, in [0, 1] after each step."""
    change = F.exp(-F.col("gap_ms") / tau_ms)
    forward = steps.select("at", "src", "dst", (up * change).alias("d"))
    backward = steps.select("at", F.col("dst").alias("src"), F.col("src").alias("dst"), (-down * change).alias("d"))
    listed = forward.unionByName(backward).where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("steps"))
    weight = F.aggregate("steps", F.lit(0.0), lambda w, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w + s["d"])))
    return listed.select("src", "dst", weight.alias("weight")).where(F.col("weight") > 0)


def predictive_strength(edges: DataFrame, query_tags: DataFrame, result_tags: DataFrame) -> DataFrame:
    """(id, strongest, average) of links from query tags (tag) to each result's tags (id, tag)."""
    linked = edges.join(small(query_tags.select(F.col("tag").alias("src"))), "src")
    return result_tags.join(linked, result_tags["tag"] == linked["dst"]).groupBy("id").agg(F.max("weight").alias("strongest"), F.avg("weight").alias("average"))


def entities(rows: DataFrame) -> DataFrame:
    """(name, type): distinct trimmed and lower-cased names."""
    return rows.select(F.lower(F.trim("name")).alias("name"), "type").distinct()


def relations(rows: DataFrame, most: int = 32) -> DataFrame:
    """(src, dst, relation, weight): each repeat adds 1; the strongest `most` of each node."""
    counted = rows.groupBy("src", "dst", "relation").agg(F.count("*").cast("double").alias("weight"))
    return top_k(counted, most, F.desc("weight"), F.asc("dst"), F.asc("relation"), by="src").drop("rank")


def traverse(edges: DataFrame, start: DataFrame, hops: int, relation: str | None = None) -> DataFrame:
    """(start, node, depth): breadth first from start (node), over one relation if named; starts excluded."""
    used = edges.where(F.col("relation") == relation) if relation else edges
    level = start.select(F.col("node").alias("start"), "node")
    seen = level.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        nxt = level.join(used, level["node"] == used["src"]).select("start", F.col("dst").alias("node")).distinct()
        level = nxt.join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    return seen.where(F.col("depth") > 0)


def similar_names(rows: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance): pairs of one type whose names differ by 1 to `most` edits.

    Names meet on deletion variants, not all with all: two names within `most` edits share a string that
    arises from each by at most `most` deletions.
    """
    variants = F.array(F.col("name"))
    for _ in range(most):
        variants = F.array_distinct(F.concat(variants, F.flatten(F.transform(variants, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))))))
    keyed = rows.select("type", "name", F.explode(variants).alias("variant"))
    a, b = keyed.select("type", "variant", F.col("name").alias("a")), keyed.select("type", "variant", F.col("name").alias("b"))
    pairs = a.join(b, ["type", "variant"]).where(F.col("a") < F.col("b")).select("type", "a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance").between(1, most))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the folder that all executors share."""
    path = scratch_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each component of undirected edges (a, b), by alternating stars."""
    current = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        tight = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = settle(tight)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now


def merge_entities(rows: DataFrame, most: int = 2) -> DataFrame:
    """(type, name, merged): names within `most` edits take the shortest, then first, name of their group."""
    pairs = similar_names(rows, most)
    key = lambda n: F.concat_ws("\u0001", "type", n)
    labels = components(pairs.select(key("a").alias("a"), key("b").alias("b")))
    named = rows.withColumn("node", key("name")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("best"))
    return named.join(best, "label").select("type", "name", F.col("best.name").alias("merged"))


def promote(edges: DataFrame, mentions: DataFrame, least: float = 3.0) -> DataFrame:
    """(a, b): entities of strongly linked records, as related; mentions are (id, entity)."""
    strong = edges.where(F.col("weight") >= least)
    a = mentions.select(F.col("id").alias("src"), F.col("entity").alias("a"))
    b = mentions.select(F.col("id").alias("dst"), F.col("entity").alias("b"))
    return strong.join(a, "src").join(b, "dst").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def expand(hits: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(id, score, via): candidates beside hits (id, score): linked records, and neighbours in time; the best of each.

    edges: (src, dst, weight); links: (id, next_id).
    """
    seeds = small(hits.select("id", "score"))
    heb = edges.join(seeds, edges["src"] == seeds["id"]).select(F.col("dst").alias("cid"), (F.col("score") * F.least(F.col("weight") / 5, F.lit(1.0)) * 0.3).alias("s"), F.lit("link").alias("via"))
    fwd = links.where(F.col("next_id").isNotNull()).join(seeds, "id").select(F.col("next_id").alias("cid"), (F.col("score") * 0.8).alias("s"), F.lit("next").alias("via"))
    seeds2 = seeds.select(F.col("id").alias("next_id"), "score")
    back = links.join(seeds2, "next_id").select(F.col("id").alias("cid"), (F.col("score") * 0.7).alias("s"), F.lit("previous").alias("via"))
    every = heb.unionByName(fwd).unionByName(back)
    best = every.groupBy("cid").agg(F.max(F.struct("s", "via")).alias("b")).select(F.col("cid").alias("id"), rounded(F.col("b.s")).alias("score"), F.col("b.via").alias("via"))
    return best.join(seeds.select("id"), "id", "left_anti")


