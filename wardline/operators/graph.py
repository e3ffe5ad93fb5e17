"""The host access graph: edges, distances, distance to visited hosts, investigation subgraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import FeatureConfig
from wardline.operators.skew import union_all
from wardline.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once (the largest ``kind`` wins on duplicates)."""
    if "kind" not in edges.columns:
        edges = edges.withColumn("kind", F.lit(None).cast("string"))
    both = edges.select("src", "dst", "kind").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    return both.groupBy("src", "dst").agg(F.max("kind").alias("kind"))


def _next_ring(ring: DataFrame, inner: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes one hop further. In an undirected graph a neighbour of ring d lies in ring d-1, d or d+1,
    so only the two latest rings need subtracting."""
    grown = (ring.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("_nb")), "dst")
             .select("src", F.col("_nb").alias("dst")).distinct())
    return grown.join(ring, ["src", "dst"], "left_anti").join(inner, ["src", "dst"], "left_anti")


# A graph of at most this many hosts is searched on its own per source: all pairs are 9 million.
SMALL_GRAPH_HOSTS = 3_000
# Below this many (visit, host) pairs distances are matched in one round.
ONE_ROUND_PAIRS = 20_000_000


def _links(edges: DataFrame, broadcast_rows: int) -> tuple[DataFrame, int, bool]:
    """Directed links written out, the number of hosts, and whether the links may be broadcast."""
    links = cut(undirected(edges).select("src", "dst").where("src != dst"))
    n_links, n_hosts = links.agg(F.count(F.lit(1)), F.count_distinct("src")).first()
    return links, n_hosts, n_links <= broadcast_rows


def _bfs_from(adjacency):
    """Per-batch helper: hop counts from each source of a batch over a small broadcast graph."""
    def run(batches):
        graph = adjacency.value
        for batch in batches:
            rows = []
            for source in batch["src"]:
                seen, ring, hop = {source: 0}, [source], 0
                while ring:
                    hop += 1
                    ring = [n for n in {m for h in ring for m in graph.get(h, ())} if n not in seen]
                    seen.update(dict.fromkeys(ring, hop))
                rows.extend((source, host, d) for host, d in seen.items())
            yield pd.DataFrame(rows, columns=["src", "dst", "d"])
    return run


def distances(sources: DataFrame, edges: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """Hop counts (src, dst, d) from every source host to each host it can reach, itself included.

    A graph of checked small size is broadcast and each source searched on its own; a larger one is
    searched breadth-first by joins, one round per hop, until no new pair appears.
    """
    links, n_hosts, small_links = _links(edges, broadcast_rows)
    return _distances(sources, links, n_hosts, small_links)


def _distances(sources: DataFrame, links: DataFrame, n_hosts: int, small_links: bool) -> DataFrame:
    sources = sources.select(F.col("host").alias("src")).distinct()
    if n_hosts <= SMALL_GRAPH_HOSTS:
        spark = links.sparkSession
        adjacency = {r["src"]: r["nbs"] for r in
                     links.groupBy("src").agg(F.collect_list("dst").alias("nbs")).collect()}
        schema = T.StructType([sources.schema["src"], T.StructField("dst", sources.schema["src"].dataType),
                               T.StructField("d", T.IntegerType())])
        spread = sources.repartition("src")
        return spread.mapInPandas(_bfs_from(spark.sparkContext.broadcast(adjacency)), schema)
    links = F.broadcast(links) if small_links else links
    ring = cut(sources.select("src", F.col("src").alias("dst")))
    inner, found, hop = ring.limit(0), ring.withColumn("d", F.lit(0)), 0
    while True:
        hop += 1
        grown = cut(_next_ring(ring, inner, links))
        if grown.isEmpty():
            return found
        found = found.unionByName(grown.withColumn("d", F.lit(hop)))
        inner, ring = ring, grown


def first_visits(events: DataFrame) -> DataFrame:
    """The first event of every (user, host): combined on the map side, so a heavy user is no burden."""
    return (events.groupBy("user_id", "host").agg(F.min(F.struct("us", "event_id")).alias("_o"))
            .select("user_id", "host", "_o.us", "_o.event_id"))


def nearest_visited(visits: DataFrame, edges: DataFrame, cfg: FeatureConfig, since: int | None = None) -> DataFrame:
    """(event_id, user_id, host, graph_dist_from_history) of every first visit that is not the user's first event.

    Distance to the nearest host the user visited earlier. Rings of hosts around the newly visited
    hosts are matched with the user's visits by equality, so no pairs of a user's hosts are formed,
    and a visit drops out at its first match. Hosts outside the graph, or without any earlier visit
    in reach, get ``unreachable``. ``since``: only visits from this time on are answered; the earlier ones
    are hosts to be reached.
    """
    visits = cut(visits.withColumn("_visit", F.monotonically_increasing_id()))  # event ids may repeat or be null
    links, n_hosts, small_links = _links(edges, cfg.broadcast_rows)
    starts = visits.groupBy("user_id").agg(F.min(F.struct("us", "event_id", "_visit")).alias("_o"))
    pending = visits.join(starts.select("_o._visit"), "_visit", "left_anti")
    asked = visits
    if since is not None:
        pending = pending.where(F.col("us") >= since)
        asked = visits.where(F.col("us") >= since)
    earlier = visits.select("user_id", F.col("host").alias("dst"), F.col("us").alias("_us"),
                            F.col("event_id").alias("_id"))
    hosts = pending.select("host").distinct()
    if n_hosts <= SMALL_GRAPH_HOSTS:
        table = _distances(hosts, links, n_hosts, small_links)
        if asked.count() * n_hosts <= ONE_ROUND_PAIRS:
            rings = iter([table.where("d > 0")])
        else:
            rings = _tabulated_rings(cut(table))
    else:
        rings = _grown_rings(hosts, F.broadcast(links) if small_links else links)
    answers = []
    ring = next(rings, None)
    while ring is not None:
        hit = cut(pending.join(ring, pending.host == ring.src)
                  .join(earlier, ["user_id", "dst"])
                  .where(F.struct("_us", "_id") < F.struct("us", "event_id"))
                  .groupBy("_visit").agg(F.min("d").alias("graph_dist_from_history")))
        answers.append(hit)
        pending = pending.join(hit, "_visit", "left_anti")
        try:
            ring = rings.send(pending) if hasattr(rings, "send") else next(rings)
        except StopIteration:
            break
    answers.append(pending.select("_visit", F.lit(cfg.unreachable).alias("graph_dist_from_history")))
    return (union_all(answers).join(visits.select("_visit", "event_id", "user_id", "host"), "_visit")
            .select("event_id", "user_id", "host", "graph_dist_from_history"))


def _tabulated_rings(table: DataFrame):
    """Distance 1 first, which settles most visits, then 2 and 3, then the rest."""
    for low, high in ((1, 1), (2, 3), (4, SMALL_GRAPH_HOSTS)):
        yield table.where(F.col("d").between(low, high))


def _grown_rings(hosts: DataFrame, links: DataFrame):
    """Rings grown hop by hop, only around the hosts of visits that are still pending."""
    ring = cut(hosts.select(F.col("host").alias("src")).join(links, "src", "left_semi")
               .select("src", F.col("src").alias("dst")))
    inner, hop = ring.limit(0), 0
    while True:
        hop += 1
        grown = cut(_next_ring(ring, inner, links))
        if grown.isEmpty():
            return
        pending = yield grown.withColumn("d", F.lit(hop))
        wanted = cut(pending.select(F.col("host").alias("src")).distinct())
        if wanted.isEmpty():
            return
        inner, ring = ring.join(wanted, "src", "left_semi"), grown.join(wanted, "src", "left_semi")


def neighbours(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, host) of the hosts next to each given (user_id, host)."""
    return hosts.join(links.select(F.col("src").alias("host"), "dst"), "host").select("user_id", F.col("dst").alias("host")).distinct()


def investigation_nodes(users: DataFrame, events: DataFrame, normal_hosts: DataFrame,
                        links: DataFrame) -> DataFrame:
    """(user_id, host, role) for every user under investigation; ``links`` holds both directions.

    Normal hosts, touched hosts and neighbours of touched hosts; a host is ``touched`` before
    ``normal`` before ``context``. Hosts outside the graph are left out.
    """
    touched = (events.join(users, "user_id", "left_semi").where(F.col("host").isNotNull())
               .select("user_id", "host").distinct())
    normal = normal_hosts.join(users, "user_id", "left_semi").select("user_id", "host").distinct()
    ranked = (touched.withColumn("_r", F.lit(0))
              .unionByName(normal.withColumn("_r", F.lit(1)))
              .unionByName(neighbours(touched, links).withColumn("_r", F.lit(2))))
    in_graph = links.select(F.col("src").alias("host")).distinct()
    role = F.element_at(F.array(F.lit("touched"), F.lit("normal"), F.lit("context")), F.min("_r") + 1)
    return ranked.join(in_graph, "host", "left_semi").groupBy("user_id", "host").agg(role.alias("role"))


def investigation_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with both ends among a user's nodes, each undirected edge once."""
    once = links.where("src < dst")
    a = nodes.select("user_id", F.col("host").alias("src"))
    b = nodes.select("user_id", F.col("host").alias("dst"))
    return a.join(once, "src").join(b, ["user_id", "dst"], "left_semi").select("user_id", "src", "dst", "kind")
