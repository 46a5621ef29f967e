"""A breadth-first walk of commit graphs over all parents, of many repositories at once, in the order of a queue.

The queue's order of commits at one distance is the order of their paths from the head, each written as the numbers of the parents taken. So a commit's place is a label (distance, path)
that is smaller the earlier it comes, and labels can be improved in any order. Commits lie in blocks of bounded size by time; a round follows parents inside each block it reaches to the end
and hands labels to other blocks, so rounds grow with the blocks that a history crosses, not with its length.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut

#: Entries of a path other than first parents: -step * PARENTS + number of the parent; paths of one length compare as these lists do.
PARENTS = 1 << 16
_LABEL = "repo string, commit string, block int, distance long, path array<long>"


def _walked(key, rows, labels):
    """One block: rows(repo, commit, parents) and labels(repo, commit, distance, path, fresh); improved labels, and those for commits of other blocks."""
    import heapq

    import pandas as pd

    wide, block = 1 << 16, key[0]
    parents = {(r, c): p for r, c, p in zip(rows["repo"], rows["commit"], rows["parents"], strict=True)}
    best, heap, changed, sent = {}, [], {}, {}
    for repo, commit, distance, path, fresh in zip(labels["repo"], labels["commit"], labels["distance"], labels["path"], labels["fresh"], strict=True):
        node, label = (repo, commit), (int(distance), tuple(int(x) for x in path))
        if fresh:
            heap.append((label, node))
        elif node not in best or label < best[node]:
            best[node] = label
    heapq.heapify(heap)
    while heap:
        label, node = heapq.heappop(heap)
        if node not in parents or (node in best and best[node] <= label):
            continue
        best[node] = changed[node] = label
        distance, path = label[0] + 1, label[1]
        for p in parents[node]:
            ahead = (distance, path + (p["number"] - distance * wide,) if p["number"] else path)
            other = (node[0], p["commit"])
            if p["block"] == block:
                heapq.heappush(heap, (ahead, other))
            elif (p["block"], other) not in sent or ahead < sent[p["block"], other]:
                sent[p["block"], other] = ahead
    out = [(*n, block, d, list(p), False) for n, (d, p) in changed.items()] + [(*n, b, d, list(p), True) for (b, n), (d, p) in sent.items()]
    return pd.DataFrame(out, columns=["repo", "commit", "block", "distance", "path", "fresh"])


def _best(labels: DataFrame) -> DataFrame:
    return labels.groupBy("repo", "commit").agg(F.min(F.struct("distance", "path")).alias("l"), F.first("block").alias("block")).select("repo", "commit", "block", "l.distance", "l.path")


def walk_order(commits: DataFrame, heads: DataFrame, rows_per_block: int = 50_000) -> DataFrame:
    """(repo, commit, distance, path): all that the heads(repo, commit) reach in commits(repo, commit, commit_ts, parents), in the order of ``distance, path`` of each repository.
    A repeated commit counts once, with its smallest time and parents; a parent that isn't there ends the walk on its side, a head that isn't there begins none. Several heads of a repository begin together."""
    walked = _walked

    def step(key, rows, labels):
        return walked(key, rows, labels)

    once = commits.where("commit is not null").groupBy("repo", "commit").agg(F.min(F.struct("commit_ts", "parents")).alias("c")).select("repo", "commit", "c.commit_ts", "c.parents")
    blocks = max(1, -(-once.count() // rows_per_block))
    dealt = _cut(once.repartitionByRange(blocks, "repo", "commit_ts", "commit").withColumn("block", F.spark_partition_id()))
    edges = dealt.select("repo", "commit", F.posexplode("parents").alias("number", "parent"))
    placed = edges.join(dealt.select("repo", F.col("commit").alias("parent"), F.col("block").alias("there")), ["repo", "parent"])
    lists = placed.groupBy("repo", "commit").agg(F.array_sort(F.collect_list(F.struct("number", F.col("parent").alias("commit"), F.col("there").alias("block")))).alias("parents"))
    rows = _cut(dealt.select("repo", "commit", "block").join(lists, ["repo", "commit"], "left").withColumn("parents", F.coalesce("parents", F.array().cast(lists.schema["parents"].dataType))))
    fresh = dealt.join(heads.select("repo", "commit").distinct(), ["repo", "commit"], "left_semi").select("repo", "commit", "block", F.lit(0).cast("long").alias("distance"), F.array().cast("array<long>").alias("path"), F.lit(True).alias("fresh"))
    known, rounds = fresh.drop("fresh").limit(0), 0
    while not fresh.isEmpty():
        active = fresh.select("block").distinct()
        labels = fresh.unionByName(known.join(active, "block", "left_semi").withColumn("fresh", F.lit(False)))
        labels = labels.toDF(*labels.columns)  # columns of its own, beside those of rows
        new = _cut(rows.join(active, "block", "left_semi").groupBy("block").cogroup(labels.groupBy("block")).applyInPandas(step, f"{_LABEL.replace('repo string', 'repo ' + rows.schema['repo'].dataType.simpleString())}, fresh boolean"))
        known, rounds = known.unionByName(new.where("not fresh").drop("fresh")), rounds + 1
        known = _cut(_best(known)) if rounds % 8 == 0 else known
        fresh = new.where("fresh")
    return _best(known).drop("block")


def walk_history(commits: DataFrame, heads: DataFrame, most_commits: int = 1000, not_before: datetime | str | None = None, since_commit: str | None = None, all_parents: bool = True, rows_per_block: int = 50_000) -> DataFrame:
    """(repo, commit, commit_ts, is_merge, commit_idx): the walk's commits, numbered from 0 in each repository, at most ``most_commits``.

    The walk ends at the first commit that begins with ``since_commit``. Commits before ``not_before`` are left out and walked through; along first parents only, the walk ends at the first of them.
    A commit of several parents is a merge in both modes."""
    plain = commits.withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    followed = plain if all_parents else plain.withColumn("parents", F.slice("parents", 1, 1))
    facts = plain.groupBy("repo", "commit").agg(F.min(F.struct("commit_ts", "parents")).alias("c")).select("repo", "commit", "c.commit_ts", (F.size("c.parents") > 1).alias("is_merge"))
    found = facts.join(walk_order(followed, heads, rows_per_block), ["repo", "commit"]).withColumn("place", F.struct("distance", "path"))
    old = F.coalesce(F.col("commit_ts") < F.lit(not_before).cast(commits.schema["commit_ts"].dataType), F.lit(False)) if not_before is not None else F.lit(False)
    ends = (F.startswith("commit", F.lit(since_commit)) if since_commit else F.lit(False)) | (F.lit(False) if all_parents else old)
    if since_commit or (not all_parents and not_before is not None):
        last = found.where(ends).groupBy("repo").agg(F.min("place").alias("last"))
        found = found.join(last, "repo", "left").where("last is null or place < last").drop("last")
    order = Window.partitionBy("repo").orderBy("place")
    numbered = found.where(~old).withColumn("commit_idx", F.row_number().over(order) - 1).where(F.col("commit_idx") < most_commits)
    return numbered.select("repo", "commit", "commit_ts", "is_merge", F.col("commit_idx").cast("long").alias("commit_idx"))


def walked_files(walk: DataFrame, changes: DataFrame) -> DataFrame:
    """walk with ``file``: each path of changes(repo, commit, file, old_file) once, a rename with both; merges, and commits without changes, have one row without a file."""
    paths = changes.select("repo", "commit", F.explode(F.array_compact(F.array("file", "old_file"))).alias("file")).distinct()
    own = walk.where("not is_merge").join(paths, ["repo", "commit"], "left")
    return own.unionByName(walk.where("is_merge").withColumn("file", F.lit(None).cast("string")))
