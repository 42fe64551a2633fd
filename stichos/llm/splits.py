"""Splits that keep related records together: groups of files, and grouped iterative stratification over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected
from ..session import cut

#: Kinds of links that bind files.
BINDING = ("reprint-of", "joins", "duplicate-of")
#: Groups with more than this part of all records are joined by broadcast, as there are few; buckets in which equal groups are ranked.
HEAVY, BUCKETS = 1 / 2000, 4096
#: Passes of exchanges after the greedy one, at most; they end earlier where nothing gets better.
PASSES = 50
#: Values of Roman letters, and what a well-formed number looks like.
ROMAN_LETTERS = (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))
ROMAN = "^(?=.)m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def roman_value(text: Column) -> Column:
    """Value of a well-formed lower-case Roman number, of any size; null for other strings."""
    table = F.create_map(*[F.lit(x) for pair in ROMAN_LETTERS for x in pair])
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: table[c])
    # a letter before a greater one is taken off
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(text.rlike(ROMAN), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def file_key(name: Column) -> Column:
    """Series, volume and number of a file, however written; a name of another shape is its own key, a blank one has none.

    Case, the signs between the parts, leading zeros, an ending .xml, spaces around, and Roman volumes make no difference;
    a letter after the number does.
    """
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"(?U)\s", " "))), r"\.xml$", "")
    parts = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n = F.size(parts)
    volume, number = F.get(parts, n - 2), F.get(parts, n - 1)
    volume = F.when(volume.rlike(r"^\d+$"), F.regexp_replace(volume, r"^0+(?=\d)", "")).otherwise(roman_value(volume).cast("string"))
    shaped = (n >= 3) & number.rlike(r"^\d+\p{L}*$") & volume.isNotNull()
    key = F.concat_ws(".", F.concat_ws(".", F.slice(parts, 1, F.greatest(n - 2, F.lit(0)))), volume, F.regexp_replace(number, r"^0+(?=\d)", ""))
    return F.when(shaped, key).when(n > 0, plain)


def components(file_links: DataFrame) -> DataFrame:
    """(key, component) of the files that binding links join, over any number of links."""
    bound = file_links.filter(F.col("link_type").isin(*BINDING)).select(file_key(F.col("from_file")).alias("a"), file_key(F.col("to_file")).alias("b"))
    return connected(bound, "a", "b").withColumnsRenamed({"node": "key"})


def grouped(files: DataFrame, file: str, file_links: DataFrame) -> DataFrame:
    """files with the columns key and component added; rows without a file name have null in both."""
    keyed = files.withColumn("key", file_key(F.col(file)))
    return keyed.join(components(file_links), "key", "left").withColumn("component", F.coalesce("component", "key"))


def file_names(ab: DataFrame, dev_case: DataFrame) -> DataFrame:
    """All file names, as written: middle pieces of block ids, and files of cases."""
    a = ab.select(F.get(F.split("id", "/"), F.lit(1)).alias("file"))
    return a.unionByName(dev_case.select(F.col("file_id").alias("file"))).filter(F.length("file") > 0).distinct()


def classes(files: DataFrame) -> DataFrame:
    """(file, component, n_files): each name with the group that it belongs to, and how many names that has; names without one are left out."""
    own = files.filter(F.col("component").isNotNull()).select("file", "component").distinct()
    size = own.groupBy("component").agg(F.count("*").alias("n_files"))
    return own.join(size, "component").select("file", "component", "n_files")


def found(classes_: DataFrame) -> DataFrame:
    """Pairs of different names of one group: file_a < file_b."""
    own = classes_.filter("n_files > 1")
    a, b = own.select("component", F.col("file").alias("file_a")), own.select("component", F.col("file").alias("file_b"))
    return a.join(b, "component").filter("file_a < file_b").select("file_a", "file_b")


def place(kinds: dict[tuple, int], shares: dict[str, float]) -> dict[tuple, dict[str, int]]:
    """How many of the groups of each kind go to each split. kinds: numbers of groups by label vector ((label, amount), ...).

    Grouped iterative stratification: the label with least left comes first, its largest groups first, each group going to the split
    that still needs most of the label; equal groups are placed together, as if one by one. Then groups are moved, and groups of two
    kinds exchanged, as long as that brings the amounts of the labels closer to the shares.
    """
    order = sorted(shares)
    labels = sorted({label for kind in kinds for label, _ in kind})
    number = {label: i for i, label in enumerate(labels)}
    names = sorted(kinds)
    vector = np.zeros((len(names), len(labels)))
    for row, kind in zip(vector, names, strict=True):
        for label, n in kind:
            row[number[label]] = n
    count = np.array([kinds[k] for k in names], np.int64)
    part = np.array([shares[s] for s in order])
    want = part[:, None] * (vector.T @ count)[None, :]
    out = _greedy(vector, count, want)
    _exchange(vector, out, want)
    return {k: {s: int(n) for s, n in zip(order, row, strict=True) if n} for k, row in zip(names, out, strict=True)}


def _greedy(vector: np.ndarray, count: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Groups of each kind by split; want: amounts by split and label."""
    need, room, left = want.copy(), want.sum(1), vector.T @ count
    out = np.zeros((len(count), len(want)), np.int64)
    open_ = np.ones(len(count), bool)
    while (left > 0).any():
        label = int(np.argmin(np.where(left > 0, left, np.inf)))
        own = np.flatnonzero(open_ & (vector[:, label] > 0))
        for k in own[np.argsort(-vector[own, label], kind="stable")]:
            given = _filled(need[:, label], room, vector[k, label], int(count[k]))
            out[k] = given
            need -= given[:, None] * vector[k][None, :]
            room -= given * vector[k].sum()
            left -= count[k] * vector[k]
            open_[k] = False
        left[label] = 0
    return out


def _filled(need: np.ndarray, room: np.ndarray, size: float, n: int) -> np.ndarray:
    """n groups of one size, each in turn to the split with the greatest need, then room: as many at once as do not change the turn."""
    given = np.zeros(len(need), np.int64)
    if n > len(need):  # a level to which the needs sink, less one group each, then one by one
        high = np.sort(need)[::-1]
        for k in range(len(high), 0, -1):
            level = (high[:k].sum() - size * n) / k
            if k == 1 or high[k - 1] >= level:
                break
        given = np.maximum(0, np.floor((need - level) / size) - 1).astype(np.int64)
    for _ in range(n - int(given.sum())):
        now = need - given * size
        given[max(range(len(need)), key=lambda s: (now[s], room[s] - given[s] * size, -s))] += 1
    return given


def _exchange(vector: np.ndarray, out: np.ndarray, want: np.ndarray) -> None:
    """Moves groups between splits while the squared distances from want, each label by its amount, shrink; changes out.

    Each pass tries, for every pair of splits, to move groups of each kind, and to exchange a group of each kind for one of the kind
    that mends best what it does.
    """
    weight = 1 / np.maximum(want.sum(0), 1)
    off = out.T @ vector - want
    cost = (vector**2 * weight).sum(1)
    for _ in range(PASSES):
        better = False
        for a in range(len(want)):
            for b in range(len(want)):
                if a == b:
                    continue
                # moving one group of kind k from a to b changes the distance by 2 (slope[k] + cost[k])
                slope = (vector * ((off[b] - off[a]) * weight)[None, :]).sum(1)
                for k in np.flatnonzero((out[:, a] > 0) & (slope + cost < -1e-9)):
                    now = float((vector[k] * ((off[b] - off[a]) * weight)).sum())
                    n = min(int(out[k, a]), max(0, round(-now / (2 * cost[k]))))
                    if n and n * (now + n * cost[k]) < -1e-9:
                        out[k, a] -= n
                        out[k, b] += n
                        off[a] -= n * vector[k]
                        off[b] += n * vector[k]
                        better = True
        better |= _swap(vector, out, off, weight)
        if not better:
            break


def _swap(vector: np.ndarray, out: np.ndarray, off: np.ndarray, weight: np.ndarray) -> bool:
    """One round of exchanges of a group of one kind for a group of another; the pairs are looked for among the kinds of most effect."""
    done = False
    for a in range(len(off)):
        for b in range(a + 1, len(off)):
            gap = (off[b] - off[a]) * weight
            slope = vector @ gap
            mine, theirs = np.flatnonzero(out[:, a] > 0), np.flatnonzero(out[:, b] > 0)
            mine, theirs = mine[np.argsort(slope[mine], kind="stable")[:64]], theirs[np.argsort(-slope[theirs], kind="stable")[:64]]
            change = vector[mine][:, None, :] - vector[theirs][None, :, :]
            gain = change @ gap + (change**2 * weight).sum(2)
            if gain.size and gain.min() < -1e-9:
                i, j = np.unravel_index(int(gain.argmin()), gain.shape)
                k, other = mine[i], theirs[j]
                out[k, a], out[k, b] = out[k, a] - 1, out[k, b] + 1
                out[other, a], out[other, b] = out[other, a] + 1, out[other, b] - 1
                off[a] -= vector[k] - vector[other]
                off[b] += vector[k] - vector[other]
                done = True
    return done


def assign(records: DataFrame, shares: DataFrame) -> DataFrame:
    """records(kind, rec_key, label, component) with split_name added; all records of a component get one split.

    Records without a component are components of their own.  Each component is placed as a whole.  The driver sees one row for each
    different vector of label amounts, not the components; those of one vector, which are alike to the method, are ranked by a hash
    and dealt out in the numbers it gives.  Splits without a positive share get nothing; an empty shares table raises ValueError.
    """
    wanted = {r.split_name: float(r.share) for r in shares.collect() if r.split_name is not None and r.share and r.share > 0}
    if not wanted:
        raise ValueError("no split has a share")
    wanted = {s: x / sum(wanted.values()) for s, x in wanted.items()}
    own = F.coalesce(F.concat(F.lit("f:"), "component"), F.concat(F.lit("r:"), "kind", F.lit(":"), "rec_key"))
    records = cut(records.withColumn("component", own))
    each = records.groupBy("component", "label").agg(F.count("*").alias("n"))
    # a component has at most one entry for each label
    vectors = each.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("v"), F.sum("n").alias("size"))
    vectors = cut(vectors.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")))
    kinds = {tuple((x.label, x.n) for x in r.v): r.n for r in vectors.groupBy("v").agg(F.count("*").alias("n")).collect()}
    plan = []
    for kind, given in place(kinds, wanted).items():
        before = 0
        for split in sorted(given):
            plan.append((kind, split, before, before + given[split]))
            before += given[split]
    spark = records.sparkSession
    plan_ = F.broadcast(spark.createDataFrame(plan, "v array<struct<label:string,n:long>>, split_name string, first long, end long"))
    # rank within the components of one vector: those of the buckets before, then the place in its bucket
    sizes = vectors.groupBy("v", "bucket").agg(F.count("*").alias("k"))
    earlier = sizes.withColumn("before", F.sum("k").over(Window.partitionBy("v").orderBy("bucket")) - F.col("k")).drop("k")
    ranked = vectors.join(earlier, ["v", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("v", "bucket").orderBy("component")) - 1)
    placed = cut(ranked.join(plan_, "v").filter("rank >= first and rank < end").select("component", "split_name", "size"))
    heavy = F.col("size") > HEAVY * (records.count() or 1)
    few = F.broadcast(placed.filter(heavy).select("component", F.col("split_name").alias("_own")))
    rest = placed.filter(~heavy).select("component", F.col("split_name").alias("_other"))
    marked = records.join(few, "component", "left")
    large = marked.filter("_own is not null").withColumnRenamed("_own", "split_name")
    return large.unionByName(marked.filter("_own is null").drop("_own").join(rest, "component").withColumnRenamed("_other", "split_name"))


def records(ab: DataFrame, dev_case: DataFrame, file_links: DataFrame) -> DataFrame:
    """Each block and case once, with its label (kind and corpus) and component (null if it names no file)."""
    a = ab.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("corpus_id").alias("corpus_id")).select(F.lit("ab").alias("kind"), F.col("id").alias("rec_key"), "corpus_id", F.get(F.split("id", "/"), F.lit(1)).alias("file"))
    b = dev_case.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.min("corpus_id").alias("corpus_id"), F.min(F.when(F.length("file_id") > 0, F.col("file_id"))).alias("file"))
    b = b.select(F.lit("dev_case").alias("kind"), F.col("case_id").cast("string").alias("rec_key"), "corpus_id", "file")
    label = F.concat_ws(":", "kind", F.coalesce("corpus_id", F.lit("")))
    return grouped(a.unionByName(b), "file", file_links).withColumn("label", label)


def achieved(assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """Per kind and split: n, share and target."""
    n = assigned.groupBy("kind", "split_name").agg(F.count("*").alias("n"))
    total = n.groupBy("kind").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "kind").join(F.broadcast(shares.select("split_name", F.col("share").alias("target"))), "split_name").select("kind", "split_name", "n", (F.col("n") / F.col("total")).alias("share"), "target")
