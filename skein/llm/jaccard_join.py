"""Operator 7: all links of Jaccard similarity 0.8 or more between sets of five-word shingles, and their components.

Documents with equal sets form a class; everything below handles one member of each class, its representative, under a
64-bit number. Pairs are always confirmed on whole sets.

1. Screening. A set of n that links with another misses at most e = n // 5 of its shingles there. Of the e + l shingles
   with the smallest hashes, two linked sets share l. Only documents that have so many of these in common with others
   stay; this moves some third of the shingles of each text once and drops most texts.
2. Quick links. Each set that is left has BANDS combinations of the QUICK shingles that come first in an order of their
   own; a set with equal combinations is compared with the shortest one of the group only. This links most near copies.
3. Signatures of what is left, from whole texts. Only shingles that sets of different components have count, and a set
   without enough of these is done. They are ordered by document frequency, rare ones first. A rare shingle (in at most
   RARE sets) is a signature of its own. Frequent ones fall into classes by hash, and only pairs of one class are
   signatures. An adversary who removes e shingles must not remove all signatures, so the prefix is extended: it goes on
   until (rare) + sum over classes of (frequent - 1) exceeds e. The number of classes grows with n, so a set has some
   2.5 e pairs and not e * e; sets near a step of that number emit both. If x and y link, the one whose prefix ends
   first has a signature within both prefixes.
4. Rounds. In each group of equal signatures a centre is compared with the members that are not yet in its component;
   components are updated and the next round takes other centres, in groups that still hold several components. Once a
   round finds few new links, the members of different components are compared by blocks of PART members. A pair comes
   out of a block only if sketches don't rule it out: bit b of a sketch is the parity of the number of shingles that
   fall on b, so two sketches differ in at most as many bits as the sets differ in shingles, and linked sets of n and m
   differ in at most (n + m) / 9. So no link between components is lost, and no group emits all its pairs.

Defined results: documents without words (null, empty, white space) have n_shingles 0 and are their own component; fewer
than five words are one shingle; an empty table stays empty; further columns play no part. Rows are told apart by a
number of their own, so neither null nor repeated ids are merged: a component has the smallest id of its rows, null if
none has one. Shingles are compared by 64-bit hashes, rows are found again by 128-bit hashes of id and text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.hashing import mix, shingle_sets

WORDS = 5
#: A shingle of at most so many sets is rare.
RARE = 8
#: Combinations for quick links, and shingles in each.
BANDS, QUICK = 6, 3
#: Shingles that one block of pairs holds in verification, on average, and pairs of one centre in it.
BLOCK_SHINGLES, BLOCK_PAIRS = 1 << 20, 256
#: Members of one signature in a block of the last comparison; small groups share a block of so many rows.
PART, BUNDLE = 512, 20_000
#: Bits of a set's sketch.
SKETCH = 1024
#: Rounds of centres end once one finds less than this share of the links that the best one found.
FEW = 0.02
#: Rows of up to so many addresses (some 40 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def misses(n):
    """Shingles of a set of n that a linked set may lack: n - ceil(0.8 n)."""
    return n // 5


def extra(n):
    """How many shingles of the screening prefix two linked sets share at least, by the size of the smaller one."""
    return misses(n) // 2 + 1


def classes(n: int) -> int:
    """Classes of frequent shingles for sets of n: a power of two near a quarter of the misses."""
    return 1 << max(0, (max(1, misses(n) // 4)).bit_length() - 1)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set: sums of scrambled hashes."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the number of shingles whose hash falls on it."""
    ones = np.bincount((mix(s) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.int64)


def combinations(s: np.ndarray) -> np.ndarray:
    """One number for each of the BANDS orders: a hash of the QUICK shingles that come first in it."""
    out = np.empty(BANDS, np.uint64)
    for k in range(BANDS):
        h = mix(s ^ mix(np.uint64(k + 1)))
        first = np.sort(np.partition(h, QUICK - 1)[:QUICK] if len(h) > QUICK else h)
        one = np.uint64(k)
        with np.errstate(over="ignore"):
            for x in first:
                one = mix(one * np.uint64(5) + x)
        out[k] = one
    return out.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one column."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets_of(batches):
    """The batches, cut into runs of bounded size, and the sets of their texts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in common.batches_of_bytes(texts):
            yield batch.slice(a, b - a), shingle_sets(texts[a:b], WORDS)


def _screened(batches):
    for batch, sets in _sets_of(batches):
        keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
        prefixes = [s[: misses(len(s)) + extra(len(s))] for s in sets]
        made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(prefixes)]
        kept = ["doc_id", "at", "at2", "row"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n", "k1", "k2", "prefix"])


def _whole(batches):
    for batch, sets in _sets_of(batches):
        made = [_lists(sets), _lists([sketch(s) for s in sets]), _lists([combinations(s) for s in sets])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), *made], ["key", "n", "shingles", "sketch", "bands"])


def signatures(n: int, counts: np.ndarray, shingles: np.ndarray, rare: int = RARE) -> np.ndarray:
    """Signatures of a set of n whose shingles of at least two sets, in order of document frequency, are given."""
    out, tokens = [], shingles.astype(np.int64).view(np.uint64)
    need = misses(n) + 1 - (n - len(tokens))  # shingles that only this set has come first in the order
    if need <= 0 or not len(tokens):
        return np.empty(0, np.int64)
    few = counts <= rare
    for m in sorted({classes(n), classes(n + n // 4)}):  # a linked set has at most 1.25 n
        label = (mix(tokens ^ np.uint64(m)) % np.uint64(m)).astype(np.int64)
        gain = np.ones(len(tokens), np.int64)
        frequent = np.flatnonzero(~few)
        gain[frequent[np.unique(label[frequent], return_index=True)[1]]] = 0  # the first of each class
        reached = np.cumsum(gain) >= need
        end = int(reached.argmax()) + 1 if reached.any() else len(tokens)
        out.append(mix(tokens[:end][few[:end]]))
        pick = frequent[frequent < end]
        order = pick[np.argsort(label[pick], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(group) > 1:
                t = np.sort(tokens[group])
                i, j = np.triu_indices(len(t), 1)
                with np.errstate(over="ignore"):
                    out.append(mix(mix(t[i] * np.uint64(3) + np.uint64(m)) + t[j]))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def components(links: DataFrame, tables: common.Tables) -> DataFrame:
    """key, label of every key in links (a, b): the smallest key that is reachable.

    In each round a key goes to its smallest neighbour's smallest neighbour (or stays, if it is smaller), links move with their
    keys, and those that have become loops go. So links get fewer at every round, and a group's links are followed once."""
    keys = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    labels = tables.write(keys.withColumn("label", F.col("key")), "labels")
    edges = tables.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "key")
        further = low.select(F.col("key").alias("label"), F.col("label").alias("further"))
        moves = tables.write(low.join(further, "label").select("key", F.col("further").alias("to")), "moves")
        one, two = moves.toDF("a", "x"), moves.toDF("b", "y")
        moved = edges.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new_edges = tables.write(moved, "links")
        new = labels.join(moves.toDF("label", "to"), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
        new = tables.write(new, "labels")
        tables.drop(edges, labels, moves)
        edges, labels = new_edges, new
    tables.drop(edges)
    return labels


def _verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Those of the pairs (a, b) whose sets (key, n, shingles) link."""
    place = {k: i for i, k in enumerate(sets["key"].to_pylist())}
    one, two = (np.array([place[k] for k in pairs[c].to_pylist()], np.int64) for c in "ab")
    shingles = sets["shingles"].combine_chunks()
    n = shingles.value_lengths().to_numpy().astype(np.int64)
    ends, flat = np.cumsum(n), shingles.flatten().to_numpy()
    linked = np.zeros(len(one), bool)
    order = np.argsort(two, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(two[order])) + 1):
        b = two[run[0]] if len(run) else 0
        centre = np.sort(flat[ends[b] - n[b] : ends[b]]) if len(run) else flat[:0]
        for p in run:
            a = one[p]
            mine = flat[ends[a] - n[a] : ends[a]]
            at = np.searchsorted(centre, mine)
            at[at == len(centre)] = 0
            i = int((centre[at] == mine).sum())
            linked[p] = i * 100 >= (n[a] + n[b] - i) * 80
    return pairs.select(["a", "b"]).filter(pa.array(linked))


def verified(pairs: DataFrame, whole: DataFrame, tables: common.Tables) -> DataFrame:
    """Those of the pairs (a, b) that link, where b is a centre that may have many partners.

    Pairs are dealt to blocks by their centre, those of a frequent centre to several, so a set moves once for each centre
    that it is compared with, and a block holds a bounded number of shingles."""
    size = whole.select("key", "n")
    pairs = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAIRS).alias("salts"))
    total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    salt = F.pmod(F.xxhash64(F.lit(1), "a"), F.col("salts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("b", salt), F.lit(blocks)).cast("int").alias("block"))
    dealt = tables.write(dealt, "pairs")
    needed = dealt.select(F.col("block").alias("cell"), F.col("a").alias("key")).union(dealt.select("block", "b")).distinct()
    needed = needed.join(whole.select("key", "shingles"), "key")
    found = dealt.groupBy("block").cogroup(needed.groupBy("cell")).applyInArrow(_verify, "a long, b long")
    found = tables.write(found, "found")
    tables.drop(dealt)
    return found


def _near(n, m):
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _possible(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither their sizes nor their sketches rule out."""
    known = whole.select("key", "n", "sketch")
    both = pairs.join(known.toDF("a", "n", "s"), "a").join(known.toDF("b", "m", "t"), "b")
    apart = sum(F.bit_count(F.col("s")[i].bitwiseXOR(F.col("t")[i])) for i in range(SKETCH // 64))
    return both.where(_near(F.col("n"), F.col("m")) & (apart * 9 <= F.col("n") + F.col("m"))).select("a", "b")


def _close_pairs(table: pa.Table) -> pa.Table:
    """Pairs of one signature and different labels that sketches and sizes allow; of blocks i and j < i only those across."""
    sig, n, label, key, block, i, j = (table[c].to_numpy() for c in ("signature", "n", "label", "key", "part", "i", "j"))
    bits = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)
    order, found = np.argsort(sig, kind="stable"), [np.empty((0, 2), np.int64)]
    for run in np.split(order, np.flatnonzero(np.diff(sig[order])) + 1):
        across = len(run) and i[run[0]] != j[run[0]]
        left, right = (run[block[run] == i[run[0]]], run[block[run] == j[run[0]]]) if across else (run, run)
        for x in left:
            ys = right if across else right[key[right] > key[x]]
            ys = ys[(label[ys] != label[x]) & (5 * np.minimum(n[ys], n[x]) >= 4 * np.maximum(n[ys], n[x]))]
            size = n[ys] + n[x]
            ys = ys[np.bitwise_count(bits[ys] ^ bits[x]).sum(axis=1, dtype=np.int64) * 9 <= size]
            if len(ys):
                found.append(np.stack([np.minimum(key[ys], key[x]), np.maximum(key[ys], key[x])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _across_labels(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs (a, b) of one group (signature, key, n, label) and different labels, by blocks of PART members."""
    sizes = groups.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    bundles = max(1, groups.count() // BUNDLE)
    rows = groups.join(sizes, "signature").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.greatest("part", "other"), "j": F.least("part", "other")})
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("signature"), F.lit(bundles))).otherwise(F.xxhash64("signature", "i", "j"))
    rows = rows.join(whole.select("key", "sketch"), "key")
    rows = rows.select(cell.alias("cell"), "signature", "key", "n", "label", "part", "i", "j", "sketch")
    found = rows.groupBy("cell").applyInArrow(_close_pairs, "a long, b long")
    return found.distinct()


def _addressed(docs: DataFrame, text: str, *names: str) -> DataFrame:
    """docs with two columns, a hash of id and text: the same whenever a row is read again."""
    return docs.select("*", *[F.xxhash64(F.lit(k), "doc_id", text).alias(c) for k, c in enumerate(names)])


def _one_each(docs: DataFrame, *names: str) -> DataFrame:
    """One of the rows that have the same address; each task keeps one before rows move."""
    (k,) = common.fresh(docs, "k")
    return docs.withColumn(k, F.row_number().over(Window.partitionBy(*names).orderBy(names[0]))).where(F.col(k) == 1).drop(k)


def _light(rows: DataFrame) -> DataFrame:
    """rows, marked for sending to all executors if they are few enough; otherwise they are joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def jaccard_components(docs: DataFrame, text: str = "text", rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    first, heads = _components(docs, text, rare)
    found = first.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(heads, ["k1", "k2"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("head.doc_id", "doc_id").alias("component_id"))


def _survivors(first: DataFrame, reps: DataFrame, tables: common.Tables) -> DataFrame:
    """key, n, at, at2 of the representatives with enough prefix shingles that other documents have, too."""
    tokens = first.where("n > 0").select("row", "n", F.explode("prefix").alias("token"))
    shared = tables.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "shared")
    smaller = F.ceil(F.col("n") * F.lit(4) / F.lit(5))
    enough = F.floor(F.floor(smaller / 5) / 2) + 1
    hits = tokens.join(shared, "token").groupBy("row", "n").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= enough)
    left = tables.write(hits.join(reps.select(F.col("key").alias("row"), "rep.at", "rep.at2"), "row"), "left")
    tables.drop(shared)
    return left.select(F.col("row").alias("key"), "n", "at", "at2")


def _components(docs: DataFrame, text: str, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, at, at2, row, n, k1, k2) and, for each set (k1, k2), its component's head: the row of the smallest id."""

    def signed_by(n: pd.Series, counts: pd.Series, shingles: pd.Series) -> pd.Series:
        made = [signatures(int(a), np.asarray(b), np.asarray(c), rare) for a, b, c in zip(n, counts, shingles, strict=True)]
        return pd.Series(made, dtype=object)

    signing = F.pandas_udf(signed_by, "array<bigint>")
    spark, tables = docs.sparkSession, common.Tables(docs.sparkSession)
    common.tidy_shuffles(spark)
    common.bound_batches(spark)
    bare = _addressed(docs.select("doc_id", F.col(text).alias("text")), "text", "at", "at2")
    numbered = bare.withColumn("row", F.monotonically_increasing_id())  # fixed by being written
    kept = f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, at long, at2 long, row long, n long, k1 long, k2 long"
    full = tables.write(numbered.mapInArrow(_screened, f"{kept}, prefix array<bigint>"), "screened")
    first = tables.write(full.drop("prefix"), "rows")
    # classes of equal sets; rows without an id come last
    members = first.where("n > 0").select("k1", "k2", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "at", "at2", "row").alias("rep"))
    reps = members.groupBy("k1", "k2").agg(F.min("rep").alias("rep")).select("k1", "k2", F.col("rep.row").alias("key"), "rep")
    reps = tables.write(reps, "representatives")

    # 1. screening, then whole sets of what is left
    left = _survivors(full, reps, tables)
    tables.drop(full)
    texts = bare.drop("doc_id").join(_light(left), ["at", "at2"]).dropDuplicates(["key"]).select("key", "n", "text")
    whole = texts.mapInArrow(_whole, "key long, n long, shingles array<bigint>, sketch array<bigint>, bands array<bigint>")
    whole = tables.write(whole, "whole")

    # 2. quick links: each set with the shortest one of an equal combination
    bands = whole.select("key", "n", F.explode("bands").alias("signature"))
    pairs = _possible(_with_centres(bands.withColumn("label", F.col("key")), 0), whole)
    links = verified(pairs, whole, tables)
    labels = components(links, tables)
    tables.drop(links)

    # 3. shingles that several components have, document frequencies, signatures
    each = _labelled(whole.select("key", "n", "shingles"), labels).select("key", "n", "label", F.explode("shingles").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    counts = counts.where("lo <> hi").select("token", "df")
    listed = each.join(counts, "token").groupBy("key", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    listed = listed.where(F.size("list") >= F.col("n") - F.floor(F.col("n") / 5))
    signed = listed.select("key", "n", "label", F.explode(signing("n", F.col("list.df"), F.col("list.token"))).alias("signature"))
    groups = _open_groups(tables.write(signed, "signatures"), tables)

    # 4. rounds of centres; a group of one component stays one, so each round only has the groups that are open
    round_, most_found = 1, 0
    while not groups.isEmpty():
        found = verified(_possible(_with_centres(groups, round_), whole), whole, tables)
        n_found = found.count()
        if not n_found:
            break
        most_found, round_ = max(most_found, n_found), round_ + 1
        labels, groups = _joined(found, labels, groups, tables)
        if n_found < FEW * most_found:
            break
    if not groups.isEmpty():
        found = verified(_across_labels(groups, whole), whole, tables)
        if not found.isEmpty():
            labels, groups = _joined(found, labels, groups, tables)

    # components of classes, then of documents
    named = _labelled(reps.select("k1", "k2", "key", "rep"), labels)
    heads = named.join(named.groupBy("label").agg(F.min("rep").alias("head")), "label").select("k1", "k2", "head")
    heads = tables.write(heads, "heads")
    tables.drop(whole, reps, labels, groups)
    return first, heads


def _with_centres(groups: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b): each member of a group (signature, key, n, label) with its centre b, if their labels differ. The first
    centres are the shortest sets; later ones are chosen by a hash of set and signature, so that a set meets several."""
    order = F.col("n") if round_ < 2 else F.xxhash64(F.lit(round_), "signature", "key")
    centre = groups.groupBy("signature").agg(F.min(F.struct(order.alias("o"), "key", "label")).alias("c"))
    centre = centre.select("signature", F.col("c.key").alias("b"), F.col("c.label").alias("centre_label"))
    pairs = groups.join(centre, "signature").where(F.col("label") != F.col("centre_label"))
    return pairs.select(F.col("key").alias("a"), "b").distinct()


def _joined(found: DataFrame, labels: DataFrame, groups: DataFrame, tables: common.Tables) -> tuple:
    """The labels with the links found since, which only join components that are known already, and the groups still open."""
    ends = found.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    ends = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    ends = tables.write(ends.distinct(), "ends")
    merged = components(ends, tables)
    keys = labels.select("key", "label").union(found.select("a", "a")).union(found.select("b", "b")).groupBy("key").agg(F.min("label").alias("label"))
    new = tables.write(keys.join(merged.toDF("label", "to"), "label", "left").select("key", F.coalesce("to", "label").alias("label")), "labels")
    still = _open_groups(_labelled(groups.drop("label"), new), tables)
    tables.drop(found, labels, groups, ends, merged)
    return new, still


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their key; the key itself where it has no link."""
    return rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _open_groups(groups: DataFrame, tables: common.Tables) -> DataFrame:
    """The rows of signatures whose members are in several components."""
    spread = groups.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return tables.write(groups.join(spread.where("lo <> hi").select("signature"), "signature"), "groups")


def first_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component, the one of the smallest id: near duplicates go. Rows without an id stay as long as no
    other row is like them. Of rows without words, those that repeat both an id and its text go."""
    first, heads = _components(docs, text)
    nobody = F.col("doc_id").isNull() & ~F.coalesce(F.col(text).rlike(r"[^ \t-\r]"), F.lit(False))  # each is its own component
    at, at2 = common.fresh(docs, "at", "at2")
    kept = heads.select("head.at", "head.at2").distinct()
    somebody = first.where("not (n = 0 and doc_id is null)")
    counted = somebody.groupBy("at", "at2").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    repeated = counted.where("c > 1")
    once = repeated.where("n > 0").select("at", "at2").join(kept, ["at", "at2"]).union(repeated.where("n = 0").select("at", "at2"))
    gone = counted.where("n > 0").select("at", "at2").join(kept, ["at", "at2"], "left_anti").union(repeated.select("at", "at2")).distinct()
    tables = common.Tables(docs.sparkSession)
    once, gone = (tables.write(t.toDF(at, at2), name) for t, name in ((once, "once"), (gone, "gone")))
    rows = _addressed(docs.where(~nobody), text, at, at2)
    alone = rows.join(_light(gone), [at, at2], "left_anti")
    out = alone.drop(at, at2).unionAll(docs.where(nobody))
    if once.isEmpty():
        return out
    return out.unionAll(_one_each(rows.join(_light(once), [at, at2], "left_semi"), at, at2).drop(at, at2))


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
