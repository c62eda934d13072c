"""MinHash near-duplicates by an LSH forest (operator 1).

Each distinct shingle set is signed with ``ORDERS * WIDTH`` minima.  Order t of the
forest reads the signature from value ``t * WIDTH`` on, cyclically.  Sets that agree on
the first ``DEPTH`` values of an order form a region of it; inside a region rows are
sorted by the rest of the signature, so that neighbours share the longest prefix.

* Links first: sorted neighbours whose signatures promise the similarity are checked on
  the full shingle sets, at most two for each set.  Their components are labelled.  For this
  pass alone, a region with more than ``REGION`` sets is cut at greater depth, as deep as its
  own density asks for.
* The rest, exactly: where a region of depth ``DEPTH``, whatever its size, still holds different
  labels, the sets with a partner of another label that signatures do not rule out are
  gathered by region, and all of them are compared on their full shingle sets.  A region
  with more than ``REGION`` sets is dealt to blocks, and a task compares two blocks.  Only links
  between labels leave the task, fewer than it has labels; pairs are never rows.  A group of
  near copies, all of one label by then, takes no part.

Sets that are equal are one class from the start; classes carry the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from echoloom.llm.arrow import bounded_batches
from echoloom.llm.textnum import shingle_sets, splitmix
from echoloom.operators.components import connected_components
from echoloom.scratch import stored

ORDERS, WIDTH, DEPTH = 16, 8, 3
VALUES = ORDERS * WIDTH
REGION = 2048  #: most sets of a region that one task compares
BOTH = 2  #: the side of a row that is compared with all of its task; 0 and 1 are compared with each other
SIGMAS = 4.2  #: how far below the threshold an estimate may lie
FACTORS = (splitmix(VALUES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (splitmix(VALUES, 12) >> np.uint64(32)).astype(np.uint32)

SKETCH = "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of VALUES hash functions over the shingles."""
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(VALUES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 4096):
        part = FACTORS[:, None] * low[None, at : at + 4096]
        part += SHIFTS[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def _sketcher(k: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = splitmix(ORDERS, 13).view(np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                sizes, digests, sigs, keys = [], [], [], []
                for s in shingle_sets(part.column(1), k):
                    sizes.append(len(s))
                    if not len(s):
                        for x in (digests, sigs, keys):
                            x.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    values = signature(s)
                    sigs.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                    heads = values.reshape(ORDERS, WIDTH)[:, :DEPTH].astype(np.int64)
                    key = salt.copy()
                    for j in range(DEPTH):
                        key = (key ^ heads[:, j]) * np.int64(0x2127599BF4325C37)
                        key ^= key >> 29
                    keys.append(key)
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "keys"])

    return sketch


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities by the shares of equal signature bytes, less the 1/256 that agree by chance."""
    return ((one[:, None, :] == many[None, :, :]).mean(2, dtype=np.float32) - 1 / 256) / (1 - 1 / 256)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The regions of a partition that is sorted by order and key, with the columns of each."""
    order, rest, held = None, None, []
    for batch in batches:
        t, key = (batch.column(i).to_numpy() for i in (0, 1))
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, VALUES)
        columns = [batch.column(2).to_numpy(), sig, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, batch.num_columns))]
        cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(t)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if (t[a], key[a]) != (order, rest):
                if held:
                    yield int(order), [np.concatenate(x) for x in zip(*held, strict=True)]
                order, rest, held = t[a], key[a], []
            held.append([x[a:b] for x in columns])
    if held:
        yield int(order), [np.concatenate(x) for x in zip(*held, strict=True)]


def _pairs_out(a: list, b: list, est: list) -> pa.RecordBatch:
    a, b, est = (np.concatenate(x) for x in (a, b, est))
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est.astype(np.float32))], ["a", "b", "est"])


def _neighbours(floor: float, share: float) -> Callable:
    """Neighbours of the sorted order that may reach the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [[], [], []], 0
        for _, (ids, sig, size) in _regions(batches):
            if len(ids) < 2:
                continue
            est = ((sig[1:] == sig[:-1]).mean(1) - 1 / 256) / (1 - 1 / 256)
            good = (est >= floor) & (np.minimum(size[1:], size[:-1]) >= share * np.maximum(size[1:], size[:-1])) & (ids[1:] != ids[:-1])
            for x, y in zip(out, (ids[1:][good], ids[:-1][good], est[good]), strict=True):
                x.append(y)
            rows += int(good.sum())
            if rows >= 20_000:
                yield _pairs_out(*out)
                out, rows = [[], [], []], 0
        if rows:
            yield _pairs_out(*out)

    return scan


def _suspects(floor: float, share: float) -> Callable:
    """The members of a region that may reach the similarity with one of another label, in no earlier order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, (ids, sig, size, label, home, keys, side) in _regions(batches):
            names, code, count = np.unique(label, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            keys = np.array(keys.tolist())[:, :t]
            main = int(count.argmax())
            few, found = np.flatnonzero(code != main), np.zeros(len(ids), bool)  # pairs inside the largest label need no look
            step = max(1, (1 << 21) // (VALUES * len(ids)))
            for low in range(0, len(few), step):
                i = few[low : low + step]
                good = (_estimates(sig[i], sig) >= floor) & (code[i][:, None] != code[None, :])
                good &= np.minimum(size[i][:, None], size[None, :]) >= share * np.maximum(size[i][:, None], size[None, :])
                good &= (side[i][:, None] != side[None, :]) | (side[i][:, None] == BOTH)
                x, y = np.nonzero(good)
                new = ~((keys[i[x]] == keys[y]) & (keys[y] != 0)).any(1)
                found[i[x[new]]] = found[y[new]] = True
            if found.any():
                n = int(found.sum())
                yield pa.record_batch([pa.array(np.full(n, t, np.int32)), pa.array(home[found]), pa.array(ids[found]), pa.array(label[found])], ["t", "key", "rep", "label"])

    return scan


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Each set as a row of bits over the members that at least two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column, keep = place[code], count[code] > 1
    out = np.zeros((len(sets), max(1, -(-len(shared) // 64)) * 8), np.uint8)
    np.bitwise_or.at(out, (owner[keep], column[keep] >> 3), (1 << (column[keep] & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _joiner(k: int, num: int, den: int) -> Callable:
    """Compares all sets of a region that carry different labels; gives links between labels, none twice."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, sets in _gathered(batches, k):
            size = np.array([len(s) for s in sets])
            bits, up = _bits(sets), {x: x for x in label}

            def top(x: int, up: dict = up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            links, code = [], np.array(label)
            for i in range(1, len(sets)):
                common = np.bitwise_count(bits[i] & bits[:i]).sum(1, dtype=np.int64)
                for j in np.flatnonzero((den * common >= num * (size[i] + size[:i] - common)) & (code[:i] != code[i])).tolist():
                    a, b = sorted((top(label[i]), top(label[j])))
                    if a != b:
                        up[b] = a
                        links.append((label[i], label[j]))
            if links:
                yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return compare


def _gathered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Labels and shingle sets by region, of a partition that is sorted by (t, key)."""
    now, labels, sets = None, [], []
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            heads = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            for head, label, s in zip(heads, part.column(2).to_pylist(), shingle_sets(part.column(3), k), strict=True):
                if head != now:
                    if len(sets) > 1:
                        yield labels, sets
                    now, labels, sets = head, [], []
                labels.append(label)
                sets.append(s)
    if len(sets) > 1:
        yield labels, sets


def _verifier(k: int, num: int, den: int) -> Callable:
    """Keeps pairs of texts whose full shingle sets satisfy den * common >= num * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                good = []
                for s, t in zip(shingle_sets(part.column(2), k), shingle_sets(part.column(3), k), strict=True):
                    common = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) * den >= num * max(len(s), len(t)) else 0
                    good.append(common > 0 and den * common >= num * (len(s) + len(t) - common))
                yield pa.record_batch([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, held: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    one = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verifier(k, num, den), "a long, b long"), "forest-links")


def _region_rows(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(t, key, rep, sig, n, turned, cut): the members of every region of at least two sets, dense regions cut deeper; and the dense regions whole, if any."""
    spark = sets.sparkSession
    rows = sets.select("rep", F.posexplode("keys").alias("t", "key"))
    shared = stored(rows.groupBy("t", "key").agg(F.count("*").alias("n_sets"), F.min("rep").alias("least")).where("n_sets > 1"), "forest-regions")
    turned = F.concat(F.expr(f"substring(sig, t * {WIDTH} + 1, {VALUES})"), F.expr(f"substring(sig, 1, t * {WIDTH})"))
    members = stored(rows.join(shared.select("t", "key", "n_sets"), ["t", "key"]), "forest-members").join(sets.select("rep", "sig", F.col("n_shingles").alias("n")), "rep")
    if shared.where(F.col("n_sets") > REGION).isEmpty():
        return members.select("t", "key", "rep", "sig", "n", turned.alias("turned"), F.lit(False).alias("cut")), None
    calm = members.where(F.col("n_sets") <= REGION).select("t", "key", "rep", "sig", "n", turned.alias("turned"), F.lit(False).alias("cut"))
    whole = stored(members.where(F.col("n_sets") > REGION).withColumn("turned", turned), "forest-dense").select("t", "key", "rep", "sig", "n", "turned")
    dense = whole.withColumn("cut", F.lit(True))
    for depth in (DEPTH + 4, DEPTH + 12):
        deeper = dense.withColumn("key", F.xxhash64("key", F.substring("turned", 1, depth)))
        sizes = deeper.groupBy("t", "key").agg(F.count("*").alias("n_sets"))
        cut = stored(deeper.join(sizes, ["t", "key"]), "forest-deeper")
        calm = calm.unionByName(cut.where(F.col("n_sets").between(2, REGION)).drop("n_sets"))
        dense = cut.where(F.col("n_sets") > REGION)
        if dense.isEmpty():
            return calm, whole
        dense = dense.drop("n_sets") if depth == DEPTH + 4 else dense
    # Sets that agree on so many values are all but equal: chunks, and one chunk dealt from all of them to tie them.
    spread = dense.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n_sets") / REGION))))
    tied = dense.where(F.pmod(F.xxhash64(F.lit(1), "rep"), F.ceil(F.col("n_sets") / (REGION // 2))) == 0).withColumn("key", F.xxhash64("key", F.lit("tie")))
    return calm.unionByName(spread.unionByName(tied).drop("n_sets")), whole


def _dealt(mixed: DataFrame) -> DataFrame:
    """Rows of regions as (.., home, key, side): ``home`` is the region, ``key`` the task.

    A region of at most REGION sets is one task.  A larger one is dealt to blocks of about half
    as many; blocks of its largest label meet those of the other labels only, which meet all.
    """
    half, main = REGION // 2, F.col("label") == F.col("main")
    n_few, n_main = (F.ceil(x / half).cast("int") for x in (F.col("n_sets") - F.col("n_main"), F.col("n_main")))
    place = F.pmod(F.xxhash64("rep"), F.when(main, n_main).otherwise(n_few)).cast("int")
    own = mixed.withColumns({"block": F.when(main, n_few + place).otherwise(place), "last": F.when(main, n_few).otherwise(n_few + n_main) - 1})
    b = F.col("block")

    def task(j):  # noqa: ANN001, ANN202
        return F.struct(F.xxhash64("key", F.least(b, j), F.greatest(b, j)).alias("key"), F.when(b == j, BOTH).when(b < j, 0).otherwise(1).alias("side"))

    one = F.array(F.struct("key", F.lit(BOTH).alias("side")))
    tasks = F.when(F.col("n_sets") <= REGION, one).otherwise(F.transform(F.sequence(F.lit(0), F.col("last")), task))
    # The outer form: else Catalyst infers a filter on the number of tasks and computes them once more for it.
    sent = own.withColumn("w", F.explode_outer(tasks))
    return sent.select("t", "rep", "sig", "n", "label", F.col("key").alias("home"), "w.key", "w.side")


def minhash_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of near-duplicate documents.

    ``docs`` has ``doc_id`` (long) and ``text`` (string); other columns, whatever
    their names, are ignored.  Two documents are linked if ``den * |common| >= num *
    |union|`` for their sets of distinct k-word shingles.  Returns one row per row
    of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that is reachable)
    and ``kept`` (whether that is its own).

    Defined cases: a null, empty or blank text has no shingles and is linked with
    nothing; a text with fewer than k words has one shingle, all its words; equal texts are
    always linked; rows that repeat a doc_id are each given, by their own text;
    a row with a null doc_id is given with a null component and is kept.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = num / den
    floor = share - SIGMAS * sqrt(share * (1 - share) / VALUES)
    sketches = stored(texts.mapInArrow(_sketcher(k), SKETCH), "forest-sketches")
    some = sketches.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "forest-classes")
    sets = stored(some.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("rep"), "sig", "keys", "n_shingles").dropDuplicates(["rep", "sig"]), "forest-sets")
    regions, dense = _region_rows(sets)
    regions = stored(regions, "forest-rows")
    whole = regions.where("NOT cut").drop("turned", "cut")
    whole = whole if dense is None else whole.unionByName(dense.drop("turned"))

    # Both checks read these texts, so all texts are shuffled once.
    held = stored(texts.join(whole.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "forest-texts")

    def by_region(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition("t", "key").sortWithinPartitions("t", "key", *more)

    near = by_region(regions, "turned", "rep").select("t", "key", "rep", "sig", "n").mapInArrow(_neighbours(floor, share), "a long, b long, est float").groupBy("a", "b").agg(F.max("est").alias("est"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("est"), "a"))).where("place <= 2")
    links = _verified(near, held, k, num, den)
    labels = stored(connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label")), "forest-labels")
    labelled = whole.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    counts = labelled.groupBy("t", "key", "label").agg(F.count("*").alias("c"))
    torn = counts.groupBy("t", "key").agg(F.sum("c").alias("n_sets"), F.max("c").alias("n_main"), F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("n_labels")).where("n_labels > 1").drop("n_labels")
    mixed = stored(labelled.join(torn, ["t", "key"]), "forest-mixed")
    homes = mixed.groupBy("rep").agg(F.array(*[F.coalesce(F.max(F.when(F.col("t") == t, F.col("key"))), F.lit(0)) for t in range(ORDERS)]).alias("homes"))
    suspects = by_region(_dealt(mixed).join(homes, "rep"), "rep").select("t", "key", "rep", "sig", "n", "label", "key", "homes", "side").mapInArrow(_suspects(floor, share), "t int, key long, rep long, label long")
    gathered = stored(suspects, "forest-suspects").join(held, F.col("rep") == F.col("doc_id"))
    late = stored(by_region(gathered, "rep").select("t", "key", "label", "text").mapInArrow(_joiner(k, num, den), "a long, b long"), "forest-late")
    if late.isEmpty():
        final = labels
    else:
        merged = connected_components(late, "a", "b").select(F.col("node").alias("label"), F.col("component").alias("final"))
        lone = merged.join(labels.select("label"), "label", "left_anti").select(F.col("label").alias("rep"), F.col("final").alias("label"))
        final = labels.join(merged, "label", "left").select("rep", F.coalesce("final", "label").alias("label")).unionByName(lone)
    of_class = classes.join(final, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    named = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    grouped = some.select("doc_id", "n_shingles", "digest").join(of_class, "digest").select("doc_id", "n_shingles", "component_id", named)
    alone = sketches.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone.select("*", named))
