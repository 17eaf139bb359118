"""Near duplicates: bottom-k sketches from one hash function (operator 3).

1. Documents with equal shingle sets form a class (a 128-bit key of the set); everything further works on classes.
2. A class keeps the `k` smallest hash values of its set. Values that no other class retains are dropped, and so is a
   class with fewer than `common` values left: two sets with a Jaccard of 0.75 share fewer than 28 of 64 retained values
   with a probability below 3e-8; for sets of at most k shingles, retained whole, the bound is certain.
3. Inverted lists of the rarest of these values generate overlaps (as two classes share at least `common` values, they
   meet in a list even if the `common` - 1 most frequent ones are left out).
4. Every member of a list is paired with the list's hub, the class whose values most others retain. Pairs are filtered
   by the estimate from their union's sketch and verified by the exact Jaccard of their full sets, which connects most
   groups of copies. Classes that still share a list with another component get inverted lists of their full sets; those
   that can be linked at all are compared, block by block, with the members of other components. A block reports no
   pairs but a spanning set of its links, so what leaves it is never more than its members.
5. Components come from the links by star contraction, repeated until nothing changes.

A shingle's hash chains the XXH3 hashes of its words, mixed before each further one, so it doesn't follow how words are
built; two given shingles collide with a probability of 2 ** -64.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null texts and texts without words have no shingles
and are linked with nothing. Very long texts are taken whole. Rows with null doc_id are linked like others but name no
component. Equal rows, and rows with equal doc_id, each give a row. An empty table gives an empty result. Further
columns, whatever their names, have no effect on `link` and are handed through by `accept`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillmill.llm.batches import bounded, small
from quillmill.runtime import Scratch

CLASS = "cid binary"
BROADCAST_ROWS = 100_000  #: of at most 100 bytes: no broadcast here exceeds 10 MB


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words than that, of all as one."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.int64)
    each = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(words, len(found))
    count = len(found) - span + 1
    h = each[:count]
    for i in range(1, span):
        h = mixed(h) + each[i : i + count]
    h = np.sort(mixed(h).view(np.int64))
    return h[np.append(True, h[1:] != h[:-1])]


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def text_key() -> Column:
    """A key of a row's text, never null."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, cid (key of the set; null: empty), sketch (the k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_hashes(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array([len(h) for h in sets], pa.int64()), pa.array([set_key(h) if len(h) else None for h in sets], pa.binary()), pa.array([h[:k] for h in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "cid", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key().alias("text_key")).mapInArrow(run, f"doc_id long, text_key long, n_shingles long, {CLASS}, sketch array<long>")


def needed(n: Column, k: int, common: int, threshold: int) -> Column:
    """How many retained values a class of `n` shingles shares with a linked one.

    Up to k shingles this is certain: the two share threshold % of the larger set, of which the partner's sketch lacks
    what exceeds k. Beyond, it holds with the probability that `common` stands for.
    """
    share = threshold / 100
    return F.when(n <= k, F.greatest(F.least(F.ceil(n * share), F.floor(k - n * (1 - share) / share)), F.lit(1))).otherwise(F.lit(common)).cast("int")


def estimated(a: Column, b: Column, n_a: Column, n_b: Column, k: int, common: int, threshold: int) -> Column:
    """Whether sizes and the union's sketch leave a link possible; sketches that hold whole sets decide it."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    whole = F.size(F.array_intersect(a, b))
    fits = 100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)
    return fits & F.when(F.greatest(n_a, n_b) <= k, 100 * whole >= threshold * (n_a + n_b - whole)).otherwise(both >= common)


def inverted_lists(classes: DataFrame, k: int, common: int, threshold: int) -> DataFrame:
    """value, cid, weight: the lists of step 3; weight grows with how often a class's values are retained by others."""
    # 8-byte ids halve what is shuffled; classes whose ids are equal get each other's values too, which loses nothing
    own = F.xxhash64("cid").alias("id")
    entries = classes.select(own, F.explode("sketch").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    kept = entries.join(often, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("at"))
    kept = kept.join(classes.select(own, "cid", "n_shingles"), "id")
    first = F.slice("at", 1, F.greatest(F.size("at") - needed(F.col("n_shingles"), k, common, threshold) + 1, F.lit(0)))
    weight = F.aggregate("at", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return kept.select("cid", weight.alias("weight"), F.explode(first).alias("x")).select(F.col("x.value").alias("value"), "cid", "weight")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: int, scratch: Scratch, salted: int = 256, spread: int = 64) -> DataFrame:
    """Of pairs (member, hub) those with 100 * intersection >= threshold * union, on full sets recomputed from texts.

    A hub's set is repeated for every `salted` members; a partition streams over its pairs, so none holds a group. Hubs
    of more members than that are told to their members in `spread` parts.
    """
    loads = pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("salts", (F.col("n") / salted).cast("int") + 1).select("hub", "salts")
    heavy = loads.filter("salts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    members = pairs.withColumn("part", F.pmod(F.hash("member"), F.lit(spread))).join(heavy, ["hub", "part"], "left")
    members = members.select(F.col("member").alias("cid"), "hub", F.coalesce(F.pmod(F.xxhash64("member"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), F.lit(1).alias("side"))
    hubs = loads.select(F.col("hub").alias("cid"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    roles = members.unionByName(hubs).join(classes.select("cid", "source_id"), "cid")
    texts = texts_of(roles, docs, scratch).select("text", "cid", "hub", "salt", "side")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            found = [shingle_hashes(t or "") for t in batch.column(0).to_pylist()]
            same = [i for i, (h, c) in enumerate(zip(found, batch.column(1).to_pylist(), strict=True)) if set_key(h) == c]  # of rows with equal doc_id, the class's own
            rest = [c.take(pa.array(same, pa.int64())) for c in batch.columns[1:]]
            yield pa.record_batch([*rest, pa.array([found[i].tobytes() for i in same], pa.binary())], names=["cid", "hub", "salt", "side", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.int64)
        for batch in small(batches, 200):
            out = []
            for cid, hub, side, raw in zip(*(batch.column(n).to_pylist() for n in ("cid", "hub", "side", "hashes")), strict=True):
                h = np.frombuffer(raw, np.int64)
                if side == 0:
                    at, own = hub, h
                elif at == hub:
                    place = np.searchsorted(own, h).clip(max=len(own) - 1)
                    both = int((own[place] == h).sum())
                    if 100 * both >= threshold * (len(own) + len(h) - both):
                        out.append((cid, hub))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["member", "hub"])

    full = texts.mapInArrow(sets, f"{CLASS}, hub binary, salt int, side int, hashes binary")
    return full.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side").select("cid", "hub", "side", "hashes").mapInArrow(compare, "member binary, hub binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """cid, label (the smallest cid reachable) for all ends of links (a, b), by alternating large and small stars."""
    edges = scratch.write(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct(), "near-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        ends = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").unionByName(low.select("x", F.col("m").alias("y")))
        edges = scratch.write(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "near-edges")
        # settled: every node has one edge, to a node that has none to a smaller one
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    return edges.select(F.col("x").alias("cid"), F.col("y").alias("label")).unionByName(edges.select(F.col("y").alias("cid"), F.col("y").alias("label")).distinct())


def near_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """cid, label: equal labels are connected, but not every component has one label yet (stars of hubs have)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("m")).select("cid", F.least("cid", "m").alias("label"))
    label = scratch.write(label, "near-labels")
    # a hub's label reaches all its members, whether theirs were smaller or not
    reached = both.join(label.withColumnsRenamed({"cid": "b", "label": "theirs"}), "b").groupBy(F.col("a").alias("cid")).agg(F.min("theirs").alias("theirs"))
    return label.join(reached, "cid").select("cid", F.least("label", "theirs").alias("label"))


def texts_of(side: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """side (source_id, ...) with the text of each source_id: a doc_id, or the text's key of a row without one."""
    side = scratch.write(side, "near-side")
    if side.count() <= BROADCAST_ROWS:  # beyond that both sides are shuffled
        side = F.broadcast(side)
    texts = docs.select(F.col("doc_id").cast("long").alias("source_id"), F.col("text").cast("string"), text_key().alias("key"))
    nameless = texts.filter("source_id is null").groupBy(F.col("key").alias("source_id")).agg(F.first("text").alias("text"))
    return texts.filter("source_id is not null").select("source_id", "text").unionByName(nameless).join(side, "source_id")


def shared_sets(unsettled: DataFrame, docs: DataFrame, classes: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """cid, label, n_shingles, at: the unsettled classes (cid, label) that can have a link between them, with those
    shingles that stand in more than one of them, the rarest first.

    A class shares threshold % of its shingles with a linked one, so it goes if fewer of them stand in any other class.
    """
    own = scratch.write(unsettled.join(classes.select("cid", "source_id", "n_shingles"), "cid"), "near-unsettled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            for text, cid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingle_hashes(text or "")
                if set_key(h) == cid:
                    yield pa.record_batch([pa.DictionaryArray.from_arrays(np.zeros(len(h), np.int32), pa.array([cid], pa.binary())).cast(pa.binary()), pa.array(h)], names=["cid", "value"])

    found = texts_of(own.select("source_id", "cid"), docs, scratch).select("text", "cid").mapInArrow(run, f"{CLASS}, value long")
    entries = scratch.write(found, "near-full")
    often = entries.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    kept = entries.join(often, "value").groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("n", "value"))).alias("at"))  # a set, as rows may be repeated
    least = F.ceil(F.col("n_shingles") * threshold / 100)
    return kept.filter(F.size("at") > 0).join(own, "cid").filter(F.size("at") >= least).select("cid", "label", "n_shingles", F.transform("at", lambda x: x["value"]).alias("at"))


def full_lists(sets: DataFrame, threshold: int) -> DataFrame:
    """value, cid, label, n_shingles: inverted lists of the rarest shingles of each class, one more than those that an
    unlinked class can miss, so that any two linked classes meet. Of lists with the same members one stays, of those
    with one label none."""
    spare = F.size("at") - F.ceil(F.col("n_shingles") * threshold / 100).cast("int") + 1
    lists = sets.select("cid", "label", "n_shingles", F.explode(F.slice("at", 1, spare)).alias("value"))
    alike = lists.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("g"))
    return lists.join(alike.filter("lo <> hi").groupBy("n", "h", "g").agg(F.min("value").alias("value")).select("value"), "value")


def overlaps(sets: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """How many values each two of the sets share: products of their incidence matrix, `width` columns at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    meet = often[at] > 1
    rows, columns = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[meet], (np.cumsum(often > 1) - 1)[at[meet]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for low in range(0, int((often > 1).sum()), width):
        part = slice(*np.searchsorted(columns, (low, low + width)))
        hold = np.zeros((len(sets), width), np.float32)
        hold[rows[part], columns[part] - low] = 1
        out += hold @ hold.T
    return out


def to_compare(group: pa.Table) -> np.ndarray:
    """Which pairs of a block's rows (the first before the second) have to be compared there: those of different labels
    that meet in no list of a smaller value and are in no other block of this one."""
    value, i, j = (group.column(n)[0].as_py() for n in ("value", "i", "j"))
    own, main = (group.column(n).to_numpy() for n in ("own", "is_main"))
    code: dict[bytes, int] = {}
    label = np.array([code.setdefault(x, len(code)) for x in group.column("label").to_pylist()])
    pairs = np.triu(label[:, None] != label[None], 1)
    if j < 0:  # the others among themselves have blocks of their own
        pairs &= main[:, None] != main[None]
    elif i != j:
        pairs &= own[:, None] != own[None]
    lists = [x.values.to_numpy() for x in group.column("lists")]
    pairs &= overlaps([x[x < value] for x in lists]) == 0
    return pairs


def block_links(lists: DataFrame, sets: DataFrame, classes: DataFrame, k: int, common: int, threshold: int, scratch: Scratch, rows: int = 1024, values: int = 1 << 21) -> DataFrame | None:
    """A spanning set of the links (a, b) between members of a list with different labels, block by block.

    The members of a list's main label need no comparison with each other: blocks of the others meet blocks of these,
    and each other. Blocks hold about `rows` members and `values` shingles. Sketches show which members of a block may
    have a link; only these bring their shingles.
    """
    each = lists.groupBy("value", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("v"))
    sizes = each.groupBy("value").agg(F.max(F.struct("n", "v", "label")).alias("main"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    blocks = lambda n, v: F.floor(F.greatest(n / rows, v / values)).cast("int")
    sizes = sizes.select("value", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.v")).alias("m"), blocks(F.col("n") - F.col("main.n"), F.col("v") - F.col("main.v")).alias("o"))
    cut = lists.join(sizes, "value").withColumn("is_main", F.col("label") == F.col("main"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("is_main"), F.col("m")).otherwise(F.col("o")) + 1).cast("int"))
    # groups (i, j): others of block i with the main label's block -j (j < 0) or with others of block j; one group if the list is small
    small = (F.col("m") == 0) & (F.col("o") == 0)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_main = F.transform(F.sequence(F.lit(0), F.col("m")), lambda x: pair(F.col("own"), -1 - x))
    with_others = F.transform(F.sequence(F.lit(0), F.col("o")), lambda x: pair(F.least(F.col("own"), x), F.greatest(F.col("own"), x)))
    of_main = F.transform(F.sequence(F.lit(0), F.col("o")), lambda x: pair(x, -1 - F.col("own")))
    groups = F.when(small, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_others))
    side = sets.select("cid", F.size("at").cast("long").alias("shared")).join(lists.groupBy("cid").agg(F.collect_list("value").alias("lists")), "cid").join(classes.select("cid", "sketch"), "cid")
    cut = cut.select("value", "cid", "label", "n_shingles", "is_main", "own", F.explode(groups).alias("g")).join(side, "cid")
    fields = "value long, i int, j int, own int, is_main boolean, cid binary, label binary, n_shingles long, lists array<long>"
    names = [x.split()[0] for x in fields.split(", ")]
    cut = cut.select("value", F.col("g.i").alias("i"), F.col("g.j").alias("j"), *names[3:], "shared", "sketch")

    def propose(group: pa.Table) -> pa.Table:
        n, most = (group.column(x).to_numpy() for x in ("n_shingles", "shared"))
        both = overlaps([x.values.to_numpy() for x in group.column("sketch")])
        hit = np.zeros(len(n), bool)
        pairs = to_compare(group)
        for a in range(0, len(n), 128):  # strips bound what is held beside the matrices of a block
            low, high = np.minimum(n[a : a + 128, None], n[None]), np.maximum(n[a : a + 128, None], n[None])
            met = both[a : a + 128]
            good = pairs[a : a + 128] & (100 * low >= threshold * high) & np.where(high <= k, 100 * met >= threshold * (low + high - met), met >= common)
            # no two share more than either one's shingles that stand elsewhere
            good &= (100 + threshold) * np.minimum(most[a : a + 128, None], most[None]) >= threshold * (low + high)
            hit[a : a + 128] |= good.any(1)
            hit |= good.any(0)
        lists = group.column("lists").cast(pa.list_(pa.int64()))
        return group.set_column(group.schema.get_field_index("lists"), "lists", lists).select(names).filter(pa.array(hit))

    def compare(group: pa.Table) -> pa.Table:
        n, ids = group.column("n_shingles").to_numpy(), group.column("cid").to_pylist()
        both = overlaps([x.values.to_numpy() for x in group.column("at")])
        linked = to_compare(group)
        for a in range(0, len(n), 128):
            linked[a : a + 128] &= 100 * both[a : a + 128] >= threshold * (n[a : a + 128, None] + n[None] - both[a : a + 128])
        root: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        labels, out = group.column("label").to_pylist(), []
        for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            p, q = top(labels[a]), top(labels[b])
            if p != q:
                root[p] = q
                out.append((ids[a], ids[b]))
        return pa.table([pa.array([x[n] for x in out], pa.binary()) for n in (0, 1)], names=["a", "b"])

    proposed = scratch.write(cut.groupBy("value", "i", "j").applyInArrow(propose, fields), "near-proposed")
    if proposed.isEmpty():
        return None
    return proposed.join(sets.select("cid", "at"), "cid").select(*names, "at").groupBy("value", "i", "j").applyInArrow(compare, "a binary, b binary")


def link(docs: DataFrame, threshold: int = 75, k: int = 64, common: int = 28) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept, n_links (links of its class in a spanning set)."""
    return labelled_rows(docs, threshold, k, common).drop("text_key", "label")


def labelled_rows(docs: DataFrame, threshold: int = 75, k: int = 64, common: int = 28) -> DataFrame:
    """The rows of link with text_key and label (the component's key; null without shingles)."""
    docs = bounded(docs)
    scratch = Scratch(docs.sparkSession)
    marks = scratch.write(sketches(docs, k), "near-sketches")
    named = marks.filter("cid is not null").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "text_key").alias("source_id"), "n_shingles", "sketch")).alias("x"))
    classes = scratch.write(named.select("cid", "x.source_id", "x.n_shingles", "x.sketch"), "near-classes")
    lists = scratch.write(inverted_lists(classes, k, common, threshold), "near-lists")

    hubs = lists.groupBy("value").agg(F.min(F.struct((-F.col("weight")).alias("h"), F.col("cid").alias("hub"))).alias("x")).select("value", "x.hub")
    met = lists.join(hubs, "value").filter("cid <> hub").select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b"), F.col("cid").alias("member"), "hub").dropDuplicates(["a", "b"])
    sketch = classes.select("cid", "n_shingles", "sketch")
    near = met.join(sketch.withColumnsRenamed({"cid": "member", "n_shingles": "n_s", "sketch": "s"}), "member").join(sketch.withColumnsRenamed({"cid": "hub", "n_shingles": "n_t", "sketch": "t"}), "hub")
    pairs = scratch.write(near.filter(estimated(F.col("s"), F.col("t"), F.col("n_s"), F.col("n_t"), k, common, threshold)).select("member", "hub"), "near-pairs")
    links = scratch.write(verified(pairs, docs, classes, threshold, scratch).select(F.col("member").alias("a"), F.col("hub").alias("b")), "near-links")

    # lists that still hold several labels
    marked = lists.select("value", "cid").join(near_labels(links, scratch), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    several = marked.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("value")
    unsettled = marked.join(several, "value").select("cid", "label").distinct()
    sets = scratch.write(shared_sets(unsettled, docs, classes, threshold, scratch), "near-shared")
    found = block_links(scratch.write(full_lists(sets, threshold), "near-full-lists"), sets, classes, k, common, threshold, scratch)
    if found is not None:
        links = links.unionByName(scratch.write(found, "near-links"))

    labels = scratch.write(components(links, scratch), "near-labels")
    degree = scratch.write(links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links")), "near-degree")
    joined = marks.drop("sketch").join(labels, "cid", "left").join(degree, "cid", "left").withColumn("label", F.coalesce("label", "cid")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    joined = scratch.write(joined, "near-joined")
    scratch.clear(joined)
    least = joined.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    done = joined.select("doc_id", "text_key", "n_shingles", "label", "n_links").join(least, "label", "left")
    component = F.coalesce("component_id", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "n_links", "text_key", "label")


def accept(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns. Rows with null doc_id stay.

    Rows are told apart by doc_id and text: of several with one doc_id each is judged by its own component, and of those
    that would stay for one component, and of equal rows, one does.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(labelled_rows(docs).filter("doc_id is not null").select("doc_id", "text_key", "label", "kept"), "near-kept")
    at = F.coalesce("label", F.col("text_key").cast("string").cast("binary")).alias("at")
    gone = found.filter(~F.col("kept")).select("doc_id", "text_key")
    stays = found.filter("kept").select("doc_id", "text_key", at)
    several = scratch.write(stays.groupBy("doc_id", "at").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).filter("n > 1"), "near-several")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))  # no name can clash
    if several.isEmpty():
        return keyed.join(gone, ["doc_id", "text_key"], "left_anti").select("_row.*")
    gone = gone.unionByName(stays.join(several, ["doc_id", "at"]).filter("text_key <> first").select("doc_id", "text_key"))
    stay = keyed.join(gone, ["doc_id", "text_key"], "left_anti")
    return stay.filter("doc_id is not null").dropDuplicates(["doc_id", "text_key"]).unionByName(stay.filter("doc_id is null")).select("_row.*")
