"""Near-duplicates by SimHash, searched by multi-index hashing: by distance of fingerprints, or by similarity of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.llm.common import components, staged

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash64(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ASCII-lower-cased word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = len(words) - width + 1
    if n < 1:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(n, 1))
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed LONG."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, width, seed) for t in text], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp(F.col("text").cast("string")).alias("fp"))


def _segments(count: int) -> list[tuple[int, int]]:
    cuts = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _balls(width: int, radius: int) -> list[int]:
    found = {0}
    for _ in range(radius):
        found |= {m ^ (1 << b) for m in found for b in range(width)}
    return sorted(found)


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `distance` bits.

    Two fingerprints that near share a segment up to distance // segments bits. So each one looks up, in the table of
    every segment, all keys of the small Hamming ball around its own key, and complete distances decide. With 64 / segments
    bits a key (32 by default) a bucket stays small at billions of fingerprints.
    """
    def key(c: Column, lo: int, width: int) -> Column:
        return F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    parts = _segments(segments)
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), key(F.col("fp"), *p).alias("k")) for i, p in enumerate(parts)])).alias("e"))
    table = table.select(F.col("fp").alias("b"), "e.s", "e.k")
    probes = None
    for i, (lo, width) in enumerate(parts):
        masks = F.array(*[F.lit(m).cast("long") for m in _balls(width, distance // segments)])
        near = fps.select(F.col("fp").alias("a"), F.lit(i).alias("s"), key(F.col("fp"), lo, width).alias("_k"), F.explode(masks).alias("_m"))
        near = near.select("a", "s", F.col("_k").bitwiseXOR(F.col("_m")).alias("k"))
        probes = near if probes is None else probes.unionByName(near)
    found = probes.join(table, ["s", "k"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return found.select("a", "b")


def near_groups(docs: DataFrame, width: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Links join fingerprints at `distance` or fewer differing bits; component_id is the smallest doc_id that links reach.
    Null or blank text has fingerprint zero and links like any other. Fewer words than `width` make one shingle. Repeated
    rows stay, each with its own row; rows with null doc_id get the group's smallest doc_id (null if it has none). An empty
    table gives an empty result. Other columns are not read.
    """
    rows = staged(fingerprints(docs, width, seed), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(distinct.select("fp"), distance))
    label = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    of = label.join(smallest, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows of each group(doc_id, component_id) that are not its representative (the smallest doc_id).

    Repeated rows of the representative's doc_id are cut to one. Rows with a null doc_id are kept. Columns of any name are
    kept, nulls too; an empty table stays empty.
    """
    keep = groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_keep")).agg((F.count("*") > 1).alias("_more"))
    once = docs.join(keep.filter("not _more"), F.col("doc_id") == F.col("_keep"), "left_semi")
    more = docs.join(keep.filter("_more"), F.col("doc_id") == F.col("_keep"), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(docs.filter("doc_id is null"))


def _mixed(h: np.ndarray) -> np.ndarray:
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ASCII-lower-cased word shingles; fewer words than width make one, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h) + w[i : len(w) - width + 1 + i]
    return np.unique(_mixed(h))


def _name(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), 42)], np.uint64).view(np.int64)[0])


def wide_fingerprint(own: np.ndarray, bits: int, segments: int, width: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of a set, in 64-bit words; its first `segments` segments of `width` bits; and for each a mask of its edge, the
    `near` bits whose majority is the closest."""
    salts = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(own), 4096):
        drawn = _mixed(own[at : at + 4096, None] + salts[None, :])
        ones += np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    margin = 2 * ones - len(own)
    words = np.packbits(margin > 0, bitorder="little").view(np.int64)
    margin, place = margin[: segments * width].reshape(segments, width), 1 << np.arange(width)
    edge = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :near]
    return words, ((margin > 0) @ place).astype(np.int32), place[edge].sum(axis=1).astype(np.int32)


def wide_fingerprints(docs: DataFrame, width: int, bits: int, segments: int, segment_bits: int, near: int) -> DataFrame:
    """(doc_id, t, id, n, fp, seg, edge) of every row: t hashes the text, id names its set of n shingles; no fp for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingle_set(t, width) for t in pdf["text"]]
            found = [wide_fingerprint(s, bits, segments, segment_bits, near) if len(s) else (None, None, None) for s in own]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "t": pdf["t"], "id": [_name(s) for s in own], "n": [len(s) for s in own]})
            for i, c in enumerate(("fp", "seg", "edge")):
                out[c] = [f[i] for f in found]
            yield out

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, t long, id long, n long, fp array<long>, seg array<int>, edge array<int>")


def _dealt(nodes: DataFrame, each: int = 4096) -> DataFrame:
    """nodes over so many tasks that each has about `each` of them: lists of keys are many times as long as the files they come from."""
    return nodes.repartition(1 + nodes.count() // each, "id")


def _bucketed(nodes: DataFrame, w: int, *kept: str) -> DataFrame:
    """(key, *kept): each node under its key of every segment, and under those of the ball that flips one edge bit."""
    part = nodes.select(*kept, F.posexplode(F.arrays_zip("seg", "edge")).alias("s", "z"))
    flips = F.filter(F.array(*[F.lit(1 << i) for i in range(w)]), lambda b: b.bitwiseAND(F.col("z.edge")) != 0)
    ball = part.select(*kept, "s", "z.seg", F.explode(F.concat(F.array(F.lit(0)), flips)).alias("flip"))
    key = F.shiftleft(F.col("s").cast("long"), w).bitwiseOR(F.col("seg").bitwiseXOR(F.col("flip")).cast("long"))
    return ball.select(key.alias("key"), *kept)


def _ends(nodes: DataFrame, w: int) -> DataFrame:
    """(x, y), each (id, n, check): of every segment's own key the smallest node and two drawn ones, as pairs, without a row for each node."""
    own = nodes.select("id", "n", "check", F.posexplode("seg").alias("s", "seg"))
    own = own.withColumn("key", F.shiftleft(F.col("s").cast("long"), w).bitwiseOR(F.col("seg").cast("long")))
    state = F.struct("id", "n", "check")
    drawn = F.struct(F.xxhash64("key", "id").alias("h"), state.alias("e"))
    three = own.groupBy("key").agg(F.min(state).alias("hub"), F.min(drawn)["e"].alias("p"), F.max(drawn)["e"].alias("q")).filter("p.id != q.id")
    pairs = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("hub", "p"), ("hub", "q"), ("p", "q"))])
    return three.select(F.explode(pairs).alias("z")).select("z.x", "z.y").filter("x.id != y.id")


def _meet_first(key: Column, w: int) -> Column:
    """True for one of the keys that nodes a and b share, that each pair comes once: (aseg, aedge) and (bseg, bedge) of both.

    It is the same key whichever of the two is a, as a pair may come in one order from one bucket and in the other from the next.
    """

    def meet(p, pe, q, qe):
        d = p.bitwiseXOR(q)
        n, either = F.bit_count(d), d.bitwiseAND(pe.bitwiseOR(qe))
        both = (either == d) & (d.bitwiseAND(pe) != 0) & (d.bitwiseAND(qe) != 0)
        return (n == 0) | ((n == 1) & (either != 0)) | ((n == 2) & both)

    s = F.shiftright(key, w).cast("int")
    places = F.transform(F.arrays_zip("aseg", "aedge", "bseg", "bedge"), lambda z: meet(z["aseg"], z["aedge"], z["bseg"], z["bedge"]))
    first = F.col("a") < F.col("b")
    p, q = (F.when(first, F.get(c, s)).otherwise(F.get(d, s)) for c, d in (("aseg", "bseg"), ("bseg", "aseg")))
    pe, qe = (F.when(first, F.get(c, s)).otherwise(F.get(d, s)) for c, d in (("aedge", "bedge"), ("bedge", "aedge")))
    d = p.bitwiseXOR(q)
    low = d.bitwiseAND(-d)
    high = d.bitwiseXOR(low)
    two = F.when((low.bitwiseAND(pe) != 0) & (high.bitwiseAND(qe) != 0), low).otherwise(high)
    flip = F.when(F.bit_count(d) == 2, two).otherwise(F.when(d.bitwiseAND(pe) != 0, d).otherwise(0))
    own = key.bitwiseAND((1 << w) - 1) == p.bitwiseXOR(flip).cast("long")
    return own & (F.array_position(places, True) == s + 1)


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, own): 32-bit hashes of the shingles of each set in wanted(id, t), from one text each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.unique((shingle_set(t, width) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "own": own})

    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).join(wanted, "t").groupBy("id").agg(F.first("text").alias("text"))
    return texts.mapInPandas(run, "id long, own array<int>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, most_bits: int) -> DataFrame:
    """The pairs (a, b) with at most most_bits different bits whose sets have percent or more of their union in common."""
    x = sets.select(F.col("id").alias("a"), F.col("fp").alias("afp"), F.col("own").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("fp").alias("bfp"), F.col("own").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common * 100 >= (F.size("x") + F.size("y") - common) * percent
    return pairs.join(x, "a").join(y, "b").filter((_apart("afp", "bfp") <= most_bits) & alike).select("a", "b")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 1024, segments: int = 16, segment_bits: int = 24, near: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, component_id; see similar_rows()."""
    return similar_rows(docs, width, percent, bits, segments, segment_bits, near).select("doc_id", "component_id")


def similar_rows(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 1024, segments: int = 16, segment_bits: int = 24, near: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, t (hash of the text), component, component_id, for links between texts whose sets of `width`-word shingles have a Jaccard
    similarity of at least percent / 100; component_id is the smallest doc_id that links reach.

    At a similarity of 0.8 about 15 in 100 bits of a SimHash differ, too many for balls that are complete. So the fingerprint
    has `bits` bits; each of its first segments stands in the table under its own key and under those with one of its `near`
    bits flipped whose majority was the closest, and two texts meet where a segment differs in up to two such bits. Of 120
    pairs at exactly 0.8 all met in a segment (a test plants more). Complete distances (18 in 100 bits at most, three
    standard deviations above those at 0.8) and then the sets themselves (32-bit hashes) decide. Tables far beyond 2 ** 30
    different texts want more bits per segment, and more segments.

    Equal sets are one node. A few nodes of each segment's own key are compared first (_ends); buckets that hold one component
    only are then never listed by node. In the others a node is compared with that smallest node of its buckets that it meets
    most often, then with the other smallest ones, and what is still apart with all nodes of other components in its buckets but
    for those of the smallest node's component among each other; only pairs that are connected anyway are left out. Null or blank texts
    are near-duplicates of each other only. Repeated rows stay; rows with null doc_id get the group's smallest doc_id (null
    if it has none); an empty table gives an empty result; other columns are not read.
    """
    most_check, most_bits = 21, bits * 18 // 100
    rows = staged(wide_fingerprints(docs, width, bits, segments, segment_bits, near), "wide")
    first = F.min_by(F.struct("t", "n", "fp", "seg", "edge"), "t")
    nodes = staged(rows.groupBy("id").agg(F.min("doc_id").alias("least"), first.alias("f")).select("id", "least", "f.*"), "nodes")
    solid = nodes.filter("n > 0").select("id", "n", "fp", "seg", "edge")
    dealt = _dealt(solid.select("id", "n", F.get("fp", F.lit(0)).alias("check"), "seg", "edge"))

    def may_be(an, bn, ac, bc):
        sizes = F.least(an, bn) * 100 >= F.greatest(an, bn) * percent
        return sizes & (F.bit_count(F.col(ac).bitwiseXOR(F.col(bc))) <= most_check)

    def placed(frame: DataFrame, node: str, name: str, reached: DataFrame) -> DataFrame:
        return frame.join(reached.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    def read(ids: DataFrame) -> DataFrame:
        return staged(_sets(docs, ids.join(nodes.select("id", "t"), "id"), width).join(nodes.select("id", "fp"), "id"), "sets")

    ends = _ends(dealt, segment_bits).filter(may_be("x.n", "y.n", "x.check", "y.check"))
    ends = staged(ends.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "ends")
    sets = read(ends.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = staged(_similar(ends, sets, percent, most_bits), "links")

    # Nearly all keys have one node, so a sum by key holds plain numbers only; sizes and checks are joined to the few that stay.
    keyed = _bucketed(placed(dealt, "id", "component", components(links)), segment_bits, "id", "component")
    hubs = keyed.groupBy("key").agg(
        F.count("*").alias("c"), F.min("id").alias("hub"), F.max("id").alias("last"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low != high").select("key", "c", "hub", "last")
    for end in ("hub", "last"):
        state = solid.select(F.col("id").alias(end), F.struct("id", "n", F.get("fp", F.lit(0)).alias("check")).alias("state"))
        hubs = hubs.join(state, end).drop(end).withColumnRenamed("state", end)
    hubs = hubs.filter((F.col("c") > 2) | may_be("hub.n", "last.n", "hub.check", "last.check"))
    member = staged(_bucketed(dealt, segment_bits, "id", "n", "check").join(hubs.select("key", "hub"), "key"), "buckets")
    stars = member.filter("id != hub.id").filter(may_be("n", "hub.n", "check", "hub.check"))
    stars = staged(stars.groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(F.count("*").alias("c")), "stars")
    sets = sets.unionByName(read(member.select("id").distinct().join(sets.select("id"), "id", "left_anti")))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    links = links.unionByName(staged(_similar(best, sets, percent, most_bits), "links"))

    reached = components(links)
    rest = placed(placed(stars, "a", "ac", reached), "b", "bc", reached).filter("ac != bc").join(best, ["a", "b"], "left_anti").select("a", "b")
    links = links.unionByName(staged(_similar(rest, sets, percent, most_bits), "links"))

    # One row for each node, with its buckets and the component of their smallest node, so that fingerprints are joined once.
    reached = components(links)
    own = placed(member.select("key", "id", F.col("hub.id").alias("hub")), "hub", "most", reached)
    own = own.groupBy("id").agg(F.collect_list(F.struct("key", "most")).alias("at"))
    own = staged(placed(own, "id", "c", reached).join(solid, "id"), "open")
    side = lambda p: [F.col(c).alias(f"{p}{d}") for c, d in (("id", ""), ("n", "n"), ("c", "c"), ("fp", "fp"), ("seg", "seg"), ("edge", "edge"))]
    x = own.select(*side("a"), F.explode(F.filter("at", lambda z: z["most"] != F.col("c"))).alias("z")).withColumn("key", F.col("z.key")).drop("z")
    y = own.select(*side("b"), F.explode("at").alias("z")).withColumn("key", F.col("z.key")).withColumn("bout", F.col("bc") != F.col("z.most")).drop("z")
    sizes = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    once = (F.col("ac") != F.col("bc")) & (~F.col("bout") | (F.col("a") < F.col("b")))
    crossed = x.join(y, "key").filter(once & sizes & (_apart("afp", "bfp") <= most_bits) & _meet_first(F.col("key"), segment_bits))
    crossed = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(ends)
    crossed = crossed.join(seen, ["a", "b"], "left_anti")
    links = links.unionByName(staged(_similar(crossed, sets, percent, most_bits), "links"))

    label = placed(nodes.select("id", "least"), "id", "component", components(links))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "t", "id").join(label.join(smallest, "component").select("id", "component", "component_id"), "id").drop("id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of similar_rows(): of its smallest doc_id, and there of the smallest hash of the text.

    Rows of one doc_id with unrelated texts are in different groups and stay. Groups without a doc_id keep all their rows. Columns of any
    name are kept, nulls too; an empty table stays empty.
    """
    own = similar_rows(docs, width, percent).filter("doc_id = component_id")
    keep = own.groupBy("component").agg(F.min("t").alias("_text"), F.first("doc_id").alias("_doc")).select("_doc", "_text")
    copies = own.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_text")).agg((F.count("*") > 1).alias("_more"))
    keep = staged(keep.join(copies, ["_doc", "_text"]), "kept")
    text = F.col("text").cast("string")
    here = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64(text) == F.col("_text"))
    once = docs.join(keep.filter("not _more"), here, "left_semi")
    more = docs.join(keep.filter("_more"), here, "left_semi").withColumn("_text", F.xxhash64(text)).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return once.unionByName(more).unionByName(docs.filter("doc_id is null"))
