"""Operator 7: near-duplicate documents by ProbMinHash, banding and verification.

A document is its set of word shingles (five lower-cased words), each weighted by
1 + ln(times it occurs).  Every shingle sends arrivals of a Poisson process whose
rate is its weight, each to a random register; a register keeps the shingle of its
first arrival, and a shingle stops once its next arrival is later than what every
register holds.  Two documents agree in a register with the probability Jaccard of
their weighted shingles.  A document with a repeated shingle has a second signature
in which all weights are 1, so that documents agree with the Jaccard of their shingle
sets too, however often a line is repeated.  Documents that agree in all registers of
a band of either are candidates; a candidate pair is linked if the Jaccard of the
shingle sets, computed exactly, is ``LEAST`` or more.

Documents with equal shingles and counts are one candidate.  A bucket's members are
first compared with its smallest member, then with a random one; only the pairs that
then still lie in different components are compared among themselves, in chunks, so
no linkable pair of a bucket is left out and no task holds a bucket.

Edge cases: a text of one to four words is one shingle; a text without words (null,
empty) is a class of its own; rows that repeat a doc_id are one document; a class is
named by its smallest doc_id, and rows without doc_id are kept only where the whole
class has none.  ``near_classes`` marks all rows of a kept document; ``keep_one``
leaves a single row of each class, also where rows repeat or have no doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import arrow_map, stored, workers_import
from baitscope.llm.graph import components

#: Words of a shingle, least Jaccard; bands and registers of a band (a pair at 0.8 is missed 3 times in
#: a million, by the signatures of equal weights).
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
#: Members of a chunk of a bucket.
CHUNK = 256
WORD = re.compile(r"\w+")
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ x >> np.uint64(30)) * MIX
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, shingle and times of all texts, sorted by document and shingle."""
    seen: dict[str, int] = {}
    codes, sizes = [], []
    for text in texts:
        words = WORD.findall(text.lower()) if text else []
        codes += [seen.setdefault(w, len(seen)) for w in words]
        sizes.append(len(words))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in seen], np.uint64)
    h = own[np.array(codes)]
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    # A shingle starts at each word that has WORDS - 1 words of its document after it; a short text is one shingle.
    count = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - sizes, count)
    stop = np.repeat(ends, count)
    value = np.full(len(doc), WORDS, np.uint64)
    for k in range(WORDS):
        at = start + k
        value = mixed(value * GOLD + np.where(at < stop, h[np.minimum(at, len(h) - 1)], np.uint64(0)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def signatures(n: int, doc: np.ndarray, value: np.ndarray, times: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that each register of each of ``n`` documents holds (0 for documents without shingles)."""
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    rate = 1 + np.log(times)
    at, done = np.zeros(len(doc)), 0
    own, v = doc, value
    while len(own):
        # Few shingles left: several arrivals of each at once.
        many = max(1, min(64, 20_000 // len(own)))
        steps = np.arange(done + 1, done + many + 1, dtype=np.uint64) * GOLD
        x = mixed(v[:, None] + steps[None, :])
        gap = -np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        when = at[:, None] + np.cumsum(gap, axis=1)
        where = own[:, None] * registers + (mixed(x + MIX) % np.uint64(registers)).astype(np.int64)
        flat, time = where.ravel(), when.ravel()
        np.minimum.at(first, flat, time)
        won = np.flatnonzero(first[flat] == time)
        held[flat[won]] = v[won // many]
        at, done = when[:, -1], done + many
        live, back = np.unique(own, return_inverse=True)
        latest = first.reshape(n, registers)[live].max(axis=1)
        stay = at < latest[back]
        own, v, at, rate = own[stay], v[stay], at[stay], rate[stay]
    return held.reshape(n, registers)


def band_keys(held: np.ndarray) -> np.ndarray:
    """A key of each band of each signature."""
    bands = held.reshape(len(held), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, (len(held), BANDS))
    for k in range(ROWS):
        key = mixed(key * GOLD + bands[:, :, k])
    return np.ascontiguousarray(key).view(np.int64)


def sketch(batch: pa.RecordBatch) -> dict:
    """Fingerprints of the weighted set and band keys; both null for texts without words."""
    n = batch.num_rows
    doc, value, times = shingles(batch.column("text").to_pylist())
    fill = np.bincount(doc, minlength=n) > 0
    weighted = mixed(value + times.astype(np.uint64) * GOLD)
    starts = np.searchsorted(doc, np.flatnonzero(fill))
    prints = np.zeros((2, n), np.int64)
    if len(doc):
        prints[0, fill] = np.add.reduceat(weighted, starts).view(np.int64)
        prints[1, fill] = np.add.reduceat(mixed(weighted + MIX), starts).view(np.int64)
    bands = [k if f else None for k, f in zip(band_keys(signatures(n, doc, value, times)).tolist(), fill.tolist(), strict=True)]
    # Without repeated shingles the signature of equal weights is the same.
    repeats = np.bincount(doc[times > 1], minlength=n) > 0
    own = repeats[doc]
    again = signatures(int(repeats.sum()), (np.cumsum(repeats) - 1)[doc[own]], value[own], np.ones(int(own.sum()), np.int64))
    for i, more in zip(np.flatnonzero(repeats).tolist(), band_keys(again).tolist(), strict=True):
        bands[i] = sorted({*bands[i], *more})
    return {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "f1": pa.array(prints[0], mask=~fill), "f2": pa.array(prints[1], mask=~fill),
            "bands": bands}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct shingles."""
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def verified(rows: DataFrame, least: float) -> DataFrame:
    """u, v of linked pairs; rows: home, chunk, role, node, part, shingles.

    Rows of one home and chunk are compared as they stream by: all with role 1 with
    all with role 0, and those of role 0 among themselves, but never two of the same
    ``part``.  Role 0 holds at most a chunk of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, us, vs = None, [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("home", "chunk", "role", "node", "part")]
            packed = batch.column("shingles")
            for i, (home, chunk, role, node, part) in enumerate(zip(*columns, strict=True)):
                if (home, chunk) != at:
                    at, held = (home, chunk), []
                own = np.frombuffer(packed[i].as_py(), "<u8")
                for other, of, sets in held:
                    small, large = sorted((len(own), len(sets)))
                    if of != part and other != node and small >= least * large and jaccard(sets, own) >= least:
                        us.append(node)
                        vs.append(other)
                        if role == 1 and of == -1:
                            break
                if role == 0:
                    held.append((node, part, own))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []

    workers_import(rows.sparkSession)
    dealt = rows.repartition("home", "chunk").sortWithinPartitions("home", "chunk", "role", "node")
    return dealt.mapInArrow(run, "u long, v long")


def star_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verify candidates (node, pivot): a pivot's set goes to each chunk of its candidates."""
    c = F.col
    names = ["home", "chunk", "role", "node", "part", "shingles"]
    crowd = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(crowd, "pivot").withColumn("chunk", F.pmod(F.xxhash64("node"), c("chunks")).cast("int"))
    members = dealt.join(sets, "node").select(c("pivot").alias("home"), "chunk", F.lit(1).alias("role"), "node",
                                              F.lit(-2).cast("long").alias("part"), "shingles")
    pivots = crowd.withColumn("chunk", F.explode(F.sequence(F.lit(0), c("chunks") - 1))).withColumnRenamed("pivot", "node")
    pivots = pivots.join(sets, "node").select(c("node").alias("home"), "chunk", F.lit(0).alias("role"), "node",
                                              F.lit(-1).cast("long").alias("part"), "shingles")
    return verified(members.select(names).union(pivots.select(names)), least)


def all_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verify the pairs of each bucket (home, node, part) between different parts, chunk by chunk."""
    c = F.col
    names = ["home", "chunk", "role", "node", "part", "shingles"]
    sizes = members.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "home").withColumn("own", F.pmod(F.xxhash64("node"), c("chunks")).cast("int"))
    held = dealt.select("home", c("own").alias("chunk"), F.lit(0).alias("role"), "node", "part")
    visits = dealt.where("own > 0").select("home", F.explode(F.sequence(F.lit(0), c("own") - 1)).alias("chunk"),
                                           F.lit(1).alias("role"), "node", "part")
    return verified(held.union(visits).join(sets, "node").select(names), least)


def link_table(reps: DataFrame, sets_of, least: float = LEAST) -> DataFrame:
    """u, v of links between representatives (node, bands); ``sets_of(nodes)`` gives node, shingles."""
    c = F.col
    members = reps.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    members = stored(members.join(shared.select("bucket", "low"), "bucket"), "bucket-members")
    sets = stored(sets_of(members.select("node").distinct()), "shingle-sets")
    pairs = members.where("node != low").select("node", c("low").alias("pivot")).distinct()
    links = stored(star_pairs(pairs, sets, least), "links")

    def apart(found: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components, each with its component as part."""
        of = members.select("bucket", "node", "low").join(components(found), "node", "left").select(
            "bucket", "node", "low", F.coalesce("component", "node").alias("part"))
        split = of.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b")
        return of.join(split.select("bucket"), "bucket")

    open_members = stored(apart(links), "open-members")
    pivot = open_members.groupBy("bucket").agg(F.min_by(F.struct("node", "part"), F.xxhash64("node", F.lit(3))).alias("p"))
    second = (open_members.join(pivot, "bucket").where("part != p.part AND p.node != low AND node != low")
              .select("node", c("p.node").alias("pivot")).distinct())
    links = stored(links.union(star_pairs(second, sets, least)), "links")
    rest = stored(apart(links), "open-members")
    # Buckets with the same members are compared once; a pair of members has been compared by now.
    same = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"),
                                      F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    homes = same.where("n > 2").groupBy("n", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket")
    last = rest.join(homes, "bucket").select(c("bucket").alias("home"), "node", "part")
    return links.union(all_pairs(last, sets, least))


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, t (a hash of the text), component (null for texts without words), class_id for every row."""
    c = F.col
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    schema = "doc_id long, t long, f1 long, f2 long, bands array<long>"
    sketches = stored(arrow_map(rows, "text", schema, sketch), "sketches")
    reps = stored(sketches.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "bands")).alias("r")).select(
            F.xxhash64("f1", "f2").alias("node"), "f1", "f2", "r.doc_id", "r.t", "r.bands"), "representatives")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Shingles of the wanted representatives, from their whole texts."""
        def make(batch: pa.RecordBatch) -> dict:
            doc, value, _ = shingles(batch.column("text").to_pylist())
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            packed = [value[i:j].astype("<u8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return {"node": batch.column("node"), "shingles": packed}

        wanted = reps.select("node", "t", F.coalesce("doc_id", F.lit(-1)).alias("d")).join(nodes, "node")
        texts = rows.withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["t", "d"])
        made = arrow_map(texts, "text", "node long, shingles binary", make)
        return made.groupBy("node").agg(F.first("shingles").alias("shingles"))

    found = components(link_table(reps.select("node", "bands"), sets_of, least))
    of = reps.join(found, "node", "left").select("f1", "f2", "doc_id", F.coalesce("component", "node").alias("component"))
    names = of.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    facts = of.join(names, "component").select("f1", "f2", "component", "class_id")
    out = sketches.select("doc_id", "t", "f1", "f2").join(facts, ["f1", "f2"], "left")
    return out.select("doc_id", "t", "component", F.when(c("f1").isNull(), c("doc_id")).otherwise(c("class_id")).alias("class_id"))


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, kept for every row of (doc_id, text)."""
    kept = F.col("class_id").isNull() | F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))
    return _classes(docs, least).select("doc_id", "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of ``docs``, all columns, of each class; rows with neither words nor doc_id are classes of their own."""
    c = F.col
    texts = _classes(docs, least).groupBy("doc_id", "t", "component").agg(F.count("*").alias("n"))
    texts = stored(texts.where("component IS NOT NULL OR (n > 1 AND doc_id IS NOT NULL)"), "class-texts")
    # The text that a class keeps; of texts without words, each.
    first = texts.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(c("doc_id").isNull().alias("z"), "doc_id", "t")).alias("r"))
    marked = texts.join(first, "component", "left").withColumn(
        "stays", c("r").isNull() | (c("doc_id").eqNullSafe(c("r.doc_id")) & (c("t") == c("r.t"))))
    marked = marked.where("NOT stays OR n > 1").select(c("doc_id").alias("_doc"), c("t").alias("_text"), "stays")
    gone, often = stored(marked.where("NOT stays").drop("stays"), "duplicates"), stored(marked.where("stays").drop("stays"), "repeated")
    same = c("doc_id").cast("long").eqNullSafe(c("_doc")) & (F.xxhash64("text") == c("_text"))
    single = docs.join(gone.union(often), same, "left_anti")
    # Repeated rows of a text that stays become one, partly before they are shuffled.
    one = docs.join(often, same).groupBy("_doc", "_text").agg(F.min(F.struct(*[docs[n] for n in docs.columns])).alias("_row"))
    return single.union(one.select("_row.*"))
