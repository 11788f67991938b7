"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words within a sentence) and
units (after a number) are typed placeholders, everything else stays a lower-cased
word.  Windows of ``WINDOW`` tokens are hash-joined with those of the benchmark in
two forms.  With its lower-cased tokens as they are, any window counts wherever a
document repeats it.  As a template, a window with a placeholder and at least
``LITERALS`` words counts too: matches of a document and an item at one offset are
an alignment, in which an item's slot value stands for the document value it meets
at most of its places (of two at half each, the one in more windows); a value that
meets none at half of them stands for nothing.  Windows that contradict this do not
count, so a question asked again with other numbers or names is caught and an
accidental match is not.  A document is contaminated by an item if it covers at
least ``SHARE`` of the item's windows, or of those with ``LITERALS`` words, as a
question asked again can match no others.

Document windows pass a bitmap of the benchmark's window hashes (a fixed 2**22 bits,
however large the benchmark) before they are joined; the join decides.  Windows that
many items share make no rows of documents times items:

* Items of one template, with equal slots at the same places, are a class.  They differ
  only in windows that hold a slot as it is; all else of a class is joined once.  A class
  whose common windows suffice contaminates with all its items.  Where they do not but
  the slots of some items might, those items are looked at one by one.
* A document that covers ``SHARE`` of the windows covers one of the rarest
  1 - ``SHARE`` of them.  Only these are joined to find documents and classes that may
  meet, so a common first sentence meets nothing unless it is half of an item.

Edge cases: an item of fewer than ``LITERALS`` tokens is never matched, one of fewer
than ``WINDOW`` tokens is a single shorter window; null and empty texts match
nothing; equal items are one item and items of one class are reported together, each named by
the smallest id; an empty benchmark
flags nothing; repeated rows get the same result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitscope.llm.common import arrow_map, pieces, stored, workers_import

WINDOW, LITERALS, SHARE = 8, 4, 0.5
BITS = 22
#: FIXED VALUES: unit words and signs that are placeholders after a number.
UNITS = frozenset("""
mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years percent % $ € £ dollar dollars cent cents euro euros pound pounds
meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams
kilogram kilograms liter liters litre litres gallon gallons degree degrees mph kmh
""".split())
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[%$€£]")
LITERAL, NAME, NUMBER, UNIT = 0, 1, 2, 3
PLACE = np.array([0, 0x51ED270B, 0x2545F491, 0x6C62272E], np.uint64)
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Seed of the hashes of windows with their tokens as they are.
VERBATIM = 1 << 32


def _analysed(raw: str) -> list[tuple[int, int]]:
    """(hash, kind) of the tokens of a word between spaces; kinds still regardless of what stands before."""
    out = []
    for token in TOKEN.findall(raw):
        low = token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else LITERAL
        out.append((xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), kind))
    return out


def templates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hash, kind, and the number of tokens of each text."""
    seen: dict[str, int] = {}
    codes, words = [], []
    for text in texts:
        raw = (text or "").split()
        codes += [seen.setdefault(w, len(seen)) for w in raw]
        words.append(len(raw))
    parts = [_analysed(w) for w in seen]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = [x for p in parts for x in p]
    value = np.array([x[0] for x in flat], np.uint64)
    kind = np.array([x[1] for x in flat], np.int8)
    stops = np.array([w.rstrip("\"')]").endswith((".", "!", "?", ":", ";")) for w in seen], bool)
    codes = np.array(codes, np.int64)
    of_text = np.repeat(np.arange(len(texts)), words)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(texts), np.int64)
    # A word starts a sentence at the start of a text and after a word that ends one.
    opens = np.ones(len(codes), bool)
    opens[1:] = stops[codes[:-1]] | (of_text[1:] != of_text[:-1])
    n = sizes[codes]
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat((np.cumsum(sizes) - sizes)[codes] - first, n)
    value, kind = value[at], kind[at].copy()
    lead = np.zeros(len(at), bool)
    lead[first[n > 0]] = opens[n > 0]
    kind[(kind == NAME) & lead] = LITERAL
    after = np.zeros(len(at), bool)
    after[1:] = kind[:-1] == NUMBER
    text = np.repeat(of_text, n)
    after[1:] &= text[1:] == text[:-1]
    kind[(kind == UNIT) & ~after] = LITERAL
    return value, kind, np.bincount(text, minlength=len(texts))


def rolled(token: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each token on."""
    m = max(0, len(token) - size + 1)
    h = np.full(m, seed, np.uint64)
    for k in range(size):
        h = (h ^ token[k:k + m]) * GOLD
        h ^= h >> np.uint64(29)
    return h


def windows(value: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the tokens and of the template of the window of ``size`` at each token, and its number of words."""
    words = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    plain = rolled(value, size, VERBATIM + size)
    typed = rolled(np.where(kind == LITERAL, value, PLACE[kind]), size, size)
    return plain, typed, words[size:] - words[:len(plain)]


def slots(value: np.ndarray, kind: np.ndarray, at: int, size: int) -> list[int]:
    """Placeholder values of a window, in order."""
    own = value[at:at + size][kind[at:at + size] != LITERAL]
    return own.view(np.int64).tolist()


def agreeing(matches: list[dict]) -> list[int]:
    """Places of an alignment's windows (place, spots, filled, found) whose slot values agree with the alignment's map."""
    met, windows_of = {}, Counter()
    for w in matches:
        triples = list(zip(w["spots"], w["filled"], w["found"], strict=True))
        met.update({spot: (own, other) for spot, own, other in triples})
        windows_of.update({(own, other) for _, own, other in triples})
    places_of = Counter(met.values())
    values, all_places = defaultdict(list), Counter()
    for (own, other), n in places_of.items():
        values[own].append((n, windows_of[own, other], other))
        all_places[own] += n
    best = {own: max(found) for own, found in values.items()}
    stands = {(own, other) for own, (n, _, other) in best.items() if 2 * n >= all_places[own]}
    return [w["place"] for w in matches if all(pair in stands for pair in zip(w["filled"], w["found"], strict=True))]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of each distinct item, as it is and as a template.

    item_id, class_id (smallest item of the class), members (items of the class), size, total (windows of the item),
    wordy (those with ``LITERALS`` words), place, good (it is one of these), typed (as a template), own (as it is, with
    slots: not all of the class have it), h, filled and spots (the slots of a template, equal ones with equal numbers, and
    their places in the item).
    """
    items = benchmark.groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).where("text IS NOT NULL")
    names = ["item_id", "form", "size", "total", "wordy", "place", "good", "typed", "own", "h", "filled", "spots"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(),
             pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = [[] for _ in names]
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                value, kind, _ = templates([text])
                size = min(WINDOW, len(value))
                if size < LITERALS:
                    continue
                plain, typed, words = windows(value, kind, size)
                wordy = int((words >= LITERALS).sum())
                numbers: dict[int, int] = {}
                slot = np.array([-1 if k == LITERAL else numbers.setdefault(v, len(numbers))
                                 for v, k in zip(value.tolist(), kind.tolist(), strict=True)], np.int64)
                shape = np.where(kind == LITERAL, value, PLACE[kind]).tobytes() + slot.tobytes()
                form = xxhash.xxh3_128_digest(shape)
                for at in range(len(plain)):
                    good, slotted = bool(words[at] >= LITERALS), bool(words[at] < size)
                    rows = [(False, slotted, int(plain[at].view(np.int64)), [], [])]
                    if good and slotted:
                        spots = at + np.flatnonzero(kind[at:at + size] != LITERAL)
                        rows.append((True, False, int(typed[at].view(np.int64)), slot[spots].tolist(), spots.tolist()))
                    for row in rows:
                        for column, x in zip(out, (item, form, size, len(plain), wordy, at, good, *row), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    workers_import(benchmark.sparkSession)
    schema = ("item_id long, form binary, size int, total int, wordy int, place int, good boolean, typed boolean, own boolean, h long, "
              "filled array<long>, spots array<int>")
    rows = stored(items.mapInArrow(run, schema), "benchmark")
    # One row an item has place 0 as it is.
    classes = rows.where("place = 0 AND NOT typed").groupBy("form").agg(F.min("item_id").alias("class_id"), F.count("*").alias("members"))
    return stored(rows.join(classes, "form").drop("form"), "benchmark")


def needed(n: Column, share: float) -> Column:
    """The least number of ``n`` windows that is at least ``share`` of them, or one less where rounding might decide."""
    return F.greatest(F.ceil(n * share - 1e-9), F.lit(1))


def rarest(bench: DataFrame, share: float) -> DataFrame:
    """class_id, typed, h of the windows of which every document that covers ``share`` of a class's windows has one."""
    c = F.col
    common = bench.groupBy("typed", "h").agg(F.count("*").alias("n"))
    # A place is as common as its most common window; the window function sees the places of one item.
    places = bench.join(common, ["typed", "h"]).groupBy("class_id", "total", "wordy", "place", "good").agg(F.max("n").alias("n"))
    order = Window.partitionBy("class_id").orderBy("n", "place").rowsBetween(Window.unboundedPreceding, 0)
    places = places.select("*", F.count("*").over(order).alias("rank"), F.count_if("good").over(order).alias("good_rank"))
    kept = places.where((c("rank") <= c("total") - needed(c("total"), share) + 1)
                        | (c("good") & (c("good_rank") <= c("wordy") - needed(c("wordy"), share) + 1)))
    return bench.join(kept.select("class_id", "place"), ["class_id", "place"]).select("class_id", "typed", "h").distinct()


def document_windows(rows: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """key, at, typed, h, found (slot values) of the windows of (key, text) whose hash is in the bitmap.

    A text's equal windows are one row (with ``at`` 0) if they are not templates.
    """
    def make(batch: pa.RecordBatch) -> dict:
        keys = batch.column("key").to_pylist()
        value, kind, n = templates(batch.column("text").to_pylist())
        ends = np.cumsum(n)
        out = {"key": [], "at": [], "typed": [], "h": [], "found": []}

        def add(d: int, at: int, typed: bool, h: int, found: list[int]) -> None:
            for column, x in zip(out.values(), (keys[d], at, typed, h, found), strict=True):
                column.append(x)

        def marked(h: np.ndarray, size: int, wanted: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
            """Places of the windows within one text that are in the bitmap, and their texts."""
            bit = h >> np.uint64(64 - BITS)
            hit = np.flatnonzero(wanted & ((bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1) > 0))
            doc = np.searchsorted(ends, hit, side="right")
            inside = hit + size <= ends[doc] if len(hit) else np.zeros(0, bool)
            return hit[inside], doc[inside]

        for size in sizes:
            plain, typed, words = windows(value, kind, size)
            hit, doc = marked(plain, size, True)
            for d, h in sorted(set(zip(doc.tolist(), plain[hit].view(np.int64).tolist(), strict=True))):
                add(d, 0, False, h, [])
            hit, doc = marked(typed, size, (words >= LITERALS) & (words < size))
            for at, d in zip(hit.tolist(), doc.tolist(), strict=True):
                add(d, at - int(ends[d] - n[d]), True, int(typed[at].view(np.int64)), slots(value, kind, at, size))
        return out

    return arrow_map(rows, "text", "key long, at int, typed boolean, h long, found array<long>", make)


def agreed(aligned: DataFrame) -> DataFrame:
    """The agreeing windows of alignments (key, class_id, members, total, wordy, matches), as rows with place, good and sure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [agreeing(matches) for matches in batch.column("matches").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(places)), [len(p) for p in places]))
            place, yes = pa.array([x for p in places for x in p], pa.int32()), pa.array([True] * sum(map(len, places)), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(of) for k in range(5)] + [place, yes, yes], [*batch.schema.names[:5], "place", "good", "sure"])

    return aligned.mapInArrow(run, "key long, class_id long, members long, total int, wordy int, place int, good boolean, sure boolean")


def share_of(places: Column, good: Column) -> Column:
    """Share of the windows at ``places``, or of those with ``LITERALS`` words at ``good``."""
    return F.greatest(F.size(places) / F.col("total"), F.size(good) / F.nullif(F.col("wordy"), F.lit(0)))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """key, n_items, items, share of contaminated documents; ``key`` is ``document_key``.

    ``n_items`` counts items; ``items`` has the smallest item of each of their classes.  ``share`` is that of the class's
    common windows where these suffice and the class has other items.
    """
    c = F.col
    bench = benchmark_windows(benchmark)
    sizes = [r["size"] for r in bench.select("size").distinct().collect()]
    # At most 2**BITS numbers, 8 bytes each.
    marked = bench.select(F.shiftrightunsigned("h", 64 - BITS).alias("b")).distinct().toArrow()["b"].to_numpy()
    bits = np.zeros(1 << BITS, bool)
    bits[marked] = True
    bitmap = np.packbits(bits, bitorder="little")
    rows = docs.select(document_key().alias("key"), "text").where("text IS NOT NULL")
    found = stored(document_windows(rows, sizes, bitmap), "found")
    of_class = ["class_id", "members", "total", "wordy"]
    shapes = bench.select(*of_class, "place", "good", "typed", "own", "h", "filled", "spots").distinct()
    maybe = found.select("key", "typed", "h").join(rarest(bench, share), ["typed", "h"]).select("key", "class_id").distinct()
    met = stored(maybe.join(shapes, "class_id").join(found, ["key", "typed", "h"]).where(F.size("found") == F.size("filled")), "met")

    pair = ["key", *of_class]
    # An alignment has at most one match for each place of the item.
    aligned = met.where("typed").groupBy(*pair, (c("at") - c("place")).alias("offset")).agg(
        F.collect_set(F.struct("place", "spots", "filled", "found")).alias("matches"))
    plain = met.where("NOT typed").select(*pair, "place", "good", (~c("own") | (c("members") == 1)).alias("sure"))
    covered = plain.union(agreed(aligned.select(*pair, "matches"))).groupBy(*pair).agg(
        *[F.collect_set(F.when(when, c("place"))).alias(name) for name, when in
          {"places": c("sure"), "wordy_places": c("sure") & c("good"), "all_places": F.lit(True), "all_wordy": c("good")}.items()])
    covered = stored(covered.withColumns({"share": share_of(c("places"), c("wordy_places")),
                                          "most": share_of(c("all_places"), c("all_wordy"))}), "covered")
    whole = covered.where(c("share") >= share).select("key", "class_id", c("members").alias("n"), "share")
    # The others count with the items' own windows, which join the few items that have them.
    own = met.where("own").select("key", "class_id", "place", "good", "h").distinct().join(
        covered.where((c("share") < share) & (c("most") >= share)).select(*pair, "places", "wordy_places"), ["key", "class_id"])
    own = own.join(bench.where("own").select("class_id", "place", "h", "item_id"), ["class_id", "place", "h"])
    single = own.groupBy(*pair, "item_id", "places", "wordy_places").agg(
        F.collect_set("place").alias("more"), F.collect_set(F.when(c("good"), c("place"))).alias("more_wordy"))
    single = single.withColumn("share", share_of(F.array_union("places", "more"), F.array_union("wordy_places", "more_wordy")))
    single = single.where(c("share") >= share).groupBy("key", "class_id").agg(F.count("*").alias("n"), F.max("share").alias("share"))
    return whole.union(single).groupBy("key").agg(
        F.sum("n").alias("n_items"), F.array_sort(F.collect_set("class_id")).alias("items"), F.max("share").alias("share"))


def document_key():
    """Equal for rows of the same doc_id and text."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull())


def flag(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, n_items, items, share (as ``contaminated`` has them) for every row of (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    hits = stored(contaminated(rows, benchmark, share), "contaminated")
    out = rows.select("doc_id", document_key().alias("key")).join(hits, "key", "left")
    return out.select(F.col("doc_id").cast("long"), F.col("n_items").isNotNull().alias("contaminated"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates."""
    hits = stored(contaminated(docs, benchmark, share).select(F.col("key").alias("_contaminated_key")), "contaminated")
    return docs.join(hits, document_key() == F.col("_contaminated_key"), "left_anti")
