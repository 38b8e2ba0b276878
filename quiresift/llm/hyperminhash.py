"""Near-duplicate classes by HyperMinHash.

Shingles fall into 128 buckets by the first bits of their hash. A bucket keeps
its smallest value, compressed to the count of its leading zeros and ten bits
of mantissa; an empty bucket borrows from one that a fixed random sequence
names, so short texts compare as long ones do. Bands of four registers bring
candidates together: two sets of similarity 0.8 share none of the 32 bands with
probability 5e-8. Candidates whose registers, corrected for chance
collisions, speak of next to no similarity go; the rest are compared on their
full sets. Sets that are equal are one class from the start.

The sets of a band are never paired with each other one by one. Each is
compared with the band's leader, the set with the most company over all bands.
With D the difference from the leader, two sets x and y are similar enough only
if |Dx & Dy| >= (|Dx| + |Dy| - t (|x| + |y|)) / 2, t = (1 - s) / (1 + s). Two
linked with the leader are in one component already; for all others this is
more than 0. Sets are told apart by their distance from the leader; for each
two classes of distance the least overlap that a link needs is held against the
most that any of their sets can have, and where it is possible, sets meet by
prefixes of their differences, the rarest shingles first, as long as they are
of different components. Keys that many sets share take a second and third
shingle. Sets far from the leader can, by the triangle inequality of Jaccard's
distance, be similar only to others nearly as far; these meet in the same way
by their differences from the empty set. So no link between different
components is passed over. Keys are split DEEPEST times at most: sets of
different components that share as many of their rarest differences as that,
or need to share fewer, are compared with one another however many they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.llm.textbytes import Texts, Words, pieces, run_hashes, scramble, split_batches, texts_of
from quiresift.operators.components import components
from quiresift.scratch import freed, keep

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
#: Registers of a band.
BAND = 4
#: Probes of an empty bucket before it takes the next one that is full.
PROBES = 256
#: A set that is not equal to one of fewer members cannot be 0.8 similar to it.
LEAST_SHINGLES = 4
#: Similarity to a leader under which a set is far from it; and the estimate, six standard deviations lower, under which it is not compared.
FAR, LEAST_LIKELY = 0.15, 0.02
SINGLE = np.uint64(0xA5A5A5A5A5A5A5A5)


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles of ``n`` words, ascending, and where each text's begin. Fewer words are one shingle."""
    words = Words(texts.lowered())
    hashes = words.hashes()
    runs = run_hashes(hashes, n)
    rows = words.rows()
    whole = np.flatnonzero(rows[: len(runs)] == rows[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
    values, of = runs[whole], rows[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, row in enumerate(short):
            own = hashes[words.first[row] : words.first[row + 1]]
            extra[k] = run_hashes(own, len(own))[0] ^ SINGLE
        values, of = np.concatenate([values, extra]), np.concatenate([of, short])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[fresh], of[fresh]
    return values, np.searchsorted(of, np.arange(texts.n + 1))


def _probe_table() -> np.ndarray:
    """For each attempt and bucket, the bucket to borrow from."""
    seeds = np.arange(PROBES * BUCKETS, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (scramble(scramble(seeds)) % np.uint64(BUCKETS)).astype(np.int64).reshape(PROBES, BUCKETS)


PROBE = _probe_table()


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 registers, a row of BUCKETS for each set (ascending); an empty set's are 0."""
    n = len(first) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    buckets = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    smallest = np.ones(len(values), bool)
    smallest[1:] = (buckets[1:] != buckets[:-1]) | (of[1:] != of[:-1])
    low = (values[smallest] << np.uint64(BUCKET_BITS)).astype(np.float64)  # the float's exponent and mantissa are what is stored
    bits = np.maximum(low, 1.0).view(np.uint64)
    zeros = np.uint64(63 + 1023) - np.minimum(bits >> np.uint64(52), np.uint64(63 + 1023))
    packed = (zeros << np.uint64(MANTISSA_BITS) | bits >> np.uint64(52 - MANTISSA_BITS) & np.uint64((1 << MANTISSA_BITS) - 1)).astype(np.uint16)
    own = np.zeros((n, BUCKETS), np.uint16)
    full = np.zeros((n, BUCKETS), bool)
    own[of[smallest], buckets[smallest]] = packed
    full[of[smallest], buckets[smallest]] = True
    out = own.copy()
    row, bucket = np.nonzero(~full & full.any(1, keepdims=True))
    for probe in PROBE:
        if not len(row):
            break
        lender = probe[bucket]
        hit = full[row, lender]
        out[row[hit], bucket[hit]] = own[row[hit], lender[hit]]
        row, bucket = row[~hit], bucket[~hit]
    for step in range(1, BUCKETS):
        if not len(row):
            break
        lender = (bucket + step) % BUCKETS
        hit = full[row, lender]
        out[row[hit], bucket[hit]] = own[row[hit], lender[hit]]
        row, bucket = row[~hit], bucket[~hit]
    return out


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_1, set_2, registers) of (doc_id, text, text_key): a set's size, 128 bits that tell sets apart, its registers (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n_shingles", "set_1", "set_2", "registers"]
        for batch, texts in split_batches(batches, "text"):
            values, first = shingle_sets(texts, shingle)
            sums = []
            for salt in (0x1234567, 0x7654321):
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(values ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            held = registers(values, first)
            sizes = np.diff(first)
            rows = [held[i].tobytes() if sizes[i] else None for i in range(texts.n)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes.astype(np.int64)), *map(pa.array, sums), pa.array(rows, pa.binary())], names=names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, set_1 long, set_2 long, registers binary")


def estimate(matches: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the number of equal registers, less those equal by chance.

    Two registers of different values are equal if leading zeros agree, with
    probability 1/3, and so do all bits of the mantissa.
    """
    chance = 1 / (3 * (1 << MANTISSA_BITS))
    return (matches / BUCKETS - chance) / (1 - chance)


def band_keys(registers_: Column) -> Column:
    """Array of a hash for each band; a register has two bytes."""
    width = 2 * BAND
    return F.array(*[F.xxhash64(F.substring(registers_, 1 + width * b, width), F.lit(b)) for b in range(BUCKETS // BAND)])


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose registers estimate a similarity of at least ``least``."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(texts_of(v).data, np.uint16).reshape(-1, BUCKETS) for v in (x, y))
        return pa.array(estimate((one == two).sum(1)) >= least)

    held = classes.select("rep", "registers")
    joined = pairs.join(held.withColumnsRenamed({"rep": "a", "registers": "ra"}), "a").join(held.withColumnsRenamed({"rep": "b", "registers": "rb"}), "b")
    return joined.where(near(F.col("ra"), F.col("rb"))).select("a", "b")


def compare(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked, similarity, size_a, size_b, differ) of ``pairs`` (a, b), on the full sets of ``texts`` (doc_id, text).

    linked: 100 * intersection >= percent * union. differ: the shingles that
    one of the two lacks, unless they are far from each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, one in pieces(batch.column("ta"), most_rows=256):
                two = texts_of(batch.column("tb").slice(first, after - first))
                (va, fa), (vb, fb) = shingle_sets(one, shingle), shingle_sets(two, shingle)
                linked, similar, ends, values = [], [], [0], [np.zeros(0, np.int64)]
                for i in range(after - first):
                    x, y = va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]]
                    differ = np.setxor1d(x, y, assume_unique=True)
                    both, either = (len(x) + len(y) - len(differ)) // 2, (len(x) + len(y) + len(differ)) // 2
                    linked.append(both > 0 and 100 * both >= percent * either)
                    similar.append(both / max(either, 1))
                    if similar[-1] >= FAR:
                        values.append(differ.view(np.int64))
                    ends.append(ends[-1] + (len(differ) if similar[-1] >= FAR else 0))
                columns = [batch.column("a").slice(first, after - first), batch.column("b").slice(first, after - first), pa.array(linked, pa.bool_()), pa.array(similar, pa.float64())]
                columns += [pa.array(np.diff(fa), pa.int64()), pa.array(np.diff(fb), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))]
                yield pa.record_batch(columns, names=["a", "b", "linked", "similarity", "size_a", "size_b", "differ"])

    joined = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, linked boolean, similarity double, size_a long, size_b long, differ array<long>")


def led(bands: DataFrame) -> DataFrame:
    """(band, rep, leader) of bands with company; the leader is the member with the most company over its bands, then the smallest."""
    shared = keep(bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"), "shared-bands")
    company = shared.groupBy("rep").agg(F.sum("n").alias("company"))
    best = shared.join(company, "rep").groupBy("band").agg(F.max(F.struct("company", (-F.col("rep")).alias("back"))).alias("best"))
    return keep(shared.select("band", "rep").join(best.select("band", (-F.col("best.back")).alias("leader")), "band"), "band-members")


#: Classes of distances from a leader that a distance of the threshold spans.
STEPS = 8
#: A key under which this many pairs for each of its rows would meet is told apart by a further shingle, so often.
CROWDED, DEEPEST = 16, 4


def from_leaders(star: DataFrame, percent: int) -> DataFrame:
    """(leader, rep, linked, own, cls, differ) of sets b that star, compare() of leaders a with them, has near their leader."""
    t = (100 - percent) / (100 + percent)
    distance = F.floor(F.size("differ") / F.greatest(F.lit(1), F.ceil(F.col("size_a") * (2 * t / STEPS))))
    cls = (distance * 2 + F.col("linked").cast("int")).cast("int").alias("cls")
    return star.where(F.col("similarity") >= FAR).select(F.col("a").alias("leader"), F.col("b").alias("rep"), "linked", F.col("size_b").alias("own"), cls, "differ")


def from_nothing(members: DataFrame, asked: DataFrame, star: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The same, with a band for a leader and the empty set for its shingles, of a band's sets that are far from its leader or nearly as far."""
    told = asked.join(star.select("a", "b", "similarity"), ["a", "b"], "left").select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    outer = keep(members.join(told.where(F.col("similarity") < FAR + (100 - percent) / 100 + 1e-9), ["leader", "rep"]).select("band", "rep", (F.col("similarity") < FAR).alias("far")), "outer-sets")
    open_ = outer.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).where("n > 1 AND far").select("band")
    outer = keep(outer.join(open_, "band", "left_semi").select(F.col("band").alias("leader"), "rep"), "outer-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, one in split_batches(batches, "text"):
            values, first = shingle_sets(one, shingle)
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], names=["rep", "differ"])

    wanted = texts.join(outer.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = wanted.mapInArrow(run, "rep long, differ array<long>")
    cls = (F.floor(F.log(F.size("differ").cast("double")) * 16) * 2).cast("int").alias("cls")
    return outer.join(sets, "rep").select("leader", "rep", F.lit(False).alias("linked"), F.size("differ").cast("long").alias("own"), cls, "differ")


def differences(near: DataFrame, of: DataFrame) -> DataFrame:
    """(leader, rep, component, n, common, own, cls) of sets near a leader, itself aside.

    near: (leader, rep, linked, own, cls, differ); of: (node, component) of the
    links so far. n: shingles that one of set and leader lacks; common: those of
    them that others of the leader's sets have too, the rarest first; own: the
    set's size; cls: its distance class, twice, plus 1 if it is linked.
    """
    rows = near.select("leader", "rep", F.explode("differ").alias("shingle"))
    counted = keep(rows.groupBy("leader", "shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "difference-counts")
    common = rows.join(counted, ["leader", "shingle"]).groupBy("leader", "rep").agg(F.sort_array(F.collect_list(F.struct("times", "shingle")))["shingle"].alias("common"))
    out = near.withColumn("n", F.size("differ")).drop("differ").join(common, ["leader", "rep"]).join(of, F.col("rep") == F.col("node"), "left")
    return out.select("leader", "rep", F.coalesce("component", "rep").alias("component"), "n", "common", "own", "cls")


def reachable(held: DataFrame, t: float) -> DataFrame:
    """(leader, cls, partners): for each distance class of a leader's sets those that it may have links with, not both linked with the leader.

    Two sets x and y are linked only if |Dx & Dy| >= (|Dx| + |Dy| - t (|x| + |y|)) / 2, and never have more in common than either has
    with anyone. A leader has few classes, however many sets.
    """
    bounds = held.groupBy("leader", "cls").agg(F.min("n").alias("least"), F.max(F.size("common")).alias("most"), F.max("own").alias("longest"), F.count(F.lit(1)).alias("sets"), F.min("component").alias("one"), F.max("component").alias("two"))
    bounds = keep(bounds, "difference-classes")
    side = lambda k: bounds.select("leader", *[F.col(c).alias(f"{c}_{k}") for c in bounds.columns if c != "leader"])
    needed = F.greatest(F.lit(1.0), F.ceil((F.col("least_x") + F.col("least_y") - F.lit(t) * (F.col("longest_x") + F.col("longest_y"))) / 2 - 1e-9))
    open_ = (F.col("cls_x") % 2 == 0) | (F.col("cls_y") % 2 == 0)
    apart = (F.col("one_x") != F.col("two_x")) | (F.col("one_y") != F.col("two_y")) | (F.col("one_x") != F.col("one_y"))
    met = side("x").join(side("y"), "leader").where(open_ & apart & (needed <= F.least("most_x", "most_y")) & ((F.col("cls_x") != F.col("cls_y")) | (F.col("sets_x") > 1)))
    return met.groupBy("leader", F.col("cls_x").alias("cls")).agg(F.collect_list(F.struct(F.col("cls_y").alias("cls"), F.col("least_y").alias("least"), F.col("longest_y").alias("longest"), needed.cast("int").alias("needed"))).alias("partners"))


def meeting(held: DataFrame, partners: DataFrame, t: float) -> DataFrame:
    """(leader, x, y): sets of different components that have a shingle in common within the prefixes of their differences.

    A set has a prefix for each class of partners: the nearer they must be, the
    shorter. Pairs that have ``k`` shingles in common have ``l`` of them in the
    first len - k + l, so a key of one shingle that crowds is told apart by the
    next one that both may have, as long as fewer than k are in the key.
    """
    rows = held.join(partners, ["leader", "cls"]).select("leader", "rep", "component", "n", "own", "cls", "common", F.explode("partners").alias("p"))
    needed = F.greatest(F.col("p.needed"), F.ceil((F.col("n") + F.col("p.least") - F.lit(t) * (F.col("own") + F.col("p.longest"))) / 2 - 1e-9)).cast("int")
    rows = rows.withColumn("needed", needed).withColumn("size", F.size("common")).where("needed <= size")
    rows = rows.withColumn("low", F.least("cls", "p.cls")).withColumn("high", F.greatest("cls", "p.cls")).withColumn("both", F.col("p.needed"))
    fixed = ["leader", "rep", "component", "n", "own", "cls", "low", "high", "both", "needed", "size"]
    at = rows.select(*fixed, F.posexplode(F.slice("common", 1, F.col("size") - F.col("needed") + 1)).alias("at", "shingle"))
    at = at.select(*fixed, "at", F.xxhash64("low", "high", "shingle").alias("key"))
    first, second = F.col("cls") == F.col("low"), F.col("cls") == F.col("high")
    found = None
    for depth in range(1, DEEPEST + 1):
        at = keep(at, "difference-keys")
        sides = at.groupBy("leader", "key").agg(F.count(F.when(first, 1)).alias("ones"), F.count(F.when(second, 1)).alias("others"), F.max(F.col("low") == F.col("high")).alias("same"), F.max("both").alias("both"))
        crowded = (F.col("ones") * F.col("others") > CROWDED * (F.col("ones") + F.col("others"))) & (F.col("both") > depth) & F.lit(depth < DEEPEST)
        sides = keep(sides.where("ones > 0 AND others > 0 AND (ones > 1 OR NOT same)").select("leader", "key", crowded.alias("crowded")), "difference-sides")
        told = at.join(sides, ["leader", "key"])
        plain = told.where("NOT crowded")
        side = lambda k, rows_: rows_.select("leader", "key", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "component", "n", "own", "cls", "size", "at")])
        overlap = F.least("at_x", "at_y") + F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
        enough = overlap >= (F.col("n_x") + F.col("n_y") - F.lit(t) * (F.col("own_x") + F.col("own_y"))) / 2 - 1e-9
        pair = ((F.col("cls_x") != F.col("cls_y")) | (F.col("rep_x") < F.col("rep_y"))) & (F.col("component_x") != F.col("component_y"))
        met = side("x", plain.where(first)).join(side("y", plain.where(second)), ["leader", "key"]).where(pair & enough).select("leader", F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
        found = met if found is None else found.union(met)
        if sides.where("crowded").isEmpty():
            break
        onward = F.slice("common", F.col("at") + 2, F.greatest(F.lit(0), F.col("size") - F.col("needed") + F.lit(depth) - F.col("at")))
        more = told.where("crowded").join(held.select("leader", "rep", "common"), ["leader", "rep"]).select(*fixed, "key", "at", F.posexplode(onward).alias("after", "shingle"))
        at = more.select(*fixed, (F.col("at") + 1 + F.col("after")).alias("at"), F.xxhash64("key", "shingle").alias("key"))
    return found.distinct()


def between(near: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets near one leader that are not both linked with it nor of one component, decided by their differences from it."""
    t = (100 - percent) / (100 + percent)
    held = keep(differences(near, of), "differences")
    met = meeting(held, reachable(held, t), t)
    side = lambda k: held.select("leader", F.col("rep").alias(k), F.col("common").alias(f"common_{k}"), F.col("n").alias(f"n_{k}"), F.col("own").alias(f"own_{k}"))
    both = met.join(side("x"), ["leader", "x"]).join(side("y"), ["leader", "y"])
    apart = F.col("n_x") + F.col("n_y") - 2 * F.size(F.array_intersect("common_x", "common_y"))
    total = F.col("own_x") + F.col("own_y")
    return both.where((total > apart) & (100 * (total - apart) >= percent * (total + apart))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def class_ids(base: DataFrame, sketches: DataFrame, key: list[str], shingle: int, percent: int) -> DataFrame:
    """(key, of): the smallest id that each class of equal sets, told by ``key``, reaches over links."""
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "registers")).alias("first"))
    reps = keep(reps.select(*key, "first.*", F.monotonically_increasing_id().alias("rep")), "set-classes")
    classes = reps.where(F.col("n_shingles") >= LEAST_SHINGLES).select("rep", "registers")

    bands = classes.select("rep", F.explode(band_keys(F.col("registers"))).alias("band"))
    members = led(bands)
    asked = keep(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "asked")
    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), "rep")
    texts = base.join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key"))).dropDuplicates(["doc_id", "text_key", "rep"])
    texts = keep(texts.select(F.col("rep").alias("doc_id"), "text"), "candidate-texts")
    star = keep(compare(likely(asked, classes, LEAST_LIKELY), texts, shingle, percent), "star")
    links = star.where("linked").select("a", "b")
    found = components(links)

    more = keep(between(from_leaders(star, percent), found, percent), "difference-links")
    far = keep(from_nothing(members, asked, star, texts, shingle, percent), "far-sets")
    if not far.isEmpty():
        more = more.union(keep(between(far, found, percent), "far-links"))
    if not more.isEmpty():
        found = components(links.union(more))

    of_class = reps.select(*key, "doc_id", "rep").join(found, F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("component", "rep"))
    of_class = keep(of_class.select(*key, "doc_id", "group"), "class-groups")
    least = keep(of_class.groupBy("group").agg(F.min("doc_id").alias("of")), "group-ids")
    return keep(of_class.drop("doc_id").join(least, "group").select(*key, "of"), "class-ids", lasting=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``shingle``-word shingles (words
    between white space, A-Z lowered) have a Jaccard similarity of ``percent``
    and more; component_id is the smallest id that can be reached. percent is
    80 or more. Null and empty texts, and white space alone, have no set and
    link with nothing; fewer words than a shingle are one shingle. Rows with a
    null id are linked with nothing and kept. Ids are of any type that has an
    order; rows that repeat an id are documents of their own, by their texts.
    Other columns play no part; an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("bands are laid out for a similarity of 0.8 and more")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base = base.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketches = keep(sketch(base, shingle), "sketches", lasting=True)
    key = ["n_shingles", "set_1", "set_2"]
    with freed():
        of_class = class_ids(base, sketches, key, shingle, percent)
    out = sketches.select("doc_id", *key).join(of_class, key, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("of"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
