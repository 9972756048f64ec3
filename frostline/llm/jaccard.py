"""N-gram Jaccard join by vertical partitioning.

A text's set holds the hashes of its distinct word shingles; the global n-gram
order is the order of the hashes. Two cuts of that order do the work.

Candidates. Sets x and y with Jaccard similarity of at least `percent`/100 and
at most U shingles each differ in at most D = (200 - 2p)U / (100 + p) of them.
With the order cut into F > D fragments, at least F - D fragments are equal in x
and y. So every set gives one signature per fragment that is not empty (the hash
of what it has there), and similar sets meet in signatures. F depends on a class
of sizes; a set near the upper end of its class signs for the next class too.
Fragments may be empty in both sets: F leaves a slack z for that, and a set with
more than z empty fragments also signs with its first shingles in the global
order (the usual prefix), where two such sets must meet.

Verification. The order is cut into `FRAGMENTS` fixed fragments. Each candidate
pair's overlap is counted in every fragment separately and summed per pair;
lengths and the sum decide. Before that, a short sketch turns away most pairs
that cannot be similar: shingles are dealt into cells, at least as many as there
are shingles, and a bit tells whether a set has an odd number of them in a cell.
Two sets differ in at least as many shingles as in bits.

Groups. Equal sets are one class throughout. Members of one signature are not
paired with each other: each is compared with one hub, links are joined into
components, and only signatures whose members still lie in several components
are looked at again, with another hub. A group of copies thus costs one comparison
per member and round, not one per pair.

The rest. After `HUB_ROUNDS` rounds, only a link across components matters. In
signatures of up to `MET_MEMBERS` classes and `MET_BITS` shingles, members of
different components are held against each other's parities, signature by
signature: a row of a class and signature costs at most so many comparisons of
bits, and no shingle is written or shuffled for it. Pairs that pass are verified.

Larger signatures. All shingles of the intersection of a link across components
are held in two components or more. So a class of n shingles needs p n / 100 such
shingles; classes that have fewer lose no link and go, which can leave other
shingles in one component only, and so on (up to `PEELS` times). Texts that share
passages and differ elsewhere go at once. What stays meets in the prefix of its
crossing shingles, the rarest first, and these pairs are compared one by one, so
no link that would join two components is lost.

Components come from repeated minimum labels with pointer jumping on written
tables. Nothing about documents is gathered on the driver.

Edge cases: a null text, an empty one or one without words has an empty set and
is linked with nothing; fewer words than a shingle are one shingle; rows are
judged one by one, so repeated rows are exact copies; an empty table gives no
rows. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import common
from frostline.llm.rows import partial_rows

FRAGMENTS = 8
HUB_ROUNDS = 3
PEELS = 4
PEEL_AGAIN = 0.9
PASSES = 4
FILTER_WORDS = 1 << 15
SMALLEST_CLASS, CLASS_RATIO = 8, 1.5
LEAST_CELLS = 1024
MET_MEMBERS, MET_BITS = 1 << 12, 1 << 27
MET_WORDS = 1 << 18

_IS_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
_FOLD = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct shingle hashes."""
    words = common.Words(texts, _IS_WORD, _FOLD)
    hashes = words.hashes()
    runs = common.shingle_hashes(hashes, size)
    for first, last in zip(words.first.tolist(), words.last.tolist(), strict=True):
        count = last - first
        if count >= size:
            yield np.unique(runs[first : last - size + 1])
        elif count:
            yield common.shingle_hashes(hashes[first:last], count)
        else:
            yield np.zeros(0, np.uint64)


def set_key(own: np.ndarray) -> int:
    """One 64-bit value per set; 0 for the empty one."""
    if not len(own):
        return 0
    total = common.mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(common.signed(common.mixed(np.array([total])))[0])


class SizeClasses:
    """Classes of set sizes by their largest size, and their fragments."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [SMALLEST_CLASS]

    def of(self, size: int) -> int:
        while self.bounds[-1] < size:
            self.bounds.append(int(self.bounds[-1] * CLASS_RATIO) + 1)
        return int(np.searchsorted(self.bounds, size))

    def signing(self, size: int) -> list[int]:
        """The own class, and the next if a similar set may lie there."""
        own = self.of(size)
        largest = size * 100 // self.percent
        return list(range(own, self.of(largest) + 1))

    def fragments(self, number: int) -> tuple[int, int]:
        """(fragments, slack for empty ones) of a class."""
        while len(self.bounds) <= number:
            self.of(self.bounds[-1] + 1)
        differ = (200 - 2 * self.percent) * self.bounds[number] // (100 + self.percent)
        slack = 1 + differ // 40
        return differ + 1 + slack, slack


def signatures(own: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Signatures of a set of at least one shingle."""
    found = []
    spread = common.mixed(own)
    for number in classes.signing(len(own)):
        count, slack = classes.fragments(number)
        part = ((own >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        hashes = common.mixed(np.add.reduceat(spread, at) + part[at] * np.uint64(0xC2B2AE3D27D4EB4F))
        label = np.uint64(number * 0x9E3779B1 + 1)
        found.append(common.mixed(hashes + label))
        if count - len(at) > slack:
            prefix = len(own) - (len(own) * classes.percent + 99) // 100 + 1
            found.append(common.mixed(spread[:prefix] ^ label))
    return np.concatenate(found)


def parities(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is the number of shingles in a cell odd: a bit per cell, with a cell or
    more per shingle, and the same for half as many cells."""
    cells = max(LEAST_CELLS, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(8)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    half = odd[: cells // 2] ^ odd[cells // 2 :]
    return tuple(np.packbits(x.astype(np.uint8)).view(np.int64) for x in (odd, half))


def _sketch(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = SizeClasses(percent), {0}
        for batch in batches:
            for block in common.text_blocks(batch):
                counts, keys, fine, coarse, signs, ends = [], [], [], [], [], [0]
                for own in shingle_sets(block.column("text"), size):
                    counts.append(len(own))
                    keys.append(set_key(own))
                    for column, bits in zip((fine, coarse), parities(own), strict=True):
                        column.append(bits)
                    if keys[-1] in seen:
                        # copies of a set sign once per task
                        ends.append(ends[-1])
                    else:
                        seen.add(keys[-1])
                        signs.append(common.signed(signatures(own, classes)))
                        ends.append(ends[-1] + len(signs[-1]))
                values = np.concatenate(signs) if signs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        block.column("text_key"),
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.int64()),
                        pa.array(fine, pa.list_(pa.int64())),
                        pa.array(coarse, pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "class", "fine", "coarse", "signs"],
                )

    return run


def _fragments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.text_blocks(batch):
                keys, counts, parts, rows = [], [], [], []
                for own in shingle_sets(block.column("text"), size):
                    if not len(own):
                        continue
                    key = set_key(own)
                    edges = np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61)
                    cuts = np.split(common.signed(own), np.searchsorted(own, edges))
                    for part, values in enumerate(cuts):
                        keys.append(key)
                        counts.append(len(own))
                        parts.append(part)
                        rows.append(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(parts, pa.int32()),
                        pa.array(rows, pa.list_(pa.int64())),
                    ],
                    names=["class", "n", "part", "grams"],
                )

    return run


def _parities_allow(percent: int) -> Column:
    """Of classes a and b (n_a, fine_a, coarse_a, ...): do they differ in no more
    cells than similar sets can."""

    def bits(name: str, other: str) -> Column:
        # sizes that are near enough have equal numbers of cells or twice as many
        finer = F.size(f"fine_{name}") > F.size(f"fine_{other}")
        return F.when(finer, F.col(f"coarse_{name}")).otherwise(F.col(f"fine_{name}"))

    different = F.aggregate(
        F.zip_with(bits("a", "b"), bits("b", "a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda n, x: n + x,
    )
    return different * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _met_in_group(
    fine: list[np.ndarray], n: np.ndarray, label: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the members of one signature, pair by pair, that have different
    labels and that sizes and parities allow."""
    words = np.array([len(x) for x in fine])
    for width in np.unique(words):
        # sizes that are near enough have equal numbers of cells or twice as many
        own, finer = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        bits = [np.stack([fine[x] for x in own])]
        if len(finer):
            wide = np.stack([fine[x] for x in finer])
            bits.append(wide[:, :width] ^ wide[:, width:])
        bits, at = np.concatenate(bits), np.concatenate((own, finer))
        step = max(1, MET_WORDS // bits.size)
        for first in range(0, len(own), step):
            stop = min(first + step, len(own))
            one, other = at[first:stop], at[first + 1 :]
            different = np.bitwise_count(bits[first:stop, None] ^ bits[None, first + 1 :]).sum(2, np.int64)
            small, large = np.minimum(n[one, None], n[other]), np.maximum(n[one, None], n[other])
            likely = different * (100 + percent) <= (100 - percent) * (small + large)
            likely &= (small * 100 >= large * percent) & (label[one, None] != label[other])
            # each pair once
            likely &= np.arange(len(one))[:, None] <= np.arange(len(other))
            x, y = np.nonzero(likely)
            if len(x):
                yield one[x], other[y]


def _met(percent: int):
    """Over rows (sign, class, label, n, fine) that are sorted by sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sign, own, label, n = (table.column(x).to_numpy() for x in ("sign", "class", "label", "n"))
            lists = table.column("fine").combine_chunks()
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1], [True])))
            a, b, held = [], [], 0
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                fine = [values[ends[x] : ends[x + 1]] for x in range(first, last)]
                for x, y in _met_in_group(fine, n[first:last], label[first:last], percent):
                    a.append(own[first + x])
                    b.append(own[first + y])
                    held += len(x)
                    if held >= MET_WORDS:
                        yield sent(a, b)
                        a, b, held = [], [], 0
            if a:
                yield sent(a, b)

        def sent(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            both = np.sort(np.stack([np.concatenate(a), np.concatenate(b)]), 0)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["a", "b"])

        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
            sign = rows.column("sign").to_numpy()
            # the last signature may go on in the next batch
            whole = int(np.searchsorted(sign, sign[-1])) if len(sign) else 0
            if whole:
                yield from pairs(rows.slice(0, whole).combine_chunks())
            waiting = rows.slice(whole)
        if waiting is not None and len(waiting):
            yield from pairs(waiting.combine_chunks())

    return run


def met_in_signatures(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) of classes that share a signature, have different
    labels and may be linked. members: sign, class, label, n."""
    common.bounded_batches(members.sparkSession)
    known = members.select("sign", "class", "label", "n").join(sketches.select("class", "fine"), "class")
    ordered = known.repartition("sign").sortWithinPartitions("sign").select("sign", "class", "label", "n", "fine")
    pairs = common.written(ordered.mapInArrow(_met(percent), "a long, b long").distinct(), "pairs")
    common.release(pairs)
    return pairs


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those that sizes and parities allow."""

    def side(name: str) -> DataFrame:
        return sketches.select(
            F.col("class").alias(name), *(F.col(x).alias(f"{x}_{name}") for x in ("n", "fine", "coarse"))
        )

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_near(F.col("n_a"), F.col("n_b"), percent) & _parities_allow(percent)).select("a", "b")


def linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those that are similar enough: overlaps
    counted in every fragment, then summed."""
    own = fragments.select(F.col("class").alias("a"), "part", F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    other = fragments.select(F.col("class").alias("b"), "part", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    partial = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    summed = (
        pairs.join(own, "a")
        .join(other, ["b", "part"])
        .groupBy("a", "b")
        .agg(F.sum(partial).alias("same"), F.max(F.col("n_a") + F.col("n_b")).alias("total"))
    )
    return summed.filter(F.col("same") * 100 >= percent * (F.col("total") - F.col("same"))).select("a", "b")


def _some_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with an id in ids. A broadcast table of `FILTER_WORDS`
    64-bit words, whatever the number of ids, keeps most other texts out of the
    shuffle; the join after it is exact."""

    def place(column: str) -> tuple[Column, Column]:
        spread = F.xxhash64(F.coalesce(F.col(column), F.lit(-1)))
        return F.pmod(F.shiftrightunsigned(spread, 6), F.lit(FILTER_WORDS)).cast("int"), spread.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place("doc_id")
    table = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    rows = docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(table), "word")
    rows = rows.filter(F.getbit("bits", F.col("bit")) == 1).select(*docs.columns)
    # an inner join, as a semi join would be moved before the filter
    wanted = ids.select(F.col("doc_id").alias("wanted"))
    return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["wanted"])).drop("wanted")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(class, label) with the smallest label that is reached by links (a, b).
    Labels of linked components meet until none changes; a label then points at
    its own smallest label, which halves every chain. `labels` is a written table
    that goes once newer ones are written."""
    while True:
        ends = links.join(labels.select(F.col("class").alias("a"), F.col("label").alias("x")), "a").join(
            labels.select(F.col("class").alias("b"), F.col("label").alias("y")), "b"
        )
        ends = common.written(ends.filter("x <> y").select("x", "y").distinct(), "ends")
        if ends.isEmpty():
            common.drop(ends)
            return labels
        smallest = (
            ends.select(F.greatest("x", "y").alias("label"), F.least("x", "y").alias("to"))
            .groupBy("label")
            .agg(F.min("to").alias("to"))
        )
        smallest = common.written(smallest, "smallest")
        common.drop(ends)
        while True:
            onward = smallest.select(F.col("label").alias("to"), F.col("to").alias("further"))
            jumped = smallest.select("label", "to").join(onward, "to", "left")
            changed = F.count_if(F.col("further").isNotNull()).alias("changed")
            jumped = common.written(jumped.select("label", F.coalesce("further", "to").alias("to"), "further"), "jumped")
            common.drop(smallest)
            smallest = jumped
            if not jumped.agg(changed).first()["changed"]:
                break
        newer = labels.join(smallest.select("label", "to"), "label", "left")
        newer = common.written(newer.select("class", F.coalesce("to", "label").alias("label")), "labels")
        common.drop(labels, smallest)
        labels = newer


def _grams(docs: DataFrame, classes: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(class, n, part, grams), written, of the classes in `some` (class)."""
    texts = _some_texts(docs, classes.join(some, "class", "left_semi").select("doc_id").distinct())
    grams = partial_rows(texts, ["text"], "class long, n long, part int, grams array<long>", _fragments(size))
    return common.written(grams.join(some, "class", "left_semi").dropDuplicates(["class", "part"]), "fragments")


def _near(n: Column, other: Column, percent: int) -> Column:
    return (n * 100 >= other * percent) & (other * 100 >= n * percent)


def _links_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The written links among pairs (a, b)."""
    likely = common.written(possible(pairs, classes, percent), "possible")
    ends = likely.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    grams = _grams(docs, classes, ends, size)
    links = common.written(linked(likely, grams, percent), "links")
    common.discard(grams, likely)
    return links


def _enough(grams: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The classes, written, that hold enough shingles of two components or more.
    Parts of the order are counted one after the other, so no more than a share of
    the shingles is shuffled at once; counts per class are all that is kept."""
    counted = []
    by_gram = Window.partitionBy("gram")
    for turn in range(PASSES):
        held = grams.filter(F.col("part") % PASSES == turn).join(labels, "class")
        held = held.select("class", "label", F.explode("grams").alias("gram"))
        held = held.withColumns({"low": F.min("label").over(by_gram), "high": F.max("label").over(by_gram)})
        shared = held.filter("low <> high").groupBy("class").agg(F.count("*").alias("shared"))
        counted.append(common.written(shared, "shared"))
        del held, shared
        common.release(grams)
    total = counted[0]
    for more in counted[1:]:
        total = total.unionByName(more)
    sizes = grams.groupBy("class").agg(F.max("n").alias("n"))
    total = total.groupBy("class").agg(F.sum("shared").alias("shared")).join(sizes, "class")
    found = common.written(total.filter(F.col("shared") * 100 >= F.col("n") * percent).select("class"), "enough")
    common.drop(*counted)
    return found


def across_components(grams: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes in different components that may be linked.
    grams: class, n, part, grams; labels: class, label; sketches: class, fine,
    coarse, one row per class. Near copies that are not linked share most of their
    shingles, so the pairs that meet are held against the parities where they
    meet, and only those that may be linked leave the join."""
    enough = _enough(grams, labels, percent)
    held = grams.join(enough, "class").join(labels, "class")
    held = common.written(held.select("class", "label", "n", F.explode("grams").alias("gram")), "held")
    rows = held.count()
    for _ in range(PEELS):
        crossing = held.groupBy("gram").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("holders")
        )
        crossing = crossing.filter("low <> high").select("gram", "holders")
        kept = held.select("class", "label", "n", "gram").join(crossing, "gram")
        shared = kept.groupBy("class").agg(F.count("*").alias("shared"), F.max("n").alias("of"))
        shared = shared.filter(F.col("shared") * 100 >= F.col("of") * percent).select("class", "shared")
        kept = common.written(kept.join(shared, "class"), "held")
        del crossing, shared
        common.discard(held)
        held, before, rows = kept, rows, kept.count()
        if not rows or rows > before * PEEL_AGAIN:
            # nothing is left, or too little went to pay for another turn
            break
    common.drop(enough)
    # of the shared ones so many can be missing that one of the first is common
    place = F.row_number().over(Window.partitionBy("class").orderBy("holders", "gram"))
    needed = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    prefix = held.withColumn("place", place).filter(F.col("place") <= F.col("shared") - needed + 1)
    prefix = prefix.join(sketches.select("class", "fine", "coarse"), "class")
    columns = ("class", "label", "n", "shared", "place", "fine", "coarse")
    prefix = common.written(prefix.select("gram", *columns), "prefix")

    def side(name: str) -> DataFrame:
        return prefix.select("gram", *(F.col(x).alias(f"{x}_{name}") for x in columns))

    # what may follow a common place
    left = F.least(F.col("shared_a") - F.col("place_a"), F.col("shared_b") - F.col("place_b")) + F.least("place_a", "place_b")
    total = F.col("n_a") + F.col("n_b")
    met = side("a").join(side("b"), "gram").filter(
        (F.col("label_a") < F.col("label_b"))
        & _near(F.col("n_a"), F.col("n_b"), percent)
        & (left * (100 + percent) >= total * percent)
        & _parities_allow(percent)
    )
    pairs = met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()
    pairs = common.written(pairs, "pairs")
    common.discard(held, prefix)
    return pairs


def _open_members(members: DataFrame, number: int) -> DataFrame:
    """Members (sign, class, label, n) of the signatures whose members have
    several labels, with a hub per signature, its size and its largest n; of
    signatures with the same members, one."""
    draw = F.xxhash64("class", F.lit(number))
    hashed = F.xxhash64("class", F.lit("members"))
    open_signs = members.groupBy("sign").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("size"),
        F.bit_xor(hashed).alias("members"),
        F.max("n").alias("widest"),
        F.min(F.struct(draw.alias("draw"), "class", "label", "n")).alias("hub"),
    )
    open_signs = open_signs.filter("low <> high").groupBy("hub", "size", "widest", "members").agg(F.min("sign").alias("sign"))
    hub = (F.col(f"hub.{x}").alias(f"hub_{x}") for x in ("class", "label", "n"))
    open_signs = open_signs.select("sign", "size", "widest", *hub)
    return members.join(open_signs, "sign")


def _last_pairs(docs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """The written pairs (a, b) of classes in different components that may be
    linked, from open members."""
    few = (F.col("size") <= MET_MEMBERS) & (F.col("size") * F.col("widest") <= MET_BITS)
    pairs = met_in_signatures(members.filter(few), classes, percent)
    some = common.written(members.filter(~few).select("class", "label").distinct(), "some")
    if not some.isEmpty():
        grams = _grams(docs, classes, some.select("class"), size)
        more = across_components(grams, some, classes, percent)
        common.discard(grams)
        both = common.written(pairs.unionByName(more).distinct(), "pairs")
        common.drop(pairs, more)
        pairs = both
    common.drop(some)
    return pairs


def _class_labels(docs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """(class, label) for all classes in `members` (sign, class). Every round
    goes on with the signatures whose members still have several labels."""
    labels = common.written(classes.select("class", F.col("class").alias("label")), "labels")
    tested = None
    for number in range(HUB_ROUNDS + 1):
        if number:
            here = members.select("sign", "class", "n").join(labels, "class")
        else:
            here = members.join(classes.select("class", "n"), "class").withColumn("label", F.col("class"))
        here = common.written(_open_members(here, number), "open")
        common.discard(members)
        members = here
        if here.isEmpty():
            break
        if number == HUB_ROUNDS:
            pairs = _last_pairs(docs, here, classes, percent, size)
        else:
            pairs = here.filter((F.col("label") != F.col("hub_label")) & _near(F.col("n"), F.col("hub_n"), percent))
            pairs = pairs.select(F.least("class", "hub_class").alias("a"), F.greatest("class", "hub_class").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = common.written(pairs, "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
        links = _links_of(docs, classes, pairs, percent, size)
        labels = components(labels, links)
        common.discard(links)
    common.discard(members)
    return labels


def _members(sketches: DataFrame) -> DataFrame:
    """(sign, class) of the signatures that two classes or more share. No more
    than a share of the signatures is shuffled at once."""
    by_sign = Window.partitionBy("sign")

    def share(turn: int) -> DataFrame:
        signed = sketches.select("class", F.explode("signs").alias("sign"))
        signed = signed.filter(F.pmod("sign", F.lit(PASSES)) == turn).repartition("sign")
        signed = signed.withColumns({"low": F.min("class").over(by_sign), "high": F.max("class").over(by_sign)})
        return signed.filter("low <> high").select("sign", "class").distinct()

    return common.written_in_turns(map(share, range(PASSES)), "members")


def _groups(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, text_key, n_shingles, class, one per row of docs (doc_id,
    text_key, text); groups: class, label of its component, its smallest doc_id."""
    sketched = _sketch(percent, size)
    schema = "doc_id long, text_key long, n_shingles long, class long, fine array<long>, coarse array<long>, signs array<long>"
    sketches = common.written(partial_rows(docs, ["doc_id", "text_key", "text"], schema, sketched), "sketches")
    members = _members(sketches)
    some = members.select("class").distinct()
    classes = (
        sketches.join(some, "class", "left_semi")
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id"), *(F.max(x).alias(y) for x, y in (("n_shingles", "n"), ("fine", "fine"), ("coarse", "coarse"))))
    )
    classes = common.written(classes, "classes")
    rows = common.written(sketches.select("doc_id", "text_key", "n_shingles", "class"), "rows")
    common.discard(sketches)
    labels = _class_labels(docs.select("doc_id", "text"), members, classes, percent, size)
    # a class that shares no signature is its own component
    firsts = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    groups = firsts.join(labels, "class", "left").select(
        "class", F.coalesce("label", "class").alias("label"), "doc_id"
    )
    groups = common.written(groups, "groups")
    return rows, groups


def join_components(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach)."""
    key = F.lit(0).cast("long").alias("text_key")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.col("text").cast("string").alias("text"))
    rows, groups = _groups(docs, percent, size)
    smallest = groups.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = groups.join(smallest, "label").select("class", "component_id")
    return rows.join(found, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def first_of_components(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Of each component the row with the smallest (doc_id, text), a null doc_id
    last, and every row with an empty set. Rows are known by doc_id and a 64-bit
    hash of text, and copies are reduced before they are shuffled."""
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(
        number.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.struct(*docs.columns).alias("row")
    )
    rows, groups = _groups(keyed.select("doc_id", "text_key", "text"), percent, size)
    smallest = groups.groupBy("label").agg(F.min("doc_id").alias("least"))
    firsts = groups.join(smallest, "label").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    firsts = firsts.select(F.col("class").alias("of"), "label", "least")
    rows = rows.filter("n_shingles > 0").select("class", "doc_id", "text_key").distinct()
    chosen = rows.join(firsts, (F.col("class") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = common.written(chosen.select("label", "least", F.col("text_key").alias("key")), "chosen")
    filled = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # the text leads, then the other columns
    own = keyed.filter(filled).groupBy("doc_id", "text_key").agg(F.min(F.struct("text", "row")).alias("own"))
    own = own.join(chosen, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("text_key") == F.col("key")))
    own = own.groupBy("label").agg(F.min("own").alias("own"))
    return own.select("own.row.*").unionByName(keyed.filter(~filled).select("row.*"))
