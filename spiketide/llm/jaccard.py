"""Jaccard join of documents on word n-grams as a blocked product of the document by n-gram matrix.

The matrix is never multiplied whole.  Columns (n-grams) are put into one global
order, rare ones first; two sets with the wanted overlap must meet in the first
floor(n / 5) + 1 columns of either, so only that part of each row is dealt out.
A task holds a block of columns and multiplies it with itself: each column that
two or more rows fill gives candidates, and candidates are dropped by bounds that
follow from the sizes of the two rows and from how far their parity bitmaps differ.
What is left is counted exactly on whole rows.

Nothing is squared where a group is large.  Rows with the same set are one row
of the product.  In a first product each column links its rows only to a centre,
so a group of near copies costs one candidate a member.  Afterwards only columns
whose rows still lie in different components are multiplied out, each distinct
set of rows once, and a row names only the nearest row outside its component.
Components merge, and that is repeated with more and at last with all of them until no column has a
pair left that was not named, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spiketide.llm.frames import as_schema, map_batches, map_rows
from spiketide.operators.graphs import components
from spiketide.session import stage

GRAM = 5
SLOTS = 1 << 23  # slots of the frequency sketch: a table of eight megabytes for any input
# a column may be salted once it is known to fill some 2**SALT_LEVEL rows
SALT_LEVEL = 10
ID_BITS = 1 << 25  # bitmap of wanted ids: four megabytes for any input
MEMBERS_PER_TASK = 256
#: candidates in other components that a row of a column names, round after round; the last round names all
NEAREST = (1, 4, 16, None)

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_hash = xxhash.xxh3_64_intdigest
U = np.uint64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word runs; of the whole sequence if it is shorter."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space separates
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    h = np.fromiter(map(_hash, words), "u8", n)
    if n < GRAM:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], "u8")
    x = h[: n - GRAM + 1] * _MIX[0]
    for k in range(1, GRAM):
        x = (x ^ (x >> U(31))) * _MIX[k] + h[k : n - GRAM + 1 + k]
    x ^= x >> U(29)
    x *= _MIX[1]
    x ^= x >> U(32)
    return np.unique(x)


def parity(grams: np.ndarray) -> np.ndarray:
    """Bitmap of one to two bits a gram; a bit is set if an odd number of grams falls on it."""
    bits = 64
    while bits < len(grams):
        bits *= 2
    odd = np.bincount((grams & U(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little")


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many grams only one of two sets has."""
    x, y = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def linked(common: int, na: int, nb: int) -> bool:
    return 100 * common >= 80 * (na + nb - common)


def near_sizes(na, nb):
    """4/5 of the larger set must be in the smaller one."""
    return 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (grams & U(SLOTS - 1)).astype("i8")


def levels(docs: DataFrame, text_col: str) -> np.ndarray:
    """log2 of the rows that a column fills, by a sketch over all texts; 0 where that is not unusual.

    It only orders the columns, so a rough count is as right as an exact one.
    A task reports the slots that stand out among its own rows.
    """
    schema = as_schema("slot int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, "u4")
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, slot_of(shingles(text.as_py())), 1)  # a set names a slot about once
        mean = counts.mean()
        slots = np.flatnonzero(counts > mean + 4 * mean**0.5 + 4)
        yield pa.RecordBatch.from_arrays([pa.array(slots, "int32"), pa.array(counts[slots], "int64")], schema=arrow)

    heavy = map_batches(docs.select(text_col), run, schema).groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, "u1")
    for r in heavy.collect():  # at most SLOTS rows
        out[r.slot] = min(63, int(r.n).bit_length() - 1)
    return out


def rows_of(docs: DataFrame, level: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Each row of the matrix: size, signature of the set, parity bitmap, and the columns it is dealt out by."""
    box = docs.sparkSession.sparkContext.broadcast(level)

    def start():
        order = box.value

        def row(key, text: str | None) -> Iterator[tuple]:
            grams = shingles(text)
            n = len(grams)
            if not n:
                yield key, 0, 0, 0, None, []
                return
            columns = (grams >> U(6)) | (order[slot_of(grams)].astype("u8") << U(58))
            first = np.partition(columns, n // 5)[: n // 5 + 1]
            mixed = (grams ^ (grams >> U(27))) * _MIX[2]
            sums = np.array([grams.sum(dtype="u8"), mixed.sum(dtype="u8")]).view("i8").tolist()
            yield key, n, *sums, parity(grams).tobytes(), first.view("i8")

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc {kind}, n int, s1 long, s2 long, bits binary, columns array<long>"
    return map_rows(docs.select(id_col, text_col), ddl, start)


def _level(column):
    return F.shiftrightunsigned(column, 58).cast("int")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Runs of equal leading values in sorted batches, as blocks of whole runs."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            got = [np.concatenate(p) for p in zip(rest, got)]
        last = np.ones(len(got[0]), bool)
        for c in got[:width]:
            last &= c == c[-1]
        cut = int(np.argmax(last))
        if cut:
            yield [c[:cut] for c in got]
        rest = [c[cut:] for c in got]
    if rest is not None:
        yield rest


def first_product(entries: DataFrame) -> DataFrame:
    """Rows of a column linked to a centre of like size; rows of larger columns are kept for the second product.

    ``entries`` (key, salt, doc, n).  Returns (kind, key, a, na, b, nb): kind 0 is a
    candidate pair, kind 1 a row of a column with three or more rows, kind 2 the
    centre of a salted part of a column.
    """
    schema = as_schema("kind int, key long, a long, na int, b long, nb int")
    arrow = to_arrow_schema(schema)

    def block(key, salt, doc, n) -> Iterator[pa.RecordBatch]:
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        begin = np.flatnonzero(change)
        count = np.diff(np.concatenate([begin, [len(key)]]))
        run = np.repeat(np.arange(len(begin)), count)
        size = count[run]
        # the centre moves on where a row is too large for it
        centre = begin[run]
        for k in np.flatnonzero(count > 1):
            i, end = begin[k], begin[k] + count[k]
            while 5 * n[i] < 4 * n[end - 1]:
                i += int(np.searchsorted(4 * n[i:end], 5 * n[i], "right"))
                centre[i:end] = i
        here = np.arange(len(key))
        pair = (size > 1) & (centre != here)
        many = (size > 2) | (salt >= 0) & (size > 1)
        top = (salt >= 0) & (centre == here)
        out = []
        for kind, at in ((0, pair), (1, many), (2, top)):
            k = np.flatnonzero(at)
            c = centre[k] if kind == 0 else k
            out.append([np.full(len(k), kind, "i4"), key[k], doc[k], n[k], doc[c], n[c]])
        columns = [np.concatenate(p) for p in zip(*out)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches, 2):
            yield from block(*columns)

    dealt = entries.select("key", "salt", "doc", "n").repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "doc")
    return map_batches(dealt, run, schema)


def second_product(members: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs of a column that lie in different components and that no bound rules out: (key, a, b, more).

    ``members`` (key, n, doc, comp, bits).  Each row is multiplied with the larger rows
    of its column, and names the ``nearest`` outside its component by the distance
    of the bitmaps.  ``more`` marks rows that had others as well.
    """
    schema = as_schema("key long, a long, b long, more boolean")
    arrow = to_arrow_schema(schema)

    def column(n, doc, comp, bits) -> Iterator[tuple]:
        """Rows come by size, so bitmaps get no shorter, and like sizes differ by one fold at most."""
        width = np.array([len(b) for b in bits])
        whole = {int(w): (np.flatnonzero(width == w)[0], np.stack([np.frombuffer(b, "u1") for b in bits[width == w]])) for w in np.unique(width)}
        folded = {w // 2: (at, m[:, : w // 2] ^ m[:, w // 2 :]) for w, (at, m) in whole.items()}
        for k in range(len(n) - 1):
            stop = k + 1 + int(np.searchsorted(4 * n[k + 1 :], 5 * n[k], "right"))
            w = int(width[k])
            mine = whole[w][1][k - whole[w][0]]
            found, far = [], []
            for at, rows in (whole[w], folded.get(w, (0, None))):
                if rows is None:
                    continue
                low, high = max(k + 1, at), min(stop, at + len(rows))
                other = np.flatnonzero(comp[low:high] != comp[k]) + low if low < high else np.empty(0, "i8")
                if len(other):
                    d = np.bitwise_count(rows[other - at] ^ mine).sum(axis=1, dtype="i8")
                    near = 9 * d <= n[k] + n[other]
                    found.append(other[near])
                    far.append(d[near])
            if not found or not len(other := np.concatenate(found)):
                continue
            kept = other[np.argsort(np.concatenate(far), kind="stable")[:nearest]]
            yield np.full(len(kept), doc[k]), doc[kept], np.full(len(kept), len(kept) < len(other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, doc, comp, bits in _runs(batches, 1):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for i, end in zip(begin, np.concatenate([begin[1:], [len(key)]])):
                for a, b, more in column(n[i:end].astype("i8"), doc[i:end], comp[i:end], bits[i:end]):
                    columns = np.full(len(a), key[i]), a, b, more
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    dealt = members.select("key", "n", "doc", "comp", "bits").repartition("key").sortWithinPartitions("key", "n", "doc")
    return map_batches(dealt, run, schema)


def only(rows: DataFrame, ids: DataFrame, id_col: str = "doc", inside: bool = True) -> DataFrame:
    """Rows whose id is in ``ids`` (doc), and a few others: an id stands for its last 25 bits.

    The bitmap keeps the rows that no join will want out of its shuffle; ``inside`` False gives those.
    """
    where = rows.columns.index(id_col)
    place = F.pmod(F.col("doc"), F.lit(ID_BITS)) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros(ID_BITS // 8, "u1")
    for r in parts.collect():  # at most 1024 rows of four kilobytes
        raw = np.frombuffer(bytes(r.bits), "u1")
        bitmap[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(raw)] = raw
    box = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(where).fill_null(0).to_numpy(zero_copy_only=False) & (ID_BITS - 1)
            yield batch.filter(pa.array(((box.value[doc >> 3] >> (doc & 7).astype("u1")) & 1 == 1) == inside))

    return map_batches(rows, run, rows.schema)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller id first."""
    swap = F.col("a") > F.col("b")
    both = pairs.filter("a <> b").select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    )
    return both.distinct()


def not_far(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that the parity bitmaps do not rule out: at most (na + nb) / 9 grams may lie in one set only."""
    sets = only(sets.select("doc", "n", "bits"), pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    both = pairs.join(left, ["a", "na"]).join(right, ["b", "nb"])

    def start():
        def row(a, b, na, nb, x, y) -> Iterator[tuple]:
            if 9 * apart(x, y) <= na + nb:
                yield a, b

        return row

    kept = map_rows(both.select("a", "b", "na", "nb", "bits_a", "bits_b"), "a long, b long", start, rows=4096)
    return kept.distinct()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that really link, by exact overlap of the whole sets.

    The texts of b come to a task after the text of a, sorted, so it holds one set
    and one text at a time; an a with many b is dealt out to several tasks.
    """
    schema = as_schema("a long, b long")
    arrow = to_arrow_schema(schema)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = only(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    counts = pairs.groupBy("a").agg((F.ceil(F.count("*") / MEMBERS_PER_TASK)).cast("int").alias("parts"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    centres = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    wanted = centres.select("a", "part", "b", F.col("a").alias("doc")).union(salted.select("a", "part", "b", F.col("b").alias("doc")))
    dealt = wanted.join(texts, "doc").select("a", "part", "b", "text").repartition("a", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, fresh = None, [], False
        out: list[tuple[int, int]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                a, part, b, text = (c[k].as_py() for c in batch.columns)
                grams = shingles(text)
                if at != (a, part):
                    at, centre = (a, part), []
                if b is None:
                    centre.append(grams)
                elif any(linked(len(np.intersect1d(c, grams, assume_unique=True)), len(c), len(grams)) for c in centre):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []

    order = [F.col("a"), F.col("part"), F.col("b").asc_nulls_first()]
    return map_batches(dealt.sortWithinPartitions(*order), run, schema)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near copies: sets of 5-word shingles with a Jaccard similarity of 0.8 or more are linked.

    Rows: ``id_col``, ``n_shingles`` and ``component_id`` (smallest id reachable by links),
    one for each row of ``docs``.  Components are whole; links inside a component are
    neither all named nor counted.  A null text has no words; texts without words have an
    empty set, no links, and their own id.  A row without an id takes no part in
    linking and gets no component.  Repeated rows count once in linking; if one id has several texts it
    has the links of all of them.  Ids are integers.  Extra columns are not read.
    """
    sets = stage(rows_of(docs.withColumn(id_col, F.col(id_col).cast("long")), levels(docs, text_col), id_col, text_col))
    named = sets.filter("n > 0 and doc is not null")
    classes = named.groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"))
    member = stage(named.select("doc", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc", "rep").distinct())
    reps = stage(classes.select(F.col("rep").alias("doc"), "n", "s1", "s2"))
    bits = sets.select("doc", "n", "s1", "s2", "bits")

    key = F.col("key")
    salts = F.expr(f"cast(shiftleft(1, greatest(0, cast(shiftrightunsigned(key, 58) as int) - {SALT_LEVEL})) as int)")
    salt = F.when(_level(key) > SALT_LEVEL, F.pmod(F.xxhash64("doc"), salts)).otherwise(-1).cast("int")
    one_of_each = sets.select("doc", "n", "s1", "s2", "columns").join(reps, ["doc", "n", "s1", "s2"], "left_semi")
    product = stage(first_product(one_of_each.select(F.explode("columns").alias("key"), "doc", "n").withColumn("salt", salt)))
    tops = product.filter("kind = 2").select("key", F.lit(-1).alias("salt"), F.col("a").alias("doc"), F.col("na").alias("n"))
    upper = stage(first_product(tops))

    tried = stage(_ordered(product.filter("kind = 0").union(upper.filter("kind = 0")).select("a", "na", "b", "nb")))
    links = stage(verified(stage(not_far(tried, bits)), docs, id_col, text_col))
    doubled = member.groupBy("doc").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
    same = stage(doubled.select(F.col("reps")[0].alias("a"), F.explode("reps").alias("b")).filter("a <> b"))
    both_ways = F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    nodes = reps.select(F.col("doc").alias("a")).distinct()

    wide = product.filter("kind > 0").union(upper.filter("kind = 1"))
    rows = stage(wide.select("key", F.col("a").alias("doc"), F.col("na").alias("n")).distinct())
    final = stage(components(nodes, links.union(same).select(both_ways)))
    for nearest in NEAREST:
        placed = stage(rows.join(final.withColumnRenamed("a", "doc"), "doc"))
        mark = [F.bit_xor(F.xxhash64(F.lit(k), "doc", "n")).alias(f"x{k}") for k in (1, 2)]
        columns = placed.groupBy("key").agg(F.count("*").alias("k"), *mark, F.min("comp").alias("low"), F.max("comp").alias("high"))
        mixed = stage(columns.filter("low < high").groupBy("k", "x1", "x2").agg(F.min("key").alias("key")).select("key"))
        inside = stage(placed.join(mixed, "key", "left_semi"))
        shown = only(bits, inside.select("doc")).join(reps, ["doc", "n", "s1", "s2"], "left_semi").select("doc", "n", "bits")
        named_pairs = stage(second_product(inside.join(shown, ["doc", "n"]), nearest))
        pairs = named_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        more = stage(verified(pairs, docs, id_col, text_col))
        links = stage(links.union(more).distinct())
        final = stage(components(nodes, links.union(same).select(both_ways)))
        open_ones = named_pairs.filter("more").select("key").distinct()
        if open_ones.isEmpty():
            break
        rows = stage(rows.join(open_ones, "key", "left_semi"))  # all other columns have named every pair

    result = member.join(final.select(F.col("a").alias("rep"), "comp"), "rep").groupBy("doc").agg(F.min("comp").alias("comp"))
    kind = docs.schema[id_col].dataType
    return sets.select("doc", "n").join(result, "doc", "left").select(
        F.col("doc").cast(kind).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("comp", "doc").cast(kind).alias("component_id"),
    )


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id (a long) is not in ``ids`` (doc); only rows that may be among them are shuffled."""
    maybe = only(docs, ids, id_col).join(ids.select(F.col("doc").alias(id_col)), id_col, "left_anti")
    return only(docs, ids, id_col, inside=False).unionByName(maybe)
