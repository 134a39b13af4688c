"""Records that share most of their words, whatever the order: an exact similarity join by a blocked sparse product.

Each text is a row of a sparse matrix, its columns being words (the second "the" is a column of its own, so that a
row is a set). The entry of a pair in the product of the matrix with its transpose is the number of words in common,
and two texts belong together when it is at least a share of the longer one's words. The product is formed in blocks,
and only where it can matter:

* Columns are ordered from rare to frequent. A text may miss at most n - ceil(share * n) of its own words, so the
  first words it shares with a partner, in that order, come early. A text is filed under every n-gram of words that
  can be those first shared ones; an n-gram grows until its expected number of texts is small. Both partners file
  under the same n-gram, since its length depends on the words alone. No pair is lost.
* A block is the texts filed under one n-gram. Its rows are ordered by size, and only rows whose sizes allow the share
  are set against each other. The size also bounds in how many words two rows may differ, and a 128-bit parity sketch
  of each row shows at least how many they do: pairs beyond the bound are discarded. A block of more than HOT rows is
  cut into chunks, and every two chunks are a block of their own on any worker.
* For the pairs left the product's entries are accumulated column by column, many pairs at a time; an entry below
  the size-derived bound is discarded.

Frequencies are counted over all texts in a hashed table of fixed size, so what is broadcast does not grow. Words are
told by 64-bit hashes, of which 48 bits enter the sums; equal rows are told by a 64-bit hash of the whole row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.workspace import Workspace, cores, spread

BUCKETS = 1 << 18
#: Texts one n-gram should be expected to hold. More texts mean fewer n-grams to ship and more pairs to look at.
BLOCK_TEXTS = 3000.0
#: Blocks up to this many rows are multiplied together; those beyond HOT rows are cut into chunks of CHUNK rows.
SMALL, HOT, CHUNK = 48, 60_000, 15_000
#: Bits of a filed row that hold the text's size; larger sizes are only known to be at least that.
SIZE_MASK = 0xFFF
#: Texts whose filed rows a partition should hold, about, and texts a pass of the filing.
PART_TEXTS, FILED_AT_ONCE = 8000, 2000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of 64 bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text, columns of all texts one after the other, those of a text in ascending order).

    Words are the longest runs of ASCII letters and digits, lower-cased; any other byte of the text is a gap.
    """
    import pyarrow.compute as pc
    import xxhash

    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
    plain = pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer(data.to_pybytes().translate(_LETTERS)), offset=texts.offset)
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    gap = names.index("") if "" in names else -1
    code = words.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = code != gap
    at = np.sort((doc[real] << 32) | code[real])
    # the n-th time a word comes in a text is a column of its own
    new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    columns = mixed(known[at & 0xFFFFFFFF] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = at >> 32
    return np.bincount(doc, minlength=len(texts)), columns[np.lexsort((columns, doc))]


def gathered(flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The runs of flat, of the given sizes, that are kept."""
    return flat[np.repeat(keep, sizes)]


def listed(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.view(np.int64)))


def ngram_keys(columns: np.ndarray, rate: np.ndarray, sizes: np.ndarray, misses: np.ndarray, texts: float, block: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): hashes of the n-grams of first shared words, given each text's words from rare to frequent.

    rate: share of texts with the word. A path takes word i after skipping the ones between; skipped words are
    missed, of which there may be ``misses``. It ends when texts * product of rates is at most ``block``, or when it
    has ``least`` words, as many as any two partners share: both ends are the same in two texts that share the path.
    All paths of all texts grow by one word at a time.
    """
    start = np.cumsum(sizes) - sizes
    doc, at, left = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), misses.astype(np.int64)
    expect, key = np.full(len(sizes), float(texts)), np.full(len(sizes), 0x9E3779B97F4A7C15, np.uint64)
    docs, keys = [], []
    for more in range(least, 0, -1):
        if not len(doc):
            break
        n = np.maximum(0, np.minimum(sizes[doc] - at, left + 1))
        of = np.repeat(np.arange(len(doc)), n)
        skipped = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        word = start[doc[of]] + at[of] + skipped
        grown = mixed((key[of] ^ columns[word]) + np.uint64(0x2545F4914F6CDD1D))
        now = expect[of] * rate[word]
        done = (now <= block) if more > 1 else np.ones(len(of), bool)
        docs.append(doc[of[done]])
        keys.append(grown[done])
        on = np.flatnonzero(~done)
        doc, at, left, expect, key = doc[of[on]], at[of[on]] + skipped[on] + 1, left[of[on]] - skipped[on], now[on], grown[on]
    return np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def overlapping(records: DataFrame, share: float = 0.8, least: int = 20, id_col: str = "record", text_col: str = "text", block_texts: float = BLOCK_TEXTS, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(record_a, record_b), record_a < record_b in byte order, of different records whose texts both have at
    least ``least`` words and have in common, counted with repetition, at least ``share`` of the longer one's.

    Null, empty and short texts have no partner; a record repeated with the same id and words counts once.
    Equal texts are compared once and their records expanded at the end. An empty table gives no rows.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "overlap")
    given = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("record"), F.col(text_col).alias("text"))

    def read(batches):
        for batch in batches:
            sizes, flat = rows_of(batch.column(1))
            keep = sizes >= least
            flat, sizes = gathered(flat, sizes, keep), sizes[keep]
            # a row's name: the sum of its columns, spread anew, whatever their order
            name = mixed(np.add.reduceat(mixed(flat + np.uint64(1)), np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)) if len(sizes) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(name.view(np.int64)), listed(flat, sizes)], names=["record", "no", "columns"])

    matrix = ws.save(given.mapInArrow(read, "record string, no bigint, columns array<bigint>"), "matrix")
    members = matrix.select("record", F.col("no").alias("text"))
    work = spread(matrix.select("no", "columns"), max(2, cores(spark) // 2))

    def fresh(batch, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, sizes, columns) of a batch's rows that this task has not met before."""
        nos = batch.column(0).to_numpy()
        keep = np.zeros(len(nos), bool)
        for n, no in enumerate(nos.tolist()):
            if no not in seen:
                seen.add(no)
                keep[n] = True
        sizes = batch.column(1).value_lengths().to_numpy()
        flat = batch.column(1).flatten().to_numpy().view(np.uint64)
        return nos[keep], sizes[keep].astype(np.int64), gathered(flat, sizes, keep)

    def count(batches):
        total, rows, seen = np.zeros(BUCKETS, np.int64), 0, set()
        for batch in batches:
            nos, _, flat = fresh(batch, seen)
            rows += len(nos)
            total += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    # at most BUCKETS + 1 rows come to the driver, whatever the size of the data
    counted = work.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    real = counted[counted.bucket >= 0]
    df[real.bucket.to_numpy()] = real.n.to_numpy()
    total = int(counted.n[counted.bucket < 0].sum())
    shipped = spark.sparkContext.broadcast(df)
    fewest = needed(least, share)

    def file(batches):
        freq, seen = shipped.value, set()
        for batch in batches:
            names, sizes, all_ = fresh(batch, seen)
            ends = np.cumsum(sizes)
            for s in range(0, len(names), FILED_AT_ONCE):
                nos, size = names[s : s + FILED_AT_ONCE], sizes[s : s + FILED_AT_ONCE]
                flat = all_[ends[s] - size[0] : ends[s] - size[0] + size.sum()]
                f = freq[(flat % np.uint64(BUCKETS)).astype(np.int64)]
                # columns of a row ascend already, so a stable order by frequency settles ties alike everywhere
                order = np.argsort((np.repeat(np.arange(len(nos)), size) << 40) + f, kind="stable")
                flat, rate = flat[order], f[order] / total
                one, two = sketches(flat, np.cumsum(size) - size)
                # the low bits of the second word hold the size, so that a filed row is three words beside its key
                two = (two & ~np.uint64(SIZE_MASK)) | np.minimum(size, SIZE_MASK).astype(np.uint64)
                miss = size - np.ceil(share * size - 1e-9).astype(np.int64)
                doc, key = ngram_keys(flat, rate, size, miss, total, block_texts, fewest)
                col = lambda v: pa.array(v[doc].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), col(nos), col(one), col(two)], names=["key", "no", "s1", "s2"])

    def multiply(batches, bound: int):
        for alone, (key, no, one, two) in whole_runs(batches, ("key", "no", "s1", "s2"), bound):
            if alone:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(no), pa.array(no), pa.array(one), pa.array(two)], names=["hot", "no_a", "no_b", "s1", "s2"])
                continue
            x, y = block_products(key, no, one.view(np.uint64), two.view(np.uint64), share)
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(x), pa.array(y), none, none], names=["hot", "no_a", "no_b", "s1", "s2"])

    form = "hot bigint, no_a bigint, no_b bigint, s1 bigint, s2 bigint"

    def blocks(filed: DataFrame, bound: int) -> DataFrame:
        return filed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda batches: multiply(batches, bound), form)

    parts = max(2 * cores(spark), total // PART_TEXTS)
    met = ws.save(blocks(work.mapInArrow(file, "key bigint, no bigint, s1 bigint, s2 bigint"), hot), "met")
    pairs = met.where("hot is null").select("no_a", "no_b")
    crowded = met.where("hot is not null").select(F.col("hot").alias("key"), F.col("no_a").alias("no"), "s1", "s2")
    if not crowded.isEmpty():
        many = crowded.groupBy("key").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
        cells = crowded.join(many, "key").withColumn("mine", F.pmod(F.xxhash64("no"), F.col("chunks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        cells = cells.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "no", "s1", "s2")
        # two chunks are a block of bounded size
        pairs = pairs.unionByName(blocks(cells, 1 << 62).select("no_a", "no_b"))
    pairs = ws.save(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("no_a").alias("no")).unionByName(pairs.select(F.col("no_b").alias("no"))).distinct()
    rows = ws.save(matrix.select("no", "columns").join(asked, "no", "left_semi").dropDuplicates(["no"]), "rows")
    left, right = rows.select(F.col("no").alias("no_a"), F.col("columns").alias("a")), rows.select(F.col("no").alias("no_b"), F.col("columns").alias("b"))

    def accumulate(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            na, nb = a.value_lengths().to_numpy(), b.value_lengths().to_numpy()
            keep = entries(a.flatten().to_numpy(), na, b.flatten().to_numpy(), nb) >= np.ceil(share * np.maximum(na, nb) - 1e-9)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["text_a", "text_b"])

    both = pairs.join(left.hint("merge"), "no_a").join(right.hint("merge"), "no_b").select("no_a", "no_b", "a", "b")
    linked = ws.save(both.mapInArrow(accumulate, "text_a bigint, text_b bigint"), "linked")
    return _expand(members, linked)


def entries(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The product's entry of each pair of rows, given the columns of all left rows and of all right rows: a column that
    both rows of a pair have stands twice among the pair's, side by side once they are in order."""
    out = np.zeros(len(na), np.int64)
    low = np.int64((1 << 48) - 1)
    at_a, at_b = np.append(0, np.cumsum(na)), np.append(0, np.cumsum(nb))
    for s in range(0, len(na), 4096):
        e = min(s + 4096, len(na))
        n = np.arange(e - s)
        both = np.concatenate([(np.repeat(n, na[s:e]) << 48) | (a[at_a[s] : at_a[e]] & low), (np.repeat(n, nb[s:e]) << 48) | (b[at_b[s] : at_b[e]] & low)])
        both.sort()
        out[s:e] = np.bincount(both[1:][both[1:] == both[:-1]] >> 48, minlength=e - s)
    return out


def whole_runs(batches, names: tuple[str, ...], hot: int, rows: int = 300_000):
    """(alone, columns) of sorted batches, cut where the first column changes; the rows of a key that has more than
    ``hot`` come as they are, marked alone."""
    held, size, crowded = [], 0, None
    for batch in batches:
        held.append([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names])
        size += batch.num_rows
        while size >= min(rows, hot + 1):
            cols = [np.concatenate(c) for c in zip(*held)]
            key = cols[0]
            if crowded is not None and key[0] == crowded:
                cut = int(np.searchsorted(key, crowded, "right"))
                yield True, [c[:cut] for c in cols]
            elif (cut := int(np.searchsorted(key, key[-1]))) > 0 and size >= rows:
                yield from _parted([c[:cut] for c in cols], hot)
            elif int(np.searchsorted(key, key[0], "right")) > hot:
                cut, crowded = int(np.searchsorted(key, key[0], "right")), key[0]
                yield True, [c[:cut] for c in cols]
            else:
                held = [cols]
                break
            held, size = [[c[cut:] for c in cols]], size - cut
    if size:
        cols = [np.concatenate(c) for c in zip(*held)]
        if crowded is not None and (cut := int(np.searchsorted(cols[0], crowded, "right"))):
            yield True, [c[:cut] for c in cols]
            cols = [c[cut:] for c in cols]
        yield from _parted(cols, hot)


def _parted(cols: list[np.ndarray], hot: int):
    """Whole runs, those of more than ``hot`` rows apart."""
    first = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(cols[0]) else np.zeros(0, int)
    large = np.repeat(np.diff(np.append(first, len(cols[0]))) > hot, np.diff(np.append(first, len(cols[0]))))
    if large.any():
        yield True, [c[large] for c in cols]
        cols = [c[~large] for c in cols]
    if len(cols[0]):
        yield False, cols


def needed(n: int, share: float) -> int:
    """Words a partner must share with a text of n words, at least: the ceiling of share * n."""
    return math.ceil(share * n - 1e-9)


def sketches(columns: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each row: two rows that differ in d columns differ in at most d bits."""
    bit = (columns >> np.uint64(20)) & np.uint64(127)
    one, zero = np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)
    low = bit < 64
    return np.bitwise_xor.reduceat(np.where(low, one, zero), starts), np.bitwise_xor.reduceat(np.where(low, zero, one), starts)


def block_products(key: np.ndarray, no: np.ndarray, one: np.ndarray, two: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of names, the smaller first, that no bound rules out in any of the blocks; rows of a block stand together."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    last = np.append(first[1:], len(key))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    many = last - first
    for m in range(2, SMALL + 1):
        # all blocks of one small size at a time
        starts = first[many == m]
        step = max(1, 400_000 // (m * m))
        for s in range(0, len(starts), step):
            i, j = small_pairs(starts[s : s + step], m, one, two, share)
            left.append(no[i])
            right.append(no[j])
    for a, b in zip(first[many > SMALL], last[many > SMALL]):
        for i, j in block_pairs(one[a:b], two[a:b], share):
            left.append(no[a + i])
            right.append(no[a + j])
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))] if len(pairs) else pairs
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def small_pairs(starts: np.ndarray, m: int, one: np.ndarray, two: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """As block_pairs, for blocks of m rows each that begin at starts."""
    i, j = np.triu_indices(m, 1)
    a, b = (starts[:, None] + i[None, :]).ravel(), (starts[:, None] + j[None, :]).ravel()
    mask = np.uint64(SIZE_MASK)
    na, nb = (two[a] & mask).astype(np.int64), (two[b] & mask).astype(np.int64)
    bound = na + nb - 2 * np.ceil(np.maximum(na, nb) * share - 1e-9).astype(np.int64)
    open_ = (na == SIZE_MASK) | (nb == SIZE_MASK)
    # a bound below nothing means that the sizes alone rule the pair out
    ok = np.flatnonzero((np.bitwise_count(one[a] ^ one[b]).astype(np.int64) <= bound) | open_)
    a, b = a[ok], b[ok]
    ok = (np.bitwise_count(one[a] ^ one[b]).astype(np.int64) + np.bitwise_count((two[a] ^ two[b]) & ~mask) <= bound[ok]) | open_[ok]
    return a[ok], b[ok]


def block_pairs(one: np.ndarray, two: np.ndarray, share: float, cells: int = 1 << 15):
    """(i, j) of a block's rows that neither their sizes nor their sketches rule out, tile by tile, each pair once.

    A tile is the product of its rows' sketches, bits being 1 and -1: it falls by two for every bit that differs.
    """
    size = (two & np.uint64(SIZE_MASK)).astype(np.int64)
    order = np.argsort(size, kind="stable")
    size, one, two = size[order], one[order], two[order] & ~np.uint64(SIZE_MASK)
    # with i before j in order of size, they differ in at most size_i + slack_j words; sizes not known allow any difference
    slack = size - 2 * np.ceil(size * share - 1e-9).astype(np.int64)
    slack[size == SIZE_MASK] = 1 << 20
    reach = np.where(size >= share * SIZE_MASK, len(one), np.searchsorted(size, np.floor(size / share + 1e-9), "right"))
    rows = min(128, max(32, cells // len(one)))
    signs = np.unpackbits(np.stack([one, two], 1).view(np.uint8), axis=1).astype(np.float32) * np.float32(2) - np.float32(1)
    least = (128 - 2 * slack).astype(np.float32)
    for a in range(0, len(one), rows):
        top = min(len(one), a + rows)
        most, end = int(size[top - 1]), int(reach[top - 1])
        for b in range(a, end, cells // 32):
            last = min(end, b + cells // 32)
            near = signs[a:top] @ signs[b:last].T
            at = (near >= (least[b:last] - np.float32(2 * most))).ravel().nonzero()[0]
            i, j = at // (last - b) + a, at % (last - b) + b
            ok = np.flatnonzero((i < j) & (near.ravel()[at] >= least[j] - 2 * size[i]))
            if len(ok):
                yield order[i[ok]], order[j[ok]]


def _expand(members: DataFrame, linked: DataFrame) -> DataFrame:
    """From pairs of texts to pairs of records, and the pairs within a text."""
    members = members.distinct()
    ma = members.select(F.col("text").alias("text_a"), F.col("record").alias("x"))
    mb = members.select(F.col("text").alias("text_b"), F.col("record").alias("y"))
    across = linked.join(ma, "text_a").join(mb, "text_b").where("x <> y").select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
    crowded = members.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select(F.col("text").alias("text_a"), F.col("text").alias("text_b"))
    inside = crowded.join(ma, "text_a").join(mb, "text_b").where("x < y").select(F.col("x").alias("record_a"), F.col("y").alias("record_b"))
    return across.unionByName(inside)


def family_records(individuals: DataFrame, citations: DataFrame) -> DataFrame:
    """(record, text): every note as id#position and every citation as C and its id."""
    notes = individuals.select("id", F.posexplode("notes").alias("pos", "text")).select(F.concat("id", F.lit("#"), F.col("pos").cast("string")).alias("record"), "text")
    cites = citations.select(F.concat(F.lit("C"), F.col("citation_id").cast("string")).alias("record"), "text")
    return notes.unionByName(cites).where("text is not null")
