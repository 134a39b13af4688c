"""The k most similar vectors of every vector, by cosine.

Vectors are brought to length one and turned by a fixed random rotation, after which any leading block of
dimensions is a fair sample of a distance. An inverted file is fitted on bounded samples: k-means lists, whose number
grows with the vectors, and cells that are balanced unions of neighbouring lists. Beyond what SAMPLE_ROWS rows can train,
lists are made in two levels: coarse lists from that sample, and in each, on the workers, as many lists as its share of
the vectors asks for, from TRAIN_ROWS sampled rows a list. Every vector is sent to the cell of its list and, as a
query, to the other cells among its nearest lists. In a cell the lists are held in column blocks; a list is
scanned block by block, and a candidate is abandoned as soon as a hypothesis test on the partial distance says
that it cannot be among the query's k best so far. Exact copies travel once and are expanded at the end.

Every row is indexed and searched. Bounds: there are at most MAX_LISTS lists, so that their centres can be broadcast;
beyond LIST_ROWS * MAX_LISTS vectors lists become longer. Of a query's PROBES nearest lists
those within MARGIN of the nearest are scanned. Lists are counted first: a query whose nearest lists hold less than
k others takes further lists, all if need be, until they hold k, and MARGIN counts from the last of these. Equal vectors are told by a 64-bit hash of their rounded numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.workspace import Workspace, cores

SAMPLE_ROWS, TRAIN_ROWS = 12_000, 8
LIST_ROWS, MAX_LISTS = 600, 65_536
#: Coarse lists looked into for a vector's nearest lists, for each list asked for; at least 8.
COARSE_PROBES = 2
CELL_ROWS = 12_000
PROBES = 8
#: A list is only scanned if its centre's cosine is within this of the nearest centre's, or of the centre's at which
#: the lists from the nearest on hold k rows besides the query.
MARGIN = 0.08
#: Ends of the column blocks, and the significance of the test: a candidate is abandoned when its partial
#: distance exceeds what the k-th best would show in that block by this many standard errors.
BLOCKS = (32, 64, 128)
EPSILON = 2.1


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means; empty lists keep their last centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(centres)))
        full = np.flatnonzero(np.bincount(at, minlength=len(centres)))
        total[full] = np.add.reduceat(x[order], starts[full], axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres).astype(np.float32)
    return centres


class Lists:
    """Centres of lists; with two levels also the coarse centres and, of each, the numbers of its lists."""

    def __init__(self, centres: np.ndarray, coarse: np.ndarray | None = None, of: list[np.ndarray] | None = None):
        self.centres, self.coarse, self.of = centres, coarse, of

    def __len__(self) -> int:
        return len(self.centres)

    def nearest(self, x: np.ndarray, k: int, rows: int = 4096) -> np.ndarray:
        """Numbers of the k nearest lists, nearest first; with two levels of those in the nearest coarse lists."""
        k = min(k, len(self))
        if self.coarse is None or k > len(self) // 2:
            return nearest(x, self.centres, k)
        out = np.empty((len(x), k), np.int32)
        for s in range(0, len(x), rows):
            part = x[s : s + rows]
            near = nearest(part, self.coarse, max(8, COARSE_PROBES * k))
            n = np.zeros(len(part), np.int64)
            for c, lists in enumerate(self.of):
                n += np.where((near == c).any(1), len(lists), 0)
            # sides with fewer lists than asked for are looked at whole
            few = n < k
            sim = np.full((len(part), int(n.max(initial=1))), -np.inf, np.float32)
            who = np.full(sim.shape, -1, np.int32)
            at = np.zeros(len(part), np.int64)
            for c, lists in enumerate(self.of):
                rows_ = np.flatnonzero((near == c).any(1))
                if len(rows_) and len(lists):
                    cols = at[rows_][:, None] + np.arange(len(lists))
                    sim[rows_[:, None], cols] = part[rows_] @ self.centres[lists].T
                    who[rows_[:, None], cols] = lists
                    at[rows_] += len(lists)
            got = np.take_along_axis(who, np.argsort(-sim, axis=1, kind="stable")[:, :k], 1)
            if got.shape[1] < k:
                got = np.pad(got, ((0, 0), (0, k - got.shape[1])), constant_values=-1)
            got[few] = nearest(part[few], self.centres, k)
            out[s : s + rows] = got
        return out


def nearest(x: np.ndarray, centres: np.ndarray, k: int, rows: int = 4096) -> np.ndarray:
    """Numbers of the k nearest centres, nearest first."""
    k = min(k, len(centres))
    out = np.empty((len(x), k), np.int32)
    for s in range(0, len(x), rows):
        sim = x[s : s + rows] @ centres.T
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(k), (len(sim), 1))
        out[s : s + rows] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)
    return out


def cells_of_lists(centres: np.ndarray, weight: np.ndarray, cells: int) -> np.ndarray:
    """Balanced unions of neighbouring lists: halved by weight along the direction of greatest spread."""
    out = np.zeros(len(centres), np.int32)
    stack, made = [(np.arange(len(centres)), cells)], 0
    while stack:
        rows, want = stack.pop()
        if want <= 1 or len(rows) <= 1:
            out[rows] = made
            made += 1
            continue
        c = centres[rows] - centres[rows].mean(0)
        v = np.linalg.svd(c, full_matrices=False)[2][0]
        order = rows[np.argsort(c @ v, kind="stable")]
        share = np.cumsum(weight[order]) / max(weight[order].sum(), 1e-9)
        a = want // 2
        cut = int(np.clip(np.searchsorted(share, a / want) + 1, 1, len(rows) - 1))
        stack += [(order[:cut], a), (order[cut:], want - a)]
    return out


def probes_of(x: np.ndarray, lists: Lists, sizes: np.ndarray, probes: int, margin: float, k: int) -> np.ndarray:
    """Lists to scan for each row, nearest first, -1 where there is none; together they hold k rows besides the row
    itself if the table has them. sizes: rows of each list."""
    centres = lists.centres
    near = lists.nearest(x, probes)
    probes = near.shape[1]
    need = np.zeros(len(x), np.int64)
    held = np.cumsum(sizes[near], 1) > k
    some = held[:, -1]
    need[some] = held[some].argmax(1)
    short = np.flatnonzero(~some)
    for s in range(0, len(short) if probes < len(centres) else 0, 1024):
        rows = short[s : s + 1024]
        far = nearest(x[rows], centres, len(centres))
        held = np.cumsum(sizes[far], 1) > k
        need[rows] = np.where(held[:, -1], held.argmax(1), len(centres) - 1)
        far[np.arange(len(centres)) > np.maximum(need[rows], probes - 1)[:, None]] = -1
        wide = max(near.shape[1], int(need[rows].max()) + 1)
        near = np.pad(near, ((0, 0), (0, wide - near.shape[1])), constant_values=-1)
        near[rows] = far[:, :wide]
    if probes == len(centres):
        need[short] = probes - 1
    sim = np.empty(near.shape, np.float32)
    for c in range(near.shape[1]):
        sim[:, c] = np.einsum("ij,ij->i", x, centres[near[:, c]])
    least = sim[np.arange(len(x)), need] - margin
    return np.where((near >= 0) & ((sim >= least[:, None]) | (np.arange(near.shape[1]) <= need[:, None])), near, -1)


class Best:
    """The k least distances of each query so far, and whose they are."""

    def __init__(self, queries: int, k: int):
        self.d = np.full((queries, k), np.inf, np.float32)
        self.i = np.full((queries, k), -1, np.int64)
        self.k = k

    def offer(self, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        """Candidates i at distance d of queries q."""
        if not len(q):
            return
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        rows, first = np.unique(q, return_index=True)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = nth < self.k
        at = np.searchsorted(rows, q[keep])
        dd = np.full((len(rows), self.k), np.inf, np.float32)
        ii = np.full((len(rows), self.k), -1, np.int64)
        dd[at, nth[keep]], ii[at, nth[keep]] = d[keep], i[keep]
        dd, ii = np.concatenate([self.d[rows], dd], 1), np.concatenate([self.i[rows], ii], 1)
        top = np.argsort(dd, axis=1, kind="stable")[:, : self.k]
        self.d[rows], self.i[rows] = np.take_along_axis(dd, top, 1), np.take_along_axis(ii, top, 1)


def scan(x: np.ndarray, own_list: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int, self_row: np.ndarray, blocks=BLOCKS, epsilon: float = EPSILON) -> Best:
    """Best k rows of x for each row of q, itself (self_row, or -1) left out.

    probes: the lists of each query in order of nearness, -1 where there is none.
    """
    dim = x.shape[1]
    ends = [b for b in blocks if b < dim] + [dim]
    order = np.argsort(own_list, kind="stable")
    lists, first = np.unique(own_list[order], return_index=True)
    last = np.append(first[1:], len(order))
    rows_of = {int(l): order[a:b] for l, a, b in zip(lists, first, last)}
    best = Best(len(q), k)
    col = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]
    qn = np.stack([(q[:, c] ** 2).sum(1) for c in col], 1)
    xn = np.stack([(x[:, c] ** 2).sum(1) for c in col], 1)
    columns = {l: [np.ascontiguousarray(x[r][:, c].T) for c in col] for l, r in rows_of.items()}
    for turn in range(probes.shape[1]):
        want = probes[:, turn]
        asked = np.argsort(want, kind="stable")
        who, a = np.unique(want[asked], return_index=True)
        for l, s, e in zip(who, a, np.append(a[1:], len(asked))):
            if int(l) not in rows_of:
                continue
            rows = rows_of[int(l)]
            for s2 in range(s, e, 1024):
                qs = asked[s2 : min(e, s2 + 1024)]
                # without k neighbours yet there is nothing to test against: the list is scanned whole
                new = np.isinf(best.d[qs, -1])
                fresh, qs = qs[new], qs[~new]
                blocks_of = columns[int(l)]
                if len(fresh):
                    d = qn[fresh].sum(1)[:, None] + xn[rows].sum(1)[None, :]
                    for b, c in enumerate(col):
                        d -= 2 * (q[fresh][:, c] @ blocks_of[b])
                    d[self_row[fresh][:, None] == rows[None, :]] = np.inf
                    most = min(k, len(rows))
                    top = np.argpartition(d, most - 1, axis=1)[:, :most]
                    far = np.take_along_axis(d, top, 1)
                    ok = np.isfinite(far)
                    best.offer(np.repeat(fresh, most)[ok.ravel()], far[ok], rows[top[ok]])
                if not len(qs):
                    continue
                limit = best.d[qs, -1]
                d = qn[qs, :1] + xn[rows, 0][None, :] - 2 * (q[qs][:, col[0]] @ blocks_of[0])
                ratio = ends[0] / dim * (1 + epsilon / np.sqrt(ends[0])) ** 2 if len(ends) > 1 else 1.0
                qi, xi = np.nonzero(d <= (limit * ratio)[:, None])
                partial = d[qi, xi]
                for b in range(1, len(ends)):
                    dots = np.empty(len(qi), np.float32)
                    if len(qi) * 4 > d.size:
                        # few were abandoned: a product of the whole block is cheaper than picking
                        dots = (q[qs][:, col[b]] @ blocks_of[b])[qi, xi]
                    else:
                        for t in range(0, len(qi), 65536):
                            u = slice(t, t + 65536)
                            dots[u] = np.einsum("ij,ij->i", q[qs[qi[u]]][:, col[b]], x[rows[xi[u]]][:, col[b]])
                    partial = partial + qn[qs[qi], b] + xn[rows[xi], b] - 2 * dots
                    ratio = ends[b] / dim * (1 + epsilon / np.sqrt(ends[b])) ** 2 if b < len(ends) - 1 else 1.0
                    keep = partial <= limit[qi] * ratio
                    qi, xi, partial = qi[keep], xi[keep], partial[keep]
                keep = rows[xi] != self_row[qs[qi]]
                best.offer(qs[qi[keep]], partial[keep], rows[xi[keep]])
    return best


def usable_vectors(vectors: DataFrame, dim: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows that can be compared: key not null, exactly ``dim`` numbers, none null or infinite, not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda e: e != 0))


def similar(vectors: DataFrame, k: int = 10, dim: int = 128, key: str = "vec_id", column: str = "embedding", probes: int = PROBES, margin: float = MARGIN, list_rows: int = LIST_ROWS, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS) -> DataFrame:
    """(id, other, rank): the k most similar vectors of each usable vector, rank from 1, fewer if there are fewer.

    Order: cosine from high to low, then the smaller id. A vector is never its own neighbour; equal vectors
    are neighbours of each other. Unusable rows (null, of another length, all zero, not finite) and null ids
    take no part; a repeated id counts once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "similar")
    turn = rotation(dim)

    def prepare(batches):
        import xxhash

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(flat).max(1, keepdims=True)
            unit = flat / top
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            same = np.round(unit * 1e6).astype(np.int32)
            same[same == 0] = 0
            keys = np.array([xxhash.xxh3_64_intdigest(r) for r in same], np.uint64).view(np.int64)
            turned = unit.astype(np.float32) @ turn
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array([r.tobytes() for r in turned], pa.binary())], names=["id", "same", "turned"])

    usable = usable_vectors(vectors, dim, key, column)
    ready = usable.mapInArrow(prepare, "id bigint, same bigint, turned binary")
    ready = ws.save(ready, "ready")
    # groups of equal vectors: their number, and the k + 1 smallest ids, pre-limited before the shuffle
    ids = ready.select("id", "same")
    small = ids.withColumn("nth", F.dense_rank().over(Window.partitionBy("same").orderBy("id"))).where(F.col("nth") <= k + 1)
    groups = small.groupBy("same").agg(F.sort_array(F.collect_set("id")).alias("first"))
    groups = ws.save(groups, "groups")
    total = groups.count()
    if not total:
        return ids.select("id", F.col("id").alias("other"), F.lit(1).alias("rank")).limit(0)
    part = min(1.0, sample_rows / total)
    rows = ready.where(F.pmod(F.xxhash64("same"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).groupBy("same").agg(F.first("turned").alias("turned")).limit(2 * sample_rows).select("turned").toPandas()
    sample = np.stack([np.frombuffer(r, np.float32) for r in rows.turned]) if len(rows) else np.zeros((1, dim), np.float32)
    want = max(1, min(max_lists, round(total / list_rows)))
    one_level = len(sample) // 8 + 1
    if want <= one_level:
        lists = Lists(kmeans(sample, want))
    else:
        lists = _two_levels(ready, sample, want, total, dim)
    shipped = spark.sparkContext.broadcast(lists)
    n_probes = min(probes, len(lists))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.nearest(x, 1)[:, 0])], names=["same", "list"])

    counted = ready.select("same", "turned").mapInArrow(assign, "same bigint, list int").groupBy("list").agg(F.count_distinct("same").alias("n")).toPandas()
    sizes = np.zeros(len(lists), np.int64)
    sizes[counted.list.to_numpy()] = counted.n.to_numpy()
    n_cells = min(len(lists), max(1, round(total / cell_rows)))
    cell_of = cells_of_lists(lists.centres, sizes.astype(float), n_cells)

    def route(batches):
        seen: set[int] = set()
        for batch in batches:
            same = batch.column(1).to_pylist()
            # a copy met before in this partition need not travel again
            fresh = []
            for n, s in enumerate(same):
                if s not in seen:
                    seen.add(s)
                    fresh.append(n)
            batch = batch.take(pa.array(fresh, pa.int64()))
            if not len(fresh):
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dim)
            near = probes_of(x, shipped.value, sizes, n_probes, margin, k)
            cell = cell_of[near]
            done = near < 0
            for c in range(near.shape[1]):
                todo = ~done[:, c]
                rows = np.flatnonzero(todo)
                if not len(rows):
                    continue
                here = (cell[rows] == cell[rows, c][:, None]) & ~done[rows]
                done[rows] |= here
                asked = [r[r >= 0].tolist() for r in np.where(here, near[rows], -1).astype(np.int32)]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column(1), taken.column(2), pa.array(cell[rows, c].astype(np.int32)), pa.array(np.full(len(rows), c == 0)), pa.array(asked, pa.list_(pa.int32()))], names=["same", "turned", "cell", "home", "lists"])

    routed = ready.mapInArrow(route, "same bigint, turned binary, cell int, home boolean, lists array<int>")

    def search(table):
        table = table.combine_chunks()
        same = table.column("same").to_pylist()
        fresh, seen = [], set()
        for n, s in enumerate(same):
            if s not in seen:
                seen.add(s)
                fresh.append(n)
        table = table.take(pa.array(fresh, pa.int64()))
        raw = table.column("turned").to_pylist()
        q = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), dim)
        home = np.flatnonzero(table.column("home").to_numpy())
        lists = table.column("lists").to_pylist()
        probe = np.full((len(lists), max((len(r) for r in lists), default=1)), -1, np.int32)
        for n, r in enumerate(lists):
            probe[n, : len(r)] = r
        me = np.full(len(q), -1, np.int64)
        me[home] = np.arange(len(home))
        best = scan(q[home], probe[home, 0], q, probe, k, me)
        some = np.flatnonzero(best.i[:, 0] >= 0)
        found, far = best.i[some], best.d[some]
        ok = found >= 0
        ends = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
        names = table.column("same").to_numpy()
        lists_of = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.table({"same": pa.array(names[some]), "cos": lists_of((1 - far[ok] / 2).astype(np.float32)), "near": lists_of(names[home[found[ok]]])})

    # about a cell a task, however many there are
    found = routed.repartition(max(cores(spark), 2 * n_cells), "cell").groupBy("cell").applyInArrow(search, "same bigint, cos array<float>, near array<bigint>")
    # a vector was searched in a few cells, at most as many as it has probes
    both = lambda c, n: F.struct(c.alias("cos"), n.alias("same"))
    zipped = F.flatten(F.transform(F.collect_list(F.struct("cos", "near")), lambda r: F.zip_with(r["cos"], r["near"], both)))
    knn = ws.save(found.groupBy("same").agg(F.slice(F.sort_array(zipped, asc=False), 1, k).alias("near")), "knn")
    return _expand(ws, ids, groups, knn, k)


def _two_levels(ready: DataFrame, sample: np.ndarray, want: int, total: int, dim: int) -> Lists:
    """About ``want`` lists: those of each coarse list are fitted by one task from its own sampled rows."""
    coarse = kmeans(sample, min(len(sample) // 8 + 1, math.ceil(math.sqrt(want))))
    part = min(1.0, TRAIN_ROWS * want / total)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(x, coarse, 1)[:, 0])], names=["same", "turned", "coarse"])

    def fit(table):
        # copies of one vector are one
        raw = sorted(set(table.column("turned").to_pylist()))
        x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)
        made = kmeans(x, max(1, round(len(x) / TRAIN_ROWS)))
        return pa.table({"coarse": pa.array(np.full(len(made), table.column("coarse")[0].as_py(), np.int32)), "centre": pa.array([c.tobytes() for c in made], pa.binary())})

    taken = ready.select("same", "turned").where(F.pmod(F.xxhash64("same", F.lit(9)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    found = taken.mapInArrow(assign, "same bigint, turned binary, coarse int").groupBy("coarse").applyInArrow(fit, "coarse int, centre binary").toPandas()
    # one row a list, at most about MAX_LISTS
    found = found.sort_values(["coarse", "centre"])
    centres = np.frombuffer(b"".join(found.centre), np.float32).reshape(-1, dim)
    return Lists(centres, coarse, [np.flatnonzero(found.coarse.to_numpy() == c) for c in range(len(coarse))])


def _expand(ws: Workspace, ids: DataFrame, groups: DataFrame, knn: DataFrame, k: int) -> DataFrame:
    """From neighbouring groups of equal vectors to neighbours of every vector."""
    names = groups.select(F.col("same").alias("o_same"), F.slice("first", 1, k).alias("o_first"))
    near = knn.select("same", F.explode("near").alias("n")).select("same", F.col("n.cos").alias("cos"), F.col("n.same").alias("o"))
    near = near.join(names, near.o == names.o_same).select("same", F.struct((-F.col("cos")).alias("far"), F.col("o_first").alias("ids")).alias("c"))
    lists = near.groupBy("same").agg(F.sort_array(F.collect_list("c")).alias("cs")).select("same", F.slice(F.flatten(F.transform("cs", lambda c: c["ids"])), 1, k).alias("others"))
    whole = groups.select("same", "first").join(lists, "same", "left").select("same", F.col("first").alias("own"), F.coalesce("others", F.array().cast("array<bigint>")).alias("others"))
    members = ids.join(whole, "same")
    mine = F.array_except("own", F.array("id"))
    ranked = members.select("id", F.slice(F.concat(mine, F.col("others")), 1, k).alias("best"))
    return ranked.select("id", F.posexplode("best").alias("pos", "other")).select("id", "other", (F.col("pos") + 1).cast("int").alias("rank"))


def similar_pairs(vectors: DataFrame, **settings) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of which at least one is among the other's k most similar; each once."""
    found = similar(vectors, **settings)
    return found.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()
