"""Most similar vectors by score-aware quantisation.

* Copies of a vector, scaled ones too, are folded into one representative with its first members.
* Vectors are partitioned at two levels of spherical k-means centroids: the upper ones are fitted on a
  bounded sample, the lower ones in parallel within each upper list, so that the number of lists grows
  with the collection. A vector has one home list and visits every list whose centroid is within a
  margin of the nearest, however many those are.
* Within a list vectors are held as 4-bit codes, sixteen subspaces of a product quantiser. Codes and
  codebooks minimise the anisotropic loss |r|^2 + (eta - 1) <r, x>^2, which penalises the residual
  parallel to the vector, the part that falsifies large inner products.
* A query scans the codes by table look-ups (two codes of four bits address one table of 256 sums);
  what may reach the asked similarity is scored again exactly, and each list passes on only the k
  best of each of its rows and visitors.

Every row is indexed; only upper centroids, codebooks and the scan's error bound come from the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch, parallelism

#: Bound of the sample that upper centroids are fitted on, rows of it for each of them, and rows for the codebooks.
SAMPLE_ROWS, ROWS_PER_CENTROID, BOOK_ROWS = 40_000, 64, 8_192
SUBSPACES = 16
ETA = 4.0
#: Bytes of vectors that a task of comparisons reads on average, and copies of one vector that a task joins.
TASK_BYTES, COPIES_PER_TASK = 64 << 20, 100_000
#: Lists from which on their rows grow instead of their number, and bytes of vectors up to which they do.
LISTS, LIST_BYTES = 128, 32 << 20
#: Rows of a list that are asked, encoded or sent on at once, and numbers of either side of exact products.
CHUNK_ROWS, EXACT_NUMBERS = 8_192, 2 << 20


@dataclass
class Index:
    upper: np.ndarray  # (upper lists, dim), unit length
    books: np.ndarray  # (SUBSPACES, 16, dim / SUBSPACES)
    slack: float  # error of a scan that all but one in 10,000 sampled close pairs stay below


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means; an empty cluster takes a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[a:a + 8192] @ c.T, axis=1) for a in range(0, len(x), 8192)])
        order = np.argsort(home, kind="stable")
        counts = np.bincount(home, minlength=k)
        sums = np.zeros_like(c)
        filled = counts > 0
        sums[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts)[:-1]])[filled], axis=0)
        sums[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
        c = unit(sums)
    return c


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA, rounds: int = 2) -> np.ndarray:
    """4-bit codes by coordinate descent on the anisotropic loss; (n, SUBSPACES) uint8."""
    n = len(x)
    m, _, w = books.shape
    parts = x.reshape(n, m, w)
    square = np.einsum("nmw,nmw->nm", parts, parts)
    dots = np.einsum("nmw,mkw->nmk", parts, books)
    dist = square[:, :, None] - 2 * dots + np.einsum("mkw,mkw->mk", books, books)[None]
    along = square[:, :, None] - dots  # <r_s, x_s> by code
    codes = dist.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        for s in range(m):
            rest = total - along[rows, s, codes[:, s]]
            loss = dist[:, s] + (eta - 1) * (rest[:, None] + along[:, s]) ** 2
            codes[:, s] = loss.argmin(axis=1)
            total = rest + along[rows, s, codes[:, s]]
    return codes.astype(np.uint8)


def train_books(x: np.ndarray, eta: float = ETA, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks: alternating codes and weighted least-squares centres under the anisotropic loss."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    w = dim // SUBSPACES
    parts = x.reshape(n, SUBSPACES, w)
    books = np.stack([parts[rng.choice(n, 16, replace=n < 16), s] for s in range(SUBSPACES)])
    for k in range(rounds):
        codes = encode(x, books, 1.0 if k < 2 else eta)
        factor = 0.0 if k < 2 else eta - 1
        recon = books[np.arange(SUBSPACES)[None], codes]
        along = np.einsum("nmw,nmw->nm", parts - recon, parts)
        total = along.sum(axis=1)
        for s in range(SUBSPACES):
            p = parts[:, s]
            rest = total - along[:, s]
            for c in range(16):
                own = codes[:, s] == c
                if not own.any():
                    continue
                q = p[own]
                left = own.sum() * np.eye(w) + factor * q.T @ q
                right = q.sum(axis=0) + factor * (q * ((q * q).sum(axis=1) + rest[own])[:, None]).sum(axis=0)
                books[s, c] = np.linalg.solve(left, right)
    return books.astype(np.float32)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products (n codes, n queries) by sums of table look-ups."""
    m, _, w = books.shape
    table = np.einsum("qmw,mkw->mkq", queries.reshape(len(queries), m, w), books).astype(np.float32)
    out = np.zeros((len(codes), len(queries)), np.float32)
    for s in range(0, m, 2):
        pair = (table[s][:, None] + table[s + 1][None]).reshape(256, -1)
        out += pair[codes[:, s].astype(np.intp) * 16 + codes[:, s + 1]]
    return out


def fit(sample: np.ndarray, upper: int) -> Index:
    """Index parts from the bounded sample of unit vectors."""
    centroids = kmeans(sample, max(1, min(upper, len(sample))))
    books = train_books(sample[:BOOK_ROWS])
    probe = sample[:2_000]
    codes = encode(probe, books)
    rng = np.random.default_rng(3)
    noise = unit(rng.standard_normal(probe.shape).astype(np.float32))
    noise = unit(noise - (noise * probe).sum(axis=1, keepdims=True) * probe)
    asked = 0.9 * probe + np.sqrt(1 - 0.81) * noise  # pairs of cosine 0.9
    m, _, w = books.shape
    recon = books[np.arange(m)[None], codes].reshape(len(probe), -1)
    error = 0.9 - (asked * recon).sum(axis=1)
    return Index(centroids, books, float(np.quantile(error, 0.9999) if len(error) else 0.3) + 0.01)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec): rows with a vector that is neither null, empty nor all zero and holds no null or NaN."""
    v = F.col(vector)
    plain = rows.select(F.col(key).cast("long").alias("row"), v.cast("array<float>").alias("vec")).where("vec is not null and row is not null")
    return plain.where(F.expr("exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x))"))


def dimensions(vectors: DataFrame) -> list[int]:
    """All dimensions that occur, by an aggregate over all rows."""
    return sorted(r["n"] for r in vectors.select(F.size("vec").alias("n")).distinct().collect())


def _padded(dim: int) -> int:
    return -(-dim // SUBSPACES) * SUBSPACES


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, filled up with zeros to a multiple of the subspaces, which changes no cosine."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow of the squares
    return np.pad(unit(x), ((0, 0), (0, _padded(dim) - dim))).astype(np.float32)


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of a float matrix as binary values."""
    width = 4 * x.shape[1]
    flat = np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])


def _unpack(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, width)


def normalised(vectors: DataFrame, dim: int) -> DataFrame:
    """(row, h1, h2, bytes): the unit vector and two hashes of it, equal for copies at any scale."""
    factors = np.random.default_rng(17).integers(1, 2**62, (2, _padded(dim)), dtype=np.int64) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            whole = np.rint(x.astype(np.float64) * 1e5).astype(np.int64)
            h1, h2 = ((whole * f).sum(axis=1) for f in factors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1), pa.array(h2), _pack(x)], names=["row", "h1", "h2", "bytes"])

    return vectors.select("row", "vec").mapInArrow(run, "row long, h1 long, h2 long, bytes binary")


def fold_copies(rows: DataFrame, members: int = 11) -> DataFrame:
    """One row per distinct vector with its least ``members`` row ids. They come from a window limited
    per group before the shuffle, so a group of copies of any size is never gathered.
    """
    top = Window.partitionBy("h1", "h2").orderBy("row")
    first = rows.withColumn("r", F.row_number().over(top)).where(f"r <= {members}")
    groups = first.groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list("row")).alias("members"), F.first("bytes").alias("bytes"))
    return groups.withColumn("rep", F.element_at("members", 1))


def near_lists(x: np.ndarray, upper: np.ndarray, lower: np.ndarray, owner: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, rows, lists): the nearest list of each vector, and all other lists within the margin of it.

    Lower centroids are looked at below the upper ones within the same margin.
    """
    scores = x @ upper.T
    open_ = scores >= scores.max(axis=1, keepdims=True) - within
    best = np.full(len(x), -2.0, np.float32)
    home = np.zeros(len(x), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for u in range(len(upper)):
        lists, who = np.nonzero(owner == u)[0], np.nonzero(open_[:, u])[0]
        if not len(lists) or not len(who):
            continue
        own = x[who] @ lower[lists].T
        arg = own.argmax(axis=1)
        top = own[np.arange(len(who)), arg]
        better = top > best[who]
        home[who[better]], best[who[better]] = lists[arg[better]], top[better]
        r, c = np.nonzero(own >= top[:, None] - within)
        found.append((who[r], lists[c], own[r, c]))
    if not found:  # only upper lists without a sampled row are near
        own = x @ lower.T
        return own.argmax(axis=1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, c, v = (np.concatenate(p) for p in zip(*found))
    missing = best < -1
    if missing.any():
        home[missing] = (x[missing] @ lower.T).argmax(axis=1)
    keep = (v >= best[r] - within) & (c != home[r])
    return home, r[keep], c[keep]


def top_of_each(who: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k entries of greatest cosine of each ``who``, ties by the smaller ``other``."""
    order = np.lexsort((other, -cosine, who))
    sorted_who = who[order]
    first = np.concatenate([[0], np.nonzero(np.diff(sorted_who))[0] + 1]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    return order[rank < k]


class Best:
    """The k entries of greatest cosine of each row among all that were added; holds a small multiple of them."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.limit = k, [], 0, 1 << 20

    def add(self, who: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> None:
        if len(who):
            self.held.append((who, other, cosine))
            self.size += len(who)
            if self.size > self.limit:
                self.held = [self.entries()]
                self.size = len(self.held[0][0])
                self.limit = max(1 << 20, 2 * self.size)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, other, cosine = (np.concatenate(p) for p in zip(*self.held))
        at = top_of_each(who, other, cosine, self.k)
        return who[at], other[at], cosine[at]


def rows_of_list(rows: int, list_rows: int, width: int) -> int:
    """Rows of a list: ``list_rows`` up to LISTS lists, then as many more as keep their number, within LIST_BYTES.

    A vector visits about a thirtieth of all lists, so visits would grow with the lists' number.
    """
    return max(list_rows, min(-(-rows // LISTS), LIST_BYTES // (4 * width)))


def compare_list(home: np.ndarray, home_ids: np.ndarray, visitors: Iterable[tuple[np.ndarray, np.ndarray]], index: Index,
                 k: int, least: float, within: float, fine_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cosine): for each home row and visitor its k best partners of at least ``least`` here.

    Codes are scanned by cells of about ``fine_rows`` rows; a query scans the cells within the margin.
    Visitors, (vectors, ids) at a time, stream past the home rows: memory holds the list's own rows, one
    chunk of visitors and the k best of each, whatever the number of visitors or of close pairs.
    """
    cells = kmeans(home, max(1, len(home) // fine_rows), 4)
    chunks = [slice(a, a + CHUNK_ROWS) for a in range(0, len(home), CHUNK_ROWS)]
    cell_of = np.concatenate([(home[c] @ cells.T).argmax(axis=1) for c in chunks])
    codes = np.concatenate([encode(home[c], index.books) for c in chunks])
    rows_of = [np.nonzero(cell_of == c)[0] for c in range(len(cells))]
    pairs = max(1, EXACT_NUMBERS // home.shape[1])
    back = Best(k)
    for source in (((home, home_ids),), visitors):
        for every, every_id in source:
            for start in range(0, len(every), CHUNK_ROWS):
                x, ids = every[start:start + CHUNK_ROWS], every_id[start:start + CHUNK_ROWS]
                ask = Best(k)
                scores = x @ cells.T
                near = scores >= scores.max(axis=1, keepdims=True) - within
                for c, rows in enumerate(rows_of):
                    asked = np.nonzero(near[:, c])[0]
                    if not len(rows) or not len(asked):
                        continue
                    step = max(64, (1 << 22) // len(rows))
                    for a in range(0, len(asked), step):
                        q = asked[a:a + step]
                        hits = np.flatnonzero(scan(x[q], codes[rows], index.books) >= least - index.slack)
                        for b in range(0, len(hits), pairs):
                            i, j = np.divmod(hits[b:b + pairs], len(q))
                            i, j = rows[i], q[j]
                            other = home_ids[i] != ids[j]
                            i, j = i[other], j[other]
                            exact = np.einsum("ij,ij->i", home[i].astype(np.float64), x[j].astype(np.float64))
                            keep = exact >= least
                            own, theirs, exact = home_ids[i[keep]], ids[j[keep]], exact[keep]
                            ask.add(theirs, own, exact)
                            back.add(own, theirs, exact)
                yield ask.entries()
    yield back.entries()


def similar_pairs(rows: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.90, list_rows: int = 8192,
                  within: float = 0.20, fine_rows: int = 160, cell_within: float = 0.16) -> DataFrame:
    """row_id_a < row_id_b with their cosine: pairs of at least ``least`` where one row is among the ``k``
    most similar of the other.

    Null, all-zero and malformed vectors take no part; vectors of different dimension have no cosine, so
    each dimension that occurs is a collection of its own. Ties are broken by the smaller row id, exact
    copies included; an empty table gives no pair. ``within`` sets how much farther than the nearest a
    list may be to be visited, ``cell_within`` the same for cells inside a list; a pair is missed only if neither row
    visits the other's home (59 of 48,350 pairs of 146,595 vectors, by brute force; 206 at a margin of 0.16). A list above twice its rows
    (:func:`rows_of_list`, ``list_rows`` or more) is cut into blocks that each of its rows visits.
    """
    vectors = usable(rows, key, vector)
    found = [_pairs_of(vectors.where(F.size("vec") == dim), dim, k, least, list_rows, within, fine_rows, cell_within) for dim in dimensions(vectors)]
    if not found:
        return rows.sparkSession.createDataFrame([], "row_id_a long, row_id_b long, cosine double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pairs_of(vectors: DataFrame, dim: int, k: int, least: float, list_rows: int, within: float, fine_rows: int,
              cell_within: float) -> DataFrame:
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    width = _padded(dim)
    keys = scratch.put(normalised(vectors, dim))
    reps = scratch.put(fold_copies(keys, k + 1))
    n = reps.count()
    list_rows = rows_of_list(n, list_rows, width)
    upper = math.ceil(math.sqrt(-(-n // list_rows)))
    sample = reps.select("bytes", "h1").orderBy("h1").limit(min(SAMPLE_ROWS, max(BOOK_ROWS, ROWS_PER_CENTROID * upper))).select("bytes").toArrow()
    fitted = spark.sparkContext.broadcast(fit(_unpack(sample.column(0).combine_chunks(), width), upper))
    # the same share of every upper list, so that a list's sample tells its size
    share = min(1.0, ROWS_PER_CENTROID / list_rows)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.nonzero((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(40)) < share * 2**24)[0]
            x = _unpack(batch.column(1).take(pa.array(chosen)), width)
            yield pa.RecordBatch.from_arrays([pa.array((x @ fitted.value.upper.T).argmax(axis=1).astype(np.int32)), _pack(x)], names=["owner", "bytes"])

    def lower_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unpack(sorted(pdf["bytes"]), width)  # the same centroids whatever the order of arrival
        c = kmeans(x, max(1, min(len(x), round(len(x) / (share * list_rows)))), 6)
        return pd.DataFrame({"owner": int(pdf["owner"].iloc[0]), "bytes": [r.tobytes() for r in c.astype(np.float32)]})

    # one vector for about list_rows rows goes to the driver and back: 1 / list_rows of the collection
    fine = reps.select("h1", "bytes").mapInArrow(sampled, "owner int, bytes binary").groupBy("owner").applyInPandas(
        lower_fit, "owner int, bytes binary").toArrow().sort_by("owner")
    if fine.num_rows:
        lower, owner = _unpack(fine.column(1).combine_chunks(), width), fine.column(0).to_numpy()
    else:  # so few rows that none was sampled
        lower, owner = fitted.value.upper, np.arange(len(fitted.value.upper))
    lists = spark.sparkContext.broadcast((lower, owner))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(lower)), np.int64)
        for batch in batches:
            x = _unpack(batch.column(0), width)
            for a in range(0, len(x), 4096):
                home, _, visited = near_lists(x[a:a + 4096], fitted.value.upper, *lists.value, within)
                counts += np.stack([np.bincount(home, minlength=len(lower)), np.bincount(visited, minlength=len(lower))])
        used = np.nonzero(counts.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["list", "n", "v"])

    # one row per list
    sizes = reps.select("bytes").mapInArrow(homes, "list long, n long, v long").groupBy("list").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    blocks = np.ones(len(lower), np.int64)
    placed_rows = 0
    for r in sizes:
        blocks[r["list"]] = max(1, -(-r["n"] // (2 * list_rows)))
        placed_rows += (r["n"] + r["v"]) * int(blocks[r["list"]])
    offset = np.concatenate([[0], np.cumsum(blocks)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x_all = _unpack(batch.column(1), width)
            for a in range(0, len(ids), 4096):
                x, own = x_all[a:a + 4096], ids[a:a + 4096]
                home, r, l = near_lists(x, fitted.value.upper, *lists.value, within)
                sub = (own * 2654435761 % 4294967296) % blocks[home]
                where = [offset[home] + sub]
                who, query = [np.arange(len(own))], [np.zeros(len(own), bool)]
                # visits: every block of the near lists, and the other blocks of the own list
                for rr, ll, skip in ((r, l, None), (np.nonzero(blocks[home] > 1)[0], None, sub)):
                    at = home[rr] if ll is None else ll
                    reps_ = np.repeat(np.arange(len(rr)), blocks[at])
                    inner = np.arange(len(reps_)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
                    keep = np.ones(len(reps_), bool) if skip is None else inner != skip[rr][reps_]
                    where.append((offset[at][reps_] + inner)[keep])
                    who.append(rr[reps_][keep])
                    query.append(np.ones(int(keep.sum()), bool))
                w, at, visits = np.concatenate(who), np.concatenate(where).astype(np.int32), np.concatenate(query)
                for b in range(0, len(w), CHUNK_ROWS):
                    c = slice(b, b + CHUNK_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(at[c]), pa.array(own[w[c]]), pa.array(visits[c]), _pack(x[w[c]])],
                                                     names=["block", "rep", "visit", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            for batch in batches:
                visit = batch.column(2).to_numpy(zero_copy_only=False)
                yield _unpack(batch.column(3), width), batch.column(1).to_numpy(), len(visit) - int(visit.sum())

        own: list[tuple[np.ndarray, np.ndarray]] = []
        visitors: list[tuple[np.ndarray, np.ndarray]] = []
        source = read()
        for x, ids, n in source:  # home rows come first
            own.append((x[:n], ids[:n]))
            if n < len(x):
                visitors.append((x[n:], ids[n:]))
                break
        home, home_ids = (np.concatenate(p) for p in zip(*own))
        own.clear()
        if len(home):
            stream = chain(visitors, ((x, ids) for x, ids, _ in source))
            for a, b, cosine in compare_list(home, home_ids, stream, fitted.value, k, least, cell_within, fine_rows):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], names=["a", "b", "cosine"])

    # partitions by rows, so that a task stays small however large the collection
    tasks = max(parallelism(spark), placed_rows * (4 * width + 40) // TASK_BYTES)
    placed = reps.select("rep", "bytes").mapInArrow(place, "block int, rep long, visit boolean, bytes binary").repartition(
        tasks, "block").sortWithinPartitions("block", "visit")
    found = placed.groupBy("block").applyInArrow(compare, "a long, b long, cosine double")
    both = scratch.put(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
    # the k nearest groups hold the k nearest rows outside the own group
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(f"r <= {k}")
    member_rows = reps.select(F.col("rep").alias("b"), F.slice("members", 1, k).alias("ids"))
    spread = near.join(member_rows, "b").select("a", "cosine", F.explode("ids").alias("id"))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "id"))).where(f"r <= {k}")
    others = ranked.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "id"))).alias("others"))
    local = reps.select("rep", "members").join(others, F.col("rep") == F.col("a"), "left")
    nothing = F.expr("array()").cast("array<struct<c:double,id:bigint>>")
    per_row = local.select(F.explode("members").alias("row"), "members", F.coalesce("others", nothing).alias("others"))
    own = F.expr("transform(filter(members, m -> m <> row), m -> named_struct('c', cast(-1.0 as double), 'id', m))")
    top = per_row.select("row", F.explode(F.slice(F.concat(own, "others"), 1, k)).alias("t")).select(
        "row", F.col("t.id").alias("id"), (-F.col("t.c")).alias("cosine"))
    # copies beyond the listed members of a large group: their nearest rows are its first k members
    large = reps.where(F.size("members") > k).select("h1", "h2", F.slice("members", 1, k).alias("ids"), F.element_at("members", k + 1).alias("last"))
    most = keys.groupBy("h1", "h2").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // COPIES_PER_TASK) or 1
    salted = large.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = keys.select("row", "h1", "h2").withColumn("s", F.pmod(F.col("row"), F.lit(salts)).cast("int")).join(salted, ["h1", "h2", "s"]).where("row > last")
    copies = rest.select("row", F.explode("ids").alias("id"), F.lit(1.0).alias("cosine"))
    return top.unionByName(copies).select(
        F.least("row", "id").alias("row_id_a"), F.greatest("row", "id").alias("row_id_b"), "cosine").groupBy(
        "row_id_a", "row_id_b").agg(F.max("cosine").alias("cosine"))


def search(rows: DataFrame, key: str, vector: str, asked: DataFrame, k: int = 10, chunk_rows: int = 50_000,
           rerank: int = 600) -> DataFrame:
    """(query, row, cosine, rank): the k most similar rows of each asked row, itself left out.

    All rows are scanned as 4-bit codes, in chunks of about ``chunk_rows``; each chunk scores its
    ``rerank`` best by the scan exactly. The stated loss: recall at 10 of at least 0.9 against brute
    force (measured in the tests). ``asked`` has the keys of the query set.
    """
    vectors = usable(rows, key, vector)
    found = [_search_of(vectors.where(F.size("vec") == dim), dim, key, asked, k, chunk_rows, rerank) for dim in dimensions(vectors)]
    if not found:
        return rows.sparkSession.createDataFrame([], "query long, row long, cosine double, rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_of(vectors: DataFrame, dim: int, key: str, asked: DataFrame, k: int, chunk_rows: int, rerank: int) -> DataFrame:
    width = _padded(dim)
    stored = Scratch(vectors.sparkSession, "search").put(normalised(vectors, dim).select("row", "bytes"))
    n = stored.count()
    sample = stored.select("bytes", F.xxhash64("row").alias("h")).orderBy("h").limit(BOOK_ROWS).select("bytes").toArrow()
    books = train_books(_unpack(sample.column(0).combine_chunks(), width))
    chunks = max(1, -(-n // chunk_rows))
    data = stored.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("asked", F.lit(False))
    queries = stored.join(asked.select(F.col(key).cast("long").alias("row")).distinct(), "row", "left_semi").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("asked", F.lit(True))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        base: np.ndarray | None = None
        for batch in batches:  # rows of the chunk come first, then the asked ones stream past them
            is_q, ids, x = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(), _unpack(batch.column(1), width)
            n = len(is_q) - int(is_q.sum())
            held.append((x[:n], ids[:n]))
            q_all, q_ids = x[n:], ids[n:]
            if not len(q_all):
                continue
            if base is None:
                base, base_ids = (np.concatenate(p) for p in zip(*held))
                held.clear()
                codes = np.concatenate([encode(base[a:a + CHUNK_ROWS], books) for a in range(0, len(base), CHUNK_ROWS)] or [np.zeros((0, SUBSPACES), np.uint8)])
                most = min(rerank, len(base))
            for a in range(0, len(q_all) if most else 0, 128):
                q = q_all[a:a + 128]
                approx = scan(q, codes, books).T
                top = np.argpartition(-approx, most - 1, axis=1)[:, :most]
                exact = np.einsum("qd,qkd->qk", q, base[top])
                exact[base_ids[top] == q_ids[a:a + 128, None]] = -9
                best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                r = np.repeat(np.arange(len(q)), best.shape[1])
                score = np.take_along_axis(exact, best, axis=1).ravel()
                keep = score > -5
                yield pa.RecordBatch.from_arrays([
                    pa.array(q_ids[a:a + 128][r][keep]), pa.array(base_ids[np.take_along_axis(top, best, axis=1).ravel()][keep]),
                    pa.array(score[keep].astype(np.float64))], names=["query", "row", "cosine"])

    local = data.unionByName(queries).select("row", "bytes", "asked", "chunk").repartition(
        max(parallelism(vectors.sparkSession), chunks), "chunk").sortWithinPartitions("chunk", "asked").groupBy("chunk").applyInArrow(look, "query long, row long, cosine double")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "row"))).where(f"rank <= {k}")
