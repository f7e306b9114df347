"""The k most similar vectors of every vector, within groups that must not be compared.

An inverted index with balanced posting lists on two levels, both fitted by the same clustering (parts that
stay too large are split again, so crowded regions get more lists) and searched in the same way:

* *cells* of about ``CELL`` vectors: their centroids are fitted on the driver from a bounded sample
  (``SAMPLE_A_CELL`` vectors for each cell, chosen by the hash of their id) and sent to the executors.  There
  are at most ``MOST_CELLS`` of them over all groups, which bounds the sample and the broadcast; beyond
  ``CELL * MOST_CELLS`` vectors the cells grow;
* *lists* of about ``LIST`` vectors inside each cell, fitted by the task that holds the cell, so their number
  is in proportion to the vectors, whatever their number, and they are never collected or broadcast.

On both levels a vector near a boundary is posted to each list whose centroid is not farther than
``1 + ratio`` times the nearest one, a query probes the lists within a wider ratio, and the nearest centroids
are found by best-first search in a neighbour graph held in memory.  A vector travels once to each of its
cells, as 16-bit numbers, where it is a query, a posting or both; lists are compared as matrix products.

Vectors that are the same after scaling form a class.  Of a class with more than ``k`` other members only the
first ``k + 1`` ids are posted, which are all that any answer needs, and its members' answers are read from
these; so a class may hold any share of the rows.

Every vector is indexed and every vector is a query.

Defined results: of each (id, group) the vector with the latest time counts (equal times: the greatest
code, usable before unusable); NULL ids and groups, NULL vectors, vectors of another length, all zeros, or with
NULL, NaN or infinite entries take no part; similarities are rounded to 6 digits and equal ones settled by
the smaller id; a group of one vector has no neighbours; an empty table gives no row.  The groups are a
configuration of few values, such as models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.session import cut_lineage

CELL, MOST_CELLS, SAMPLE_A_CELL = 4_000, 4_000, 16
LEAST_SAMPLE = 4_000  # vectors of each group that has more than one cell
LIST, FIT_ROWS = 500, 48  # vectors of a list inside a cell, and of them for the fit
STRIP = 32  # neighbouring similarities of which only the maximum is looked at first
FAN = 12  # parts of one split
CELLS = {"post": (0.06, 3), "probe": (0.09, 4)}  # distance ratio and most cells
LISTS = {"post": (0.10, 4), "probe": (0.16, 8)}
LINKS, BEAM, ENTRIES = 16, 16, 32
QUERY, POSTING = 1, 2
MOST_CLASSES = 200_000  # classes of equal vectors that are broadcast; more are joined by shuffling


def _split(x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Balanced spherical clustering: a part that holds more than its share attracts less in the next round."""
    centres = x[rng.choice(len(x), parts, replace=False)].copy()
    handicap = np.zeros(parts, np.float32)
    share = len(x) / parts
    for _ in range(rounds):
        attraction = x @ centres.T - handicap
        own = attraction.argmax(axis=1)
        size = np.bincount(own, minlength=parts)
        handicap += (0.1 * (float(attraction.std()) + 1e-6) * np.clip(size / share - 1.0, -1.0, 3.0)).astype(np.float32)
        sums = np.stack([x[own == p].sum(axis=0) if size[p] else x[rng.integers(len(x))] for p in range(parts)])
        centres = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return centres


def balanced_centres(x: np.ndarray, target: float, seed: int = 7) -> np.ndarray:
    """Unit centroids of parts of about ``target`` rows; parts that stay beyond 1.5 times that are split again.

    Centroids that attract less than a quarter of ``target`` are left out, and their rows go to others.
    """
    rng = np.random.default_rng(seed)
    todo, out = [x], []
    while todo:
        part = todo.pop()
        wanted = int(np.ceil(len(part) / target))
        split = None
        if wanted > 1 and len(part) > 1.5 * target:
            centres = _split(part, min(FAN, wanted), rng)
            own = (part @ centres.T).argmax(axis=1)
            split = [part[own == p] for p in range(len(centres))]
            split = [s for s in split if len(s)]
        if split and len(split) > 1:
            todo.extend(split)
        else:  # small enough, or rows that no centroid tells apart
            mean = part.sum(axis=0)
            out.append(mean / max(float(np.linalg.norm(mean)), 1e-9))
    centres = np.array(out, np.float32)
    own = np.concatenate([(x[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(x), 4096)])
    size = np.bincount(own, minlength=len(centres))
    return centres[(size >= target / 4) | (size == size.max())]


class Index:
    """Unit centroids and the graph that links each with its nearest ones."""

    def __init__(self, centres: np.ndarray, links: np.ndarray | None = None):
        self.centres = centres
        if links is None:
            count = min(LINKS, max(len(centres) - 1, 0))
            links = np.empty((len(centres), count), np.int32)
            for at in range(0, len(centres), 1024):
                rows = np.arange(at, min(at + 1024, len(centres)))
                sims = centres[rows] @ centres.T
                sims[np.arange(len(rows)), rows] = -9.0
                links[rows] = np.argsort(-sims, axis=1, kind="stable")[:, :count]
        self.links = links

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, similarities) of the ``want`` nearest centroids of each row, best first, by best-first graph search.

        The search starts from evenly spaced centroids and opens the best unopened one of the beam until all of
        the beam are opened, which looks at up to ``ENTRIES + LINKS * BEAM`` centroids; where there are no more
        than that, all are looked at in one product.
        """
        count, k = len(x), len(self.centres)
        want = min(want, k)
        if k <= ENTRIES + LINKS * BEAM:
            sims = x @ self.centres.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
            return order, np.take_along_axis(sims, order, 1)
        rows = np.arange(count)
        width = max(BEAM, want)
        start = np.unique(np.linspace(0, k - 1, min(k, max(ENTRIES, int(np.sqrt(k))))).astype(np.int64))
        seen = np.zeros((count, k), bool)
        seen[:, start] = True
        beam, score = np.broadcast_to(start, (count, len(start))), x @ self.centres[start].T
        opened = np.zeros(beam.shape, bool)
        while True:
            order = np.argsort(-score, axis=1, kind="stable")[:, :width]
            beam, score, opened = (np.take_along_axis(a, order, 1) for a in (beam, score, opened))
            best = np.where(opened, -9.0, score).argmax(axis=1)
            live = ~opened[rows, best]
            if not live.any():
                return beam[:, :want], score[:, :want]
            opened[rows, best] = True
            fresh = self.links[beam[rows, best]]
            new = ~seen[rows[:, None], fresh] & live[:, None]
            seen[rows[:, None], fresh] = True
            gained = np.where(new, np.einsum("bd,bnd->bn", x, self.centres[fresh]), -9.0)
            beam, score, opened = np.concatenate([beam, fresh], axis=1), np.concatenate([score, gained], axis=1), np.concatenate([opened, ~new], axis=1)

    def chosen(self, x: np.ndarray, rules: dict[str, tuple[float, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, posted, probed) of each row: which of the nearest centroids the distance ratios select."""
        numbers, sims = self.search(x, max(most for _, most in rules.values()))
        distance = np.sqrt(np.maximum(2.0 - 2.0 * sims, 1e-9))

        def inside(ratio: float, most: int) -> np.ndarray:
            within = distance <= (1.0 + ratio) * distance[:, :1] + 1e-6
            within[:, most:] = False
            return within

        return numbers, inside(*rules["post"]), inside(*rules["probe"])


def _decoded(codes: pa.Array) -> np.ndarray:
    """Unit vectors of a binary array without NULL, all of one length."""
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    x = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int16).reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, key: str, group: str, vector: str, time: str, size: int) -> DataFrame:
    """(id bigint, group_id, code binary): the latest vector of each (id, group), if it is usable, as 16-bit numbers.

    A code keeps the direction to about 2e-6 of a similarity.  The codes are kept in the shared checkpoint
    folder, as every later step reads them.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("group_id"), F.col(time).alias("time"), F.col(vector).cast("array<float>").alias("vector"))
    time_type = dict(rows.dtypes)["time"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            right = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
            x = np.asarray(vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, size)
            largest = np.abs(x).max(axis=1, initial=0.0)
            good = np.isfinite(largest) & (largest > 0)
            codes = np.full(batch.num_rows, None, object)
            scaled = np.rint(x[good].astype(np.float64) / largest[good, None] * 32767).astype(np.int16)
            codes[right[good]] = [c.tobytes() for c in scaled]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group_id"), batch.column("time"), pa.array(codes, pa.binary())], ["id", "group_id", "time", "code"])

    coded = rows.mapInArrow(encode, f"id long, group_id string, time {time_type}, code binary")
    latest = coded.groupBy("id", "group_id").agg(F.max(F.struct(F.col("time").isNotNull().alias("known"), "time", "code")).alias("r"))
    return cut_lineage(latest.select("id", "group_id", F.col("r.code").alias("code")).filter("code IS NOT NULL"))


def fit_indexes(units: DataFrame) -> dict[str, Index]:
    """The cells of each group, from at most about ``MOST_CELLS * SAMPLE_A_CELL`` vectors, or ``LEAST_SAMPLE`` of a small group."""
    totals = {r["group_id"]: r["n"] for r in units.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = MOST_CELLS / max(sum(totals.values()), 1)
    cells = {name: max(1, int(min(n / CELL, n * bound))) for name, n in totals.items()}
    wanted = {name: min(totals[name], max(LEAST_SAMPLE, SAMPLE_A_CELL * c)) for name, c in cells.items() if c > 1}
    held: dict[str, list[np.ndarray]] = {name: [] for name in wanted}
    if wanted:
        rate = F.create_map(*[F.lit(v) for name in sorted(wanted) for v in (name, wanted[name] / totals[name])])
        share = F.pmod(F.xxhash64("id"), F.lit(2**31)) / float(2**31)
        sample = units.filter(share < F.element_at(rate, F.col("group_id"))).orderBy("group_id", "id").toArrow()
        names = np.array(sample.column("group_id").to_pylist(), object)
        if len(names):
            x = _decoded(sample.column("code").combine_chunks())
            held = {name: x[names == name] for name in wanted}
    indexes = {}
    for name, n in totals.items():
        x = held.get(name)
        if x is None or len(x) < 2:
            indexes[name] = Index(np.zeros((1, 1), np.float32))  # one cell, nothing to choose
        else:
            indexes[name] = Index(balanced_centres(x, len(x) / cells[name]))
    return indexes


def _equal_classes(units: DataFrame, k: int) -> DataFrame:
    """(group_id, same, firsts): the ``k + 1`` smallest ids of each class of equal codes with more members."""
    order = Window.partitionBy("group_id", "same").orderBy("id")
    # Only the first rows of a class leave a task.
    firsts = units.select("group_id", "id", F.md5("code").alias("same")).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 2)
    classes = firsts.groupBy("group_id", "same").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") == k + 2)
    return classes.select("group_id", "same", F.slice("ids", 1, k + 1).alias("firsts"))


def cell_neighbours(ids: np.ndarray, role: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, similarity): the k most similar postings of each query of one cell."""
    order = np.argsort(ids, kind="stable")
    ids, role, x = ids[order], role[order], x[order]
    posts, queries = np.flatnonzero(role & POSTING), np.flatnonzero(role & QUERY)
    if not len(posts) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    by_list = _lists_of_cell(role, x, posts)
    # Where the lists overlap so much that they compare no fewer pairs than the whole cell, the cell is one list.
    if sum(len(held) * len(asking) for held, asking in by_list) >= len(posts) * len(queries):
        by_list = [(posts, queries)]
    candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    room = np.zeros(len(x), np.int64)
    for held, asking in by_list:
        if len(held) and len(asking):
            candidates.append(_best_of_list(x, held, asking, k + 2))
            room[asking] = np.maximum(room[asking], len(held))
    # A query whose lists are all too short for k others is compared with the whole cell.
    short = queries[room[queries] < k + 1]
    if len(short):
        candidates.append(_best_of_list(x, posts, short, k + 2))
    q, p, sim = (np.concatenate(c) for c in zip(*candidates))
    sim = np.round(sim.astype(np.float64), 6)
    order = np.lexsort((p, -sim, q))  # rows are in the order of ids
    q, p, sim = q[order], p[order], sim[order]
    if len(candidates) > 1:  # lists share postings; their similarities may differ in the last digit
        _, first = np.unique(q * len(x) + p, return_index=True)
        first.sort()
        q, p, sim = q[first], p[first], sim[first]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return ids[q[kept]], ids[p[kept]], sim[kept]


def _lists_of_cell(role: np.ndarray, x: np.ndarray, posts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(postings, queries) of each list of a cell."""
    lists = max(1.0, len(posts) / LIST)
    fit = posts[:: max(1, int(len(posts) / (lists * FIT_ROWS)))]
    index = Index(balanced_centres(x[fit], len(fit) / lists))
    entries: dict[int, list[np.ndarray]] = {POSTING: [], QUERY: []}
    for at in range(0, len(x), 1024):
        numbers, posted, probed = index.chosen(x[at : at + 1024], LISTS)
        for bit, chosen in ((POSTING, posted), (QUERY, probed)):
            row, column = np.nonzero(chosen & ((role[at : at + 1024] & bit) > 0)[:, None])
            entries[bit].append(np.stack([numbers[row, column], row + at]))
    sides = []
    for bit in (POSTING, QUERY):
        number, row = np.concatenate(entries[bit], axis=1)
        at = np.argsort(number, kind="stable")
        sides.append(np.split(row[at], np.searchsorted(number[at], np.arange(1, len(index.centres)))))
    return list(zip(*sides))


def _best_of_list(x: np.ndarray, held: np.ndarray, asking: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, posting row, similarity): the ``take`` best postings of each query, itself left out."""
    take = min(take, len(held))
    width = -(-len(held) // STRIP)  # column c belongs to strip c % width
    against = np.zeros((width * STRIP, x.shape[1]), np.float32)
    against[: len(held)] = x[held]
    position = np.full(len(x), -1)
    position[held] = np.arange(len(held))
    found = []
    for at in range(0, len(asking), 512):
        q = asking[at : at + 512]
        sims = x[q] @ against.T
        sims[:, len(held) :] = -9.0
        itself = np.flatnonzero(position[q] >= 0)
        sims[itself, position[q[itself]]] = -9.0
        # The best of a row lie in the strips with the best maxima.
        inside, where = sims, np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
        if width > take:
            strips = sims.reshape(len(q), STRIP, width)
            good = np.argpartition(strips.max(axis=1), -take, axis=1)[:, -take:]
            where = (np.arange(STRIP)[None, :, None] * width + good[:, None, :]).reshape(len(q), -1)
            inside = np.take_along_axis(sims, where, 1)
        best = np.argpartition(inside, -take, axis=1)[:, -take:]
        value, column = np.take_along_axis(inside, best, 1).ravel(), np.take_along_axis(where, best, 1).ravel()
        real = value > -8.0
        found.append((np.repeat(q, take)[real], held[column[real]], value[real]))
    rows, others, values = zip(*found)
    return np.concatenate(rows), np.concatenate(others), np.concatenate(values)


def nearest_vectors(units: DataFrame, indexes: dict[str, Index], k: int) -> DataFrame:
    """(group_id, id, neighbour, similarity, place): the k most similar vectors of every vector.

    ``units`` comes from :func:`usable_vectors`, ``indexes`` from :func:`fit_indexes`.
    """
    spark = units.sparkSession
    first_cell, cells = {}, 0
    for name in sorted(indexes):
        first_cell[name], cells = cells, cells + len(indexes[name].centres)
    held = spark.sparkContext.broadcast({name: (first_cell[name], i.centres, i.links) for name, i in indexes.items()})

    classes = cut_lineage(_equal_classes(units, k))
    of_class, count = None, classes.count()
    rows = units.withColumn("role", F.lit(QUERY | POSTING))
    if count:
        classes = F.broadcast(classes) if count <= MOST_CLASSES else classes
        marked = units.withColumn("same", F.md5("code")).join(classes, ["group_id", "same"], "left")
        rows = marked.filter(F.col("firsts").isNull() | F.array_contains("firsts", F.col("id"))).select("id", "group_id", "code", F.when(F.col("firsts").isNull(), QUERY | POSTING).otherwise(POSTING).alias("role"))
        others = F.slice(F.array_remove("firsts", F.col("id")), 1, k)
        of_class = marked.filter("firsts IS NOT NULL").select("group_id", "id", F.posexplode(others).alias("at", "neighbour")).select("group_id", "id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("at") + 1).alias("place"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes_here = {name: (first, Index(centres, links)) for name, (first, centres, links) in held.value.items()}
        for batch in batches:
            names = np.array(batch.column("group_id").to_pylist(), object)
            for name in sorted(set(names) & set(indexes_here)):
                first, index = indexes_here[name]
                mine = np.flatnonzero(names == name)
                for at in range(0, len(mine), 1024):
                    part = batch.take(pa.array(mine[at : at + 1024]))
                    role = part.column("role").to_numpy()
                    if len(index.centres) == 1:
                        row, cell = np.arange(len(role)), np.zeros(len(role), np.int64)
                        use = role
                    else:
                        numbers, posted, probed = index.chosen(_decoded(part.column("code")), CELLS)
                        uses = (POSTING * posted | QUERY * probed) & role[:, None]
                        row, column = np.nonzero(uses)
                        cell, use = numbers[row, column], uses[row, column]
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array((cell + first).astype(np.int32)), taken.column("group_id"), taken.column("id"), pa.array(use.astype(np.int32)), taken.column("code")], ["cell", "group_id", "id", "role", "code"])

    def compare(table: pa.Table) -> pa.Table:
        found, neighbours, similarity = cell_neighbours(table.column("id").to_numpy(), table.column("role").to_numpy(), _decoded(table.column("code").combine_chunks()), k)
        return pa.table({"group_id": pa.array([table.column("group_id")[0].as_py()] * len(found), pa.string()), "id": pa.array(found, pa.int64()), "neighbour": pa.array(neighbours, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    routed = rows.mapInArrow(route, "cell int, group_id string, id long, role int, code binary")
    # A partition for each cell, so no task gets several by chance.
    near = routed.repartitionById(cells, F.col("cell")).groupBy("cell").applyInArrow(compare, "group_id string, id long, neighbour long, similarity double") if cells else routed.select("group_id", "id", F.lit(None).cast("long").alias("neighbour"), F.lit(None).cast("double").alias("similarity"))
    # The same neighbour may come from several cells; a query has at most k * cells candidates.
    met = near.repartition("group_id", "id").groupBy("group_id", "id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = met.groupBy("group_id", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("away"), "neighbour"))), 1, k).alias("b"))
    found = best.select("group_id", "id", F.posexplode("b").alias("at", "n")).select("group_id", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.away")).alias("similarity"), (F.col("at") + 1).alias("place"))
    return found if of_class is None else found.unionByName(of_class)


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """(group_id, id_a, id_b), a < b: pairs of which one is among the other's nearest, at ``least`` similar."""
    pairs = neighbours.filter(F.col("similarity") >= least).select("group_id", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pairs.distinct()
