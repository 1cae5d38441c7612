"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long hash string: symbols of a few bits, each the
largest of a group of coordinates (and its sign) under the tree's own random rotation.
Near vectors share long prefixes.  A tree is the sorted array of its strings, held in
segments by the first bits of the string; a segment above its size, because many strings
begin alike, is dealt over several arrays that are all searched.

A query is looked up in all trees.

1. It descends to the longest prefix that it shares with anything, and ascends in all
   trees in step, STEP_BITS at a time, until their cells hold SOUGHT vectors a neighbour
   and tree.  These are measured exactly on the original vectors.
2. The distance of the last neighbour found bounds the angle between the query and
   anything nearer, and so how often a tree gives both of them one prefix.  The query
   ascends on, in all trees in step, to the longest prefix at which a vector at that
   distance would be missed by all trees with a probability of MISS at most, and
   everything in these cells is measured.

So how far a query ascends follows from its own neighbourhood and from nothing else:
there is no cap on candidates and no other way for small tables.  Where neighbours stand
out, cells are small; where everything is about equally far, no short list of candidates
holds the nearest ones, and cells are wide.  The rotations are random, so the expected
share of neighbours found is 1 - MISS or more for any data.

Cells are not gathered by query.  A segment hands each block of vectors its entries once,
in order, with the positions of every query's cell among them; the block unites a
query's cells and measures what they hold.

No group grows with the data: segments, their queries and blocks are all dealt by
size.  Identical vectors are one class, which keeps the ids that can reach a result: the
k + 1 smallest.

The rotations are drawn from a fixed seed and not fitted; every vector is indexed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor rows without an id, nor vectors of another length
than the most common one (of equally common ones the longer).  A row repeated in
id and vector counts once.  Ties go to the smaller id.  Vectors so long that their
length is no finite double are measured against everything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import prepared, through_table

TREES = 80
#: Coordinates of which a symbol names the largest.
GROUP = 8
#: Bits of a string, and of one for more vectors than MANY.
STRING_BITS, LONG_BITS, MANY = 32, 60, 1 << 24
#: Prefixes get shorter by so many bits at a time.
STEP_BITS = 2
#: Entries in cells a neighbour and tree before anything is measured.
SOUGHT = 2
#: A neighbour may be missed with this probability.
MISS = 0.08
#: Entries of a segment, queries that it is asked for at once, and vectors of a block.
SEGMENT, QUERIES, VECTOR_BLOCK = 65_536, 65_536, 8_192
#: Queries in one matrix product.
PRODUCT_ROWS = 256
SEED = 20_240_229
#: Pairs of vectors drawn to tell how often prefixes agree, and the angles between them.
SAMPLES, ANGLES = 10_000, 60
#: A slot is the block of a vector and its place there.
_PLACE_BITS = 24


def symbol_width(dimensions: int) -> int:
    """Bits of a symbol: which of so many coordinates is largest, and its sign."""
    return min(GROUP, dimensions).bit_length()


def string_symbols(n: int, dimensions: int) -> int:
    return (LONG_BITS if n > MANY else STRING_BITS) // symbol_width(dimensions)


def _shape(dimensions: int, symbols: int) -> tuple[int, int, int]:
    """(coordinates of a symbol, symbols of a rotation, rotations)."""
    group = 1 << (symbol_width(dimensions) - 1)
    each = min(symbols, dimensions // group)
    return group, each, -(-symbols // each)


def rotation(tree: int, dimensions: int, symbols: int) -> np.ndarray:
    """Orthonormal columns, those of one random rotation after another, as many as the symbols take."""
    group, each, count = _shape(dimensions, symbols)
    rng = np.random.default_rng([SEED, tree])
    turns = [np.linalg.qr(rng.normal(size=(dimensions, each * group)))[0] for _ in range(count)]
    return np.concatenate(turns, axis=1)[:, : symbols * group].astype(np.float32)


def strings(turned: np.ndarray, dimensions: int, symbols: int) -> np.ndarray:
    """The hash strings of turned vectors, as longs; the first symbol is the highest."""
    group, width = 1 << (symbol_width(dimensions) - 1), symbol_width(dimensions)
    turned = turned.reshape(len(turned), symbols, group)
    largest = np.abs(turned).argmax(axis=2)
    sign = np.take_along_axis(turned, largest[:, :, None], axis=2)[:, :, 0] > 0
    worth = np.int64(1) << (width * np.arange(symbols - 1, -1, -1, dtype=np.int64))
    # The sign leads: a prefix that ends within a symbol still tells both signs apart.
    return ((sign * group + largest) * worth).sum(axis=1, dtype=np.int64)


def shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix of strings of so many bits."""
    differ = np.bitwise_xor(a, b)
    return bits - np.where(differ > 0, np.frexp(differ.astype(np.float64))[1], 0)


def settled_depths(dimensions: int, symbols: int, trees: int) -> list[int]:
    """By angle, in ANGLES steps of a half turn: the longest prefix by which trees miss no more than MISS.

    Drawn pairs at an angle tell how often their strings agree so far, less three
    deviations.  A step's answer holds for all angles within it.
    """
    rng = np.random.default_rng([SEED, dimensions])
    bits = symbols * symbol_width(dimensions)
    group, each, count = _shape(dimensions, symbols)
    x = rng.normal(size=(SAMPLES, dimensions))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=(SAMPLES, dimensions))
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    # The pairs are random themselves, so the rotations of one tree will do.
    turn = rotation(0, dimensions, symbols).astype(np.float64)
    first, other = x @ turn, u @ turn
    own = strings(first, dimensions, symbols)
    found = []
    for step in range(1, ANGLES + 1):
        angle = math.pi * step / ANGLES
        shared = shared_bits(own, strings(math.cos(angle) * first + math.sin(angle) * other, dimensions, symbols), bits)
        agree = np.cumsum(np.bincount(shared.astype(np.int64), minlength=bits + 1)[::-1])[::-1] / SAMPLES
        agree = np.maximum(0.0, agree - 3 * np.sqrt(agree / SAMPLES))
        settled = np.flatnonzero((1 - agree) ** trees <= MISS)
        depth = int(settled[-1]) if len(settled) else 0
        found.append(min(depth, found[-1]) if found else depth)
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part; vectors as doubles."""
    wide = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    ).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    # Not false but null where the vector holds a null.
    without = lambda x: ~F.array_contains("vector", F.lit(x))
    wide = wide.filter(without(float("nan")) & without(float("inf")) & without(float("-inf")))
    wide = wide.filter((F.array_max("vector") != 0) | (F.array_min("vector") != 0))
    common = (
        wide.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    )
    return wide.filter(F.size("vector") == (common["n"] if common else 0))


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def hashed(vectors: np.ndarray, symbols: int, trees: int):
    """Tree by tree, the strings of vectors."""
    dimensions = vectors.shape[1]
    level = (vectors / np.abs(vectors).max(axis=1)[:, None]).astype(np.float32)  # strings know no length
    for tree in range(trees):
        yield tree, strings(level @ rotation(tree, dimensions, symbols), dimensions, symbols)


def cells_in(held: np.ndarray, string: np.ndarray, depth: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in a sorted array the strings begin and end that share so many bits with each string."""
    below = np.int64(bits) - depth.astype(np.int64)
    first = string >> below << below
    return np.searchsorted(held, first), np.searchsorted(held, first + (np.int64(1) << below))


class Forest:
    """The index over classes of equal vectors: sorted arrays of strings, and blocks of vectors."""

    def __init__(self, classes: DataFrame, n: int, dimensions: int, k: int, trees: int):
        self.n, self.dimensions, self.k, self.trees = n, dimensions, k, trees
        self.symbols = string_symbols(n, dimensions)
        self.bits = self.symbols * symbol_width(dimensions)
        #: Segments are cut by so many leading bits: their average size is about SEGMENT.
        self.cell_bits = min(self.bits, max(0, math.ceil(math.log2(max(1, n) / SEGMENT))))
        block = F.pmod(F.xxhash64("class_id"), F.lit(max(1, -(-n // VECTOR_BLOCK))).cast("long"))
        place = F.row_number().over(Window.partitionBy("block").orderBy("class_id")) - 1
        self.blocks = through_table(
            classes.withColumn("block", block).withColumn("place", place.cast("long")), "forest-blocks"
        )
        ends = classes.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
        self.lengths = (ends["low"] or 0.0, ends["high"] or 0.0)
        self.arrays = through_table(self._arrays(), "forest-arrays")
        self.dealt = self.arrays.groupBy("tree", "cell").agg((F.max("sub") + 1).alias("subs"))

    def _arrays(self) -> DataFrame:
        """(tree, cell, sub, strings, slots): sorted arrays of about SEGMENT entries."""
        shift, symbols, n_trees = self.bits - self.cell_bits, self.symbols, self.trees

        def pieces(batches):
            held, size = [], 0

            def cut():
                slots = np.concatenate([s for s, _ in held])
                trees, cells, counts, found, own = [], [], [], [], []
                for tree, strings_ in hashed(np.concatenate([v for _, v in held]), symbols, n_trees):
                    order = np.argsort(strings_, kind="stable")
                    cell = strings_[order] >> shift
                    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    for start, stop in zip(edges, [*edges[1:], len(cell)], strict=True):
                        trees.append(tree)
                        cells.append(int(cell[start]))
                        counts.append(stop - start)
                        found.append(strings_[order[start:stop]].tobytes())
                        own.append(slots[order[start:stop]].tobytes())
                for at in range(0, len(trees), 1000):
                    part = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(trees[part], pa.int32()),
                            pa.array(cells[part], pa.int64()),
                            pa.array(counts[part], pa.int64()),
                            pa.array(found[part], pa.binary()),
                            pa.array(own[part], pa.binary()),
                        ],
                        names=["tree", "cell", "n", "strings", "slots"],
                    )

            for batch in batches:
                block, place = (batch.column(c).to_numpy() for c in ("block", "place"))
                held.append((block << _PLACE_BITS | place, _matrix(batch.column("vector"))))
                size += len(batch)
                if size >= VECTOR_BLOCK:
                    yield from cut()
                    held, size = [], 0
            if held:
                yield from cut()

        def merge(table: pa.Table) -> pa.Table:
            found = np.concatenate([_longs(s) for s in table["strings"].to_pylist()])
            slots = np.concatenate([_longs(s) for s in table["slots"].to_pylist()])
            order = np.lexsort((slots, found))
            return pa.table(
                {
                    "tree": table["tree"].slice(0, 1),
                    "cell": table["cell"].slice(0, 1),
                    "sub": table["sub"].slice(0, 1),
                    "strings": pa.array([found[order].tobytes()], pa.binary()),
                    "slots": pa.array([slots[order].tobytes()], pa.binary()),
                }
            )

        cut = through_table(
            self.blocks.select("block", "place", "vector").mapInArrow(
                pieces, "tree int, cell long, n long, strings binary, slots binary"
            ),
            "forest-pieces",
        )
        subs = cut.groupBy("tree", "cell").agg(F.ceil(F.sum("n") / (2 * SEGMENT)).cast("long").alias("subs"))
        own = F.pmod(F.xxhash64("slots"), "subs")
        return (
            cut.join(subs, ["tree", "cell"])
            .select("tree", "cell", own.alias("sub"), "strings", "slots")
            .groupBy("tree", "cell", "sub")
            .applyInArrow(merge, "tree int, cell long, sub long, strings binary, slots binary")
        )

    def asked(self) -> DataFrame:
        """(query, vector, length, strings) of the classes that ask."""
        symbols, trees = self.symbols, self.trees

        def run(batches):
            for batch in batches:
                found = np.stack([s for _, s in hashed(_matrix(batch.column("vector")), symbols, trees)], axis=1)
                edges = np.arange(0, found.size + 1, trees, dtype=np.int32)
                own = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query"), batch.column("vector"), batch.column("length"), own],
                    names=["query", "vector", "length", "strings"],
                )

        asking = self.blocks.filter("asks").select(F.col("class_id").alias("query"), "vector", "length")
        return asking.repartition("query").mapInArrow(
            run, "query long, vector array<double>, length double, strings array<long>"
        )

    def _requests(self, asked: DataFrame) -> DataFrame:
        """(tree, cell, sub, part, query, string, depth): what each array is asked for."""
        shift = self.bits - self.cell_bits
        each = asked.select("query", "depth", F.posexplode("strings").alias("tree", "string"))
        each = each.filter((F.col("depth") > 0) | (F.col("tree") == 0))  # at the root one tree holds all
        own = F.shiftright("string", shift)
        # A prefix shorter than that of a segment spans segments.
        wide = F.greatest(F.lit(0), F.lit(self.cell_bits) - F.col("depth"))
        first = F.call_function("shiftleft", F.call_function("shiftright", own, wide), wide)
        span = F.call_function("shiftleft", F.lit(1).cast("long"), wide)
        cells = F.sequence(first, first + span - 1)
        each = each.select("tree", F.explode(cells).alias("cell"), "query", "string", "depth") if self.cell_bits else (
            each.select("tree", F.lit(0).cast("long").alias("cell"), "query", "string", "depth")
        )
        parts = each.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("parts"))
        known = self.dealt.join(parts, ["tree", "cell"])
        return each.join(known, ["tree", "cell"]).select(
            "tree", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"),
            F.pmod(F.xxhash64("query"), "parts").alias("part"), "query", "string", "depth",
        )

    def _at_arrays(self, requests: DataFrame, work, schema: str) -> DataFrame:
        key = ["tree", "cell", "sub", "part"]
        wanted = requests.groupBy(*key[:3]).agg((F.max("part") + 1).alias("parts"))
        arrays = self.arrays.join(wanted, key[:3]).select(
            *key[:3], F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "strings", "slots"
        )
        # Both sides come from one table; cogroup mixes up columns that are one attribute.
        asking = requests.select(*(F.col(c).alias(f"to_{c}") for c in key), "query", "string", "depth")
        return arrays.groupBy(*key).cogroup(asking.groupBy(*(f"to_{c}" for c in key))).applyInArrow(work, schema)

    def first_depth(self, asked: DataFrame) -> DataFrame:
        """Add the depth at which the cells of all trees hold SOUGHT entries a neighbour and tree."""
        bits = self.bits
        most = list(range(bits, self.cell_bits, -STEP_BITS)) or [bits]

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            queries, depths, counts = [], [], []
            if left.num_rows and right.num_rows:
                held = _longs(left["strings"][0].as_py())
                string, query = right["string"].to_numpy(), right["query"].to_numpy()
                for depth in most:
                    start, stop = cells_in(held, string, np.full(len(string), depth), bits)
                    n = stop - start
                    some = np.flatnonzero(n)
                    queries.append(query[some])
                    depths.append(np.full(len(some), depth, np.int32))
                    counts.append(n[some])
            empty = [np.zeros(0, np.int64)]
            return pa.table(
                {
                    "query": pa.array(np.concatenate(queries or empty)),
                    "depth": pa.array(np.concatenate(depths or empty).astype(np.int32)),
                    "n": pa.array(np.concatenate(counts or empty).astype(np.int64)),
                }
            )

        deepest = asked.withColumn("depth", F.lit(self.bits))
        counted = self._at_arrays(self._requests(deepest), count, "query long, depth int, n long")
        sought = SOUGHT * self.k * self.trees
        reached = counted.groupBy("query", "depth").agg(F.sum("n").alias("n")).filter(F.col("n") >= sought)
        reached = reached.groupBy("query").agg(F.max("depth").alias("depth"))
        least = 0 if not self.cell_bits else self.cell_bits
        return asked.join(reached, "query", "left").withColumn("depth", F.coalesce("depth", F.lit(least)))

    def measured(self, asked: DataFrame) -> DataFrame:
        """(query, members, score, place): the k + 1 nearest classes in the cells of each query."""
        requests, bits = self._requests(asked), self.bits

        def gather(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                held = _longs(left["strings"][0].as_py())
                start, stop = cells_in(held, right["string"].to_numpy(), right["depth"].to_numpy(), bits)
                slots = _longs(left["slots"][0].as_py())
                query = right["query"].to_numpy()
                edges = np.zeros(len(slots) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, stop, -1)
                at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                block = slots[at] >> _PLACE_BITS
                order = np.argsort(block, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
                for own in np.split(at[order], ends[:-1]) if len(at) else []:
                    a, b = np.searchsorted(own, start), np.searchsorted(own, stop)
                    some = np.flatnonzero(b > a)
                    places = (slots[own] & ((1 << _PLACE_BITS) - 1)).astype(np.int32)
                    rows.append(
                        (
                            int(slots[own[0]] >> _PLACE_BITS),
                            places.tobytes(),
                            query[some],
                            np.stack([a[some], b[some]]).astype(np.int32).tobytes(),
                        )
                    )
            lengths = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
            return pa.table(
                {
                    "block": pa.array([r[0] for r in rows], pa.int64()),
                    "places": pa.array([r[1] for r in rows], pa.binary()),
                    "queries": pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                    "cells": pa.array([r[3] for r in rows], pa.binary()),
                }
            )

        gathered = through_table(
            self._at_arrays(requests, gather, "block long, places binary, queries array<long>, cells binary"),
            "forest-gathered",
        )
        met = gathered.select("block", F.explode("queries").alias("query")).distinct()
        looked = met.join(asked.select("query", "vector"), "query").select(
            "block", F.lit(None).cast("binary").alias("places"), F.array("query").alias("queries"),
            F.lit(None).cast("binary").alias("cells"), F.col("vector").alias("asked"),
        )
        sent = gathered.withColumn("asked", F.lit(None).cast("array<double>")).unionByName(looked)
        sent = sent.withColumnRenamed("block", "to_block")
        k = self.k

        def measure(left: pa.Table, right: pa.Table) -> pa.Table:
            queries, members, scores = [], [], []
            if left.num_rows and right.num_rows:
                place = left["place"].to_numpy()
                order = np.argsort(place)
                vectors, ids = _matrix(left["vector"])[order], left["class_id"].to_numpy()[order]
                held = left["members"].combine_chunks().take(pa.array(order))
                told = right.filter(right["asked"].is_valid())
                own, asked_ = told["queries"].combine_chunks().flatten().to_numpy(), _matrix(told["asked"])
                by_query = np.argsort(own)
                own, asked_ = own[by_query], asked_[by_query]
                wanted: list[list[np.ndarray]] = [[] for _ in own]
                cells = right.filter(right["asked"].is_null())
                for data, who, bounds in zip(
                    cells["places"].to_pylist(), cells["queries"].combine_chunks(), cells["cells"].to_pylist(), strict=True
                ):
                    places = np.frombuffer(data, np.int32)
                    starts, stops = np.frombuffer(bounds, np.int32).reshape(2, -1).tolist()
                    for q, a, b in zip(np.searchsorted(own, who.values.to_numpy()).tolist(), starts, stops, strict=True):
                        wanted[q].append(places[a:b])
                with np.errstate(over="ignore", invalid="ignore"):
                    squares = (vectors**2).sum(axis=1)
                    for base in range(0, len(own), PRODUCT_ROWS):
                        some = asked_[base : base + PRODUCT_ROWS]
                        length = (some**2).sum(axis=1)[:, None]
                        rough = squares - 2 * (some @ vectors.T) + length
                        # Rounding may misplace products by less than this; the nearest are measured exactly.
                        slack = 1e-10 * (squares.max() + length[:, 0])
                        for row in range(len(some)):
                            mask = np.zeros(len(vectors), bool)
                            for cell in wanted[base + row]:
                                mask[cell] = True
                            at = np.flatnonzero(mask)
                            near = rough[row][at]
                            last = min(k + 1, len(at)) - 1
                            border = np.partition(near, last)[last] + slack[row]
                            if np.isfinite(border) and np.isfinite(near).all():
                                at = at[near <= border]
                            score = np.sqrt(((vectors[at] - some[row]) ** 2).sum(axis=1))
                            best = np.lexsort((ids[at], score))[: k + 1]
                            queries.append(np.full(len(best), own[base + row]))
                            members.append(at[best])
                            scores.append(score[best])
            if not queries:
                queries, members, scores = [np.zeros(0, np.int64)], [], [np.zeros(0)]
            chosen = np.concatenate(members) if members else np.zeros(0, np.int64)
            return pa.table(
                {
                    "query": pa.array(np.concatenate(queries).astype(np.int64)),
                    "members": held.take(pa.array(chosen)) if members else pa.array([], pa.list_(pa.int64())),
                    "score": pa.array(np.concatenate(scores)),
                }
            )

        found = (
            self.blocks.select("block", "place", "class_id", "vector", "members")
            .groupBy("block")
            .cogroup(sent.groupBy("to_block"))
            .applyInArrow(measure, "query long, members array<long>, score double")
        )
        best = Window.partitionBy("query").orderBy("score", F.get("members", F.lit(0)))
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)

    def further(self, asked: DataFrame, near: DataFrame) -> DataFrame:
        """The queries that have to ascend on, with the depth they have to ascend to."""
        so_far = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            near.withColumn("ids", F.sum(F.size("members")).over(so_far))
            .filter(F.col("ids") > self.k)
            .groupBy("query")
            .agg(F.min("score").alias("last"))
        )
        low, high = (F.lit(float(x)) for x in self.lengths)
        x, r = F.col("length"), F.col("last")
        # Of all lengths in the table, the one that lets a vector within r of the query be farthest in angle.
        worst = F.when(x > r, F.greatest(low, F.least(high, F.sqrt(x * x - r * r)))).otherwise(low)
        cosine = (x * x + worst * worst - r * r) / (2 * x * worst)
        cosine = F.when(F.isnan(cosine) | (x == float("inf")), -1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
        depths = F.array(*(F.lit(d) for d in settled_depths(self.dimensions, self.symbols, self.trees)))
        step = F.greatest(F.lit(1), F.ceil(F.acos(cosine) * ANGLES / math.pi)).cast("int")
        wanted = F.coalesce(F.element_at(depths, F.least(step, F.lit(ANGLES))), F.lit(0))
        both = asked.join(last, "query", "left").withColumn("wanted", wanted)
        return both.filter(F.col("wanted") < F.col("depth")).select(
            "query", "vector", "length", "strings", F.col("wanted").cast("int").alias("depth")
        )


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query, a condition on vec_id."""
    prepared(vectors.sparkSession)
    asks = F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False))
    rows = through_table(usable(vectors, id_col, vector_col).withColumn("hash", F.xxhash64("vector")), "forest-rows")
    # Most vectors are there once: their hashes tell, and they need no comparison.
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select("hash")
    often = through_table(often, "forest-often")
    once = rows.join(often, "hash", "left_anti").select(
        "vector", F.array("vec_id").alias("members"), asks.alias("asks"), F.col("vec_id").alias("class_id")
    )
    repeated = rows.join(often, "hash", "left_semi").select("vec_id", "vector").distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = (
        repeated.withColumn("place", place)
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    )
    asking = repeated.filter(asks).groupBy("vector").agg(F.lit(True).alias("asks"))
    shared = members.join(asking, "vector", "left").select(
        "vector", "members", F.coalesce("asks", F.lit(False)).alias("asks"), F.get("members", F.lit(0)).alias("class_id")
    )
    classes = through_table(once.unionByName(shared).withColumn("length", _length("vector")), "forest-classes")
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    forest = Forest(classes, shape["n"], shape["d"] or 1, k, trees)
    looked_up = through_table(forest.first_depth(through_table(forest.asked(), "forest-asked")), "forest-first")
    near = through_table(forest.measured(looked_up), "forest-near")
    on = through_table(forest.further(looked_up, near), "forest-further")
    near = near.join(on.select("query"), "query", "left_anti").unionByName(forest.measured(on))
    asked = rows.filter(asks).select("vec_id", "vector").distinct()
    queries = asked.join(classes.filter("asks").select("vector", F.col("class_id").alias("query")), "vector").select(
        F.col("vec_id").alias("query_id"), "query"
    )
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        queries.join(near.select("query", "score", F.explode("members").alias("vec_id")), "query")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
