"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens; full pieces are sequences already. Best-fit
decreasing over all others, which needs no more than the number of pieces of each length, gives every
piece a first bin. Whole bins are dealt by hash into blocks of bounded expected size, and they are the
first packing of their block, so breeding can only save bins. For each block several islands breed packings
apart from each other: crossover injects whole well-filled bins of one parent into the other, removes
the bins that now hold duplicates, and best-fits the displaced pieces; mutation dissolves the emptiest
bins. Between epochs each island sends its best packing to its neighbour. Bins left with room by
the best packing of each block give their pieces to another round, whose fewer blocks mix what earlier
blocks kept apart; rounds end with one block, or when a round leaves about as many such pieces.

Defined cases: a null text is empty and is one piece, its end id; a null id is kept; repeated rows
are packed as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm import bpe
from emberlake.llm.ordering import with_order
from emberlake.llm.workers import slices, small_batches, tidy
from emberlake.storage import materialize, shuffle_width

CAPACITY = 2048
CHUNK = 1 << 20  # bytes of text encoded at once
BLOCK = 4096  # expected pieces in a block
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 4
SHRINKS = 0.8  # a further round is worth it if no larger part of the pieces goes on


def pieces(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str, joins_space: bool = False, end: int = 0, specials: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32``; only documents over the capacity are cut."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = bpe.encoder(tokenizer, joins_space, end, specials)
        uid = TaskContext.get().partitionId() << 34
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, n in slices(texts, CHUNK):
                flat, counts = enc.encode([t or "" for t in texts.slice(at, n).to_pylist()])
                flat = flat.astype("<u4")
                ends = np.cumsum(counts)
                rows = []
                for d, a, b in zip(ids[at : at + n], (ends - counts).tolist(), ends.tolist()):
                    for k, s in enumerate(range(a, b, capacity)):
                        part = flat[s : min(b, s + capacity)]
                        rows.append((uid, d, k, s - a, len(part), zlib.crc32(part.tobytes())))
                        uid += 1
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(tidy(cut, True), schema)


def _best_fit(order, lens, assign, fill, capacity: int) -> int:
    """Put ``order``'s items, in that order, into the fullest bins that hold them; returns the number of bins.

    ``fill`` maps a bin to its content; room is looked up in one integer, whose bits are the rooms at hand.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for b, f in enumerate(fill):
        if f < capacity:
            rooms[capacity - f].append(b)
            bits |= 1 << (capacity - f)
    for i in order:
        size = lens[i]
        fit = bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        assign[i] = b
        fill[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            bits |= 1 << left
    return len(fill)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Best-fit decreasing from counts: runs ``(first, bin, each)`` over pieces from long to short.

    Pieces of a run from place ``first`` on go to bins from ``bin`` on, ``each`` to a bin. Pieces of one length are alike, and
    so are bins with one room, which are kept as ranges of bins. A piece that fits leaves its bin the fullest, so a bin takes
    as many of a length as it holds. Runs are bounded by lengths and rooms, whatever the number of pieces.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of bins
    runs, place, bins = [], 0, 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                each = capacity // size
                begin, count = bins, max(1, left // each)
                bins += count
                room = capacity
            else:
                begin, count = rooms[room].pop()
                each = room // size
                if count > max(1, left // each):
                    kept = max(1, left // each)
                    rooms[room].append((begin + kept, count - kept))
                    count = kept
                if not rooms[room]:
                    del rooms[room]
            each = min(each, left)  # the last bin may take fewer
            runs.append((place, begin, each))
            place += each * count
            left -= each * count
            if room > each * size:
                rooms.setdefault(room - each * size, []).append((begin, count))
    return runs


def first_bins(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``uid, length`` with ``bin``, by best-fit decreasing over all of them."""
    import numpy as np

    runs = plan({r["length"]: r["count"] for r in items.groupBy("length").count().collect()}, capacity)  # at most one row a length
    first, begin, each = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    ordered = with_order(items.select("uid", "length", (-F.col("length")).alias("shorter")), ["shorter", "uid"])

    def look_up(batches):
        import pyarrow as pa

        for b in batches:
            pos = b.column(2).to_numpy()
            run = np.searchsorted(first, pos, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(begin[run] + (pos - first[run]) // each[run])], ["uid", "length", "bin"])

    return ordered.select("uid", "length", "_pos").mapInArrow(look_up, "uid long, length long, bin long")


def _fitness(fill, capacity: int) -> float:
    """Fewer bins score higher, then a higher mean of squared fills."""
    return sum((f / capacity) ** 2 for f in fill) / max(1, len(fill)) - len(fill)


def _rebuild(assign, keep, lens, capacity: int, order):
    """Keep the bins in ``keep``, renumbered, and best-fit every other item in ``order``."""
    import numpy as np

    new = np.full(len(keep) + 1, -1)  # the last answers for items without a bin, -1
    new[:-1][keep] = np.arange(int(keep.sum()))
    out = new[assign]
    placed = out >= 0
    fill = np.bincount(out[placed], weights=lens[placed], minlength=int(keep.sum())).astype(int).tolist()
    out = out.tolist()
    _best_fit([i for i in order if out[i] < 0], lens.tolist(), out, fill, capacity)
    return np.array(out, np.int32), _fitness(fill, capacity)


def breed(lens, population, fitness, generations: int, seed: int, capacity: int = CAPACITY):
    """Evolve packings of one block; ``population`` has at least the one it began with. Returns the new population and its fitness."""
    import numpy as np

    rng = np.random.default_rng(seed)
    down = np.argsort(-lens, kind="stable")
    none = np.full(len(lens), -1, np.int32)
    while len(population) < POPULATION:
        # after the one it began with comes best-fit decreasing; others start from a disturbed order
        noise = 1 if len(population) <= 1 else np.exp(rng.normal(0, 0.15, len(lens)))
        order = np.argsort(-(lens * noise), kind="stable").tolist()
        p, f = _rebuild(none, np.zeros(0, bool), lens, capacity, order)
        population.append(p)
        fitness.append(f)
    down = down.tolist()
    for _ in range(generations):
        a, b = rng.permutation(len(population))[:2]
        one, other = population[a], population[b]
        fill = np.bincount(other, weights=lens)
        full = np.flatnonzero(fill >= capacity - 1)
        if not len(full):
            full = np.argsort(-fill)[: max(1, len(fill) // 10)]
        inject = rng.choice(full, max(1, len(full) // 3), replace=False)
        chosen = np.isin(other, inject)
        keep = np.ones(int(one.max()) + 1, bool)
        keep[one[chosen]] = False  # bins with duplicates of injected pieces go
        ones = np.bincount(one, weights=lens)
        keep[np.argsort(ones)[: max(1, len(ones) // 100)]] = False  # mutation: the emptiest dissolve
        # injected bins stay whole: they come after the kept ones
        base = np.where(chosen, -1, one)
        lifted = np.where(chosen, len(keep) + np.searchsorted(np.sort(inject), other), base)
        child, f = _rebuild(lifted, np.concatenate([keep, np.ones(len(inject), bool)]), lens, capacity, down)
        worst = int(np.argmin(fitness))
        if f >= fitness[worst]:
            population[worst], fitness[worst] = child, f
    return population, fitness


_STATE = "block long, island int, uids array<long>, lens array<int>, population array<array<int>>, fitness array<double>"


def _epoch(state: DataFrame, epoch: int, capacity: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                lens = np.asarray(r.lens, np.int64)
                population = [np.asarray(p, np.int32) for p in r.population]
                fit = list(r.fitness)
                if not population:
                    population = [np.unique(r.first, return_inverse=True)[1].astype(np.int32)]
                    fit = [_fitness(np.bincount(population[0], weights=lens), capacity)]
                if r.elite is not None and len(r.elite):
                    worst = int(np.argmin(fit))
                    population[worst], fit[worst] = np.asarray(r.elite, np.int32), float(r.elite_fitness)
                population, fit = breed(lens, population, fit, GENERATIONS, hash((int(r.block), int(r.island), epoch)) & 0x7FFFFFFF, capacity)
                yield pd.DataFrame([[r.block, r.island, r.uids, r.lens, [p.tolist() for p in population], fit]], columns=["block", "island", "uids", "lens", "population", "fitness"])

    return state.mapInPandas(run, _STATE)


def islands(items: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK, level: int = 1) -> DataFrame:
    """Pack ``uid, length, bin`` rows of at most the capacity in no more bins: ``uid, block, bin, fill``. ``level`` deals bins anew."""
    spark = items.sparkSession
    n = max(1, -(-items.count() // block))
    grouped = items.groupBy(F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(n)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length"), "bin"))).alias("items")
    )
    state = grouped.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("items.uid").alias("uids"), F.col("items.length").alias("lens"),
        F.col("items.bin").alias("first"), F.array().cast("array<array<int>>").alias("population"), F.array().cast("array<double>").alias("fitness"),
        F.lit(None).cast("array<int>").alias("elite"), F.lit(None).cast("double").alias("elite_fitness"),
    )
    best = F.array_position("fitness", F.array_max("fitness")).cast("int")
    for epoch in range(EPOCHS):
        state = materialize(_epoch(state.repartition(shuffle_width(spark), "block", "island"), epoch, capacity), "islands")
        # migration: the best packing of each island goes to the next one
        elite = state.select(
            F.col("block").alias("_block"), ((F.col("island") + 1) % ISLANDS).alias("_island"),
            F.element_at("population", best).alias("elite"), F.array_max("fitness").alias("elite_fitness"),
        )
        home = state
        state = state.join(elite, (F.col("block") == F.col("_block")) & (F.col("island") == F.col("_island"))).drop("_block", "_island")
    chosen = home.groupBy("block").agg(F.max_by(F.struct("uids", "lens", F.element_at("population", best).alias("bins")), F.struct(F.array_max("fitness"), -F.col("island"))).alias("s"))
    placed = chosen.select("block", F.explode(F.arrays_zip("s.uids", "s.lens", "s.bins")).alias("x"))
    placed = placed.select(F.col("x.uids").alias("uid"), "block", F.col("x.bins").cast("long").alias("bin"), F.col("x.lens").alias("length"))
    return placed.withColumn("fill", F.sum("length").over(Window.partitionBy("block", "bin")))


def pack(cut: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces."""
    rest, where, level = first_bins(cut.where(F.col("length") < capacity).select("uid", "length"), capacity), None, 0
    rest = materialize(rest, "first")
    left = rest.count()
    while left:
        level += 1
        made = materialize(islands(rest, capacity=capacity, block=block, level=level), "packed")
        roomy = F.col("fill") < capacity
        again = made.where(roomy).count()
        # one block, or a round that would leave as much again, is the last
        last = left <= block or again > SHRINKS * left
        number = (F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")).cast("long").alias("sequence_id")
        done = (made if last else made.where(~roomy)).select("uid", number)
        where = done if where is None else where.unionByName(done)
        rest, left = (rest, 0) if last else (made.where(roomy).select("uid", "length", number.alias("bin")), again)
    placed = cut.withColumn("sequence_id", F.col("uid")) if where is None else cut.join(where, "uid", "left").withColumn("sequence_id", F.coalesce("sequence_id", "uid"))
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def op9_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    cut = materialize(pieces(docs, tokenizer=tokenizer or bpe.tokenizer_path("word_bpe_49k.json")), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
