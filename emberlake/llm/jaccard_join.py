"""Exact N-gram Jaccard join with set-relation skipping.

Documents are sets of 64-bit hashes of word shingles, found with numpy for a batch of texts at once.
Equal sets are one set, so copies never enter the join. A set goes by a 64-bit name; a second one tells
unlike sets apart whose first names agree, and such sets go by the second one.
All sets put their members into one order, rare ones first (a fixed-size sketch counted over all
documents decides), and only the first members, the prefix, go to the index: two sets above the
threshold share one of those.

Skipping inside index lists: a list is sorted by set size and cut into blocks that carry their least
and greatest size and their least position; a pair of blocks whose best possible overlap, given size
and position, is too small is skipped as a whole.

Skipping by computed answers: each list has a pivot, the set that most lists hold, and every other set
of the list is compared with it once; the answer keeps what the set lacks of the pivot and what it adds.
Pairs of sets that are near the same pivot follow from these small differences exactly,
|x & y| = |P| - |lacks(x) | lacks(y)| + |adds(x) & adds(y)|, and only where their components are still
apart. All other pairs of a list go through its blocks; few are compared member by member.

Bounds of a task: index buckets hold about ``BUCKET`` entries, as many buckets as the corpus needs; a
member that more sets hold is spread over several. Sets around one pivot, and lists, are dealt in cells
of ``CELL`` sets; sets that already share the pivot's component are compared with the others only. A
set that very many pairs start from is sent to several tasks.

Defined cases: a null, empty or blank text has an empty set and links with nothing; fewer words than
a shingle make one shingle of the whole sequence; rows that repeat an id and text come back as often
as they came in; null ids are kept, and a component's id is its least id that is not null (null if it
has none; the least long counts as null); an empty table gives an empty result; other columns of the
input are not read. Positions above 65,535 count as 65,535, which only widens the candidates.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.columns import unused
from emberlake.llm.components import components
from emberlake.llm.workers import release, slices, small_batches, tidy
from emberlake.storage import bucketed, materialize, shuffle_width

SHINGLE = 5
NUM, DEN = 80, 100  # links: DEN * intersection >= NUM * union
SKETCH_BITS, SLICES = (16, 24), 16  # counters follow the corpus between these powers of two; 16 MB of ranks at most
PER_COUNTER = 16  # members of sets that share a counter, as long as the bound allows
FAN = 64  # sketches that one task adds up
FILTER_BITS = (20, 26)  # a map over candidate ids: 8 MB at most
CHUNK = 1 << 20  # bytes of text handled at once
BUCKET = 250_000  # expected index entries of a bucket, and entries of one member that stay together
BLOCK = 128  # entries of an index list's block
CELL = 2048  # sets around a pivot, or of a list, that one task pairs with as many others
TOGETHER = 50_000  # entries of lists that one call of Python looks at
PARTS = 4096  # pairs from one set that share a copy of its members
BLOB = 32_000_000  # bytes of members in one part of the table of sets
NO_ID = -(1 << 63)


@lru_cache(1)
def _tables():
    import numpy as np

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return lower, blank


def _sets_of(texts, width: int) -> list:
    import numpy as np
    import pyarrow.compute as pc

    from emberlake.llm.hashing import mix, span_hashes

    lower, blank = _tables()
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated, so that order counts
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = "large" in str(texts.type)
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    # a word begins after a blank or where a text begins, and ends likewise
    filled = ~blank[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[cuts] = True
    starts = filled.copy()
    starts[1:] &= ~filled[:-1] | border[1:-1]
    ends = filled.copy()
    ends[:-1] &= ~filled[1:] | border[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    word = span_hashes(lower[raw], starts, ends)
    grams = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k, f in enumerate(factors):
        grams += word[k : k + len(grams)] * f
    grams = mix(grams)
    out, first = [], 0
    for last in np.searchsorted(starts, cuts[1:]).tolist():
        n = last - first
        if n >= width:
            out.append(np.unique(grams[first : last - width + 1]))
        elif n:
            short = np.uint64(n)
            for k in range(n):
                short = short + word[first + k : first + k + 1] * factors[k]
            out.append(mix(short))
        else:
            out.append(grams[:0])
        first = last
    return out


def shingle_sets(texts, width: int = SHINGLE) -> list:
    """Sorted distinct shingle hashes (uint64) of each text of a list or an Arrow column."""
    import pyarrow as pa

    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    return [s for at, n in slices(texts, CHUNK) for s in _sets_of(texts.slice(at, n), width)]


def set_names(members, bits: int = 64) -> tuple[int, int]:
    """Two names for a set that do not depend on order, found apart from each other; equal sets have equal ones.

    The first one keeps ``bits`` bits (tests take few, so that it fails to tell sets apart).
    """
    import numpy as np

    from emberlake.llm.hashing import mix

    other = mix(members ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return first_name(members, bits), int(mix(np.array([other + np.uint64(len(members))]))[0].astype(np.int64))


def first_name(members, bits: int = 64) -> int:
    import numpy as np

    from emberlake.llm.hashing import mix

    total = mix(members + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(mix(np.array([total ^ np.uint64(len(members))]))[0].astype(np.int64)) >> (64 - bits)


def set_id(members, renamed: dict, bits: int = 64) -> int:
    """The name under which a set enters the join: its first one, unless an unlike set has that too."""
    if not renamed:
        return first_name(members, bits)
    first, second = set_names(members, bits)
    return renamed.get((first, second), first)


def _renamed(named: DataFrame) -> dict:
    """Other names for unlike sets that share a first name, by both of theirs.

    Among ``n`` distinct sets some n * n / 2 ** 65 pairs are to be expected, so next to none is collected.
    """
    shared = named.where("n > 0").groupBy("sid").agg(F.min("also").alias("least"), F.max("also").alias("most")).where("least <> most").select("sid")
    rows = named.join(shared, "sid").groupBy("sid", "also").agg(F.min("n").alias("n")).toArrow().to_pylist()
    if not rows:
        return {}
    by_name: dict[int, list[int]] = {}
    for r in rows:
        by_name.setdefault(r["sid"], []).append(r["also"])
    # the least second name keeps the first name; the others are known by their second one
    return {(sid, also): also for sid, all_ in by_name.items() for also in sorted(all_)[1:]}


def _packed(counts) -> bytes:
    """Counters, compressed: most are below 16, so low halves of bytes lie apart from the rest."""
    import numpy as np
    import pyarrow as pa

    low = (counts & 15).astype(np.uint8)
    return pa.Codec("zstd", 1).compress((low[0::2] | low[1::2] << 4).tobytes() + (counts >> 4).astype("<u4").tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int):
    import numpy as np
    import pyarrow as pa

    plain = pa.Codec("zstd").decompress(raw, n // 2 + 4 * n, asbytes=True)
    out = np.frombuffer(plain, "<u4", n, n // 2).astype(np.uint64) << np.uint64(4)
    low = np.frombuffer(plain, np.uint8, n // 2)
    out[0::2] += low & 15
    out[1::2] += low >> 4
    return out


def _survey(bits: int, name_bits: int):
    def run(batches):
        """Sizes and names of sets, and at the end the task's sketch of member counts."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("sid", pa.int64()), ("also", pa.int64()), ("slice", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())])
        sketch = np.zeros(1 << bits, np.uint16)
        shift = np.uint64(64 - bits)
        for batch in batches:
            for at, k in slices(batch.column(1), CHUNK):
                sets = _sets_of(batch.column(1).slice(at, k), SHINGLE)
                slot, more = np.unique((np.concatenate(sets) >> shift).astype(np.int64), return_counts=True)
                sketch[slot] = np.minimum(sketch[slot] + more, 65535)
                none = [None] * k
                names = [set_names(s, name_bits) for s in sets]
                yield pa.RecordBatch.from_pydict({"doc": batch.column(0).slice(at, k), "digest": batch.column(2).slice(at, k), "n": [len(s) for s in sets], "sid": [a for a, _ in names], "also": [b for _, b in names], "slice": none, "task": none, "counts": none}, schema=schema)
        none = [None] * SLICES
        packed = [_packed(x) for x in sketch.reshape(SLICES, -1)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"doc": none, "digest": none, "n": none, "sid": none, "also": none, "slice": list(range(SLICES)), "task": [task] * SLICES, "counts": packed}, schema=schema)

    return tidy(run)


def _add_up(bits: int, last: bool):
    def run(rows):
        """Counters of one slice together; in the last round as ranks: eighths of a doubling, one byte each."""
        import numpy as np
        import pandas as pd

        total = np.zeros((1 << bits) // SLICES, np.uint64)
        for c in rows["counts"]:
            total += _unpacked(c, len(total))
        made = np.minimum(np.floor(8 * np.log2(1.0 + total)), 255).astype(np.uint8).tobytes() if last else _packed(total)
        return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "task": [int(rows["task"].min()) // FAN], "counts": [made]})

    return run


def _commonness(sketches: DataFrame, tasks: int, bits: int) -> bytes:
    """Ranks of all counters; ``FAN`` sketches meet in a task, round by round, and 16 MB at most reach the driver."""
    level = sketches.select("slice", "task", "counts")
    while tasks > FAN:
        level = materialize(level.groupBy("slice", F.floor(F.col("task") / FAN).alias("_part")).applyInPandas(_add_up(bits, False), "slice int, task long, counts binary"), "sketch")
        tasks = -(-tasks // FAN)
    ranks = level.groupBy("slice").applyInPandas(_add_up(bits, True), "slice int, task long, counts binary")
    parts = {r["slice"]: bytes(r["counts"]) for r in ranks.collect()}
    return b"".join(parts.get(i, bytes((1 << bits) // SLICES)) for i in range(SLICES))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


#: An index entry: the member's hash within its bucket, the set and its size, the member's place in the set.
ENTRY = [("token", "<u4"), ("sid", "<i8"), ("size", "<u4"), ("place", "<u2")]
SPREAD = 1 << 31  # marks members that are spread over buckets


def _postings(commonness, bits: int, buckets: int, name):
    """Index entries of each task, packed by bucket."""

    def pack(held):
        import numpy as np
        import pyarrow as pa

        members, ranks, places = (np.concatenate(x) for x in held[:3])
        sizes = np.array(held[4], np.uint32)
        owner = np.repeat(np.arange(len(sizes)), [len(x) for x in held[0]])
        entries = np.empty(len(members), ENTRY)
        entries["sid"], entries["size"], entries["place"] = np.array(held[3], np.int64)[owner], sizes[owner], places
        bucket = (members % np.uint64(buckets)).astype(np.int64)
        entries["token"] = (members // np.uint64(buckets)).astype(np.uint32) & np.uint32(SPREAD - 1)
        hot = np.flatnonzero(ranks >= 8 * np.log2(1 + BUCKET))
        if len(hot):
            parts = np.ceil(2 ** (ranks[hot] / 8.0) / BUCKET).astype(np.int64)
            bucket[hot] = (bucket[hot] + entries["sid"][hot] % parts) % buckets
            entries["token"][hot] |= np.uint32(SPREAD)
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        raw = entries.tobytes()
        size = entries.itemsize
        return pa.RecordBatch.from_pydict({"bucket": bucket[cuts[:-1]], "entries": [raw[a * size : b * size] for a, b in zip(cuts[:-1], cuts[1:])]}, schema=pa.schema([("bucket", pa.int64()), ("entries", pa.binary())]))

    def run(batches):
        import numpy as np

        counts = np.frombuffer(commonness.value, np.uint8)
        shift = np.uint64(64 - bits)
        seen: set[int] = set()
        held, size = ([], [], [], [], []), 0
        for batch in batches:
            for at, k in slices(batch.column(1), CHUNK):
                for s in _sets_of(batch.column(1).slice(at, k), SHINGLE):
                    if not len(s) or (sid := name(s)) in seen:
                        continue
                    seen.add(sid)
                    p = prefix_size(len(s))
                    rank = counts[(s >> shift).astype(np.int64)]
                    first = np.argsort(rank, kind="stable")[:p]
                    held[0].append(s[first])
                    held[1].append(rank[first])
                    held[2].append(np.minimum(np.arange(p), 65535))
                    held[3].append(sid)
                    held[4].append(len(s))
                    size += p
                    if size >= 1_000_000:
                        yield pack(held)
                        held, size = ([], [], [], [], []), 0
        if size:
            yield pack(held)

    return tidy(run)


def _possible(nx, ny, px, py):
    """Whether sizes and first common positions leave room for a link (arrays broadcast)."""
    import numpy as np

    best = np.minimum(nx - px, ny - py)
    return (DEN * best >= NUM * (nx + ny - best)) & (DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny))


def _lists(rows):
    """The index lists of one bucket: lists of two as pairs, and the entries of longer ones.

    A member that is spread over buckets keeps one list name everywhere, and its lists may not merge.
    """
    import numpy as np
    import pandas as pd

    e = np.concatenate([np.frombuffer(raw, ENTRY) for raw in rows["entries"]])
    # one entry for each member and set: the same set may come from several tasks
    e = e[np.lexsort((e["sid"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["sid"][1:] != e["sid"][:-1])
    e = e[new]
    s, n, p = e["sid"], e["size"].astype(np.int64), e["place"].astype(np.int64)
    start = np.flatnonzero(np.diff(e["token"].astype(np.int64), prepend=-1))
    length = np.diff(np.append(start, len(e)))
    spread = e["token"][start] >= SPREAD
    two = start[(length == 2) & ~spread]
    ok = _possible(n[two], n[two + 1], p[two], p[two + 1])
    pairs = np.unique(np.stack([s[two], s[two + 1]], 1)[ok], axis=0)
    # equal lists become one, with the least positions
    many: dict[bytes, int] = {}
    b = int(rows["bucket"].iloc[0])
    parts = [(np.full(len(pairs), b), np.full(len(pairs), -1), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64))]
    for a, m in zip(start[(length > 2) & ~spread].tolist(), length[(length > 2) & ~spread].tolist()):
        key = s[a : a + m].tobytes()
        if key in many:
            at = many[key]
            np.minimum(p[at : at + m], p[a : a + m], out=p[at : at + m])
        else:
            many[key] = a
    for k, (key, a) in enumerate(many.items()):
        m = len(key) // 8
        parts.append((np.full(m, b), np.full(m, k), s[a : a + m], np.zeros(m, np.int64), n[a : a + m], p[a : a + m]))
    for a, m in zip(start[spread].tolist(), length[spread].tolist()):
        parts.append((np.full(m, -1), np.full(m, int(e["token"][a])), s[a : a + m], np.zeros(m, np.int64), n[a : a + m], p[a : a + m]))
    return pd.DataFrame(dict(zip(["bucket", "list", "sid", "other", "size", "place"], map(np.concatenate, zip(*parts)))))


_LISTS = "bucket long, list long, sid long, other long, size long, place long"


def block_pairs(root, size, place, known, settled):
    """Pairs of one index list that may link and lie in different components.

    ``known`` is each set's overlap with the list's pivot, or -1; pairs of two ``settled`` sets are left
    out. Entries are sorted by size and cut into blocks; pairs of blocks that cannot reach the threshold
    are skipped.
    """
    import numpy as np

    order = np.argsort(size, kind="stable")
    root, size, place, known, settled = root[order], size[order], place[order], known[order], settled[order]
    heads = range(0, len(size), BLOCK)
    least = np.array([size[h] for h in heads])
    most = np.array([size[h : h + BLOCK].max() for h in heads])
    early = np.array([place[h : h + BLOCK].min() for h in heads])
    for i, a in enumerate(heads):
        for j in range(i, len(least)):
            if DEN * most[i] < NUM * least[j]:
                break  # later blocks hold larger sets still
            best = min(most[i] - early[i], most[j] - early[j])
            if DEN * best < NUM * (least[i] + least[j] - best):
                continue
            x, y = slice(a, a + BLOCK), slice(j * BLOCK, j * BLOCK + BLOCK)
            ok = _possible(size[x, None], size[None, y], place[x, None], place[None, y]) & (root[x, None] != root[None, y])
            ok &= ~(settled[x, None] & settled[None, y])
            # the pivot's answers bound this pair's overlap from above
            kx, ky, nx, ny = known[x, None], known[None, y], size[x, None], size[None, y]
            most_common = np.minimum(kx + ny - ky, ky + nx - kx)
            ok &= (kx < 0) | (ky < 0) | (DEN * most_common >= NUM * (nx + ny - most_common))
            if i == j:
                ok &= np.arange(ok.shape[0])[:, None] < np.arange(ok.shape[1])[None, :]
            r, c = np.nonzero(ok)
            if len(r):
                yield order[a + r], order[j * BLOCK + c]


def derived_links(root, size, lacks, adds, width: int):
    """Links among sets near one pivot, from their differences to it; one for each two components it joins.

    ``lacks``: places of the pivot's members (of ``width``) that a set does not have; ``adds``: members
    beyond the pivot's. Yields positions of linked pairs; components that a link has joined stay joined.
    """
    import numpy as np

    label = root.copy()
    m = len(root)
    n_lost, n_more = np.array([len(x) for x in lacks]), np.array([len(x) for x in adds])
    place, holder = np.concatenate(lacks).astype(np.int64), np.repeat(np.arange(m), n_lost)
    code, adder = np.unique(np.concatenate(adds).astype(np.int64), return_inverse=True)[1], np.repeat(np.arange(m), n_more)
    upto = np.cumsum(n_more)
    lost, more = np.zeros(width, bool), np.zeros(len(code) + 1, bool)
    names, n = np.unique(label, return_counts=True)
    largest = names[np.argmax(n)]
    for i in np.flatnonzero(label != largest).tolist():
        apart = label != label[i]
        if not apart.any():
            continue
        own = code[upto[i] - n_more[i] : upto[i]]
        lost[lacks[i]] = more[own] = True
        both = np.bincount(holder[lost[place]], minlength=m)
        common = width - (n_lost + n_lost[i] - both) + np.bincount(adder[more[code]], minlength=m)
        lost[lacks[i]] = more[own] = False
        ok = apart & (DEN * common >= NUM * (size + size[i] - common))
        for j in np.flatnonzero(ok).tolist():
            if label[j] != label[i]:
                yield i, j
                a, b = (label[i], label[j]) if label[j] == largest else (label[j], label[i])
                label[label == a] = b


def _near_pivot(rows):
    """Links that the answers of one pivot give, as pairs of components."""
    import pandas as pd

    root = rows["root"].to_numpy()
    found = derived_links(root, rows["size"].to_numpy(), list(rows["lacks"]), list(rows["adds"]), int(rows["width"].iloc[0]))
    return pd.DataFrame([(int(root[i]), int(root[j])) for i, j in found], columns=["u", "v"], dtype="int64")


def _open_pairs(rows):
    """Pairs of sets of one list that its pivot's answers leave open; ``rows`` holds some lists, or cells of them."""
    import numpy as np
    import pandas as pd

    keys = [rows[c].to_numpy() for c in ("two", "one", "list", "bucket")]
    order = np.lexsort(keys)
    sid, root, size, place, known, near = (rows[c].to_numpy()[order] for c in ("sid", "root", "size", "place", "known", "near"))
    first = np.flatnonzero(np.any([np.diff(k[order], prepend=k[order][0] - 1) != 0 for k in keys], axis=0))
    out = [np.zeros((0, 2), np.int64)]
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sid)]):
        at, s = slice(a, b), sid[a:b]
        out += [np.stack([np.minimum(s[r], s[c]), np.maximum(s[r], s[c])], 1) for r, c in block_pairs(root[at], size[at], place[at], known[at], near[at])]
    return pd.DataFrame(np.concatenate(out), columns=["x", "y"])


def _in_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deal the sets of each group so that every two that can still link meet, in tasks of two cells at most.

    ``home`` tells sets of the pivot's component, which need not meet each other. A group without others
    goes; a small one stays whole (``one`` = ``two`` = 0).
    """
    others = F.sum((~F.col("home")).cast("long"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), others.alias("_others")).where("_others > 0")
    n = n.withColumn("_a", F.ceil((F.col("_n") - F.col("_others") + 1) / CELL)).withColumn("_b", F.ceil(F.col("_others") / CELL))
    met = rows.join(n, keys)
    deal = lambda parts: F.pmod(F.xxhash64("sid"), parts)
    cell = F.when(F.col("home"), deal(F.col("_a"))).otherwise(F.col("_a") + deal(F.col("_b")))
    met = met.withColumn("_cell", cell).withColumn("_whole", F.col("_n") <= 2 * CELL)
    # pairs of cells of which one at least holds others
    ends = F.sequence(F.lit(0).cast("long"), F.col("_a") + F.col("_b") - 1)
    allowed = F.filter(ends, lambda c: (c != F.col("_cell")) & ((c >= F.col("_a")) | (F.col("_cell") >= F.col("_a"))))
    pairs = F.transform(allowed, lambda c: F.struct(F.least(c, F.col("_cell")).alias("one"), F.greatest(c, F.col("_cell")).alias("two")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two")))
    met = met.withColumn("_pair", F.explode(F.when(F.col("_whole"), alone).otherwise(pairs)))
    return met.select(*rows.columns, "_pair.one", "_pair.two")


def _overlaps(differences: bool):
    def run(batches):
        """Exact overlaps; where asked and y is near x, also the places of x's members that it lacks, and what it adds."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            nx, ny, common, lacks, adds = [], [], [], [], []
            for a, b in zip(batch.column("bx"), batch.column("by")):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                has = b[at] == a
                n = int(has.sum())
                nx.append(len(a))
                ny.append(len(b))
                common.append(n)
                near = differences and 2 * n > max(len(a), len(b))
                lacks.append(np.flatnonzero(~has).astype(np.int32) if near else None)
                adds.append(np.delete(b, at[has]).view(np.int64) if near else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y"), pa.array(nx, pa.int64()), pa.array(ny, pa.int64()), pa.array(common, pa.int64()), pa.array(lacks, pa.list_(pa.int32())), pa.array(adds, pa.list_(pa.int64()))],
                ["x", "y", "nx", "ny", "common", "lacks", "adds"],
            )

    return tidy(run)


def _compare(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """Exact overlaps of written pairs of set ids, members compared in tasks.

    ``sets`` lies in buckets by id, so only pairs, with the members of their first set, are shuffled. A set
    with more than ``PARTS`` pairs is copied for each ``PARTS`` of them, so that no task sends them all.
    """
    fan = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PARTS).alias("parts")).where("parts > 1")
    fan = materialize(fan, "fan")
    first = sets.select(F.col("sid").alias("x"), F.col("members").alias("bx"))
    if fan.isEmpty():
        one = pairs.join(first, "x")
    else:
        told = pairs.join(fan, "x", "left")
        copies = first.join(fan, "x").select("x", "bx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        many = told.where("parts IS NOT NULL").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part")).join(copies.hint("shuffle_hash"), ["x", "part"])
        one = told.where("parts IS NULL").select("x", "y").join(first, "x").unionByName(many.select("x", "y", "bx"))
    both = one.join(sets.select(F.col("sid").alias("y"), F.col("members").alias("by")), "y").select("x", "y", "bx", "by")
    return materialize(both.mapInArrow(_overlaps(differences), "x long, y long, nx long, ny long, common long, lacks array<int>, adds array<long>"), "overlaps")


def _linked(overlaps: DataFrame) -> DataFrame:
    rows = overlaps.where(DEN * F.col("common") >= NUM * (F.col("nx") + F.col("ny") - F.col("common")))
    return rows.select(F.col("x").alias("u"), F.col("y").alias("v"))


def _id(doc: str) -> Column:
    return F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID))


def _digest(text: str) -> Column:
    """Tells texts of one id apart; null differs from empty."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _members(wanted, bits: int, name):
    """Sets of documents whose ids are on the map, with their members; a task tells each set once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("sid", pa.int64()), ("members", pa.binary())])
        filled = np.frombuffer(wanted.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            slot = batch.column(0).to_numpy() % (1 << bits)
            kept = batch.column(1).filter(pa.array((filled[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for at, k in slices(kept, CHUNK):
                new = {sid: s for s in _sets_of(kept.slice(at, k), SHINGLE) if len(s) and (sid := name(s)) not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_pydict({"sid": list(new), "members": [s.tobytes() for s in new.values()]}, schema=schema)

    return tidy(run)


def _id_map(spark, carriers: DataFrame, rows: int):
    """A broadcast map of bits over the carriers' ids, and its size as a power of two."""
    import numpy as np

    least, most = FILTER_BITS
    bits = min(most, max(least, (8 * rows).bit_length()))
    bit = F.pmod("doc", F.lit(1 << bits))
    words = carriers.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(doc, {1 << bits}) & 63))")).alias("bits"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():  # at most 2 ** 20 words of a fixed-size map
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return spark.sparkContext.broadcast(bitmap.view(np.uint8).tobytes()), bits


def linked_sets(source: DataFrame, name_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of rows ``doc, text, digest``: each row's ``doc, digest, n, sid``, and ``node, root`` of linked set ids."""
    spark = source.sparkSession
    small_batches(spark)
    size = source.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    least, most = SKETCH_BITS
    bits = min(most, max(least, (size // (5 * PER_COUNTER)).bit_length()))
    survey = materialize(source.select("doc", "text", "digest").mapInArrow(_survey(bits, name_bits), "doc long, digest string, n long, sid long, also long, slice int, task long, counts binary"), "survey")
    named = survey.where("slice IS NULL").select("doc", "digest", "n", "sid", "also")
    renamed = _renamed(named)
    name_of = lambda s: set_id(s, renamed, name_bits)
    name = F.col("sid")
    for (first, second), other in renamed.items():
        name = F.when((F.col("sid") == first) & (F.col("also") == second), F.lit(other)).otherwise(name)
    named = named.select("doc", "digest", "n", name.alias("sid"))
    prefix = F.col("n") - F.ceil(NUM * F.col("n") / DEN) + 1
    tasks, entries, rows = survey.agg(F.max("task"), F.sum(prefix), F.count("n")).first()
    commonness = spark.sparkContext.broadcast(_commonness(survey.where("slice IS NOT NULL"), (tasks or 0) + 1, bits))

    width = shuffle_width(spark)
    buckets = max(width, -(-(entries or 0) // BUCKET))
    packed = source.select("doc", "text").mapInArrow(_postings(commonness, bits, buckets, name_of), "bucket long, entries binary")
    lists = materialize(packed.groupBy("bucket").applyInPandas(_lists, _LISTS), "lists")
    pairs = materialize(lists.where("list = -1").select(F.least("sid", "other").alias("x"), F.greatest("sid", "other").alias("y")).distinct(), "pairs")
    longer = lists.where("list >= 0").select("bucket", "list", "sid", "size", "place")
    # the pivot of a list is the set that most lists hold
    held = longer.groupBy("sid").agg(F.count(F.lit(1)).alias("held"))
    pivots = longer.join(held, "sid").groupBy("bucket", "list").agg(F.max_by("sid", F.struct("held", "sid")).alias("pivot"), F.max_by("size", F.struct("held", "sid")).alias("width"))
    longer = materialize(longer.join(pivots, ["bucket", "list"]), "entries")

    # members of candidate sets, from one carrier each
    candidates = pairs.select(F.explode(F.array("x", "y")).alias("sid")).unionByName(longer.select("sid")).distinct()
    carriers = materialize(named.groupBy("sid").agg(F.min("doc").alias("doc"), F.min("n").alias("n")).join(candidates, "sid"), "carriers")
    blobs = carriers.agg(F.sum("n")).first()[0] or 0
    wanted, id_bits = _id_map(spark, carriers, rows)
    found = source.select("doc", "text").mapInArrow(_members(wanted, id_bits, name_of), "sid long, members binary")
    parts = max(width, -(-8 * blobs // BLOB))
    found = found.repartition(parts, "sid").join(carriers.select("sid").hint("shuffle_hash"), "sid", "left_semi")
    sets, forget = bucketed(found.dropDuplicates(["sid"]), "sets", "sid", parts)

    star = longer.where("sid <> pivot").where(DEN * F.least("size", "width") >= NUM * F.greatest("size", "width"))
    stars = materialize(star.select(F.col("pivot").alias("x"), F.col("sid").alias("y")).distinct(), "stars")
    answers = _compare(stars, sets, True)
    either = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    others = _compare(materialize(pairs.join(either, ["x", "y"], "left_anti"), "others"), sets)
    roots = materialize(components(_linked(answers).unionByName(_linked(others))), "roots")

    # links that a pivot's answers give for all sets near it, whatever lists they share
    rooted = lambda df, sid, name: df.join(roots.select(F.col("node").alias(sid), F.col("root").alias(f"_{name}")), sid, "left").withColumn(name, F.coalesce(f"_{name}", sid)).drop(f"_{name}")
    near = answers.where("lacks IS NOT NULL").select(F.col("x").alias("pivot"), F.col("nx").alias("width"), F.col("y").alias("sid"), F.col("ny").alias("size"), "lacks", "adds")
    centre = near.select("pivot", "width").distinct().select("pivot", "width", F.col("pivot").alias("sid"), F.col("width").alias("size"), F.array().cast("array<int>").alias("lacks"), F.array().cast("array<long>").alias("adds"))
    near = rooted(rooted(near.unionByName(centre), "sid", "root"), "pivot", "centre").withColumn("home", F.col("root") == F.col("centre"))
    sure = _in_cells(materialize(near, "near"), ["pivot"]).groupBy("pivot", "one", "two").applyInPandas(_near_pivot, "u long, v long")
    sure = materialize(sure.distinct(), "sure")

    # pairs of a list that its pivot's answers leave open
    known = answers.select(F.col("x").alias("pivot"), F.col("y").alias("sid"), F.col("common").alias("known"), F.col("lacks").isNotNull().alias("near"))
    told = rooted(rooted(longer, "sid", "root"), "pivot", "centre").join(known, ["pivot", "sid"], "left")
    own = F.col("pivot") == F.col("sid")
    told = told.select(
        "bucket", "list", "sid", "root", "size", "place", (F.col("root") == F.col("centre")).alias("home"),
        F.when(own, F.col("size")).otherwise(F.coalesce("known", F.lit(-1))).alias("known"), (own | F.coalesce("near", F.lit(False))).alias("near"),
    )
    whole = materialize(_in_cells(materialize(told, "told"), ["bucket", "list"]), "cells")
    # many short lists share a group of rows, so that Python is not called for each
    some = F.pmod(F.xxhash64("bucket", "list", "one", "two"), F.lit(max(width, whole.count() // TOGETHER)))
    pairs_left = whole.groupBy(some.alias("_some")).applyInPandas(_open_pairs, "x long, y long").distinct()
    pairs_left = materialize(pairs_left.join(either, ["x", "y"], "left_anti"), "open")
    more = _linked(_compare(pairs_left, sets)).unionByName(sure)
    tree = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
    final = components(tree.unionByName(more))
    forget()
    commonness.unpersist()
    wanted.unpersist()
    release()
    return named, final


def jaccard_components(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", name_bits: int = 64) -> DataFrame:
    """``doc, n_shingles, component`` for each row; linked documents share the smallest id of theirs."""
    named, final = linked_sets(docs.select(_id(doc).alias("doc"), F.col(text).alias("text"), F.lit(None).cast("string").alias("digest")), name_bits)
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    of_set = named.where("n > 0").groupBy("sid").agg(F.min(own).alias("doc")).join(final.withColumnRenamed("node", "sid"), "sid", "left").select(F.coalesce("root", "sid").alias("root"), "sid", "doc")
    least = of_set.groupBy("root").agg(F.min("doc").alias("component"))
    by_sid = of_set.select("sid", "root").join(least, "root").select("sid", "component")
    out = named.join(by_sid, "sid", "left")
    return out.select(own.alias("doc"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(own).alias("component"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 80 % Jaccard over five-word shingles."""
    rows = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: its smallest id, then the smallest SHA-256 of a text.

    A row is named by id and text, so texts that share an id, or have none, are decided each on its own;
    rows that repeat an id and text are copies, of which the least by the other columns stays. All columns stay; empty texts stay.
    """
    named, final = linked_sets(docs.select(_id("doc_id").alias("doc"), "text", _digest("text").alias("digest")))
    name = F.struct("doc", "digest")
    of_set = named.where("n > 0").groupBy("sid").agg(F.min(name).alias("name"))
    rooted = of_set.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    keep = rooted.groupBy("root").agg(F.min("name").alias("name")).select("name").unionByName(named.where("n = 0").select(name.alias("name")).distinct())
    key, text, own, digest = unused(docs, "_key", "_text", "_doc", "_digest")
    keep = keep.select(F.col("name.doc").alias(own), F.col("name.digest").alias(digest))
    joined = docs.withColumns({key: _id("doc_id"), text: _digest("text")}).join(keep.hint("shuffle_hash"), (F.col(key) == F.col(own)) & (F.col(text) == F.col(digest)), "left_semi")
    # rows of one id and text may differ elsewhere: the least row stays (maps have no order and are passed over)
    order = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    row = F.min_by("row", F.struct(*[F.col("row")[c] for c in order])) if order else F.first("row")
    once = joined.select(key, text, F.struct(*docs.columns).alias("row")).groupBy(key, text).agg(row.alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
