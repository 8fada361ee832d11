"""Least-cost repair of conversation structure by weighted CYK parsing over spans.

The repair grammar is in Chomsky normal form. Its symbols ``[p, q]`` derive what leads the role order
``(s?(ua)+)?`` from place ``p`` to ``q``; the rules are ``[p, q] -> [p, r] [r, q]``, and ``[p, q] -> row`` for a row
that is kept, given another role, or deleted. Insertions are closed into the symbols of a row, on both sides. A span of
rows has one cell for each symbol: the minimum of (cost, audit), where the audit is the string of the edits' initials.
Of equal cost no audit begins another one over the same rows (an extra insertion would cost), so the minimum of a
concatenation is the concatenation of minima. As the grammar has the binary rule for every ``r``, any split of a span
gives the same cell as all splits together; spans are therefore combined bottom-up with doubling length, first inside
blocks of ``SPAN`` rows, then ``FAN_IN`` neighbouring spans at a time, and no task holds a whole conversation.

Rows of a conversation follow their turn (nulls first), then role, then the SHA-256 of their text.

Defined cases: a null conversation id is a conversation; null roles and texts stand for one space; a role that does not
begin with s, u or a (an empty one too) cannot be kept; repeated rows are duplicates; an empty table gives an empty
result; other columns of the input are not read. A conversation's audit is one value of the result, and its digest is
taken by one task, which reads the rows in order and holds one batch of them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.workers import small_batches
from emberlake.storage import materialize, shuffle_width

SPAN = 256  # rows of a block
FAN_IN = 16  # spans that one row of the next level combines
SPACE = " \t\n\x0b\x0c\r"

# Places in the role order (0 before all, 1 after the system's row, 2 after the user, 3 after the assistant),
# steps between them, costs and initials of edits.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
INITIALS = "suao"
FAULTS = ("none", "blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
AT = {pair: i for i, pair in enumerate(PAIRS)}
#: Ways to cut ``[p, q]`` in two symbols.
RULES = tuple(tuple((AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT) for p, q in PAIRS)


def code(initial: Column, fault: Column) -> Column:
    """One letter for a row's initial (its place in ``INITIALS``) and fault (its place in ``FAULTS``)."""
    return F.char(initial * len(FAULTS) + fault + ord("a"))


def _joined(one: list, two: list) -> list:
    """Cells of two neighbouring spans to the cells of both."""
    out = []
    for ways in RULES:
        best = None
        for i, j in ways:
            a, b = one[i], two[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                    best = (cost, a[1] + b[1])
        out.append(best)
    return out


def _insertions() -> list:
    """Cells of no rows at all: chains of insertions."""
    none = [(0, "") if p == q else None for p, q in PAIRS]
    one = [min((INSERT, "I") for r in "ua" if STEPS.get((p, r)) == q) if any(STEPS.get((p, r)) == q for r in "ua") else None for p, q in PAIRS]
    cells = none
    while True:
        more = [min((c for c in x if c is not None), default=None) for x in zip(none, _joined(cells, one))]
        if more == cells:
            return cells
        cells = more


CLOSURE = _insertions()


@lru_cache(maxsize=len(INITIALS) * len(FAULTS))
def _row(letter: str) -> list:
    """Cells of a row, closed by insertions on both sides."""
    which, fault = divmod(ord(letter) - ord("a"), len(FAULTS))
    initial, fault = INITIALS[which], FAULTS[fault]
    extra = OPEN if fault == "truncated" else 0
    cells = []
    for p, q in PAIRS:
        ways = [(DELETE, "D")] if p == q else []
        if fault not in ("blank", "duplicate"):
            ways += [(KEEP + extra, "K")] if STEPS.get((p, initial)) == q else []
            ways += [(REROLE + extra, "R") for r in "ua" if STEPS.get((p, r)) == q]
        cells.append(min(ways, default=None))
    return _joined(_joined(CLOSURE, cells), CLOSURE)


def combine(spans: list[tuple]) -> tuple:
    """Neighbouring spans ``(first initial, last initial, illegal pairs, cells)`` to one, with doubling length."""
    while len(spans) > 1:
        longer = []
        for i in range(0, len(spans) - 1, 2):
            (a, b, n, x), (c, d, m, y) = spans[i : i + 2]
            longer.append((a, d, n + m + (b + c not in LEGAL), _joined(x, y)))
        spans = longer + spans[len(longer) * 2 :]
    return spans[0]


@lru_cache(maxsize=4096)
def parse(codes: str) -> tuple:
    """The span of some rows, given as letters."""
    initials = [INITIALS[(ord(c) - ord("a")) // len(FAULTS)] for c in codes]
    return combine([(i, i, 0, _row(c)) for i, c in zip(initials, codes)])


_CELLS = "first string, last string, illegal long, cost array<long>, audit array<string>"


def _written(spans: list[tuple]) -> dict:
    return {
        "first": [s[0] for s in spans],
        "last": [s[1] for s in spans],
        "illegal": [s[2] for s in spans],
        "cost": [[c and c[0] for c in s[3]] for s in spans],
        "audit": [[c and c[1] for c in s[3]] for s in spans],
    }


def _read(s: dict) -> tuple:
    return s["first"], s["last"], s["illegal"], [None if c is None else (c, a) for c, a in zip(s["cost"], s["audit"])]


def _by_key(df: DataFrame, column: str, kind: str, run) -> DataFrame:
    """``key, block`` and the cells that ``run`` makes of each value of ``column``."""
    import pyarrow as pa

    cells = pa.schema([("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])

    def mapped(batches):
        for b in batches:
            made = pa.table(_written([run(v) for v in b.column(2).to_pylist()]), schema=cells)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[c.combine_chunks() for c in made.columns]], ["key", "block", *made.column_names])

    return df.select("key", "block", column).mapInArrow(mapped, f"key {kind}, block long, {_CELLS}")


def damage(conversations: DataFrame) -> DataFrame:
    """The table ``conv_id, turn, role, text`` with planted faults: by a checksum of its place a row is dropped, emptied,
    loses its closing marks, is repeated, or is given to the user."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")), F.lit(20))
    text, role = spelled("text"), spelled("role")
    hurt = F.when(what == 1, F.lit("")).when(what == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.where(what != 0).select("conv_id", "turn", F.when(what == 4, F.lit("user")).otherwise(role).alias("role"), hurt.alias("text"), what.alias("what"))
    return rows.withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("what", "copy")


def place(conversations: DataFrame) -> DataFrame:
    """``key, at, turn, role, text`` and each row's ``code`` (initial and first fault), ``at`` counting a conversation's rows from 0.

    The order comes from range partitions and the counts of a conversation's rows in those before, so a conversation
    may span partitions. Written in the shared folder.
    """
    spark = conversations.sparkSession
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.struct("conv_id").alias("key"), "turn", or_space("role").alias("role"), or_space("text").alias("text"))
    closing = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({
        "digest": F.sha2("text", 256), "blank": closing == "", "open": ~F.right(closing, F.lit(1)).isin(*".!?"),
        "salt": F.monotonically_increasing_id(),  # equal rows are spread
    })
    order = ["turn", "role", "digest", "salt"]
    ranged = materialize(rows.repartitionByRange(shuffle_width(spark), "key", *order).withColumn("part", F.spark_partition_id()), "conversations")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("part", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", "key").orderBy(*order)
    placed = ranged.join(bases, ["part", "key"]).withColumn("at", F.row_number().over(own) - 1 + F.col("base"))
    return materialize(placed.select("key", "at", "turn", "role", "text", "digest", "blank", "open"), "placed")


def coded(placed: DataFrame) -> DataFrame:
    """``key, at, turn, fault, code`` of placed rows, without their texts."""
    first = placed.groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("key", "at", F.lit(True).alias("is_first"))
    narrow = placed.select("key", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "open").join(first, ["key", "at"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("is_first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    which = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return narrow.select("key", "at", "turn", fault.alias("fault"), code(which, fault).alias("code"))


def cheapest(rows: DataFrame) -> DataFrame:
    """``key, illegal, cost, audit`` of coded rows: cells of blocks, then of more and more blocks until one span is left."""
    kind = dict(rows.dtypes)["key"]
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    blocks = rows.groupBy("key", F.floor(F.col("at") / SPAN).alias("block")).agg(letters.alias("codes"))  # SPAN rows at most
    spans = materialize(_by_key(blocks, "codes", kind, parse), "spans")
    while spans.agg(F.max("block")).first()[0]:
        fields = ["block", "first", "last", "illegal", "cost", "audit"]
        near = F.sort_array(F.collect_list(F.struct(*fields)))
        level = spans.groupBy("key", F.floor(F.col("block") / FAN_IN).alias("above")).agg(near.alias("near"))  # FAN_IN rows at most
        spans = materialize(_by_key(level.withColumnRenamed("above", "block"), "near", kind, lambda x: combine([_read(s) for s in x])), "spans")
    best = F.least(*[F.struct(F.col("cost")[AT[0, q]].alias("cost"), F.col("audit")[AT[0, q]].alias("audit")) for q in ENDS])
    return spans.withColumn("best", best).select("key", "illegal", "best.cost", "best.audit")


def edits(audits: DataFrame) -> DataFrame:
    """Audits as rows: ``key, at`` (null if inserted), ``edit, place`` (null if deleted), ``new_role`` (null if kept).

    The order of roles follows from the number of rows that stay: an odd one begins with the system's.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            for key, audit in zip(b.column(0), b.column(1).to_pylist()):
                letters = np.frombuffer(audit.encode(), "S1")
                own, stays = letters != b"I", letters != b"D"
                at, to = np.cumsum(own) - 1, np.cumsum(stays) - 1
                turn = (to - stays.sum() % 2) % 2
                role = np.where(turn == 0, "user", "assistant")
                for i in range(0, len(letters), 65_536):
                    s = slice(i, i + 65_536)
                    columns = [
                        pa.array([key.as_py()] * len(letters[s]), key.type), pa.array(at[s], pa.int64(), mask=~own[s]), pa.array(letters[s].astype("U1")),
                        pa.array(to[s], pa.int64(), mask=~stays[s]), pa.array(role[s], pa.string(), mask=(letters[s] == b"K") | (letters[s] == b"D")),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "at", "edit", "place", "new_role"])

    return audits.select("key", "audit").mapInArrow(run, f"key {dict(audits.dtypes)['key']}, at long, edit string, place long, new_role string")


def repaired(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``key, place, edit, role, text``."""
    made = edits(audits).where("edit <> 'D'")
    kept = made.where("edit <> 'I'").join(placed.select("key", "at", "role", "text"), ["key", "at"])
    kept = kept.select("key", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return kept.unionByName(made.where("edit = 'I'").select("key", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def digests(rows: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: SHA-256 of a conversation's ``role:text`` lines, read in order, batch by batch."""
    import pyarrow as pa

    kind = dict(rows.dtypes)["key"]
    lines = rows.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "place")

    def run(batches):
        now, sha, key_type = None, None, None
        for b in batches:
            key_type = b.schema.field(0).type
            done, keys = [], b.column(0).to_pylist()
            for key, line in zip(keys, b.column(2).to_pylist()):
                if sha is None or key != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done])], ["key", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([sha.hexdigest()])], ["key", "sha"])

    return ordered.mapInArrow(run, f"key {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair a table ``conv_id, turn, role, text``.

    Returns one row for each conversation (``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``) and the
    repaired rows (``key, place, edit, role, text``).
    """
    small_batches(conversations.sparkSession)
    placed = place(conversations)
    rows = materialize(coded(placed), "coded")
    audits = materialize(cheapest(rows), "audits")
    n = lambda k: F.sum((F.col("fault") == k).cast("long"))
    turns = rows.groupBy("key", "turn").agg(*[n(k).alias(FAULTS[k]) for k in (1, 2, 3)])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in FAULTS[1:]])
    return counts.join(audits, "key").select("key.conv_id", "key", *["gaps", *FAULTS[1:], "illegal", "cost", "audit"]), repaired(placed, audits)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest repair and the digest of the repaired rows."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, rows = repair(damage(conversations))
    numbers = ["gaps", *FAULTS[1:], "illegal", "cost"]
    every = conversations.select("conv_id").distinct().select("conv_id", F.struct("conv_id").alias("key"))
    out = every.join(found.drop("conv_id"), "key", "left").join(digests(rows), "key", "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same by other means: damage by a checksum table, and the least cost by a walk from row to row."""
    steps = ", ".join(f"({p}, '{r}', {q})" for (p, r), q in STEPS.items())
    return f"""
    WITH RECURSIVE
    bits AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
    checks AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    spelled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot FROM conversations),
    hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(spot, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what FROM spelled, checks),
    hurt AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE what <> 0),
    placed AS (SELECT conv_id AS c, turn, role, text, left(role, 1) AS r, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS closing,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM hurt),
    rows AS (SELECT *, CASE WHEN closing = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(closing, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        (lag(r) OVER (PARTITION BY c ORDER BY i)) || r AS pair FROM placed),
    counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY c),
    step(p, r, q) AS (VALUES {steps}),
    more AS (SELECT p, q, 1 AS n FROM step WHERE r <> 's' UNION ALL SELECT a.p, b.q, 2 FROM step a JOIN step b ON a.q = b.p WHERE a.r <> 's' AND b.r <> 's'),
    filled AS (SELECT p, p AS q, 0 AS n FROM range(4) x(p) UNION ALL SELECT p, q, min(n) FROM more WHERE p <> q GROUP BY p, q),
    edit AS (SELECT p, p AS q, 'D' AS e, NULL AS r, {DELETE} AS cost FROM range(4) x(p) UNION ALL SELECT p, q, 'K', r, {KEEP} FROM step UNION ALL SELECT p, q, 'R', NULL, {REROLE} FROM step WHERE r <> 's'),
    walk AS (SELECT c, 0 AS i, q, 5 * f.n AS cost, repeat('I', f.n) AS audit FROM counts, filled f WHERE p = 0
      UNION ALL
      (SELECT c, i, q, (min(v)).cost AS cost, (min(v)).audit AS audit FROM (
        SELECT w.c, w.i + 1 AS i, f.q, {{'cost': w.cost + e.cost + CASE WHEN e.e <> 'D' AND s.fault = 3 THEN {OPEN} ELSE 0 END + 5 * f.n, 'audit': w.audit || e.e || repeat('I', f.n)}} AS v
        FROM walk w JOIN rows s ON s.c IS NOT DISTINCT FROM w.c AND s.i = w.i + 1 JOIN edit e ON e.p = w.q AND (e.e = 'D' OR s.fault NOT IN (1, 2)) AND (e.r IS NULL OR e.r = s.r)
        JOIN filled f ON f.p = e.q) GROUP BY c, i, q)),
    best AS (SELECT c, (min({{'cost': cost, 'audit': audit}})).cost AS cost, (min({{'cost': cost, 'audit': audit}})).audit AS audit FROM walk JOIN counts k USING (c) WHERE w_end(i, k.n, q) GROUP BY c),
    letters AS (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k, length(replace(audit, 'D', '')) % 2 AS odd FROM best),
    told AS (SELECT c, odd, audit[k] AS e, length(replace(audit[1:k], 'I', '')) AS i, length(replace(audit[1:k], 'D', '')) - 1 AS place FROM letters WHERE audit[k] <> 'D'),
    lines AS (SELECT t.c, place, CASE WHEN e = 'K' THEN s.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE s.text END AS line
      FROM told t LEFT JOIN rows s ON t.c IS NOT DISTINCT FROM s.c AND t.i = s.i AND e <> 'I'),
    texts AS (SELECT c, string_agg(line, chr(10) ORDER BY place) AS whole FROM lines GROUP BY c)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
      coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON o.conv_id IS NOT DISTINCT FROM k.c LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.c
      LEFT JOIN texts x ON o.conv_id IS NOT DISTINCT FROM x.c
    """.replace("w_end(i, k.n, q)", f"i = k.n AND q IN {ENDS}")


SQL = _sql()
