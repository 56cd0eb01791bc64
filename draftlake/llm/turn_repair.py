"""Repair of conversation structure by block tables over normalised cost vectors (the Four Russians' method).

A conversation's rows are kept, given another role, deleted, or have rows inserted between them, at least cost, so that the
initials of its roles become ``(s?(ua)+)?``. The cost of repairing what follows, seen from each of the automaton's four
states, is a vector; less its first entry it is one of a few dozen. ``Tables`` finds them all, and for every block of
``BLOCK`` symbols and every vector at the block's right end notes the vector at its left end, the cost between
both, and the state that the block leaves for each state it is entered in. A chunk of rows is then a fold over
look-ups, from the right for costs, from the left for states; only blocks on the way are expanded, backward
for the vectors inside and then forward, taking the ASCII-least edit wherever several are cheapest.

A conversation may be of any length. Rows get a place in one order of the whole table (range partitioning, and a
running number), chunks of at most ``CHUNK`` places are folded by themselves for all vectors at once, a conversation's
chunk summaries meet to fix each chunk's right vector and left state, and the chunks are traced apart. Equal rows of a
turn are one with a number of copies.

Edits: K keep (0), R give the role user or assistant (2), D delete (3), I insert an empty user or assistant row (2); a
truncated row that isn't deleted adds 1; blank rows and duplicates must go.

Cases: nulls in turn, role or text count as one space (a null turn comes first); a null conv_id is a conversation of its
own; rows of the same turn are ordered by role and text; roles go by their first character, and an empty one
can't stay; an empty table gives an
empty result; other columns are not carried (a row of the result may be inserted).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import SPACES, materialise

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols of rows: x must go; s, u, a and o (another initial) may stay, in capitals if truncated.
SYMBOLS = "xsuaoSUAO"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by state; the only role that may be inserted or given there.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
BLOCK, CHUNK_BITS = 3, 12
CHUNK = 1 << CHUNK_BITS
LEGAL = ("su", "ua", "au")


def inserted(costs: list[int]) -> list[int]:
    """The costs when rows may also be inserted first."""
    costs, queue = list(costs), [(c, s) for s, c in enumerate(costs)]
    heapq.heapify(queue)
    while queue:
        cost, state = heapq.heappop(queue)
        for before in NEXT:
            if STEPS[before, NEXT[before]] == state and cost == costs[state] and cost + INSERT < costs[before]:
                costs[before] = cost + INSERT
                heapq.heappush(queue, (costs[before], before))
    return costs


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) of a row in a state, in the order of ASCII."""
    found = [("D", DELETE, state)]
    if symbol != "x":
        worse = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in STEPS:
            found.append(("K", KEEP + worse, STEPS[state, symbol.lower()]))
        found.append(("R", REROLE + worse, STEPS[state, NEXT[state]]))
    return found


def before(symbol: str, costs: tuple[int, ...]) -> list[int]:
    """The costs before a row, from those after it."""
    return inserted([min(cost + costs[after] for _, cost, after in moves(symbol, state)) for state in range(4)])


#: What is left to pay at the end.
LAST = tuple(inserted([0, 1 << 20, 1 << 20, 0]))


def traced(symbol: str, state: int, costs: list[int], after: tuple[int, ...]) -> tuple[str, str, int]:
    """The edits of one row from a state: (edits, roles that are new, state after it). costs are those before the row."""
    edits, roles = "", ""
    while True:
        step = next(((e, s) for e, c, s in moves(symbol, state) if e == "D" and c + after[s] == costs[state]), None)
        if step is None and INSERT + costs[STEPS[state, NEXT[state]]] == costs[state]:
            edits, roles, state = edits + "I", roles + NEXT[state], STEPS[state, NEXT[state]]
            continue
        step = step or next((e, s) for e, c, s in moves(symbol, state) if c + after[s] == costs[state])
        return edits + step[0], roles + (NEXT[state] if step[0] == "R" else ""), step[1]


@dataclass
class Tables:
    """vectors (normalised costs), and by block and vector: the vector before, the cost between, the state after by state."""

    vectors: list[tuple[int, ...]]
    before: np.ndarray  # block x vector
    cost: np.ndarray
    leaves: np.ndarray  # block x vector x state

    @classmethod
    @functools.cache
    def made(cls, block: int = BLOCK) -> Tables:
        number, steps, queue = {LAST: 0}, {}, [LAST]
        while queue:
            vector = queue.pop()
            for i, symbol in enumerate(SYMBOLS):
                costs = before(symbol, vector)
                reached = tuple(c - costs[0] for c in costs)
                if reached not in number:
                    number[reached] = len(number)
                    queue.append(reached)
                steps[i, number[vector]] = number[reached], costs[0] - vector[0], [traced(symbol, s, costs, vector)[2] for s in range(4)]
        vectors = list(number)
        one = [np.array([[steps[i, v][k] for v in range(len(vectors))] for i in range(len(SYMBOLS))], np.int64) for k in range(3)]
        tables = cls(vectors, *one)
        for _ in range(block - 1):
            tables = tables.joined(one)
        return tables

    def joined(self, one: list[np.ndarray]) -> Tables:
        """Blocks one symbol longer: the symbol first, then the block."""
        many = len(SYMBOLS) * len(self.before)
        after = self.before[None, :, :]
        symbol = np.arange(len(SYMBOLS))[:, None, None]
        entered = one[2][symbol, after]  # the state in which the block is entered, by symbol, block, vector and first state
        leaves = self.leaves[np.arange(len(self.before))[None, :, None, None], np.arange(len(self.vectors))[None, None, :, None], entered]
        flat = lambda x: x.reshape(many, *x.shape[2:])
        return Tables(self.vectors, flat(one[0][symbol, after]), flat(one[1][symbol, after] + self.cost[None]), flat(leaves))


@functools.lru_cache(1 << 16)
def expanded(block: str, right: int, state: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """The edits of each row of a block, and the state after it: vectors from the right, edits from the left."""
    costs = [list(Tables.made().vectors[right])]
    for symbol in reversed(block):
        costs.append(before(symbol, tuple(costs[-1])))
    costs.reverse()
    rows = []
    for i, symbol in enumerate(block):
        edits, roles, state = traced(symbol, state, costs[i], tuple(costs[i + 1]))
        rows.append((edits, roles))
    return tuple(rows), state


_CODE = {s: i for i, s in enumerate(SYMBOLS)}


def blocks_of(symbols: str) -> tuple[list[str], np.ndarray]:
    """Blocks of BLOCK symbols and their numbers. What is missing at the left is filled with rows that must go: they change neither vector
    nor state and cost the same from all of them."""
    padded = "x" * (-len(symbols) % BLOCK) + symbols
    blocks = [padded[i : i + BLOCK] for i in range(0, len(padded), BLOCK)]
    return blocks, np.array([functools.reduce(lambda n, s: n * len(SYMBOLS) + _CODE[s], b, 0) for b in blocks], np.int64)


def summary(symbols: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk, for each vector at its right end: the vector at its left end, the cost, the state after it by state."""
    tables = Tables.made()
    vector = np.arange(len(tables.vectors))
    cost, leaves = np.zeros(len(vector), np.int64), np.tile(np.arange(4), (len(vector), 1))
    for b in blocks_of(symbols)[1][::-1]:
        leaves = np.take_along_axis(leaves, tables.leaves[b][vector], 1)
        cost += tables.cost[b][vector]
        vector = tables.before[b][vector]
    return vector, cost - DELETE * (-len(symbols) % BLOCK), leaves


def trace(symbols: str, right: int, state: int, last: bool) -> tuple[list[str], list[str]]:
    """Edits and new roles of each row of a chunk; the last chunk's last row also has what is inserted at the end."""
    tables = Tables.made()
    blocks, numbers = blocks_of(symbols)
    rights = []
    for b in numbers[::-1]:
        rights.append(right)
        right = tables.before[b][right]
    edits, roles = [], []
    for block, at in zip(blocks, reversed(rights), strict=True):
        rows, state = expanded(block, int(at), state)
        edits += [e for e, _ in rows]
        roles += [r for _, r in rows]
    missing = -len(symbols) % BLOCK
    edits, roles = edits[missing:], roles[missing:]
    if last and edits:
        while LAST[state]:
            edits[-1], roles[-1], state = edits[-1] + "I", roles[-1] + NEXT[state], STEPS[state, NEXT[state]]
    return edits, roles


def _summaries(symbols: pa.Array) -> pa.Array:
    rows = [summary(s) for s in symbols.to_pylist()]
    return pa.array([{"before": v.tolist(), "cost": c.tolist(), "leaves": x.reshape(-1).tolist()} for v, c, x in rows], pa.struct([(n, pa.list_(pa.int64())) for n in ("before", "cost", "leaves")]))


def _placed(chunks: pa.Array) -> pa.Array:
    """Of each conversation, its chunks' right vectors and left states, and what all of it costs."""
    out = []
    for parts in chunks.to_pylist():
        right, cost, rights, state, states = 0, 0, [], START, []
        for part in reversed(parts):
            rights.append(right)
            cost, right = cost + part["made"]["cost"][right], part["made"]["before"][right]
        cost += Tables.made().vectors[right][START]
        rights.reverse()
        for part, right in zip(parts, rights, strict=True):
            states.append(state)
            state = part["made"]["leaves"][4 * right + state]
        out.append({"cost": cost, "at": [{"first": p["first"], "right": r, "state": s, "last": i == len(parts) - 1} for i, (p, r, s) in enumerate(zip(parts, rights, states, strict=True))]})
    at = pa.list_(pa.struct([("first", pa.int64()), ("right", pa.int64()), ("state", pa.int64()), ("last", pa.bool_())]))
    return pa.array(out, pa.struct([("cost", pa.int64()), ("at", at)]))


def _traces(symbols: pa.Array, right: pa.Array, state: pa.Array, last: pa.Array) -> pa.Array:
    rows = [trace(*x) for x in zip(symbols.to_pylist(), right.to_pylist(), state.to_pylist(), last.to_pylist(), strict=True)]
    return pa.array([{"edits": e, "roles": r} for e, r in rows], pa.struct([("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))]))


SUMMARY = "before array<bigint>, cost array<bigint>, leaves array<bigint>"
PLACED = "cost bigint, at array<struct<first: bigint, right: bigint, state: bigint, last: boolean>>"
TRACES = "edits array<string>, roles array<string>"


def damage(turns: DataFrame) -> DataFrame:
    """Faults planted by the crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out
    ``[.!?]``, 3 repeats it, 4 makes its role user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    return (
        turns.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault <> 0")
        .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
        .drop("_copy")
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Rows with ``at``, a running number by conversation, turn, role and text; equal rows once, with their number
    ``copies``."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds are sampled: of texts only their beginnings go to the driver for them
    spread = rows.repartitionByRange(parts, *order, F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(*order, "text")
    return materialise(spread.withColumn("at", F.monotonically_increasing_id()), "turns-in-order")


def faults(rows: DataFrame) -> DataFrame:
    """Of the rows of in_order: at, conv_id, turn, copies, initial, symbol, and blank, duplicate, truncated (numbers of copies that
    are). Texts aren't moved: a row is the first with its role and text if its place is the least among those of their digest."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    first = rows.groupBy("conv_id", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("digest")).agg(F.min("at").alias("at"))
    marked = rows.select("at", "conv_id", "turn", "copies", F.substring("role", 1, 1).alias("initial"), (said == "").alias("empty"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"))
    marked = marked.join(first.select("at", F.lit(True).alias("first")), "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    goes, zero = F.col("empty") | ~F.col("first"), F.lit(0).cast("long")
    return marked.select(
        "at", "conv_id", "turn", "copies", "initial", F.when(F.col("empty"), F.col("copies")).otherwise(zero).alias("blank"),
        F.when(F.col("empty"), zero).when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies")).alias("duplicate"),
        F.when(goes | ~F.col("cut"), zero).otherwise(F.lit(1).cast("long")).alias("truncated"),
        F.when(goes, "x").when(F.col("cut"), F.upper(known)).otherwise(known).alias("symbol"),
    )


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of turns (conv_id, turn, role, text): the repaired rows (conv_id, at, part, role, text; in the order of
    at and part), and a report by conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    texts = in_order(turns)
    rows = materialise(faults(texts), "turn-faults")
    piece = F.struct("at", "symbol", "initial", "copies")
    chunks = materialise(
        rows.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk"))
        .agg(
            F.array_sort(F.collect_list(piece)).alias("rows"), F.min("turn").alias("least"), F.max("turn").alias("most"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("copies") - 1).alias("more"),
        )
        .select(
            "conv_id", F.col("rows")[0]["at"].alias("first"), F.col("rows.at").alias("places"), F.col("rows.copies").alias("copies"), F.array_join("rows.symbol", "").alias("symbols"),
            "least", "most", "blank", "duplicate", "truncated", "more", F.col("rows.initial").alias("initials"),
        ),
        "turn-chunks",
    )
    pair = F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, F.size("initials") - 1), lambda a, b: F.concat(a, b).isin(*LEGAL))
    inside = F.size(F.filter(pair, lambda legal: ~legal)) + F.col("more")  # neighbouring copies are never legal
    summed = chunks.select(
        "conv_id", "least", "most", "blank", "duplicate", "truncated", "more",
        F.struct("first", arrow_udf(_summaries, SUMMARY)("symbols").alias("made"), F.get("initials", F.lit(0)).alias("begins"), F.get("initials", F.size("initials") - 1).alias("ends")).alias("part"),
        inside.alias("illegal"),
    )
    turns_seen = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("turn").alias("turns"))
    whole = materialise(
        summed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "more", "illegal")])
        .select("*", arrow_udf(_placed, PLACED)("parts").alias("placed")),
        "turn-conversations",
    )
    at = whole.select(F.inline("placed.at"))
    told = chunks.join(at, "first").select("conv_id", "first", "places", "copies", arrow_udf(_traces, TRACES)("symbols", "right", "state", "last").alias("told"))
    told = materialise(told.select("conv_id", "first", "places", "copies", "told.edits", "told.roles"), "turn-edits")
    # the copies after the first go with it: D, before what is inserted at the end
    audit = F.zip_with("edits", "copies", lambda e, n: F.concat(F.regexp_extract(e, "^I*[DKR]", 0), F.repeat(F.lit("D"), (n - 1).cast("int")), F.regexp_extract(e, "[DKR](I*)$", 1)))
    audits = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", F.array_join(audit, "").alias("audit")))).alias("audits"))
    between = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts") - 1), lambda a, b: F.concat(a["ends"], b["begins"]).isin(*LEGAL))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    zero = F.lit(0).cast("long")
    report = (
        whole.join(audits.withColumnRenamed("conv_id", "c1"), whole["conv_id"].eqNullSafe(F.col("c1")))
        .join(turns_seen.withColumnRenamed("conv_id", "c2"), whole["conv_id"].eqNullSafe(F.col("c2")))
        .select(
            whole["conv_id"], F.when(F.col("least").isNull(), zero).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated",
            (F.col("illegal") + F.size(F.filter(between, lambda legal: ~legal))).alias("illegal"), (F.col("placed.cost") + DELETE * F.col("more")).alias("cost"), F.array_join("audits.audit", "").alias("audit"),
        )
    )
    edits = told.select(F.inline(F.arrays_zip("places", "edits", "roles"))).withColumnRenamed("places", "at").filter("edits <> 'D'")
    return _applied(texts, edits), report


def _applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows that stay or are inserted. Each edit string is I*, one of D, K, R, and I*; roles has a letter for each I and R."""
    long = lambda letter: F.when(letter == "u", ROLES["u"]).otherwise(ROLES["a"])
    edit = F.split(F.col("edits"), "")
    new = lambda i: F.length(F.regexp_replace(F.substring(F.col("edits"), F.lit(1), i + 1), "[KD]", ""))
    part = F.transform(edit, lambda e, i: F.struct(
        i.alias("part"), e.alias("edit"),
        F.when(e == "K", F.col("role")).otherwise(long(F.substring(F.col("roles"), new(i), F.lit(1)))).alias("role"),
        F.when(e == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
    ))
    return rows.join(edits, "at").select("conv_id", "at", F.inline(F.filter(part, lambda p: p["edit"].isin("K", "R", "I")))).drop("edit")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` joined by newlines. A digest needs its conversation in order: one task reads it as
    a stream, a batch at a time."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    keyed = repaired.select(F.col("conv_id").cast("string").alias("c"), "at", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = keyed.repartition("c").sortWithinPartitions("c", "at", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or c != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = c, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["c", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["c", "repaired_sha256"])

    return ordered.mapInArrow(run, "c string, repaired_sha256 string").select(F.col("c").cast(kind).alias("conv_id"), "repaired_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired, report = repair(damage(turns))
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("one"))
    told = report.withColumnRenamed("conv_id", "c1")
    hashed = digests(repaired).withColumnRenamed("conv_id", "c2")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(told, ids["conv_id"].eqNullSafe(told["c1"]), "left").join(hashed, ids["conv_id"].eqNullSafe(hashed["c2"]), "left")
        .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    )


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
k AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
                            lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, substr(role, 1, 1) AS i FROM d),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS ending FROM o),
y AS (
  SELECT *, ending = '' AS blank, ending <> '' AND again AS duplicate, ending <> '' AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated FROM w),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY conv_id),
f AS (
  SELECT conv_id, n AS p, {'c': 0::BIGINT, 'a': '', 'r': ''} AS s0, {'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
         {'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'} AS s2, {'c': 0::BIGINT, 'a': '', 'r': ''} AS s3 FROM n
  UNION ALL
  SELECT conv_id, p - 1, list_min([s0, {'c': 2 + t2.c, 'a': 'I' || t2.a, 'r': chr(10) || 'user:' || t2.r}]), list_min([s1, {'c': 2 + t2.c, 'a': 'I' || t2.a, 'r': chr(10) || 'user:' || t2.r}]), t2,
         list_min([s3, {'c': 2 + t2.c, 'a': 'I' || t2.a, 'r': chr(10) || 'user:' || t2.r}])
  FROM (
    SELECT *, list_min([s2, {'c': 2 + s3.c, 'a': 'I' || s3.a, 'r': chr(10) || 'assistant:' || s3.r}]) AS t2
    FROM (
      SELECT f.conv_id, f.p,
             list_min([{'c': 3 + s0.c, 'a': 'D' || s0.a, 'r': s0.r}, {'c': CASE WHEN go OR i NOT IN ('s', 'u') THEN 999999999 ELSE e END + CASE i WHEN 's' THEN s1.c ELSE s2.c END, 'a': 'K' || CASE i WHEN 's' THEN s1.a ELSE s2.a END, 'r': own || CASE i WHEN 's' THEN s1.r ELSE s2.r END},
                       {'c': CASE WHEN go THEN 999999999 ELSE 2 + e END + s2.c, 'a': 'R' || s2.a, 'r': u || s2.r}]) AS s0,
             list_min([{'c': 3 + s1.c, 'a': 'D' || s1.a, 'r': s1.r}, {'c': CASE WHEN go OR i <> 'u' THEN 999999999 ELSE e END + s2.c, 'a': 'K' || s2.a, 'r': own || s2.r},
                       {'c': CASE WHEN go THEN 999999999 ELSE 2 + e END + s2.c, 'a': 'R' || s2.a, 'r': u || s2.r}]) AS s1,
             list_min([{'c': 3 + s2.c, 'a': 'D' || s2.a, 'r': s2.r}, {'c': CASE WHEN go OR i <> 'a' THEN 999999999 ELSE e END + s3.c, 'a': 'K' || s3.a, 'r': own || s3.r},
                       {'c': CASE WHEN go THEN 999999999 ELSE 2 + e END + s3.c, 'a': 'R' || s3.a, 'r': a || s3.r}]) AS s2,
             list_min([{'c': 3 + s3.c, 'a': 'D' || s3.a, 'r': s3.r}, {'c': CASE WHEN go OR i <> 'u' THEN 999999999 ELSE e END + s2.c, 'a': 'K' || s2.a, 'r': own || s2.r},
                       {'c': CASE WHEN go THEN 999999999 ELSE 2 + e END + s2.c, 'a': 'R' || s2.a, 'r': u || s2.r}]) AS s3
      FROM f JOIN (SELECT conv_id, p, i, blank OR duplicate AS go, truncated::BIGINT AS e, chr(10) || role || ':' || text AS own, chr(10) || 'user:' || text AS u, chr(10) || 'assistant:' || text AS a FROM y) AS x
        ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.p = f.p))),
g AS (SELECT conv_id, s0 FROM f WHERE p = 0)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id
"""
