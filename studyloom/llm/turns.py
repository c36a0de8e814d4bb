"""Repair of the structure of conversations by weighted finite-state composition.

A conversation is an acceptor of its rows' symbols (role initial and fault). It is
composed with an edit transducer, which keeps, reroles, deletes and inserts rows,
and with an acceptor of the role grammar ``(s?(ua)+)?``. The composition is made
lazily, a row at a time, and its shortest path is found in topological order over
weights (cost, string of labels), compared in this order.

Rows are dealt out by range of (conversation, turn), so a long conversation lies in
many tasks; what meets for a conversation is one letter a row. Texts meet their
verdict by key, since of equal rows of a conversation only one can stay.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.memory import batches_of
from studyloom.llm.storage import materialise

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
#: Symbols of rows: role initial (x: none of the three) and no fault, one that must
#: be deleted, one that is truncated.
SOUND, BAD, CUT = "suax", "SUAX", "1234"
#: The role grammar: state and role initial to state; a path ends in a final state.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, STATES = (0, 3), range(4)
_FAR = 1 << 40
#: Rows of a conversation whose symbols are first put together.
BLOCK = 256


def edits(symbol: str) -> list[tuple[str, int, str, str]]:
    """Arcs of the edit transducer for a row: (label, cost, role initial that comes
    out, what is done). The empty symbol is the insertion."""
    if not symbol:
        return [("I", INSERT, "u", "U"), ("I", INSERT, "a", "A")]
    arcs = [("D", DELETE, "", "-")]
    if symbol not in BAD:
        more = OPEN if symbol in CUT else 0
        own = SOUND[(CUT if more else SOUND).index(symbol)]
        arcs += [("R", REROLE + more, "u", "u"), ("R", REROLE + more, "a", "a")]
        arcs += [("K", KEEP + more, own, "k")] if own != "x" else []
    return arcs


def _composed(state: int, symbol: str):
    """Arcs of edit transducer and grammar together: (label, cost, done, state)."""
    for label, cost, out, done in edits(symbol):
        if not out:
            yield label, cost, done, state
        elif (state, out) in GRAMMAR:
            yield label, cost, done, GRAMMAR[state, out]


def _with_insertions(own: list[tuple]) -> tuple:
    """Best ways (cost, label, labels, done, state) from each state, from those that
    begin without an insertion."""
    best = list(own)
    for _ in STATES:  # no shortest path visits a state twice between two rows
        best = [min([own[q], *((cost + best[to][0], label, label + best[to][2], done + best[to][3], best[to][4]) for label, cost, done, to in _composed(q, ""))], key=lambda w: w[:2]) for q in STATES]
    return tuple(best)


@lru_cache(maxsize=None)
def _ahead(costs: tuple[int, ...], symbol: str) -> tuple[tuple, tuple]:
    """Costs from before a row, less the least, and the ways through the row from each
    state, for costs from behind it. Costs differ by a few edits, so that there are few
    such pairs. Arcs of a state have different labels, hence comparing (cost, label)
    compares (cost, string): no cheapest string begins another one."""
    if symbol == "end":
        ways = _with_insertions([(0 if q in FINAL else _FAR, "", "", "", q) for q in STATES])
    else:
        ways = _with_insertions([min(((cost + costs[to], label, label, done, to) for label, cost, done, to in _composed(q, symbol)), key=lambda w: w[:2]) for q in STATES])
    return tuple(w[0] for w in ways), tuple(w[2:] for w in ways)


def shortest_path(symbols: str) -> tuple[int, str, list[str]]:
    """(cost, labels, done) of the cheapest edits; of several those with the ASCII-least
    labels. ``done`` has for each row the letters of insertions before it and its own,
    and behind them those of insertions at the end."""
    costs, ways = _ahead((), "end")
    total, passed = 0, [ways]
    for symbol in reversed(symbols):
        costs, ways = _ahead(costs, symbol)
        least = min(costs)
        costs = tuple(c - least for c in costs)
        total += least
        passed.append(ways)
    state, labels, done = 0, [], []
    for ways in reversed(passed):
        label, letters, state = ways[state]
        labels.append(label)
        done.append(letters)
    return total + costs[0], "".join(labels), done


def with_nulls(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a space for a null role or text."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", blank("role"), blank("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with every 20th dropped, emptied, cut, doubled
    or given to the user, by a checksum of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    rows = with_nulls(rows).withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key() -> Column:
    """Digest of conversation, role and text."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws(":", conv, F.length("role").cast("string"), F.concat("role", "text"))))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: (conv_id, turn, role, head, key, n, symbol,
    again), where ``n`` counts equal rows of one turn, ``symbol`` is that of the first
    and ``again`` that of the others. ``rows`` as from ``with_nulls``."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, cut = shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), _key().alias("key"), blank.alias("blank"), cut.alias("cut"))
    runs = narrow.groupBy("conv_id", "turn", "role", "head", "key", "blank", "cut").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = runs.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1").select("key", "first")
    runs = runs.join(firsts, "key", "left")
    later = F.coalesce(place > F.col("first"), F.lit(False))
    of = lambda letters: F.when(initial == "s", letters[0]).when(initial == "u", letters[1]).when(initial == "a", letters[2]).otherwise(letters[3])
    symbol = F.when(F.col("blank") | later, of(BAD)).when(F.col("cut"), of(CUT)).otherwise(of(SOUND))
    return runs.select("conv_id", "turn", "role", "head", "key", "n", "blank", later.alias("later"), "cut", symbol.alias("symbol"), of(BAD).alias("again"))


def faults(runs: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) from ``judged`` rows."""
    blank = F.when(F.col("blank"), F.col("n")).otherwise(0)
    duplicate = F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)
    truncated = F.when(~F.col("blank") & ~F.col("later") & F.col("cut"), 1).otherwise(0)
    sums = runs.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(blank).cast("long").alias("blank"),
        F.sum(duplicate).cast("long").alias("duplicate"),
        F.sum(truncated).cast("long").alias("truncated"),
    )
    return sums


def _blocks(runs: DataFrame) -> DataFrame:
    """(conv_id, start, keys, symbols): the rows of each conversation in order, cut into
    blocks of BLOCK rows at most; ``start`` is one number for each block and rises
    along a conversation. Written."""
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.select("conv_id", "turn", "role", "head", "key", "symbol", "again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("key"), F.col("copy")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    one = F.struct(F.monotonically_increasing_id().alias("at"), "key", F.when(F.col("copy") == 0, F.col("symbol")).otherwise(F.col("again")).alias("symbol")).alias("one")
    grouped = dealt.select("conv_id", one).groupBy("conv_id", F.floor(F.col("one.at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("one")).alias("rows"))
    made = grouped.select("conv_id", F.col("rows")[0]["at"].alias("start"), F.col("rows.key").alias("keys"), F.array_join("rows.symbol", "").alias("symbols"))
    return materialise(made, "turns")


_PATH = T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("illegal", T.LongType()), T.StructField("done", T.ArrayType(T.ArrayType(T.StringType())))])


@F.arrow_udf(_PATH)
def _path(blocks: pa.Array) -> pa.Array:
    """Shortest paths of conversations given as strings of symbols by block."""
    costs, audits, illegal, every = [], [], [], []
    plain = str.maketrans(BAD + CUT, SOUND + SOUND)
    for parts in blocks.to_pylist():
        symbols = "".join(parts)
        roles = symbols.translate(plain)
        cost, audit, done = shortest_path(symbols)
        costs.append(cost)
        audits.append(audit)
        illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])))
        at, own = 0, []
        for part in parts:
            own.append(done[at : at + len(part)])
            at += len(part)
        own[-1] = own[-1] + [done[-1]]  # insertions behind the last row
        every.append(own)
    return pa.StructArray.from_arrays([pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(illegal, pa.int64()), pa.array(every, pa.list_(pa.list_(pa.string())))], ["cost", "audit", "illegal", "done"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and repaired rows of conversations (conv_id, turn, role, text).

    Verdicts: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row
    for each conversation. Repaired rows: (conv_id, start, pos, at, role, text), in the
    order of the three numbers; inserted rows have an empty text. A conversation whose
    rows are all deleted has none.

    Rows go by turn, null first; rows of one turn by role, by the first 32 characters
    and then a hash of the text. A null role or text is a space; a null conv_id is a
    conversation of its own; equal rows are duplicates of the first; an empty role has
    no initial and can't be kept as it is; an empty table gives empty tables; other
    columns are left out."""
    rows = with_nulls(rows)
    spark = rows.sparkSession
    runs = materialise(judged(rows), "judged")
    blocks = _blocks(runs)
    listed = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "symbols"))).alias("blocks"))
    found = listed.select("conv_id", F.col("blocks.start").alias("starts"), _path(F.col("blocks.symbols")).alias("path"))
    with batches_of(spark):
        found = materialise(found.select("conv_id", "starts", "path.*"), "paths")
    ways, counts = found.select(F.col("conv_id").alias("own"), "illegal", "cost", "audit"), faults(runs)
    verdicts = counts.join(ways, counts["conv_id"].eqNullSafe(ways["own"])).drop("own")
    done = found.select(F.explode(F.arrays_zip("starts", "done")).alias("z")).select(F.col("z.starts").alias("start"), F.col("z.done").alias("done"))
    each = blocks.join(done, "start").select("conv_id", "start", F.posexplode(F.arrays_zip("keys", "done")).alias("pos", "z"))
    letters = each.where("z.done not in ('-', '')").select("conv_id", "start", "pos", F.col("z.keys").alias("key"), F.posexplode(F.split("z.done", "")).alias("at", "letter")).where("letter not in ('-', '')")
    own = F.col("letter").isin("k", "u", "a")
    letters = letters.select("conv_id", "start", "pos", "at", "letter", F.when(own, F.col("key")).alias("key"))
    texts = rows.select(_key().alias("key"), F.col("role").alias("was"), "text").dropDuplicates(["key"])
    role = F.when(F.lower("letter") == "u", "user").when(F.lower("letter") == "a", "assistant").otherwise(F.col("was"))
    repaired = letters.join(texts, "key", "left").select("conv_id", "start", "pos", "at", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return verdicts, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each conversation in ``repaired``,
    joined by newlines. Lines stream through the hash in order, a conversation is never
    held as a whole."""
    tasks = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired.select("conv_id", "start", "pos", "at", F.concat_ws(":", "role", "text").alias("line"))
    dealt = lines.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "start", "pos", "at")

    def run(batches):
        last, state = None, None
        for batch in batches:
            ids, out, sums = batch.column(0).to_pylist(), [], []
            for id_, line in zip(ids, batch.column(4).cast(pa.binary())):
                if state is None or id_ != last:
                    if state is not None:
                        out.append(last)
                        sums.append(state.hexdigest())
                    last, state = id_, hashlib.sha256(line.as_py())
                else:
                    state.update(b"\n")
                    state.update(line.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(0).type), pa.array(sums, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    kind = repaired.schema["conv_id"].dataType
    return dealt.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), T.StructField("sha256", T.StringType())]))
