"""Repair of conversation structure as a lightest derivation, found by Knuth's agenda.

A conversation is well formed if the initials of its roles read (s?(ua)+)?. Its rows are repaired by
edits: K keeps a row (cost 0), R gives it the role user or assistant (3), D deletes it (4; the only
edit of blank and repeated rows), I inserts an empty turn (3). A truncated row that stays costs 3 more.

Items of the deduction are (place, state of the pattern): "what stands from here on can be finished
from this state". An edit and the item behind it derive the item before it, with a value of (cost,
letters of the edits). The agenda pops items by cost, then by place from the end, then by letters. In
this order every deduction is superior, since an edit of a row leads to an earlier place and an
insertion to a higher cost, and monotone, since letters are put in front. So an item is final once
popped. An item has one deduction for each letter, so that its first letter settles any tie.

Long conversations are dealt out in blocks of BLOCK rows. A block's costs from each state to each are
found by itself; blocks are then chained by these few numbers, and each is solved once more with the
costs of all that comes behind it. No task holds more rows of a conversation than a block has, but
for the digest in summary(), which goes through a conversation's rows in order as a stream.

Defined results: null texts and roles are one space; null turns come first and are counted in no gap;
rows of the same turn are ordered by role, then by their text's digest; null conversations are one;
repeated rows are duplicates; an empty table gives no rows; other columns fall away.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, staged

#: Rows of a block, as a power of two.
BLOCK_BITS = 10
#: Cost of no derivation.
NEVER = 1 << 40
RETYPE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
LEGAL = ("su", "ua", "au")
#: States of the pattern: nothing yet, after s, after u, after a; by initial, what a role leads to.
STATES = range(4)
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that a state takes, as the initial and as what it leads to.
TAKES = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
#: Costs at the end of a conversation: it may end after nothing or after a.
FINAL = [0, NEVER, NEVER, 0]
_PLACE = "_conv string, _block long"


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with made damage by crc32(conv_id:turn) % 20: 0 dropped, 1 emptied, 2 without sentence ends, 3 twice, 4 as user."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")), F.lit(20))
    d = rows.select("conv_id", "turn", k.alias("_k"), one_space("role").alias("role"), one_space("text").alias("text")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _key(conv_id: str) -> Column:
    return F.when(F.col(conv_id).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string")))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with places in their conversation's order (_pos, unique over all) and their first fault: blank, duplicate, truncated or none."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), _key("conv_id").alias("_conv"))
    d = d.withColumn("_digest", F.sha2("text", 256))
    order = ("_conv", F.asc_nulls_first("turn"), "role", "_digest")
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    d = staged(d.withColumn("_block", F.shiftright("_pos", BLOCK_BITS)), "conversation-rows")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    again = d.groupBy("_conv", "role", "_digest").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = d.join(again, ["_conv", "role", "_digest"], "left").drop("_digest")
    fault = F.when(bare == "", "blank").when(F.col("_pos") > F.col("_first"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    return d.withColumn("fault", fault).drop("_first")


def lightest(roles: str, faults: str, ends: list[int]) -> tuple[list[int], list[str | None], list[int | None]]:
    """Knuth's agenda over one block: by state at its start, the least cost, the letters of its edits and the state at its end; ends: by state, the cost of all behind it."""
    n = len(roles)
    final: list[dict[int, tuple]] = [{} for _ in range(n + 1)]  # at each place: state to (cost, letter, place and state behind)
    agenda = [(ends[q], 0, "", q, None) for q in STATES if ends[q] < NEVER]
    heapq.heapify(agenda)
    while agenda:
        cost, from_end, letter, q, behind = heapq.heappop(agenda)
        at = n - from_end
        if q in final[at]:
            continue
        final[at][q] = cost, letter, behind
        told = at, q
        for p in STATES:  # what is derived from this item
            if TAKES[p][1] == q and p not in final[at]:
                heapq.heappush(agenda, (cost + INSERT, from_end, "I", p, told))
        if not at:
            continue
        role, fault = roles[at - 1], faults[at - 1]
        heapq.heappush(agenda, (cost + DELETE, from_end + 1, "D", q, told))
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            for p in STATES:
                if STEP.get(role, {}).get(p) == q:
                    heapq.heappush(agenda, (cost + more, from_end + 1, "K", p, told))
                if TAKES[p][1] == q:
                    heapq.heappush(agenda, (cost + RETYPE + more, from_end + 1, "R", p, told))
    costs, audits, to = [], [], []
    for q in STATES:
        costs.append(final[0][q][0] if q in final[0] else NEVER)
        letters, item = [], (0, q) if q in final[0] else None
        while item and (found := final[item[0]][item[1]])[2]:
            letters.append(found[1])
            item = found[2]
        audits.append("".join(letters) if item else None)
        to.append(item[1] if item else None)
    return costs, audits, to


@F.arrow_udf(T.StructType().add("cost", T.ArrayType(T.LongType())).add("audit", T.ArrayType(T.StringType())).add("to", T.ArrayType(T.IntegerType())))
def solved(roles: pa.Array, faults: pa.Array, ends: pa.Array) -> pa.Array:
    got = [lightest(r.as_py(), f.as_py(), e.as_py()) for r, f, e in zip(roles, faults, ends, strict=True)]
    return pa.StructArray.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())))], ["cost", "audit", "to"])


@F.arrow_udf(T.ArrayType(T.StructType().add("row", T.IntegerType()).add("edit", T.StringType()).add("role", T.StringType())))
def steps(roles: pa.Array, start: pa.Array, audit: pa.Array) -> pa.Array:
    """The edits of a block in order, each with the row that it is about and the role that it gives, if any."""
    out = []
    for r, q, letters in zip(roles.to_pylist(), start.to_pylist(), audit.to_pylist(), strict=True):
        row, edits = 0, []
        for x in letters:
            initial = {"K": r[row : row + 1], "D": ""}.get(x, TAKES[q][0])
            edits.append({"row": None if x == "I" else row, "edit": x, "role": {"u": "user", "a": "assistant"}[initial] if x in "IR" else None})
            row += x != "I"
            q = STEP[initial][q] if x != "D" else q
        out.append(edits)
    return pa.array(out, pa.list_(pa.struct([("row", pa.int32()), ("edit", pa.string()), ("role", pa.string())])))


def _by_block(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["_block"])


def _ends(table: pa.Table) -> pa.Table:
    """Of a conversation's blocks, with their costs from each state to each: what comes behind each block costs, by state."""
    rows, ends = _by_block(table), list(FINAL)
    for r in reversed(rows):
        r["ends"] = ends
        ends = [min([NEVER, *(r["costs"][e][q] + ends[e] for e in STATES)]) for q in STATES]
    return pa.table({"_conv": [r["_conv"] for r in rows], "_block": [r["_block"] for r in rows], "ends": pa.array([r["ends"] for r in rows], pa.list_(pa.int64()))})


def _starts(table: pa.Table) -> pa.Table:
    """The state in which each block of a conversation begins."""
    rows, q = _by_block(table), 0
    for r in rows:
        r["start"], q = q, r["to"][q]
    return pa.table({"_conv": [r["_conv"] for r in rows], "_block": [r["_block"] for r in rows], "start": pa.array([r["start"] for r in rows], pa.int32())})


def _audits(blocks: DataFrame) -> DataFrame:
    """blocks (_conv, _block, roles, faults, ...) with start and the letters of their edits."""
    several = blocks.groupBy("_conv").count().filter("count > 1").select("_conv")
    vector = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    one = blocks.join(several, "_conv", "left_anti").withColumn("s", solved("roles", "faults", vector(FINAL)))
    one = one.withColumn("start", F.lit(0)).withColumn("audit", F.get("s.audit", F.lit(0))).drop("s")
    many = staged(blocks.join(several, "_conv", "left_semi"), "long-conversations")
    unit = [vector([0 if q == e else NEVER for q in STATES]) for e in STATES]
    costs = many.select("_conv", "_block", F.array(*[solved("roles", "faults", u)["cost"] for u in unit]).alias("costs"))
    ends = costs.groupBy("_conv").applyInArrow(_ends, f"{_PLACE}, ends array<bigint>")
    many = staged(many.join(ends, ["_conv", "_block"]).withColumn("s", solved("roles", "faults", "ends")).drop("ends"), "long-conversations-solved")
    starts = many.select("_conv", "_block", "s.to").groupBy("_conv").applyInArrow(_starts, f"{_PLACE}, start int")
    many = many.join(starts, ["_conv", "_block"]).withColumn("audit", F.get("s.audit", F.col("start"))).drop("s")
    return one.unionByName(many)


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) to the cheapest edits of each conversation, in order of _block, _seq.

    A row per edit: conv_id, turn, role and text as repaired (of an insertion: null turn, empty text), edit
    (K, R, D or I), fault and cost; was, the role before it. The repaired conversation is all but the D's.
    """
    d = staged(with_faults(rows), "conversation-faults")
    initial = F.when(F.col("role") == "", "\0").otherwise(F.substring("role", 1, 1))
    members = F.array_sort(F.collect_list(F.struct("_pos", initial.alias("role"), F.substring("fault", 1, 1).alias("fault"))))
    line = lambda c: F.array_join(F.transform("m", lambda x: x[c]), "")
    blocks = d.groupBy("_conv", "_block").agg(members.alias("m"), F.first("conv_id").alias("conv_id"))  # as many as a block has rows
    blocks = staged(blocks.select("_conv", "_block", "conv_id", F.get("m", F.lit(0))["_pos"].alias("_base"), line("role").alias("roles"), line("fault").alias("faults")), "conversation-blocks")
    e = _audits(blocks).select("_conv", "_block", "conv_id", "_base", F.posexplode(steps("roles", "start", "audit")).alias("_seq", "e"))
    e = e.select("_conv", "_block", "conv_id", "_seq", (F.col("_base") + F.col("e.row")).alias("_at"), F.col("e.edit").alias("edit"), F.col("e.role").alias("_role"))
    d = d.select(F.col("_pos").alias("_at"), "turn", F.col("role").alias("was"), "text", "fault")
    j = e.filter("edit <> 'I'").join(d, "_at").unionByName(e.filter("edit = 'I'"), allowMissingColumns=True)
    stays = F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), TRUNCATED).otherwise(0)
    cost = stays + F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", RETYPE).otherwise(0)
    return j.select("_conv", "_block", "_seq", "conv_id", "turn", F.coalesce("_role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit", "fault", cost.cast("long").alias("cost"), "was")


def digests(edits: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256) of the repaired rows, role:text joined by newlines: a conversation's rows pass in order, none is held."""
    lines = edits.filter("edit <> 'D'").select("_conv", "_block", "_seq", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("_conv").sortWithinPartitions("_conv", "_block", "_seq").select("_conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        for batch in batches:
            convs, out = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if conv != now:
                    if now is not None:
                        convs.append(now)
                        out.append(hashed.hexdigest())
                    now, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(line.as_py().encode())
            yield pa.RecordBatch.from_pydict({"_conv": pa.array(convs, pa.string()), "repaired_sha256": pa.array(out, pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"_conv": [now], "repaired_sha256": [hashed.hexdigest()]})

    return lines.mapInArrow(run, "_conv string, repaired_sha256 string")


def summary(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conv_id of conversations: gaps, faults, illegal neighbours, cost and letters of the edits, digest of the repaired rows; zeros and empty for those without rows."""
    e = staged(edits, "conversation-edits")
    there, count = F.col("edit") != "I", lambda f: F.count_if(F.col("fault") == f)
    initial = F.when(F.col("was") == "", "\0").otherwise(F.substring("was", 1, 1))
    line = F.array_sort(F.collect_list(F.struct("_seq", "edit", F.when(there, initial).alias("i"))))
    b = e.groupBy("_conv", "_block").agg(line.alias("m"), F.sum("cost").alias("cost"), *[count(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    b = b.withColumn("roles", F.array_join(F.transform(F.filter("m", lambda x: x["i"].isNotNull()), lambda x: x["i"]), "")).withColumn("letters", F.array_join(F.transform("m", lambda x: x["edit"]), "")).drop("m")
    by_block = W.partitionBy("_conv").orderBy("_block")  # a row per block
    b = b.withColumn("roles", F.concat(F.coalesce(F.right(F.lag("roles").over(by_block), F.lit(1)), F.lit("")), "roles"))
    pairs = F.when(F.length("roles") < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length("roles") - 1))
    b = b.withColumn("illegal", F.size(F.filter(pairs, lambda i: ~F.substring(F.col("roles"), i, F.lit(2)).isin(*LEGAL))).cast("long"))
    sums = b.groupBy("_conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "letters"))), lambda x: x["letters"]), "").alias("audit"),
    )
    turns = e.filter(there & F.col("turn").isNotNull()).select("_conv", "turn").distinct()
    gaps = turns.groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    ids = conversations.select("conv_id").distinct().withColumn("_conv", _key("conv_id"))
    out = ids.join(gaps, "_conv", "left").join(sums, "_conv", "left").join(digests(e), "_conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
