"""Sharding by sampled splitters, in DataFrame functions only.

Records are put in the order of a key that is theirs alone: the hash of the group (equal texts
lie side by side), the hash of the id, and that of the row's number, which no two numbers share. A sample in which every record's
chance follows its size gives quantiles of this order by size; they cut it into many ranges,
whose sizes are then summed exactly. A range that came out overfull is sampled anew and cut
again. Ranges are small, so positions inside them are running sums of one window each, and with
the sums of the ranges before, every record knows the bytes that precede it in the whole table.
Shards are equal stretches of these bytes. A boundary inside a small group moves to the group's
nearer edge, so that copies share a shard; a group of more than ``snap`` of a shard is divided.

Defined cases: a null size is 0; equal records are told apart by their row number, so a group of
any size can be divided; an empty table has no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tarnish.llm.texts import fresh
from tarnish.session import materialise

#: Sample points per range; ranges per shard at least, and records per range at most if that is more.
POINTS, RANGES, RECORDS = 8, 64, 200_000
#: A range of so many times its share is overfull; so often such ranges are cut again.
OVERFULL, ROUNDS = 2.0, 4

Key = tuple[int, int, int]


def slots(splitters: list[Key], level: int) -> list[tuple]:
    """Rows ``(g, t, slot, before, values)`` for the splitters that agree in the ``level`` numbers before.

    The numbers are hashes, so their leading bits file them evenly, about eight to a slot. ``before``:
    splitters of the group in earlier slots. ``values``: the different numbers of the slot, how many
    splitters have each, the bits by which several are filed on the next level, or the rest of the one.
    """
    groups: dict[tuple, list[Key]] = {}
    for s in splitters:
        groups.setdefault(s[:level], []).append(s)
    rows = []
    for prefix, own in groups.items():
        if level and len(own) == 1:
            continue
        bits, before, by_slot = bits_for(len(own)), 0, {}
        for s in own:
            by_slot.setdefault((s[level] + (1 << 63)) >> (64 - bits), {}).setdefault(s[level], []).append(s)
        for slot in range(1 << bits):
            values = by_slot.get(slot, {})
            rows.append((*(*prefix, 0, 0)[:2], slot, before, [
                (x, len(held), bits_for(len(held)), *(*held[0][level + 1:], 0, 0)[:2]) for x, held in values.items()]))
            before += sum(map(len, values.values()))
    return rows


def bits_for(n: int) -> int:
    return max(1, n.bit_length() - 3)


#: Where a splitter has the record's number on a level and no other does, the rest of it decides.
ALONE = {"g": "v.x = g and v.n = 1 and (v.one < t or v.one = t and v.two <= u)", "t": "v.x = t and v.n = 1 and v.one <= u", "u": "v.x = u"}


def with_range(records: DataFrame, splitters: list[Key], out: str = "r") -> DataFrame:
    """Add the number of splitters at or below the key ``(g, t, u)``, of three hashes.

    A record meets the slot of its ``g`` by an equi-join, and compares the few splitters there. Only
    where several splitters have the same ``g`` they are filed by ``t``, and then by ``u``. No table has
    more rows than splitters, so what a record costs doesn't depend on their number.
    """
    if not splitters:
        return records.withColumn(out, F.lit(0))
    columns, found = records.columns, records.select("*", F.lit(bits_for(len(splitters))).alias("_bits"), F.lit(0).alias("_sum"))
    for level, own in enumerate(("g", "t", "u")):
        rows = slots(splitters, level)
        if not rows:
            break
        table = F.broadcast(records.sparkSession.createDataFrame(
            rows, "_g bigint, _t bigint, _slot bigint, _before int, _values array<struct<x:bigint,n:int,bits:int,one:bigint,two:bigint>>"))
        # from the least number on, as unsigned
        slot = F.expr(f"shiftrightunsigned({own} ^ (-9223372036854775807L - 1L), 64 - _bits)")
        same = F.col("_slot") == F.col("_at")
        for c in ("g", "t")[:level]:
            same &= F.col(c) == F.col(f"_{c}")
        met = found.withColumn("_at", slot).join(table, same, "left")
        below = F.expr(f"aggregate(filter(_values, v -> v.x < {own} or {ALONE[own]}), 0, (a, v) -> a + v.n)")
        several = F.expr(f"get(filter(_values, v -> v.x = {own} and v.n > 1), 0).bits")
        found = met.select(*columns, several.alias("_bits"), (F.col("_sum") + F.coalesce(F.col("_before") + below, F.lit(0))).alias("_sum"))
    return found.withColumnRenamed("_sum", out).drop("_bits")


def splitters_of(records: DataFrame, ranges: int, total: int) -> list[Key]:
    """Quantile boundaries from a size-weighted sample; overfull ranges are cut again."""
    share = total / ranges
    chance = F.pmod(F.xxhash64("u", "t"), F.lit(1 << 40)) / float(1 << 40)

    def sample(rows: DataFrame, per_byte: float) -> list[Key]:
        # about POINTS for each range wanted
        return sorted(tuple(r) for r in rows.where(chance < F.col("size") * per_byte).select("g", "t", "u").collect())

    points = sample(records, POINTS * ranges / total)
    cuts = sorted(set(points[POINTS - 1::POINTS]))
    for i in range(1, ROUNDS + 1):
        sums = {r.r: r.size for r in with_range(records, cuts).groupBy("r").agg(F.sum("size").alias("size")).collect()}
        over = [r for r, size in sums.items() if size > OVERFULL * share]
        if not over:
            break
        # four times as many points inside them, and a cut at every half share
        points = POINTS * 4 ** i
        inside = with_range(records, cuts).where(F.col("r").isin(over))
        new = set(sample(inside, points * ranges / total)[::points // 2]) - set(cuts)
        if not new:  # single records larger than a range
            break
        cuts = sorted({*cuts, *new})
    return cuts


def shard(records: DataFrame, shards: int, size: str = "size", group: str = "group", ident: str = "doc_id",
          snap: float = 0.01, out: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``records`` with the shard, from 0, and the place in it; shards are near equal in ``size``."""
    columns = [c for c in records.columns if c not in out]
    k = fresh("_key", columns)
    keyed = materialise(records.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        F.xxhash64(F.col(f"`{group}`")).alias("g"), F.xxhash64(F.col(f"`{ident}`")).alias("t"),
        F.xxhash64(F.monotonically_increasing_id()).alias("u"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("size")
    ).alias(k)), "keyed")
    bare = keyed.select(f"{k}.*")
    total, n = bare.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(shards * RANGES, min(1 << 16, -(-n // RECORDS)))
    cuts = splitters_of(bare, ranges, total) if total else []

    at = with_range(bare, cuts)
    here = Window.partitionBy("r").orderBy("g", "t", "u")
    placed = materialise(at.select(
        "g", "u", "r", "size", (F.row_number().over(here) - 1).alias("row"),
        (F.sum("size").over(here) - F.col("size")).alias("before")), "placed")
    # a row per range, bounded by the splitters
    sums = placed.groupBy("r").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("r").collect()
    starts, bytes_, rows = [], 0, 0
    for x in sums:
        starts.append((x.r, bytes_, rows))
        bytes_, rows = bytes_ + x.size, rows + x.n
    offsets = records.sparkSession.createDataFrame(starts, "r int, first_byte bigint, first_row bigint")
    placed = placed.join(offsets, "r").select(
        "g", "u", "size", (F.col("before") + F.col("first_byte")).alias("byte"), (F.col("row") + F.col("first_row")).alias("row"))

    edges = [total * i / shards for i in range(1, shards)]
    crossing = F.exists(F.array(*[F.lit(e) for e in edges]), lambda e: (F.col("byte") < e) & (e <= F.col("byte") + F.col("size"))) if edges else F.lit(False)
    hit = [r.g for r in placed.where(crossing).select("g").distinct().collect()]  # at most one per boundary
    groups = placed.where(F.col("g").isin(hit)).groupBy("g").agg(
        F.min("byte").alias("a"), F.max(F.col("byte") + F.col("size")).alias("z")).collect() if hit else []
    moved = []
    for e in edges:
        own = next((x for x in groups if x.a < e <= x.z and x.z - x.a <= snap * total / shards), None)
        moved.append((own.a if e - own.a < own.z - e else own.z) if own else e)
    # a record belongs where its middle lies
    middle = F.col("byte") + F.col("size") / 2
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in moved]), lambda e: e <= middle)) if moved else F.lit(0)
    dealt = materialise(placed.select("u", "row", number.cast("int").alias("shard")), "dealt")
    heads = dealt.groupBy("shard").agg(F.min("row").alias("head")).collect()  # a row per shard
    head = F.coalesce(*[F.when(F.col("shard") == x.shard, F.lit(x.head)) for x in heads], F.lit(0))
    s = fresh("_shard", [*columns, k])
    found = dealt.select(F.struct("u", "shard", (F.col("row") - head).cast("bigint").alias("slot")).alias(s))
    return keyed.join(found, F.col(f"{k}.u") == F.col(f"{s}.u")).select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"{s}.shard").alias(out[0]), F.col(f"{s}.slot").alias(out[1]))


def write_shards(sharded: DataFrame, path: str, files: int = 8) -> None:
    """One folder per shard, in up to ``files`` files each, records in the order of their slots."""
    (sharded.repartition(F.col("shard"), F.col("slot") % files).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
