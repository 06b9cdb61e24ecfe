"""Bit operations over order and line keys."""

from pyspark.sql import functions as F

from lodeframe.functions import bits as B
from lodeframe.plans.registry import query, table


@query(
    "b01_b06_bit_profile",
    """SELECT o_orderkey,
  list_sum(list_transform(range(0, 32), lambda i: ((o_orderkey >> i) & 1) * (1::BIGINT << (31 - i))))::BIGINT AS reversed32,
  bit_count(o_orderkey)::BIGINT AS ones,
  (((o_orderkey << 5) | (o_orderkey >> 27)) & 4294967295)::BIGINT AS rotated_left,
  (((o_orderkey >> 5) | (o_orderkey << 27)) & 4294967295)::BIGINT AS rotated_right,
  (CASE WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey & (o_orderkey - 1) END)::BIGINT AS cleared,
  ((o_orderkey >> 3) & 63)::BIGINT AS bits_3_6,
  CASE WHEN o_orderkey <= 1 THEN 1 ELSE (1::BIGINT << length(bin(o_orderkey - 1))) END::BIGINT AS ceil2,
  CASE WHEN o_orderkey = 0 THEN 0 ELSE (1::BIGINT << (length(bin(o_orderkey)) - 1)) END::BIGINT AS floor2 FROM orders""",
)
def bit_profile(spark, sf_dir):
    k = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            B.reverse_bits(k, 32).alias("reversed32"),
            B.popcount(k).cast("long").alias("ones"),
            B.rotate_left(k, 5, 32).alias("rotated_left"),
            B.rotate_right(k, 5, 32).alias("rotated_right"),
            B.clear_lowest_bit(k).alias("cleared"),
            B.extract_bits(k, 3, 6).alias("bits_3_6"),
            B.bit_ceil(k).alias("ceil2"),
            B.bit_floor(k).alias("floor2"),
        )
    )


@query(
    "b07_b11_b12_bit_stream",
    """SELECT l_orderkey, l_linenumber, (l_orderkey & 1048575)::BIGINT AS f0, (l_linenumber & 7)::BIGINT AS f1, (l_partkey & 131071)::BIGINT AS f2, 5::BIGINT AS n_bytes FROM lineitem""",
)
def bit_stream(spark, sf_dir):
    """Fields packed to bytes and read back, in the four orders at once: all must agree with the masked keys."""
    widths = [20, 3, 17]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey").alias("fields"))
    for order in B.BitOrder:
        rows = rows.withColumn(order.value, B.pack_bits(F.col("fields"), widths, order))
    rows = rows.select("l_orderkey", "l_linenumber", F.octet_length("msbit").cast("long").alias("n_bytes"), *(B.unpack_bits(F.col(o.value), widths, o).alias(o.value) for o in B.BitOrder))
    same = (F.col("lsbyte") == F.col("msbyte")) & (F.col("lsbyte") == F.col("lsbit")) & (F.col("lsbyte") == F.col("msbit"))
    return rows.select("l_orderkey", "l_linenumber", *(F.when(same, F.col("lsbyte")[i]).alias(f"f{i}") for i in range(3)), "n_bytes")


@query(
    "b08_bit_field",
    """SELECT o_orderkey, ((o_orderkey >> 4) & 255)::BIGINT AS field, ((o_orderkey & ~(255::BIGINT << 4)) | ((o_custkey & 255) << 4))::BIGINT AS replaced FROM orders""",
)
def bit_field(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", B.field_get("o_orderkey", 4, 8).alias("field"), B.field_set("o_orderkey", 4, 8, "o_custkey").alias("replaced"))


@query(
    "b09_bit_walk",
    """SELECT bit, sum((o_orderkey >> bit) & 1)::BIGINT AS ones FROM orders, range(0, 24) AS t(bit) GROUP BY bit""",
)
def bit_walk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.posexplode(B.bits_of("o_orderkey", 24)).alias("bit", "value"))
    return rows.groupBy(F.col("bit").cast("long").alias("bit")).agg(F.sum("value").cast("long").alias("ones"))


@query(
    "b10_byte_order",
    """SELECT o_orderkey, (((o_orderkey & 255) << 24) | (((o_orderkey >> 8) & 255) << 16) | (((o_orderkey >> 16) & 255) << 8) | ((o_orderkey >> 24) & 255))::BIGINT AS swapped FROM orders""",
)
def byte_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", B.reverse_bytes("o_orderkey", 4).alias("swapped"))


@query(
    "b13_bitset",
    """WITH s AS (SELECT user_id, list(DISTINCT event_id % 64) AS a, list(DISTINCT event_id % 48) AS b FROM events GROUP BY user_id)
SELECT user_id, len(list_filter(range(0, 64), lambda i: list_contains(a, i) AND i < 48 AND list_contains(b, i)))::BIGINT AS n_and,
  len(list_filter(range(0, 64), lambda i: list_contains(a, i) OR (i < 48 AND list_contains(b, i))))::BIGINT AS n_or,
  len(list_filter(range(0, 64), lambda i: list_contains(a, i) <> (i < 48 AND list_contains(b, i))))::BIGINT AS n_xor,
  (64 - len(a))::BIGINT AS n_not FROM s""",
)
def bitsets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 64).cast("int")).alias("a"), F.collect_set((F.col("event_id") % 48).cast("int")).alias("b"))
    rows = rows.select("user_id", B.bitset(64, F.col("a")).alias("a"), B.bitset(48, F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "user_id",
        B.bitset_count(B.bitset_and(a, b)).cast("long").alias("n_and"),
        B.bitset_count(B.bitset_or(a, b)).cast("long").alias("n_or"),
        B.bitset_count(B.bitset_xor(a, b)).cast("long").alias("n_xor"),
        B.bitset_count(B.bitset_flip(a)).cast("long").alias("n_not"),
    )


@query(
    "b14_flags",
    """WITH f AS (SELECT l_orderkey, bit_or(1::BIGINT << (l_linenumber + 1)) AS flags FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, flags, flags | 3 AS added, flags & ~12::BIGINT AS removed, (flags & 20) <> 0 AS any_of_20, bit_count(flags)::BIGINT AS n_flags FROM f""",
)
def flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, l_linenumber + 1)")).alias("flags"))
    return rows.select(
        "l_orderkey",
        "flags",
        B.flags_add("flags", F.lit(3)).alias("added"),
        B.flags_remove("flags", F.lit(12)).alias("removed"),
        B.flags_contain("flags", F.lit(20)).alias("any_of_20"),
        F.size(B.flags_list("flags")).cast("long").alias("n_flags"),
    )


@query(
    "b11_b12_cursor",
    """SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS quantity, l_quantity::BIGINT % 16 AS low_quantity, l_partkey % 65536 AS part, true AS at_end FROM lineitem""",
)
def cursor(spark, sf_dir):
    """A record of three bits, six bits and, from the next byte on, sixteen, written and read by cursors."""

    def written(line: int, quantity: float, part: int) -> bytes:
        out = B.BitWriter()
        out.write(line, 3)
        out.write(0, 6)
        out.align()
        out.write_bytes(int(part % 65536).to_bytes(2, "little"))
        out.seek(3)
        out.write(int(quantity), 6)
        return out.buffer()

    def read(data: bytes) -> list[int]:
        cursor = B.BitReader(bytes(data))
        cursor.drop(3)
        low, quantity = cursor.peek(4), cursor.read(6)
        cursor.align()
        part, at_end = cursor.read(16), cursor.eof
        cursor.seek(0)
        return [cursor.read(3), quantity, low, part, int(at_end)]

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.by_cursor([F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey")], "binary", written).alias("d"))
    rows = rows.withColumn("f", B.by_cursor([F.col("d")], "array<long>", read))
    names = ("line", "quantity", "low_quantity", "part")
    return rows.select("l_orderkey", "l_linenumber", *(F.col("f")[i].alias(n) for i, n in enumerate(names)), (F.col("f")[4] == 1).alias("at_end"))


@query("b13_bitset_resize", "SELECT p_partkey, (p_size % 16 < 8)::BIGINT AS kept_low, (1 + (p_size % 16 <> 3)::INT)::BIGINT AS grown FROM part")
def bitset_resize(spark, sf_dir):
    """A bit among sixteen, cut to eight and grown again, with another set behind."""
    one = B.bitset(16, F.array((F.col("p_size") % 16).cast("int")))
    three = B.bitset_set(B.bitset_resize(one, 20), 3)
    return table(spark, sf_dir, "part").select("p_partkey", B.bitset_count(B.bitset_resize(B.bitset_resize(one, 8), 16)).cast("long").alias("kept_low"), B.bitset_count(three).cast("long").alias("grown"))
