"""Checksums and codecs over documents, benchmark texts and keys."""

from pyspark.sql import functions as F

from lodeframe.functions import codecs as C
from lodeframe.plans.registry import query, table
from lodeframe.streaming.chunks import deflate_chunks, inflate_chunks

_BYTES = "list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2*i+1:2*i+2])::BIGINT)"


def _crc_sql(name: str) -> str:
    bits, polynomial, start, reflected, final = C.CRCS[name]
    table_ = str([int(x) for x in C.crc_table(bits, polynomial, reflected)]) + "::BIGINT[]"
    step = f"xor(acc >> 8, ({table_})[(xor(acc, b) & 255) + 1])" if reflected else f"xor((acc << 8) & {(1 << bits) - 1}, ({table_})[(xor(acc >> {bits - 8}, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([{start}::BIGINT], {_BYTES}), lambda acc, b: {step}), {final})::BIGINT"


@query("c01_c04_crc", f"SELECT item_id, {_crc_sql('crc32')} AS crc32, {_crc_sql('crc32c')} AS crc32c, {_crc_sql('crc16_ccitt')} AS crc16 FROM benchmark")
def crc(spark, sf_dir):
    data = C.utf8("text")
    return table(spark, sf_dir, "benchmark").select("item_id", C.crc_named(data, "crc32").alias("crc32"), C.crc_named(data, "crc32c").alias("crc32c"), C.crc_named(data, "crc16_ccitt").alias("crc16"))


@query(
    "c05_adler",
    f"""WITH x AS (SELECT doc_id, {_BYTES} AS b FROM documents)
SELECT doc_id, (((len(b) + coalesce(list_sum(list_transform(b, lambda v, i: v * (len(b) - i + 1))), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521)::BIGINT AS adler32 FROM x""",
)
def adler(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.adler(C.utf8("text")).alias("adler32"))


@query(
    "c06_varint",
    """SELECT l_orderkey, l_linenumber, CASE WHEN k < 128 THEN lpad(hex(k), 2, '0') WHEN k < 16384 THEN lpad(hex(k % 128 + 128), 2, '0') || lpad(hex(k // 128), 2, '0')
 ELSE lpad(hex(k % 128 + 128), 2, '0') || lpad(hex((k // 128) % 128 + 128), 2, '0') || lpad(hex(k // 16384), 2, '0') END AS encoded, k AS decoded FROM (SELECT *, l_orderkey AS k FROM lineitem)""",
)
def varint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.varint_encode("l_orderkey").alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", F.hex("raw").alias("encoded"), C.varint_decode("raw").alias("decoded"))


@query(
    "c07_zigzag",
    """SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS encoded, v AS decoded FROM (SELECT *, (l_partkey - 1000)::BIGINT AS v FROM lineitem)""",
)
def zigzag(spark, sf_dir):
    encoded = C.zigzag_encode(F.col("l_partkey") - 1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", encoded.alias("encoded"), C.zigzag_decode(encoded).alias("decoded"))


@query(
    "c08_c11_base_texts",
    """WITH b AS (SELECT item_id, text, encode(text) AS d, octet_length(encode(text)) AS n FROM benchmark),
x AS (SELECT *, list_transform(range(0, n), lambda i: ('0x' || hex(d)[2*i+1:2*i+2])::INTEGER) AS v FROM b),
c AS (SELECT *, (n * 8 + 4) // 5 AS chars FROM x)
SELECT item_id, hex(d) AS base16, base64(d) AS base64, translate(base64(d), '+/', '-_') AS base64url,
 rpad(array_to_string(list_transform(range(0, chars), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((((v[i*5//8+1] << 8) | coalesce(v[i*5//8+2], 0)) >> (11 - (i*5) % 8)) & 31) + 1]), ''), (((chars + 7) // 8) * 8)::INTEGER, '=') AS base32 FROM c""",
)
def base_texts(spark, sf_dir):
    data = C.utf8("text")
    return table(spark, sf_dir, "benchmark").select("item_id", C.to_base16(data).alias("base16"), C.to_base64(data).alias("base64"), C.to_base64url(data).alias("base64url"), C.to_base32(data).alias("base32"))


@query("c09_c10_radix_round_trip", "SELECT item_id, hex(encode(text)) AS from58, hex(encode(text)) AS from62, hex(encode(text)) AS from36, hex(encode(text)) AS from32, hex(encode(text)) AS from64 FROM benchmark")
def radix(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", C.utf8("text").alias("d"))
    rows = rows.select("item_id", C.to_radix("d", C.BASE58).alias("t58"), C.to_radix("d", C.BASE62).alias("t62"), C.to_radix("d", C.BASE36).alias("t36"), C.to_base32("d").alias("t32"), C.to_base64("d").alias("t64"))
    return rows.select(
        "item_id",
        *(F.hex(C.from_radix(f"t{n}", alphabet)).alias(f"from{n}") for n, alphabet in ((58, C.BASE58), (62, C.BASE62), (36, C.BASE36))),
        F.hex(C.from_base("t32", C.BASE32, padding="require")).alias("from32"),
        F.hex(C.from_base("t64", C.BASE64)).alias("from64"),
    )


@query(
    "c12_base_sizes",
    """SELECT doc_id, (2 * n)::BIGINT AS base16, (((n * 8 + 4) // 5 + 7) // 8 * 8)::BIGINT AS base32, (((n * 8 + 5) // 6 + 3) // 4 * 4)::BIGINT AS base64, ((n * 6) // 8)::BIGINT AS from64 FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""",
)
def base_sizes(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(C.encoded_size(n, a).alias(x) for x, a in (("base16", C.BASE16), ("base32", C.BASE32), ("base64", C.BASE64))), C.decoded_size(n, C.BASE64).alias("from64"))


@query("c14_c15_deflate_round_trip", "SELECT page_id, sha256(html) AS raw, sha256(html) AS zlib, sha256(html) AS gzip, octet_length(encode(html))::BIGINT AS stored_less_5 FROM pages")
def deflate(spark, sf_dir):
    containers = {"raw": 9, "zlib": 6, "gzip": 2}
    pack = C.kernels({c: C.deflater(c, level) for c, level in containers.items()} | {"stored": C.deflater("raw", 0)}, "binary", True)
    back = C.kernels({c: C.inflater() for c in containers}, "binary", True)
    rows = table(spark, sf_dir, "pages").select("page_id", C.utf8("html").alias("d"))
    rows = rows.select("page_id", pack("d").alias("p"), F.octet_length("d").alias("n"))
    rows = rows.select("page_id", back(*(F.col(f"p.{c}") for c in containers)).alias("b"), F.octet_length("p.stored").alias("stored"), "n")
    blocks = F.greatest(F.ceil(F.col("n") / 65535), F.lit(1)) * 5
    return rows.select("page_id", *(F.sha2(f"b.{c}", 256).alias(c) for c in containers), F.when(F.col("stored") <= F.col("n") + blocks * 4, F.col("n").cast("long")).alias("stored_less_5"))


@query("c16_container", "SELECT page_id, 'raw' AS raw, 'zlib' AS zlib, 'gzip' AS gzip, (n + greatest((n + 65534) // 65535, 1) * 5 + 18)::BIGINT AS bound FROM (SELECT page_id, octet_length(encode(html)) AS n FROM pages)")
def container(spark, sf_dir):
    containers = ("raw", "zlib", "gzip")
    rows = table(spark, sf_dir, "pages").select("page_id", C.utf8("html").alias("d"))
    rows = rows.select("page_id", F.octet_length("d").alias("n"), C.kernels({c: C.deflater(c, 6) for c in containers}, "binary", True)("d").alias("p"))
    return rows.select("page_id", *(C.detect_container(f"p.{c}").alias(c) for c in containers), C.compress_bound("n").alias("bound"))


@query("c19_gzip_metadata", "SELECT item_id, 'item-' || item_id AS name, 'text' AS comment, item_id AS mtime FROM benchmark")
def gzip_metadata(spark, sf_dir):
    import pandas as pd

    @F.pandas_udf("binary")
    def member(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([C.gzip_member(t.encode(), f"item-{i}", "text", i, header_crc=True) for i, t in zip(ids, texts, strict=True)], dtype=object)

    rows = table(spark, sf_dir, "benchmark").select("item_id", C.gzip_info(member("item_id", "text")).alias("info"))
    return rows.select("item_id", "info.name", "info.comment", "info.mtime")


@query(
    "c25_flat_buffer",
    "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag, l_partkey AS part, (4 + 8 + 4 + octet_length(encode(l_returnflag)) + 8)::BIGINT AS size FROM lineitem",
)
def flat_buffer(spark, sf_dir):
    kinds = ["int32", "double", "string", "int64"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", C.pack_fields(["l_linenumber", "l_quantity", "l_returnflag", "l_partkey"], kinds).alias("d"))
    fields = C.unpack_fields("d", kinds, "line int, quantity double, flag string, part long")
    rows = rows.select("l_orderkey", F.octet_length("d").cast("long").alias("size"), fields.alias("f"))
    return rows.select("l_orderkey", F.col("f.line").alias("l_linenumber"), "f.quantity", "f.flag", "f.part", "size")


@query(
    "c26_byte_search",
    """SELECT p_partkey, nullif(instr(p_name, 'e'), 0) - 1 AS first_e, CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') END AS last_e,
  (length(p_name) - length(replace(p_name, 'e', '')))::BIGINT AS n_e, p_name[1:4] AS head FROM part""",
)
def byte_search(spark, sf_dir):
    d, e = C.utf8("p_name"), F.lit("e").cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", C.find_bytes(d, e).cast("long").alias("first_e"), C.rfind_bytes(d, e).cast("long").alias("last_e"), C.count_bytes(d, e).alias("n_e"), F.decode(C.sub_bytes(d, 0, 4), "UTF-8").alias("head"))


@query("c27_c28_hex_base64", "SELECT item_id, lower(hex(encode(text))) AS hex, text AS from_hex, text AS from_base64 FROM benchmark")
def hex_base64(spark, sf_dir):
    d = C.utf8("text")
    return table(spark, sf_dir, "benchmark").select("item_id", C.to_hex(d).alias("hex"), F.decode(C.from_hex(C.to_hex(d, True, ":")), "UTF-8").alias("from_hex"), F.decode(F.unbase64(C.to_base64(d)), "UTF-8").alias("from_base64"))


@query("c14_strategies", "SELECT page_id, 0::BIGINT AS stored, 1::BIGINT AS fixed, 2::BIGINT AS dynamic, sha256(html) AS from_stored, sha256(html) AS from_fixed, sha256(html) AS from_dynamic FROM pages")
def strategies(spark, sf_dir):
    """The kind of the first block of each strategy's stream, and what the streams hold."""
    names = ("stored", "fixed", "dynamic")
    rows = table(spark, sf_dir, "pages").select("page_id", C.kernels({n: C.deflater("raw", 6, n) for n in names}, "binary", True)(C.utf8("html")).alias("p"))
    kind = lambda n: F.shiftright(F.conv(F.hex(F.substring(f"p.{n}", 1, 1)), 16, 10).cast("long"), 1).bitwiseAND(F.lit(3).cast("long"))
    back = C.kernels({n: C.inflater("raw") for n in names}, "binary", True)(*(F.col(f"p.{n}") for n in names))
    rows = rows.select("page_id", *(kind(n).alias(n) for n in names), back.alias("b"))
    return rows.select("page_id", *names, *(F.sha2(f"b.{n}", 256).alias(f"from_{n}") for n in names))


@query("c17_c18_chunks", "SELECT page_id, sha256(html) AS sha256, ((length(html) + 499) // 500)::BIGINT AS chunks FROM pages")
def chunks(spark, sf_dir):
    """Pages in chunks, through a compressor and a decompressor chunk by chunk, and together again."""
    page = table(spark, sf_dir, "pages").select("page_id", "html", F.posexplode(F.sequence(F.lit(0), F.floor((F.length("html") - 1) / 500))).alias("number", "_"))
    parts = page.select("page_id", "number", C.utf8(F.substring("html", F.col("number") * 500 + 1, F.lit(500))).alias("data"))
    back = inflate_chunks(deflate_chunks(parts, "page_id", "number", "data"), "page_id", "number", "data")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("number", F.lit(1 << 30)).alias("n"), F.hex("data").alias("d")))), lambda x: x["d"]), "")
    return back.groupBy("page_id").agg(F.sha2(F.unhex(whole), 256).alias("sha256"), F.count("number").alias("chunks"))
