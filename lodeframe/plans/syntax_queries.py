"""Lexing of document texts and parsing of what part sizes spell."""

from pyspark.sql import functions as F

from lodeframe.functions import syntax as L
from lodeframe.plans.registry import query, table
from lodeframe.storage import kept

WORD, NUMBER, SPACE, REST = 1, 2, 3, 4


@query("x08_x09_lexer", "SELECT item_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, len(regexp_extract_all(text, '[ \n\t]+'))::BIGINT AS spaces FROM benchmark")
def lexer(spark, sf_dir):
    rules = L.Lexer([("[A-Za-z]+", WORD), ("[0-9]+", NUMBER), ("[ \\n\\t]+", SPACE)])
    rows = table(spark, sf_dir, "benchmark").select("item_id", L.lex(F.col("text"), rules, REST).alias("w"))
    return rows.select("item_id", *(F.size(F.filter(F.transform("w", lambda x: x["token"]), _is(k))).cast("long").alias(n) for n, k in (("words", WORD), ("numbers", NUMBER), ("spaces", SPACE))))


def _is(k: int):
    return lambda t: t == k


@query("x10_x12_parser", "SELECT p_partkey, p_size % 4 <> 3 AS accepted, CASE WHEN p_size % 4 <> 3 THEN 1 + 2 * (p_size % 4) + 1 + 2 * (p_size % 4) + 1 END::BIGINT AS events FROM part")
def parser(spark, sf_dir):
    """Sums ``n + n + ...``; the third kind ends on a plus and is no sum."""
    grammar = L.Parser([("sum", ["sum", "+", "n"]), ("sum", ["n"])])
    k = F.col("p_size") % 4
    tokens = F.when(k == 3, F.array(F.lit("n"), F.lit("+"))).otherwise(F.concat(F.array(F.lit("n")), F.flatten(F.array_repeat(F.array(F.lit("+"), F.lit("n")), k))))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", L.parse_events(tokens, grammar).alias("e"))
    accepted = F.element_at("e", -1)["event"] == "accept"
    return rows.select("p_partkey", accepted.alias("accepted"), F.when(accepted, F.size("e") + F.col("p_size") % 4).cast("long").alias("events"))


_TERMS = [("e", ["e", "+", "t"]), ("e", ["t"]), ("t", ["t", "*", "f"]), ("t", ["f"]), ("f", ["(", "e", ")"]), ("f", ["n"])]


@query(
    "x11_x12_loaded_parser",
    """SELECT p_partkey, p_size % 3 <> 2 AS accepted, [8, 11, 3][p_size % 3 + 1]::BIGINT AS reduced, [5, 7, 2][p_size % 3 + 1]::BIGINT AS shifted FROM part""",
)
def loaded_parser(spark, sf_dir):
    """``n + n * n``, ``( n + n ) * n`` and the wrong ``n + * n``, by a parser whose table went through a written DataFrame."""
    rows = L.Parser(_TERMS).to_rows()
    saved = kept(spark.createDataFrame(rows, "state int, symbol string, action string, number int"))
    parser = L.Parser.from_rows([tuple(r) for r in saved.collect()])  # a grammar's table, whatever the data
    forms = [F.split(F.lit(x), " ") for x in ("n + n * n", "( n + n ) * n", "n + * n")]
    kind = F.col("p_size") % 3
    tokens = F.when(kind == 0, forms[0]).when(kind == 1, forms[1]).otherwise(forms[2])
    found = table(spark, sf_dir, "part").select("p_partkey", F.transform(L.parse_events(tokens, parser), lambda x: x["event"]).alias("e"))
    number = lambda name: F.size(F.filter("e", lambda x: x == name)).cast("long")
    return found.select("p_partkey", (F.element_at("e", -1) == "accept").alias("accepted"), number("reduce").alias("reduced"), number("shift").alias("shifted"))
