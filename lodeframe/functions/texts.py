"""Versions, INI documents, patterns, Huffman codes and LZ77 tokens."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_version(text, strict: bool = True) -> Column:
    """``(major, minor, patch, build)``, which sorts as versions do. Strict texts have 1, 2, 3 and 3 digits at least; lax ones four numbers or
    more, of which the first four count. Anything else is all 0."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"^(\d+)\.(\d{2,})\.(\d{3,})\.(\d{3,})$" if strict else r"^(\d+)\.(\d+)\.(\d+)\.(\d+)(?:\.\d+)*$"
    parts = [F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("long"), F.lit(0).cast("long")) for i in range(1, 5)]
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("major", "minor", "patch", "build"), strict=True)))


def format_version(v: Column) -> Column:
    return F.format_string("%d.%02d.%03d.%03d", v["major"], v["minor"], v["patch"], v["build"])


def ini_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, section, name, value)`` of INI texts, a row a document: the last assignment counts; keys before any section are left out.

    A document is taken apart within its row, in time linear in its lines but for a sort of its assignments; nothing is shuffled."""
    blank = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    lines = F.filter(F.transform(F.split(text, "\r?\n"), blank), lambda line: ~line.rlike("^(?:[;#].*)?$"))
    marked = docs.select(key, lines.alias("_lines"))
    at = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(r"^\[.*\]$"), i)), lambda i: i.isNotNull())
    marked = marked.select(key, "_lines", at.alias("_heads"))
    # A section is the lines between its head and the next one.
    lines_of = lambda head, k: F.slice(F.col("_lines"), head + 2, F.coalesce(F.get("_heads", k + 1), F.size("_lines")) - head - 1)
    section = lambda head: F.regexp_extract(F.get("_lines", head), r"^\[(.*)\]$", 1)

    def pair(name: Column, line: Column, n: Column) -> Column:
        cut = F.instr(line, "=")
        return F.struct(name.alias("section"), blank(F.substring(line, F.lit(1), cut - 1)).alias("name"), n.alias("n"), blank(F.substring(line, cut + 1, F.length(line))).alias("value"))

    parts = marked.select(key, F.transform("_heads", lambda head, k: F.struct(section(head).alias("section"), head.alias("n"), lines_of(head, k).alias("lines"))).alias("_parts"))
    pairs = F.flatten(F.transform("_parts", lambda p: F.transform(F.filter(p["lines"], lambda line: F.instr(line, "=") > 0), lambda line, i: pair(p["section"], line, p["n"] + i))))
    ordered = parts.select(key, F.sort_array(pairs).alias("_pairs"))
    last = F.filter("_pairs", lambda x, i: F.coalesce((F.get("_pairs", i + 1)["section"] != x["section"]) | (F.get("_pairs", i + 1)["name"] != x["name"]), F.lit(True)))
    return ordered.select(key, F.explode(last).alias("_pair")).select(key, "_pair.section", "_pair.name", "_pair.value")


def ini_text(rows: DataFrame, key: str) -> DataFrame:
    """One INI text a key, sections and names in order. The rows of a key meet in one shuffle."""
    lines = rows.groupBy(key).agg(F.collect_list(F.struct("section", F.concat("name", F.lit("="), "value").alias("line"))).alias("_lines"))
    lines = lines.select(key, F.sort_array("_lines").alias("_lines"))

    def part(x: Column, i: Column) -> Column:
        """A line, behind its section's head if it is the first one. Lines that are NULL stand first and give a head alone if there is no other."""
        before, after = F.when(i > 0, F.get("_lines", i - 1)), F.get("_lines", i + 1)
        head = F.concat(F.lit("["), x["section"], F.lit("]\n"))
        alone = x["line"].isNull() & (after.isNull() | ~after["section"].eqNullSafe(x["section"]))
        first = before.isNull() | ~before["section"].eqNullSafe(x["section"]) | before["line"].isNull()
        return F.when(alone, head).when(x["section"].isNotNull(), F.when(first, F.concat(head, x["line"])).otherwise(x["line"]))

    return lines.select(key, F.array_join(F.transform("_lines", part), "\n").alias("text"))


def first_match(value: Column, cases: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]], otherwise: Column | None = None) -> Column:
    """What the first case with a true test makes of the value; without any, ``otherwise``, or an error."""
    out = None
    for test, action in cases:
        out = F.when(test(value), action(value)) if out is None else out.when(test(value), action(value))
    return out.otherwise(F.raise_error(F.lit("no pattern matches")) if otherwise is None else otherwise)


def all_matches(value: Column, cases: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> Column:
    """The actions of all cases with a true test, in order, as an array."""
    return F.array_compact(F.array(*(F.when(test(value), action(value)) for test, action in cases)))


def within(low, high, closed: str = "both") -> Callable[[Column], Column]:
    """A range test, closed at "both" ends, at "left", at "right" or at "neither"."""
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError("closed is one of both, left, right and neither")
    return lambda v: ((v >= low) if closed in ("both", "left") else (v > low)) & ((v <= high) if closed in ("both", "right") else (v < high))


# Huffman codes.


def symbol_counts(rows: DataFrame, by: str, text: str) -> DataFrame:
    """``(by, symbol, freq)``: characters counted with partial sums before the shuffle."""
    symbols = rows.select(by, F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("symbol"))
    return symbols.groupBy(by, "symbol").agg(F.count("*").alias("freq"))


def huffman_depths(freqs: list[int], arity: int = 2) -> list[int]:
    """Code lengths of least weighted sum; a lone symbol has length 1."""
    if len(freqs) == 1:
        return [1]
    order = count()
    heap = [(f, next(order), [i]) for i, f in enumerate(freqs)]
    heap += [(0, next(order), []) for _ in range(-(len(freqs) - 1) % (arity - 1))] if arity > 2 else []
    heapq.heapify(heap)
    depths = [0] * len(freqs)
    while len(heap) > 1:
        parts = [heapq.heappop(heap) for _ in range(min(arity, len(heap)))]
        members = [i for p in parts for i in p[2]]
        for i in members:
            depths[i] += 1
        heapq.heappush(heap, (sum(p[0] for p in parts), next(order), members))
    return depths


def limited_depths(freqs: list[int], most: int) -> list[int]:
    """Binary code lengths of least weighted sum up to ``most`` bits, by merging of packages."""
    n = len(freqs)
    if n > 1 << most:
        raise ValueError("too many symbols for the depth")
    if n == 1:
        return [1]
    leaves = sorted((f, [i]) for i, f in enumerate(freqs))
    level: list = []
    for _ in range(most):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(leaves + pairs, key=lambda p: p[0])
    depths = [0] * n
    for _, members in level[: 2 * n - 2]:
        for i in members:
            depths[i] += 1
    return depths


def canonical_codes(depths: dict[str, int]) -> dict[str, str]:
    """Codes in order of length and symbol."""
    code, last, out = 0, 0, {}
    for symbol, depth in sorted(depths.items(), key=lambda x: (x[1], x[0])):
        code <<= depth - last
        if code >> depth:
            raise ValueError("these lengths are of no tree")
        out[symbol], code, last = f"{code:0{depth}b}", code + 1, depth
    return out


def huffman_table(counts: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """``(by, symbol, freq, depth, code)``: one code a group, built where the group's small table of symbols is."""
    kind = counts.schema[by].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["freq", "symbol"])
        freqs = [int(f) for f in group["freq"]]
        depths = limited_depths(freqs, most) if most else huffman_depths(freqs)
        codes = canonical_codes(dict(zip(group["symbol"], depths, strict=True)))
        return group.assign(depth=depths, code=[codes[s] for s in group["symbol"]])[[by, "symbol", "freq", "depth", "code"]]

    return counts.groupBy(by).applyInPandas(run, f"{by} {kind}, symbol string, freq long, depth int, code string")


def code_statistics(table: DataFrame, by: str) -> DataFrame:
    """Per code: entropy in bits, weighted path length, average length, efficiency, Kraft sum, greatest depth and leaves."""
    total = F.sum("freq")
    entropy = F.log2(total.cast("double")) - F.sum(F.col("freq") * F.log2(F.col("freq").cast("double"))) / total
    weighted = F.sum(F.col("freq") * F.col("depth"))
    rows = table.groupBy(by).agg(entropy.alias("entropy"), weighted.alias("weighted_length"), (weighted / total).alias("average_length"), F.sum(F.pow(F.lit(2.0), -F.col("depth"))).alias("kraft_sum"), F.max("depth").alias("max_depth"), F.count("*").alias("leaves"))
    return rows.withColumn("efficiency", F.col("entropy") / F.col("average_length"))


def encode_symbols(text: str, codes: dict[str, str]) -> str:
    try:
        return "".join(codes[c] for c in text)
    except KeyError as e:
        raise ValueError(f"no code for {e.args[0]!r}") from None


def decode_symbols(bits: str, codes: dict[str, str]) -> str:
    back, out, held = {v: k for k, v in codes.items()}, [], ""
    for b in bits:
        held += b
        if held in back:
            out.append(back[held])
            held = ""
    if held:
        raise ValueError("the bits end within a code")
    return "".join(out)


def tree_text(codes: dict[str, str]) -> str:
    """A code's tree in preorder: I before two subtrees, L before a leaf's symbol. Frequencies aren't kept."""
    back = {v: k for k, v in codes.items()}

    def walk(prefix: str) -> str:
        return f"L{back[prefix]}" if prefix in back else "I" + walk(prefix + "0") + (walk(prefix + "1") if any(c.startswith(prefix + "1") for c in back) else "")

    return walk("")


def tree_codes(text: str) -> dict[str, str]:
    """The codes of a tree in preorder; a lone leaf below one branch has code 0."""
    at, out = 0, {}

    def walk(prefix: str) -> None:
        nonlocal at
        if at >= len(text):
            if prefix == "1":  # the missing half of a one-symbol tree
                return
            raise ValueError("the tree ends too early")
        mark, at = text[at], at + 1
        if mark == "L":
            out[text[at]] = prefix
            at += 1
        elif mark == "I":
            walk(prefix + "0")
            walk(prefix + "1")
        else:
            raise ValueError(f"{mark!r} marks no node")

    walk("")
    return out


def sibling_property(table: dict[str, tuple[int, int]]) -> bool:
    """Whether ``symbol: (freq, depth)`` can be a Huffman code: no symbol lies deeper than a rarer one."""
    rows = sorted(table.values())
    return all(a[1] >= b[1] for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] < b[0])


# LZ77 with a window of 32768 bytes and matches of 3 to 258.

LEAST, MOST, SPAN = 3, 258, 32_768


def lz77_tokens(data: bytes, chain: int = 64, lazy: bool = False) -> list[tuple[int, int, int]]:
    """``(distance, length, literal)``; a literal has distance 0 and length 0. ``chain`` bounds how many earlier places are tried."""
    places: dict[bytes, list[int]] = {}

    def longest(i: int) -> tuple[int, int]:
        best, at = 0, 0
        for j in reversed(places.get(data[i : i + LEAST], [])[-chain:]):
            if i - j > SPAN:
                break
            n, most = 0, min(MOST, len(data) - i)
            while n < most and data[j + n] == data[i + n]:
                n += 1
            if n > best:
                best, at = n, i - j
        return (best, at) if best >= LEAST else (0, 0)

    def note(i: int) -> None:
        if i + LEAST <= len(data):
            places.setdefault(data[i : i + LEAST], []).append(i)

    out, i = [], 0
    while i < len(data):
        n, d = longest(i)
        note(i)
        if n and lazy and i + 1 < len(data) and longest(i + 1)[0] > n:
            n = 0
        if n:
            out.append((d, n, 0))
            for k in range(i + 1, i + n):
                note(k)
            i += n
        else:
            out.append((0, 0, data[i]))
            i += 1
    return out


def lz77_bytes(tokens: list[tuple[int, int, int]]) -> bytes:
    out = bytearray()
    for distance, length, literal in tokens:
        if not length:
            out.append(literal)
            continue
        if not 0 < distance <= len(out):
            raise ValueError("a match begins before the data")
        for _ in range(length):
            out.append(out[-distance])
    return bytes(out)


def lz77(rows: DataFrame, key: str, data: str, chain: int = 64, lazy: bool = False) -> DataFrame:
    """``(key, pos, distance, length, literal)`` of a BINARY column, a row a token."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, x in zip(batch[key], batch[data], strict=True):
                tokens = lz77_tokens(bytes(x or b""), chain, lazy)
                yield pd.DataFrame([(k, i, *t) for i, t in enumerate(tokens)], columns=[key, "pos", "distance", "length", "literal"])

    return rows.select(key, data).mapInPandas(run, f"{key} {kind}, pos long, distance int, length int, literal int")
