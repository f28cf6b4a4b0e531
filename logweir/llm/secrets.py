"""Secret scans: fixed patterns plus sliding-window Shannon entropy over candidate strings, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds with their pattern and the characters they need (assign: in group 2).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
ASSIGN_VALUE = 12

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

#: Known harmless shapes: placeholders, plain sequences, UUIDs.
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0123456|abcdefg|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of a character class whose most random window of `window` characters has `bits` a character."""

    kind: str
    only: str
    bits: float


#: In order of preference: a candidate belongs to the first class that holds all its characters.
CLASSES = (
    EntropyClass("entropy_hex", r"^[0-9a-fA-F]+$", 3.05),
    EntropyClass("entropy_alnum", r"^[0-9A-Za-z]+$", 3.87),
    EntropyClass("entropy_base64", r"^[0-9A-Za-z+/_=-]+$", 3.87),
)
WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}+"

#: Matches of a text are placed in blocks of so many, so that placing n of them takes about n * sqrt(n) steps at most.
_BLOCK = 512


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """Array of struct(s, e, m): where each match stands, in code points.

    What stands between the matches comes from split() with the same pattern; running sums of both lengths are the
    positions. Sums run within blocks first and over blocks then."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    starts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    placed = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
    sums = F.aggregate(
        placed,
        F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])),
    )
    moved = F.zip_with(F.slice(sums, 1, F.size(placed)), placed, lambda o, b: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["m"].alias("m"))))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(F.size(matches) > 0, F.flatten(moved)).otherwise(none)


def _most_bits(text: Column) -> Column:
    """Largest Shannon entropy, in bits a character, of a window of WINDOW characters of an ASCII string.

    The counts of the window's characters and the sum of c * log2(c) go from window to window by the character that
    leaves and the one that enters; no window is counted anew."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)
    clog = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc, c):
        old = F.when(acc["i"] >= WINDOW, F.element_at(codes, acc["i"] - WINDOW + 1)).otherwise(F.lit(-1))
        n_old = F.when(old >= 0, F.get(acc["n"], old)).otherwise(F.lit(0))
        less = acc["s"] - clog(n_old) + clog(n_old - 1)
        n_new = F.get(acc["n"], c) - F.when(old == c, 1).otherwise(0)
        more = less - clog(n_new) + clog(n_new + 1)
        counts = F.transform(acc["n"], lambda x, k: x + F.when(k == c, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        bits = F.when(acc["i"] + 1 >= WINDOW, F.lit(WINDOW).cast("double")).otherwise(F.lit(None).cast("double"))
        now = F.log2(bits) - more / bits
        return F.struct(counts.alias("n"), (acc["i"] + 1).alias("i"), more.alias("s"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(codes, zero, step, lambda acc: acc["best"])


def _spans(placed: Column, kind: str) -> Column:
    return F.transform(placed, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def _in_class(i: int):
    """Predicate: the candidate's first fitting class is CLASSES[i] and its entropy suffices there."""

    def keep(x):
        out = F.rlike(x["m"], F.lit(CLASSES[i].only)) & (x["b"] >= CLASSES[i].bits)
        for c in CLASSES[:i]:
            out = out & ~F.rlike(x["m"], F.lit(c.only))
        return out

    return keep


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str = ALLOW) -> DataFrame:
    """One row for each input row: the id column and spans, an array of struct(start, end, kind, match), by start and
    then by kind in the order of KINDS. Positions are code points, ends exclusive.

    Base kinds are found leftmost and without overlap for each kind, on whole texts. Entropy kinds are added for
    candidate strings with letters and digits, unless `allow` matches them; base spans are never suppressed. A null or
    empty text has no spans. Repeated rows are scanned alike, very long texts whole; an empty table gives no rows;
    further columns are ignored. All work stays in the row, so nothing is shuffled."""
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    base = base.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in found.items()))
    base = base.withColumn("_m_assign_v", F.when(F.size("_m_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))))
    placed = {k: _placed(text, F.col(f"_m_{k}"), p) for k, p in found.items()}
    value = F.zip_with(placed["assign"], F.coalesce("_m_assign_v", F.array().cast("array<string>")), lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.length(v).alias("v")))
    assign = F.filter(value, lambda x: x["v"] >= ASSIGN_VALUE)
    likely = F.filter(placed["entropy"], lambda x: F.rlike(x["m"], F.lit("[0-9]")) & F.rlike(x["m"], F.lit("[A-Za-z]")) & ~F.rlike(x["m"], F.lit(allow)))
    base = base.select("_id", assign.alias("_assign"), placed["access"].alias("_access"), placed["hex"].alias("_hex"), likely.alias("_likely"))
    base = base.withColumn("_bits", F.transform("_likely", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _most_bits(x["m"]).alias("b"))))
    own = [_spans(F.filter("_bits", _in_class(i)), c.kind) for i, c in enumerate(CLASSES)]
    spans = F.concat(_spans(F.col("_assign"), "assign"), _spans(F.col("_access"), "access"), _spans(F.col("_hex"), "hex"), *own)
    names = F.array(*map(F.lit, KINDS))
    out = F.transform(F.array_sort(spans), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.get(names, x["k"]).alias("kind"), x["m"].alias("match")))
    return base.select(F.col("_id").alias(id_col), out.alias("spans"))
