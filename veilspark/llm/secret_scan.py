"""Secret scan by fixed patterns and a battery of randomness tests, in SQL
expressions only.

Candidates are long runs of key characters that mix character classes, also
behind a name and ``=``; of ``=`` itself only trailing padding belongs to a run.
The encoding is inferred from the characters (decimal, hexadecimal, base 32, base
36, base 62, base 64), which gives an alphabet. Under the hypothesis that the
symbols are independent and uniform over it, three tests are made:
chi-squared of the symbol counts, the number of runs above and below the
alphabet's middle, and the correlation of neighbours; their p-values are
combined by Fisher's method. Over all candidates of the table, hypotheses are
rejected by the Benjamini-Hochberg rule at ``FALSE_RATE``, with weights in
proportion to length, as long strings carry more evidence. What is not
rejected, and is long enough for its alphabet that text would have been, is
reported as kind ``random`` unless a fixed pattern covers it.

Positions are code points. Defined results: a null text counts as empty; a
text without matches has empty span lists; repeated rows are scanned each; no
candidates, no rejections; other input columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, settle, text_or_empty

_KEY = "A-Za-z0-9+/_.=-"
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([{_KEY}]+)"
ASSIGN_VALUE = 6
#: Greedy runs: a run is long enough, or no part of it is.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Base 32 pads with up to six characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,6}"

FALSE_RATE = 0.05
#: Bits of a uniform string from which on text would be told apart.
LEAST_BITS = 90.0
BINS = 512

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, characters that it may hold, alphabet in the order of its symbols
ENCODINGS = (
    ("decimal", "[0-9]", _DIGITS),
    ("hex", "[0-9a-f]", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]", _UPPER + "234567"),
    ("base36", "[0-9a-z]", _DIGITS + _LOWER),
    ("BASE36", "[0-9A-Z]", _DIGITS + _UPPER),
    ("base62", "[0-9A-Za-z]", _DIGITS + _UPPER + _LOWER),
    ("base64", "[0-9A-Za-z+/]", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[0-9A-Za-z_-]", _UPPER + _LOWER + _DIGITS + "-_"),
)

_SPAN = "array<struct<start:int,stop:int,match:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, stop, match>>.
    Matches are set between two control characters that no pattern here
    matches, and the pieces' lengths give the places."""
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    marked = F.regexp_replace(plain, f"(?<found>{pattern})", "\x01${found}\x02")
    pieces = F.split(marked, "[\x01\x02]")
    empty = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = (acc["at"] + F.length(piece)).cast("int")
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("stop"), piece.alias("match")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(F.contains(marked, F.lit("\x01")), F.aggregate(pieces, empty, step, lambda acc: acc["found"])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' matches by kind."""
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1))
    return {
        "assign": F.filter(spans(text, ASSIGN), lambda s: value(s) >= ASSIGN_VALUE),
        "access": spans(text, ACCESS),
        "hex": spans(text, HEX),
    }


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, by a logistic approximation (error < 0.0002)."""
    z = F.greatest(F.lit(-7.0), F.least(F.lit(7.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def symbols(token: Column) -> Column:
    """struct<encoding, size, values>: the first encoding that fits, the size
    of its alphabet, and the token's symbol numbers without padding."""
    bare = F.regexp_replace(token, "=+$", "")
    out = F.lit(None)
    for name, allowed, alphabet in reversed(ENCODINGS):
        fit = F.struct(F.lit(name).alias("encoding"), F.lit(len(alphabet)).alias("size"), _places(F.split(bare, ""), alphabet).alias("values"))
        out = F.when(bare.rlike(f"^{allowed}+$"), fit).otherwise(out)
    return out


def battery(size: Column, values: Column) -> Column:
    """Fisher's combined p-value of the three tests that the values are
    independent and uniform below ``size``."""
    n = F.size(values).cast("double")
    zero = F.lit(0.0)
    squares = F.aggregate(F.transform(F.array_distinct(values), lambda d: F.pow(F.size(F.filter(values, lambda v: v == d)).cast("double"), F.lit(2.0))), zero, lambda a, x: a + x)
    freedom = size - 1
    chi = squares * size / n - n
    # Wilson-Hilferty: the cube root is nearly normal
    chi_z = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))

    high = F.transform(values, lambda v: (v >= size / 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
    n2 = n - n1
    turns = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    expected = 2 * n1 * n2 / n + 1
    variance = F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / F.greatest(F.lit(1.0), n - 1))
    runs_z = (turns + 1 - expected) / F.sqrt(variance)

    mean = (size - 1) / 2
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: (a - mean) * (b - mean))
    covariance = F.aggregate(F.transform(pairs, lambda x: x.cast("double")), zero, lambda a, x: a + x)
    power = F.aggregate(F.transform(values, lambda v: F.pow((v - mean).cast("double"), F.lit(2.0))), zero, lambda a, x: a + x)
    serial_z = covariance / F.greatest(F.lit(1e-9), power) * F.sqrt(n)

    ps = [F.greatest(F.lit(1e-300), p) for p in (_upper_tail(chi_z), _two_sided(runs_z), _two_sided(serial_z))]
    half = -(F.log(ps[0]) + F.log(ps[1]) + F.log(ps[2]))
    # chi-squared with six degrees of freedom in closed form
    return F.exp(-half) * (1 + half + half * half / 2)


def _named(found: Column, order: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(KINDS[order]).alias("kind"), s["stop"].alias("stop")))


def _places(characters: Column, alphabet: str) -> Column:
    return F.filter(F.transform(characters, lambda c: F.instr(F.lit(alphabet), c) - 1), lambda v: v >= 0)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array<struct<start, order, kind, stop>>) and candidates
    (array<struct<start, stop, encoding, length, bits, p>>)."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    kinds = base_spans(F.col("text"))
    mixed = lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")
    rows = rows.select("doc_id", *(c.alias(k) for k, c in kinds.items()), F.filter(spans(F.col("text"), CANDIDATE), mixed).alias("found"))
    named = [_named(F.col(kind), order) for order, kind in enumerate(KINDS[:3])]
    read = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), symbols(s["match"]).alias("s")))
    rows = rows.select("doc_id", F.array_sort(F.concat(*named)).alias("base"), F.filter(read, lambda c: c["s"].isNotNull()).alias("read"))
    tested = F.transform("read", lambda c: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), c["s"]["encoding"].alias("encoding"),
        F.size(c["s"]["values"]).alias("length"), (F.size(c["s"]["values"]) * F.log2(c["s"]["size"].cast("double"))).alias("bits"),
        battery(c["s"]["size"].cast("double"), c["s"]["values"]).alias("p"),
    ))
    return rows.select("doc_id", "base", tested.alias("candidates"))


def _rejection_limit(tests: DataFrame) -> tuple[float, float]:
    """Mean length and the largest weighted p-value that Benjamini-Hochberg
    rejects, from counts in bins of log p (so to a bin's width)."""
    mean = tests.agg(F.avg("length")).first()[0]
    if mean is None:
        return 1.0, 0.0
    weighted = tests.select((F.col("p") * mean / F.col("length")).alias("q"))
    bin_ = F.least(F.lit(BINS - 1), F.floor(-4 * F.log(F.greatest(F.lit(1e-55), F.col("q"))))).cast("int")
    counts = {r["bin"]: r["n"] for r in weighted.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect()}
    total, below, limit = sum(counts.values()), 0, 0.0
    for b in sorted(counts, reverse=True):
        below += counts[b]
        edge = 2.718281828459045 ** (-b / 4)  # the bin's largest value
        if edge * total <= FALSE_RATE * below:
            limit = edge
    return mean, limit


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, both arrays of
    struct<start, order, kind, stop> by start and kind."""
    rows = settle(scanned(docs, id_col, text_col))
    tests = rows.select(F.explode("candidates").alias("c")).select("c.p", "c.length")
    mean, limit = _rejection_limit(tests)
    clear = lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    random = F.filter("candidates", lambda c: (c["p"] * mean / c["length"] > limit) & (c["bits"] >= LEAST_BITS) & (c["encoding"] != "decimal") & clear(c))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", _named(random, 3))).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
