"""Secret scans in DataFrame expressions: three base patterns, and a randomness test battery for other tokens.

Spans are code points, end exclusive. A pattern's matches are leftmost and non-overlapping; their places come from the
lengths of the gaps that ``split`` leaves and of the matches that ``regexp_extract_all`` finds.

Battery. A candidate is a whole run of 20 or more characters of ``[A-Za-z0-9+/_-]``, with one or two ``=`` where they end
it, that has a letter and a digit and that no base span touches (so of ``name=token`` the token alone). Its encoding is inferred (hex, base32, base64) and each symbol becomes its place in that alphabet.
Three tests ask whether the places look drawn at random: chi-squared against equal frequencies, Wald-Wolfowitz runs
about the alphabet's middle, and lag-one serial correlation. Fisher's method joins their p-values. Random tokens have
uniform joint p-values, ordinary ones heap near zero; how far depends on length. So in each stratum of encoding and
length the share of random tokens is estimated from the upper half of the p-values, and the cut is the lowest p at which
the estimated share of ordinary tokens among those above it is at most 5 %. The strata and p-values (in 100 steps) are
counted over the whole table, each different token once (copies are no independent draws), and hold for every occurrence;
the counts are a fixed number of rows.

Defined results: a null or empty text has no spans; each row is scanned by itself, so repeated rows and null ids are as
any other; spans of one start sort by kind; very long texts take time in proportion to their length and matches; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, running, running_sums

# Fixed values of the base scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more, which is what is left of all runs
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LENGTHS = (20, 24, 32, 48, 64, 128)
STEPS = 100
FALSE_SHARE = 0.05
_FAR = 2_147_483_647
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost non-overlapping matches. Only a text that has some is split for its gaps."""

    def spans(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g)), 1, F.size(found))

        def place(gap: Column) -> Column:
            before = running_sums(F.zip_with(gap, found, lambda g, v: g + F.char_length(v)))
            starts = F.zip_with(before, gap, lambda b, g: b + g)
            return F.zip_with(starts, found, lambda s, v: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(v)).alias("end"), v.alias("value"))).cast(_SPANS)

        return F.when(F.size(found) > 0, let(gaps, place)).otherwise(_none())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _apart(spans: Column, base: Column) -> Column:
    """The spans that no base span touches, in one pass over both by their starts."""
    both = F.array_sort(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s.alias("span"))), F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s.alias("span")))))

    def free(all_: Column) -> Column:
        other = lambda field, none: F.transform(all_, lambda x: F.when(x["own"] == 0, x["span"][field]).otherwise(F.lit(none)))
        reached = running(other("end", -1), F.greatest, F.lit(-1))
        ahead = F.reverse(running(F.reverse(other("start", _FAR)), F.least, F.lit(_FAR)))
        seen = F.zip_with(F.zip_with(reached, ahead, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), all_, lambda n, x: F.struct(n["r"].alias("r"), n["a"].alias("a"), x["own"].alias("own"), x["span"].alias("span")))
        kept = F.filter(seen, lambda x: (x["own"] == 1) & (x["r"] <= x["span"]["start"]) & (x["a"] >= x["span"]["end"]))
        return F.transform(kept, lambda x: x["span"])

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(both, free)).otherwise(spans)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, to 1e-7 (a published rational approximation)."""

    def tail(z: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(z))
        series = F.lit(0.0)
        for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
            series = (series + c) * t
        upper = F.exp(-z * z / 2) / 2.5066282746310002 * series
        return F.when(z >= 0, upper).otherwise(1 - upper)

    return let(z, tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def _encoding(token: Column) -> Column:
    return F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")


def _places(token: Column, kind: Column) -> Column:
    """The alphabet's size, and each symbol's place in it."""
    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    chars = F.split(F.when(kind == "hex", F.lower(bare)).otherwise(bare), "")
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    return let(alphabet, lambda a: F.struct(F.length(a).cast("double").alias("k"), F.transform(chars, lambda c: F.instr(a, c) - 1).alias("x")))


def _p_value(token: Column) -> Column:
    """The joint p-value of the three tests, under the hypothesis that the token is random in its encoding.

    Whatever is used more than once is a local name: an expression inside a lambda is evaluated at each use.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    pairs = lambda x, f: F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.size(x) - 1), f)

    def chi(x: Column, n: Column, k: Column) -> Column:
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
        df = k - 1
        return _normal_tail((F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    def runs(x: Column, n: Column, k: Column) -> Column:
        def of(high: Column) -> Column:
            counted = F.struct(total(high).alias("n1"), (1 + total(pairs(high, lambda a, b: (a != b).cast("double")))).alias("runs"))

            def test(c: Column) -> Column:
                product = 2 * c["n1"] * (n - c["n1"])
                var = product * (product - n) / (n * n * (n - 1))
                return F.when(var > 0, _two_sided((c["runs"] - product / n - 1) / F.sqrt(var))).otherwise(F.lit(1e-6))

            return let(counted, test)

        return let(F.transform(x, lambda v: (v * 2 >= k).cast("double")), of)

    def lag(x: Column, n: Column) -> Column:
        def test(c: Column) -> Column:
            return F.when(c["spread"] > 0, _two_sided((c["lag"] / c["spread"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-6))

        around = lambda y: F.struct(total(F.transform(y, lambda v: v * v)).alias("spread"), total(pairs(y, lambda a, b: a * b)).alias("lag"))
        return let(total(x) / n, lambda m: let(F.transform(x, lambda v: v - m), lambda y: let(around(y), test)))

    def joint(s: Column) -> Column:
        x, k = s["x"], s["k"]
        n = F.size(x).cast("double")
        three = F.array(chi(x, n, k), runs(x, n, k), lag(x, n))
        half = -total(F.transform(three, lambda p: F.ln(F.greatest(p, F.lit(1e-12)))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(token, lambda t: let(_encoding(t), lambda kind: let(_places(t, kind), joint)))


def _stratum(token: Column) -> Column:
    band = sum((F.length(token) >= n).cast("int") for n in LENGTHS[1:])
    return F.concat_ws("-", _encoding(token), band)


def _step(token: Column) -> Column:
    return F.least(F.lit(STEPS - 1), F.floor(_p_value(token) * STEPS)).cast("int")


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (sorted) and candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    second = lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8
    long = lambda s: F.char_length(s["value"]) >= 16
    base = docs.select(
        "doc_id", text.alias("text"), F.filter(_matches(text, ASSIGN, 0), second).alias("assign"), F.filter(_matches(text, ACCESS, 1), long).alias("access"), _matches(text, HEX, 2).alias("hex"),
    )
    spans = F.array_sort(F.concat("assign", "access", "hex"))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    runs = base.withColumn("base", spans).withColumn("runs", F.filter(_matches(F.col("text"), CANDIDATE, 3), mixed))
    return runs.withColumn("candidates", _apart(F.col("runs"), F.col("base"))).drop("text", "runs")


def cuts(docs: DataFrame) -> dict[str, int]:
    """For each stratum that has random tokens, the lowest step of p-values that is taken."""
    tokens = _scan(docs).select(F.explode("candidates.value").alias("token"))
    different = tokens.select(_stratum(F.col("token")).alias("stratum"), _step(F.col("token")).alias("step"), F.xxhash64("token").alias("token")).distinct()
    rows = different.groupBy("stratum", "step").agg(F.count("*").alias("n")).collect()  # at most 3 * 6 * STEPS rows
    found: dict[str, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        n = [0] * STEPS
        for r in rows:
            if r["stratum"] == stratum:
                n[r["step"]] += r["n"]
        random = min(sum(n), 2 * sum(n[STEPS // 2 :]))
        for cut in range(STEPS):
            above = sum(n[cut:])
            if above and above - random * (1 - cut / STEPS) <= FALSE_SHARE * above:
                found[stratum] = cut
                break
    return found


def find_secrets(docs: DataFrame, random_tokens: bool = True) -> DataFrame:
    """Per row: doc_id, spans (sorted structs start, kind, end, value) and base, the base spans alone."""
    docs = docs.select("doc_id", "text")
    found = cuts(docs) if random_tokens else {}
    scanned = _scan(docs)
    more = _none()
    if found:
        cut = F.create_map(*(F.lit(x) for pair in sorted(found.items()) for x in pair))
        more = F.filter("candidates", lambda s: _step(s["value"]) >= F.get(F.array(F.element_at(cut, _stratum(s["value"]))), F.lit(0)))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", more)))


def digests(found: DataFrame) -> DataFrame:
    """Digest columns of the spans."""
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
