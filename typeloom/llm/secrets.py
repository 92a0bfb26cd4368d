"""Operator 7: secret scans by fixed patterns and a randomness test battery, with SQL functions only.

Base spans are the matches of three patterns. The battery adds tokens that look random: each candidate token of
letters, digits and code signs gets the narrowest encoding that has all its characters (hex, base32 and base36 of one
case, base62, base64), and three statistics of it:

* chi-squared of its characters against a uniform alphabet;
* runs of character kinds (lower case, upper case, digit, sign), against the number that the kinds' shares give;
* serial correlation of neighbouring characters' codes.

Each gives a p-value under randomness; combined by Fisher's method they reject tokens that no random source would
write. A token that stays is a discovery if writing would hardly look so random: the p-value under writing combines
how low the chi-squared statistic is for the non-central distribution that the collision rate of written characters
gives, and how many the runs are for writing, which changes kind rarely. Both shrink with the token's length, so that
the false-discovery rule of Benjamini and Hochberg over a document's candidates asks short tokens for more evidence
than long ones, and documents with many candidates for more than those with one.

Only tokens with a letter and a digit are judged: of letters alone, writing without spaces is too common.

Offsets are code points, ends exclusive. Spark has no function for match positions: they are summed up from the pieces
of ``split`` and the matches of ``regexp_extract_all``, which agree for non-empty matches.

Defined cases: a null text is scanned as an empty one and has the hash of the empty string; repeated rows are scanned
each; an empty table gives an empty result; input columns are kept and the operator's own columns replace columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, swept, table

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGNED = 6
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Number of symbols and pattern of the encodings, narrowest first; any other token is judged as base64.
ENCODINGS = [(16.0, "^([0-9a-f]+|[0-9A-F]+)$"), (32.0, "^([a-z2-7]+|[A-Z2-7]+)$"), (36.0, "^([a-z0-9]+|[A-Z0-9]+)$"), (62.0, "^[A-Za-z0-9]+$")]
#: False-discovery level, and the combined p-value under randomness below which a token isn't random.
LEVEL, REJECT = 0.02, 0.001
#: In writing: rate at which characters collide (among hex digits, which words don't use alone, they do oftener), and
#: rate at which a character is of another kind than the one before it.
COLLIDE, COLLIDE_HEX, CHANGE = 0.07, 0.125, 0.12


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches whose group has at least ``least`` characters."""
    wholes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else wholes
    zipped = F.arrays_zip(between.alias("gap"), F.transform(wholes, F.length).alias("n"), values.alias("value"))
    kind = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{kind}>")

    def step(at: Column, m: Column):
        first = at + m["gap"]
        one = F.array(F.struct(first.alias("start"), (first + m["n"]).alias("end"), m["value"].alias("value")))
        keep = m["value"].isNotNull() & (F.length(m["value"]) >= least)
        return first + F.coalesce(m["n"], F.lit(0)), F.when(keep, one).otherwise(none)

    # most texts have no match: they skip the walk
    return F.when(text.rlike(pattern), swept(zipped, F.lit(0), step, kind)).otherwise(none)


def _tail(z: Column) -> Column:
    """Chance that a normal variable exceeds ``z``, by a logistic of a cubic; of at most five deviations either way."""
    z = F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _fisher(*p: Column) -> Column:
    """Fisher's combined p-value of two or three independent ones."""
    half = F.lit(0.0)
    for x in p:
        half = half - F.log(F.greatest(x, F.lit(1e-12)))
    return bound(half, lambda h: F.exp(-h) * (1 + h + (h * h / 2 if len(p) == 3 else 0)))


def _count(token: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(token, pattern, "")).cast("double")


def battery(token: Column) -> Column:
    """struct<p, steady>: the p-value against writing, and whether the three tests allow randomness."""
    n = F.length(token).cast("double")
    chars = F.split(token, "")
    size = lambda c: n - F.length(F.replace(token, c, F.lit("")))
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + size(c) * size(c))
    alphabet = F.lit(64.0)
    for symbols, pattern in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    kinds = F.translate(token, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "a" * 26 + "b" * 26 + "c" * 10 + "dddd")
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    shares = F.array(*(1 - _count(kinds, k) / n for k in "abcd"))
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")).cast("double")
    held = F.struct(n.alias("n"), squares.alias("squares"), alphabet.alias("of"), shares.alias("shares"), runs.alias("runs"), codes.alias("codes"))

    def tests(t: Column) -> Column:
        n, free = t["n"], t["of"] - 1
        chi = t["of"] / n * t["squares"] - n
        # its cube root is about normal
        uniform = (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        same = F.aggregate(t["shares"], F.lit(0.0), lambda a, s: a + s * s)
        runs = (t["runs"] - 1 - (n - 1) * (1 - same)) / F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(1.0)))
        moved = bound(F.aggregate(t["codes"], F.lit(0.0), lambda a, c: a + c) / n, lambda mean: F.transform(t["codes"], lambda c: c - mean))
        serial = bound(
            moved,
            lambda m: F.aggregate(F.zip_with(m, F.slice(m, 2, F.size(m)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, c: a + c)
            / F.greatest(F.aggregate(m, F.lit(0.0), lambda a, c: a + c * c), F.lit(1e-9))
            * F.sqrt(n),
        )
        random = _fisher(_tail(uniform), 2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial)))
        # writing: more collisions the longer it is, and few changes of kind
        far = (n - 1) * (t["of"] * F.when(t["of"] == 16.0, F.lit(COLLIDE_HEX)).otherwise(F.lit(COLLIDE)) - 1)
        low = (free + far - chi) / F.sqrt(2 * free + 4 * far)
        many = (t["runs"] - 1 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
        mixes = (t["shares"][2] > 0) & (t["shares"][2] < 1)
        return F.struct(_fisher(_tail(low), _tail(many)).alias("p"), (mixes & (random >= REJECT)).alias("steady"))

    return bound(held, tests)


def accepted(tested: Column) -> Column:
    """Benjamini-Hochberg over array<struct<start, end, p, steady>>: those up to the last p-value under its rising bound.

    The sorted array and the bound are each computed once a text."""
    ordered = F.array_sort(tested, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(a["start"] - b["start"]))

    def judged(some: Column) -> Column:
        rising = F.array_max(F.transform(some, lambda t, i: F.when(t["p"] <= LEVEL * (i + 1) / F.size(some), t["p"]).otherwise(-1.0)))
        return bound(rising, lambda most: F.filter(some, lambda t: (t["p"] <= most) & t["steady"]))

    return bound(ordered, judged)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, in one sweep by start: a token waits until the next one begins, for base
    spans can begin within it. Tokens don't overlap each other."""
    kind = "struct<start:int,end:int,value:string>"
    none, nothing = F.array().cast(f"array<{kind}>"), F.lit(None).cast(kind)
    item = lambda s, value: F.struct(s["start"].alias("start"), s["end"].alias("end"), value.cast("string").alias("value"))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("value")))
    every = F.concat(F.transform(tokens, lambda t: item(t, t["value"])), F.transform(base, lambda s: item(s, F.lit(None))))
    ordered = F.concat(F.array_sort(every, lambda a, b: a["start"] - b["start"]), last)

    def step(held: Column, s: Column):
        token, waits = s["value"].isNotNull(), held["token"]
        hit = s["start"] < waits["end"]
        after = F.when(token, F.when(s["start"] >= held["end"], s)).when(~hit, waits)
        made = F.when(token & waits.isNotNull(), F.array(waits)).otherwise(none)
        return F.struct(F.when(token, held["end"]).otherwise(F.greatest(held["end"], s["end"])).alias("end"), after.alias("token")), made

    return F.when(F.size(tokens) > 0, swept(ordered, F.struct(F.lit(0).alias("end"), nothing.alias("token")), step, kind)).otherwise(none)


def scan(docs: DataFrame, name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: array<struct<start, end, kind>> by start, then kind (its number in KINDS)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c != name]
    one, two, three, tokens, base, outside, tested = fresh(docs, "assign", "access", "hex", "tokens", "base", "outside", "tested")
    matched = docs.select(
        *own,
        spans(text, ASSIGN, 2, ASSIGNED).alias(one),
        spans(text, ACCESS).alias(two),
        spans(text, HEX).alias(three),
        spans(text, CANDIDATE).alias(tokens),
    )
    number = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    every = F.concat(*[number(F.col(c), k) for k, c in enumerate((one, two, three))])
    mixes = lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]")
    judged = F.transform(outside, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["value"]).alias("b")))
    out = matched.withColumn(base, every).withColumn(outside, apart(F.filter(tokens, mixes), F.col(base))).withColumn(tested, judged)
    flat = F.transform(tested, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["b"]["p"].alias("p"), t["b"]["steady"].alias("steady")))
    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return out.select(*own, F.array_sort(F.concat(base, number(accepted(flat), 3)), by_place).alias(name))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; n_chars follows. Rows without a span stay as they are."""
    name, fixed = fresh(docs, "found", "fixed")
    found, text = scan(docs, name), F.col("text")

    def step(at: Column, s: Column):
        kept = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        begins = F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit(""))
        return F.greatest(at, s["end"]), F.array(F.concat(kept, begins))

    parts = F.concat(swept(F.col(name), F.lit(0), step, "string"), F.array(F.substring(text, F.array_max(F.transform(name, lambda s: s["end"])) + 1, F.length(text))))
    changed = F.size(name) > 0
    out = found.withColumn(fixed, F.when(changed, F.array_join(parts, "")).otherwise(text))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(fixed).alias("text")
        if c == "n_chars":
            return F.when(changed, F.length(fixed).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return out.select(*map(column, docs.columns))


def op7_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
    )
