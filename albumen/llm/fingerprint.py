"""Homomorphic multiset hash of a document's paragraphs. DataFrame functions only.

Each paragraph (a line, cut again after punctuation) is hashed to a wide vector, and a text's hash is the sum over its
paragraphs, lane by lane modulo a power of two: EQUAL lanes of whole hash words, which decide equality, and SIGNS lanes
of plus or minus one, whose inner products estimate how many paragraphs two texts share. A sum does not depend on order,
and a paragraph is put in or taken out by adding or subtracting its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

#: Lanes of hash words, each modulo 2 ** 32.
EQUAL = 4
#: Lanes of signs, each modulo 2 ** 20; three to a long.
SIGNS = 126
_LONGS = SIGNS // 3
_LANE = (1 << 20) - 1
#: The three lanes of a long, each modulo 2 ** 20 in its 21 bits.
_LANES = _LANE | _LANE << 21 | _LANE << 42
#: Paragraphs that are summed at once, so that no lane runs into the next one; a longer text is summed part by part.
PART = 1 << 20
_MARKS = "[\\n\\r]+|(?<=[.!?;:,|])\\s+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, _MARKS), lambda p: F.trim(p) != "")


def _vector(p: Column) -> tuple[list[Column], list[Column]]:
    """The hash words that a paragraph's equality lanes and sign lanes are made of."""
    return [F.xxhash64(F.lit(s), p) for s in range(EQUAL)], [F.xxhash64(F.lit(100 + s), p) for s in range(2)]


def sums(rows: DataFrame, keys: list[str], unit: str, part: str | None = None) -> DataFrame:
    """keys and the summed vector of the units: eq0.., s0.., n. A null unit adds nothing.

    part: a column that cuts the rows of a key into parts of PART units at most; without it, a key may not have more.
    """
    there = F.col(unit).isNotNull()
    whole, signs = _vector(F.col(unit))
    by = [*keys, *([part] if part else [])]
    hashed = rows.select(*by, there.alias("_there"), *[h.alias(f"_w{i}") for i, h in enumerate(whole)], *[h.alias(f"_h{i}") for i, h in enumerate(signs)])
    cols = [F.sum(F.when(F.col("_there"), F.col(f"_w{i}").bitwiseAND(0xFFFFFFFF)).otherwise(0)).bitwiseAND(0xFFFFFFFF).alias(f"eq{i}") for i in range(EQUAL)]
    spread = F.lit(1 | 1 << 21 | 1 << 42)
    for j in range(_LONGS):
        # bits j, j + 21 and j + 42 of a hash word are lanes of their own, apart by 21 places already
        h, at = F.col(f"_h{j // 21}"), j % 21
        cols.append(F.sum(F.when(F.col("_there"), F.shiftrightunsigned(h, at).bitwiseAND(spread)).otherwise(0)).alias(f"s{j}"))
    summed = hashed.groupBy(*by).agg(F.count(F.when(F.col("_there"), 1)).alias("n"), *cols)
    if not part:
        return summed
    # parts are added up lane by lane, each time modulo the lane's power, so that lanes stay within their bits
    names = ["n", *[f"eq{i}" for i in range(EQUAL)], *[f"s{j}" for j in range(_LONGS)]]
    lists = summed.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_parts"))
    one = F.size("_parts") == 1

    def total(name: str) -> Column:
        mask = _LANES if name[0] == "s" else 0xFFFFFFFF if name[0] == "e" else (1 << 63) - 1
        parts = F.aggregate("_parts", F.lit(0).cast("long"), lambda t, x: (t.bitwiseAND(mask) + x[name].bitwiseAND(mask)).bitwiseAND(mask))
        return F.when(one, F.get("_parts", F.lit(0))[name]).otherwise(parts).alias(name)

    return lists.select(*keys, *map(total, names))


def lanes(prefix: str = "") -> Column:
    """The sign lanes of summed columns: twice the ones less the count, as the residue modulo 2 ** 20 nearest to 0."""
    n = F.col(f"{prefix}n")
    half = (_LANE + 1) // 2
    part = lambda j, k: F.shiftrightunsigned(F.col(f"{prefix}s{j}"), 21 * k).bitwiseAND((1 << 21) - 1)
    return F.array(*[((2 * part(j, k) - n + half).bitwiseAND(_LANE) - half).cast("long") for j in range(_LONGS) for k in range(3)])


def text_form(prefix: str = "") -> Column:
    """The fingerprint as text: count, equality lanes and sign lanes, each modulo its power, in hex."""
    hexed = lambda c, width: F.lpad(F.lower(F.hex(c)), width, "0")
    eq = [hexed(F.col(f"{prefix}eq{i}"), 8) for i in range(EQUAL)]
    signs = F.array_join(F.transform(lanes(prefix), lambda v: hexed(v.bitwiseAND(_LANE), 5)), "")
    return F.concat(hexed(F.col(f"{prefix}n").bitwiseAND(0xFFFFFFFF), 8), *eq, signs)


def decode_lanes(fingerprint: Column) -> Column:
    """The sign lanes of a fingerprint's text form."""
    start = 8 * (1 + EQUAL)
    raw = F.transform(F.sequence(F.lit(0), F.lit(SIGNS - 1)), lambda i: F.conv(fingerprint.substr(i * 5 + start + 1, F.lit(5)), 16, 10).cast("long"))
    return F.transform(raw, lambda v: F.when(v > _LANE // 2, v - (_LANE + 1)).otherwise(v))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's put in (sign 1) or taken out (sign -1)."""
    hexed = lambda c, width: F.lpad(F.lower(F.hex(c.bitwiseAND((1 << 4 * width) - 1))), width, "0")
    field = lambda f, at, width: F.conv(f.substr(F.lit(at + 1), F.lit(width)), 16, 10).cast("long")
    heads = [hexed(field(a, 8 * i, 8) + sign * field(b, 8 * i, 8), 8) for i in range(1 + EQUAL)]
    signs = F.array_join(F.zip_with(decode_lanes(a), decode_lanes(b), lambda x, y: hexed(x + sign * y, 5)), "")
    return F.concat(*heads, signs)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Cosine of two lists of sign lanes, 0 to 1; 1 where the fingerprints are the same."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, at, doc_id, text, next_id, next): each row's follower by ascending id, the first row after the last.

    Rows are dealt to buckets between quantiles of the ids; the first row of each bucket is dealt to the one before it
    too, so one shuffle brings each row and its follower together. Repeated ids follow one another by text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    starts = sorted({got.low, *(got.cuts or [])}) if got.low is not None else [0]
    last = len(starts) - 1
    bucket = F.expr("aggregate(array(%s), -1, (n, s) -> n + if(s <= doc_id, 1, 0))" % ", ".join(f"{s}L" for s in starts))
    dealt = docs.filter("doc_id is not null").withColumn("bucket", bucket)
    # the whole group of a starting id goes along; only its first row is taken
    firsts = dealt.filter(F.col("doc_id").isin(starts)).groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
    ahead = firsts.select("doc_id", "text", F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("extra"))
    both = dealt.select("doc_id", "text", "bucket", F.lit(False).alias("extra")).unionByName(ahead)
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    out = both.withColumn("next", F.lead("text").over(order)).withColumn("next_id", F.lead("doc_id").over(order)).withColumn("at", F.row_number().over(order)).filter("not extra")
    return out.select("bucket", "at", "doc_id", "text", "next_id", "next")


def edited_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null text counts as empty. The edited text has the last n_chars / 4 code points, rounded down, replaced by the first
    as many (or all) of the next document by id; after the last comes the first. near_* are 0 to 1: 1 for equal
    fingerprints, 0 where either text has no paragraph. Rows with a null id take no part and give no row. Repeated rows
    give a row each. Texts of any length are summed in parts; above 2 ** 19 equal paragraphs lanes wrap, which leaves
    equality alone but blurs likeness. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    found = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    found = found.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next").substr(F.lit(1), cut)))
    key = F.xxhash64("text").alias("tk")
    kinds = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))
    keep = ["bucket", "at", "doc_id", "tk", "next_id", "nk", "n_chars", "edited_sha256"]
    base = found.select("bucket", "at", "doc_id", key, "next_id", F.xxhash64("next").alias("nk"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(kinds).alias("x"))
    base = base.select(*keep, F.col("x.v").alias("v"), F.col("x.t").alias("t"))  # apart, so that no paragraph carries its text along
    units = base.select(*keep, "v", F.posexplode_outer(paragraphs(F.col("t"))).alias("at_", "p")).withColumn("part", F.shiftright(F.coalesce("at_", F.lit(0)), PART.bit_length() - 1))
    made = store(_summed(units, keep), "fingerprints")
    side = made.select(F.col("doc_id").alias("next_id"), F.col("tk").alias("nk"), F.col("fingerprint").alias("next_fingerprint"), F.col("l0").alias("l2")).dropDuplicates(["next_id", "nk"])
    both = made.join(side, ["next_id", "nk"], "left")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("l0"), F.col("l1"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("l0"), F.col("l2"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )


def _summed(units: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each document with both texts' fingerprints."""
    total = sums(units, [*keep, "v"], "p", "part")
    form = total.select(*keep, "v", text_form().alias("f"), lanes().alias("l"))
    return form.groupBy(*keep).agg(*[F.max(F.when(F.col("v") == v, F.col(c))).alias(name) for v, c, name in ((0, "f", "fingerprint"), (1, "f", "edited_fingerprint"), (0, "l", "l0"), (1, "l", "l1"))])
