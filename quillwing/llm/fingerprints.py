"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OrderedBuckets, text_bytes, words

SAMPLES = 32
#: UTF-8 bytes of text in one ordered bucket.
BUCKET_BYTES = 4 << 20


def gamma_quantile(p: float) -> float:
    """x with 1 - (1 + x) exp(-x) = p: a quantile of Gamma(2, 1)."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < p else (low, mid)
    return (low + high) / 2


def gamma_tables() -> tuple[list[float], list[float]]:
    """Gamma(2, 1) in 256 even steps, and ln Gamma(2, 1) in 4 bands of 64 steps: band k is the k-th power of 1/16 of the least values."""
    r = [round(gamma_quantile((i + 0.5) / 256), 6) for i in range(256)]
    ln_c = []
    for band in range(4):
        high = 16.0**-band
        low = high / 16 if band < 3 else 0.0
        ln_c += [round(math.log(gamma_quantile(low + (high - low) * (i + 0.5) / 64)), 6) for i in range(64)]
    return r, ln_c


def sample_value(k: int, term: str = "term", log_weight: str = "log_weight") -> Column:
    """ln a of the k-th sample of a weighted term.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from the hash of (term, k):
    t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The value
    depends on S through t alone, so two documents' least values are equal just
    where they chose the same (term, t), with probability sum(min S) / sum(max S).
    The gamma variates come from tables of quantiles, indexed by bits of one hash.
    """
    r_table, c_table = gamma_tables()
    h = f"xxhash64({term}, {k})"
    r = f"get(array({','.join(f'{x}D' for x in r_table)}), cast({h} & 255 as int))"
    band = f"if(({h} & 3840) > 0, 0, if(({h} & 61440) > 0, 64, if(({h} & 983040) > 0, 128, 192)))"
    ln_c = f"get(array({','.join(f'{x}D' for x in c_table)}), {band} + cast(shiftright({h}, 20) & 63 as int))"
    b = f"(shiftrightunsigned({h}, 26) / 274877906944D)"
    return F.expr(f"{ln_c} - {r} * (floor({log_weight} / {r} + {b}) - {b} + 1D)")


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES, term: str = "term") -> DataFrame:
    """Columns keys, values (array of double): the least sample values of each key's weighted terms.

    ``terms`` has one row an occurrence; a term's weight is its count. Rows with
    a null term give a key without terms a signature (of nulls). Where ``terms`` is
    already dealt by some of the keys, nothing is shuffled.
    """
    weighed = terms.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("_n")).withColumn("log_weight", F.log(F.col("_n").cast("double")))
    values = [F.min(F.when(F.col(term).isNotNull(), sample_value(k, term))).alias(f"_v{k}") for k in range(samples)]
    found = weighed.groupBy(*keys).agg(*values)
    return found.select(*keys, F.array(*[F.col(f"_v{k}") for k in range(samples)]).alias("values"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures, which estimates generalised Jaccard similarity; two texts without terms are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (same / F.size(a)).cast("double")


def as_text(values: Column) -> Column:
    """A signature as hex digits, eight a sample."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Columns id_col, fingerprint (string), values: one row for each distinct id.

    Terms are the lower-cased words, weighted by their count over all rows of the
    id; null texts have none. Equal texts have equal fingerprints.
    """
    docs = df.select(id_col, F.transform(words(F.lower(F.coalesce(F.col(text_col), F.lit("")))), lambda w: F.xxhash64(w)).alias("_t"))
    found = signatures(docs.repartition(F.col(id_col)).select(id_col, F.explode_outer("_t").alias("term")), [id_col], samples)
    return found.select(id_col, as_text(F.col("values")).alias("fingerprint"), "values")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns _bucket, _rank, id, text, next_text, _guest: every row with the text after it in descending id order (after the last: the first).

    Rows are dealt once, into contiguous id buckets of about BUCKET_BYTES; each
    bucket's first row is also a guest at the end of the bucket before it, so no
    window spans buckets. Guests keep their place for later windows; drop rows
    with _guest at the end. Null ids come last; equal ids are ordered by text, descending.
    """
    _, total = text_bytes(df, text_col)
    buckets = OrderedBuckets(df, id_col, -(-total // BUCKET_BYTES))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets.id_col = "id"
    docs = docs.withColumn("_bucket", buckets.bucket())
    last = len(buckets.lows)
    nulls = docs.where("id is null").limit(1).count() > 0
    lowest = 0 if nulls or not last else 1
    highs = "array(" + ",".join(f"{x}L" if x >= 0 else f"(-{-x}L)" for x in buckets.highs) + ")"
    # The guest place of each bucket's greatest id: the bucket above it, or the lowest for the greatest of all.
    leads = F.expr(f"id = get({highs}, _bucket - 1)") if last else F.lit(False)
    guest = F.when(leads, F.when(F.col("_bucket") == last, F.lit(lowest)).otherwise(F.col("_bucket") + 1))
    if nulls:
        guest = F.when(F.col("id").isNull(), F.lit(min(1, last))).otherwise(guest)
    places = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.struct(guest.cast("int").alias("b"), F.lit(True).alias("g")))
    dealt = (
        docs.withColumn("_place", F.explode(places))
        .where("_place.b is not null")
        .select(F.col("_place.b").alias("_bucket"), F.col("_place.g").alias("_guest"), "id", "text")
        .repartition(max(1, last), "_bucket")
    )
    order = Window.partitionBy("_bucket").orderBy(F.col("_guest"), F.col("id").desc_nulls_last(), F.col("text").desc())
    return dealt.select("_bucket", F.row_number().over(order).alias("_rank"), "id", "text", F.lead("text").over(order).alias("next_text"), "_guest")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row an input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by as many (or all) of the next row's, in descending id order.
    Null texts are empty. All of it follows one exchange of the texts: terms,
    counts, samples and neighbours are grouped within the id buckets.
    """
    placed = with_next(df, id_col, text_col)
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 2) as int))"), F.coalesce(F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))"), F.lit("")))
    base = placed.select("_bucket", "_rank", "_guest", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    hashed = lambda c: F.transform(words(F.lower(F.col(c))), lambda w: F.xxhash64(w))
    sha = [F.conv(F.substring(F.sha2(F.col("edited"), 256), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    # What a row says of itself travels as single "terms" of kinds of their own, so that only numbers pass through the aggregations.
    facts = [F.col("id"), F.col("n_chars"), F.col("_guest").cast("long"), *sha]
    kinds = [(0, hashed("text")), (1, hashed("edited"))] + [(2 + i, F.array(x)) for i, x in enumerate(facts)]
    rows = base.select("_bucket", "_rank", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("terms")) for k, t in kinds])).alias("_x"))
    terms = rows.select("_bucket", "_rank", F.col("_x.kind").alias("kind"), F.explode_outer("_x.terms").alias("term"))
    keys = ["_bucket", "_rank", "kind"]
    weighed = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_n")).withColumn("log_weight", F.log(F.col("_n").cast("double")))
    sampled = F.col("term").isNotNull() & (F.col("kind") < 2)
    values = [F.min(F.when(sampled, sample_value(k))).alias(f"_v{k}") for k in range(samples)]
    each = weighed.groupBy(*keys).agg(F.max("term").alias("_fact"), *values)
    each = each.select(*keys, "_fact", F.array(*[F.col(f"_v{k}") for k in range(samples)]).alias("values"))
    fact = lambda k: F.max(F.when(F.col("kind") == 2 + k, F.col("_fact")))
    one = each.groupBy("_bucket", "_rank").agg(
        F.max(F.when(F.col("kind") == 0, F.col("values"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("values"))).alias("edited"),
        *[fact(k).alias(f"_f{k}") for k in range(len(facts))],
    )
    follows = Window.partitionBy("_bucket").orderBy("_rank")
    out = one.withColumn("_next", F.lead("own").over(follows)).where("_f2 = 0")
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"_f{3 + i}"))), 8, "0") for i in range(8)])
    return out.select(
        F.col("_f0").alias("doc_id"),
        F.col("_f1").alias("n_chars"),
        digest.alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("_next")).alias("near_next"),
    )
