"""Secrets in texts: fixed patterns, and parts of credentials that belong together.

Everything is DataFrame functions. A pattern's places come from the texts between
its matches: their lengths and the matches' lengths, summed up in order, are the
starts. Equal texts are looked at once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written

# The patterns of the base kinds, in their order. Classes with a least
# length match the same stretches as their open forms whose short matches are dropped.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_ASSIGNED = 8

# Parts that mean something only together. Each pattern begins where a run of its
# characters begins, so no text makes it try every place of a long run.
IDENTIFIER = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}"
    r"""|(?<![A-Za-z0-9_])(?:access_key_id|client_id|user_?name|user|login|account)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@+-]{3,64}"""
)
LOOSE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
)
ENDPOINT = (
    r"""(?i)(?<![a-z0-9])(?:https?|jdbc:[a-z]{2,20}|postgres|mysql|mongodb|redis|amqp|ftp)://[^\x00-\x20"'<>]{3,}"""
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}"
)
# A blank line ends a scope.
BREAK = r"\n[\x20\t\r]*\n"

PATTERNS = {
    "assign": ASSIGN,
    "access": ACCESS,
    "hex": HEX,
    "identifier": IDENTIFIER,
    "loose": LOOSE,
    "endpoint": ENDPOINT,
    "break": BREAK,
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
# A text without one of these holds no part of a secret.
SIGNS = [ASSIGN, ACCESS, HEX, LOOSE]
# Characters of a bin of the join of parts with scopes; it changes no result.
BIN = 256


def gaps_and_hits(text: Column, kind: str) -> Column:
    """What a pattern finds: length of the text before each match, and the match."""
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x["gap"].alias("gap"), x["hit"].alias("hit")),
    )


def parts_of(found: DataFrame) -> DataFrame:
    """Parts of each text: ``text_key``, ``kind``, ``start``, ``end`` (code points)."""
    rows = found.select("text_key", F.explode("found").alias("f")).select("text_key", "f.*")
    order = Window.partitionBy("text_key", "kind").orderBy("no")
    before = F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(order)
    rows = rows.withColumn("end", before.cast("long")).where("hit IS NOT NULL")
    rows = rows.withColumn("start", F.col("end") - F.length("hit"))
    # A short assigned value is no find by itself, but may be part of one.
    value = F.length(F.regexp_extract("hit", ASSIGN, 2))
    short = (F.col("kind") == "assign") & (value < LEAST_ASSIGNED)
    return rows.where(~short | (value >= 4)).select(
        "text_key", F.when(short, "loose").otherwise(F.col("kind")).alias("kind"), "start", "end"
    )


def order_of(kind: Column) -> Column:
    names = [*BASE, "identifier", "endpoint", "loose"]
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in names]), kind), F.lit(0))


def scopes_of(parts: DataFrame) -> DataFrame:
    """Stretches of the texts between blank lines: ``text_key``, ``low``, ``high`` (exclusive)."""
    breaks = F.collect_list(F.when(F.col("kind") == "break", F.col("end")))
    edges = F.concat(F.array(F.lit(0).cast("long"), F.max("end")), breaks)
    texts = parts.groupBy("text_key").agg(F.array_sort(F.array_distinct(edges)).alias("edges"))
    between = F.arrays_zip(
        F.slice("edges", F.lit(1), F.size("edges") - 1).alias("low"),
        F.slice("edges", F.lit(2), F.size("edges") - 1).alias("high"),
    )
    return texts.select("text_key", F.explode(between).alias("s")).select("text_key", "s.*")


def in_scopes(parts: DataFrame, scopes: DataFrame) -> DataFrame:
    """The parts with ``low`` of the scope that they lie in: an interval join by bins."""
    bins = F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))
    binned = scopes.withColumn("bin", F.explode(bins))
    pairs = parts.withColumn("bin", F.floor(F.col("start") / BIN)).join(binned, ["text_key", "bin"])
    return pairs.where((F.col("low") <= F.col("start")) & (F.col("start") < F.col("high"))).drop("bin", "high")


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary one anywhere in the same scope.

    A secret is complemented by an identifier or an endpoint, and these by a secret.
    Base finds count as identifiers (access) and secrets (assign, hex). A loose secret
    inside an endpoint is a stretch of its address: only an identifier complements it,
    and then the endpoint belongs to the two. What roles a scope holds is gathered
    first, so no pairs are made, however many parts a scope has.
    """
    running = Window.partitionBy("text_key").orderBy("start", order_of(F.col("kind")), "end")
    upto = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("kind")

    def reached(which: Column) -> Column:
        return F.coalesce(F.max(F.when(which, F.col("end"))).over(upto) > F.col("start"), F.lit(False))

    placed = parts.withColumn("covered", reached(kind.isin(BASE))).withColumn("buried", reached(kind == "endpoint"))
    # What lies in a base find is that find.
    placed = placed.where((kind != "break") & (kind.isin(BASE) | ~F.col("covered")))
    role = (
        F.when(kind.isin("access", "identifier"), "id")
        .when(kind == "endpoint", "place")
        .when((kind == "loose") & F.col("buried"), "buried")
        .otherwise("secret")
    )
    placed = placed.select("text_key", "kind", "start", "end", role.alias("role"))
    placed = in_scopes(placed, scopes_of(parts))
    roles = placed.groupBy("text_key", "low").agg(
        *[F.max(F.col("role") == r).alias(f"has_{r}") for r in ("id", "place", "secret", "buried")]
    )
    together = (
        F.when(F.col("role") == "id", F.col("has_secret") | F.col("has_buried"))
        .when(F.col("role") == "place", F.col("has_secret") | F.col("has_id") & F.col("has_buried"))
        .when(F.col("role") == "buried", F.col("has_id"))
        .otherwise(F.col("has_id") | F.col("has_place"))
    )
    weak = placed.where(~kind.isin(BASE)).join(roles, ["text_key", "low"])
    return weak.where(together).select("text_key", "kind", "start", "end")


def has_signs(text: Column) -> Column:
    return reduce(or_, [text.rlike(sign) for sign in SIGNS])


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """The documents with ``text_key``, the digest of a text with signs of a secret."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn("text_key", F.when(has_signs(value), F.sha2(value, 256)))


def scanned(docs: DataFrame, text: str) -> DataFrame:
    """``keyed`` documents without their texts, with what the patterns find."""
    found = F.concat(*[gaps_and_hits(F.col(f"`{text}`"), kind) for kind in KINDS])
    found = F.when(F.col("text_key").isNotNull(), found)
    return written(keyed(docs, text).withColumn("found", found).drop(text), "scanned")


def spans_of(scan: DataFrame) -> DataFrame:
    """All finds: ``text_key``, ``kind``, ``start``, ``end`` and whether of a ``base`` kind."""
    texts = scan.where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("found").alias("found"))
    parts = written(parts_of(texts), "parts")
    base = parts.where(F.col("kind").isin(BASE))
    return base.withColumn("base", F.lit(True)).unionByName(linked(parts).withColumn("base", F.lit(False)))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Finds of every document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_spans`` and ``spans`` (arrays of ``kind:start:end`` by start, then kind).

    Starts and ends count code points, the end is exclusive. The base kinds stand for
    themselves; identifiers, endpoints and loose secrets (short assigned values, bare
    strings of letters and digits) are reported only where a secret and an identifier or
    endpoint are in one scope, the text between two blank lines. Null and empty texts hold nothing. Rows that repeat an id get a row
    each, and equal texts equal finds. Other columns are ignored.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scan = scanned(plain, "text")
    named = F.struct("start", order_of(F.col("kind")).alias("order"), "end", "kind", "base")

    def text_of(items: Column) -> Column:
        return F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    finds = spans_of(scan).groupBy("text_key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(named)).alias("all"),
    )
    finds = finds.select(
        "text_key", *[f"n_{k}" for k in BASE],
        text_of(F.filter("all", lambda s: s["base"])).alias("base_spans"), text_of(F.col("all")).alias("spans"),
    )
    empty = F.array().cast("array<string>")
    columns = [
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.coalesce("base_spans", empty).alias("base_spans"),
        F.coalesce("spans", empty).alias("spans"),
    ]
    # Documents without signs don't take part in the join: their key is null.
    with_signs = scan.where("text_key IS NOT NULL").select("doc_id", "text_key")
    with_signs = with_signs.join(written(finds, "finds"), "text_key", "left").select(*columns)
    nothing = scan.where("text_key IS NULL").select(
        "doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE], empty.alias("base_spans"), empty.alias("spans")
    )
    return with_signs.unionByName(nothing)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with ``mask`` in the place of every find; all columns stay.

    Finds that overlap or touch become one mask. The time for a text grows with its
    length times its finds.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = plain.columns[docs.columns.index(text)]
    spans = written(spans_of(scanned(plain.select(at), at)), "spans")
    order = Window.partitionBy("text_key").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached >= F.col("start"), 0).otherwise(1)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = runs.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    marked = keyed(plain, at)
    found = marked.where("text_key IS NOT NULL").join(written(cuts, "cuts"), "text_key", "left")
    lows = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"]))
    highs = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.length(at).cast("long")))
    kept = F.transform(
        F.arrays_zip(lows.alias("low"), highs.alias("high")),
        lambda s: F.substr(F.col(at), (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")),
    )
    found = found.withColumn(at, F.when(F.col("cuts").isNull(), F.col(at)).otherwise(F.array_join(kept, mask)))
    clean = marked.where("text_key IS NULL")
    return found.select(*plain.columns).unionByName(clean.select(*plain.columns)).toDF(*docs.columns)
