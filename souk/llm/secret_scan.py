"""Secret scans with multipart credential linking, in DataFrame functions only.

Parts of a text are marked by one regular-expression replacement per kind; splitting at
the marks gives match and gap lengths, whose running sum is the position in code points.

Strong kinds (``assign``, ``access``, ``hex``) are always reported. Weak candidates
(``ident``: an identifier assignment, ``opaque``: a long token with letters and digits or
cases mixed all through it, unlike words, slugs and UUIDs, ``endpoint``: a URL
or an IPv4 address) mean little alone. They are reported only if a complementary part
lies in the same scope: identifiers need a secret, secrets an identifier or an endpoint,
endpoints a secret other than a bare hexadecimal number (a commit, a checksum). An opaque token that shares characters with an identifier assignment or
an endpoint is its value or path and no second part, unless it lies in the user part of a
URL (``scheme://user:secret@host``). The interval join of parts within ``scope`` code points is done by
two ordered sweeps per text (furthest end so far, nearest start to come), so it needs
no pairs, whatever the number of parts.

Findings depend on the text alone, so equal texts are scanned into one row, keyed by hash.

Defined results: null and empty texts have no spans (the hash of no spans is that of the
empty string); repeated rows are reported each; an empty table gives no rows; extra
columns are ignored by ``scan`` and carried by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"     # marks; a text's own become OTHER

# (kind, pattern, least length of the match, strong); hexadecimal runs are maximal, so the
# least length may stand in the pattern
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
KINDS = [
    ("assign", ASSIGN, 0, True),
    ("access", r"AKIA[A-Z0-9]+", 18, True),
    ("hex", r"[0-9a-f]{16,}", 16, True),
    ("ident", r"(?<![A-Za-z0-9])(?i:(?:client|app|access|account|user|key)[_-]?id)[\"']?\x20*"
              r"[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", 0, False),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", 20, False),
    ("endpoint", r"(?<![A-Za-z0-9.])(?:[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D\"'<>]+"
                 r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.]*[0-9]))", 0, False),
]
USER = r"^[^:]+://[^/?#@]*@"                    # an endpoint up to its host, if it names a user
# an opaque token changes between small letters, capitals and digits inside its words
TURN = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9])"
NUMBER = r"(?<=[A-Za-z])[0-9]+|[0-9]+(?=[A-Za-z])"
LEAST_TURNS, LEAST_NUMBERS, LEAST_CHARACTERS = 4, 2, 10
NAMES = [k[0] for k in KINDS]
LEAST_SECRET = 12
SCOPE = 200


def text_hash(col: str) -> Column:
    return F.coalesce(F.md5(F.col(col)), F.md5(F.lit("")))


def _parts(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``carry, h, parts``: per row the pieces of every kind that occurs in its text."""
    t = docs.select(*carry, text_hash(text).alias("h"),
                    F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, OTHER * 2).alias("t"))
    marked = t.select(*carry, "h", *[
        F.split(F.regexp_replace("t", pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1).alias(name)
        for name, pattern, _, _ in KINDS])

    def pieces(k: int):
        name, _, least, _ = KINDS[k]

        def piece(p: Column, i: Column) -> Column:
            n = F.instr(p, CLOSE) - 1
            value = F.substring(p, F.lit(1), n)
            good = n >= least
            if name == "assign":
                good = F.length(F.regexp_extract(value, ASSIGN, 2)) >= LEAST_SECRET
            elif name == "opaque":
                good = (good & ~value.rlike("^[0-9a-fA-F-]+$")
                        & (F.regexp_count(value, F.lit(TURN)) >= LEAST_TURNS)
                        & (F.regexp_count(value, F.lit(NUMBER)) >= LEAST_NUMBERS)
                        & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS))
            secret = value.rlike("[a-f]") if name == "hex" else F.lit(True)
            user = F.length(F.regexp_extract(value, USER, 0)) if name == "endpoint" else F.lit(0)
            return F.struct(F.lit(k).alias("k"), i.alias("i"),
                            (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("long").alias("step"),
                            n.cast("long").alias("n"), (good & (i > 0)).alias("good"),
                            secret.alias("secret"), user.cast("long").alias("user"))

        return F.when(F.size(name) > 1, F.transform(name, piece)).otherwise(
            F.array().cast("array<struct<k:int,i:int,step:bigint,n:bigint,good:boolean,secret:boolean,user:bigint>>"))

    return marked.select(*carry, "h", F.flatten(F.array(*[pieces(k) for k in range(len(KINDS))])).alias("parts"))


def _spans(parts: DataFrame, scope: int) -> DataFrame:
    """``h, k, start, end`` (end exclusive) of everything reported in a text."""
    rows = (parts.where(F.size("parts") > 0).dropDuplicates(["h"])
            .select("h", F.explode("parts").alias("p")).select("h", "p.*"))
    at = Window.partitionBy("h", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    found = (rows.withColumn("start", F.coalesce(F.sum("step").over(at), F.lit(0)))
             .where("good").withColumn("end", F.col("start") + F.col("n")))
    strong = F.col("k") < 3
    identifier = F.col("k").isin(NAMES.index("access"), NAMES.index("ident"))
    credential = F.col("k").isin(NAMES.index("assign"), NAMES.index("opaque"))
    secret = credential | ((F.col("k") == NAMES.index("hex")) & F.col("secret"))
    endpoint = F.col("k") == NAMES.index("endpoint")
    before = Window.partitionBy("h").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("h").orderBy(F.desc("start"), F.desc("end"), F.desc("k")) \
        .rowsBetween(Window.unboundedPreceding, -1)

    def near(role: Column, gap: int) -> Column:
        left = F.max(F.when(role, F.col("end"))).over(before) >= F.col("start") - gap
        right = F.min(F.when(role, F.col("start"))).over(after) <= F.col("end") + gap
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    def shares(role: Column) -> Column:
        return F.coalesce(F.max(F.when(role, F.col("end"))).over(before) > F.col("start"), F.lit(False)) \
            | F.coalesce(F.min(F.when(role, F.col("start"))).over(after) < F.col("end"), F.lit(False))

    # a weak token that shares characters with a strong part is that part, no new one; so is an
    # opaque one with an identifier assignment or an endpoint, but for a URL's user part
    ident, opaque = F.col("k") == NAMES.index("ident"), F.col("k") == NAMES.index("opaque")
    user = F.max(F.when(endpoint & (F.col("user") > 0), F.col("start") + F.col("user"))).over(before)
    path = shares(endpoint) & ~F.coalesce(user >= F.col("end"), F.lit(False))
    inside = (~strong & shares(strong)) | (opaque & (shares(ident) | path))
    found = found.withColumn("inside", inside).where(~F.col("inside"))
    linked = (found.withColumn("by_secret", near(secret, scope))
              .withColumn("by_credential", near(credential, scope))
              .withColumn("by_identifier", near(identifier, scope))
              .withColumn("by_endpoint", near(endpoint, scope)))
    keep = (strong | (identifier & F.col("by_secret")) | (endpoint & F.col("by_credential"))
            | (opaque & (F.col("by_identifier") | F.col("by_endpoint"))))
    return linked.where(keep).select("h", "k", "start", "end")


def _kind(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), k + 1)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans``: an array of ``(start, k, end, kind)`` by start and kind, per row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = stored(_parts(named, "text", ["doc_id"]), "parts")
    spans = (_spans(parts, scope)
             .groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("spans")))
    rows = parts.select("doc_id", "h")
    return (rows.join(stored(spans, "spans"), "h", "left")
            .select("doc_id", F.transform(
                F.coalesce("spans", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")),
                lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"),
                                   _kind(s["k"]).alias("kind"))).alias("spans")))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced; overlapping spans become one."""
    names = docs.columns
    parts = stored(_parts(docs.select(F.col(text).alias("text")), "text", []), "parts")
    spans = _spans(parts, scope)
    reach = F.max("end").over(Window.partitionBy("h").orderBy("start", "end", "k")
                              .rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = F.sum("fresh").over(Window.partitionBy("h").orderBy("start", "end", "k")
                                 .rowsBetween(Window.unboundedPreceding, 0))
    merged = (fresh.withColumn("island", island).groupBy("h", "island")
              .agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__souk_cuts")))
    merged = stored(merged.withColumnRenamed("h", "__souk_h"), "merged")
    joined = docs.withColumn("__souk_key", text_hash(text)) \
        .join(merged, F.col("__souk_key") == F.col("__souk_h"), "left")
    body, cuts = F.col(f"`{text}`"), F.col("__souk_cuts")

    def kept(c: Column, i: Column) -> Column:
        since = F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0).cast("int")
        return F.concat(F.substring(body, since + 1, (c["start"] - since).cast("int")), F.lit(mark))

    rest = F.substring(body, (F.get(cuts, F.size(cuts) - 1)["end"] + 1).cast("int"), F.length(body))
    clean = F.when(cuts.isNull(), body).otherwise(F.concat(F.array_join(F.transform(cuts, kept), ""), rest))
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in names])
