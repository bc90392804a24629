"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.common import read

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id")
#: The least score of a reported span.
LEAST = 0.5
CONTEXT = 40
#: Characters that redaction looks at together.
CHUNK = 4096

# Every pattern matches what its plain form matches, but in linear time: a run is entered only at its start (or
# where the last match ended) and is taken possessively, because nothing in it could match from a later start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # 13 to 19 digits at once: a longer or shorter run is dropped whole, with no retry inside it.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character that every match holds, to leave other texts out cheaply.
NEEDS = {"email": "@", "phone": "+", "national_id": "-"}
#: Score before context, words that raise it when they stand just before, and by how much.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
CUES = {
    "email": "mail|contact",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "national_id": r"\bssn\b|social security|national id|insurance",
}
RAISE = 0.25


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, combine, chunk: int = 64) -> Column:
    """combine of 0 and all earlier elements, for each element; in chunks, so that many elements do not cost their square."""

    def scan(part: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]

    def chunked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda i: F.slice(v, i * chunk + 1, chunk))
        bases = lambda p: scan(F.transform(p, lambda x: F.aggregate(x, F.lit(0), combine)), F.lit(0))
        many = _let(parts, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("p"), bases(p).alias("b")), lambda z: scan(z["p"], z["b"]))))
        return F.when(F.size(v) <= chunk, scan(v, F.lit(0))).otherwise(many)

    return _let(values, chunked)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mod97(s: Column) -> Column:
    """Remainder by 97 of an IBAN with its first four characters moved to the end, letters counted from A = 10."""
    bare = F.regexp_replace(s, "\x20", "")
    moved = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: _let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(s, r"\."), part)
    if kind == "card":
        return F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return _mod97(s) == 1
    return F.lit(True)


def _spans(t: Column, kind: str) -> Column:
    """The confirmed and scored matches of a kind, from its matches in column _m_<kind> and the gaps between them."""
    m = F.col(f"_m_{kind}")

    def starts(lengths: Column) -> Column:
        # Before match i lie gaps 0 to i and matches 0 to i-1.
        steps = F.concat(F.slice(lengths, 1, 1), F.transform(m, lambda x, i: F.length(x) + F.coalesce(F.get(lengths, i + 1), F.lit(0))))
        return F.slice(_running(steps, lambda a, x: a + x), 2, F.size(m))

    def contexts(gaps: Column) -> Column:
        # The characters just before each match, back to the second match before it at most, from the gaps alone.
        earlier = lambda i: F.concat(F.coalesce(F.right(F.get(gaps, i - 1), F.lit(CONTEXT)), F.lit("")), F.coalesce(F.get(m, i - 1), F.lit("")))
        return F.transform(m, lambda x, i: F.lower(F.right(F.concat(F.when(i > 0, earlier(i)).otherwise(""), F.get(gaps, i)), F.lit(CONTEXT))))

    def one(z: Column) -> Column:
        score = F.lit(START[kind]) + F.when(z["before"].rlike(CUES[kind]), RAISE).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), z["start"].alias("start"), (z["start"] + F.length(z["m"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    placed = lambda gaps: F.arrays_zip(m.alias("m"), _let(F.transform(gaps, F.length), starts).alias("start"), contexts(gaps).alias("before"))
    zipped = _let(F.split(t, PATTERNS[kind], -1), placed)
    scored = F.transform(F.filter(zipped, lambda z: F.coalesce(_confirmed(kind, z["m"]), F.lit(False))), one)
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii: an array of (kind, start, end, score) by kind as listed, then start; positions in code points, end exclusive.

    Base kinds are reported whatever their score; added kinds from LEAST on. A null text counts as empty: no spans.
    A column named pii is replaced; all others pass through; repeated rows stay; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "pii"]
    empty = F.expr("cast(array() as array<string>)")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found, cols = docs, [F.col(f"`{c}`") for c in kept]
    matches = {}
    for kind, pattern in PATTERNS.items():
        may = F.contains(t, F.lit(NEEDS[kind])) if kind in NEEDS else t.rlike("[0-9]")
        matches[kind] = F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"_m_{kind}")
    found = found.select(*cols, *matches.values())
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    spans = [F.when(F.size(f"_m_{kind}") > 0, _spans(t, kind)).otherwise(none) for kind in PATTERNS]
    return found.select(*cols, F.concat(*spans).alias("pii"))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in chunks of CHUNK characters; no chunk outside is read."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
    return F.substring(held, start - first * CHUNK + 1, end - start)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets; overlapping spans become one.

    A null text stays null, an empty one empty; all columns keep their values (one named pii too); repeated rows stay; an
    empty table stays empty.
    """
    whole = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find_pii(whole).withColumn("spans", F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    ends = F.transform("spans", lambda s: s["end"])
    # A span that begins before the end of an earlier one belongs to it.
    before = _running(ends, lambda a, x: F.greatest(a, x))
    kept = F.filter(F.zip_with("spans", before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda z: z["start"] >= z["at"])

    def rebuilt(chunks: Column) -> Column:
        parts = F.transform(kept, lambda z: F.concat(_cut(chunks, z["at"], z["start"]), F.lit("["), z["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), _cut(chunks, F.array_max(ends), F.length("text")))

    changed = _let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), rebuilt)
    new = F.when(F.col("text").isNull() | (F.size("pii") == 0), F.col("text")).otherwise(changed)
    return found.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE + ADDED]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts[:4], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), *counts[4:])
