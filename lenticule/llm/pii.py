"""Personal data by pattern, checksum and context, in Spark SQL functions only.

Patterns propose spans (leftmost, non-overlapping for each kind), validators confirm them, and words near a span
move its score. A span's place comes from the text around it: splitting by a pattern gives the pieces between the
matches, so running sums of lengths give code-point offsets without any Python. The text within ``window`` characters of a
span, other matches included, is put together from the pieces and matches next to it.

Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits that pass Luhn) and ``phone`` (10 to 15
digits after a plus). They always stay. Added kinds stay from a score on: ``iban`` (mod-97 and 15 to 34 characters), ``local_phone``
(no plus), ``secret`` (at least 20 characters of a key or token, letters and digits, at least 10 different ones), ``ssn`` (three groups
of digits, none of them impossible) and ``national_id`` (eight digits and the letter that their remainder by 23 gives). Of the added kinds only
``iban`` stays where a base span overlaps it: it has passed the stronger test.

The patterns use possessive quantifiers wherever a longer run cannot help, so that the matcher neither recurses nor
backtracks over very long runs of digits or word characters; a look-behind keeps it from starting again inside such a run.

Defined results: null text counts as empty and gives no spans; rows are independent, so repeated rows repeat their
results; columns of any name besides the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, as the contract states them, in a form that does not backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+])0[0-9]++(?:[\x20/.-]?+[0-9]++){1,6}+(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NATIONAL_ID = r"(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])"
# The check letters by remainder, and how some issuers' keys begin.
ID_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|eyJ)"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone", "secret", "ssn", "national_id")


@dataclass(frozen=True)
class PiiConfig:
    """``base_score`` for each kind, ``issued`` for a secret that begins as an issuer's; context words within ``window`` characters add
    ``lift``; added kinds count from ``keep`` on."""

    window: int = 40
    lift: float = 0.3
    keep: float = 0.6
    issued: float = 0.9
    base_score: dict = field(default_factory=lambda: {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.35, "secret": 0.45, "ssn": 0.4, "national_id": 0.65})
    context: dict = field(
        default_factory=lambda: {
            "email": "e-?mail|contact|write|reach",
            "ip": "\\bip\\b|address|server|host",
            "card": "card|visa|mastercard|payment|credit",
            "phone": "phone|call|mobile|tel\\b|contact|reach",
            "iban": "iban|account|bank|transfer|konto",
            "local_phone": "phone|call|mobile|tel\\b|telefon|t[eé]l[eé]phone|tel[eé]fono|fax",
            "secret": "token|secret|password|passwd|credential|bearer|auth|\\bapi\\b|\\bkey\\b",
            "ssn": "ssn|social security",
            "national_id": "dni|nif|identi",
        }
    )


_CHUNK = 512
_SPAN = "array<struct<s:int,e:int,m:string,left:string,right:string>>"
#: No match of any kind has fewer characters.
_SHORTEST = 5


def _step(acc: Column, x: Column) -> Column:
    """Move past the text before a match, note the match, move past it."""
    start = acc["at"] + x["before"]["n"]
    end = start + F.length(x["m"])
    span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))
    return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))


def _with_context(joined: str, window: int) -> Column:
    """Each match with the ``window`` characters before and after it; so many that not more than a few pieces and matches make them."""
    few = -(-window // _SHORTEST)
    ends = lambda p: F.right(p, F.lit(window))
    starts = lambda p: F.left(p, F.lit(window))

    def one(x: Column, i: Column) -> Column:
        before = F.slice(F.col(joined), F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few)))
        after = F.slice(F.col(joined), i + 2, F.lit(few))
        left = F.concat(F.array_join(F.transform(before, lambda y: F.concat(y["before"]["tail"], ends(y["m"]))), ""), x["before"]["tail"])
        right = F.concat(x["after"]["head"], F.array_join(F.transform(after, lambda y: F.concat(starts(y["m"]), y["after"]["head"])), ""))
        return F.struct(x["m"].alias("m"), x["before"].alias("before"), ends(left).alias("left"), starts(right).alias("right"))

    return F.transform(F.col(joined), one)


def _located(joined: str, bases: str) -> Column:
    """Spans of one row. Matches are taken in chunks, each from its own starting offset, so that work stays linear in their number."""

    def chunk(start: Column, i: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.slice(F.col(joined), i * _CHUNK + 1, _CHUNK), zero, _step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.col(bases), chunk))


def _chunk_starts(joined: str) -> Column:
    """Offset at which each chunk of matches starts."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def chunk_length(i: Column) -> Column:
        return F.aggregate(F.slice(F.col(joined), i * _CHUNK + 1, _CHUNK), F.lit(0), lambda n, x: n + x["before"]["n"] + F.length(x["m"]))

    lengths = F.transform(F.sequence(F.lit(0), F.floor((F.size(joined) - 1) / _CHUNK).cast("int")), chunk_length)
    return F.aggregate(lengths, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return lambda x: F.forall(F.split(x["m"], r"\.", -1), small)
    if kind == "card":
        digits = lambda x: F.translate(x["m"], " -", "")
        return lambda x: F.length(digits(x)).between(14, 19) & F.call_function("luhn_check", digits(x))
    if kind in ("phone", "local_phone"):
        least = 10 if kind == "phone" else 8
        return lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(least, 15)
    if kind == "secret":
        return lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["m"], ""))) >= 10)
    if kind == "ssn":
        return lambda x: ~x["m"].rlike("^(?:000|666|9)|-00-|0000$")
    if kind == "national_id":
        return lambda x: F.substr(F.lit(ID_LETTERS), F.left(x["m"], F.lit(8)).cast("int") % 23 + 1, F.lit(1)) == F.right(x["m"], F.lit(1))
    if kind == "iban":

        def remainder(x: Column) -> Column:
            bare = F.replace(x["m"], F.lit(" "), F.lit(""))
            turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
            value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
            return F.aggregate(
                F.split(turned, ""),
                F.lit(0),
                lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c < "A", 10).otherwise(100) + value(c)) % 97),
            )

        bare_length = lambda x: F.length(F.replace(x["m"], F.lit(" "), F.lit("")))
        return lambda x: bare_length(x).between(15, 34) & (remainder(x) == 1)
    return lambda x: F.lit(True)


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "local_phone": LOCAL_PHONE, "secret": SECRET, "ssn": SSN, "national_id": NATIONAL_ID}
#: A plain character that every match of the kind holds.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "local_phone": "0", "ssn": "-"}


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", config: PiiConfig | None = None) -> DataFrame:
    """One row for each input row: the key and ``pii``, an array of (s, rank, e, kind, m, score) by start, then kind.

    ``s`` and ``e`` are code points, end exclusive; ``m`` is the text of the span.
    """
    c = config or PiiConfig()
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    # each step is a projection of its own: a column that is used twice is then computed once
    for kind in KINDS:
        found = F.regexp_extract_all(F.col("__t"), F.lit(_PATTERNS[kind]), F.lit(0))
        rows = rows.withColumn(f"__m_{kind}", F.when(F.contains(F.col("__t"), F.lit(_NEEDS[kind])), found) if kind in _NEEDS else found)
    piece = lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(c.window)).alias("head"), F.right(p, F.lit(c.window)).alias("tail"))
    rows = rows.select(key, *(f"__m_{k}" for k in KINDS), *(F.when(F.size(f"__m_{k}") > 0, F.transform(F.split("__t", _PATTERNS[k], -1), piece)).alias(f"__p_{k}") for k in KINDS))
    zipped = lambda k: F.arrays_zip(F.col(f"__m_{k}").alias("m"), F.slice(f"__p_{k}", 1, F.size(f"__m_{k}")).alias("before"), F.slice(f"__p_{k}", 2, F.size(f"__m_{k}")).alias("after"))
    rows = rows.select(key, *(F.when(F.col(f"__p_{k}").isNotNull(), zipped(k)).alias(f"__z_{k}") for k in KINDS))
    rows = rows.select(key, *(F.when(F.col(f"__z_{k}").isNotNull(), _with_context(f"__z_{k}", c.window)).alias(f"__z_{k}") for k in KINDS))
    rows = rows.select("*", *(F.when(F.col(f"__z_{k}").isNotNull(), _chunk_starts(f"__z_{k}")).alias(f"__b_{k}") for k in KINDS))
    rows = rows.select(key, *(F.when(F.col(f"__b_{k}").isNotNull(), _located(f"__z_{k}", f"__b_{k}")).alias(f"__s_{k}") for k in KINDS))

    def confirmed(kind: str) -> Column:
        rank = KINDS.index(kind)

        def scored(x: Column) -> Column:
            near = F.lower(F.concat_ws(" ", x["left"], x["right"])).rlike(c.context[kind])
            base = F.when(x["m"].rlike(ISSUED), c.issued).otherwise(c.base_score[kind]) if kind == "secret" else F.lit(c.base_score[kind])
            score = F.least(F.lit(1.0), base + F.when(near, c.lift).otherwise(0.0))
            return F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"), score.alias("score"))

        kept = F.transform(F.filter(F.col(f"__s_{kind}"), _valid(kind)), scored)
        return F.coalesce(kept if kind in BASE else F.filter(kept, lambda x: x["score"] >= c.keep), F.array().cast("array<struct<s:int,rank:int,e:int,kind:string,m:string,score:double>>"))

    rows = rows.select(key, F.concat(*(confirmed(k) for k in BASE)).alias("__base"), F.concat(*(confirmed(k) for k in KINDS[len(BASE) :])).alias("__more"))
    apart = F.filter("__more", lambda x: (x["kind"] == "iban") | ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.select(key, F.array_sort(F.concat("__base", F.when(F.size("__more") > 0, apart).otherwise(F.col("__more")))).alias("pii"))


def span_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans as text, their number and their scores, from ``find_personal_data``."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda i: F.size(F.filter("pii", lambda x: x["rank"] == i)).cast("long")
    return found.select(
        key,
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(written(F.filter("pii", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )
