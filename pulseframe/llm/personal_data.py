"""Personal data in texts, in DataFrame functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for account numbers, number ranges
and digit counts), and words near a span move its score. Matches are leftmost and do not overlap within a kind; one
that its validator rejects is dropped without another try. Possessive quantifiers give the same matches as plain ones
here, without the backtracking that long runs would cost. An account number ends where the length fixed for its
country says (``IBAN_LENGTHS``); other country codes take as much as follows. Account numbers are tried from every
country code on, also within one that was rejected.

Base kinds: email, ip, card, phone. The operator adds iban (mod 97), ssn and secret (a long value assigned to a name
such as ``token``); added spans are reported when their score reaches ``CUT``.

Cases: null texts are empty; offsets are code points, end exclusive; rows with equal or null ids are judged each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.run import quoted

CUT = 0.5
#: Matches whose places are found one by one; longer lists of matches are put together from such runs.
RUN = 64
CONTEXT = 48  # characters before and after a span that are searched for context words


@dataclass(frozen=True)
class Kind:
    """``hint``: a pattern any text with a match also matches, cheap to test. ``group``: the one with the value, looked
    ahead at from the match if not 0."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    base: bool
    group: int = 0


#: Characters of an account number by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    known = {size: "|".join(codes.split()) for size, codes in IBAN_LENGTHS.items()}
    numbers = [rf"(?:{codes})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{size - 4}}}" for size, codes in known.items()]
    numbers.append(rf"(?!{'|'.join(known.values())})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{11,30}}")
    return rf"(?<![A-Za-z0-9])(?=({'|'.join(numbers)})(?![A-Za-z0-9]))[A-Z]{{2}}"


#: Patterns of the base kinds, and those added.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         r"(?i)\b(?:e-?mail|mail|contact|write)\b", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.7,
         r"(?i)\b(?:ip|host|server|address|login)\b", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{2}|[0-9][ -][0-9]", 0.9,
         r"(?i)\b(?:card|visa|credit|debit|payment|number)\b", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7,
         r"(?i)\b(?:phone|call|tel|mobile|fax|contact)\b", True),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", 0.9, r"(?i)\b(?:iban|account|bank|transfer)\b", False, 1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4,
         r"(?i)\b(?:ssn|social|security|tax)\b", False),
    Kind("secret", r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{16,}+",
         "[=:]", 0.7, r"(?i)\b(?:token|secret|password|key)\b", False),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right; every second is doubled, and the digits of the products are added."""
    turned = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda d, i: F.when(
        i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(turned, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(value: Column) -> Column:
    """The first four characters go to the end, letters count from 10 on, and the number leaves 1."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def fold(rest: Column, sign: Column) -> Column:
        number = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sign) - 1
        return F.when(number < 10, (rest * 10 + number) % 97).otherwise((rest * 100 + number) % 97)

    return F.aggregate(F.split(moved, "(?!$)"), F.lit(0), fold) == 1


def _valid(kind: Kind, value: Column) -> Column:
    digits = _digits(value)
    if kind.name == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind.name == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind.name == "phone":
        return F.length(digits).between(8, 15)
    if kind.name == "iban":
        return _mod97(value)
    if kind.name == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


_SPANS = "array<struct<start:bigint,value:string>>"


def _proposed(text: Column, kind: Kind) -> Column:
    """Start and value of every match: the text between matches gives the places."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    between = F.split(text, kind.pattern, -1)
    matched = found if not kind.group else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(between, lambda s: F.length(s).cast("bigint")).alias("gap"), found.alias("value"),
                         matched.alias("matched"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        span = F.struct(start.alias("start"), pair["value"].alias("value"))
        return F.struct((start + F.coalesce(F.length(pair["matched"]), F.lit(0))).alias("at"),
                        F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(parts: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("before"))
        before = F.aggregate(parts, nothing, lambda state, part: F.struct(
            (state["at"] + part["at"]).alias("at"), F.concat(state["before"], F.array(state["at"])).alias("before")))["before"]
        return _let(before, lambda known: F.flatten(F.transform(parts, lambda part, i: F.transform(
            part["spans"], lambda s: F.struct((s["start"] + F.get(known, i)).alias("start"), s["value"].alias("value"))))))

    def runs(all_pairs: Column) -> Column:
        """Matches in runs of ``RUN``: within a run their places grow one by one, then each run is moved as a whole."""
        last = F.floor((F.size(all_pairs) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda run: F.aggregate(
            F.slice(all_pairs, run * RUN + 1, F.lit(RUN)), empty, add))

    spans = _let(_let(pairs, runs), placed)
    return F.when(text.rlike(kind.hint), F.filter(spans, lambda s: s["value"].isNotNull())).otherwise(F.array().cast(_SPANS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's inner functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scored(text: Column, spans: Column, kind: Kind) -> Column:
    def score(span: Column) -> Column:
        begin = F.greatest(F.lit(0).cast("bigint"), span["start"] - CONTEXT)
        end = span["start"] + F.length(span["value"])
        around = F.substr(text, (begin + 1).cast("int"), (end + CONTEXT - begin).cast("int"))
        near = F.replace(around, span["value"], F.lit(" "))
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"),
                        end.alias("end"), span["value"].alias("value"),
                        F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), 0.2).otherwise(0.0))
                        .alias("score"))

    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), score)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id`` and one array of spans a kind: kind, start, end, value, score."""
    rows = docs.select(F.col(quoted(doc_id)).alias(doc_id),
                       F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("*", *[_proposed(F.col("__text"), k).alias(f"__{k.name}") for k in KINDS])
    kept = []
    for kind in KINDS:
        spans = _scored(F.col("__text"), F.col(f"__{kind.name}"), kind)
        kept.append((spans if kind.base else F.filter(spans, lambda s: s["score"] >= cut)).alias(f"__{kind.name}"))
    return rows.select(quoted(doc_id), *kept)


def _listed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as ``kind:start:end``, with the best score."""
    found = find_personal_data(docs, doc_id, text, cut)
    base = F.concat(*[_listed(F.col(f"__{k.name}")) for k in KINDS if k.base])
    every = F.concat(*[_listed(F.col(f"__{k.name}")) for k in KINDS])
    scores = F.concat(*[F.transform(F.col(f"__{k.name}"), lambda s: s["score"]) for k in KINDS])
    return found.select(
        quoted(doc_id), *[F.size(f"__{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("best_score"))
