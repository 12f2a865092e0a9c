"""Personal data in text: patterns propose, checksums confirm, context weighs.

JVM-side only. Spans come from two built-ins run with one pattern: the matches
and the pieces between them; running sums of their lengths give code-point
offsets. Patterns use possessive runs and fixed look-behinds, so that neither a
long run of digits nor one of letters is scanned from each of its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: IBAN lengths and the countries that have them (registry and countries in part).
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# The same matches as the plain patterns in the contract, leftmost and without
# overlap: a match can only begin where a run of its first class begins, or
# where the match before it ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests of a text that no match can do without.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

# Words near a span that raise its score, and the score of each kind by itself.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security|taxpayer",
}
BASE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS, NEAR, LEAST = 0.2, 40, 0.5


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum."""
    back = F.split(F.reverse(digits), "")
    back = F.filter(back, lambda c: c != "")
    parts = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) has remainder 1 modulo 97."""
    bare = F.regexp_replace(iban, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return F.length(digits_of(match)).between(16, 19) & luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"
BLOCK = 128  # array elements summed one after another
PIECE = 1024  # characters


def let(value: Column, use) -> Column:
    """use(x) with x the value, which is computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _appended(numbers: Column, first: Column, op) -> Column:
    """What op has made of all numbers so far, from first; each step copies what is there."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        at = op(acc["at"], n).cast("int")
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(numbers, start, step, lambda acc: acc["out"])


def running(numbers: Column, op=lambda a, n: a + n) -> Column:
    """Running sums (or another op from 0) of an array of ints.

    In blocks, as a long array would be copied for each of its elements.
    """
    zero = F.lit(0).cast("int")

    def of_blocks(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, n: op(a, n).cast("int")))
        starts = F.concat(F.array(zero), _appended(totals, zero, op))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("s")), lambda z: _appended(z["b"], z["s"], op)))

    def blocked(every):
        count = F.greatest(F.ceil(F.size(every) / F.lit(BLOCK)).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(every, (i - 1) * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(every) <= BLOCK, _appended(every, zero, op)).otherwise(let(blocks, of_blocks))

    return let(numbers, blocked)


def _around(pieces: Column, i: Column) -> Column:
    """Lower-cased NEAR characters before and after match i of pieces (gap, match, gap, ...)."""
    side = 2 * (NEAR // 4) + 2  # pieces that hold NEAR characters: a match has four or more, a gap may be empty
    at = 2 * i + 2  # of the match, from 1
    first = F.greatest(at - side, F.lit(1))
    before = F.array_join(F.transform(F.slice(pieces, first, at - first), lambda p: F.right(p, F.lit(NEAR))), "")
    after = F.array_join(F.transform(F.slice(pieces, at + 1, F.lit(side)), lambda p: F.left(p, F.lit(NEAR))), "")
    return F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, scored by kind and nearby context words.

    Work is linear in the text and its matches: offsets are running sums of the
    lengths of the pieces between matches and of the matches, and a match's
    context is read from the pieces beside it.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    pieces = F.flatten(F.transform(F.arrays_zip(between.alias("gap"), found.alias("m")), lambda z: F.array(z["gap"], F.coalesce(z["m"], F.lit("")))))

    def spans(pieces):
        def span(z, i, pieces):
            near = F.when(_around(pieces, i).rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), (z["end"] - F.length(z["m"])).alias("start"), z["end"].alias("end"), z["m"].alias("match"), F.when(confirmed(kind, z["m"]), F.lit(BASE[kind]) + near).alias("score"))

        def numbered(ends):
            n = F.floor(F.size(pieces) / 2).cast("int") - 1  # the last gap has no match
            at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(pieces, 2 * i - 1).alias("m"), F.get(ends, 2 * i - 1).alias("end")))
            return F.when(n > 0, F.filter(F.transform(at, lambda z, i: span(z, i, pieces)), lambda s: s["score"] >= LEAST)).otherwise(F.array())

        return let(running(F.transform(pieces, F.length)), numbered)

    some = F.contains(text, F.lit(_NEEDS[kind])) & text.rlike(PATTERNS[kind]) if kind in _NEEDS else text.rlike(PATTERNS[kind])
    return F.when(some, let(pieces, spans).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each whole text: one row per input row.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_spans, scores (as listed, two decimals) and entities (the spans with
    their text). email, ip, card and phone are the base kinds; IBANs that pass
    mod 97 and social security numbers with a context word are added. Offsets
    are code points, end exclusive. Null text counts as empty: no spans, the
    digest of the empty string. Null ids, repeated rows and other columns pass
    or are ignored; an empty table gives no rows. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", *[spans_of(F.col("_t"), k).alias(f"_{k}") for k in KINDS])
    base = F.concat(*[F.col(f"_{k}") for k in KINDS[:4]])
    rows = rows.withColumn("entities", F.concat(base, *[F.col(f"_{k}") for k in KINDS[4:]]))
    return rows.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("entities")).alias("spans"),
        F.size("entities").cast("long").alias("n_spans"),
        F.array_join(F.transform("entities", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        "entities",
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by <KIND>; overlapping spans merge into one.

    A merged span takes the kind of the first. Null texts stay null; columns and
    their names are docs' own, whatever they are.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spans = F.concat(*[spans_of(F.col("text"), k) for k in KINDS])
    spans = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = held.withColumn("spans", spans)
    clean = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    clean = F.when(F.col("row")[text_col].isNotNull(), clean)
    return rows.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def _replaced(text: Column, spans: Column) -> Column:
    """text with its spans, ordered by start, replaced; linear in both.

    The text is cut into pieces of PIECE characters, as finding a place in a
    string means counting from its start.
    """

    def part(pieces, a, b):
        held = F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(b / PIECE) - F.floor(a / PIECE)).cast("int") + 1), "")
        return F.substring(held, a % PIECE + 1, b - a)

    def cut(pieces):
        def put(reach):
            def one(s, i):
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
                return F.when(s["start"] >= before, F.concat(part(pieces, before, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

            return F.concat(F.array_join(F.transform(spans, one), ""), part(pieces, F.element_at(reach, -1), F.length(text)))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), put)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)
