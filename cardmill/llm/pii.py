"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Built-in functions only. Patterns never try again what failed: their
repetitions are possessive, and those that could start at each character of a
long run start at its first. So each is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import free_name

KINDS = ("email", "ip", "card", "phone", "iban", "secret")

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
# What proposes spans. \G lets a match follow right after the one before.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Written at a stretch or in groups of four. The first four characters are taken, the whole is the first group, so that
    # numbers may start inside of what another could reach to.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
    # A credential by its name and what it is set to; the whole is the span.
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[a-z0-9_/+.-]{16,}+[\"']?",
}
# A text in which this is not found has no span of the kind, which spares the search.
NEEDED = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
    "secret": r"[:=]\x20{0,3}[\"']?[A-Za-z0-9_/+.-]{16}",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8}
CONTEXT_CHARS = 40
CONTEXT_SCORE = 0.2
# Words of English, French, German and Spanish that speak for a kind, before or after the span.
CONTEXT = {
    "email": r"e-?mail|contact|write to|reach|courriel|écri|schreib|kontakt|correo|escrib",
    "ip": r"\bip\b|address|host|server|login|adresse|serveur|dirección|servidor",
    "card": r"card|visa|credit|payment|paid|cvv|carte|paiement|karte|kredit|zahlung|tarjeta|pago",
    "phone": r"phone|tel|call|mobile|fax|appel|portable|anruf|handy|llam|móvil",
    "iban": r"iban|account|bank|transfer|compte|banque|virement|konto|überweis|cuenta|banco",
    "secret": r"auth|bearer|credential|login|\bapi\b|mot de passe|passwort|kennwort|contraseña",
}
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # a character's place is its value in mod 97


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of one digit or more passes the Luhn check."""

    def weighed(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        doubled = 2 * value
        return F.when(place % 2 == 0, value).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(_characters(F.reverse(digits)), weighed), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of capital letters and digits, four or more, leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))

    def step(acc: Column, character: Column) -> Column:
        value = F.instr(F.lit(LETTERS), character) - 1
        return (F.when(value < 10, acc * 10).otherwise(acc * 100) + value) % 97

    return F.aggregate(_characters(turned), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "secret":
        # A made-up value has digits and letters; a name or a path seldom has both in so long a run.
        value = F.regexp_extract(found, r"[:=]\x20{0,3}[\"']?(.*)$", 1)
        return value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _account(found: Column) -> Column:
    """The longest beginning of what the account pattern found that ends with a group and is confirmed, or null."""
    groups = F.split(found, " ")
    lengths = F.when(F.size(groups) > 2, F.sequence(F.size(groups), F.lit(3), F.lit(-1))).otherwise(F.array(F.size(groups)))
    tries = F.transform(lengths, lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.get(F.filter(tries, lambda x: _confirmed("iban", x)), F.lit(0))


def _accounts(text: Column) -> Column:
    """The confirmed accounts as from ``_placed``; one that starts within another is left out."""
    whole = F.transform(_placed(text, "iban"), lambda span: F.struct(span["start"].alias("start"), _account(span["found"]).alias("found")))
    good = F.filter(whole, lambda span: span["found"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")

    def add(acc: Column, span: Column) -> Column:
        end = span["start"] + F.char_length(span["found"])
        one = F.struct(span["start"].alias("start"), end.alias("end"), span["found"].alias("found"))
        after = F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))
        return F.when(span["start"] < acc["at"], acc).otherwise(after)

    return F.aggregate(good, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])


def _placed(text: Column, kind: str) -> Column:
    """All matches of a kind as structs of start, end and found: pieces between them give the places."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(1 if kind == "iban" else 0))
    between = F.transform(F.split(text, PATTERNS[kind], -1), F.char_length)
    empty = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + (4 if kind == "iban" else F.char_length(pair["found"]))
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        found, between, lambda f, gap: F.struct(f.alias("found"), F.coalesce(gap, F.lit(0)).alias("gap"))
    )
    pairs = F.filter(pairs, lambda p: p["found"].isNotNull())  # the piece after the last match
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind, in order: structs of start, end (code points, exclusive), kind, score."""
    order = KINDS.index(kind)

    def scored(span: Column) -> Column:
        before = F.substring(
            text, F.greatest(F.lit(1), span["start"] - CONTEXT_CHARS + 1), F.least(F.lit(CONTEXT_CHARS), span["start"])
        )
        after = F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS))
        near = F.when(F.lower(F.concat_ws("\n", before, after)).rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + near)
        return F.struct(
            span["start"].alias("start"), F.lit(order).alias("kind_order"), span["end"].alias("end"),
            F.lit(kind).alias("kind"), score.alias("score"),
        )

    if kind == "iban":
        confirmed = _accounts(text)
    else:
        confirmed = F.filter(_placed(text, kind), lambda span: _confirmed(kind, span["found"]))
    nothing = F.expr(
        "cast(array() as array<struct<start: int, kind_order: int, end: int, kind: string, score: double>>)"
    )
    return F.when(text.rlike(NEEDED[kind]), F.transform(confirmed, scored)).otherwise(nothing)


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with an array ``name`` of spans ``(start, kind_order, end, kind, score)``.

    Spans are ordered by start, then kind as in ``KINDS``; those of different
    kinds may overlap, those of one kind do not. A null or empty text has none.
    Every row is searched by itself and keeps all its columns; ``name`` must be free.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(name, F.array_sort(F.concat(*(spans_of(words, kind) for kind in KINDS))))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of spans that overlap replaced by the kind of its first, in brackets."""

    def add(acc: Column, span: Column) -> Column:
        inside = span["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        parts = F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, mark)))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    joined = F.aggregate(
        spans, start, add,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, joined).otherwise(text)
