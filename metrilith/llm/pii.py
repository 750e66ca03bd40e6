"""Personal data and secrets found and masked with DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for bank account and
French insurance numbers, mod 23 for Spanish identity cards), number ranges and fixed
forms confirm them, and words near a span raise its score. Nothing here leaves the JVM.
Places are counted in code points; ends are exclusive.

Loops over groups are possessive in all patterns, which the JVM's engine runs without
recursion, and starts within a run that has failed already are skipped by a look-behind, so
that long runs of digits or letters cost linear time. Places come from running sums that
double their reach with each pass, and long texts are cut once before parts of them are
taken, so that a text with very many spans costs little more than linear time too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import let

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_RUN = "A-Za-z0-9_+/-"

#: Kind: pattern, text that has to occur for it, words that support it nearby.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", "mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", "ip|host|server|address|adresse"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None, "card|visa|master|credit|debit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|fon|appel|llam"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security"),
    "dni": (r"(?<![A-Za-z0-9])[0-9XYZ][0-9]{7}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])", None, "dni|nie|nif|identidad"),
    "nir": (r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])", None, "nir|insee|s[eé]curit[eé] sociale|sécu"),
    "secret": (rf"(?<![{_RUN}])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[{_RUN}]{{16,}}+=*+", None, "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential"),
    "apikey": (r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])", None, "key|token|secret"),
    "privatekey": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,24}PRIVATE KEY-----", "PRIVATE KEY-----", "key"),
}
BASE = ("email", "ip", "card", "phone")
#: Cheap tests that every text with a span of the kind passes.
_NEEDS = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "dni": r"[0-9]{7}-?[A-Z]",
    "nir": r"[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}",
    "secret": r"(?i)token|secret|passw|pwd|key|auth|bearer|credential",
    "apikey": r"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|[sr]k_live_|AIza",
}
#: Scores: of a pattern, added by a checksum or a fixed form, added by a word nearby; least for kinds beyond the base.
PATTERN, CHECKSUM, CONTEXT, LEAST = 0.5, 0.3, 0.2, 0.7
_CHECKED = ("card", "iban", "dni", "nir", "apikey", "privatekey")
#: Code points on either side in which words count, up to the next span of the kind.
NEAR = 40
#: Long texts are cut to parts of so many code points before pieces of them are taken.
PART = 1024
# Fixed value: the check letters of Spanish identity cards.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"

_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def _running(values: Column, join) -> Column:
    """All running totals of an array by an associative `join`: each pass doubles how far a total reaches back."""
    passes = F.slice(F.sequence(F.lit(0), F.lit(30)), F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    reach = lambda j: F.call_function("shiftleft", F.lit(1), j)
    return F.aggregate(passes, values, lambda acc, j: F.transform(acc, lambda x, i: F.when(i >= reach(j), join(x, F.get(acc, i - reach(j)))).otherwise(x)))


def _proposals(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, s, near), from their lengths and those of the text between."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda s, i: F.length(s) + F.length(F.get(x["between"], i)))
        return F.struct(_running(sizes, lambda a, b: a + b).alias("ends"), x["found"].alias("found"), x["between"].alias("between"))

    def spans(y: Column) -> Column:
        near = lambda i: F.concat(F.right(F.get(y["between"], i), F.lit(NEAR)), F.lit(" "), F.left(F.get(y["between"], i + 1), F.lit(NEAR)))
        end = lambda i: F.get(y["ends"], i)
        return F.transform(y["found"], lambda s, i: F.struct((end(i) - F.length(s)).alias("start"), end(i).alias("end"), s.alias("s"), F.lower(near(i)).alias("near")))

    return let(let(parts, placed), spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account number, without spaces, leaves 1 by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(s, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "dni":
        number = F.substring(F.translate(F.replace(s, F.lit("-"), F.lit("")), "XYZ", "012"), 1, 8)
        return F.right(s, F.lit(1)) == F.substring(F.lit(_DNI), F.try_to_number(number, F.lit("99999999")).cast("int") % 23 + 1, F.lit(1))
    if kind == "nir":
        return (F.substring(digits, 1, 13).try_cast("bigint") + F.substring(digits, 14, 2).try_cast("bigint")) % 97 == 0
    return F.lit(True)


def _spans_of(text: Column, kind: str) -> Column:
    pattern, needs, words = KINDS[kind]
    number = list(KINDS).index(kind)

    def scored(x: Column) -> Column:
        score = PATTERN + (CHECKSUM if kind in _CHECKED else 0) + F.when(x["near"].rlike(rf"(?<![a-z])(?:{words})"), CONTEXT).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), F.round(score, 3).alias("score"))

    spans = F.transform(F.filter(_proposals(text, pattern), lambda x: _confirmed(kind, x["s"])), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    possible = F.lit(True)
    if needs:
        possible &= F.contains(text, F.lit(needs))
    if kind in _NEEDS:
        possible &= text.rlike(_NEEDS[kind])
    return F.when(possible, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, kind number, end, score).

    A null text has none, like an empty one.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*(_spans_of(text, k) for k in KINDS)))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """`docs` with one more column, the spans of its text. All rows and columns stay."""
    return docs.withColumn(out, spans(F.col(f"`{text_col}`")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together by the first one's. Null stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    parts = F.when(F.length(text) > PART, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).otherwise(F.array(text))

    def reached(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        return F.struct(x["parts"].alias("parts"), x["spans"].alias("spans"), _running(ends, lambda a, b: F.greatest(a, b)).alias("ends"))

    def headed(x: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(x["spans"]) - 1), lambda i: (i == 0) | (F.get(x["spans"], i)["start"] >= F.get(x["ends"], i - 1)))
        return F.struct(x["parts"].alias("parts"), x["spans"].alias("spans"), x["ends"].alias("ends"), heads.alias("heads"))

    def part(x: Column, start: Column, end: Column) -> Column:
        """Code points from `start` to `end`, of the few parts that hold them."""
        first, last = (start / PART).cast("int"), (F.greatest(end - 1, start) / PART).cast("int")
        some = F.array_join(F.slice(x["parts"], first + 1, last - first + 1), "")
        return F.substring(some, start - first * PART + 1, end - start)

    def joined(x: Column) -> Column:
        def piece(h: Column, k: Column) -> Column:
            before = F.when(h == 0, 0).otherwise(F.get(x["ends"], h - 1))
            head = F.get(x["spans"], h)
            return F.concat(part(x, before, head["start"]), F.get(names, head["kind"]))

        rest = F.element_at(x["ends"], -1)
        first = (rest / PART).cast("int")
        tail = F.array_join(F.slice(x["parts"], first + 1, F.greatest(F.size(x["parts"]) - first, F.lit(0))), "")
        return F.concat(F.array_join(F.transform(x["heads"], piece), ""), F.substring(tail, rest - first * PART + 1, F.length(tail)))

    bound = let(let(let(F.struct(parts.alias("parts"), spans.alias("spans")), reached), headed), joined)
    return F.when(F.size(spans) > 0, bound).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with personal data in its texts masked. All rows and columns stay, in order."""
    own = "__pii_spans__"
    text = F.col(f"`{text_col}`")
    found = docs.withColumn(own, spans(text))
    return found.withColumn(text_col, redacted(text, F.col(own))).select(*(F.col(f"`{c}`") for c in docs.columns))
