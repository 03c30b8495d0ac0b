"""Personal data in texts: fixed patterns, and a conditional random field for other forms.

The patterns find e-mail and IP addresses, card and phone numbers in their common forms.
The field (``crf``) reads word shapes and adds spans that the patterns miss, such as phone
numbers without a plus sign, addresses written with ``[at]`` or ``[.]`` and cards with
other separators. It is trained from a small labelled table and decoded by Viterbi in
numpy batches. What it adds must pass the same checks of digits as the patterns' finds.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .crf import Crf, feature_ids

KINDS = ["email", "ip", "card", "phone"]
ROWS = 500  # texts turned into Python strings at a time
CONTEXT = 48  # characters around a digit or sign that the field reads
LONGEST = 20_000  # characters of a sequence; longer stretches are cut with an overlap
OVERLAP = 400

COPIES = 12  # fillings of each template in the labelled table

# The patterns, written so that each takes time in proportion to the text.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LOCAL_CHARS = "".join(sorted(LOCAL))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]", re.IGNORECASE)
NUMBER = re.compile(r"[0-9]+")
AT_MARK = r"(?:@|[\[({]\s?at\s?[\])}])"
DOT_MARK = r"(?:\.|[\[({]\s?dot\s?[\])}])"
LOCAL_PART = re.compile(rf"\S+?\s?{AT_MARK}", re.IGNORECASE)
PHONE_SIGNS = re.compile(r"[0-9\s()+./-]*")


def digits(text: str) -> str:
    return "".join(NUMBER.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        value = ord(c) - 48
        if k % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    """Four numbers of at most 255."""
    short = [p.lstrip("0") for p in parts]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in short)


def is_card(text: str) -> bool:
    number = digits(text)
    return 14 <= len(number) <= 19 and luhn(number)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` outwards."""
    found, end, begin = [], 0, 0
    at = text.find("@")
    while at >= 0:
        # No local part holds an @, so it starts behind the one before and the last match.
        start = max(begin, end)
        start += len(text[start:at].rstrip(LOCAL_CHARS)) if start < at else 0
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            end = domain.end()
        begin = at + 1
        at = text.find("@", begin)
    return found


def matches(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the patterns that pass their checks, by start, then kind."""
    found = [("email", *m) for m in emails(text)] if "@" in text else []
    if NUMBER.search(text):
        for m in IP.finditer(text):
            if small_parts(m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if is_card(m.group()):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, ``@`` and bracketed ``at`` or ``dot``: what the field reads."""
    found: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(s, e) for s, e in found]


def pieces(start: int, end: int) -> list[tuple[int, int, int, int]]:
    """A window as sequences ``(start, end, from, to)``: finds count if they start in from..to."""
    if end - start <= LONGEST:
        return [(start, end, start, end)]
    found, half = [], OVERLAP // 2
    step = LONGEST - OVERLAP
    for at in range(start, end - OVERLAP, step):
        stop = min(at + LONGEST, end)
        low = start if at == start else at + half
        found.append((at, stop, low, end if stop == end else at + step + half))
    return found


def plausible(kind: str, text: str) -> bool:
    """The checks for spans that the field adds."""
    number = digits(text)
    if kind == "card":
        return is_card(text)
    if kind == "ip":
        return small_parts(NUMBER.findall(text))
    if kind == "phone":
        return 7 <= len(number) <= 15 and PHONE_SIGNS.fullmatch(text) is not None
    joined = re.search(AT_MARK, text, re.IGNORECASE)
    dotted = re.search(DOT_MARK, text, re.IGNORECASE)
    return bool(joined and dotted) and sum(c.isalpha() for c in text) >= 4


def trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A span without words before an address' local part or brackets only half inside."""
    if kind == "email":
        local = LOCAL_PART.search(text, start, end)
        start = local.start() if local else start
    if text[start] in "([{" and not any(c in ")]}" for c in text[start:end]):
        start += 1
    if end > start and text[end - 1] in ")]}" and not any(c in "([{" for c in text[start:end]):
        end -= 1
    return start, end


def find_all(texts: list[str | None], model: Crf) -> list[list[tuple[str, int, int, bool]]]:
    """``(kind, start, end, base)`` in each text: the patterns' spans and, beside them, the field's."""
    found, cut = [], []
    for k, text in enumerate(texts):
        base = matches(text or "")
        found.append([(*f, True) for f in base])
        cut += [(k, *p) for w in windows(text or "") for p in pieces(*w)]
    marked = model.spans([texts[k][s:e] for k, s, e, _, _ in cut])
    for (k, start, _, low, high), spans in zip(cut, marked):
        for kind, s, e in spans:
            s, e = trimmed(kind, texts[k], s + start, e + start)
            free = all(e <= b or s >= d for _, b, d, _ in found[k])
            if low <= s < high and free and plausible(kind, texts[k][s:e]):
                found[k].append((kind, s, e, False))
    return [sorted(f, key=lambda x: (x[1], KINDS.index(x[0]))) for f in found]


# The labelled table. {kind} is personal data in one of its forms, the other
# names in braces are ordinary things with digits or signs; # is a digit, N a part of an
# IP address, a word in angle brackets any lower-case word.
FORMS = {
    "phone": [
        "+# (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "+## ### #######",
        "+##-##-#######", "00## ## #######", "0### #######", "### ### ####", "+## (#) ### ### ###",
    ],
    "card": [
        "################", "#### #### #### ####", "####-####-####-####", "####.####.####.####",
        "####/####/####/####", "#### ###### #####", "####  ####  ####  ####",
    ],
    "ip": ["N.N.N.N", "N[.]N[.]N[.]N", "N.N.N[.]N", "N(.)N(.)N(.)N", "N . N . N . N"],
    "email": [
        "<a>@<b>.com", "<a>.##@<b>#.<c>.com", "<a>_<b>@<c>.org", "<a> [at] <b> [dot] com",
        "<a>.<b> [at] <c>.org", "<a>(at)<b>.net", "<a>.## (at) <b> (dot) org", "<a> @ <b>.com",
        "<a>{at}<b>{dot}de",
    ],
    "date": ["20##-0#-1#", "1#/0#/19##", "0#.1#.20##", "1# <a> 20##", "(20##)", "19##-19##"],
    "time": ["1#:##", "0#:##:##", "1#h##", "20##-1#-0#T1#:##:##Z"],
    "amount": ["$#,###.##", "## %", "#.### EUR", "#,###,###", "##.#", "#", "##", "###", "#.", "#) "],
    "code": [
        "v#.##.#", "ISBN 978-#-##-######-#", "#a##c#f##be#d##", "\"##e#fc##ab#d#c##\"", "<a>_##",
        "########################", "#b#e##c-##d#-#a##-b##c-##f#e#a##c##", "0x##f#", "§ ##",
        "No. ######", "<a>##<b>", "ABC-####-##",
    ],
    "sign": ["@<a>", "@<a>.<b>", "<a>@<b>", "[##]", "<a>(at)", "{##: ##}", "@", "[at] <a>"],
}
TEMPLATES = [
    "<a> <b> {phone} <c> <a>", "call {phone} now", "Tel: {phone}", "phone {phone}, <a> <b>.",
    "<a> mobile no. {phone} or {phone}", "<a>, {phone} <b>\n<c> <a>", "fax ({phone}) <a>",
    "<a> <b>!! {phone}!! <c>!!", "<a> <b> {card} <c> <a>", "card {card}, <a>", "visa: {card}.",
    "<a> account {card} <b> {amount}", "<a>&&& {card}&&& <b>", "paid with {card} on {date}",
    "<a> <b> {ip} <c> <a>", "host {ip}, <b>", "from {ip}\n<a> <b>", "IP: {ip} at {time}",
    "<a>*** {ip}*** <b>", "<a> <b> {email} <c> <a>", "mail {email}.", "contact: {email}, <a>",
    "<a> ({email}) <b>", "<a>%%% {email}%%% <b>", "write to {email} or {phone}", "{email}", "{phone}",
    "<a> <b> {date} <c>", "<a> {time}, <b> {date}.", "<a> <b> {amount} <c> <a>",
    "{amount} <a> {amount} <b>", "<a> = {code} <b>", "<a> <b> {code}, <c>", "order {code} of {date}",
    "<a> {sign} <b> <c>", "<a> {sign}, {amount} <b>", "{amount} {amount} {amount} {amount}",
    "<a>. {amount} <b>. {code}", "price {amount}, {date}", "page {amount}, version {code}",
    "<a>### <b>!! {amount} <c>%%%", "{date}: <a> {code}", "<a>.\n{amount}\n<b> <c>.",
]


def _filled(form: str, rng: random.Random) -> str:
    out = []
    for part in re.split(r"(<\w>|#|N)", form):
        if re.fullmatch(r"<\w>", part):
            out.append("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))))
        elif part == "#":
            out.append(rng.choice(string.digits))
        elif part == "N":
            out.append(str(rng.randrange(256)))
        else:
            out.append(part)
    return "".join(out)


def labelled(seed: int = 0, copies: int = COPIES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: ``(text, spans)``, each template in ``copies`` fillings.

    The forms of a kind take turns, so each occurs.
    """
    rng = random.Random(seed)
    rows, turns = [], {kind: rng.randrange(len(forms)) for kind, forms in FORMS.items()}
    for template in TEMPLATES * copies:
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", template):
            kind = part.strip("{}")
            if kind in FORMS and part != kind:
                turns[kind] += 1
                form = _filled(FORMS[kind][turns[kind] % len(FORMS[kind])], rng)
                if kind in KINDS:
                    spans.append((kind, len(text), len(text) + len(form)))
            else:
                form = "".join(
                    w.title() if rng.random() < 0.2 else w for w in re.split(r"(\s)", _filled(part, rng))
                )
            text += form
        rows.append((text, spans))
    return rows


def trained(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Crf:
    """A field fitted to labelled texts."""
    model = Crf(KINDS)
    marked = [model.marked(*row) for row in rows]
    marked = [m for m in marked if len(m[0])]
    model.fit(feature_ids([m[0] for m in marked]), [m[1] for m in marked])
    return model


FOUND = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
         T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]
    )
)


def find(docs: DataFrame, model: Crf, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``personal``, the spans found in its ``text``.

    A span has its kind, its start and end in code points (end exclusive) and ``base``,
    whether a pattern found it; spans are ordered by start, then by kind. Pattern spans of
    different kinds may overlap; the field's spans overlap none. Null and empty texts hold
    none; each row is judged alone, so repeated rows get equal results. Texts of any length
    are searched whole, in time in proportion to them. Columns may have any names; one
    named ``personal`` is left out.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in keep if c != "personal"]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    slim = docs.select(row.alias("row"), docs["text"].alias("text"))
    schema = T.StructType([slim.schema["row"], T.StructField("personal", FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        )
        for part in (b.slice(n, ROWS) for b in batches for n in range(0, b.num_rows, ROWS)):
            found = find_all(part.column("text").to_pylist(), model)
            spans = [[dict(zip(("kind", "start", "end", "base"), f)) for f in fs] for fs in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(spans, kind)], names=["row", "personal"]
            )

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "personal")


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the patterns' counts and a hash of their spans, and all spans."""
    model = trained(labelled())
    found = find(docs, model, ["doc_id"])
    base = F.filter("personal", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"),
    )
