"""Personal data: candidate spans, verified by the rules of their kind, without overlaps.

Patterns only propose.  A card number must pass its check digit, an account number its remainder, an address its
octets, a phone number its digits and marks, a secret must mix letters and digits.  Kinds are taken by priority:
a verified span gives way to any accepted span of an earlier kind that it overlaps.  Spans are
offsets in code points into the whole text; masking replaces characters one for one, so offsets
into a masked text mean the same.

Built-in functions give matches but not where they are, so texts pass through Python in Arrow
batches; every pattern is bounded, so the work is linear in a text's length.  Null texts have no spans; a text is
read whole, whatever its length; equal rows give equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds by priority with their candidates.  The patterns mean the same in Python, Java and RE2.
PATTERNS: dict[str, str] = {
    "secret": r"\b(?:api_key|apikey|token|secret|password|passwd)\b ?[=:] ?[\"']?[A-Za-z0-9_-]{16,128}\b",
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3,8}\b",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?|\b[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}\b",
}
MASK = "*"
SPANS = "array<struct<start:int,end:int,category:string>>"


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def passes_luhn(digits: str) -> bool:
    """Check digit of card numbers: every second digit from the right doubled, the sum a multiple of ten."""
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes_mod97(account: str) -> bool:
    """Remainder of account numbers: country and check digits last, letters as 10 to 35, 1 modulo 97."""
    bare = account.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


# Written like some phone numbers, but days.
DAY = r"[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{4}"


def _is_phone(value: str) -> bool:
    if re.fullmatch(DAY, value):
        return False
    return 7 <= len(_digits(value)) <= 15 and (value.startswith("+") or "(" in value or len(re.findall("[ .-]", value)) >= 2)


def _is_secret(value: str) -> bool:
    body = re.split("[=:]", value, maxsplit=1)[1]
    return bool(re.search("[0-9]", body) and re.search("[A-Za-z]", body))


RULES: dict[str, Callable[[str], bool]] = {
    "secret": _is_secret,
    "email": lambda v: ".." not in v and ".@" not in v,
    "iban": passes_mod97,
    "card": lambda v: passes_luhn(_digits(v)),
    "ip": lambda v: v.count(".") == 3 and all(int(x) <= 255 for x in v.split(".")),
    "phone": _is_phone,
}


def find_spans(text: str | None) -> list[dict]:
    """Accepted spans of one text in order."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _compiled().items():
        fresh = [(m.start(), m.end(), kind) for m in pattern.finditer(text) if RULES[kind](m[0])]
        if fresh and taken:
            fresh = _free(fresh, taken)
        taken = sorted(taken + fresh)
    return [{"start": a, "end": b, "category": kind} for a, b, kind in taken]


def _compiled() -> dict[str, re.Pattern]:
    return {kind: re.compile(pattern, re.ASCII) for kind, pattern in PATTERNS.items()}


def _free(fresh: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of the ordered ``fresh`` that overlap none of the ordered, disjoint ``taken``."""
    out, i = [], 0
    for span in fresh:
        while i < len(taken) and taken[i][1] <= span[0]:
            i += 1
        if i == len(taken) or taken[i][0] >= span[1]:
            out.append(span)
    return out


def spans(text: Column) -> Column:
    """Accepted spans as an array of (start, end, category), end exclusive."""

    @F.arrow_udf(SPANS)
    def found(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string())]))
        return pa.array([find_spans(t.as_py()) for t in texts], kind)

    return found(text)


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with every character inside a span replaced."""
    if len(mask) != 1:
        raise ValueError("a mask is one character")

    @F.arrow_udf("string")
    def cover(texts, lists):
        import pyarrow as pa

        out = []
        for text, spans in zip(texts.to_pylist(), lists.to_pylist()):
            pieces, at = [], 0
            for span in spans or []:
                pieces += [text[at : span["start"]], mask * (span["end"] - span["start"])]
                at = span["end"]
            out.append(text if not pieces else "".join([*pieces, text[at:]]))
        return pa.array(out, pa.string())

    return cover(text, found)


def _columns(found: Column) -> dict[str, Column]:
    return {
        "attr_pii_has_pii": F.size(found) > 0,
        "attr_pii_categories": F.sort_array(F.array_distinct(found["category"])),
    }


def add_pii(chunks: DataFrame) -> DataFrame:
    """Chunks with the two columns set."""
    return chunks.withColumn("_spans", spans(F.col("text"))).withColumns(_columns(F.col("_spans"))).drop("_spans")


def tag_pii(chunks: DataFrame) -> DataFrame:
    """(chunk_id, attr_pii_has_pii, attr_pii_categories)."""
    return add_pii(chunks.select("chunk_id", "text")).drop("text")


def pii_spans(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, start, end, category, value) for every accepted span."""
    found = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).withColumn("_spans", spans(F.col("_text")))
    each = found.select("_key", "_text", F.explode("_spans").alias("s"))
    value = F.substr("_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return each.select(F.col("_key").alias(key), "s.start", "s.end", "s.category", value.alias("value"))
