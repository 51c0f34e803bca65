"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards,
modulo 97 for IBANs, ranges for addresses and numbers), and words in the 40
characters before a span adjust its score. The base kinds (email, ip, card,
phone) stay whatever their score; the kinds that the method adds (iban, ssn,
phone_local) need a score of ``ACCEPT``: an IBAN reaches it by its checksum,
the other two only beside a word that names them.

Matches are leftmost and do not overlap within a kind. Offsets are found
without leaving the JVM: the pieces between the matches (split) and the
matches (regexp_extract_all) alternate, so their lengths add up to the starts.
Patterns use possessive repetition and start only where a run starts, so very
long runs take linear time and no deep recursion.

Scale: one pass over the texts, no shuffle; texts without the characters that
a kind needs skip its patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.8
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL over the text: whether the pattern can match at all.
    needs: str
    #: SQL over ``text`` and the span ``x``: the validators.
    valid: str
    score: float
    context: str
    base: bool = True


SPAN = "struct<start:int,rank:int,stop:int,kind:string,text:string,score:double>"
_DIGITS = r"regexp_replace(x.text, '[^0-9]', '')"
_ALONE = r"not substring(text, greatest(x.start, 1), least(x.start, 1)) rlike '[A-Za-z0-9+.-]' and not substring(text, x.stop + 1, 1) rlike '[A-Za-z0-9]'"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The number of an IBAN modulo 97, its first four characters moved to the end and letters read as 10 to 35.
_MOD97 = (
    r"aggregate(transform(split(concat(substring(replace(x.text, ' ', ''), 5), substring(replace(x.text, ' ', ''), 1, 4)), ''),"
    r" c -> if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55)), 0, (a, v) -> (a * if(v < 10, 10, 100) + v) % 97)"
)

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.9, "e-?mail|contact|write|mailto"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "digits", rf"x.text rlike '^{_BYTE}([.]{_BYTE}){{3}}$'", 0.8, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "digits", f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})", 0.9, "card|visa|mastercard|credit|payment|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "digits and contains(text, '+')", f"length({_DIGITS}) between 10 and 15", 0.8, "phone|tel|call|mobile|fax|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "digits", f"length(replace(x.text, ' ', '')) between 15 and 34 and {_ALONE} and {_MOD97} = 1", 0.8, "iban|account|bank|transfer", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "digits and contains(text, '-')", f"{_ALONE} and not x.text rlike '^(000|666|9)|-00-|0000$'", 0.5, "ssn|social security|security number", False),
    Kind("phone_local", r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", "digits", _ALONE, 0.5, "phone|tel|call|mobile|fax|whatsapp", False),
)
_BONUS = 0.4




def _spans(kind: Kind, at: int) -> Column:
    """All accepted spans of one kind in order of their starts; the text's pieces and matches are columns p_<at>, m_<at>."""
    starts = (
        f"aggregate(arrays_zip(p_{at}, m_{at}), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,m:string>>)),"
        f" (a, z) -> if(z.m_{at} is null, a, named_struct('at', a.at + length(z.p_{at}) + length(z.m_{at}),"
        f" 'out', concat(a.out, array(named_struct('start', a.at + length(z.p_{at}), 'm', z.m_{at}))))), a -> a.out)"
    )
    beside = f"lower(substring(text, greatest(1, s.start - {CONTEXT - 1}), least(s.start, {CONTEXT})))"
    score = f"round(least(1.0D, {kind.score}D + if({beside} rlike '(^|[^a-z])({kind.context})([^a-z]|$)', {_BONUS}D, 0.0D)), 2)"
    found = f"transform({starts}, s -> struct(s.start as start, {at} as rank, s.start + length(s.m) as stop, '{kind.name}' as kind, s.m as text, {score} as score))"
    kept = f"filter({found}, x -> {kind.valid}" + ("" if kind.base else f" and x.score >= {ACCEPT}D") + ")"
    return F.expr(f"if(p_{at} is null, cast(array() as array<{SPAN}>), {kept})")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<start, rank, stop, kind, text, score>>)``: one row per row of ``docs``.

    Offsets count code points from 0, stop is exclusive; spans go by start,
    then kind in the order of ``KINDS``. Null and empty texts have no spans;
    null ids and repeated rows keep their rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digits", F.expr("text rlike '[0-9]'"))
    cut = {}
    for at, kind in enumerate(KINDS):
        cut[f"p_{at}"] = F.when(F.expr(kind.needs), F.split("text", kind.pattern, -1))
        cut[f"m_{at}"] = F.when(F.expr(kind.needs), F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)))
    spans = F.array_sort(F.concat(*[_spans(kind, at) for at, kind in enumerate(KINDS)]))
    return rows.select("*", *[c.alias(n) for n, c in cut.items()]).select("doc_id", spans.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_pii(docs)
    count = lambda at: F.size(F.filter("spans", lambda s: s["rank"] == at)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < sum(k.base for k in KINDS))
    return found.select(
        "doc_id", *[count(at).alias(f"n_{k.name}") for at, k in enumerate(KINDS) if k.base], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
