"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Everything is a DataFrame expression. Base kinds (email, ip, card, phone) always stay; IBANs must pass mod 97 and
national ids need a context word before or after them. A null text is an empty one. Offsets count code points. Spans that
start together keep the order of KINDS. Patterns use possessive repeats and start only where a run starts, so a long run of
digits or letters is read once. What stands at a place is cut from pieces of equal length, not from the whole text, so time
grows with a text's length and its spans, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed order of the kinds; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this cannot hold the kind; it spares most texts the full pattern.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "national_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score before context, and words that raise it when they stand within REACH characters before or after the span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|write to|reply",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": r"phone|\btel\b|mobile|call|fax|whatsapp",
    "iban": r"iban|account|\bbank\b|transfer",
    "national_id": r"\bssn\b|social security|national id|tax id",
}
RAISE, THRESHOLD, REACH = 0.3, 0.5, 40
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return let(F.translate(m, " -", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return let(F.translate(m, " ", ""), lambda d: F.when(F.length(d).between(15, 34), mod97(d)).otherwise(False))
    return F.lit(True)


PIECE = 1024


def pieces_of(text: Column) -> Column:
    """A text cut into pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, what lies beyond the text left out."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


_SPAN = "struct<start:int,rank:int,end:int,score:double>"


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind, in order. The text between matches gives their places; found spans gather in small
    arrays that are joined at the end, so a text with very many spans isn't copied again and again."""
    none = F.lit(None).cast(f"array<{_SPAN}>")
    empty, deep = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<array<{_SPAN}>>")
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), empty.alias("few"), deep.alias("done"))

    def score(cut: Column, at: Column, end: Column) -> Column:
        near = F.lower(F.concat_ws("\n", between(cut, F.greatest(at - REACH, F.lit(0)), at), between(cut, end, end + REACH)))
        return F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(min(RAISE, 1 - PRIOR[kind]))).otherwise(F.lit(0.0))

    def add(acc: Column, pair: Column, cut: Column) -> Column:
        at, m = acc["at"] + pair["gap"], pair["m"]
        end = at + F.length(m)

        def put(s: Column) -> Column:
            one = F.array(F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), s.alias("score")).cast(_SPAN))
            full = F.size(acc["few"]) >= 255
            return F.struct(
                end.alias("at"),
                F.when(full, empty).otherwise(F.concat(acc["few"], one)).alias("few"),
                F.when(full, F.concat(acc["done"], F.array(F.concat(acc["few"], one)))).otherwise(acc["done"]).alias("done"),
            )

        skip = F.struct(end.alias("at"), acc["few"].alias("few"), acc["done"].alias("done"))
        here = let(score(cut, at, end), lambda s: F.when((s >= THRESHOLD) | F.lit(kind in KINDS[:4]), put(s)).otherwise(skip))
        return F.when(_confirmed(kind, m), here).otherwise(skip)

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    got = let(pieces_of(text), lambda cut: F.aggregate(pairs, start, lambda acc, pair: add(acc, pair, cut), lambda acc: F.concat(F.flatten(acc["done"]), acc["few"])))
    return F.coalesce(F.when(GATES[kind](text), got).otherwise(none), empty)


def spans(text: Column) -> Column:
    """All spans of a text, by start and then kind."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.sort_array(F.concat(*[_spans(k, t) for k in KINDS])))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of the base spans, all spans and their scores."""
    def row(s: Column) -> Column:
        def count(rank: int) -> Column:
            return F.size(F.filter(s, lambda x: x["rank"] == rank)).cast("long")

        n = [count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
        base = F.filter(s, lambda x: x["rank"] < 4)
        scores = F.array_join(F.transform(s, lambda x: F.round(x["score"], 2).cast("string")), ",")
        return F.struct(*n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"), scores.alias("scores"))

    return docs.select("doc_id", let(spans(F.col("text")), row).alias("pii")).select("doc_id", "pii.*")


def mask(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every span of ``text`` replaced by its kind in square brackets. A null text stays
    null. Of spans that overlap, the one that starts first is named and the replaced range reaches to the last end."""
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    empty, deep = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def over(t: Column) -> Column:
        def joined(s: Column, cut: Column) -> Column:
            begin = F.struct(F.lit(0).alias("past"), empty.alias("few"), deep.alias("done"))

            def add(acc: Column, x: Column) -> Column:
                # a gap before the span and its kind, unless a span before reaches over its start
                new = F.when(x["start"] >= acc["past"], F.array(between(cut, acc["past"], x["start"]), F.get(kind, x["rank"]))).otherwise(empty)
                full = F.size(acc["few"]) >= 255
                return F.struct(
                    F.greatest(acc["past"], x["end"]).alias("past"),
                    F.when(full, new).otherwise(F.concat(acc["few"], new)).alias("few"),
                    F.when(full, F.concat(acc["done"], F.array(acc["few"]))).otherwise(acc["done"]).alias("done"),
                )

            def end(acc: Column) -> Column:
                return F.concat(F.array_join(F.flatten(acc["done"]), ""), F.array_join(acc["few"], ""), between(cut, acc["past"], F.greatest(acc["past"], F.length(t))))

            return F.aggregate(s, begin, add, end)

        whole = lambda s: F.when(F.size(s) == 0, t).otherwise(let(pieces_of(t), lambda cut: joined(s, cut)))
        return F.when(t.isNull(), t).otherwise(let(spans(t), whole))

    return docs.withColumn("text", let(F.col("text"), over))
