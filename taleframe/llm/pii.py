"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built from SQL functions; no Python runs on the executors.  Patterns never give back what they have
taken, and positions, contexts and redacted texts come from running sums and fixed-width code points, so a text
costs time in proportion to its length (times a small power of the number of its spans) whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import DOCUMENT_COLUMNS, LOWER as LOWERED
from taleframe.llm.common import UPPER, lower_ascii, read

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind: (cheap test that any match passes, pattern).  Kinds in the order of the result.
#: A match can only begin where its first run begins or where the last match ended; saying so with \\G
#: and a look-behind finds the same spans without trying every character of a long run.
PATTERNS = {
    "email": ("@[A-Za-z0-9-]", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("[A-Z]{2}[0-9]{2}[A-Z0-9 ]", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"),
    "secret": ("[A-Z0-9]{20}|[0-9a-f]{32}", r"\b(?:A[KS]IA[A-Z0-9]{16}|[0-9a-f]{32,64})\b"),
}
#: These kinds stay whatever their score; the others are kept from LEAST on.
BASE, LEAST = ("email", "ip", "card", "phone"), 70
#: Kind: (score of a confirmed span in percent, words nearby that raise it, words that lower it).
SCORES = {
    "email": (85, r"e-?mail|contact|write to|@", r"example of|regex"),
    "ip": (60, r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server|login", r"version|release|section|(?:^|[^a-z])v(?:[^a-z]|$)"),
    "card": (70, r"card|visa|credit|payment|master", r"token|hash|serial|isbn|order"),
    "phone": (70, r"phone|(?:^|[^a-z])tel(?:[^a-z]|$)|call|mobile|fax", r"version|score|sum"),
    "iban": (90, r"iban|account|bank|transfer", r"serial|part no"),
    "secret": (60, r"token|secret|passw|key|auth|credential", r"commit|checksum|sha|md5|digest|revision"),
}
#: Added to and taken from the score; a secret with a vendor's prefix needs no words nearby.
RAISE, LOWER, PREFIXED = 10, 30, 25
NEAR = 48
SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"
#: Items of a running sum that are added up in one piece.
_PIECE = 128


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, although it is used inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of whole numbers, what ``step`` (a sum or a maximum, from 0) makes of those before it.

    Appending to one array costs its length; pieces of _PIECE values with a sum carried from piece to piece do not.
    """

    def scan(items: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            items, begin, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
        )

    def whole(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _PIECE).cast("int")), lambda i: F.slice(v, i * _PIECE + 1, F.lit(_PIECE)))
        return _bind(pieces, lambda p: F.flatten(F.zip_with(p, scan(F.transform(p, lambda x: F.aggregate(x, F.lit(0), step)), F.lit(0)), scan)))

    return _bind(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _wide(text: Column) -> Column:
    """Four bytes for each code point, so that any stretch can be taken without a walk from the start."""
    return F.encode(text, "UTF-32")


def _stretch(wide: Column, start: Column, size: Column) -> Column:
    return F.decode(F.substr(wide, start * 4 + 1, size * 4), "UTF-32")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account code of letters and digits has remainder 1 modulo 97 (first four moved to the end)."""
    compact = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (a * 10 + n - 48) % 97).otherwise((a * 100 + n - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _small(part: Column) -> Column:
    """A run of digits is at most 255, whatever its length."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))


def _confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), _small)
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34), mod97(text)).otherwise(F.lit(False))
    if kind == "secret":  # digits only, or letters only, is a number or a word
        return F.rlike(text, F.lit("[0-9]")) & F.rlike(text, F.lit("[A-Za-z]"))
    return F.lit(True)


def _proposed(kind: str, text: Column) -> Column:
    """array<struct<start,text>> of all matches: gaps and matches alternate, so their lengths add up."""
    test, pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("text"))), lambda p: p["text"].isNotNull())

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + F.length(x["text"])), lambda a, x: a + x)
        return F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["text"].alias("text")))

    none = F.array().cast("array<struct<start:int,text:string>>")
    return F.when(F.rlike(text, F.lit(test)), _bind(pairs, placed)).otherwise(none)


def _spans(kind: str, wide: Column, proposed: Column) -> Column:
    base, up, down = SCORES[kind]

    def scored(p: Column) -> Column:
        size = F.length(p["text"])
        first = F.greatest(p["start"] - NEAR, F.lit(0))
        before = _stretch(wide, first, p["start"] - first)
        after = _stretch(wide, p["start"] + size, F.lit(NEAR // 2))
        near = lower_ascii(F.concat(before, F.lit(" "), after))
        score = F.lit(base) + F.when(F.rlike(near, F.lit(up)), RAISE).otherwise(0) - F.when(F.rlike(near, F.lit(down)), LOWER).otherwise(0)
        if kind == "secret":
            score = score + F.when(F.rlike(p["text"], F.lit("^A[KS]IA")), PREFIXED).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"), p["start"].alias("start"), (p["start"] + size).alias("end"), p["text"].alias("text"), F.round(score / 100, 2).alias("score")
        )

    out = F.transform(F.filter(proposed, lambda p: _confirmed(kind, p["text"])), scored).cast(SPAN)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST / 100)


def detect_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column spans, array<struct<kind,start,end,text,score>>, by start and then kind.

    Offsets count code points; end is exclusive.  Matches of one kind never overlap; those of two kinds may.
    A match that its checksum refuses is dropped and not tried again at another place.  Words in the NEAR
    characters before a span, or half as many after it, raise or lower its score; spans of the kinds outside
    BASE are kept from a score of LEAST percent on.  A null or empty text has no spans; texts of any length are
    read whole; repeated rows stay repeated; an empty table gives an empty result.  All other columns pass
    through, one named spans or starting with ``_pii_`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    for kind in PATTERNS:
        docs = docs.withColumn(f"_pii_{kind}", _proposed(kind, t))

    def ranked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(rank).alias("rank"), s.alias("span")))

    def ordered(wide: Column) -> Column:
        per_kind = [ranked(_spans(k, wide, F.col(f"_pii_{k}")), r) for r, k in enumerate(PATTERNS)]
        return F.transform(F.array_sort(F.concat(*per_kind)), lambda x: x["span"])

    any_ = sum((F.size(f"_pii_{k}") for k in PATTERNS), F.lit(0)) > 0
    found = F.when(any_, _bind(_wide(t), ordered)).otherwise(F.array().cast(SPAN))
    return docs.withColumn("spans", found).drop(*[f"_pii_{k}" for k in PATTERNS])


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``detect_pii`` by its kind in brackets; overlapping spans become one, named by the first.

    A text without spans, null or empty, stays as it is; other columns pass through; repeated rows stay repeated.
    """
    reached = running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    # a span that begins before an earlier one ends is part of that one
    opening = F.filter(F.zip_with("spans", reached, lambda s, r: F.struct(r.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))), lambda o: o["to"] >= o["from"])
    last = F.array_max(F.transform("spans", lambda s: s["end"]))

    def written(wide: Column) -> Column:
        parts = F.transform(opening, lambda o: F.concat(_stretch(wide, o["from"], o["to"] - o["from"]), F.lit("["), F.upper(o["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.decode(F.substr(wide, last * 4 + 1), "UTF-32"))

    return found.withColumn(text, F.when(F.size("spans") > 0, _bind(_wide(F.coalesce(F.col(text), F.lit(""))), written)).otherwise(F.col(text)))


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced and n_chars brought up to date; no document goes.

    Texts without spans (null and empty ones too) and their n_chars stay as they are; repeated rows stay repeated;
    columns other than those of documents go; an empty table gives an empty result.
    """
    clean = redact(detect_pii(docs.select(*DOCUMENT_COLUMNS)))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*DOCUMENT_COLUMNS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every row of documents, as counts and digests; ``scores`` in percent, by span.

    Null and empty texts have no spans (zero counts, the digest of nothing, empty strings); texts of any length are read
    whole; repeated rows and ids stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    found = detect_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores")
    )


_RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PATTERNS["iban"][1],
    "secret": PATTERNS["secret"][1],
}
_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
_CODE = "replace(t, ' ', '')"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(t, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || ltrim(p, '0'))::bigint <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::int ELSE (c::int * 2) % 10 + c::int // 5 END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"length({_CODE}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({_CODE}[5:] || {_CODE}[:4], ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, n: (a * (CASE WHEN n < 10 THEN 10 ELSE 100 END) + n) % 97) = 1",
    "secret": "regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]')",
}


def _sql_kind(rank: int, kind: str) -> str:
    p, (base, up, down) = _RE2[kind], SCORES[kind]
    prefixed = f" + CASE WHEN regexp_matches(t, '^A[KS]IA') THEN {PREFIXED} ELSE 0 END" if kind == "secret" else ""
    found = f"""SELECT n, {rank} AS rank, '{kind}' AS kind, s, s + length(t) AS e,
  {base} + CASE WHEN regexp_matches(near, '{up}') THEN {RAISE} ELSE 0 END - CASE WHEN regexp_matches(near, '{down}') THEN {LOWER} ELSE 0 END{prefixed} AS score FROM (
  SELECT n, t, s, translate(substr(text, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || ' ' || substr(text, s + length(t) + 1, {NEAR // 2}), '{UPPER}', '{LOWERED}') AS near FROM (
    SELECT n, text, m[i] AS t, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint AS s
    FROM (SELECT n, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT n, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')))) WHERE {_VALID[kind]})"""
    return found if kind in BASE else f"SELECT * FROM ({found}) WHERE score >= {LEAST}"


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_kind(r, k) for r, k in enumerate(PATTERNS))}),
joined AS (
  SELECT n, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(score::varchar, ',' ORDER BY s, rank) AS scores FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN joined USING (n)
"""
