"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base entities (e-mail and IP addresses, card and phone numbers) are found by expressions and checks.
Mentions are all stretches that look like an identifier. A mention that passes a base check, or is a
long run of hexadecimal digits, seeds its kind. The one to three tokens before a mention, since the mention before it, are its
lexical patterns. In rounds, Spark scores the graph of patterns and distinct mentioned values: a
pattern's confidence in a kind is the share of its values known to be of it, a value's is the noisy-or
of its confident patterns. Values that come out confident are known in all later rounds, which go on
until one finds no further value; in the end each of their mentions is a span too.

Cases: a null text is an empty one; expressions match leftmost and don't overlap within a kind, and a
match that fails its check is dropped without another try inside it; spans of different kinds may
overlap; repeated rows and ids keep a row each; very long texts and tokens are looked at whole; an empty table gives an empty table; other columns
are ignored. Starts and ends are in code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .rows import shared_if_small

#: The least values of a pattern, and the least confidence of a pattern and of a value.
LEAST_VALUES, PATTERN, VALUE = 3, 0.6, 0.8
#: The end of a text, written backwards, that has its last three tokens.
LAST_TOKENS = r"^\s*+(?:(?:\p{L}++|[^\s\p{L}])\s*+){0,3}+"

#: Kinds in their order, and the expression of each. Runs are possessive and begin where
#: no match could have begun earlier, so that no text takes more than a time in proportion to its length.
KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_STOP = r"\s\"'=,;:()<>|"
MENTION = rf"(?<![^{_STOP}])(?:{PHONE}|[0-9]++(?:[ -][0-9]++)++(?![^{_STOP}])|[^{_STOP}0-9@]*+[0-9@][^{_STOP}]*+)"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, have a digit sum that ends in 0."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a kind's expression passes the kind's check."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _matches(text: Column, kind: str, expression: str, may: Column) -> Column:
    """An array of (kind, gap before, value, end of the gap) of all matches in order; ``may``: a cheap necessary condition."""
    both = F.zip_with(
        F.split(text, expression, -1),
        F.regexp_extract_all(text, F.lit(expression), F.lit(0)),
        lambda gap, value: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), value.alias("value"), (F.reverse(F.regexp_extract(F.reverse(gap), LAST_TOKENS, 0)) if kind == "mention" else F.lit(None).cast("string")).alias("before")),
    )
    return F.when(may, F.filter(both, lambda x: x["value"].isNotNull()))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``doc_id``, ``kind``, ``start``, ``end``, ``value`` and ``before`` of all matches, and for each row one of kind ''."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text = F.col("text")
    digit, at = text.rlike("[0-9]"), text.contains("@")
    found = [_matches(text, "email", EMAIL, at), _matches(text, "ip", IP, digit), _matches(text, "card", CARD, digit), _matches(text, "phone", PHONE, text.contains("+") & digit), _matches(text, "mention", MENTION, digit | at)]
    none = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("gap"), F.lit("").alias("value"), F.lit(None).cast("string").alias("before")))
    listed = F.concat(none, *[F.coalesce(f, F.slice(none, 1, 0)) for f in found])
    each = texts.select("row", "doc_id", F.posexplode(listed).alias("n", "m")).select("row", "doc_id", "n", "m.*")
    line = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.length("value")).cast("long")).over(line)
    placed = each.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(passes("ip", F.col("value")) | (F.col("kind") != "ip")).where(passes("card", F.col("value")) | (F.col("kind") != "card")).where(passes("phone", F.col("value")) | (F.col("kind") != "phone")).select("row", "doc_id", "kind", "start", "end", "value", "before")


def _seed_kind(value: Column) -> Column:
    """The kind that a mention seeds, or null."""
    whole = lambda e: value.rlike(f"^(?:{e})$")
    checks = [(k, whole(e) & passes(k, value)) for k, e in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))]
    checks.append(("secret", value.rlike("^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$")))
    kind = F.when(checks[0][1], checks[0][0])
    for name, holds in checks[1:]:
        kind = kind.when(holds, name)
    return kind


def _patterns(before: Column) -> Column:
    """The last one, two and three tokens before a mention, digits made alike."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(before), "[0-9]+", "0"), F.lit(r"\p{L}+|[^\s\p{L}]"), F.lit(0))
    n = F.size(tokens)
    parts = [F.when(n >= k, F.concat(F.lit(f"{k}:"), F.array_join(F.slice(tokens, -k, k), " "))) for k in (1, 2, 3)]
    return F.array_compact(F.array(*parts))


def discover(mentions: DataFrame) -> DataFrame:
    """``value``, ``kind`` and ``confidence`` of values that confident patterns find, from ``mentions`` (value, before)."""
    edges = mentions.select("value", F.explode(_patterns(F.col("before"))).alias("pattern")).distinct()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_VALUES)
    # patterns of fewer values are never trusted
    edges = cut(edges.join(sizes, "pattern").withColumn("seed", _seed_kind(F.col("value"))))
    open_values = edges.where(F.col("seed").isNull() & F.col("value").rlike(r"[0-9@].*[0-9@]") & (F.length("value") >= 6)).select("value", "pattern")
    fresh = edges.where(F.col("seed").isNotNull()).select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    held, found = None, None
    while True:  # a value is found once, so there is a last round
        more = edges.select("value", "pattern", "size").join(fresh, "value").groupBy("pattern", "size", "kind").agg(F.sum("confidence").alias("held"))
        held = cut(more if held is None else held.unionByName(more).groupBy("pattern", "size", "kind").agg(F.sum("held").alias("held")))
        trusted = held.withColumn("trust", F.col("held") / (F.col("size") + 1)).where(F.col("trust") >= PATTERN).select("pattern", "kind", "trust")
        doubt = F.sum(F.log(1 - F.least("trust", F.lit(0.999))))
        left = open_values if found is None else open_values.join(found, "value", "left_anti")
        each = left.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
        best = each.groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("value", "b.kind", "b.confidence")
        fresh = cut(best.where(F.col("confidence") >= VALUE))
        found = fresh if found is None else cut(found.unionByName(fresh))
        if fresh.isEmpty():
            return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id`` and ``found``, an array of (place of the kind in ``KINDS``, start, end, whether it is a base
    entity), in order and distinct.
    """
    occurrences = cut(_occurrences(docs, id_col, text_col))
    mentions = occurrences.where("kind = 'mention'")
    new = discover(mentions.select("value", "before"))
    added = mentions.drop("kind").join(new.select("value", "kind"), "value").select("row", "doc_id", "kind", "start", "end", F.lit(False).alias("base"))
    base = occurrences.where("kind != 'mention'").select("row", "doc_id", "kind", "start", "end", F.lit(True).alias("base"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.when(F.col("kind") != "", F.struct(place.alias("kind"), "start", "end", "base"))
    return base.unionByName(added).groupBy("row", "doc_id").agg(F.array_sort(F.array_distinct(F.collect_list(span))).alias("found")).drop("row")


def _spelled(spans: Column) -> Column:
    """``kind:start:end``, joined by commas, for spans as ``find`` gives them."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(F.array_distinct(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string")))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a count of each base kind, ``base_sha256`` over the base spans and ``spans``, all spans, for each row."""
    found = find(docs, id_col, text_col)
    base = F.filter("found", lambda x: x["base"])

    def count(kind: str) -> Column:
        place = KINDS.index(kind) + 1
        return F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == place))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_spelled(base).cast("binary"), 256).alias("base_sha256"), _spelled(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets, capitals; of spans that overlap, the first, then the longest.

    Texts are looked up by a digest, so repeated texts are redacted alike; a null text stays null.
    """
    given = F.struct(*[docs[c] for c in docs.columns]).alias("given")  # whatever its columns are called
    keyed = docs.select(given, F.md5(docs[text_col].cast("binary")).alias("_key"))
    found = find(keyed.select("_key", F.col("given")[text_col].alias("_text")), "_key", "_text")
    found = cut(found.where((F.size("found") > 0) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_key")).agg(F.first("found").alias("_found")))
    spans = F.array_sort(F.transform("_found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    name = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"])), F.lit("]"))
    joined = keyed.join(shared_if_small(found), "_key", "left")
    text = F.col("given")[text_col]
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), name(x)).alias("out"), (-x["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return joined.select(*[F.when(F.col("_found").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col("given")[c].alias(c) for c in docs.columns])
