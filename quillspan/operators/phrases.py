"""Phrases of a dictionary in texts: an index of aliases met by equi-joins, longest first, then rounds for misspelt words.

The index has, for each beginning of ``HEAD`` characters, the lengths of the aliases that begin so. Each place of a text looks up its beginning, then
one stretch of each of those lengths by itself: what a place costs depends on the lengths of aliases and not on their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import gestalt
from ..functions.text import characters, once
from ..session import cut

#: Characters of an alias's beginning; shorter ones are looked up as a whole.
HEAD = 4
#: Characters of aliases and names that are shared with every task; a larger dictionary is met by sorting.
SHARED = 1_000_000
#: Aliases applied to a text, rounds for misspelt words, spans looked at in a round, and the least similarity.
APPLIED, ROUNDS, SPANS, RATIO = 5, 3, 12, 0.7
#: Stands for what has been rewritten already, a character for each of its own.
MASK = "\x00"


def hits(texts: DataFrame, aliases: DataFrame, shortest: int = 2) -> DataFrame:
    """``id``, ``start`` (from 1), ``alias``, ``canonical``: every place of the lower-cased texts (id, text) where an alias (alias, canonical) of ``shortest``
    characters or more stands.
    """
    names = aliases.where(F.length("alias") >= shortest).select(F.lower("alias").alias("alias"), "canonical").distinct()
    heads = names.select(F.substring("alias", 1, HEAD).alias("head"), F.length("alias").alias("size")).distinct().groupBy("head").agg(F.collect_set("size").alias("sizes"))
    held = names.agg(F.max(F.length("alias")).alias("longest"), F.sum(F.length("alias") + F.coalesce(F.length("canonical"), F.lit(0))).alias("all")).first()
    longest = held["longest"] or 0
    # said outright: Spark takes the places of texts for as few as the texts, and would send them to the driver to share them
    met = F.broadcast if (held["all"] or 0) <= SHARED else lambda df: df.hint("merge")
    # from an array of characters: in a string each place would be found by counting from its start
    low = texts.where("length(text) > 0").select("id", once(characters(F.lower("text"))).alias("c"))
    stretches = F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.array_join(F.slice("c", i, F.lit(longest)), ""))
    places = low.select("id", F.posexplode(stretches).alias("start", "ahead")).select("id", (F.col("start") + 1).alias("start"), "ahead") if longest else low.select("id", F.lit(1).alias("start"), F.lit("").alias("ahead"))
    beginnings = places.withColumn("head", F.explode(F.array_distinct(F.array(*[F.substring("ahead", 1, n) for n in range(min(shortest, HEAD), HEAD + 1)]))))  # a short alias is its own
    found = beginnings.join(met(heads), "head").select("id", "start", "ahead", F.explode("sizes").alias("size")).where("length(ahead) >= size")
    return found.select("id", "start", F.expr("substring(ahead, 1, size)").alias("alias")).join(met(names), "alias").select("id", "start", "alias", "canonical")


def longest_first(found: DataFrame, most: int = APPLIED) -> DataFrame:
    """``id`` and ``spans`` (size, alias, canonical, start): of each text's hits the longest, then by alias, canonical and place, that don't
    overlap, one for a canonical name, at most ``most``; in the order in which they are taken. There may be one row for every text, so a join with it isn't broadcast.
    """
    row = F.struct((-F.length("alias")).alias("size"), "alias", "canonical", "start")
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("all"))  # as long as the text at most, for each alias length

    def step(taken: Column, x: Column) -> Column:
        meets = F.exists(taken, lambda t: (t["canonical"] == x["canonical"]) | ((t["start"] < x["start"] - x["size"]) & (x["start"] < t["start"] - t["size"])))
        return F.when((F.size(taken) < most) & ~meets, F.array_append(taken, x)).otherwise(taken)

    return listed.select("id", F.aggregate("all", F.slice("all", 1, 0), step).alias("spans")).hint("merge")


def replaced(text: Column, spans: Column, with_: Column | None = None) -> Column:
    """The text with each of ``spans`` replaced by its canonical name, or by ``with_`` (of the span)."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["size"]).alias("size"), x["canonical"].alias("canonical"))))
    new = (lambda x: x["canonical"]) if with_ is None else with_
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"], x["start"] - acc["at"]), new(x)).alias("out"), (x["start"] + x["size"]).alias("at"))
    return F.aggregate(order, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))


def rewrite(texts: DataFrame, aliases: DataFrame, fuzzy: bool = True, words: DataFrame | None = None) -> DataFrame:
    """``id``, ``text`` (rewritten) and ``applied`` (before, after, method), for each of ``texts`` (id, text).

    Aliases that aren't the name itself give way to it (``longest_first``). With ``fuzzy``, up to three rounds follow: the text as it is then is cut into
    words, of which those of 4 to 8 letters that no rewriting made are held against all aliases, the longest word first. The first that is one
    edit and a gestalt ratio of 0.7 or more from an alias, and not itself a word of ``words`` (word), gives way to the alias's name; of several aliases the longest, then the first, counts.
    A word is tried once.
    """
    other = aliases.where(F.lower("alias") != F.lower("canonical"))
    spans = longest_first(hits(texts, other))
    fill = lambda x: F.repeat(F.lit(MASK), F.length(x["canonical"]).cast("int"))
    done = F.transform("spans", lambda x: F.struct(x["alias"].alias("before"), x["canonical"].alias("after"), F.lit("exact").alias("method")))
    none = F.array().cast("array<struct<before:string,after:string,method:string>>")
    # as one struct: inside lambdas a name would mean the new column of that name
    row = F.struct(
        "id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("spans"))).alias("text"),
        F.when(F.col("spans").isNull(), F.lower("text")).otherwise(replaced(F.lower("text"), F.col("spans"), fill)).alias("masked"),
        F.coalesce(done, none).alias("applied"), F.array().cast("array<string>").alias("tried"),
    )
    state = texts.join(spans, "id", "left").select(row.alias("r")).select("r.*")
    if not fuzzy:
        return state.select("id", "text", "applied")
    state, near = cut(state), cut(_neighbours(aliases.where("length(alias) >= 4").select(F.lower("alias").alias("alias"), "canonical").distinct(), "alias"))
    for _ in range(ROUNDS):
        state, moved = _round(state, near, words)
        if not moved:
            break
    return state.select("id", "text", "applied")


def _neighbours(words: DataFrame, col: str) -> DataFrame:
    """``words`` under ``key``: each word, and it without one of its characters."""
    less = F.expr(f"transform(sequence(1, length({col})), i -> concat(substr({col}, 1, i - 1), substr({col}, i + 1)))")
    return words.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(col), less))))


def _round(state: DataFrame, near: DataFrame, words: DataFrame | None) -> tuple[DataFrame, bool]:
    """One more word of each text, if there is one that fits; and whether any text has changed."""
    found = F.array_distinct(F.regexp_extract_all("masked", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    fresh = F.array_except(F.filter(found, lambda w: F.length(w).between(4, 8)), F.col("tried"))
    longest = F.array_sort(F.transform(fresh, lambda w: F.struct((-F.length(w)).alias("size"), w.alias("span"))))
    open_texts = cut(state.where(F.size("applied") < APPLIED).select("id", F.transform("applied", lambda x: F.lower(x["after"])).alias("names"), F.slice(longest, 1, SPANS).alias("spans")))
    each = open_texts.select("id", "names", F.posexplode("spans").alias("place", "s")).select("id", "names", "place", F.col("s.span").alias("span")).where("NOT array_contains(names, span)")
    if words is not None:
        each = each.join(words.select(F.lower("word").alias("span")).distinct(), "span", "left_anti")
    met = _neighbours(each.select("span").distinct(), "span").join(near, "key").where((F.levenshtein("span", "alias") == 1)).select("span", "alias", "canonical").distinct()
    fine = met.withColumn("ratio", gestalt("span", "alias")).where(F.col("ratio") >= RATIO)
    best = fine.groupBy("span").agg(F.min(F.struct((-F.length("alias")).alias("size"), "alias", "canonical")).alias("m")).select("span", "m.canonical")
    first = each.join(best, "span").groupBy("id").agg(F.min(F.struct("place", "span", "canonical")).alias("hit"))
    tried = F.transform(F.col("spans"), lambda s: s["span"])
    joined = state.join(open_texts.select("id", "spans"), "id", "left").join(first, "id", "left")
    span, name = F.col("hit.span"), F.col("hit.canonical")
    at = F.position(span, F.col("masked"))
    swap = lambda c, new: F.when(F.col("hit").isNull(), F.col(c)).otherwise(F.concat(F.substring(F.col(c), F.lit(1), at - 1), new, F.substring(F.col(c), at + F.length(span), F.length(F.col(c))))).alias(c)
    looked = F.when(F.col("hit").isNull(), tried).otherwise(F.slice(tried, F.lit(1), F.coalesce(F.col("hit.place"), F.lit(0)) + 1))
    more = F.array(F.struct(span.alias("before"), name.alias("after"), F.lit("edit").alias("method")))
    row = F.struct(
        "id", swap("text", name), swap("masked", F.repeat(F.lit(MASK), F.length(name).cast("int"))), F.when(F.col("hit").isNull(), F.col("applied")).otherwise(F.concat("applied", more)).alias("applied"),
        F.coalesce(F.concat("tried", looked), F.col("tried")).alias("tried"), F.col("hit").isNotNull().alias("moved"),
    )
    after = cut(joined.select(row.alias("r")).select("r.*"))
    return after.drop("moved"), not after.where("moved").isEmpty()
