"""Byte-level BPE encoding of a whole corpus with JVM-side higher-order functions.

Method.  A text is cut into words by the vocabulary's published split pattern.  A word is a byte array, written in
hexadecimal so that any byte string is a map key.  The rank of a token is its id, so one literal rank map serves both
the merges and the final ids.  ``fold`` joins the pair of lowest rank again and again (``aggregate`` over at most
bytes - 1 rounds; every non-overlapping occurrence of the pair goes in the same round).

Plan.  Two scans of the corpus and one small shuffle:

1. distinct words that are no single token are counted over all documents (map-side combine), and the ``frequent``
   most common ones (a documented bound, default 32,768) are folded once;
2. each document's words are looked up in the literal map of single tokens and folded words; the distinct words that
   remain in a document - rare by construction - are folded in place.

The text itself is never shuffled and no dictionary is joined back.  The only thing that reaches the driver is the
bounded list of frequent words.

Defined results: null or empty text gives an empty list; a special token's string is ordinary text; repeated rows are
encoded each; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the vocabulary's published split pattern for the JVM.  The alternatives exclude each other by their first
#: letters, so the commonest comes first; possessive quantifiers save the matcher its way back.
SPLIT = (
    r" ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{IsWhite_Space}\p{L}\p{N}]++"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
NO_RANK = 2**31 - 1
#: Hexadecimal digits from which a word is folded by all occurrences at once.
LONG = 256
BUCKETS = 1 << 15


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's rank file; TOKENIZER_DIR overrides the place."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def _literal(spark: SparkSession, entries: dict[str, object], kind: str) -> Column:
    """A literal array of small maps: a lookup is one hash and one short scan, whatever the size of the map.

    The array is a constant of the plan in Spark's flat binary form, so a task reads it as one block of bytes instead
    of building an object for each entry.
    """
    parts: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        parts[_bucket(key)][key] = value
    one = spark.range(1).select(F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{kind}>>").alias("m"))
    jvm = spark._jvm
    value = one._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0).copy()
    expr = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, one._jdf.schema().apply(0).dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expr))


def _lookup(table: Column, key: Column) -> Column:
    at = (F.crc32(key.cast("binary")) % BUCKETS + 1).cast("int")
    return F.try_element_at(F.element_at(table, at), key)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(word_hex: Column, ranks: Column) -> Column:
    """Token ids of one word given in hexadecimal; ``ranks`` is the literal rank map.

    The state holds the pieces and the rank of each neighbouring pair.  A round joins the leftmost pair of lowest rank and
    looks up only the two pairs it changed.
    """
    rank = lambda a, b: F.coalesce(_lookup(ranks, F.concat(a, b)), F.lit(NO_RANK))
    at = F.element_at
    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest((F.length(word_hex) / 2).cast("int"), F.lit(1))),
        lambda i: F.substring(word_hex, 2 * i - 1, F.lit(2)),
    )
    start = _let(
        pieces,
        lambda t: F.struct(
            t.alias("t"),
            F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: rank(at(t, i), at(t, i + 1))))
            .otherwise(F.array().cast("array<int>"))
            .alias("r"),
        ),
    )

    def join(t: Column, r: Column, p: Column) -> Column:
        def around(x: Column) -> Column:
            before = F.when(p > 1, F.array(rank(at(t, p - 1), x))).otherwise(F.array().cast("array<int>"))
            after = F.when(p < F.size(r), F.array(rank(x, at(t, p + 2)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(t, F.lit(1), p - 1), F.array(x), F.slice(t, p + 2, F.size(t))).alias("t"),
                F.concat(F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(r, p + 2, F.size(t))).alias("r"),
            )

        return _let(F.concat(at(t, p), at(t, p + 1)), around)

    def step(state: Column, _: Column) -> Column:
        return _let(
            F.coalesce(F.array_min(state["r"]), F.lit(NO_RANK)),
            lambda m: F.when(m == NO_RANK, state).otherwise(
                _let(F.array_position(state["r"], m).cast("int"), lambda p: join(state["t"], state["r"], p))
            ),
        )

    rounds = F.sequence(F.lit(1), F.greatest(F.length(word_hex) / 2 - 1, F.lit(1)).cast("int"))
    one_by_one = F.aggregate(rounds, start, step, lambda s: s["t"])
    return F.transform(F.when(F.length(word_hex) > LONG, _fold_long(start, rounds, step, rank)).otherwise(one_by_one), lambda p: _lookup(ranks, p))


def _fold_long(start: Column, rounds: Column, step, rank) -> Column:
    """The fold of a long word: a round joins every occurrence of the lowest rank, left to right, if that equals joining them
    one after the other - that is, if no pair that arises on the way or at the end ranks lower - and else only the first.
    """
    at = F.element_at

    def all_of(state: Column, m: Column) -> Column:
        t, r = state["t"], state["r"]
        marks = F.array_join(F.transform(r, lambda x: F.when(x == m, "1").otherwise("0")), "")
        # an occurrence that overlaps the one before it is void: of 111 the first and the last are joined
        marks = F.split(F.concat(F.translate(F.replace(marks, F.lit("11"), F.lit("20")), "1", "2"), F.lit("00")), "")

        def joined(k: Column) -> Column:
            pieces = F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.size(t)),
                    lambda i: F.when((i > 1) & (at(k, F.greatest(i - 1, F.lit(1))) == "2"), F.lit(None)).otherwise(
                        F.struct(
                            F.when(at(k, i) == "2", F.concat(at(t, i), F.try_element_at(t, i + 1))).otherwise(at(t, i)).alias("t"),
                            F.when((at(k, i) == "2") | (at(k, i + 1) == "2"), F.lit(-1)).otherwise(F.try_element_at(r, i)).alias("r"),
                            F.when((at(k, i) == "2") & (i + 2 <= F.size(t)), rank(F.concat(at(t, i), F.try_element_at(t, i + 1)), F.try_element_at(t, i + 2)))
                            .otherwise(F.lit(NO_RANK)).alias("passing"),
                        )
                    ),
                ),
                lambda x: x.isNotNull(),
            )

            def ranked(u: Column) -> Column:
                new_r = F.transform(
                    F.when(F.size(u) > 1, F.sequence(F.lit(1), F.size(u) - 1)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.when(at(u, i)["r"] == -1, rank(at(u, i)["t"], at(u, i + 1)["t"])).otherwise(at(u, i)["r"]),
                )
                lowest = F.least(F.coalesce(F.array_min(new_r), F.lit(NO_RANK)), F.array_min(F.transform(u, lambda x: x["passing"])))
                return F.struct(F.transform(u, lambda x: x["t"]).alias("t"), new_r.alias("r"), (lowest < m).alias("differs"))

            return _let(pieces, ranked)

        return _let(
            _let(marks, joined),
            lambda n: F.when(n["differs"], step(state, F.lit(0))).otherwise(F.struct(n["t"].alias("t"), n["r"].alias("r"))),
        )

    def round_of(state: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(state["r"]), F.lit(NO_RANK)), lambda m: F.when(m == NO_RANK, state).otherwise(all_of(state, m)))

    return F.aggregate(rounds, start, round_of, lambda s: s["t"])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def _hex(word: Column) -> Column:
    return F.hex(F.encode(word, "utf-8"))


def encode(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, frequent: int = 32768
) -> DataFrame:
    """Rows of ``df`` reduced to ``keep`` plus ``ids``, the list of token ids of ``text``."""
    spark = df.sparkSession
    ranks = load_ranks(vocabulary or default_vocabulary())
    single = {k.hex().upper(): v for k, v in ranks.items()}
    rank_map = _literal(spark, single, "int")
    docs = df.select(*[F.col(k) for k in keep], words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))

    counted = docs.select(F.explode("_w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # the condition names n so that the look-up follows the count: once for each distinct word, not for each word
    unknown = counted.where(F.when(F.col("n") > 0, _lookup(rank_map, _hex(F.col("w")))).isNull())
    top = unknown.orderBy(F.desc("n"), "w").limit(frequent)
    known = {r["w"]: r["ids"] for r in top.select("w", fold(_hex(F.col("w")), rank_map).alias("ids")).collect()}
    for token, at in ranks.items():
        try:
            known[token.decode()] = [at]
        except UnicodeDecodeError:
            continue
    table = _literal(spark, known, "array<int>")

    found = docs.select(*keep, "_w", F.transform("_w", lambda w: _lookup(table, w)).alias("_i"))
    rest = F.array_distinct(F.filter("_w", lambda w, i: F.element_at("_i", i + 1).isNull()))
    own = F.map_from_entries(F.transform(rest, lambda w: F.struct(w, fold(_hex(w), rank_map))))
    # flatten is null if a word was not found: only then are rare words folded
    rare = _let(own, lambda m: F.flatten(F.transform("_i", lambda x, i: F.coalesce(x, F.try_element_at(m, F.element_at("_w", i + 1))))))
    return found.select(*keep, F.coalesce(F.flatten("_i"), rare).alias("ids"))


def decode(ids: Column, vocabulary: str | None = None, step: int = 64) -> Column:
    """Text of a list of token ids: the tokens' binary pieces laid end to end, ``step`` at a time so that long lists don't copy their start again and again."""
    ranks = load_ranks(vocabulary or default_vocabulary())
    by_id = [""] * (max(ranks.values()) + 1)
    for token, at in ranks.items():
        by_id[at] = base64.b64encode(token).decode()
    # a constant of the plan: JSON holds binary values in base64
    pieces, empty = F.from_json(F.lit(json.dumps(by_id)), "array<binary>"), F.lit(b"")
    own = lambda k: F.aggregate(F.slice(ids, k * step + 1, F.lit(step)), empty, lambda out, i: F.concat(out, F.element_at(pieces, i + 1)))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(ids), F.lit(1)) - 1) / step).cast("int"))
    return F.decode(F.aggregate(F.transform(starts, own), empty, lambda out, part: F.concat(out, part)), "utf-8")
