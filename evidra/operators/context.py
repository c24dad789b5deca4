"""Context assembly: chunks of sources as JSON lines, in round-robin over buckets, until a token budget is spent."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as T

# The longest chunk in tokens, and tokens kept free beside the instructions.
CHUNK_LIMIT, MARGIN = 500, 512
# Words that set a chunk's category, first match.
CATEGORIES = [(0, ["public email:"]), (1, ["founder", "chief", "profile link", "our team"]), (2, ["built for", "developers", "teams", "customers"])]
#: Splits text before its words are merged, as the byte-level vocabularies of tiktoken expect.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(model: str, vocabulary: str = "", pattern: str = PATTERN):
    """The tokenizer of a model, or the one in a .tiktoken vocabulary file; an unknown model raises."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    if vocabulary:
        return tiktoken.Encoding(name=vocabulary, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(vocabulary), special_tokens={})
    if model.startswith("gemini-"):
        return tiktoken.get_encoding("o200k_base")
    try:
        return tiktoken.encoding_for_model(model)
    except KeyError as e:
        raise ValueError("there is no tokenizer for this model: configure another, or a vocabulary file") from e


def count_tokens(text: str, model: str, vocabulary: str = "") -> int:
    return len(encoder(model, vocabulary).encode(text, disallowed_special=()))


def token_column(model: str, vocabulary: str = ""):
    """A function from a column of lines to the tokens of each with its line end, in Arrow batches."""

    def count(lines: pa.Array) -> pa.Array:
        e = encoder(model, vocabulary)
        return pa.array([len(x) for x in e.encode_ordinary_batch([f"{s or ''}\n" for s in lines.to_pylist()])], pa.int64())

    return F.arrow_udf(count, "long")


def overhead(instructions: str, schema: dict, count, repair: str = "", limit: int | None = None) -> int:
    """Tokens that every request spends beside its context; more than limit allows raises."""
    n = count(instructions + json.dumps(schema, separators=(",", ":")) + repair) + MARGIN
    if limit is not None and n >= limit:
        raise ValueError("max_context_tokens is too small for the instructions, the schema and the margin")
    return n


def category(chunk: Column) -> Column:
    low, out = F.lower(chunk), None
    for n, words in CATEGORIES:
        test = low.contains(words[0])
        for w in words[1:]:
            test = test | low.contains(w)
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.otherwise(3)


def given(sources: DataFrame) -> DataFrame:
    """The sources that a context may quote."""
    return sources.where("usable and kind = 'first_party_html'")


def chunks(sources: DataFrame, key: str = "ord", source: str = "source_id") -> DataFrame:
    """(key, source, pos, chunk, category): sentences of each line, first occurrence in a source only."""
    lines = sources.select(key, source, F.posexplode(F.split("text", T.LINES)).alias("line", "paragraph"))
    each = lines.select(key, source, "line", F.posexplode(F.split("paragraph", r"(?<=[.!?])\s+(?=[A-Z])")).alias("part", "chunk")).where("chunk <> ''")
    first = each.withColumn("n", F.row_number().over(Window.partitionBy(key, source, "chunk").orderBy("line", "part"))).where("n = 1")
    pos = F.row_number().over(Window.partitionBy(key, source).orderBy("line", "part"))
    return first.withColumn("pos", pos).select(key, source, "pos", "chunk", category(F.col("chunk")).alias("category"))


def numbered(found: DataFrame, key: str = "ord", source: str = "source_id") -> DataFrame:
    """found with nth, its place in its (category, source) bucket: by (nth, category, source as text) each gives one chunk a pass."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(key, "category", source).orderBy("pos")))


def interleaved(found: DataFrame, key: str = "ord", source: str = "source_id") -> DataFrame:
    """found with turn: its place when each (category, source) bucket gives one chunk a pass."""
    order = Window.partitionBy(key).orderBy("nth", "category", F.col(source).cast("string"))
    return numbered(found, key, source).withColumn("turn", F.row_number().over(order)).drop("nth")


def quoted(x: Column) -> Column:
    """x as a JSON string, letters beyond ASCII as they are."""
    j = F.to_json(F.array(x.cast("string")))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def json_line(source: Column, chunk: Column) -> Column:
    return F.concat(F.lit('{"source_id": '), quoted(source), F.lit(', "text": '), quoted(chunk), F.lit("}"))


def source_index(sources: DataFrame, key: str = "ord", source: str = "source_id", order: str = "page_no") -> DataFrame:
    """(key, line): all sources of a key as one JSON object, in their order. sources: final_url and title too."""
    entry = F.concat(F.lit('{"source_id": '), quoted(F.col(source)), F.lit(', "url": '), quoted(F.col("final_url")), F.lit(', "title": '), quoted(F.coalesce("title", F.lit(""))), F.lit("}"))
    listed = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(source).alias("s"), entry.alias("e")))).alias("entries"))
    return listed.select(key, F.concat(F.lit('{"sources": ['), F.array_join(F.transform("entries", lambda x: x["e"]), ", "), F.lit("]}")).alias("line"))


def _fold(limit: int):
    """Adds lines of a key while they fit; keeps the chosen lines of one key, which the budget bounds."""
    schema = pa.schema([("text", pa.string()), ("context_tokens", pa.int64()), ("request_tokens", pa.int64()), ("selected_chunks", pa.int64()), ("dropped_chunks", pa.int64())])

    def run(batches):
        key_field, out, now = None, [], None

        def told():
            some = len(now["lines"]) > 1
            return {"k": now["key"], "text": "\n".join(now["lines"]) if some else "", "context_tokens": now["used"] if some else 0, "request_tokens": now["free"] + (now["used"] if some else 0), "selected_chunks": len(now["lines"]) - 1, "dropped_chunks": now["dropped"]}

        def flushed():
            full = pa.schema([pa.field("k", key_field), *schema])
            return pa.RecordBatch.from_pylist(out, schema=full)

        for b in batches:
            key_field = b.schema.field(0).type
            for key, line, tokens, spent in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if spent is not None:  # a key begins with its index
                    if now:
                        out.append(told())
                    now = {"key": key, "lines": [line], "used": tokens, "free": spent, "dropped": 0}
                elif tokens > CHUNK_LIMIT or now["used"] + tokens > limit - now["free"]:
                    now["dropped"] += 1
                else:
                    now["lines"].append(line)
                    now["used"] += tokens
                if len(out) >= 100:
                    yield flushed()
                    out = []
        if now:
            out.append(told())
        if out:
            yield flushed()

    return run


def assembled(sources: DataFrame, tokens, spent: Column, limit: int, key: str = "ord", source: str = "source_id", order: str = "page_no") -> DataFrame:
    """(key, text, context_tokens, request_tokens, selected_chunks, dropped_chunks) for each key with a source to quote.

    sources: key, source, order, usable, kind, final_url, title and text. tokens: a function from a column of lines to the
    tokens of each. spent: a column over sources, the same for a key, with the tokens of a request beside its context.
    The index of sources comes first and is paid for; chunks longer than CHUNK_LIMIT or than what is left are skipped,
    later ones may still fit. Lines are sorted within a key's partition and folded one by one, so a task holds only the
    lines that the budget admits.
    """
    s = given(sources)
    free = s.groupBy(key).agg(F.max(spent).cast("long").alias("spent"))
    first = source_index(s, key, source, order).join(free, key)
    none = F.lit(None).cast("long")
    head = first.select(key, F.lit(0).alias("nth"), F.lit(-1).alias("category"), F.lit("").alias("by"), "line", "spent")
    found = numbered(chunks(s, key, source), key, source)
    rest = found.select(key, "nth", "category", F.col(source).cast("string").alias("by"), json_line(F.col(source), F.col("chunk")).alias("line"), none.alias("spent"))
    lines = head.unionByName(rest).withColumn("tokens", tokens(F.col("line")).cast("long"))
    sorted_ = lines.repartition(key).sortWithinPartitions(key, "nth", "category", "by")
    kind = sources.schema[key].dataType.simpleString()
    ddl = f"k {kind}, text string, context_tokens long, request_tokens long, selected_chunks long, dropped_chunks long"
    return sorted_.select(key, "line", "tokens", "spent").mapInArrow(_fold(limit), ddl).withColumnRenamed("k", key)
