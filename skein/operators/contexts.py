"""Contexts of bounded size, folded from ranked texts, as Column expressions over an array of rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx


def _cut(text: Column, room: Column) -> Column:
    return F.when(F.length(text) > room, F.rtrim(F.substring(text, F.lit(1), F.greatest(room, F.lit(0))))).otherwise(text)


def _start() -> Column:
    return F.struct(F.lit("").alias("text"), F.lit(0).alias("included"), F.lit(0).alias("omitted"), F.lit(False).alias("truncated"), F.lit(False).alias("closed"))


def _state(text: Column, included: Column, omitted: Column, truncated: Column, closed: Column) -> Column:
    return F.struct(text.alias("text"), included.cast("int").alias("included"), omitted.cast("int").alias("omitted"), truncated.alias("truncated"), closed.alias("closed"))


def _joined(state: Column, block: Column) -> Column:
    return F.when(state["included"] > 0, F.concat(state["text"], F.lit("\n\n"), block)).otherwise(block)


def _skip(state: Column, cut: bool) -> Column:
    return _state(state["text"], state["included"], state["omitted"] + 1, state["truncated"] | F.lit(cut), state["closed"])


def retrieval_context(results: Column, most: int = 6000, least: int = 20) -> Column:
    """struct: text, included, omitted, truncated. results: array of (chunk_index, text) in their order.

    Each text gets a header with its number. Texts that don't fit are cut, or left out if hardly any room is left; later
    ones may still fit."""
    def add(state: Column, row: Column) -> Column:
        def with_text(clean: Column) -> Column:
            header = F.concat(F.lit("[source_"), (state["included"] + 1).cast("string"), F.lit("; chunk_index="), row["chunk_index"].cast("string"), F.lit("]\n"))
            room = F.lit(most) - F.length(state["text"])
            first = room - F.length(header)
            second = first - F.when(state["included"] > 0, 2).otherwise(0)
            kept = _cut(_cut(clean, first), second)
            text = _joined(state, F.concat(header, kept))
            full = (F.length(clean) > second) | (F.length(text) >= most)
            fits = _state(text, state["included"] + 1, state["omitted"], state["truncated"] | full, state["closed"])
            narrow = (first <= least) | ((F.length(_cut(clean, first)) > second) & (second <= least))
            return F.when(clean == "", _skip(state, False)).when(narrow, _skip(state, True)).otherwise(fits)

        return tx.bound(tx.clean_context(F.coalesce(row["text"], F.lit(""))), with_text)

    return F.aggregate(results, _start(), add, lambda s: s.dropFields("closed"))


def cluster_context(members: Column, most: int = 12_000, least: int = 20) -> Column:
    """The members' texts (array of (level, text)) under headers, until hardly any room is left."""
    numbered = F.transform(members, lambda m, i: F.struct(m["level"].alias("level"), tx.clean_context(m["text"]).alias("text"), (i + 1).alias("i")))

    def add(state: Column, row: Column) -> Column:
        header = F.concat(F.lit("[cluster_item_"), row["i"].cast("string"), F.lit("; level="), row["level"].cast("string"), F.lit("]\n"))
        room = F.lit(most) - F.length(state["text"]) - F.when(state["included"] > 0, 2).otherwise(0) - F.length(header)
        text = _joined(state, F.concat(header, _cut(row["text"], room)))
        fits = _state(text, state["included"] + 1, state["omitted"], state["truncated"], F.length(text) >= most)
        closed = _state(state["text"], state["included"], state["omitted"], state["truncated"], F.lit(True))
        return F.when(state["closed"] | (row["text"] == ""), state).when(room <= least, closed).otherwise(fits)

    return F.aggregate(numbered, _start(), add, lambda s: s["text"])


def hierarchy_context(results: Column, most: int = 6000) -> Column:
    """struct: text, included, omitted, truncated. results: array of (node_id, level, chunk_id, chunk_index, parent, subintents,
    similarity, text) in their order; null chunk_id for summaries, null parent and an empty subintents are left out."""
    def lines(row: Column, number: Column, text: Column) -> Column:
        kind = F.when(row["level"] == 0, "leaf").otherwise("summary")
        named = [("source: raptor_source_", number), ("node_id: ", row["node_id"]), ("level: ", row["level"]), ("type: ", kind)]
        named += [("chunk_id: ", row["chunk_id"]), ("chunk_index: ", F.when(row["chunk_id"].isNotNull(), row["chunk_index"])), ("expanded_from_parent_id: ", row["parent"])]
        named += [("matched_subintents: ", F.when(F.size(row["subintents"]) > 0, F.array_join(row["subintents"].cast("array<string>"), ", "))), ("similarity_score: ", F.format_string("%.6f", row["similarity"]))]
        return F.concat(F.concat_ws("\n", F.lit("[RAPTOR NODE]"), *[F.concat(F.lit(k), v.cast("string")) for k, v in named], F.lit("text:")), F.lit("\n"), text)

    def add(state: Column, row: Column) -> Column:
        def with_text(clean: Column) -> Column:
            number = state["included"] + 1
            block, head = lines(row, number, clean), lines(row, number, F.lit(""))
            room = F.lit(most) - F.length(state["text"]) - F.when(state["included"] > 0, 2).otherwise(0)
            inside = room - F.length(head)
            whole = F.length(block) <= room
            text = _joined(state, F.when(whole, block).otherwise(F.concat(head, _cut(clean, inside))))
            fits = _state(text, number, state["omitted"], state["truncated"] | ~whole | (F.length(text) >= most), state["closed"])
            narrow = (room <= 40) | (~whole & (inside <= 20))
            return F.when(clean == "", _skip(state, False)).when(narrow, _skip(state, True)).otherwise(fits)

        return tx.bound(tx.clean_context(F.coalesce(row["text"], F.lit(""))), with_text)

    return F.aggregate(results, _start(), add, lambda s: s.dropFields("closed"))


def safe_token_limit(model_limit: int = 1_048_576, most: int = 900_000, output: int = 1024, margin: int = 8192) -> int:
    """Tokens that a prompt may have: the model's, less its output and a margin, and never more than the limit set."""
    return min(most, max(1, model_limit - output - margin))


def full_context(text: Column, prompt_chars: int, most_chars: int = 0, token_limit: int | None = None, chars_per_token: float = 3.0) -> Column:
    """struct: text, strategy (null if whole), tokens (estimated), error. The longest start of a document, without blanks at its
    end, that stays within the characters (0: any number) and the estimated tokens."""
    limit = safe_token_limit() if token_limit is None else token_limit
    room = int(limit * chars_per_token) - prompt_chars

    def of(t: Column) -> Column:
        by_chars = F.rtrim(F.substring(t, 1, most_chars)) if most_chars else t
        cut = (F.length(t) > most_chars) if most_chars else F.lit(False)
        one = F.when(cut, by_chars).otherwise(t)
        over = F.length(one) > room
        out = F.when(over, F.regexp_replace(F.substring(one, 1, max(room, 0)), r"(?U)\s+\z", "")).otherwise(one)
        why = F.when(over, "token_aware_document_start_truncation").when(cut, "configured_char_limit_document_start_truncation")
        error = F.when(F.lit(room < 0), "prompt_engineering_context_too_large")
        return F.struct(out.alias("text"), why.alias("strategy"), F.ceil((F.length(out) + prompt_chars) / F.lit(chars_per_token)).cast("long").alias("tokens"), error.alias("error"))

    return tx.bound(tx.clean_document(text), of)


def folded(rows: DataFrame, key: str, order: str, text: str, most: int, least: int = 20) -> DataFrame:
    """key, context: the texts of each key in their order, joined by empty lines within a budget of characters. A text that doesn't
    fit is cut if more than `least` characters are left, else left out; later ones may still fit. Null texts don't count; rows
    without a key are one context. Rows stream through sorted partitions; a task holds one context at a time, however many rows a key
    has, and keys go through Arrow as they are."""
    def fold(batches):
        held = None  # [key, context]
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held is None or held[0] != k:
                    out += [held] if held else []
                    held = [k, ""]
                gap = "\n\n" if held[1] else ""
                room = most - len(held[1]) - len(gap)
                part = t if t is None or len(t) <= room else (t[:room].rstrip(" ") if room > least else None)
                held[1] += "" if part is None else gap + part
            yield made(out, batch.schema.field("key").type)
        if held is not None:
            yield made([held], batch.schema.field("key").type)

    def made(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([c for _, c in rows], pa.string())], ["key", "context"])

    kind = rows.schema[key].dataType.simpleString()
    sorted_ = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key", "order", "text")
    return sorted_.select("key", "text").mapInArrow(fold, f"key {kind}, context string").withColumnRenamed("key", key)
