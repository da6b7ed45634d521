"""Merging in order: the first of each value, the richer of two texts, notes put below each other.

A group may hold a large share of all rows, so no group is gathered as it is: values
are first reduced to distinct ones with their first place (map-side), and folds stream
over these in order with one value as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.text import normalize_text

State = str | None


def ordered_union(rows: DataFrame, group: str, place: Column, values: Column, name: str) -> DataFrame:
    """group and `name`: the distinct non-empty values of all its arrays, by place of the row, then by place in the array."""
    each = rows.select(F.col(group), place.alias("row_place"), F.posexplode(values).alias("place", "value")).where("value <> ''")
    first = each.groupBy(group, "value").agg(F.min(F.struct("row_place", "place")).alias("first"))
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("v")).select(group, F.transform("v", lambda x: x["value"]).alias(name))


def latest_entries(rows: DataFrame, group: str, place: Column, entries: Column, name: str) -> DataFrame:
    """group and `name`: a map in which the last row that has a key decides its value; keys in order of the alphabet."""
    each = rows.select(F.col(group), place.alias("place"), F.explode(entries).alias("key", "value")).where("value IS NOT NULL")
    last = each.groupBy(group, "key").agg(F.max_by("value", "place").alias("value"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))


def folded(rows: DataFrame, group: str, place: Column, fields: list[str], rule: Callable[[tuple[State, State], tuple[State, State]], tuple[State, State]]) -> DataFrame:
    """group and the fields, each folded by rule over its distinct texts by first place.

    The rule gets the state and the incoming value as (text, normalised text); a rule has to
    leave its state when it meets a value again, which makes distinct values enough."""
    spark = rows.sparkSession
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])
    values = rows.select(F.col(group).cast("string").alias("group"), place.alias("place"), F.explode(each).alias("e")).select("group", "place", "e.*").where("value <> ''")
    first = values.groupBy("group", "field", "value").agg(F.min("place").alias("place"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = Window.partitionBy("group", "field").orderBy("place", "value")
    dealt = first.repartition(tasks, "group", "field").withColumns({"before": F.lag("value").over(own), "after": F.lead("value").over(own)})
    # a text that is alone is never compared: it goes past the fold, and its plain spelling isn't worked out
    alone = F.col("before").isNull() & F.col("after").isNull()
    met = dealt.select("group", "field", "value", F.when(~alone, normalize_text(F.col("value"))).alias("plain"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (None, None)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["group", "field", "value"])

        for batch in batches:
            out = []
            for group, field, *value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (group, field):
                    out += [(*key, state[0])] if key else []
                    key, state = (group, field), tuple(value)
                else:
                    state = rule(state, tuple(value))
            yield told(out)
        yield told([(*key, state[0])] if key else [])

    done = met.mapInArrow(stream, "group string, field string, value string")
    wide = done.groupBy("group").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return wide.select(F.col("group").cast(rows.schema[group].dataType).alias(group), *fields)


def richer_of(state: tuple[State, State], incoming: tuple[State, State]) -> tuple[State, State]:
    """N34 as a rule of folded(): the incoming text where it holds the current one and is longer."""
    (text, plain), (other, other_plain) = state, incoming
    return incoming if plain and other_plain and plain in other_plain and len(other) > len(text) else state
