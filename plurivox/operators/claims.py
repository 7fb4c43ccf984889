"""Claims: parts of contributions anchored as verbatim spans, decoded from stored forms, and flattened to one table.

Spans are half-open, in code points. A part is found as it stands, or else with any run of white space where it has one; what is
found nowhere is rejected, so no claim holds a word that its contribution does not.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered

#: Characters that count as white space (fixed values).
SPACE = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN, _LONG = re.compile(SPACE + "+"), re.compile(SPACE + "{2,}")
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c))
JOINT = " "
#: Parts that meet their text at once, and claims that leave a task at once.
PARTS, OUT_ROWS = 4096, 4096
_SPAN = "struct<start: int, end: int>"
_OBJECT = "text string, spans array<array<int>>, start int, end int, target array<int>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


class _Text:
    """A text in which parts are located; the occurrences of a repeated part, and the text with short runs of white space, are worked out once."""

    def __init__(self, text: str) -> None:
        self.text, self._all, self._short = text, {}, None

    def exact(self, part: str, nth: int) -> int:
        """Where the occurrence `nth` begins, starting over when they are used up; -1 without any."""
        if not nth:
            return self.text.find(part)
        if part not in self._all:
            found, at = [], self.text.find(part)
            while at >= 0:
                found.append(at)
                at = self.text.find(part, at + len(part))
            self._all[part] = found
        found = self._all[part]
        return found[nth % len(found)] if found else -1

    def tolerant(self, part: str) -> tuple[int, int] | None:
        """The first place that differs in white space only: looked for with every run of white space as one space, and taken back by what the longer runs before add."""
        if self._short is None:
            runs = [(m.start(), len(m.group()) - 1) for m in _LONG.finditer(self.text)]
            before = [0, *accumulate(more for _, more in runs)]
            self._short = _RUN.sub(" ", self.text), [at - less for (at, _), less in zip(runs, before)], before
        short, places, before = self._short
        sought = _RUN.sub(" ", part)
        at = short.find(sought)
        if at < 0:
            return None
        last = at + len(sought) - 1
        return at + before[bisect_left(places, at)], last + before[bisect_left(places, last)] + 1

    def locate(self, part: str, nth: int) -> tuple[int, int] | None:
        at = self.exact(part, nth)
        return (at, at + len(part)) if at >= 0 else self.tolerant(part)


def _anchored(text: str, asked: Iterable[tuple]) -> Iterator[tuple]:
    """claim, text, spans, target of the claims of a text with an anchored part; `asked`: claim, place (-1: a target), part, nth."""
    places, found = _Text(text), {}
    for claim, place, part, nth in asked:
        span = places.locate(part, nth)
        if span:
            found.setdefault(claim, []).append((place, span))
    for claim, ps in found.items():
        ps.sort()
        spans = [s for place, s in ps if place >= 0]
        if spans:
            yield claim, JOINT.join(text[a:b] for a, b in spans), [{"start": a, "end": b} for a, b in spans], dict(zip(("start", "end"), ps[0][1])) if ps[0][0] < 0 else None


def align(texts: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key, claim, text, spans, target of the claims (key, claim, parts array<string>, target string) of `texts` (key, text).

    Claims of a text are taken in the order of `claim`, their parts in their own. The same part again, in the same claim or another, gets the next
    occurrence. Blank and null parts are passed over; claims without an anchored part are left out; a target is its first occurrence, or null.
    A text meets its claims once for each `PARTS` parts, never once a part."""
    asked = claims.select(key, "claim", F.posexplode("parts").alias("place", "part")).unionByName(claims.select(key, "claim", F.lit(-1).alias("place"), F.col("target").alias("part")))
    asked = asked.withColumn("part", stripped(F.col("part"))).where(F.length("part") > 0).repartition(key)
    aim = F.col("place") < 0
    nth = F.when(aim, 0).otherwise(F.row_number().over(W.partitionBy(key, "part", aim).orderBy("claim", "place")) - 1)
    groups = F.ceil(F.count("*").over(W.partitionBy(key)) / PARTS)
    asked = asked.withColumn("nth", nth).withColumn("group", F.pmod(F.xxhash64("claim"), groups))
    held = asked.groupBy(key, "group").agg(F.collect_list(F.struct("claim", "place", "part", "nth")).alias("ps"))
    rows = held.join(texts.select(key, "text").hint("merge"), key).select(key, "text", "ps.claim", "ps.place", "ps.part", "ps.nth")
    kinds = dict(claims.dtypes)
    schema = f"`{key}` {kinds[key]}, claim {kinds['claim']}, text string, spans array<{_SPAN}>, target {_SPAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])

        def made(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            claim, text, spans, target = zip(*out)
            arrays = [batch.column(0).take(pa.array(at)), pa.array(claim, batch.column(2).type.value_type), pa.array(text, pa.string()), pa.array(spans, pa.list_(pair)), pa.array(target, pair)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "claim", "text", "spans", "target"])

        for batch in batches:
            at, out = [], []
            for k in range(batch.num_rows):
                text, *columns = (batch.column(c)[k].as_py() for c in range(1, 6))
                for row in _anchored(text, zip(*columns)) if text else ():
                    at.append(k)
                    out.append(row)
                if len(out) >= OUT_ROWS:
                    yield made(batch, at, out)
                    at, out = [], []
            if out:
                yield made(batch, at, out)

    return rows.mapInArrow(run, schema)


def whole(text: Column) -> Column:
    """The claim that stands in where none was found: the whole contribution."""
    return F.struct(text.alias("text"), F.array(span(F.lit(0), F.length(text))).alias("spans"), F.lit(None).cast(_SPAN).alias("target"))


def decode(raw: Column, text: Column) -> Column:
    """text, spans, target of a stored claim. Forms: {"text", "spans": [[s, e], ...], "target": [s, e]}; the older {"text", "start", "end"}; a JSON string or plain
    text, which is looked for in its contribution. Pairs of other lengths are passed over; what has no place stands at (-1, -1)."""
    o = F.from_json(raw, _OBJECT)
    pair = lambda x: span(F.get(x, F.lit(0)), F.get(x, F.lit(1)))
    pairs = F.transform(F.filter(F.coalesce(o["spans"], F.array()), lambda x: F.size(x) == 2), pair)
    older = F.array(span(F.coalesce(o["start"], F.lit(-1)), F.coalesce(o["end"], F.lit(-1))))
    target = F.when(F.size(o["target"]) == 2, pair(o["target"]))
    stored = F.struct(F.coalesce(o["text"], F.lit("")).alias("text"), F.when(F.size(pairs) > 0, pairs).otherwise(older).alias("spans"), target.alias("target"))
    plain = F.when(raw.startswith('"'), F.get_json_object(raw, "$")).otherwise(raw)
    at = F.position(plain, text)
    placed = F.when(at > 0, span(at - 1, at - 1 + F.length(plain))).otherwise(span(F.lit(-1), F.lit(-1)))
    bare = F.struct(plain.alias("text"), F.array(placed).alias("spans"), F.lit(None).cast(_SPAN).alias("target"))
    return F.when(raw.startswith("{"), stored).otherwise(bare)


def flatten(avis: DataFrame, order: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """claim_index, avis_id, pos, weight, text, spans, target: the stored claims of contributions (avis_id, `order`, weight, text, claims array<string>)
    in the order of the contributions and then their own, each with its contribution's weight; a contribution without claims gives none."""
    rows = avis.select("avis_id", F.col(order).alias("_order"), "weight", F.col("text").alias("_text"), F.posexplode("claims").alias("pos", "raw"))
    rows = rows.select("avis_id", "_order", "weight", "pos", decode(F.col("raw"), F.col("_text")).alias("c")).select("avis_id", "_order", "weight", "pos", "c.*")
    return numbered(rows, ["_order", "avis_id", "pos"], "claim_index", checkpoint).drop("_order")


def in_order(claims: DataFrame, key: str) -> DataFrame:
    """Claims with `nth`, their place (from 0) in their contribution by first span, unplaced ones last."""
    first = F.array_min(F.transform("spans", lambda s: F.when(s["start"] >= 0, s["start"])))
    return claims.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.asc_nulls_last(first), "claim_index")) - 1)
