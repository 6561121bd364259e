"""Tag tables and rule-based correction of token tags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import all_digits
from ..session import stored
from .ordered import BLOCK, BLOCK_ROWS, whole_runs, with_halo


def tag_list(text: Column) -> Column:
    """Tags of a list file ``['O', 'B_X', ...]``, ordered O, B_, I_, E_; others dropped."""
    items = F.filter(F.split(F.regexp_replace(text, r"[\[\]\n' ]", ""), ","), lambda t: t != "")

    def starting(prefix: str) -> Column:
        return F.filter(items, lambda t: t.startswith(prefix))

    return F.concat(*[starting(p) for p in ("O", "B_", "I_", "E_")])


class Rule(NamedTuple):
    """What a row does when its turn comes, on the classes so far.

    It asks for one of ``words`` or a word that contains ``part``, for the row's class, for a number as the word some
    rows on, for the class some (two or more) rows on: all that are given must hold. It sets the class of the row
    before (-1), of its own (0) or of the next (1).
    """

    sets: tuple[int, str]
    words: tuple[str, ...] = ()
    part: str | None = None
    label: str | None = None
    number_at: int | None = None
    label_at: tuple[int, str] | None = None


def name_rules(animals: Sequence[str] = V.ANIMAL_WORDS, hunter: str = V.HUNTER_WORD, titles: Sequence[str] = V.TITLE_WORDS,
               rulers: Sequence[str] = V.RULER_WORDS, selves: Sequence[str] = V.SELF_WORDS, ordinal: str = V.ORDINAL_WORD) -> list[Rule]:
    """The correction of predicted name tags, in order."""
    return [Rule((0, "0"), words=tuple(animals), part=hunter), Rule((0, "9"), words=tuple(titles)), Rule((0, "11"), words=tuple(rulers)),
            Rule((-1, "3"), label="12"), Rule((0, "0"), words=tuple(selves)), Rule((0, "4"), words=(ordinal,), number_at=2),
            Rule((1, "15"), label="4", label_at=(2, "17"))]


#: Bit of a row whose word is a number; the bits below say which rules' words it is.
_NUMBER = 62
#: Parts of a row's mark: its class and 1, whether it begins a block, is a row of its own block, lies in a later one.
_CODE, _START, _OWN, _LATER = (1 << 16) - 1, 1 << 16, 1 << 17, 1 << 18


def _steps(rules: Sequence[Rule], names: list[str], states: list[int], hits: np.ndarray, code: np.ndarray, run: np.ndarray) -> tuple:
    """For every row and state it can be met in: its class, the class it gives the row before (-1: none), the next state.

    State 0 leaves a row's own class, the others are classes that the row before has set.
    """
    n = len(code)

    def ahead(values: np.ndarray, d: int, none: int) -> np.ndarray:
        out = np.full(n, none, dtype=values.dtype)
        same = run[d:] == run[:n - d] if d < n else np.zeros(0, bool)
        out[:len(same)][same] = values[d:][same]
        return out

    own, back, following = (np.empty((n, len(states)), dtype="int64") for _ in range(3))
    for s, forced in enumerate(states):
        now = code.copy() if s == 0 else np.full(n, forced)
        before, after = np.full(n, -1), np.zeros(n, dtype="int64")
        for i, rule in enumerate(rules):
            hit = np.ones(n, bool)
            if rule.words or rule.part is not None:
                hit &= (hits >> i) & 1 == 1
            if rule.label is not None:
                hit &= now == names.index(rule.label)
            if rule.number_at is not None:
                hit &= (ahead(hits, rule.number_at, 0) >> _NUMBER) & 1 == 1
            if rule.label_at is not None:
                hit &= ahead(code, rule.label_at[0], -2) == names.index(rule.label_at[1])
            where, to = rule.sets[0], names.index(rule.sets[1])
            if where == 0:
                now[hit] = to
            elif where < 0:
                before[hit] = to
            else:
                after[hit] = states.index(to)
        own[:, s], back[:, s], following[:, s] = now, before, after
    return own, back, following


def _settled(own: np.ndarray, back: np.ndarray, following: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all rows, and the state after each, for every state in which its run can begin.

    Maps from the first state of a run to the state after a row are composed over 1, 2, 4, ... rows; rows whose map has
    one value left are done.
    """
    n, states = own.shape
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(start, at, 0))
    to = following.copy()
    d, inside = 1, np.flatnonzero(~start)
    while len(inside):
        to[inside] = np.take_along_axis(to[inside], to[inside - d], axis=1)
        d *= 2
        # A map with one value stays what it is, whatever came before.
        inside = inside[(inside - d >= first[inside]) & (to[inside] != to[inside, :1]).any(axis=1)]
    into = np.tile(np.arange(states), (n, 1))
    later = np.flatnonzero(~start)
    into[later] = to[later - 1]
    code, given = np.take_along_axis(own, into, axis=1), np.take_along_axis(back, into, axis=1)
    rows = later - 1
    code[rows] = np.where(given[later] >= 0, given[later], code[rows])
    return code, to


def apply_rules(df: DataFrame, group: list[str], pos: str, word: str, label: str, rules: Sequence[Rule], out: str = "fixed",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rules on predicted classes as if applied row after row: adds the final class ``out``.

    ``pos`` is the dense position in the group. The class that a row may set for the next is the state of a machine
    with a handful of states, a row is a map of states. Rows are sorted once, in blocks with a few rows of the next
    block; rows that lie together by group stay where they are, and two numbers of each row go to the function that
    composes the maps of a block for every state in which it can begin. A table of one map per block (of groups with
    several) tells in which it does. NULL words and classes meet no rule; a look beyond the end fails.
    """
    for r in rules:
        if r.sets[0] not in (-1, 0, 1) or (r.label_at and r.label_at[0] < 2) or (r.number_at is not None and r.number_at < 1):
            raise ValueError(f"a rule reaches too far or not far enough: {r}")
    if len(rules) >= _NUMBER:
        raise ValueError("too many rules")
    rules = list(rules)
    names = sorted({r.sets[1] for r in rules} | {r.label for r in rules if r.label is not None} | {r.label_at[1] for r in rules if r.label_at})
    states = [-1, *sorted({names.index(r.sets[1]) for r in rules if r.sets[0] == 1})]
    reach = 1 + max([0, *(r.label_at[0] for r in rules if r.label_at), *(r.number_at for r in rules if r.number_at)])
    w = F.col(word)
    bits = F.when(F.coalesce(all_digits(w), F.lit(False)), F.lit(1 << _NUMBER)).otherwise(F.lit(0).cast("long"))
    for i, r in enumerate(rules):
        hit = w.isin(*r.words) if r.words else F.lit(False)
        hit = hit | w.contains(r.part) if r.part is not None else hit
        bits = bits + F.when(F.coalesce(hit, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0).cast("long"))
    known = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label)) - 1, F.lit(-1))
    seen = with_halo(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                               F.col(pos).cast("long").alias("_at"), bits.cast("long").alias("_hits"), known.cast("int").alias("_code")),
                     "_at", 0, reach, block_rows)
    keys = [f"_g{i}" for i in range(len(group))]
    near = Window.partitionBy(*keys, BLOCK).orderBy("_at")
    # The window deals the rows out and sorts them, unless they lie together already; the sort says what is relied on.
    placed = seen.withColumn("_mark", F.col("_code") + 1 + F.when(F.row_number().over(near) == 1, _START).otherwise(0)
                             + F.when(F.col("_own"), _OWN).otherwise(0) + F.when(F.col(BLOCK) > 0, _LATER).otherwise(0))
    placed = placed.sortWithinPartitions(*keys, BLOCK, "_at")

    def settle(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def starts(t: pa.RecordBatch) -> np.ndarray:
            return t.column(1).to_numpy() & _START != 0

        def pack(m: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
            """Lists of some rows, NULL for the others."""
            sizes = np.zeros(n, "int32")
            sizes[rows] = len(states)
            ends = np.append(0, np.cumsum(sizes)).astype("int32")
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel().astype("int32")), mask=pa.array(sizes == 0))

        for t in whole_runs((pa.RecordBatch.from_arrays(list(b), ["hits", "mark"]) for b in batches), starts):
            hits, mark = (c.to_numpy() for c in t.columns)
            start, own, n = starts(t), mark & _OWN != 0, len(mark)
            codes, after = _settled(*_steps(rules, names, states, hits, ((mark & _CODE) - 1).astype("int64"), np.cumsum(start)), start)
            later = np.flatnonzero(own & (mark & _LATER != 0))
            last = np.flatnonzero(own & ~np.append((own & ~start)[1:], True) & ~np.append(start[1:], True))  # rows of the next block follow
            yield pa.StructArray.from_arrays([pa.array(codes[:, 0].astype("int32"), mask=~own), pack(codes[later], later, n), pack(after[last], last, n)],
                                             ["code", "codes", "map"])

    ruled = F.arrow_udf(settle, "struct<code int, codes array<int>, map array<int>>").asNondeterministic()  # so that it runs once, on all rows
    done = placed.withColumn("_ruled", ruled("_hits", "_mark")).filter("_ruled.code IS NOT NULL").select("_row", *keys, BLOCK, "_ruled")
    done = stored(done, "ruled")
    maps = done.filter("_ruled.map IS NOT NULL").select(*keys, BLOCK, F.col("_ruled.map").alias("_map"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stored(maps.select(*[F.col(k).alias(f"_c{k}") for k in keys], (F.col(BLOCK) + 1).alias("_cb"), F.aggregate(
        F.collect_list("_map").over(earlier), F.lit(0), lambda s, m: m[s]).alias("_state")), "states")
    same = F.col(BLOCK) == F.col("_cb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    code = F.coalesce(F.col("_ruled.codes")[F.coalesce("_state", F.lit(0))], "_ruled.code")  # a first block begins in state 0
    final = F.when(code >= 0, F.array(*[F.lit(x) for x in names])[F.greatest(code, F.lit(0))]).otherwise(F.col(f"_row.{label}"))
    return done.join(carried, same, "left").select("_row.*", final.alias(out))


def entity_spans(df: DataFrame, group: list[str], pos: str, tags: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Entities of one or more tag columns: one row per span (column, type, start, end), both ends included.

    A tag is its first letter (B, I, E, S or O) and a type. A span ends after E or S, before B, S or O, or where
    the type changes. All tag columns share one sort. Rows are read once: what leaves a block are the ends of its spans
    and its last row, if others follow, with the last starts so far; only these few rows meet the starts of earlier blocks.
    """
    near = Window.partitionBy(*group, BLOCK).orderBy(pos)
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cell(tag: str) -> tuple[Column, Column]:
        full = F.coalesce(F.col(tag), F.lit("O"))
        return F.substring(full, 1, 1), F.substring(full, 2, 1 << 30)

    def starts(pk, pt, k, t):
        opens = k.isin("B", "S") | (pk.isin("E", "S", "O") & k.isin("E", "I"))
        return opens | ((k != "O") & (k != ".") & (pt != t))

    def ends(k, t, nk, nt):
        closes = k.isin("E", "S") | (k.isin("B", "I") & nk.isin("B", "S", "O"))
        return closes | ((k != "O") & (k != ".") & (t != nt))

    linked = with_halo(df.select(*group, pos, *[F.col(tag).alias(f"_{i}") for i, tag in enumerate(tags)]), pos, 1, 1, block_rows)
    for i in range(len(tags)):
        linked = linked.withColumns({f"_p{i}": F.lag(f"_{i}").over(near), f"_n{i}": F.lead(f"_{i}").over(near)})
    # A row of the next block is no row of this one: it neither starts a span here nor ends one.
    begun = {f"_s{i}": F.when(F.col("_own") & starts(*cell(f"_p{i}"), *cell(f"_{i}")), F.col(pos)) for i in range(len(tags))}
    linked = linked.withColumns({**{name: F.last(start, ignorenulls=True).over(upto) for name, start in begun.items()},
                                 "_last": ~F.coalesce(F.lead("_own").over(near), F.lit(True))}).filter("_own")
    closed = {f"_e{i}": ends(*cell(f"_{i}"), *cell(f"_n{i}")) for i in range(len(tags))}
    linked = linked.withColumns(closed)
    kept = linked.filter(reduce(lambda a, b: a | b, [F.col(e) for e in closed], F.col("_last")))
    kept = stored(kept.select(*group, pos, BLOCK, "_last", *[f"{x}{i}" for i in range(len(tags)) for x in ("_", "_s", "_e")]), "ends")

    earlier = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = stored(kept.filter("_last").select(*[F.col(g).alias(f"_c{j}") for j, g in enumerate(group)], (F.col(BLOCK) + 1).alias("_cb"), *[
        F.last(f"_s{i}", ignorenulls=True).over(earlier).alias(f"_c_s{i}") for i in range(len(tags))]), "starts")  # a row for each block
    same = F.col(BLOCK) == F.col("_cb")
    for j, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_c{j}"))
    found = []
    for i, tag in enumerate(tags):
        span = F.struct(F.lit(tag).alias("column"), cell(f"_{i}")[1].alias("type"),
                        F.coalesce(f"_s{i}", f"_c_s{i}", F.lit(0)).alias("start"), F.col(pos).alias("end"))
        found.append(F.when(F.col(f"_e{i}"), span))
    return kept.join(known, same, "left").select(*group, F.inline(F.array_compact(F.array(*found))))
