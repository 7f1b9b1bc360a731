"""Schemas that drift between files: find every change, and read all files into one table.

Method: similarity flooding. Each file's schema becomes a labelled graph (table -> column -> field, type, name words, next column);
the scores of node pairs start from names and from how often the columns agree on rows that both files hold, are
propagated along equally labelled edges until they converge, and the best consistent correspondences are selected by the
converged scores. The row comparison is a Spark join and one aggregation; the graphs are bounded by the columns, not by the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotwin.functions.times import let, minutes, run_stem, time_text
from isotwin.session import col, cut

#: Share of shared rows on which two columns agree from which rows speak for a pair in full; below it they speak against it in proportion.
AGREE = 0.3
#: As many shared rows as this weigh no more than the names do.
NAME_ROWS = 1.0
#: What a pair of one family starts from when neither its names nor rows say anything.
BASE = 0.1
#: Least converged score of a correspondence.
SCORE = 0.3
#: Passes of the propagation and the change at which it has converged; ``rounds=0`` leaves the start scores.
ROUNDS, EPS = 200, 1e-6
#: Least share of the compared rows that agree as times alone, from which a text column is read as a time.
TIME_SHARE = 0.02
#: Shared keys that are broadcast.
FEW_KEYS = 500_000
CHANGES = "from_table string, to_table string, change_kind string, col_from string, col_to string"

#: A column or a field within one: the names that lead to it.
Path = tuple[str, ...]
#: For pairs of paths: rows on which they agree, rows where both have a value, rows that agree as times alone.
Agreement = dict[tuple[Path, Path], tuple[int, int, int]]


# --- schema graphs and flooding -------------------------------------------------------------------


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def _fields(kind: T.DataType) -> list[T.StructField]:
    """The fields of a struct, or of a list of structs."""
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return list(inner.fields) if isinstance(inner, T.StructType) else []


def _nodes(schema: T.StructType) -> dict[Path, T.DataType]:
    """Every column and field, by its path."""
    out: dict[Path, T.DataType] = {}

    def add(fields: list[T.StructField], above: Path) -> None:
        for f in fields:
            out[(*above, f.name)] = f.dataType
            add(_fields(f.dataType), (*above, f.name))

    add(list(schema.fields), ())
    return out


def _edges(schema: T.StructType) -> list[tuple[tuple, str, tuple]]:
    """The labelled edges of a schema graph; nodes are ``(kind, value)``."""
    edges = []
    nodes = _nodes(schema)
    siblings: dict[Path, list[Path]] = {}
    for path, kind in nodes.items():
        node = ("col", path)
        above = ("col", path[:-1]) if len(path) > 1 else ("table", ())
        edges.append((above, "field", node))
        edges.extend((node, "word", ("word", w)) for w in set(_words(path[-1])))
        edges.append((node, "type", ("type", kind.simpleString() if not _fields(kind) else kind.typeName())))
        edges.append((node, "family", ("family", _family(kind))))
        siblings.setdefault(path[:-1], []).append(path)
    for row in siblings.values():
        edges.extend((("col", a), "next", ("col", b)) for a, b in zip(row, row[1:]))
    return edges


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    if _fields(kind):
        return "fields"
    return "text" if isinstance(kind, (T.StringType, T.ArrayType)) else kind.typeName()


def _name_score(a: str, b: str) -> float:
    """Likeness of two names from 0 to 1: shared words and shared letter pairs."""
    if a == b:
        return 1.0
    wa, wb = set(_words(a)), set(_words(b))
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    ga, gb = grams(a.lower()), grams(b.lower())
    return 0.9 * max(len(wa & wb) / max(1, len(wa | wb)), 2 * len(ga & gb) / max(1, len(ga) + len(gb)))


def _start(a: tuple, b: tuple, families: tuple[str, str], agreement: Agreement) -> float:
    """The score that a pair of nodes starts from."""
    if a[0] != "col":
        return 1.0 if a == b else 0.0 if a[0] != "word" else _name_score(a[1], b[1])
    name = _name_score(a[1][-1], b[1][-1])
    before = max(name, BASE) if families[0] == families[1] else 0.6 * name
    same, n, _ = agreement.get((a[1], b[1]), (0, 0, 0))
    return (same + NAME_ROWS * before) / (n + NAME_ROWS)


def flood(left: T.StructType, right: T.StructType, agreement: Agreement, rounds: int = ROUNDS) -> dict[tuple[Path, Path], float]:
    """Converged scores of the pairs of columns and of fields at equal depth, the largest being 1.

    A pair starts from the likeness of its names and the share of shared rows that agree, the names weighing ``NAME_ROWS`` rows. In each round
    it gets, besides its start and last score, its neighbours' start and last scores along equally labelled edges, shared equally
    among the edges of a label. Pairs that shared rows contradict keep nothing of it: their score is scaled by how far rows agree.
    """
    ea, eb = _edges(left), _edges(right)
    fa, fb = ({p: _family(k) for p, k in _nodes(s).items()} for s in (left, right))
    out: dict[tuple, list[tuple]] = {}
    for (s, label, t), (u, label2, v) in product(ea, eb):
        if label == label2 and s[0] == u[0] and t[0] == v[0] and len(s[1]) == len(u[1]):
            out.setdefault(((s, u), label), []).append((t, v))
    into: dict[tuple, list[tuple]] = {}
    for (p, label), ends in out.items():
        for e in ends:
            into.setdefault((e, label), []).append(p)
    nodes = {p for p, _ in out} | {p for p, _ in into}
    start = {(a, b): _start(a, b, (fa.get(a[1], ""), fb.get(b[1], "")), agreement) for a, b in nodes}
    doubt = {}
    for a, b in nodes:
        same, n, _ = agreement.get((a[1], b[1]), (0, 0, 0)) if a[0] == "col" else (0, 0, 0)
        doubt[a, b] = min(1.0, (same / AGREE + NAME_ROWS) / (n + NAME_ROWS))
    weights: dict[tuple, list[tuple[tuple, float]]] = {}
    for links in (out, into):
        for (p, _), ends in links.items():
            for e in ends:
                weights.setdefault(e, []).append((p, 1 / len(ends)))
    score = dict(start)
    for _ in range(rounds):
        new = {p: doubt[p] * (start[p] + score[p] + sum(w * (score[q] + start[q]) for q, w in weights.get(p, ()))) for p in nodes}
        top = max(new.values(), default=1) or 1
        new = {p: v / top for p, v in new.items()}
        done = sum((new[p] - score[p]) ** 2 for p in nodes) < EPS
        score = new
        if done:
            break
    columns = {(a[1], b[1]): v for (a, b), v in score.items() if a[0] == "col"}
    top = max(columns.values(), default=1) or 1
    return {p: v / top for p, v in columns.items()}


def correspond(left: T.StructType, right: T.StructType, agreement: Agreement, rounds: int = ROUNDS) -> list[tuple[Path, Path]]:
    """The consistent one-to-one correspondences between the columns of two schemas, and between the fields of columns that correspond.

    Pairs are taken by falling converged score, down to ``SCORE`` of the best of their level. Fields correspond only within columns that do.
    Equal names stay together whatever the score, unless shared rows say better of another column: a column may be filled anew.
    """
    score = flood(left, right, agreement, rounds)
    chosen: list[tuple[Path, Path]] = []

    def share(p: tuple[Path, Path]) -> float:
        same, n, _ = agreement.get(p, (0, 0, 0))
        return same / n if n else 0.0

    def level(above: tuple[Path, Path], depth: int) -> None:
        pairs = [(a, b) for a, b in score if len(a) == len(b) == depth and (a[:-1], b[:-1]) == above]
        top = max((score[p] for p in pairs), default=1) or 1
        taken_a, taken_b = set(), set()
        rank = {}
        for a, b in pairs:
            stays = a[-1] == b[-1] and not any(share(q) >= max(AGREE, share((a, b)) + 0.1) for q in pairs if (q[0] == a) != (q[1] == b))
            rank[a, b] = (stays, score[a, b])
        for a, b in sorted(pairs, key=lambda p: (not rank[p][0], -rank[p][1], p)):
            if a not in taken_a and b not in taken_b and (rank[a, b][0] or score[a, b] >= SCORE * top):
                taken_a.add(a)
                taken_b.add(b)
                chosen.append((a, b))
                level((a, b), depth + 1)

    level(((), ()), 1)
    return chosen


# --- evidence from the rows --------------------------------------------------------------------------

_PLAIN = r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*\+?\s*$"


def _plain_number(text: Column) -> Column:
    """A plain number, with a charge's plus sign at most, else null."""
    return F.regexp_extract(text, _PLAIN, 1).try_cast("double")


def _stated_time(text: Column) -> Column:
    """Minutes, of a text that names a unit or is written as a clock time; else null. Texts that begin like no time cost one look."""
    looks = text.rlike(r"(?i)^\s*(?:[a-z_. ]*[=:])?\s*(?:pt)?\d")
    return F.when(looks, let(time_text(text), lambda t: minutes(t["value"], t["unit"])))


def _read(kind: T.DataType, c: Column) -> tuple[Column, Column, Column]:
    """A value as a number, as a text and as a time in minutes, each null where it is none; to compare columns of different types."""
    number, text, time = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("double")
    if isinstance(kind, T.BooleanType):
        number = c.cast("int").cast("double")
    elif isinstance(kind, T.NumericType):
        number = c.cast("double")
    elif isinstance(kind, T.StringType):
        number, time = _plain_number(c), _stated_time(c)
        text = F.lower(F.when(c.rlike(r"[/\\.]"), run_stem(c)).otherwise(F.trim(c)))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
        text = F.lower(F.array_join(c.cast("array<string>"), ";"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    else:
        text = F.to_json(F.struct(c))
    return number, text, time


def _leaves(schema: T.StructType) -> dict[Path, T.DataType]:
    """Columns and fields that have one value in a row: those within lists are compared with their list alone."""
    nodes = _nodes(schema)
    return {p: k for p, k in nodes.items() if not isinstance(k, T.StructType) and not any(isinstance(nodes[p[:i]], T.ArrayType) for i in range(1, len(p)))}


def _comparable(a: T.DataType, b: T.DataType) -> str:
    """How two types are compared: by ``n`` numbers, ``t`` texts, ``b`` both; empty if never."""
    kinds = ["text" if isinstance(k, T.StringType) else "number" if isinstance(k, (T.NumericType, T.BooleanType)) else "list" if isinstance(k, T.ArrayType) else k.typeName() for k in (a, b)]
    if kinds == ["text", "text"]:
        return "b"
    if set(kinds) <= {"number", "text"} or kinds[0] == kinds[1] and isinstance(a, T.DatetimeType):
        return "n"
    return "t" if set(kinds) <= {"list", "text"} or kinds[0] == kinds[1] else ""


def agreement(left: DataFrame, right: DataFrame, key: str) -> Agreement:
    """For every pair of columns or fields the rows found in both files on which they agree, over the rows where both have a value.

    The keys that both files hold come first, from the key columns alone; only their rows are read, broadcast against if there are at most
    ``FEW_KEYS``. A key stored several times counts once (by its least row). Then one equi-join on ``key``, whose rows are compared a batch
    at a time, and a sum of three counts a pair; only these come back. Numbers agree within a thousandth; NaN is no value. Types that
    never hold the same quantity are not compared.
    """
    keys = [df.where(col(key).isNotNull()).select(col(key).alias("_key")).distinct() for df in (left, right)]
    shared = cut(keys[0].join(keys[1], "_key"))
    few = shared.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    sides = []
    for df, side in ((left, "l"), (right, "r")):
        df = df.join(F.broadcast(shared) if few else shared, col(key) == F.col("_key"), "left_semi")
        kinds = _leaves(df.schema)
        rows = df.select(col(key).alias("_key"), _read_all(kinds).alias(side))
        sides.append((list(kinds.items()), rows.groupBy("_key").agg(F.min(side).alias(side))))
    (a, rows_a), (b, rows_b) = sides
    asked = []
    for (i, (p, ka)), (j, (q, kb)) in product(enumerate(a), enumerate(b)):
        way = _comparable(ka, kb)
        if len(p) == len(q) and way:
            clocks = way in "nb" and all(isinstance(k, (T.StringType, T.FractionalType)) for k in (ka, kb)) and (isinstance(ka, T.StringType) or isinstance(kb, T.StringType))
            asked.append((i, j, way, *("t" if way == "t" or isinstance(k, T.StringType) else "n" for k in (ka, kb)), clocks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_columns(batch.column(side)) for side in ("l", "r"))
            counts = [_agreeing(one(x[0]), two(x[1]), *x[2:]) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*counts)]], names=["pair", "same", "n", "times"])

    if not asked:
        return {}
    sums = rows_a.join(rows_b, "_key").select("l", "r").mapInArrow(count, "pair bigint, same bigint, n bigint, times bigint").groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("same", "n", "times")])
    return {(a[asked[r["pair"]][0]][0], b[asked[r["pair"]][1]][0]): (r["same"] + r["times"], r["n"], r["times"]) for r in sums.collect() if r["n"]}


def _read_all(kinds: dict[Path, T.DataType]) -> Column:
    """The columns of ``kinds``, each read by ``_read``, as one array in their order; all texts go through one expression."""
    at = lambda p: reduce(lambda c, f: c[f], p[1:], col(p[0]))
    read = lambda kind, c: F.struct(*[x.alias(n) for n, x in zip("nts", _read(kind, c))]).cast("struct<n:double,t:string,s:double>")
    texts = [p for p, k in kinds.items() if isinstance(k, T.StringType)]
    if not texts:
        return F.array(*[read(k, at(p)) for p, k in kinds.items()])
    made = F.transform(F.array(*[at(p) for p in texts]), lambda c: read(T.StringType(), c))
    return let(made, lambda m: F.array(*[F.get(m, F.lit(texts.index(p))) if p in texts else read(k, at(p)) for p, k in kinds.items()]))


def _columns(values: pa.ListArray) -> Callable[[int], dict]:
    """For rows of equally many structs of ``_read``: a function that gives the i-th of all rows as arrays."""
    flat, rows = values.flatten(), len(values)
    wide = len(flat) // max(1, rows)
    number, text, time = (pc.struct_field(flat, n) for n in "nts")
    numbers, times = (x.to_numpy(zero_copy_only=False).astype(float).reshape(rows, wide) for x in (number, time))
    return lambda i: {"n": numbers[:, i], "t": text.take(pa.array(np.arange(rows) * wide + i)), "s": times[:, i]}


def _agreeing(x: dict, y: dict, way: str, has_x: str, has_y: str, clocks: bool) -> tuple[int, int, int]:
    """Rows that agree as they stand, rows that have both values, rows that agree only if texts are read as times."""

    def near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return (np.abs(u - v) <= 1e-3 * np.maximum(np.maximum(np.abs(u), np.abs(v)), 1e-9)) | (u == v)

    has = [v["t"].is_valid().to_numpy(zero_copy_only=False) if h == "t" else ~np.isnan(v["n"]) for v, h in ((x, has_x), (y, has_y))]
    plain = np.zeros(len(x["n"]), bool)
    if way != "t":
        plain |= near(x["n"], y["n"])
    if way != "n":
        plain |= pc.fill_null(pc.equal(x["t"], y["t"]), False).to_numpy(zero_copy_only=False)
    late = np.zeros(0, bool)
    if clocks:
        one, two = (np.where(np.isnan(v["s"]), v["n"], v["s"]) for v in (x, y))
        late = ~(np.isnan(x["s"]) & np.isnan(y["s"])) & ~plain & near(one, two)
    return int(plain.sum()), int((has[0] & has[1]).sum()), int(late.sum())


# --- the operator ----------------------------------------------------------------------------------


@dataclass
class Match:
    """The correspondences between a file and the next, and those of them that hold a time written as text on one side."""

    pairs: list[tuple[Path, Path]]
    times: set[tuple[Path, Path]] = field(default_factory=set)


def match_files(files: list[tuple[str, DataFrame]], key: str, rounds: int = ROUNDS) -> list[Match]:
    """The correspondences between each file and the next."""
    out = []
    for (_, a), (_, b) in zip(files, files[1:]):
        rows = agreement(a, b, key) if key in a.columns and key in b.columns else {}
        pairs = correspond(a.schema, b.schema, rows, rounds)
        out.append(Match(pairs, {p for p in pairs if p in rows and rows[p][2] > TIME_SHARE * rows[p][1]}))
    return out


def _type_name(kind: T.DataType) -> str:
    """A type, the fields of structs left out: their changes are reported one by one."""
    if isinstance(kind, T.ArrayType):
        return f"array<{_type_name(kind.elementType)}>"
    return "struct" if isinstance(kind, T.StructType) else kind.simpleString()


def schema_changes(spark: SparkSession, files: list[tuple[str, DataFrame]], key: str, matches: list[Match] | None = None) -> DataFrame:
    """Every change between successive ``files`` (name, table), one row each.

    ``change_kind`` is ``added`` (``col_from`` empty), ``removed`` (``col_to`` empty), ``renamed`` (letter case counts) or
    ``retyped``; a column both renamed and retyped gives two rows. A field within a column is named ``column.field`` and reported where
    its column stays. ``key`` names the column that identifies a row in every file; where it is absent, or no row comes again, the
    flooded names, types and order alone decide. Null keys and values speak for nothing; empty files still give their schema's changes.
    Repeated rows and row order do not matter. ``matches``: what ``match_files`` gave, if it is at hand.
    """
    rows = []
    for (name_a, a), (name_b, b), match in zip(files, files[1:], matches or match_files(files, key)):
        ta, tb = _nodes(a.schema), _nodes(b.schema)
        after, before = dict(match.pairs), {q: p for p, q in match.pairs}
        for p, q in match.pairs:
            rows += [(name_a, name_b, "renamed", ".".join(p), ".".join(q))] * (p[-1] != q[-1]) + [(name_a, name_b, "retyped", ".".join(p), ".".join(q))] * (_type_name(ta[p]) != _type_name(tb[q]))
        rows += [(name_a, name_b, "removed", ".".join(p), "") for p in ta if p not in after and (len(p) == 1 or p[:-1] in after)]
        rows += [(name_a, name_b, "added", "", ".".join(q)) for q in tb if q not in before and (len(q) == 1 or q[:-1] in before)]
    return spark.createDataFrame(rows, CHANGES)


def _widest(kinds: list[T.DataType], fractional: bool) -> T.DataType:
    """The type of a unified value: the list if any is one, the widest number or truth value, else text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    arrays = [k for k in kinds if isinstance(k, T.ArrayType)]
    if arrays:
        return T.ArrayType(_widest([k.elementType if isinstance(k, T.ArrayType) else k for k in kinds], fractional))
    simple = (T.NumericType, T.BooleanType, T.StringType)
    numbers = [k for k in kinds if isinstance(k, (T.NumericType, T.BooleanType))]
    if not numbers or not all(isinstance(k, simple) for k in kinds):
        return T.StringType()
    if any(isinstance(k, T.BooleanType) for k in numbers) and all(isinstance(k, (T.BooleanType, T.IntegralType)) for k in numbers):
        return T.BooleanType() if not fractional else T.DoubleType()
    return T.DoubleType() if fractional or any(isinstance(k, T.FractionalType) for k in numbers) else T.LongType()


def _cast(c: Column, have: T.DataType, want: T.DataType, time: bool) -> Column:
    """``c`` as ``want``; null where it cannot be without loss."""
    if have == want:
        return c
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            return F.transform(c, lambda x: _cast(x, have.elementType, want.elementType, time))
        return F.when(c.isNotNull(), F.array(_cast(c, have, want.elementType, time)))
    if isinstance(have, T.StringType) and isinstance(want, (T.NumericType, T.BooleanType)):
        if isinstance(want, T.FractionalType):
            # In a column of times a number without a unit counts minutes, however its decimals are parted.
            return (let(time_text(c), lambda t: minutes(t["value"], F.coalesce(t["unit"], F.lit("min")))) if time else _plain_number(c)).cast(want)
        whole = let(_plain_number(c), lambda x: F.when(x == F.floor(x), x))
        return whole.cast(want) if isinstance(want, T.NumericType) else F.coalesce(F.trim(c).try_cast("boolean"), F.when(whole.isin(0.0, 1.0), whole == 1))
    if isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return c.cast("string").cast("double")
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.MapType, T.ArrayType)):
        return F.when(c.isNotNull(), F.to_json(c))
    if isinstance(want, T.BooleanType):
        return F.when(c.isin(0, 1), c == 1)
    return c.cast(want)


#: Text of a number with a fraction.
_FRACTION = r"^\s*[+-]?\d+\.\d*[1-9]\d*(?:[eE][+-]?\d+)?\s*\+?\s*$"


def unify(files: list[tuple[str, DataFrame]], key: str, matches: list[Match] | None = None) -> DataFrame:
    """All rows of all ``files`` in one table, with the file's name in ``source_table`` and what could not be read in ``unread``.

    A column is called as in the first file that has it and takes the widest of its types: a list where any file has one,
    truth values where the rest are 0 and 1, else the wider number (a fractional one where a text holds a fraction); structs are merged
    field by field. Text is read as a plain number; as a time in minutes only where shared rows show that the column is one. Values that
    the type cannot hold without loss are null in their column and stand, as text, in the map ``unread`` under its name, so none is lost;
    see ``lossy_casts``. What a file lacks is null. Every row is kept, repeated ones too; besides the comparison of ``match_files`` there
    is no shuffle, only a look for fractions in texts that meet whole numbers. A column called ``source_table`` or ``unread`` gets a ``_`` behind it.
    """
    matches = matches or match_files(files, key)
    losses: list[list[tuple[str, Column]]] = [[] for _ in files]

    def chains(above: dict[int, Path], fields: dict[int, list[T.StructField]]) -> list[dict[int, Path]]:
        """What stands for the same field in each file."""
        last = min(fields)
        found: list[dict[int, Path]] = [{last: (*above[last], f.name)} for f in fields[last]]
        for i in sorted(fields)[1:]:
            after = dict(matches[i - 1].pairs)
            met = set()
            for chain in found:
                if (q := after.get(chain.get(i - 1))) is not None and q[:-1] == above[i]:
                    chain[i] = q
                    met.add(q)
            for f in fields[i]:
                q = (*above[i], f.name)
                if q not in met:
                    # A column that was away, and is back under its name, goes on.
                    back = next((ch for ch in found if i not in ch and i - 1 not in ch and q[-1] in {x[-1] for x in ch.values()}), None)
                    (back if back is not None else found.append({i: q}) or found[-1])[i] = q
        return found

    def is_time(chain: dict[int, Path]) -> bool:
        return any((chain[i - 1], chain[i]) in matches[i - 1].times for i in chain if i - 1 in chain)

    def has_fraction(chain: dict[int, Path], kinds: dict[int, T.DataType]) -> bool:
        whole = any(isinstance(k, (T.IntegralType, T.BooleanType)) for k in kinds.values()) and not any(isinstance(k, T.FractionalType) for k in kinds.values())
        texts = [i for i, k in kinds.items() if isinstance(k, T.StringType) and len(chain[i]) == 1]
        return whole and any(files[i][1].where(col(chain[i][0]).rlike(_FRACTION)).limit(1).count() > 0 for i in texts)

    def merge(chain: dict[int, Path], kinds: dict[int, T.DataType], read: dict[int, Callable], name: str) -> tuple[dict[int, Column], T.DataType]:
        """The unified value in each file that has it, and its type."""
        inner = {i: k.elementType if isinstance(k, T.ArrayType) else k for i, k in kinds.items()}
        if all(isinstance(k, T.StructType) for k in inner.values()) and len({isinstance(k, T.ArrayType) for k in kinds.values()}) == 1 and len(set(map(str, inner.values()))) > 1:
            parts = named(chains(chain, {i: list(k.fields) for i, k in inner.items()}), set())
            as_list = isinstance(next(iter(kinds.values())), T.ArrayType)
            made: dict[int, list[Column]] = {i: [] for i in kinds}
            fields: list[T.StructField] = []
            whole = {i: (lambda c: c) for i in kinds}
            for part, ch in parts:
                types = {i: next(f.dataType for f in inner[i].fields if f.name == p[-1]) for i, p in ch.items()}
                fields.append(T.StructField(part, merge(ch, types, whole, "")[1]))
            want = T.StructType(fields)

            def build(i: int, c: Column) -> Column:
                cols = []
                for (part, ch), f in zip(parts, fields):
                    if i in ch:
                        types = {k: next(g.dataType for g in inner[k].fields if g.name == p[-1]) for k, p in ch.items()}
                        cols.append(merge(ch, types, {k: (lambda _, p=p: c.getField(p[-1])) for k, p in ch.items()}, f"{name}.{part}" if not as_list else "")[0][i].alias(part))
                    else:
                        cols.append(F.lit(None).cast(f.dataType).alias(part))
                return F.when(c.isNotNull(), F.struct(*cols))

            out = {i: F.transform(read[i](None), (lambda i: lambda x: build(i, x))(i)) if as_list else build(i, read[i](None)) for i in kinds}
            return out, T.ArrayType(want) if as_list else want
        time = is_time(chain)
        want = _widest([kinds[i] for i in sorted(kinds)], has_fraction(chain, kinds))
        out = {}
        for i, k in kinds.items():
            raw = read[i](F.lit(None).cast(k))
            out[i] = _cast(raw, k, want, time)
            if name and k != want and not isinstance(want, T.StringType) and isinstance(k, (T.StringType, T.NumericType)) and not isinstance(want, T.ArrayType):
                losses[i].append((name, F.when(raw.isNotNull() & out[i].isNull(), raw.cast("string"))))
        return out, want

    def named(found: list[dict[int, Path]], used: set[str]) -> list[tuple[str, dict[int, Path]]]:
        out = []
        for chain in found:
            name = chain[min(chain)][-1]
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            out.append((name, chain))
        return out

    top = named(chains({i: () for i in range(len(files))}, {i: list(df.schema.fields) for i, (_, df) in enumerate(files)}), {"source_table", "unread"})
    merged = []
    for name, chain in top:
        kinds = {i: files[i][1].schema[p[0]].dataType for i, p in chain.items()}
        merged.append((name, *merge(chain, kinds, {i: (lambda _, p=p: col(p[0])) for i, p in chain.items()}, name)))
    parts = []
    for i, (table, df) in enumerate(files):
        cols = [(made[i] if i in made else F.lit(None).cast(kind)).alias(name) for name, made, kind in merged]
        lost = F.lit(None).cast("map<string,string>")
        if losses[i]:
            entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in losses[i]]), lambda e: e["value"].isNotNull())
            lost = let(entries, lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))
        parts.append(df.select(F.lit(table).alias("source_table"), *cols, lost.alias("unread")))
    return reduce(DataFrame.unionByName, parts)


def lossy_casts(unified: DataFrame) -> DataFrame:
    """A row for each value of ``unify`` that its column's type cannot hold: ``source_table, column, text, n`` (how often)."""
    return unified.where("unread is not null").select("source_table", F.explode("unread").alias("column", "text")).groupBy("source_table", "column", "text").agg(F.count("*").alias("n"))
