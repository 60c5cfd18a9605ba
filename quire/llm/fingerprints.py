"""Document fingerprints: invertible Bloom lookup sketches over the digests of a text's paragraphs.

A paragraph is a line or sentence; one without an end in 120 characters is cut there. A sketch is TABLES x PLACES cells
(count, xor of digests, xor of check sums); each digest falls in one cell of every table. Subtracting two sketches leaves
the digests that differ, and peeling cells of count 1 recovers them. Where peeling fails, both texts are sketched again
with more cells: a sketch for each class of some four digests, by bits that no level before has used; and so on for the classes that
failed. Past DEPTH retries the digests themselves are compared, so a difference is always whole. The fingerprint stands for a set of
paragraphs: texts with the same paragraphs in another order, or as often repeated, have the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLES, PLACES, DEPTH, ROUNDS = 3, 4, 3, 8
#: From which bit of a digest a retry deals classes; the places of a digest are at bits 20, 32 and 44.
BITS = {1: 22, 2: 34}
PARAGRAPH = r"[^\n.]{0,120}[\n.]|[^\n.]{1,120}"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for an empty text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(d: str, table: str) -> str:
    """A digest's place in a table: each table has two bits of the digest of its own, from 20, 32 and 44 on."""
    return f"(shiftrightunsigned({d}, {table}) & {PLACES - 1})"


def _sketch(xs: str, v: str) -> str:
    zero = "named_struct('n', 0, 'd', 0L, 'c', 0L)"
    add = f"named_struct('n', s{v}.n + 1, 'd', s{v}.d ^ d{v}, 'c', s{v}.c ^ xxhash64(d{v}, 1))"
    table = lambda t: f"transform(sequence(0, {PLACES - 1}), i{v} -> aggregate({xs}, {zero}, (s{v}, d{v}) -> if({_place(f'd{v}', str(20 + 12 * t))} = i{v}, {add}, s{v})))"
    return f"concat({', '.join(table(t) for t in range(TABLES))})"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _peel(cells: str, v: str) -> str:
    """Digests of either side by rounds of cells of count 1; null when cells stay."""
    s, p, c, i, a, x = (k + v for k in "spciax")
    pure = f"array_distinct(transform(filter({s}.cells, {c} -> abs({c}.n) = 1 AND {c}.c = xxhash64({c}.d, 1)), {c} -> named_struct('n', {c}.n, 'd', {c}.d)))"
    less = f"transform({s}.cells, ({c}, {i}) -> aggregate({p}, {c}, ({a}, {x}) -> if({_place(f'{x}.d', f'20 + 12 * ({i} div {PLACES})')} = {i} % {PLACES}, named_struct('n', {a}.n - {x}.n, 'd', {a}.d ^ {x}.d, 'c', {a}.c ^ xxhash64({x}.d, 1)), {a})))"
    step = _let(p, pure, f"if(size({p}) = 0, named_struct('cells', {s}.cells, 'got', {s}.got, 'on', false), named_struct('cells', {less}, 'got', concat({s}.got, {p}), 'on', true))")
    start = f"named_struct('cells', {cells}, 'got', cast(array() AS array<struct<n:int,d:bigint>>), 'on', true)"
    done = f"if(exists({s}.cells, {c} -> {c}.n <> 0 OR {c}.d <> 0 OR {c}.c <> 0), NULL, {s}.got)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, ({s}, r{v}) -> if({s}.on, {step}, {s}), {s} -> {done})"


def _ranges(xs: str, v: str) -> str:
    """Array of the classes of a sorted array: slices of it, cut where the ranges' first values starts{v} would stand in it."""
    cut = f"transform(starts{v}, y{v} -> cast(array_position(q{v}, y{v}) AS int))"
    each = f"transform(e{v}, (x{v}, i{v}) -> slice(q{v}, x{v} + 1, coalesce(get(e{v}, i{v} + 1) - 1, size(q{v})) - x{v}))"
    return _let(f"q{v}", f"sort_array(concat({xs}, starts{v}))", _let(f"e{v}", cut, each))


def _differing(left: str, right: str, level: int = 0, made: tuple[str, str] | None = None) -> str:
    """SQL for array<struct<n, d>>: digests that one side alone has, n = 1 for the left side's and -1 for the right's. made: their first sketches.

    Each level deals the digests of what failed to classes of some four: the first to ranges of the sorted digests (256 at most, as cutting
    them costs classes times digests), the later ones by the bits from BITS[level] on.
    """
    v = f"_{level}"
    a, b, j = f"l{v}", f"r{v}", f"j{v}"
    one, two = made or (_sketch(a, f"{v}a"), _sketch(b, f"{v}b"))
    gap = f"zip_with({one}, {two}, (x{v}, y{v}) -> named_struct('n', x{v}.n - y{v}.n, 'd', x{v}.d ^ y{v}.d, 'c', x{v}.c ^ y{v}.c))"
    peeled = f"if(abs(size({a}) - size({b})) > {TABLES * PLACES}, NULL, {_peel(gap, f'{v}p')})"
    many = f"greatest(2, (size({a}) + size({b})) div 4)"
    if level == 0:
        starts = f"transform(array(least(256, {many})), w{v} -> transform(sequence(0, w{v} - 1), {j} -> shiftleft({j} * ({(1 << 63) - 1}L div w{v}), 1) ^ {-(1 << 63)}L))[0]"
        inner = _differing(f"u{v}", f"p{v}[{j}]", level + 1)
        larger = _let(f"starts{v}", starts, _let(f"p{v}", _ranges(b, v), f"flatten(transform({_ranges(a, v)}, (u{v}, {j}) -> {inner}))"))
    elif level < DEPTH:
        kind = f"(shiftrightunsigned(z{v}, {BITS[level]}) & 1023) % m{v} = {j}"
        inner = _differing(f"filter({a}, z{v} -> {kind})", f"filter({b}, z{v} -> {kind})", level + 1)
        larger = _let(f"m{v}", many, f"flatten(transform(sequence(0, m{v} - 1), {j} -> {inner}))")
    else:
        larger = f"concat(transform(array_except({a}, {b}), z{v} -> named_struct('n', 1, 'd', z{v})), transform(array_except({b}, {a}), z{v} -> named_struct('n', -1, 'd', z{v})))"
    return _let(a, left, _let(b, right, f"coalesce({peeled}, {larger})"))


def sketch(xs: str) -> Column:
    """The first sketch of an array<bigint> column of digests."""
    return F.expr(_sketch(f"`{xs}`", "_f"))


def differing(left: str, right: str, sketches: tuple[str, str] | None = None) -> Column:
    """Digests that only one of two array<bigint> columns of digests has, by subtracting and peeling their sketches (columns, if they are there)."""
    made = (f"`{sketches[0]}`", f"`{sketches[1]}`") if sketches else None
    return F.expr(_differing(f"`{left}`", f"`{right}`", made=made))


def likeness(n_left: Column, n_right: Column, n_differing: Column) -> Column:
    """Common digests over all digests of both (1 where neither has any)."""
    both = (n_left + n_right - n_differing) / 2
    every = both + n_differing
    return F.when(every == 0, 1.0).otherwise(both / F.when(every == 0, 1).otherwise(every))


def fingerprint(sketch_column: str) -> Column:
    """A sketch as text: count, digests and check sums of each cell, in hex."""
    return F.array_join(F.transform(sketch_column, lambda f: F.concat_ws(":", F.hex(f["n"]), F.hex(f["d"]), F.hex(f["c"]))), ",")


def neighbours(keys: DataFrame) -> DataFrame:
    """keys(d, none, hash, n) -> with the row before in descending order of d (none last), round about: to_d, to_none, to_hash, to_n.

    Rows are numbered by range partitions, so no task sees the whole order; only a count for each partition is brought together.
    """
    order = [F.col("none").asc(), F.col("d").desc(), F.col("hash").asc()]
    dealt = materialise(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    dealt = dealt.withColumns({"part": F.shiftrightunsigned("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    parts = dealt.groupBy("part").agg(F.count("*").alias("n_part"))
    before = F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n_part").over(Window.partitionBy())
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    ranked = dealt.join(F.broadcast(parts), "part").select("d", "none", "hash", "n", (F.col("before") + F.col("at")).alias("rank"), "total")
    other = ranked.select(((F.col("rank") + 1) % F.col("total")).alias("rank"), *[F.col(c).alias(f"to_{c}") for c in ("d", "none", "hash", "n")])
    return ranked.join(other, "rank").drop("rank", "total", "n")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text), of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, in descending doc_id order, after the last the first. Null text counts as empty; null doc_ids come last;
    rows equal in doc_id and text are one place in the order and each gives the same result; rows with equal doc_id and
    other texts are ordered by a hash of the text. Columns other than doc_id and text are not read. One row each of:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_differing.
    """
    place = ["d", "none", "hash"]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = materialise(neighbours(rows.select(*place, F.length("text").alias("n")).distinct()), "neighbours")
    # Whole texts are shuffled once, by place: both sides below have them from the same exchange.
    placed = rows.join(keys.hint("merge"), place)
    once = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*place).orderBy("to_n"))).where("nth = 1")
    heads = once.select(*[F.col(f"to_{c}").alias(c) for c in place], F.expr("substring(text, 1, to_n div 3)").alias("head"), digests(F.col("text")).alias("next_digests"))
    joined = rows.join(heads.hint("merge"), place)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), F.col("head"))
    made = joined.select(F.when(~F.col("none"), F.col("d")).alias("doc_id"), n.cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), edited.alias("edited"), "next_digests")
    made = made.select("doc_id", "n_chars", "own", "next_digests", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("changed"))
    made = made.withColumns({"s_own": sketch("own"), "s_changed": sketch("changed"), "s_next": sketch("next_digests")})
    out = made.select("*", F.size(differing("own", "changed", ("s_own", "s_changed"))).alias("d_edited"), F.size(differing("own", "next_digests", ("s_own", "s_next"))).alias("d_next"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("s_own").alias("fingerprint"), fingerprint("s_changed").alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("changed"), F.col("d_edited")).alias("near_edited"), likeness(F.size("own"), F.size("next_digests"), F.col("d_next")).alias("near_next"),
        F.size("own").cast("long").alias("n_paragraphs"), F.col("d_edited").cast("long").alias("n_differing"),
    )
