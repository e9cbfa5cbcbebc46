"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraph digests. Its sketch has ``3 * ROW`` cells; a digest falls
into one cell of each third, and a cell holds how many fell into it and their exclusive
or. Sketches of two versions subtract cell by cell, digests they share cancel, and peeling
recovers the others: a cell with one digest gives it away, which empties it elsewhere.

A digest carries a check of its own bits, so a cell that only looks like one digest is
not taken for it. Peeling that does not end in empty cells has failed, and the pair is
tried again with a larger sketch: its digests are split by further bits over as many
sketches as its size calls for, then over four times as many, where needed. Up to
``SPLIT`` sketches are peeled in the pair's own row, which moves nothing; larger pairs and
what is still left are in rows of their own, so that the work stays linear and no row grows
with a text's number of paragraphs. Should ``ATTEMPTS`` not do, the digests themselves are
compared. Where a pair is peeled changes no result.

Built-in functions only; no Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept
from weft.operators.ids import counted_ids

ROW = 16  # cells in each third; a power of two
LOAD = 12  # digests of both sides that a sketch of a retry gets on average
SPLIT = 64  # sketches of one pair that are peeled in its row
ROUNDS = 12
ATTEMPTS = 6
LONG_PARAGRAPH = 600  # a longer line counts as its sentences

_BITS = ROW.bit_length() - 1
_CHECK = "(xxhash64({0} & -65536L) & 65535L)"


def digests(text: Column) -> Column:
    """Sorted digests of a text's paragraphs, the k-th of several equal ones told apart by k.

    Paragraphs are its lines; lines of over ``LONG_PARAGRAPH`` characters count as their
    sentences. Blank ones are left out; null and empty texts have none.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG_PARAGRAPH, F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x))))
    hashes = F.sort_array(F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))

    def numbered(all_of: Column) -> Column:
        # the array is bound once, not recomputed for every element
        return F.transform(all_of, lambda x, i: F.xxhash64(x, i.cast("bigint") - F.array_position(all_of, x)))

    raw = F.element_at(F.transform(F.array(hashes), numbered), 1)
    return F.transform(raw, lambda x: x.bitwiseAND(F.lit(-65536)).bitwiseOR(F.xxhash64(x.bitwiseAND(F.lit(-65536))).bitwiseAND(F.lit(65535))))


def sketch(column: str) -> Column:
    """Cells ``struct<n:array<int>, x:array<bigint>>`` of a column of digests: how many, and their exclusive or."""
    return F.expr(_cells(column))


def _bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _dealt(digests: str) -> str:
    """SQL of an array with the digests of each cell.

    They are dealt by the upper, then by the lower half of a cell's bits, so that each is
    looked at eight times for a third and not once for each of its cells.
    """
    half = _BITS // 2

    def chosen(part: str, place: int, bits: int, to: str) -> str:
        return f"filter({part}, d -> (shiftright(d, {place}) & {(1 << bits) - 1}L) = {to})"

    def third(place: int) -> str:
        cells = f"transform(sequence(0L, {(1 << half) - 1}L), low -> {chosen('part', place, half, 'low')})"
        parts = _bound(chosen(digests, place + half, _BITS - half, "high"), "part", cells)
        return f"flatten(transform(sequence(0L, {(1 << _BITS - half) - 1}L), high -> {parts}))"

    return f"concat({', '.join(third(16 + i * _BITS) for i in range(3))})"


def _cells(a: str, b: str | None = None) -> str:
    """SQL of the cells of the digests ``a``, less those of ``b``.

    Counts and exclusive ors are two plain arrays: an array of structs is copied row by row at every step.
    """
    def mixed(side: str, start: str = "0L") -> str:
        return f"aggregate({side}, {start}, (x, d) -> x ^ d)"

    if b is None:
        return _bound(_dealt(a), "own", f"named_struct('n', transform(own, p -> size(p)), 'x', transform(own, p -> {mixed('p')}))")
    sides = f"named_struct('a', {_dealt(a)}, 'b', {_dealt(b)})"
    return _bound(sides, "own", f"""named_struct('n', zip_with(own.a, own.b, (p, q) -> size(p) - size(q)),
        'x', zip_with(own.a, own.b, (p, q) -> {mixed('q', mixed('p'))}))""")


def fingerprint(cells: Column) -> Column:
    """A sketch as text: count and digits of each cell."""
    return F.array_join(F.zip_with(cells["n"], cells["x"], lambda n, x: F.concat(n.cast("string"), F.lit("."), F.when(x == 0, F.lit("0")).otherwise(F.lower(F.hex(x))))), " ")


def subtract(a: str, b: str) -> str:
    """SQL of one sketch minus another, cell by cell."""
    return f"named_struct('n', zip_with({a}.n, {b}.n, (p, q) -> p - q), 'x', zip_with({a}.x, {b}.x, (p, q) -> p ^ q))"


def peel(cells: str) -> Column:
    """``struct<n, x, only_a, only_b, a, b>``: what remains in the cells, digests recovered (only left, only right),
    and those that the cells would give away next.

    ``cells`` is SQL; it is evaluated once.
    """
    return F.expr(_peel(cells))


def _peel(cells: str) -> str:
    def pure(n: int) -> str:
        return f"array_distinct(filter(c.x, (x, j) -> c.n[j] = {n} AND (x & 65535L) = {_CHECK.format('x')}))"

    def state(cells: str, only_a: str, only_b: str) -> str:
        return _bound(cells, "c", f"named_struct('n', c.n, 'x', c.x, 'only_a', {only_a}, 'only_b', {only_b}, 'a', {pure(1)}, 'b', {pure(-1)})")

    none = "filter(c.x, x -> false)"
    less = _bound(_cells("s.a", "s.b"), "p", subtract("s", "p"))
    return f"""
        aggregate(sequence(1, {ROUNDS}), {state(cells, none, none)},
            (s, i) -> if(size(s.a) + size(s.b) = 0, s, {state(less, 'concat(s.only_a, s.a)', 'concat(s.only_b, s.b)')}))"""


def done(peeled: str) -> Column:
    return F.expr(_done(peeled))


def _done(peeled: str) -> str:
    return f"NOT exists({peeled}.n, n -> n <> 0) AND NOT exists({peeled}.x, x -> x <> 0)"


def _found(peeled: str) -> str:
    """SQL of the number of digests recovered."""
    return f"(size({peeled}.only_a) + size({peeled}.only_b))"


def level(a: str, b: str) -> str:
    """SQL of the number of bits that split two arrays of digests into sketches of about ``LOAD``."""
    return f"cast(greatest(1, least(30, ceil(log2((size({a}) + size({b})) / {LOAD})))) as int)"


def split(a: str, b: str) -> Column:
    """``struct<n, a, b, level>`` of a pair whose one sketch failed, peeled in its own row.

    ``n`` digests were found to differ; ``a`` and ``b`` hold those of the sketches that failed
    again. A pair that needs more than ``SPLIT`` sketches comes back whole. ``level`` is the
    number of bits that the rest is to be split by next, see :func:`retried`.
    """
    # dealt by the upper, then by the lower half of the bits
    def dealt(side: str, at: str, mask: str, to: str) -> str:
        return f"filter({side}, d -> (shiftrightunsigned(d, {at}) & {mask}) = {to})"

    far = f"named_struct('l', {dealt(a, '32 + o.low', 'o.far', 'high')}, 'r', {dealt(b, '32 + o.low', 'o.far', 'high')})"
    near = f"named_struct('l', {dealt('half.l', '32', 'o.near', 'low')}, 'r', {dealt('half.r', '32', 'o.near', 'low')})"
    order = "named_struct('low', cast(bits div 2 as int), 'far', shiftleft(1L, cast(bits - bits div 2 as int)) - 1L, 'near', shiftleft(1L, cast(bits div 2 as int)) - 1L)"
    parts = _bound(order, "o", f"flatten(transform(sequence(0L, o.far), high -> {_bound(far, 'half', f'transform(sequence(0L, o.near), low -> {near})')}))")
    peeled = _peel(_cells("part.l", "part.r"))
    none = "filter(part.l, d -> false)"
    tried = f"""transform({parts}, part -> element_at(transform(array({peeled}), end ->
        if({_done('end')}, named_struct('n', {_found('end')}, 'a', {none}, 'b', {none}),
            named_struct('n', 0, 'a', part.l, 'b', part.r))), 1))"""
    return F.expr(f"""element_at(transform(array({level(a, b)}), bits -> if(shiftleft(1L, bits) > {SPLIT}L,
        named_struct('n', 0, 'a', {a}, 'b', {b}, 'level', bits),
        element_at(transform(array({tried}), tries -> named_struct(
            'n', aggregate(tries, 0, (n, t) -> n + t.n),
            'a', flatten(transform(tries, t -> t.a)), 'b', flatten(transform(tries, t -> t.b)), 'level', bits + 2)), 1))), 1)""")


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, n_diff)``: how many digests of the arrays ``a`` and ``b`` are in one of them only.

    ``keys`` name a pair and are not null. One sketch each first, then :func:`retried`.
    """
    first = _attempt(pairs)
    return first.where("ok").select(*keys, F.col("n").cast("bigint").alias("n_diff")).union(retried(first.where("NOT ok").select(*keys, "a", "b"), keys))


def retried(failed: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`differences` of pairs for which one sketch each was too small.

    A column ``level`` tells by how many bits to split first; without it, the sizes do.
    """
    solved = []
    bits = F.col("level") if "level" in failed.columns else F.expr(level("a", "b")).alias("level")
    work = failed.select(*keys, bits, "a", "b")
    for attempt in range(ATTEMPTS):
        loose = work.select(*keys, "level", F.size("a").alias("size_a"), F.posexplode(F.concat("a", "b")).alias("at", "d"))
        sub = F.expr("shiftrightunsigned(d, 32) & (shiftleft(1L, level) - 1L)").alias("sub")
        left = F.col("at") < F.col("size_a")
        a, b = (F.collect_list(F.when(side, F.col("d"))).alias(c) for c, side in (("a", left), ("b", ~left)))  # about LOAD together
        rest = _attempt(loose.groupBy(*keys, "level", sub).agg(a, b).drop("sub"))
        solved.append(rest.where("ok").select(*keys, "n"))
        work = rest.where("NOT ok").select(*keys, F.expr("least(31, level + 2)").alias("level"), "a", "b")
        if not work.limit(1).count():
            break
    else:
        exact = F.expr("size(array_except(a, b)) + size(array_except(b, a))")
        solved.append(work.select(*keys, exact.alias("n")))
    every = solved[0]
    for frame in solved[1:]:
        every = every.union(frame)
    return every.groupBy(*keys).agg(F.sum("n").alias("n_diff"))


def _attempt(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``ok`` and ``n`` of one sketch each; digests only where they are needed again."""
    cells = pairs.withColumns({"_sa": sketch("a"), "_sb": sketch("b")})
    peeled = cells.withColumn("_p", peel(subtract("_sa", "_sb"))).withColumn("ok", done("_p"))
    rest = [F.when(~F.col("ok"), F.col(c)).alias(c) for c in ("a", "b")]
    others = [c for c in pairs.columns if c not in ("a", "b")]
    return kept(peeled.select(*others, "ok", F.when(F.col("ok"), F.expr(_found("_p"))).otherwise(0).alias("n"), *rest), "sketches")


def recovered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, ok, only_a, only_b)``: the digests that one sketch per pair of arrays ``a``, ``b`` gives back."""
    cells = pairs.withColumns({"_sa": sketch("a"), "_sb": sketch("b")})
    peeled = cells.withColumn("_p", peel(subtract("_sa", "_sb"))).withColumn("ok", done("_p"))
    return peeled.select(*keys, "ok", "_p.only_a", "_p.only_b")


def likeness(size_a: Column, size_b: Column, n_diff: Column) -> Column:
    """Shared digests over all digests, from the sizes and the number that differ; 1 for two empty texts."""
    return F.when(size_a + size_b == 0, F.lit(1.0)).otherwise((size_a + size_b - n_diff) / (size_a + size_b + n_diff))


def successors(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For ``docs(doc_id, h, n_chars)``: ``(doc_id, h, owner_id, owner_h, need)`` and whether rows repeat.

    A row is what follows its owner in descending order of id (the first follows the last);
    ``need`` is how many of its characters the owner's edited text takes.
    """
    single = docs.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    ranked, number = counted_ids(single.withColumn("down", F.bitwise_not("doc_id")), ["down", "doc_id", "h"])
    repeats = ranked.where("n > 1").limit(1).count() > 0
    owner = ranked.select(
        F.col("doc_id").alias("owner_id"), F.col("h").alias("owner_h"), F.expr("cast(n_chars div 3 as int)").alias("need"),
        ((F.col("id") + 1) % max(1, number)).alias("id"),
    )
    return kept(ranked.join(owner, "id").select("doc_id", "h", "owner_id", "owner_h", "need"), "successors"), repeats


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited form, and how like their fingerprints are.

    The edited text has its last third (rounded down) replaced by as many first characters
    of the next document, in descending order of id; after the last comes the first.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_paragraphs``. Null texts count as empty. Rows that repeat an id follow one
    another in the order of a hash of their texts; rows that repeat id and text count once.
    Null ids come before all others. An empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    following, repeats = successors(rows.select("doc_id", "h", F.length("text").cast("bigint").alias("n_chars")))
    # a key of columns that are never null: a null id has a mark of its own
    def key(id: str, h: str) -> list[Column]:
        return [F.coalesce(id, F.lit(0)).alias("k_id"), F.col(id).isNull().alias("k_none"), F.coalesce(h, F.lit(0)).alias("k_h")]

    # both joins read the same columns of the same rows, so that texts are shuffled once
    on = ["k_id", "k_none", "k_h"]
    keyed = rows.select(*key("doc_id", "h"), "text", digests(F.col("text")).alias("own"))
    keyed = keyed.dropDuplicates(on) if repeats else keyed
    owner = F.struct(*key("owner_id", "owner_h")).alias("owner")
    giver = following.select(*key("doc_id", "h"), owner, "need")
    heads = keyed.join(giver.hint("merge"), on).select("owner.*", F.expr("substring(text, 1, need)").alias("head"), F.col("own").alias("next"))
    edited = keyed.join(heads.hint("merge"), on).select(
        F.struct(*on).alias("key"), F.length("text").cast("bigint").alias("n_chars"), "own", "next",
        F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), "head").alias("edited"),
    )
    edited = edited.select("key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next", digests(F.col("edited")).alias("edit"))
    cells = edited.withColumns({f"_{c}": sketch(c) for c in ("own", "edit", "next")})
    cells = cells.withColumns({f"_p_{c}": peel(subtract("_own", f"_{c}")) for c in ("edit", "next")})
    cells = cells.withColumns({f"_ok_{c}": done(f"_p_{c}") for c in ("edit", "next")})
    cells = cells.withColumns({f"_s_{c}": F.when(~F.col(f"_ok_{c}"), split("own", c)) for c in ("edit", "next")})
    left = {c: F.size(f"_s_{c}.a") + F.size(f"_s_{c}.b") > 0 for c in ("edit", "next")}
    first = cells.select(
        F.monotonically_increasing_id().alias("row"), "key.k_id", "key.k_none", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_edit")).alias("edited_fingerprint"),
        *(F.size(c).alias(f"n_{c}") for c in ("own", "edit", "next")),
        *(F.when(F.col(f"_ok_{c}"), F.expr(_found(f"_p_{c}"))).otherwise(F.col(f"_s_{c}.n")).alias(f"d_{c}") for c in ("edit", "next")),
        *(F.when(left[c], F.col(f"_s_{c}")).alias(f"rest_{c}") for c in ("edit", "next")),
    )
    first = kept(first, "fingerprints")
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"rest_{c}").alias("rest")) for i, c in enumerate(("edit", "next"))))).alias("k")
    open_rows = F.col("rest_edit").isNotNull() | F.col("rest_next").isNotNull()
    again = first.where(open_rows).select("row", kinds).where("k.rest IS NOT NULL")
    again = again.select((F.col("row") * 2 + F.col("k.kind")).alias("pair"), "k.rest.level", "k.rest.a", "k.rest.b")
    found = retried(again, ["pair"]).groupBy(F.shiftright("pair", 1).alias("row"))
    found = found.agg(*(F.max(F.when(F.col("pair") % 2 == i, F.col("n_diff"))).alias(f"r_{c}") for i, c in enumerate(("edit", "next"))))
    # only rows with something left meet what was found; the others stay where they are
    late, settled = (first.where(some).drop("rest_edit", "rest_next") for some in (open_rows, ~open_rows))
    none = F.lit(None).cast("bigint")
    joined = late.join(found, "row", "left").unionByName(settled.select("*", none.alias("r_edit"), none.alias("r_next")))
    n_own = F.col("n_own")
    near = (likeness(n_own, F.col(f"n_{c}"), F.col(f"d_{c}") + F.coalesce(f"r_{c}", F.lit(0))).alias(name) for c, name in (("edit", "near_edited"), ("next", "near_next")))
    id = F.when(~F.col("k_none"), F.col("k_id")).alias("doc_id")
    return joined.select(id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, n_own.alias("n_paragraphs"))
