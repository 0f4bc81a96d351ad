"""Mixing sources to target weights by pivotal dependent rounding; DataFrame and SQL functions only.

Each document should be taken x = target / size of its source times.  The whole part is certain;
the fractional parts are rounded together.  Two documents of a source meet: words are moved from
one's expectation to the other's, in a random direction that leaves both expectations as they are
on average, until one of the two is integral.  The other one goes on to meet the next.  Words are
conserved at every meeting.  The one document that is left of a source is rounded to the nearer
number, so a source misses its target by half a document at most.

The meetings form a tree: documents are dealt by a hash into small blocks, a block is folded in
one row and hands on one residual, residuals are dealt into blocks again, until a source has one
left.  A source of any size is many blocks, and a level costs a shuffle of small rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN, Shared, unused

#: Parameters: source weights in turn, words wanted of all words, most copies, documents that meet in a block.
WEIGHTS, SHARE, MOST, FAN = (5, 2, 1), 1.5, 2, 32
#: Copies of one row that come out of one task.
REPEAT = 10_000


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source -> with ``target``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn.  Targets fill
    like connected vessels: at the level L where min(L * weight, most * size) add up to the share.
    Sources sorted by the level at which they are full: the first that isn't full at the level that
    the earlier ones leave tells the level.  One row of two numbers for each source stands here, never
    documents, and all of them meet in one task: its bound is tens of millions of sources.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    at = "row_number() OVER (ORDER BY source ASC NULLS LAST)"
    rows = sizes.withColumn("weight", F.element_at(turn, (F.expr(at) - 1) % len(weights) + 1)).withColumn("most", F.col("source_size") * float(most))
    rows = rows.select(
        "*",
        F.expr("most / weight").alias("full"),
        F.expr(f"(SUM(source_size) OVER ()) * {share}D").alias("all"),
        F.expr("coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)").alias("before"),
        F.expr("sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").alias("open"),
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("before")) / F.col("open"))
    rows = rows.withColumn("level", F.expr("min(CASE WHEN level <= full THEN struct(full, source IS NULL, source, level) END) OVER ()")["level"])
    return rows.select("source", "source_size", F.expr("least(coalesce(level, full) * weight, most)").alias("target"))


#: One meeting.  x has gathered the residual so far (x.cur), e is the next document; s: size, p: expectation.
_MEET = """
aggregate(
  slice(items, 2, size(items)),
  named_struct('done', slice(transform(items, e -> named_struct('item', e, 'one', 0)), 1, 0), 'cur', items[0]),
  (x, e) -> transform(array(named_struct(
      'up', coalesce({uniform} < try_divide(least(x.cur.s * x.cur.p, e.s * (1D - e.p)), least(x.cur.s * (1D - x.cur.p), e.s * e.p) + least(x.cur.s * x.cur.p, e.s * (1D - e.p))), false),
      'add', x.cur.s * (1D - x.cur.p) <= e.s * e.p,
      'sub', x.cur.s * x.cur.p <= e.s * (1D - e.p))),
    t -> CASE
      WHEN t.up AND t.add THEN named_struct('done', concat(x.done, array(named_struct('item', x.cur, 'one', 1))), 'cur', {of_e} e.p - x.cur.s * (1D - x.cur.p) / e.s {end})
      WHEN t.up THEN named_struct('done', concat(x.done, array(named_struct('item', e, 'one', 0))), 'cur', {of_cur} x.cur.p + e.s * e.p / x.cur.s {end})
      WHEN t.sub THEN named_struct('done', concat(x.done, array(named_struct('item', x.cur, 'one', 0))), 'cur', {of_e} e.p + x.cur.s * x.cur.p / e.s {end})
      ELSE named_struct('done', concat(x.done, array(named_struct('item', e, 'one', 1))), 'cur', {of_cur} x.cur.p - e.s * (1D - e.p) / x.cur.s {end})
    END)[0])
"""
_ITEM = ("k", "doc_id", "h", "m", "base", "s", "p")


def _uniform(*parts: str) -> str:
    """A number in [0, 1) from a hash, the same in every run."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) * {2.0**-53!r}D)"


def _meetings(seed: int, level: int) -> Column:
    def renewed(v: str) -> str:
        kept = ", ".join(f"'{c}', {v}.{c}" for c in _ITEM[:-1])
        return f"named_struct({kept}, 'p', least(1D, greatest(0D,"

    return F.expr(_MEET.format(uniform=_uniform(str(seed), str(level), "x.cur.k", "e.k"), of_e=renewed("e"), of_cur=renewed("x.cur"), end=")))"))


def copies(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """``(source, doc_id, h, size, m, source_size, target, copies)`` for each group of equal documents.

    h is a hash of the text, m counts the rows with this id, source and text, and ``copies`` is how
    often the mix takes them together.  The same input gives the same result in every run.
    """
    spark = docs.sparkSession
    units = docs.select(
        F.col(source_col).cast("string").alias("source"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("h"),
        word_count(text_col).alias("size"),
    )
    units = shared.table(units.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("m")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    known = shared.table(targets(sizes.drop("n"), weights, share, most).join(sizes.select(F.col("source").alias("__s"), "n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "targets")
    mine = known.withColumnRenamed("source", "__s")
    wanted = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) * F.col("m")
    rows = units.join(mine, units.source.eqNullSafe(mine["__s"])).drop("__s").withColumn("wanted", wanted).withColumn("base", F.floor("wanted").cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("wanted") - F.col("base")).otherwise(0.0)).withColumn("k", F.xxhash64("doc_id", "h", F.lit(seed)))
    rows = rows.withColumn("s", F.col("size").cast("double"))
    whole = rows.where("p = 0").select("source", "doc_id", "h", "size", "m", F.col("base").alias("copies"))
    item = F.struct(*_ITEM)
    open_ = rows.where("p > 0").select("source", item.alias("item"), F.ceil(F.col("n") / FAN).alias("blocks"))
    most_blocks = known.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    done = [whole]
    level = 0
    while most_blocks:
        block = F.pmod(F.xxhash64(F.lit(seed + level), "item.k"), F.col("blocks"))
        folded = open_.groupBy("source", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = shared.table(folded.select("source", "blocks", _meetings(seed, level).alias("x")), f"level-{level}")
        settled = folded.select("source", F.explode("x.done").alias("d"))
        done.append(settled.select("source", "d.item.doc_id", "d.item.h", F.col("d.item.s").cast("long").alias("size"), "d.item.m", (F.col("d.item.base") + F.col("d.one")).alias("copies")))
        last = F.col("blocks") <= 1
        final = folded.where(last).select("source", F.col("x.cur").alias("c"))
        done.append(final.select("source", "c.doc_id", "c.h", F.col("c.s").cast("long").alias("size"), "c.m", (F.col("c.base") + (F.col("c.p") >= 0.5).cast("long")).alias("copies")))
        open_ = folded.where(~last).select("source", F.col("x.cur").alias("item"), F.ceil(F.col("blocks") / FAN).alias("blocks"))
        most_blocks = ceil(most_blocks / FAN) if most_blocks > 1 else 0
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(mine.drop("n"), out.source.eqNullSafe(mine["__s"])).drop("__s")


def _repeated(rows: DataFrame, times: str, turn: str) -> DataFrame:
    """Every row ``times`` times, ``turn`` counting from 0; a row of very many comes out of many tasks."""
    few = rows.where(F.col(times).between(1, REPEAT)).withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))
    many = rows.where(F.col(times) > REPEAT)
    many = many.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEAT)))).repartition(F.col(turn))
    last = F.least(F.col(times).cast("long") - 1, (F.col(turn) + 1) * REPEAT - 1)
    return few.unionByName(many.withColumn(turn, F.explode(F.sequence(F.col(turn) * REPEAT, last))))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for each row of ``docs``.

    Null and wordless texts have size 0; they take part with the whole copies that their source's
    share gives, and add no words.  A source without words has target 0.  Null is a source of its
    own, the last one.  Repeated rows share what they get together, none above the most copies.  An
    empty table gives an empty table; other columns are ignored.
    """
    rows = copies(docs, Shared.create(docs.sparkSession, "mixing"), id_col, text_col, source_col, **options)
    share = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("j") < F.col("copies") % F.col("m"), 1).otherwise(0)
    rows = _repeated(rows, "m", "j").withColumn("copies", share.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``plan`` takes it, with all its columns.

    Columns may have any names and types.  Rows with one id, source and text that differ elsewhere
    share their copies in the order of their other columns, as JSON.  Texts without words are taken
    as often as the whole copies of their source say; an empty table gives an empty table.
    """
    names = docs.columns
    key, own, of, m, n, kind, count, before, turn, k_key, k_own, k_of = unused(names, "key", "own", "of", "m", "n", "kind", "count", "before", "turn", "taken_key", "taken_own", "taken_of")
    found = copies(docs, Shared.create(docs.sparkSession, "mixing"), id_col, text_col, source_col, **options)
    found = found.where("copies > 0").select(F.col("h").alias(k_key), F.col("doc_id").alias(k_own), F.col("source").alias(k_of), F.col("m").alias(m), F.col("copies").alias(n))
    rows = docs.withColumns({key: F.xxhash64(F.col(f"`{text_col}`").cast("string")), own: F.col(f"`{id_col}`").cast("long"), of: F.col(f"`{source_col}`").cast("string")})
    same = (F.col(key) == F.col(k_key)) & F.col(own).eqNullSafe(F.col(k_own)) & F.col(of).eqNullSafe(F.col(k_of))
    plain = [F.col(f"`{c}`") for c in names]
    out = _repeated(rows.join(found.where(F.col(m) == 1), same), n, turn).select(*plain)
    if not found.where(F.col(m) > 1).limit(1).count():
        return out
    many = rows.join(found.where(F.col(m) > 1), same)
    group = [key, own, of]
    many = many.groupBy(*group, F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.lit(0).alias("c"))).alias(kind)).agg(F.first(F.struct(*plain)).alias(turn), F.count("*").alias(count), F.first(m).alias(m), F.first(n).alias(n))
    earlier = Window.partitionBy(*group).orderBy(kind).rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col(count), F.col(n) % F.col(m) - F.col(before)))
    many = many.withColumn(n, F.col(count) * F.floor(F.col(n) / F.col(m)) + extra)
    return out.unionByName(_repeated(many.select(F.col(turn).alias("row"), F.col(n).alias("n")), "n", "j").select("row.*"))
