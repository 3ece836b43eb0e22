"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its target over its size. Whole documents can't reach a
target by that: a source of one document of 20,000 words at a rate of 1.5 takes 20,000 words or 40,000. So a document's interval is
as long as its expected copies times its passages of `unit` words, and each integer boundary it crosses emits one passage:
the document is emitted whole as often as that fills, and the rest of it is one copy of its beginning. The shorter
last passages have intervals of their own. Within the source, intervals stand in the order of their passages' length, then of a
hash; they are prefix-summed and one random offset is added. As the order is by length, what a source takes differs
from its target by no more than about one passage.

The prefix sums are taken in three levels: over the lengths of a source, over the hash buckets of a length, and
within each such bucket, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.operators.store import written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _unit_interval(x: Column) -> Column:
    """A number in [0, 1) drawn from a text."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: list[int], share: float, cap: int, seed: str) -> DataFrame:
    """(source, source_size, target, offset) from (source, size): shares by weight of `share` times all words, none above `cap` times its source's size.

    Sources by code point, null last, take the weights in turn. With sources in the order of size over weight, those at their
    cap come first; all others share what is left by weight, so one pass of running sums finds the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    upto = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumns({"before": F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0)), "total": F.sum("source_size").over(everything) * share, "left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))})
    per = per.withColumn("full", F.col("source_size") * cap * F.col("left") <= F.col("w") * (F.col("total") - F.col("before")))
    per = per.withColumns({"given": F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everything), "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)})
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise((F.col("total") - F.col("given")) / F.nullif(F.col("open"), F.lit(0)) * F.col("w"))
    offset = _unit_interval(F.concat(F.lit(seed), F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))))
    return per.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, unit: int = 100, seed: str = "mix") -> DataFrame:
    """(doc_id, source, h, nth, size, source_size, target, taken, whole, rest) for each row of `docs` (doc_id, text, source; other columns are ignored).

    size: words; target: its source's; whole: how many of its passages of `unit` words the mix takes, repeats counted; rest: how often
    it takes the shorter last one; taken: words so taken. h is a hash of the text, nth numbers equal rows. Null and empty texts have no words and no
    passages; a null source is a source; rows with a null doc_id are sampled like others, by their text. The same rows
    give the same mix; ties of equal rows are open, as their copies are the same. An empty table gives an empty result.
    The number of sources is taken to be small: their targets are found in one task.
    """
    key = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 3)
    base = written(docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("h"), key.alias("bucket"), n_words().alias("size")), "sizes")
    same = Window.partitionBy("doc_id", "source", "h", "size").orderBy(F.lit(1))
    base = written(base.withColumn("nth", F.row_number().over(same)), "numbered")
    per = written(targets(base, list(weights), share, cap, seed), "targets")
    runs = F.array(F.struct(F.lit(unit).alias("words"), F.expr(f"size div {unit}").alias("many")), F.struct((F.col("size") % unit).cast("int").alias("words"), F.when(F.col("size") % unit > 0, 1).otherwise(0).cast("long").alias("many")))
    names = ["doc_id", "source", "h", "nth", "size"]
    long = base.withColumn("run", F.explode(runs)).where("run.many > 0").select(*names, "bucket", "run.words", "run.many")
    counts = long.groupBy("source", "words", "bucket").agg(F.sum("many").alias("many"))
    upto = lambda w: F.coalesce(F.sum("many").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = counts.groupBy("source", "words").agg(F.sum("many").alias("many")).select(F.col("source").alias("s"), F.col("words").alias("w"), upto(Window.partitionBy("source").orderBy("words")).alias("before"))
    starts = counts.select(F.col("source").alias("s"), F.col("words").alias("w"), F.col("bucket").alias("b"), upto(Window.partitionBy("source", "words").orderBy("bucket")).alias("inner"))
    placed = long.withColumn("own", upto(Window.partitionBy("source", "words", "bucket").orderBy("doc_id", "size", "h", "nth")))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("words") == F.col("w")) & (F.col("bucket") == F.col("b"))).drop("s", "w", "b")
    placed = placed.join(lengths, F.col("source").eqNullSafe(F.col("s")) & (F.col("words") == F.col("w")))
    rates = per.select(F.col("source").alias("s2"), (F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).alias("rate"), "offset")
    placed = placed.join(rates, F.col("source").eqNullSafe(F.col("s2"))).withColumn("at", F.col("before") + F.col("inner") + F.col("own"))
    mark = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    placed = placed.withColumn("copies", F.least(mark(F.col("at") + F.col("many")) - mark(F.col("at")), cap * F.col("many")))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("copies"))), F.lit(0)).cast("long")
    got = placed.groupBy(*names).agg(of(F.col("words") == unit).alias("whole"), of(F.col("words") < unit).alias("rest"), F.sum(F.col("words") * F.col("copies")).alias("taken"))
    none = F.lit(0).cast("long")
    out = base.drop("bucket").join(got.select(*(F.col(c).alias(f"_{c}") for c in names), "whole", "rest", "taken"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left")
    out = out.join(per.drop("offset").withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")))
    return out.select(*names, "source_size", "target", *(F.coalesce(c, none).alias(c) for c in ("taken", "whole", "rest")))


def emitted(docs: DataFrame, mixed: DataFrame, unit: int = 100) -> DataFrame:
    """The documents of a mix, with the columns of `docs`: copies of the whole text as often as its passages fill them, then one of its beginning.

    A whole copy has the text as it stands, a part of it its words joined by one space; its last passage, shorter than `unit` words, comes as often as
    the mix takes it. n_chars, if there is one, follows the text. Documents that the mix doesn't take, and those without words, have no rows.
    Nulls, ties and repeated rows are as in `mix`; empty tables give an empty result; of the columns of `docs` none may end with `_m_`.
    """
    names = ["doc_id", "source", "h", "nth", "size"]
    rows = docs.select("*", F.xxhash64("text").alias("h_m_"), n_words().alias("size_m_"))
    rows = rows.withColumn("nth_m_", F.row_number().over(Window.partitionBy("doc_id", "source", "h_m_", "size_m_").orderBy(F.lit(1))))
    plan = mixed.where("taken > 0").select(*(F.col(c).alias(f"{c}_p_m_") for c in names), F.col("whole").alias("whole_m_"), F.col("rest").alias("rest_m_"))
    mine = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source")}
    both = rows.join(plan, [mine.get(c, F.col(f"{c}_m_")).eqNullSafe(F.col(f"{c}_p_m_")) for c in names])
    many = F.expr(f"size_m_ div {unit}")
    tail = F.col("size_m_") % unit > 0
    both = both.withColumn("k_m_", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(F.col("whole_m_") / F.nullif(many, F.lit(0))), F.col("rest_m_")))))
    full = F.least(many, F.greatest(F.lit(0), F.col("whole_m_") - (F.col("k_m_") - 1) * many))
    ends = F.col("rest_m_") >= F.col("k_m_")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.filter(words, lambda w, i: (i < full * unit) | (ends & (i >= many * unit))), " ")
    both = both.withColumn("text_m_", F.when((full == many) & (ends | ~tail), F.col("text")).otherwise(part))
    made = {"text": F.col("text_m_"), "n_chars": F.length("text_m_").cast("long")}
    return both.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns))


def mix_sql(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, unit: int = 100, seed: str = "mix") -> str:
    """The digest of a mix of `documents` as one DuckDB statement: doc_id, size, source_size, target, taken."""
    upto = "(order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)"
    return f"""with d as (select row_number() over () as rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, substr(md5(coalesce(cast(doc_id as varchar), text, '')), 1, 3) as bucket from documents),
per as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, ({list(weights)})[(row_number() over (order by source nulls last) - 1) % {len(weights)} + 1] as w from per),
b as (select *, coalesce(sum(source_size * {cap}) over {upto}, 0) as before, sum(source_size) over () * {share}::double as total, sum(w) over () - coalesce(sum(w) over {upto}, 0) as open_ from w),
f as (select *, source_size * {cap} * open_ <= w * (total - before) as is_full from b),
g as (select *, sum(case when is_full then source_size * {cap} else 0 end) over () as given, sum(case when is_full then 0 else w end) over () as left_ from f),
t as (select source, source_size, case when is_full then cast(source_size * {cap} as double) else (total - given) / nullif(left_, 0) * w end as target, cast(('0x' || substr(md5('{seed}' || case when source is null then 'n' else 's' || source end), 1, 8)) as bigint) / 4294967296.0::double as shift from g),
r as (select rid, doc_id, source, size, bucket, {unit} as words, size // {unit} as many from d union all select rid, doc_id, source, size, bucket, size % {unit}, case when size % {unit} > 0 then 1 else 0 end from d),
p as (select *, coalesce(sum(many) over (partition by source order by words, bucket, doc_id, size rows between unbounded preceding and 1 preceding), 0) as upto from r where many > 0),
k as (select rid, sum(words * least(floor(target / source_size * (upto + many) + shift) - floor(target / source_size * upto + shift), {cap} * many)) as taken from p join t on p.source is not distinct from t.source group by rid)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from d join t on d.source is not distinct from t.source left join k using (rid)"""
