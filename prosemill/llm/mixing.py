"""Mixing sources to target weights by a hypergeometric splitting tree, built from SQL functions only.

A source's documents, in an order given by a hash, lie end to end on a line of words that is cut into blocks.  Its
target is drawn as whole passes over the line and a last pass over so many blocks, in a permuted order, that the words
add up exactly.  The draws of all sources are dealt to output shards by a tree: a node splits its exact quotas of every
source between two children by multivariate hypergeometric draws, one source after the other.  A shard then takes its
quota from each source as the next draws in the permuted order, disjoint from all other shards'; a draw beyond the last
shard's quota is not taken.  ``mixed_documents`` deals the pieces to their shards and shuffles each shard by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .quality import let, words_of

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Words in a block, several documents long so that most stay whole, and in a shard, which is sorted by one task.
BLOCK_WORDS, SHARD_WORDS = 2048, 1_000_000
#: Rounds (partner, factor, summand) of the block permutation, from a rule, and the prime that its bits are taken from.
_PRIME = (1 << 31) - 1
_ROUNDS = [tuple(pow(base, k + 1, _PRIME) for base in (48271, 69621, 16807)) for k in range(12)]
#: Standard deviations around the mean within which a split is drawn; what lies beyond is far below double precision.
_WIDTH = 12


def hypergeometric(pool: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of ``good`` items among ``draws`` from ``pool``, by inversion at ``u``.

    The probabilities follow from each other by ratios, so they are summed in one pass and inverted in a second.
    """
    p = good / F.greatest(pool, F.lit(1))
    sigma = F.sqrt(F.greatest(draws * p * (1 - p), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - (pool - good), F.floor(draws * p - _WIDTH * sigma).cast("long") - 2)
    high = F.least(good, draws, F.ceil(draws * p + _WIDTH * sigma).cast("long") + 2)

    def draw(x: Column) -> Column:
        pool, good, draws, low, high, u = (x[k] for k in ("pool", "good", "draws", "low", "high", "u"))
        ratio = lambda k: ((good - k) * (draws - k)).cast("double") / ((k + 1) * (pool - good - draws + k + 1)).cast("double")
        steps = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))
        one = F.lit(1.0)
        total = F.aggregate(steps, F.struct(one.alias("w"), one.alias("sum")), lambda a, k: let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))))["sum"]
        picked = let(
            u * total,
            lambda goal: F.aggregate(
                steps,
                F.struct(one.alias("w"), one.alias("sum"), low.alias("k")),
                lambda a, k: let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when(a["sum"] < goal, k + 1).otherwise(a["k"]).alias("k"))),
            )["k"],
        )
        return picked

    args = F.struct(pool.alias("pool"), good.alias("good"), draws.alias("draws"), low.alias("low"), high.alias("high"), u.alias("u"))
    return let(args, draw)


def permuted(block: Column, blocks: Column) -> Column:
    """The place of ``block`` (0 to blocks - 1) in a fixed permutation of all blocks.

    In every round a block and its partner (their sum is fixed, modulo their number) swap places or don't, as a bit of
    the greater of the two says; that is a permutation for any number of blocks, without a sort.
    """
    rounds = F.array(*[F.struct(*[F.lit(x).cast("long").alias(name) for name, x in zip("pfs", r, strict=True)]) for r in _ROUNDS])

    def swap(x: Column, r: Column) -> Column:
        n = F.greatest(blocks, F.lit(1).cast("long"))
        return let((r["p"] % n + n - x) % n, lambda y: F.when(F.shiftright((F.greatest(x, y) % _PRIME * r["f"] + r["s"]) % _PRIME, 15) % 2 == 1, y).otherwise(x))

    return F.aggregate(rounds, block, swap)


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, quotas) for one row with the array column quotas: the leaves of the splitting tree.

    A node over n shards gives its left child n // 2 of n parts of its draws.  Everything here is a few numbers per
    shard and source.
    """
    nodes = quotas.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.col("quotas"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    width = 1
    while width < shards:
        pool = total(F.col("quotas"))
        half = F.floor(F.col("n") / 2).cast("int")
        begin = F.struct(F.array().cast("array<long>").alias("left"), pool.alias("pool"), F.floor(pool * half / F.col("n")).cast("long").alias("draws"))
        numbered = F.transform("quotas", lambda q, j: F.struct(q.alias("q"), _uniform(F.lit(seed), F.col("first"), F.col("n"), j).alias("u")))

        def step(a: Column, x: Column) -> Column:
            return let(hypergeometric(a["pool"], x["q"], a["draws"], x["u"]), lambda k: F.struct(F.concat(a["left"], F.array(k)).alias("left"), (a["pool"] - x["q"]).alias("pool"), (a["draws"] - k).alias("draws")))

        left = F.aggregate(numbered, begin, step)["left"]
        both = let(left, lambda l: F.array(F.struct(F.col("first"), half.alias("n"), l.alias("quotas")), F.struct((F.col("first") + half).alias("first"), (F.col("n") - half).alias("n"), F.zip_with("quotas", l, lambda q, k: q - k).alias("quotas"))))
        alone = F.array(F.struct("first", "n", "quotas"))
        nodes = nodes.select(F.explode(F.when(F.col("n") > 1, both).otherwise(alone)).alias("c")).select("c.*")
        width *= 2
    return nodes.select(F.col("first").alias("shard"), "quotas")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) by water-filling: targets share all words by weight, none above its cap.

    Sources are ranked by code point, null last, and weigh 1, 2, 3, repeating.  One row per source goes to one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = sums.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.lit(float(MAX_REPEATS)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", (F.sum("source_size").over(every).cast("double") - before) / after).withColumn("place", F.row_number().over(by_ratio))
    met = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    level = F.min(met).over(every)["level"]
    return levels.select("source", "source_size", "rank", F.least("cap", F.coalesce(level, F.col("cap")) * F.col("weight")).alias("target"))


def _line(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document's start within its range of its source's line, and where every range starts.

    A running sum over a source would put a hot source into one task, so the line is summed in two steps: over 4096
    ranges of the hash, and within each of them.
    """
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))).withColumn("range", F.substring("key", 1, 3))
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "range").agg(F.sum("size").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("offset"))
    return placed, offsets


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, block_words: int = BLOCK_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """Plan of a mix over all documents.

    Returns doc_id, size (words), source, source_size, target and pieces, an array of (pass, draw, shard, position,
    start, words): the runs of the document's words that the mix takes, the shard that gets each and its place there;
    and, as the struct carried, the columns named in ``carry``.  Unless told, there are so many shards that one has about
    a million words.
    A pass takes a document at most once and there are at most three, so none is taken more than three times.  The words
    taken from a source add up to its rounded target.  A null text has no words; a null source is a source of its own;
    rows with equal ids and sizes are interchangeable.  The result depends on nothing but the rows, so reruns agree.
    An empty table gives an empty result.  Sources are assumed to be few enough for one array.
    """
    size = F.coalesce(F.size(words_of(docs[f"`{text_col}`"])), F.lit(0)).cast("long")
    carried = [F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]).alias("carried")] if carry else []
    sized = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), size.alias("size"), *carried)
    narrow = cut(sized.select("doc_id", "source", "size"))
    if not carry:
        sized = narrow
    b = F.lit(block_words).cast("long")
    if shards is None:
        shards = max(1, -(-(narrow.agg(F.sum("size")).first()[0] or 0) // SHARD_WORDS))
    stats = source_targets(narrow).withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    stats = stats.withColumn("full", F.expr("CASE WHEN source_size > 0 THEN wanted div source_size ELSE 0 END")).withColumn("rest", F.col("wanted") - F.col("full") * F.col("source_size"))
    stats = stats.withColumn("last_rank", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks")))).withColumn("short", F.col("source_size") - b * (F.col("blocks") - 1))
    touched = F.expr(f"CASE WHEN rest = 0 THEN 0 WHEN rest <= last_rank * {block_words} THEN (rest + {block_words - 1}) div {block_words} WHEN rest <= last_rank * {block_words} + short THEN last_rank + 1 ELSE (rest + {block_words} - short + {block_words - 1}) div {block_words} END")
    stats = cut(stats.withColumn("quota", F.coalesce(F.col("full") * F.col("blocks") + touched, F.lit(0))), 0)
    quotas = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas"))
    leaves = split_quotas(quotas, shards).select("shard", F.posexplode("quotas").alias("source_no", "n"))
    ends = leaves.groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("by_shard"))
    cumulated = F.aggregate("by_shard", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)).otherwise(F.lit(0).cast("long")) + x["n"])))
    planned = stats.join(ends.select((F.col("source_no") + 1).alias("rank"), cumulated.alias("ends")), "rank")
    placed, offsets = _line(sized)
    known = offsets.join(planned, offsets["source"].eqNullSafe(planned["source"])).select(offsets["source"].alias("s"), offsets["range"].alias("r"), "offset", "source_size", "target", "blocks", "full", "rest", "last_rank", "short", "ends")
    joined = placed.join(known, placed["source"].eqNullSafe(known["s"]) & (placed["range"] == known["r"])).withColumn("at", F.col("at") + F.col("offset"))

    def piece(turn: Column, block: Column, rank: Column) -> Column:
        length = F.when(block == F.col("blocks") - 1, F.col("short")).otherwise(b)
        before = rank * b - F.when(F.col("last_rank") < rank, b - F.col("short")).otherwise(F.lit(0))
        take = F.when(turn < F.col("full"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
        begin = F.greatest(block * b, F.col("at"))
        draw = turn * F.col("blocks") + rank
        shard = F.size(F.filter("ends", lambda e: e <= draw))
        return F.struct(turn.alias("pass"), draw.alias("draw"), shard.alias("shard"), F.xxhash64(F.lit("place"), F.col("source"), draw).alias("position"), (begin - F.col("at")).alias("start"), (F.least(block * b + take, F.col("at") + F.col("size")) - begin).alias("words"))

    block_numbers = F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))
    turns = F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, F.lit(0)).otherwise(F.lit(1)))
    none = F.col("size") * (F.col("full") + F.col("rest")) == 0
    ranked = F.transform(block_numbers, lambda k: F.struct(k.alias("block"), permuted(k, F.col("blocks")).alias("rank")))
    nested = let(ranked, lambda rs: F.flatten(F.transform(turns, lambda t: F.transform(rs, lambda r: piece(t, r["block"], r["rank"])))))
    pieces = F.when(~none, F.filter(nested, lambda p: (p["words"] > 0) & (p["shard"] < shards)))
    empty = F.array().cast("array<struct<pass:bigint,draw:bigint,shard:int,position:bigint,start:bigint,words:bigint>>")
    return joined.select("doc_id", "size", "source", "source_size", "target", F.coalesce(pieces, empty).alias("pieces"), *(["carried"] if carry else []))


def taken(pieces: Column | str) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["words"])


def mixed_documents(docs: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row per document, pass and shard, with the words taken.

    Every shard is a partition of its own (or shares one) and is shuffled there, its rows in the order of a hash of their
    draws and ids.  Where a whole document is taken the text is as it is; a part of it is its words joined by one space.
    """
    plan = mix(docs, text_col=text_col, carry=docs.columns, **options)
    row = F.col("piece")
    rows = plan.select("carried", "size", F.explode("pieces").alias("piece"), F.col("pieces"))
    # One row for the pieces of a pass that go to one shard: the first of them speaks for all.
    same = F.array_sort(F.transform(F.filter("pieces", lambda p: (p["pass"] == row["pass"]) & (p["shard"] == row["shard"])), lambda p: F.struct(p["start"].cast("int").alias("start"), p["words"].cast("int").alias("words"))))
    rows = rows.select("carried", "size", row["shard"].alias("shard"), row["position"].alias("position"), row["start"].alias("start"), same.alias("runs")).where(F.col("start") == F.col("runs")[0]["start"])
    text = F.col(f"carried.`{text_col}`")
    part = let(words_of(text), lambda w: F.array_join(F.flatten(F.transform("runs", lambda p: F.slice(w, p["start"] + 1, p["words"]))), " "))
    taken_text = F.when(taken("runs") == F.col("size"), text).otherwise(part)
    out = rows.select(*[(taken_text if c == text_col else F.col(f"carried.`{c}`")).alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col("shard").alias("__shard"), F.col("position").alias("__position"))
    dealt = out.repartition("__shard").sortWithinPartitions("__shard", F.xxhash64("__position", *[F.col(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]))
    return dealt.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _permuted_sql(table: str) -> str:
    """``table`` with the columns block and blocks, and the block's place in the permutation as block_rank."""
    sql = f"SELECT *, block AS x FROM {table}"
    for partner, factor, summand in _ROUNDS:
        sql = f"SELECT * EXCLUDE (y) REPLACE (CASE WHEN ((greatest(x, y) % {_PRIME} * {factor} + {summand}) % {_PRIME} >> 15) % 2 = 1 THEN y ELSE x END AS x) FROM (SELECT *, ({partner} % blocks + blocks - x) % blocks AS y FROM ({sql}))"
    return f"SELECT * EXCLUDE (x), x AS block_rank FROM ({sql})"


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source
), caps AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3.0::DOUBLE * source_size AS cap FROM sums
), levels AS (
  SELECT *, row_number() OVER r AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps WINDOW r AS (ORDER BY cap / weight, rank)
), targets AS (
  SELECT *, least(cap, (SELECT arg_min(level, place) FROM levels WHERE cap / weight >= level) * weight) AS target FROM levels
), stats AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM targets
), steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS full_passes, source_size - {BLOCK_WORDS} * (blocks - 1) AS short FROM stats
), lasts AS (
  SELECT source, block_rank AS last_rank FROM ({_permuted_sql("(SELECT source, blocks, blocks - 1 AS block FROM steps WHERE blocks > 0)")})
), ready AS (
  SELECT s.*, wanted - full_passes * source_size AS rest, last_rank FROM steps s LEFT JOIN lasts l ON s.source IS NOT DISTINCT FROM l.source
), placed AS (
  SELECT s.doc_id, s.size, r.*, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sized s JOIN ready r ON s.source IS NOT DISTINCT FROM r.source
), numbered AS (
  SELECT *, row_number() OVER () AS row_no FROM placed
), pieces AS (
  SELECT *, unnest(range(CAST(begins // {BLOCK_WORDS} AS BIGINT), CAST((begins + size - 1) // {BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM numbered WHERE size > 0
), ranked AS (
  SELECT *, CASE WHEN block = blocks - 1 THEN short ELSE {BLOCK_WORDS} END AS length FROM ({_permuted_sql("pieces")})
), parts AS (
  SELECT row_no, sum(greatest(0, least(block * {BLOCK_WORDS} + greatest(0, least(length, rest - (block_rank * {BLOCK_WORDS} - CASE WHEN last_rank < block_rank THEN {BLOCK_WORDS} - short ELSE 0 END))), begins + size)
    - greatest(block * {BLOCK_WORDS}, begins))) AS part FROM ranked GROUP BY row_no
)
SELECT doc_id, size, source_size, target, CAST(full_passes * size + coalesce(part, 0) AS BIGINT) AS taken FROM numbered LEFT JOIN parts USING (row_no)
"""
