"""Line dedup: repeated runs of lines by the suffix order of all documents' line sequences.

DataFrame functions only.  A document is the sequence of its lines that aren't
blank, and every place in it starts a suffix.  Each distinct line gets an
integer id.  Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines:
the pairs of a suffix's rank and that of the suffix ``n`` lines further on are
sorted over range partitions, and the place of a pair in that order is the rank
for ``2n`` lines.  Only pairs that occur at least twice are sorted and ranked: a
suffix that has none is apart from all others, and no longer prefix of it is
repeated either.  Before the first round, lines that occur once are dropped, and
with them every stretch of lines that has too few words between two of them, so
what is ranked are the stretches that can hold a repeated run.

A run of lines counts as repeated from ``min_words`` words.  The prefix of ``l``
lines is named by ``l`` and the two ranks that cover it, from its start and to
its end.  Suffixes that share the name of their shortest prefix of enough words
are an interval of the suffix array whose longest common prefixes have enough
words; every maximal repeated run is the union of the shortest such prefixes that
start in it and the like blocks that end in it.  So one grouping by name finds,
for each interval, its first member in order of ids, and the others are later
copies whose lines are deleted.  Rounds end where nothing is left to rank or
ranks stand for over half of ``min_words`` lines: as no line that counts has less
than a word, deeper ranks name no shortest prefix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

MIN_WORDS = 50
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _order_key(docs: DataFrame, id_col: str) -> Column:
    """The id for ordering, null first: whole numbers as such, others as texts."""
    if docs.schema[id_col].dataType.simpleString() in _WHOLE:
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit(""))


def _plain(line: Column) -> Column:
    """A line without outer white space and with single blanks inside."""
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(did, rid, seq, name, words)`` of each line that isn't blank; ``rid`` tells apart rows that repeat an id."""
    text = whole_text(text_col)
    lines = F.filter(F.transform(F.split(text, "\n"), _plain), lambda x: x != "")
    held = docs.select(_order_key(docs, id_col).alias("did"), F.xxhash64(text).alias("rid"), F.posexplode(lines).alias("seq", "line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return held.select("did", "rid", "seq", F.unhex(F.md5(F.col("line").cast("binary"))).alias("name"), words.cast("bigint").alias("words"))


def _ranked(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``keys`` with ``rank``: places in their order over range partitions, written so that they stay as they are."""
    spread = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(spread.withColumn("rank", F.monotonically_increasing_id()), label)


def repeated_stretches(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``(did, rid, part, seq, words, r0)``: lines that occur more than once, in parts without a gap and of enough words; ``r0`` ranks lines."""
    rows = materialize(line_rows(docs, id_col, text_col), "lines")
    names = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    names = _ranked(names, ["name"], "line-ids").withColumnRenamed("rank", "r0")
    rows = rows.join(names, "name").select("did", "rid", "seq", "words", "r0").distinct()
    doc = Window.partitionBy("did", "rid")
    rows = rows.withColumn("part", F.col("seq") - F.row_number().over(doc.orderBy("seq")))
    rows = rows.withColumn("all", F.sum("words").over(Window.partitionBy("did", "rid", "part")))
    return rows.where(F.col("all") >= min_words).select("did", "rid", "part", "seq", "words", "r0")


def suffix_ranks(rows: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``r0``, ``r1``, ...: the ranks of suffixes of each part by their first 1, 2, 4, ... lines, null where the prefix occurs once; and these lengths."""
    order = Window.partitionBy("did", "rid", "part").orderBy("seq")
    rows, levels = materialize(rows, "suffixes"), [1]
    while levels[-1] * 2 <= most:
        k, n = len(levels), levels[-1]
        paired = rows.withColumn("ahead", F.when(F.col(f"r{k - 1}").isNotNull(), F.lead(f"r{k - 1}", n).over(order)))
        pairs = paired.where("ahead is not null").groupBy(f"r{k - 1}", "ahead").agg(F.count("*").alias("n")).where("n > 1").select(f"r{k - 1}", "ahead")
        ranks = _ranked(pairs, [f"r{k - 1}", "ahead"], f"ranks-{2 * n}").withColumnRenamed("rank", f"r{k}")
        if ranks.isEmpty():
            break
        rows = materialize(paired.join(ranks, [f"r{k - 1}", "ahead"], "left").drop("ahead"), f"suffixes-{2 * n}")
        levels.append(2 * n)
    return rows, levels


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(did, rid, gone)``: the places of the lines to delete in every document that has some."""
    rows, levels = suffix_ranks(repeated_stretches(docs, id_col, text_col, min_words), min_words)
    part = Window.partitionBy("did", "rid", "part")
    order = part.orderBy("seq")
    rows = rows.withColumns({
        "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "from": F.min("seq").over(part),
        "end": F.max("seq").over(part) + 1,
    }).withColumn("before", F.col("upto") - F.col("words"))
    ahead = part.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)
    behind = part.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    rows = rows.withColumns({"total": F.max("upto").over(part), "next": F.min("seq").over(ahead), "prior": F.max("seq").over(behind)})
    # the shortest prefix from here with enough words, and the shortest block to here
    forward = F.coalesce(F.col("next"), F.when(F.col("total") - F.col("before") >= min_words, F.col("end"))) - F.col("seq")
    backward = F.col("seq") - F.coalesce(F.col("prior"), F.when(F.col("upto") >= min_words, F.col("from") - 1))
    rows = rows.withColumns({"fw": forward.cast("int"), "bw": backward.cast("int")})
    blocks = []
    for k, n in enumerate(levels):
        # a block of n to 2n - 1 lines: the ranks of its first n lines and of its last n; deeper blocks than ranks go are apart
        for length, start in (("fw", F.lit(0)), ("bw", 1 - F.col("bw"))):
            near = order.rowsBetween(0, n - 1) if length == "fw" else order.rowsBetween(2 - 2 * n, 0)
            held = F.collect_list(F.coalesce(f"r{k}", F.lit(-1).cast("bigint"))).over(near)
            if length == "fw":
                first, last = F.col(f"r{k}"), F.get(held, F.col("fw") - n)
            else:
                first, last = F.get(held, F.size(held) - F.col("bw")), F.get(held, F.size(held) - n)
            fits = F.col(length).between(n, 2 * n - 1)
            blocks.append(F.when(fits, F.struct(F.lit(k).alias("k"), first.alias("first"), last.alias("last"), F.col(length).alias("length"), (F.col("seq") + start).alias("start"))))
    blocks = rows.select("did", "rid", F.array_compact(F.array(*blocks)).alias("b")).select("did", "rid", F.explode("b").alias("b")).select("did", "rid", "b.*")
    blocks = materialize(blocks.where("first >= 0 and last >= 0").distinct(), "line-blocks")
    name, place = ["k", "first", "last", "length"], F.struct("did", "rid", "start")
    intervals = blocks.groupBy(*name).agg(F.count("*").alias("n"), F.min(place).alias("earliest")).where("n > 1").drop("n")
    later = blocks.join(intervals, name).where(place > F.col("earliest"))
    seqs = later.select("did", "rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("seq"))
    return seqs.groupBy("did", "rid").agg(F.collect_set("seq").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without later copies of repeated runs in the text; adds ``n_lines``, ``n_removed`` and ``removed_runs``.

    Columns of these three names are replaced.  Lines are compared without outer
    and repeated white space (of Unicode); blank lines are neither compared nor
    deleted.  The first copy is that of the smallest id (ids that aren't whole
    numbers: as texts; rows that repeat an id: by hash of the text), then place.
    A null id comes first; a null text stays null and has no lines.  Rows that
    repeat both id and text are one document and lose the same lines.
    ``removed_runs`` lists the deleted runs as ``first-last`` line numbers from 0,
    among the lines that aren't blank.  An empty table gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_runs")]
    keyed = docs.select(F.struct(*names).alias("row"), _order_key(docs, id_col).alias("did"), F.xxhash64(whole_text(text_col)).alias("rid"))
    joined = keyed.join(gone.select("did", "rid", F.array_sort("gone").alias("gone")), ["did", "rid"], "left")
    text = F.col("row")[text_col]
    joined = joined.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn("n", F.size("gone"))

    def without(lines: Column, solid: Column) -> Column:
        places = F.transform("gone", lambda s: F.get(solid, s))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i)), "\n")

    solid = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(_plain(x) != "", i)), lambda i: i.isNotNull())
    left = _bound(F.split(text, "\n"), lambda lines: _bound(solid(lines), lambda places: without(lines, places)))
    # a run starts where the place before isn't gone, and ends where the next isn't
    starts = F.array_except("gone", F.transform("gone", lambda s: s + 1))
    ends = F.array_except("gone", F.transform("gone", lambda s: s - 1))
    runs = F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))), ",")
    filled = F.regexp_count(text, F.lit(r"(?U)\S[^\n]*"))
    return joined.select(
        *(F.when(F.col("n") > 0, left).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names),
        F.coalesce(filled, F.lit(0)).cast("bigint").alias("n_lines"),
        F.col("n").cast("bigint").alias("n_removed"),
        F.when(F.col("n") > 0, runs).otherwise("").alias("removed_runs"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document without later copies of repeated runs of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "removed_runs", "text")
