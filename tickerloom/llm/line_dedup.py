"""Near-duplicate lines by a segment-partition edit join, in Spark expressions only.

Lines within ``edits`` edits of each other share one of ``edits + 1`` segments, unchanged and at most a few places away. Each
line is indexed by its segments under its length, and probes the segments of lines as long as itself or a little shorter
at the places that can matter. Lines that meet are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.filters import semi_filter
from tickerloom.llm.linkage import link_buckets
from tickerloom.workspace import stage


#: Letters whose counts rule out most pairs before they are compared; any choice gives the same result.
LETTERS = "etanoirshdlucmfg"


@dataclass(frozen=True)
class LineSettings:
    """Lines of at least ``least`` characters take part; ``edits`` is the largest edit distance of a link. With ``short``, equal
    shorter lines are repeats, too, without edits; blank ones always stay, as they part paragraphs."""

    edits: int = 2
    least: int = 20
    short: bool = False


#: Settings of the query and of the pipeline.
WHOLE = LineSettings(short=True)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter by, segment, shift)`` of every probe: the multi-match-aware places of Li et al., "Pass-Join" (2011)."""
    out = []
    for shorter in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), shorter - (edits + 1 - i))
            high = min(i - 1, shorter + (edits + 1 - i))
            out += [(shorter, i, shift) for shift in range(low, high + 1)]
    return out


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``node, bucket, is_index`` of ``lines`` (``node, line, length``): a row per probe that fits its line. Probes are made into
    rows first, so that the generated code holds one key's expression and not that of all."""
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, ("shorter", "i", "shift"))]) for p in probes(edits)])
    rows = lines.select("node", "line", "length", F.inline(table))
    rows = rows.withColumn("other", F.col("length") - F.col("shorter"))
    rows = rows.withColumn("base", F.expr(f"other div {edits + 1}").cast("int"))
    short = F.lit(edits + 1) - (F.col("other") - F.col("base") * (edits + 1))  # segments of the base length come first
    rows = rows.withColumn("short", short)
    before = (F.col("i") - 1) * F.col("base") + F.greatest(F.lit(0), F.col("i") - 1 - F.col("short"))
    rows = rows.withColumn("start", F.lit(1) + before + F.col("shift"))
    rows = rows.withColumn("size", F.col("base") + F.when(F.col("i") > F.col("short"), 1).otherwise(0))
    rows = rows.filter("base > 0 and start >= 1 and start + size - 1 <= length")
    bucket = F.xxhash64("other", "i", F.substring("line", F.col("start"), F.col("size")))
    is_index = ((F.col("shorter") == 0) & (F.col("shift") == 0)).cast("int")
    return rows.select("node", bucket.alias("bucket"), is_index.alias("is_index"))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings, over code points, is at most ``edits``.

    Banded form of Myers' bit-vector algorithm: a column of the band is ``2 * edits + 1`` bits, held as vertical steps up (vp)
    and down (vn). The distance follows the lower edge of the band until it reaches the last row, then that row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def bits_not(x: Column) -> Column:
        return F.lit(full).bitwiseXOR(x)

    def step(state: Column, j: Column, x: Column, y: Column, m: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        match = F.lit(0)
        for r in range(width):
            same = F.get(x, j - 1 - edits + r) == F.get(y, j - 1)
            match = match.bitwiseOR(F.when(F.coalesce(same, F.lit(False)), 1 << r).otherwise(0))
        return F.transform(
            F.array(F.struct(match.alias("m"), vp.alias("vp"), vn.alias("vn"))),
            lambda s: F.struct(
                (s["m"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["m"]).bitwiseOR(s["vn"])
                .bitwiseAND(F.lit(full)).alias("d0"),
                s["vp"].alias("vp"), s["vn"].alias("vn"),
            ),
        )[0]

    def advance(state: Column, j: Column, x: Column, y: Column, m: Column) -> Column:
        def finish(s: Column) -> Column:
            d0 = s["d0"]
            hp = s["vn"].bitwiseOR(bits_not(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            row = m - j + edits  # where the last row lies in this column's band
            edge = F.when(F.shiftright(d0, width - 1).bitwiseAND(F.lit(1)) == 1, 0).otherwise(1)
            along = F.expr("0") + F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1)) - F.call_function(
                "shiftright", hn, row
            ).bitwiseAND(F.lit(1))
            return F.struct(
                hn.bitwiseOR(bits_not(F.shiftright(d0, 1).bitwiseOR(hp))).alias("vp"),
                F.shiftright(d0, 1).bitwiseAND(hp).alias("vn"),
                (state["d"] + F.when(row >= 2 * edits, edge).otherwise(along)).alias("d"),
            )

        return F.transform(F.array(step(state, j, x, y, m)), finish)[0]

    start = F.struct(
        F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d")
    )
    # the longer string gives the rows, so that the band always reaches the last one
    longer, other = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    parts = F.array(F.struct(F.split(longer, "").alias("x"), F.split(other, "").alias("y")))
    distance = F.transform(
        parts,
        lambda p: F.aggregate(
            F.sequence(F.lit(1), F.size(p["y"])), start, lambda s, j: advance(s, j, p["x"], p["y"], F.size(p["x"])),
            lambda s: s["d"],
        ),
    )[0]
    return (F.abs(F.length(a) - F.length(b)) <= edits) & (distance <= edits)


def _takes_part(line: Column, settings: LineSettings) -> Column:
    long = F.length(line) >= settings.least
    return long | line.rlike(r"\S") if settings.short else long


def _lines(docs: DataFrame, settings: LineSettings) -> DataFrame:
    """``doc_id, at, line, node, length`` of the lines that take part; a node is a line's 64-bit hash."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.withColumn("length", F.length("line")).filter(_takes_part(F.col("line"), settings)).withColumn(
        "node", F.xxhash64("line")
    )


def _different(docs: DataFrame, settings: LineSettings) -> DataFrame:
    """``node, line, length, first``: one row per different line that takes part, with its first place, stored."""
    lines = _lines(docs, settings)
    folded = lines.groupBy("node").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.any_value("line").alias("line"))
    return stage(folded.withColumn("length", F.length("line")), "lines")


def line_classes(lines: DataFrame, settings: LineSettings | None = None) -> DataFrame:
    """``node, component`` of those different lines (``node, line, length``, stored) that lie within ``edits`` edits of another,
    over chains of such lines."""
    settings = settings or LineSettings()
    lines = lines.filter(F.col("length") >= settings.least)
    keyed = stage(segment_keys(lines, settings.edits), "keyed")
    met = keyed.groupBy("bucket").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("is_index").alias("indexed")
    )
    met = stage(met.filter("lo <> hi and indexed = 1").select("bucket"), "met")
    buckets = semi_filter(keyed.select("bucket", "node"), "bucket", met, "bucket").join(met, "bucket").distinct()
    buckets = stage(buckets, "buckets")
    nodes = buckets.select("node").distinct()
    texts = semi_filter(lines.select("node", "line"), "node", nodes, "node").join(nodes, "node")
    texts = stage(texts.withColumn("facts", _letters(F.col("line"))), "texts")
    possible = _may_be_near(settings.edits)

    def verify(pairs: DataFrame) -> DataFrame:
        named = pairs.join(texts.toDF("a", "la", "fa"), "a").join(texts.toDF("b", "lb", "fb"), "b")
        near = named.filter(possible(F.col("fa"), F.col("fb"), F.col("fb")))
        return near.filter(within_edits(F.col("la"), F.col("lb"), settings.edits)).select("a", "b")

    return link_buckets(
        buckets, verify, lambda nodes: texts.join(nodes, "node", "left_semi").select("node", "facts"), possible
    )


def _letters(line: Column) -> Column:
    """How often each of ``LETTERS`` occurs, and the length."""
    size = F.length(line)
    counts = [(size - F.length(F.translate(line, c, ""))).alias(c) for c in LETTERS]
    return F.struct(size.alias("size"), *counts)


def _may_be_near(edits: int):
    """An edit changes the length by one at most, and at most two letter counts by one each. ``low`` and ``high`` bound the
    counts of one or several lines."""

    def possible(x: Column, low: Column, high: Column) -> Column:
        gaps = [F.greatest(low[c] - x[c], x[c] - high[c], F.lit(0)) for c in ("size", *LETTERS)]
        return (gaps[0] <= edits) & (sum(gaps[2:], gaps[1]) <= 2 * edits)

    return possible


def dedup_lines(docs: DataFrame, settings: LineSettings | None = None) -> DataFrame:
    """``docs`` with each class of near-equal lines reduced to its first line: columns as given, ``text`` without the removed
    lines, and ``n_lines``, ``n_removed`` (clashing names are replaced).

    Lines are what line feeds separate. Those of at least ``least`` characters form classes: equal lines, and lines linked by
    at most ``edits`` edits, over chains. Of a class the occurrence with the smallest ``doc_id``, then the smallest place,
    stays and all others go. Shorter lines form classes of equal lines with ``short``, unless they are blank, and stay without it.
    Every document stays, if need be with an empty text. Null text stays null
    with 0 lines, an empty text has one line, documents with a null id are passed through and take no part; rows that
    share an id count as one document, so repeated rows lose the same lines. An empty table gives an empty table.
    Lines are told apart by 64-bit hashes.
    """
    settings = settings or LineSettings()
    docs = docs.drop("n_lines", "n_removed")
    lines = _different(docs, settings)
    named = lines.select("node", "first").join(line_classes(lines, settings), "node", "left")
    alone = named.filter("component is null").select("first")
    heads = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first")
    kept = alone.unionByName(heads).select("first.doc_id", "first.at").groupBy("doc_id").agg(
        F.collect_list("at").alias("__kept")
    )
    kept = kept.withColumnRenamed("doc_id", "__doc")
    every = F.split("text", "\n")
    joined = docs.join(kept, F.col("doc_id") == F.col("__doc"), "left").withColumn("__lines", every)
    outside = F.filter(
        F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~_takes_part(F.get("__lines", i), settings)
    )
    stays = F.array_sort(F.array_union(outside, F.coalesce("__kept", F.array().cast("array<int>"))))
    stays = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.size("__lines") - 1)).otherwise(stays)
    stays = F.filter(stays, lambda i: i < F.size("__lines"))
    rebuilt = joined.withColumn("__stays", F.when(F.col("text").isNotNull(), stays))
    text = F.when(
        F.size("__stays") == F.size("__lines"), F.col("text")
    ).otherwise(F.array_join(F.transform("__stays", lambda i: F.get("__lines", i)), "\n"))
    return rebuilt.select(
        *[F.when(F.col("text").isNotNull(), text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNotNull(), F.size("__lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.size("__lines") - F.size("__stays")).otherwise(0).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of lines, of removed lines, and a digest of the text that is left."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, WHOLE).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {}
